"""Packing of tokenized documents into fixed-length sequences by the harmonic method.

Lengths fall into reciprocal classes: a piece of class k is longer than capacity / (k + 1) and at
most capacity / k, so any k of them fit one sequence. A class's sequences are filled with k pieces
each, and a piece's place follows from its rank in its class alone. Workers count their pieces per
class; the prefix sums of those counts turn a worker's own ranks into global ones, so only the last
sequence of each class stays unfinished, whatever the number of workers.

Since documents may be cut, long ones are cut where a class is filled exactly: at whole capacities,
then at capacity / 2, / 3, ... as long as keeping a rest in one piece would waste too much.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import claim, materialize
from .token_counts import SPACE

#: A rest is kept whole when it fills at least this share of its class's slot.
FILL = 0.97
#: Rests of at most capacity / SMALL tokens are never cut again.
SMALL = 16
#: Longer words are encoded each time; entries of a worker's cache before it starts anew.
LONGEST, CACHE = 40, 400_000

# Fixed value: the published split pattern of this vocabulary; letters first, which begin no other part.
WORD = rf"\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: The same for lower-cased ASCII.
ASCII_WORD = r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9]+"
#: Texts of these characters only are NFC already and lower-cased alike by every Unicode version.
PLAIN = r"[\u0000-\u00ff\u0152\u0153\u0178\u2010-\u2027\u2030-\u203a\u20ac]*"


class WordIds(dict):
    """Lower-cased word to its ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        ids = encode(self.tokenizer, word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


def encode(tokenizer: Tokenizer, text: str) -> bytes:
    return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Encoder:
    """Ids of whole texts; words are encoded once per worker."""

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.words = WordIds(self.tokenizer)
        self.special = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.plain, self.pattern, self.ascii_pattern = regex.compile(PLAIN), regex.compile(WORD), re.compile(ASCII_WORD)

    def ids(self, text: str) -> bytes:
        ascii_only = text.isascii()
        if not (ascii_only or self.plain.fullmatch(text)) or any(token in text for token in self.special):
            return encode(self.tokenizer, text)
        pattern = self.ascii_pattern if ascii_only else self.pattern
        return b"".join(map(self.words.__getitem__, pattern.findall(text.lower())))


def read_definition(path: str) -> str:
    """The tokenizer's JSON, refused unless it lower-cases and splits into independent words."""
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    parsed = json.loads(definition)
    steps = [n["type"] for n in (parsed.get("normalizer") or {}).get("normalizers", [])]
    if steps != ["NFC", "Replace", "Lowercase"] or parsed["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError("a lower-casing BPE with word ends is expected")
    return definition


def cuts(length: int, capacity: int) -> list[int]:
    """Lengths of the pieces that a document of ``length`` tokens is cut into."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k >= SMALL or rest * k >= FILL * capacity:
            pieces.append(rest)
            break
        exact = next(c for c in range(k + 1, capacity + 1) if capacity % c == 0)
        pieces.append(capacity // exact)
        rest -= capacity // exact
    return pieces


def pieces_of(df: DataFrame, definition: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, with its class and its rank among the task's pieces of that class."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, ranks, task = encoder_of(definition), {}, TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                ids = (encoder.ids(text) if text else b"") + end
                start = 0
                for length in cuts(len(ids) // 4, capacity):
                    k = capacity // length
                    rank = ranks[k] = ranks.get(k, -1) + 1
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, task, k, rank))
                    start += length
            out = pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "task", "k", "rank"])
            out["doc"] = out["doc"].astype("Int64")
            yield out

    schema = "doc long, start long, length long, ids_crc32 long, doc_tokens long, task int, k int, rank long"
    return df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInPandas(cut, schema)


def finish(capacity: int, rest: pd.DataFrame) -> pd.DataFrame:
    """The pieces left over by all classes, largest first, each into the first sequence with room."""
    rest = rest.sort_values(["length", "k", "rank"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    room, count, sequence, slot = [], [], [], []
    for length in rest["length"]:
        at = next((i for i, left in enumerate(room) if left >= length), len(room))
        if at == len(room):
            room.append(capacity)
            count.append(0)
        sequence.append(at)
        slot.append(count[at])
        room[at] -= length
        count[at] += 1
    out = rest[["doc", "start", "length", "ids_crc32", "doc_tokens"]].copy()
    out["doc"] = out["doc"].astype("Int64")
    out["sequence_id"], out["slot"] = rest["all_full"] + np.array(sequence, dtype=np.int64), np.array(slot, dtype=np.int64)
    return out


def pack(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of all pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, padded_length``.

    A document's ids are those of its text, without special tokens, and then ``end_id``; a null
    text counts as empty and so has one id. Rows with a null or repeated id are packed like others,
    each as a document of its own. Other columns are ignored; an empty table gives an empty result.
    Each id is in exactly one piece. A sequence holds pieces of one class, or what the classes left
    over, at offsets without gaps from 0, and is padded to ``capacity`` unless its filled length is a power of two.

    The pieces (not the texts) are written once, so the ranks stay as they are when a task is run
    again. What meets in one place are the counts per task and class and, at last, less than k pieces
    of each class k (some 20,000 pieces at most for a capacity of 4096).
    """
    pieces = materialize(pieces_of(df, read_definition(tokenizer_path), end_id, capacity, id_col, text_col), "pieces")
    per_task = pieces.groupBy("k", "task").agg(F.count("*").alias("n"))
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("k").orderBy("task")) - F.col("n")).drop("n")
    classes = per_task.groupBy("k").agg(F.sum("n").alias("n")).withColumn("full", F.floor(F.col("n") / F.col("k")))
    everything = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = classes.select("k", "full", (F.sum("full").over(Window.orderBy("k")) - F.col("full")).alias("first"), F.sum("full").over(everything).alias("all_full"))
    ranked = pieces.join(before.join(first, "k"), ["k", "task"]).withColumn("rank", F.col("before") + F.col("rank"))
    ranked = ranked.withColumn("open", F.col("rank") >= F.col("full") * F.col("k"))
    columns = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]
    whole = ranked.filter("NOT open").withColumns({"sequence_id": F.col("first") + F.floor(F.col("rank") / F.col("k")), "slot": F.col("rank") % F.col("k")}).select(columns)
    # Unfinished sequences: fewer than k pieces of each class, so a bounded number however large the corpus.
    rest = ranked.filter("open").select("doc", "start", "length", "ids_crc32", "doc_tokens", "all_full", "k", "rank")
    schema = "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    placed = whole.unionByName(rest.groupBy("all_full").applyInPandas(lambda left: finish(capacity, left), schema))
    within = Window.partitionBy("sequence_id")
    filled = F.sum("length").over(within)
    return placed.select(
        F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        (F.sum("length").over(within.orderBy("slot")) - F.col("length")).alias("offset"),
        F.when(filled.bitwiseAND(filled - 1) == 0, filled).otherwise(F.lit(capacity).cast("long")).alias("padded_length"),
    )


_encoders: dict[int, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer, kept from task to task."""
    claim("packing", _encoders.clear)
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]
