"""Token counts by a map-side lookup in two tiers.

A byte-level BPE vocabulary splits a text into pre-tokens and encodes each for itself, so the
tokens of a text are the sum over its pre-tokens. The first tier is a compact table of frequent
pre-tokens and their lengths, broadcast to every worker. A miss is encoded once by the library
and kept in a bounded cache of the worker. No pre-token is ever shuffled.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Pre-tokens in the broadcast table; with pre-tokens of at most LONGEST characters it is under 3 MB.
FREQUENT = 32_768
#: Longer pre-tokens are encoded each time, so that no cache holds long strings.
LONGEST = 48
#: Entries of a worker's cache before it starts anew.
CACHE = 400_000
#: Documents that the frequent table is drawn from. It only decides what is quick, never a count.
SAMPLE_DOCS = 2_000

# The published split pattern of byte-level BPE, with White_Space spelt out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters whose class no Unicode version of the last ten years has changed. A text with others
#: goes to the library as a whole, since its tables may be of another version than ours.
UNSETTLED = r"[^\u0000-\u0373\u0400-\u052f\u2000-\u206f\u2100-\u214f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fd5\uac00-\ud7a3]"


class Lengths(dict):
    """Pre-token to its number of tokens; unknown ones are encoded, and kept while there is room."""

    def __init__(self, tokenizer: Tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.frequent = tokenizer, frequent

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of texts in one worker."""

    def __init__(self, definition: str, frequent: dict[str, int]):
        self.tokenizer = Tokenizer.from_str(definition)
        self.lengths = Lengths(self.tokenizer, frequent)
        added = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.pattern, self.unsettled = regex.compile(PRE_TOKEN), regex.compile(UNSETTLED)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.unsettled.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text)
        of = self.lengths.__getitem__
        return len(parts) - 1 + sum(sum(map(of, self.pattern.findall(part))) for part in parts)


def read_definition(path: str) -> str:
    """The tokenizer's JSON, refused unless pre-tokens are independent of each other."""
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    parsed = json.loads(definition)
    before = parsed.get("pre_tokenizer") or {}
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parsed["added_tokens"])
    if parsed.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or not plain:
        raise ValueError("a byte-level BPE without normalizer or prefix space is expected")
    return definition


def frequent_pre_tokens(df: DataFrame, text_col: str, definition: str, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about ``sample_docs`` documents."""
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern, seen = regex.compile(PRE_TOKEN), Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    seen.update(p for p in pattern.findall(text) if len(p) <= LONGEST)
        top = seen.most_common(FREQUENT)
        if top:
            yield pd.DataFrame({"piece": [p for p, _ in top], "n": [n for _, n in top]})

    rows = df.count()
    if not rows:
        return {}
    sample = df.select(F.col(text_col).alias("text")).sample(False, min(1.0, sample_docs / rows), 17)
    top = (
        sample.mapInPandas(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece").collect()
    )
    tokenizer = Tokenizer.from_str(definition)
    pieces = [r.piece for r in top]
    return {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)}


def token_counts(df: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Bytes and tokens of every text: ``id_col, n_bytes, n_tokens, over_limit``.

    ``over_limit`` says whether a text has more than ``limit`` tokens. A null text counts as empty:
    0 bytes, 0 tokens. Ids are passed on as they are, null or repeated; other columns are ignored.
    An empty table gives an empty result. Special strings inside a text are matched as the library
    does by default; nothing is added, truncated or padded.
    """
    spark = df.sparkSession
    definition = read_definition(tokenizer_path)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, definition, frequent_pre_tokens(df, text_col, definition, sample_docs)))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(shared)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    text = F.col(text_col)
    counted = df.select(
        F.col(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


_counters: dict[str, TokenCounter] = {}


def counter_of(shared) -> TokenCounter:
    """The worker's counter for a broadcast, kept from task to task."""
    key, definition, frequent = shared.value
    if key not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(definition, frequent)
    return _counters[key]
