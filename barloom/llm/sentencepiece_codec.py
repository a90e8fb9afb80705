"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one pass of dynamic programming.

The automaton holds all pieces. At each position its output links give every piece that ends there,
and each tries to relax the best segmentation of the text up to that position: the largest sum of
piece scores, the usual Viterbi. Its ids are ``best_ids``.

A BPE model's scores are merge ranks; the reference library doesn't add them up but merges by them,
so its ids differ from those of the best sum. Both belong to the same text. Where a trained model
expects the library's, ``ids`` holds them: they come from the library itself, word by word. For a
unigram model the library looks for the best sum as well, and ``ids`` are ``best_ids``.

Two characters that stand next to each other in no piece are always a border. Between borders,
strings are segmented once per worker and then looked up.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that stands for a space inside pieces.
MARK = "\u2581"
#: Longer units are segmented each time; entries of a worker's cache before it starts anew.
LONGEST, CACHE = 40, 800_000
#: How far below the worst score an unknown character lies in a unigram model.
UNKNOWN_PENALTY = 10.0


class Codec:
    """Encodes and decodes texts with the pieces of one model file."""

    def __init__(self, model: bytes, unigram: bool):
        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = range(library.vocab_size())
        self.unigram, self.unknown = unigram, library.unk_id()
        special = {i for i in size if library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)}
        names = [library.id_to_piece(i) for i in size]
        self.score = [library.get_score(i) for i in size]
        self.scores = np.array(self.score)
        self.ids = {names[i]: i for i in size if i not in special}
        self.bytes = {int(names[i][3:5], 16): i for i in size if library.is_byte(i)}
        self.raw = [
            bytes([int(names[i][3:5], 16)]) if library.is_byte(i) else b"" if library.is_control(i)
            else " \u2047 ".encode() if library.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in size
        ]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece), self.score[i]))
        self.automaton.make_automaton()
        self.floor = min((self.score[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        inner = any(MARK in p[1:] and p.strip(MARK) for p in self.ids)
        if not unigram and inner:
            raise ValueError("pieces that span words aren't supported")
        # No piece joins two words, so words are units.
        self.unit = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not inner else re.compile(r"(?s).+")
        # Without bytes to fall back to, unknown characters in a row are one unknown piece.
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)} if self.bytes else None
        if not unigram and (self.inside is None or any("\n" in p for p in self.ids)):
            raise ValueError("a BPE model that falls back to bytes and has no piece with a line's end is expected")
        self.apart = len(library.encode("\n"))
        self.known = {p for p in self.ids if len(p) == 1}
        #: Ids of units and of what lies between the borders of a unit: (the library's, the best).
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def encode_both(self, text: str | None) -> tuple[bytes, bytes]:
        """The library's ids and those of the best sum, as native 32-bit integers."""
        if not text:
            return b"", b""
        units = self.unit.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.words.get, units))
        if None in found:
            new = self.look_up({unit for unit, ids in zip(units, found, strict=True) if ids is None})
            found = [ids or new[unit] for unit, ids in zip(units, found, strict=True)]
        library, best = zip(*found, strict=True)
        return b"".join(library), b"".join(best)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_both(text)[0], dtype=np.int32).tolist()

    def look_up(self, units: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of new units, put together from those between their borders, and kept for later."""
        if len(self.words) >= CACHE:
            self.words.clear()
        split = {} if self.inside is None else {unit: self.between_borders(unit) for unit in units if not unit[1:].isalpha()}
        parts = {part for of in split.values() for part in of}
        whole = [part for part in (units.difference(split) | parts) if part not in self.words]
        best = [self.segment(part) for part in whole]
        if self.unigram:
            library = best
        else:
            # The library puts a mark before every text; a line's end keeps it apart from the part.
            coded = self.library.encode(["\n" + part.replace(MARK, " ") for part in whole], num_threads=1)
            library = [array("i", ids[self.apart :]).tobytes() for ids in coded]
        new = dict(zip(whole, zip(library, best, strict=True), strict=True))
        known = self.words
        for unit, of in split.items():
            if len(of) > 1:
                pairs = [new.get(part) or known[part] for part in of]
                new[unit] = b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])
        known.update(new if max(map(len, new), default=0) <= LONGEST else {unit: ids for unit, ids in new.items() if len(unit) <= LONGEST})
        return new

    def between_borders(self, unit: str) -> list[str]:
        inside, at, parts = self.inside, 0, []
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in inside:
                parts.append(unit[at:k])
                at = k
        parts.append(unit[at:])
        return parts

    def segment(self, unit: str) -> bytes:
        """The ids of the largest sum of scores, by relaxing each end with all pieces that end there."""
        n, worst = len(unit), float("-inf")
        best, back = [0.0] + [worst] * n, [(self.unknown, 1)] * (n + 1)
        if self.known.issuperset(unit):
            for end, piece in self.automaton.iter(unit):
                _, length, score = piece
                end += 1
                total = best[end - length] + score
                if total > best[end]:
                    best[end], back[end] = total, piece
        else:
            settled, known = 0, 0  # ends up to the first are final; where the last piece of one character ends
            for end, piece in chain(self.automaton.iter(unit), ((n, None),)):
                while settled < end:
                    settled += 1
                    if known != settled and best[settled - 1] + self.floor > best[settled]:
                        best[settled], back[settled] = best[settled - 1] + self.floor, (self.unknown, 1)
                if piece is None:
                    break
                _, length, score = piece
                end += 1
                known = end if length == 1 else known
                total = best[end - length] + score
                if total > best[end]:
                    best[end], back[end] = total, piece
        out, end = [], n
        while end:
            i, length = back[end][:2]
            if i == self.unknown and self.bytes:
                out.extend(self.bytes[b] for b in reversed(unit[end - 1 : end].encode("utf-8", "surrogatepass")))
            elif i != self.unknown or not out or out[-1] != i:
                out.append(i)
            end -= length
        return array("i", out[::-1]).tobytes()

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_decode(df: DataFrame, model_path: str, unigram: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text and the text that they give again:
    ``id_col, ids, best_ids, best_score, decoded, came_back``.

    ``ids`` are the library's, without begin or end; ``best_ids`` those of the segmentation whose
    scores have the largest sum, ``best_score``. ``decoded`` is the text of ``best_ids`` and
    ``came_back`` whether it is the text given. A null text counts as empty: no ids, sum 0, an
    empty text. Null or repeated document ids pass through; other columns are ignored; an empty
    table gives an empty result. Decoding gives the text again, except that the mark character
    itself comes back as a space, as in the library.
    """
    model = read_model(model_path)
    given = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lists = pa.list_(pa.int32())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, unigram)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            coded = [codec.encode_both(t) for t in texts]
            library, best = (as_lists([c[k] for c in coded]) for k in (0, 1))
            sums = [float(codec.scores[np.frombuffer(c[1], dtype=np.int32)].sum()) for c in coded]
            decoded = [codec.decode(np.frombuffer(c[1], dtype=np.int32).tolist()) for c in coded]
            same = [a == b for a, b in zip(decoded, texts, strict=True)]
            columns = [batch.column("id"), library.cast(lists), best.cast(lists), pa.array(sums, pa.float64()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "best_ids", "best_score", "decoded", "came_back"])

    kind = given.schema["id"].dataType.simpleString()
    out = given.mapInArrow(code, f"id {kind}, ids array<int>, best_ids array<int>, best_score double, decoded string, came_back boolean")
    return out.withColumnRenamed("id", id_col)


def as_lists(ids: list[bytes]) -> pa.Array:
    """One list of ids for each row's bytes."""
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


_codecs: dict[tuple[int, bool], Codec] = {}


def codec_of(model: bytes, unigram: bool) -> Codec:
    """The worker's codec for a model, kept from task to task."""
    key = (hash(model), unigram)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, unigram)
    return _codecs[key]
