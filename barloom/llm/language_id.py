"""Language identification with error-correcting output codes.

Each language gets a codeword. For each bit a binary n-gram classifier is learned that tells the
languages with a one from those with a zero. A text is given the language whose codeword has the
least total loss against the margins of all bits; if the runner-up is close, the text is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, sampled

#: Buckets of hashed n-grams, a power of two; bucket 0 is for n-grams that say nothing.
BUCKETS = 1 << 14
#: Languages up to this number get the exhaustive code, others a random one of BITS_PER_LOG bits.
EXHAUSTIVE, BITS_PER_LOG = 6, 12
#: Turns a mean log ratio per n-gram into a margin.
SHARPNESS = 6.0
#: Probability gap to the runner-up under which a text is flagged as ambiguous.
AMBIGUOUS = 0.2
#: Training documents at most.
SAMPLE_DOCS = 20_000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))
_CHUNK = 1 << 20


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the lower-cased text, without those that hold no two letters in a row."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(_TO_SPACE) + b" "
    for at in range(0, len(data) - 2, _CHUNK):
        b = np.frombuffer(data[at : at + _CHUNK + 2], dtype=np.uint8).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        hashed = ((code * np.uint32(2654435761)) >> np.uint32(18)) % np.uint32(BUCKETS - 1) + 1
        yield hashed[(b[1:-1] != 32) & ((b[:-2] != 32) | (b[2:] != 32))]


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits in two, or random ones that keep rows apart."""
    if languages <= EXHAUSTIVE:
        masks = range(1, 1 << max(languages - 1, 0))
        return np.array([[1 if k < languages - 1 and m >> k & 1 else -1 for m in masks] for k in range(languages)], dtype=np.float64)
    bits, best, apart = int(np.ceil(BITS_PER_LOG * np.log2(languages))), None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((languages, bits)) < 0.5, -1.0, 1.0)
        gap = bits - (code @ code.T - 2 * bits * np.eye(languages)).max()
        if gap > apart and (np.abs(code.sum(0)) < languages).all():
            best, apart = code, gap
    return best


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, codewords and a weight per n-gram bucket and bit, from n-gram counts per language."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for hashed in grams(text):
                    total += np.bincount(hashed, minlength=BUCKETS)
        for lang, total in totals.items():
            held = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": held.astype(np.int32), "n": total[held]})

    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = sampled(known, known, id_col, sample_docs).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Tasks' counts are added up by Spark; the driver gets one number per language and bucket.
    sums = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    per_lang = {}
    for lang, part in sums.groupby("lang"):
        per_lang[lang] = np.zeros(BUCKETS, dtype=np.int64)
        per_lang[lang][part["bucket"]] = part["n"]
    languages = sorted(per_lang)
    code = codewords(len(languages))
    if code.size == 0:
        return languages, code, np.zeros((BUCKETS, 0), dtype=np.float32)
    share = np.array([per_lang[k] / max(per_lang[k].sum(), 1) for k in languages])
    smooth = 0.01 / BUCKETS
    weights = np.empty((BUCKETS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        ones, zeros = share[code[:, bit] > 0].mean(0), share[code[:, bit] < 0].mean(0)
        weights[:, bit] = np.log((ones + smooth) / (zeros + smooth))
    weights[0] = 0
    return languages, code, np.clip(weights, -6, 6)


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[int, float, float]:
    """The codeword of least logistic loss, its probability and its gap to the runner-up."""
    loss = np.logaddexp(0.0, -code * margins).sum(1)
    p = np.exp(loss.min() - loss)
    p /= p.sum()
    order = np.argsort(-p, kind="stable")
    return int(order[0]), float(p[order[0]]), float(p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0))


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Language of every text: ``id_col, held_out, lang_pred, score, ambiguous``.

    Only text and non-null ``lang_col`` of rows are learned from whose id's crc32 (as text) modulo
    ``folds`` isn't ``held_out``; of those, at most ``sample_docs``. A null text, or one without a
    letter, is ``und`` with score 0; so is every text if there is nothing to learn from. A null id
    is never held out nor learned from. Repeated rows each get their own result; other columns are
    ignored; an empty table gives an empty result.
    """
    fold = F.coalesce(crc_fold(id_col, folds) == held_out, F.lit(False))
    languages, code, weights = fit(df.filter(~fold), id_col, text_col, lang_col, sample_docs)
    shared = df.sparkSession.sparkContext.broadcast((languages, code, weights))

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, words, table = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                if not names or not text or not _LETTER.search(text):
                    rows.append((UNKNOWN, 0.0, True))
                    continue
                total, n = np.zeros(table.shape[1]), 0
                for hashed in grams(text):
                    total += np.take(table, hashed, axis=0).sum(0, dtype=np.float64)
                    n += len(hashed)
                best, p, gap = decode(SHARPNESS * total / max(n, 1), words)
                rows.append((names[best], p, gap < AMBIGUOUS))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "ambiguous"])

    out = df.select(F.col(id_col), fold.alias("held_out"), predict(F.col(text_col)).alias("__p"))
    return out.select(id_col, "held_out", "__p.lang_pred", "__p.score", "__p.ambiguous")
