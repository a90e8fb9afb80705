"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other alphabets, and digits or symbols
that stand for letters inside a word. Patterns are beginnings of words or whole words; each has a
weight, the log ratio of how often toxic and clean training documents hold it. A hit inside an
exception phrase doesn't count; besides the given ones, those are the phrases of a hit word and a
word next to it that clean documents hold. The sum of weights, for itself and by length, gives the
score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, crc_fold, discard, materialize, sampled
from .quality_crf import train_labels

#: Training documents at most.
SAMPLE_DOCS = 12_000
#: Shortest and longest beginning of a word in the lexicon, and longest whole word. Longer words can
#: be hit by their beginnings only.
SHORTEST, LONGEST, LONGEST_WORD = 4, 12, 48
#: A pattern needs so many toxic documents, and to be so many times likelier there.
LEAST_DOCS, LEAST_RATIO = 4, 20.0
#: A phrase around a hit is an exception if so many clean documents hold it, and if it is so many
#: times likelier there.
EXCEPTION_DOCS, EXCEPTION_RATIO = 4, 4.0
#: Items that a task counts before it gives up their sums and starts anew.
HELD = 500_000
#: Marks a whole word among patterns.
END = " "
#: Phrases in which a listed word is harmless; more are learned from clean documents.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "idiot proof", "idiot light", "pond scum")

# Letters of other alphabets that look like Latin ones, and what stands for letters inside a word.
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝαορνικıɡɑ",
    "aeopcyxijshdqwaopvikiga",
) | {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)} | {0x200B: None, 0x200D: None, 0xAD: None}
LEET = str.maketrans("013457@$", "oieastas")
_LEET_INSIDE = re.compile(r"[^\W_]*[013457@$][^\W_]*(?:[@$]+[^\W_]+)*")
_HAS_LEET = re.compile(r"[^\W\d_][013457@$]+[^\W\d_]|(?<![^\W_])[013457@$]+[^\W\d_]{2}")
_WORD = re.compile(r"[^\W_]+")
_LAST_WORD, _NEXT_WORD = re.compile(r"[^\W_]+ $"), re.compile(r" [^\W_]+")


def fold(text: str) -> str:
    """The text with look-alikes, digits and symbols inside words as plain letters."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(LOOK_ALIKES)
    return _LEET_INSIDE.sub(_unleet, text) if _HAS_LEET.search(text) else text


def _unleet(match: re.Match) -> str:
    word = match.group()
    body = word.rstrip("@$")
    letters = sum(c.isalpha() for c in body)
    return body.translate(LEET) + word[len(body):] if letters >= 2 and letters * 3 >= len(body) else word


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slopes: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -6.0]))

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        patterns: dict[str, list[tuple[bool, float]]] = {}
        for pattern, weight in self.weights.items():
            patterns.setdefault(pattern.rstrip(END), []).append((pattern.endswith(END), weight))
        for phrase in self.exceptions:
            patterns.setdefault(phrase, []).append((True, 0.0))
        for text, kinds in patterns.items():
            found.add_word(text, (len(text), kinds))
        if patterns:
            found.make_automaton()
        return found


def word_hits(automaton: ahocorasick.Automaton, folded: str) -> dict[int, float]:
    """The best weight at each start of a word that is hit outside all exception phrases."""
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    last = len(folded) - 1
    for end, (length, kinds) in automaton.iter(folded):
        start = end - length + 1
        if start and folded[start - 1].isalnum():
            continue
        at_end = end == last or not folded[end + 1].isalnum()
        for whole, weight in kinds:
            if whole and not at_end:
                continue
            if weight:
                best[start] = max(weight, best.get(start, weight))
            else:
                excused.append((start, end))
    if not excused:
        return best
    # One sweep over phrases and hits in the text's order: a hit is excused while a phrase reaches it.
    excused.sort()
    kept, at, reach = {}, 0, -1
    for start in sorted(best):
        while at < len(excused) and excused[at][0] <= start:
            reach = max(reach, excused[at][1])
            at += 1
        if start > reach:
            kept[start] = best[start]
    return kept


def hits(automaton: ahocorasick.Automaton, text: str) -> tuple[float, int]:
    """Sum of the weights of hits, the best one at each word, and the number of words hit."""
    if not len(automaton):
        return 0.0, 0
    best = word_hits(automaton, fold(text))
    return math.fsum(best.values()), len(best)


def features(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, float]:
    """Log of the sum of weights, and of that sum per hundred words."""
    if not text:
        return 0.0, 0.0
    total, _ = hits(automaton, text)
    words = text.count(" ") + text.count("\n") + 1
    return float(np.log1p(total)), float(np.log1p(100 * total / words))


def candidates(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(_WORD.findall(fold(text))):
        out.update(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))
        if 2 < len(word) <= LONGEST_WORD:
            out.add(word + END)
    return out


def phrases(automaton: ahocorasick.Automaton, text: str) -> set[str]:
    """Each hit word with the word before it and with the word after it, one space between."""
    folded, out = fold(text), set()
    for start in word_hits(automaton, folded):
        word = _WORD.match(folded, start).group()
        end = start + len(word)
        before = _LAST_WORD.search(folded[max(0, start - LONGEST_WORD) : start])
        after = _NEXT_WORD.match(folded, end)
        if before:
            out.add(before.group() + word)
        if after and len(after.group()) <= LONGEST_WORD:
            out.add(word + after.group())
    return out


def document_counts(rows: DataFrame, listed) -> DataFrame:
    """``item, half, y, n``: how many documents of ``rows(y, text, half)`` hold each of ``listed()(text)``.

    Each task counts for itself, a bounded number of items at a time; only its sums are shuffled.
    """
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("toxicity")
        find, seen = listed(), Counter()

        def sums() -> Iterator[pd.DataFrame]:
            keys = list(seen)
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                out = pd.DataFrame(part, columns=["item", "half", "y"])
                out["n"] = [seen[k] for k in part]
                yield out
            seen.clear()

        for batch in batches:
            for y, half, text in zip(batch["y"], batch["half"], batch["text"], strict=True):
                if text:
                    seen.update((item, half, y > 0) for item in find(text))
                if len(seen) >= HELD:
                    yield from sums()
        yield from sums()

    schema = "item string, half boolean, y boolean, n long"
    return rows.mapInPandas(tally, schema).groupBy("item").agg(*[
        F.sum(F.when((F.col("half") == half) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"{'toxic' if y else 'clean'}_{int(half)}")
        for half in (False, True) for y in (False, True)])


def log_ratio(toxic: Column, clean: Column, sizes: tuple[int, int]) -> Column:
    """How much likelier a toxic document holds an item than a clean one; ``sizes`` of toxic and clean documents."""
    return F.log(((toxic + 0.5) / (sizes[0] + 1)) / ((clean + 0.5) / (sizes[1] + 1)))


def learn(counts: DataFrame, toxic: Column, clean: Column, sizes: tuple[int, int], least: int) -> dict[str, float]:
    """Weights of the shortest patterns that tell toxic documents. Only telling ones reach the driver."""
    weighed = counts.filter(toxic >= least).select("item", log_ratio(toxic, clean, sizes).alias("w"))
    found = {r.item: r.w for r in weighed.filter(F.col("w") >= math.log(LEAST_RATIO)).collect()}
    kept: dict[str, float] = {}
    for pattern in sorted(found, key=lambda p: (len(p), p)):
        body = pattern.rstrip(END)
        above = [kept[body[:k]] for k in range(SHORTEST, len(body) + (pattern != body)) if body[:k] in kept]
        # A longer pattern stays only if it tells much more than a beginning that is kept already.
        if not above or found[pattern] > max(above) + 1.0:
            kept[pattern] = found[pattern]
    return kept


def fit_scores(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, slightly shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.array([0.05] * (x.shape[1] - 1) + [1e-4])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - penalty * w), -3, 3)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, exceptions: tuple[str, ...] = EXCEPTIONS, sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    """A lexicon and its score from at most ``sample_docs`` labelled documents.

    The lexicon is counted on all of them. For the score two more are counted on a half each and
    measured on the other half, so that patterns which only fit their own documents don't lift it.
    """
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("__y"))
    known = sampled(known, known, id_col, sample_docs)
    text = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    half = F.pmod(F.xxhash64(F.col(id_col), F.lit("half")), F.lit(2)) == 0
    rows = text.join(F.broadcast(known), id_col).select(F.col("__y").alias("y"), F.col("__text").alias("text"), half.alias("half"))
    rows = materialize(rows, "toxicity-sample")
    size = {(r.half, r.toxic): r.n for r in rows.groupBy("half", (F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    of = lambda *halves: tuple(sum(size.get((h, y), 0) for h in halves) for y in (True, False))
    if 0 in of(True, False):
        discard(rows)
        return Lexicon({}, exceptions, np.array([0.0, 0.0, 6.0 if of(True, False)[0] else -6.0]))
    counts = materialize(document_counts(rows, lambda: candidates), "toxicity-counts")
    sums = {name: [F.col(f"{name}_0"), F.col(f"{name}_1")] for name in ("toxic", "clean")}
    lexicon = Lexicon(learn(counts, sum(sums["toxic"][1:], sums["toxic"][0]), sum(sums["clean"][1:], sums["clean"][0]), of(True, False), LEAST_DOCS), exceptions)
    halves = [learn(counts, sums["toxic"][h], sums["clean"][h], of(bool(h)), LEAST_DOCS) for h in (0, 1)]

    around = document_counts(rows, lambda: partial(phrases, lexicon.automaton())) if lexicon.weights else None
    if around is not None:
        toxic, clean = sum(sums["toxic"][1:], sums["toxic"][0]), sum(sums["clean"][1:], sums["clean"][0])
        harmless = around.filter((clean >= EXCEPTION_DOCS) & (log_ratio(toxic, clean, of(True, False)) <= -math.log(EXCEPTION_RATIO)))
        lexicon.exceptions = (*exceptions, *sorted(r["item"] for r in harmless.select("item").collect()))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("toxicity")
        automata = [Lexicon(halves[h], lexicon.exceptions).automaton() for h in (0, 1)]
        for batch in batches:
            x = [features(automata[not h], t) for h, t in zip(batch["half"], batch["text"], strict=True)]
            yield pd.DataFrame({"y": batch["y"], "a": [v[0] for v in x], "b": [v[1] for v in x]})

    got = rows.mapInPandas(measure, "y double, a double, b double").toPandas()
    discard(rows, counts)
    lexicon.slopes = fit_scores(got[["a", "b"]].to_numpy(), (got["y"] > 0).to_numpy(dtype=np.float64))
    return lexicon


def scorer(lexicon: Lexicon, spark):
    """A Pandas UDF from a text column to its toxicity, 0 to 1."""
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity")
        automaton, slopes = shared.value.automaton(), shared.value.slopes
        for texts in batches:
            x = np.array([features(automaton, t) for t in texts], dtype=np.float64).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ slopes[:2] + slopes[2], -30, 30))))

    return toxicity


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_out: int = 1, threshold: float = 0.7, exceptions: tuple[str, ...] = EXCEPTIONS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Toxicity of every text: ``id_col, held_out, score, predicted``.

    Labels are learned from rows whose id's crc32 (as text) modulo ``folds`` isn't ``held_out``, at
    most ``sample_docs`` of them; a document labelled twice counts as its larger label. Nulls among
    labels are ignored. A null or empty text has no hit and is scored as such. With labels of one
    kind or none, every text gets one score near 0 or 1. A null id is never held out; repeated rows
    each get their result; other columns are ignored; an empty table stays empty.
    """
    lexicon = fit(docs, train_labels(labels, id_col, folds, held_out), id_col, text_col, label_col, exceptions, sample_docs)
    fold_out = F.coalesce(crc_fold(id_col, folds) == held_out, F.lit(False))
    out = docs.select(F.col(id_col), fold_out.alias("held_out"), scorer(lexicon, docs.sparkSession)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
