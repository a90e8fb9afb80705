"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe the line and the lines next to it; transitions
let neighbouring lines agree. Forward-backward gives each line's probability of being good, and
their mean, weighted by line length, is the document's evidence.

Labels exist for documents only, so lines are learned in rounds: lines of good documents are good,
lines of bad ones are what the last round's model finds, with at least their worst line bad.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, crc_fold, sampled

#: Training documents at most, and rounds of relabelling.
SAMPLE_DOCS, ROUNDS = 4_000, 3
#: Defaults of ``fit``: lines of one training sequence, and sequences of a document at most. Longer
#: documents give as many, from the beginning to the end in equal steps.
TRAIN_LINES, TRAIN_PARTS = 32, 4
#: Lines and bytes whose features are computed at a time; lines of a chain that advance in step.
BLOCK_LINES, BLOCK_BYTES, LANE = 1 << 15, 1 << 22, 256
#: Scores of a line beyond this say nothing more.
STEEPEST = 60.0

# Classes of bytes: 0 other symbol, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence
# punctuation, 6 exclamation or question mark, 7 part of a character beyond ASCII.
_KINDS = 8
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 5
_KIND[[ord(c) for c in "!?"]] = 6
_KIND[128:] = 7
OWN, REPEATED = 18, 14
WIDTH = 3 * OWN + 3


@dataclass
class Model:
    weights: np.ndarray  # of the features, for "good" against "bad"
    stay: float  # score of two neighbouring lines that agree
    slope: float
    offset: float


def own_features(lines: list[bytes]) -> np.ndarray:
    """What a line's own bytes say; ``repeated`` is left 0."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    length = np.array([len(x) for x in lines], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(length + 1)[:-1])).astype(np.int64)
    kind = _KIND[data]
    share = np.stack([np.add.reduceat(kind == k, start, dtype=np.int64) for k in range(_KINDS)], axis=1).astype(np.float64)
    share[:, 4] -= 1  # the line's own end
    share /= np.maximum(length, 1)[:, None]
    border = np.zeros(len(data), dtype=bool)  # a symbol right behind a letter or digit
    border[1:] = ((kind[1:] == 0) | (kind[1:] == 6)) & (kind[:-1] != 0) & (kind[:-1] != 4) & (kind[:-1] != 6)
    lone = np.zeros(len(data), dtype=bool)  # a symbol that is a word of its own
    lone[1:-1] = (kind[1:-1] == 0) & (kind[:-2] == 4) & (kind[2:] == 4)
    alone = np.add.reduceat(lone, start, dtype=np.int64)
    glued = np.add.reduceat(border, start, dtype=np.int64)
    split = [line.split() for line in lines]
    words = np.array([len(w) for w in split], dtype=np.float64)
    distinct = np.array([len(set(w)) for w in split], dtype=np.float64)
    some = np.maximum(words, 1)
    return np.column_stack([
        share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 5], share[:, 6], share[:, 7],
        np.log1p(length) / 8, length == 0, np.minimum(glued / some, 1), np.minimum(2 * alone / some, 1), np.minimum(length / some / 20, 2),
        distinct / some, np.maximum(0, 1 - distinct / np.maximum(8 * np.log2(some + 1), 1)) * (some > 20), np.zeros(len(lines)), share[:, 2] > 0.5,
        (distinct < 0.4 * words) & (words > 6), alone * 5 > words,
    ])


def lines_of(data: bytes) -> Iterator[list[bytes]]:
    """A text's lines, a bounded number and length of them at a time; one longer line comes alone."""
    at, end = 0, len(data)
    while True:
        stop = end if end - at <= BLOCK_BYTES else data.find(b"\n", at + BLOCK_BYTES)
        stop = end if stop < 0 else stop
        lines = data[at:stop].split(b"\n")
        for k in range(0, len(lines), BLOCK_LINES):
            yield lines[k : k + BLOCK_LINES]
        if stop == end:
            return
        at = stop + 1


def blocks(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Own features of all lines of the texts, block by block: features, lengths, and which text each line is of."""
    lines, text, size, repeated = [], [], 0, []

    def features():
        own = own_features(lines)
        own[:, REPEATED] = repeated
        return own, np.array([len(x) for x in lines], dtype=np.int64), np.array(text, dtype=np.int64)

    for k, t in enumerate(texts):
        seen: set[int] = set()
        for part in lines_of((t or "").encode("utf-8", "replace")):
            for line in part:
                blank = not line or line.isspace()
                key = 0 if blank else xxhash.xxh3_64_intdigest(line)
                repeated.append(not blank and key in seen)
                if not blank:
                    seen.add(key)
            lines += part
            text += [k] * len(part)
            size += sum(map(len, part))
            if len(lines) >= BLOCK_LINES or size >= BLOCK_BYTES:
                yield features()
                lines, text, size, repeated = [], [], 0, []
    if lines:
        yield features()


def wide(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of lines with those of the lines before and after them in their sequence."""
    first = np.zeros(len(own), dtype=bool)
    first[np.cumsum(counts) - counts] = True
    end = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[end] = 0, 0
    return np.column_stack([own, before, after, first, end, np.ones(len(own))]).astype(own.dtype)


def emissions(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of every line, its length, and how many lines each text has.

    A line's features meet three parts of the weights: for itself, for the line after it and for
    the line before it. Only those three numbers are kept, so the wide features never exist.
    """
    w = np.column_stack(np.split(model.weights[: 3 * OWN], 3))
    scores, length, text = [], [], []
    for own, n, k in blocks(texts):
        scores.append(own @ w), length.append(n), text.append(k)
    scores, length = np.concatenate(scores), np.concatenate(length)
    counts = np.bincount(np.concatenate(text), minlength=len(texts))
    start = np.cumsum(counts) - counts
    first, end = start, start + counts - 1
    total = scores[:, 0] + model.weights[-1]
    ahead, behind = np.roll(scores[:, 1], 1), np.roll(scores[:, 2], -1)
    ahead[first], behind[end] = 0, 0
    total += ahead + behind
    total[first] += model.weights[3 * OWN]
    total[end] += model.weights[3 * OWN + 1]
    return total, length, counts


def pass_on(ratio: np.ndarray, stay: float) -> np.ndarray:
    """The log ratio of good to bad of a line's neighbour, from that of the line."""
    return np.logaddexp(ratio + stay, 0.0) - np.logaddexp(ratio, stay)


def carried(emission: np.ndarray, counts: np.ndarray, stay: float) -> np.ndarray:
    """What the lines before each line say about it, as a log ratio of good to bad; 0 at first lines.

    A line passes a message on by a fraction of linear terms, so the lines of a whole stretch do as
    well: long texts are cut into lanes, the lanes' two-by-two matrices are multiplied in step, the
    few lanes of a text are followed one after the other, and then all lanes advance in step.
    """
    lanes = -(-counts // LANE)
    text = np.repeat(np.arange(len(counts)), lanes)
    start = (np.cumsum(counts) - counts)[text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    size = np.minimum(LANE, np.cumsum(counts)[text] - start)
    whole = np.flatnonzero(np.append(text[1:] == text[:-1], False))  # lanes with another one behind them
    incoming = np.zeros(len(text))  # equal odds at a text's first line
    if len(whole):
        a = np.exp(stay)
        m = np.tile(np.eye(2), (len(whole), 1, 1))
        for t in range(LANE):
            good = np.exp(emission[start[whole] + t])[:, None] * m[:, 0]
            m = np.stack([a * good + m[:, 1], good + a * m[:, 1]], axis=1)
            m /= m.max(axis=(1, 2), keepdims=True)
        for lane, ((p, q), (r, s)) in zip(whole.tolist(), m.tolist(), strict=True):
            x = math.exp(incoming[lane])
            incoming[lane + 1] = math.log((p * x + q) / (r * x + s))
    out = np.zeros(len(emission))
    order = np.argsort(-size, kind="stable")
    start, size, message = start[order], size[order], incoming[order]
    active = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")
    for t, n in enumerate(active):
        now = start[:n] + t
        out[now] = message[:n]
        message[:n] = pass_on(message[:n] + emission[now], stay)
    return out


def line_probabilities(emission: np.ndarray, counts: np.ndarray, stay: float) -> np.ndarray:
    """Forward-backward: the probability that each line is good."""
    emission = np.clip(emission, -STEEPEST, STEEPEST)
    forward = carried(emission, counts, stay)
    backward = carried(emission[::-1], counts[::-1], stay)[::-1]
    return 1 / (1 + np.exp(-(forward + emission + backward)))


def chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts from most to fewest lines, the first line of each, and how many have more than t lines."""
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-counts[order], -np.arange(counts.max()), side="left")
    return order, start, active


def marginals(emission: np.ndarray, counts: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that a line is good, expected agreement with the line before, and log-likelihood terms.

    ``emission`` is the score of good against bad. The two states are kept as one log ratio, all
    texts advance together line by line, and a text drops out after its last line.
    """
    _, start, active = chains(counts)
    both = np.column_stack([np.zeros_like(emission), emission])
    trans = np.array([[stay, 0.0], [0.0, stay]])
    forward, backward = np.zeros_like(both), np.zeros_like(both)
    steps = len(active)
    for t in range(steps):
        now = start[: active[t]] + t
        if t == 0:
            forward[now] = both[now]
        else:
            past = forward[now - 1]
            forward[now] = both[now] + np.logaddexp(past[:, :1] + trans[0], past[:, 1:] + trans[1])
    for t in range(steps - 2, -1, -1):
        now = start[: active[t + 1]] + t
        ahead = backward[now + 1] + both[now + 1]
        backward[now] = np.logaddexp(ahead[:, :1] + trans[0], ahead[:, 1:] + trans[1])
    total = forward + backward
    norm = np.logaddexp(total[:, 0], total[:, 1])
    agree = np.zeros(len(emission))
    for t in range(1, steps):
        now = start[: active[t]] + t
        rest = backward[now] + both[now] - norm[now, None]
        agree[now] = np.exp(forward[now - 1] + rest + stay).sum(1)
    return np.exp(total[:, 1] - norm), agree, float(norm[start].sum())


def fit_chain(x: np.ndarray, y: np.ndarray, counts: np.ndarray, steps: int = 100, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and agreement score that maximise the penalised likelihood of the line labels."""
    w, stay = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(counts) - counts] = False
    same = (inner & (y == np.roll(y, 1))).sum()
    for step in range(1, steps + 1):
        p, agree, _ = marginals((x @ w.astype(x.dtype)).astype(np.float64), counts, stay)
        grad = np.append((y - p).astype(x.dtype) @ x - penalty * len(y) * w, same - agree[inner].sum() - penalty * len(y) * stay) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, stay = w + move[:-1], float(stay + move[-1])
    return w, stay


def fit_logistic(z: np.ndarray, y: np.ndarray, steps: int = 40) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one feature, by Newton's method."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-4])
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - np.array([1e-2, 1e-4]) * w), -4, 4)
    return float(w[0]), float(w[1])


def evidence(emission: np.ndarray, length: np.ndarray, counts: np.ndarray, stay: float) -> np.ndarray:
    """The mean probability of a text's lines to be good, weighted by their length."""
    p = line_probabilities(emission, counts, stay)
    start = np.cumsum(counts) - counts
    weight = length + 1.0
    return np.add.reduceat(p * weight, start) / np.add.reduceat(weight, start)


def training_lines(texts: Iterable[str | None], train_lines: int = TRAIN_LINES, train_parts: int = TRAIN_PARTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Own features and lengths of a text's lines: all of them, or ``train_parts`` stretches spread evenly over a longer one."""
    for text in texts:
        total = (text or "").count("\n") + 1
        most = train_lines * train_parts
        starts = [0] if total <= most else [k * (total - train_lines) // max(1, train_parts - 1) for k in range(train_parts)]
        wanted, own, length, at = total if total <= most else train_lines, [], [], 0
        for x, n, _ in blocks([text]):
            keep = np.zeros(len(n), dtype=bool)
            for s in starts:
                keep[max(0, s - at) : max(0, s + wanted - at)] = True
            own.append(x[keep].astype(np.float32)), length.append(n[keep])
            at += len(n)
        yield np.concatenate(own), np.concatenate(length)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int = SAMPLE_DOCS, train_lines: int = TRAIN_LINES, train_parts: int = TRAIN_PARTS) -> Model:
    """A model from at most ``sample_docs`` labelled documents.

    The driver gets the features of at most ``train_lines`` times ``train_parts`` lines of each, 72 bytes a line.
    """
    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("quality_crf")
        for batch in batches:
            got = list(training_lines(batch["text"], train_lines, train_parts))
            yield pd.DataFrame({
                "y": batch["y"], "lines": [len(n) for _, n in got], "x": [x.tobytes() for x, _ in got], "length": [n.tobytes() for _, n in got],
            })

    known = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("__y"))
    known = sampled(known, known, id_col, sample_docs)
    text = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    rows = text.join(F.broadcast(known), id_col).select(F.col("__y").alias("y"), F.col("__text").alias("text"))
    got = rows.mapInPandas(featurize, "y double, lines long, x binary, length binary").toPandas()
    if got.empty or got["y"].nunique() < 2:
        rate = float(got["y"].mean()) if len(got) else 0.5
        return Model(np.zeros(WIDTH), 0.0, 0.0, 6.0 if rate >= 0.5 else -6.0)
    counts, quality = got["lines"].to_numpy(), got["y"].to_numpy() > 0
    own = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(-1, OWN)
    length = np.frombuffer(b"".join(got["length"]), dtype=np.int64)
    x = wide(own, counts)
    part = np.concatenate([np.full(-(-n // train_lines), train_lines) if n % train_lines == 0 else np.append(np.full(n // train_lines, train_lines), n % train_lines) for n in counts])
    doc = np.repeat(np.arange(len(counts)), counts)
    y = np.repeat(quality, counts).astype(np.float64)
    mean, spread = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    mean[-1], spread[spread < 1e-9] = 0.0, 1.0
    z = x
    z -= mean.astype(np.float32)
    z /= spread.astype(np.float32)
    for _ in range(ROUNDS):
        w, stay = fit_chain(z, y, part)
        p = line_probabilities((z @ w.astype(np.float32)).astype(np.float64), counts, stay)
        worst = np.minimum.reduceat(p, np.cumsum(counts) - counts)[doc]
        y = (quality[doc] | ((p > 0.5) & (p > worst))).astype(np.float64)
    score = (z @ w.astype(np.float32)).astype(np.float64)
    slope, offset = fit_logistic(evidence(score, length, counts, stay), quality.astype(np.float64))
    w = w / spread
    w[-1] -= mean @ w
    return Model(w, stay, slope, offset)


def scorer(model: Model, spark):
    """A Pandas UDF from a text column to its quality, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("quality_crf")
        for texts in batches:
            if not len(texts):
                yield pd.Series([], dtype="float64")
                continue
            z = evidence(*emissions(shared.value, list(texts)), shared.value.stay)
            yield pd.Series(1 / (1 + np.exp(-np.clip(shared.value.slope * z + shared.value.offset, -30, 30))))

    return quality


def train_labels(labels: DataFrame, id_col: str, folds: int, held_out: int) -> DataFrame:
    return labels.filter(crc_fold(id_col, folds) != held_out)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1, threshold: float = 0.5, sample_docs: int = SAMPLE_DOCS,
    train_lines: int = TRAIN_LINES, train_parts: int = TRAIN_PARTS,
) -> DataFrame:
    """Quality of every text: ``id_col, held_out, score, predicted``.

    Labels are learned from rows whose id's crc32 (as text) modulo ``folds`` isn't ``held_out``, at
    most ``sample_docs`` of them, and of each at most ``train_parts`` stretches of ``train_lines`` lines; every line of every
    text is scored. A document labelled twice counts as its larger label. Nulls among labels are ignored. A null or empty text is one empty line and is scored as such; a text of any
    length is scored as a whole, its lines' features a block at a time. With labels
    of one kind or none, every text gets one score near 0 or 1. A null id is never held out;
    repeated rows each get their result; other columns are ignored; an empty table stays empty.
    """
    model = fit(docs, train_labels(labels, id_col, folds, held_out), id_col, text_col, label_col, sample_docs, train_lines, train_parts)
    fold = F.coalesce(crc_fold(id_col, folds) == held_out, F.lit(False))
    out = docs.select(F.col(id_col), fold.alias("held_out"), scorer(model, docs.sparkSession)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
