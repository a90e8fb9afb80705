"""N-gram Jaccard join with filters under several global token orders, and its connected components.

1. Every text becomes its set of shingles, as 64-bit hashes. Texts with equal sets form a class, and
   only classes go on. The same pass counts shingles in a sketch of fixed size; its logarithms are
   the frequency classes that every global order starts with, rarest first.
2. Two sets that reach the threshold share a token among the first few of each (prefix filter),
   and SHARED tokens among as many more. Classes are joined on those tokens of the first order. The
   join's condition holds the length filter, the positional filter, and a bound on the symmetric
   difference from 256 parity bits; the pairs' shared tokens are counted afterwards.
3. Each class also keeps its prefix tokens under the other orders. Candidates must share some under
   every order: the filters are intersected before any text is moved.
4. What is left is dealt to groups of bounded size. There each text comes once, and pairs are
   compared exactly.
5. Only components are wanted. Where a token is in very many classes, a few leaders per token are
   compared first. What they link collapses, and only pairs across different components are
   compared afterwards, so a large group of near copies isn't expanded into all its pairs, and yet
   every pair that could join two components is compared. Those meet by more than the token: short
   sets by as many equal words of parity bits as the difference they may have leaves, long ones by
   classes of both sizes, of which each set names only those that its place of the token leaves.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add, and_, or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_semi_filter, claim, discard, materialize

#: Cells of the frequency sketch (one byte each when broadcast) and cells of one row of it.
CELLS, CHUNK = 1 << 22, 1 << 12
#: Classes with a token above which leaders are compared first, and leaders per token.
HOT, LEADERS = 32, 8
#: Prefixes are longer by so many tokens less one, and candidates share so many of them.
SHARED = 3
#: Columns of 64 parity bits each.
PARITY = ("p0", "p1", "p2", "p3")
#: Columns of 64 finer parity bits each, kept once per class and joined to the rows of hot tokens.
FINE = tuple(f"f{k}" for k in range(16))
#: Shingles of the texts that one comparison task holds on either side.
GROUP_SHINGLES = 400_000
#: Sets a task remembers to skip copies.
SEEN = 200_000
#: Prefix tokens of whole texts that a task gives out at a time.
POSTINGS = 1 << 17
#: Bytes of a text whose words are hashed at a time; longer words are hashed one by one.
BLOCK, LONG_WORD = 1 << 18, 64
#: Seeds of the global orders.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_U = np.uint64
_PAD = _U(0x27D4EB2F165667C5)
#: Odd factors of a shingle's places.
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=_U)
_BREAK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_values() -> np.ndarray:
    """A random value for each byte, the same for both cases of an ASCII letter."""
    values = mix(np.arange(1, 257, dtype=_U) * _PAD)
    values[65:91] = values[97:123]
    return values


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_VALUE = _word_values()
#: An odd factor modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    factors = np.full(BLOCK + 1, base, dtype=_U)
    factors[0] = 1
    return np.cumprod(factors, dtype=_U)


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def block_words(data: bytes) -> np.ndarray:
    """Hashes of the words of at most BLOCK bytes: differences of running sums of values times powers."""
    a = np.frombuffer(data, dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[a], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    sums = np.zeros(len(a) + 1, dtype=_U)
    np.cumsum(_VALUE[a] * _POWERS[: len(a)], out=sums[1:])
    size = ends - starts
    out = mix((sums[ends] - sums[starts]) * _INVERSES[starts] + size.astype(_U))
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = long_word(data[starts[k] : ends[k]])
    return out


def long_word(word: bytes) -> int:
    """Sums of powers modulo 2**64 are no good hash of long words made to collide."""
    return xxhash.xxh3_64_intdigest(word.lower())


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word, in blocks that end where a word does."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data) and not _SPACE[data[end]]:
            cut = _BREAK.search(data[at:end][::-1])
            if cut:
                end -= cut.start()
            else:  # a word that is longer than a block, perhaps with the end of another before it
                more = _BREAK.search(data, end)
                end = more.start() if more else len(data)
                out.append(np.array([long_word(data[at:end])], dtype=_U))
                at = end
                continue
        out.append(block_words(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=_U)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole sequence if it has fewer words."""
    w = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, dtype=_U)
    if not len(w):
        return w
    if len(w) < size:
        w = np.concatenate([w, np.full(size - len(w), _PAD, dtype=_U)])
    n = len(w) - size + 1
    h = np.zeros(n, dtype=_U)
    for k in range(size):
        if k < len(_PLACES):
            h += w[k : k + n] * _PLACES[k]
        else:  # long shingles: earlier places are mixed before more are added
            h = mix(h) + w[k : k + n]
    return np.unique(mix(h))


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> _U(20)) & _U(CELLS - 1)


def ordered(h: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """The set from rarest to most frequent class; within a class by the order's own hash."""
    return h[np.lexsort((mix(h ^ _U(ORDERS[order])), classes[cell(h)]))]


class Threshold:
    """Lengths that follow from ``part * intersection >= whole_share * union``, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def probe(self, n):
        """Tokens of a set among which a partner at most as large must have one."""
        return n - -(-self.percent * n // 100) + 1

    def index(self, n):
        """Tokens of a set among which a partner at least as large must have one."""
        return n - -(-2 * self.percent * n // (100 + self.percent)) + 1

    def overlap(self, a, b):
        """Tokens that sets of these sizes must share."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def apart(self, both):
        """Tokens in one of two sets only, at most, where their sizes add up to ``both``."""
        return both - 2 * self.overlap(both, 0)


def digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=np.int64).tolist())


def digests(df: DataFrame, size: int) -> DataFrame:
    """Rows of kind 0, one per text: id, key, shingles, digest. Rows of kind 1: parts of each task's sketch."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("ngram_join")
        counts = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = shingles(text, size)
                np.add.at(counts, cell(h), 1)
                rows.append((len(h), *digest(h)))
            out = pd.DataFrame(rows, columns=["n", "node", "check"])
            out["kind"], out["id"], out["key"], out["part"] = 0, batch["id"].astype("Int64"), batch["key"], None
            yield out[["kind", "id", "key", "n", "node", "check", "part"]]
        for at in range(0, CELLS, CHUNK):
            part = counts[at : at + CHUNK]
            if part.any():
                packed = zlib.compress(part.astype(np.uint32).tobytes(), 1)
                yield pd.DataFrame({"kind": [1], "id": [at // CHUNK], "key": [0], "n": [0], "node": [0], "check": [0], "part": [packed]})

    return df.mapInPandas(read, "kind int, id long, key long, n long, node long, check long, part binary")


def frequency_classes(parts: DataFrame) -> np.ndarray:
    """Logarithms of the summed sketch. A task sums the parts of its chunks as they stream by."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch["id"], batch["part"], strict=True):
                one = np.frombuffer(zlib.decompress(part), dtype=np.uint32)
                sums[chunk] = sums[chunk] + one if chunk in sums else one.astype(np.uint64)
        for chunk, total in sums.items():
            log = np.ceil(np.log2(total + 1.0)).astype(np.uint8)
            yield pd.DataFrame({"id": [chunk], "part": [log.tobytes()]})

    rows = parts.filter("kind = 1").select("id", "part").repartition("id").mapInPandas(add, "id long, part binary")
    classes = np.zeros(CELLS, dtype=np.uint8)
    for row in rows.collect():  # CELLS bytes in all
        classes[row.id * CHUNK : (row.id + 1) * CHUNK] = np.frombuffer(row.part, dtype=np.uint8)
    return classes


def postings(df: DataFrame, size: int, limit: Threshold, classes, clash: frozenset[int]) -> DataFrame:
    """Prefix tokens of the first order: ``token, node, n, pos``, parities; a task skips copies it has seen.

    One more row for each set has ``pos`` -1, finer parities and, in ``others``, its prefix tokens
    under the other orders, folded to 32 bits: equal tokens stay equal.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("ngram_join")
        table, seen = classes.value, set()
        for batch in batches:
            token, node, n, pos, parity, sets, held = [], [], [], [], [[] for _ in PARITY], [], 0

            def frames():
                yield pd.DataFrame({
                    "token": np.concatenate(token), "node": np.concatenate(node), "n": np.concatenate(n).astype(np.int32),
                    "pos": np.concatenate(pos).astype(np.int32), **{name: np.concatenate(c) for name, c in zip(PARITY, parity, strict=True)}, **dict.fromkeys(FINE), "others": None,
                })
                yield pd.DataFrame({
                    "token": 0, "node": [s[0] for s in sets], "n": np.array([s[1] for s in sets], dtype=np.int32), "pos": np.int32(-1),
                    **dict.fromkeys(PARITY, 0), **dict(zip(FINE, np.stack([s[2] for s in sets]).T, strict=True)), "others": [s[3] for s in sets],
                })
                for column in (token, node, n, pos, *parity, sets):
                    column.clear()

            for text in batch["text"]:
                h = shingles(text, size)
                if not len(h):
                    continue
                d, check = digest(h)
                d = check if d in clash else d
                if d in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                p = min(limit.probe(len(h)) + SHARED - 1, len(h))
                token.append(ordered(h, table, 0)[:p].view(np.int64))
                odd = np.bincount((h >> _U(56)).astype(np.int64), minlength=64 * len(PARITY)).astype(np.uint8) & 1
                node.append(np.full(p, d)), n.append(np.full(p, len(h))), pos.append(np.arange(p))
                for column, bits in zip(parity, np.packbits(odd).view(np.int64), strict=True):
                    column.append(np.full(p, bits))
                odd = np.bincount((h >> _U(54)).astype(np.int64), minlength=64 * len(FINE)).astype(np.uint8) & 1
                sets.append((d, len(h), np.packbits(odd).view(np.int64), [(ordered(h, table, k)[: limit.probe(len(h))] >> _U(32)).astype(np.uint32).view(np.int32) for k in range(1, len(ORDERS))]))
                held += p
                if held >= POSTINGS:
                    yield from frames()
                    held = 0
            if token:
                yield from frames()

    return df.select("text").mapInPandas(read, "token long, node long, n int, pos int, " + ", ".join(f"{c} long" for c in PARITY + FINE) + ", others array<array<int>>")


def share_others(pairs: DataFrame, others: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs ``a, b, na, nb`` whose sets share prefix tokens under every other order too.

    The shorter set has a token among its first few that may come first in both; the longer one
    has it in its prefix.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = materialize(bitmap_semi_filter(others, "node", wanted).join(wanted, "node").dropDuplicates(["node"]), "prefixes")
    of = lambda c: held.select(F.col("node").alias(c), F.col("others").alias(f"o{c}"))
    p = limit.percent
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    shorter = F.least("na", "nb").cast("long")
    count = (shorter - F.ceil(shorter * (2 * p) / (100 + p) - 1e-6) + 1).cast("int")
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    for k in range(len(ORDERS) - 1):
        short = F.when(first, F.col("oa")[k]).otherwise(F.col("ob")[k])
        long = F.when(first, F.col("ob")[k]).otherwise(F.col("oa")[k])
        met = met.filter(F.arrays_overlap(F.slice(short, F.lit(1), count), long))
    return met.select("a", "b", "na", "nb")


def unequal_bits(a: str, b: str, columns: tuple[str, ...]) -> Column:
    """Unequal parity bits: at most as many as there are tokens in one of the two sets only."""
    return reduce(add, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in columns])


def fits_finely(limit: Threshold, a: str, b: str) -> Column:
    """``fits`` for rows of hot tokens, which have the finer parities too.

    PARITY has so few bits that half of them are fewer than the tokens by which two sets of some
    hundreds may differ; it tells such sets apart no more.
    """
    both = F.col(f"{a}.n").cast("long") + F.col(f"{b}.n")
    need = F.ceil(both * limit.percent / (100 + limit.percent) - 1e-6)
    return fits(limit, a, b) & (unequal_bits(a, b, FINE) <= both - 2 * need)


def fits(limit: Threshold, a: str, b: str):
    """Length, positional and parity filters for two rows of one token.

    Sets that reach the threshold pass them at each of the first SHARED tokens they share, since
    behind the k-th of these all but k of the needed ones must follow on either side.
    """
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    p = limit.percent
    need = F.ceil((na + nb) * p / (100 + p) - 1e-6)
    shorter, longer = F.least(na, nb), F.greatest(na, nb)
    short_first = (na < nb) | ((na == nb) & (F.col(f"{a}.node") < F.col(f"{b}.node")))
    short_pos = F.when(short_first, F.col(f"{a}.pos")).otherwise(F.col(f"{b}.pos"))
    index = shorter - F.ceil(shorter * (2 * p) / (100 + p) - 1e-6) + 1
    apart = unequal_bits(a, b, PARITY)
    return (
        (shorter * 100 >= longer * p) & (short_pos < index + (SHARED - 1))
        & (F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) >= need - (SHARED - 1)) & (apart <= na + nb - 2 * need)
    )


def within_tokens(first: DataFrame, tokens: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs ``l, r`` that pass the filters at one of ``tokens``, of which each has at most HOT postings.

    The few postings of a token meet in one row, so they are shuffled once and not for a self-join.
    """
    met = bitmap_semi_filter(first, "token", tokens).join(tokens, "token")
    met = met.groupBy("token").agg(F.collect_set(F.struct("node", "n", "pos", *PARITY)).alias("all"))
    pairs = met.select(F.explode("all").alias("l"), "all").select("l", F.explode("all").alias("r"))
    return pairs.filter((F.col("l.node") < F.col("r.node")) & fits(limit, "l", "r"))


#: By how many tokens two sets differ at most: the words of parity bits of which one choice is equal.
CHOICES = {apart: list(combinations(PARITY, len(PARITY) - apart)) for apart in range(len(PARITY))}


def partner_sizes(rows: DataFrame, limit: Threshold) -> DataFrame:
    """Rows with ``least`` and ``most``, the sizes of sets that can still link at this posting; none without any.

    Behind its place a set has too few tokens left for a much larger partner, so a token that comes
    late has a small range, and one of a passage that many otherwise different texts share none.
    """
    n, p = F.col("n").cast("long"), limit.percent
    reach = F.floor((n - F.col("pos") + SHARED - 1) * (100 + p) / p - n + 1e-6)
    sized = rows.withColumns({"least": F.ceil(n * p / 100 - 1e-6), "most": F.least(F.floor(n * 100 / p + 1e-6), reach)})
    return sized.filter("least <= most")


#: Sizes of one class lie within this ratio; more classes than there are.
CLASS_WIDTH, CLASSES = 1.03, 1 << 12


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / np.log(CLASS_WIDTH) + 1e-9).cast("long")


def with_keys(rows: DataFrame, limit: Threshold, left: bool) -> DataFrame:
    """Rows of hot tokens, once for each key ``apart, choice, value`` by which they meet others.

    Sets that may differ by d tokens only have at most d unequal words of parity bits, so one choice
    of the remaining words is equal. Sets that may differ by more meet by the classes of both sizes:
    each names its own and those of the partners it can still have; choice 0 if the left one is the shorter.
    """
    rows, p, many = partner_sizes(rows, limit), limit.percent, len(PARITY)
    last = max(s for s in range(2, 100 * many) if limit.apart(s) < many)
    n, own = F.col("n").cast("long"), size_class(F.col("n"))
    apart = lambda s: s - 2 * F.ceil(s * p / (100 + p) - 1e-6)
    small = F.least(F.col("most"), last - n)
    none = F.array().cast("array<bigint>")
    kinds = F.array_distinct(F.transform(F.when(F.col("least") <= small, F.sequence(n + F.col("least"), n + small)).otherwise(none), apart))
    key = lambda d, k, value: F.struct(F.lit(d).alias("apart"), F.lit(k).alias("choice"), value.alias("value"))
    upto = lambda low, high: F.when(low <= high, F.sequence(size_class(low), size_class(high))).otherwise(none)
    longer, shorter = upto(F.greatest(n, "least"), F.col("most")), upto(F.col("least"), F.least(n, F.col("most")))
    keys = F.concat(
        F.transform(longer, lambda c: key(many, 0 if left else 1, own * CLASSES + c)), F.transform(shorter, lambda c: key(many, 1 if left else 0, c * CLASSES + own)))
    keys = F.when(n + F.col("most") > last, keys).otherwise(F.slice(keys, 1, 0))
    for d, choices in CHOICES.items():
        some = F.array(*[key(d, k, F.xxhash64(*choice)) for k, choice in enumerate(choices)])
        keys = F.concat(keys, F.when(F.array_contains(kinds, F.lit(d).cast("long")), some).otherwise(F.slice(some, 1, 0)))
    return rows.withColumn("key", F.explode(keys)).select("*", "key.*").drop("key")


def meet_once(limit: Threshold) -> Column:
    """That two rows with equal keys differ as much as the key says, and that it is the one key they are to meet by."""
    both, many = F.col("l.n").cast("long") + F.col("r.n"), len(PARITY)
    right = F.least(both - 2 * F.ceil(both * limit.percent / (100 + limit.percent) - 1e-6), F.lit(many).cast("long")) == F.col("l.apart")
    left_first = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.node") < F.col("r.node")))
    right &= (F.col("l.apart") < many) | (left_first == (F.col("l.choice") == 0))
    equal = lambda choice: reduce(and_, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in choice])
    for d, choices in CHOICES.items():
        for k in range(1, len(choices)):
            earlier = reduce(or_, [equal(c) for c in choices[:k]])
            right &= ~((F.col("l.apart") == d) & (F.col("l.choice") == k) & earlier)
    return right


def as_pairs(joined: DataFrame) -> DataFrame:
    """One row ``a, b, na, nb`` per pair of nodes and token."""
    first = F.col("l.node") < F.col("r.node")
    pick = lambda c, yes, no: F.when(first, F.col(f"{yes}.{c}")).otherwise(F.col(f"{no}.{c}"))
    return joined.select(
        pick("node", "l", "r").alias("a"), pick("node", "r", "l").alias("b"), pick("n", "l", "r").alias("na"), pick("n", "r", "l").alias("nb"),
    )


def compare(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, limit: Threshold) -> tuple[DataFrame, list[DataFrame]]:
    """Links that connect what pairs above the threshold connect, as their classes' nodes: ``a, b``.

    Also what was written for them, to be discarded once the links are.

    Every group links each of its members to the smallest one it is connected with; pairs that are
    connected already need no comparison.

    A pair goes to the group of the smallest node next to its first one, so the pairs of one bunch
    of near copies meet and each text is sent there once. A large group is cut into chunks of a
    bounded number of shingles, and its pairs go to pairs of chunks.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    groups = both.groupBy("a").agg(F.min("b").alias("g")).withColumn("g", F.least("a", "g"))
    dealt = pairs.join(groups, "a")
    members = dealt.select("g", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("na").alias("n")), F.struct(F.col("b").alias("node"), F.col("nb").alias("n")))).alias("m"))
    chunks = members.select("g", "m.*").distinct().groupBy("g").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("int").alias("chunks"))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit("chunk")), F.col("chunks")).cast("int")
    placed = dealt.join(chunks, "g").withColumns({"ca": part("a"), "cb": part("b")})
    placed = materialize(placed.select("g", F.least("ca", "cb").alias("i"), F.greatest("ca", "cb").alias("j"), "a", "b"), "pairs")
    wanted = placed.select("g", "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node")
    wanted = materialize(wanted.select("g", "i", "j", "node", "id", "key"), "members")
    texts = bitmap_semi_filter(docs, "id", wanted).join(wanted, ["id", "key"]).select("g", "i", "j", "node", "text")

    def verify(given: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        claim("ngram_join")
        sets: dict[int, np.ndarray] = {}
        for node, text in zip(members["node"], members["text"], strict=True):
            if node not in sets:
                sets[node] = shingles(text, size)
        root = {node: node for node in sets}

        def find(node: int) -> int:
            while root[node] != node:
                root[node] = node = root[root[node]]
            return node

        for a, b in zip(given["a"], given["b"], strict=True):
            if (u := find(a)) == (v := find(b)):
                continue
            x, y = sorted((sets[a], sets[b]), key=len)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            if int((y[at] == x).sum()) >= limit.overlap(len(x), len(y)):
                low, high = sorted((u, v))
                root[high] = low
        out = [(top, node) for node in root if (top := find(node)) != node]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keys = ["g", "i", "j"]
    return placed.groupBy(keys).cogroup(texts.groupBy(keys)).applyInPandas(verify, "a long, b long"), [placed, wanted]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id, component`` for every id on an edge; the component is its smallest reachable id.

    Alternating stars: every node links its larger neighbours, then its smaller ones, to the
    smallest it knows, until nothing changes. Minima are combined before they are shuffled.
    """
    current = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct(), name)
    while True:
        # Done when every node hangs on one smaller node and none of those hangs itself.
        ends = current.select(F.explode(F.array(F.struct(F.col("hi").alias("id"), F.lit(1).alias("hangs")), F.struct(F.col("lo").alias("id"), F.lit(0).alias("hangs")))).alias("e")).select("e.*")
        loose = ends.groupBy("id").agg(F.sum("hangs").alias("times"), F.min("hangs").alias("least")).filter("times > 1 OR times = 1 AND least = 0")
        if loose.agg(F.count("*").alias("n")).first().n == 0:
            return current.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
                current.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        both = current.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(current.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select("hi", "lo", "m")
        stars = small.select(F.col("m").alias("lo"), F.col("hi")).unionByName(small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
        done, current = current, materialize(stars.filter("lo <> hi").distinct(), name)
        discard(done)


def text_key(column: str) -> Column:
    """With its id, what tells a row's text from other texts of a repeated id."""
    return F.xxhash64(column)


def linked_rows(df: DataFrame, percent: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, n, linked, component_id`` of every row; ``key`` is its text's ``text_key``.

    ``linked`` is the same for the rows that links connect, also where ids are repeated; it is null
    for a row without an id or a shingle.
    """
    limit = Threshold(percent)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("key"))
    known = docs.filter(F.col("id").isNotNull())
    read = materialize(digests(docs, size), "digests")
    rows = read.filter("kind = 0").select("id", "key", "n", "node", "check")
    least = rows.filter("id IS NOT NULL AND n > 0").groupBy("node", "check").agg(F.min(F.struct("id", "key")).alias("least"))
    reps = materialize(least.select("node", "check", "least.*"), "classes")
    # Classes go by half of their digest. Where that is the same for two, by the other half: with N
    # classes those are some N * N / 2**65, a few hundred of 10**11.
    clash = frozenset(r.node for r in reps.groupBy("node").agg(F.count("*").alias("c")).filter("c > 1").select("node").collect())
    if clash:
        rename = F.when(F.col("node").isin(*clash), F.col("check")).otherwise(F.col("node"))
        rows, reps = rows.withColumn("node", rename), reps.withColumn("node", rename)
        if reps.groupBy("node").count().filter("count > 1").head(1):
            raise ValueError("two different texts have one digest")
    named = rows.filter("id IS NOT NULL AND n > 0")
    classes = df.sparkSession.sparkContext.broadcast(frequency_classes(read))

    written = materialize(postings(known, size, limit, classes, clash), "postings")
    first, others = written.filter("pos >= 0").drop("others", *FINE), written.filter("pos < 0").select("node", "others")
    scratch = [written]

    def keep(df: DataFrame, name: str) -> DataFrame:
        scratch.append(materialize(df, name))
        return scratch[-1]

    shared = first.groupBy("token").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("c")
    ).filter("lo <> hi")
    # A token of two texts only is of use if their lengths agree.
    shared = shared.filter((F.col("c") > 2) | (F.col("least").cast("long") * 100 >= F.col("most").cast("long") * percent))
    shared = keep(shared.select("token", (F.col("c") > HOT).alias("hot")), "tokens")
    rep_ids = reps.select("node", "id", "key")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        links, parts = compare(share_others(keep(pairs, f"{name}-candidates"), others, limit), known, rep_ids, size, limit)
        scratch.extend(parts)
        return keep(links, f"{name}-links")

    candidates, edges = as_pairs(within_tokens(first, shared.filter("NOT hot").select("token"), limit)), None
    if shared.filter("hot").head(1):
        tokens = shared.filter("hot").select("token")
        hot = bitmap_semi_filter(first, "token", tokens).join(tokens, "token").dropDuplicates(["token", "node"])
        fine = written.filter("pos < 0").select("node", *FINE).dropDuplicates(["node"])
        hot = keep(hot.join(fine, "node"), "lists")
        salt = F.pmod(F.xxhash64("node", F.lit("leader")), F.lit(LEADERS))
        lead = hot.groupBy("token", salt.alias("salt")).agg(F.min(F.struct("node", "n", "pos", *PARITY, *FINE)).alias("x")).select("token", "x.*")
        led = lead.alias("l").join(hot.alias("r"), F.col("l.token") == F.col("r.token")).filter((F.col("l.node") != F.col("r.node")) & fits_finely(limit, "l", "r"))
        edges = links_of(as_pairs(led).distinct(), "leader")
        grouped = components(edges, "leader-components")
        scratch.append(grouped)
        label = reps.join(grouped.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
        marked = hot.join(label, "node")
        major = marked.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"))
        marked = keep(marked.join(major, "token").withColumn("rest", F.col("comp") != F.col("major")).drop("major"), "marked")
        once = (F.col("l.node") < F.col("r.node")) | ~F.col("r.rest")
        # Only tokens with a second component go on.
        apart = marked.filter("rest").select("token").distinct()
        either = bitmap_semi_filter(marked, "token", apart).join(apart, "token")
        meet = ["token", "apart", "choice", "value"]
        across = with_keys(marked.filter("rest"), limit, True).alias("l").join(
            with_keys(either, limit, False).alias("r"), reduce(and_, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in meet]))
        across = across.filter((F.col("l.comp") != F.col("r.comp")) & once & meet_once(limit) & fits_finely(limit, "l", "r"))
        known_comp = lambda c: label.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
        parted = candidates.join(known_comp("a"), "a").join(known_comp("b"), "b").filter("comp_a <> comp_b")
        candidates = parted.select("a", "b", "na", "nb").unionByName(as_pairs(across))
    overlap = F.ceil((F.col("na").cast("long") + F.col("nb")) * percent / (100 + percent) - 1e-6)
    candidates = candidates.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).filter(F.col("c") >= F.least(F.lit(SHARED), overlap)).drop("c")
    links = links_of(candidates, "all")
    if edges is not None:
        links = links.unionByName(edges)
    linked = components(links).withColumnRenamed("id", "node")
    discard(*(df for df in scratch if hasattr(df, "_barloom_folder")))
    smallest = linked.join(rep_ids, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    named_classes = reps.join(linked.join(smallest, "component"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("linked"), F.coalesce("component_id", "id").alias("component_id"))
    out = named.join(named_classes, "node").select("id", "key", "n", "linked", "component_id")
    alone = rows.filter("id IS NULL OR n = 0").select("id", "key", "n", F.lit(None).cast("long").alias("linked"), F.col("id").alias("component_id"))
    return out.unionByName(alone)


def ngram_join(df: DataFrame, percent: int = 90, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` of every text under links of Jaccard similarity.

    Words are runs of non-space characters with A-Z lower-cased; a set holds the distinct shingles
    of ``size`` words, or the whole sequence if it is shorter. Two texts link when
    100 * intersection >= percent * union. ``component_id`` is the smallest id reachable by links,
    the text's own included. A null text or one without words has no shingle and links with
    nothing. A row with a null id takes no part: its component is null. Repeated ids are allowed;
    each row is linked by its own text, never by its id. Other columns are ignored; an empty table stays empty.
    """
    rows = linked_rows(df, percent, size, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
