"""Prefix trie of conversations by an external mergesort that knows common prefixes.

1. Every turn becomes 16 bytes (half the sha256 of role and text) and its length; texts move no
   further. A conversation's turns, in order, are its key, so equal turns are equal bytes and the
   order of keys puts all conversations below one node next to each other.
2. Keys are dealt to ranges of about equal size by Spark's range exchange, on key and id, so a group
   of equal conversations is split like any other rows.
3. In a range, batches become sorted runs in which each row carries its LCP, the turns it shares with
   the row before. A loser tree merges runs; rows that share different numbers of turns with the last
   winner are told apart by those numbers alone, and no shared turn is compared again.
4. The merged stream keeps the open path of the trie. Nodes that a row leaves are finished and go out;
   what they add up to goes to their parent.
5. A range can't finish the prefixes of its first and last row. It gives them as one row, and one
   stream over these rows, one for each range, finishes them by the same stack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a turn in a key, bytes of keys and lengths in a range, rows of a run, rows of an output batch.
TURN, RANGE_BYTES, RUN_ROWS, OUT_ROWS = 16, 8 << 20, 4096, 5000


def lcp(a: bytes, b: bytes, shared: int) -> int:
    """Turns that two keys share, where ``shared`` are known to be equal."""
    at, end = shared * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def sorted_run(rows: list[tuple]) -> tuple[list[tuple], list[int]]:
    """Rows ``key, id, ...`` in order, and the LCP of each with the one before (0 for the first)."""
    rows.sort(key=lambda r: r[:2])
    return rows, [0, *(lcp(a[0], b[0], 0) for a, b in zip(rows, rows[1:], strict=False))]


def merge_runs(runs: list[tuple[list[tuple], list[int]]]) -> Iterator[tuple[int, tuple]]:
    """Rows of all runs in order, each with its LCP with the row given before it.

    ``tree`` holds the losers of the matches at its inner nodes. A head's LCP is always the one with
    the last winner of every match on its way, so of two heads with unequal LCPs the larger is first.
    """
    runs = [r for r in runs if r[0]]
    if not runs:
        return
    width = 1
    while width < len(runs):
        width *= 2
    at, shared = [0] * width, [0] * width
    done = [k >= len(runs) for k in range(width)]
    tree = [0] * width

    def wins(a: int, b: int) -> bool:
        """Whether head ``a`` comes before head ``b``; the loser's LCP is then the one with the winner."""
        if done[a] or done[b]:
            return not done[a]
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        (x, i, *_), (y, j, *_) = runs[a][0][at[a]], runs[b][0][at[b]]
        both = lcp(x, y, shared[a])
        first = (x[both * TURN : both * TURN + TURN], i) <= (y[both * TURN : both * TURN + TURN], j)
        shared[b if first else a] = both
        return first

    def play(node: int) -> int:
        if node >= width:
            return node - width
        left, right = play(2 * node), play(2 * node + 1)
        winner, tree[node] = (left, right) if wins(left, right) else (right, left)
        return winner

    winner = play(1)
    while not done[winner]:
        rows, shares = runs[winner]
        yield shared[winner], rows[at[winner]]
        at[winner] += 1
        if at[winner] < len(rows):
            shared[winner] = shares[at[winner]]
        else:
            done[winner] = True
        node = (winner + width) // 2
        while node:
            if wins(tree[node], winner):
                winner, tree[node] = tree[node], winner
            node //= 2


class Node:
    """An open node: sums over its finished children and the members that end here, and what waits for it.

    ``waiting`` are rows of finished children, which lack their parent's smallest member until it is
    finished itself; ``parts`` are the ranges that an unfinished node was met in.
    """

    __slots__ = ("conv", "n", "children", "leaves", "saved", "size", "ends", "waiting", "parts")

    def __init__(self, size: int):
        self.conv, self.n, self.children, self.leaves, self.saved, self.size = None, 0, 0, 0, 0, size
        self.ends, self.waiting, self.parts = [], [], []

    def add(self, conv: int | None, n: int, children: int, leaves: int, saved: int) -> None:
        if n and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved

    def finish(self) -> tuple:
        """``conv, n, children, leaves, saved`` of the finished node."""
        return self.conv, self.n, self.children, self.leaves + (not self.children), self.saved + (self.n - 1) * self.size

    def open_sums(self) -> list[int]:
        return [self.conv or 0, self.n, self.children, self.leaves, self.saved, self.size]


def prefix_name(key: bytes, depth: int) -> bytes:
    """16 bytes that stand for the first ``depth`` turns of a key."""
    return hashlib.blake2b(key[: depth * TURN], digest_size=16).digest()


def ends_hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


#: Rows are finished nodes, ranges, bunches of the ends of an unfinished node, and places of unfinished nodes.
NODE, RANGE, ENDS, PLACE = range(4)
FIELDS = {
    "kind": "int", "part": "int", "name": "binary", "parent_conv": "long", "depth": "long", "conv": "long", "n": "long", "children": "long", "leaves": "long",
    "saved": "long", "ends": "string", "first": "binary", "last": "binary", "first_id": "long", "shared": "long", "chain": "array<long>",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    while batch := list(islice(rows, OUT_ROWS)):
        yield pd.DataFrame({k: pd.Series([r.get(k) for r in batch], dtype="Int64" if v in ("int", "long") else "object") for k, v in FIELDS.items()})


def node_row(depth: int, sums: tuple, ends: str | None) -> dict:
    return {"kind": NODE, "depth": depth, "ends": ends, **dict(zip(("conv", "n", "children", "leaves", "saved"), sums, strict=True))}


def nodes_of(merged: Iterator[tuple[int, tuple]], part: int) -> Iterator[dict]:
    """Finished nodes of a range, bunches of ends of its unfinished ones, and its row for ``join_ranges``.

    A finished node whose parent is unfinished has the parent's name instead of its smallest member.
    """
    path: list[Node] = []
    left: list[Node] = []  # prefixes of the first row that later rows don't share, deepest first
    first = last = b""
    first_id = unfinished = 0  # the path's nodes of a smaller depth than ``unfinished`` are prefixes of the first row

    def give(node: Node, name: bytes) -> Iterator[dict]:
        for row in node.waiting:
            yield row | {"part": part, "name": name}
        if node.ends:
            yield {"kind": ENDS, "name": name, "first_id": node.ends[0], "ends": ",".join(map(str, node.ends))}

    def leave(depth: int) -> Iterator[dict]:
        """Take the nodes deeper than ``depth`` off the path."""
        nonlocal unfinished
        while len(path) > depth + 1:
            node, at = path.pop(), len(path)
            if at < unfinished:
                unfinished = at
                left.append(node)
                yield from give(node, prefix_name(last, at))
                continue
            sums = node.finish()
            for row in node.waiting:
                yield row | {"parent_conv": node.conv}
            path[-1].add(sums[0], sums[1], 1, *sums[3:])
            row = node_row(at, sums, ends_hash(node.ends))
            if at - 1 < unfinished:
                yield row | {"part": part, "name": prefix_name(last, at - 1)}
            else:
                path[-1].waiting.append(row)

    for shared, (key, conv, sizes) in merged:
        if path:
            yield from leave(shared)
            path.extend(Node(int(s)) for s in sizes[shared:])
        else:
            first, first_id = key, conv
            path.extend([Node(0), *(Node(int(s)) for s in sizes)])
            unfinished = len(path)
        path[-1].ends.append(conv)
        path[-1].add(conv, 1, 0, 0, 0)
        last = key
    if path:
        for at, node in enumerate(path):
            yield from give(node, prefix_name(last, at))
        chain = [x for node in [*reversed(left), *path] for x in node.open_sums()]
        yield {"kind": RANGE, "part": part, "first": first, "first_id": first_id, "last": last, "shared": unfinished - 1, "chain": chain}


def join_ranges(ranges: Iterator[tuple[int, bytes, bytes, int, list[int]]]) -> Iterator[dict]:
    """Finish what ranges left open; ranges come in order, as ``part, first, last, shared, chain``.

    ``chain`` has the prefixes of the first key that the last one doesn't share, then those of the last.
    """
    path: list[Node] = []
    key = b""

    def leave(depth: int) -> Iterator[dict]:
        while len(path) > depth + 1:
            node, at = path.pop(), len(path)
            sums, name = node.finish(), prefix_name(key, at)
            for row in node.waiting:
                yield row | {"parent_conv": node.conv}
            for part in node.parts:
                yield {"kind": PLACE, "part": part, "name": name, "conv": node.conv}
            row = node_row(at, sums, None) | {"name": name}
            if path:
                path[-1].add(sums[0], sums[1], 1, *sums[3:])
                path[-1].waiting.append(row)
            else:
                yield row

    for part, first, last, shared, chain in ranges:
        nodes = [chain[k : k + 6] for k in range(0, len(chain), 6)]
        front, back = nodes[: len(first) // TURN - shared], nodes[len(first) // TURN - shared :]
        if path:
            yield from leave(lcp(key, first, 0))
        for given, upto, begin in ((front, first, shared + 1), (back, last, 0)):
            if given is back:
                yield from leave(shared)
            for at in range(len(upto) // TURN + 1):
                known = given[at - begin] if at >= begin else back[at]
                if at == len(path):
                    path.append(Node(known[5]))
                if at >= begin:
                    path[at].add(*known[:5])
                    path[at].parts.append(part)
            key = upto
    yield from leave(-1)


def conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turns``: each conversation's turns in order, as ``d`` (32 hex digits) and ``b`` (bytes of the text).

    ``turns`` moves 16 bytes and two numbers a turn. Rows are dealt by five consecutive ids, so that what reads a
    conversation with the first of its five needs no second shuffle.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = df.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * TURN).alias("d"),
        F.octet_length(text).cast("long").alias("b"),
    ).filter(F.col("conv").isNotNull()).withColumn("base", F.col("conv") - F.col("conv") % 5)
    gathered = turns.repartition("base").groupBy("base", "conv").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "b"))).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["b"].alias("b"))))


def with_shared_starts(own: DataFrame) -> DataFrame:
    """Rebuilt conversations: up to eight turns of the first of its five, then the conversation's own later turns."""
    most = 8
    base = F.max(F.when(F.col("conv") == F.col("base"), F.slice("turns", 1, most))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int")
    start = F.slice(F.coalesce("start", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.withColumns({"start": base, "h": h}).select("conv", F.concat(start, rest).alias("turns"))


def prefix_trie(rebuilt: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Nodes of the trie of ``conv, turns`` (``turns``: array of ``d``, ``b``), every ``conv`` once.

    Columns: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. A conversation without a turn is a member of the root only. A conversation is one
    row of 24 bytes a turn, and a range's nodes are held by one task until their parents are done. An empty table gives no node.
    """
    spark = rebuilt.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), ""))
    keyed = materialize(rebuilt.select(key.alias("key"), "conv", F.transform("turns", lambda t: t["b"]).alias("sizes")), "trie-keys")
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("key") * 1.5 + 100), F.lit(0)).alias("n")).first().n
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // range_bytes))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(map(bytes, batch["key"]), batch["conv"].tolist(), batch["sizes"], strict=True))
        runs = []
        while run := list(islice(rows, RUN_ROWS)):
            runs.append(sorted_run(run))
        yield from frames(nodes_of(merge_runs(runs), TaskContext.get().partitionId()))

    made = materialize(keyed.repartitionByRange(ranges, "key", "conv").mapInPandas(build, SCHEMA), "trie-nodes")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((int(p), bytes(a), bytes(z), int(s), [int(x) for x in c]) for b in batches for p, a, z, s, c in zip(b["part"], b["first"], b["last"], b["shared"], b["chain"], strict=True))
        yield from frames(join_ranges(rows))

    # One row for each range, however many conversations a range holds.
    borders = made.filter(F.col("kind") == RANGE).repartition(1).sortWithinPartitions("first", "first_id")
    joined = materialize(borders.mapInPandas(finish, SCHEMA), "trie-borders")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, digest = None, None
        for batch in batches:
            for next_name, ends in zip(map(bytes, batch["name"]), batch["ends"], strict=True):
                if next_name == name:
                    digest.update(b"," + ends.encode())
                    continue
                if name is not None:
                    yield pd.DataFrame({"name": [name], "hash": [digest.hexdigest()]})
                name, digest = next_name, hashlib.sha256(ends.encode())
        if name is not None:
            yield pd.DataFrame({"name": [name], "hash": [digest.hexdigest()]})

    bunches = made.filter(F.col("kind") == ENDS).select("name", "first_id", "ends").repartition("name").sortWithinPartitions("name", "first_id")
    hashes = bunches.mapInPandas(hashed, "name binary, hash string")
    border = joined.filter(F.col("kind") == NODE).join(hashes, "name", "left").withColumn("ends", F.coalesce("hash", F.lit(ends_hash([])))).drop("hash")
    places = joined.filter(F.col("kind") == PLACE).select("part", "name", F.col("conv").alias("upper"))
    inner = made.filter(F.col("kind") == NODE)
    below = inner.filter(F.col("name").isNotNull()).join(places, ["part", "name"]).withColumn("parent_conv", F.col("upper")).drop("upper")
    nodes = border.unionByName(below).unionByName(inner.filter(F.col("name").isNull()))
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **sizes: int) -> DataFrame:
    """The trie of rebuilt conversations, one row a node; see ``prefix_trie`` for its columns.

    Turns go by their number, null first, those of one number by their digest, so repeated rows are
    turns of their own; a null role or text is empty; rows without a conversation's id take no part.
    Conversation c has the first h turns of conversation c - c % 5, then its own after its first h,
    where h is crc32(c) % 9. Other columns are ignored.
    """
    return prefix_trie(with_shared_starts(conversations(df, conv_col, turn_col, role_col, text_col)), **sizes)


ORACLE_SQL = """
WITH t AS (SELECT conv_id AS c, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS d,
                  strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(d ORDER BY turn NULLS FIRST, d) AS d, list(b ORDER BY turn NULLS FIRST, d) AS b,
        xor(4294967295, list_reduce(list_transform(range(0, 8 * len(CAST(c AS VARCHAR))), lambda k: CASE WHEN k % 8 = 0 THEN CAST(ascii(substr(CAST(c AS VARCHAR), CAST(k // 8 + 1 AS BIGINT), 1)) AS BIGINT) ELSE 0 END),
            lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), CAST(4294967295 AS BIGINT))) % 9 AS h FROM t GROUP BY c),
r AS (SELECT o.c, list_concat(coalesce(p.d, [])[1:o.h], o.d[o.h + 1:]) AS d, list_concat(coalesce(p.b, [])[1:o.h], o.b[o.h + 1:]) AS b FROM own o LEFT JOIN own p ON p.c = o.c - o.c % 5),
m AS (SELECT c, k, d[1:k] AS p, CASE WHEN k > 0 THEN b[k] ELSE 0 END AS b, k = len(d) AS last FROM (SELECT *, unnest(range(0, len(d) + 1)) AS k FROM r)),
g AS (SELECT p, k, any_value(b) AS b, min(c) AS conv, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM m GROUP BY p, k),
ch AS (SELECT p[1:k - 1] AS p, count(*) AS children FROM g WHERE k > 0 GROUP BY ALL),
w AS (SELECT g.*, coalesce(ch.children, 0) AS children FROM g LEFT JOIN ch USING (p)),
s AS (SELECT p[1:a] AS p, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * b) AS saved FROM (SELECT *, unnest(range(0, k + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv AS conv_id, w.k AS depth, u.conv AS parent_conv_id, w.n AS n_convs, w.children AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256 FROM w JOIN s USING (p) LEFT JOIN g u ON w.k > 0 AND u.p = w.p[1:w.k - 1]
"""
