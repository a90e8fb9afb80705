"""Secret scan that tells live-looking credentials from widely copied examples by who owns them.

1. A task scans whole texts for places where a pattern matches, and for bare runs of characters that
   could be a credential. Only places and 128-bit hashes of the values leave it.
2. Hashes are counted over the whole corpus: in how many repositories and of how many owners. Counts
   are combined before every shuffle, by (value, owner, repository), (value, owner), then value.
3. A value of more owners or repositories than allowed is a copied example. One of few owners whose
   characters look random is live. A bare run becomes a finding only if it is live, and long or
   assigned to a name somewhere in the corpus.

Verdicts go back to the places by the value. The values that have more than 1/HOT_SHARE of all
places, at most HOT_SHARE of them, are broadcast; the others' groups are small enough for a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "bare")
#: The patterns of the base kinds and the shortest value of each.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, BARE = r"AKIA[A-Z0-9]+", r"[0-9a-f]+", r"[A-Za-z0-9+/_-]+"
SHORTEST = {"assign": 6, "access": 20, "hex": 24, "bare": 16}
#: A bare run this long needs no assignment elsewhere.
LONG_RUN = 20
#: A live-looking value has so many different characters.
VARIED = 8
#: Words in lower case that show a placeholder.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "redacted", "xxxx", "your", "0000000", "1234567", "abcdefg")
#: Values with more than this share of all places are joined by broadcast.
HOT_SHARE = 4096

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
# A maximal run that is long enough is the run itself; shorter ones are never made.
RUNS = {kind: p[:-1] + "{%d,}" % least for kind, p, least in (("access", ACCESS, SHORTEST["access"] - 4), ("hex", HEX, SHORTEST["hex"]), ("bare", BARE, SHORTEST["bare"]))}
_runs = {kind: re.compile(p) for kind, p in RUNS.items()}


def looks_live(value: str) -> bool:
    """Letters and digits, many different ones, and no placeholder's word."""
    if len(set(value)) < VARIED or not any("0" <= c <= "9" for c in value) or not any("a" <= c <= "z" or "A" <= c <= "Z" for c in value):
        return False
    low = value.lower()
    return not any(word in low for word in PLACEHOLDERS)


def candidates(text: str | None) -> list[tuple[int, int, int, bytes, bool]]:
    """``start, kind, end, value's hash, looks live`` in order; bare runs only where no base span is."""
    if not text:
        return []
    found = [(m.start(), 0, m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    for kind in ("access", "hex"):
        found += [(m.start(), KINDS.index(kind), m.end(), m[0]) for m in _runs[kind].finditer(text)]
    found.sort()
    out, at, reach = [], 0, 0
    for m in _runs["bare"].finditer(text):
        while at < len(found) and found[at][0] < m.end():
            reach, at = max(reach, found[at][2]), at + 1
        if reach <= m.start() and looks_live(m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return [(s, k, e, hashlib.blake2b(v.encode(), digest_size=16).digest(), k == 3 or looks_live(v)) for s, k, e, v in sorted(found + out)]


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(places: DataFrame) -> DataFrame:
    """``value, owners, repositories, places, assigned`` of every value; a repository is one owner's."""
    each = places.groupBy("value", "owner", "repo").agg(F.count("*").alias("places"), F.max(F.col("kind") == 0).alias("assigned"))
    owned = each.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("places").alias("places"), F.max("assigned").alias("assigned"))
    return owned.groupBy("value").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("places").alias("places"), F.max("assigned").alias("assigned"))


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
    max_owners: int = 2, max_repositories: int = 100,
) -> DataFrame:
    """Findings of every text: ``id_col, n_assign, n_access, n_hex, base_sha256, spans``, then
    ``live_spans, copied_spans, n_bare``.

    Spans are ``kind:start:end`` in code points, by start and kind. Base kinds are all there; ``bare``
    spans are the method's. ``live_spans`` have a live-looking value of at most ``max_owners`` owners
    and ``max_repositories`` repositories, ``copied_spans`` one of more. A null or empty text has no
    span. A null owner or repository counts as one of its own. Repeated rows are each reported and
    counted as one repository; ids are passed on, null ones too. Texts are scanned whole; other
    columns are ignored; an empty table gives an empty result.
    """
    spans_type = "array<struct<start:long,kind:int,end:long,value:binary,live:boolean>>"

    @F.pandas_udf(spans_type)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("start", "kind", "end", "value", "live"), c, strict=True)) for c in candidates(t)] for t in texts])

    named = df.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), scan(F.col(text_col)).alias("found"))
    scanned = materialize(named.withColumn("row", F.monotonically_increasing_id()), "secret-places")
    places = scanned.filter(F.size("found") > 0).select("row", "owner", "repo", F.inline("found"))
    judged = materialize(ownership(places), "secret-owners").withColumn("copied", (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories))
    judged = judged.select("value", "places", "assigned", "copied")

    total = judged.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n")).first().n
    is_hot = F.col("places") * HOT_SHARE > total
    hot, cold = judged.filter(is_hot).drop("places"), judged.filter(~is_hot).drop("places")
    found = places.select("row", "start", "kind", "end", "value", "live")
    marked = found.join(F.broadcast(hot), "value").unionByName(found.join(F.broadcast(hot), "value", "left_anti").join(cold, "value"))
    live = F.col("live") & ~F.col("copied")
    reported = (F.col("kind") < 3) | (live & ((F.col("end") - F.col("start") >= LONG_RUN) | F.col("assigned")))
    rows = marked.filter(reported).select("row", F.struct("start", "kind", "end", live.alias("live"), "copied").alias("s")).groupBy("row").agg(F.collect_list("s").alias("s"))

    some = scanned.filter(F.size("found") > 0).select("row", "id").join(rows, "row", "left").select("id", F.coalesce("s", F.array().cast("array<struct<start:long,kind:int,end:long,live:boolean,copied:boolean>>")).alias("s"))
    none = scanned.filter(F.size("found") <= 0).select("id", F.array().cast("array<struct<start:long,kind:int,end:long,live:boolean,copied:boolean>>").alias("s"))
    of = lambda test: F.filter("s", test)
    count = lambda k: F.size(of(lambda x: x["kind"] == k)).cast("long")
    return some.unionByName(none).select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(spelled(of(lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), spelled(F.col("s")).alias("spans"),
        spelled(of(lambda x: x["live"])).alias("live_spans"), spelled(of(lambda x: x["copied"])).alias("copied_spans"), count(3).alias("n_bare"))


def oracle_sql(max_owners: int = 2, max_repositories: int = 100) -> str:
    """The same rows as SQL. Places follow from the lengths of matches and of what lies between them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    matches = []
    for kind, (pattern, subject) in enumerate(((ASSIGN, "low"), *((RUNS[k], "t") for k in KINDS[1:]))):
        p = quote(pattern)
        gaps, whole = f"string_split_regex({subject}, {p})", f"regexp_extract_all({subject}, {p})"
        ends = f"list_transform(range(1, len({whole}) + 1), lambda i: list_sum(list_transform(({gaps})[1:i], lambda x: length(x))) + list_sum(list_transform(({whole})[1:i], lambda x: length(x))))"
        matches.append(
            f"SELECT row, {kind} AS kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, "
            + (f"substr(t, e - length(v) + 1, length(v))" if kind == 0 else "m") + " AS v FROM (SELECT row, t, unnest(" + whole + f") AS m, unnest(list_transform({ends}, lambda x: CAST(x AS BIGINT))) AS e"
            + (f", unnest(regexp_extract_all(low, {p}, 2)) AS v" if kind == 0 else "") + f" FROM d) WHERE length({'v' if kind == 0 else 'm'}) >= {SHORTEST[KINDS[kind]]}")
    placeholder = " OR ".join(f"contains(lower(v), '{w}')" for w in PLACEHOLDERS)
    live = f"len(list_distinct(string_split(v, ''))) >= {VARIED} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT ({placeholder})"
    name = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'bare' END || ':' || s || ':' || e"
    joined = lambda test: f"coalesce(string_agg({name}, ',' ORDER BY s, kind) FILTER (WHERE {test}), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t, translate(coalesce(text, ''), '{upper}', '{lower}') AS low FROM documents),
base AS ({' UNION ALL '.join(matches[:3])}), bare AS ({matches[3]}),
free AS (SELECT b.* FROM bare b WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.row = b.row AND x.s < b.e AND b.s < x.e)),
p AS (SELECT *, {live} AS live FROM (SELECT * FROM base UNION ALL SELECT * FROM free)),
c AS (SELECT p.*, d.source AS owner, d.doc_id AS repo FROM p JOIN d USING (row) WHERE kind < 3 OR live),
o AS (SELECT v, count(*) AS owners, sum(r) AS repos, bool_or(a) AS assigned FROM (SELECT v, owner, count(*) AS r, bool_or(a) AS a FROM
      (SELECT v, owner, repo, bool_or(kind = 0) AS a FROM c GROUP BY ALL) GROUP BY v, owner) GROUP BY v),
j AS (SELECT c.*, owners > {max_owners} OR repos > {max_repositories} AS copied, assigned FROM c JOIN o USING (v)),
f AS (SELECT row, kind, s, e, live AND NOT copied AS live, copied FROM j WHERE kind < 3 OR (live AND NOT copied AND (e - s >= {LONG_RUN} OR assigned)))
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256({joined('kind < 3')}) AS base_sha256, {joined('kind IS NOT NULL')} AS spans, {joined('live')} AS live_spans, {joined('copied')} AS copied_spans,
       count(*) FILTER (WHERE kind = 3) AS n_bare FROM d LEFT JOIN f USING (row) GROUP BY d.row
"""
