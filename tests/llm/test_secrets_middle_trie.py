"""Secret scan, fill-in-the-middle and prefix trie against brute force, and their odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import fill_middle, prefix_trie, secret_scan

ODD = [None, "", " ", "a", "<P>", "x<S>y", "<M", "<", "日本 ßİ 😀é́​", "line\nline\r\n\nlast", "<P" * 50, "word " * 4000, "é" * 200_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_middle_equals_the_definition_and_comes_back(spark):
    pick = random.Random(5)
    texts = [*ODD, *("".join(pick.choices("ab <>PSM\né😀日", k=pick.randint(0, 30))) for _ in range(600))]
    rows = [(k if k else None, t, "n", 3) for k, t in enumerate(texts)] + [(4, "a", "again", 1), (4, "a", "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    made = fill_middle.fill_in_middle(docs)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = []
    for doc, text, *_ in rows:
        t = text or ""
        h = [int(x, 16) for x in re.findall(".{8}", sha(f"1:{'' if doc is None else doc}"))[:4]]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((doc, len(t), "plain", None, None, t, t))
        elif h[3] % 100 < 20:
            want.append((doc, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", t))
        else:
            want.append((doc, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", t))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_middle_cuts_at_units(spark):
    word = lambda t: re.findall(r"\s+|\w+|[^\w\s]+", t)
    for unit, split in (("word", word), ("line", lambda t: re.findall(r"[^\n]*\n|[^\n]+", t))):
        for text in ("It is, isn't it?  So\n\nbe it.\n", "a", "\n", "日本 ok!!", "no end\nhere"):
            units = split(text)
            ends = fill_middle.boundaries(fill_middle.code_points(text), unit).tolist()
            assert ends == [sum(map(len, units[:k])) for k in range(len(units) + 1)]
    text = "One line\nand two\nand three\n" * 40
    docs = spark.createDataFrame([(k, text) for k in range(50)], "doc_id long, text string")
    rows = fill_middle.fill_in_middle(docs, unit="line", plain_percent=0, spm_percent=50).collect()
    ends = set(fill_middle.boundaries(fill_middle.code_points(text), "line").tolist())
    assert all(r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends and fill_middle.rebuild(r.output, r.form) == text for r in rows)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, unit="page")


def plain_spans(text):
    found = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII | re.IGNORECASE):
        found += [("assign", m.start(), m.end())] * (len(m[1]) >= 6)
    for kind, p, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        found += [(kind, m.start(), m.end()) for m in re.finditer(p, text) if len(m[0]) >= least]
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_secret_spans_equal_plain_matching(spark):
    pick = random.Random(9)
    parts = ["token", "TOKEN", "api_key", "apikey", "secret", "ſecret", "toKen", "=", ": ", " ", "\"", "'", "deadbeef", "0123456789abcdef", "AKIA", "ABCD1234", "é", "😀", "\n", "x", ".", "-", "Zz9"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 25))) for _ in range(3000)] + [None, "", "token=token: abcdefgh", "AKIA" * 5 + "a", "f" * 300_000, "token" + " " * 300_000]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, source string, spans int")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = plain_spans(text or "")
        spelled = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        row = got[k]
        assert row.base_sha256 == sha(spelled)
        assert ",".join(s for s in row.spans.split(",") if not s.startswith("bare")) == spelled
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[0] == kind for s in want) for kind in secret_scan.KINDS[:3])


def test_owners_tell_live_values_from_copied_ones(spark):
    live, copied, known = "q7Zk2LmN8vXc4BtR1yWp9", "aB3dE5fG7hJ9kL1mN3pQ5", "w8Rt5yUi2oPa6sDf"
    rows = [(1, f"token = '{live}'", "a"), (2, f"see {live} here", "a"), (3, f"{copied} {copied}", "a"), (4, f"password: {copied}", "b"), (5, copied, None), (6, f"api_key={known}", "c"),
            (7, f"bare {known}", "c"), (8, "token=EXAMPLEexample1234567", "d"), (9, "bare u5Gh8jKl1zXc4vBn", "d"), (None, f"{live}!", "a"), (9, "bare u5Gh8jKl1zXc4vBn", "d")]
    rows += [(100 + k, f"secret={copied}", f"o{k % 7}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = secret_scan.scan_secrets(docs)
    got = defaultdict(list)
    for r in found.collect():
        got[r.doc_id].append(r)
    assert got[1][0].live_spans == got[1][0].spans == f"assign:0:{9 + len(live)}"
    assert got[2][0].spans == f"bare:4:{4 + len(live)}" and got[None][0].n_bare == 1
    assert got[3][0].spans == got[5][0].spans == ""  # a copied value that nothing assigns here
    assert got[4][0].copied_spans == got[4][0].spans != "" and all(got[100 + k][0].copied_spans and not got[100 + k][0].live_spans for k in range(400))
    assert got[7][0].spans == f"bare:5:{5 + len(known)}"  # short, but assigned elsewhere
    assert got[8][0].spans and not got[8][0].live_spans
    assert [r.spans for r in got[9]] == ["", ""]
    limited = {r.doc_id: r for r in secret_scan.scan_secrets(docs, max_owners=100, max_repositories=1).collect()}
    assert limited[7].spans == "" and limited[6].copied_spans
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def brute_trie(rows):
    """Nodes of the rebuilt conversations, by their prefixes as tuples."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    for conv in turns:
        turns[conv] = [t[3:] for t in sorted(turns[conv])]
    whole = {}
    for conv in turns:
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        whole[conv] = tuple(turns.get(base, [])[:h] + turns[conv][h:])
    members = defaultdict(list)
    for conv, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(conv)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = defaultdict(list)
    for conv, seq in whole.items():
        ends[seq].append(conv)
    return [(min(c), len(p), min(members[p[:-1]]) if p else None, len(c), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, c in members.items()]


def random_conversations(seed, convs, words=3):
    pick = random.Random(seed)
    rows = []
    for conv in [*pick.sample(range(-40, 4 * convs), convs), None]:
        n = pick.choice([1, 1, 2, 3, 8, 12, 14])
        for k in range(n):
            rows.append((conv, pick.choice([None, k, k, k, k]), pick.choice(["user", "é", None, "user"]), pick.choice(["a", "bé", "", None, "ccc"][: words + 2])))
    return rows + rows[:20]


@pytest.mark.parametrize("range_bytes", [400, 8 << 20])
def test_trie_equals_brute_force(spark, range_bytes):
    rows = random_conversations(1, 120)
    rows += [(5000 + k, t, "user", f"t{t}") for k in range(30) for t in range(10)]  # equal conversations
    rows += [(7003, t, "user", "deep") for t in range(700)] + [(7008, t, "user", "deep") for t in range(650)]
    rows += [(9001 + 5 * k, 0, "user", "short") for k in range(12)]  # some of these keep no turn
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "conv_id long, turn long, role string, text string, depth double, conv int").repartition(6)
    got = prefix_trie.conversation_trie(df, range_bytes=range_bytes)
    assert sorted(map(repr, brute_trie(rows))) == sorted(repr(tuple(r)) for r in got.collect())
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_trie_of_equal_and_turnless_conversations(spark):
    rows = [(10 * k, t, "user", "same") for k in range(200) for t in range(3)]
    schema = "conv_id long, turn long, role string, text string"
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, schema), range_bytes=300).collect()
    assert sorted(map(repr, brute_trie(rows))) == sorted(repr(tuple(r)) for r in got)
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    got = prefix_trie.conversation_trie(spark.createDataFrame([(lone, 0, "user", "gone")], schema)).collect()
    assert [tuple(r) for r in got] == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]


def test_loser_tree_merges_runs_with_their_prefixes():
    pick = random.Random(3)
    key = lambda: b"".join(bytes([pick.randint(0, 1)]) * prefix_trie.TURN for _ in range(pick.randint(0, 6)))
    for runs in range(1, 12):
        rows = [(key(), k, []) for k in range(pick.randint(0, 300))]
        parts = [rows[k::runs] for k in range(runs)]
        merged = list(prefix_trie.merge_runs([prefix_trie.sorted_run(list(p)) for p in parts]))
        assert [r for _, r in merged] == sorted(rows, key=lambda r: r[:2])
        for (_, a), (shared, b) in zip(merged, merged[1:]):
            assert shared == prefix_trie.lcp(a[0], b[0], 0)
