"""Operators of training data against libraries, brute force and held-out accuracy, and their odd inputs."""

import math
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import (
    exact_topk, language_id, license_scan, ngram_join, packing, quality_crf, sentencepiece_codec, token_counts, toxicity, vptree_ann,
)
from barloom.llm.common import bitmap_semi_filter, materialize, shared_dir

SF = "/root/testdata/sf0.001"
BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "\n\n", "a", "A b", "x" * 3000, "word " * 4000, "<|endoftext|> x <|startoftext|>", "日本 ßİ ﬁ é́ ​", "it's  We'LL\t12\r\n", "idiot", "CC-BY", "cc by"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns named like results."""
    rows = [(k, t, "en" if k % 2 else None, None, None, 1.5, 7) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[5], (None, "no id here", "en", None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA)


def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def random_texts(n, seed=3):
    pick = random.Random(seed)
    parts = list("ab '\n\t\r\x0b\x1c\x1f\x85\xa0Éé1²ßК.!? 　▁") + ["  ", "the", "ing", "日本", "😀", "<s>", "'s", "'ll", "<|endoftext|>", "é", "İ"]
    return ["".join(pick.choices(parts, k=pick.randint(0, 40))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, docs, odd):
    library = Tokenizer.from_file(BYTE_BPE)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, BYTE_BPE, 1024).collect()}
    for doc, text in texts(docs).items():
        assert (got[doc].n_tokens, got[doc].n_bytes, got[doc].over_limit) == (count(text), len(text.encode()), count(text) > 1024)
    counter = token_counts.TokenCounter(token_counts.read_definition(BYTE_BPE), {})
    assert all(counter.count(t) == count(t) for t in random_texts(1500))
    rows = token_counts.token_counts(odd, BYTE_BPE, 1024).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, count(r.text)) for r in odd.collect())
    assert token_counts.token_counts(docs.limit(0), BYTE_BPE, 1024).count() == 0
    with pytest.raises(ValueError):
        token_counts.read_definition(WORD_BPE)


def check_packed(given, placed, capacity, end_id):
    library = Tokenizer.from_file(WORD_BPE)
    want = sorted((r.doc_id is None, r.doc_id or 0, [*library.encode(r.text or "", add_special_tokens=False).ids, end_id]) for r in given)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in placed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= capacity and {r.padded_length for r in rows} == {at if at & (at - 1) == 0 else capacity}
    assert sum(r.length for r in placed) == sum(len(ids) for _, _, ids in want)
    for no_id, doc, ids in want:
        if no_id or sum(1 for w in want if w[:2] == (no_id, doc)) > 1:
            continue
        at, data = 0, struct.pack(f"<{len(ids)}I", *ids)
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(data[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert at == len(ids)
    return sum(rows[0].padded_length for rows in by_sequence.values()), sum(r.length for r in placed)


def test_packing_places_every_id_once(spark, docs, odd):
    space, used = check_packed(docs.collect(), packing.pack(docs.repartition(3), WORD_BPE, 2).collect(), 4096, 2)
    assert space / used < 1.15  # few documents leave each class's last sequence open
    check_packed(odd.collect(), packing.pack(odd, WORD_BPE, 2, capacity=256).collect(), 256, 2)
    assert packing.pack(docs.limit(0), WORD_BPE, 2).count() == 0
    for n in [*range(1, 300), 4095, 4096, 4097, 100_000]:
        pieces = packing.cuts(n, 4096)
        assert sum(pieces) == n and min(pieces) > 0
    encoder, library = packing.Encoder(packing.read_definition(WORD_BPE)), Tokenizer.from_file(WORD_BPE)
    assert all(encoder.ids(t) == packing.encode(library, t) for t in random_texts(1500))
    with pytest.raises(ValueError):
        packing.read_definition(BYTE_BPE)


def proto(pieces):
    """A unigram model file with these pieces, written by hand."""
    def field(tag, kind, body):
        return bytes([tag << 3 | kind]) + body

    def block(tag, body):
        return field(tag, 2, bytes([len(body) & 127 | 128, len(body) >> 7]) if len(body) > 127 else bytes([len(body)])) + body

    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(p, s, 1) for p, s in pieces]]
    out = b"".join(block(1, block(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([kind]))) for p, s, kind in entries)
    trainer = field(3, 0, bytes([1]))
    normalizer = block(1, b"identity") + field(3, 0, bytes([1])) + field(4, 0, bytes([0])) + field(5, 0, bytes([1]))
    return out + block(2, trainer) + block(3, normalizer)


def test_sentencepiece_equals_the_library(spark, docs, odd):
    model = sentencepiece_codec.read_model(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = sentencepiece_codec.Codec(model, False)
    for t in [*random_texts(1500), *[" " * k for k in range(0, 120, 7)]]:
        ids = codec.encode(t)
        assert ids == library.encode(t) and codec.decode(ids) == library.decode(ids)
    got = {r.doc_id: r for r in sentencepiece_codec.encode_decode(docs, PIECES).collect()}
    for doc, text in texts(docs).items():
        assert got[doc].ids == library.encode(text) and got[doc].decoded == text
    rows = {r.doc_id: r for r in sentencepiece_codec.encode_decode(odd, PIECES).collect()}
    assert (rows[0].ids, rows[0].decoded, rows[1].ids) == ([], "", []) and rows[7].decoded == ODD[7]
    assert sentencepiece_codec.encode_decode(docs.limit(0), PIECES).count() == 0


def test_unigram_viterbi_finds_the_best_sum():
    pick = random.Random(5)
    pieces = [("▁", -4.0), ("a", -3.0), ("b", -3.5), ("▁a", -4.1), ("ab", -4.3), ("ba", -5.9), ("aba", -6.2), ("▁ab", -6.05), ("bb", -6.6)]
    pieces = [(p, s - pick.random() / 100) for p, s in pieces]
    model = proto(pieces)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model, True)
    for _ in range(400):
        t = "".join(pick.choices("aabb  ", k=pick.randint(1, 14)))
        ours, theirs = codec.encode(t), library.encode(t)
        total = lambda ids: sum(codec.score[i] for i in ids)
        assert codec.decode(ours) == library.decode(theirs) and abs(total(ours) - total(theirs)) < 1e-4, t  # sums may tie


def held_out(got, truth, column):
    rows = got.filter("held_out").join(truth.select("doc_id", F.col(column).alias("truth")), "doc_id").filter("truth IS NOT NULL").collect()
    return rows, sum(r.truth == (r.predicted if column != "lang" else r.lang_pred) for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows, right = held_out(quality_crf.score_quality(docs, labels), labels, "quality")
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    rows, right = held_out(toxicity.score_toxicity(docs, labels), labels, "toxic")
    assert right >= 0.9 and not [r for r in rows if r.predicted and not r.truth]
    rows, right = held_out(language_id.identify_language(docs), docs, "lang")
    assert right >= 0.97


def test_marginals_equal_enumeration():
    pick = np.random.default_rng(2)
    counts = np.array([3, 1, 4])
    e, stay = pick.normal(size=8), 0.7
    p, agree, norm = quality_crf.marginals(e, counts, stay)
    at, total = 0, 0.0
    for n in counts:
        weight, good, same = 0.0, np.zeros(n), np.zeros(n)
        for k in range(2**n):
            y = np.array([k >> i & 1 for i in range(n)])
            w = math.exp(e[at : at + n] @ y + stay * (y[1:] == y[:-1]).sum())
            weight, good = weight + w, good + w * y
            same[1:] += w * (y[1:] == y[:-1])
        assert np.allclose(p[at : at + n], good / weight) and np.allclose(agree[at : at + n], same / weight)
        at, total = at + n, total + math.log(weight)
    assert abs(norm - total) < 1e-9


def test_classifiers_take_odd_rows(spark, odd, docs, labels):
    for got in (quality_crf.score_quality(odd, labels), toxicity.score_toxicity(odd, labels)):
        rows = got.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    for run in (quality_crf.score_quality, toxicity.score_toxicity):
        assert run(docs.limit(0), labels).count() == 0
        assert run(docs, labels.limit(0)).count() == docs.count()
        assert run(docs, labels.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})).count() == docs.count()
    rows = language_id.identify_language(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)} == {"und"}
    nothing = language_id.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"] and language_id.identify_language(docs.limit(0)).count() == 0


def test_codewords_differ():
    for k in (2, 3, 4, 6, 7, 20):
        code = language_id.codewords(k)
        gaps = [(code[a] != code[b]).sum() for a in range(k) for b in range(a)]
        assert min(gaps) >= (1 if k == 2 else 2)
    assert language_id.codewords(1).size == 0


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "trash" + toxicity.END: 2.0})
    found = lexicon.automaton()
    for text, wanted in (("an 1d10t", 3.0), ("іdiot!", 3.0), ("IDIOT$$$", 3.0), ("idiotic", 3.0), ("trash", 2.0), ("trashy", 0.0), ("vidiot", 0.0), ("a trash can", 0.0), ("trash cans", 2.0), ("tr@sh idiot", 5.0)):
        assert toxicity.hits(found, text)[0] == wanted, text
    assert toxicity.hits(toxicity.Lexicon({}, ()).automaton(), "x") == (0.0, 0)


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    words = WORDS.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_components(rows, percent, size):
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((root(a), root(b)))
                parent[v] = u
    return {d: (len(s), root(d)) for d, s in sets}


def edited(pick, words, edits):
    out = list(words)
    for _ in range(edits):
        out[pick.randrange(len(out))] = f"w{pick.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("hot", [128, 6])
def test_ngram_join_equals_brute_force(spark, docs, monkeypatch, hot):
    """Also with so low a bound that leaders and the comparison across components take over."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "LEADERS", 4 if hot == 6 else 16)
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", 2_000)
    pick = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    made = [(10_000 + k, edited(pick, base, pick.randrange(0, 7))) for k in range(60)]
    made += [(20_000 + k, t) for k, t in enumerate(["", " \n", "one", "ONE", "one two", "one  two", "one two three", None])] + [(30_000, "One\ttwo\vthree")]
    rows = made + (list(texts(docs).items()) if hot == 128 else [])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect()}
    assert got == brute_components(rows, 90, 3)


def test_ngram_join_takes_odd_rows(spark, odd):
    rows = ngram_join.ngram_join(odd).collect()
    assert len(rows) == odd.count() and all(r.component_id is None for r in rows if r.doc_id is None)
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id in (0, 1, 2, 3)} == {(0, 0), (0, 1), (0, 2), (0, 3)}
    assert ngram_join.ngram_join(odd.limit(0)).count() == 0


def test_components(spark):
    pick = random.Random(4)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    got = {r.id: r.component for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            u, v = sorted((find(a), find(b)))
            parent[v] = u
    assert got == {x: find(x) for x in parent}


def vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(v) for v in rng.normal(0, 0.3, 8)]) for k in range(400)]
    same = [0.5] * 8
    rows += [(1000 + k, same) for k in range(60)] + [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [0.0] * 8), (None, same), (1000, same)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))


def test_exact_top_k_equals_brute_force(spark):
    rows, df = vectors(spark)
    good = [(i, np.floor(256 * np.asarray(v, dtype=np.float32).astype(float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    got = exact_topk.exact_top_k(df.filter("vec_id <> 1000 OR vec_id IS NULL"), 50, 5, shard_rows=90, block_queries=4).collect()
    good = [g for g in good if g[0] != 1000]
    want = set()
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want
    assert exact_topk.exact_top_k(df.limit(0), 50, 5).count() == 0


def test_tree_is_exact_with_factor_one_and_near_with_less(spark):
    rows, df = vectors(spark)
    good = [(i, np.asarray(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.asarray(v) != 0) and i != 1000]
    df = df.filter("vec_id <> 1000")
    want = {q: sorted((math.dist(x, y), i) for i, y in good if i != q)[:10] for q, x in good if q % 100 == 0}
    got = defaultdict(list)
    for r in vptree_ann.nearest_neighbours(df, 100, 10, 1.0, shard_rows=200, block_queries=3).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert {q: [i for _, i, _ in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(abs(s - want[q][k - 1][0]) < 1e-12 for q, v in got.items() for k, _, s in v)
    near = vptree_ann.nearest_neighbours(df, 100, 10, 0.5).collect()
    assert sum((r.vec_id in {i for _, i in want[r.query_id]}) for r in near) >= 0.9 * sum(map(len, want.values()))
    assert vptree_ann.nearest_neighbours(df.limit(0), 100, 10, 1.0).count() == 0
    with pytest.raises(ValueError):
        vptree_ann.nearest_neighbours(df, 100, 10, 0.0)


def test_license_scan(spark, odd):
    rows = [
        (1, "x CC-BY y\nAll Rights  Reserved."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "released under the MIT license"),
        (4, "Released\nunder the MIT License"), (5, "accc by"), (6, "cc byé"), (7, "cc by cc by"), (8, None), (9, "Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (7, 2, 1, 4, "cc-by,reserved")
    assert got[2].labels == "gpl,gpl-3.0-notice" and got[3].labels == got[4].labels == "mit-notice" and got[9].labels == "apache-2.0-notice"
    assert got[5].n_base == got[6].n_base == 0 and (got[7].n_base, got[7].last_word) == (2, 2)
    assert (got[8].n_words, got[8].n_base, got[8].first_word, got[8].labels, got[8].score) == (0, 0, None, "", 0.0)
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_bitmap_filter_keeps_every_match(spark):
    keys = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    got = {r.k for r in bitmap_semi_filter(spark.range(2000).withColumnRenamed("id", "k"), "k", keys, bits=1 << 12).collect()}
    assert got >= set(range(0, 1000, 7)) and len(got) < 600
    assert bitmap_semi_filter(keys, "k", keys.limit(0)).count() == 0
    assert materialize(keys, "t").count() == keys.count() and shared_dir(spark)


def test_pipeline_stages(spark, odd, labels):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    good = p.keep_good(spark, docs, SF)
    scores = {r.doc_id: r.predicted for r in quality_crf.score_quality(docs, labels).collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {d for d, v in scores.items() if v}
    mild = p.drop_toxic(spark, docs, SF)
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    assert {r.doc_id for r in mild.collect()} == {d for d, v in scores.items() if not v}
    single = p.drop_near_duplicates(spark, docs, SF)
    want = brute_components(texts(docs).items(), 80, 5)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {d for d, (_, c) in want.items() if c == d}
    repeated = p.drop_near_duplicates(spark, odd, SF)
    assert repeated.columns == odd.columns and repeated.filter("doc_id = 4").count() == 1 and repeated.filter("doc_id IS NULL").count() == 2
    assert p.run(spark, SF).count() > 0


def test_repeated_ids_are_linked_by_their_own_texts(spark):
    """Different texts share id 5; one is a copy of id 3's text, one of id 9's, one of none."""
    import corpus_pipeline as p

    one, two, three = (" ".join(f"{c}{k}" for k in range(80)) for c in "abc")
    rows = [(5, f"{one} end"), (5, two), (5, three), (5, three), (3, one), (9, f"{two} end"), (5, ""), (5, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    linked = {(r.id, r.n, r.key): r for r in ngram_join.linked_rows(df, 90, 3).collect()}
    key = {r.text: r.k for r in df.select("text", ngram_join.text_key("text").alias("k")).collect()}
    of = lambda doc, n, text: linked[doc, n, key[text]]
    assert of(5, 79, f"{one} end").component_id == of(3, 78, one).component_id == 3
    assert of(5, 79, f"{one} end").linked == of(3, 78, one).linked
    assert of(5, 78, two).component_id == of(9, 79, f"{two} end").component_id == of(5, 78, three).component_id == 5
    assert of(5, 78, two).linked == of(9, 79, f"{two} end").linked != of(5, 78, three).linked
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect())
    assert got == [(3, 78, 3), (5, 0, 5), (5, 0, 5), (5, 78, 5), (5, 78, 5), (5, 78, 5), (5, 79, 3), (9, 79, 5)]
    kept = sorted(tuple(r) for r in p.drop_near_duplicates(spark, df, SF).collect())
    assert kept == sorted([(3, one), (5, two), (5, three), (5, ""), (5, " ")])


def test_tree_counts_components_past_a_shards_width(spark):
    """The two long vectors lie in one shard or two; the short ones of other shards are all narrower."""
    rng = np.random.default_rng(9)
    rows = [(k, [float(v) for v in rng.normal(0, 1, 9 if k in (0, 7) else 3 + k % 3)]) for k in range(300)]
    wide = {k: np.pad(np.asarray(v, dtype=np.float32).astype(float), (0, 9 - len(v))) for k, v in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vptree_ann.nearest_neighbours(df, 50, 10, 1.0, shard_rows=20, block_queries=2).collect()}
    for q in range(0, 300, 50):
        for rank, (d, k) in enumerate(sorted((math.dist(wide[q], wide[k]), k) for k in wide if k != q)[:10], 1):
            assert got[q, rank][0] == k and abs(got[q, rank][1] - d) < 1e-9


def test_folding_inside_long_texts():
    found, around = toxicity.Lexicon({"idiot": 3.0}).automaton(), "plain words go on " * 2000
    for word in ("1d10t", "іdiot", "IDIOT$$$"):
        assert toxicity.hits(found, f"{around}{word} {around}")[0] == 3.0, word


def test_ngram_join_with_equal_half_digests(spark, monkeypatch):
    """Different sets whose first half of the digest is the same are told apart by the other half."""
    real = ngram_join.digest
    monkeypatch.setattr(ngram_join, "digest", lambda h: (real(h)[0] & 7, real(h)[1]))
    pick = random.Random(2)
    base = [f"b{k}" for k in range(120)]
    rows = [(k, edited(pick, base, pick.randrange(0, 6))) for k in range(40)] + [(100 + k, f"x{k} y{k}") for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 90, 3)


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_ngram_join_of_short_texts_with_common_passages(spark, monkeypatch, percent, size):
    """Passages that fill most of many short texts: hot tokens in every prefix, most pairs below the threshold."""
    monkeypatch.setattr(ngram_join, "HOT", 5)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    pick = random.Random(9)
    rows = []
    for k in range(240):
        words = [f"p{k % 3}{j}" for j in range(pick.choice([3, 6, 12, 20, 30, 45, 70]))]
        rows.append((k, edited(pick, words, pick.randrange(0, 3))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), percent, size).collect()}
    assert got == brute_components(rows, percent, size)


def test_one_shingle_in_thousands_of_unrelated_texts_forms_few_pairs(spark):
    """Every text is a common shingle and one of its own: no square of their number meets."""
    limit, n = ngram_join.Threshold(90), 3000
    texts = spark.createDataFrame([(f"own{k} all rights reserved",) for k in range(n)], "text string")
    table = spark.sparkContext.broadcast(np.zeros(ngram_join.CELLS, dtype=np.uint8))
    hot = ngram_join.postings(texts, 3, limit, table, frozenset()).filter("pos >= 0").drop("others")
    keys = ["token", "apart", "choice", "value"]
    left, right = (ngram_join.with_keys(hot, limit, side).groupBy(keys).count() for side in (True, False))
    met = left.join(right.withColumnRenamed("count", "c"), keys).agg(F.sum(F.col("count") * F.col("c")).alias("n")).first().n
    assert met < 60 * n


def test_index_stops_on_proof_only():
    """Shards of thousands, few vectors left to rescore: the proof decides, not the rescoring of all."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 30, (3000, 24)))
    x[100:160] = x[7]  # ties
    ids = rng.permutation(10_000)[:3000]
    index, read = exact_topk.ImpactIndex(ids, x), []
    for k in range(0, 3000, 60):
        got = index.top(int(ids[k]), x[k], 5, rescore=5, read=read)
        score = (x @ x[k]).astype(np.int64)
        want = [i for i in np.lexsort((ids, -score)) if i != k][:5]
        assert got[0].tolist() == ids[want].tolist() and got[1].tolist() == score[want].tolist()
    assert min(read) < 0.95  # hard: vectors without structure and hardly any left to rescore
    index.top(int(ids[0]), x[0], 5, read=(usual := []))
    assert usual[0] < 0.8


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = defaultdict(set)
    for r in vptree_ann.nearest_neighbours(df, 100, 10, 0.5).collect():
        found[r.query_id].add(r.vec_id)
    hit = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        d[k] = np.inf
        hit += len(found[ids[k]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert hit >= 0.9 * total


def test_long_chains_equal_short_ones(monkeypatch):
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 400, 17, 256, 257, 1, 30])
    e = rng.normal(0, 3, counts.sum())
    for lane in (256, 3):
        monkeypatch.setattr(quality_crf, "LANE", lane)
        for stay in (0.7, 2.5, -1.0):
            assert np.allclose(quality_crf.line_probabilities(e, counts, stay), quality_crf.marginals(e, counts, stay)[0], atol=1e-12)


def test_scores_of_blocks_equal_wide_features(monkeypatch):
    model = quality_crf.Model(np.random.default_rng(3).normal(size=quality_crf.WIDTH), 1.2, 1.0, 0.0)
    given = ["a b\nc d!!\n\nx" * 40, "", "one line", "a\nb\nc\na\n", None]
    for lines, size in ((1 << 15, 1 << 22), (7, 30)):
        monkeypatch.setattr(quality_crf, "BLOCK_LINES", lines)
        monkeypatch.setattr(quality_crf, "BLOCK_BYTES", size)
        scores, length, counts = quality_crf.emissions(model, given)
        own = np.concatenate([b[0] for b in quality_crf.blocks(given)])
        assert np.allclose(scores, quality_crf.wide(own, counts) @ model.weights) and counts.tolist() == [121, 1, 1, 5, 1]
    monkeypatch.undo()
    scores, length, counts = quality_crf.emissions(model, ["a\n" * 500_000])  # a megabyte of short lines
    assert 0 <= quality_crf.evidence(scores, length, counts, model.stay)[0] <= 1 and counts[0] == 500_001


def test_hits_equal_plain_search_and_stay_linear():
    lexicon = toxicity.Lexicon({"idio": 2.0, "idiot" + toxicity.END: 3.0, "scum": 1.5, "trash" + toxicity.END: 1.0})
    found, pick = lexicon.automaton(), random.Random(6)
    for _ in range(300):
        text = " ".join(pick.choices(["idiot", "idiots", "vidiot", "scum", "pond scum", "trash", "trash can", "idiot proof", "x", "can", "trashy"], k=pick.randint(0, 12)))
        excused = {k for p in lexicon.exceptions for m in re.finditer(rf"(?<![^\W_]){p}(?![^\W_])", text) for k in range(m.start(), m.end())}
        want = 0.0
        for m in re.finditer(r"[^\W_]+", text):
            if m.start() not in excused:
                want += max([w for p, w in lexicon.weights.items() if (m.group() == p.rstrip() if p.endswith(toxicity.END) else m.group().startswith(p))], default=0.0)
        assert abs(toxicity.hits(found, text)[0] - want) < 1e-9, text
    assert toxicity.hits(found, "trash can " * 200_000) == (0.0, 0)  # two megabytes; quadratic work would take a quarter of an hour


def test_decoding_equals_plain_loss():
    code = language_id.codewords(4)
    for seed in range(50):
        margins = np.random.default_rng(seed).normal(0, 2, code.shape[1])
        loss = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(row, margins, strict=True)) for row in code]
        best, p, gap = language_id.decode(margins, code)
        share = sorted((math.exp(-x) for x in loss), reverse=True)
        assert best == int(np.argmin(loss)) and abs(p - share[0] / sum(share)) < 1e-9 and abs(gap - (share[0] - share[1]) / sum(share)) < 1e-9


def test_best_sum_of_the_public_model(spark, docs):
    """The ids of the registered path against brute force over all segmentations of its words."""
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(PIECES), False)
    rows = sentencepiece_codec.encode_decode(docs.filter("length(text) < 1500").limit(20), PIECES).join(docs, "doc_id").collect()
    for r in rows:
        marked, best = sentencepiece_codec.MARK + r.text.replace(" ", sentencepiece_codec.MARK), [0.0]
        for end in range(1, len(marked) + 1):
            best.append(max([best[s] + codec.scores[codec.ids[marked[s:end]]] for s in range(max(0, end - 20), end) if marked[s:end] in codec.ids], default=best[-1]))
        known = [i for i in r.best_ids if codec.raw[i] and i not in codec.bytes.values()]
        assert r.came_back and r.decoded == r.text
        assert abs(sum(codec.scores[i] for i in known) - best[-1]) < 1e-3 * max(1, abs(best[-1]))
