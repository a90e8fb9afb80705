"""Near-duplicate joins of long texts that share a passage, and the pipeline's stage on odd columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import ngram_join
from barloom.llm.common import materialize

from test_llm import brute_components


def passage_texts(n, own):
    """A common passage of 152 words in every text, which else has words of its own."""
    passage = " ".join(f"common{k}" for k in range(152))
    return [(k, " ".join(f"own{k}x{j}" for j in range(own(k))) + " " + passage) for k in range(n)]


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_long_texts_of_one_passage_form_few_pairs(spark, percent, size):
    """Texts below the threshold: what meets grows with their number, not with its square."""
    limit, n = ngram_join.Threshold(percent), 3000
    texts = spark.createDataFrame(passage_texts(n, lambda k: 12 if percent == 90 else 30), "doc_id long, text string")
    read = materialize(ngram_join.digests(texts.select(F.col("doc_id").alias("id"), "text", F.lit(0).cast("long").alias("key")), size), "test")
    table = spark.sparkContext.broadcast(ngram_join.frequency_classes(read))
    rows = ngram_join.postings(texts, size, limit, table, frozenset()).filter("pos >= 0").drop("others")
    late = rows.join(rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 32"), "token")
    assert late.count() > n
    keys = ["token", "apart", "choice", "value"]
    left, right = (ngram_join.with_keys(late, limit, side).groupBy(keys).count() for side in (True, False))
    met = left.join(right.withColumnRenamed("count", "c"), keys).agg(F.coalesce(F.sum(F.col("count") * F.col("c")), F.lit(0)).alias("n")).first().n
    assert met < 60 * n


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_long_texts_of_one_passage_keep_their_links(spark, monkeypatch, percent, size):
    monkeypatch.setattr(ngram_join, "HOT", 5)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    pick = random.Random(4)
    rows = passage_texts(150, lambda k: pick.choice([0, 1, 2, 4, 6, 8, 9, 11, 14, 20, 40]))
    rows += [(1000 + k, text + " end" * (k % 2)) for k, text in rows[::3]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), percent, size).collect()}
    assert got == brute_components(rows, percent, size)


def test_stages_take_columns_named_like_their_own(spark):
    rows = [(k, f"some text number {k // 2} of a few words that repeat", "a", 5, 1, "x") for k in range(8)] + [(None, "no id", "b", 1, 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, key int, n int, linked string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "unused")
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [*rows[::2]]))


def test_words_have_one_hash_wherever_blocks_end(monkeypatch):
    """Equal words, whatever their case, block and place; words longer than a block too."""
    pick, seen = random.Random(1), {}
    for size in (1 << 18, 130, 200, 300):
        monkeypatch.setattr(ngram_join, "BLOCK", size)
        for _ in range(300):
            data = "".join(pick.choices(["a", "B", "b", " ", "\n", "\t", "é", "\x0b", "\x85", "　", "zz", "long" * 30], k=pick.randint(0, 160))).encode()
            words, hashes = data.lower().split(), ngram_join.word_hashes(data)
            assert len(words) == len(hashes)
            assert all(seen.setdefault(w, int(h)) == int(h) for w, h in zip(words, hashes))
    assert len(set(seen.values())) == len(seen)
    assert len(ngram_join.word_hashes(b"x" * 2_000_000 + b" y")) == 2
