"""The corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; what they
decide takes effect by the rows they leave out. ``run`` writes each stage's rows to the shared
folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import ngram_join, packing, quality_crf, toxicity
from barloom.llm.common import discard, materialize, read_table, text_batches

#: The classifiers' stages cannot be written as SQL; they are tested against plain versions.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least 0.5; the model is learned from the whole corpus' labels.

    A null or empty text is scored as one empty line; repeated rows and rows without an id are each
    judged by their own text; an empty table stays empty.
    """
    text_batches(spark)
    labels = quality_crf.train_labels(read_table(spark, sf_dir, "labels"), "doc_id", 3, 1)
    model = quality_crf.fit(read_table(spark, sf_dir, "documents"), labels, "doc_id", "text", "quality")
    return docs.filter(quality_crf.scorer(model, spark)(F.col("text")) >= 0.5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.7.

    A null or empty text has no hit and is scored as such; repeated rows and rows without an id are
    each judged by their own text; an empty table stays empty.
    """
    text_batches(spark)
    labels = quality_crf.train_labels(read_table(spark, sf_dir, "labels"), "doc_id", 3, 1)
    lexicon = toxicity.fit(read_table(spark, sf_dir, "documents"), labels, "doc_id", "text", "toxic")
    return docs.filter(toxicity.scorer(lexicon, spark)(F.col("text")) < 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows without an id stay.

    Near copies share at least 0.8 of their shingles of five words. Null texts and texts without a
    word are near copies of nothing; an empty table stays empty. Where ids are repeated, a row goes only when its own text is a copy of one that stays.
    """
    text_batches(spark)
    rows = ngram_join.linked_rows(docs, percent=80, size=5).filter("id IS NOT NULL")
    first = rows.filter("linked IS NOT NULL").groupBy("linked").agg(F.min(F.struct("id", "key")).alias("first")).select("first.*")
    kept = first.unionByName(rows.filter("linked IS NULL").select("id", "key")).toDF("__id", "__kept")
    keyed = docs.withColumn("__key", ngram_join.text_key("text"))
    found = keyed.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__kept")), "left_semi")
    return found.dropDuplicates(["doc_id", "__key"]).drop("__key").unionByName(docs.filter(F.col("doc_id").isNull()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 4096 tokens.

    A null or empty text has the end id alone; repeated rows and rows without an id are documents of
    their own; an empty table gives no piece.
    """
    text_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
