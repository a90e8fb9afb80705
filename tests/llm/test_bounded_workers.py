"""What a task holds at a time is bounded, however long the texts are and however many it reads."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import ngram_join, toxicity


class Captured:
    """Stands for a table and keeps the function that its rows would go through."""

    def __getattr__(self, name):
        def call(*args, **kwargs):
            if name == "mapInPandas":
                self.function = args[0]
            return self
        return call


@pytest.mark.parametrize("held", [1 << 17, 1_000])
def test_postings_of_long_texts_come_in_parts(monkeypatch, held):
    monkeypatch.setattr(ngram_join, "POSTINGS", held, raising=False)
    table, limit = Captured(), ngram_join.Threshold(80)
    ngram_join.postings(table, 5, limit, SimpleNamespace(value=np.zeros(ngram_join.CELLS, dtype=np.uint8)), frozenset())
    size = 200_000 if held > 1_000 else 2_000
    texts = [None, "", *[" ".join(f"{k}w{i}" for i in range(size)) for k in range(8)], "a few words", "a few words"]
    frames = list(table.function(iter([pd.DataFrame({"text": texts})])))
    longest = size - 4 - -(-80 * (size - 4) // 100) + ngram_join.SHARED
    assert max(map(len, frames)) < held + longest
    rows = pd.concat([f[["node", "n", "pos"]] for f in frames])
    assert (rows["pos"] < 0).sum() == 9
    assert (rows["pos"] >= 0).sum() == 8 * longest + 1
    assert not rows.duplicated().any()


def test_toxicity_counts_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 50, raising=False)
    texts = [f"same words x{k}a y{k}b z{k % 7}c" for k in range(200)]
    rows = [(float(k % 3 == 0), t, k % 2 == 0) for k, t in enumerate(texts)] + [(1.0, None, True), (0.0, "", False)]
    table, read = Captured(), []
    toxicity.document_counts(table, lambda: str.split)

    def batches():
        for at in range(0, len(rows), 10):
            read.append(at)
            yield pd.DataFrame(rows[at : at + 10], columns=["y", "text", "half"])

    found, first = Counter(), None
    for part in table.function(batches()):
        first = first or len(read)
        assert len(part) < 60
        for item, half, y, n in part.itertuples(index=False):
            found[item, half, y] += n
    assert first < 4
    assert found == Counter((w, half, y > 0) for y, t, half in rows if t for w in t.split())

    frame = spark.createDataFrame(rows, "y double, text string, half boolean")
    got = toxicity.document_counts(frame, lambda: lambda t: set(t.split())).filter(F.col("item") == "same").first()
    assert (got.toxic_0 + got.toxic_1, got.clean_0 + got.clean_1) == (67, 133)
