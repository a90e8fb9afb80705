"""The live query on a table of several files: no part of the feed goes through one task."""

import duckdb

import __spark_entry__ as entry
from barloom.streaming import jobs


def test_parts_of_the_feed_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    shared, data = tmp_path / "shared", tmp_path / "sf"
    monkeypatch.setattr(jobs, "shared_dir", lambda _: str(shared))
    spark.read.parquet("/root/testdata/sf0.01/events.parquet").repartition(4).write.parquet(str(data / "events.parquet"))
    got = entry.queries()["live_settlement"](spark, str(data)).toPandas()
    files = [f for f in shared.glob("live-feed-*/part-*.parquet")]
    assert len(files) > 4
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet/*.parquet'")
        want = c.execute(entry.oracle_sql()["live_settlement"]).df()
    rows = lambda t: sorted(map(str, t[list(want.columns)].astype(object).where(t.notna(), None).itertuples(index=False, name=None)))
    assert len(want) and len(got) == len(want)
    assert rows(got) == rows(want)
