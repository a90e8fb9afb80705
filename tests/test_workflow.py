"""A run from archives to compared models, driven by its configuration on the command line."""

import datetime as dt
import hashlib
import io
import json
import math
import random
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from barloom import cli, config, workflow
from barloom.operators.model import DataInfo
from barloom.sources import archives, files
from test_config import valid

DAYS = 10


def fine_bars():
    pick, price, out = random.Random(1), 40000.0, []
    for k in range(DAYS * 288):
        close = price * math.exp(pick.gauss(0, 0.002))
        out.append((k, price, max(price, close) * (1 + pick.random() * 1e-3), min(price, close) * (1 - pick.random() * 1e-3), close))
        price = close
    return out


def coarse_of(bars):
    return [(k // 6, b[0][1], max(x[2] for x in b), min(x[3] for x in b), b[-1][4]) for k in range(0, len(bars), 6) for b in [bars[k : k + 6]]]


def archive(bars, minutes):
    out, start = io.BytesIO(), int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 1000
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("bars.csv", "\n".join(f"{start + k * minutes * 60000},{o},{h},{low},{c},0,{start + (k + 1) * minutes * 60000 - 1},0" for k, o, h, low, c in bars))
    return out.getvalue()


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """A run's folder after all steps, and what each returned."""
    root = tmp_path_factory.mktemp("run")
    given = valid()
    given["data"] |= {"start_date": "2024-01-01", "end_date": "2024-01-10"}
    path = root / "run.yaml"
    path.write_text(yaml.safe_dump(given))
    fine, store = fine_bars(), {}
    for bars, minutes in ((fine, 5), (coarse_of(fine), 30)):
        url = archives.Archive("BTCUSDT", f"{minutes}m", dt.date(2024, 1, 1)).url("http://x")
        store[url] = archive(bars, minutes)
        store[url + ".CHECKSUM"] = hashlib.sha256(store[url]).hexdigest().encode()
    at = workflow.Artifacts(str(root / "work"))
    codes = {"data-download": workflow.data_download(spark, config.load(str(path)), at, store.__getitem__, "http://x")}
    for name, more in (
        ("data-prepare", []), ("dataset-build", []), ("data-check", []), ("feature-build", []), ("feature-check", []), ("check", []),
        ("train", ["--run-id", "t", "--trees", "2", "--view", "coarse"]), ("compare-features", ["--run-id", "c", "--trees", "2"]),
    ):
        codes[name] = cli.main([name, "--config", str(path), "--root", at.root, *more])
    return at, codes, path


def report(spark, path):
    return json.loads(files.read_text(spark, path))


def test_every_step_passes(spark, run):
    at, codes, _ = run
    assert codes == dict.fromkeys(codes, 0) and len(codes) == 9
    data = report(spark, at.report("fine_data"))
    assert (data["rows"], data["gap_count"], data["archives"], data["source"]) == (DAYS * 288, 0, ["BTCUSDT-5m-2024-01.zip"], "binance_public_data")


def test_reports_count_what_the_tables_hold(spark, run):
    at, _, _ = run
    coarse, fused, data = (spark.read.parquet(p) for p in (at.features("coarse"), at.features("fused"), at.dataset))
    got = report(spark, at.report("coarse_features"))
    assert len(got) == 12 and got["total_rows"] == DAYS * 48 and got["insufficient_history_rows"] == 48 and got["valid_feature_rows"] == coarse.filter("feature_valid").count()
    got = report(spark, at.report("multires_features"))
    assert len(got) == 19 and got["total_prediction_rows"] == fused.count() and got["common_eligible_rows"] == data.filter("common_eligible").count()
    assert got["common_eligible_train_rows"] == data.filter("common_eligible AND split = 'train'").count() and sum(got["invalid_reason_counts"].values()) == fused.filter("NOT feature_valid").count()
    got = report(spark, at.report("samples"))
    assert got["total_candidate_events"] == DAYS * 48 and got["invalid_reason_counts"] == {"missing_next_bar": 1} and [c["invalid_reason"] for c in got["invalid_candidates"]] == ["missing_next_bar"]
    assert set(got["parts"]) == {"train", "validation", "test"}


def test_runs_leave_models_and_never_the_test_part(spark, run):
    at, _, path = run
    info = report(spark, at.run("c") + "/run_info.json")
    assert info["status"] == "COMPLETE" and info["best"]["best_variant"] in workflow.VIEWS
    for view in workflow.VIEWS:
        folder = f"{at.run('c')}/{view}"
        assert report(spark, f"{folder}/metadata.json")["n_features"] == {"coarse": 34, "fine": 49, "multires": 83}[view]
        gains = report(spark, f"{folder}/importance.json")["features"]
        assert sum(g["importance_split"] for g in gains) > 0 and gains == sorted(gains, key=lambda g: (-g["importance_gain"], g["feature"]))
        model = workflow.LeafwiseTrees.load(spark, f"{folder}/model.json", workflow.fusion.view(view).names, view)
        rows = workflow.fusion.model_rows(workflow.fusion.project(spark.read.parquet(at.dataset), view), "validation")
        p = {r.sample_id: r.predicted_probability_up for r in model.predict(rows).collect()}
        assert p == {r.sample_id: r.predicted_probability_up for r in spark.read.parquet(f"{folder}/predictions").collect()} and p
    with pytest.raises(ValueError, match="features"):
        workflow.LeafwiseTrees.load(spark, f"{at.run('c')}/fine/model.json", workflow.fusion.view("coarse").names)
    assert cli.main(["train", "--config", str(path), "--root", at.root, "--run-id", "t"]) == 1  # the folder holds a run
    files.write_text(spark, at.run("t") + "/deep/test_predictions.json", "{}")
    assert workflow.finish_run(spark, at.run("t"), {"test_status": "SEALED"}) == 1
    assert report(spark, at.run("t") + "/run_info.json")["status"] == "FAILED"


def test_checks_see_what_is_wrong(spark, run, tmp_path, capsys):
    at, _, path = run
    broken = workflow.Artifacts(str(tmp_path))
    leaky = lambda df: df.withColumn("f5_ret_1", F.when(F.col("feature_valid"), F.lit(float("inf"))).otherwise(F.col("f5_ret_1")))
    for name, change in (("features", leaky),):
        for side in ("coarse", "fine", "fused"):
            df = spark.read.parquet(at.features(side))
            (change(df) if side == "fine" else df).write.parquet(broken.features(side))
    for side in ("coarse", "fine"):
        spark.read.parquet(at.bars(side)).write.parquet(broken.bars(side))
    spark.read.parquet(at.dataset).write.partitionBy("split").parquet(broken.dataset)
    assert cli.main(["feature-check", "--config", str(path), "--root", broken.root]) == 1
    assert "n_non_finite" in capsys.readouterr().out
    (tmp_path / "bad.yaml").write_text("data: {}\n")
    assert cli.main(["data-check", "--config", str(tmp_path / "bad.yaml"), "--root", broken.root]) == 2


def test_data_info():
    assert DataInfo(2, ("a", "b")).as_dict()["n_features"] == 2
    for wrong in ({"n_features": 0}, {"n_features": 1, "feature_names": ("a", "b")}, {"horizon_minutes": -1}):
        with pytest.raises(ValueError):
            DataInfo(**wrong)
