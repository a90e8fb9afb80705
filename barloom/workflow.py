"""The steps of a run in the order of its configuration, from archives to compared models.

Every step reads what earlier steps left in the run's folder, which may be in any store that Spark
reads, and leaves tables and JSON reports there. ``Artifacts`` knows their places.
"""

from __future__ import annotations

import datetime as dt
import json
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import lookup
from .operators import bars as bars_ops
from .operators import checks, features, fingerprints, fusion, labels, metrics, proofs, quality, reports, splits
from .operators.leafwise import LeafwiseTrees
from .operators.model import DataInfo, ProbabilityModel, make_model, train_two_stages
from .params import Ratios, interval_minutes
from .schemas import schema_errors
from .sources import archives, files, klines
from .sources.sinks import write_table

BASE_URL = "https://data.binance.vision/data/futures/um"
VIEWS = ("coarse", "fine", "multires")


class Artifacts:
    """Places of a run's tables and reports below its folder."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    raw = property(lambda self: self.at("raw"))

    def bars(self, side: str) -> str:
        return self.at("processed", f"{side}_bars")

    def features(self, side: str) -> str:
        return self.at("processed", f"{side}_features")

    samples = property(lambda self: self.at("processed", "samples"))
    dataset = property(lambda self: self.at("processed", "dataset"))

    def report(self, name: str) -> str:
        return self.at("reports", f"{name}.json")

    def run(self, run_id: str) -> str:
        return self.at("results", run_id)


def write_report(spark: SparkSession, path: str, content: dict) -> None:
    files.write_text(spark, path, json.dumps(content, indent=2, default=str, sort_keys=True, allow_nan=False, ensure_ascii=False), overwrite=True)


def sides(config: dict) -> dict[str, int]:
    """Minutes of the coarse and the fine bars."""
    return {side: interval_minutes(lookup(config, f"data.intervals.{side}")) for side in ("coarse", "fine")}


def fetch(url: str) -> bytes:
    try:
        with urllib.request.urlopen(url, timeout=60) as answer:
            return answer.read()
    except urllib.error.HTTPError as problem:
        if problem.code == 404:
            raise archives.ArchiveNotFound(url) from None
        raise


def data_download(spark: SparkSession, config: dict, at: Artifacts, get: Callable[[str], bytes] = fetch, base: str = BASE_URL) -> int:
    """Verified archives of both intervals; the folder must be one that this machine can write to."""
    start, end = (dt.date.fromisoformat(str(lookup(config, f"data.{k}_date"))) for k in ("start", "end"))
    for side in ("coarse", "fine"):
        paths = archives.download_range(lookup(config, "data.symbol"), lookup(config, f"data.intervals.{side}"), start, end, base, at.raw, get)
        print(f"{side}: {len(paths)} archives")
    return 0


def data_prepare(spark: SparkSession, config: dict, at: Artifacts) -> int:
    """Canonical bars and a report of both intervals."""
    symbol, source = lookup(config, "data.symbol"), {k: lookup(config, f"data.{k}") for k in ("source", "market", "series")}
    for side, minutes in sides(config).items():
        folder = f"{at.raw}/{archives.MARKET}/{symbol}/{lookup(config, f'data.intervals.{side}')}"
        dropped = klines.prepare(spark, folder, symbol, minutes, str(lookup(config, "data.start_date")), str(lookup(config, "data.end_date")), at.bars(side), at.report(f"{side}_data"), source=source)
        print(f"{side}: bars in {at.bars(side)}, {dropped} repeated ones dropped")
    return 0


def coarse_bars(spark: SparkSession, at: Artifacts) -> DataFrame:
    return spark.read.parquet(at.bars("coarse"))


def dataset_build(spark: SparkSession, config: dict, at: Artifacts) -> int:
    """Labelled samples with their part, and a report of labels and parts."""
    minutes = sides(config)["coarse"]
    errors = checks.label_inputs(coarse_bars(spark, at)).filter("NOT passed").collect()
    if errors:
        raise ValueError(f"bars that labels can't be made of: {errors[0].asDict()}")
    labelled = labels.candidates(coarse_bars(spark, at), minutes)
    ratios = Ratios(*(float(lookup(config, f"split.{p}_ratio")) for p in ("train", "validation", "test")))
    write_table(splits.chronological(labels.samples(labelled), ratios, int(lookup(config, "split.purge_minutes"))), at.samples)
    parts = {r.split: r.asDict() for r in splits.full_report(spark.read.parquet(at.samples), labels.samples(labelled)).collect()}
    write_report(spark, at.report("samples"), checks.merged_report(reports.label_report(labelled), {"parts": parts}))
    return 0


def data_check(spark: SparkSession, config: dict, at: Artifacts) -> int:
    """Bars of both intervals, how they fit together, labels and parts: everything that fails is printed."""
    errors = []
    for side, minutes in sides(config).items():
        wrong = schema_errors(spark.read.parquet(at.bars(side)))
        if wrong:
            return tell([f"{side} bars: {w}" for w in wrong])
        errors += [f"{side} bars: {r.asDict()}" for r in quality.preflight(spark.read.parquet(at.bars(side)), minutes).filter("NOT passed").collect()]
    coarse, fine = (spark.read.parquet(at.bars(s)) for s in ("coarse", "fine"))
    size = sides(config)
    unaligned = quality.alignment_contract(coarse, fine, size["coarse"] // size["fine"], size["fine"]).filter("NOT aligned AND NOT gap_explained")
    errors += [f"coarse bar without its fine bars: {r.asDict()}" for r in unaligned.orderBy("coarse_open").limit(10).collect()]
    if files.exists(spark, at.samples):
        samples = spark.read.parquet(at.samples)
        errors += [f"labels: {r.asDict()}" for r in labels.causality_check(samples, coarse, size["coarse"]).filter("NOT passed").collect()]
        errors += [f"parts: {r.asDict()}" for r in splits.check(samples).filter("NOT passed").collect()]
    return tell(errors)


def tell(errors: list[str]) -> int:
    for error in checks.distinct_messages(errors):
        print(error)
    print(f"CHECK = {'FAIL' if errors else 'PASS'}")
    return 1 if errors else 0


def built(coarse: DataFrame, fine: DataFrame, size: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fusion.multires(coarse, fine, size["coarse"], size["fine"])


def feature_build(spark: SparkSession, config: dict, at: Artifacts) -> int:
    """Features of both resolutions, fused ones, the dataset of all samples, and their reports."""
    coarse, fine, _ = built(*(spark.read.parquet(at.bars(s)) for s in ("coarse", "fine")), sides(config))
    write_table(coarse, at.features("coarse"))
    write_table(fine, at.features("fine"))
    coarse, fine = (spark.read.parquet(at.features(s)) for s in ("coarse", "fine"))
    write_table(fusion.fuse(coarse, fine), at.features("fused"))
    fused, samples = spark.read.parquet(at.features("fused")), spark.read.parquet(at.samples)
    write_table(fusion.dataset(samples, fused), at.dataset, ("split",))
    data, on = spark.read.parquet(at.dataset), ["symbol", "prediction_time"]
    write_report(spark, at.report("coarse_features"), reports.coarse_report(coarse.join(samples.select(*on, "split", "label_valid"), on, "left")))
    write_report(spark, at.report("multires_features"), reports.multires_report(fused, data))
    return 0


def feature_check(spark: SparkSession, config: dict, at: Artifacts) -> int:
    """Columns, finite values, one row a prediction, equal samples of all views, and proofs on the bars at hand.

    The proofs cut at the middle of the bars: later prices may not reach earlier features, and a missing
    bar must be noticed.
    """
    tables = {s: spark.read.parquet(at.features(s)) for s in ("coarse", "fine", "fused")}
    errors = checks.feature_schema_errors(tables["coarse"], features.coarse_set().names(), ("symbol", "prediction_time"))
    errors += checks.feature_schema_errors(tables["fine"], fusion.fine_names(), ("symbol", "prediction_time"), ("feature_valid", "feature_invalid_reason", "alignment_valid"))
    errors += checks.feature_schema_errors(tables["fused"], fusion.coarse_names() + fusion.fine_names(), ("symbol", "prediction_time"), (*fusion.VALIDITY[:-1], "feature_invalid_reason"))
    for side, names in (("coarse", features.coarse_set().names()), ("fine", fusion.fine_names()), ("fused", fusion.coarse_names() + fusion.fine_names())):
        errors += [f"{side}: {r.asDict()}" for r in checks.finite(tables[side], names).filter("NOT passed").limit(10).collect()]
        errors += [f"{side} and coarse: {r.asDict()}" for r in checks.one_to_one(tables[side], tables["coarse"]).filter("NOT passed").collect()]
    data = spark.read.parquet(at.dataset)
    views = {v: fusion.project(data, v).filter("common_eligible") for v in VIEWS}
    errors += [f"samples: {r.asDict()}" for r in fingerprints.compare(views, ["sample_id", "prediction_time", "target_up"], ["split"]).filter("NOT equal").collect()]
    size, (coarse, fine) = sides(config), (spark.read.parquet(at.bars(s)) for s in ("coarse", "fine"))
    middle = coarse.agg(F.timestamp_micros(((F.min(F.unix_micros(F.col("open_time").cast("timestamp"))) + F.max(F.unix_micros(F.col("open_time").cast("timestamp")))) / 2).cast("long")).alias("t")).first().t
    cut = F.lit(middle)
    flags = ("multires_feature_valid", "feature_invalid_reason")
    proof = proofs.mutation_proof(lambda c, f: built(c, f, size)[2], [coarse, fine], cut, fusion.coarse_names() + fusion.fine_names(), flags)
    errors += [f"later prices reach earlier features: {r.asDict()}" for r in proof.filter("NOT passed").collect()]
    for side, spec, table in (("coarse", features.coarse_set(), coarse), ("fine", features.fine_set(), fine)):
        nearest = table.filter(F.col("open_time") >= cut).agg(F.min("open_time").alias("t")).first().t
        build = lambda b, spec=spec, side=side: features.build(b, spec, size[side])
        found = proofs.gap_proof(build, table, F.col("open_time") == F.lit(nearest), spec.names(), spec.max_lag)
        errors += [f"{side}: a missing bar goes unnoticed or spreads: {r.asDict()}" for r in found.filter("NOT passed").collect()]
    return tell(errors)


def start_run(spark: SparkSession, folder: str, info: dict) -> None:
    if files.exists(spark, folder) and files.names(spark, folder):
        raise FileExistsError(f"{folder} holds an earlier run")
    write_report(spark, f"{folder}/run_info.json", info)


def finish_run(spark: SparkSession, folder: str, info: dict) -> int:
    """The last status of a run, which fails if a file of the test part is anywhere in its folder."""
    errors = checks.sealing_errors(info, files.names(spark, folder))
    write_report(spark, f"{folder}/run_info.json", info | {"status": "FAILED", "error": "; ".join(errors)} if errors else info | {"status": "COMPLETE"})
    return 1 if errors else 0


def in_run(spark: SparkSession, config: dict, at: Artifacts, run_id: str, work: Callable[[str], dict]) -> int:
    folder, info = at.run(run_id), {"run_id": run_id, "status": "RUNNING", "test_status": checks.SEALED, "seed": lookup(config, "project.seed")}
    start_run(spark, folder, info)
    write_report(spark, f"{folder}/config.json", config)
    try:
        info |= work(folder)
    except Exception as problem:
        write_report(spark, f"{folder}/run_info.json", info | {"status": "FAILED", "error": str(problem)[:1000]})
        raise
    return finish_run(spark, folder, info)


def model_params(config: dict, model: str, given: dict[str, Any]) -> dict[str, Any]:
    """The configuration's seed and patience, where a model has them, and what was given."""
    own = {"seed": lookup(config, "project.seed")} | ({"patience": lookup(config, "training.early_stopping.stopping_rounds")} if model == "leafwise_trees" else {})
    return own | given


def train_view(spark: SparkSession, config: dict, at: Artifacts, folder: str, view: str, model: str, given: dict[str, Any]) -> DataFrame:
    """Fit one view, leave model, importance, metadata and predictions of the validation part; return the predictions."""
    data = fusion.project(spark.read.parquet(at.dataset).filter(F.col("split") != "test"), view)
    names = fusion.view(view).names
    errors = checks.view_errors(data, names, fusion.view(view).valid)
    if errors:
        raise ValueError("; ".join(errors))
    make: Callable[..., ProbabilityModel] = lambda **p: make_model(model, **p)
    fitted = train_two_stages(fusion.model_rows(data, "train"), names, make, **model_params(config, model, given))
    info = DataInfo(len(names), tuple(names), "target_up", int(lookup(config, "target.horizon_minutes")))
    predicted = fitted.predict(fusion.model_rows(data, "validation")).select("symbol", "sample_id", "prediction_time", "target_up", "predicted_probability_up")
    write_table(predicted, f"{folder}/predictions")
    if isinstance(fitted, LeafwiseTrees):
        fitted.save(spark, f"{folder}/model.json", view)
        rows = [{"feature": n, "importance_gain": g, "importance_split": s} for n, g, s in fitted.importances()]
    else:
        rows = [{"feature": n, "importance_gain": g} for n, g in fitted.importance()]
    groups = [(name, group) for group, members in fusion.view(view).groups.items() for name in members]
    gains = spark.createDataFrame([(r["feature"], float(r["importance_gain"])) for r in rows], "feature string, gain double")
    shares = [r.asDict() for r in metrics.group_importance(gains, spark.createDataFrame(groups, "feature string, feature_group string")).collect()]
    write_report(spark, f"{folder}/importance.json", {"features": rows, "groups": shares})
    write_report(spark, f"{folder}/metadata.json", info.as_dict() | {"model": model, "view": view, "trees": getattr(fitted, "best", None)})
    return spark.read.parquet(f"{folder}/predictions")


def evaluate(spark: SparkSession, scored: DataFrame, folder: str) -> None:
    """Metrics and reports of ``prediction_time, y, p``, each as JSON."""
    one = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  reports of a few rows
    probability = {**metrics.probability_metrics(scored).first().asDict()}
    write_report(spark, f"{folder}/evaluation.json", {"metrics": probability, "reliability": one(metrics.reliability(scored)), "confidence": one(metrics.confidence(scored)), "monthly": one(metrics.monthly(scored))})


def as_scored(predicted: DataFrame, view: str) -> DataFrame:
    return predicted.select(F.lit(view).alias("variant"), "prediction_time", F.col("target_up").alias("y"), F.col("predicted_probability_up").alias("p"))


def train(spark: SparkSession, config: dict, at: Artifacts, model: str, run_id: str, view: str = "coarse", **given: Any) -> int:
    """One model of one view; the test part stays sealed."""
    def work(folder: str) -> dict:
        evaluate(spark, as_scored(train_view(spark, config, at, folder, view, model, given), view), folder)
        return {"model": model, "view": view}

    return in_run(spark, config, at, run_id, work)


def compare_features(spark: SparkSession, config: dict, at: Artifacts, model: str, run_id: str, **given: Any) -> int:
    """A model of each view on the same samples, and what the finer ones add to the coarse one."""
    def work(folder: str) -> dict:
        scored = None
        for view in VIEWS:
            one = as_scored(train_view(spark, config, at, f"{folder}/{view}", view, model, given), view)
            evaluate(spark, one, f"{folder}/{view}")
            scored = one if scored is None else scored.unionByName(one)
        compared = metrics.comparison(scored)
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row for each view
        best = metrics.best_variant(compared).first().asDict()
        write_report(spark, f"{folder}/comparison.json", {"views": rows(compared), "incremental": rows(metrics.incremental(compared, "coarse")), "best": best})
        return {"model": model, "best": best}

    return in_run(spark, config, at, run_id, work)


def workspace_check(spark: SparkSession, config: dict, at: Artifacts) -> int:
    """What a run's folder holds so far, and that the configuration's payout is what it implies."""
    event = config["event"]
    errors = [] if abs(event["win_pnl"] - (event["winning_total_return_usdt"] - event["stake_usdt"])) < 1e-12 and event["loss_pnl"] == -event["stake_usdt"] else ["the payout isn't what stake and return give"]
    for name in ("raw", "processed", "reports", "results"):
        print(f"{name.upper()} = {'PRESENT' if files.exists(spark, at.at(name)) else 'MISSING'}")
    print(f"DATA = {'CONFIGURED' if all(files.exists(spark, at.bars(s)) for s in ('coarse', 'fine')) else 'NOT_CONFIGURED'}")
    return tell(errors)
