"""Command line: ``python -m barloom.cli COMMAND``. Exit code 0 is success, 1 a failed check, 2 a usage or configuration error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config, workflow
from .operators import checks, fusion, labels, metrics, quality, splits
from .operators.model import BoostedTrees, train_two_stages
from .params import Ratios, interval_minutes
from .session import ship
from .sources import klines
from .sources.sinks import new_run_folder, write_json, write_report_csv, write_table


def prepare(spark: SparkSession, args) -> int:
    dropped = klines.prepare(spark, args.raw, args.symbol, interval_minutes(args.interval), args.start, args.end, args.out)
    print(f"bars written to {args.out}; {dropped} repeated bars dropped")
    return 0


def check(spark: SparkSession, args) -> int:
    rows = quality.preflight(spark.read.parquet(args.bars), interval_minutes(args.interval)).collect()
    for row in rows:
        print(row.asDict())
    return 0 if rows and all(r.passed for r in rows) else 1


def dataset(spark: SparkSession, args) -> int:
    coarse, fine = spark.read.parquet(args.bars), spark.read.parquet(args.fine)
    minutes, fine_minutes = interval_minutes(args.interval), interval_minutes(args.fine_interval)
    split = splits.chronological(labels.samples(labels.candidates(coarse, minutes)), Ratios(), minutes)
    fused = fusion.multires(coarse, fine, minutes, fine_minutes)[2]
    write_table(fusion.dataset(split, fused), args.out, ("split",))
    return 0


def show_config(spark: SparkSession, args) -> int:
    """The configuration with defaults and derived values, or what is wrong with it."""
    print(json.dumps(config.load(args.config), indent=2, default=str, sort_keys=True))
    return 0


def feature_check(spark: SparkSession, args) -> int:
    """Columns, finite values and one row per sample of a dataset's features."""
    data = spark.read.parquet(args.data)
    view = fusion.view(args.view)
    errors = checks.view_errors(data, view.names, view.valid)
    if not errors:
        bad = checks.finite(fusion.project(data, args.view), view.names).filter("NOT passed").limit(10).collect()
        errors += [f"values that aren't finite: {r.asDict()}" for r in bad]
        repeated = data.groupBy("symbol", "prediction_time").count().filter("count > 1").limit(10).collect()
        errors += [f"repeated prediction time: {r.asDict()}" for r in repeated]
    for error in checks.distinct_messages(errors):
        print(error, file=sys.stderr)
    return 1 if errors else 0


def compare(spark: SparkSession, args) -> int:
    """Train each view on the same samples; the test part is never read."""
    folder = new_run_folder(args.out)
    info = {"status": "RUNNING", "test_status": checks.SEALED}
    write_json(info, f"{folder}/run_info.json")
    try:
        best = evaluate(spark, args, folder)
    except Exception as problem:
        write_json(info | {"status": "FAILED", "error": str(problem)[:1000]}, f"{folder}/run_info.json")
        raise
    info |= {"status": "COMPLETE", "best": best}
    errors = checks.sealing_errors(info, os.listdir(folder))
    write_json(info | ({"status": "FAILED", "error": "; ".join(errors)} if errors else {}), f"{folder}/run_info.json")
    return 1 if errors else 0


def evaluate(spark: SparkSession, args, folder: str) -> dict:
    """Predictions of every view and the reports on them; returns the best view's row."""
    data = spark.read.parquet(args.data).filter(F.col("split") != "test")
    scored = None
    for name in ("coarse", "fine", "multires"):
        view = fusion.project(data, name)
        model = train_two_stages(fusion.model_rows(view, "train"), fusion.view(name).names, BoostedTrees, trees=args.trees)
        p = model.predict(fusion.model_rows(view, "validation")).select(F.lit(name).alias("variant"), "prediction_time", F.col("target_up").alias("y"), F.col("predicted_probability_up").alias("p"))
        scored = p if scored is None else scored.unionByName(p)
    write_table(scored, f"{folder}/predictions")
    scored = spark.read.parquet(f"{folder}/predictions")
    compared = metrics.comparison(scored)
    write_report_csv(compared, f"{folder}/comparison")
    write_report_csv(metrics.incremental(compared, "coarse"), f"{folder}/incremental")
    for name in ("coarse", "fine", "multires"):
        of = scored.filter(F.col("variant") == name)
        write_report_csv(metrics.reliability(of), f"{folder}/reliability_{name}")
        write_report_csv(metrics.confidence(of), f"{folder}/confidence_{name}")
        write_report_csv(metrics.monthly(of), f"{folder}/monthly_{name}")
    return metrics.best_variant(compared).first().asDict()


#: Commands that a configuration drives, and what they take besides it and the run's folder.
STEPS = {
    "check": (workflow.workspace_check, {}), "data-download": (workflow.data_download, {}), "data-prepare": (workflow.data_prepare, {}), "data-check": (workflow.data_check, {}),
    "dataset-build": (workflow.dataset_build, {}), "feature-build": (workflow.feature_build, {}), "feature-check": (workflow.feature_check, {}),
    "train": (workflow.train, {"model": "leafwise_trees", "run-id": "train", "view": "coarse"}), "compare-features": (workflow.compare_features, {"model": "leafwise_trees", "run-id": "compare"}),
}


def step(spark: SparkSession, args) -> int:
    """One step of a run; a configuration that can't be run is a usage error."""
    run, more = STEPS[args.command]
    given = {name.replace("-", "_"): getattr(args, name.replace("-", "_")) for name in more}
    if getattr(args, "trees", None):
        given["trees"] = args.trees
    return run(spark, config.load(args.config), workflow.Artifacts(args.root), **given)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barloom")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(title: str, run, *names: str, **defaults: str):
        sub = commands.add_parser(title, help=run.__doc__)
        for name in names:
            sub.add_argument(f"--{name}", required=name not in defaults, default=defaults.get(name))
        sub.set_defaults(run=run)
        return sub

    for title, (run, more) in STEPS.items():
        sub = command(title, run, "config", "root", *more, **more)
        if "model" in more:
            sub.add_argument("--trees", type=int)
        sub.set_defaults(run=step)
    command("show-config", show_config, "config")
    # The same work on tables at hand, without a configuration.
    command("bars-prepare", prepare, "raw", "symbol", "interval", "start", "end", "out")
    command("bars-check", check, "bars", "interval")
    command("bars-dataset", dataset, "bars", "fine", "interval", "fine-interval", "out")
    command("view-check", feature_check, "data", "view", view="multires")
    command("views-compare", compare, "data", "out").add_argument("--trees", type=int, default=50)
    args = parser.parse_args(argv)
    spark = ship(SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    try:
        return args.run(spark, args)
    except config.ConfigError as problem:
        print(f"CONFIG = FAIL: {problem}", file=sys.stderr)
        return 2
    except (ValueError, OSError) as problem:
        print(problem, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
