"""The jobs from the command line: preprocess, train, train-tuned, eda.

    python -m tessera.cli preprocess --train-path train.csv --test-path test.csv --output-dir processed
    python -m tessera.cli train --train-path processed/train_processed.parquet --test-path processed/test_processed.parquet
"""

from __future__ import annotations

import argparse
import logging
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import runtime
from tessera.config import FeatureConfig, PostConfig
from tessera.operators import cleaning, models
from tessera.plans import eda, features, scoring
from tessera.sources import tables

log = logging.getLogger("tessera")


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--seed", type=int, default=42, help="seed of every estimator")
    common.add_argument("--log-level", default="INFO", choices=runtime.LEVELS)
    common.add_argument("--log-dir", default="logs")
    top = argparse.ArgumentParser(prog="tessera")
    jobs = top.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("preprocess", parents=[common], help="clean both CSV files and derive time features")
    job.add_argument("--train-path", default="data/train.csv")
    job.add_argument("--test-path", default="data/test.csv")
    job.add_argument("--output-dir", default="data/processed")
    job.add_argument("--save-format", default="parquet", choices=["csv", "parquet"])
    job.add_argument("--run-eda", action="store_true", help="explore the raw train file too")

    job = jobs.add_parser("eda", parents=[common], help="tables and report of the raw train file")
    job.add_argument("--train-path", default="data/train.csv")
    job.add_argument("--output-dir", default="reports")

    for name, text in (("train", "fit, blend, correct and write a submission"), ("train-tuned", "the same without neighbour features and corrections")):
        job = jobs.add_parser(name, parents=[common], help=text)
        job.add_argument("--train-path", default="data/processed/train_processed.parquet")
        job.add_argument("--test-path", default="data/processed/test_processed.parquet")
        job.add_argument("--submission-path", default=None, help="sample submission, to check the number of rows")
        job.add_argument("--output-dir", default="submissions")
        job.add_argument("--models", nargs="+", default=list(models.PRESETS), choices=[*models.PRESETS, "boosted", "forest", "linear"])
        job.add_argument("--n-folds", type=int, default=2, help="folds of the target encoding")
        job.add_argument("--rounds", type=int, default=models.ROUNDS, help="boosting rounds at most")
        job.add_argument("--fit-day", type=int, default=PostConfig.fit_day)
        job.add_argument("--val-day", type=int, default=PostConfig.val_day)
    return top


def _describe(name: str, df: DataFrame) -> None:
    """Shape, columns and the first three rows, to the log."""
    log.info("%s: %d rows, %d columns: %s", name, df.count(), len(df.columns), ", ".join(df.columns))
    for row in df.limit(3).collect():
        log.info("%s preview: %s", name, row.asDict())


def preprocess(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    """Both files cleaned by medians of train, with time features and narrow types; returns the paths written."""
    raw = {name: tables.read_csv(spark, path) for name, path in (("train", args.train_path), ("test", args.test_path))}
    panels = {name: tables.panel_of_raw(df) for name, df in raw.items()}
    if args.run_eda:
        eda.run_all(panels["train"], f"{args.output_dir}/eda", args.seed)
    medians = cleaning.fit_medians(panels["train"])
    out = {}
    for name, panel in panels.items():
        df = medians.transform(cleaning.time_features(features.prepare(panel)))
        df = cleaning.coordinate_fallback(cleaning.decode_coordinates(df))
        df = cleaning.apply_downcast(df, cleaning.downcast_plan(df))
        out[name] = tables.save(df, f"{args.output_dir}/{name}_processed.{args.save_format}", args.save_format)
        _describe(name, tables.load(spark, out[name], df.schema))
    return out


def train(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Fit, blend, correct, write the submission pair and the run's facts; returns the facts."""
    tuned = args.job == "train-tuned"
    fit_rows, test = (tables.load(spark, p) for p in (args.train_path, args.test_path))
    fcfg, pcfg = FeatureConfig(folds=args.n_folds, seed=args.seed), PostConfig(fit_day=args.fit_day, val_day=args.val_day)
    exclude = scoring.TUNED_EXCLUDES if tuned else ()
    scored = scoring.train_score(fit_rows, test, tuple(args.models), fcfg, pcfg, args.rounds, rules=not tuned, exclude=exclude)
    predictions = scored.predictions.withColumnRenamed("idx", "Index")
    if args.submission_path:
        tables.matches_sample(spark, predictions, args.submission_path)
    stamp = f"{datetime.now():%Y%m%d_%H%M%S}"
    tables.save_submission_pair(predictions, args.output_dir, stamp)
    facts = {"timestamp": stamp, "models": list(args.models), "seed": args.seed, "feature_count": scored.features, "best_rounds": scored.rounds, "cv_scores": scored.scores, "blend_weights": scored.weights, "ensemble_r2": 100 * scored.r2}
    tables.save_json(spark, facts, f"{args.output_dir}/cv_meta_{stamp}.json")
    log.info("%s", facts)
    return facts


def main(argv: list[str] | None = None) -> object:
    args = parser().parse_args(argv)
    runtime.setup_logging(args.log_dir, args.log_level)
    runtime.set_seed(args.seed)
    spark = runtime.session()
    if args.job == "preprocess":
        return preprocess(spark, args)
    if args.job == "eda":
        panel = tables.panel_of_raw(tables.read_csv(spark, args.train_path))
        return eda.run_all(panel.filter(F.col("demand").isNotNull()), args.output_dir, args.seed)
    return train(spark, args)


if __name__ == "__main__":
    main()
