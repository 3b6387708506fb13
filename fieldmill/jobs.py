"""Command line jobs: ``spark-submit fieldmill/jobs.py <job> ...`` or ``python -m fieldmill.jobs``.

preview    first targets and sizes of a dataset's splits
evaluate   score raw answers against gold targets; writes predictions, summary, per-field scores
compare    summaries of two prediction files on the same rows, and their difference
pairs      preference pairs from gold targets or from a prediction file's mistakes
sweep      score the answers of all runs of a sweep and rank them
preference message rows for preference training out of pairs and their samples
encode     token ids, labels and masks of a dataset's chat rows

Rows that a job cannot use are written to ``<out>_quarantine``, with a reason.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.operators.batching import encode
from fieldmill.operators.pairs import (
    pairs_from_gold,
    pairs_from_predictions,
    to_preference_rows,
    without_target,
)
from fieldmill.operators.scoring import compare_models, evaluate, per_field, score, summarize
from fieldmill.operators.sweeps import expand_runs, metrics_long, rank_runs, sweep_results
from fieldmill.registry import open_dataset
from fieldmill.session import ship_package, work_folder
from fieldmill.sources.samples import (
    preview,
    read_pairs,
    read_predictions,
    write_metrics,
    write_pairs,
    write_predictions,
    write_results,
)


def _schema(path: str | None) -> dict | None:
    return None if path is None else json.loads(Path(path).read_text(encoding="utf-8"))


def _dataset(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """All splits of the named dataset under one another, with their common columns."""
    options = {"n_train": args.n_train, "n_eval": args.n_eval}
    if args.path:
        options["path"] = args.path
    splits = open_dataset(spark, args.dataset, **options)
    rows = splits["train"].unionByName(splits["validation"])
    reason = F.col("bad_reason") if "bad_reason" in rows.columns else F.lit(None).cast("string")
    return rows.select("split", "index", "target_json", reason.alias("bad_reason"))


def _quarantine(rows: DataFrame, out: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(f"{out}_quarantine")


def _split_off(rows: DataFrame, purpose: str, out: str) -> DataFrame:
    """The usable rows; those with a ``bad_reason`` go to quarantine.  Computed once."""
    place = work_folder(rows.sparkSession, purpose)
    rows.write.parquet(place)
    there = rows.sparkSession.read.parquet(place)
    _quarantine(there.where("bad_reason IS NOT NULL"), out)
    return there.where("bad_reason IS NULL").drop("bad_reason")


def run_preview(spark: SparkSession, args: argparse.Namespace) -> None:
    preview(_dataset(spark, args).drop("bad_reason"), args.n).orderBy("split", "index").show(truncate=False)


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    answers = spark.read.schema("index bigint, raw string").json(args.answers)
    golds = (
        _dataset(spark, args)
        .where(F.col("split") == args.split)
        .select("index", F.col("target_json").alias("gold"))
    )
    # Scored once into the shared folder; the three outputs read it from there.
    place = work_folder(spark, "scored")
    evaluate(answers, golds, _schema(args.schema), args.limit).write.parquet(place)
    scored = spark.read.parquet(place)
    write_predictions(scored, f"{args.out}/predictions")
    write_metrics(summarize(scored), f"{args.out}/summary")
    write_metrics(per_field(scored).orderBy("field"), f"{args.out}/per_field")
    bad = scored.where("NOT gold_valid").withColumn("bad_reason", F.lit("gold is not JSON"))
    _quarantine(bad.select("index", "gold", "raw", "bad_reason"), args.out)


def run_compare(spark: SparkSession, args: argparse.Namespace) -> None:
    def side(path: str, model: str) -> DataFrame:
        rows = read_predictions(spark, path).where("bad_reason IS NULL").select("gold", "raw")
        return rows.withColumn("model", F.lit(model))

    both = side(args.baseline, "baseline").unionByName(side(args.adapter, "adapter"))
    sums = summarize(score(both, schema=_schema(args.schema)), "model")
    write_metrics(compare_models(metrics_long(sums)), args.out)


def run_pairs(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.from_predictions:
        read = read_predictions(spark, args.from_predictions)
        rows, bad = read.where("bad_reason IS NULL"), read.where("bad_reason IS NOT NULL")
        pairs = pairs_from_predictions(rows, args.split)
    else:
        samples = _dataset(spark, args)
        pairs = pairs_from_gold(samples, args.split, args.n, args.seed)
        bad = without_target(samples)
    write_pairs(pairs, args.out)
    _quarantine(bad, args.out)


def run_preference(spark: SparkSession, args: argparse.Namespace) -> None:
    samples = spark.read.parquet(args.samples)
    rows = to_preference_rows(read_pairs(spark, args.pairs), samples, args.instruction)
    _split_off(rows, "preference", args.out).write.parquet(args.out)


def run_encode(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = _dataset(spark, args)
    reason = F.coalesce("bad_reason", F.when(F.col("target_json").isNull(), "no target"))
    usable = _split_off(rows.withColumn("bad_reason", reason), "encode", args.out)
    encode(usable, args.instruction, max_len=args.max_len).write.parquet(args.out)


def run_sweep(spark: SparkSession, args: argparse.Namespace) -> None:
    """Answers lie in folders ``run_no=<n>`` of prediction lines, n as ``expand_runs`` counts."""
    spec = json.loads(Path(args.spec).read_text(encoding="utf-8"))
    grid, variants = spec.get("grid"), spec.get("variants")
    answers = read_predictions(spark, args.answers).where("bad_reason IS NULL")
    sums = summarize(score(answers, schema=_schema(args.schema)), "run_no")
    metrics = sums.withColumn("run_id", F.format_string("run-%06d", F.col("run_no").cast("int")))
    runs = expand_runs(spark, grid, variants, spec.get("fixed"))
    ranked = rank_runs(sweep_results(runs, metrics, grid, bool(variants)))
    # One row per run of the spec: a single file keeps the ranking readable.
    write_results(ranked.coalesce(1), args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)

    def add(name: str, run, dataset: bool = False) -> argparse.ArgumentParser:
        job = jobs.add_parser(name)
        job.set_defaults(run=run)
        if dataset:
            job.add_argument("--dataset", default="synthetic_invoices")
            job.add_argument("--path")
            job.add_argument("--n-train", type=int)
            job.add_argument("--n-eval", type=int)
        return job

    add("preview", run_preview, True).add_argument("--n", type=int, default=3)
    job = add("evaluate", run_evaluate, True)
    job.add_argument("--answers", required=True, help="JSON lines with index and raw")
    job.add_argument("--split", default="validation")
    job.add_argument("--schema")
    job.add_argument("--limit", type=int)
    job.add_argument("--out", required=True)
    job = add("compare", run_compare)
    for name in ("--baseline", "--adapter", "--out"):
        job.add_argument(name, required=True)
    job.add_argument("--schema")
    job = add("pairs", run_pairs, True)
    job.add_argument("--from-predictions")
    job.add_argument("--split", default="train")
    job.add_argument("--n", type=int, default=128)
    job.add_argument("--seed", type=int, default=0)
    job.add_argument("--out", required=True)
    job = add("preference", run_preference)
    for name in ("--pairs", "--samples", "--instruction", "--out"):
        job.add_argument(name, required=True)
    job = add("encode", run_encode, True)
    job.add_argument("--instruction", required=True)
    job.add_argument("--max-len", type=int, default=2048)
    job.add_argument("--out", required=True)
    job = add("sweep", run_sweep)
    for name in ("--spec", "--answers", "--out"):
        job.add_argument(name, required=True)
    job.add_argument("--schema")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"fieldmill-{args.job}").getOrCreate()
    ship_package(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
