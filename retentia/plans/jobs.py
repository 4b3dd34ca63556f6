"""End-to-end batch jobs: event log -> feature table -> models -> scores.

    python -m retentia.plans.jobs features --events DIR --out DIR [--events-format json]
    python -m retentia.plans.jobs model --features DIR --model DIR --results DIR [--top-list-on-all-rows]
    python -m retentia.plans.jobs score --model DIR --requests DIR --out DIR [--requests-format csv --header]

Outputs are written by the executors (parquet unless stated); the driver only
sees metric scalars and the grid table.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from retentia.operators import encode, evaluate, score, train
from retentia.operators.features import feature_table
from retentia.session import build_session, materialize
from retentia.sources import io


def feature_job(spark: SparkSession, events: str, out: str, events_format: str = "json",
                out_format: str = "parquet", header: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Read the log with the declared schema, build the feature table, write it."""
    ft = feature_table(io.read_events(spark, events, fmt=events_format))
    io.write_features(ft, out, fmt=out_format, header=header, mode=mode)
    return io.read_features(spark, out, fmt=out_format, header=header)


def model_job(spark: SparkSession, features: str, model_path: str, results: str, features_format: str = "parquet",
              header: bool = False, grid: dict | None = None, parallelism: int = 4, mode: str = "errorifexists",
              top_list_on_all_rows: bool = False) -> dict[str, DataFrame]:
    """Compare the four classifiers, tune the forest, save the scoring pipeline.

    Writes ``<results>/compare``, ``<results>/cv`` and ``<results>/tuned`` and
    the fitted scoring pipeline to ``model_path``.
    """
    data = materialize(encode.labelled(io.read_features(spark, features, fmt=features_format, header=header)))
    collapse_on = data if top_list_on_all_rows else None
    compare = train.compare(data, parallelism=parallelism, collapse_on=collapse_on)
    best, cv_results = train.cv_tune(data, grid=grid, parallelism=parallelism)
    tuned = evaluate.weighted_f1(best.transform(data), keys=("split",))
    out = {"compare": compare, "cv": cv_results, "tuned": tuned}
    for name, df in out.items():
        df.write.mode(mode).parquet(f"{results}/{name}")
    score.save_model(score.fit_scoring_model(data, collapse_on=collapse_on), model_path)
    return out


def score_job(spark: SparkSession, model_path: str, requests: str, out: str, requests_format: str = "parquet",
              header: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Score every request row with the saved pipeline; write (userId, probability, prediction, decision)."""
    reqs = io.read_features(spark, requests, fmt=requests_format, header=header)
    scored = score.batch_score(score.load_model(model_path), reqs)
    scored.write.mode(mode).parquet(out)
    return spark.read.parquet(out)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="retentia.plans.jobs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    f = sub.add_parser("features")
    f.add_argument("--events", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--events-format", default="json")
    f.add_argument("--out-format", default="parquet")
    m = sub.add_parser("model")
    m.add_argument("--features", required=True)
    m.add_argument("--model", required=True)
    m.add_argument("--results", required=True)
    m.add_argument("--features-format", default="parquet")
    m.add_argument("--top-list-on-all-rows", action="store_true")
    s = sub.add_parser("score")
    s.add_argument("--model", required=True)
    s.add_argument("--requests", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--requests-format", default="parquet")
    for p in (f, m, s):
        p.add_argument("--header", action="store_true", help="CSV files have a header line")
        p.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite", "append", "ignore"])
    args = ap.parse_args(argv)
    # Master, resources and partition counts come from spark-submit.
    spark = build_session(master=None, shuffle_partitions=None)
    if args.cmd == "features":
        feature_job(spark, args.events, args.out, args.events_format, args.out_format, args.header, args.mode)
    elif args.cmd == "model":
        model_job(spark, args.features, args.model, args.results, args.features_format, args.header, mode=args.mode,
                  top_list_on_all_rows=args.top_list_on_all_rows)
    else:
        score_job(spark, args.model, args.requests, args.out, args.requests_format, args.header, args.mode)


if __name__ == "__main__":
    main()
