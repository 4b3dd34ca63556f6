from retentia.plans import jobs
from retentia.plans.catalog import features_of
from retentia.schema import FEATURE_COLUMNS
from retentia.session import scratch_path
from retentia.sources import io
from retentia.sources.activity import activity_log
from tests.conftest import SF_MID, rows_of


def test_feature_model_score_jobs(spark):
    events = scratch_path(spark, "t-job-events")
    io.write_events(activity_log(spark, SF_MID), events, fmt="json")
    feats = scratch_path(spark, "t-job-features")
    ft = jobs.feature_job(spark, events, feats)
    assert rows_of(ft) == rows_of(features_of(spark, SF_MID))

    model, results = scratch_path(spark, "t-job-model"), scratch_path(spark, "t-job-results")
    grid = {"numTrees": [5], "maxDepth": [3], "impurity": ["gini"], "featureSubsetStrategy": ["sqrt"]}
    out = jobs.model_job(spark, feats, model, results, grid=grid)
    assert spark.read.parquet(f"{results}/compare").count() == 8
    assert spark.read.parquet(f"{results}/cv").count() == 1
    assert {r.split for r in out["tuned"].collect()} == {"train", "test", "valid"}

    scored = jobs.score_job(spark, model, feats, scratch_path(spark, "t-job-scores"))
    assert scored.count() == ft.count()
    assert set(scored.columns) == {"userId", "probability", "prediction", "decision"}
    assert ft.columns == FEATURE_COLUMNS


def test_score_command_reads_csv_with_header(spark, monkeypatch):
    """A headered CSV of requests is scored from the command line; an existing output needs a mode."""
    import pytest

    from retentia.operators import score
    from retentia.plans.catalog import labelled_of
    data = labelled_of(spark, SF_MID)
    model, requests, out = (scratch_path(spark, f"t-cli-{x}") for x in ("model", "requests", "out"))
    score.save_model(score.fit_scoring_model(data, "Naive Bayes"), model)
    io.write_features(data, requests, header=True)
    monkeypatch.setattr(jobs, "build_session", lambda **_: spark)
    args = ["score", "--model", model, "--requests", requests, "--out", out, "--requests-format", "csv", "--header"]
    jobs.main(args)
    assert spark.read.parquet(out).count() == data.count()
    with pytest.raises(Exception):
        jobs.main(args)
    jobs.main([*args, "--mode", "overwrite"])
    assert spark.read.parquet(out).count() == data.count()
