"""Counts, versions, groups and lookups on small rows, with the empty, null and tied cases."""

import pytest
from pyspark.sql import functions as F

from loomlab.operators import catalog as cat
from loomlab.operators import experiments as ex
from loomlab.operators import reports


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_run_counts_keep_zero(spark):
    experiments = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    runs = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (9, 13), (None, 14)], "experiment_id long, run_id long")
    assert rows(ex.run_counts(experiments, runs)) == [(1, 2), (2, 0), (3, 1)]
    assert rows(ex.run_counts(experiments, runs.limit(0))) == [(1, 0), (2, 0), (3, 0)]


def test_status_counts(spark):
    jobs = spark.createDataFrame([("running",), ("running",), (None,)], "status string")
    assert rows(ex.status_counts(jobs)) == [("running", 2), (None, 1)]


def test_next_version_starts_at_one(spark):
    versions = spark.createDataFrame([(1, 1), (1, 4), (2, None)], "model_id long, version int")
    models = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert rows(ex.next_version(versions)) == [(1, 5), (2, 1)]
    assert rows(ex.next_version(versions, models)) == [(1, 5), (2, 1), (3, 1)]


def test_latest_version_by_family_and_project(spark):
    models = spark.createDataFrame(
        [(1, "net", None, "p", 1), (2, "net", None, "p", 2), (3, "net", None, None, 9), (4, "other", "net", "p", 3), (5, "x", "net", "p", 3), (6, "net", None, "q", 1)],
        "id long, name string, registry_name string, project string, version int",
    )
    assert rows(ex.latest_version(models)) == [("net", "p", 3, 5), ("net", "q", 1, 6), ("net", None, 9, 3)]


METRICS = "id long, job_id long, metric_name string, value double, step int, epoch int, recorded_at long"


def test_metric_history_is_oldest_first(spark):
    metrics = spark.createDataFrame([(3, 1, "a", 1.0, 0, 0, 5), (1, 1, "a", 1.0, 0, 0, 7), (2, 1, "a", 1.0, 0, 0, 5), (4, 2, "a", 1.0, 0, 0, 1)], METRICS)
    assert [r["id"] for r in ex.metric_history(metrics, 1).collect()] == [2, 3, 1]
    assert [r["id"] for r in ex.metric_history(metrics).collect()] == [2, 3, 1, 4]


def test_epoch_without_losses_is_zero(spark):
    metrics = spark.createDataFrame([(1, 1, "l", 1.0, 0, 0, 0), (2, 1, "l", 2.0, 1, 0, 0), (3, 1, "l", None, 2, 0, 0), (4, 1, "l", None, 0, 1, 0)], METRICS)
    assert rows(ex.epoch_loss(metrics)) == [(1, 0, 1.5, 2), (1, 1, 0.0, 0)]


def test_runs_may_share_a_job(spark):
    metrics = spark.createDataFrame([(1, 7, "loss", 0.5, 3, None, 0), (2, 7, "acc", 0.1, 3, 2, 0), (3, 8, "loss", 0.2, None, None, 0)], METRICS)
    runs = spark.createDataFrame([(1, 7, "r1"), (2, 7, "r2"), (3, None, "r3"), (4, 99, "r4")], "run_id long, job_id long, label string")
    got = ex.run_series(runs, metrics, "loss").select("run_id", "label", "step", "value")
    assert rows(got) == [(1, "r1", 3, 0.5), (2, "r2", 3, 0.5)]
    assert rows(ex.run_series(runs, metrics).select("run_id", "id", "step")) == [(1, 1, 3), (1, 2, 2), (2, 1, 3), (2, 2, 2)]


def test_metric_cards(spark):
    values = spark.createDataFrame(
        [(1, "val_accuracy", 0.5), (1, "f1", 0.25), (1, "loss", 9.0), (1, "acc", None), (2, "acc", 0.0), (3, "loss", 1.0)], "job_id long, key string, value double"
    )
    got = {(r["job_id"], r["key"]): r["percent_of_best"] for r in ex.metric_cards(values).collect()}
    assert got == {(1, "val_accuracy"): 100.0, (1, "f1"): 50.0, (1, "loss"): None, (1, "acc"): 0.0, (2, "acc"): 0.0, (3, "loss"): None}


def test_rows_of_chosen_owners(spark):
    owners = spark.createDataFrame([(1, "automl", "p"), (2, "plain", "p"), (3, "automl", "q")], "id long, kind string, project string")
    trials = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 1), (14, None), (15, 8)], "run_id long, experiment_id long")
    newest = [F.col("run_id").desc()]
    assert [r["run_id"] for r in cat.rows_of(trials, "experiment_id", owners, ["project"], newest, kind="automl").collect()] == [13, 12, 10]
    assert [r["run_id"] for r in cat.rows_of(trials, "experiment_id", owners, [], newest, kind="automl", project="q").collect()] == [12]
    assert [r["run_id"] for r in cat.rows_of(trials, "experiment_id", owners, [], newest, kind=None).collect()] == [13, 12, 11, 10]


def test_groups_without_members_stay(spark):
    flows = spark.createDataFrame([(1, "running"), (2, "draft")], "flow long, status string")
    steps = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (9, 1, "z")], "flow long, place int, kind string")
    got = [tuple(r) for r in cat.members_in_order(flows, "flow", steps, ["place"]).collect()]
    assert got == [(1, "running", 1, "a"), (1, "running", 2, "b"), (2, "draft", None, None)]


def test_load_group_by_id_else_newest_name(spark):
    groups = spark.createDataFrame([(1, "g", 10), (2, "g", 20), (3, "1", 30)], "id long, name string, created_at long")
    features = spark.createDataFrame([(1, "z"), (1, "a"), (2, "m"), (3, "o")], "group_id long, name string")
    load = lambda request: [r["name"] for r in cat.load_group(groups, features, request).collect()]
    assert load("g") == ["m"] and load("1") == ["a", "z"] and load("3") == ["o"] and load("?") == []


@pytest.mark.parametrize("limit", [1, 10])
def test_search_tables(spark, limit):
    a = spark.createDataFrame([(1, "beta", "x"), (2, "alpha", "BET"), (3, "gamma", None)], "id int, name string, description string")
    b = spark.createDataFrame([(7, "bet")], "id long, name string")
    got = rows(cat.search_tables({"project": (a, ["name", "description"]), "model": (b, ["name"])}, "bet", limit))
    assert got == [("model", 7, "bet"), ("project", 1, "beta"), ("project", 2, "alpha")] if limit > 1 else [("model", 7, "bet"), ("project", 2, "alpha")]


def test_attach_name_keeps_unknown_rows(spark):
    sets = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, model_id long")
    models = spark.createDataFrame([(5, "net")], "id long, name string")
    assert rows(cat.attach_name(sets, "model_id", models, "model").select("id", "model")) == [(1, "net"), (2, None), (3, None)]


def test_job_outputs(spark):
    jobs = spark.createDataFrame(
        [(1, "inference", '{"score": 3}', "completed"), (2, "inference", "{broken", "failed"), (3, "training", '{"score": 4}', "completed"), (4, "inference", None, "pending")],
        "id long, job_type string, metrics string, status string",
    )
    assert rows(cat.job_outputs(jobs, path="$.score", kind="int")) == [(1, "completed", 3), (2, "failed", None), (4, "pending", None)]


def test_installed_names(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("c",)], "name string")
    there = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "name string")
    assert rows(cat.installed_names(asked, there)) == [("a",)]


def test_panel_bottom(spark):
    layouts = [(1, '[{"visualization":1,"x":0,"y":4,"w":6,"h":3},{"visualization":2,"x":6,"y":0,"w":6,"h":9}]'), (2, "[]"), (3, None), (4, "{broken")]
    df = spark.createDataFrame(layouts, "dashboard_id long, layout string")
    assert rows(cat.panel_bottom(df)) == [(1, 9), (2, 0), (3, 0), (4, 0)]
    assert "Exchange" not in cat.panel_bottom(df)._jdf.queryExecution().toString()


def test_unread_and_active(spark):
    notes = spark.createDataFrame([(1, False), (1, True), (2, True), (1, None)], "user_id long, read boolean")
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert rows(reports.unread_count(notes)) == [(1, 1), (2, 0)]
    assert rows(reports.unread_count(notes, users)) == [(1, 1), (2, 0), (3, 0)]
    members = spark.createDataFrame([("p", True), ("p", None), ("q", False)], "project string, active boolean")
    assert rows(reports.active_counts(members, "project")) == [("p", 2, 1), ("q", 1, 0)]


def test_boards(spark):
    features = spark.createDataFrame([("g", "user", True), ("g", "user", False), ("h", "user", True), ("h", "item", None)], "group_name string, entity string, online boolean")
    assert rows(reports.feature_store_summary(features)) == [("g", 2, 1, 1), ("h", 2, 2, 1), (None, 4, 2, 2)]
    assert rows(reports.kpi_board({"a": spark.range(3), "b": spark.range(0)})) == [("a", 3), ("b", 0), (None, 3)]
