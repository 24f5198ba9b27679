"""The relations read single files and folders of part files alike, and queries read whole tables."""

import os

from __spark_entry__ import queries
from loomlab.streaming.metrics import append_to
from loomlab.session import scratch
from loomlab.tables import SCHEMAS, Lab


def test_schemas_are_those_of_the_files(spark, folder):
    lab = Lab(spark, folder)
    for name in SCHEMAS:
        assert lab.raw(name).schema == spark.read.parquet(lab.path(name)).schema, name


def test_streams_read_files_and_folders(spark, folder, tmp_path):
    single = Lab(spark, folder)
    single.raw("events").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    parts = Lab(spark, str(tmp_path))
    for lab in (single, parts):
        landed = append_to(spark, lab.stream("events").select("event_id"), scratch(spark, "e"))
        assert landed.distinct().count() == single.raw("events").count()


def test_results_do_not_depend_on_partitioning(spark, folder, tmp_path):
    for name in ("events", "orders", "customer", "embeddings"):
        Lab(spark, folder).raw(name).repartition(7).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("running_best", "best_run", "last_metric", "series_slots", "job_state", "scene_boundaries", "random_trials"):
        a, b = (queries()[name](spark, d) for d in (folder, str(tmp_path)))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


def test_no_reference_to_local_checkpoints():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for base, _, files in os.walk(os.path.join(root, "loomlab")):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(base, f)).read()
                assert "localCheckpoint" not in text and "crossJoin" not in text and ".rdd" not in text, f


def test_a_hot_group_is_cut_into_bounded_chunks(spark):
    """One sweep with two thirds of all trials still gives chunks of at most the chunk width."""
    from pyspark.sql import functions as F

    from loomlab.operators.ordered import _chunked

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("sweep_id"), F.col("id").alias("job_id"))
    sizes = _chunked(rows, ["sweep_id"], "job_id", 1000).groupBy("_group", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1000
