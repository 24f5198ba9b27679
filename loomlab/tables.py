"""The lab's relations, derived lazily from the given tables.

Every method returns an unevaluated DataFrame, so filters and column selections
written on top of it still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the given tables; a scan with a known schema starts no job to look for one.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def status_of(letter: Column) -> Column:
    expr = F.when(letter == "F", F.lit("completed"))
    return expr.when(letter == "O", F.lit("running")).otherwise(F.lit("pending"))


class Lab:
    """Relations of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def stream(self, name: str) -> DataFrame:
        """The table as a file stream; it may be a folder of part files or one file.

        File streams start from folders, so a single file is picked out of its folder by name.
        """
        reader = self.spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", "1000")
        if is_folder(self.spark, self.path(name)):
            return reader.parquet(self.path(name))
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)

    # metric points, log lines, notifications -------------------------------------------

    def metrics(self) -> DataFrame:
        return as_metrics(self.raw("events"))

    def notifications(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            F.col("ts").alias("created_at"),
            (F.col("value") < 50).alias("read"),
        )

    def logs(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("job_id"),
            F.col("turn").alias("logged_at"),
            F.col("role").alias("level"),
            F.col("text").alias("message"),
        )

    # catalog ---------------------------------------------------------------------------

    def jobs(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("model_id"),
            status_of(F.col("o_orderstatus")).alias("status"),
            F.col("o_orderpriority").alias("tier"),
            F.col("o_totalprice").alias("cost"),
            F.col("o_orderdate").alias("created_at"),
        )

    def models(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_nationkey").alias("project_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("framework"),
            F.col("c_acctbal").alias("score"),
        )

    def projects(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").alias("owner_id"),
        )

    def collaborators(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_nationkey").alias("project_id"),
            F.expr("cast(s_suppkey % 5 as int)").alias("user_id"),
        )

    def artifacts(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("job_id"),
            F.col("l_returnflag").alias("kind"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_extendedprice").alias("size"),
            F.col("l_shipdate").alias("created_at"),
        )

    def endpoints(self) -> DataFrame:
        balance = F.abs("s_acctbal")
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("project_id"),
            F.when(F.col("s_suppkey") % 7 == 0, "stopped").otherwise("active").alias("status"),
            F.round(balance % 5, 2).alias("error_rate"),
            F.round(balance % 1000, 2).alias("latency"),
            (1 + F.col("s_suppkey") % 3).alias("replicas"),
        )

    # runs --------------------------------------------------------------------------------

    def runs(self) -> DataFrame:
        """Experiment runs; which metric keys a run has depends on its experiment."""
        ratio = F.col("o_totalprice") / 500000
        metrics = (
            F.when(
                F.col("o_custkey") % 3 == 0,
                F.create_map(F.lit("accuracy"), ratio, F.lit("loss"), 1 - ratio),
            )
            .when(F.col("o_custkey") % 3 == 1, F.create_map(F.lit("loss"), 1 - ratio))
            .otherwise(F.create_map(F.lit("val_error"), ratio, F.lit("zeta"), ratio * 2))
        )
        params = F.when(
            F.col("o_orderkey") % 2 == 0,
            F.create_map(
                F.lit("learning_rate"), ratio.cast("string"), F.lit("tier"), F.col("o_orderpriority")
            ),
        ).otherwise(
            F.create_map(
                F.lit("lr"), ratio.cast("string"), F.lit("tier"), F.substring("o_orderpriority", 1, 1)
            )
        )
        return self.raw("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_custkey").alias("experiment_id"),
            params.alias("parameters"),
            metrics.alias("metrics"),
            F.col("o_orderdate").alias("created_at"),
        )

    def trials(self) -> DataFrame:
        """Sweep trials: the objective is absent unless the trial's job completed."""
        return self.raw("orders").select(
            F.col("o_custkey").alias("sweep_id"),
            F.col("o_orderkey").alias("job_id"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("objective"),
            status_of(F.col("o_orderstatus")).alias("status"),
        )

    # media -------------------------------------------------------------------------------

    def frames(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("label").alias("source"),
            F.col("vec_id").alias("frame_id"),
            F.col("embedding").cast("array<double>").alias("pixels"),
        )

    def waveforms(self) -> DataFrame:
        scaled = F.transform(
            F.col("embedding").cast("array<double>"), lambda x: x * F.col("label") / 9
        )
        return self.raw("embeddings").select(
            F.col("vec_id").alias("clip_id"),
            F.when(F.col("vec_id") % 2 == 0, F.array_sort(scaled)).otherwise(scaled).alias("samples"),
            "label",
        )


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of part files: a single file is its own only input."""
    files = spark.read.parquet(path).inputFiles()
    return len(files) != 1 or not files[0].endswith(path.rstrip("/").rsplit("/", 1)[-1])


def as_metrics(events: DataFrame) -> DataFrame:
    """Metric points of an event frame (batch or stream)."""
    step = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("metric_name"),
        "value",
        step.alias("step"),
        F.floor(step / 10).cast("int").alias("epoch"),
        F.col("ts").alias("recorded_at"),
    )
