"""Metric, log and media streams.

The lab applies events in arrival order; here the event time with the event id as tie-break
decides, so a replayed or reordered stream ends in the same state as the batch query. Each
stream keeps its state in its checkpoint and its results in tables of the shared folder.
Folds run as aggregates with a partial step before the shuffle, so one busy job is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from loomlab.operators.grouped import moment
from loomlab.session import scratch

# Fixed values of the stream protocol.
RATE_NAMES = ("learning_rate", "lr")
FINISHED_AT = 100.0
FLUSH_INTERVAL = "2 seconds"
#: Batches whose folders stand side by side before they are folded into one.
GENERATION = 32


def drain(spark: SparkSession, writer: DataStreamWriter, state: str | None = None, interval: str | None = None) -> None:
    """Run a stream over all that has arrived and stop; with ``interval`` it flushes on that beat."""
    state = state or scratch(spark, "stream-state")
    writer = writer.option("checkpointLocation", state)
    if interval is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    flow = writer.trigger(processingTime=interval).start()
    try:
        flow.processAllAvailable()
    finally:
        flow.stop()


def append_to(spark: SparkSession, stream: DataFrame, path: str, **drain_options) -> DataFrame:
    """Land a stream in a Parquet table; the file sink records each batch once."""
    drain(spark, stream.writeStream.format("parquet").option("path", path).outputMode("append"), **drain_options)
    return spark.read.schema(stream.schema).parquet(path)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


class Folded:
    """A table that a stream adds to, batch by batch, and that keeps few folders however long the stream runs.

    Batches stand in generations of ``length``. The first batch of a generation carries over what ``fold`` makes of the
    generation before, so a look at all earlier rows reads at most ``length`` batches and one carried table. A batch
    that runs again writes the same folders again. Folders of past generations may be deleted at any time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fold, length: int = GENERATION):
        self.spark, self.path, self.schema, self.fold, self.length = spark, path, schema, fold, length
        spark.createDataFrame([], schema).write.mode("ignore").parquet(self._folder(0, -1))

    def _folder(self, generation: int, batch: int) -> str:
        return f"{self.path}/generation={generation}/batch={batch}"

    def _rows(self, generation: int) -> DataFrame:
        return self.spark.read.schema(_with_batch(self.schema)).parquet(f"{self.path}/generation={generation}")

    def before(self, batch_id: int) -> DataFrame:
        """The rows of earlier batches, folded up to the batch's generation; writes the carried table if it is due."""
        generation, first = divmod(batch_id, self.length)
        if generation and not first:
            self.fold(self._rows(generation - 1)).select(*self.schema.names).write.mode("overwrite").parquet(self._folder(generation, -1))
        return self._rows(generation).where(F.col("batch") < batch_id)

    def add(self, batch_id: int, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._folder(batch_id // self.length, batch_id))

    def rows(self) -> DataFrame:
        """All rows, folded up to the newest generation, with the batch that wrote them."""
        numbers = self.spark.read.schema(T.StructType([T.StructField("generation", T.LongType())])).parquet(self.path)
        newest = max(int(f.rsplit("generation=", 1)[1].split("/")[0]) for f in numbers.inputFiles())
        return self._rows(newest)


class Segments:
    """A table that a stream only adds to, batch by batch, read in few folders however long the stream runs.

    Whenever ``length`` folders of one level are full they are rewritten as one folder of the next level, so ``n``
    batches stand in fewer than ``length`` folders per level, and a row is rewritten once per level. Which folders
    are in use follows from the number of batches alone: a batch that runs again finds, and writes, the same ones.
    Folders that were rewritten may be deleted. Rows are kept by ``day``, a column of text.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, day: str = "_day", length: int = GENERATION):
        self.spark, self.path, self.day, self.length = spark, path, day, length
        self.schema = T.StructType([f for f in schema.fields if f.name != day])
        self._write(spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(day, T.StringType())])), self._folder(0, -1), "ignore")

    def _folder(self, level: int, first: int) -> str:
        return f"{self.path}/level={level}/first={first}"

    def _write(self, rows: DataFrame, folder: str, mode: str = "overwrite") -> None:
        rows.select(*self.schema.names, self.day).write.partitionBy(self.day).mode(mode).parquet(folder)

    def _read(self, folders: list[str]) -> DataFrame:
        kinds = T.StructType([*self.schema.fields, T.StructField(self.day, T.StringType())])
        return self.spark.read.schema(kinds).option("basePath", self.path).parquet(*folders).select(*self.schema.names, self.day)

    def folders(self, batches: int) -> list[str]:
        """The folders that hold the first ``batches`` batches."""
        out, first, level = [self._folder(0, -1)], 0, 0
        while self.length ** (level + 1) <= batches:
            level += 1
        while level >= 0:
            size = self.length**level
            while first + size <= batches:
                out.append(self._folder(level, first))
                first += size
            level -= 1
        return out

    def before(self, batch_id: int) -> DataFrame:
        """The rows of earlier batches; rewrites the folders that have become full."""
        level, size = 1, self.length
        while batch_id and batch_id % size == 0:
            parts = [self._folder(level - 1, i) for i in range(batch_id - size, batch_id, size // self.length)]
            self._write(self._read(parts).hint("rebalance", self.day), self._folder(level, batch_id - size))
            level, size = level + 1, size * self.length
        return self._read(self.folders(batch_id))

    def add(self, batch_id: int, rows: DataFrame) -> None:
        self._write(rows, self._folder(0, batch_id))

    def rows(self) -> DataFrame:
        """The rows of all batches."""
        names = self.spark.read.schema(self.schema).parquet(f"{self.path}/level=0").inputFiles()
        last = max((int(f.rsplit("first=", 1)[1].split("/")[0]) for f in names), default=-1)
        return self._read([*self.folders(max(last, 0)), *([self._folder(0, last)] if last >= 0 else [])])


def upsert_snapshots(spark: SparkSession, stream: DataFrame, keys: list[str], path: str, length: int = GENERATION) -> DataFrame:
    """Land an update-mode aggregate: a folder per batch, the newest row per key on reading; old batches are folded."""
    payload = [c for c in stream.columns if c not in keys]

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col("batch")).alias("_r")).select(*keys, "_r.*")

    landed = Folded(spark, path, stream.schema, newest, length)

    def write(batch: DataFrame, batch_id: int) -> None:
        landed.before(batch_id)
        landed.add(batch_id, batch)

    drain(spark, stream.writeStream.outputMode("update").foreachBatch(write))
    return newest(landed.rows()).select(*stream.columns)


def whole_number(value: Column) -> Column:
    """Truncated to an integer; values out of range stop at its ends, so none can fail a stream."""
    bounded = F.least(F.greatest(F.nanvl(value, F.lit(0.0)), F.lit(-2147483648.0)), F.lit(2147483647.0))
    return F.when(value.isNotNull(), bounded.cast("int"))


# job state -----------------------------------------------------------------------------------


def job_state(metrics: DataFrame) -> DataFrame:
    """Newest loss, learning rate, progress (truncated) and epoch per job; batch or stream."""
    name = F.col("metric_name")
    order = moment("recorded_at", "id")

    def newest(value: Column, chosen: Column) -> Column:
        return F.max_by(value, F.when(chosen, order))

    return metrics.groupBy("job_id").agg(
        newest(F.col("value"), name == "loss").alias("loss"),
        newest(F.col("value"), name.isin(*RATE_NAMES)).alias("learning_rate"),
        whole_number(newest(F.col("value"), name == "progress")).alias("progress"),
        newest(F.col("epoch"), F.col("epoch").isNotNull()).alias("epoch_current"),
    )


def completions(metrics: DataFrame, threshold: float = FINISHED_AT) -> DataFrame:
    """First moment each job's progress reaches the threshold."""
    done = metrics.where((F.col("metric_name") == "progress") & (F.col("value") >= threshold))
    return done.groupBy("job_id").agg(F.min("recorded_at").alias("completed_at"))


def completion_stream(spark: SparkSession, metrics: DataFrame, path: str, threshold: float = FINISHED_AT, length: int = GENERATION) -> DataFrame:
    """One completion event per job, emitted by the first batch that shows it: (job_id, completed_at, status).

    Each batch is reduced to one row per job and then loses the jobs of earlier batches in an
    anti join with the events already written. The batch's own folder is left out of that
    lookup, so a retried batch emits the same events again into the same place.
    """
    done = metrics.where((F.col("metric_name") == "progress") & (F.col("value") >= threshold))
    columns = T.StructType([metrics.schema["job_id"], T.StructField("completed_at", metrics.schema["recorded_at"].dataType)])
    events = Folded(spark, path, columns, lambda rows: rows, length)

    def emit(batch: DataFrame, batch_id: int) -> None:
        found = batch.groupBy("job_id").agg(F.min("recorded_at").alias("completed_at"))
        events.add(batch_id, found.join(events.before(batch_id).select("job_id"), "job_id", "left_anti"))

    drain(spark, done.select("job_id", "recorded_at").writeStream.foreachBatch(emit))
    return events.rows().select("job_id", "completed_at", F.lit("completed").alias("status"))


def completion_notices(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """One notice per completion event to the owner of its job: (user_id, job_id, title, created_at)."""
    owners = jobs.select(F.col("id").alias("job_id"), F.col("owner_id").alias("user_id"))
    title = F.concat(F.lit("Job "), F.col("job_id").cast("string"), F.lit(" completed"))
    return events.join(owners, "job_id").select("user_id", "job_id", title.alias("title"), F.col("completed_at").alias("created_at"))


# fan-out, buffering, logs ----------------------------------------------------------------------


def subscribe(metrics: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Points of the subscribed jobs as they arrive (stream joined with a table)."""
    return metrics.join(subscriptions.select("job_id"), "job_id", "left_semi")


def day_of(at: str) -> Column:
    return F.coalesce(F.to_date(F.col(at)).cast("string"), F.lit("none"))


def land_once(spark: SparkSession, stream: DataFrame, path: str, key: str, at: str, length: int = GENERATION, **drain_options) -> DataFrame:
    """Land a stream without the repeats that a sender's retries cause; rows may come in any order and however late.

    A batch loses its own repeats and then, in an anti join, the keys that earlier batches landed on the same days. A
    retry sends the same row, so its day is the same; the landed table has a folder per day, and only the very days that
    the batch has are read: one late row costs one day. Batches are kept in :class:`Segments`.
    """
    kinds = T.StructType([*stream.schema.fields, T.StructField("_day", T.StringType())])
    landed = Segments(spark, path, kinds, length=length)

    def land(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key]).withColumn("_day", day_of(at))
        days = [r["_day"] for r in fresh.select("_day").distinct().collect()]  # as many as the calendar has
        earlier = landed.before(batch_id).where(F.col("_day").isin(days))
        landed.add(batch_id, fresh.join(earlier.select(key, "_day"), [key, "_day"], "left_anti"))

    drain(spark, stream.writeStream.foreachBatch(land), **drain_options)
    return landed.rows().drop("_day")


def windowed_means(
    spark: SparkSession, stream: DataFrame, path: str, keys: list[str], at: str, value: str, window: str, delay: str,
    length: int = GENERATION, **drain_options,
) -> tuple[DataFrame, DataFrame]:
    """(means per key and tumbling window, late rows) of a stream.

    A row is late if it is more than ``delay`` older than the newest row of the earlier batches; late rows are kept in a
    table of their own instead of being dropped. A batch adds one row of sums per key and window, so means are merged
    from sums and no earlier row is read again. Sums and the newest time are folded, late rows kept in segments.
    """
    none = spark.createDataFrame([], stream.schema)
    summed = lambda rows: rows.groupBy(*keys, F.window(at, window)["start"].alias("window_start")).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    merged = lambda rows: rows.groupBy(*keys, "window_start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    newest = lambda rows: rows.agg(F.max("newest").alias("newest"))
    sums = Folded(spark, f"{path}/sums", summed(none).schema, merged, length)
    marks = Folded(spark, f"{path}/marks", T.StructType([T.StructField("newest", stream.schema[at].dataType)]), newest, length)
    late = Segments(spark, f"{path}/late", T.StructType([*stream.schema.fields, T.StructField("_day", T.StringType())]), length=length)

    def fold(batch: DataFrame, batch_id: int) -> None:
        known = newest(marks.before(batch_id)).first()["newest"]
        is_late = F.lit(False) if known is None else F.coalesce(F.col(at) < F.lit(known) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        sums.before(batch_id)
        sums.add(batch_id, summed(batch.where(~is_late)))
        late.before(batch_id)
        late.add(batch_id, batch.where(is_late).withColumn("_day", day_of(at)))
        marks.add(batch_id, newest(batch.select(F.col(at).alias("newest"))))

    drain(spark, stream.writeStream.foreachBatch(fold), **drain_options)
    means = merged(sums.rows()).select(*keys, "window_start", "n", (F.col("total") / F.col("n")).alias("mean"))
    return means, late.rows().drop("_day")


def log_lines(stream: DataFrame, level: str | None = None, default_at: Column | None = None) -> DataFrame:
    """Log lines, those without a time stamped on arrival, optionally of one level."""
    at = F.col("logged_at") if default_at is None else F.coalesce("logged_at", default_at)
    lines = stream.withColumn("logged_at", at)
    return lines if level is None else lines.where(F.col("level") == level)


def refresh(spark: SparkSession, stream: DataFrame, path: str, partial, merge, finish, length: int = GENERATION) -> DataFrame:
    """Keep a small summary of a growing table fresh: every beat adds the partial summary of the rows that came.

    ``partial`` makes mergeable rows of a batch, ``merge`` folds such rows, ``finish`` makes the summary. No beat reads
    earlier rows of the stream again, and old partial summaries are folded.
    """
    parts = Folded(spark, path, partial(spark.createDataFrame([], stream.schema)).schema, lambda rows: merge(rows.drop("batch")), length)

    def beat(batch: DataFrame, batch_id: int) -> None:
        parts.before(batch_id)
        parts.add(batch_id, partial(batch))

    drain(spark, stream.writeStream.foreachBatch(beat))
    return finish(merge(parts.rows().drop("batch")))


def media_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 100) -> DataFrame:
    """New files below a folder as (key, bytes, data) rows."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", str(files_per_batch))
    )
    return reader.load(folder).select(F.col("path").alias("key"), F.col("length").alias("bytes"), F.col("content").alias("data"))
