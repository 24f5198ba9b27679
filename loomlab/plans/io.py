"""Dataset, object, sample and shard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.operators.experiments import union_all
from loomlab.plans import media as media_plans
from loomlab.plans.registry import query
from loomlab.session import materialize, scratch
from loomlab.sources import csv_schema, datasets, objects, samples
from loomlab.tables import Lab

FORMATS = datasets.TABULAR


def save_all(lab: Lab):
    """The part table saved in every format, with the catalog entries."""
    parts = lab.raw("part")
    return [datasets.save_dataset(parts, scratch(lab.spark, f"part-{f}"), f"part-{f}", f) for f in FORMATS]


@query(
    "load_dataset",
    "SELECT f AS format, part.* FROM part, (VALUES " + ", ".join(f"('{f}')" for f in FORMATS) + ") t(f)",
)
def load_dataset(lab: Lab):
    """Part written in four formats and loaded back by name or id."""
    entries = [(str(i), e["name"], e["format"], e["path"], i) for i, e in enumerate(save_all(lab))]
    catalog = lab.spark.createDataFrame(entries, "id string, name string, format string, path string, position int")
    schema = lab.raw("part").schema
    loaded = []
    for i, (ident, name, fmt, _, _) in enumerate(entries):
        rows = datasets.load_dataset(lab.spark, catalog, name if i % 2 else ident, schema=schema)
        loaded.append(rows.withColumn("format", F.lit(fmt)))
    return union_all(loaded)


@query(
    "load_dataset_text",
    "SELECT f AS format, doc_id, text, lang, source, n_chars FROM documents, (VALUES ('csv'), ('json'), ('jsonl'), ('parquet')) t(f)",
)
def load_dataset_text(lab: Lab):
    """Documents, whose texts hold line breaks and quotes, written and loaded back without loss."""
    docs, loaded = lab.raw("documents"), []
    for f in FORMATS:
        entry = datasets.save_dataset(docs, scratch(lab.spark, f"documents-{f}"), f"documents-{f}", f)
        loaded.append(datasets.read_dataset(lab.spark, entry["path"], f, docs.schema).withColumn("format", F.lit(f)))
    return union_all(loaded)


@query(
    "infer_csv_schema_text",
    """SELECT * FROM (VALUES (0, 'doc_id', 'int64'), (1, 'text', 'string'), (2, 'lang', 'string'), (3, 'source', 'string'), (4, 'n_chars', 'int64'))
    t(position, name, type), (SELECT true AS nullable, count(*) AS row_count FROM documents)""",
)
def infer_csv_schema_text(lab: Lab):
    """The schema of documents saved as CSV, read from the files."""
    entry = datasets.save_dataset(lab.raw("documents"), scratch(lab.spark, "documents-schema"), "documents", "csv")
    return csv_schema.infer_csv_schema(lab.spark, entry["path"])


@query(
    "save_dataset",
    "SELECT f AS format, 'part-' || f AS name, (SELECT count(*) FROM part) AS row_count FROM (VALUES " + ", ".join(f"('{f}')" for f in FORMATS) + ") t(f)",
)
def save_dataset(lab: Lab):
    rows = [(e["format"], e["name"], e["row_count"]) for e in save_all(lab)]
    return lab.spark.createDataFrame(rows, "format string, name string, row_count bigint")


def cells(lab: Lab):
    """Orders as text cells: whole numbers, decimals, dates, and a column that is empty at times."""
    return lab.raw("orders").select(
        F.col("o_orderkey").alias("_at"),
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_totalprice").cast("string")).alias("mixed"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey").cast("string")).otherwise("").alias("gaps"),
        F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("false").alias("done"),
        F.col("o_orderpriority"),
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
    )


def _schema_sql() -> str:
    columns = {
        "o_orderkey": "CAST(o_orderkey AS VARCHAR)",
        "mixed": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END",
        "o_totalprice": "CAST(o_totalprice AS VARCHAR)",
        "gaps": "CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END",
        "done": "CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'false' END",
        "o_orderpriority": "o_orderpriority",
        "o_orderdate": "CAST(o_orderdate AS VARCHAR)",
    }
    cells = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, {e} AS cell FROM head" for i, (c, e) in enumerate(columns.items()))
    return f"""WITH head AS (SELECT * FROM orders), cells AS ({cells}),
    kinds AS (SELECT position, name, CASE WHEN cell = '' THEN 'string' WHEN regexp_full_match(cell, '[+-]?[0-9]+') THEN 'int64'
      WHEN regexp_full_match(cell, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'float64'
      WHEN lower(cell) IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS kind FROM cells),
    k AS (SELECT position, name, list_sort(list_distinct(list(kind))) AS ks FROM kinds GROUP BY 1, 2)
    SELECT position, name, CASE WHEN len(ks) = 1 THEN ks[1] WHEN ks = ['float64', 'int64'] THEN 'float64' ELSE 'string' END AS type,
      true AS nullable, (SELECT count(*) FROM orders) AS row_count FROM k"""


@query("infer_csv_schema", _schema_sql())
def infer_csv_schema(lab: Lab):
    return csv_schema.infer_schema(cells(lab), ["_at"])


@query(
    "dataset_catalog_backfill",
    """SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_type WHEN n > 0 THEN 'computed' END AS schema,
    CASE WHEN p_size % 3 > 0 THEN nullif(p_size % 5, 0)::BIGINT ELSE coalesce(nullif(p_size % 5, 0), n) END AS row_count
    FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
)
def dataset_catalog_backfill(lab: Lab):
    """Parts as datasets, some without schema or count; both are computed from their lines."""
    catalog = lab.raw("part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("schema"),
        F.nullif(F.col("p_size") % 5, F.lit(0)).cast("long").alias("row_count"),
    )
    computed = lab.artifacts().groupBy(F.col("part_id").alias("id")).agg(F.count(F.lit(1)).alias("row_count"))
    return datasets.backfill_catalog(catalog, computed.withColumn("schema", F.lit("computed")))


PARSED = "doc_id long, text string"


def parsed_objects(objects_):
    """The records inside scanned objects of JSON lines."""
    lines = objects_.select(F.explode(F.split(F.decode("data", "utf-8"), "\n")).alias("line")).where(F.col("line") != "")
    return lines.select(F.from_json("line", PARSED).alias("r")).select("r.doc_id", F.md5("r.text").alias("digest"))


def exported(lab: Lab) -> str:
    """Documents written as objects of JSON lines."""
    prefix = scratch(lab.spark, "objects")
    lab.raw("documents").select("doc_id", "text").write.json(prefix)
    return prefix


@query("object_scan", "SELECT doc_id, md5(text) AS digest FROM documents")
def object_scan(lab: Lab):
    """Documents exported as objects, then listed, and read line by line in ranges."""
    lines = objects.object_lines(lab.spark, exported(lab), "*.json", 1 << 16).where(F.col("error").isNull())
    return lines.select(F.from_json(F.decode("line", "utf-8"), PARSED).alias("r")).select("r.doc_id", F.md5("r.text").alias("digest"))


@query("open_source_objects", "SELECT CAST(sum(strlen(text)) AS BIGINT) AS text_bytes, count(*) AS documents FROM documents")
def open_source_objects(lab: Lab):
    """Documents written as one text object each, opened as an object source in ranges, their bytes counted."""
    prefix = scratch(lab.spark, "objects")
    rows = lab.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    samples.write_sample_files(rows, "doc_id", {".txt": "text"}, prefix)
    found = objects.open_source(lab.spark, "s3", path=prefix, pattern="*.txt", range_bytes=1 << 12)
    return found.agg(F.sum(F.octet_length("data")).alias("text_bytes"), F.countDistinct("key").alias("documents"))


def hub(lab: Lab):
    path = scratch(lab.spark, "hub")
    lab.raw("documents").withColumnRenamed("lang", "split").write.partitionBy("split").parquet(path)
    return path


@query("hub_scan", "SELECT doc_id, upper(source) AS source, n_chars FROM documents WHERE lang = 'en'")
def hub_scan(lab: Lab):
    upper = lambda df: df.withColumn("source", F.upper("source"))
    return objects.hub_scan(lab.spark, hub(lab), "en", upper).select("doc_id", "source", "n_chars")


@query("open_source", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'")
def open_source(lab: Lab):
    rows = objects.open_source(lab.spark, "huggingface", name=hub(lab), split="fr")
    return rows.select("doc_id", "source", "n_chars")


@query(
    "sample_scan",
    "SELECT documents.doc_id, text, quality, toxic FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id ORDER BY 1",
)
def sample_scan(lab: Lab):
    """Samples with their optional sidecar."""
    return samples.with_sidecar(lab.raw("documents").select("doc_id", "text"), lab.raw("labels"), "doc_id")


@query(
    "sample_files",
    """SELECT CAST(d.doc_id AS VARCHAR) AS stem, text AS visual, lang AS audio, CASE WHEN l.doc_id IS NOT NULL THEN 'codec-' || coalesce(quality, -1) END AS codec,
    CASE WHEN l.doc_id IS NOT NULL THEN toxic END AS num_codebooks FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY stem""",
)
def sample_files(lab: Lab):
    """Samples as files: a caption per document, a sidecar beside some, read back and joined by stem."""
    folder = scratch(lab.spark, "sample-files")
    labels = lab.raw("labels").select("doc_id", F.to_json(F.struct(F.concat(F.lit("codec-"), F.coalesce("quality", F.lit(-1))).alias("codec"), F.col("toxic").alias("num_codebooks"))).alias("sidecar"))
    captions = lab.raw("documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("clip_id"), F.col("text").alias("visual"), F.col("lang").alias("audio"))).alias("caption"))
    samples.write_sample_files(captions.join(labels, "doc_id", "left"), "doc_id", {".json": "caption", samples.SIDECAR_SUFFIX: "sidecar"}, folder)
    found = samples.with_sidecar(samples.read_captions(lab.spark, folder), samples.read_sidecars(lab.spark, folder), "stem")
    return found.select("stem", "visual", "audio", "codec", "num_codebooks")


def published(lab: Lab):
    joined = lab.raw("documents").join(lab.raw("labels").withColumn("_has", F.lit(True)), "doc_id", "left")
    captions = joined.select(
        F.col("doc_id").alias("clip_id"),
        F.col("text").alias("visual"),
        F.when(F.col("n_chars") > 500, F.col("lang")).alias("audio"),
        F.lit(None).cast("string").alias("speech"),
        F.when(F.col("n_chars") > 500, F.col("n_chars") / 24).alias("duration_seconds"),
        F.lit(None).cast("int").alias("fps"),
        F.col("quality").alias("codec"),
        F.col("toxic").alias("num_codebooks"),
        "_has",
    )
    return samples.publish_records(captions, ["codec", "num_codebooks"], F.col("_has"))


@query(
    "publish_records",
    """SELECT d.doc_id AS clip_id, text AS visual_caption, CASE WHEN n_chars > 500 THEN lang ELSE '' END AS audio_label, '' AS speech_transcript,
    round(CASE WHEN n_chars > 500 THEN n_chars / 24::DOUBLE ELSE 0 END, 8) AS duration_seconds, 24 AS fps, quality AS codec, toxic AS num_codebooks
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def publish_records(lab: Lab):
    path = scratch(lab.spark, "records")
    samples.write_records(published(lab), path, shard_bytes=1 << 22, order="clip_id")
    return lab.spark.read.parquet(path).drop("shard").withColumn("duration_seconds", F.round("duration_seconds", 8))


@query(
    "tar_shards",
    """WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS shard FROM documents)
    SELECT shard, printf('shard-%06d.tar', shard) AS shard_name, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM r GROUP BY 1""",
)
def tar_shards(lab: Lab):
    placed = samples.assign_shards(lab.raw("documents").select("doc_id"), "doc_id", 100)
    return samples.shard_summary(placed, "doc_id")


@query(
    "tar_shards_written",
    """WITH r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS shard FROM documents)
    SELECT printf('shard-%06d.tar', shard) AS shard_name, doc_id || '.txt' AS member, md5(text) AS digest FROM r WHERE text IS NOT NULL""",
)
def tar_shards_written(lab: Lab):
    """The same shards, written as tar files; the members are read back."""
    folder = scratch(lab.spark, "tars")
    placed = samples.assign_shards(lab.raw("documents").select("doc_id", "text"), "doc_id", 100)
    shards = materialize(lab.spark, samples.write_tar_shards(placed, "doc_id", {".txt": "text"}, folder), "tar-list")
    return samples.read_tar_shards(shards, folder).select("shard_name", "member", F.md5("data").alias("digest"))


@query("tar_shards_of_bytes", "SELECT doc_id || '.txt' AS member, md5(text) AS digest, true AS fits FROM documents WHERE text IS NOT NULL")
def tar_shards_of_bytes(lab: Lab):
    """Shards cut by bytes: every document is in one, and none is above its bytes."""
    folder, most = scratch(lab.spark, "tars"), 1 << 22
    docs = lab.raw("documents").select("doc_id", "text")
    placed = samples.shards_of_bytes(docs, "doc_id", F.octet_length("text"), most)
    shards = materialize(lab.spark, samples.write_tar_shards(placed, "doc_id", {".txt": "text"}, folder), "tar-list")
    members = samples.read_tar_shards(shards, folder, ("bytes",))
    return members.select("member", F.md5("data").alias("digest"), (F.col("bytes") <= most).alias("fits"))


@query("json_dir_stream", "SELECT doc_id, text, lang FROM documents")
def json_dir_stream(lab: Lab):
    """Documents written as JSON files, picked up by a stream and landed as a table."""
    source, landed = scratch(lab.spark, "json-in"), scratch(lab.spark, "json-out")
    rows = lab.raw("documents").select("doc_id", "text", "lang")
    rows.write.json(source)
    stream = samples.json_stream(lab.spark, source, rows.schema, streaming=True)
    flow = (
        stream.writeStream.format("parquet")
        .option("path", landed)
        .option("checkpointLocation", scratch(lab.spark, "json-state"))
        .trigger(availableNow=True)
        .start()
    )
    flow.awaitTermination()
    return lab.spark.read.schema(rows.schema).parquet(landed)


@query(
    "caption_export",
    f"WITH RECURSIVE {media_plans.CAPTIONS} SELECT *, 24 AS fps, '256x256' AS resolution, 16000 AS audio_sample_rate FROM captions",
)
def caption_export(lab: Lab):
    path = scratch(lab.spark, "captions")
    exported = samples.export_captions(media_plans.captions(lab))
    exported.write.json(path)
    stored = lab.spark.read.schema(exported.schema).json(path)
    return stored.withColumn("resolution", F.concat_ws("x", F.col("resolution").cast("array<string>")))
