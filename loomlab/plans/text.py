"""Queries over texts, markup and encoded payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.functions import text as tx
from loomlab.plans.registry import query
from loomlab.session import scratch
from loomlab.tables import Lab

# Lines that sources begin with, dealt to the documents by id; two name several frameworks.
IMPORTS = ("import torch", "from sklearn.svm import SVC", "import scikit_posthocs", "import tensorflow as tf", "import keras", "import numpy", "import keras, torch", "import tensorflow, sklearn")


@query(
    "framework_detect",
    f"""WITH code AS (SELECT doc_id, ([{', '.join(map(repr, IMPORTS))}])[doc_id % {len(IMPORTS)} + 1] || chr(10) || text AS code FROM documents)
    SELECT doc_id, CASE WHEN contains(code, 'torch') THEN 'pytorch' WHEN contains(code, 'sklearn') OR contains(code, 'scikit') THEN 'sklearn'
    WHEN contains(code, 'tensorflow') OR contains(code, 'keras') THEN 'tensorflow' ELSE 'python' END AS framework FROM code""",
)
def framework_detect(lab: Lab):
    """The framework of every document, read as a source file that begins with an import line."""
    first = F.get(F.array(*[F.lit(i) for i in IMPORTS]), (F.col("doc_id") % len(IMPORTS)).cast("int"))
    code = F.concat(first, F.lit("\n"), F.col("text"))
    return lab.raw("documents").select("doc_id", tx.framework_of(code).alias("framework"))


def sources(lab: Lab):
    """Documents wrapped as source files with an embedded payload; English ones have none."""
    blob = F.concat(F.lit("x = 1\n" + tx.BLOB_START), tx.base64_text(F.encode("text", "utf-8")), F.lit(tx.BLOB_END + "\ny = 2\n"))
    return lab.raw("documents").select("doc_id", "n_chars", "text", F.when(F.col("lang") != "en", blob).otherwise("x = 1\n").alias("source"))


@query(
    "embedded_blob",
    """SELECT doc_id, CASE WHEN lang <> 'en' THEN md5(text) END AS payload,
    CASE WHEN lang <> 'en' THEN 'x = 1' || chr(10) || '_MODEL_B64 = \"\"\"' || to_base64(encode('new ' || doc_id)) || '\"\"\"' || chr(10) || 'y = 2' || chr(10)
         ELSE 'x = 1' || chr(10) END AS replaced FROM documents""",
)
def embedded_blob(lab: Lab):
    fresh = F.encode(F.concat(F.lit("new "), "doc_id"), "utf-8")
    return sources(lab).select(
        "doc_id",
        F.md5(tx.embedded_blob(F.col("source"))).alias("payload"),
        tx.replace_blob(F.col("source"), fresh).alias("replaced"),
    )


@query(
    "base64_codec",
    "SELECT doc_id, to_base64(encode(text)) AS encoded, md5(text) AS decoded_md5 FROM documents",
)
def base64_codec(lab: Lab):
    coded = lab.raw("documents").select("doc_id", tx.base64_text(F.encode("text", "utf-8")).alias("encoded"))
    return coded.withColumn("decoded_md5", F.md5(F.unbase64("encoded")))


@query("strip_script", "SELECT page_id, regexp_replace(html, '<script.*?</script>', '', 'gis') AS html FROM pages")
def strip_script(lab: Lab):
    return lab.raw("pages").select("page_id", tx.strip_script(F.col("html")).alias("html"))


@query(
    "clip_text",
    "SELECT doc_id, left(text, 4096) AS message, left(CAST(doc_id + 100000000 AS VARCHAR), 8) AS label, left(text, 60) AS summary FROM documents",
)
def clip_text(lab: Lab):
    """Truncated error text, id prefix and summary, as stored with jobs and listings."""
    return lab.raw("documents").select(
        "doc_id",
        F.left("text", F.lit(tx.ERROR_LENGTH)).alias("message"),
        F.substring((F.col("doc_id") + 100000000).cast("string"), 1, 8).alias("label"),
        F.left("text", F.lit(60)).alias("summary"),
    )


@query(
    "checkpoint_key",
    """SELECT event_id AS id, 'models/' || user_id || '/checkpoints/' || CASE WHEN event_type = 'signup' THEN 'latest.pt'
      ELSE printf('epoch_%04d.pt', CAST(json_extract_string(props, '$.k') AS INTEGER)) END AS key,
      CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS epoch FROM events""",
)
def checkpoint_key(lab: Lab):
    epoch = F.when(F.col("metric_name") != "signup", F.col("step"))
    keys = lab.metrics().select("id", tx.checkpoint_key(F.col("job_id"), epoch).alias("key"))
    return keys.withColumn("epoch", tx.checkpoint_epoch(F.col("key")))


@query(
    "event_stream_parse",
    """SELECT CASE WHEN event_type = 'error' THEN '{"raw":"no json ' || event_id || '"}' ELSE '{"id":' || event_id || ',"kind":"' || event_type || '"}' END AS payload
    FROM events""",
)
def event_stream_parse(lab: Lab):
    """Events written as a text event stream, read back block by block and parsed."""
    body = F.when(F.col("event_type") == "error", F.concat(F.lit("no json "), "event_id")).otherwise(
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    )
    block = F.concat(F.lit("event: metric\ndata: superseded\ndata: "), body)
    path = scratch(lab.spark, "event-stream")
    lab.raw("events").select(block.alias("value")).write.option("lineSep", "\n\n").text(path)
    return read_event_stream(lab.spark, path).select("payload")


def read_event_stream(spark, path: str):
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    return blocks.withColumn("payload", tx.event_payload(F.col("value"))).where(F.col("payload").isNotNull())
