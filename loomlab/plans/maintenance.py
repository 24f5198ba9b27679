"""Snapshot jobs over the catalog relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.operators import maintenance as mt
from loomlab.operators.grouped import latest
from loomlab.plans.registry import query
from loomlab.session import scratch
from loomlab.tables import Lab

MODELS = """models AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'reg-' || c_custkey END AS registry_name,
  CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS project_id, 1::BIGINT AS version, c_mktsegment AS code, c_mktsegment AS framework,
  CASE WHEN c_custkey % 2 = 0 THEN 'about ' || c_name END AS description FROM customer)"""
CHANGES = """changes AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 0 THEN 'Fresh#' || (o_custkey % 50) ELSE c_name END AS name,
  CASE WHEN o_orderkey % 10 = 1 THEN 'reg-' || o_custkey END AS registry_name, CASE WHEN o_custkey % 5 > 0 THEN c_nationkey END AS project_id,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS code, o_orderstatus AS framework,
  CASE WHEN o_orderkey % 3 = 0 THEN 'change ' || o_orderkey END AS description FROM orders JOIN customer ON o_custkey = c_custkey)"""


def models(lab: Lab):
    key = F.col("c_custkey")
    return lab.raw("customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.when(key % 4 == 0, F.concat(F.lit("reg-"), key)).alias("registry_name"),
        F.when(key % 5 > 0, F.col("c_nationkey")).alias("project_id"),
        F.lit(1).cast("long").alias("version"),
        F.col("c_mktsegment").alias("code"),
        F.col("c_mktsegment").alias("framework"),
        F.when(key % 2 == 0, F.concat(F.lit("about "), "c_name")).alias("description"),
    )


def changes(lab: Lab):
    owners = lab.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    return (
        lab.raw("orders")
        .join(owners, "o_custkey")
        .select(
            key.alias("seq"),
            F.when(key % 10 == 0, F.concat(F.lit("Fresh#"), owner % 50)).otherwise(F.col("c_name")).alias("name"),
            F.when(key % 10 == 1, F.concat(F.lit("reg-"), owner)).alias("registry_name"),
            F.when(owner % 5 > 0, F.col("c_nationkey")).alias("project_id"),
            F.when(key % 7 > 0, F.col("o_orderpriority")).alias("code"),
            F.col("o_orderstatus").alias("framework"),
            F.when(key % 3 == 0, F.concat(F.lit("change "), key)).alias("description"),
        )
    )


@query(
    "upsert_versioned",
    f"""WITH {MODELS}, {CHANGES},
    hit AS (SELECT c.*, m.id AS target FROM changes c LEFT JOIN models m ON m.project_id IS NOT DISTINCT FROM c.project_id
      AND CASE WHEN c.registry_name IS NOT NULL THEN m.registry_name = c.registry_name ELSE m.name = c.name END),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY target, CASE WHEN target IS NULL THEN coalesce('r' || registry_name, 'n' || name) END,
        CASE WHEN target IS NULL THEN project_id END ORDER BY seq DESC) AS k,
      count(*) OVER w AS n, last_value(description IGNORE NULLS) OVER w AS d, last_value(registry_name IGNORE NULLS) OVER w AS r FROM hit
      WINDOW w AS (PARTITION BY target, CASE WHEN target IS NULL THEN coalesce('r' || registry_name, 'n' || name) END,
        CASE WHEN target IS NULL THEN project_id END ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    folded AS (SELECT * FROM ranked WHERE k = 1)
    SELECT m.id, m.name, coalesce(f.r, m.registry_name) AS registry_name, m.project_id, m.version + coalesce(f.n, 0) AS version,
      CASE WHEN f.seq IS NOT NULL THEN f.code ELSE m.code END AS code, CASE WHEN f.seq IS NOT NULL THEN f.framework ELSE m.framework END AS framework,
      coalesce(f.d, m.description) AS description FROM models m LEFT JOIN folded f ON f.target = m.id
    UNION ALL SELECT NULL, name, r, project_id, n, code, framework, d FROM folded WHERE target IS NULL""",
)
def upsert_versioned(lab: Lab):
    return mt.upsert_versioned(models(lab), changes(lab))


@query(
    "publish_version",
    """SELECT o_custkey AS model_id, o_orderkey AS id, row_number() OVER w AS version,
    last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER w AS code
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""",
)
def publish_version(lab: Lab):
    updates = lab.raw("orders").select(
        F.col("o_custkey").alias("model_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("code")
    )
    return mt.publish_version(updates)


@query(
    "patch_coalesce",
    """WITH p AS (SELECT o_custkey AS id, max(o_orderkey) AS last FROM orders GROUP BY 1)
    SELECT c_custkey AS id, c_nationkey AS project_id, CASE WHEN last % 2 = 0 THEN 'renamed ' || last ELSE c_name END AS name,
      CASE WHEN last % 3 = 0 THEN o_orderpriority ELSE c_mktsegment END AS framework, c_acctbal AS score
    FROM customer LEFT JOIN p ON p.id = c_custkey LEFT JOIN orders ON o_orderkey = last""",
)
def patch_coalesce(lab: Lab):
    """Each model patched by its newest order; fields the patch leaves out stay."""
    newest = latest(lab.jobs().select("model_id", "id", "tier"), ["model_id"], ["id"])
    patches = newest.select(
        F.col("model_id").alias("id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("renamed "), "id")).alias("name"),
        F.when(F.col("id") % 3 == 0, F.col("tier")).alias("framework"),
    )
    return mt.patch_coalesce(lab.models(), patches, "id")


@query(
    "mark_read",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 300)
    SELECT event_id AS id, user_id, ts AS created_at, value < 50 OR event_type = 'click' OR user_id IN (SELECT user_id FROM a) AS read,
      NOT value < 50 AND (event_type = 'click' OR user_id IN (SELECT user_id FROM a)) AS changed FROM events""",
)
def mark_read(lab: Lab):
    """Clicks are listed by their own user, views by a stranger; some users mark everything."""
    events = lab.raw("events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")
    own = events.where(F.col("event_type") == "click").select("user_id", "id")
    strange = events.where(F.col("event_type") == "view").select((F.col("user_id") + 1).alias("user_id"), "id")
    everything = events.where((F.col("event_type") == "signup") & (F.col("value") > 300))
    return mt.mark_read(lab.notifications(), own.unionByName(strange), everything)


@query(
    "delete_cascade",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
    lost AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
    SELECT 'models' AS relation, c_custkey AS id, CAST(NULL AS BIGINT) AS parent FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT 'jobs', o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM lost)
    UNION ALL SELECT 'artifacts', l_partkey, CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM lost) THEN l_orderkey END FROM lineitem""",
)
def delete_cascade(lab: Lab):
    """Deleting models takes their jobs along; artifacts stay without their job."""
    models_ = lab.models()
    gone = models_.where(F.col("score") < 0).select("id")
    jobs = lab.jobs().select("id", "model_id")
    kept_models = models_.where(~(F.col("score") < 0) | F.col("score").isNull())
    kept_jobs = mt.delete_cascade(jobs, "model_id", gone, "id")
    lost_jobs = jobs.join(gone.select(F.col("id").alias("model_id")), "model_id", "left_semi")
    artifacts = mt.delete_set_null(lab.artifacts().select("part_id", "job_id"), "job_id", lost_jobs, "id")
    return (
        kept_models.select(F.lit("models").alias("relation"), "id", F.lit(None).cast("long").alias("parent"))
        .unionByName(kept_jobs.select(F.lit("jobs").alias("relation"), "id", F.col("model_id").alias("parent")))
        .unionByName(artifacts.select(F.lit("artifacts").alias("relation"), F.col("part_id").alias("id"), F.col("job_id").alias("parent")))
    )


@query(
    "feature_group_append",
    """WITH old AS (SELECT p_brand AS group_name, nullif(p_size % 3, 0) AS project, p_name AS feature, p_type AS dtype, p_partkey AS seq FROM part),
    new AS (SELECT 'Brand#' || (l_suppkey % 30) AS group_name, nullif(l_linenumber % 3, 0) AS project, 'f' || (l_partkey % 20) AS feature, l_returnflag AS dtype,
      l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
    both_ AS (SELECT *, 0 AS fresh FROM old UNION ALL SELECT *, 1 FROM new),
    r AS (SELECT *, row_number() OVER (PARTITION BY group_name, project, feature ORDER BY fresh DESC, seq DESC, dtype DESC) AS k,
      min(fresh) OVER (PARTITION BY group_name, project) = 1 AS new_group FROM both_)
    SELECT group_name, project, feature, dtype, new_group FROM r WHERE k = 1""",
)
def feature_group_append(lab: Lab):
    existing = lab.raw("part").select(
        F.col("p_brand").alias("group_name"),
        F.nullif(F.col("p_size") % 3, F.lit(0)).alias("project"),
        F.col("p_name").alias("feature"),
        F.col("p_type").alias("dtype"),
        F.col("p_partkey").alias("seq"),
    )
    appended = lab.raw("lineitem").select(
        F.concat(F.lit("Brand#"), F.col("l_suppkey") % 30).alias("group_name"),
        F.nullif(F.col("l_linenumber") % 3, F.lit(0)).alias("project"),
        F.concat(F.lit("f"), F.col("l_partkey") % 20).alias("feature"),
        F.col("l_returnflag").alias("dtype"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return mt.append_features(existing, appended)


@query(
    "run_append",
    """SELECT o_orderkey AS run_id, o_custkey AS experiment_id, 2 AS parameters,
    CASE WHEN o_custkey % 3 = 1 THEN 1 ELSE 2 END AS metrics FROM orders""",
)
def run_append(lab: Lab):
    """Runs with their maps appended to a stored table in two writes."""
    path = scratch(lab.spark, "runs")
    runs = lab.runs()
    early = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    runs.where(early).write.mode("append").parquet(path)
    runs.where(~early).write.mode("append").parquet(path)
    stored = lab.spark.read.schema(runs.schema).parquet(path)
    return stored.select("run_id", "experiment_id", F.size("parameters").alias("parameters"), F.size("metrics").alias("metrics"))


STATUS = {"signup": "running", "purchase": "completed", "error": "failed", "view": "queued", "click": "queued"}


@query(
    "status_transition",
    """WITH e AS (SELECT user_id AS job_id, event_id AS seq, ts AS moment, CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
      props AS message FROM events)
    SELECT job_id, arg_max(status, seq) AS status, arg_min(moment, seq) FILTER (status = 'running') AS started_at,
      arg_max(moment, seq) FILTER (status IN ('completed', 'failed')) AS completed_at, max(CASE WHEN status = 'completed' THEN 100 END) AS progress,
      arg_max(message, seq) FILTER (status = 'failed') AS error_message FROM e WHERE status IS NOT NULL GROUP BY 1""",
)
def status_transition(lab: Lab):
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    events = lab.raw("events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("at"),
        names[F.col("event_type")].alias("status"),
        F.col("props").alias("message"),
    )
    return mt.status_transitions(events)


AUDIT_KEYS = (
    ("customer", ["c_custkey"]),
    ("orders", ["o_orderkey"]),
    ("part", ["p_partkey"]),
    ("supplier", ["s_suppkey"]),
    ("lineitem", ["l_orderkey", "l_linenumber"]),
    ("events", ["event_id"]),
    ("documents", ["doc_id"]),
    ("conversations", ["conv_id", "turn"]),
)
AUDIT_REFERENCES = (
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "supplier", "s_suppkey"),
)
AUDIT_DOMAINS = (("orders", "o_orderstatus", ["F", "O"]), ("conversations", "role", ["user", "assistant", "system"]))


def _audit_sql() -> str:
    parts = [f"SELECT 'unique {t}' AS violation, count(*) AS n FROM (SELECT 1 FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for t, k in AUDIT_KEYS]
    parts += [f"SELECT 'reference {t}.{k}', count(*) FROM {t} WHERE NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.{pk} = {t}.{k})" for t, k, p, pk in AUDIT_REFERENCES]
    parts += [f"SELECT 'domain {t}.{c}', count(*) FROM {t} WHERE {c} NOT IN (" + ", ".join(f"'{a}'" for a in allowed) + ")" for t, c, allowed in AUDIT_DOMAINS]
    return " UNION ALL ".join(parts)


@query("integrity_audit", _audit_sql())
def integrity_audit(lab: Lab):
    tables = {t for t, _ in AUDIT_KEYS} | {x for t, _, p, _ in AUDIT_REFERENCES for x in (t, p)} | {t for t, _, _ in AUDIT_DOMAINS}
    return mt.integrity_audit({t: lab.raw(t) for t in sorted(tables)}, AUDIT_KEYS, AUDIT_REFERENCES, AUDIT_DOMAINS)


@query(
    "visualization_listing",
    "SELECT doc_id AS id, lang AS backend, source AS name, CASE WHEN n_chars > 1000 THEN 'published' ELSE 'draft' END AS state FROM documents ORDER BY id DESC",
)
def visualization_listing(lab: Lab):
    """Visualizations without their heavy data column, which the scan does not read."""
    state = F.when(F.col("n_chars") > 1000, "published").otherwise("draft")
    rows = lab.raw("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("backend"), F.col("source").alias("name"), state.alias("state"))
    return rows.orderBy(F.col("id").desc())
