"""Listing, search, lookup and join queries over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.operators import catalog as cat
from loomlab.operators.grouped import top_per_group
from loomlab.plans.registry import ENDPOINTS, JOBS, query
from loomlab.tables import Lab

LOGS = "logs AS (SELECT conv_id AS job_id, turn AS logged_at, role AS level, text AS message FROM conversations)"
ARTIFACTS = """artifacts AS (SELECT l_orderkey AS job_id, l_returnflag AS kind, l_linenumber AS line, l_partkey AS part_id,
  l_suppkey AS supplier_id, l_extendedprice AS size, l_shipdate AS created_at FROM lineitem)"""


@query("scoped_list", f"WITH {JOBS} SELECT * FROM jobs ORDER BY created_at DESC, id DESC")
def scoped_list(lab: Lab):
    return cat.scoped_list(lab.jobs(), [F.col("created_at").desc(), F.col("id").desc()])


@query("job_filter", f"WITH {JOBS} SELECT * FROM jobs WHERE status = 'completed' AND tier = '1-URGENT' ORDER BY created_at DESC, id DESC")
def job_filter(lab: Lab):
    jobs = cat.filter_equal(lab.jobs(), model_id=None, tier="1-URGENT", status="completed")
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").desc())


@query(
    "dataset_manifest",
    """SELECT p_partkey AS id, p_name AS name, p_type AS format, p_size AS size, p_retailprice AS rows, p_brand AS version
    FROM part ORDER BY id DESC""",
)
def dataset_manifest(lab: Lab):
    fields = {"id": "p_partkey", "name": "p_name", "format": "p_type", "size": "p_size", "rows": "p_retailprice", "version": "p_brand"}
    return lab.raw("part").select(*[F.col(c).alias(n) for n, c in fields.items()]).orderBy(F.col("id").desc())


def search(lab: Lab, q: str, limit: int, category: str | None = None):
    """Hits in all nine categories, or in one."""

    def link(place: str):
        return F.concat(F.lit(f"/{place}/"), F.col("id"))

    name, description, status = F.col("name"), F.col("description"), F.col("status")
    urgent = F.when(F.col("tier") == "1-URGENT", link("inference")).otherwise(link("training"))
    created = F.unix_seconds(F.col("created_at").cast("timestamp"))

    def table(source: str, **columns: str):
        return lab.raw(source).select(*[F.expr(e).alias(c) for c, e in columns.items()])

    makers = {
        "projects": lambda c: cat.search_items(lab.projects(), c, ["name"], q, limit, name, link(c)),
        "models": lambda c: cat.search_items(
            lab.models(), c, ["name", "framework"], q, limit, name, link(c), icon_hint=F.col("framework")
        ),
        "datasets": lambda c: cat.search_items(
            table("part", id="p_partkey", name="p_name", description="p_brand", format="p_type"),
            c, ["name", "description", "format"], q, limit, name, link(c), description=description, icon_hint=F.col("format"),
        ),
        "experiments": lambda c: cat.search_items(
            table("benchmark", id="item_id", name="text", description="text"),
            c, ["name", "description"], q, limit, name, link(c), description=description,
        ),
        "training": lambda c: cat.search_items(
            lab.jobs(), c, ["tier", "status"], q, limit, F.concat(F.col("tier"), F.lit(" — "), status), urgent, created,
            F.concat(F.lit("Status: "), status), F.col("tier"), status,
        ),
        "workspaces": lambda c: cat.search_items(
            lab.endpoints(), c, ["name", "status"], q, limit, name, F.lit("/workspaces"),
            description=F.concat(F.col("replicas").cast("string"), F.lit(" — "), status), status=status,
        ),
        "features": lambda c: cat.search_items(
            table("documents", id="doc_id", name="source", description="text", kind="lang"),
            c, ["name", "description", "kind"], q, limit, name, F.lit("/features"), description=description, icon_hint=F.col("kind"),
        ),
        "visualizations": lambda c: cat.search_items(
            table("pages", id="page_id", name="url", description="html"),
            c, ["name", "description"], q, limit, name, link(c),
        ),
        "data_sources": lambda c: cat.search_items(
            table("region", id="r_regionkey", name="r_name"), c, ["name"], q, limit, name, F.lit("/data-sources"),
            description=F.concat(F.lit("Type: "), name), icon_hint=name,
        ),
    }
    wanted = [category] if category else list(makers)
    return cat.rank_hits([makers[c](c) for c in wanted])


def _hits_sql(q: str, limit: int) -> str:
    absent = "CAST(NULL AS VARCHAR)"

    def one(category, fields, table, key, name, href, recency=None, description=absent, icon=absent, status=absent):
        where = " OR ".join(f"{f} ILIKE '%{q}%'" for f in fields)
        return f"""(SELECT '{category}' AS category, CAST({key} AS BIGINT) AS id, {name} AS name, {description} AS description, {href} AS href,
          {icon} AS icon_hint, {status} AS status, CAST({recency or key} AS BIGINT) AS recency FROM {table} WHERE {where} ORDER BY recency DESC, id DESC LIMIT {limit})"""

    selects = [
        one("projects", ["n_name"], "nation", "n_nationkey", "n_name", "'/projects/' || n_nationkey"),
        one("models", ["c_name", "c_mktsegment"], "customer", "c_custkey", "c_name", "'/models/' || c_custkey", icon="c_mktsegment"),
        one("datasets", ["p_name", "p_type", "p_brand"], "part", "p_partkey", "p_name", "'/datasets/' || p_partkey", description="p_brand", icon="p_type"),
        one("experiments", ["text"], "benchmark", "item_id", "text", "'/experiments/' || item_id", description="text"),
        one("training", ["tier", "status"], "jobs", "id", "tier || ' — ' || status", "CASE tier WHEN '1-URGENT' THEN '/inference/' ELSE '/training/' END || id",
            "epoch(created_at)", "'Status: ' || status", "tier", "status"),
        one("workspaces", ["name", "status"], "endpoints", "id", "name", "'/workspaces'", description="replicas || ' — ' || status", status="status"),
        one("features", ["source", "text", "lang"], "documents", "doc_id", "source", "'/features'", description="text", icon="lang"),
        one("visualizations", ["url", "html"], "pages", "page_id", "url", "'/visualizations/' || page_id"),
        one("data_sources", ["r_name"], "region", "r_regionkey", "r_name", "'/data-sources'", description="'Type: ' || r_name", icon="r_name"),
    ]
    return f"WITH {JOBS}, {ENDPOINTS}, hits AS (" + " UNION ALL ".join(selects) + ")"


@query(
    "catalog_search",
    _hits_sql("1%5", 10)
    + " SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY recency DESC, id DESC) AS INTEGER) AS rank FROM hits",
)
def catalog_search(lab: Lab):
    return search(lab, "1%5", 10)


@query("category_totals", _hits_sql("r", 25) + " SELECT category, count(*) AS hits FROM hits GROUP BY ROLLUP (category)")
def category_totals(lab: Lab):
    return cat.category_totals(search(lab, "r", 25))


@query(
    "two_table_search",
    """(SELECT 'project' AS kind, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_name ILIKE '%n_1%' ORDER BY name, id LIMIT 10)
    UNION ALL (SELECT 'model', c_custkey, c_name FROM customer WHERE c_name ILIKE '%n_1%' OR c_mktsegment ILIKE '%n_1%' ORDER BY c_name, c_custkey LIMIT 10)""",
)
def two_table_search(lab: Lab):
    return cat.search_tables({"project": (lab.projects(), ["name"]), "model": (lab.models(), ["name", "framework"])}, "n_1")


def registry(lab: Lab):
    return lab.raw("part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.col("p_type"), F.lit(" part of size "), F.col("p_size")).alias("description"),
        F.split("p_name", " ").alias("tags"),
        F.col("p_brand").alias("author"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("framework"),
    )


@query(
    "registry_search",
    """SELECT p_partkey AS id, p_name AS name, p_brand AS author, p_type AS category FROM part
    WHERE lower(p_type) = 'economy' AND contains(lower(concat_ws(' ', p_name, p_type || ' part of size ' || p_size, p_name, p_brand)), 'size 1')""",
)
def registry_search(lab: Lab):
    return cat.registry_search(registry(lab), "SIZE 1", category="economy").select("id", "name", "author", "category")


@query("facet_filter", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS framework FROM customer WHERE contains(lower(c_name), '7') AND c_mktsegment = 'BUILDING'")
def facet_filter(lab: Lab):
    rows = lab.models().withColumn("stage", F.lit("any"))
    return cat.facet_filter(rows, "7", ["name", "framework"], framework="BUILDING", stage="All").select("id", "name", "framework")


@query(
    "log_query",
    f"""WITH {LOGS}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY logged_at, level, message) AS k FROM logs WHERE level = 'user')
    SELECT job_id, logged_at, level, message FROM r WHERE k > 1 AND k <= 1001""",
)
def log_query(lab: Lab):
    """The page of every job that skips its first user line."""
    return cat.log_query(lab.logs(), level="user", limit=1000, offset=1)


@query(
    "tail_n",
    f"""WITH {LOGS}, r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY job_id * 1000 + logged_at DESC) AS k FROM logs)
    SELECT level, job_id * 1000 + logged_at AS seq, message FROM r WHERE k <= 10 ORDER BY level, seq""",
)
def tail_n(lab: Lab):
    lines = lab.logs().select("level", (F.col("job_id") * 1000 + F.col("logged_at")).alias("seq"), "message")
    return cat.tail_n(lines, ["level"], "seq", 10)


@query(
    "page_slice",
    f"WITH {LOGS} SELECT * FROM logs ORDER BY job_id, logged_at LIMIT 100 OFFSET 20",
)
def page_slice(lab: Lab):
    return cat.page_slice(lab.logs(), [F.col("job_id"), F.col("logged_at")], limit=100, offset=20)


@query(
    "page_after",
    f"WITH {LOGS} SELECT * FROM logs WHERE (job_id, logged_at) > (4, 2) ORDER BY job_id, logged_at LIMIT 100",
)
def page_after(lab: Lab):
    return cat.page_after(lab.logs(), ["job_id", "logged_at"], (4, 2), limit=100)


@query("topk_recent", f"WITH {JOBS} SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 50")
def topk_recent(lab: Lab):
    return lab.jobs().orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(50)


@query("multi_key_sort", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_name, p_partkey")
def multi_key_sort(lab: Lab):
    return lab.raw("part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_name", "p_partkey")


@query(
    "recent_distinct",
    """WITH q AS (SELECT user_id, event_type || ' ' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) AS query, max(ts) AS last_used FROM events GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, query) AS INTEGER) AS rank FROM q)
    SELECT * FROM r WHERE rank <= 8""",
)
def recent_distinct(lab: Lab):
    points = lab.metrics()
    searches = points.select(
        F.col("job_id").alias("user_id"),
        F.concat("metric_name", F.lit(" "), F.col("step") % 4).alias("query"),
        F.col("recorded_at").alias("at"),
    )
    return cat.recent_distinct(searches, 8)


@query(
    "sample_cap",
    """WITH r AS (SELECT label AS source, vec_id AS clip_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS rank FROM embeddings)
    SELECT * FROM r WHERE rank <= 20""",
)
def sample_cap(lab: Lab):
    clips = lab.raw("embeddings").select(F.col("label").alias("source"), F.col("vec_id").alias("clip_id"))
    return top_per_group(clips, ["source"], [F.col("clip_id")], 20)


@query(
    "activity_feed",
    """WITH r AS (SELECT user_id, event_id AS id, ts AS created_at, value < 50 AS read,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events)
    SELECT * FROM r WHERE rank <= 50""",
)
def activity_feed(lab: Lab):
    """Newest fifty notifications of every user."""
    return top_per_group(lab.notifications(), ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], 50)


@query("artifact_scope", f"WITH {ARTIFACTS} SELECT job_id, kind, line, size, created_at FROM artifacts ORDER BY job_id, created_at DESC")
def artifact_scope(lab: Lab):
    """Artifacts of each job, newest first."""
    rows = lab.artifacts().select("job_id", "kind", "line", "size", "created_at")
    return cat.scoped_list(rows, [F.col("job_id"), F.col("created_at").desc()])


@query(
    "job_outputs",
    """SELECT event_id AS id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS output,
    CASE WHEN value < 50 THEN 'pending' ELSE 'completed' END AS status FROM events WHERE event_type = 'purchase'""",
)
def job_outputs(lab: Lab):
    """Output field and status of the inference jobs."""
    status = F.when(F.col("value") < 50, "pending").otherwise("completed").alias("status")
    jobs = lab.raw("events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("job_type"), F.col("props").alias("metrics"), status)
    return cat.job_outputs(jobs, "purchase", "$.k", "int")


@query(
    "resolve_name_or_id",
    """WITH requests AS (SELECT DISTINCT p_name AS request FROM part UNION SELECT CAST(p_partkey * 3 AS VARCHAR) FROM part),
    names AS (SELECT p_name AS request, max(p_partkey) AS by_name FROM part GROUP BY 1)
    SELECT r.request, coalesce(p_partkey, by_name) AS id FROM requests r
    LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = r.request LEFT JOIN names ON names.request = r.request""",
)
def resolve_name_or_id(lab: Lab):
    parts = lab.raw("part")
    rows = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("created_at"))
    asked = rows.select(F.col("name").alias("request")).unionByName(rows.select((F.col("id") * 3).cast("string").alias("request")))
    return cat.resolve(asked.distinct(), rows)


@query(
    "endpoints_by_project",
    f"""WITH {ENDPOINTS} SELECT e.id, e.name, e.status, e.latency, n_name AS project FROM endpoints e
    JOIN nation ON e.project_id = n_nationkey WHERE n_regionkey = 1 ORDER BY e.id DESC""",
)
def endpoints_by_project(lab: Lab):
    endpoints = lab.endpoints().select("id", "name", "status", "latency", "project_id")
    columns = [F.col("name").alias("project")]
    return cat.rows_of(endpoints, "project_id", lab.projects(), columns, [F.col("id").desc()], owner_id=1).drop("project_id")


@query(
    "artifacts_of_model",
    f"""WITH {ARTIFACTS}, {JOBS} SELECT model_id, job_id, kind, line, size, a.created_at FROM artifacts a JOIN jobs ON job_id = jobs.id
    ORDER BY model_id, a.created_at DESC""",
)
def artifacts_of_model(lab: Lab):
    owners = lab.jobs().select(F.col("id").alias("job_id"), "model_id")
    rows = lab.artifacts().select("job_id", "kind", "line", "size", "created_at").join(owners, "job_id")
    return cat.scoped_list(rows, [F.col("model_id"), F.col("created_at").desc()])


@query(
    "latest_checkpoint",
    f"""WITH {ARTIFACTS}, {JOBS}, r AS (SELECT model_id, job_id, a.created_at, line, part_id, supplier_id, size,
      row_number() OVER (PARTITION BY model_id ORDER BY a.created_at DESC, job_id DESC, line DESC, part_id DESC, supplier_id DESC, size DESC) AS k
      FROM artifacts a JOIN jobs ON job_id = jobs.id WHERE kind = 'R')
    SELECT model_id, job_id, created_at, line, part_id, supplier_id, size FROM r WHERE k = 1""",
)
def latest_checkpoint(lab: Lab):
    return cat.latest_checkpoint(lab.artifacts(), lab.jobs(), "R")


@query(
    "visible_projects",
    """SELECT user_id, project_id, bool_or(owned) AS owned FROM (
      SELECT n_regionkey AS user_id, n_nationkey AS project_id, true AS owned FROM nation
      UNION ALL SELECT CAST(s_suppkey % 5 AS INTEGER), s_nationkey, false FROM supplier) GROUP BY 1, 2""",
)
def visible_projects(lab: Lab):
    return cat.visible_projects(lab.projects(), lab.collaborators())


@query(
    "registry_status",
    """WITH asked AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part),
    installed AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_retailprice > 915)
    SELECT asked.name, installed.name IS NOT NULL AS installed FROM asked LEFT JOIN installed ON asked.name = installed.name""",
)
def registry_status(lab: Lab):
    parts = lab.raw("part")
    asked = parts.select(F.col("p_brand").alias("name")).unionByName(parts.select(F.col("p_type").alias("name")))
    installed = parts.where(F.col("p_retailprice") > 915).select(F.col("p_brand").alias("name"))
    return cat.registry_status(asked, installed)


@query(
    "distinct_names",
    "SELECT DISTINCT p_brand AS name FROM part WHERE p_retailprice > 915 INTERSECT SELECT DISTINCT p_brand FROM part WHERE p_size > 20",
)
def distinct_names(lab: Lab):
    """Registry names that are both requested and installed, each once."""
    parts = lab.raw("part").select(F.col("p_brand").alias("name"), "p_retailprice", "p_size")
    return cat.installed_names(parts.where(F.col("p_size") > 20), parts.where(F.col("p_retailprice") > 915))


@query(
    "label_lookup",
    """SELECT o_orderkey AS id, c_name AS model, n_name AS project FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def label_lookup(lab: Lab):
    models = cat.attach_name(lab.models().select("id", "name", "project_id"), "project_id", lab.projects(), "project")
    return cat.attach_name(lab.jobs().select("id", "model_id"), "model_id", models, "model", "project").select("id", "model", "project")


def dashboards(lab: Lab):
    """Every part read as a dashboard whose layout is JSON text."""
    panel = lambda i: F.struct(
        ((F.col("p_partkey") + 7 * i) % 120).alias("visualization"),
        F.lit(0).alias("x"),
        (i * 4).alias("y"),
        F.lit(6).alias("w"),
        (4 + F.col("p_size") % 2).alias("h"),
    )
    slots = F.sequence(F.lit(0), F.col("p_size") % 3)
    return lab.raw("part").select(F.col("p_partkey").alias("dashboard_id"), F.to_json(F.transform(slots, panel)).alias("layout"))


PANELS = """panels AS (SELECT p_partkey AS dashboard_id, CAST(i AS INTEGER) AS slot, (p_partkey + 7 * i) % 120 AS visualization, 0 AS x,
  CAST(i * 4 AS INTEGER) AS y, 6 AS w, CAST(4 + p_size % 2 AS INTEGER) AS h FROM part, unnest(range(0, p_size % 3 + 1)) AS u(i))"""


@query("dashboard_panels", f"WITH {PANELS} SELECT panels.*, s_name AS title FROM panels LEFT JOIN supplier ON visualization = s_suppkey")
def dashboard_panels(lab: Lab):
    return cat.dashboard_panels(dashboards(lab), lab.endpoints())


@query("panel_bottom", f"WITH {PANELS} SELECT dashboard_id, max(y + h) AS bottom FROM panels GROUP BY 1")
def panel_bottom(lab: Lab):
    return cat.panel_bottom(dashboards(lab))


@query(
    "step_status",
    f"""WITH {JOBS}, {ARTIFACTS} SELECT id AS workflow_id, status, line AS step_order, kind AS step_kind, part_id
    FROM jobs LEFT JOIN artifacts ON id = job_id ORDER BY workflow_id, step_order""",
)
def step_status(lab: Lab):
    """Each workflow with its steps in order, one row per step; one without steps has a row too."""
    steps = lab.artifacts().select(F.col("job_id").alias("workflow_id"), F.col("line").alias("step_order"), F.col("kind").alias("step_kind"), "part_id")
    flows = lab.jobs().select(F.col("id").alias("workflow_id"), "status")
    return cat.members_in_order(flows, "workflow_id", steps, ["step_order"])


@query("feature_group_load", "SELECT p_brand AS group_name, p_name AS feature, p_type AS dtype, p_partkey AS id FROM part ORDER BY 1, 2, 4")
def feature_group_load(lab: Lab):
    """Features of every group, ordered by name."""
    return (
        lab.raw("part")
        .select(F.col("p_brand").alias("group_name"), F.col("p_name").alias("feature"), F.col("p_type").alias("dtype"), F.col("p_partkey").alias("id"))
        .orderBy("group_name", "feature", "id")
    )


@query("unlinked_rows", f"WITH {JOBS} SELECT id, model_id, status FROM jobs WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id)")
def unlinked_rows(lab: Lab):
    jobs = lab.jobs().select("id", "model_id", "status")
    return cat.unlinked_rows(jobs, "id", lab.artifacts(), "job_id").select("id", "model_id", "status")


