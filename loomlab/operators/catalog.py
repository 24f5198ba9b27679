"""Listings, searches, lookups and small joins over the catalog relations.

No join carries a broadcast hint: adaptive execution broadcasts a side only after it has
measured it below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlab.operators.grouped import latest, page_per_group, top_per_group


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_pattern(text: Column, q: str) -> Column:
    """``text ILIKE '%q%'``, where ``%`` and ``_`` in ``q`` keep their meaning.

    With ``%`` only, the literal parts are looked for one after the other, each behind the first
    place of the one before. That reads a text once, while a regular expression with several
    wildcards starts over at every candidate.
    """
    if "_" in q or "\\" in q:
        return text.ilike(f"%{q}%")
    rest, parts = F.lower(text), [p for p in q.lower().split("%") if p]
    if not parts:
        return text.isNotNull()
    for part in parts[:-1]:
        rest = F.get(F.split(rest, re.escape(part), 2), F.lit(1))
    return rest.contains(parts[-1])


# listings ----------------------------------------------------------------------------------


def scoped_list(df: DataFrame, order: list[Column], scope: str | None = None, value=None) -> DataFrame:
    """All rows, or those of one scope, in the given order."""
    chosen = df if value is None else df.where(F.col(scope) == F.lit(value))
    return chosen.orderBy(*order)


def rows_of(rows: DataFrame, key: str, owners: DataFrame, columns: list, order: list[Column], **wanted) -> DataFrame:
    """The rows whose owner has the wanted values, with ``columns`` of the owner, in the given order.

    ``rows[key]`` refers to ``owners.id``, which is unique. Rows without a known owner are in no answer. The filter runs
    on the owners, before the join.
    """
    chosen = filter_equal(owners, **wanted).select(F.col("id").alias(key), *columns)
    return rows.join(chosen, key).orderBy(*order)


def members_in_order(groups: DataFrame, key: str, members: DataFrame, order: list[str]) -> DataFrame:
    """Each group with its members in order, one row per member; a group without members has one row, with empty fields."""
    return groups.join(members, key, "left").orderBy(key, *[F.col(c).asc_nulls_first() for c in order])


def load_group(groups: DataFrame, members: DataFrame, request: str, key: str = "group_id", order: str = "name") -> DataFrame:
    """The members of the group with that id, else of the newest group with that name, ordered; nothing if there is none.

    ``groups`` has id, name and created_at, and ``members[key]`` refers to the id.
    """
    asked = groups.sparkSession.range(1).select(F.lit(request).alias("request"))
    found = resolve(asked, groups.where((F.col("name") == request) | (F.col("id").cast("string") == request)))
    return members.join(found.select(F.col("id").alias(key)), key, "left_semi").orderBy(order)


def filter_equal(df: DataFrame, **wanted) -> DataFrame:
    """Equality on every argument that is not None."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def page_slice(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page by limit and offset."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: list[str], last: tuple, limit: int) -> DataFrame:
    """The page after the key ``last``: the filter reaches the scan, so deep pages cost no more."""
    after = F.struct(*key) > F.struct(*[F.lit(v).alias(k) for k, v in zip(key, last)])
    lead = F.col(key[0]) >= F.lit(last[0])
    return df.where(lead & after).orderBy(*key).limit(limit)


def log_query(
    logs: DataFrame, job=None, level: str | None = None, limit: int = 1000, offset: int = 0, cap: int = 5000
) -> DataFrame:
    """Log lines, oldest first: one page of a job, or the same page of every job."""
    if level is not None:
        logs = logs.where(F.col("level") == level)
    if job is not None:
        return page_slice(logs.where(F.col("job_id") == job), [F.col("logged_at")], min(limit, cap), offset)
    return page_per_group(logs, ["job_id"], [F.col("logged_at"), F.col("level"), F.col("message")], limit, offset, cap).drop("rank")


def tail_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group, in ascending order."""
    return top_per_group(df, keys, [F.col(order).desc()], n).drop("rank").orderBy(*keys, order)


def recent_distinct(searches: DataFrame, n: int = 8) -> DataFrame:
    """Each user's ``n`` latest distinct queries; using one again moves it to the front."""
    said = searches.withColumn("query", F.trim("query")).where(F.col("query") != "")
    last_use = said.groupBy("user_id", "query").agg(F.max("at").alias("last_used"))
    return top_per_group(last_use, ["user_id"], [F.col("last_used").desc(), F.col("query")], n)


# searches ----------------------------------------------------------------------------------


def search_items(
    df: DataFrame,
    category: str,
    fields: list[str],
    q: str,
    limit: int,
    name: Column,
    href: Column,
    recency: Column | None = None,
    description: Column | None = None,
    icon_hint: Column | None = None,
    status: Column | None = None,
) -> DataFrame:
    """The newest ``limit`` rows of one table with a field that contains ``q``, as hit records.

    Wildcards in ``q`` keep their meaning. Without a recency the id decides. The limit is a top-k,
    so only ``limit`` rows per task leave the scan stage.
    """
    absent = F.lit(None).cast("string")
    hits = df.where(any_of([contains_pattern(F.col(f), q) for f in fields]))
    texts = {"name": name, "description": description, "href": href, "icon_hint": icon_hint, "status": status}
    return (
        hits.select(
            F.lit(category).alias("category"),
            F.col("id").cast("long").alias("id"),
            *[(absent if text is None else text).alias(field) for field, text in texts.items()],
            (F.col("id") if recency is None else recency).cast("long").alias("recency"),
        )
        .orderBy(F.col("recency").desc(), F.col("id").desc())
        .limit(limit)
    )


def search_tables(tables: dict[str, tuple[DataFrame, list[str]]], q: str, limit: int = 10) -> DataFrame:
    """(kind, id, name) of the first ``limit`` rows by name of each table with a field like ``%q%``."""
    found = [
        df.where(any_of([contains_pattern(F.col(f), q) for f in fields]))
        .select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "name")
        .orderBy("name", "id")
        .limit(limit)
        for kind, (df, fields) in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), found)


def rank_hits(categories: list[DataFrame]) -> DataFrame:
    """All categories in one answer; at most ``limit`` rows each, ranked inside the category."""
    hits = reduce(lambda a, b: a.unionByName(b), categories)
    order = Window.partitionBy("category").orderBy(F.col("recency").desc(), F.col("id").desc())
    return hits.withColumn("rank", F.row_number().over(order))


def category_totals(hits: DataFrame) -> DataFrame:
    """Hits per category and, with no category, in total."""
    return hits.rollup("category").agg(F.count(F.lit(1)).alias("hits"))


def registry_search(index: DataFrame, q: str = "", category: str | None = None, framework: str | None = None) -> DataFrame:
    """Entries whose name, description, tags and author contain ``q``; facets ignore case."""
    text = F.lower(F.concat_ws(" ", "name", "description", F.concat_ws(" ", "tags"), "author"))
    if category:
        index = index.where(F.lower("category") == category.lower())
    if framework:
        index = index.where(F.lower("framework") == framework.lower())
    return index.where(text.contains(q.lower())) if q else index


def facet_filter(df: DataFrame, q: str, fields: list[str], **facets: str) -> DataFrame:
    """Lower-case contains on any field, and equality on every facet that is not "All"."""
    if q:
        df = df.where(any_of([F.lower(f).contains(q.lower()) for f in fields]))
    return filter_equal(df, **{k: None if v == "All" else v for k, v in facets.items()})


# lookups -----------------------------------------------------------------------------------


def resolve(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """For each requested text the row with that id, else the newest row with that name.

    Two equi joins; names are reduced to their newest row before the join.
    """
    ids = rows.select(F.col("id").cast("string").alias("request"), F.col("id").alias("by_id"))
    names = latest(rows.select(F.col("name").alias("request"), F.col("id").alias("by_name"), "created_at"), ["request"], ["created_at", "by_name"])
    found = requests.join(ids, "request", "left").join(names.drop("created_at"), "request", "left")
    return found.select("request", F.coalesce("by_id", "by_name").alias("id"))


def attach_name(rows: DataFrame, key: str, named: DataFrame, alias: str, *more: str) -> DataFrame:
    """Adds, as ``alias``, the name of what ``rows[key]`` refers to; null where it is unknown. Ids of ``named`` are unique."""
    return rows.join(named.select(F.col("id").alias(key), F.col("name").alias(alias), *more), key, "left")


def job_outputs(jobs: DataFrame, job_type: str = "inference", path: str = "$", kind: str = "string") -> DataFrame:
    """Output and status of the jobs of a type; the output is a field of the JSON text ``metrics``, null if it isn't there."""
    output = F.try_variant_get(F.try_parse_json("metrics"), path, kind)
    return jobs.where(F.col("job_type") == job_type).withColumn("output", output).drop("job_type", "metrics")


def visible_projects(projects: DataFrame, members: DataFrame) -> DataFrame:
    """(user, project) for owners and collaborators, each pair once."""
    owned = projects.select(F.col("owner_id").alias("user_id"), F.col("id").alias("project_id"), F.lit(True).alias("owned"))
    joined = members.select("user_id", "project_id", F.lit(False).alias("owned"))
    known = joined.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    return owned.unionByName(known).groupBy("user_id", "project_id").agg(F.bool_or("owned").alias("owned"))


def registry_status(requested: DataFrame, installed: DataFrame) -> DataFrame:
    """Each requested name with whether it is installed."""
    names = installed.select("name").distinct().withColumn("_hit", F.lit(True))
    return requested.select("name").distinct().join(names, "name", "left").select(
        "name", F.col("_hit").isNotNull().alias("installed")
    )


def installed_names(requested: DataFrame, installed: DataFrame) -> DataFrame:
    """The requested names that are installed, each once; empty names are no requests."""
    asked = requested.select("name").where(F.col("name") != "").distinct()
    return asked.join(installed.select("name"), "name", "left_semi")


def latest_checkpoint(artifacts: DataFrame, jobs: DataFrame, kind: str) -> DataFrame:
    """Newest artifact of a kind per model; reduced per job before the join."""
    order = ["created_at", "line", "part_id", "supplier_id", "size"]
    per_job = latest(artifacts.where(F.col("kind") == kind).drop("kind"), ["job_id"], order)
    owned = per_job.join(jobs.select(F.col("id").alias("job_id"), "model_id"), "job_id")
    return latest(owned, ["model_id"], ["created_at", "job_id", *order[1:]])


PANEL = "array<struct<visualization:bigint,x:int,y:int,w:int,h:int>>"


def panels(dashboards: DataFrame) -> DataFrame:
    """One row per panel of a JSON layout; dashboards without panels vanish."""
    parsed = dashboards.select("dashboard_id", F.from_json("layout", PANEL).alias("p"))
    return parsed.select("dashboard_id", F.posexplode("p").alias("slot", "p")).select("dashboard_id", "slot", "p.*")


def panel_bottom(dashboards: DataFrame) -> DataFrame:
    """The first free grid row below all panels of each dashboard, 0 without panels. Read from the layout, without a shuffle."""
    lows = F.transform(F.from_json("layout", PANEL), lambda p: p["y"] + p["h"])
    return dashboards.select("dashboard_id", F.greatest(F.array_max(lows), F.lit(0)).alias("bottom"))


def dashboard_panels(dashboards: DataFrame, visualizations: DataFrame) -> DataFrame:
    """Panels with their visualization; unknown ones stay as empty panels."""
    known = visualizations.select(F.col("id").alias("visualization"), F.col("name").alias("title"))
    return panels(dashboards).join(known, "visualization", "left")


def unlinked_rows(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is null or has no parent."""
    return df.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
