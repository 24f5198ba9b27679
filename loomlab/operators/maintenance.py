"""Table changes as snapshot jobs: old snapshot and changes in, new snapshot out.

Changes are folded per key before they meet the table, so a key with many changes costs one
aggregate row. Snapshots are written to a new place and never over their own input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlab.functions.text import ERROR_LENGTH
from loomlab.operators.experiments import union_all
from loomlab.operators.ordered import running


def _null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str) -> DataFrame:
    on = reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])
    return left.join(right, on, how)


def upsert_versioned(models: DataFrame, changes: DataFrame) -> DataFrame:
    """Register changes (seq, name, registry_name, project_id, code, framework, description).

    A change with a registry name matches the newest model of that registry name in its project,
    any other the newest of its name; no project is a scope of its own. Each change raises the
    version, overwrites code and framework and keeps the description unless it brings one.
    Changes that match nothing create a model, which the later ones of the same key then match.
    Changes are folded per key before any join, so a name with very many changes is one row there.
    """

    def newest(key: str, out: str) -> DataFrame:
        rows = models.where(F.col(key).isNotNull())
        return rows.groupBy(F.col(key).alias(f"_{out}_key"), F.col("project_id").alias(f"_{out}_project")).agg(
            F.max_by("id", F.struct("version", "id")).alias(out)
        )

    seq = F.col("seq")
    per_key = changes.groupBy(
        "project_id", "registry_name", F.when(F.col("registry_name").isNull(), F.col("name")).alias("k_name")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("seq", "code", "framework")).alias("last"),
        F.max(F.when(F.col("description").isNotNull(), F.struct("seq", "description"))).alias("described"),
        F.min(F.struct("seq", "name")).alias("first"),
    )
    hit = _null_safe(
        per_key, newest("registry_name", "by_registry"), [("project_id", "_by_registry_project"), ("registry_name", "_by_registry_key")], "left"
    )
    hit = _null_safe(hit, newest("name", "by_name"), [("project_id", "_by_name_project"), ("k_name", "_by_name_key")], "left")
    target = F.when(F.col("registry_name").isNotNull(), F.col("by_registry")).otherwise(F.col("by_name"))
    fresh = F.col("target").isNull()
    registered = F.when(F.col("registry_name").isNotNull(), F.struct(F.col("last.seq").alias("seq"), F.col("registry_name").alias("name")))
    folded = hit.withColumn("target", target).groupBy(
        "target", *[F.when(fresh, F.col(c)).alias(k) for c, k in (("registry_name", "f_registry"), ("k_name", "f_name"), ("project_id", "f_project"))]
    ).agg(
        F.sum("n").alias("n"),
        F.max("last").alias("last"),
        F.max("described").alias("described"),
        F.max(registered).alias("registered"),
        F.min("first").alias("first"),
    ).select(
        "target",
        F.col("f_project").alias("k_project"),
        "n",
        "last",
        F.col("described.description").alias("new_description"),
        F.col("registered.name").alias("new_registry"),
        F.col("first.name").alias("first_name"),
    )
    merged = models.join(folded, models["id"] == folded["target"], "full")
    known, touched = models["id"].isNotNull(), F.col("n").isNotNull()
    return merged.select(
        models["id"],
        F.when(known, models["name"]).otherwise(F.col("first_name")).alias("name"),
        F.coalesce("new_registry", models["registry_name"]).alias("registry_name"),
        F.when(known, models["project_id"]).otherwise(F.col("k_project")).alias("project_id"),
        (F.coalesce(models["version"], F.lit(0)) + F.coalesce("n", F.lit(0))).alias("version"),
        F.when(touched, F.col("last.code")).otherwise(models["code"]).alias("code"),
        F.when(touched, F.col("last.framework")).otherwise(models["framework"]).alias("framework"),
        F.coalesce("new_description", models["description"]).alias("description"),
    )


def publish_version(updates: DataFrame) -> DataFrame:
    """Version rows (model_id, id, version, code); no code carries the last one forward."""
    given = F.when(F.col("code").isNotNull(), F.struct("id", "code"))
    walked = running(updates, ["model_id"], "id", {"version": ("count", F.lit(1)), "_given": ("max", given)})
    return walked.select("model_id", "id", "version", F.col("_given.code").alias("code"))


def patch_coalesce(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Each column takes the patch's value where there is one; one patch per key."""
    changed = [c for c in patches.columns if c != key]
    renamed = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = rows.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in rows.columns])


def mark_read(notifications: DataFrame, listed: DataFrame, everything: DataFrame) -> DataFrame:
    """Mark listed (user_id, id) pairs, and all of the users in ``everything``, as read.

    A listed id of another user changes nothing. ``changed`` marks the rows that were unread.
    """
    pairs = listed.select("user_id", "id").distinct().withColumn("_listed", F.lit(True))
    users = everything.select("user_id").distinct().withColumn("_all", F.lit(True))
    hit = F.coalesce("_listed", "_all", F.lit(False))
    joined = notifications.join(pairs, ["user_id", "id"], "left").join(users, "user_id", "left")
    return joined.select(
        "id", "user_id", "created_at", (F.col("read") | hit).alias("read"), (~F.col("read") & hit).alias("changed")
    )


def delete_cascade(children: DataFrame, reference: str, deleted: DataFrame, key: str) -> DataFrame:
    """Children without those of deleted parents."""
    return children.join(deleted.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def delete_set_null(children: DataFrame, reference: str, deleted: DataFrame, key: str) -> DataFrame:
    """Children that keep their row but lose the reference to a deleted parent."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    joined = children.join(gone, children[reference] == F.col("_gone"), "left")
    kept = F.when(F.col("_gone").isNull(), F.col(reference)).alias(reference)
    return joined.select(*[kept if c == reference else F.col(c) for c in children.columns])


def append_features(existing: DataFrame, appended: DataFrame) -> DataFrame:
    """Feature rows per (group, project, feature), the latest one kept; new groups are marked."""
    both = existing.withColumn("_old", F.lit(True)).unionByName(appended.withColumn("_old", F.lit(False)))
    order = F.struct(~F.col("_old"), F.col("seq"), F.col("dtype"))
    rows = both.groupBy("group_name", "project", "feature").agg(F.max_by("dtype", order).alias("dtype"))
    groups = existing.select(F.col("group_name").alias("_g"), F.col("project").alias("_p")).distinct()
    joined = _null_safe(rows, groups, [("group_name", "_g"), ("project", "_p")], "left")
    return joined.select("group_name", "project", "feature", "dtype", F.col("_g").isNull().alias("new_group"))


def status_transitions(events: DataFrame) -> DataFrame:
    """Job state after its ordered status events (job_id, seq, at, status, message)."""
    status, at, seq = F.col("status"), F.col("at"), F.col("seq")
    finished = status.isin("completed", "failed")
    return events.where(status.isin("running", "completed", "failed")).groupBy("job_id").agg(
        F.max_by("status", seq).alias("status"),
        F.min_by(at, F.when(status == "running", seq)).alias("started_at"),
        F.max_by(at, F.when(finished, seq)).alias("completed_at"),
        F.max(F.when(status == "completed", 100)).alias("progress"),
        F.max_by(F.left("message", F.lit(ERROR_LENGTH)), F.when(status == "failed", seq)).alias("error_message"),
    )


# integrity -----------------------------------------------------------------------------------


def integrity_audit(
    tables: dict[str, DataFrame],
    keys: list[tuple[str, list[str]]],
    references: list[tuple[str, str, str, str]],
    domains: list[tuple[str, str, list[str]]],
) -> DataFrame:
    """(violation, n): repeated keys, references without a parent, and values outside an enumeration.

    ``keys`` are (table, columns), ``references`` (table, column, parent, parent's column), ``domains`` (table, column,
    allowed values). A table is grouped once by its key: that pass counts repeated keys and stray values, and, as the
    keys of the rows that refer to it are counted into the same groups, the references that no parent has. Null
    references are none, null values are in every domain, a null key is a key. Counts start in the map tasks.
    """
    by_key = {t: list(k) for t, k in keys}
    passes: dict[tuple[str, tuple[str, ...]], list] = {(t, tuple(k)): [] for t, k in by_key.items()}
    for reference in references:
        passes.setdefault((reference[2], (reference[3],)), []).append(reference)
    for t, _, _ in domains:
        if t not in by_key and not any(parent == t for parent, _ in passes):
            passes[t, ()] = []
    found, told = [], set()
    for (name, key), children in passes.items():
        own = [d for d in domains if d[0] == name and d[:2] not in told]
        told |= {d[:2] for d in own}
        stray = [F.when(~F.col(c).isin(*allowed), 1).otherwise(0) for _, c, allowed in own]
        columns = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
        counts = ["parents", *[f"d{i}" for i in range(len(own))], *[f"c{i}" for i in range(len(children))]]
        blank = [F.lit(0)] * len(counts)
        rows = tables[name].select(*columns, *[v.alias(c) for v, c in zip([F.lit(1), *stray, *blank], counts)])
        for i, (child, column, _, _) in enumerate(children):
            mine = [F.lit(int(c == f"c{i}")).alias(c) for c in counts]
            kind = tables[name].schema[key[0]].dataType
            rows = rows.unionByName(tables[child].where(F.col(column).isNotNull()).select(F.col(column).cast(kind).alias("k0"), *mine))
        grouped = rows.groupBy(*[f"k{i}" for i in range(len(key))]).agg(*[F.sum(c).alias(c) for c in counts])
        out = [(f"domain {name}.{c}", F.sum(f"d{i}")) for i, (_, c, _) in enumerate(own)]
        out += [(f"reference {child}.{c}", F.sum(F.when(F.col("parents") == 0, F.col(f"c{i}")))) for i, (child, c, _, _) in enumerate(children)]
        if by_key.get(name) == list(key):
            out.append((f"unique {name}", F.count_if(F.col("parents") > 1)))
        row = grouped.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(f"v{i}") for i, (_, v) in enumerate(out)])
        found.append(row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("violation"), F.col(f"v{i}").alias("n")) for i, (n, _) in enumerate(out)]))))
    return union_all(found)
