"""Sweep, training and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.operators import learning, sweeps
from loomlab.plans.registry import query
from loomlab.session import materialize
from loomlab.tables import Lab, status_of

GRID = {
    "batch_size": {"type": "choice", "values": [16, 32, 64]},
    "epochs": {"type": "int_range", "min": 5, "max": 9},
    "optimizer": {"type": "choice", "values": ["adam", "sgd"]},
}
SPACE = {
    "batch_size": {"type": "choice", "values": [16, 32, 64]},
    "epochs": {"type": "int_range", "min": 5, "max": 50},
    "lr": {"type": "log_uniform", "min": 1e-5, "max": 1e-1},
    "momentum": {"type": "uniform"},
    "unknown": {"type": "spline"},
}


def planned(lab: Lab):
    """Every order read as a planned trial of its customer's sweep."""
    return lab.raw("orders").select(F.col("o_custkey").alias("sweep_id"), F.col("o_orderkey").alias("job_id"))


@query(
    "grid_trials",
    """SELECT o_custkey AS sweep_id, o_orderkey AS job_id, ([16, 32, 64])[o_orderkey % 3 + 1] AS batch_size, 5 + o_orderkey // 3 % 5 AS epochs,
    (['adam', 'sgd'])[o_orderkey // 15 % 2 + 1] AS optimizer FROM orders""",
)
def grid_trials(lab: Lab):
    return sweeps.grid_trials(planned(lab), GRID, "job_id")


def _draw(name: str) -> str:
    return f"CAST('0x' || left(md5('7|{name}|' || sweep_id || '|' || job_id), 13) AS BIGINT) / {16.0**13}::DOUBLE"


DRAWN = f"""drawn AS (SELECT *, ([16, 32, 64])[CAST(floor({_draw('batch_size')} * 3) AS INTEGER) + 1] AS batch_size,
  5 + CAST(floor({_draw('epochs')} * 46) AS BIGINT) AS epochs,
  exp(ln(1e-5::DOUBLE) + {_draw('lr')} * (ln(1e-1::DOUBLE) - ln(1e-5::DOUBLE))) AS lr, {_draw('momentum')} AS momentum
  FROM (SELECT o_custkey AS sweep_id, o_orderkey AS job_id, o_orderstatus FROM orders))"""


@query(
    "random_trials",
    f"""WITH {DRAWN} SELECT sweep_id, job_id, batch_size, epochs, round(lr, 10) AS lr, round(momentum, 10) AS momentum, CAST(NULL AS VARCHAR) AS unknown
    FROM drawn""",
)
def random_trials(lab: Lab):
    drawn = sweeps.random_trials(planned(lab), SPACE, ["sweep_id", "job_id"], seed=7)
    return drawn.withColumns(
        {"lr": F.round("lr", 10), "momentum": F.round("momentum", 10), "unknown": F.col("unknown").cast("string")}
    )


@query(
    "train_params",
    """SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN '{"lr":' || o_orderkey || '}' END,
      CASE WHEN c_acctbal > 0 AND o_orderkey % 3 = 1 THEN '{"set":"' || c_name || '"}' END) AS parameters
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def train_params(lab: Lab):
    """Orders as jobs: a third with parameters, a third with a stored set, a third with none."""
    jobs = lab.raw("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey")).alias("set_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.format_string('{"lr":%d}', F.col("o_orderkey"))).alias("parameters"),
    )
    sets = lab.models().where(F.col("score") > 0).select("id", F.format_string('{"set":"%s"}', F.col("name")).alias("parameters"))
    return sweeps.train_params(jobs, sets).select("id", "parameters")


LINES = {"quantity": ["l_quantity"], "discount": ["l_discount"], "both": ["l_quantity", "l_discount"]}
LINE_SPACE = {
    "features": {"type": "choice", "values": list(LINES)},
    "penalty": {"type": "log_uniform", "min": 1e-2, "max": 1e3},
}


@query(
    "sweep",
    f"""WITH rows AS (SELECT l_orderkey % 5 AS fold, l_quantity AS q, l_discount AS d, l_extendedprice AS p FROM lineitem),
    t AS (SELECT f, avg(q) AS mq, avg(d) AS md, avg(p) AS mp, covar_pop(q, q) AS qq, covar_pop(d, d) AS dd, covar_pop(q, d) AS qd, covar_pop(q, p) AS qp, covar_pop(d, p) AS dp
      FROM rows, range(5) AS x(f) WHERE fold <> f GROUP BY f),
    h AS (SELECT fold AS f, count(*) AS n, avg(q) AS mq, avg(d) AS md, avg(p) AS mp, covar_pop(q, q) AS qq, covar_pop(d, d) AS dd, covar_pop(q, d) AS qd,
      covar_pop(q, p) AS qp, covar_pop(d, p) AS dp, covar_pop(p, p) AS pp FROM rows GROUP BY fold),
    drawn AS (SELECT *, (['quantity', 'discount', 'both'])[CAST(floor({_draw('features')} * 3) AS INTEGER) + 1] AS features,
      exp(ln(1e-2::DOUBLE) + {_draw('penalty')} * (ln(1e3::DOUBLE) - ln(1e-2::DOUBLE))) AS l
      FROM (SELECT o_custkey AS sweep_id, o_orderkey AS job_id, o_orderstatus FROM orders)),
    fitted AS (SELECT sweep_id, job_id, t.*,
        CASE features WHEN 'quantity' THEN qp / (qq + l) WHEN 'discount' THEN 0 ELSE (qp * (dd + l) - dp * qd) / ((qq + l) * (dd + l) - qd * qd) END AS wq,
        CASE features WHEN 'quantity' THEN 0 WHEN 'discount' THEN dp / (dd + l) ELSE (dp * (qq + l) - qp * qd) / ((qq + l) * (dd + l) - qd * qd) END AS wd
      FROM drawn, t WHERE o_orderstatus = 'F'),
    errors AS (SELECT sweep_id, job_id, sqrt(sum(h.n * (h.pp - 2 * (wq * h.qp + wd * h.dp) + wq * wq * h.qq + 2 * wq * wd * h.qd + wd * wd * h.dd
        + power((h.mp - x.mp) - wq * (h.mq - x.mq) - wd * (h.md - x.md), 2))) / sum(h.n)) AS objective FROM fitted x JOIN h ON h.f = x.f GROUP BY ALL)
    SELECT sweep_id, count(*) AS completed_trials, round(min(objective), 4) AS best_value, arg_min(job_id, {{'v': objective, 'j': job_id}}) FILTER (objective IS NOT NULL) AS best_job
    FROM drawn LEFT JOIN errors USING (sweep_id, job_id) GROUP BY 1""",
)
def sweep(lab: Lab):
    """Random trials of every sweep: lines that predict a price, scored on held-out lines, folded to one row per sweep."""
    rows = lab.raw("lineitem").withColumn("_fold", F.col("l_orderkey") % 5)
    columns = ["l_quantity", "l_discount", "l_extendedprice"]
    moments = sweeps.fold_moments(rows, columns, "_fold", 5)
    completed = (status_of(F.col("o_orderstatus")) == "completed").alias("done")
    trials = lab.raw("orders").select(F.col("o_custkey").alias("sweep_id"), F.col("o_orderkey").alias("job_id"), completed)
    drawn = sweeps.random_trials(trials, LINE_SPACE, ["sweep_id", "job_id"], seed=7)
    _, summary = sweeps.sweep(drawn, sweeps.ridge_trials(moments, columns, LINES, "features", "penalty", "done"), minimize=True)
    return summary.withColumn("best_value", F.round("best_value", 4))


@query(
    "user_train",
    """WITH f AS (SELECT p_brand, regr_slope(l_extendedprice, l_quantity) AS l_quantity, regr_intercept(l_extendedprice, l_quantity) AS intercept, count(*) AS n,
      var_pop(l_extendedprice) * (1 - regr_r2(l_extendedprice, l_quantity)) AS loss FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
    SELECT p_brand, 'l_quantity' AS metric_name, round(l_quantity, 2) AS value FROM f UNION ALL SELECT p_brand, 'intercept', round(intercept, 2) FROM f
    UNION ALL SELECT p_brand, 'rows', CAST(n AS DOUBLE) FROM f UNION ALL SELECT p_brand, 'loss', round(loss, 0) FROM f""",
)
def user_train(lab: Lab):
    """One least-squares fit per brand by a user trainer."""
    brands = lab.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = lab.raw("lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(brands, "l_partkey")
    metrics = learning.user_train(rows, ["p_brand"], ["l_quantity", "l_extendedprice"], learning.LinearTrainer(["l_quantity"], "l_extendedprice"))
    digits = F.when(F.col("metric_name") == "loss", F.round("value", 0)).otherwise(F.round("value", 2))
    return metrics.withColumn("value", digits)


@query(
    "user_infer",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
    SELECT l_orderkey, l_quantity, round(a + b * l_quantity, 3) AS prediction FROM lineitem, f""",
)
def user_infer(lab: Lab):
    """Line items scored by a model fitted to all of them."""
    rows = lab.raw("lineitem")
    fit = rows.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a")).first()
    a, b = fit["a"], fit["b"]
    scored = learning.user_infer(rows.select("l_orderkey", "l_quantity"), ["l_quantity"], lambda x: a + b * x[:, 0])
    return scored.withColumn("prediction", F.round("prediction", 3))


@query(
    "row_transform",
    "SELECT doc_id, CAST(len(text) AS BIGINT) AS chars, upper(lang) AS lang FROM documents",
)
def row_transform(lab: Lab):
    """A user function applied to the documents, a batch at a time."""

    def measure(batch):
        return batch[["doc_id"]].assign(chars=batch["text"].str.len(), lang=batch["lang"].str.upper())

    return learning.batch_transform(lab.raw("documents").select("doc_id", "text", "lang"), measure, "doc_id bigint, chars bigint, lang string")


def described(lab: Lab):
    """Features of every document."""
    words = F.size(F.split("text", r"\s+"))
    return lab.raw("documents").select(
        "doc_id",
        "lang",
        F.log1p(F.col("n_chars").cast("double")).alias("length"),
        (F.col("n_chars") / words).alias("word_length"),
        (F.regexp_count("text", F.lit(r"[^\w\s]")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("marks"),
    )


def labeled(lab: Lab):
    labels = lab.raw("labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return described(lab).join(labels, "doc_id")


FEATURES = ["length", "word_length", "marks"]

LABELED = r"""described AS (SELECT doc_id, ln(1 + n_chars::DOUBLE) AS length, n_chars / len(regexp_split_to_array(text, '\s+')) AS word_length,
    len(regexp_extract_all(text, '[^\w\s]')) / greatest(n_chars, 1) AS marks FROM documents),
  labeled AS (SELECT d.*, quality::DOUBLE AS quality, CAST(floor(CAST('0x' || left(md5('0|fold|' || doc_id), 13) AS BIGINT) / 4503599627370496.0::DOUBLE * 5) AS INTEGER) AS fold
    FROM described d JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""


def _models_sql(rows: str, numbers: str) -> str:
    """Class statistics per model, from the rows of the other folds; model 5 leaves out no fold."""
    stats = ", ".join(f"avg({f}) AS m_{f}, greatest(var_pop({f}), 1e-9) AS v_{f}" for f in FEATURES)
    return f"models AS (SELECT m, quality AS guess, count(*) AS n, {stats} FROM {rows}, ({numbers}) WHERE fold <> m GROUP BY ALL)"


COST = "-ln(n) + " + " + ".join(f"ln(v_{f}) / 2 + power({f} - m_{f}, 2) / (2 * v_{f})" for f in FEATURES)


@query(
    "cv_train",
    f"""WITH {LABELED}, {_models_sql('labeled', 'SELECT range AS m FROM range(6)')},
    guessed AS (SELECT m, doc_id, quality, arg_min(guess, {{'c': {COST}, 'g': guess}}) AS guess FROM labeled JOIN models ON m = fold OR m = 5 GROUP BY ALL),
    found AS (SELECT CAST(row_number() OVER (ORDER BY m) AS INTEGER) AS epoch, count(*) FILTER (guess = quality) / count(*) AS accuracy FROM guessed GROUP BY m)
    SELECT epoch, 'accuracy' AS metric_name, accuracy AS value FROM found UNION ALL SELECT epoch, 'loss', 1 - accuracy FROM found""",
)
def cv_train(lab: Lab):
    """Five-fold accuracy and loss of a quality classifier, and those of the fit on all rows."""
    return learning.cv_train(materialize(lab.spark, labeled(lab), "labeled"), "doc_id", FEATURES, "quality")


@query(
    "batch_inference",
    f"""WITH {LABELED}, {_models_sql('labeled', 'SELECT 5 AS m')}
    SELECT doc_id, CAST(arg_min(guess, {{'c': {COST}, 'g': guess}}) AS INTEGER) AS predicted_quality FROM described, models GROUP BY 1""",
)
def batch_inference(lab: Lab):
    """Every document scored by the classifier that is fitted on the labeled ones."""
    model = materialize(lab.spark, learning.gaussian_train(labeled(lab), FEATURES, "quality"), "model")
    scored = learning.gaussian_infer(described(lab).select("doc_id", *FEATURES), FEATURES, model, "predicted_quality")
    return scored.select("doc_id", F.col("predicted_quality").cast("int").alias("predicted_quality"))
