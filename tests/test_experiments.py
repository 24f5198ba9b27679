import json

import pytest
from pyspark.sql import functions as F

from loomlab.functions import display
from loomlab.functions import text as tx
from loomlab.operators import catalog as cat
from loomlab.operators import experiments as ex
from loomlab.operators import learning, sweeps

RUNS = "experiment_id long, run_id long, parameters map<string,string>, metrics map<string,double>"


def test_best_run(spark):
    rows = [
        (1, 1, {}, {"accuracy": 0.31}), (1, 2, {}, {"accuracy": 0.47}), (1, 3, {}, {"accuracy": 0.22, "loss": 0.0}),
        (2, 1, {}, {"loss": 0.5, "zeta": 1.0}), (2, 2, {}, {"loss": 0.2}), (2, 3, {}, {"loss": 0.2}),
        (3, 1, {}, {"test_error": 2.0}), (3, 2, {}, {"test_error": float("nan")}), (3, 3, {}, {"test_error": 1.0}),
        (4, 1, {}, {"val_loss": 1.0}), (4, 2, {}, {"val_loss": 3.0}), (4, 3, {}, {}),
    ]
    runs = spark.createDataFrame(rows, RUNS)
    got = {r["experiment_id"]: (r["metric"], r["run_id"]) for r in ex.best_run(runs).collect()}
    assert got == {1: ("accuracy", 2), 2: ("loss", 2), 3: ("test_error", 3), 4: ("val_loss", 2)}
    low = {r["experiment_id"]: r["run_id"] for r in ex.best_run(runs, F.col("metric").contains("loss")).collect()}
    assert low[4] == 1


def test_running_best_keeps_the_first_of_equals(spark):
    rows = [(1, 1, None), (1, 2, 5.0), (1, 3, 5.0), (1, 4, 4.0), (1, 5, None), (1, 6, 9.0)]
    trials = spark.createDataFrame(rows, "sweep_id long, job_id long, objective double")
    low = [(r["completed_trials"], r["best_value"], r["best_job"]) for r in ex.running_best(trials, True).orderBy("job_id").collect()]
    assert low == [(1, None, None), (2, 5.0, 2), (3, 5.0, 2), (4, 4.0, 4), (5, 4.0, 4), (6, 4.0, 4)]
    high = [r["best_job"] for r in ex.running_best(trials, False).orderBy("job_id").collect()]
    assert high == [None, 2, 2, 2, 2, 6]


def test_best_flag_marks_all_equals_but_no_zero(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.1), (2, 4, 0.0)]
    got = {r["run_id"]: r["is_best"] for r in ex.best_flag(spark.createDataFrame(rows, "experiment_id long, run_id long, accuracy double")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_trial_fields_take_zero_as_missing(spark):
    rows = [(1, 1, {"learning_rate": "0", "lr": "0.1", "batch": "8", "n_layers": "x"}, None)]
    r = ex.trial_view(spark.createDataFrame(rows, RUNS)).first()
    assert (r["learning_rate"], r["batch_size"], r["layers"], r["accuracy"]) == (0.1, 8.0, 4.0, 0.0)


@pytest.mark.parametrize("text, value", [("1.5", 1.5), (" 2 ", 2.0), ("1d", 0.0), ("x", 0.0), ("", 0.0), (None, 0.0), ("-1e3", -1000.0)])
def test_number_or_zero(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(ex.number_or_zero(F.col("t"))).first()[0] == value


def test_tables_take_any_number_of_keys(spark):
    runs = spark.range(1200).select(F.lit(1).alias("experiment_id"), F.col("id").alias("run_id"), F.create_map(F.col("id").cast("string"), F.lit("1")).alias("parameters"),
                                              F.create_map(F.lit("a"), F.lit(1.0)).alias("metrics"), F.col("id").alias("created_at"))
    assert ex.compare_table(runs).where(F.size("parameters") == 1).count() == 1200
    wide = ex.compare_table(runs, [str(i) for i in range(600)], ["a"])
    assert len(wide.columns) == 604 and wide.where("parameter_7 = '1'").count() == 1


# sweeps ------------------------------------------------------------------------------------

SPACE = {"lr": {"type": "log_uniform", "min": 1e-5, "max": 1e-1}, "batch_size": {"type": "choice", "values": [16, 32, 64]},
         "epochs": {"type": "int_range", "min": 5, "max": 50}, "u": {"type": "uniform"}, "none": {"type": "choice", "values": []}, "odd": {"type": "?"}}


def test_random_trials_stay_in_range_and_do_not_move(spark):
    trials = spark.range(3000)
    one = sweeps.random_trials(trials.repartition(3), SPACE, ["id"], 1)
    two = sweeps.random_trials(trials.repartition(11), SPACE, ["id"], 1)
    cols = ["id", "lr", "batch_size", "epochs", "u"]
    rows = one.select(cols).collect()
    assert sorted(rows) == sorted(two.select(cols).collect())
    assert all(1e-5 <= r["lr"] < 1e-1 and r["batch_size"] in (16, 32, 64) and 5 <= r["epochs"] <= 50 and 0 <= r["u"] < 1 for r in rows)
    assert {r["epochs"] for r in rows} == set(range(5, 51))
    below = sum(r["lr"] < 1e-3 for r in rows)
    assert 1350 < below < 1650
    assert one.where(F.col("none").isNotNull() | F.col("odd").isNotNull()).count() == 0


def test_grid_order_and_wrap(spark):
    space = {"b": {"type": "int_range", "min": 1, "max": 3}, "a": {"type": "choice", "values": ["x", "y"]}}
    got = [(r["a"], r["b"]) for r in sweeps.grid_trials(spark.range(8), space, "id").orderBy("id").collect()]
    assert got == [("x", 1), ("y", 1), ("x", 2), ("y", 2), ("x", 3), ("y", 3), ("x", 1), ("y", 1)]


def test_sweep_summary(spark):
    trials = spark.range(30).select(F.lit(1).alias("sweep_id"), F.col("id").alias("job_id"))
    _, summary = sweeps.sweep(trials, lambda t: t.withColumn("objective", F.abs(F.col("job_id") - 17).cast("double")), True)
    assert tuple(summary.first()) == (1, 30, 0.0, 17)


def test_user_trainer_is_partition_invariant(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    for n in (1, 9):
        out = learning.user_train(df.repartition(n), ["g"], ["x", "y"], learning.LinearTrainer(["x"], "y")).collect()
        slopes = {r["g"]: r["value"] for r in out if r["metric_name"] == "x"}
        assert set(slopes) == {"hot", "g0", "g1", "g2", "g3", "g4"} and all(abs(v - 2) < 1e-6 for v in slopes.values())


# catalog -----------------------------------------------------------------------------------


def test_registry_search(spark):
    rows = [("rain-gbm", "rain by hour", ["weather", "boosted"], "ida", "regression", "xgboost"), ("leaf-vit", "leaf shapes", ["plants"], "kai", "images", "jax")]
    index = spark.createDataFrame(rows, "name string, description string, tags array<string>, author string, category string, framework string")
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(cat.registry_search(index)) == ["leaf-vit", "rain-gbm"]
    assert names(cat.registry_search(index, "BOOSTED")) == ["rain-gbm"]
    assert names(cat.registry_search(index, framework="Jax")) == ["leaf-vit"]
    assert names(cat.registry_search(index, "rain", category="images")) == []


@pytest.mark.parametrize("q", ["a%b", "B%A", "a.b", "%", "", "_b", "a%b%a", "x%%y", "é%1", "a\\\\%b"])
def test_search_patterns_equal_ilike(spark, q):
    texts = ["ab", "ba", "a.b", "xAbby", "aab ba", "", "x--y", "É and 1", "1 é", "a%b", "aXbXa", None, "a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(cat.contains_pattern(F.col("t"), q).alias("a"), F.col("t").ilike(f"%{q}%").alias("b")).collect()
    assert [bool(r["a"]) for r in got] == [bool(r["b"]) for r in got]


def test_resolve_prefers_the_id(spark):
    rows = spark.createDataFrame([(1, "7", 1), (7, "x", 2), (8, "x", 3)], "id long, name string, created_at long")
    asked = spark.createDataFrame([("7",), ("x",), ("?",)], "request string")
    assert {r["request"]: r["id"] for r in cat.resolve(asked, rows).collect()} == {"7": 7, "x": 8, "?": None}


def test_log_page_cap(spark):
    logs = spark.range(30).select(F.lit(1).alias("job_id"), F.col("id").alias("logged_at"), F.lit("info").alias("level"), F.lit("m").alias("message"))
    assert [r["logged_at"] for r in cat.log_query(logs, job=1, limit=100, offset=10, cap=5).collect()] == [10, 11, 12, 13, 14]
    assert cat.log_query(logs, level="error").count() == 0


@pytest.mark.parametrize("ties, plain", [("up", None), ("even", lambda v, d: f"{v:.{d}f}")])
def test_fixed_text(spark, ties, plain):
    from decimal import ROUND_HALF_UP, Decimal

    values = [k / 40 for k in range(-400, 400)] + [7.55, 2.25, 2.35, 0.05, 1.005, 0.0755 * 100, 1e-9, 123456.25, 0.00005, 0.03125, 0.09375]
    for digits in (1, 4):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = [r[0] for r in df.select(display.fixed_text(F.col("v"), digits, ties)).collect()]
        half_up = lambda v, d: str(Decimal(v).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP))
        want = [(plain or half_up)(v, digits) for v in values]
        zero = {f"-{0:.{digits}f}": f"{0:.{digits}f}"}
        assert [zero.get(g, g) for g in got] == [zero.get(w, w) for w in want]


# display and text --------------------------------------------------------------------------


@pytest.mark.parametrize("seconds, text", [(12, "12s"), (184, "3m 4s"), (7500, "2h 5m"), (-5, "0s"), (0, "0s")])
def test_duration(spark, seconds, text):
    df = spark.createDataFrame([(seconds,)], "s int").select(F.lit("2024-01-01").cast("timestamp_ntz").alias("a"), "s")
    end = F.col("a") + F.make_dt_interval(secs=F.col("s"))
    assert df.select(display.duration_text(F.col("a"), end, F.col("a"))).first()[0] == text


def test_week_starts_on_sunday(spark):
    now = F.lit("2024-01-31 10:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([("2024-01-31 00:00:00",), ("2024-01-28 00:00:00",), ("2024-01-27 23:59:59",)], "t string")
    got = [r[0] for r in df.select(display.day_bucket(F.col("t").cast("timestamp_ntz"), now)).collect()]
    assert got == ["today", "week", "earlier"]


@pytest.mark.parametrize("size, text", [(None, "—"), (0, "—"), (1, "1.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1024**5, "1024.0 TB")])
def test_bytes(spark, size, text):
    assert spark.createDataFrame([(size,)], "s long").select(display.bytes_text(F.col("s"))).first()[0] == text


def test_blob(spark):
    source = 'a = 1\n_MODEL_B64 = """aGk=\n"""\nb = """x"""'
    df = spark.createDataFrame([(source,), ("none",)], "s string")
    got = [(bytes(r[0]) if r[0] else None, r[1]) for r in df.select(tx.embedded_blob(F.col("s")), tx.replace_blob(F.col("s"), F.lit(b"$1\\"))).collect()]
    assert got[0][0] == b"hi" and got[1] == (None, "none")
    assert got[0][1] == 'a = 1\n_MODEL_B64 = """JDFc"""\nb = """x"""'


@pytest.mark.parametrize(
    "block, payload",
    [('data: {"a": 1}', '{"a": 1}'), ("event: x\ndata: no\ndata: yes", '{"raw":"yes"}'), ("event: x", None), ("data:", None), ("id: 1\ndata:[1,2]\n", "[1,2]")],
)
def test_event_blocks(spark, block, payload):
    got = spark.createDataFrame([(block,)], "b string").select(tx.event_payload(F.col("b"))).first()[0]
    assert got == payload if payload is None else json.loads(got) == json.loads(payload)


def test_frameworks(spark):
    df = spark.createDataFrame([("import torch",), ("from sklearn import x",), ("scikit",), ("import keras",), ("print()",)], "s string")
    assert [r[0] for r in df.select(tx.framework_of(F.col("s"))).collect()] == ["pytorch", "sklearn", "sklearn", "tensorflow", "python"]


def test_scripts_are_stripped_across_lines(spark):
    df = spark.createDataFrame([("<p>a<SCRIPT x>\nb</script\n>c</Script>d</p>",)], "m string")
    assert df.select(tx.strip_script(F.col("m"))).first()[0] == "<p>ad</p>"


def test_checkpoint_keys(spark):
    df = spark.createDataFrame([(5,), (12345,), (None,)], "e int").select(tx.checkpoint_key(F.lit("m"), F.col("e")).alias("k"))
    rows = df.select("k", tx.checkpoint_epoch(F.col("k")).alias("e")).collect()
    assert [tuple(r) for r in rows] == [("models/m/checkpoints/epoch_0005.pt", 5), ("models/m/checkpoints/epoch_12345.pt", 12345), ("models/m/checkpoints/latest.pt", None)]
