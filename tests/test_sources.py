import json
import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from loomlab.session import materialize, scratch
from loomlab.sources import csv_schema, datasets, objects, samples


def types_of(spark, path, **kw):
    rows = csv_schema.infer_csv_schema(spark, str(path), **kw).orderBy("position").collect()
    return {r["name"]: r["type"] for r in rows}, {r["row_count"] for r in rows}


def test_csv_schema(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('name,age,score,ok,gap,mix,plus\n"a, b",1,2,true,1,1,+5\nb,-2,2.5,FALSE,,x,1e3\nbad,row\nc, 3 ,1e5,true,3,2,inf\n')
    kinds, rows = types_of(spark, f)
    assert kinds == {"name": "string", "age": "int64", "score": "float64", "ok": "boolean", "gap": "string", "mix": "string", "plus": "float64"}
    assert rows == {3}
    assert types_of(spark, f, tolerant=True)[0]["gap"] == "int64"


def test_all_rows_decide_unless_told_otherwise(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text("x\n" + "\n".join(str(i) for i in range(100)) + "\nword\n")
    assert types_of(spark, f) == ({"x": "string"}, {101})
    assert types_of(spark, f, sample_rows=100) == ({"x": "int64"}, {101})


def test_text_survives_csv(spark, tmp_path):
    rows = [(1, 'line one\nline "two", still\n\nend'), (2, ""), (3, None), (4, "back\\slash, tab\t")]
    df = spark.createDataFrame(rows, "a long, b string")
    entry = datasets.save_dataset(df, str(tmp_path / "d"), "d", "csv")
    back = datasets.read_dataset(spark, entry["path"], "csv", df.schema)
    assert sorted(map(tuple, back.collect())) == rows
    assert types_of(spark, entry["path"]) == ({"a": "int64", "b": "string"}, {4})


@pytest.mark.parametrize(
    "cell, kind",
    [("", "string"), ("5", "int64"), ("+5", "int64"), ("9223372036854775807", "int64"), ("9223372036854775808", "float64"), ("1d", "string"), (".5", "float64"),
     ("5.", "float64"), ("NaN", "float64"), ("1e-3", "float64"), ("True", "boolean"), ("yes", "string"), ("2024-01-01", "string"), (" 7 ", "int64"), ("1 2", "string")],
)
def test_cell_types(spark, cell, kind):
    assert spark.createDataFrame([(cell,)], "c string").select(csv_schema.cell_type(F.col("c"))).first()[0] == kind


@pytest.mark.parametrize("kinds", [["int64", "float64", "int64"], ["int64", "string"], ["boolean", "int64"], ["float64"], ["boolean"]])
def test_lattice_does_not_depend_on_order(spark, kinds):
    def fold(seq):
        out = seq[0]
        for k in seq[1:]:
            out = out if out == k else ("float64" if {out, k} == {"int64", "float64"} else "string")
        return out

    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    bit = F.element_at(F.create_map(*[F.lit(x) for kv in csv_schema.BITS.items() for x in kv]), F.col("k"))
    got = df.agg(csv_schema.column_type(F.bit_or(bit))).first()[0]
    assert got == fold(kinds) == fold(kinds[::-1])


@pytest.mark.parametrize("fmt", datasets.TABULAR)
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'x "q", y'), (2, None), (3, "z")], "a long, b string")
    entry = datasets.save_dataset(df, str(tmp_path / "d"), "d", fmt)
    assert entry["row_count"] == 3 and entry["format"] == fmt
    catalog = spark.createDataFrame([("id-1", "d", fmt, entry["path"], 0)], "id string, name string, format string, path string, position int")
    for key in ("d", "id-1"):
        got = datasets.load_dataset(spark, catalog, key, schema=df.schema)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_json_arrays_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert datasets.read_dataset(spark, str(tmp_path / "a.json"), "json").count() == 2


def test_json_keeps_all_rows_in_any_layout(spark, tmp_path):
    df = spark.range(2000).select("id", F.concat(F.lit("line\n\"q\" [{"), "id").alias("text"))
    entry = datasets.save_dataset(df.repartition(3), str(tmp_path / "d"), "d", "json", array_bytes=5_000)
    files = [f for f in os.listdir(tmp_path / "d") if f.startswith("part-")]
    assert len(files) > 6 and sum(len(json.loads((tmp_path / "d" / f).read_text())) for f in files) == 2000  # whole arrays
    catalog = spark.createDataFrame([("1", "d", entry["format"], entry["path"], 0)], "id string, name string, format string, path string, position int")
    assert sorted(map(tuple, datasets.load_dataset(spark, catalog, "d").collect())) == sorted(map(tuple, df.collect()))
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    rows = [{"a": i, "b": None if i % 3 else f"x{i}"} for i in range(40)]
    (mixed / "lines.json").write_text("\n".join(map(json.dumps, rows[:20])) + "\n\n")
    (mixed / "pretty.json").write_text(json.dumps(rows[20:35], indent=2))
    (mixed / "array.json").write_text(json.dumps(rows[35:39]))
    (mixed / "object.json").write_text(json.dumps(rows[39], indent=1))
    (mixed / "empty.json").write_text("")
    for schema in (None, "a long, b string"):
        got = datasets.read_dataset(spark, str(mixed), "json", schema)
        assert sorted((r["a"], r["b"]) for r in got.collect()) == [(r["a"], r["b"]) for r in rows]


def test_arrays_are_held_once(spark):
    # 30 MB of JSON with a character of four bytes, which makes a Python string four bytes a character
    df = spark.range(0, 3_000, 1, 1).select("id", F.concat(F.repeat(F.lit("x"), 10_000), F.lit("\U0001f600")).alias("text"))
    task = datasets.json_arrays(df, 1 << 24)

    def peak(batches):
        import resource

        import pyarrow as pa

        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        sizes = [b.column("value")[0].as_buffer().size for b in gather(batches)]
        grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
        yield pa.RecordBatch.from_pydict({"mb": [grown // 1024], "longest": [max(sizes)], "n": [len(sizes)]})

    gather = datasets.gather_arrays(1 << 24)
    objects_ = df.select(F.to_json(F.struct("id", "text")).alias("value"))
    r = objects_.mapInArrow(peak, "mb long, longest long, n long").first()
    assert r["n"] == 2 and r["longest"] <= (1 << 24) and r["mb"] < 130
    back = task.select(F.explode(F.from_json("value", "array<struct<id:long,text:string>>")).alias("r")).select("r.*")
    assert back.exceptAll(df).count() == 0 and back.count() == 3_000


def test_csv_files_of_whole_lines_are_split(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "lines.csv").write_text("a,b\n" + "".join(f'{i},"x ""{i}"", y"\n' for i in range(20_000)))
    (tmp_path / "c" / "breaks.csv").write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(20_000, 20_100)))
    assert [[os.path.basename(f) for f in x] for x in datasets.files_by_lines(spark, str(tmp_path / "c"), datasets.csv_line)] == [["lines.csv"], ["breaks.csv"]]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        back = datasets.read_dataset(spark, str(tmp_path / "c"), "csv", "a long, b string")
        rows = back.withColumn("task", F.spark_partition_id()).collect()
        cells = csv_schema.read_cells(spark, str(tmp_path / "c")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert cells == 20_100
    assert sorted((r["a"], r["b"]) for r in rows) == [(i, f'x "{i}", y' if i < 20_000 else f"x\n{i}") for i in range(20_100)]
    assert len({r["task"] for r in rows if r["a"] < 20_000}) > 4 and len({r["task"] for r in rows if r["a"] >= 20_000}) == 1


def test_schema_reads_once(spark):
    cells = spark.range(10).select("id", F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    plan = csv_schema.infer_schema(cells, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "explode" not in plan.split("posexplode")[-1]
    empty = csv_schema.infer_schema(cells.limit(0), ["id"]).collect()
    assert [(r["name"], r["type"], r["row_count"]) for r in empty] == [("a", "string", 0), ("b", "string", 0)]


def test_lookup(spark, tmp_path):
    rows = [("1", "x", "csv", "p0", 0), ("x", "y", "csv", "p1", 1), ("2", "blob", "bin", "p2", 2)]
    catalog = spark.createDataFrame(rows, "id string, name string, format string, path string, position int")
    assert datasets.find_dataset(catalog, "x")["path"] == "p0"
    assert datasets.load_dataset(spark, catalog, "blob") == "p2"
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, catalog, "nothing")


@pytest.mark.parametrize("path, fmt", [("a.csv", "csv"), ("a.PARQUET", "parquet"), ("a.jsonl", "jsonl"), ("a.xls", "csv"), ("a", "csv")])
def test_format_by_extension(path, fmt):
    assert datasets.format_of(path) == fmt


def test_media_discovery(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.MP4", "b.txt", "in/c.webm"):
        (tmp_path / name).write_bytes(b"xx")
    found = objects.discover_media(spark, [{"path": str(tmp_path)}, {"type": "ftp"}])
    assert sorted(os.path.basename(r["path"]) for r in found.collect()) == ["a.MP4", "c.webm"]
    assert objects.discover_media(spark, []).count() == 0


def test_unknown_source_type(spark):
    with pytest.raises(ValueError):
        objects.open_source(spark, "tape")


def test_open_object_source(spark, tmp_path):
    (tmp_path / "k1").write_bytes(b"abc")
    rows = objects.open_source(spark, "s3", path=str(tmp_path), transform=lambda df: df.withColumn("n", F.length("data"))).collect()
    assert [(r["bytes"], bytes(r["data"]), r["n"]) for r in rows] == [(3, b"abc", 3)]


def test_open_video_source_decodes(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"abcd")
    decoder = lambda content: ((i, i % 2 == 0, bytes([b])) for i, b in enumerate(content))
    rows = objects.open_source(spark, "video", path=str(tmp_path), pattern="*.mp4", decoder=decoder).collect()
    assert [(r["pts"], bytes(r["frame"])) for r in rows] == [(0, b"a"), (2, b"c")]


def test_broken_files_become_error_rows(spark):
    def decoder(content):
        if not content:
            raise ValueError("empty")
        for i, b in enumerate(content):
            yield i, i % 2 == 0, bytes([b])

    files = spark.createDataFrame([("ok", bytearray(b"abc")), ("bad", bytearray(b""))], "path string, content binary")
    rows = {(r["source"], r["pts"], r["error"]) for r in objects.decode_keyframes(files, decoder).collect()}
    assert rows == {("ok", 0, None), ("ok", 2, None), ("bad", None, "empty")}


def test_sidecars_are_not_captions(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"clip_id": "b", "visual": "v"}, indent=2))
    (tmp_path / "a.json").write_text(json.dumps({"clip_id": "a", "visual": "w", "duration_seconds": 3.0}))
    (tmp_path / "a.audio.json").write_text(json.dumps({"audio_tokens": [[1, 2]], "codec": "c", "num_codebooks": 1}))
    captions = samples.read_captions(spark, str(tmp_path))
    joined = samples.with_sidecar(captions, samples.read_sidecars(spark, str(tmp_path)), "stem").collect()
    assert [(r["stem"], r["codec"]) for r in joined] == [("a", "c"), ("b", None)]


def test_published_defaults(spark, tmp_path):
    df = spark.createDataFrame([("a", None, None, None, None, None, "c", True), ("b", "v", "s", "t", 2.0, 30, "d", None)],
                               "clip_id string, visual string, audio string, speech string, duration_seconds double, fps int, codec string, has boolean")
    a, b = samples.publish_records(df, ["codec"], F.col("has")).orderBy("clip_id").collect()
    assert tuple(a) == ("a", "", "", "", 0.0, 24, "c") and tuple(b) == ("b", "v", "s", "t", 2.0, 30, None)
    with pytest.raises(ValueError):
        samples.write_records(df.limit(0), str(tmp_path / "x"), 10)


def test_tar_shards(spark, tmp_path):
    rows = spark.range(0, 500, 2).select(F.col("id").alias("key"), F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("audio"))
    placed = samples.assign_shards(rows.repartition(7), "key", 100, width=64)
    out = samples.write_tar_shards(placed, "key", {".json": "text", ".audio.json": "audio"}, str(tmp_path / "t")).collect()
    assert sorted(tuple(r)[:2] for r in out) == [("shard-000000.tar", 100), ("shard-000001.tar", 100), ("shard-000002.tar", 50)]
    members = list(samples.iterate_tar(str(tmp_path / "t" / "shard-000002.tar")))
    assert members[0] == ("400.json", b"t400") and [m[0] for m in members] == [f"{k}.json" for k in range(400, 500, 2)]


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch(spark, "x").startswith(named.rstrip("/"))
    assert scratch(spark, "x") != scratch(spark, "x")


def test_shards_of_bytes(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("key"), F.repeat(F.lit("x"), (F.col("id") * 37 % 900).cast("int")).alias("text"))
    placed = samples.shards_of_bytes(rows.repartition(5), "key", F.octet_length("text"), 5_000)
    out = samples.write_tar_shards(placed, "key", {".txt": "text"}, str(tmp_path / "t"))
    shards = {r["shard_name"]: r for r in out.collect()}
    assert all(r["bytes"] <= 5_000 for r in shards.values()) and sum(r["n"] for r in shards.values()) == 300
    listed = spark.createDataFrame([(n,) for n in shards], "shard_name string")
    found = {r["member"]: bytes(r["data"]).decode() for r in samples.read_tar_shards(listed, str(tmp_path / "t")).collect()}
    assert found == {f"{r['key']}.txt": r["text"] for r in rows.collect()}
    first = sorted(shards)[0]
    keys = [int(m[0].split(".")[0]) for m in samples.iterate_tar(str(tmp_path / "t" / first))]
    assert keys == list(range(len(keys)))
    with pytest.raises(ValueError):
        samples.shards_of_bytes(rows, "key", F.octet_length("text"), 1_000)
    samples.write_records(rows, str(tmp_path / "r"), shard_bytes=9_000, order="key")
    back = spark.read.parquet(str(tmp_path / "r"))
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length(F.to_json(F.struct("key", "text")))).alias("b")).collect()
    assert back.count() == 300 and all(r["b"] <= 9_000 for r in sizes) and len(sizes) > 10


def test_objects_in_ranges(spark, tmp_path):
    (tmp_path / "o").mkdir()
    big = bytes(range(256)) * 4000
    (tmp_path / "o" / "big.bin").write_bytes(big)
    (tmp_path / "o" / "none.bin").write_bytes(b"")
    (tmp_path / "o" / "gone.bin").write_bytes(b"abc")
    rows = objects.object_ranges(spark, str(tmp_path / "o"), "*.bin", 100_000)
    listed = rows.select("key", "offset", "bytes", "data", "error").collect()
    parts = sorted((r["offset"], bytes(r["data"])) for r in listed if r["key"].endswith("big.bin"))
    assert len(parts) == 11 and b"".join(d for _, d in parts) == big and max(len(d) for _, d in parts) == 100_000
    assert [bytes(r["data"]) for r in listed if r["key"].endswith("none.bin")] == [b""]


def test_members_of_shards_are_not_broadcast(spark, tmp_path):
    rows = spark.range(3_000).select(F.col("id").alias("key"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    placed = samples.assign_shards(rows, "key", 1_000, width=64)
    shards = materialize(spark, samples.write_tar_shards(placed, "key", {".txt": "text"}, str(tmp_path / "t")), "tar-list")
    members = samples.read_tar_shards(shards, str(tmp_path / "t"), ("bytes", "n"))
    sizes = {r["shard_name"]: (r["bytes"], r["n"]) for r in shards.collect()}
    got = members.collect()
    assert sorted((r["member"], bytes(r["data"]).decode()) for r in got) == sorted((f"{r['key']}.txt", r["text"]) for r in rows.collect())
    assert all((r["bytes"], r["n"]) == sizes[r["shard_name"]] for r in got)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan


def test_shards_of_the_query_are_not_joined(spark, folder):
    plan = queries()["tar_shards_of_bytes"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_sample_files_in_subfolders(spark, tmp_path):
    rows = [(i, json.dumps({"clip_id": str(i), "visual": "é\n" * i}), '{"codec": "c"}' if i % 3 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, caption string, sidecar string")
    assert samples.write_sample_files(df, "k", {".json": "caption", samples.SIDECAR_SUFFIX: "sidecar"}, str(tmp_path / "s")) == 800
    assert len(os.listdir(tmp_path / "s")) > 100 and all(os.path.isdir(tmp_path / "s" / x) for x in os.listdir(tmp_path / "s"))
    captions = samples.read_captions(spark, str(tmp_path / "s"))
    joined = samples.with_sidecar(captions, samples.read_sidecars(spark, str(tmp_path / "s")), "stem").collect()
    assert [(r["stem"], r["visual"], r["codec"]) for r in joined] == sorted((str(i), "é\n" * i, "c" if s else None) for i, _, s in rows)


def test_json_files_as_spark_reads_them(spark, tmp_path):
    files = {
        "arr.json": b'[{"clip_id":"1"},\n{"clip_id":"2","fps":3}]', "empty.json": b"", "blank.json": b" \n ", "bad.json": b"{not", "none.json": b"[]",
        "part.json": b'{"clip_id":"x","fps":"no","visual":"v"}', "null.json": b"null", "holes.json": b'[null,{"clip_id":"k"}]', "inv.json": b'{"clip_id":"\xff"}',
        "wide.json": '{"clip_id":"é"}'.encode("utf-16"), "a b%.json": b'{"clip_id":"s"}', "_hidden.json": b"{}", ".hidden.json": b"{}", "x.txt": b"{}",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = spark.read.schema(samples.CAPTION).json(str(tmp_path), multiLine=True, pathGlobFilter="*.json")
    want = want.withColumn("stem", F.regexp_extract("_metadata.file_path", r"([^/]*)\.json$", 1))
    got = samples.read_captions(spark, str(tmp_path))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_listing_is_that_of_spark(spark, tmp_path):
    for name in ("a.bin", "in/b.bin", "in/deep/c.bin", "in/_d.bin", ".e.bin", "_f/g.bin", "k=1/h.bin", "x.txt", "a1.bin", "sp ace.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    for pattern in (None, "*.bin", "?.bin", "{a,b}.*", "[a-b]?.bin", "[!a].bin"):
        want = objects.object_scan(spark, str(tmp_path), pattern).select("key", "bytes", "data")
        got = objects.object_ranges(spark, str(tmp_path), pattern, 100)
        assert sorted(map(tuple, got.select("key", "bytes", "data").collect())) == sorted(map(tuple, want.collect()))
        assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["bytes"] for r in objects.object_ranges(spark, str(tmp_path / "a.bin"), None, 3).collect()] == [5, 5]


def test_ranges_of_one_object_follow_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(objects, "BLOCK_BYTES", 40)
    for i in range(30):
        (tmp_path / f"{i}.bin").write_bytes(bytes(range(100)))
    dealt = objects._ranges(spark, str(tmp_path), "*.bin", 10).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["key"], r["offset"]) for r in dealt) == sorted((f"file:{tmp_path}/{i}.bin", at) for i in range(30) for at in range(0, 100, 10))
    assert all(len({r["task"] for r in dealt if (r["key"], r["offset"] // 40) == b}) == 1 for b in {(r["key"], r["offset"] // 40) for r in dealt})
    assert len({r["task"] for r in dealt}) == 4
    got = objects.object_ranges(spark, str(tmp_path), "*.bin", 10).collect()
    assert all(bytes(r["data"]) == bytes(range(r["offset"], r["offset"] + 10)) for r in got) and len(got) == 300


@pytest.mark.parametrize("size", [1, 7, 64, 5_000])
def test_lines_of_objects_split_anywhere(spark, tmp_path, size):
    (tmp_path / "l").mkdir()
    text = [("x" * (i * 7 % 23)) + str(i) for i in range(120)] + ["", "é", ""]
    (tmp_path / "l" / "a.txt").write_text("\n".join(text) + "\n")
    (tmp_path / "l" / "b.txt").write_text("no end")
    found = objects.object_lines(spark, str(tmp_path / "l"), "*.txt", size).collect()
    assert sorted(bytes(r["line"]).decode() for r in found) == sorted([*text, "no end"]) and not any(r["error"] for r in found)


def test_an_object_that_cannot_be_read_is_a_row(spark, tmp_path, monkeypatch):
    listed = spark.createDataFrame([(f"file:{tmp_path}/gone", 10, 0)], "key string, bytes bigint, offset bigint")
    monkeypatch.setattr(objects, "_ranges", lambda *a: listed)
    assert "FileNotFound" in objects.object_ranges(spark, "").first()["error"]
    assert "FileNotFound" in objects.object_lines(spark, "").first()["error"]
