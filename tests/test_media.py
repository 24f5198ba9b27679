import random

import pytest
from pyspark.sql import functions as F

from loomlab.functions import arrays
from loomlab.operators import media


def greedy(diffs, threshold, gap):
    """The rule frame by frame."""
    out = [0]
    for i, d in enumerate(diffs):
        if d is not None and d > threshold and i - out[-1] >= gap:
            out.append(i)
    return out + [len(diffs)]


@pytest.fixture(scope="module")
def series():
    rng = random.Random(5)
    dense = [None] + [rng.random() for _ in range(999)]
    sparse = [None] + [0.9 if rng.random() < 0.02 else 0.1 for _ in range(700)]
    return {1: dense, 2: sparse, 3: [None], 4: [None] + [0.9] * 60, 5: [None] + [0.0] * 40}


@pytest.fixture(scope="module")
def differences(spark, series):
    rows = [(s, i, 1000 * s + i, d) for s, ds in series.items() for i, d in enumerate(ds)]
    return spark.createDataFrame(rows, "source int, idx long, frame_id long, diff double").repartition(6)


@pytest.mark.parametrize("gap", [1, 3, 17])
@pytest.mark.parametrize("chunk, fan_in, levels", [(32, 3, 2), (17, 4, 1), (1024, 256, None), (20, 2, 3)])
def test_boundaries_follow_the_greedy_rule(series, differences, gap, chunk, fan_in, levels):
    out = media.scene_boundaries(differences, 0.5, gap, chunk, fan_in, levels).collect()
    got = {s: sorted(r["boundary"] for r in out if r["source"] == s) for s in series}
    assert got == {s: greedy(d, 0.5, gap) for s, d in series.items()}


def test_clips_tile_their_segments(spark):
    bounds = spark.createDataFrame([("v", b) for b in (0, 48, 60, 400)], "source string, boundary long")
    clips = media.split_segments(bounds, fps=24.0, clip_min=0.5, clip_max=5.0).orderBy("clip_id").collect()
    assert [(c["clip_id"], c["start_frame"], c["end_frame"]) for c in clips] == [
        ("000000", 0, 48), ("000001", 48, 60), ("000002", 60, 180), ("000003", 180, 300), ("000004", 300, 400)]
    strict = media.split_segments(bounds, 24.0, clip_min=1.0, clip_max=5.0).collect()
    assert len(strict) == 4 and sorted(c["clip_id"] for c in strict)[-1] == "000003"


def test_exact_multiple_leaves_no_rest(spark):
    bounds = spark.createDataFrame([("v", 0), ("v", 240)], "source string, boundary long")
    assert media.split_segments(bounds, 24.0, 0.5, 5.0).count() == 2


def test_synthetic_video(spark):
    frames = spark.range(72).select(
        F.lit("a").alias("source"), F.col("id").alias("frame_id"),
        F.expr("transform(sequence(0, 15), p -> double((id * 7 + p * 13) % 256))").alias("pixels"))
    diffs = media.frame_differences(frames)
    clips = media.split_segments(media.scene_boundaries(diffs, 5.0, 12), 24.0, 0.5, 5.0).collect()
    assert clips and all((c["end_frame"] - c["start_frame"]) / 24 >= 0.5 for c in clips)


def test_motion_without_pairs_is_zero(spark, differences):
    clips = spark.createDataFrame([(1, "a", 5, 6), (4, "b", 0, 4)], "source int, clip_id string, start_frame long, end_frame long")
    got = {r["clip_id"]: r["motion"] for r in media.motion_scores(clips, differences, 10).collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(0.9)


def test_validation_needs_audio_only_if_asked(spark):
    scored = spark.createDataFrame([("a", "1", 0.5), ("b", "2", 0.5), ("a", "3", 0.001)], "source string, clip_id string, motion double")
    audible = spark.createDataFrame([("a",)], "source string")
    assert {r["clip_id"] for r in media.valid_clips(scored).collect()} == {"1", "2"}
    assert {r["clip_id"] for r in media.valid_clips(scored, 0.01, audible).collect()} == {"1"}


@pytest.mark.parametrize(
    "samples, label",
    [(None, "silence"), ([], "silence"), ([0.001] * 50, "silence"), ([0.1, -0.1] * 25, "speech"), ([0.2] * 50, "music"), ([0.01] * 50, "ambient"), ([0.5], "ambient")],
)
def test_audio_classes(spark, samples, label):
    df = spark.createDataFrame([(samples,)], "s array<double>")
    assert df.select(arrays.audio_class(F.col("s"))).first()[0] == label


def test_chunks(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],)], "s array<double>")
    got = [r[0] for r in df.select(arrays.chunks(F.col("s"), 2)).collect()]
    assert got == [[[1.0, 2.0], [3.0, 4.0], [5.0]], []]


def test_caption_and_hash(spark):
    import hashlib

    df = spark.createDataFrame([("v.mp4", 0.0, 3.0), ("v.mp4", 0.5, 12345678.25), ("v.mp4", 0.0001, 1.0)], "source string, start_time double, end_time double")
    rows = media.caption_records(df, F.lit("music")).collect()
    assert rows[0]["duration_seconds"] == 3.0 and rows[0]["visual"] == "Video clip from 0.0s to 3.0s"
    texts = ["v.mp4_0.0_3.0", "v.mp4_0.5_12345678.25", "v.mp4_0.0001_1.0"]
    assert [r["clip_id"] for r in rows] == [hashlib.md5(t.encode()).hexdigest()[:12] for t in texts]


def test_stride(spark):
    frames = spark.range(100).select(F.lit("a").alias("source"), (F.col("id") * 3).alias("frame_id"))
    got = sorted(r["idx"] for r in media.frame_stride(frames, 24.0, 8.0, max_frames=5).collect())
    assert got == [0, 3, 6, 9, 12]
