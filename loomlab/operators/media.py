"""From frames to scenes, clips and scores.

A source may hold a large share of all frames, so nothing here needs one source in one task:
neighbors come from chunked windows, scene boundaries from composed chunk tables, and frames
meet their clips in a join on (source, time bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlab.functions.arrays import every, mean_abs_difference
from loomlab.functions.display import fixed_text
from loomlab.operators.ordered import ROWS, position, running

SCENE_CHUNK = 1024
FAN_IN = 256
TOP_PARTS = 4096
#: Bytes of frames that a window sorts at a time.
CHUNK_BYTES = 1 << 28


def indexed_frames(frames: DataFrame) -> DataFrame:
    """Frames with their zero-based index in the source."""
    return position(frames, ["source"], "frame_id", "idx")


def frame_differences(frames: DataFrame, stride: int = 1) -> DataFrame:
    """(source, idx, frame_id, diff): mean absolute change since the frame before, null for the first.

    Of each frame every ``stride``-th value is compared. Chunks hold as many frames as fit ``CHUNK_BYTES``.
    """
    looked = frames.select("source", "frame_id", every(F.col("pixels"), stride).alias("pixels"))
    size = looked.where(F.col("pixels").isNotNull()).select(F.size("pixels").alias("n")).first()
    rows = ROWS if size is None else max(1, min(ROWS, CHUNK_BYTES // (8 * max(1, size["n"]))))
    walked = running(
        looked, ["source"], "frame_id", {"_n": ("count", F.lit(1)), "_before": ("previous", F.col("pixels"))},
        measure=frames.select("frame_id"), rows=rows,
    )
    diff = mean_abs_difference(F.col("pixels"), F.col("_before"))
    return walked.select("source", (F.col("_n") - 1).alias("idx"), "frame_id", diff.alias("diff"))


# scene boundaries ----------------------------------------------------------------------------
#
# The greedy rule keeps a candidate frame if it lies at least ``gap`` frames after the last kept
# one. All that a chunk of frames needs from the past is the earliest frame allowed next, which
# is at most ``gap`` frames into the chunk. So a chunk is a table of gap + 1 entries (where it
# leaves that bound for each way of entering it), tables compose, and chunks of chunks are built
# until few are left per source. Going back down gives every chunk its true entry bound.


def _walk(marks: str, allowed: str, gap: int) -> str:
    return f"aggregate({marks}, {allowed}, (a, c) -> if(c >= a, c + {gap}L, a))"


def _step(entry: str, x: str, span: int) -> str:
    return f"element_at({x}.exits, int(greatest({entry} - {x}.part * {span}L, 0L)) + 1)"


def _entries(parts: DataFrame, gap: int, span: int, fan_in: int, levels: int) -> DataFrame:
    """(source, part, allowed): the earliest allowed frame on entering each part of ``span`` frames."""
    top = levels == 0
    up = parts.withColumn("_up", F.lit(0).cast("long") if top else F.expr(f"part div {fan_in}"))
    grouped = up.groupBy("source", "_up").agg(F.sort_array(F.collect_list(F.struct("part", "exits"))).alias("members"))
    if top:
        entered = grouped.withColumn("allowed", F.lit(gap).cast("long"))
    else:
        wide = span * fan_in
        fold = f"aggregate(members, _up * {wide}L + e, (a, x) -> {_step('a', 'x', span)})"
        exits = F.expr(f"transform(sequence(0L, {gap}L), e -> {fold})")
        above = grouped.select("source", F.col("_up").alias("part"), exits.alias("exits"))
        allowed = _entries(above, gap, wide, fan_in, levels - 1).withColumnRenamed("part", "_up")
        entered = grouped.join(allowed, ["source", "_up"])
    state = "named_struct('a', allowed, 'out', cast(array() as array<struct<part:bigint,allowed:bigint>>))"
    after = f"named_struct('a', {_step('s.a', 'x', span)}, 'out', array_append(s.out, named_struct('part', x.part, 'allowed', s.a)))"
    listed = entered.select("source", F.explode(F.expr(f"aggregate(members, {state}, (s, x) -> {after}).out")).alias("_m"))
    return listed.select("source", "_m.part", "_m.allowed")


def scene_boundaries(
    differences: DataFrame,
    threshold: float = 30.0,
    min_scene_len: int = 48,
    chunk: int = SCENE_CHUNK,
    fan_in: int = FAN_IN,
    levels: int | None = None,
) -> DataFrame:
    """(source, boundary) as frame indexes: the start, every scene change kept, and the end.

    Unless given, ``levels`` is what brings the longest source down to a few thousand parts.
    """
    gap = min_scene_len
    if levels is None:
        parts, levels = (differences.agg(F.max("idx")).first()[0] or 0) // chunk + 1, 0
        while parts > TOP_PARTS:
            parts, levels = parts // fan_in + 1, levels + 1
    marked = differences.where(F.col("diff") > threshold).select("source", "idx", F.expr(f"idx div {chunk}").alias("part"))
    marks = marked.groupBy("source", "part").agg(F.sort_array(F.collect_list("idx")).alias("marks"))
    walk = _walk("marks", f"part * {chunk}L + e", gap)
    tables = marks.withColumn("exits", F.expr(f"transform(sequence(0L, {gap}L), e -> {walk})"))
    entered = marks.join(_entries(tables.drop("marks"), gap, chunk, fan_in, levels), ["source", "part"])
    state = "named_struct('a', allowed, 'out', cast(array() as array<bigint>))"
    keep = f"if(c >= s.a, named_struct('a', c + {gap}L, 'out', array_append(s.out, c)), s)"
    kept = entered.select("source", F.explode(F.expr(f"aggregate(marks, {state}, (s, c) -> {keep}).out")).alias("boundary"))
    ends = differences.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    outer = ends.select("source", F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("boundary"))
    return kept.unionByName(outer)


def split_segments(boundaries: DataFrame, fps: float, clip_min: float = 2.0, clip_max: float = 10.0) -> DataFrame:
    """Clips (source, clip_id, start_frame, end_frame) cut from the segments between boundaries.

    Segments longer than ``clip_max`` seconds become pieces of that length and a rest; pieces
    below ``clip_min`` are dropped; clips are numbered in order within their source.
    """
    longest, shortest = int(clip_max * fps), clip_min * fps
    # both keys are frame indexes, which are dense: chunks of that many keys need no measuring
    walked = running(boundaries, ["source"], "boundary", {"start": ("previous", F.col("boundary"))}, ROWS)
    segments = walked.where(F.col("start").isNotNull()).withColumnRenamed("boundary", "end")
    pieces = segments.withColumn("_i", F.explode(F.expr(f"sequence(0L, (end - start - 1) div {longest}L)"))).select(
        "source",
        (F.col("start") + F.col("_i") * longest).alias("start_frame"),
        F.least(F.col("start") + (F.col("_i") + 1) * longest, F.col("end")).alias("end_frame"),
    )
    kept = pieces.where(F.col("end_frame") - F.col("start_frame") >= shortest)
    numbered = position(kept, ["source"], "start_frame", "_k", ROWS)
    return numbered.select("source", F.format_string("%06d", F.col("_k")).alias("clip_id"), "start_frame", "end_frame")


def frames_in_clips(clips: DataFrame, frames: DataFrame, longest: int) -> DataFrame:
    """Each frame with the clip whose [start_frame, end_frame) holds its index.

    Buckets as long as the longest clip make this an equi join; a clip meets at most two.
    """
    b = f"{longest}L"
    spread = clips.withColumn("_b", F.explode(F.expr(f"sequence(start_frame div {b}, (end_frame - 1) div {b})")))
    placed = frames.withColumn("_b", F.expr(f"idx div {b}"))
    joined = placed.join(spread, ["source", "_b"])
    inside = (F.col("idx") >= F.col("start_frame")) & (F.col("idx") < F.col("end_frame"))
    return joined.where(inside).drop("_b")


def keyframes(clips: DataFrame, frames: DataFrame, longest: int) -> DataFrame:
    """The first frame at or after the middle of each clip."""
    middle = F.expr("(start_frame + end_frame) div 2")
    late = frames_in_clips(clips, frames, longest).where(F.col("idx") >= middle)
    return late.groupBy("source", "clip_id", "start_frame", "end_frame").agg(
        F.min("idx").alias("idx"), F.min_by("frame_id", "idx").alias("frame_id")
    )


def motion_scores(clips: DataFrame, differences: DataFrame, longest: int) -> DataFrame:
    """Mean change between neighboring frames of each clip; 0 for clips without a pair."""
    pairs = frames_in_clips(clips, differences, longest).where(F.col("idx") > F.col("start_frame"))
    scores = pairs.groupBy("source", "clip_id").agg(F.avg("diff").alias("motion"))
    return clips.join(scores, ["source", "clip_id"], "left").withColumn("motion", F.coalesce("motion", F.lit(0.0)))


def valid_clips(scored: DataFrame, min_motion: float = 0.01, audible: DataFrame | None = None) -> DataFrame:
    """Clips that move enough and, where ``audible`` sources are given, have audio."""
    moving = scored.where(F.col("motion") >= min_motion)
    return moving if audible is None else moving.join(audible.select("source").distinct(), "source", "left_semi")


def frame_stride(frames: DataFrame, source_fps: float, target_fps: float, max_frames: int | None = None, clips: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """Every n-th frame of each source, n = source over target rate; at most ``max_frames`` where the caller says so.

    With ``clips`` (source, clip_id, start_frame, end_frame; none longer than ``longest``) frames are counted from the
    first one of each clip, and the limit is that of a clip.
    """
    step = max(1, int(source_fps / target_fps))
    placed = indexed_frames(frames)
    at = F.col("idx")
    if clips is not None:
        placed, at = frames_in_clips(clips, placed, longest), F.col("idx") - F.col("start_frame")
    kept = placed.where(at % step == 0)
    return kept if max_frames is None else kept.where(at < step * max_frames)


def seconds_text(seconds: Column) -> Column:
    """The shortest decimal form, never with an exponent."""
    plain = F.regexp_replace(seconds.cast("decimal(38,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((seconds == 0) | ((seconds >= 1e-3) & (seconds < 1e7)), seconds.cast("string")).otherwise(plain)


def clip_hash(source: Column, start: Column, end: Column) -> Column:
    text = F.concat_ws("_", source.cast("string"), seconds_text(start), seconds_text(end))
    return F.substring(F.md5(text), 1, 12)


def caption_records(clips: DataFrame, audio: Column) -> DataFrame:
    """Placeholder caption record of each clip (start_time, end_time in seconds)."""
    start, end = F.col("start_time"), F.col("end_time")
    return clips.select(
        clip_hash(F.col("source"), start, end).alias("clip_id"),
        F.concat(
            F.lit("Video clip from "), fixed_text(start, 1, "even"), F.lit("s to "), fixed_text(end, 1, "even"), F.lit("s")
        ).alias("visual"),
        audio.alias("audio"),
        F.lit("").alias("speech"),
        F.bround(end - start, 2).alias("duration_seconds"),
    )
