"""Scene, clip and audio queries over frames and waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.functions import arrays
from loomlab.operators import media
from loomlab.plans.registry import query
from loomlab.session import materialize
from loomlab.tables import Lab

# The test frames change by 0.11 to 0.17 between neighbors, so the thresholds lie inside that.
THRESHOLD, MIN_SCENE, FPS, CLIP_MIN, CLIP_MAX = 0.145, 3, 2.0, 2.0, 4.0
LONGEST = int(CLIP_MAX * FPS)

FRAMES = """frames AS (SELECT label AS source, vec_id AS frame_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
  CAST(embedding AS DOUBLE[]) AS px, CAST(lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]) AS before FROM embeddings),
diffs AS (SELECT source, idx, frame_id, list_sum([abs(px[i] - before[i]) FOR i IN range(1, len(px) + 1)]) / len(px) AS diff FROM frames)"""

SCENES = f"""{FRAMES}, cand AS (SELECT source, idx FROM diffs WHERE diff > {THRESHOLD}),
starts AS (SELECT DISTINCT source, 0 AS pos FROM frames UNION SELECT source, idx FROM cand),
nxt AS (SELECT s.source, s.pos, min(c.idx) AS next FROM starts s JOIN cand c ON c.source = s.source AND c.idx >= s.pos + {MIN_SCENE} GROUP BY 1, 2),
kept(source, pos) AS (SELECT DISTINCT source, CAST(0 AS BIGINT) FROM frames UNION ALL SELECT k.source, n.next FROM kept k JOIN nxt n ON n.source = k.source AND n.pos = k.pos),
bounds AS (SELECT source, pos AS boundary FROM kept UNION SELECT source, count(*) FROM frames GROUP BY 1)"""

CLIPS = f"""{SCENES}, segs AS (SELECT source, lag(boundary) OVER (PARTITION BY source ORDER BY boundary) AS s, boundary AS e FROM bounds),
pieces AS (SELECT source, s + i * {LONGEST} AS start_frame, least(s + (i + 1) * {LONGEST}, e) AS end_frame
  FROM segs, unnest(range(0, (e - s - 1) // {LONGEST} + 1)) AS u(i) WHERE s IS NOT NULL),
clips AS (SELECT source, printf('%06d', row_number() OVER (PARTITION BY source ORDER BY start_frame) - 1) AS clip_id, start_frame, end_frame
  FROM pieces WHERE end_frame - start_frame >= {CLIP_MIN * FPS}),
inside AS (SELECT c.*, f.idx, f.frame_id, f.diff FROM clips c JOIN diffs f ON f.source = c.source AND f.idx >= c.start_frame AND f.idx < c.end_frame),
motion AS (SELECT c.source, c.clip_id, c.start_frame, c.end_frame, coalesce(avg(i.diff) FILTER (i.idx > i.start_frame), 0) AS motion
  FROM clips c LEFT JOIN inside i ON i.source = c.source AND i.clip_id = c.clip_id GROUP BY ALL)"""

WAVES = """waves AS (SELECT vec_id AS clip_id, label, CASE WHEN vec_id % 2 = 0 THEN list_sort(w) ELSE w END AS w
  FROM (SELECT vec_id, label, [CAST(x AS DOUBLE) * label / 9 FOR x IN embedding] AS w FROM embeddings)),
loud AS (SELECT clip_id, label, sqrt(list_sum([x * x FOR x IN w]) / len(w)) AS rms,
  list_sum([abs(sign(w[i + 1]) - sign(w[i])) FOR i IN range(1, len(w))]) / (len(w) - 1) / 2 AS zcr FROM waves),
sounds AS (SELECT clip_id, label, rms, zcr, CASE WHEN rms < 0.005 THEN 'silence' WHEN zcr > 0.15 THEN 'speech' WHEN rms > 0.05 AND zcr < 0.08 THEN 'music'
  ELSE 'ambient' END AS audio FROM loud)"""


def differences(lab: Lab):
    """Decoded once and written: several steps read it, and it is far smaller than the frames."""
    return materialize(lab.spark, media.frame_differences(lab.frames()), "differences")


def scenes(diffs):
    return media.scene_boundaries(diffs, THRESHOLD, MIN_SCENE)


def clips(lab: Lab, diffs):
    return materialize(lab.spark, media.split_segments(scenes(diffs), FPS, CLIP_MIN, CLIP_MAX), "clips")


@query("frame_diff", f"WITH {FRAMES} SELECT source, idx, frame_id, round(diff, 8) AS diff FROM diffs")
def frame_diff(lab: Lab):
    return differences(lab).withColumn("diff", F.round("diff", 8))


@query("scene_boundaries", f"WITH RECURSIVE {SCENES} SELECT source, boundary FROM bounds")
def scene_boundaries(lab: Lab):
    return scenes(differences(lab))


@query("split_segments", f"WITH RECURSIVE {CLIPS} SELECT source, clip_id, start_frame, end_frame FROM clips")
def split_segments(lab: Lab):
    return clips(lab, differences(lab))


@query("frames_in_clips", f"WITH RECURSIVE {CLIPS} SELECT source, clip_id, idx, frame_id FROM inside")
def frames_in_clips(lab: Lab):
    diffs = differences(lab)
    return media.frames_in_clips(clips(lab, diffs), diffs, LONGEST).select("source", "clip_id", "idx", "frame_id")


@query(
    "keyframe_pick",
    f"""WITH RECURSIVE {CLIPS} SELECT source, clip_id, min(idx) AS idx, arg_min(frame_id, idx) AS frame_id FROM inside
    WHERE idx >= (start_frame + end_frame) // 2 GROUP BY source, clip_id""",
)
def keyframe_pick(lab: Lab):
    diffs = differences(lab)
    return media.keyframes(clips(lab, diffs), diffs, LONGEST).select("source", "clip_id", "idx", "frame_id")


@query("motion_score", f"WITH RECURSIVE {CLIPS} SELECT source, clip_id, start_frame, end_frame, round(motion, 8) AS motion FROM motion")
def motion_score(lab: Lab):
    diffs = differences(lab)
    scored = media.motion_scores(clips(lab, diffs), diffs, LONGEST)
    return scored.withColumn("motion", F.round("motion", 8))


@query(
    "clip_validate",
    f"WITH RECURSIVE {CLIPS}, {WAVES} SELECT source, clip_id, round(motion, 8) AS motion FROM motion WHERE motion >= 0.14 AND source IN (SELECT label FROM sounds WHERE audio <> 'silence')",
)
def clip_validate(lab: Lab):
    diffs = differences(lab)
    scored = media.motion_scores(clips(lab, diffs), diffs, LONGEST)
    sounds = lab.waveforms().where(arrays.audio_class(F.col("samples")) != "silence")
    valid = media.valid_clips(scored, 0.14, sounds.select(F.col("label").alias("source")).distinct())
    return valid.select("source", "clip_id", F.round("motion", 8).alias("motion"))


@query("audio_class", f"WITH {WAVES} SELECT clip_id, round(rms, 8) AS rms, round(zcr, 8) AS zcr, audio FROM sounds")
def audio_class(lab: Lab):
    s = F.col("samples")
    return lab.waveforms().select(
        "clip_id", F.round(arrays.rms(s), 8).alias("rms"), F.round(arrays.zero_crossing_rate(s), 8).alias("zcr"), arrays.audio_class(s).alias("audio")
    )


@query(
    "audio_chunks",
    """SELECT vec_id AS clip_id, CAST(i AS INTEGER) AS chunk, CAST(len(embedding[i * 10 + 1:i * 10 + 10]) AS INTEGER) AS n,
    round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding[i * 10 + 1:i * 10 + 10]]), 8) AS total
    FROM embeddings, unnest(range(0, CAST(ceil(len(embedding) / 10) AS BIGINT))) AS u(i)""",
)
def audio_chunks(lab: Lab):
    samples = F.col("embedding").cast("array<double>")
    cut = lab.raw("embeddings").select(F.col("vec_id").alias("clip_id"), F.posexplode(arrays.chunks(samples, 10)).alias("chunk", "part"))
    return cut.select("clip_id", "chunk", F.size("part").alias("n"), F.round(arrays.total(F.col("part")), 8).alias("total"))


@query(
    "frame_stride",
    f"WITH {FRAMES} SELECT source, frame_id, idx FROM frames WHERE idx % 3 = 0",
)
def frame_stride(lab: Lab):
    return media.frame_stride(lab.frames().select("source", "frame_id"), 24.0, 8.0)


@query(
    "frame_stride_clips",
    f"WITH RECURSIVE {CLIPS} SELECT source, clip_id, frame_id, idx FROM inside WHERE (idx - start_frame) % 3 = 0 AND idx - start_frame < 15",
)
def frame_stride_clips(lab: Lab):
    """At most five frames of each clip, counted from the clip's first one."""
    cut = clips(lab, differences(lab))
    frames = lab.frames().select("source", "frame_id")
    return media.frame_stride(frames, 24.0, 8.0, 5, cut, LONGEST).select("source", "clip_id", "frame_id", "idx")


TIMED = f"SELECT *, start_frame / {FPS}::DOUBLE AS t0, end_frame / {FPS}::DOUBLE AS t1 FROM clips"
HASHED = "left(md5(source || '_' || CAST(t0 AS VARCHAR) || '_' || CAST(t1 AS VARCHAR)), 12)"


def timed(lab: Lab):
    return clips(lab, differences(lab)).withColumns({"start_time": F.col("start_frame") / FPS, "end_time": F.col("end_frame") / FPS})


@query("clip_id", f"WITH RECURSIVE {CLIPS} SELECT source, clip_id AS number, {HASHED} AS clip_id FROM ({TIMED})")
def clip_id(lab: Lab):
    return timed(lab).select(
        "source", F.col("clip_id").alias("number"), media.clip_hash(F.col("source"), F.col("start_time"), F.col("end_time")).alias("clip_id")
    )


def captions(lab: Lab):
    """Caption records whose audio is the waveform recorded with the clip's keyframe."""
    diffs = differences(lab)
    picked = media.keyframes(clips(lab, diffs), diffs, LONGEST)
    sounds = lab.waveforms().select(F.col("clip_id").alias("frame_id"), arrays.audio_class(F.col("samples")).alias("label"))
    heard = picked.join(sounds, "frame_id").withColumns(
        {"start_time": F.col("start_frame") / FPS, "end_time": F.col("end_frame") / FPS}
    )
    return media.caption_records(heard, F.col("label"))


CAPTIONS = f"""{CLIPS}, {WAVES}, picked AS (SELECT source, clip_id, start_frame, end_frame, arg_min(frame_id, idx) AS frame_id FROM inside
  WHERE idx >= (start_frame + end_frame) // 2 GROUP BY ALL),
captions AS (SELECT {HASHED} AS clip_id, printf('Video clip from %.1fs to %.1fs', t0, t1) AS visual, audio, '' AS speech, round(t1 - t0, 2) AS duration_seconds
  FROM (SELECT p.source, p.frame_id, start_frame / {FPS}::DOUBLE AS t0, end_frame / {FPS}::DOUBLE AS t1 FROM picked p) q JOIN sounds ON sounds.clip_id = q.frame_id)"""


@query("caption_record", f"WITH RECURSIVE {CAPTIONS} SELECT * FROM captions")
def caption_record(lab: Lab):
    return captions(lab)
