"""Queries over timelines, edit lists, signals and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import timeline as L

from . import Tables, register
from .queries_text import WORDS, timed_words

#: Segments of conversations, every fifth without width, and the time that they have to fill.
SEG = "(SELECT clip_id, line, speaker, t_start, CASE WHEN line % 5 = 4 THEN t_start ELSE t_end END AS t_end FROM b_segments)"


def segments(t: Tables):
    return t.b_segments.withColumn("t_end", F.expr("CASE WHEN line % 5 = 4 THEN t_start ELSE t_end END"))


@register("parse_timeline", f"""WITH s AS (SELECT clip_id, line, CASE WHEN line % 3 = 2 THEN ' ' ELSE speaker END AS prompt, floor(t_start * 1000 + 0.5) / 1000 AS t_start, floor(t_end * 1000 + 0.5) / 1000 AS t_end FROM {SEG} x)
SELECT clip_id, CASE WHEN clip_id % 4 = 0 THEN 'plain ' || clip_id ELSE 'g' || clip_id END AS global_text, CAST(CASE WHEN clip_id % 4 = 0 THEN 0 ELSE count(*) FILTER (trim(prompt) <> '' AND t_end > t_start) END AS INT) AS n_segments,
CASE WHEN clip_id % 4 <> 0 THEN sum(t_end - t_start) FILTER (trim(prompt) <> '' AND t_end > t_start) END AS covered FROM s GROUP BY clip_id""")
def parse_timeline(t: Tables):
    s = segments(t).withColumn("prompt", F.expr("CASE WHEN line % 3 = 2 THEN ' ' ELSE speaker END"))
    raw = s.groupBy("clip_id").agg(F.to_json(F.struct(F.concat(F.lit("g"), F.col("clip_id")).alias("global"), F.collect_list(F.struct("prompt", "t_start", "t_end")).alias("segments"))).alias("timeline"))
    raw = raw.withColumn("timeline", F.when(F.col("clip_id") % 4 == 0, F.concat(F.lit("plain "), "clip_id")).otherwise(F.col("timeline")))
    out = L.parse_timeline(raw)
    covered = F.aggregate("segments", F.lit(0.0), lambda a, x: a + x["t_end"] - x["t_start"])
    return out.select("clip_id", "global_text", F.size("segments").alias("n_segments"), F.when((F.col("clip_id") % 4 != 0) & (F.size("segments") > 0), covered).alias("covered"))


@register("timeline_rescale", f"""WITH w AS (SELECT *, greatest(t_end - t_start, 0) AS w FROM {SEG} s),
p AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY clip_id) > 0 THEN w * 60 / sum(w) OVER (PARTITION BY clip_id) ELSE 60.0 / count(*) OVER (PARTITION BY clip_id) END AS part FROM w),
c AS (SELECT *, sum(part) OVER (PARTITION BY clip_id ORDER BY t_start, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e, lead(line) OVER (PARTITION BY clip_id ORDER BY t_start, line) AS nxt FROM p)
SELECT clip_id, line, round(coalesce(lag(e) OVER (PARTITION BY clip_id ORDER BY t_start, line), 0), 6) AS new_start, round(CASE WHEN nxt IS NULL THEN 60 ELSE e END, 6) AS new_end FROM c""")
def timeline_rescale(t: Tables):
    return L.timeline_rescale(segments(t), F.lit(60.0)).select("clip_id", "line", F.round("new_start", 6).alias("new_start"), F.round("new_end", 6).alias("new_end"))


@register("timeline_adjacency", f"""SELECT clip_id, line, coalesce(abs(lag(t_end) OVER w - t_start) <= 0.001, false) AS touches_left, coalesce(abs(lead(t_start) OVER w - t_end) <= 0.001, false) AS touches_right,
round(t_start - coalesce(lag(t_end) OVER w, 0), 6) AS gap_before FROM {SEG} s WINDOW w AS (PARTITION BY clip_id ORDER BY t_start, line)""")
def timeline_adjacency(t: Tables):
    return L.timeline_adjacency(segments(t)).select("clip_id", "line", "touches_left", "touches_right", F.round("gap_before", 6).alias("gap_before"))


@register("snap_and_split", f"""WITH s AS (SELECT clip_id, line, floor(t_start * 24 + 0.5) / 24 AS a, floor(t_end * 24 + 0.5) / 24 AS b, floor((t_start + 2) * 24 + 0.5) / 24 AS c FROM {SEG} x),
u AS (SELECT clip_id, line, 0 AS part, a AS t_start, CASE WHEN c - a >= 0.04 AND b - c >= 0.04 THEN c ELSE b END AS t_end FROM s UNION ALL SELECT clip_id, line, 1, c, b FROM s WHERE c - a >= 0.04 AND b - c >= 0.04)
SELECT clip_id, line, part, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM u""")
def snap_and_split(t: Tables):
    return L.snap_and_split(segments(t), 24.0, F.col("t_start") + 2).select("clip_id", "line", "part", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"))


TOKENS = "(length(text) - length(replace(text, ' ', '')) + 1)"


@register("token_offsets", f"""SELECT clip_id, line, CAST(sum({TOKENS}) OVER w - {TOKENS} AS BIGINT) AS start_token, CAST(sum({TOKENS}) OVER w AS BIGINT) AS end_token
FROM b_lines WINDOW w AS (PARTITION BY clip_id ORDER BY line)""")
def token_offsets(t: Tables):
    n = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    return L.token_offsets(t.b_lines, n, ["line"]).select("clip_id", "line", "start_token", "end_token")


LAT = """CASE WHEN {0} <= 0 THEN 0.0::DOUBLE ELSE least(CASE WHEN {0} * 25 <= 1 THEN 1.0::DOUBLE ELSE 1 + ({0} * 25 - 1) / 8 END, 40.0::DOUBLE) END"""
RELAY = f"(SELECT clip_id, line, t_start / 20 AS t_start, t_end / 20 AS t_end FROM {SEG} z)"
LATENT = f"""lat AS (SELECT *, greatest(b - a, 0) AS len, (a + b) / 2 AS middle FROM (SELECT clip_id, line, {LAT.format('t_start')} AS a, {LAT.format('t_end')} AS b FROM {RELAY} r) x),
win AS (SELECT *, greatest(0, len - 2) AS hw, greatest((len - greatest(0, len - 2)) / sqrt(2 * ln(1 / 0.1)), 0.000001) AS sigma FROM lat)"""


def relay(t: Tables):
    return segments(t).select("clip_id", "line", (F.col("t_start") / 20).alias("t_start"), (F.col("t_end") / 20).alias("t_end"), F.lit(25.0).alias("fps"), F.lit(40).alias("latent_frames"), F.lit(0).alias("start_token"), F.lit(8).alias("end_token"))


@register("latent_time", f"WITH {LATENT} SELECT clip_id, line, round(a, 6) AS lat_start, round(b, 6) AS lat_end, round(hw, 6) AS half_window, round(sigma, 6) AS sigma FROM win")
def latent_time(t: Tables):
    out = L.latent_time(relay(t), "video")
    return out.select("clip_id", "line", *[F.round(c, 6).alias(c) for c in ("lat_start", "lat_end", "half_window", "sigma")])


@register("route_segments", f"""WITH {LATENT} SELECT clip_id, line, CAST(f AS INT) AS frame, round(-power(greatest(abs(f - middle) - hw, 0), 2) / (2 * sigma * sigma), 5) AS weight FROM win CROSS JOIN range(0, 40) g(f) WHERE len > 0""")
def route_segments(t: Tables):
    return L.route_segments(relay(t)).select("clip_id", "line", "frame", F.round("weight", 5).alias("weight"))


@register("legal_frames", """SELECT video_id, CAST(greatest(8 * round_even((greatest(round_even(total_frames / 7.0::DOUBLE * fps, 0), 1) - 1) / 8, 0) + 1, 9) AS INT) AS frames,
CAST(8 * ceil(floor(total_frames / 7.0::DOUBLE * fps) / 8) + 1 AS INT) AS audio_frames FROM b_videos""")
def legal_frames(t: Tables):
    v = t.b_videos.withColumn("seconds", F.col("total_frames") / 7.0)
    v = L.legal_frames(v, "audio").withColumnRenamed("frames", "audio_frames")
    return L.legal_frames(v).select("video_id", "frames", "audio_frames")


@register("edl_concat", """WITH k AS (SELECT *, CAST(trunc(start_trim * sample_rate) AS BIGINT) AS f, n_samples - CAST(trunc(end_trim * sample_rate) AS BIGINT) AS l FROM b_edl),
m AS (SELECT *, greatest(0, least(greatest(l, f) - f, n_samples - f)) AS kept FROM k WHERE greatest(0, least(greatest(l, f) - f, n_samples - f)) > 0),
p AS (SELECT *, kept + CASE WHEN lead(pos) OVER (PARTITION BY program_id ORDER BY pos) IS NULL THEN 0 ELSE CAST(trunc(pause_after * sample_rate) AS BIGINT) END AS len FROM m)
SELECT program_id, pos, CAST(coalesce(sum(len) OVER (PARTITION BY program_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start, kept AS kept_samples,
CAST(sum(len) OVER (PARTITION BY program_id) AS BIGINT) AS total_samples FROM p""")
def edl_concat(t: Tables):
    return L.edl_concat(t.b_edl).select("program_id", "pos", "out_start", "kept_samples", "total_samples")


TARGETS = """targets AS (SELECT * FROM (SELECT clip_id, line, sum(length(text)) OVER (PARTITION BY clip_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / sum(length(text)) OVER (PARTITION BY clip_id) AS share,
  lead(line) OVER (PARTITION BY clip_id ORDER BY line) AS nxt FROM b_lines) x WHERE nxt IS NOT NULL)"""


@register("proportional_cuts", f"WITH {TARGETS} SELECT clip_id, line, CAST(floor(share * 480000) AS BIGINT) AS cut_sample FROM targets")
def proportional_cuts(t: Tables):
    return L.proportional_cuts(t.b_lines, F.lit(480_000), F.length("text")).select("clip_id", "line", "cut_sample")


QUIET = """runs AS (SELECT clip_id, min(frame_idx) AS start_frame, count(*) AS frames FROM (SELECT *, rn - row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS g FROM
  (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS rn, avg(rms) OVER (PARTITION BY clip_id) AS m FROM b_signal) a WHERE rms < m * {ratio}) b GROUP BY clip_id, g HAVING count(*) >= {least})"""


@register("silence_regions", f"WITH {QUIET.format(ratio=0.6, least=3)} SELECT clip_id, start_frame, frames, CAST((start_frame + floor(frames / 2)) * 160 AS BIGINT) AS center FROM runs")
def silence_regions(t: Tables):
    return L.silence_regions(t.b_signal, 0.6, 3)


@register("silence_dp_cuts")
def silence_dp_cuts(t: Tables):
    centers = L.silence_regions(t.b_signal, 0.6, 2).select("clip_id", "center")
    targets = L.proportional_cuts(t.b_lines, F.lit(12_000), F.length("text")).select("clip_id", "line", "share", F.lit(12_000).alias("total"))
    return L.silence_dp_cuts(centers, targets)


def heard(t: Tables):
    return timed_words(t).where("pos % 9 <> 4").withColumn("word", F.expr("CASE WHEN pos % 11 = 3 THEN 'noise' ELSE word END"))


@register("align_words_to_lines")
def align_words_to_lines(t: Tables):
    return L.align_words_to_lines(heard(t).drop("line"), t.b_lines)


HOLES = f"WITH {WORDS}, h AS (SELECT clip_id, pos, t_start, t_end, CASE WHEN pos % 4 = 1 OR pos < 2 THEN NULL ELSE line END AS line FROM timed), f AS (SELECT *, coalesce(last_value(line IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(line IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled FROM h)"


def holes(t: Tables):
    return timed_words(t).withColumn("line", F.expr("CASE WHEN pos % 4 = 1 OR pos < 2 THEN NULL ELSE line END"))


@register("fill_word_lines", f"{HOLES} SELECT clip_id, pos, filled AS line FROM f")
def fill_word_lines(t: Tables):
    return L.fill_word_lines(holes(t)).select("clip_id", "pos", "line")


@register("line_boundaries", f"""{HOLES}, e AS (SELECT clip_id, filled AS line, arg_max(t_end, pos) AS e, arg_min(t_start, pos) AS s FROM f GROUP BY clip_id, filled),
n AS (SELECT l.clip_id, l.line, e, lead(l.line) OVER w AS nxt, lead(s) OVER w AS a FROM b_lines l LEFT JOIN e ON e.clip_id = l.clip_id AND e.line = l.line WINDOW w AS (PARTITION BY l.clip_id ORDER BY l.line)),
b AS (SELECT clip_id, line, CAST(trunc(coalesce((e + a) / 2, e, a) * 16000) AS BIGINT) AS boundary FROM n WHERE nxt IS NOT NULL)
SELECT clip_id, line, boundary FROM b WHERE clip_id NOT IN (SELECT clip_id FROM b WHERE boundary IS NULL)""")
def line_boundaries(t: Tables):
    return L.line_boundaries(L.fill_word_lines(holes(t)), t.b_lines, 16_000)


@register("trim_ranges", """WITH v AS (SELECT video_id, fps, total_frames::BIGINT AS total_frames, 48000 AS sample_rate, CAST(total_frames AS BIGINT) * 1600 AS n_samples, video_id % 9 AS i, CASE WHEN video_id % 4 = 0 THEN 0 ELSE video_id % 13 END AS o FROM b_videos),
e AS (SELECT *, greatest(0, least(CAST(round_even(i * fps, 0) AS BIGINT), total_frames)) AS a, greatest(0, least(CASE WHEN o = 0 THEN total_frames ELSE CAST(round_even(o * fps, 0) AS BIGINT) END, total_frames)) AS b,
greatest(0, least(i * sample_rate, n_samples)) AS c, greatest(0, least(CASE WHEN o = 0 THEN n_samples ELSE o * sample_rate END, n_samples)) AS d FROM v)
SELECT video_id, a AS start_frame, b AS end_frame, CASE WHEN a >= b THEN 1 ELSE b - a END AS frame_count, CASE WHEN c >= d THEN 1 ELSE d - c END AS sample_count FROM e""")
def trim_ranges(t: Tables):
    v = t.b_videos.withColumns({"total_frames": F.col("total_frames").cast("bigint"), "sample_rate": F.lit(48_000), "n_samples": F.col("total_frames").cast("bigint") * 1600, "i": (F.col("video_id") % 9).cast("double"), "o": F.expr("CAST(CASE WHEN video_id % 4 = 0 THEN 0 ELSE video_id % 13 END AS DOUBLE)")})
    return L.trim_ranges(v, F.col("fps"), F.col("i"), F.col("o")).select("video_id", "start_frame", "end_frame", "frame_count", "sample_count")


@register("waveform_peaks", """WITH n AS (SELECT clip_id, count(*) AS n FROM b_signal GROUP BY clip_id), c AS (SELECT clip_id, col, CAST(floor(col * n / 16.0) AS BIGINT) AS lo, CAST(floor((col + 1) * n / 16.0) AS BIGINT) AS hi FROM n CROSS JOIN range(0, 16) g(col))
SELECT c.clip_id, CAST(col AS INT) AS col, max(abs(rms)) AS peak FROM c JOIN b_signal s ON s.clip_id = c.clip_id AND s.frame_idx >= lo AND s.frame_idx < hi GROUP BY c.clip_id, col""")
def waveform_peaks(t: Tables):
    return L.waveform_peaks(t.b_signal, 16)


@register("token_padding", "SELECT stem, kind, CAST(ceil(token_len / 128.0) * 128 AS INT) AS padded_len, CAST(ceil(token_len / 128.0) * 128 - token_len AS INT) AS pad_left FROM b_artifacts")
def token_padding(t: Tables):
    return L.token_padding(t.b_artifacts, "token_len").where("mask IS NULL OR size(mask) = padded_len").select("stem", "kind", "padded_len", "pad_left")


@register("keyframe_hold", """WITH e AS (SELECT video_id, CAST(frame AS INT) AS keyframe, 'edit' || event_id AS edited FROM b_frames WHERE event_id % 3 = 0)
SELECT f.video_id, f.frame, coalesce(edited, 'src' || f.event_id) AS shown FROM b_frames f LEFT JOIN e ON e.video_id = f.video_id AND e.keyframe = floor(f.frame / 8)""")
def keyframe_hold(t: Tables):
    f = t.b_frames
    edits = f.where("event_id % 3 = 0").select("video_id", F.col("frame").alias("keyframe"), F.concat(F.lit("edit"), "event_id").alias("edited"))
    return L.keyframe_hold(f.select("video_id", "frame", F.concat(F.lit("src"), "event_id").alias("source")), edits, 8)
