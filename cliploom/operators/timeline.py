"""Segment timelines, routing, edit lists and line boundaries."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far apart two edges still touch, and the least length of a part after a split.
TOUCH, LEAST_PART = 1e-3, 0.04


def parse_timeline(raw: DataFrame, style: str | None = None, column: str = "timeline") -> DataFrame:
    """Global text, valid segments (a prompt that isn't blank, end after start) sorted by start, and the JSON written back, rounded to ms.

    Text that is no JSON object is a global text without segments; a style takes the place of the global text.
    """
    shape = "struct<global:string,segments:array<struct<prompt:string,t_start:double,t_end:double>>>"
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    parsed = F.when(text.startswith("{"), F.from_json(text, shape))
    ok = F.filter(parsed["segments"], lambda s: (F.trim(s["prompt"]) != "") & (F.coalesce(s["t_end"], F.lit(0.0)) > F.coalesce(s["t_start"], F.lit(0.0))))
    ms = lambda x: F.floor(F.coalesce(x, F.lit(0.0)) * 1000 + 0.5) / 1000
    clean = F.transform(F.array_sort(F.transform(ok, lambda s: F.struct(ms(s["t_start"]).alias("t_start"), ms(s["t_end"]).alias("t_end"), F.trim(s["prompt"]).alias("prompt")))), lambda s: s)
    none = F.array().cast("array<struct<t_start:double,t_end:double,prompt:string>>")
    whole = F.lit(style) if style else F.coalesce(parsed["global"], F.when(~text.startswith("{"), F.col(column)), F.lit(""))
    rows = raw.withColumns({"global_text": whole, "segments": F.coalesce(clean, none)})
    return rows.withColumn("written", F.to_json(F.struct(F.col("global_text").alias("global"), "segments")))


def timeline_rescale(segments: DataFrame, total: Column) -> DataFrame:
    """Segments laid end to end over exactly 0..total with their relative widths (equal ones if all are zero); the last ends at total."""
    order = Window.partitionBy("clip_id").orderBy("t_start", "line")
    whole = Window.partitionBy("clip_id")
    width = F.greatest(F.col("t_end") - F.col("t_start"), F.lit(0.0))
    rows = segments.withColumns({"_w": width, "_total": total})
    rows = rows.withColumns({"_sum": F.sum("_w").over(whole), "_n": F.count("*").over(whole)})
    rows = rows.withColumn("_part", F.when(F.col("_sum") > 0, F.col("_w") * F.col("_total") / F.col("_sum")).otherwise(F.col("_total") / F.col("_n")))
    rows = rows.withColumns({"new_end": F.sum("_part").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("line").over(order)})
    rows = rows.withColumn("new_start", F.coalesce(F.lag("new_end").over(order), F.lit(0.0)))
    return rows.withColumn("new_end", F.when(F.col("_next").isNull(), F.col("_total")).otherwise(F.col("new_end"))).drop("_w", "_total", "_sum", "_n", "_part", "_next")


def timeline_adjacency(segments: DataFrame, eps: float = TOUCH) -> DataFrame:
    """Whether each segment touches the one before and the one after it, and the gap before it."""
    order = Window.partitionBy("clip_id").orderBy("t_start", "line")
    before, after = F.lag("t_end").over(order), F.lead("t_start").over(order)
    near = lambda d: F.coalesce(F.abs(d) <= eps, F.lit(False))
    return segments.withColumns({"touches_left": near(before - F.col("t_start")), "touches_right": near(after - F.col("t_end")), "gap_before": F.col("t_start") - F.coalesce(before, F.lit(0.0))})


def snap_and_split(segments: DataFrame, fps: float, cut: Column) -> DataFrame:
    """Edges moved to frames (half up); a segment splits at `cut`, if both parts are long enough, and both keep the prompt."""
    snap = lambda x: F.floor(x * fps + 0.5) / fps
    rows = segments.withColumns({"t_start": snap(F.col("t_start")), "t_end": snap(F.col("t_end")), "_cut": snap(cut)})
    split = (F.col("_cut") - F.col("t_start") >= LEAST_PART) & (F.col("t_end") - F.col("_cut") >= LEAST_PART)
    one = lambda a, b: F.struct(F.col(a).alias("t_start"), F.col(b).alias("t_end"))
    parts = F.when(split, F.array(one("t_start", "_cut"), one("_cut", "t_end"))).otherwise(F.array(one("t_start", "t_end")))
    rest = [c for c in segments.columns if c not in ("t_start", "t_end")]
    return rows.select(*rest, F.posexplode(parts).alias("part", "_p")).select(*rest, "part", "_p.t_start", "_p.t_end")


def token_offsets(blocks: DataFrame, count: Column, order: list[str]) -> DataFrame:
    """Token range [start_token, end_token) of each block, the clip's blocks laid end to end."""
    w = Window.partitionBy("clip_id").orderBy(*order)
    end = F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("end_token", end.cast("bigint")).withColumn("start_token", F.col("end_token") - count)


def video_latent(seconds: Column, fps: Column, frames: Column) -> Column:
    """Latent index of a time: 0 at 0, at most 1 up to the first frame, then one for every 8 frames, at most `frames`."""
    at = seconds * fps
    index = F.when(at <= 1, F.lit(1.0)).otherwise(1 + (at - 1) / 8)
    return F.when((seconds <= 0) | (fps <= 0), 0.0).otherwise(F.least(index, frames.cast("double")))


def audio_latent(seconds: Column, rate: int, hop: int, factor: int, frames: Column, causal: bool) -> Column:
    """Latent index of a time in an audio stream, clamped to 0..frames."""
    mel = seconds * rate / hop
    index = 1 + (mel - 1) / max(factor, 1) if causal else mel / max(factor, 1)
    return F.when(seconds <= 0, 0.0).otherwise(F.least(F.greatest(index, F.lit(0.0)), frames.cast("double")))


def latent_time(df: DataFrame, stream: str, mode: str = "L-2", epsilon: float = 0.1, custom: int = 0, rate: int = 16_000, hop: int = 160, factor: int = 4, causal: bool = True) -> DataFrame:
    """Latent start and end of segments, their middle, half window and spread."""
    at = (lambda c: video_latent(F.col(c), F.col("fps"), F.col("latent_frames"))) if stream == "video" else (lambda c: audio_latent(F.col(c), rate, hop, factor, F.col("latent_frames"), causal))
    rows = df.withColumns({"lat_start": at("t_start"), "lat_end": at("t_end")})
    length = F.greatest(F.col("lat_end") - F.col("lat_start"), F.lit(0.0))
    rows = rows.withColumns({"lat_len": length, "middle": (F.col("lat_start") + F.col("lat_end")) / 2})
    window = F.greatest(F.lit(0.0), F.least(F.lit(float(custom)), F.floor("lat_len").cast("double"))) if mode == "custom" else F.greatest(F.lit(0.0), F.col("lat_len") - (1 if mode == "L-1" else 2))
    spread = max(float(np.sqrt(2 * np.log(1 / max(epsilon, 1e-6)))), 1e-6)
    rows = rows.withColumn("half_window", window)
    return rows.withColumn("sigma", F.greatest((F.col("lat_len") - F.col("half_window")) / spread, F.lit(1e-6)))


def route_segments(relay: DataFrame, epsilon: float = 0.1, mode: str = "L-2", stream: str = "video") -> DataFrame:
    """Weight of every latent frame for every segment: 0 inside the window around the middle, then falling as a Gaussian's log."""
    kept = relay.where((F.col("end_token") > F.col("start_token")) & (F.col("t_end") > F.col("t_start")))
    rows = latent_time(kept, stream, mode, epsilon).where("lat_len > 0")
    rows = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("latent_frames") - 1)))
    far = F.greatest(F.abs(F.col("frame") - F.col("middle")) - F.col("half_window"), F.lit(0.0))
    return rows.withColumn("weight", -(far * far) / (2 * F.col("sigma") * F.col("sigma")))


def legal_frames(df: DataFrame, mode: str = "nearest", seconds: str = "seconds", fps: str = "fps") -> DataFrame:
    """Frame counts of the form 8k+1: the nearest one, 9 at least; or, for the length of an audio track, the next one."""
    raw = F.greatest(F.bround(F.col(seconds) * F.col(fps)), F.lit(1.0))
    near = F.greatest(8 * F.bround((raw - 1) / 8) + 1, F.lit(9.0))
    up = 8 * F.ceil(F.floor(F.col(seconds) * F.col(fps)) / 8) + 1
    return df.withColumn("frames", (near if mode == "nearest" else F.greatest(up, F.lit(1))).cast("int"))


def edl_concat(edl: DataFrame, trailing_pause: bool = False, lead_in: float = 0.0) -> DataFrame:
    """Start and end sample of each clip of a program after trims (empty ones go) and pauses, and the program's length.

    The pause after the last clip counts only with trailing_pause; lead_in seconds come before the first.
    """
    rate = F.col("sample_rate")
    first = (F.col("start_trim") * rate).cast("bigint")
    last = F.col("n_samples") - (F.col("end_trim") * rate).cast("bigint")
    rows = edl.withColumns({"from_sample": first, "kept_samples": F.greatest(last, first) - first})
    rows = rows.withColumn("kept_samples", F.greatest(F.lit(0), F.least("kept_samples", F.col("n_samples") - F.col("from_sample")))).where("kept_samples > 0")
    order = Window.partitionBy("program_id").orderBy("pos")
    pause = (F.col("pause_after") * rate).cast("bigint")
    if not trailing_pause:
        pause = F.when(F.lead("pos").over(order).isNull(), F.lit(0)).otherwise(pause)
    rows = rows.withColumn("_len", F.col("kept_samples") + pause)
    begin = F.coalesce(F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.lit(lead_in) * rate).cast("bigint")
    total = F.sum("_len").over(Window.partitionBy("program_id")) + (F.lit(lead_in) * rate).cast("bigint")
    return rows.withColumns({"out_start": begin, "total_samples": total}).withColumn("out_end", F.col("out_start") + F.col("kept_samples")).drop("_len")


def proportional_cuts(lines: DataFrame, total: Column, weight: Column) -> DataFrame:
    """The sample at which each line but the last ends, if the whole is shared by weight."""
    w = Window.partitionBy("clip_id")
    upto = F.sum(weight).over(w.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumns({"share": upto / F.sum(weight).over(w), "_last": F.lead("line").over(w.orderBy("line"))})
    return rows.where(F.col("_last").isNotNull()).withColumn("cut_sample", F.floor(F.col("share") * total).cast("bigint")).drop("_last")


#: Frames of one block of a recording; blocks are searched side by side.
SIGNAL_BLOCK = 1 << 16


def _limits(signal: DataFrame, ratio: float) -> DataFrame:
    """(_clip, _limit): ratio x each clip's mean.

    A sum of doubles depends on its order, and so does a frame that equals the limit but for rounding. Clips that have
    such a frame, nearer to the limit than any two orders can be apart, are summed again in the order of their frames.
    """
    clip = F.col("clip_id").alias("_clip")
    rough = signal.groupBy(clip).agg((F.avg("rms") * ratio).alias("_limit"), (F.avg(F.abs("rms")) * abs(ratio) * (F.count("rms") + 4) * 1e-15).alias("_apart"))
    near = signal.join(rough, F.col("clip_id").eqNullSafe(F.col("_clip"))).where(F.abs(F.col("rms") - F.col("_limit")) <= F.col("_apart")).select("_clip").distinct()
    again = signal.join(near, F.col("clip_id").eqNullSafe(F.col("_clip")), "left_semi").where("rms IS NOT NULL")
    upto = Window.partitionBy("clip_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    summed = again.select(clip, "frame_idx", F.sum("rms").over(upto).alias("_sum")).groupBy("_clip").agg((F.max_by("_sum", "frame_idx") / F.count("*") * ratio).alias("_exact"))
    summed = summed.withColumnRenamed("_clip", "_same")
    return rough.join(summed, F.col("_clip").eqNullSafe(F.col("_same")), "left").select("_clip", F.coalesce("_exact", "_limit").alias("_limit"))


def silence_regions(signal: DataFrame, ratio: float = 0.1, min_len: int = 10, hop: int = 160) -> DataFrame:
    """Runs of at least min_len frames quieter than ratio x the clip's mean, with the sample of their centre.

    A long recording is cut into blocks. Runs inside a block are whole; those that touch its first or last frame are
    put together with their neighbours', at most two a block. So one recording is many tasks, and only what
    touches a border is ordered by clip.
    """
    means = _limits(signal, ratio)
    rows = signal.select("clip_id", "frame_idx", "rms", F.floor(F.col("frame_idx") / SIGNAL_BLOCK).alias("_block"))
    rows = rows.join(means, F.col("clip_id").eqNullSafe(F.col("_clip"))).withColumn("_quiet", F.col("rms") < F.col("_limit"))
    block = Window.partitionBy("clip_id", "_block")
    rows = rows.withColumns({"_rn": F.row_number().over(block.orderBy("frame_idx")), "_n": F.count("*").over(block)}).where("_quiet OR _rn = 1")
    # a block's first frame stays even where it is loud: it tells that the block has frames
    rows = rows.withColumn("_island", F.col("_rn") - F.row_number().over(Window.partitionBy("clip_id", "_block", "_quiet").orderBy("frame_idx")))
    runs = rows.groupBy("clip_id", "_block", "_quiet", "_island").agg(F.min("frame_idx").alias("start_frame"), F.count("*").alias("frames"), (F.min("_rn") == 1).alias("_head"), (F.max("_rn") == F.max("_n")).alias("_tail"))
    inner = runs.where("_quiet AND NOT _head AND NOT _tail").select("clip_id", "start_frame", "frames")
    order = Window.partitionBy("clip_id").orderBy("_block", "start_frame")
    edge = runs.where("_head OR _tail OR NOT _quiet")
    # a loud first frame has no run before it in its block, so it parts what is on both sides
    goes_on = F.col("_quiet") & F.col("_head") & F.lag(F.col("_quiet") & F.col("_tail")).over(order)
    edge = edge.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    joined = edge.where("_quiet").groupBy("clip_id", "_run").agg(F.min("start_frame").alias("start_frame"), F.sum("frames").alias("frames")).drop("_run")
    found = inner.unionByName(joined).where(F.col("frames") >= min_len)
    return found.withColumn("center", ((F.col("start_frame") + F.floor(F.col("frames") / 2)) * hop).cast("bigint"))


def best_cuts(centers: list[float], targets: list[float], total: float) -> list[int]:
    """Of ordered silences as many as there are targets, in order, with the least squared distance; targets themselves if there are too few."""
    n, k = len(targets), len(centers)
    if k < n:
        return [int(total * t) for t in targets]
    at = np.asarray(centers, float) / total
    best, back = (at - targets[0]) ** 2, []
    for t in targets[1:]:
        # cheapest end among the silences before each one, and the first at which it is reached
        low = np.minimum.accumulate(best)
        new = np.append(True, best[1:] < low[:-1])
        place = np.maximum.accumulate(np.where(new, np.arange(k), 0))
        back.append(np.append(-1, place[:-1]))
        best = np.append(np.inf, low[:-1]) + (at - t) ** 2
    out = [int(np.argmin(best))]
    for first in reversed(back):
        out.append(int(first[out[-1]]))
    return [int(centers[i]) for i in reversed(out)]


def silence_dp_cuts(centers: DataFrame, targets: DataFrame) -> DataFrame:
    """Cut samples of each clip; centers: (clip_id, center), targets: (clip_id, line, share, total)."""
    a = targets.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("line", "share"))).alias("targets"), F.max("total").alias("total"))
    b = centers.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.col("center").cast("double"))).alias("centers"))

    def cut(frames):
        for f in frames:
            rows = []
            for clip, want, total, have in zip(f["clip_id"], f["targets"], f["total"], f["centers"], strict=True):
                cuts = best_cuts([] if have is None else list(have), [w["share"] for w in want], float(total))
                rows += [(clip, w["line"], c) for w, c in zip(want, cuts, strict=True)]
            yield pd.DataFrame(rows, columns=["clip_id", "line", "cut_sample"])

    return a.join(b, "clip_id", "left").mapInPandas(cut, "clip_id long, line int, cut_sample long")


def align_lines(heard: list[str], lines: list[str]) -> tuple[list[int | None], float]:
    """The script line of each heard word, as far as the alignment tells, and the share of words that match."""
    plain = lambda w: re.sub(r"[^a-z0-9]", "", w.lower())
    script = [(p, i) for i, line in enumerate(lines) for w in line.split() if (p := plain(w))]
    words = [plain(w) for w in heard]
    out: list[int | None] = [None] * len(words)
    matched = 0
    for block in difflib.SequenceMatcher(None, words, [p for p, _ in script], autojunk=False).get_opcodes():
        tag, a, a_end, b, b_end = block
        if tag in ("equal", "replace"):
            for i in range(a, a_end):
                out[i] = script[b + (i - a) * (b_end - b) // (a_end - a)][1]
            matched += (a_end - a) * (tag == "equal")
    return out, matched / max(1, len(words), len(script))


def align_words_to_lines(words: DataFrame, lines: DataFrame, min_ratio: float = 0.4) -> DataFrame:
    """Words with the script line that each belongs to (null: none found); clips under min_ratio of matching words are left out."""
    shape = pa.schema([("clip_id", pa.int64()), ("pos", pa.int32()), ("word", pa.string()), ("t_start", pa.float64()), ("t_end", pa.float64()), ("line", pa.int32())])

    def align(said: pa.Table, script: pa.Table) -> pa.Table:
        if said.num_rows and script.num_rows:
            said, script = said.sort_by([("pos", "ascending"), ("word", "ascending")]), script.sort_by([("line", "ascending"), ("text", "ascending")])
            found, ratio = align_lines(said["word"].to_pylist(), [x or "" for x in script["text"].to_pylist()])
            if ratio >= min_ratio:
                line = script["line"].take(pa.array(found, pa.int64()))
                return pa.table([*(said[c].cast(shape.field(c).type) for c in shape.names[:-1]), line.cast(pa.int32())], schema=shape)
        return shape.empty_table()

    # clip by clip: a worker holds the words of one at a time
    heard = words.where("clip_id IS NOT NULL").select("clip_id", "pos", "word", "t_start", "t_end").groupBy("clip_id")
    return heard.cogroup(lines.where("clip_id IS NOT NULL").select("clip_id", "line", "text").groupBy("clip_id")).applyInArrow(align, "clip_id long, pos int, word string, t_start double, t_end double, line int")


def fill_word_lines(aligned: DataFrame) -> DataFrame:
    """Words without a line take that of the word before, else of the one after, else line 0."""
    order = Window.partitionBy("clip_id").orderBy("pos")
    before = F.last("line", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("line", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return aligned.withColumn("line", F.coalesce(before, after, F.lit(0)))


def line_boundaries(aligned: DataFrame, lines: DataFrame, sample_rate: int) -> DataFrame:
    """The sample between each line and the next: midway between the last word of one and the first of the other.

    With words on one side only, that side's edge; a clip with a boundary without words has no result.
    """
    edges = aligned.groupBy("clip_id", "line").agg(F.max_by("t_end", "pos").alias("_end"), F.min_by("t_start", "pos").alias("_start"))
    order = Window.partitionBy("clip_id").orderBy("line")
    rows = lines.select("clip_id", "line").join(edges, ["clip_id", "line"], "left")
    rows = rows.withColumns({"_next": F.lead("line").over(order), "_after": F.lead("_start").over(order)}).where(F.col("_next").isNotNull())
    second = F.coalesce((F.col("_end") + F.col("_after")) / 2, "_end", "_after")
    rows = rows.withColumn("boundary", (second * sample_rate).cast("bigint"))
    failed = F.max(F.col("boundary").isNull()).over(Window.partitionBy("clip_id"))
    return rows.withColumn("_failed", failed).where(~F.col("_failed")).select("clip_id", "line", "boundary")


def trim_ranges(clips: DataFrame, fps: Column, in_sec: Column, out_sec: Column) -> DataFrame:
    """Frame and sample ranges of a trim (out 0: to the end), clamped; an empty range is one blank frame."""

    def edge(seconds: Column, per: Column, total: Column, end: bool) -> Column:
        at = F.bround(seconds * per).cast("bigint")
        at = F.when(seconds == 0, total).otherwise(at) if end else at
        return F.greatest(F.lit(0), F.least(at, total))

    rows = clips.withColumns({"start_frame": edge(in_sec, fps, F.col("total_frames"), False), "end_frame": edge(out_sec, fps, F.col("total_frames"), True), "start_sample": edge(in_sec, F.col("sample_rate"), F.col("n_samples"), False), "end_sample": edge(out_sec, F.col("sample_rate"), F.col("n_samples"), True)})
    frames = F.when(F.col("start_frame") >= F.col("end_frame"), 1).otherwise(F.col("end_frame") - F.col("start_frame"))
    samples = F.when(F.col("start_sample") >= F.col("end_sample"), 1).otherwise(F.col("end_sample") - F.col("start_sample"))
    counted = F.when(F.col("total_frames").isNull(), F.bround(samples / F.col("sample_rate") * fps)).otherwise(frames)
    return rows.withColumns({"frame_count": counted.cast("bigint"), "sample_count": samples.cast("bigint")})


def waveform_peaks(signal: DataFrame, cols: int) -> DataFrame:
    """Largest absolute value of each of `cols` equal columns of a clip; column c covers frames floor(c*n/cols) to floor((c+1)*n/cols).

    Frames are counted and their peaks taken before anything is shuffled, however long the clip.
    """
    sizes = signal.groupBy(F.col("clip_id").alias("_clip")).agg(F.count("*").alias("_n"))
    col = F.floor(((F.col("frame_idx") + 1) * cols - 1) / F.col("_n"))
    rows = signal.join(sizes, F.col("clip_id").eqNullSafe(F.col("_clip")))
    return rows.groupBy("clip_id", col.cast("int").alias("col")).agg(F.max(F.abs("rms")).alias("peak"))


def token_padding(df: DataFrame, length: str, multiple: int = 128) -> DataFrame:
    """Padded length (the next multiple), how many go in front, and the mask; rows without a length stay, with nulls."""
    padded = (F.ceil(F.col(length) / multiple) * multiple).cast("int")
    return df.withColumns({"padded_len": padded, "pad_left": padded - F.col(length)}).withColumn("mask", F.concat(F.array_repeat(F.lit(False), F.col("pad_left")), F.array_repeat(F.lit(True), F.col(length))))


def keyframe_hold(frames: DataFrame, edits: DataFrame, every_nth: int) -> DataFrame:
    """Every frame with the edited keyframe that holds there (frame div every_nth), or its own source."""
    key = F.floor(F.col("frame") / every_nth).cast("int")
    held = edits.select("video_id", F.col("keyframe").alias("_k"), "edited")
    out = frames.withColumn("_key", key).join(held.withColumnRenamed("_k", "_key"), ["video_id", "_key"], "left")
    return out.withColumn("shown", F.coalesce("edited", "source")).drop("_key", "edited", "source")
