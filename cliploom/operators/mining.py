"""Chunks of source videos: grids, positions, validation, gates and better in-points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a chunk length by which the search moves, and by which it goes on.
FRACTIONS = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0)
FURTHER = (2.25, 2.5, 2.75, 3.0, 3.25, 3.5, 3.75, 4.0)


def chunk_grid(videos: DataFrame, frames: int, target_fps: float = 0.0, skip_start: float = 0.0, skip_end: float = 0.0, mode: str = "pool") -> DataFrame:
    """Frame range of every chunk: the source frames that give `frames` at target_fps, between the skipped ends.

    In pool mode only whole chunks count; in sequential mode a tail of half a chunk or more does, too.
    """
    fps = F.col("fps")
    first = F.greatest(F.lit(0), F.bround(skip_start * fps).cast("int"))
    last = F.greatest(first, F.col("total_frames") - F.bround(skip_end * fps).cast("int"))
    length = F.lit(frames)
    if target_fps > 0:
        length = F.when(F.abs(fps - target_fps) > 0.5, F.ceil(frames * (fps / target_fps)).cast("int") + 2).otherwise(length)
    rows = videos.withColumns({"first_frame": first, "last_frame": last, "_len": length})
    span = F.col("last_frame") - F.col("first_frame")
    n = F.floor(span / F.col("_len"))
    if mode != "pool":
        n = n + (span - n * F.col("_len") >= F.col("_len") / 2).cast("int")
    rows = rows.withColumn("_n", n).where("_n > 0").withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    start = F.col("first_frame") + F.col("chunk_idx") * F.col("_len")
    return rows.withColumns({"start_frame": start, "end_frame": F.least(start + F.col("_len"), "last_frame")}).drop("_len", "_n")


def positions_of(start: Column, end: Column, n: int) -> Column:
    n = max(2, n)
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (start + F.floor(i * (end - start) / n)).cast("int")), lambda p: (p >= start) & (p < end))


def sample_positions(chunks: DataFrame, n: int = 4) -> DataFrame:
    """A row for each sampled frame of a chunk: pos (from 0) and frame."""
    return chunks.select("*", F.posexplode(positions_of(F.col("start_frame"), F.col("end_frame"), n)).alias("pos", "frame"))


#: Frames of one mask of a video, in words of 64.
MASK = 1024


def masks(matches: DataFrame) -> DataFrame:
    """(video_id, mask, hits, unknowns): frames with a hit or an unknown as bits of 64-bit words, MASK frames a row. Frames without either have no row.

    Words are put together before the shuffle, so a frame costs a bit.
    """
    words = MASK // 64
    bit = F.expr("shiftleft(1L, cast(pmod(frame, 64) as int))")
    word = F.floor(F.pmod("frame", F.lit(MASK)) / 64)
    packed = lambda c: F.array(*[F.coalesce(F.bit_or(F.when(F.col(c) & (word == i), bit)), F.lit(0).cast("long")) for i in range(words)])
    rows = matches.where(F.col("hit") | F.col("unknown")).withColumn("mask", F.floor(F.col("frame") / MASK).cast("int"))
    return rows.groupBy("video_id", "mask").agg(packed("hit").alias("hits"), packed("unknown").alias("unknowns"))


def with_masks(ranges: DataFrame, matches: DataFrame, low: Column, high: Column) -> DataFrame:
    """ranges with `_masks`, a map from mask number to its words, of all frames from low to before high.

    A range meets the one or few masks that it touches, its halo included; no frame or position is a row.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in ranges.columns])
    numbers = F.sequence(F.floor(low / MASK).cast("int"), F.floor(F.greatest(low, high - 1) / MASK).cast("int"))
    # numbered before they are dealt to masks, so that a range's rows share a number
    asked = ranges.select(whole.alias("_row"), numbers.alias("_all")).withColumn("_id", F.monotonically_increasing_id()).withColumn("_mask", F.explode("_all")).drop("_all")
    found = masks(matches).withColumnsRenamed({"video_id": "_video", "mask": "_number"})
    joined = asked.join(found, (F.col("_row.video_id") == F.col("_video")) & (F.col("_mask") == F.col("_number")), "left")
    pair = F.when(F.col("_number").isNotNull(), F.struct("_number", F.struct("hits", "unknowns")))
    return joined.groupBy("_id").agg(F.first("_row").alias("_row"), F.map_from_entries(F.collect_list(pair)).alias("_masks")).select("_row.*", "_masks")


def _bit(frame: Column, kind: str) -> Column:
    """Whether the frame's bit is set in `_masks`."""
    words = F.try_element_at(F.col("_masks"), F.floor(frame / MASK).cast("int"))[kind]
    word = F.get(words, F.floor(F.pmod(frame, F.lit(MASK)) / 64).cast("int"))
    return F.coalesce(F.getbit(word, F.pmod(frame, F.lit(64)).cast("int")) == 1, F.lit(False))


def seen_in(start: Column, end: Column, n: int) -> Column:
    """struct(hits, unknowns, n_pos, first_hit, last_hit) of the n positions of a range, read from `_masks`."""
    # each step is bound once, as later ones use it several times, and a lambda's expressions are worked out anew at each use
    at = lambda p: F.struct(p.alias("p"), F.filter(p, lambda f: _bit(f, "hits")).alias("h"), F.filter(p, lambda f: _bit(f, "unknowns")).alias("u"))
    seen = F.transform(F.array(positions_of(start, end, n)), at)
    return F.transform(seen, lambda x: F.struct(F.size(x["h"]).cast("long").alias("hits"), F.size(x["u"]).cast("long").alias("unknowns"), F.size(x["p"]).cast("long").alias("n_pos"), F.array_min(x["h"]).alias("first_hit"), F.array_max(x["h"]).alias("last_hit")))[0]


def validate_ranges(ranges: DataFrame, matches: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """Hits, unknowns, positions and hit frames of ranges (keys, video_id, start_frame, end_frame).

    matches: (video_id, frame, hit, unknown); frames without a row count as read, without a hit. Empty ranges have no row.
    """
    rows = ranges.select(*keys, *[c for c in ("video_id", "start_frame", "end_frame") if c not in keys]).where("end_frame > start_frame")
    seen = with_masks(rows, matches, F.col("start_frame"), F.col("end_frame"))
    return seen.select(*keys, F.inline(F.array(seen_in(F.col("start_frame"), F.col("end_frame"), n))))


def validate_chunks(positions: DataFrame, sightings: DataFrame, unknown: DataFrame, target: list[str] | None = None) -> DataFrame:
    """For each chunk: hits, which positions have one, unknown positions, and how often each identity is seen.

    positions: (video_id, chunk_idx, pos, frame); sightings: (video_id, frame, identity); unknown: (video_id, frame).
    With a target, only its identities make a hit.
    """
    keys = ["video_id", "chunk_idx"]
    seen = positions.join(sightings, ["video_id", "frame"], "left")
    hit = F.col("identity").isNotNull() if target is None else F.coalesce(F.col("identity").isin(*target), F.lit(False))
    each = seen.groupBy(*keys, "pos", "frame").agg(F.bool_or(hit).alias("hit"))
    each = each.join(unknown.select("video_id", "frame", F.lit(True).alias("_u")).distinct(), ["video_id", "frame"], "left")
    flags = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hit"))), lambda x: x["hit"])
    out = each.groupBy(*keys).agg(F.count_if("hit").alias("hits"), flags.alias("has_hit"), F.count_if(F.col("_u").isNotNull()).alias("unknowns"), F.count("*").alias("n_pos"))
    counts = seen.where("identity IS NOT NULL").groupBy(*keys, "identity").agg(F.count_distinct("pos").alias("n"))
    counts = counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("identity", "n")))).alias("counts"))
    return out.join(counts, keys, "left")


def gate_limits(n_pos: Column, required: float, unknown: float) -> tuple[Column, Column]:
    """Hits that a range needs, and unknowns that it may have."""
    return F.greatest(F.lit(1), F.bround(required * n_pos)), F.bround(unknown * n_pos)


def chunk_gate(validated: DataFrame, required: float = 0.75, unknown: float = 0.25) -> DataFrame:
    """Why a chunk is rejected, or pass; 'skip' (not recorded) if only identities over their quota were seen."""
    need, may = gate_limits(F.col("n_pos"), required, unknown)
    seen = F.col("n_seen") > 0
    reason = F.when((F.col("hits") == 0) & ~seen, "no_known_character").when(F.col("hits") == 0, "skip").when(F.col("hits") < need, "insufficient_character_presence").when(F.col("unknowns") > may, "unknown_face").otherwise("pass")
    return validated.withColumn("reason", reason)


def _snap(x: Column) -> Column:
    return (F.floor(x.cast("int") / 8) * 8).cast("int")


def _move(part: Column, length: Column) -> Column:
    """Frames that a move by a part of a length takes."""
    size = _snap(length * F.abs(part))
    return F.when(part < 0, -size).otherwise(size)


def _moves(parts: Column, n: int, need_inside: bool = True) -> Column:
    """Array of the moved ranges with what is seen in them. parts: array of (k, part); with need_inside only moves that stay inside the video."""
    length = F.col("end_frame") - F.col("start_frame")
    moved = F.transform(parts, lambda m: F.struct(m["k"].alias("search_order"), _move(m["part"], length).alias("shift")))
    inside = lambda m: (F.col("start_frame") + m["shift"] >= F.col("first_frame")) & (F.col("end_frame") + m["shift"] <= F.col("last_frame"))
    if need_inside:
        moved = F.filter(moved, lambda m: inside(m) & (m["shift"] != 0))
    placed = lambda m: (F.col("start_frame") + m["shift"], F.col("end_frame") + m["shift"])
    return F.transform(moved, lambda m: F.struct(m["search_order"].alias("search_order"), m["shift"].alias("shift"), placed(m)[0].alias("start_frame"), placed(m)[1].alias("end_frame"), inside(m).alias("inside"), seen_in(*placed(m), n).alias("seen")))


def _array(parts: list[float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("part")) for k, p in enumerate(parts, 1)])


def _passes(seen: Column, required: float, unknown: float) -> Column:
    need, may = gate_limits(seen["n_pos"], required, unknown)
    return (seen["hits"] >= need) & (seen["unknowns"] <= may)


def candidates(chunks: DataFrame, matches: DataFrame, n: int = 4, required: float = 0.75, unknown: float = 0.25, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Every range that passes: the chunk itself (search_order 0) and its moves, if it has a hit and is not perfect already.

    All moves of a chunk are judged in its row, against the masks of the frames that they can reach.
    """
    length, reach = F.col("end_frame") - F.col("start_frame"), max(fractions)
    rows = with_masks(chunks.where("end_frame > start_frame"), matches, F.col("start_frame") - F.ceil(length * reach), F.col("end_frame") + F.ceil(length * reach))
    rows = rows.withColumn("_own", seen_in(F.col("start_frame"), F.col("end_frame"), n))
    passes = _passes(F.col("_own"), required, unknown)
    search = (F.col("_own.hits") > 0) & (F.col("_own.n_pos") >= 2) & ~(passes & (F.col("_own.hits") == F.col("_own.n_pos")))
    moved = F.filter(_moves(_array([-f for f in fractions] + list(fractions)), n), lambda m: _passes(m["seen"], required, unknown))
    own = F.struct(F.lit(0).alias("search_order"), F.lit(0).alias("shift"), F.col("start_frame"), F.col("end_frame"), F.lit(True).alias("inside"), F.col("_own").alias("seen"))
    none = F.filter(F.array(own), lambda _: F.lit(False))
    every = F.concat(F.when(passes, F.array(own)).otherwise(none), F.when(search, moved).otherwise(none))
    kept = [c for c in chunks.columns if c not in ("start_frame", "end_frame")]
    out = rows.select(*kept, F.explode(every).alias("_m"))
    return out.select(*kept, "_m.search_order", "_m.shift", "_m.start_frame", "_m.end_frame", "_m.seen.*")


def shift_search(chunks: DataFrame, matches: DataFrame, **how) -> DataFrame:
    """The best range of each chunk that has any: the first perfect move in search order, else most hits, fewest unknowns, smallest move.

    All moves to the left come before those to the right, and a perfect one ends the search, so the
    first perfect one wins even over a smaller move.
    """
    perfect = F.col("hits") == F.col("n_pos")
    rank = F.struct(-F.col("hits"), F.when(perfect, F.lit(0)).otherwise(F.col("unknowns")), F.when(perfect, F.lit(0)).otherwise(F.abs("shift")), F.col("search_order"))
    one = F.struct("shift", "hits", "unknowns", "n_pos", "start_frame", "end_frame", "first_frame", "last_frame")
    return candidates(chunks, matches, **how).groupBy("video_id", "chunk_idx").agg(F.min_by(one, rank).alias("b")).select("video_id", "chunk_idx", "b.*")


def shift_extend(best: DataFrame, matches: DataFrame, n: int = 4, required: float = 0.75, unknown: float = 0.25) -> DataFrame:
    """Further moves of chunks whose best one is the farthest and not perfect, as long as each is inside, passes, has no fewer hits than the one before, and none was perfect."""
    length = F.col("end_frame") - F.col("start_frame")
    far = best.where((F.col("shift") != 0) & (F.abs("shift") >= _snap(length * 2.0)) & (F.col("hits") < F.col("n_pos")))
    rows = far.select("video_id", "chunk_idx", "first_frame", "last_frame", (F.col("start_frame") - F.col("shift")).alias("start_frame"), (F.col("end_frame") - F.col("shift")).alias("end_frame"), F.signum("shift").alias("_sign"), F.col("hits").alias("_hits"))
    reach = F.ceil(length * max(FURTHER))
    rows = with_masks(rows, matches, F.col("start_frame") - F.when(F.col("_sign") < 0, reach).otherwise(0), F.col("end_frame") + F.when(F.col("_sign") > 0, reach).otherwise(0))
    parts = F.transform(_array(list(FURTHER)), lambda m: F.struct(m["k"].alias("k"), (m["part"] * F.col("_sign")).alias("part")))
    rows = rows.withColumn("_tried", _moves(parts, n, need_inside=False))
    before = lambda i: F.when(i == 0, F.col("_hits")).otherwise(F.get("_tried", i - 1)["seen"]["hits"])
    done = lambda i: F.coalesce(F.get("_tried", i - 1)["seen"]["hits"] == F.get("_tried", i - 1)["seen"]["n_pos"], F.lit(False))
    good = lambda m, i: m["inside"] & _passes(m["seen"], required, unknown) & (m["seen"]["hits"] >= before(i)) & ~F.when(i == 0, F.lit(False)).otherwise(done(i))
    rows = rows.withColumn("_good", F.transform("_tried", good))
    end = F.coalesce(F.nullif(F.array_position("_good", F.lit(False)), F.lit(0)), F.size("_tried") + 1).cast("int") - 1
    out = rows.select("video_id", "chunk_idx", F.explode(F.slice("_tried", F.lit(1), end)).alias("_m"))
    return out.select("video_id", "chunk_idx", "_m.search_order", "_m.shift", "_m.seen.hits", "_m.seen.unknowns", "_m.seen.n_pos")


def hit_centered_probe(cands: DataFrame, chunks: DataFrame, matches: DataFrame, n: int = 4, required: float = 0.75, unknown: float = 0.25) -> DataFrame:
    """One more move for chunks without a perfect range: centred on the hit frames of ranges within a chunk length of the best one."""
    keys = ["video_id", "chunk_idx"]
    best = cands.groupBy(*keys).agg(F.min_by("shift", F.struct(-F.col("hits"), F.col("unknowns"), F.abs("shift"), F.col("search_order"))).alias("_best"), F.max((F.col("hits") == F.col("n_pos")).cast("int")).alias("_perfect"), F.collect_set("shift").alias("_tried")).where("_perfect = 0")
    length = F.col("end_frame") - F.col("start_frame")
    near = cands.join(best, keys).where(F.abs(F.col("shift") - F.col("_best")) <= length)
    pooled = near.groupBy(*keys, "_best", "_tried").agg(F.min("first_hit").alias("_a"), F.max("last_hit").alias("_b"))
    rows = chunks.join(pooled, keys)
    center = F.floor((F.col("_a") + F.col("_b")) / 2) - (F.col("start_frame") + F.floor(length / 2))
    rows = rows.withColumn("shift", (F.bround(center / 8) * 8).cast("int")).where((F.col("shift") != 0) & ~F.array_contains("_tried", F.col("shift")))
    rows = rows.withColumns({"start_frame": F.col("start_frame") + F.col("shift"), "end_frame": F.col("end_frame") + F.col("shift")})
    rows = rows.where((F.col("start_frame") >= F.col("first_frame")) & (F.col("end_frame") <= F.col("last_frame")))
    out = rows.select(*keys, "shift", "start_frame", "end_frame").join(validate_ranges(rows, matches, keys, n), keys)
    need, may = gate_limits(F.col("n_pos"), required, unknown)
    return out.where((F.col("hits") >= need) & (F.col("unknowns") <= may)).select(*keys, "shift", "hits", "unknowns", "n_pos")


def consumed_neighbors(chosen: DataFrame) -> DataFrame:
    """Chunks that a moved range covers: as many in its direction as it has begun; they leave the pool, but not for the ledger."""
    length = F.col("end_frame") - F.col("start_frame")
    n = F.ceil(F.abs("shift") / length).cast("int")
    rows = chosen.where("shift <> 0").withColumn("_k", F.explode(F.sequence(F.lit(1), n)))
    return rows.select("video_id", (F.col("chunk_idx") + F.when(F.col("shift") > 0, F.col("_k")).otherwise(-F.col("_k"))).alias("chunk_idx")).where("chunk_idx >= 0").distinct()


def resume_position(videos: DataFrame, progress: DataFrame, clips: DataFrame) -> DataFrame:
    """Next chunk of each video: as the progress record says, else after the last extracted one, else 0."""
    last = clips.groupBy("video_id").agg((F.max("chunk_idx") + 1).alias("_after"))
    out = videos.join(progress, "video_id", "left").join(last, "video_id", "left")
    return out.withColumn("next_chunk", F.coalesce("next_idx", "_after", F.lit(0))).drop("next_idx", "_after")


def extraction_plan(chunks: DataFrame, target_frames: int, target_fps: float = 0.0) -> DataFrame:
    """Start second, duration, output frames and audio seconds of each chunk."""
    n, fps = F.col("end_frame") - F.col("start_frame"), F.col("fps")
    convert = (F.abs(fps - target_fps) > 0.5) if target_fps > 0 else F.lit(False)
    return chunks.withColumns({"start_sec": F.round(F.col("start_frame") / fps, 4), "duration_sec": F.round(n / fps, 4), "out_frames": F.when(convert, target_frames).otherwise(n), "audio_sec": F.round(F.when(convert, F.lit(target_frames / (target_fps or 1))).otherwise(n / fps), 4)})
