"""Detections, references, voices and identity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.ranking import placed
from cliploom.functions.vectors import with_best_reference, with_references_over, with_two_nearest


def detection_confidence_split(det: DataFrame, keep: float = 0.5, unknown: float = 0.85) -> DataFrame:
    """Detections of at least `keep`, with whether they can count as unknown faces."""
    return det.where(F.col("det_score") >= keep).withColumn("can_be_unknown", F.col("det_score") >= unknown)


def match_face_refs(det: DataFrame, refs: DataFrame, threshold: float = 0.40) -> DataFrame:
    """The most similar reference of each detection, if it is similar enough; of equal ones the last."""
    best = with_best_reference(det, "embedding", refs, "_b").drop("embedding")
    ok = F.col("_b.sim") >= threshold
    return best.withColumns({"similarity": F.col("_b.sim"), "matched": F.when(ok, F.col("_b.trigger_name"))}).drop("_b")


def match_scene_refs(frames: DataFrame, refs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """A row for every reference at least `threshold` similar to a whole frame."""
    found = with_references_over(frames, "embedding", refs, threshold, "_m").withColumn("_m", F.explode("_m"))
    return found.select(*[c for c in frames.columns if c != "embedding"], "_m.trigger_name", F.col("_m.sim").alias("similarity"))


def unknown_faces(det: DataFrame, refs: DataFrame, threshold: float = 0.40, min_score: float = 0.85) -> DataFrame:
    """For each frame, whether a confident detection is like no reference; never, if there are no references."""
    best = with_best_reference(det, "embedding", refs, "_b").drop("embedding")
    odd = (F.col("det_score") >= min_score) & (F.col("_b.sim") < threshold)
    return best.groupBy("video_id", "frame").agg(F.coalesce(F.bool_or(odd), F.lit(False)).alias("has_unknown"))


def attribute_speakers(segments: DataFrame, voices: DataFrame, max_dist: float = 0.70, margin: float = 0.05, bonus: float = 0.15, least: float = 0.3) -> DataFrame:
    """Speaker of each segment: the nearest voice (on-screen ones are `bonus` nearer), if near enough and clearly nearer than the next.

    segments: embedding, on_screen (names, may be null), t_start, t_end. Short segments are unknown. Only
    the two nearest voices of a segment are kept, and nothing is shuffled.
    """
    rows = with_two_nearest(segments, "embedding", "on_screen", voices, bonus, "_n").drop("embedding")
    first, second = F.get("_n", F.lit(0)), F.get("_n", F.lit(1))
    clear = F.coalesce(second["d"] - first["d"] >= margin, F.lit(True))
    ok = (F.col("t_end") - F.col("t_start") >= least) & (first["d"] <= max_dist) & clear
    return rows.withColumns({"distance": first["d"], "speaker": F.when(F.coalesce(ok, F.lit(False)), first["name"]).otherwise("unknown")}).drop("_n")


def associate_boxes(boxes: DataFrame, det: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """The detection of the same frame that overlaps each requested box most, if enough; of equal ones the first."""
    d = det.select("video_id", "frame", "det_id", *[F.col(c).alias(f"_{c}") for c in "xywh"])
    wide = lambda a, w, b, v: F.greatest(F.lit(0), F.least(F.col(a) + F.col(w), F.col(b) + F.col(v)) - F.greatest(F.col(a), F.col(b)))
    both = wide("x", "w", "_x", "_w") * wide("y", "h", "_y", "_h")
    pairs = boxes.join(d, ["video_id", "frame"]).withColumn("iou", both / (F.col("w") * F.col("h") + F.col("_w") * F.col("_h") - both))
    best = pairs.where(F.col("iou") >= min_iou).groupBy("box_id").agg(F.min_by(F.struct("det_id", "iou"), F.struct(-F.col("iou"), F.col("det_id"))).alias("b"))
    return best.select("box_id", "b.det_id", "b.iou")


def largest_face(det: DataFrame) -> DataFrame:
    """The detection of largest area of each frame; of equal ones the first."""
    return det.groupBy("video_id", "frame").agg(F.min_by("det_id", F.struct(-F.col("w") * F.col("h"), F.col("det_id"))).alias("det_id"), F.max(F.col("w") * F.col("h")).alias("area"))


def single_identity_gate(positions: DataFrame, det: DataFrame, target: list[float], threshold: float = 0.40) -> DataFrame:
    """Whether the first position with a face shows the target: pass, face_mismatch or no_face.

    positions: (video_id, chunk_idx, pos, frame). The largest face of that frame decides.
    """
    dot = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.array(*[F.lit(float(x)) for x in target]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    faces = det.groupBy("video_id", "frame").agg(F.min_by(dot, F.struct(-F.col("w") * F.col("h"), F.col("det_id"))).alias("sim"))
    rows = positions.join(faces, ["video_id", "frame"], "left")
    out = rows.groupBy("video_id", "chunk_idx").agg(F.min_by("sim", F.when(F.col("sim").isNotNull(), F.col("pos"))).alias("similarity"))
    return out.withColumn("reason", F.when(F.col("similarity").isNull(), "no_face").when(F.col("similarity") < threshold, "face_mismatch").otherwise("pass"))


def identity_counts(members: DataFrame) -> DataFrame:
    """Appearances of each identity and the clips they are in, and the same of all, marked is_total. members: (clip_id, identity).

    Members without an identity are counted as one, too, in a row that is no total.
    """
    return members.rollup("identity").agg(F.count("*").alias("appearances"), F.count_distinct("clip_id").alias("clips"), (F.grouping("identity") == 1).alias("is_total"))


def dominant_identities(sightings: DataFrame, keys: list[str], ratio: float = 0.5) -> DataFrame:
    """Identities of each chunk that are seen at `ratio` of the most frequent one's positions at least, sorted."""
    seen = sightings.groupBy(*keys, "identity").agg(F.count_distinct("pos").alias("n"))
    top = seen.groupBy(*keys).agg(F.max("n").alias("top"), F.collect_list(F.struct("identity", "n")).alias("all"))
    kept = F.filter("all", lambda x: x["n"] >= F.col("top") * ratio)
    return top.select(*keys, F.sort_array(F.transform(kept, lambda x: x["identity"])).alias("identities"))


def relabel_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changes between two labelings of (clip_id, identity): appearances added and removed, and clips changed.

    A row for each identity with a change (null is one), and one for all, marked is_total.
    """
    same = lambda df: df.select(F.col("clip_id").alias("_c"), F.col("identity").alias("_i"))
    both = F.col("clip_id").eqNullSafe(F.col("_c")) & F.col("identity").eqNullSafe(F.col("_i"))
    added = new.join(same(old), both, "left_anti").select("clip_id", "identity", F.lit(1).alias("_up"))
    removed = old.join(same(new), both, "left_anti").select("clip_id", "identity", F.lit(0).alias("_up"))
    changed = added.unionByName(removed)
    return changed.rollup("identity").agg(F.count_if(F.col("_up") == 1).alias("added"), F.count_if(F.col("_up") == 0).alias("removed"), F.count_distinct("clip_id").alias("clips"), (F.grouping("identity") == 1).alias("is_total"))


def signatures(members: DataFrame) -> DataFrame:
    """(clip_id, signature): each clip's identities, sorted."""
    return members.groupBy("clip_id").agg(F.sort_array(F.collect_set("identity")).alias("signature"))


def capacity_limit(clips: DataFrame, max_samples: int, order: list[str], group: str = "source_stem") -> DataFrame:
    """The first max_samples clips of the whole set, source after source (by name, none first); max_samples 0 keeps all.

    The place of each clip comes from range partitions and their sizes, so no task sees all clips or all sources.
    """
    if not max_samples:
        return clips
    inner = f"{'_'.join(clips.columns)}_place"  # longer than any column's name
    return placed(clips, [F.col(group), *map(F.col, order)], out=inner).where(F.col(inner) <= max_samples).drop(inner)


def capacity_shortfall(clips: DataFrame, pool: DataFrame, max_samples: int) -> DataFrame:
    """One row: samples, how many are missing to the cap, what the pool still holds, and what to do about it.

    With open slots in the pool more can be mined; with none, sources have to be added. Without a cap (0) nothing is missing.
    """
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
    rows = one(clips, "samples").join(one(pool, "pool_remaining"), "_k").drop("_k")
    short = F.greatest(F.lit(max_samples) - F.col("samples"), F.lit(0)).cast("long") if max_samples else F.lit(0).cast("long")
    advice = F.when(F.col("shortfall") > 0, F.when(F.col("pool_remaining") > 0, "mine more").otherwise("add sources"))
    return rows.withColumn("shortfall", short).withColumn("advice", advice)


def shuffle_pool(pool: DataFrame, seed: int, key: str) -> DataFrame:
    """The pool in a random order, the same for the same seed: each slot's shuffle_key and its place (from 1)."""
    keyed = pool.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return placed(keyed, [F.col("shuffle_key"), F.col(key)])
