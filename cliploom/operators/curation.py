"""One curation pass: rebalance, mine the open slots, gate, take in by quota, and what that leaves behind."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.shared import stored
from cliploom.operators import identity, mining, quota, reconcile
from cliploom.sources.media import stem_of

SLOT = ["video_id", "chunk_idx"]


class Pass(NamedTuple):
    """entries: the new manifest; rejections: rows for the ledger; clips: ranges to extract; pool: slots that are still open; quotas: where each identity stands."""

    entries: DataFrame
    rejections: DataFrame
    clips: DataFrame
    pool: DataFrame
    quotas: DataFrame


def absorbed(order: DataFrame, moved: DataFrame) -> DataFrame:
    """Slots (video_id, chunk_idx) that are skipped, as a moved clip covers them that was taken before them.

    order: (video_id, chunk_idx, place), the slots in the order in which they are worked through; moved: those of
    them that give a clip from another place (shift, start_frame, end_frame). A slot that is skipped covers
    nothing. Whether it is, is settled in rounds from the first places on: a slot is worked on once all that could
    cover it are skipped, and skipped once one of them is worked on. Orders are random, so rounds are few.
    """
    length = F.col("end_frame") - F.col("start_frame")
    n = F.ceil(F.abs("shift") / length).cast("int")
    reach = moved.where("shift <> 0").select("video_id", F.col("chunk_idx").alias("by"), F.explode(F.sequence(F.lit(1), n)).alias("k"), F.signum("shift").cast("int").alias("side"))
    reach = reach.select("video_id", "by", (F.col("by") + F.col("k") * F.col("side")).alias("chunk_idx"))
    first = order.select("video_id", F.col("chunk_idx").alias("by"), F.col("place").alias("by_place"))
    edges = reach.join(order, SLOT).join(first, ["video_id", "by"]).where("by_place < place").select("video_id", "by", "chunk_idx")
    edges = stored(edges, "covering")
    slots = edges.select("video_id", F.col("by").alias("chunk_idx")).unionByName(edges.select(*SLOT)).distinct()
    # null: not settled; a slot that nothing can cover is worked on
    state = stored(slots.join(edges.select(*SLOT, F.lit(True).alias("can")).distinct(), SLOT, "left").select(*SLOT, F.when(F.col("can").isNull(), F.lit(False)).alias("skipped")), "covered")
    while not state.where("skipped IS NULL").isEmpty():
        by = state.select("video_id", F.col("chunk_idx").alias("by"), F.col("skipped").alias("by_skipped"))
        seen = edges.join(by, ["video_id", "by"]).groupBy(*SLOT).agg(F.bool_or(~F.col("by_skipped")).alias("covered"), F.bool_and(F.coalesce("by_skipped", F.lit(False))).alias("free"))
        settled = F.when(F.col("covered"), F.lit(True)).when(F.col("free"), F.lit(False))
        state = stored(state.join(seen, SLOT, "left").select(*SLOT, F.coalesce("skipped", settled).alias("skipped")), "covered")
    return state.where("skipped").select(*SLOT)


def curation_pass(entries: DataFrame, ledger: DataFrame, clips: DataFrame, grid: DataFrame, matches: DataFrame, sightings: DataFrame, cast: DataFrame, max_samples: int, seed: int = 0, n: int = 4, required: float = 0.75, unknown: float = 0.25, ratio: float = 0.5) -> Pass:
    """One pass over what is there.

    entries: (entry_id, stem, media_path, source_file, caption, characters), ids in the order of the manifest;
    ledger: (media_path, source_file, reason, chunk_idx); clips: (stem) on disk; grid: (video_id, source_stem, chunk_idx,
    start_frame, end_frame, first_frame, last_frame); matches: (video_id, frame, hit, unknown);
    sightings: (video_id, frame, identity); cast: (identity).

    1. Clips of identities over their quota go (rebalance_over_quota).
    2. Slots of the grid that are not on disk, in the manifest or in the ledger form the pool, in a random order of the seed.
    3. A slot gives its best range (shift_search), or its reason for having none (chunk_gate). Slots that an
       earlier, moved clip covers are skipped.
    4. Clips are taken in by quota, in the order of the pool, until no identity is under its quota; some replace others.

    All that goes, is refused, rejected or covered gets a row for the ledger with its reason, so that a second pass over the
    results changes nothing: rebalanced, swapped_out, quota_refused, absorbed, or the gate's reason. Slots after the last clip that was
    needed stay in the pool. Nothing is ever taken for an empty cast.
    """
    entries = stored(entries.select("entry_id", "stem", "media_path", "source_file", "caption", F.array_sort(F.array_distinct(F.coalesce("characters", F.array().cast("array<string>")))).alias("characters")), "entries")
    cast = stored(cast.select("identity").distinct(), "cast")
    counted = entries.select(F.explode("characters").alias("identity")).groupBy("identity").agg(F.count("*").alias("n"))
    quotas = stored(quota.quota_table(counted, cast, max_samples), "quotas")
    held = entries.select(F.col("entry_id").alias("clip_id"), F.col("characters").alias("signature"))
    gone = stored(quota.rebalance_over_quota(held, quotas.select("identity", "quota")).select(F.col("clip_id").alias("entry_id")), "rebalanced")
    kept = entries.join(gone, "entry_id", "left_anti")

    # clips that go are out of the pool of this pass, too
    open_slots = reconcile.chunk_pool(grid, clips, entries, ledger)
    pool = stored(identity.shuffle_pool(open_slots.withColumn("_slot", F.concat_ws("#", "source_stem", "chunk_idx")), seed, "_slot").drop("shuffle_key", "_slot"), "pool")
    best = stored(mining.shift_search(pool.drop("place", "source_stem"), matches, n=n, required=required, unknown=unknown), "best")
    skipped = stored(absorbed(pool.select(*SLOT, "place"), best), "absorbed")
    taken = best.join(skipped, SLOT, "left_anti").join(pool.select(*SLOT, "source_stem", "place"), SLOT)
    frames = mining.sample_positions(taken.select(*SLOT, "start_frame", "end_frame"), n)
    seen = frames.join(sightings.join(cast, "identity", "left_semi"), ["video_id", "frame"]).select(*SLOT, "pos", "identity")
    signatures = identity.dominant_identities(seen, SLOT, ratio).withColumnRenamed("identities", "signature")
    base = entries.agg(F.coalesce(F.max("entry_id"), F.lit(0)).cast("long")).first()[0]
    taken = taken.join(signatures, SLOT, "left").withColumn("signature", F.coalesce("signature", F.array().cast("array<string>")))
    taken = stored(taken.withColumns({"pos": F.col("place"), "clip_id": F.col("place") + base}), "taken")

    left = kept.select(F.col("entry_id").alias("clip_id"), F.col("characters").alias("signature"))
    decided = stored(quota.quota_intake(taken.select("clip_id", "pos", "signature"), left, quotas.select("identity", "quota"), max_samples), "decided")
    swapped = decided.where("swapped IS NOT NULL").select(F.col("swapped").alias("clip_id"))
    accepted = taken.join(decided.where("accepted").select("clip_id"), "clip_id", "left_semi")
    path = F.concat(F.lit("clips/"), reconcile.chunk_name(F.col("source_stem"), F.col("chunk_idx")))
    source = F.concat("source_stem", F.lit(".mp4"))
    new = accepted.select(F.col("clip_id").alias("entry_id"), stem_of(path).alias("stem"), path.alias("media_path"), source.alias("source_file"), F.lit("").alias("caption"), F.col("signature").alias("characters"))
    every = kept.unionByName(new)
    after = stored(every.join(swapped.withColumnRenamed("clip_id", "entry_id"), "entry_id", "left_anti"), "manifest")
    final = quota.quota_table(after.select(F.explode("characters").alias("identity")).groupBy("identity").agg(F.count("*").alias("n")), cast, max_samples)

    # with all quotas met, the clip that met the last one ends the pass
    reached = pool
    if final.where(~F.col("met")).isEmpty():
        last = decided.where("accepted").agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last")).first().last
        reached = pool.where(F.col("place") <= last)
    number = F.col("chunk_idx").cast("int").alias("chunk_idx")
    slot_row = lambda df, reason: df.select(path.alias("media_path"), source.alias("source_file"), reason.alias("reason"), number)
    refused = reached.join(taken.select(*SLOT, "clip_id"), SLOT).join(decided.where(~F.coalesce("accepted", F.lit(False))).select("clip_id"), "clip_id", "left_semi")
    failed = reached.join(best, SLOT, "left_anti").join(skipped, SLOT, "left_anti")
    judged = mining.validate_ranges(failed, matches, SLOT, n).withColumn("n_seen", F.lit(0))
    reasons = mining.chunk_gate(judged, required, unknown).select(*SLOT, "reason")
    entry_row = lambda df, reason: reconcile.clip_lineage(df, "stem").select("media_path", "source_file", F.lit(reason).alias("reason"), F.col("lineage_chunk").alias("chunk_idx"))
    rejections = (
        entry_row(entries.join(gone, "entry_id", "left_semi"), "rebalanced")
        .unionByName(entry_row(every.join(swapped.withColumnRenamed("clip_id", "entry_id"), "entry_id", "left_semi"), "swapped_out"))
        .unionByName(slot_row(refused, F.lit("quota_refused")))
        .unionByName(slot_row(reached.join(skipped, SLOT, "left_semi"), F.lit("absorbed")))
        .unionByName(slot_row(failed.join(reasons, SLOT), F.col("reason")))
    )
    ranges = accepted.join(swapped, "clip_id", "left_anti").select("clip_id", *SLOT, "source_stem", "shift", "start_frame", "end_frame")
    still = pool.join(reached.select(*SLOT), SLOT, "left_anti")
    return Pass(after, stored(rejections, "rejections"), ranges, still, final)


def purge_list(rejections: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Derived artifacts of clips that the given ledger rows reject; they go with the clip. Rows for a whole source name no clip and purge none."""
    stems = reconcile.rejection_scope(rejections).where(F.col("scope") == "chunk").select("stem")
    return artifacts.join(stems, "stem", "left_semi")
