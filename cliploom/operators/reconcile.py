"""Set algebra between manifest, clips, artifacts, media and ledger."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.sources.media import base_name, stem_of

KINDS = ("latents", "conditions", "audio_latents")


def _kinds(with_audio: bool) -> tuple[str, ...]:
    return KINDS if with_audio else KINDS[:2]


def normalize_media_paths(entries: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Relative paths go under root; absolute ones stay if the file exists, else the clip of that name under root, if there is one.

    Null and empty paths stay.
    """
    known = files.select(F.col("path").alias("_known")).distinct()
    clips = files.where(F.col("path").startswith(f"{root}/clips/")).groupBy(base_name("path").alias("_name")).agg(F.min("path").alias("_clip"))
    out = entries.join(known, F.col("media_path") == F.col("_known"), "left").join(clips, base_name("media_path") == F.col("_name"), "left")
    path = F.when(F.col("media_path") == "", "").when(~F.col("media_path").startswith("/"), F.concat(F.lit(f"{root}/"), "media_path")).when(F.col("_known").isNotNull(), F.col("media_path"))
    return out.withColumn("resolved", F.coalesce(path, "_clip", "media_path")).drop("_known", "_name", "_clip")


def artifact_paths(entries: DataFrame, root: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row for each entry and kind: where the artifact lies. Folders under root are kept; outside, only the stem is."""
    prefix = root.rstrip("/") + "/"
    inside = F.regexp_replace(F.substr("media_path", F.lit(len(prefix) + 1)), r"\.[^./]*$", "")
    rest = F.when(F.col("media_path").startswith(prefix), inside).otherwise(stem_of("media_path"))
    return entries.withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).withColumn("artifact_path", F.concat(F.lit(prefix), "kind", F.lit("/"), rest, F.lit(".pt")))


def clip_lineage(df: DataFrame, col: str = "stem") -> DataFrame:
    """Source stem and chunk index of a clip's stem, split at the last _chunk; the index is null if it is no number."""
    marked = F.col(col).contains("_chunk")
    source = F.when(marked, F.regexp_extract(col, r"^(.*)_chunk", 1)).otherwise(F.col(col))
    number = F.when(marked, F.regexp_extract(col, r"^.*_chunk(\d+)$", 1))
    return df.withColumns({"lineage_source": source, "lineage_chunk": F.nullif(number, F.lit("")).try_cast("int")})


def chunk_name(source, index):
    """File name of a chunk."""
    return F.format_string("%s_chunk%04d.mp4", source, index)


def blank_overlong_conditions(entries: DataFrame, artifacts: DataFrame, limit: int = 128) -> DataFrame:
    """Entries with the caption blanked where its condition artifact is longer than limit tokens; drop_artifact marks those."""
    long = artifacts.where((F.col("kind") == "conditions") & (F.col("token_len") > limit)).select(F.col("stem").alias("_stem")).distinct()
    out = entries.join(long, F.col("stem") == F.col("_stem"), "left")
    hit = F.col("_stem").isNotNull() & (F.coalesce("caption", F.lit("")) != "")
    return out.withColumns({"drop_artifact": hit, "caption": F.when(hit, "").otherwise(F.col("caption"))}).drop("_stem")


def todo_transcribe(entries: DataFrame, clips: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Entries whose transcript was never tried, whose clip is there and whose condition isn't."""
    done = artifacts.where(F.col("kind") == "conditions")
    return entries.where(F.col("transcript").isNull()).join(clips, "stem", "left_semi").join(done, "stem", "left_anti")


def todo_caption(entries: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Entries with a blank caption and no condition artifact."""
    return entries.where(F.trim(F.coalesce("caption", F.lit(""))) == "").join(artifacts.where(F.col("kind") == "conditions"), "stem", "left_anti")


def quarantine_destinations(rejected: DataFrame, root: str) -> DataFrame:
    """Where rejected clips go: a folder of the reason, made safe; equal names there are numbered _1, _2, ..."""
    from pyspark.sql import Window

    name = base_name("media_path")
    folder = F.concat(F.lit(f"{root}/rejected_clips/"), F.regexp_replace("reason", r"[^A-Za-z0-9_-]", "_"))
    rows = rejected.where(F.col("media_path").isNotNull()).withColumns({"_folder": folder, "_name": name})
    n = F.row_number().over(Window.partitionBy("_folder", "_name").orderBy("media_path", "chunk_idx")) - 1
    rows = rows.withColumn("_n", n)
    named = F.when(F.col("_n") == 0, F.col("_name")).otherwise(F.concat(stem_of("_name"), F.lit("_"), F.col("_n").cast("string"), F.regexp_extract("_name", r"(\.[^.]*)$", 1)))
    return rows.withColumn("quarantined_path", F.concat("_folder", F.lit("/"), named)).drop("_folder", "_name", "_n")


def _held(artifacts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(_stem, has_<kind>...): which kinds each stem has. One row a stem, so joins with it need the stem alone and keep bucketed tables in place."""
    return artifacts.where(F.col("kind").isin(*kinds)).groupBy(F.col("stem").alias("_stem")).agg(*[F.max(F.col("kind") == k).alias(f"has_{k}") for k in kinds])


def missing_artifacts(clips: DataFrame, artifacts: DataFrame, with_audio: bool = True) -> DataFrame:
    """(stem, kind) of every artifact that a clip lacks. Tables of bucketed() are joined without a shuffle."""
    kinds = _kinds(with_audio)
    rows = clips.select("stem").distinct().join(_held(artifacts, kinds), F.col("stem") == F.col("_stem"), "left")
    lacks = F.array_compact(F.array(*[F.when(~F.coalesce(f"has_{k}", F.lit(False)), F.lit(k)) for k in kinds]))
    return rows.select("stem", F.explode(lacks).alias("kind"))


def orphan_entries(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """Rejections for entries without a path or whose clip is gone: reason deleted, with the chunk index of the name."""
    gone = entries.join(clips.select(F.col("path").alias("media_path")), "media_path", "left_anti")
    return clip_lineage(gone.withColumn("_s", stem_of("media_path")), "_s").select("media_path", "source_file", F.lit("deleted").alias("reason"), F.col("lineage_chunk").alias("chunk_idx"))


def surviving_entries(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """Entries whose clip is there."""
    return entries.join(clips.select(F.col("path").alias("media_path")), "media_path", "left_semi")


def stub_entries(clips: DataFrame, entries: DataFrame, media: DataFrame) -> DataFrame:
    """Rows for clips without an entry; the source file is the first in path order with the clip's source stem."""
    new = clips.select(F.col("path").alias("media_path"), "source_stem").join(entries, "media_path", "left_anti")
    first = media.groupBy(stem_of("path").alias("source_stem")).agg(F.min("path").alias("source_file"))
    return new.join(first, "source_stem", "left").select("media_path", "source_file", F.lit("").alias("caption"))


def orphan_artifacts(artifacts: DataFrame, clips: DataFrame) -> DataFrame:
    """Artifacts whose clip is gone."""
    return artifacts.join(clips, "stem", "left_anti")


def rejection_scope(ledger: DataFrame) -> DataFrame:
    """What the ledger blocks: with a clip's path only that clip, without one the whole source."""
    clip = F.col("media_path").isNotNull()
    return ledger.select(F.when(clip, "chunk").otherwise("source").alias("scope"), F.when(clip, stem_of("media_path")).otherwise(stem_of("source_file")).alias("stem")).distinct()


def new_sources(media: DataFrame, clips: DataFrame, ledger: DataFrame) -> DataFrame:
    """Media of which no chunk exists and which the ledger doesn't block as a whole."""
    blocked = rejection_scope(ledger).where(F.col("scope") == "source").select("stem")
    seen = clips.select(F.col("source_stem").alias("stem")).unionByName(blocked)
    return media.withColumn("stem", stem_of("path")).join(seen, "stem", "left_anti")


def chunk_pool(grid: DataFrame, clips: DataFrame, entries: DataFrame, ledger: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Open (source_stem, chunk_idx) slots: not extracted, not in the manifest, not rejected, and of no blocked source.

    The three exclusions are one set, so the grid is shuffled once. With a saved pool the same rules apply to its slots.
    """
    scope = rejection_scope(ledger)
    used = clips.select("stem").unionByName(entries.select("stem")).unionByName(scope.where(F.col("scope") == "chunk").select("stem"))
    used = clip_lineage(used).select(F.col("lineage_source").alias("source_stem"), F.col("lineage_chunk").alias("chunk_idx"))
    slots = (grid if saved is None else saved).join(used, ["source_stem", "chunk_idx"], "left_anti")
    blocked = scope.where(F.col("scope") == "source").select(F.col("stem").alias("source_stem"))
    return slots.join(blocked, "source_stem", "left_anti")


def training_manifest(artifacts: DataFrame, kinds: tuple[str, ...] = KINDS[:2]) -> DataFrame:
    """Stems that have every kind, with each kind's token length; their number is the steps of an epoch.

    An artifact is there if it has a row; its length may be null, as that of a placeholder is.
    """
    each = [c for k in kinds for c in (F.count_if(F.col("kind") == k).alias(f"has_{k}"), F.max(F.when(F.col("kind") == k, F.col("token_len"))).alias(f"{k}_len"))]
    wide = artifacts.where(F.col("kind").isin(*kinds)).groupBy("stem").agg(*each)
    return wide.where(F.least(*[F.col(f"has_{k}") for k in kinds], F.lit(1)) > 0).select("stem", *[f"{k}_len" for k in kinds])


def pair_conditioning(entries: DataFrame, files: DataFrame, ext_order: tuple[str, ...]) -> DataFrame:
    """The conditioning file of each entry: same stem as its source, first in the order of extensions, then of paths."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    rank = F.array_position(F.array(*map(F.lit, ext_order)), ext)
    best = files.withColumn("_r", rank).where(F.col("_r") > 0).groupBy(stem_of("path").alias("_stem")).agg(F.min_by("path", F.struct("_r", "path")).alias("reference_path"))
    return entries.join(best, stem_of("source_file") == F.col("_stem"), "left").drop("_stem")


def union_missing(missing: DataFrame) -> DataFrame:
    """Clips that lack anything."""
    return missing.select("stem").distinct()


def complete_stems(clips: DataFrame, artifacts: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Clips that have all kinds. Tables of bucketed() are joined without a shuffle."""
    full = _held(artifacts, kinds).where(F.least(*[F.coalesce(f"has_{k}", F.lit(False)) for k in kinds], F.lit(True)))
    return clips.select("stem").distinct().join(full, F.col("stem") == F.col("_stem"), "left_semi")


def reconcile_report(clips: DataFrame, artifacts: DataFrame, with_audio: bool = True) -> DataFrame:
    """One row: clips, missing of each kind, clips that lack any, and whether the set is established, complete or to be recovered."""
    kinds = _kinds(with_audio)
    have = artifacts.groupBy(F.col("stem").alias("_stem")).agg(*[F.max(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in kinds])
    rows = clips.select("stem").distinct().join(have, F.col("stem") == F.col("_stem"), "left").na.fill(0, list(kinds))
    any_missing = F.least(*[F.col(k) for k in kinds]) == 0
    out = rows.agg(F.count("*").alias("clips"), *[F.count_if(F.col(k) == 0).alias(f"missing_{k}") for k in kinds], F.count_if(any_missing).alias("missing_any"), F.count_if(F.greatest(*[F.col(k) for k in kinds]) == 1).alias("_some"))
    return out.withColumns({"established": F.col("_some") > 0, "complete": (F.col("clips") > 0) & (F.col("missing_any") == 0), "mode": F.when(F.col("_some") > 0, "recovery").otherwise("fresh")}).drop("_some")


def audit_summary(entries: DataFrame, clips: DataFrame, artifacts: DataFrame, limit: int = 128) -> DataFrame:
    """One row: entries dropped as orphans, stubs added, captions blanked."""
    paths = clips.select(F.col("path").alias("media_path")).distinct()
    kept = entries.join(paths, "media_path", "left_semi")
    dropped = entries.join(paths, "media_path", "left_anti").agg(F.count("*").alias("orphans"))
    stubs = paths.join(entries, "media_path", "left_anti").agg(F.count("*").alias("stubs"))
    blanked = blank_overlong_conditions(kept, artifacts, limit).agg(F.count_if("drop_artifact").alias("blanked"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(dropped).join(one(stubs), "_k").join(one(blanked), "_k").drop("_k")


class Repaired(NamedTuple):
    """entries: the repaired manifest; rejections: ledger rows of entries that went; drop: (stem, kind) of artifacts to delete."""

    entries: DataFrame
    rejections: DataFrame
    drop: DataFrame


def repair_entries(entries: DataFrame, clips: DataFrame, media: DataFrame, artifacts: DataFrame, limit: int = 128) -> Repaired:
    """The manifest as it should be: entries whose clip is gone go to the ledger, clips without an entry get an empty one, and captions of overlong conditions are blanked.

    entries: (stem, media_path, source_file, caption, ...), clips: (stem, path, source_stem), media: (path). Once `drop` is deleted, a
    second repair changes nothing. Other columns stay; they are null in new entries.
    """
    clips = clips.select("stem", "path", "source_stem").distinct()
    checked = blank_overlong_conditions(surviving_entries(entries, clips), artifacts, limit)
    stubs = stub_entries(clips, entries, media).withColumn("stem", stem_of("media_path"))
    drop = checked.where("drop_artifact").select("stem", F.lit("conditions").alias("kind")).distinct()
    repaired = checked.drop("drop_artifact").unionByName(stubs, allowMissingColumns=True).select(entries.columns)
    return Repaired(repaired, orphan_entries(entries, clips), drop)
