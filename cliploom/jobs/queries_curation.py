"""The curation pass and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.shared import stored
from cliploom.operators import curation as C
from cliploom.operators import reconcile as R
from cliploom.sources import media as M
from cliploom.streaming.telemetry import work_path

from . import Tables, register
from .curation import curate, read_set, repair


def curation_inputs(t: Tables) -> dict[str, DataFrame]:
    """A set with a fifth of the chunks in its manifest and some in its ledger, and what was seen in all frames.

    Frames and grid are written once, as every step of a pass reads them.
    """
    t = Tables(t.spark, t.sf_dir, {"b_frames": stored(t.b_frames.select("event_id", "video_id", "event_type", "frame"), "frames")})
    grid = stored(t.b_chunks.withColumn("source_stem", F.concat(F.lit("v"), F.col("video_id").cast("string"))), "grid")
    path = F.concat(F.lit("clips/"), R.chunk_name(F.col("source_stem"), F.col("chunk_idx")))
    source = F.concat("source_stem", F.lit(".mp4"))
    sightings = t.b_frames.where("event_id % 5 < 3").select("video_id", "frame", F.col("event_type").alias("identity"))
    some = grid.where("(video_id * 7 + chunk_idx) % 5 = 0")
    # b_chunks cuts a video every 16 frames
    first = sightings.withColumn("chunk_idx", F.floor(F.col("frame") / 16).cast("int")).join(some, ["video_id", "chunk_idx"]).where("frame < start_frame + 3").groupBy("video_id", "chunk_idx").agg(F.collect_set("identity").alias("characters"))
    held = some.join(first, ["video_id", "chunk_idx"], "left")
    entries = held.select((F.col("video_id") * 1000 + F.col("chunk_idx")).alias("entry_id"), M.stem_of(path).alias("stem"), path.alias("media_path"), source.alias("source_file"), F.lit("seen").alias("caption"), "characters")
    ledger = grid.where("(video_id + chunk_idx) % 11 = 3 AND (video_id * 7 + chunk_idx) % 5 <> 0").select(path.alias("media_path"), source.alias("source_file"), F.lit("unknown_face").alias("reason"), F.col("chunk_idx").cast("int").alias("chunk_idx"))
    return {"entries": entries, "ledger": ledger, "clips": some.select(M.stem_of(path).alias("stem")), "grid": grid, "matches": t.b_matches, "sightings": sightings, "cast": sightings.select("identity").distinct()}


def samples(entries: DataFrame) -> int:
    """A cap that leaves some identities over and some under their quota."""
    return int(entries.select(F.explode("characters")).count() * 1.2)


@register("curation_pass")
def curation_pass(t: Tables):
    given = curation_inputs(t)
    root = work_path(t.spark, "set")
    M.append_rejections(given.pop("ledger"), f"{root}/ledger")
    M.write_entries(given.pop("entries"), root)
    cap = samples(read_set(t.spark, root)[0])
    done = curate(t.spark, root, **given, max_samples=cap)
    entries, ledger = read_set(t.spark, root)
    row = lambda df, kind, path, detail: df.select(F.lit(kind).alias("kind"), path.alias("media_path"), detail.alias("detail"))
    open_path = F.concat(F.lit("clips/"), R.chunk_name(F.col("source_stem"), F.col("chunk_idx")))
    return row(entries, "entry", F.col("media_path"), F.array_join("characters", ",")).unionByName(row(ledger, "rejected", F.col("media_path"), F.col("reason"))).unionByName(row(done.pool, "open", open_path, F.lit("")))


@register("purge_list", """SELECT a.stem, a.kind FROM b_artifacts a WHERE a.stem IN (SELECT regexp_replace(regexp_extract(media_path, '([^/]*)$', 1), '\\.[^.]*$', '') FROM b_ledger WHERE media_path IS NOT NULL)""")
def purge_list(t: Tables):
    return C.purge_list(t.b_ledger, t.b_artifacts).select("stem", "kind")


#: Source files by number, so that some source stems have one.
SOURCES = "(SELECT concat('/src/', CAST(file_id % 3 AS STRING), '/v', CAST(file_id AS STRING), '.mov') AS path FROM b_files)"


@register("repair_entries", f"""WITH m AS (SELECT regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS s, min(path) AS p FROM {SOURCES} f GROUP BY 1),
a AS (SELECT stem, max(token_len) AS n FROM b_artifacts WHERE kind = 'conditions' GROUP BY stem)
SELECT 'entry' AS kind, media_path, source_file, CASE WHEN coalesce(n, 0) > 128 THEN '' ELSE caption END AS caption FROM b_entries LEFT JOIN a USING (stem) WHERE media_path IN (SELECT path FROM b_clips)
UNION ALL SELECT 'entry', path, p, '' FROM (SELECT DISTINCT path, source_stem FROM b_clips) c LEFT JOIN m ON s = source_stem WHERE path NOT IN (SELECT media_path FROM b_entries)
UNION ALL SELECT 'deleted', media_path, source_file, NULL FROM b_entries WHERE media_path NOT IN (SELECT path FROM b_clips)
UNION ALL SELECT 'artifact', stem, NULL, NULL FROM (SELECT DISTINCT stem FROM b_entries JOIN a USING (stem) WHERE n > 128 AND caption <> '' AND media_path IN (SELECT path FROM b_clips)) d""")
def repair_entries(t: Tables):
    root = work_path(t.spark, "set")
    M.write_entries(t.b_entries.select("stem", "media_path", "source_file", "caption"), root)
    files = t.spark.sql(SOURCES.replace("b_files", "{f}")[1:-1], f=t.b_files)
    done = repair(t.spark, root, t.b_clips, files, t.b_artifacts)
    entries, ledger = read_set(t.spark, root)
    rows = entries.select(F.lit("entry").alias("kind"), "media_path", "source_file", "caption")
    rows = rows.unionByName(ledger.select(F.col("reason").alias("kind"), "media_path", "source_file"), allowMissingColumns=True)
    return rows.unionByName(done.drop.select(F.lit("artifact").alias("kind"), F.col("stem").alias("media_path")), allowMissingColumns=True)
