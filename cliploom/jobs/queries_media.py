"""Queries over listings, manifests and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import reconcile as R
from cliploom.sources import media as M
from cliploom.streaming.telemetry import work_path

from . import Tables, register

SCAN = "SELECT *, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext, regexp_extract(path, '([^/]*)$', 1) AS name FROM b_files"
IMAGES = "('png','jpg','jpeg','webp','bmp','tiff','tif')"
VOICES = "('wav','mp3','flac','m4a','ogg','opus','mp4','mkv','mov','avi','webm','m4v')"
KIND = f"CASE WHEN ext IN ('mp4','mov','avi','mkv','webm','flv','wmv') THEN 'video' WHEN ext IN {IMAGES} THEN 'image' END"
FILE_STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '\\.[^.]*$', '')"
KIND_ROWS = "(SELECT unnest(['latents','conditions','audio_latents']) AS kind)"
MEDIA = f"media AS (SELECT file_id, path FROM ({SCAN}) s WHERE {KIND} IS NOT NULL AND name NOT LIKE '\\_%' ESCAPE '\\')"
SCOPE = f"""scope AS (SELECT DISTINCT CASE WHEN media_path IS NULL THEN 'source' ELSE 'chunk' END AS scope,
  {FILE_STEM.format('coalesce(media_path, source_file)')} AS stem FROM b_ledger)"""


@register("scan_media", f"SELECT file_id, path, ext, {KIND} AS kind FROM ({SCAN}) s WHERE {KIND} IS NOT NULL AND substr(name, 1, 1) <> '_'")
def scan_media(t: Tables):
    return M.scan_media(t.b_files)


@register("read_entries", "SELECT entry_id, media_path, caption, transcript FROM b_entries")
def read_entries(t: Tables):
    # manifests of some hundred entries each as JSON files, read by the operator: an absent key stays null, an empty text stays empty
    path = work_path(t.spark, "manifests")
    fields = F.struct("media_path", "source_file", F.concat(F.col("entry_id").cast("string"), F.lit("|"), "caption").alias("caption"), "transcript")
    files = t.b_entries.groupBy(F.floor(F.col("entry_id") / 2000)).agg(F.to_json(F.collect_list(fields)).alias("value")).select("value")
    files.write.option("maxRecordsPerFile", 1).text(path)
    cut = F.split("caption", r"\|", 2)
    return M.read_entries(t.spark, path).select(cut[0].cast("long").alias("entry_id"), "media_path", cut[1].alias("caption"), "transcript")


@register("write_entries", """SELECT entry_id, CASE WHEN media_path LIKE 'clips/v1%' THEN substr(media_path, 7) ELSE media_path END AS media_path FROM b_entries""")
def write_entries(t: Tables):
    root = work_path(t.spark, "set")
    full = t.b_entries.withColumn("media_path", F.when(F.col("media_path").startswith("clips/v1"), F.concat(F.lit(root + "/"), F.substr("media_path", F.lit(7)))).otherwise(F.col("media_path")))
    M.write_entries(full.limit(0), root)  # an older version, which the newer one replaces
    M.write_entries(full, root)
    return M.current_entries(t.spark, root).select("entry_id", "media_path")


@register("append_rejections", """SELECT media_path, source_file, reason, chunk_idx, NULL::INTEGER AS start_frame FROM b_ledger
UNION ALL SELECT media_path, source_file, 'deleted', NULL, 0 FROM b_entries WHERE caption = ''""")
def append_rejections(t: Tables):
    path = work_path(t.spark, "ledger")
    M.append_rejections(t.b_ledger, path)
    M.append_rejections(t.b_entries.where("caption = ''").select("media_path", "source_file", F.lit("deleted").alias("reason"), F.lit(0).alias("start_frame")), path)
    kinds = "media_path string, source_file string, chunk_idx int, start_frame int, reason string"
    return M.read_rejections(t.spark, path, kinds).select("media_path", "source_file", "reason", "chunk_idx", "start_frame")


@register("artifact_inventory", """SELECT stem, CAST(max((kind = 'latents')::INT) AS INT) AS has_latents, CAST(max((kind = 'conditions')::INT) AS INT) AS has_conditions,
CAST(max((kind = 'audio_latents')::INT) AS INT) AS has_audio_latents FROM b_artifacts GROUP BY stem""")
def artifact_inventory(t: Tables):
    return M.artifact_inventory(t.b_artifacts, R.KINDS)


@register("load_refs", f"""WITH f AS (SELECT path, ext, {FILE_STEM.format('path')} AS stem FROM ({SCAN}) s)
SELECT 'character' AS ref_kind, replace(lower(stem), '_', '-') AS ref_key, min(path) AS path FROM f WHERE ext IN {IMAGES} GROUP BY 2
UNION ALL SELECT 'location', trim(replace(stem, '_', ' ')), min(path) FROM f WHERE ext IN {IMAGES} GROUP BY 2
UNION ALL SELECT 'voice', replace(lower(stem), '_', '-'), min(path) FROM f WHERE ext IN {VOICES} GROUP BY 2""")
def load_refs(t: Tables):
    found = [M.load_refs(t.b_files, kind).select(F.lit(kind).alias("ref_kind"), "ref_key", "path") for kind in ("character", "location", "voice")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("loss_history_flatten", """SELECT run_id, 'step' AS kind, step, loss, step_time, NULL::DOUBLE AS ema_loss FROM b_metrics
UNION ALL SELECT run_id, 'ema', step, NULL, NULL, loss + 1 FROM b_metrics WHERE step > 20""")
def loss_history_flatten(t: Tables):
    point = F.when(F.col("step") > 20, F.array(F.col("step").cast("double"), F.col("loss") + 1))
    nested = t.b_metrics.groupBy("run_id", F.floor(F.col("step") / 100).alias("file")).agg(F.to_json(F.struct(F.collect_list(F.struct("step", "loss", "step_time")).alias("steps"), F.collect_list(point).alias("ema_history"))).alias("history"))
    return M.loss_history_flatten(nested).select("run_id", "kind", "step", "loss", "step_time", "ema_loss")


@register("parse_train_log", """SELECT event_id, line, CAST(coalesce(nullif(regexp_extract(line, '[Ss]tep\\s*[:=]?\\s*(\\d+)', 1), ''), nullif(regexp_extract(line, '\\|\\s*(\\d+)/(\\d+)', 1), '')) AS BIGINT) AS step FROM b_log""")
def parse_train_log(t: Tables):
    return M.parse_train_log(t.b_log)


PATHS = "(SELECT entry_id, CASE WHEN caption = '' THEN '' WHEN entry_id % 3 = 0 THEN media_path WHEN entry_id % 3 = 1 THEN '/set/' || media_path ELSE '/old/' || media_path END AS media_path FROM b_entries)"


def paths(t: Tables):
    return t.b_entries.select("entry_id", F.expr("CASE WHEN caption = '' THEN '' WHEN entry_id % 3 = 0 THEN media_path WHEN entry_id % 3 = 1 THEN concat('/set/', media_path) ELSE concat('/old/', media_path) END AS media_path"))


@register("normalize_media_paths", f"""WITH e AS {PATHS}, files AS (SELECT '/set/' || path AS path FROM b_clips)
SELECT entry_id, media_path, CASE WHEN media_path = '' THEN '' WHEN media_path NOT LIKE '/%' THEN '/set/' || media_path WHEN f.path IS NOT NULL THEN media_path
  ELSE coalesce(c.path, media_path) END AS resolved
FROM e LEFT JOIN files f ON f.path = e.media_path LEFT JOIN files c ON regexp_extract(c.path, '([^/]*)$', 1) = regexp_extract(e.media_path, '([^/]*)$', 1)""")
def normalize_media_paths(t: Tables):
    return R.normalize_media_paths(paths(t), t.b_clips.select(F.concat(F.lit("/set/"), "path").alias("path")), "/set")


@register("artifact_paths", f"""SELECT entry_id, media_path, kind, '/set/' || kind || '/' || CASE WHEN media_path LIKE '/set/%' THEN regexp_replace(substr(media_path, 6), '\\.[^./]*$', '')
  ELSE {FILE_STEM.format('media_path')} END || '.pt' AS artifact_path FROM {PATHS} e CROSS JOIN {KIND_ROWS} k""")
def artifact_paths(t: Tables):
    return R.artifact_paths(paths(t), "/set")


@register("clip_lineage", """SELECT entry_id, stem, regexp_extract(stem, '^(.*)_chunk', 1) AS lineage_source, CAST(regexp_extract(stem, '_chunk(\\d+)$', 1) AS INT) AS lineage_chunk,
  regexp_extract(stem, '^(.*)_chunk', 1) || '_chunk' || lpad(CAST(entry_id AS VARCHAR), CAST(greatest(4, length(CAST(entry_id AS VARCHAR))) AS INT), '0') || '.mp4' AS file_name FROM b_entries""")
def clip_lineage(t: Tables):
    return R.clip_lineage(t.b_entries.select("entry_id", "stem")).withColumn("file_name", R.chunk_name(F.col("lineage_source"), F.col("lineage_chunk")))


@register("blank_overlong_conditions", """SELECT entry_id, (coalesce(token_len > 128, false) AND caption <> '') AS drop_artifact, CASE WHEN token_len > 128 AND caption <> '' THEN '' ELSE caption END AS caption
FROM b_entries LEFT JOIN b_artifacts a ON a.stem = b_entries.stem AND a.kind = 'conditions'""")
def blank_overlong_conditions(t: Tables):
    return R.blank_overlong_conditions(t.b_entries, t.b_artifacts).select("entry_id", "drop_artifact", "caption")


@register("todo_transcribe", """SELECT entry_id, stem FROM b_entries e WHERE transcript IS NULL AND EXISTS (SELECT 1 FROM b_clips c WHERE c.stem = e.stem)
AND NOT EXISTS (SELECT 1 FROM b_artifacts a WHERE a.stem = e.stem AND a.kind = 'conditions')""")
def todo_transcribe(t: Tables):
    return R.todo_transcribe(t.b_entries, t.b_clips, t.b_artifacts).select("entry_id", "stem")


@register("todo_caption", "SELECT entry_id, stem FROM b_entries e WHERE trim(caption) = '' AND NOT EXISTS (SELECT 1 FROM b_artifacts a WHERE a.stem = e.stem AND a.kind = 'conditions')")
def todo_caption(t: Tables):
    return R.todo_caption(t.b_entries, t.b_artifacts).select("entry_id", "stem")


@register("quarantine_destinations", """SELECT media_path, reason, '/set/rejected_clips/' || regexp_replace(reason, '[^A-Za-z0-9_-]', '_', 'g') || '/' ||
  CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || n || '.mp4' END AS quarantined_path
FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(reason, '[^A-Za-z0-9_-]', '_', 'g'), name ORDER BY media_path, chunk_idx) - 1 AS n
  FROM (SELECT 'clips/' || CAST(chunk_idx AS VARCHAR) || '/a.mp4' AS media_path, 'a.mp4' AS name, reason, chunk_idx FROM b_ledger WHERE media_path IS NOT NULL) x) y""")
def quarantine_destinations(t: Tables):
    led = t.b_ledger.where("media_path IS NOT NULL").withColumn("media_path", F.concat(F.lit("clips/"), F.col("chunk_idx").cast("string"), F.lit("/a.mp4")))
    return R.quarantine_destinations(led, "/set").select("media_path", "reason", "quarantined_path")


@register("missing_artifacts", f"SELECT stem, kind FROM (SELECT DISTINCT stem FROM b_clips) c CROSS JOIN {KIND_ROWS} k EXCEPT SELECT stem, kind FROM b_artifacts")
def missing_artifacts(t: Tables):
    return R.missing_artifacts(t.b_clips, t.b_artifacts)


@register("bucketed_inventory", f"""SELECT stem, kind AS missing, NULL::INT AS latents_len FROM (SELECT stem, kind FROM (SELECT DISTINCT stem FROM b_clips) c CROSS JOIN {KIND_ROWS} k EXCEPT SELECT stem, kind FROM b_artifacts) m
UNION ALL SELECT a.stem, NULL, a.token_len FROM b_artifacts a JOIN b_artifacts c USING (stem) WHERE a.kind = 'latents' AND c.kind = 'conditions'""")
def bucketed_inventory(t: Tables):
    clips, artifacts = M.bucketed(t.b_clips, "clips"), M.bucketed(t.b_artifacts, "artifacts")
    missing = R.missing_artifacts(clips, artifacts).select("stem", F.col("kind").alias("missing"), F.lit(None).cast("int").alias("latents_len"))
    return missing.unionByName(R.training_manifest(artifacts).select("stem", F.lit(None).cast("string").alias("missing"), "latents_len"))


@register("orphan_entries", """SELECT media_path, source_file, 'deleted' AS reason, CAST(entry_id AS INT) AS chunk_idx FROM b_entries WHERE media_path NOT IN (SELECT path FROM b_clips)""")
def orphan_entries(t: Tables):
    return R.orphan_entries(t.b_entries, t.b_clips)


@register("stub_entries", f"""WITH m AS (SELECT {FILE_STEM.format('path')} AS s, min(path) AS p FROM (SELECT '/src/' || CAST(file_id % 3 AS VARCHAR) || '/v' || CAST(file_id AS VARCHAR) || '.mov' AS path FROM b_files) f GROUP BY 1)
SELECT path AS media_path, p AS source_file, '' AS caption FROM b_clips LEFT JOIN m ON s = source_stem WHERE path NOT IN (SELECT media_path FROM b_entries)""")
def stub_entries(t: Tables):
    media = t.b_files.select(F.expr("concat('/src/', CAST(file_id % 3 AS STRING), '/v', CAST(file_id AS STRING), '.mov') AS path"))
    return R.stub_entries(t.b_clips, t.b_entries, media)


@register("orphan_artifacts", "SELECT stem, kind, token_len FROM b_artifacts WHERE stem NOT IN (SELECT stem FROM b_clips)")
def orphan_artifacts(t: Tables):
    return R.orphan_artifacts(t.b_artifacts, t.b_clips)


@register("rejection_scope", f"WITH {SCOPE} SELECT scope, stem FROM scope")
def rejection_scope(t: Tables):
    return R.rejection_scope(t.b_ledger)


@register("new_sources", f"""WITH {SCOPE}, media AS (SELECT video_id, '/src/' || stem || '.mp4' AS path, stem FROM b_videos)
SELECT video_id, path, stem FROM media WHERE stem NOT IN (SELECT source_stem FROM b_clips WHERE clip_id % 40 = 0) AND stem NOT IN (SELECT stem FROM scope WHERE scope = 'source')""")
def new_sources(t: Tables):
    media = t.b_videos.select("video_id", F.concat(F.lit("/src/"), "stem", F.lit(".mp4")).alias("path"))
    return R.new_sources(media, t.b_clips.where("clip_id % 40 = 0"), t.b_ledger).select("video_id", "path", "stem")


GRID = "(SELECT concat('v', CAST(o_custkey % 500 AS STRING)) AS source_stem, CAST(o_orderkey AS INT) AS chunk_idx FROM orders)"


@register("chunk_pool", f"""WITH {SCOPE}, used AS (SELECT stem FROM b_clips WHERE clip_id % 2 = 0 UNION SELECT stem FROM b_entries WHERE entry_id % 3 = 0 UNION SELECT stem FROM scope WHERE scope = 'chunk')
SELECT source_stem, chunk_idx FROM {GRID} g WHERE source_stem || '_chunk' || chunk_idx NOT IN (SELECT stem FROM used) AND source_stem NOT IN (SELECT stem FROM scope WHERE scope = 'source')""")
def chunk_pool(t: Tables):
    grid = t.orders.select(F.expr("concat('v', CAST(o_custkey % 500 AS STRING)) AS source_stem"), F.col("o_orderkey").cast("int").alias("chunk_idx"))
    return R.chunk_pool(grid, t.b_clips.where("clip_id % 2 = 0"), t.b_entries.where("entry_id % 3 = 0"), t.b_ledger).select("source_stem", "chunk_idx")


@register("training_manifest", """SELECT a.stem, a.token_len AS latents_len, c.token_len AS conditions_len FROM b_artifacts a JOIN b_artifacts c USING (stem) WHERE a.kind = 'latents' AND c.kind = 'conditions'""")
def training_manifest(t: Tables):
    return R.training_manifest(t.b_artifacts)


@register("pair_conditioning", f"""WITH f AS (SELECT path, {FILE_STEM.format('path')} AS s, list_position(['png','jpg','mp4','mov'], lower(regexp_extract(path, '\\.([^./]*)$', 1))) AS r
  FROM (SELECT '/ref/v' || CAST(file_id % 60 AS VARCHAR) || '.' || regexp_extract(path, '\\.([^./]*)$', 1) AS path FROM b_files) x),
b AS (SELECT s, arg_min(path, r * 1000000 + length(path)) AS reference_path FROM (SELECT DISTINCT * FROM f) y WHERE r > 0 GROUP BY s)
SELECT entry_id, reference_path FROM b_entries LEFT JOIN b ON s = replace(source_file, '.mp4', '')""")
def pair_conditioning(t: Tables):
    files = t.b_files.select(F.expr("concat('/ref/v', CAST(file_id % 60 AS STRING), '.', regexp_extract(path, '\\\\.([^./]*)$', 1)) AS path"))
    return R.pair_conditioning(t.b_entries, files, ("png", "jpg", "mp4", "mov")).select("entry_id", "reference_path")


@register("union_missing", f"SELECT DISTINCT stem FROM (SELECT stem, kind FROM (SELECT DISTINCT stem FROM b_clips) c CROSS JOIN {KIND_ROWS} k EXCEPT SELECT stem, kind FROM b_artifacts) m")
def union_missing(t: Tables):
    return R.union_missing(R.missing_artifacts(t.b_clips, t.b_artifacts))


@register("complete_stems", "SELECT stem FROM b_clips WHERE stem IN (SELECT stem FROM b_artifacts GROUP BY stem HAVING count(DISTINCT kind) = 3)")
def complete_stems(t: Tables):
    return R.complete_stems(t.b_clips, t.b_artifacts)


HAVE = """h AS (SELECT c.stem, coalesce(max((kind = 'latents')::INT), 0) AS l, coalesce(max((kind = 'conditions')::INT), 0) AS c, coalesce(max((kind = 'audio_latents')::INT), 0) AS a
  FROM (SELECT DISTINCT stem FROM b_clips) c LEFT JOIN b_artifacts USING (stem) GROUP BY c.stem)"""


@register("reconcile_report", f"""WITH {HAVE} SELECT count(*) AS clips, count(*) FILTER (l = 0) AS missing_latents, count(*) FILTER (c = 0) AS missing_conditions, count(*) FILTER (a = 0) AS missing_audio_latents,
count(*) FILTER (l * c * a = 0) AS missing_any, count(*) FILTER (l + c + a > 0) > 0 AS established, count(*) FILTER (l * c * a = 0) = 0 AS complete, 'recovery' AS mode FROM h""")
def reconcile_report(t: Tables):
    return R.reconcile_report(t.b_clips, t.b_artifacts)


@register("audit_summary", """SELECT (SELECT count(*) FROM b_entries WHERE media_path NOT IN (SELECT path FROM b_clips)) AS orphans,
(SELECT count(*) FROM b_clips WHERE path NOT IN (SELECT media_path FROM b_entries)) AS stubs,
(SELECT count(*) FROM b_entries e JOIN b_artifacts a ON a.stem = e.stem AND a.kind = 'conditions' WHERE token_len > 128 AND caption <> '' AND media_path IN (SELECT path FROM b_clips)) AS blanked""")
def audit_summary(t: Tables):
    return R.audit_summary(t.b_entries, t.b_clips, t.b_artifacts)
