"""Views over the test tables in the shapes of the operators' inputs.

Each view is one SQL text that Spark and DuckDB both read; Spark gets it as a DataFrame, an oracle as
a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

STEM = "concat('v', CAST(o_custkey % 500 AS STRING), '_chunk', CAST(o_orderkey AS STRING))"

VIEWS = {
    "b_clips": f"""SELECT o_orderkey AS clip_id, concat('v', CAST(o_custkey % 500 AS STRING)) AS source_stem, {STEM} AS stem,
  concat('clips/', {STEM}, '.mp4') AS path FROM orders WHERE o_orderkey % 11 <> 0""",
    "b_entries": f"""SELECT o_orderkey AS entry_id, {STEM} AS stem, concat('clips/', {STEM}, '.mp4') AS media_path,
  concat('v', CAST(o_custkey % 500 AS STRING), '.mp4') AS source_file,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('A shot of order ', lower(o_orderpriority)) END AS caption,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' THEN '' ELSE concat('Line ', CAST(o_orderkey AS STRING)) END AS transcript
  FROM orders WHERE o_orderkey % 13 <> 0""",
    "b_artifacts": f"""SELECT {STEM} AS stem, CASE l_returnflag WHEN 'A' THEN 'latents' WHEN 'N' THEN 'conditions' ELSE 'audio_latents' END AS kind,
  CASE WHEN max(o_orderkey) % 7 = 0 THEN NULL ELSE CAST(max(l_quantity) * 3 AS INT) END AS token_len FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "b_videos": """SELECT c_custkey AS video_id, concat('v', CAST(c_custkey AS STRING)) AS stem,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 23.976 WHEN 1 THEN 25 WHEN 2 THEN 29.97 ELSE 60 END AS DOUBLE) AS fps,
  CAST(200 + (c_custkey * 37) % 4000 AS INT) AS total_frames,
  CAST(CASE c_nationkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1280 ELSE 720 END AS INT) AS width,
  CAST(CASE c_nationkey % 3 WHEN 0 THEN 1080 WHEN 1 THEN 720 ELSE 1280 END AS INT) AS height FROM customer""",
    "b_files": """SELECT page_id AS file_id, concat('/data/', CASE WHEN page_id % 17 = 0 THEN '_' ELSE '' END, 'Clip_', CAST(page_id % 190 AS STRING), '.',
  CASE page_id % 11 WHEN 0 THEN 'mp4' WHEN 1 THEN 'MOV' WHEN 2 THEN 'png' WHEN 3 THEN 'JPG' WHEN 4 THEN 'txt' WHEN 5 THEN 'wmv' WHEN 6 THEN 'Tiff' WHEN 7 THEN 'flv' WHEN 8 THEN 'tif' WHEN 9 THEN 'wav' ELSE 'html' END) AS path FROM pages""",
    "b_ledger": f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('clips/', {STEM}, '.mp4') END AS media_path,
  concat('v', CAST(o_custkey % 500 AS STRING), '.mp4') AS source_file,
  CASE o_orderkey % 4 WHEN 0 THEN 'no_known_character' WHEN 1 THEN 'unknown face!' WHEN 2 THEN 'deleted' ELSE 'caption/too long' END AS reason,
  CAST(o_orderkey AS INT) AS chunk_idx FROM orders WHERE o_orderkey % 29 = 0""",
    "b_refs": """SELECT concat('id-', CAST(label AS STRING)) AS trigger_name, CAST(row_number() OVER (ORDER BY label) * 5000 AS INT) AS ref_order, embedding AS ref_embedding
  FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) r WHERE rn = 1""",
    "b_frames": """SELECT event_id, user_id AS video_id, event_type, value, ts,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame FROM events""",
    "b_detections": """SELECT f.video_id, f.frame, f.event_id AS det_id, CAST(0.45 AS DOUBLE) + CAST(f.event_id * 37 % 55 AS DOUBLE) / 100 AS det_score,
  CAST(f.event_id * 7 % 400 AS INT) AS x, CAST(f.event_id * 11 % 300 AS INT) AS y, CAST(20 + f.event_id * 13 % 200 AS INT) AS w,
  CAST(20 + f.event_id * 17 % 200 AS INT) AS h, e.embedding
  FROM b_frames f CROSS JOIN (SELECT count(*) AS n FROM embeddings) c JOIN embeddings e ON e.vec_id = f.event_id % c.n""",
    "b_sightings": "SELECT video_id, frame AS pos, event_type AS identity, value FROM b_frames",
    "b_matches": "SELECT video_id, frame, event_id % 5 < 3 AS hit, event_id % 7 = 0 AS unknown FROM b_frames",
    "b_chunks": """SELECT video_id, CAST(floor(frame / 16) AS INT) AS chunk_idx, CAST(min(frame) AS INT) AS start_frame, CAST(max(frame) + 1 AS INT) AS end_frame, 0 AS first_frame,
  CAST(max(max(frame)) OVER (PARTITION BY video_id) + 1 AS INT) AS last_frame FROM b_frames GROUP BY video_id, floor(frame / 16)""",
    "b_members": """SELECT DISTINCT user_id * 100 + extract(DAY FROM ts) AS clip_id, event_type AS identity FROM events""",
    "b_metrics": """SELECT video_id AS run_id, frame + 1 AS step, value AS loss, CAST(1 + event_id % 7 AS DOUBLE) AS step_time FROM b_frames""",
    "b_signal": "SELECT video_id AS clip_id, frame AS frame_idx, value AS rms FROM b_frames",
    "b_lines": "SELECT conv_id AS clip_id, CAST(turn AS INT) AS line, role AS speaker, text FROM conversations",
    "b_segments": """SELECT clip_id, line, speaker, text, CAST(coalesce(sum(length(text)) OVER (PARTITION BY clip_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 6 / 100 AS t_start,
  CAST(sum(length(text)) OVER (PARTITION BY clip_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) * 6 / 100 AS t_end FROM b_lines""",
    "b_names": """SELECT CAST(item_id + 10 AS INT) AS ref_order, CASE item_id % 3 WHEN 0 THEN split_part(text, ' ', 1) WHEN 1 THEN concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) ELSE lower(split_part(text, ' ', 2)) END AS name FROM benchmark
  UNION ALL SELECT 0, 'the-ha' UNION ALL SELECT 1, 'the' UNION ALL SELECT 2, 'is the' UNION ALL SELECT 3, 'und der' UNION ALL SELECT 4, 'le' UNION ALL SELECT 5, 'de' UNION ALL SELECT 6, 'The'""",
    "b_attempts": "SELECT CAST(floor(doc_id / 3) AS BIGINT) AS clip_id, CAST(doc_id % 3 AS INT) AS attempt, text AS caption FROM documents",
    "b_captions": "SELECT d.doc_id, d.text AS caption, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "b_checkpoints": """SELECT c_nationkey AS run_id, concat('ck/lora_weights_step_', lpad(CAST(c_custkey * 7 % 5000 AS STRING), 5, '0'), '.safetensors') AS path FROM customer""",
    "b_log": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('Step ', CAST(event_id AS STRING), '/2000 loss') WHEN 1 THEN concat('step=', CAST(event_id * 3 AS STRING))
  WHEN 2 THEN concat(' 50%|##  | ', CAST(event_id % 90 AS STRING), '/200') ELSE 'saving checkpoint' END AS line FROM events""",
    "b_edl": """SELECT clip_id AS program_id, line AS pos, 1000 AS sample_rate, CAST(length(text) * 60 AS BIGINT) AS n_samples,
  CAST(line % 3 AS DOUBLE) / 4 AS start_trim, CAST(line % 2 AS DOUBLE) / 2 AS end_trim, CAST(0.25 AS DOUBLE) AS pause_after FROM b_lines""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needs(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def view(spark: SparkSession, sf_dir: str, name: str, ready: dict[str, DataFrame]) -> DataFrame:
    """The view as a DataFrame, straight from the tables it reads and the views that are `ready`."""
    if name in ready:
        return ready[name]
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    used |= {v: view(spark, sf_dir, v, ready) for v in _needs(text)}
    for t in used:
        text = re.sub(rf"\b{t}\b(?!\.)", f"{{{t}}}", text)
    return spark.sql(text, **used)


def with_views(body: str) -> str:
    """An oracle: the body with the views that it reads in front."""
    order: list[str] = []

    def add(text: str) -> None:
        for v in _needs(text):
            add(VIEWS[v])
            if v not in order:
                order.append(v)

    add(body)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = body.strip()
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head}, {body[len(start) :]}"
    return f"WITH {head} {body}"
