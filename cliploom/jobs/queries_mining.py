"""Queries over detections, chunks, identities, quotas and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import encode as E
from cliploom.operators import geometry as G
from cliploom.operators import identity as I
from cliploom.operators import mining as M
from cliploom.operators import quota as Q

from . import Tables, register

SIM = "list_inner_product(d.embedding::DOUBLE[], r.ref_embedding::DOUBLE[])"
BEST = f"best AS (SELECT d.*, r.trigger_name, {SIM} AS sim, row_number() OVER (PARTITION BY det_id ORDER BY {SIM} DESC, ref_order DESC) AS rn FROM b_detections d CROSS JOIN b_refs r)"


@register("detection_confidence_split", "SELECT det_id, det_score >= 0.85 AS can_be_unknown FROM b_detections WHERE det_score >= 0.5")
def detection_confidence_split(t: Tables):
    return I.detection_confidence_split(t.b_detections).select("det_id", "can_be_unknown")


@register("match_face_refs", f"WITH {BEST} SELECT det_id, round(sim, 6) AS similarity, CASE WHEN sim >= 0.2 THEN trigger_name END AS matched FROM best WHERE rn = 1")
def match_face_refs(t: Tables):
    return I.match_face_refs(t.b_detections, t.b_refs, 0.2).select("det_id", F.round("similarity", 6).alias("similarity"), "matched")


@register("match_scene_refs", f"SELECT det_id, trigger_name, round({SIM}, 6) AS similarity FROM b_detections d JOIN b_refs r ON {SIM} >= 0.2")
def match_scene_refs(t: Tables):
    return I.match_scene_refs(t.b_detections, t.b_refs, 0.2).select("det_id", "trigger_name", F.round("similarity", 6).alias("similarity"))


@register("unknown_faces", f"WITH {BEST} SELECT video_id, frame, coalesce(bool_or(det_score >= 0.85 AND sim < 0.2), false) AS has_unknown FROM best WHERE rn = 1 GROUP BY video_id, frame")
def unknown_faces(t: Tables):
    return I.unknown_faces(t.b_detections, t.b_refs, 0.2)


@register("attribute_speakers", f"""WITH n AS (SELECT det_id, w / 100.0 AS secs, r.trigger_name, 1 - {SIM} - CASE WHEN r.trigger_name = 'id-' || (det_id % 10) THEN 0.15 ELSE 0 END AS dist FROM b_detections d CROSS JOIN b_refs r),
k AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY dist, trigger_name) AS rn, lead(dist) OVER (PARTITION BY det_id ORDER BY dist, trigger_name) AS nxt FROM n)
SELECT det_id, round(dist, 6) AS distance, CASE WHEN secs >= 0.3 AND dist <= 0.85 AND nxt - dist >= 0.05 THEN trigger_name ELSE 'unknown' END AS speaker FROM k WHERE rn = 1""")
def attribute_speakers(t: Tables):
    seg = t.b_detections.select("det_id", "embedding", F.array(F.concat(F.lit("id-"), (F.col("det_id") % 10).cast("string"))).alias("on_screen"), F.lit(0.0).alias("t_start"), (F.col("w") / 100).alias("t_end"))
    return I.attribute_speakers(seg, t.b_refs, max_dist=0.85).select("det_id", F.round("distance", 6).alias("distance"), "speaker")


#: Ten frames count as one, so that a frame has several faces.
FACES = "(SELECT video_id, CAST(floor(frame / 10) AS INT) AS frame, det_id, x, y, w, h FROM b_detections)"


def faces(t: Tables):
    return t.b_detections.withColumn("frame", F.floor(F.col("frame") / 10).cast("int"))


@register("associate_boxes", f"""WITH p AS (SELECT a.det_id AS box_id, b.det_id, a.w * a.h AS s, b.w * b.h AS s2,
 greatest(0, least(a.x + 10 + a.w, b.x + b.w) - greatest(a.x + 10, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i FROM {FACES} a JOIN {FACES} b ON a.video_id = b.video_id AND a.frame = b.frame),
q AS (SELECT box_id, det_id, i::DOUBLE / (s + s2 - i) AS iou FROM p)
SELECT box_id, det_id, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY iou DESC, det_id) AS rn FROM q WHERE iou >= 0.3) z WHERE rn = 1""")
def associate_boxes(t: Tables):
    f = faces(t)
    boxes = f.select("video_id", "frame", F.col("det_id").alias("box_id"), (F.col("x") + 10).alias("x"), "y", "w", "h")
    return I.associate_boxes(boxes, f).select("box_id", "det_id", F.round("iou", 6).alias("iou"))


@register("largest_face", f"SELECT video_id, frame, det_id, area FROM (SELECT *, w * h AS area, row_number() OVER (PARTITION BY video_id, frame ORDER BY w * h DESC, det_id) AS rn FROM {FACES} f) z WHERE rn = 1")
def largest_face(t: Tables):
    return I.largest_face(faces(t))


@register("single_identity_gate", """WITH r AS (SELECT ref_embedding FROM b_refs WHERE ref_order = 5000),
f AS (SELECT video_id, frame, list_inner_product(d.embedding::DOUBLE[], (SELECT ref_embedding FROM r)::DOUBLE[]) AS sim FROM b_detections d WHERE det_score >= 0.8),
p AS (SELECT video_id, chunk_idx, i AS pos, start_frame + floor(i * (end_frame - start_frame) / 4)::INT AS frame FROM b_chunks CROSS JOIN range(0, 4) g(i)),
j AS (SELECT p.*, sim FROM p LEFT JOIN f ON f.video_id = p.video_id AND f.frame = p.frame WHERE p.frame >= 0)
SELECT video_id, chunk_idx, round(arg_min(sim, pos) FILTER (sim IS NOT NULL), 6) AS similarity, CASE WHEN count(sim) = 0 THEN 'no_face' WHEN arg_min(sim, pos) FILTER (sim IS NOT NULL) < 0 THEN 'face_mismatch' ELSE 'pass' END AS reason
FROM j GROUP BY video_id, chunk_idx""")
def single_identity_gate(t: Tables):
    target = t.b_refs.where("ref_order = 5000").first().ref_embedding
    pos = M.sample_positions(t.b_chunks).select("video_id", "chunk_idx", "pos", "frame")
    out = I.single_identity_gate(pos, t.b_detections.where("det_score >= 0.8"), list(target), 0.0)
    return out.select("video_id", "chunk_idx", F.round("similarity", 6).alias("similarity"), "reason")


#: Members of which some have no identity.
SOME = "(SELECT clip_id, CASE WHEN clip_id % 11 <> 0 THEN identity END AS identity FROM b_members)"


def some_members(t: Tables):
    return t.b_members.withColumn("identity", F.expr("CASE WHEN clip_id % 11 <> 0 THEN identity END"))


@register("identity_counts", f"SELECT identity, count(*) AS appearances, count(DISTINCT clip_id) AS clips, grouping(identity) = 1 AS is_total FROM {SOME} m GROUP BY ROLLUP(identity)")
def identity_counts(t: Tables):
    return I.identity_counts(some_members(t))


@register("dominant_identities", """WITH s AS (SELECT video_id, identity, count(DISTINCT pos) AS n FROM b_sightings GROUP BY ALL)
SELECT video_id, string_agg(identity, ',' ORDER BY identity) AS identities FROM (SELECT *, max(n) OVER (PARTITION BY video_id) AS m FROM s) z WHERE n >= m * 0.8 GROUP BY video_id""")
def dominant_identities(t: Tables):
    return I.dominant_identities(t.b_sightings, ["video_id"], 0.8).select("video_id", F.array_join("identities", ",").alias("identities"))


@register("relabel_diff", f"""WITH o AS (SELECT DISTINCT clip_id, identity FROM {SOME} m WHERE clip_id % 5 <> 0 OR identity < 'd'), n AS (SELECT DISTINCT clip_id, identity FROM {SOME} m WHERE clip_id % 3 <> 0 OR identity > 'd'),
x AS (SELECT *, 1 AS up FROM (SELECT * FROM n EXCEPT SELECT * FROM o) a UNION ALL SELECT *, 0 FROM (SELECT * FROM o EXCEPT SELECT * FROM n) r)
SELECT identity, count(*) FILTER (up = 1) AS added, count(*) FILTER (up = 0) AS removed, count(DISTINCT clip_id) AS clips, grouping(identity) = 1 AS is_total FROM x GROUP BY ROLLUP(identity)""")
def relabel_diff(t: Tables):
    m = some_members(t).distinct()
    return I.relabel_diff(m.where("clip_id % 5 <> 0 OR identity < 'd'"), m.where("clip_id % 3 <> 0 OR identity > 'd'"))


@register("capacity_limit", """WITH c AS (SELECT clip_id, CASE WHEN clip_id % 7 <> 0 THEN source_stem END AS source_stem FROM b_clips)
SELECT clip_id, source_stem FROM (SELECT *, row_number() OVER (ORDER BY source_stem NULLS FIRST, clip_id) AS rn FROM c) z WHERE rn <= (SELECT count(*) // 2 FROM b_clips)""")
def capacity_limit(t: Tables):
    clips = t.b_clips.select("clip_id", F.expr("CASE WHEN clip_id % 7 <> 0 THEN source_stem END AS source_stem"))
    return I.capacity_limit(clips, t.b_clips.count() // 2, ["clip_id"])


@register("capacity_shortfall", """SELECT *, greatest(20000 - samples, 0) AS shortfall, CASE WHEN samples < 20000 THEN CASE WHEN pool_remaining > 0 THEN 'mine more' ELSE 'add sources' END END AS advice
FROM (SELECT (SELECT count(*) FROM b_clips) AS samples, (SELECT count(*) FROM b_chunks) AS pool_remaining) z""")
def capacity_shortfall(t: Tables):
    return I.capacity_shortfall(t.b_clips, t.b_chunks, 20_000)


@register("shuffle_pool", "SELECT clip_id, md5('42:' || clip_id) AS shuffle_key, row_number() OVER (ORDER BY md5('42:' || clip_id), clip_id) AS place FROM b_clips")
def shuffle_pool(t: Tables):
    return I.shuffle_pool(t.b_clips, 42, "clip_id").select("clip_id", "shuffle_key", "place")


@register("chunk_grid", """WITH v AS (SELECT *, CAST(round_even(2 * fps, 0) AS INT) AS f, greatest(CAST(round_even(2 * fps, 0) AS INT), total_frames - CAST(round_even(1.5::DOUBLE * fps, 0) AS INT)) AS l,
CASE WHEN abs(fps - 24) > 0.5 THEN CAST(ceil(49 * (fps / 24)) AS INT) + 2 ELSE 49 END AS n FROM b_videos)
SELECT video_id, CAST(i AS INT) AS chunk_idx, CAST(f + i * n AS INT) AS start_frame, CAST(f + i * n + n AS INT) AS end_frame FROM (SELECT *, unnest(range(0, CAST(floor((l - f) / n) AS BIGINT))) AS i FROM v) z""")
def chunk_grid(t: Tables):
    return M.chunk_grid(t.b_videos, 49, 24.0, 2.0, 1.5).select("video_id", "chunk_idx", "start_frame", "end_frame")


POS = "pos AS (SELECT video_id, chunk_idx, CAST(i AS INT) AS pos, CAST(start_frame + floor(i * (end_frame - start_frame) / 4) AS INT) AS frame, start_frame, end_frame FROM b_chunks CROSS JOIN range(0, 4) g(i))"


@register("sample_positions", f"WITH {POS} SELECT video_id, chunk_idx, frame FROM pos")
def sample_positions(t: Tables):
    return M.sample_positions(t.b_chunks).select("video_id", "chunk_idx", "frame")


@register("extraction_plan", """SELECT video_id, chunk_idx, round(start_frame / fps, 4) AS start_sec, round((end_frame - start_frame) / fps, 4) AS duration_sec, CASE WHEN abs(fps - 24) > 0.5 THEN 16 ELSE end_frame - start_frame END AS out_frames,
round(CASE WHEN abs(fps - 24) > 0.5 THEN 16 / 24.0::DOUBLE ELSE (end_frame - start_frame) / fps END, 4) AS audio_sec FROM b_chunks JOIN b_videos USING (video_id)""")
def extraction_plan(t: Tables):
    c = t.b_chunks.join(t.b_videos.select("video_id", "fps"), "video_id")
    return M.extraction_plan(c, 16, 24.0).select("video_id", "chunk_idx", "start_sec", "duration_sec", "out_frames", "audio_sec")


VAL = f"""{POS}, val AS (SELECT p.video_id, p.chunk_idx, count(*) FILTER (coalesce(hit, false)) AS hits, count(*) FILTER (coalesce(m.unknown, false)) AS unknowns, count(*) AS n_pos,
 array_to_string(list(coalesce(hit, false) ORDER BY pos), ',') AS has_hit FROM pos p LEFT JOIN b_matches m ON m.video_id = p.video_id AND m.frame = p.frame GROUP BY p.video_id, p.chunk_idx)"""


@register("validate_chunks", f"""{'WITH ' + POS}, s AS (SELECT p.*, CASE WHEN f.event_id % 5 < 3 THEN f.event_type END AS identity, coalesce(f.event_id % 7 = 0, false) AS u FROM pos p LEFT JOIN b_frames f ON f.video_id = p.video_id AND f.frame = p.frame),
c AS (SELECT video_id, chunk_idx, identity, count(*) AS n FROM s WHERE identity IS NOT NULL GROUP BY ALL), cs AS (SELECT video_id, chunk_idx, string_agg(identity || '=' || n, ',' ORDER BY identity) AS counts FROM c GROUP BY ALL)
SELECT s.video_id, s.chunk_idx, count(*) FILTER (identity IS NOT NULL) AS hits, array_to_string(list(identity IS NOT NULL ORDER BY pos), ',') AS has_hit, count(*) FILTER (u) AS unknowns, count(*) AS n_pos, any_value(counts) AS counts
FROM s LEFT JOIN cs ON cs.video_id = s.video_id AND cs.chunk_idx = s.chunk_idx GROUP BY s.video_id, s.chunk_idx""")
def validate_chunks(t: Tables):
    f = t.b_frames
    pos = M.sample_positions(t.b_chunks).select("video_id", "chunk_idx", "pos", "frame")
    out = M.validate_chunks(pos, f.where("event_id % 5 < 3").select("video_id", "frame", F.col("event_type").alias("identity")), f.where("event_id % 7 = 0").select("video_id", "frame"))
    named = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("video_id", "chunk_idx", "hits", F.array_join(F.col("has_hit").cast("array<string>"), ",").alias("has_hit"), "unknowns", "n_pos", named.alias("counts"))


@register("chunk_gate", f"""WITH {VAL} SELECT video_id, chunk_idx, CASE WHEN hits = 0 AND chunk_idx % 2 = 0 THEN 'no_known_character' WHEN hits = 0 THEN 'skip' WHEN hits < greatest(1, round_even(0.75 * n_pos, 0)) THEN 'insufficient_character_presence'
WHEN unknowns > round_even(0.25 * n_pos, 0) THEN 'unknown_face' ELSE 'pass' END AS reason FROM val""")
def chunk_gate(t: Tables):
    v = M.validate_ranges(t.b_chunks, t.b_matches, ["video_id", "chunk_idx"]).withColumn("n_seen", F.col("chunk_idx") % 2)
    return M.chunk_gate(v).select("video_id", "chunk_idx", "reason")


CAND = f"""{VAL}, moves AS (SELECT CAST(k AS INT) AS k, CASE WHEN k <= 8 THEN -k * 0.25 ELSE (k - 8) * 0.25 END AS part FROM range(1, 17) g(k)),
own AS (SELECT c.*, hits, unknowns, n_pos, hits >= greatest(1, round_even(0.75 * n_pos, 0)) AND unknowns <= round_even(0.25 * n_pos, 0) AS passes FROM b_chunks c JOIN val USING (video_id, chunk_idx)),
mv AS (SELECT video_id, chunk_idx, k, CAST(CASE WHEN part < 0 THEN -1 ELSE 1 END * floor(floor((end_frame - start_frame) * abs(part)) / 8) * 8 AS INT) AS shift, start_frame, end_frame, first_frame, last_frame FROM own CROSS JOIN moves WHERE hits > 0 AND n_pos >= 2 AND NOT (passes AND hits = n_pos)),
ins AS (SELECT *, start_frame + shift AS a, end_frame + shift AS b FROM mv WHERE shift <> 0 AND start_frame + shift >= first_frame AND end_frame + shift <= last_frame),
tp AS (SELECT DISTINCT video_id, chunk_idx, k, shift, a + CAST(floor(i * (b - a) / n) AS INT) AS frame, i FROM (SELECT *, 4 AS n FROM ins) q CROSS JOIN range(0, 4) g(i)),
tv AS (SELECT p.video_id, p.chunk_idx, k, shift, count(*) FILTER (coalesce(hit, false)) AS hits, count(*) FILTER (coalesce(m.unknown, false)) AS unknowns, count(*) AS n_pos,
 min(p.frame) FILTER (coalesce(hit, false)) AS fh, max(p.frame) FILTER (coalesce(hit, false)) AS lh FROM tp p LEFT JOIN b_matches m ON m.video_id = p.video_id AND m.frame = p.frame GROUP BY ALL),
oh AS (SELECT p.video_id, p.chunk_idx, min(p.frame) FILTER (coalesce(hit, false)) AS fh, max(p.frame) FILTER (coalesce(hit, false)) AS lh FROM pos p LEFT JOIN b_matches m ON m.video_id = p.video_id AND m.frame = p.frame GROUP BY ALL),
cand AS (SELECT video_id, chunk_idx, 0 AS k, 0 AS shift, hits, unknowns, n_pos, fh, lh FROM own JOIN oh USING (video_id, chunk_idx) WHERE passes
 UNION ALL SELECT * FROM tv WHERE hits >= greatest(1, round_even(0.75 * n_pos, 0)) AND unknowns <= round_even(0.25 * n_pos, 0))"""


@register("shift_search", f"""WITH {CAND} SELECT video_id, chunk_idx, shift, hits, unknowns FROM (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_idx ORDER BY hits DESC, CASE WHEN hits = n_pos THEN 0 ELSE unknowns END,
CASE WHEN hits = n_pos THEN 0 ELSE abs(shift) END, k) AS rn FROM cand) z WHERE rn = 1""")
def shift_search(t: Tables):
    return M.shift_search(t.b_chunks, t.b_matches).select("video_id", "chunk_idx", "shift", "hits", "unknowns")


#: As CAND, with moves of 1.5 and 2 lengths only, a quarter of hits required, and three quarters of unknown faces allowed.
WIDE = CAND.replace("SELECT CAST(k AS INT) AS k, CASE WHEN k <= 8 THEN -k * 0.25 ELSE (k - 8) * 0.25 END AS part FROM range(1, 17) g(k)", "SELECT * FROM (VALUES (1, -1.5), (2, -2.0), (3, 1.5), (4, 2.0)) v(k, part)")
WIDE = WIDE.replace("round_even(0.25 * n_pos, 0)", "round_even(3 * n_pos / 4, 0)").replace("round_even(0.75 * n_pos, 0)", "round_even(n_pos / 4, 0)")


@register(
    "shift_extend",
    f"""WITH {WIDE},
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY video_id, chunk_idx
  ORDER BY hits DESC, CASE WHEN hits = n_pos THEN 0 ELSE unknowns END, CASE WHEN hits = n_pos THEN 0 ELSE abs(shift) END, k) = 1),
far AS (SELECT c.*, hits AS hits_before, sign(shift) AS side, end_frame - start_frame AS size FROM best JOIN b_chunks c USING (video_id, chunk_idx)
  WHERE shift <> 0 AND hits < n_pos AND abs(shift) >= floor((end_frame - start_frame) * 2 / 8) * 8),
further AS (SELECT *, CAST(o AS INT) AS search_order, CAST(side * floor(floor(size * (2 + o * 0.25)) / 8) * 8 AS INT) AS shift FROM far CROSS JOIN range(1, 9) g(o)),
seen AS (SELECT f.video_id, chunk_idx, search_order, shift, hits_before, start_frame + shift >= first_frame AND end_frame + shift <= last_frame AS inside,
  count(*) FILTER (coalesce(hit, false)) AS hits, count(*) FILTER (coalesce(m.unknown, false)) AS unknowns, count(*) AS n_pos
  FROM further f CROSS JOIN range(0, 4) p(i) LEFT JOIN b_matches m ON m.video_id = f.video_id AND m.frame = start_frame + shift + CAST(floor(i * size / 4) AS INT) GROUP BY ALL),
judged AS (SELECT *, inside AND hits >= greatest(1, round_even(n_pos / 4, 0)) AND unknowns <= round_even(3 * n_pos / 4, 0)
  AND hits >= coalesce(lag(hits) OVER w, hits_before) AND NOT coalesce(lag(hits = n_pos) OVER w, false) AS good
  FROM seen WINDOW w AS (PARTITION BY video_id, chunk_idx ORDER BY search_order))
SELECT video_id, chunk_idx, search_order, shift, hits, unknowns, n_pos FROM judged
QUALIFY bool_and(good) OVER (PARTITION BY video_id, chunk_idx ORDER BY search_order)""",
)
def shift_extend(t: Tables):
    # a wide tolerance, so that many chunks end at the farthest move
    best = M.shift_search(t.b_chunks, t.b_matches, required=0.25, unknown=0.75, fractions=(1.5, 2.0))
    return M.shift_extend(best, t.b_matches, required=0.25, unknown=0.75)


@register("hit_centered_probe", f"""WITH {CAND.replace("range(1, 17) g(k))", "range(1, 17) g(k) WHERE k % 4 = 0)")}, best AS (SELECT video_id, chunk_idx, shift AS bs FROM (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_idx ORDER BY hits DESC, unknowns, abs(shift), k) AS rn, max((hits = n_pos)::INT) OVER (PARTITION BY video_id, chunk_idx) AS perfect FROM cand) z WHERE rn = 1 AND perfect = 0),
pool AS (SELECT b.video_id, b.chunk_idx, floor((min(fh) + max(lh)) / 2) AS center FROM best b JOIN cand c USING (video_id, chunk_idx) JOIN b_chunks k USING (video_id, chunk_idx) WHERE abs(c.shift - bs) <= k.end_frame - k.start_frame GROUP BY ALL),
pr AS (SELECT p.video_id, p.chunk_idx, start_frame, end_frame, first_frame, last_frame, CAST(round_even((center - (start_frame + floor((end_frame - start_frame) / 2))) / 8, 0) * 8 AS INT) AS shift FROM pool p JOIN b_chunks USING (video_id, chunk_idx)),
ok AS (SELECT * FROM pr WHERE shift <> 0 AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.video_id = pr.video_id AND c.chunk_idx = pr.chunk_idx AND c.shift = pr.shift) AND start_frame + shift >= first_frame AND end_frame + shift <= last_frame),
pp AS (SELECT video_id, chunk_idx, shift, start_frame + shift + CAST(floor(i * (end_frame - start_frame) / 4) AS INT) AS frame FROM ok CROSS JOIN range(0, 4) g(i)),
pv AS (SELECT pp.video_id, pp.chunk_idx, shift, count(*) FILTER (coalesce(hit, false)) AS hits, count(*) FILTER (coalesce(m.unknown, false)) AS unknowns, count(*) AS n_pos FROM pp LEFT JOIN b_matches m ON m.video_id = pp.video_id AND m.frame = pp.frame GROUP BY ALL)
SELECT video_id, chunk_idx, shift, hits, unknowns, n_pos FROM pv WHERE hits >= greatest(1, round_even(0.75 * n_pos, 0)) AND unknowns <= round_even(0.25 * n_pos, 0)""")
def hit_centered_probe(t: Tables):
    c = M.candidates(t.b_chunks, t.b_matches, fractions=(1.0, 2.0))
    return M.hit_centered_probe(c, t.b_chunks, t.b_matches)


@register("consumed_neighbors", """WITH c AS (SELECT video_id, chunk_idx, CAST((video_id % 5 - 2) * 12 AS INT) AS shift, end_frame - start_frame AS len FROM b_chunks)
SELECT DISTINCT video_id, CAST(chunk_idx + sign(shift) * k AS INT) AS chunk_idx FROM (SELECT *, unnest(range(1, CAST(ceil(abs(shift) / len) AS BIGINT) + 1)) AS k FROM c WHERE shift <> 0) z WHERE chunk_idx + sign(shift) * k >= 0""")
def consumed_neighbors(t: Tables):
    return M.consumed_neighbors(t.b_chunks.withColumn("shift", ((F.col("video_id") % 5 - 2) * 12).cast("int")))


@register("resume_position", """WITH p AS (SELECT video_id, CAST(video_id % 4 AS INT) AS nxt FROM b_videos WHERE video_id % 3 = 0), c AS (SELECT video_id, max(chunk_idx) + 1 AS aft FROM b_chunks GROUP BY video_id)
SELECT video_id, coalesce(nxt, aft, 0) AS next_chunk FROM b_videos LEFT JOIN p USING (video_id) LEFT JOIN c USING (video_id)""")
def resume_position(t: Tables):
    progress = t.b_videos.where("video_id % 3 = 0").select("video_id", (F.col("video_id") % 4).cast("int").alias("next_idx"))
    return M.resume_position(t.b_videos.select("video_id"), progress, t.b_chunks)


BOX = "(SELECT d.det_id, d.x, d.y, d.w, d.h, v.width AS fw, v.height AS fh FROM b_detections d JOIN b_videos v ON v.video_id = d.video_id)"


@register("crop_windows", f"""WITH b AS (SELECT *, x + w // 2 AS cx, y + h // 2 AS cy, greatest(w, h) * 1.6::DOUBLE AS p, CASE WHEN fw::DOUBLE / fh > 1.5 THEN CAST(trunc(fh * 1.5::DOUBLE) AS INT) ELSE fw END AS mw, CASE WHEN fw::DOUBLE / fh > 1.5 THEN fh ELSE CAST(trunc(fw / 1.5::DOUBLE) AS INT) END AS mh FROM {BOX} z),
f AS (SELECT *, least(p * 1.5, fw) AS a, least(p, fh) AS c FROM b), g AS (SELECT *, CAST(trunc(CASE WHEN a / c > 1.5 THEN c * 1.5 ELSE a END) AS INT) AS cw, CAST(trunc(CASE WHEN a / c > 1.5 THEN c ELSE a / 1.5 END) AS INT) AS ch, (fw - mw) // 2 AS l, (fh - mh) // 2 AS t FROM f)
SELECT det_id, greatest(0, least(cx - cw // 2, fw - cw)) AS face_x, greatest(0, least(cy - ch // 2, fh - ch)) AS face_y, cw AS face_w, ch AS face_h, l AS center_x, t AS center_y, mw AS center_w, mh AS center_h,
greatest(0, least(CASE WHEN cx < l + w // 2 THEN cx - w // 2 WHEN cx > l + mw - w // 2 THEN cx + w // 2 - mw ELSE l END, fw - mw)) AS pan_x,
greatest(0, least(CASE WHEN cy < t + h // 2 THEN cy - h // 2 WHEN cy > t + mh - h // 2 THEN cy + h // 2 - mh ELSE t END, fh - mh)) AS pan_y FROM g""")
def crop_windows(t: Tables):
    rows = t.b_detections.join(t.b_videos.select("video_id", "width", "height"), "video_id").select("det_id", "x", "y", "w", "h", "width", "height")
    for mode in ("face", "center", "pan"):
        rows = G.crop_windows(rows, 768, 512, mode)
        rows = rows.withColumnsRenamed({f"crop_{c}": f"{mode}_{c}" for c in "xywh"})
    return rows.select("det_id", "face_x", "face_y", "face_w", "face_h", "center_x", "center_y", "center_w", "center_h", "pan_x", "pan_y")


@register("fit_resolution", """WITH s AS (SELECT video_id, CAST(trunc(width * least(768.0::DOUBLE / width, 512.0::DOUBLE / height)) AS INT) AS new_w, CAST(trunc(height * least(768.0::DOUBLE / width, 512.0::DOUBLE / height)) AS INT) AS new_h,
CAST(trunc(sqrt(768 * 512 / (width::DOUBLE / height))) AS INT) AS tall, width::DOUBLE / height AS asp FROM b_videos)
SELECT video_id, new_w, new_h, (768 - new_w) // 2 AS pad_x, (512 - new_h) // 2 AS pad_y, greatest(32, CAST(round_even(trunc(tall * asp) / 32, 0) * 32 AS INT)) AS budget_w, greatest(32, CAST(round_even(tall / 32.0::DOUBLE, 0) * 32 AS INT)) AS budget_h FROM s""")
def fit_resolution(t: Tables):
    rows = G.fit_resolution(t.b_videos, 768, 512, "budget").withColumnsRenamed({"new_w": "budget_w", "new_h": "budget_h"}).drop("pad_x", "pad_y")
    return G.fit_resolution(rows, 768, 512).select("video_id", "new_w", "new_h", "pad_x", "pad_y", "budget_w", "budget_h")


@register("parse_buckets", "SELECT * FROM (VALUES (768, 512, 49), (512, 512, 25), (768, 512, 1), (512, 512, 1)) v(width, height, frames) WHERE (SELECT count(*) FROM b_files WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg)$')) > 0")
def parse_buckets(t: Tables):
    return G.parse_buckets(t.b_files, "768x512x49;512x512x25;768x512x1")


QUOTAS = "quotas AS (SELECT identity, CAST(600 // 5 + CASE WHEN row_number() OVER (ORDER BY identity) <= 600 % 5 THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT DISTINCT identity FROM b_members) z)"


@register("quota_table", """WITH i AS (SELECT identity, row_number() OVER (ORDER BY identity) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT identity FROM b_members) z),
q AS (SELECT identity, CAST(8003 // k + CASE WHEN i < 8003 % k THEN 1 ELSE 0 END AS BIGINT) AS quota FROM i), c AS (SELECT identity, count(*) AS n FROM b_members GROUP BY identity)
SELECT identity, quota, coalesce(n, 0) AS n, greatest(0, coalesce(n, 0) - quota) AS over, greatest(0, quota - coalesce(n, 0)) AS under, coalesce(n, 0) >= quota AS met FROM q LEFT JOIN c USING (identity)""")
def quota_table(t: Tables):
    m = t.b_members
    return Q.quota_table(m.groupBy("identity").agg(F.count("*").alias("n")), m.select("identity"), 8003)


def quotas(t: Tables, part: float):
    """A quota for each identity: a part of what there is."""
    return t.b_members.groupBy("identity").agg(F.floor(F.count("*") * part).cast("bigint").alias("quota"))


@register(
    "rebalance_over_quota",
    """WITH RECURSIVE counted AS (SELECT identity, count(*) - floor(count(*) * 0.9::DOUBLE)::BIGINT AS excess FROM (SELECT DISTINCT clip_id, identity FROM b_members) d GROUP BY identity),
clips AS (SELECT clip_id, list_sort(list(identity)) AS signature, max(excess) AS most FROM (SELECT DISTINCT clip_id, identity FROM b_members) d JOIN counted USING (identity) GROUP BY clip_id),
m AS MATERIALIZED (SELECT clip_id, signature, row_number() OVER (ORDER BY most DESC, clip_id) AS n FROM clips),
walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS clip_id, NULL::VARCHAR[] AS signature, false AS gone, (SELECT list({'identity': identity, 'excess': excess}) FROM counted) AS spare
 UNION ALL SELECT n, clip_id, signature, gone, CASE WHEN gone THEN list_transform(spare, lambda x: {'identity': x.identity, 'excess': x.excess - list_contains(signature, x.identity)::BIGINT}) ELSE spare END
 FROM (SELECT m.n, m.clip_id::BIGINT AS clip_id, m.signature, len(list_filter(w.spare, lambda x: x.excess <= 0 AND list_contains(m.signature, x.identity))) = 0 AS gone, w.spare FROM walk w JOIN m ON m.n = w.n + 1))
SELECT clip_id, array_to_string(signature, ',') AS signature FROM walk WHERE gone""",
)
def rebalance_over_quota(t: Tables):
    return Q.rebalance_over_quota(I.signatures(t.b_members), quotas(t, 0.9)).select("clip_id", F.array_join("signature", ",").alias("signature"))


@register(
    "quota_intake",
    """WITH RECURSIVE sig AS (SELECT clip_id, list_sort(list(DISTINCT identity)) AS g FROM b_members GROUP BY clip_id),
one AS (SELECT DISTINCT clip_id, identity FROM b_members), h AS (SELECT identity, count(*) FILTER (clip_id % 2 = 1) AS n, floor(count(*) * 0.5::DOUBLE)::BIGINT AS q FROM one GROUP BY identity),
pool AS (SELECT list({'clip': clip_id::BIGINT, 'g': g, 'new': clip_id % 2 = 0} ORDER BY len(g), clip_id % 2 = 0, clip_id) AS p FROM sig),
m AS MATERIALIZED (SELECT clip_id, g, row_number() OVER (ORDER BY clip_id) AS n FROM sig WHERE clip_id % 2 = 0),
walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS clip_id, (SELECT list({'identity': identity, 'n': n, 'q': q}) FROM h) AS counts, []::BIGINT[] AS gone, []::BIGINT[] AS taken, NULL::BOOLEAN AS accepted, NULL::BIGINT AS swapped
 UNION ALL SELECT n, clip_id, CASE WHEN accepted THEN list_transform(counts, lambda x: {'identity': x.identity, 'n': x.n + list_contains(g, x.identity)::BIGINT - coalesce(list_contains(leaver.g, x.identity), false)::BIGINT, 'q': x.q}) ELSE counts END,
  CASE WHEN leaver IS NOT NULL THEN list_append(gone, leaver.clip) ELSE gone END, CASE WHEN accepted THEN list_append(taken, clip_id) ELSE taken END, accepted, leaver.clip
 FROM (SELECT *, NOT stop AND (len(hit) = 0 OR leaver IS NOT NULL) AS accepted
 FROM (SELECT *, CASE WHEN NOT stop AND len(hit) > 0 AND len(hit) < len(g) THEN list_filter((SELECT p FROM pool), lambda x: len(x.g) < len(g) AND list_has_all(g, x.g) AND list_has_all(x.g, hit) AND NOT list_contains(gone, x.clip) AND (NOT x.new OR list_contains(taken, x.clip)))[1] END AS leaver
 FROM (SELECT m.n, m.clip_id::BIGINT AS clip_id, m.g, w.counts, w.gone, w.taken, len(list_filter(w.counts, lambda x: x.n < x.q)) = 0 AS stop, list_filter(m.g, lambda c: len(list_filter(w.counts, lambda x: x.identity = c AND x.n >= x.q)) > 0) AS hit
 FROM walk w JOIN m ON m.n = w.n + 1))))
SELECT clip_id, accepted, swapped FROM walk WHERE n > 0""",
)
def quota_intake(t: Tables):
    sig = I.signatures(t.b_members)
    q = quotas(t, 0.5)
    new = sig.where("clip_id % 2 = 0").withColumn("pos", F.col("clip_id").cast("long"))
    most = int(q.agg(F.sum("quota")).first()[0] or 0)
    out = Q.quota_intake(new, sig.where("clip_id % 2 = 1"), q, most)
    return out.select("clip_id", "accepted", "swapped")


@register("swap_candidates", """WITH s AS (SELECT clip_id, list(DISTINCT identity ORDER BY identity) AS g FROM b_members GROUP BY clip_id), met AS (SELECT list(identity ORDER BY identity) AS f FROM (SELECT DISTINCT identity FROM b_members) z WHERE identity < 'p'),
n AS (SELECT DISTINCT g, list_sort(list_intersect(g, (SELECT f FROM met))) AS held FROM s WHERE clip_id % 2 = 0), o AS (SELECT DISTINCT g FROM s WHERE clip_id % 2 = 1),
p AS (SELECT n.g, o.g AS og, row_number() OVER (PARTITION BY n.g ORDER BY len(o.g), o.g) AS rn FROM n JOIN o ON len(held) > 0 AND list_has_all(n.g, o.g) AND len(o.g) < len(n.g) AND list_has_all(o.g, held))
SELECT clip_id, array_to_string(p.og, ',') AS swap FROM s LEFT JOIN p ON p.g = s.g AND rn = 1 WHERE clip_id % 2 = 0""")
def swap_candidates(t: Tables):
    sig = I.signatures(t.b_members)
    met = t.b_members.select("identity").distinct().withColumn("met", F.col("identity") < "p")
    return Q.swap_candidates(sig.where("clip_id % 2 = 0"), sig.where("clip_id % 2 = 1"), met).select("clip_id", F.array_join("swap", ",").alias("swap"))


@register("encode_missing", """SELECT stem, 'conditions' AS kind, CASE WHEN caption = '' THEN NULL ELSE CAST(length(caption) // 4 + 1 AS INT) END AS token_len FROM b_entries e WHERE NOT EXISTS (SELECT 1 FROM b_artifacts a WHERE a.stem = e.stem AND a.kind = 'conditions')""")
def encode_missing(t: Tables):
    def lengths(f):
        return f[["stem"]].assign(token_len=(f["caption"].str.len() // 4 + 1).astype("Int32"))

    return E.encode_missing(t.b_entries.select("stem", "caption"), t.b_artifacts, "conditions", lengths, "caption", "stem string, token_len int")
