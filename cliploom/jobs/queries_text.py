"""Queries over captions, replies, transcripts and dialogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import captions as C

from . import Tables, register

#: Every text as a reply: after a thought, before an open one, in marks, or with a verdict.
REPLY = "(SELECT doc_id, 'name ' || doc_id AS name, CASE doc_id % 4 WHEN 0 THEN '<think>x</think> ' || text WHEN 1 THEN text || ' <think> open' WHEN 2 THEN '**' || text || '** [le]' ELSE text || ' MisMatch' END AS reply FROM documents)"


def replies(t: Tables):
    return t.documents.select("doc_id", F.expr("concat('name ', doc_id) AS name"), F.expr("CASE doc_id % 4 WHEN 0 THEN concat('<think>x</think> ', text) WHEN 1 THEN concat(text, ' <think> open') WHEN 2 THEN concat('**', text, '** [le]') ELSE concat(text, ' MisMatch') END AS reply"))


THOUGHT = "regexp_replace(regexp_replace(trim({0}), '<think>.*?</think>', '', 'gs'), '<think>.*', '', 's')"
PLAIN = f"trim(translate(regexp_replace({THOUGHT.format('coalesce(reply, chr(32))')}, '[*_`]+', '', 'g'), '[]{{}}\"''', '      '))"


@register("filter_hallucinated", """SELECT doc_id, length(regexp_replace(c, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(c, '[^\\p{L}]', '', 'g')) AS letters,
CASE WHEN trim(c) = '' THEN 'silent' WHEN length(regexp_replace(c, '[^\\p{L}]', '', 'g')) > 0 AND length(regexp_replace(c, '[^A-Za-z]', '', 'g'))::DOUBLE / length(regexp_replace(c, '[^\\p{L}]', '', 'g')) < 0.9 THEN 'hallucination' ELSE 'speech' END AS speech_state
FROM (SELECT doc_id, coalesce(caption, '') AS c FROM b_captions) x""")
def filter_hallucinated(t: Tables):
    return C.filter_hallucinated(t.b_captions, min_latin=0.9).select("doc_id", F.col("latin").cast("bigint"), F.col("letters").cast("bigint"), "speech_state")


@register("first_ok_caption", """SELECT clip_id, arg_min(caption, attempt) FILTER (length(caption) <= 600) AS caption, min(attempt) FILTER (length(caption) <= 600) AS attempt,
CASE WHEN count(*) FILTER (length(caption) <= 600) = 0 THEN 'caption_too_long' END AS reason FROM b_attempts WHERE attempt < 3 GROUP BY clip_id""")
def first_ok_caption(t: Tables):
    return C.first_ok_caption(t.b_attempts)


@register("normalize_caption")
def normalize_caption(t: Tables):
    return C.normalize_caption(t.b_captions, t.b_names).select("doc_id", "caption")


@register("speaker_display", """SELECT clip_id, line, CASE WHEN s IN ('', 'unknown') THEN 'Someone' ELSE array_to_string(list_transform(list_filter(string_split(replace(s, '_', '-'), '-'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS display,
array_to_string(list_transform(list_filter(string_split(s, ' '), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title
FROM (SELECT clip_id, line, CASE line % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'miss-' || speaker WHEN 2 THEN speaker || '_von  gast' ELSE '' END AS s FROM b_lines) x""")
def speaker_display(t: Tables):
    rows = t.b_lines.withColumn("s", F.expr("CASE line % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN concat('miss-', speaker) WHEN 2 THEN concat(speaker, '_von  gast') ELSE '' END"))
    return rows.select("clip_id", "line", C.speaker_display(F.col("s")).alias("display"), C.title_display(F.col("s")).alias("title"))


@register("clean_reply", f"SELECT doc_id, coalesce(nullif(trim({THOUGHT.format('reply')}), ''), trim('tok ' || name)) AS clean FROM {REPLY} r")
def clean_reply(t: Tables):
    return C.clean_reply(replies(t), "tok").select("doc_id", "clean")


#: Names that differ in case only are one; each reply with the names in it, by their order.
FOUND = f"""n AS (SELECT lower(name) AS k, min(ref_order) AS at, arg_max(name, ref_order) AS name FROM b_names WHERE name <> '' GROUP BY lower(name)),
r AS (SELECT doc_id, {PLAIN} AS p FROM {REPLY} r),
f AS (SELECT doc_id, any_value(p) AS p, list(n.name ORDER BY n.at) FILTER (n.name IS NOT NULL) AS found
  FROM r LEFT JOIN n ON contains(lower(p), n.k) AND regexp_matches(lower(p), '(^|[^a-z0-9])' || regexp_escape(n.k) || '($|[^a-z0-9])') GROUP BY doc_id)"""


def _refuse(phrases: tuple[str, ...]) -> str:
    return "(p = '' OR upper(p) = 'NONE' OR " + " OR ".join("contains(upper(p), '" + x.replace("'", "''") + "')" for x in phrases) + ")"


@register("parse_cast_reply", f"WITH {FOUND} SELECT doc_id, CASE WHEN {_refuse(C.NO_CAST)} THEN '' ELSE coalesce(array_to_string(found, ','), '') END AS cast_names FROM f")
def parse_cast_reply(t: Tables):
    return C.parse_cast_reply(replies(t), t.b_names).select("doc_id", F.array_join("cast_names", ",").alias("cast_names"))


@register("parse_location_reply", f"WITH {FOUND} SELECT doc_id, CASE WHEN NOT {_refuse(C.NO_LOCATION)} THEN found[1] END AS location FROM (SELECT doc_id, trim(p, '. ') AS p, found FROM f) x")
def parse_location_reply(t: Tables):
    return C.parse_location_reply(replies(t), t.b_names).select("doc_id", "location")


@register("verdict_parse", f"SELECT doc_id, CASE WHEN contains(upper(reply), 'MISMATCH') THEN 'reject' ELSE 'match' END AS verdict FROM {REPLY} r")
def verdict_parse(t: Tables):
    return C.verdict_parse(replies(t)).select("doc_id", "verdict")


@register("filename_caption", """SELECT entry_id, 'tok ' || trim(regexp_replace(translate(regexp_replace(regexp_replace(stem, '_img$', ''), '_chunk\\d+$', ''), '_-', '  '), '\\s+', ' ', 'g')) AS caption FROM b_entries""")
def filename_caption(t: Tables):
    return C.filename_caption(t.b_entries, "auto", "tok").select("entry_id", "caption")


#: Entries of urgent orders have no caption at all, and every fourth one has attributed segments.
SAID = "(SELECT entry_id, transcript, CASE WHEN caption LIKE '%urgent' THEN NULL ELSE caption END AS caption FROM b_entries)"


@register("merge_transcript", f"""SELECT entry_id, CASE WHEN coalesce(transcript, '') <> '' AND entry_id % 4 <> 0 THEN caption END AS caption_original,
CASE WHEN coalesce(transcript, '') <> '' AND entry_id % 4 <> 0 THEN CASE WHEN coalesce(caption, '') = '' THEN '' ELSE caption || ' ' END || 'Dialogue: "' || transcript || '"' ELSE caption END AS caption FROM {SAID} s""")
def merge_transcript(t: Tables):
    rows = t.b_entries.withColumn("caption", F.when(~F.col("caption").endswith("urgent"), F.col("caption")))
    rows = rows.withColumn("transcript_segments", F.when(F.col("entry_id") % 4 == 0, F.array(F.lit("x"))))
    return C.merge_transcript(rows).select("entry_id", "caption_original", "caption")


LIST = "(SELECT clip_id, string_agg(CASE WHEN line % 3 = 2 THEN '   ' ELSE (line + 1) || '. ' || text END, chr(10) ORDER BY line) AS dialogue FROM b_lines GROUP BY clip_id)"


@register("parse_dialogue_list", f"""SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY i) - 1 AS INT) AS pos, text FROM
(SELECT clip_id, i, regexp_replace(trim(x), '^\\d+\\.\\s*', '') AS text FROM (SELECT clip_id, unnest(string_split(dialogue, chr(10))) AS x, generate_subscripts(string_split(dialogue, chr(10)), 1) AS i FROM {LIST} l) a) b WHERE text <> ''""")
def parse_dialogue_list(t: Tables):
    line = F.expr("CASE WHEN line % 3 = 2 THEN '   ' ELSE concat(line + 1, '. ', text) END")
    lists = t.b_lines.withColumn("x", line).groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x"))), lambda s: s["x"]), "\n").alias("dialogue"))
    return C.parse_dialogue_list(lists)


TAG = "CASE speaker WHEN 'system' THEN 's' WHEN 'user' THEN 'a' ELSE 'd' END"


@register("parse_script", f"""WITH p AS (SELECT clip_id, line, {TAG} AS tag, trim(text, concat(' ', chr(10), chr(9), chr(13))) AS x FROM b_lines WHERE trim(text, concat(' ', chr(10), chr(9), chr(13))) <> ''),
d AS (SELECT clip_id, x, row_number() OVER (PARTITION BY clip_id ORDER BY line) AS n FROM p WHERE tag = 'd'),
v AS (SELECT clip_id, string_agg(CASE tag WHEN 's' THEN 'Style: ' || x || '.' WHEN 'a' THEN upper(left(x, 1)) || substr(x, 2) || CASE WHEN regexp_matches(x, '[.!?]$') THEN '' ELSE '.' END ELSE '"' || x || '"' END, ' ' ORDER BY line) AS visual_prompt FROM p GROUP BY clip_id)
SELECT v.clip_id, v.visual_prompt, coalesce(max(x) FILTER (n = 2), '') AS audio_prompt, CAST(count(x) AS INT) AS dialogue_count, CAST(least(2, count(x)) AS INT) AS current_index,
coalesce(string_agg(n || '. ' || x, chr(10) ORDER BY n), '') AS dialogue_list FROM v LEFT JOIN d USING (clip_id) GROUP BY v.clip_id, v.visual_prompt""")
def parse_script(t: Tables):
    part = F.concat(F.lit("["), F.expr(TAG), F.lit("] "), F.col("text"))
    rows = t.b_lines.withColumn("x", part).groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x"))), lambda s: s["x"]), "\n").alias("script"))
    return C.parse_script(rows, index=2).drop("script")


@register("dialogue_context", """SELECT clip_id, string_agg('- ' || upper(left(speaker, 1)) || substr(speaker, 2) || ': "' || x || '"', chr(10) ORDER BY line) AS dialogue
FROM (SELECT *, regexp_replace(trim(text), '[.!?]+$', '') AS x FROM b_lines) l WHERE x <> '' GROUP BY clip_id""")
def dialogue_context(t: Tables):
    return C.dialogue_context(t.b_lines)


@register("prompt_cache_split", """WITH r AS (SELECT doc_id, text AS prompt, lang AS system_prompt, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS image_key FROM documents),
c AS (SELECT prompt, system_prompt, image_key, min(doc_id) AS output FROM r WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT doc_id, output, output IS NULL AS to_do FROM r LEFT JOIN c ON r.prompt IS NOT DISTINCT FROM c.prompt AND r.system_prompt IS NOT DISTINCT FROM c.system_prompt AND r.image_key IS NOT DISTINCT FROM c.image_key""")
def prompt_cache_split(t: Tables):
    r = t.documents.select("doc_id", F.col("text").alias("prompt"), F.col("lang").alias("system_prompt"), F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS image_key"))
    cache = r.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "output")
    return C.prompt_cache_split(r, cache).select("doc_id", "output", "to_do")


#: Words of the lines, with times by their place in the clip.
WORDS = """words AS (SELECT clip_id, line, wpos, word, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY line, wpos) - 1 AS INT) AS pos FROM
  (SELECT clip_id, line, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS wpos FROM b_lines) w WHERE word <> ''),
timed AS (SELECT *, pos * 0.5::DOUBLE AS t_start, pos * 0.5::DOUBLE + 0.2::DOUBLE + (length(word) % 3) * 0.1::DOUBLE AS t_end FROM words)"""


def timed_words(t: Tables):
    from pyspark.sql import Window

    w = t.b_lines.select("clip_id", "line", F.posexplode(F.split("text", " ")).alias("wpos", "word")).where("word <> ''")
    w = w.withColumn("pos", (F.row_number().over(Window.partitionBy("clip_id").orderBy("line", "wpos")) - 1).cast("int"))
    return w.withColumns({"t_start": F.col("pos") * 0.5, "t_end": F.col("pos") * 0.5 + 0.2 + (F.length("word") % 3) * 0.1})


@register("flatten_words", f"WITH {WORDS} SELECT clip_id, line AS segment, CAST(row_number() OVER (PARTITION BY clip_id, line ORDER BY pos) - 1 AS INT) AS pos, word, t_start, t_end FROM timed")
def flatten_words(t: Tables):
    w = timed_words(t)
    seg = w.groupBy("clip_id", "line").agg(F.array_sort(F.collect_list(F.struct("pos", "word", F.col("t_start").alias("start"), F.col("t_end").alias("end")))).alias("words"))
    # every line up to the last one, silent ones included, so that a segment's number is its line
    last = seg.groupBy("clip_id").agg(F.max("line").alias("m")).select("clip_id", F.explode(F.sequence(F.lit(0), "m")).alias("line"))
    seg = last.join(seg, ["clip_id", "line"], "left")
    body = F.struct(F.when(F.col("words").isNotNull(), "said").otherwise(" ").alias("text"), F.coalesce("words", F.array().cast("array<struct<pos:int,word:string,start:double,end:double>>")).alias("words"))
    text = seg.groupBy("clip_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("line", body.alias("b")))), lambda x: x["b"]).alias("segments"))).alias("result"))
    return C.flatten_words(text)


@register("word_cut_shift", f"""WITH {WORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_start DESC, pos DESC) AS rn FROM timed),
e AS (SELECT clip_id, max(t_start) FILTER (rn = 1) AS s1, max(t_end) FILTER (rn = 1) AS e1, coalesce(max(t_end) FILTER (rn = 2), 0) AS e2 FROM r GROUP BY clip_id),
c AS (SELECT clip_id, count(*) * 0.5::DOUBLE AS duration, 25.0::DOUBLE AS fps, 0 AS first_frame, CAST(clip_id % 40 AS INT) AS start_frame FROM timed GROUP BY clip_id),
m AS (SELECT c.*, greatest(first_frame, start_frame - CAST(round_even((duration - (e2 + s1) / 2) * fps, 0) AS INT)) AS moved, e1 FROM c JOIN e USING (clip_id))
SELECT clip_id, CASE WHEN duration - e1 < 0.3 AND moved < start_frame THEN moved ELSE start_frame END AS new_start FROM m""")
def word_cut_shift(t: Tables):
    w = timed_words(t)
    clips = w.groupBy("clip_id").agg((F.count("*") * 0.5).alias("duration")).withColumns({"fps": F.lit(25.0), "first_frame": F.lit(0), "start_frame": (F.col("clip_id") % 40).cast("int")})
    return C.word_cut_shift(w, clips).select("clip_id", "new_start")


@register("plan_caption_frames", """WITH r AS (SELECT video_id, total_frames, least(10, greatest(0, CAST(floor((total_frames - 1) / 4) AS INT))) AS lo FROM (SELECT video_id, CASE WHEN video_id % 5 = 0 THEN CAST(video_id % 13 AS INT) ELSE total_frames END AS total_frames FROM b_videos) v WHERE total_frames > 0),
h AS (SELECT *, greatest(lo, total_frames - 1 - lo) AS hi FROM r)
SELECT video_id, array_to_string(CASE WHEN hi - lo + 1 <= 5 THEN range(lo, hi + 1) ELSE list_transform(range(0, 5), lambda i: CAST(lo + floor(i * (hi - lo) / 4) AS BIGINT)) END, ',') AS frames FROM h""")
def plan_caption_frames(t: Tables):
    clips = t.b_videos.withColumn("total_frames", F.expr("CASE WHEN video_id % 5 = 0 THEN CAST(video_id % 13 AS INT) ELSE total_frames END"))
    return C.plan_caption_frames(clips).select("video_id", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))
