"""Queries over training telemetry, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import metrics as K
from cliploom.streaming import telemetry as S

from . import Tables, register

#: Limits that short runs reach.
LIMITS = {"threshold": 5.0, "detect": 4, "stop": 8, "alpha": 0.2, "warmup": 10}


@register("loss_ema", """WITH RECURSIVE m AS MATERIALIZED (SELECT run_id, step, loss, (1 - 2 / (greatest(n / 5, 2) + 1)) AS w FROM (SELECT *, count(*) OVER (PARTITION BY run_id)::DOUBLE AS n FROM b_metrics) z),
e AS (SELECT run_id, step, loss, NULL::DOUBLE AS ema_before, loss AS ema_after, loss AS chart_ema FROM m WHERE step = 1
 UNION ALL SELECT m.run_id, m.step, m.loss, e.ema_after, 0.98 * e.ema_after + 0.02 * m.loss, least(0.95, w) * e.chart_ema + (1 - least(0.95, w)) * m.loss FROM e JOIN m ON m.run_id = e.run_id AND m.step = e.step + 1)
SELECT run_id, step, round(ema_before, 6) AS ema_before, round(ema_after, 6) AS ema_after, round(chart_ema, 6) AS chart_ema FROM e""")
def loss_ema(t: Tables):
    out = K.loss_ema(t.b_metrics)
    return out.select("run_id", "step", *[F.round(c, 6).alias(c) for c in ("ema_before", "ema_after", "chart_ema")])


def watch_sql(rows: str, warmup: int | None, alpha: float, threshold: float, detect: int, stop: int, least_warmup: int = 0) -> str:
    """The divergence watch as a recursion over the steps of all runs at once. rows: a table of run_id, step, loss."""
    first = f"greatest({least_warmup}, floor(max(step) OVER (PARTITION BY run_id) * 0.25))" if warmup is None else warmup
    return f"""WITH RECURSIVE m AS MATERIALIZED (SELECT run_id, step, loss, {first} AS first, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n FROM {rows}),
w AS (SELECT DISTINCT run_id, 0::BIGINT AS n, 0 AS step, NULL::DOUBLE AS ema, NULL::DOUBLE AS low, 0 AS since, false AS watched, false AS reset, false AS stopped, NULL::DOUBLE AS over, false AS began, NULL::VARCHAR AS event FROM m
 UNION ALL SELECT run_id, n, step, ema, low, CASE event WHEN 'recovered' THEN 0 WHEN 'lr_reset' THEN step ELSE since END, watched AND event IS DISTINCT FROM 'recovered',
  CASE event WHEN 'recovered' THEN false WHEN 'lr_reset' THEN true ELSE reset END, stopped OR event IS NOT DISTINCT FROM 'stop', over, began, event
 FROM (SELECT * EXCLUDE (watched), watched OR began AS watched, CASE WHEN NOT active OR NOT (watched OR began) THEN NULL WHEN NOT high THEN 'recovered' WHEN step - since < {stop} THEN NULL WHEN reset THEN 'stop' ELSE 'lr_reset' END AS event
 FROM (SELECT *, active AND high AND NOT watched AND step - since >= {detect} AS began
 FROM (SELECT * EXCLUDE (since), CASE WHEN NOT active OR watched THEN since WHEN NOT high THEN 0 WHEN since = 0 THEN step ELSE since END AS since
 FROM (SELECT *, active AND over > {threshold} AS high
 FROM (SELECT *, CASE WHEN low > 0 THEN (ema - low) / low * 100 ELSE 0 END AS over
 FROM (SELECT * EXCLUDE (low), CASE WHEN active THEN least(ema, low) ELSE low END AS low
 FROM (SELECT w.run_id, m.n, m.step, CASE WHEN w.ema IS NULL THEN m.loss WHEN w.stopped THEN w.ema ELSE {1 - alpha}::DOUBLE * w.ema + {alpha}::DOUBLE * m.loss END AS ema,
   w.low, w.since, w.watched, w.reset, w.stopped, NOT w.stopped AND m.step >= m.first AS active FROM w JOIN m ON m.run_id = w.run_id AND m.n = w.n + 1))))))))
SELECT run_id, step, 'monitor' AS event, round(over, 6) AS percent_over FROM w WHERE began
UNION ALL SELECT run_id, step, event, round(over, 6) FROM w WHERE event IS NOT NULL"""


@register("divergence_events", watch_sql("b_metrics", **{**LIMITS, "warmup": None}, least_warmup=10))
def divergence_events(t: Tables):
    # each run's own warm-up: a quarter of its steps, 10 at least
    limits = {k: v for k, v in LIMITS.items() if k != "warmup"}
    return K.divergence_events(t.b_metrics, **limits, least_warmup=10).withColumn("percent_over", F.round("percent_over", 6))


@register("loss_trend", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rn FROM b_metrics), v AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM r WHERE rn <= 60)
SELECT run_id, round(regr_slope(loss, step), 6) AS slope, CASE WHEN regr_slope(loss, step) < 0 THEN 'down' ELSE 'up' END AS direction FROM v WHERE n >= 20 AND rn <= greatest(20, floor(n * 0.75)) GROUP BY run_id""")
def loss_trend(t: Tables):
    return K.loss_trend(t.b_metrics, window=60, min_pts=20, value="loss").select("run_id", F.round("slope", 6).alias("slope"), "direction")


@register("step_time_stats", "SELECT run_id, max(step) AS last_step, arg_max(step_time, step) AS last_seconds, round(avg(step_time), 6) AS mean_seconds, (max(step) - 1) % 25 + 1 AS epoch_step FROM b_metrics GROUP BY run_id")
def step_time_stats(t: Tables):
    return K.step_time_stats(t.b_metrics, 25).withColumn("mean_seconds", F.round("mean_seconds", 6))


@register("rebuild_timestamps", "SELECT run_id, step, 100000 - coalesce(sum(coalesce(step_time, 0)) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS at_sec FROM b_metrics")
def rebuild_timestamps(t: Tables):
    return K.rebuild_timestamps(t.b_metrics, 100_000.0).select("run_id", "step", "at_sec")


@register("lr_schedule", """WITH m AS (SELECT run_id, step, 0.001::DOUBLE * power(0.8::DOUBLE, step // 20) AS top, (step % 20) / 20.0::DOUBLE AS p FROM b_metrics)
SELECT run_id, step, round(top, 12) AS constant, round(top * (1 + (0.05::DOUBLE - 1) * p), 12) AS linear, round(0.00005::DOUBLE + (top - 0.00005::DOUBLE) * (1 + cos(pi() * p)) / 2, 12) AS cosine, round(top * (1 - p), 12) AS polynomial FROM m""")
def lr_schedule(t: Tables):
    out = t.b_metrics.select("run_id", "step")
    for kind in ("constant", "linear", "cosine", "polynomial"):
        out = K.lr_schedule(out, kind, 0.001, 0.00005, 20).withColumn(kind, F.round("lr", 12)).drop("lr")
    return out


@register("latest_checkpoint", """SELECT run_id, path, step FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC, path) AS rn FROM
(SELECT run_id, path, CAST(regexp_extract(path, 'step_(\\d+)', 1) AS INT) AS step FROM b_checkpoints) z) y WHERE rn = 1""")
def latest_checkpoint(t: Tables):
    return K.latest_checkpoint(t.b_checkpoints)


@register("checkpoint_retention", """SELECT run_id, path, row_number() OVER (PARTITION BY run_id ORDER BY CAST(regexp_extract(path, 'step_(\\d+)', 1) AS INT) DESC, path) > 3 AND run_id % 6 <> 0 AS removed,
replace(path, '.safetensors', '.json') AS sidecar FROM b_checkpoints""")
def checkpoint_retention(t: Tables):
    watched = t.b_checkpoints.where("run_id % 6 = 0").select("run_id")
    return K.checkpoint_retention(t.b_checkpoints, 3, watched).select("run_id", "path", "removed", "sidecar")


#: A stand-in for the average, which starts after ten steps.
AVERAGED = "(SELECT *, CASE WHEN step > 10 THEN avg(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS ema_loss FROM b_metrics)"


@register("resume_truncate", f"""WITH a AS {AVERAGED}, s AS (SELECT run_id, count(*) FILTER (step > 40) AS dropped, min(ema_loss) FILTER (step <= 40) AS ema_low, max(CASE WHEN step <= 40 AND ema_loss IS NOT NULL THEN step END) AS last FROM a GROUP BY run_id)
SELECT a.run_id, a.step, a.loss, s.dropped, round(s.ema_low, 6) AS ema_low, round((SELECT b.ema_loss FROM a b WHERE b.run_id = s.run_id AND b.step = s.last), 6) AS ema_last,
 (SELECT min(b.step) FROM a b WHERE b.run_id = s.run_id AND b.step <= 40 AND b.ema_loss = s.ema_low) AS ema_low_step FROM a JOIN s USING (run_id) WHERE a.step <= 40""")
def resume_truncate(t: Tables):
    rows = t.spark.sql(AVERAGED.replace("b_metrics", "{m}")[1:-1], m=t.b_metrics)
    kept = K.resume_truncate(rows, 40).join(K.resume_state(rows, 40), "run_id")
    return kept.select("run_id", "step", "loss", "dropped", F.round("ema_low", 6).alias("ema_low"), F.round("ema_last", 6).alias("ema_last"), "ema_low_step")


def event_stream(t: Tables, folder: str = "events"):
    schema = t.spark.read.parquet(f"{t.sf_dir}/{folder}.parquet").schema
    # a pattern, as a stream's path itself has to be a folder and a table can be one file
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{folder}.parque[t]")


@register("stream_divergence", watch_sql("(SELECT user_id AS run_id, event_id::INT AS step, value AS loss FROM events)", **{**LIMITS, "warmup": None}, least_warmup=10))
def stream_divergence(t: Tables):
    # each run's own warm-up: a quarter of the steps that it is planned to take
    limits = {k: v for k, v in LIMITS.items() if k != "warmup"}
    plan = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.max("event_id").alias("total_steps"))
    stream = event_stream(t).select(F.col("user_id").alias("run_id"), F.col("event_id").cast("int").alias("step"), F.col("value").alias("loss"))
    path = S.work_path(t.spark, "divergence")
    S.run_once(S.stream_divergence(stream, plan, **limits, least_warmup=10), path)
    return t.spark.read.schema(K.EVENTS).parquet(path).withColumn("percent_over", F.round("percent_over", 6))


@register("stream_identity_status", """WITH c AS (SELECT event_type AS identity, count(*) AS appearances FROM events GROUP BY ROLLUP(event_type)),
t AS (SELECT (SELECT count(*) FROM b_clips) AS clips, (SELECT count(*) FROM b_chunks) AS pool_remaining)
SELECT identity, appearances, CASE WHEN identity IS NULL THEN clips END AS clips, CASE WHEN identity IS NULL THEN pool_remaining END AS pool_remaining, CASE WHEN identity IS NULL THEN 5000 END::BIGINT AS cap FROM c CROSS JOIN t""")
def stream_identity_status(t: Tables):
    sink = S.work_path(t.spark, "identities")
    S.stream_identity_status(event_stream(t).select(F.col("event_type").alias("identity")), sink).awaitTermination()
    status = S.current_status(t.spark, sink)
    totals = S.status_totals(status, t.b_clips, t.b_chunks, 9000, 5000).select(F.lit(None).cast("string").alias("identity"), "appearances", "clips", "pool_remaining", "cap")
    return status.where("identity IS NOT NULL").unionByName(totals, allowMissingColumns=True)


@register("stream_ingest", """SELECT DISTINCT stem FROM (SELECT 'h' || length(url) || '-' || page_id % 100 AS stem FROM pages) p WHERE stem NOT IN (SELECT 'h' || length(url) || '-' || page_id % 100 FROM pages WHERE page_id % 9 = 0)""")
def stream_ingest(t: Tables):
    stem = F.expr("concat('h', length(url), '-', page_id % 100) AS stem")
    sink = S.work_path(t.spark, "ingest")
    blocked = t.pages.where("page_id % 9 = 0").select(stem)
    S.stream_ingest(event_stream(t, "pages").select(stem), blocked, sink).awaitTermination()
    return t.spark.read.parquet(sink).select("stem")
