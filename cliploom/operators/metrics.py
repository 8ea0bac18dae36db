"""Training telemetry: smoothing, divergence, trends, schedules and checkpoints."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.ranking import placed
from cliploom.functions.shared import stored


def smoothed(loss: np.ndarray, alpha: float, start: float | None = None) -> np.ndarray:
    """Exponential moving average, begun with `start` or with the first loss."""
    if start is None:
        return pd.Series(loss).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return pd.Series(np.append(start, loss)).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def chart_weight(n: int) -> float:
    """Weight of the past in the chart's smoothing of n points."""
    return min(0.95, 1 - 2 / (max(n / 5, 2) + 1))


#: Steps of one block of a run; blocks of a run are worked on side by side.
BLOCK = 1 << 16


def in_blocks(metrics: DataFrame) -> DataFrame:
    """(run_id, step, loss, place, block): steps with a loss, numbered from 1 in each run, however long it is, and dealt into blocks in order."""
    rows = metrics.where(F.col("loss").isNotNull()).select(F.col("run_id").cast("long").alias("run_id"), F.col("step").cast("int").alias("step"), F.col("loss").cast("double").alias("loss"))
    return placed(rows, [F.col("step"), F.col("loss")], ["run_id"], "place").withColumn("block", F.floor((F.col("place") - 1) / BLOCK).cast("long"))


def _to_block(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of a table that has one row a block."""
    named = table.withColumnsRenamed({"run_id": "_run", "block": "_block"})
    return rows.join(named, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("block") == F.col("_block")), "left").drop("_run", "_block")


def _bucketed(rows: DataFrame):
    """Rows grouped so that a group holds whole blocks, of about BLOCK rows together: short runs share one."""
    buckets = 1 + rows.count() // BLOCK
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("run_id", "block"), F.lit(buckets))).groupBy("_bucket")


def _cut_blocks(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A group of _bucketed() in order, and where its blocks begin and end."""
    table = table.sort_by([("run_id", "ascending"), ("block", "ascending"), ("place", "ascending")])
    run, none, block = table["run_id"].fill_null(0).to_numpy(), table["run_id"].is_null().to_numpy(), table["block"].to_numpy()
    new = (run[1:] != run[:-1]) | (none[1:] != none[:-1]) | (block[1:] != block[:-1])
    return table, np.concatenate([[0], np.flatnonzero(new) + 1, [len(run)]])


def averages(rows: DataFrame, past: dict[str, Column]) -> DataFrame:
    """Rows of in_blocks with exponential averages: <name> after each loss and <name>_before, null at a run's first.

    past: by name, the weight of the average so far, the same in all of a run. A block of steps is one
    affine map of the average that it begins with. The maps are sums over the blocks' rows; composing them,
    one number a block, gives each block its start, and all blocks are then averaged side by side.
    """
    left = F.lit(BLOCK) * (F.col("block") + 1) - F.col("place")
    maps = []
    for name, d in past.items():
        own = F.when(F.col("place") == 1, 1.0).otherwise(1 - d) * F.pow(d, left) * F.col("loss")
        maps += [F.sum(own).alias(f"{name}_b"), F.max(d).alias(f"{name}_d")]
    names = list(past)
    given = rows.withColumns({f"{n}_d": d for n, d in past.items()})

    def compose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        out = {"run_id": f["run_id"], "block": f["block"]}
        for n in names:
            value, starts = math.nan, []
            for b, d in zip(f[f"{n}_b"], f[f"{n}_d"], strict=True):
                starts.append(value)
                value = b if math.isnan(value) else d**BLOCK * value + b
            out[f"{n}_start"] = starts
        return pd.DataFrame(out)

    # a run of one block has nothing to compose
    several = rows.groupBy("run_id", "block").agg(*maps).withColumn("_last", F.max("block").over(Window.partitionBy("run_id"))).where("_last > 0").drop("_last")
    starts = several.groupBy("run_id").applyInPandas(compose, ", ".join(["run_id long, block long", *(f"{n}_start double" for n in names)]))
    given = _to_block(given, starts)
    extra = [c for c in rows.columns if c not in ("run_id", "step", "loss", "place", "block")]
    kept = ["run_id", "step", "loss", "place", "block", *extra]

    def run(table: pa.Table) -> pa.Table:
        table, cuts = _cut_blocks(table)
        loss = table["loss"].to_numpy()
        out = table.select(kept)
        for n in names:
            starts, weights = table[f"{n}_start"].to_numpy(), table[f"{n}_d"].to_numpy()
            after, before = np.empty(len(loss)), np.empty(len(loss))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                after[a:b] = smoothed(loss[a:b], 1 - weights[a], None if math.isnan(starts[a]) else starts[a])
                before[a], before[a + 1 : b] = starts[a], after[a : b - 1]
            out = out.append_column(n, pa.array(after)).append_column(f"{n}_before", pa.array(before, from_pandas=True))
        return out

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.select(*kept).schema.fields)
    return _bucketed(given).applyInArrow(run, ", ".join([shape, *(f"{n} double, {n}_before double" for n in names)]))


def loss_ema(metrics: DataFrame, alpha: float = 0.02) -> DataFrame:
    """Each step's average before and after its loss (the first has none before), and the chart's average.

    A step without a loss changes no average and has none. A run of any length is averaged block by block, see averages().
    """
    rows = in_blocks(metrics)
    sizes = rows.groupBy(F.col("run_id").alias("_r")).agg(F.max("place").alias("_n"))
    chart = F.least(F.lit(0.95), 1 - 2 / (F.greatest(F.col("_n") / 5, F.lit(2)) + 1))
    rows = rows.join(sizes, F.col("run_id").eqNullSafe(F.col("_r"))).withColumn("chart", chart).drop("_r", "_n")
    out = averages(rows, {"ema": F.lit(1 - alpha), "chart_ema": F.col("chart")})
    without = metrics.where(F.col("loss").isNull()).select(F.col("run_id").cast("long").alias("run_id"), F.col("step").cast("int").alias("step"))
    return out.select("run_id", "step", "ema_before", F.col("ema").alias("ema_after"), "chart_ema").unionByName(without, allowMissingColumns=True)


@dataclass
class Watch:
    """State of the divergence watch of one run."""

    ema: float | None = None
    low: float | None = None
    low_step: int = -1
    since: int = 0
    monitoring: bool = False
    boosted: bool = False
    stopped: bool = False
    last_step: int = -1

    def feed(self, steps: list[int], losses: list[float], alpha: float, warmup: int, threshold: float, detect: int, stop: int) -> list[tuple[int, str, float]]:
        """Take steps in order and return (step, event, percent over the lowest average)."""
        out = []
        for step, loss in zip(steps, losses, strict=True):
            self.last_step = step
            if self.stopped:
                continue
            self.ema = loss if self.ema is None else (1 - alpha) * self.ema + alpha * loss
            if step < warmup:
                continue
            if self.low is None or self.ema < self.low:
                self.low, self.low_step = self.ema, step
            over = (self.ema - self.low) / self.low * 100 if self.low > 0 else 0.0
            high = over > threshold
            if not self.monitoring:
                if not high:
                    self.since = 0
                    continue
                self.since = self.since or step
                if step - self.since < detect:
                    continue
                self.monitoring = True
                out.append((step, "monitor", over))
            if not high:
                out.append((step, "recovered", over))
                self.monitoring, self.boosted, self.since = False, False, 0
            elif step - self.since >= stop:
                if self.boosted:
                    self.stopped = True
                    out.append((step, "stop", over))
                else:
                    self.boosted, self.since = True, step
                    out.append((step, "lr_reset", over))
        return out

    def as_tuple(self) -> tuple:
        return tuple(asdict(self).values())


WATCH = "ema double, low double, low_step int, since int, monitoring boolean, boosted boolean, stopped boolean, last_step int"
EVENTS = "run_id long, step int, event string, percent_over double"


def warmup_end(total_steps: Column, start_step: Column | None = None, least: int = 50, share: float = 0.25) -> Column:
    """The first step that is watched: after a quarter of the steps to come, `least` at least."""
    start = F.lit(0) if start_step is None else start_step
    return (start + F.greatest(F.lit(least), F.floor((total_steps - start) * share))).cast("int")


def _watched(rows: DataFrame, threshold: float) -> DataFrame:
    """Watched steps with how far they are over the lowest average so far, whether that is too far, and whether this begins a stretch of such or other steps in their block."""
    lows = rows.groupBy("run_id", "block").agg(F.min("ema").alias("least"))
    before = Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = _to_block(rows, lows.select("run_id", "block", F.min("least").over(before).alias("low")))  # the window is over blocks

    def run(table: pa.Table) -> pa.Table:
        table, cuts = _cut_blocks(table)
        ema, step = table["ema"].to_numpy(), table["step"].to_numpy()
        low = np.fmin(ema, table["low"].to_numpy())  # no blocks before: NaN
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            low[a:b] = np.minimum.accumulate(low[a:b])
        over = np.where(low > 0, (ema - low) / np.where(low > 0, low, 1) * 100, 0.0)
        high = (over > threshold) & (step != 0)  # no stretch begins at step 0
        begins = np.append(True, high[1:] != high[:-1])
        begins[cuts[:-1]] = True
        return table.select(["run_id", "block", "place", "step"]).append_column("over", pa.array(over)).append_column("high", pa.array(high)).append_column("begins", pa.array(begins))

    return _bucketed(rows).applyInArrow(run, "run_id long, block long, place long, step int, over double, high boolean, begins boolean")


def _first_from(points: DataFrame, watched: DataFrame, tops: DataFrame, out: str) -> DataFrame:
    """points with `out`: (place, step, over) of the run's first watched step of at least x, if it lies before `until`.

    points: (run_id, start, until, x, ...), (run_id, start) being unique; tops: the last step of each block. The block is
    found among tops; then only rows of such blocks are looked at.
    """
    on = Window.partitionBy("run_id").orderBy("x", "is_top").rowsBetween(0, Window.unboundedFollowing)
    both = points.select("run_id", "x", F.lit(0).alias("is_top"), "start", F.lit(None).cast("long").alias("block")).unionByName(tops.select("run_id", F.col("top").alias("x"), F.lit(1).alias("is_top"), F.lit(None).cast("long").alias("start"), "block"))
    where = both.withColumn("block", F.first("block", ignorenulls=True).over(on)).where("is_top = 0 AND block IS NOT NULL")
    where = where.select(F.col("run_id").alias("_r"), F.col("block").alias("_b"), F.col("start").alias("_s"), F.col("x").alias("_x"))
    near = watched.join(where, F.col("run_id").eqNullSafe(F.col("_r")) & (F.col("block") == F.col("_b")) & (F.col("step") >= F.col("_x")) & (F.col("place") >= F.col("_s")))
    found = near.groupBy("_r", "_s").agg(F.min(F.struct("place", "step", "over")).alias("_f"))
    got = points.join(found, F.col("run_id").eqNullSafe(F.col("_r")) & (F.col("start") == F.col("_s")), "left")
    return got.withColumn(out, F.when(F.col("until").isNull() | (F.col("_f.place") < F.col("until")), F.col("_f"))).drop("_r", "_s", "_f")


def divergence_events(metrics: DataFrame, threshold: float = 15, detect: int = 150, stop: int = 300, alpha: float = 0.02, warmup: int | None = None, least_warmup: int = 50) -> DataFrame:
    """Events of each run: monitor (detect steps over threshold), recovered, lr_reset (stop steps since first seen), stop (as many again).

    Without a fixed `warmup` each run has its own, from its last step (see warmup_end). A step without a loss is none.

    Averages come from averages(), lowest ones from the minimum of each block and of those before it.
    What happens in a stretch of steps over the threshold depends on that stretch alone: its watch begins with it,
    and the step after it clears it. So only the ends of stretches are walked over, and the steps at which a stretch is detect and
    stop steps old are looked up in their blocks.
    """
    rows = in_blocks(metrics)
    if warmup is None:
        ends = rows.groupBy(F.col("run_id").alias("_r")).agg(warmup_end(F.max("step"), least=least_warmup).alias("from_step"))
        rows = rows.join(ends, F.col("run_id").eqNullSafe(F.col("_r"))).drop("_r")
    else:
        rows = rows.withColumn("from_step", F.lit(warmup))
    watched = stored(averages(rows, {"ema": F.lit(1 - alpha)}).where("step >= from_step").select("run_id", "block", "place", "step", "ema"), "averages")
    watched = stored(_watched(watched, threshold), "watched")
    tops = watched.groupBy("run_id", "block").agg(F.max("step").alias("top"))
    order = Window.partitionBy("run_id").orderBy("place")  # over the ends of stretches
    ends = watched.where("begins").select("*", F.lag("high").over(order).alias("was")).where("was IS NULL OR was <> high")
    after = lambda c: F.lead(c).over(order)
    high = ends.select("run_id", "high", F.col("place").alias("start"), "step", after("place").alias("until"), after("step").alias("after_step"), after("over").alias("after_over")).where("high")
    high = _first_from(high.withColumn("x", F.col("step") + detect), watched, tops, "seen").where("seen IS NOT NULL")
    high = stored(_first_from(high.withColumn("x", F.col("step") + max(detect, stop)), watched, tops, "reset"), "stretches")
    again = high.where("reset IS NOT NULL").withColumns({"x": F.col("reset.step") + max(stop, 1), "stretch": F.col("start"), "start": F.col("reset.place")})
    again = _first_from(again, watched, tops, "stopped").select(F.col("run_id").alias("_run"), "stretch", "stopped")
    high = high.join(again, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("start") == F.col("stretch")), "left")
    recovered = F.when(F.col("stopped").isNull() & F.col("until").isNotNull(), F.struct(F.col("until").alias("place"), F.col("after_step").alias("step"), F.col("after_over").alias("over")))
    kinds = {"monitor": F.col("seen"), "lr_reset": F.col("reset"), "stop": F.col("stopped"), "recovered": recovered}
    events = high.select("run_id", F.inline(F.array(*[F.struct(F.lit(k).alias("event"), c.alias("at")) for k, c in kinds.items()]))).where("at IS NOT NULL")
    last = F.min(F.when(F.col("event") == "stop", F.col("at.place"))).over(Window.partitionBy("run_id"))
    events = events.withColumn("last", last).where("last IS NULL OR at.place <= last")
    return events.select("run_id", "at.step", "event", F.col("at.over").alias("percent_over"))


def ema_minimum(metrics: DataFrame) -> DataFrame:
    """Each step's lowest average so far and how far it is over that, in percent. metrics: (run_id, step, ema)."""
    upto = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = metrics.withColumn("low", F.min("ema").over(upto))
    return rows.withColumn("percent_over", F.when(F.col("low") > 0, (F.col("ema") - F.col("low")) / F.col("low") * 100).otherwise(0.0))


def loss_trend(metrics: DataFrame, window: int = 1000, share: float = 0.75, min_pts: int = 50, value: str = "chart_ema") -> DataFrame:
    """Least-squares slope and intercept of the smoothed loss over the last part of what is visible of each run, and its direction."""
    order = Window.partitionBy("run_id").orderBy(F.desc("step"))
    rows = metrics.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= window)
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("run_id"))).where(F.col("_n") >= min_pts)
    rows = rows.where(F.col("_rn") <= F.greatest(F.lit(min_pts), F.floor(F.col("_n") * share)))
    out = rows.groupBy("run_id").agg(F.regr_slope(value, "step").alias("slope"), F.regr_intercept(value, "step").alias("intercept"))
    return out.withColumn("direction", F.when(F.col("slope") < 0, "down").otherwise("up"))


def step_time_stats(metrics: DataFrame, step_epoch: int) -> DataFrame:
    """Last and mean seconds a step of each run, its last step, and that step's place in its epoch."""
    out = metrics.groupBy("run_id").agg(F.max("step").alias("last_step"), F.max_by("step_time", "step").alias("last_seconds"), F.avg("step_time").alias("mean_seconds"))
    return out.withColumn("epoch_step", (F.col("last_step") - 1) % step_epoch + 1)


def rebuild_timestamps(metrics: DataFrame, now: float) -> DataFrame:
    """Seconds at which each step ended: the newest at `now`, the others back by the durations after them (missing: 0)."""
    after = Window.partitionBy("run_id").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    return metrics.withColumn("at_sec", now - F.coalesce(F.sum(F.coalesce("step_time", F.lit(0.0))).over(after), F.lit(0.0)))


def lr_schedule(metrics: DataFrame, kind: str, base: float, end: float = 0.0, cycle: int = 100, decay: float = 0.8) -> DataFrame:
    """Learning rate of each step: base x decay^cycles, falling within a cycle as `kind` says."""
    top = base * F.pow(F.lit(decay), F.floor(F.col("step") / cycle))
    part = (F.col("step") % cycle) / cycle
    least = end / base if end > 0 and base > 0 else 0.1
    shapes = {
        "constant": top,
        "linear": top * (1 + (least - 1) * part),
        "cosine": end + (top - end) * (1 + F.cos(math.pi * part)) / 2,
        "polynomial": top * (1 - part),
    }
    return metrics.withColumn("lr", shapes["cosine" if kind == "cosine_with_restarts" else kind])


def checkpoint_step(path):
    return F.nullif(F.regexp_extract(path, r"step_(\d+)", 1), F.lit("")).cast("int")


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint of the highest step of each run; of equal ones the first path."""
    rows = checkpoints.withColumn("step", checkpoint_step("path")).where("step IS NOT NULL")
    return rows.groupBy("run_id").agg(F.min_by("path", F.struct(-F.col("step"), "path")).alias("path"), F.max("step").alias("step"))


def checkpoint_retention(checkpoints: DataFrame, keep_last: int = 2, monitoring: DataFrame | None = None) -> DataFrame:
    """Checkpoints with whether they go (all but the newest keep_last of a run; 0 keeps all; none while monitoring), and their sidecar."""
    order = Window.partitionBy("run_id").orderBy(F.desc("step"), "path")
    rows = checkpoints.withColumn("step", checkpoint_step("path"))
    gone = (F.row_number().over(order) > keep_last) if keep_last > 0 else F.lit(False)
    rows = rows.withColumns({"removed": gone, "sidecar": F.regexp_replace("path", r"\.[^./]*$", ".json")})
    if monitoring is not None:
        held = monitoring.select("run_id", F.lit(True).alias("_m")).distinct()
        rows = rows.join(held, "run_id", "left").withColumn("removed", F.col("removed") & F.col("_m").isNull()).drop("_m")
    return rows


def resume_truncate(metrics: DataFrame, resume_step: int) -> DataFrame:
    """The records of each run up to the step from which it goes on; those past it are stale."""
    return metrics.where(F.col("step") <= resume_step)


def resume_state(metrics: DataFrame, resume_step: int, ema: str = "ema_loss") -> DataFrame:
    """What each run goes on with: records dropped, and of the rest the last average, the lowest one and its first step.

    Steps without an average (the warm-up) count for none of these.
    """
    kept = (F.col("step") <= resume_step) & F.col(ema).isNotNull()
    at = F.when(kept, F.col("step"))
    return metrics.groupBy("run_id").agg(
        F.count_if(F.col("step") > resume_step).alias("dropped"),
        F.max_by(ema, at).alias("ema_last"),
        F.min(F.when(kept, F.col(ema))).alias("ema_low"),
        F.min_by(at, F.when(kept, F.struct(ema, "step"))).alias("ema_low_step"),
    )
