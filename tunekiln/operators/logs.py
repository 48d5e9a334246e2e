"""Training-log analysis over points ``(run_id, step, ts, metric, value, line)``.

Moving windows run over blocks of a run's numbered points, with the points before a block as a halo, so
a run holding a third of all points still spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import catalog as cat
from ..session import land
from ..sources.lines import number_rows
from .substrings import substring_join

# Our thresholds (the reference describes the symptoms in prose only); parameters below.
SPIKE_FACTOR = 2.0
SPIKE_WINDOW = 5
SPIKE_BLOCK = 1 << 16
OVERFIT_RATIO = 1.2
UTILISATION_LOW = 50.0


def match_signatures(lines: DataFrame, line_col: str = "line", signatures: DataFrame | None = None) -> DataFrame:
    """Each log line with each error signature it contains (case-insensitive).

    ``signatures`` (sig_pos, signature, cause) may be a user's own table of any size; by default the known
    ones. Lines meet the signatures through an index of their q-grams (``substring_join``)."""
    table = (signatures if signatures is not None else cat.signatures_table(lines.sparkSession)).select("sig_pos", "signature", "cause")
    return substring_join(lines, F.lower(F.col(line_col)), table, F.lower("signature"))


def signature_counts(lines: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    m = match_signatures(lines, signatures=signatures)
    return m.groupBy("run_id", "signature", "cause").agg(F.count(F.lit(1)).alias("n"))


def run_summary(points: DataFrame) -> DataFrame:
    tr = F.col("metric") == "train_loss"
    ev = F.col("metric") == "eval_loss"
    return points.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.max("step").alias("last_step"),
        F.min_by(F.when(tr, F.col("value")), F.when(tr, F.col("step"))).alias("first_train_loss"),
        F.max_by(F.when(tr, F.col("value")), F.when(tr, F.col("step"))).alias("last_train_loss"),
        F.min(F.when(tr, F.col("value"))).alias("min_train_loss"),
        F.max_by(F.when(ev, F.col("value")), F.when(ev, F.col("step"))).alias("last_eval_loss"),
        F.max(F.when(F.col("metric") == "memory_gb", F.col("value"))).alias("peak_memory"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("duration_us"),
    )


def loss_spikes(points: DataFrame, k: float = SPIKE_FACTOR, w: int = SPIKE_WINDOW) -> DataFrame:
    """Train-loss points above k × the mean of the previous w train-loss points of the run.

    Points are numbered per run and cut into blocks of SPIKE_BLOCK numbers; the last w points of a block
    also stand in the next one as a halo, so one window per block sees all it needs and a long run is
    spread over many tasks."""
    tr = land(points.filter(F.col("metric") == "train_loss").select("run_id", "step", "value"), "losses")
    tr = number_rows(tr, "step", by=["run_id"], out="idx").withColumn("idx", F.col("idx") - 1)
    block = F.floor(F.col("idx") / SPIKE_BLOCK)
    late = F.col("idx") % SPIKE_BLOCK >= SPIKE_BLOCK - w
    d = tr.withColumn("_b", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    win = Window.partitionBy("run_id", "_b").orderBy("idx").rowsBetween(-w, -1)
    d = d.withColumn("prev_mean", F.avg("value").over(win)).withColumn("prev_n", F.count(F.lit(1)).over(win))
    return d.filter((F.col("_b") == block) & (F.col("value") > F.lit(k) * F.col("prev_mean"))).select(
        "run_id", "step", "value", "prev_mean", "prev_n")


def no_progress(points: DataFrame) -> DataFrame:
    tr = points.filter(F.col("metric") == "train_loss")
    s = tr.groupBy("run_id").agg(F.regr_slope("value", "step").alias("slope"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("no_progress", F.col("slope") >= 0)


def overfit(points: DataFrame, ratio: float = OVERFIT_RATIO) -> DataFrame:
    tr = F.col("metric") == "train_loss"
    ev = F.col("metric") == "eval_loss"
    s = points.groupBy("run_id").agg(
        F.max_by(F.when(tr, F.col("value")), F.when(tr, F.col("step"))).alias("last_train"),
        F.max_by(F.when(ev, F.col("value")), F.when(ev, F.col("step"))).alias("last_eval"),
        F.regr_slope(F.when(ev, F.col("value")), F.when(ev, F.col("step"))).alias("eval_slope"))
    return s.withColumn("overfit", (F.col("last_eval") > F.lit(ratio) * F.col("last_train")) & (F.col("eval_slope") > 0))


def memory_growth(points: DataFrame, low: float = UTILISATION_LOW) -> DataFrame:
    mem = F.col("metric") == "memory_gb"
    ut = F.col("metric") == "utilisation"
    s = points.groupBy("run_id").agg(
        F.regr_slope(F.when(mem, F.col("value")), F.when(mem, F.col("step"))).alias("memory_slope"),
        F.avg(F.when(ut, F.col("value"))).alias("avg_utilisation"))
    return s.withColumn("leak", F.col("memory_slope") > 0).withColumn("input_bound", F.col("avg_utilisation") < low)
