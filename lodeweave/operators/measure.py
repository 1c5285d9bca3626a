"""Ranking metrics, calibration metrics and threshold selection as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import maths

EPSILON = 1e-15


def recall_at(rank: Column, k: int) -> Column:
    """Share of queries whose target is in the first ``k``; a null rank is a miss."""
    return F.coalesce(F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0))), F.lit(0.0))


def mrr_at(rank: Column, k: int = 10) -> Column:
    return F.coalesce(F.avg(F.when(rank <= k, 1.0 / rank).otherwise(0.0)), F.lit(0.0))


def percentile(values: Column, q: float) -> Column:
    """Nearest-rank percentile (no interpolation)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {values._jc.toString()})")


def clipped(confidence: Column) -> Column:
    return F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), confidence))


def log_loss(confidence: Column, label: Column) -> Column:
    c = clipped(confidence)
    return -(label * F.log(c) + (1 - label) * F.log(1 - c))


def reliability(rows: DataFrame, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Count, mean confidence and accuracy of each confidence bin."""
    at = F.least(F.floor(clipped(F.col("confidence")) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return rows.groupBy(*(by or []), at).agg(F.count("*").alias("n"), F.avg(clipped(F.col("confidence"))).alias("mean_confidence"), F.avg("label").alias("accuracy"))


def running(rows: DataFrame, order: str, sums: list[str], down: bool = False) -> DataFrame:
    """``rows`` with the sums of all rows up to theirs by ``order`` (``run_`` columns), without a window over all of them.

    The rows are dealt by ranges of the order; each part adds what the parts before it sum up to. The window over
    the parts sees a row for each.
    """
    by = F.col(order).desc() if down else F.col(order).asc()
    parts = rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()).persist()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.sum(x).alias(x) for x in sums])
    totals = totals.select("_part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_{x}") for x in sums])
    own = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(totals), "_part").select(*rows.columns, *[(F.sum(x).over(own) + F.col(f"_{x}")).alias(f"run_{x}") for x in sums])


def ordered_risk(rows: DataFrame) -> DataFrame:
    """Each distinct confidence with the accepted rows and errors from it up; counted per confidence first."""
    grouped = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    return running(grouped, "confidence", ["n", "good"], down=True).withColumnsRenamed({"run_n": "accepted", "run_good": "correct"})


def match_threshold(rows: DataFrame, precision: float = 0.9, least: int = 5) -> DataFrame:
    """The lowest confidence from which up enough rows are accepted at enough precision; no row if there is none."""
    total = rows.agg(F.count("*").alias("total"))
    ok = ordered_risk(rows).where((F.col("accepted") >= least) & (F.col("correct") / F.col("accepted") >= precision))
    return ok.orderBy("confidence").limit(1).crossJoin(total).select(F.col("confidence").alias("threshold"), "accepted", "correct", (F.col("correct") / F.col("accepted")).alias("precision"), (F.col("accepted") / F.col("total")).alias("coverage"))


def no_match_threshold(rows: DataFrame, match: float, least: int = 5, precision: float = 0.9, most_false: float = 0.1) -> DataFrame:
    """The cut at or below which rows count as absent: most recall, then fewest false, then precision, then the lowest.

    ``label`` is 1 for rows that are absent. A row is predicted absent if its confidence is at most ``at_most``.
    """
    grouped = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    total = rows.agg(F.sum("label").alias("absent"), (F.count("*") - F.sum("label")).alias("present"))
    run = running(grouped, "confidence", ["n", "good"]).select("confidence", F.col("run_n").alias("predicted"), F.col("run_good").alias("correct")).crossJoin(F.broadcast(total))
    run = run.withColumn("false", F.col("predicted") - F.col("correct"))
    ok = run.where((F.col("confidence") < match) & (F.col("predicted") >= least) & (F.col("correct") / F.col("predicted") >= precision) & (F.col("false") / F.col("present") <= most_false))
    best = ok.orderBy((F.col("correct") / F.col("absent")).desc(), "false", (F.col("correct") / F.col("predicted")).desc(), "confidence").limit(1)
    return best.select(F.col("confidence").alias("at_most"), "predicted", "correct", "false", (F.col("correct") / F.col("absent")).alias("recall"))


def fit_logistic(rows: DataFrame, features: list[str], label: str, iterations: int = 500, rate: float = 0.05, most_rows: int = 50_000) -> tuple[list[float], float]:
    """Batch gradient descent from zero for a fixed number of steps.

    The steps are few hundred and tiny; the training set (a bounded sample by contract) is fitted on
    the driver. More than ``most_rows`` rows are an error, not a sample.
    """
    data = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("y")).limit(most_rows + 1).toPandas()
    if not 0 < len(data) <= most_rows:
        raise ValueError(f"between 1 and {most_rows} training rows are needed")
    x, y = data[features].to_numpy(), data["y"].to_numpy()
    w, b = np.zeros(len(features)), 0.0
    for _ in range(iterations):
        error = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y
        w, b = w - rate * (error @ x) / len(y), b - rate * error.sum() / len(y)
    return w.tolist(), float(b)


def fit_logistic_newton(rows: DataFrame, features: list[str], label: str, strength: float = 1.0, iterations: int = 50) -> tuple[list[float], float]:
    """The minimum of the summed log loss plus half the squared weights divided by ``strength`` (the intercept is free), by Newton's method.

    Each step sums gradient and curvature over the rows where they are, in one aggregate of (features + 1) ** 2 numbers.
    """
    names = [f"x{i}" for i in range(len(features))]
    data = rows.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)], F.col(label).cast("double").alias("y")).persist()
    at = np.zeros(len(features) + 1)
    penalty = np.diag([1.0 / strength] * len(features) + [0.0])
    columns = [*[F.col(n) for n in names], F.lit(1.0)]
    for _ in range(iterations):
        p = maths.sigmoid(sum((F.lit(float(w)) * c for w, c in zip(at, columns, strict=True)), F.lit(0.0)))
        gradient = [F.sum((p - F.col("y")) * c) for c in columns]
        curvature = [F.sum(p * (1 - p) * a * b) for a in columns for b in columns]
        got = data.agg(*[c.alias(f"s{i}") for i, c in enumerate([*gradient, *curvature])]).first()
        if got is None or got[0] is None:
            raise ValueError("there are no rows to fit")
        n = len(at)
        g, h = np.array(got[:n]) + penalty @ at, np.array(got[n:]).reshape(n, n) + penalty
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        at = at - step
        if np.abs(step).max() < 1e-10:
            break
    data.unpersist()
    return at[:-1].tolist(), float(at[-1])


def _pool(pools: list[list[float]], low: float, high: float, n: float, good: float) -> None:
    """Add a pool (range, rows, good ones) behind the others and merge while the shares don't rise."""
    pools.append([low, high, n, good])
    while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
        last = pools.pop()
        pools[-1][1], pools[-1][2], pools[-1][3] = last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]


def fit_isotonic(rows: DataFrame, x: str = "score", y: str = "label", most_knots: int = 100_000) -> list[tuple[float, float]]:
    """Pool-adjacent-violators knots. Scores are dealt by ranges and pooled where they are; what reaches the
    driver is each range's pools. A fit of more than ``most_knots`` pools is an error: it is no calibration."""
    grouped = rows.groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("good")).where("x is not null")

    def local(batches):
        pools: list[list[float]] = []
        for pdf in batches:
            for row in pdf[["x", "n", "good"]].to_numpy():
                _pool(pools, row[0], row[0], row[1], row[2])
        yield pd.DataFrame(pools, columns=["low", "high", "n", "good"])

    pooled = grouped.repartitionByRange("x").sortWithinPartitions("x").mapInPandas(local, "low double, high double, n double, good double")
    pools: list[list[float]] = []
    for r in pooled.toLocalIterator():  # part by part, so in order
        _pool(pools, *r)
        if len(pools) > most_knots:
            raise ValueError(f"the fit has more than {most_knots} pools")
    out = []
    for low, high, n, good in pools:
        out += [(low, good / n)] + ([(high, good / n)] if high > low else [])
    return out


def temperatures(rows: DataFrame, steps: range = range(-400, 401)) -> DataFrame:
    """Mean log loss of each temperature of a grid over (score, label): each task sums all steps over its rows, and
    gives a row for each step."""
    grouped = rows.groupBy("score", "label").agg(F.count("*").alias("n"))
    scale = np.exp(np.array(steps) / 100.0)

    def run(batches):
        loss, seen = np.zeros(len(scale)), 0
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                score, label, n = (part[c].to_numpy(dtype=float)[:, None] for c in ("score", "label", "n"))
                c = np.clip(1 / (1 + np.exp(-np.clip(score / scale, -40, 40))), EPSILON, 1 - EPSILON)
                loss += (-(label * np.log(c) + (1 - label) * np.log(1 - c)) * n).sum(axis=0)
                seen += int(n.sum())
        if seen:
            yield pd.DataFrame({"step": list(steps), "loss": loss, "n": seen})

    return grouped.mapInPandas(run, "step int, loss double, n long").groupBy("step").agg((F.sum("loss") / F.sum("n")).alias("nll"))


def calibrators(rows: DataFrame, by: str = "name") -> DataFrame:
    """Brier score, log loss and calibration error of each calibrator (``confidence``, ``label``), rounded, and its place:
    by Brier score, then log loss, then calibration error, then name."""
    c = clipped(F.col("confidence"))
    m = rows.groupBy(by).agg(F.round(F.avg((c - F.col("label")) ** 2), 6).alias("brier"), F.round(F.avg(log_loss(F.col("confidence"), F.col("label"))), 6).alias("nll"))
    gap = F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")
    m = m.join(reliability(rows, [by]).groupBy(by).agg(F.round(gap, 6).alias("ece")), by)
    # a row for each calibrator
    return m.withColumn("place", F.row_number().over(Window.orderBy("brier", "nll", "ece", by)))


def stopped(history: DataFrame, by: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """Early stopping of each run in ``by``: the first best epoch up to the one that is the ``patience``-th in a row without
    a new best, that epoch, the best metric and the epochs since. Epochs count from one in the order of ``epoch``."""
    order = Window.partitionBy(by).orderBy(epoch)
    best = F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    h = history.select(by, metric, epoch, F.row_number().over(order).alias("at"), (best.isNull() | (F.col(metric) > best)).alias("better"))
    h = h.withColumn("last", F.max(F.when(F.col("better"), F.col("at"))).over(order)).withColumn("stale", F.col("at") - F.col("last"))
    until = F.min(F.when(F.col("stale") >= patience, F.col("at"))).over(Window.partitionBy(by))
    seen = h.withColumn("until", until).where("until is null or at <= until")
    end = F.struct("at", "last", "stale")
    return seen.groupBy(by).agg(F.max(end).alias("x"), F.max(metric).alias("best")).select(by, F.col("x.last").alias("selected_epoch"), F.col("x.at").alias("stop_epoch"), "best", F.col("x.stale").alias("stale"))


def gates(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """One row for each rule (metric, operator, threshold) over a one-row table of metrics, with whether it passes."""
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual"), F.lit(op).alias("operator"), F.lit(float(t)).alias("threshold")) for m, op, t in rules]
    g = metrics.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    passed = F.when(F.col("operator") == ">=", F.col("actual") >= F.col("threshold")).when(F.col("operator") == "<=", F.col("actual") <= F.col("threshold")).otherwise(F.col("actual") == F.col("threshold"))
    return g.withColumn("passed", passed)
