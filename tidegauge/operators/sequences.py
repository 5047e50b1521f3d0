"""Ordered sequences: trailing windows, recursions, runs of alarms and their post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def standardized(rows: DataFrame, stream: list[str], block: str | None, value: str, warmup: int) -> DataFrame:
    """z of each step against its block's warm-up mean and the stream's pooled warm-up deviation; 0 in warm-up and for missing values.

    The degrees of freedom are warm-up cells less blocks, 1 at least.
    """
    by = [*stream, *([block] if block else [])]
    warm = F.when(F.col("step") < warmup, F.col(value))
    out = rows.withColumn("mu", F.avg(warm).over(Window.partitionBy(*by)))
    whole = Window.partitionBy(*stream)
    res = F.when(F.col("step") < warmup, F.col(value) - F.col("mu"))
    blocks = F.size(F.collect_set(F.when(warm.isNotNull(), F.col(block))).over(whole)) if block else F.lit(1)
    out = out.withColumn("sigma", F.sqrt(F.sum(res * res).over(whole) / F.greatest(F.count(res).over(whole) - blocks, F.lit(1))))
    z = (F.col(value) - F.col("mu")) / F.greatest(F.col("sigma"), F.lit(1e-9))
    return out.withColumn("z", F.when(F.col("step") < warmup, 0.0).otherwise(F.coalesce(z, F.lit(0.0))))


def weighted(rows: DataFrame, stream: list[str], block: str, value: str, observed: str, size: int, warmup: int) -> DataFrame:
    """As ``standardized`` for block means over ``observed`` of ``size`` channels: residuals weigh by the root of the share observed; z is 0 where none is.

    With all channels observed it is the plain rule, whose degrees of freedom are the warm-up cells less the blocks.
    """
    weight = F.sqrt(F.col(observed) / size)
    known = rows.withColumn("_m", F.when(F.col(observed) > 0, F.col(value)))
    warm = F.when(F.col("step") < warmup, F.col("_m"))
    mu = known.groupBy(*stream, block).agg(F.avg(warm).alias("mu"))  # a row per block
    both = known.join(mu, [*stream, block])
    res = F.when(F.col("step") < warmup, (F.col("_m") - F.col("mu")) * weight)
    one = both.groupBy(*stream).agg(F.sum(res * res).alias("_ss"), F.count(res).alias("_n"), F.count_distinct(F.when(F.col("mu").isNotNull(), F.col(block))).alias("_b"))
    sigma = one.select(*stream, F.greatest(F.sqrt(F.coalesce("_ss", F.lit(0.0)) / F.greatest(F.col("_n") - F.col("_b"), F.lit(1))), F.lit(1e-9)).alias("sigma"))
    z = F.when(F.col("step") < warmup, 0.0).otherwise(F.coalesce((F.col("_m") - F.col("mu")) * weight / F.col("sigma"), F.lit(0.0)))
    return both.join(sigma, stream).withColumn("z", z).drop("_m")


def ewma(rows: DataFrame, by: list[str], lam: float = 0.2, part: int = 256) -> DataFrame:
    """abs(e) over its stationary deviation, e = lam z + (1 - lam) e over all steps before.

    The recursion is linear: parts of ``part`` steps are folded on their own, then the parts' ends, and each step adds
    what is left of the state at its part's start. No array holds a whole stream's steps.
    """
    keep = 1 - lam
    place = F.row_number().over(Window.partitionBy(*by).orderBy("step")) - 1
    cut = rows.withColumn("_part", F.floor(place / part)).withColumn("_at", (place % part).cast("long"))
    w = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_own", F.aggregate(F.collect_list("z").over(w), F.lit(0.0), lambda a, q: lam * q + keep * a))
    ends = own.groupBy(*by, "_part").agg(F.max_by("_own", "_at").alias("_end"), (F.max("_at") + 1).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.aggregate(F.collect_list(F.struct("_end", "_n")).over(before), F.lit(0.0), lambda a, x: x["_end"] + F.pow(F.lit(keep), x["_n"]) * a)
    start = ends.select(*by, "_part", carry.alias("_carry"))
    e = F.col("_own") + F.pow(F.lit(keep), F.col("_at") + 1) * F.col("_carry")
    return own.join(start, [*by, "_part"]).withColumn("ewma", F.abs(e) / (lam / (2 - lam)) ** 0.5).drop("_part", "_at", "_own", "_carry")


def cusum(rows: DataFrame, by: list[str], k: float = 0.5) -> DataFrame:
    """Two-sided CUSUM in closed form: a running sum less its running minimum."""
    w = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for side, sign in (("up", 1), ("down", -1)):
        out = out.withColumn(f"p_{side}", F.sum(F.when(F.col("live"), sign * F.col("z") - k).otherwise(0.0)).over(w))
        out = out.withColumn(side, F.col(f"p_{side}") - F.least(F.lit(0.0), F.min(f"p_{side}").over(w)))
    return out.withColumn("cusum", F.greatest("up", "down"))


def changepoint_cusum(rows: DataFrame, by: list[str], k: float = 0.5, m: int = 3, hazard: float = 1 / 200, least: float = 0.8, tau2: float = 4.0) -> DataFrame:
    """CUSUM with a Bayes-factor restart: a fold with reset, so one array per group and a struct as its state."""
    import math

    log_prior, shrink = math.log(hazard) - math.log(1 - hazard), tau2 / (1 + m * tau2)
    empty = F.array().cast("array<double>")

    def step(s: Column, z: Column) -> Column:
        r = z - s["offset"]
        up, down = F.greatest(F.lit(0.0), s["up"] + r - k), F.greatest(F.lit(0.0), s["down"] - r - k)
        hist = F.when(F.size(s["hist"]) >= m, F.concat(F.slice(s["hist"], 2, m - 1), F.array(r))).otherwise(F.concat(s["hist"], F.array(r)))
        total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
        odds = -0.5 * math.log(1 + m * tau2) + 0.5 * shrink * total * total + log_prior
        prob = F.when(F.size(hist) == m, 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))).otherwise(0.0)
        hit = prob >= least
        return F.struct(
            F.when(hit, s["offset"] + total / m).otherwise(s["offset"]).alias("offset"),
            F.when(hit, 0.0).otherwise(up).alias("up"),
            F.when(hit, 0.0).otherwise(down).alias("down"),
            F.when(hit, empty).otherwise(hist).alias("hist"),
            F.concat(s["out"], F.array(F.greatest(up, down, prob / least))).alias("out"),
        )

    start = F.struct(F.lit(0.0).alias("offset"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), empty.alias("hist"), empty.alias("out"))
    rows_of = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("step", "z"))).alias("_steps"))
    folded = rows_of.withColumn("_out", F.aggregate(F.col("_steps.z"), start, step)["out"])
    return folded.select(*by, F.explode(F.arrays_zip(F.col("_steps.step").alias("step"), F.col("_out").alias("score"))).alias("_row")).select(*by, "_row.step", "_row.score")


def trailing(by: list[str], width: int, order: str = "t") -> object:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)


def padded(by: list[str], value: str, width: int) -> Column:
    """The last ``width`` values as an array; before the start the first value is repeated."""
    w = trailing(by, width)
    first = F.first(value).over(Window.partitionBy(*by).orderBy("t"))
    got = F.collect_list(value).over(w)
    return F.concat(F.array_repeat(first, width - F.size(got)), got)


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, ((n + 2) / 2).cast("int"))) / 2


def runs(rows: DataFrame, by: list[str], alarm: str = "alarm") -> DataFrame:
    """Maximal runs of alarmed t as inclusive (start, end)."""
    on = rows.where(F.col(alarm))
    island = on.withColumn("island", F.col("t") - F.row_number().over(Window.partitionBy(*by).orderBy("t")))
    return island.groupBy(*by, "island").agg(F.min("t").alias("start"), F.max("t").alias("end")).drop("island")


def hysteresis(rows: DataFrame, by: list[str], low: float) -> DataFrame:
    """Runs of score > low * threshold that hold a score over the threshold."""
    on = rows.where(F.col("score") > low * F.col("threshold"))
    island = on.withColumn("island", F.col("t") - F.row_number().over(Window.partitionBy(*by).orderBy("t")))
    return island.groupBy(*by, "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.bool_or(F.col("score") > F.col("threshold")).alias("high")).where("high").drop("island", "high")


def merged_gaps(spans: DataFrame, by: list[str], gap: int, least: int = 1) -> DataFrame:
    """Runs at most ``gap`` apart become one; those shorter than ``least`` go."""
    w = Window.partitionBy(*by).orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(w) - 1 > gap, 1).otherwise(0)
    group = spans.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = group.groupBy(*by, "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")
    return out.where(F.col("end") - F.col("start") + 1 >= least)


def cooled(spans: DataFrame, by: list[str], rest: int) -> DataFrame:
    """Greedy: a run goes if it starts at most ``rest`` after the last kept run's end."""
    every = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    keep = F.expr(f"aggregate(_runs, cast(array() as array<struct<start:bigint,end:bigint>>), (a, r) -> if(size(a) = 0 or r.start - a[size(a) - 1].end > {int(rest)}, concat(a, array(r)), a))")
    return every.select(*by, F.explode(keep).alias("_row")).select(*by, "_row.start", "_row.end")


def merged_windows(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping or adjacent inclusive windows become one; its class joins the sorted distinct classes with '+'."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    group = spans.withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return group.groupBy(*by, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_set("class")), "+").alias("class")).drop("g")
