"""Exact interpolated percentiles without gathering a group's values in one task.

Spark's ``percentile`` merges all distinct values of a group into one map on one task,
which a group holding a third of a large log does not survive. Here the rows are first
counted per (group, value, failed), so repeats never travel; the counts are then summed into
log-linear bins (each 0.1 % wide); a running sum over the bins finds the few bins that
hold the wanted ranks. Those bins are split again, a million times finer, so that however many values
one of them holds, only the values of the few fine bins with a wanted rank are sorted: 2 ** 22 at
most, as many doubles as there are in one. Bins and values come from the same counts with the same
columns, so the shuffle behind them is done once and the input is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_STEPS = 1 << 10
FINE_STEPS = 1 << 30


def value_bin(v: Column, steps: int = BIN_STEPS) -> Column:
    """A whole number that never falls as *v* rises; equal within 1/steps of magnitude."""
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    inside = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * steps)
    # 1100 octaves below 1.0 covers every double, subnormal ones included
    step = F.coalesce((octave + 1100) * steps + inside, F.lit(1 << 60)).try_cast("bigint")
    step = F.when(size > 1.7976931348623157e308, F.lit(1 << 60)).otherwise(step)
    return F.when(v == 0, F.lit(0)).when(v < 0, -step).otherwise(step).cast("bigint")


def percentile_name(p: float) -> str:
    return f"p{p:g}"


def _holding(parts: DataFrame, wanted: Column, by: list[str], carry: Sequence[str]) -> DataFrame:
    """The parts (with ``before`` and ``part_n`` rows) that hold a wanted rank, the ranks counted within them."""
    inside = F.filter(
        F.transform(wanted, lambda r: F.struct(r["name"].alias("name"), (r["at"] - F.col("before")).cast("bigint").alias("at"), r["part"].alias("part"))),
        lambda r: (r["at"] >= 0) & (r["at"] < F.col("part_n")),
    )
    return parts.select(
        *[F.col(c).alias(f"t_{c}") for c in by], *carry, inside.alias("wanted")
    ).filter(F.size("wanted") > 0)


def value_profile(
    df: DataFrame,
    value: str,
    percentiles: Sequence[float],
    by: Sequence[str] = (),
    errors: str | None = None,
    weight: str | None = None,
    spread: str | None = None,
) -> DataFrame:
    """Per group: ``total``, ``errors``, ``value_sum`` and one ``p<q>`` column per percentile.

    Percentile q lies at rank (n-1)*q/100 of the sorted values, interpolated between its
    two neighbours. *errors* names a boolean column whose true rows are counted; *weight*
    names a column saying how many rows a row stands for; *spread* one whose smallest and largest
    value come out as ``spread_min`` and ``spread_max``. Without *by* there is always one row,
    and an empty input gives zeros.
    """
    by = list(by)
    rows = F.col(weight) if weight else F.lit(1)
    failed = F.coalesce(F.col(errors), F.lit(False)) if errors else F.lit(False)
    of_spread = [F.col(spread).alias("spread")] if spread else []
    span = lambda low, high, *names: [F.min(low).alias(names[0]), F.max(high).alias(names[1])] if spread else []
    counts = (
        df.select(*by, F.col(value).cast("double").alias("v"), failed.alias("failed"), rows.alias("n"), *of_spread)
        .groupBy(*by, "v", "failed")
        .agg(F.sum("n").cast("bigint").alias("n"), *span("spread", "spread", "low", "high"))
        .withColumn("bin", value_bin(F.col("v")))
    )
    group = Window.partitionBy(*by)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = (
        counts.groupBy(*by, "bin")
        .agg(
            F.sum("n").alias("part_n"),
            F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("bin_e"),
            F.sum(F.col("v") * F.col("n")).alias("bin_sum"),
            *span("low", "high", "low", "high"),
        )
        .withColumn("before", F.sum("part_n").over(upto) - F.col("part_n"))
        .withColumn("total", F.sum("part_n").over(group))
        .withColumn("errors", F.sum("bin_e").over(group))
        .withColumn("value_sum", F.sum("bin_sum").over(group))
    )
    facts = ["total", "errors", "value_sum"]
    if spread:
        bins = bins.withColumns({"spread_min": F.min("low").over(group), "spread_max": F.max("high").over(group)})
        facts += ["spread_min", "spread_max"]

    def ranks(p: float) -> list[Column]:
        rank = (F.col("total") - 1) * F.lit(p / 100.0)
        low = F.floor(rank)
        high = F.least(low + 1, F.col("total") - 1)
        share = rank - low
        return [
            F.struct(F.lit(percentile_name(p)).alias("name"), at.cast("bigint").alias("at"), part.alias("part"))
            for at, part in ((low, 1 - share), (high, share))
        ]

    # without groups these are at most two parts per percentile
    shared = F.broadcast if not by else lambda df: df
    same = lambda names: [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in names]
    coarse = shared(_holding(bins, F.array(*[r for p in percentiles for r in ranks(p)]), [*by, "bin"], facts))
    near = counts.join(coarse, same([*by, "bin"]), "inner").withColumn("fine", value_bin(F.col("v"), FINE_STEPS))
    fine_upto = Window.partitionBy(*by, "bin").orderBy("fine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fines = near.groupBy(*by, "bin", "fine").agg(
        F.sum("n").alias("part_n"), F.first("wanted").alias("wanted"), *[F.first(c).alias(c) for c in facts]
    ).withColumn("before", F.sum("part_n").over(fine_upto) - F.col("part_n"))
    targets = shared(_holding(fines, F.col("wanted"), [*by, "fine"], facts))
    running = (
        Window.partitionBy(*by, "fine")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    picked = (
        counts.withColumn("fine", value_bin(F.col("v"), FINE_STEPS))
        .join(targets, same([*by, "fine"]), "inner")
        .withColumn("seen", F.sum("n").over(running))
        .withColumn(
            "mine",
            F.filter(
                "wanted",
                lambda r: (r["at"] >= F.col("seen") - F.col("n")) & (r["at"] < F.col("seen")),
            ),
        )
        .filter(F.size("mine") > 0)
        .select(*by, "v", *facts, F.explode("mine").alias("r"))
    )

    def interpolated(p: float) -> Column:
        here = F.col("r.name") == percentile_name(p)
        part = F.when(F.col("r.part") == 0, 0.0).otherwise(F.col("v") * F.col("r.part"))
        return F.coalesce(F.sum(F.when(here, part)), F.lit(0.0)).alias(percentile_name(p))

    return picked.groupBy(*by).agg(
        F.coalesce(F.max("total"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.max("errors"), F.lit(0)).cast("bigint").alias("errors"),
        F.coalesce(F.max("value_sum"), F.lit(0.0)).alias("value_sum"),
        *span("spread_min", "spread_max", "spread_min", "spread_max"),
        *[interpolated(p) for p in percentiles],
    )
