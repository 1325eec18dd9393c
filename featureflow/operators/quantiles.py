"""Exact quantiles without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.operators.windows import running
from featureflow.session import stage

#: Groups up to this many rows are ranked whole.
SMALL_GROUP = 50_000
#: A group with more cells than this is ranked in chunks instead of in one task.
HOT_CELLS = 1_000_000


def exact_quantiles(
    df: DataFrame, by: list[str], col: str | Column, probs: dict[str, float],
    accuracy: int = 20_000, small_group: int = SMALL_GROUP, hot_cells: int = HOT_CELLS,
) -> DataFrame:
    """Interpolated quantiles per group (`by` may be empty), exact at any size.

    First pass: a sketch per group gives a value bracket around every wanted rank. The
    bracket reaches four times the sketch's error bound (rows / accuracy) to both sides;
    groups of at most `accuracy` rows are ranked whole, so that this is four rows or more and
    the bracket is certain to hold both ranks an interpolation needs. Second pass: equal values are
    counted with a map-side half; values outside the brackets fall into one cell per gap,
    so only the few distinct values inside brackets are ranked.
    """
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    value = F.nanvl(value, F.lit(None).cast("double"))
    keys = [f"_g{i}" for i in range(len(by))] or ["_g"]
    groups = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias("_g")]
    v = df.select(*groups, value.alias("_v")).where(F.col("_v").isNotNull())

    eps = 4.0 / accuracy
    names = list(probs)
    marks = []
    for p in probs.values():
        marks += [max(p - eps, 0.0), min(p + eps, 1.0)]
    sketch = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(m) for m in marks]), accuracy).alias("_m"),
    )
    small = F.col("_n") <= F.lit(max(small_group, accuracy))
    lows, highs = [], []
    for i, p in enumerate(probs.values()):
        lows.append(F.when(small | F.lit(p <= eps), F.col("_min")).otherwise(F.col("_m")[2 * i]))
        highs.append(F.when(small | F.lit(p >= 1 - eps), F.col("_max")).otherwise(F.col("_m")[2 * i + 1]))
    brackets = sketch.select(
        *[F.col(k).alias(f"{k}_b") for k in keys], "_n", F.array(*lows).alias("_lo"), F.array(*highs).alias("_hi")
    )
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"{k}_b"))
        cond = e if cond is None else cond & e
    if not by:
        row = brackets.first()
        if row is None:
            return df.sparkSession.createDataFrame(
                [tuple(None for _ in names)], ", ".join(f"{n} double" for n in names)
            )
        with_b = v.withColumns(
            {
                "_n": F.lit(row["_n"]),
                "_lo": F.array(*[F.lit(x) for x in row["_lo"]]),
                "_hi": F.array(*[F.lit(x) for x in row["_hi"]]),
            }
        )
    else:
        # staged: one row per group, so the join is planned from its true size
        brackets = stage(brackets)
        with_b = v.join(brackets, cond).drop(*[f"{k}_b" for k in keys])

    inside, below = F.lit(False), F.lit(float("-inf"))
    for i in range(len(names)):
        lo, hi = F.col("_lo")[i], F.col("_hi")[i]
        inside = inside | ((F.col("_v") >= lo) & (F.col("_v") <= hi))
        below = F.greatest(below, F.when(F.col("_v") > hi, hi).otherwise(F.lit(float("-inf"))))
    cells = with_b.groupBy(*keys, F.when(inside, F.col("_v")).otherwise(below).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n")
    )
    # cells of a group: all its values if it is small, else those in the brackets and one per gap
    largest = brackets.agg(F.max("_n")).first()[0] if by else None
    few = by and max(small_group, accuracy, (largest or 0) * 2 * eps * len(names)) <= hot_cells
    if few:
        upto = F.sum("_c").over(
            Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        ranked = cells.withColumn("_upto", upto)
    else:  # a group's cells are ranked in chunks if they are many
        ranked = running(stage(cells), keys, ["_cell"], {"_upto": ("sum", "_c")}, hot_cells, max(1, hot_cells // 8))
    picks = []
    for i, p in enumerate(probs.values()):
        at = (F.col("_n") - 1) * F.lit(p)
        for end, f in (("a", F.floor(at)), ("b", F.ceil(at))):
            picks.append(F.min(F.when(F.col("_upto") > f, F.col("_cell"))).alias(f"_{end}{i}"))
    got = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        at = (F.col("_n") - 1) * F.lit(p)
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        out.append((a + (b - a) * (at - F.floor(at))).alias(name))
    return got.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *out)
