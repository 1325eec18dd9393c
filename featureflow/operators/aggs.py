"""Aggregations and metrics (A1-A15). Every shuffle follows a map-side half."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.functions.numbers import ratio
from featureflow.operators.columns import cols_of
from featureflow.operators.quantiles import exact_quantiles
from featureflow.session import stage


#: Groups of at most this many rows hold their distinct values as one row of an aggregate; those of larger groups are cells.
WHOLE_GROUP = 4096


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _with_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a null key are left out of groups."""
    return df.dropna(subset=keys, how="any")


def group_mean(df: DataFrame, key: str | list[str], cols: list[str] | None = None) -> DataFrame:
    """Mean of all numeric columns per key."""
    keys = _keys(key)
    cols = cols or [c for c in cols_of(df, "numeric") if c not in keys]
    return _with_key(df, keys).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def group_stats(df: DataFrame, key: str | list[str], col: str, prefix: str = "price") -> DataFrame:
    """Mean, sample deviation, biased skewness (0 for n <= 2) and excess kurtosis (0 for n <= 3)."""
    keys = _keys(key)
    n = F.count(col)
    return _with_key(df, keys).groupBy(*keys).agg(
        F.avg(col).alias(f"{prefix}_mean"),
        F.stddev_samp(col).alias(f"{prefix}_std"),
        F.when(n > 2, F.skewness(col)).otherwise(F.lit(0.0)).alias(f"{prefix}_skew"),
        F.when(n > 3, F.kurtosis(col)).otherwise(F.lit(0.0)).alias(f"{prefix}_kurtosis"),
    )


def group_median(df: DataFrame, key: str | list[str], cols: dict[str, str], approx: bool = False) -> DataFrame:
    """Median per key, exact at any group size; `approx` uses the sketch alone."""
    keys = _keys(key)
    if approx:
        return df.groupBy(*keys).agg(*[F.percentile_approx(c, 0.5).alias(n) for n, c in cols.items()])
    out = None
    for n, c in cols.items():
        one = exact_quantiles(df, keys, c, {n: 0.5})
        out = one if out is None else out.join(one, keys, "full")
    return out


def segment_profile(
    df: DataFrame, by: str, count: str, means: dict[str, tuple[str, int]], medians: dict[str, tuple[str, int]],
    approx: bool = False,
) -> DataFrame:
    """Row count, rounded means and rounded medians per segment; specs are {name: (column, digits)}."""
    if medians:  # means and medians read the columns they need from one written copy, not from the plan behind them
        used = {c for c, _ in (*means.values(), *medians.values())}
        df = stage(df.select(by, *sorted(used - {by})))
    flat = df.groupBy(by).agg(
        F.count(F.lit(1)).alias(count), *[F.round(F.avg(c), d).alias(n) for n, (c, d) in means.items()]
    )
    if not medians:
        return flat
    med = group_median(df, by, {n: c for n, (c, _) in medians.items()}, approx)
    med = med.select(F.col(by).alias("_by"), *[F.round(n, d).alias(n) for n, (_, d) in medians.items()])
    return flat.join(med, flat[by].eqNullSafe(med["_by"]), "left").drop("_by")


def group_mode(df: DataFrame, key: str | list[str], cols: list[str], suffix: str = "_mode",
               nunique: bool = False) -> DataFrame:
    """Most frequent non-null value per key (smallest value wins a tie), and distinct counts.

    All columns go through one pass: rows become (column, value), counted with a
    map-side half, so a hot key costs one cell per distinct value.
    """
    keys = _keys(key)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    )
    counts = (
        _with_key(df, keys)
        .select(*keys, pairs.alias("_p"))
        .groupBy(*keys, F.col("_p.i").alias("_i"), F.col("_p.v").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    best = F.struct((-F.col("_c")).alias("c"), F.col("_v").alias("v"))
    aggs = []
    for i, c in enumerate(cols):
        known = (F.col("_i") == i) & F.col("_v").isNotNull()
        aggs.append(F.min(F.when(known, best))["v"].alias(f"{c}{suffix}"))
        if nunique:
            aggs.append(F.count(F.when(known, 1)).alias(f"{c}_nunique"))
    return counts.groupBy(*keys).agg(*aggs)


def agg_features(
    df: DataFrame, key: str | list[str], numeric: list[str] | None = None, categorical: list[str] | None = None,
    stats: tuple[str, ...] = ("mean", "sum", "count"), nunique: bool = False, cells: bool = False,
) -> DataFrame:
    """Statistics of numbers and mode (and distinct count) of categories per key.

    Where no group has more than WHOLE_GROUP rows, one shuffle gives all, and what a query does not
    select is not worked out. The count of the largest group is a job of its own over the keys. `cells` never does so.
    """
    keys = _keys(key)
    numeric = [c for c in cols_of(df, "numeric") if c not in keys] if numeric is None else numeric
    categorical = [c for c in cols_of(df, "string") if c not in keys] if categorical is None else categorical
    fns = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp}
    out = None
    aggs = [fns[s](c).alias(f"{c}_{s}") for c in numeric for s in stats]
    if categorical and not cells and not df.isStreaming and _small_groups(df, keys):
        return _with_key(df, keys).groupBy(*keys).agg(*aggs, *_modes(categorical, nunique))
    if numeric:
        out = _with_key(df, keys).groupBy(*keys).agg(*aggs)
    if categorical:
        modes = group_mode(df, keys, categorical, nunique=nunique)
        out = modes if out is None else out.join(modes, keys)
    return unique_values(_with_key(df, keys), keys) if out is None else out


def _small_groups(df: DataFrame, keys: list[str]) -> bool:
    largest = _with_key(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= WHOLE_GROUP


def _modes(cols: list[str], nunique: bool, suffix: str = "_mode") -> list[Column]:
    """What `group_mode` gives, as aggregates that hold the distinct values of a group in memory."""
    out = []
    for c in cols:
        text = F.col(c).cast("string")
        out.append(F.mode(text, True).alias(f"{c}{suffix}"))  # of equal counts the smallest value
        if nunique:
            out.append(F.size(F.collect_set(text)).cast("bigint").alias(f"{c}_nunique"))
    return out


def group_count(df: DataFrame, key: str | list[str], name: str = "count") -> DataFrame:
    keys = _keys(key)
    return _with_key(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def unique_values(df: DataFrame, cols: str | list[str]) -> DataFrame:
    return df.select(*_keys(cols)).dropDuplicates()


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Rows per non-null value, most frequent first, value as tie-break."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.col(name).desc(), F.col(col))


def cost_rollup(events: DataFrame, run: str = "run_id", operator: str = "operator", cost: str = "cost",
                attempts: str | None = None) -> DataFrame:
    """Cost and calls per (run, operator) with the run total beside them."""
    tries = F.sum(attempts) if attempts else F.count(F.lit(1))
    per_op = events.groupBy(run, operator).agg(
        F.sum(F.coalesce(F.col(cost), F.lit(0.0))).alias("cost_usd"), tries.alias("attempts")
    )
    total = per_op.groupBy(run).agg(F.sum("cost_usd").alias("run_cost_usd"), F.sum("attempts").alias("run_attempts"))
    return per_op.join(total, run)


def score_summary(folds: DataFrame, by: str | list[str], score: str = "score") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return folds.groupBy(*_keys(by)).agg(F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"))


def best_by(df: DataFrame, part: str | list[str], score: str = "score", tie: str = "trial") -> DataFrame:
    """The best row per group: highest score, then lowest tie value; a null score ranks last."""
    keys = _keys(part)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))), -F.col(tie))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(*keys, "_b.*").select(*df.columns)


def distinct_options(trajs: DataFrame, model: str = "model", temp: str = "temperature") -> DataFrame:
    """Distinct (model, temperature) pairs with the label `short name (t=x)`."""
    t = F.coalesce(F.col(temp).cast("double"), F.lit(0.0))
    short = F.element_at(F.split(F.col(model), "/"), -1)
    return (
        trajs.where(F.length(model) > 0)
        .select(F.col(model).alias("model"), t.alias("temperature"),
                F.concat(short, F.lit(" (t="), t.cast("string"), F.lit(")")).alias("label"))
        .dropDuplicates()
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, nulls; with row and column counts. One pass."""
    cols = df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"c{i}") for i, c in enumerate(cols)],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                    F.col(f"c{i}").alias("null_count"),
                )
                for i, c in enumerate(cols)
            ]
        )
    )
    return one.select(
        F.col("n").alias("row_count"), F.lit(len(cols)).cast("bigint").alias("column_count"), rows.alias("_c")
    ).select("row_count", "column_count", "_c.*")


# --- metrics --------------------------------------------------------------------------


def classification_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy, F1 of class 1 (`f1`, 0 without hits), macro and weighted F1 from the confusion counts (one row)."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    ends = F.explode(
        F.array(
            F.struct(F.col("l").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said")),
        )
    )
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    per_class = (
        cells.select(ends.alias("e"), hit.alias("h"))
        .groupBy(F.col("e.c").alias("c"))
        .agg(
            F.sum("e.support").alias("support"), F.sum("e.said").alias("said"),
            (F.sum("h") / 2).alias("hits"),
        )
        .withColumn("f1", ratio(2 * F.col("hits"), F.col("support") + F.col("said"), plus=0))
    )
    f1 = F.coalesce(F.col("f1"), F.lit(0.0))
    return per_class.agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.coalesce(F.max(F.when(F.expr("try_cast(cast(c AS string) AS double) = 1"), f1)), F.lit(0.0)).alias("f1"),
        F.avg(f1).alias("f1_macro"),
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """MSE and R2 in one pass (one row); R2 is NULL for a constant label."""
    err = F.pow(F.col(label) - F.col(pred), F.lit(2))
    return df.agg(F.avg(err).alias("mse"), F.sum(err).alias("_sse"),
                  (F.var_pop(label) * F.count(label)).alias("_sst")).select(
        "mse", (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2")
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC (one row): distinct scores are counted first, then ranked in score ranges."""
    from featureflow.operators.windows import running

    per = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    cum = running(per.withColumn("_one", F.lit(1)), ["_one"], ["s"], {"cneg": ("sum", "neg")})
    area = F.sum(F.col("pos") * (F.col("cneg") - F.col("neg") * 0.5))
    return cum.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def metrics(df: DataFrame, label: str, pred: str, score: str | None = None, kind: str = "classification") -> DataFrame:
    """All metrics of the kind in one row."""
    if kind == "regression":
        return regression_metrics(df, label, pred)
    out = classification_metrics(df, label, pred)
    if score:
        out = out.withColumn("roc_auc", F.lit(roc_auc(df, label, score).first()[0]).cast("double"))
    return out


def describe_frame(df: DataFrame, n: int = 5) -> DataFrame:
    """Summary record of a table: schema, first rows as maps, row count (one row)."""
    fields = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"))
          for f in df.schema.fields]
    )
    as_map = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    rows = df.count()
    sample = df.limit(n).agg(F.collect_list(as_map).alias("sample"))
    return sample.select(fields.alias("schema"), "sample", F.lit(rows).cast("bigint").alias("row_count"))
