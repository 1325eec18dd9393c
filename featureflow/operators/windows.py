"""Ordered operators (W1-W7) that stay exact and parallel on one huge group.

Three means are used instead of a plain window over a hot group:
* an aggregate with a map-side half (`max_by`, `min_by`) wherever one row per key is wanted,
* a range-partitioned global position, so an order over the whole table is no single task,
* prefix scans in two levels: inside chunks, then over one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.functions.hashing import _col
from featureflow.session import broadcast_if_small, has_at_most, stage

#: A group with more rows than this is scanned in chunks instead of in one task.
HOT_ROWS = 5_000_000
#: Types of order columns whose sketch gives a bound.
SORTABLE = ("byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz")
CHUNK_ROWS = 1_000_000


def _order(order_cols: list) -> list[Column]:
    """Names ascend, names after a minus sign descend; empty values come last both ways."""
    named = lambda c: F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last()
    return [named(c) if isinstance(c, str) else c for c in order_cols]


#: Bytes of a text that make up its number in `_as_number`.
PREFIX = 7


def _as_number(df: DataFrame, name: str) -> Column | None:
    """A number that ascends with the order `name` stands for; equal for texts that begin alike. None for other types."""
    column = name.removeprefix("-")
    kind, c = df.schema[column].dataType.typeName(), F.col(column)
    if kind == "string":
        # the first bytes as one number; a shorter text is filled up with zeros
        c = F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("long")
        kind = "long"
    elif kind not in SORTABLE:
        return None
    if not name.startswith("-"):
        return c
    if kind in ("float", "double"):
        return -c
    if kind in ("date", "timestamp", "timestamp_ntz"):
        c = F.unix_micros(c.cast("timestamp"))
    return F.bitwise_not(c)  # descends without an overflow


def global_position(df: DataFrame, order_cols: list, name: str = "_pos") -> DataFrame:
    """0-based position of every row in the order over the whole table.

    Rows are range-partitioned and sorted, numbered inside their partition, and staged
    so that the numbers cannot change. Partition sizes (one row per partition) give
    the offset. No task sees more than one range.
    """
    cols = df.columns
    order = _order(order_cols)
    ids = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", ids)
    staged = stage(
        ranged.select(
            *cols,
            F.shiftright("_mid", 33).alias("_part"),
            F.col("_mid").bitwiseAND((1 << 33) - 1).alias("_in"),
        )
    )
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count
    offsets = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return staged.join(F.broadcast(offsets), "_part").select(*cols, (F.col("_before") + F.col("_in")).alias(name))


def ntile_global(df: DataFrame, k: int, col: str, tie: str | list[str], name: str = "ntile") -> DataFrame:
    """NTILE(k) over the whole table in the order of `col`, ties broken by `tie`.

    Only the order columns are ranked; the k-1 boundary rows come to the driver and the
    full table is labelled by comparing with them, without being shuffled.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    order = [col, *ties]
    ranked = global_position(df.select(*order), order)
    n = ranked.agg(F.max("_pos")).first()[0]
    n = 0 if n is None else n + 1
    size, extra = divmod(n, k)
    starts, at = [], 0
    for i in range(k - 1):
        at += size + (1 if i < extra else 0)
        if at < n and at not in starts:
            starts.append(at)
    bounds = ranked.where(F.col("_pos").isin(starts)).orderBy("_pos").collect() if starts else []
    types = {c: df.schema[c].dataType for c in order}
    bucket = F.lit(1)
    for b in bounds:
        bucket = bucket + F.when(_not_before(order, b, types), 1).otherwise(0)
    return df.withColumn(name, bucket)


def _not_before(order: list[str], row, types) -> Column:
    """(columns) >= (row) in ascending order with nulls last."""
    out = F.lit(True)
    for c in reversed(order):
        v = row[c]
        if v is None:
            out = F.col(c).isNull() & out
        else:
            lit = F.lit(v).cast(types[c])
            out = F.col(c).isNull() | (F.col(c) > lit) | (F.col(c).eqNullSafe(lit) & out)
    return out


def rank_desc(df: DataFrame, col: str, name: str = "rank", rows: int | None = None, bound: int = 1_000_000) -> DataFrame:
    """RANK() by `col` descending, nulls last.

    `rows` is a known bound of the row count (for example the size of the grouping
    dimension); when absent it is checked. In larger frames values are counted first, so
    that equal values, however many, are one row of what is ranked.
    """
    small = rows <= bound if rows is not None else has_at_most(df, bound)
    if small:
        return df.withColumn(name, F.rank().over(Window.orderBy(F.col(col).desc_nulls_last())).cast("bigint"))
    values = stage(df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    if has_at_most(values, bound):
        upto = F.sum("_c").over(Window.orderBy(F.col("_v").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
        first = values.select("_v", (F.coalesce(upto, F.lit(0)) + 1).alias(name))
    else:
        placed = global_position(values, [F.col("_v").desc_nulls_last()])
        chunk = F.floor(F.col("_pos") / F.lit(bound)).cast("bigint")
        placed = placed.withColumn("_chunk", chunk)
        here = Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        tops = placed.groupBy("_chunk").agg(F.sum("_c").alias("_t"))  # a row per chunk of values
        tops = tops.select("_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
        inside = placed.select("_v", "_chunk", F.coalesce(F.sum("_c").over(here), F.lit(0)).alias("_in"))
        first = inside.join(tops, "_chunk").select("_v", (F.col("_before") + F.col("_in") + 1).alias(name))
    return df.join(first, df[col].eqNullSafe(first["_v"])).drop("_v")


def latest_per_key(df: DataFrame, key: str | list[str], ts: str | list[str]) -> DataFrame:
    """The newest row per key; give a unique last column in `ts` to break ties."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [ts] if isinstance(ts, str) else list(ts)
    return _pick(df, keys, F.max_by, F.struct(*order))


def first_by_priority(df: DataFrame, name: str | list[str], prio: str | list[str]) -> DataFrame:
    """The row of the lowest priority number per name."""
    keys = [name] if isinstance(name, str) else list(name)
    order = [prio] if isinstance(prio, str) else list(prio)
    return _pick(df, keys, F.min_by, F.struct(*order))


def first_emission(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The first row per key in the given order; later duplicates are dropped."""
    return first_by_priority(df, key, order)


def _pick(df: DataFrame, keys: list[str], fn, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(fn(F.struct(*rest), order).alias("_r"))
    return out.select(*keys, "_r.*").select(*df.columns)


# --- prefix scans ---------------------------------------------------------------------


def largest_group(df: DataFrame, part: list[str]) -> int:
    return df.groupBy(*part).count().agg(F.max("count")).first()[0] or 0


def chunked(df: DataFrame, part: list[str], order: list, hot_rows: int | None = None,
            chunk_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add `_chunk`: 0 everywhere, or slices of the global order when some group is hot."""
    if largest_group(df, part) <= (HOT_ROWS if hot_rows is None else hot_rows):
        return df.withColumn("_chunk", F.lit(0).cast("bigint")), False
    placed = global_position(df, [*part, *order])
    step = CHUNK_ROWS if chunk_rows is None else chunk_rows
    return placed.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(step)).cast("bigint")).drop("_pos"), True


_COMBINE = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame, part: list[str], order: list, what: dict[str, tuple[str, str | Column]],
    hot_rows: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Running values inside each group, current row included.

    `what` maps the new column to (kind, column) with kind count, sum, max, min or last
    (last = latest non-null value).
    """
    data, split = chunked(df, part, order, hot_rows, chunk_rows)
    fns = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}
    here = Window.partitionBy(*part, "_chunk").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = {
        n: (F.last(_col(c), ignorenulls=True) if kind == "last" else fns[kind](_col(c))).over(here)
        for n, (kind, c) in what.items()
    }
    out = data.select(*data.columns, *[e.alias(n) for n, e in local.items()])
    if not split:
        return out.drop("_chunk")
    tops = data.groupBy(*part, "_chunk").agg(
        *[
            (
                F.max_by(_col(c), F.when(_col(c).isNotNull(), F.struct(*[F.col(o) for o in order])))
                if kind == "last"
                else fns[kind](_col(c))
            ).alias(n)
            for n, (kind, c) in what.items()
        ]
    )
    before = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(
        *[F.col(p).alias(f"_k{i}") for i, p in enumerate(part)],
        F.col("_chunk").alias("_kc"),
        *[
            (F.last(n, ignorenulls=True) if kind == "last" else _COMBINE[kind](n)).over(before).alias(f"_c_{n}")
            for n, (kind, _) in what.items()
        ],
    )
    cond = F.col("_chunk") == F.col("_kc")
    for i, p in enumerate(part):
        cond = cond & F.col(p).eqNullSafe(F.col(f"_k{i}"))
    joined = out.join(carry, cond, "left")
    final = []
    for n, (kind, _) in what.items():
        a, b = F.col(n), F.col(f"_c_{n}")
        if kind in ("count", "sum"):
            v = F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        elif kind == "max":
            v = F.greatest(a, b)
        elif kind == "min":
            v = F.least(a, b)
        else:
            v = F.coalesce(a, b)
        final.append(v.alias(n))
    return joined.select(*df.columns, *final)


def following(
    df: DataFrame, part: list[str], order: list, col: str, name: str, default_flag: str | None = None,
    hot_rows: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Value of `col` in the next row of the group; `default_flag` tells rows with no next row."""
    data, split = chunked(df, part, order, hot_rows, chunk_rows)
    here = Window.partitionBy(*part, "_chunk").orderBy(*_order(order))
    boxed = F.struct(F.col(col).alias("v"))
    out = data.withColumn("_next", F.lead(boxed).over(here))
    if split:
        heads = data.groupBy(*part, "_chunk").agg(
            F.min_by(boxed, F.struct(*[F.col(o) for o in order])).alias("_head")
        )
        chain = heads.select(
            *[F.col(p).alias(f"_k{i}") for i, p in enumerate(part)],
            F.col("_chunk").alias("_kc"),
            F.lead("_head").over(Window.partitionBy(*part).orderBy("_chunk")).alias("_after"),
        )
        cond = F.col("_chunk") == F.col("_kc")
        for i, p in enumerate(part):
            cond = cond & F.col(p).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(chain, cond, "left").withColumn("_next", F.coalesce("_next", "_after"))
    extra = [F.col("_next.v").alias(name)]
    if default_flag:
        extra.append(F.col("_next").isNull().alias(default_flag))
    return out.select(*df.columns, *extra)


def last_of_run(df: DataFrame, part: list[str], order: list, col: str, number: str = "run_no",
                hot_rows: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Last row of every run of equal consecutive values; runs are numbered from 1."""
    kw = {"hot_rows": hot_rows, "chunk_rows": chunk_rows}
    nxt = following(df, part, order, col, "_nv", "_end", **kw)
    ends = nxt.where(F.col("_end") | ~F.col(col).eqNullSafe(F.col("_nv"))).drop("_nv", "_end")
    return running(ends, part, order, {number: ("count", F.lit(1))}, **kw)


def trajectory_progress(trials: DataFrame, run: str = "run_id", hot_rows: int | None = None,
                        chunk_rows: int | None = None) -> DataFrame:
    """Best score so far per run and the gain of each trial over its parent."""
    best = running(trials, [run], ["trial"], {"best_so_far": ("max", "score")}, hot_rows, chunk_rows)
    parents = trials.select(run, F.col("trial").alias("parent_trial"), F.col("score").alias("parent_score"))
    joined = best.join(parents, [run, "parent_trial"], "left")
    return joined.select(
        *trials.columns,
        "best_so_far",
        (F.col("score") - F.col("parent_score")).alias("improvement"),
        F.coalesce(F.col("score") == F.col("best_so_far"), F.lit(False)).alias("is_best_so_far"),
    )


#: Shares of a group at which its order column is looked at before the group is shuffled.
CUTS = (0.000001, 0.00001, 0.0001, 0.001, 0.01, 0.1)


def _cut_by_order(df: DataFrame, part: list[str], k: int | Column, first: Column, accuracy: int = 2_000_000) -> DataFrame:
    """Without the rows that are certainly behind the first k of their group in ascending order of `first`.

    A sketch gives values at fixed shares of the group; the first one behind which k
    rows and twice the sketch's error remain in front is the bound.
    """
    found = df.groupBy(*[F.col(p).alias(f"_g{i}") for i, p in enumerate(part)]).agg(
        F.count(first).alias("_n"), F.percentile_approx(first, list(CUTS), accuracy).alias("_cuts"),
        F.max(k if isinstance(k, Column) else F.lit(k)).alias("_want"),
    )
    bound = F.coalesce(
        *[F.when(F.lit(p) * F.col("_n") >= F.col("_want") + 2 + 2 * F.col("_n") / accuracy, F.col("_cuts")[i]) for i, p in enumerate(CUTS)]
    )
    found = stage(found.select(*[f"_g{i}" for i in range(len(part))], bound.alias("_bound")))
    cond = F.lit(True)
    for i, p in enumerate(part):
        cond = cond & F.col(p).eqNullSafe(F.col(f"_g{i}"))
    out = df.join(broadcast_if_small(found), cond)
    # empty values come last in this order; they matter only where no bound is known
    return out.where(F.col("_bound").isNull() | (first <= F.col("_bound"))).select(*df.columns)


def top_per_group(df: DataFrame, part: list[str], k: int | Column, order: list, salts: int = 64,
                  small: int = 1_000_000) -> DataFrame:
    """The first k rows of every group in the given order (k may be a column).

    Beyond `small` rows a bound on the order column is found first (where that is the name of a number,
    a time or a text, after a minus sign for a descending order), and rows behind it are dropped before
    anything is shuffled. Then two rounds: first inside `salts` slices of the group, then among the
    survivors, so that a group of equal values meets in no one task before it is cut down.
    """
    o = _order(order)
    number = _as_number(df, order[0]) if isinstance(order[0], str) else None
    if number is not None and not has_at_most(df, small):
        df = _cut_by_order(df, part, k, number)
    slice_of = F.pmod(F.xxhash64(*[c for c in df.columns if _hashable(df, c)]), F.lit(salts))
    one = Window.partitionBy(*part, "_slice").orderBy(*o)
    cut = (
        df.withColumn("_slice", slice_of)
        .withColumn("_rn", F.row_number().over(one))
        .where(F.col("_rn") <= k)
    )
    two = Window.partitionBy(*part).orderBy(*o)
    return cut.withColumn("_rn", F.row_number().over(two)).where(F.col("_rn") <= k).drop("_rn", "_slice")


def _hashable(df: DataFrame, c: str) -> bool:
    return "map" not in df.schema[c].dataType.simpleString()


def top_k(df: DataFrame, part: list[str], k: int, order: list) -> DataFrame:
    """Top k rows per group. For small k Spark cuts each group before the shuffle itself."""
    if k > 1000:
        return top_per_group(df, part, k, order)
    w = Window.partitionBy(*part).orderBy(*_order(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
