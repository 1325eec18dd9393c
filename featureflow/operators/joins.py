"""Joins (J1-J9). Strategies are Catalyst's; only row-checked sides are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.operators.windows import running
from featureflow.session import BROADCAST_BYTES, broadcast_if_small, has_at_most

#: Files may be far smaller than the rows they hold: a dimension of more rows than this is never broadcast.
BROADCAST_ROWS = 100_000


def merge(
    l: DataFrame,
    r: DataFrame,
    on: str | list[str] | None = None,
    left_on: str | list[str] | None = None,
    right_on: str | list[str] | None = None,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join with table-merge rules.

    `on` keeps the key once; `left_on`/`right_on` keep both keys. Other names that occur
    on both sides get the suffixes. `null_safe` lets null keys match each other.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if on is not None:
        lk = rk = [on] if isinstance(on, str) else list(on)
    else:
        lk = [left_on] if isinstance(left_on, str) else list(left_on)
        rk = [right_on] if isinstance(right_on, str) else list(right_on)
    shared = {k for k, k2 in zip(lk, rk) if k == k2}
    clash = (set(l.columns) & set(r.columns)) - shared
    lname = {c: c + suffixes[0] if c in clash else c for c in l.columns}
    rname = {c: c + suffixes[1] if c in clash else c for c in r.columns}
    for k in shared:
        rname[k] = f"_r_{k}"
    left = l.select(*[F.col(c).alias(n) for c, n in lname.items()])
    right = r.select(*[F.col(c).alias(n) for c, n in rname.items()])
    cond = None
    for a, b in zip(lk, rk):
        x, y = F.col(lname[a]), F.col(rname[b])
        e = x.eqNullSafe(y) if null_safe else x == y
        cond = e if cond is None else cond & e
    return left.join(right, cond, how).drop(*[rname[k] for k in shared])


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, str]], how: str = "inner",
              max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Fact joined to each dimension; a dimension is broadcast only within a bound on its bytes and its rows."""
    for dim, key in dims:
        small = dim.isStreaming or has_at_most(dim, max_rows)
        fact = merge(fact, broadcast_if_small(dim, max_bytes) if small else dim.hint("merge"), on=key, how=how)
    return fact


def align_by_occurrence(
    l: DataFrame, r: DataFrame, label: str, l_order: list[str], r_order: list[str],
    part: list[str] | None = None, **scan,
) -> DataFrame:
    """The i-th row of a label on the left meets the i-th row of that label on the right."""
    keys = [*(part or []), label]
    left = running(l, keys, l_order, {"occurrence": ("count", F.lit(1))}, **scan)
    right = running(r, keys, r_order, {"occurrence": ("count", F.lit(1))}, **scan)
    return merge(left, right, on=[*keys, "occurrence"])


def remap_ids(edges: DataFrame, mapping: DataFrame, part: list[str] | None = None,
              source: str = "source", target: str = "target") -> DataFrame:
    """Replace both edge ends by `mapping(old_id, new_id)`; unmapped ids stay."""
    part = part or []
    out = edges
    for end in (source, target):
        m = mapping.select(*part, F.col("old_id").alias(end), F.col("new_id").alias("_new"))
        out = out.join(m, [*part, end], "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return out.select(*edges.columns)


def lookup_chain(df: DataFrame, tables: list[tuple[DataFrame, str, str, str]], out: str = "value",
                 flag: str = "is_error") -> DataFrame:
    """Ordered fallbacks: each table is (frame, key in df, key in table, value column).

    The first table that has a value wins; `flag` marks rows that none could serve.
    Every table must hold one row per key.
    """
    hits = []
    cols = df.columns
    for i, (t, key, tkey, value) in enumerate(tables):
        side = t.select(F.col(tkey).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        df = df.join(side, F.col(key) == F.col(f"_k{i}"), "left")
        hits.append(F.col(f"_v{i}"))
    found = F.coalesce(*hits)
    return df.select(*cols, found.alias(out), found.isNull().alias(flag))
