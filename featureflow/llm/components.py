"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.session import stage, staged_path


def _starred(edges: DataFrame, ends: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node around; `ends`: (u, v) seen from u."""
    least = ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    side = ends.where("v > u") if large else ends.where("v <= u")
    hung = side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:  # a node that hangs its smaller neighbours goes there itself
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` for every node of `links` (u, v: long) that isn't its component's smallest.

    Each round writes its links to the shared folder and is removed when the next
    one is written; rounds go on until nothing changes, without a bound on their
    number. Self links, repeated links and either direction are allowed; an empty
    table gives no rows. NULL ends are ignored.
    """
    edges = stage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after_large = stage(_starred(edges, both, large=True), replaces=None)
        small_ends = after_large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        after_small = _starred(after_large, small_ends, large=False)
        old = staged_path(edges)
        edges = stage(after_small, replaces=old)
        now = digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
