"""sem_augment (Q11): synthetic training rows, never at predict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.functions.hashing import key_fraction
from featureflow.operators.columns import cols_of
from featureflow.session import stage


class SemAugment:
    """Copies of minority rows with seeded noise until the class is `target_ratio` of the majority.

    Every row of a smaller class gets the same whole number of copies, and a seeded share of
    them one more, so no row is gathered or counted out. Noise is +/- `scale` deviations of
    the column, from key, copy number and column. Labels and keys are not changed.
    """

    def __init__(self, y: str, key: str, target_ratio: float = 1.0, scale: float = 0.05, seed: int = 0,
                 method: str = "jitter"):
        if method not in ("jitter", "copy"):
            raise ValueError("method must be 'jitter' or 'copy'")
        self.y, self.key, self.target_ratio, self.scale, self.seed, self.method = y, key, target_ratio, scale, seed, method

    def augment(self, df: DataFrame) -> DataFrame:
        sizes = stage(df.groupBy(F.col(self.y).alias("_class")).agg(F.count(F.lit(1)).alias("_n")))
        base = df.withColumn("is_augmented", F.lit(False))
        want = self.target_ratio * (sizes.agg(F.max("_n")).first()[0] or 0)
        per_row = F.greatest(F.lit(float(want)) - F.col("_n"), F.lit(0.0)) / F.col("_n")
        more = F.when(key_fraction(self.key, self.seed) < F.col("_per") - F.floor("_per"), 1).otherwise(0)
        marked = df.join(sizes.withColumn("_per", per_row), F.col(self.y).eqNullSafe(F.col("_class")))
        marked = marked.withColumn("_m", (F.floor("_per") + more).cast("int")).drop("_class", "_n", "_per")
        copies = marked.where("_m > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _m)")))
        if self.method == "jitter":
            nums = [c for c in cols_of(df, "numeric") if c not in (self.y, self.key)]
            if nums:
                sd = df.agg(*[F.stddev_pop(c).alias(c) for c in nums]).first()
                moved = {}
                for i, c in enumerate(nums):
                    u = key_fraction([self.key, "_copy"], self.seed + 1 + i) * 2 - 1
                    moved[c] = (F.col(c) + u * F.lit(self.scale * (sd[c] or 0.0))).cast(df.schema[c].dataType)
                copies = copies.withColumns(moved)
        return base.unionByName(copies.drop("_m", "_copy").withColumn("is_augmented", F.lit(True)))
