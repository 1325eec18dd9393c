"""sem_refine (Q4): unify variants of the values of one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.lineage.graphs import connected_components
from featureflow.semantic import sqltext
from featureflow.semantic.program import FeatureProgram, Operator, quote
from featureflow.session import stage


class SemRefine(Operator):
    """Values with the same plain words (case, accents, punctuation and word order aside) are one.

    With `max_deletes` > 0 keys that become equal after dropping up to that many letters
    each are one as well, transitively. Links run over the shared shortened forms, never over
    pairs of values, so a large group costs one link per member. With `max_distance` > 0 keys within
    that many edits (a letter put in, left out or replaced) are one, transitively: a key of which
    another is d edits away keeps one of d + 1 segments, so keys meet over segments and the distance
    is confirmed. The group takes its most frequent value; with existing_only=False its blanks and
    capitals are tidied too.

    The column must hold no nulls: fill it first.
    """

    def __init__(self, target: str, existing_only: bool = False, max_deletes: int = 0, hint: str = "", max_distance: int = 0):
        if max_deletes not in (0, 1, 2):
            raise ValueError("max_deletes must be 0, 1 or 2")
        if max_distance not in (0, 1, 2, 3) or (max_distance and max_deletes):
            raise ValueError("max_distance must be 0, 1, 2 or 3, and stands alone")
        self.target, self.existing_only, self.max_deletes, self.hint = target, existing_only, max_deletes, hint
        self.max_distance = max_distance

    def fit(self, df: DataFrame, **tables) -> FeatureProgram:
        t, q = self.target, quote(self.target)
        counted = df.groupBy(F.col(t).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        values = stage(counted.withColumn("k", F.expr(sqltext.collision_key("v"))))
        if values.where(F.col("v").isNull()).limit(1).count():
            raise ValueError(f"column {t!r} holds nulls; fill them before sem_refine")
        group = values.select("k").distinct().withColumn("g", F.col("k"))
        worded = values.select("k").where(F.length("k") > 0).distinct()
        if self.max_deletes:
            group = self._fuzzy_groups(worded)
        elif self.max_distance:
            group = near_groups(worded, self.max_distance)
        named = values.join(group, "k")
        best = named.groupBy("g").agg(
            F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))["v"].alias("_best")
        )
        mapping = named.select("k", "g").distinct().join(best, "g").select("k", F.col("_best"))
        if not self.existing_only:
            mapping = mapping.withColumn("_best", F.expr(f"initcap({sqltext.squeezed('_best')})"))
        program = FeatureProgram("sem_refine")
        program.columns(**{t: f"CASE WHEN {q} IS NULL THEN raise_error('{t} holds nulls') ELSE {q} END"})
        program.lookup("variants", stage(mapping), [(sqltext.collision_key(q), "k")], {"_best": "_refined"})
        program.columns(**{t: f"coalesce(_refined, {q})"})
        program.drop("_refined")
        program.attempts.append({"operator": "sem_refine", "hint": self.hint, "column": t})
        return program

    def _fuzzy_groups(self, keys: DataFrame) -> DataFrame:
        """k → group label: components of the graph key – shortened form."""
        forms = keys.withColumn("f", F.col("k"))
        level = forms
        for _ in range(self.max_deletes):
            cut = F.expr(
                "transform(sequence(1, length(f)), i -> concat(substring(f, 1, i - 1), substring(f, i + 1)))"
            )
            level = level.where(F.length("f") > 1).select("k", F.explode(F.array_distinct(cut)).alias("f"))
            forms = forms.unionByName(level)
        forms = forms.distinct()
        heads = forms.groupBy("f").agg(F.min("k").alias("head"))
        links = forms.join(heads, "f").where("k <> head").select(
            F.lit(0).alias("graph_id"), F.col("k").alias("source"), F.col("head").alias("target")
        )
        nodes = keys.select(F.lit(0).alias("graph_id"), F.col("k").alias("id"))
        return connected_components(nodes, links.distinct()).select(
            F.col("id").alias("k"), F.col("component").alias("g")
        )


def _segment(length: Column, j: int, d: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment `j` of a text of `length` letters in d + 1 segments, longer ones last."""
    base, longer = F.floor(length / (d + 1)).cast("int"), F.greatest(F.lit(0), F.lit(j - d - 1) + length % (d + 1))
    return F.lit(j) * base + longer, base + (length % (d + 1) >= d + 1 - j).cast("int")


def near_pairs(keys: DataFrame, d: int) -> DataFrame:
    """Distinct pairs (a, b) of different `k` with more than `d` letters that are at most `d` edits apart.

    The shorter key (of equal ones the lesser) gives its d + 1 segments with its length; the longer one looks for each
    of them where it can stand if the edits before and behind it are few enough. Their number
    depends on d alone. AQE splits segments that many keys share.
    """
    n = F.length("k")
    long = keys.where(n > d).select("k", n.alias("n"))
    own = []
    for j in range(d + 1):
        at, size = _segment(F.col("n"), j, d)
        own.append(F.struct(F.col("n").alias("l"), F.lit(j).alias("j"), F.substring("k", at + 1, size).alias("part")))
    sought = []
    for more in range(d + 1):
        length = F.col("n") - more
        for j in range(d + 1):
            at, size = _segment(length, j, d)
            for off in range(max(-j, more - (d - j)), min(j, more + (d - j)) + 1):
                fits = (length > d) & (at + off >= 0) & (at + off + size <= F.col("n"))
                sought.append(F.when(fits, F.struct(length.alias("l"), F.lit(j).alias("j"), F.substring("k", at + off + 1, size).alias("part"))))
    give = long.select(F.col("k").alias("a"), F.explode(F.array(*own)).alias("s")).select("a", "s.*")
    look = long.select(F.col("k").alias("b"), F.col("n"), F.explode(F.array_distinct(F.array_compact(F.array(*sought)))).alias("s")).select("b", "n", "s.*")
    met = give.join(look, ["l", "j", "part"]).where((F.col("l") < F.col("n")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", d) >= 0).select("a", "b").distinct()


def _deletions(keys: DataFrame, d: int) -> DataFrame:
    """(k, f): what is left of short keys without up to `d` letters."""
    level = out = keys.select("k", F.col("k").alias("f"))
    cut = F.expr("transform(sequence(1, length(f)), i -> concat(substring(f, 1, i - 1), substring(f, i + 1)))")
    for _ in range(d):
        level = level.where(F.length("f") > 0).select("k", F.explode(F.array_distinct(cut)).alias("f")).distinct()
        out = out.unionByName(level)
    return out.distinct()


def near_groups(keys: DataFrame, d: int) -> DataFrame:
    """(k, g): group label of each key; keys within `d` edits are in one group, transitively.

    Keys of at most `d` letters are one group by definition. One of them and a longer key have a
    form in common after up to `d` letters are left out of each; both are short, so forms are few.
    """
    n = F.length("k")
    short, middle = keys.where(n <= d), keys.where((n > d) & (n <= 2 * d))
    head = short.agg(F.min("k").alias("b")).where("b IS NOT NULL")  # one row
    stars = short.select(F.col("k").alias("a")).join(F.broadcast(head), F.col("a") > F.col("b"))
    forms = _deletions(short, d).withColumnRenamed("k", "a").join(_deletions(middle, d).withColumnRenamed("k", "b"), "f")
    mixed = forms.where(F.levenshtein("a", "b", d) >= 0).select("a", "b")
    links = near_pairs(keys, d).unionByName(stars).unionByName(mixed)
    edges = links.select(F.lit(0).alias("graph_id"), F.col("a").alias("source"), F.col("b").alias("target")).distinct()
    nodes = keys.select(F.lit(0).alias("graph_id"), F.col("k").alias("id"))
    return connected_components(nodes, edges).select(F.col("id").alias("k"), F.col("component").alias("g"))
