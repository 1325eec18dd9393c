"""sem_fillna (Q1): fill a target column from the other columns of the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.numbers import NUMERIC
from featureflow.operators.quantiles import exact_quantiles
from featureflow.semantic import sqltext
from featureflow.semantic.program import FeatureProgram, Operator, quote, text_literal
from featureflow.session import stage

#: A dictionary of known values up to this size is written into the program text.
INLINE_VALUES = 2000


class SemFillNA(Operator):
    """Fill nulls of `target` in this order; the column `<target>_source` tells which rule did it.

    1. `text`: a known value named in a text column (longest, then most frequent, then
       alphabetical), of any number of words.
    2. `group`: the most frequent value (numbers with existing_only=False: the median) among rows
       that agree in the context columns, dropping context columns from the right.
    3. `overall`: the same over all rows.

    Only values seen at fit are ever written, except medians. `hint` is kept with the program;
    its words move context columns they name to the front.
    """

    def __init__(self, target: str, context: list[str] | None = None, hint: str = "", existing_only: bool = True,
                 text: list[str] | None = None):
        self.target, self.hint, self.existing_only = target, hint, existing_only
        self.context, self.text = list(context or []), list(text or [])

    def _ordered_context(self) -> list[str]:
        said = self.hint.lower()
        return sorted(self.context, key=lambda c: (c.lower() not in said, self.context.index(c)))

    def fit(self, df: DataFrame, **tables) -> FeatureProgram:
        t, q = self.target, quote(self.target)
        numeric = isinstance(df.schema[t].dataType, NUMERIC)
        median = numeric and not self.existing_only
        program = FeatureProgram("sem_fillna")
        known = df.where(F.col(t).isNotNull())
        tries: list[tuple[str, str]] = []

        if self.text and not numeric:
            for i, e in enumerate(self._dictionary(known, program)):
                # a column of its own: looked up once, and only in rows that miss the target
                program.columns(**{f"_text{i}": f"CASE WHEN {q} IS NULL THEN {e} END"})
                tries.append(("text", f"_text{i}"))

        levels = self._ordered_context()
        # modes of all levels come from one table of counts at the finest level
        counts = None if median else stage(known.groupBy(*levels, F.col(t).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
        for depth in range(len(levels), 0, -1):
            ctx = levels[:depth]
            if median:
                best = exact_quantiles(known, ctx, t, {"_best": 0.5})
            else:
                per = counts.groupBy(*ctx, "_v").agg(F.sum("_c").alias("_c"))
                typed = F.col("_v").cast(df.schema[t].dataType)  # ties go to the least value, not the least text
                best = per.groupBy(*ctx).agg(F.min(F.struct((-F.col("_c")).alias("c"), typed.alias("v")))["v"].alias("_best"))
            best = best.dropna(subset=ctx)
            name = f"level{depth}"
            program.lookup(name, stage(best), [(quote(c), c) for c in ctx], {"_best": f"_fill{depth}"})
            tries.append(("group", f"_fill{depth}"))

        value = self._overall(known, counts, median)
        if value is not None:  # text that casts back to the same value of the type
            tries.append(("overall", f"cast({text_literal(value)} AS {'double' if median else df.schema[t].dataType.simpleString()})"))
        cases = " ".join(f"WHEN {e} IS NOT NULL THEN '{kind}'" for kind, e in tries)
        source = f"CASE WHEN {q} IS NOT NULL THEN 'given' {cases} END"
        program.columns(**{f"{t}_source": source})
        dtype = df.schema[t].dataType.simpleString()
        filled = f"coalesce({', '.join([q, *[f'cast({e} AS {dtype})' for _, e in tries]])})"
        if median and not isinstance(df.schema[t].dataType, (T.DoubleType, T.FloatType)):
            filled = f"coalesce({', '.join([f'cast({q} AS double)', *[f'cast({e} AS double)' for _, e in tries]])})"
        program.columns(**{t: filled})
        program.drop(*[e for kind, e in tries if kind != "overall"])
        program.attempts.append({"operator": "sem_fillna", "hint": self.hint, "rules": [k for k, _ in tries]})
        return program

    def _overall(self, known: DataFrame, counts: DataFrame | None, median: bool) -> str | None:
        if median:
            middle = exact_quantiles(known, [], self.target, {"m": 0.5}).first()["m"]
            return None if middle is None else repr(middle)
        typed = F.col("_v").cast(known.schema[self.target].dataType)
        top = counts.groupBy("_v").agg(F.sum("_c").alias("_c")).orderBy(F.col("_c").desc(), typed).limit(1).collect()
        return top[0]["_v"] if top else None

    def _dictionary(self, known: DataFrame, program: FeatureProgram) -> list[str]:
        """SQL expressions that find a known value in the text columns."""
        phrase = F.array_join(F.expr(sqltext.words("v")), " ")
        counts = known.groupBy(F.col(self.target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        entries = (
            counts.select("v", "n", phrase.alias("k"))
            .where(F.length("k") > 0)
            .groupBy("k")
            .agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))).alias("b"))
            .select("k", F.col("b.v").alias("v"), (-F.col("b.n")).alias("n"))
        )
        entries = stage(entries)
        # word runs are formed in the sizes that known values have
        sizes = entries.groupBy(F.size(F.split("k", " ")).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()
        if not sizes:
            return []
        grams = [sqltext.word_grams(quote(c), [r["size"] for r in sizes]) for c in self.text]
        if sum(r["n"] for r in sizes) <= INLINE_VALUES:
            rows = entries.collect()
            pairs = ", ".join(
                f"{text_literal(r['k'])}, named_struct('l', {-len(r['k'].split())}, 'n', {-r['n']}, "
                f"'v', {text_literal(r['v'])})"
                for r in rows
            )
            table = f"map({pairs})"
            return [f"array_min(array_compact(transform({g}, g -> try_element_at({table}, g)))).v" for g in grams]
        # large dictionary: resolve the distinct texts once by an equi-join on word runs
        out = []
        for i, (c, g) in enumerate(zip(self.text, grams)):
            program.tables[f"dict{i}"] = entries
            program.steps.append({"op": "phrases", "table": f"dict{i}", "col": c, "grams": g, "as": f"_found{i}"})
            out.append(f"_found{i}")
        return out


def _phrases(self, df: DataFrame, step: dict, bound) -> DataFrame:
    """Replay of a large dictionary: distinct texts → word runs ⋈ dictionary → best value."""
    c = step["col"]
    texts = df.select(F.col(c).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    runs = texts.select("_text", F.explode(F.expr(step["grams"].replace(quote(c), "_text"))).alias("k"))
    order = F.struct((-F.size(F.split("k", " "))).alias("l"), (-F.col("n")).alias("n"), F.col("v").alias("v"))
    best = runs.join(self.tables[step["table"]], "k").groupBy("_text").agg(F.min(order)["v"].alias(step["as"]))
    return df.join(best, F.col(c) == F.col("_text"), "left").drop("_text")


FeatureProgram._phrases = _phrases
