"""sem_clean (Q2, Q3): numeric capping and spelling standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.operators.quantiles import exact_quantiles
from featureflow.semantic import sqltext
from featureflow.semantic.program import FeatureProgram, Operator, quote
from featureflow.session import stage


class SemClean(Operator):
    """kind="numeric": values that satisfy `invalid` become NULL, the rest is capped at the
    quartiles -/+ `iqr_k` times their distance (exact quartiles; `approx` uses the sketch).

    kind="text": blanks are trimmed and collapsed, and every spelling that differs only in
    case or blanks becomes the most frequent one.
    """

    def __init__(self, columns: list[str], kind: str = "numeric", iqr_k: float = 1.5, invalid: str | None = "<=0",
                 approx: bool = False, hint: str = ""):
        if kind not in ("numeric", "text"):
            raise ValueError("kind must be 'numeric' or 'text'")
        self.columns, self.kind, self.iqr_k, self.invalid, self.approx = columns, kind, iqr_k, invalid, approx
        self.hint = hint

    def fit(self, df: DataFrame, **tables) -> FeatureProgram:
        return self._fit_numeric(df) if self.kind == "numeric" else self._fit_text(df)

    def _fit_numeric(self, df: DataFrame) -> FeatureProgram:
        program = FeatureProgram("sem_clean")
        valid = {c: f"({quote(c)} {self.invalid})" if self.invalid else "false" for c in self.columns}
        cells = F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), F.expr(f"CASE WHEN NOT {valid[c]} THEN cast({quote(c)} AS double) END").alias("v"))
                    for i, c in enumerate(self.columns)
                ]
            )
        )
        long = df.select(cells.alias("c")).select("c.i", "c.v")
        if self.approx:
            q = long.groupBy("i").agg(F.percentile_approx("v", [0.25, 0.75], 10_000).alias("q"))
            q = q.select("i", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
        else:
            q = exact_quantiles(long, ["i"], "v", {"q1": 0.25, "q3": 0.75})
        exprs = {}
        for row in q.collect():  # one row per cleaned column
            c = self.columns[row["i"]]
            spread = self.iqr_k * (row["q3"] - row["q1"])
            lo, hi = row["q1"] - spread, row["q3"] + spread
            exprs[c] = f"CASE WHEN {quote(c)} IS NOT NULL AND NOT {valid[c]} THEN greatest(least({quote(c)}, {hi!r}D), {lo!r}D) END"
        program.columns(**exprs)
        program.attempts.append({"operator": "sem_clean", "hint": self.hint, "columns": self.columns})
        return program

    def _fit_text(self, df: DataFrame) -> FeatureProgram:
        program = FeatureProgram("sem_clean")
        for c in self.columns:
            q = quote(c)
            spelled = df.where(F.col(c).isNotNull()).groupBy(F.expr(sqltext.squeezed(q)).alias("v")).agg(
                F.count(F.lit(1)).alias("n")
            )
            best = spelled.groupBy(F.lower("v").alias("k")).agg(
                F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))["v"].alias("canonical")
            )
            program.lookup(f"spelling_{c}", stage(best), [(sqltext.folded(q), "k")], {"canonical": "_canonical"})
            program.columns(**{c: f"coalesce(_canonical, {sqltext.squeezed(q)})"})
            program.drop("_canonical")
        program.attempts.append({"operator": "sem_clean", "hint": self.hint, "columns": self.columns})
        return program
