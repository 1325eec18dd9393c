"""sem_select (Q12): keep the columns that bear on the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.search.score import candidate_quality, score_candidates
from featureflow.semantic.program import FeatureProgram, Operator, quote


def column_report(df: DataFrame, y: str, keep: list[str] | None = None) -> DataFrame:
    """(column, null_ratio, constant, score) for every column but the label and `keep`."""
    cols = {c: quote(c) for c in df.columns if c not in {y, *(keep or [])}}
    quality = candidate_quality(df, cols)
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    scores = score_candidates(df, cols, y).select("candidate", "score")
    return quality.join(scores, "candidate", "left").select(
        F.col("candidate").alias("column"), F.try_divide(F.col("nulls"), F.lit(total)).alias("null_ratio"),
        "constant", "score",
    )


class SemSelect(Operator):
    """Drop columns with too many nulls or no spread, then keep the k strongest.

    Strength is |correlation| for numbers and the correlation ratio for text.
    """

    def __init__(self, y: str, k: int | None = None, max_null: float = 0.5, min_score: float = 0.0,
                 keep: list[str] | None = None, hint: str = ""):
        self.y, self.k, self.max_null, self.min_score = y, k, max_null, min_score
        self.keep, self.hint = list(keep or []), hint

    def fit(self, df: DataFrame, **tables) -> FeatureProgram:
        report = column_report(df, self.y, self.keep).collect()  # one row per column
        ok = [r for r in report if r["null_ratio"] <= self.max_null and not r["constant"]
              and (r["score"] or 0.0) >= self.min_score]
        ok.sort(key=lambda r: (-(r["score"] or 0.0), r["column"]))
        chosen = {r["column"] for r in (ok[: self.k] if self.k is not None else ok)}
        kept = [c for c in df.columns if c in chosen or c in self.keep or c == self.y]
        program = FeatureProgram("sem_select", [{"op": "keep", "cols": kept}])
        program.attempts.append(
            {"operator": "sem_select", "hint": self.hint, "scores": {r["column"]: r["score"] for r in report}}
        )
        return program
