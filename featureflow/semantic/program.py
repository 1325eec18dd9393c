"""Feature programs: what a fitted operator learned, as Spark SQL expressions and lookup tables.

A program holds no closures. Its transform adds expressions and left joins to a plan, so
Catalyst optimises it and it runs on streaming frames as well.

Steps (plain dicts, stored as JSON):
  columns  {exprs: {name: sql}}                       computed from the incoming frame
  lookup   {table, on: [[sql, column]], cols: {column: name}}   left join with a learned table
  child    {left_on, right_on, numeric, categorical, stats, zero}   aggregate a bound child table
  drop     {cols}
  keep     {cols, missing_ok}
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class FeatureProgram:
    operator: str
    steps: list[dict] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    attempts: list[dict] = field(default_factory=list)

    # -- building ------------------------------------------------------------------

    def columns(self, **exprs: str) -> FeatureProgram:
        if exprs:
            self.steps.append({"op": "columns", "exprs": dict(exprs)})
        return self

    def lookup(self, table: str, frame: DataFrame, on: list[tuple[str, str]], cols: dict[str, str]) -> FeatureProgram:
        self.tables[table] = frame
        self.steps.append({"op": "lookup", "table": table, "on": [list(p) for p in on], "cols": dict(cols)})
        return self

    def drop(self, *cols: str) -> FeatureProgram:
        if cols:
            self.steps.append({"op": "drop", "cols": list(cols)})
        return self

    # -- replay --------------------------------------------------------------------

    def transform(self, df: DataFrame, **bound: DataFrame) -> DataFrame:
        for step in self.steps:
            df = getattr(self, f"_{step['op']}")(df, step, bound)
        return df

    def _columns(self, df, step, bound):
        return df.withColumns({n: F.expr(e) for n, e in step["exprs"].items()})

    def _lookup(self, df, step, bound):
        t = self.tables[step["table"]]
        keys = {c: f"_lk{i}" for i, (_, c) in enumerate(step["on"])}
        side = t.select(
            *[F.col(c).alias(k) for c, k in keys.items()], *[F.col(c).alias(n) for c, n in step["cols"].items()]
        )
        left = df.drop(*step["cols"].values()).withColumns(
            {f"_le{i}": F.expr(e) for i, (e, _) in enumerate(step["on"])}
        )
        cond = None
        for i in range(len(step["on"])):
            e = F.col(f"_le{i}") == F.col(f"_lk{i}")
            cond = e if cond is None else cond & e
        hidden = [x for i in range(len(step["on"])) for x in (f"_le{i}", f"_lk{i}")]
        return left.join(side, cond, "left").drop(*hidden)

    def _child(self, df, step, bound):
        from featureflow.operators.aggs import agg_features

        child = bound[step["table"]]
        key = step["right_on"]
        agg = agg_features(
            child, key, step["numeric"], step["categorical"], tuple(step["stats"]), step.get("nunique", False), step.get("cells", False)
        )
        names = {c: f"{step['prefix']}{c}" for c in agg.columns if c != key}
        side = agg.select(F.col(key).alias("_ck"), *[F.col(c).alias(n) for c, n in names.items()])
        out = df.join(side, F.col(step["left_on"]) == F.col("_ck"), "left").drop("_ck")
        zero = [n for n in names.values() if n.endswith(("_count", "_nunique"))]
        return out.withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in zero}) if zero else out

    def _drop(self, df, step, bound):
        return df.drop(*step["cols"])

    def _keep(self, df, step, bound):
        return df.select(*[c for c in df.columns if c in set(step["cols"])])

    # -- storing -------------------------------------------------------------------

    def to_json(self) -> str:
        return json.dumps(
            {"operator": self.operator, "steps": self.steps, "tables": sorted(self.tables), "attempts": self.attempts}
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Program text and lookup tables under `path`, readable by every executor."""
        spark.createDataFrame([(self.to_json(),)], "value string").write.mode("overwrite").text(f"{path}/program")
        for name, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/tables/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureProgram:
        d = json.loads(spark.read.text(f"{path}/program").first()[0])
        tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in d["tables"]}
        return FeatureProgram(d["operator"], d["steps"], tables, d["attempts"])


def chain(*programs: FeatureProgram) -> FeatureProgram:
    """Several programs as one; lookup tables keep apart by position."""
    out = FeatureProgram("chain")
    for i, p in enumerate(programs):
        for step in p.steps:
            step = dict(step)
            if step.get("table") in p.tables:  # tables bound by the caller keep their names
                step["table"] = f"p{i}_{step['table']}"
            out.steps.append(step)
        out.tables.update({f"p{i}_{n}": t for n, t in p.tables.items()})
        out.attempts += p.attempts
    return out


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Operator:
    """A fit/transform operator: `fit` learns a program, `fit_transform` also applies it."""

    def fit(self, df: DataFrame, **tables: DataFrame) -> FeatureProgram:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame, **tables: DataFrame) -> DataFrame:
        return self.fit(df, **tables).transform(df, **tables)
