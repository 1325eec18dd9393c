"""Feature preparation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    Imputer,
    OneHotEncoder,
    RegexTokenizer,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.operators.columns import cols_of
from featureflow.operators.windows import global_position
from featureflow.session import broadcast_if_small, has_at_most, remove_path, stage, staged_path

#: Text columns with at most this many distinct values are one-hot encoded, others hashed.
CARDINALITY = 40

#: Numbers in the vectors that one task of a fit reads: 32 MB as doubles, about twice that with what trees keep beside them.
TASK_NUMBERS = 4 << 20


class TableVectorizer:
    """Any table → `features` vector.

    Distinct counts decide (approximate ones, exact near the threshold): numbers pass (mean-filled), few-valued
    text becomes one-hot with a slot for unseen values, other text becomes hashed words with
    idf weights, timestamps become parts, booleans 0/1. The result is a PipelineModel.
    """

    def __init__(self, exclude: list[str] | None = None, cardinality: int = CARDINALITY, hashed: int = 64,
                 output: str = "features"):
        self.exclude, self.cardinality, self.hashed, self.output = list(exclude or []), cardinality, hashed, output

    def plan(self, df: DataFrame) -> dict[str, list[str]]:
        kinds = {k: [c for c in cols_of(df, k) if c not in self.exclude] for k in ("numeric", "boolean", "timestamp", "string")}
        numeric = kinds["numeric"]
        counts = df.agg(
            F.lit(1),
            *[F.approx_count_distinct(c).alias(f"t{i}") for i, c in enumerate(kinds["string"])],
            *[F.count(F.col(c).cast("double")).alias(f"n{i}") for i, c in enumerate(numeric)],
        ).first()
        distinct = {c: counts[f"t{i}"] for i, c in enumerate(kinds["string"])}
        near = [c for c, n in distinct.items() if self.cardinality / 2 < n < self.cardinality * 2]
        if near:  # the sketch may be off by some per cent: count those exactly, in one job
            exact = df.agg(*[F.countDistinct(c).alias(f"t{i}") for i, c in enumerate(near)]).first()
            distinct.update({c: exact[f"t{i}"] for i, c in enumerate(near)})
        low = [c for c, n in distinct.items() if 0 < n <= self.cardinality]
        high = [c for c, n in distinct.items() if n > self.cardinality]
        return {**kinds, "numeric": [c for i, c in enumerate(numeric) if counts[f"n{i}"]], "low": low, "high": high}

    def stages(self, df: DataFrame) -> list:
        p = self.plan(df)
        parts = [f"CAST(`{c}` AS DOUBLE) AS `_n_{c}`" for c in p["numeric"]]
        parts += [f"CAST(coalesce(`{c}`, false) AS DOUBLE) AS `_b_{c}`" for c in p["boolean"]]
        parts += [
            f"coalesce(CAST({part}(`{c}`) AS DOUBLE), -1D) AS `_t_{c}_{part}`"
            for c in p["timestamp"] for part in ("year", "month", "dayofweek", "hour")
        ]
        parts += [f"coalesce(nullif(trim(`{c}`), ''), '(none)') AS `_s_{c}`" for c in p["low"] + p["high"]]
        stages: list = [SQLTransformer(statement=f"SELECT *{''.join(', ' + x for x in parts)} FROM __THIS__")]
        inputs = [f"_b_{c}" for c in p["boolean"]]
        inputs += [f"_t_{c}_{part}" for c in p["timestamp"] for part in ("year", "month", "dayofweek", "hour")]
        if p["numeric"]:
            names = [f"_n_{c}" for c in p["numeric"]]
            stages.append(Imputer(strategy="mean", inputCols=names, outputCols=[f"{n}_f" for n in names]))
            inputs += [f"{n}_f" for n in names]
        if p["low"]:
            s = [f"_s_{c}" for c in p["low"]]
            stages.append(StringIndexer(inputCols=s, outputCols=[f"{x}_i" for x in s], handleInvalid="keep",
                                        stringOrderType="alphabetAsc"))
            stages.append(OneHotEncoder(inputCols=[f"{x}_i" for x in s], outputCols=[f"{x}_o" for x in s],
                                        dropLast=False, handleInvalid="keep"))
            inputs += [f"{x}_o" for x in s]
        hashed = []
        for c in p["high"]:
            s = f"_s_{c}"
            hashed.append(RegexTokenizer(inputCol=s, outputCol=f"{s}_w", pattern=r"[^\p{L}\p{N}]+"))
            hashed.append(HashingTF(inputCol=f"{s}_w", outputCol=f"{s}_h", numFeatures=self.hashed))
            stages.append(IDF(inputCol=f"{s}_h", outputCol=f"{s}_o"))
            inputs.append(f"{s}_o")
        stages[1:1] = hashed  # before all that is fitted
        stages.append(VectorAssembler(inputCols=inputs, outputCol=self.output, handleInvalid="keep"))
        return stages

    def fit(self, df: DataFrame) -> PipelineModel:
        return Pipeline(stages=self.stages(df)).fit(df)

    def fit_transform(self, df: DataFrame, write: Callable[[DataFrame], DataFrame]) -> tuple[PipelineModel, DataFrame]:
        """The model and what it makes of `df`. Hashed words are worked out once: `write` writes them and gives them back."""
        stages = self.stages(df)
        fitted = next(i for i, s in enumerate(stages) if isinstance(s, Estimator)) if any(isinstance(s, IDF) for s in stages) else 0
        if not fitted:
            model = Pipeline(stages=stages).fit(df)
            return model, model.transform(df)
        words = PipelineModel(stages[:fitted])
        hashed = words.transform(df)
        hashed = write(hashed.drop(*[s.getOutputCol() for s in stages[:fitted] if isinstance(s, RegexTokenizer)]))
        rest = Pipeline(stages=stages[fitted:]).fit(hashed)
        return PipelineModel(words.stages + rest.stages), rest.transform(hashed)


def without_scratch(df: DataFrame) -> DataFrame:
    """Drop the helper columns the vectorizer leaves behind."""
    return df.drop(*[c for c in df.columns if c.startswith(("_n_", "_b_", "_t_", "_s_"))])


def spread(df: DataFrame, features: str = "features", numbers: int = TASK_NUMBERS) -> DataFrame:
    """Written rows as a fit reads them: in pieces of about `numbers` numbers, kept on disk, if their files give fewer pieces.

    Files are cut by their size, and vectors are far smaller as files than as rows.
    """
    first = df.select(features).first() if features in df.columns else None
    if first is None or first[0] is None:
        return df
    pieces = -(-df.count() * first[0].size // numbers)
    return df.repartition(pieces).persist(StorageLevel.DISK_ONLY) if pieces > df.rdd.getNumPartitions() else df


def mean_impute(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls of numeric columns become the column mean of `fit_on`."""
    src = fit_on if fit_on is not None else df
    doubles = {c: F.col(c).cast("double") for c in cols}
    model = Imputer(strategy="mean", inputCols=cols, outputCols=cols).fit(src.withColumns(doubles))
    return model.transform(df.withColumns(doubles))


def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    src = fit_on if fit_on is not None else df
    s = src.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).first()
    out = {}
    for c in cols:
        m, sd = s[f"m_{c}"], s[f"s_{c}"]
        centred = F.col(c) - F.lit(m)
        out[c] = centred / F.lit(sd) if sd else F.when(F.col(c).isNotNull(), F.lit(0.0))
    return df.withColumns(out)


class LabelCodec:
    """Text classes ↔ indices; classes in alphabetical order, values that are unknown or missing come after the last.

    Up to `inline` classes are held by the model and written into expressions (`classes`). More are a
    staged table (class, index), numbered in ranges and joined both ways, and never come to the driver.
    """

    def __init__(self, col: str, index: str = "label", inline: int = 10_000):
        self.col, self.index, self.inline = col, index, inline

    def fit(self, df: DataFrame) -> LabelCodec:
        self.table = self.classes = None
        values = stage(df.select(F.col(self.col).cast("string").alias("_class")).where(F.col("_class").isNotNull()).distinct())
        if has_at_most(values, self.inline):
            few = values.withColumnRenamed("_class", self.col)
            self.model = StringIndexer(
                inputCol=self.col, outputCol=self.index, stringOrderType="alphabetAsc", handleInvalid="keep"
            ).fit(few)
            self.classes = list(self.model.labels)
        else:
            self.table = stage(global_position(values, ["_class"], "_index"))
            self.size = self.table.count()
        remove_path(df.sparkSession, staged_path(values))
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        if self.table is None:
            return self.model.transform(df)
        out = df.join(broadcast_if_small(self.table), F.col(self.col).cast("string") == F.col("_class"), "left")
        return out.withColumn(self.index, F.coalesce("_index", F.lit(self.size)).cast("double")).drop("_class", "_index")

    def decode(self, df: DataFrame, index: str, out: str) -> DataFrame:
        """The class of an index; NULL for the index of unknown or missing values."""
        if self.table is not None:
            named = self.table.withColumnRenamed("_class", out)
            return df.drop(out).join(broadcast_if_small(named), F.col(index).cast("long") == F.col("_index"), "left").drop("_index")
        if not self.classes:
            return df.withColumn(out, F.lit(None).cast("string"))
        return df.withColumn(out, F.get(F.array(*[F.lit(c) for c in self.classes]), F.col(index).cast("int")))


def drop_low_variance(df: DataFrame, threshold: float = 0.0, cols: list[str] | None = None) -> DataFrame:
    """Drop numeric columns whose population variance is at most the threshold. One pass."""
    cols = cols or cols_of(df, "numeric")
    v = df.agg(F.lit(1), *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    flat = [c for i, c in enumerate(cols) if v[f"v{i}"] is None or v[f"v{i}"] <= threshold]
    return df.drop(*flat)


def normality(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n, statistic, p_value): Jarque-Bera per numeric column, one pass.

    The statistic is chi-squared with two degrees of freedom, so p = exp(-statistic / 2).
    """
    cols = cols or cols_of(df, "numeric")
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.skewness(c).alias("s"), F.kurtosis(c).alias("k")
        ).alias(f"c{i}")
        for i, c in enumerate(cols)
    ]
    one = df.agg(*parts).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cols))])).alias("c"))
    stat = F.col("c.n") / 6.0 * (F.col("c.s") * F.col("c.s") + F.col("c.k") * F.col("c.k") / 4.0)
    return one.select(
        "c.column", "c.n", stat.alias("statistic"), F.exp(-stat / 2.0).alias("p_value")
    )
