"""Artwork culture: annotation, date intervals, features, filling, unification, classifier."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.functions.numbers import fill_by_type
from featureflow.models.estimators import multiclass_classifier
from featureflow.models.learner import Context
from featureflow.models.prep import LabelCodec
from featureflow.operators.columns import copy_column, drop_columns
from featureflow.semantic.extract import SemExtract, annotate
from featureflow.semantic.generate import SemGenFeatures
from featureflow.semantic.refine import SemRefine


def refined(inputs: Mapping[str, DataFrame], ctx: Context, gen: SemGenFeatures | None = None) -> DataFrame:
    """Everything up to unified object names; the label column stays in the frame."""
    art = copy_column(inputs["artworks"], "object_name", "object_name_raw")
    art = annotate(art, "description")
    art = ctx.step("extract_dates", SemExtract(["date"], recipe="date_interval"), art)
    art = ctx.pin(art)
    gen = gen or SemGenFeatures(
        how_many=5, hint="length words frequency of texts", keep_all=True,
        exclude=["object_ID", "culture", "object_name_raw", "description"],
    )
    art = ctx.step("additional_features", gen, art)
    filled = fill_by_type(art, [c for c in art.columns if c != "culture"])
    filled = ctx.pin(filled)
    unified = ctx.step("unify_names", SemRefine("object_name", existing_only=False), filled)
    return drop_columns(unified, ["object_name_raw"], errors="ignore")


def build(inputs: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """Pipeline for a Learner: `prediction` is the class index, `predicted_culture` its name."""
    data = refined(inputs, ctx)
    classes = ctx.value("classes", lambda: LabelCodec("culture").fit(data.select("culture")).classes)
    codec = StringIndexerModel.from_labels(classes, inputCol="culture", outputCol="label", handleInvalid="keep")
    data = codec.transform(data)
    vec = ctx.vectorize("vector", data, exclude=["object_ID", "culture", "label"])
    # rows without a culture are predicted, not learned from
    known = lambda df: multiclass_classifier("label", trees=15, depth=6).fit(df.where(F.col("culture").isNotNull()))
    out = ctx.model("culture_model", None, vec, fit=known)
    return out.withColumn("predicted_culture", F.get(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int")))
