"""House prices: star join, cleaning, ratios, generated features, regression, city analysis."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.functions.numbers import log1p, ratio
from featureflow.models.estimators import regressor
from featureflow.models.learner import Context
from featureflow.operators.aggs import segment_profile
from featureflow.operators.columns import assign, drop_columns, mark
from featureflow.operators.joins import merge, star_join
from featureflow.operators.windows import rank_desc
from featureflow.semantic.clean import SemClean
from featureflow.semantic.extract import SemExtract
from featureflow.semantic.generate import SemGenFeatures

VISUAL_TERMS = {"size_words": ["small", "large", "medium"], "shine_words": ["bright", "shiny", "polished"]}
GEN_HINT = "Generate features for price prediction from location and property characteristics; guard ratio denominators."


def join_houses(inputs: Mapping[str, DataFrame]) -> DataFrame:
    return star_join(inputs["facts"], [(inputs["cities"], "city_id"), (inputs["images"], "image_id")])


def cleaned_houses(houses: DataFrame, ctx: Context) -> DataFrame:
    """Capped sqft, its logarithm and the two room ratios."""
    cleaned = ctx.step("clean_sqft", SemClean(["sqft"], invalid="<= 0", hint="IQR capping of sqft"), houses)
    return assign(
        cleaned,
        sqft_log=log1p("sqft"),
        bed_bath_ratio=ratio("bed", "bath"),
        sqft_per_bed=ratio("sqft", "bed"),
    )


def features(inputs: Mapping[str, DataFrame], ctx: Context, gen: SemGenFeatures | None = None) -> DataFrame:
    houses = mark(join_houses(inputs), y="price", description="selling price")
    data = cleaned_houses(houses, ctx)
    data = ctx.pin(ctx.step("extract_visuals", SemExtract(["image_path"], dictionaries=VISUAL_TERMS), data))
    gen = gen or SemGenFeatures(how_many=5, y="price", hint=GEN_HINT, exclude=["house_id", "city_id", "image_id", "image_path"])
    return ctx.step("generated_features", gen, data)


def build(inputs: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """Pipeline for a Learner: features, vector, regression. Prediction column `prediction`."""
    data = features(inputs, ctx)
    vec = ctx.vectorize("vector", data, exclude=["house_id", "image_id", "image_path", "price"])
    vec = drop_columns(vec, ["image_path"])
    return ctx.model("price_model", regressor("price", iterations=5), vec)


def city_analysis(houses: DataFrame, cities_rows: int | None = None) -> DataFrame:
    """Profile per city with the rank of its mean price.

    `houses` needs city_name, price, sqft, bed, bath, predicted_price (joined by row key).
    """
    priced = houses.withColumn("price_per_sqft", ratio("price", "sqft", plus=0))
    profile = segment_profile(
        priced,
        "city_name",
        "num_houses",
        {
            "avg_price": ("price", 0), "avg_sqft": ("sqft", 0), "avg_price_per_sqft": ("price_per_sqft", 0),
            "avg_bed": ("bed", 1), "avg_bath": ("bath", 1), "avg_predicted_price": ("predicted_price", 0),
        },
        {"median_price": ("price", 0)},
    )
    return rank_desc(profile, "avg_price", "price_rank", rows=cities_rows).orderBy(
        F.col("avg_price").desc(), "city_name"
    )


def with_predictions(houses: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions joined by row key."""
    p = predictions.select("house_id", F.col("prediction").alias("predicted_price"))
    return merge(houses, p, on="house_id")
