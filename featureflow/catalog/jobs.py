"""Checked queries for whole jobs, models, learners and searches (E1-E8, M6-M12, Q14, Q15, G2, G6, ST5)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featureflow import session
from featureflow.catalog.history import finish
from featureflow.catalog.registry import query
from featureflow.catalog.relational import duck_fraction, duck_hash, fresh, r
from featureflow.catalog.scalars import date_sql
from featureflow.catalog.semantics import FILL_SQL, MODES, fixed_candidates, list_sql, words_sql
from featureflow.models import estimators as M
from featureflow.models.learner import Context, Learner
from featureflow.operators import sampling as L
from featureflow.operators.aggs import metrics
from featureflow.plans import artworks, fraud, houses
from featureflow.plans.scenario import oracle_with, table, view
from featureflow.search.optimise import mutations, optimise
from featureflow.semantic.aggregate import SemAggFeatures
from featureflow.semantic.choose import choices, fit_with_choices
from featureflow.semantic.fillna import SemFillNA
from featureflow.semantic.generate import SemGenFeatures, propose
from featureflow.session import plan_bytes, stage
from featureflow.sources.tables import Inputs


def house_inputs(spark, sf) -> Inputs:
    return Inputs(**{n: view(spark, sf, n) for n in ("facts", "cities", "images")})


def basket_inputs(spark, sf, planted: bool = False, staged: bool = True) -> Inputs:
    baskets, products = view(spark, sf, "baskets"), view(spark, sf, "products")
    return Inputs(baskets=fraud.planted(baskets, products, staged) if planted else baskets, products=products)


def halves(inputs: Inputs, name: str, key: str) -> tuple[Inputs, Inputs]:
    train, test = L.split(inputs[name], 0.25, key, 42)
    return inputs.rebind(**{name: train}), inputs.rebind(**{name: test})


def report(pred, label: str, kind: str = "classification"):
    """Metrics of the predictions with their row count (one row)."""
    p = stage(pred.select(F.col(label).cast("double").alias("y"), F.col("prediction").cast("double").alias("p")))
    return metrics(p, "y", "p", kind=kind).withColumn("rows", F.lit(p.count()))


CITY_SQL = """, houses AS (SELECT *, 0.9 * price + 2 * sqft AS predicted_price FROM facts JOIN cities USING (city_id)),
 s AS (SELECT *, price / nullif(sqft, 0) AS price_per_sqft FROM houses), c AS (SELECT city_name, count(*) AS num_houses,
 round(avg(price), 0) AS avg_price, round(median(price), 0) AS median_price, round(avg(sqft), 0) AS avg_sqft,
 round(avg(price_per_sqft), 0) AS avg_price_per_sqft, round(avg(bed), 1) AS avg_bed, round(avg(bath), 1) AS avg_bath,
 round(avg(predicted_price), 0) AS avg_predicted_price FROM s GROUP BY city_name)
 SELECT *, rank() OVER (ORDER BY avg_price DESC) AS price_rank FROM c ORDER BY avg_price DESC, city_name"""


@query("e5_city_analysis", oracle_with("facts", "cities") + CITY_SQL)
def e5(spark, sf):
    facts = view(spark, sf, "facts")
    cities = view(spark, sf, "cities")
    pred = facts.select("house_id", (F.lit(0.9) * F.col("price") + 2 * F.col("sqft")).alias("prediction"))
    joined = houses.merge(houses.with_predictions(facts, pred), cities, on="city_id")
    return houses.city_analysis(joined, cities.count())


@query(
    "e4_house_features",
    oracle_with("facts", "cities", "images")
    + ", h AS (SELECT * FROM facts JOIN cities USING (city_id) JOIN images USING (image_id)), q AS (SELECT quantile_cont(sqft, 0.25) AS a,"
    " quantile_cont(sqft, 0.75) AS b FROM h WHERE sqft > 0), c AS (SELECT h.* EXCLUDE (sqft), CASE WHEN sqft > 0 THEN"
    " greatest(least(sqft, b + 1.5 * (b - a)), a - 1.5 * (b - a)) END AS sqft, " + words_sql("image_path") + " AS w FROM h, q)"
    " SELECT house_id, city_name, price, round(sqft, 4) AS sqft, round(ln(1 + sqft), 6) AS sqft_log, round(bed / (bath + 1.0), 6) AS"
    " bed_bath_ratio, round(sqft / (bed + 1.0), 6) AS sqft_per_bed, "
    + ", ".join(
        f"len(list_intersect(w, {list_sql(t)})) > 0 AS is_{n}, len(list_intersect(w, {list_sql(t)})) AS {n}_count"
        for n, t in houses.VISUAL_TERMS.items()
    ) + " FROM c",
)
def e4f(spark, sf):
    gen = SemGenFeatures(how_many=0, keep_all=True, proposer=lambda profile, hint: [])
    out = houses.features(house_inputs(spark, sf), Context("fit"), gen)
    kept = [f"{p}{n}{s}" for n in houses.VISUAL_TERMS for p, s in (("is_", ""), ("", "_count"))]
    return out.select(
        "house_id", "city_name", "price", r("sqft").alias("sqft"),
        *[r(c, 6).alias(c) for c in ("sqft_log", "bed_bath_ratio", "sqft_per_bed")], *kept,
    )


@query("e4_house_prices")
def e4(spark, sf):
    """Fit on three quarters of the houses, predict the rest, analyse the cities."""
    train, test = halves(house_inputs(spark, sf), "facts", "house_id")
    pred = Learner(houses.build).fit(train).predict(test)
    joined = houses.with_predictions(houses.join_houses(test), pred)
    return houses.city_analysis(joined, test["cities"].count())


@query(
    "e3_price_analysis",
    oracle_with("products") + FILL_SQL + " SELECT make, round(avg(cash_price), 4) AS price_mean, round(stddev_samp(cash_price), 4) AS"
    " price_std, count(*) AS n FROM filled GROUP BY make",
)
def e3a(spark, sf):
    filled = SemFillNA("make", **fraud.FILL).fit_transform(view(spark, sf, "products"))
    out = fraud.price_analysis(filled).join(filled.groupBy("make").agg(F.count(F.lit(1)).alias("n")), "make")
    return out.select("make", r("price_mean").alias("price_mean"), r("price_std").alias("price_std"), "n")


E3_WORDS = words_sql("make")


@query(
    "e3_product_features",
    oracle_with("products") + FILL_SQL + " SELECT basket_ID, line, cash_price, make, make_source, lower(make) AS normalized_name,"
    " len(t) AS word_count, false AS has_stopwords, round(list_sum(list_transform(t, lambda x: length(x))) / len(t), 6) AS avg_word_length,"
    f" len(list_intersect(w, ['1', '2', '3'])) > 0 AS is_luxury_brand, len(list_intersect(w, ['brand'])) AS known_brand_count FROM"
    f" (SELECT *, {E3_WORDS} AS w, regexp_extract_all(lower(make), '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]') AS t FROM filled)",
)
def e3f(spark, sf):
    out = fraud.product_features(basket_inputs(spark, sf), Context("fit"))
    return out.select(
        "basket_ID", "line", "cash_price", "make", "make_source", "normalized_name", "word_count", "has_stopwords",
        r("avg_word_length", 6).alias("avg_word_length"), "is_luxury_brand", "known_brand_count",
    )


@query(
    "e3_basket_features",
    oracle_with("baskets", "products") + FILL_SQL + " SELECT ID, round(avg(cash_price), 6) AS cash_price_mean,"
    " round(sum(cash_price), 6) AS cash_price_sum, count(cash_price) AS cash_price_count, round(stddev_samp(cash_price), 4) AS"
    " cash_price_std, count(DISTINCT make) AS make_nunique FROM baskets LEFT JOIN filled ON ID = basket_ID GROUP BY ID",
)
def e3b(spark, sf):
    gen = SemGenFeatures(how_many=3, proposer=fixed_candidates, keep_all=True, exclude=["basket_ID", "line"])
    out = fraud.basket_features(basket_inputs(spark, sf), Context("fit"), gen)
    return out.select(
        "ID", r("cash_price_mean", 6).alias("cash_price_mean"), r("cash_price_sum", 6).alias("cash_price_sum"), "cash_price_count",
        r("cash_price_std").alias("cash_price_std"), "make_nunique",
    )


def _fraud_job(build):
    def run(spark, sf):
        train, test = halves(basket_inputs(spark, sf, planted=True), "baskets", "ID")
        return report(Learner(build).fit(train).predict(test), fraud.FLAG)

    return run


query("e1_fraud_simple")(_fraud_job(fraud.simple))
query("e2_fraud_medium")(_fraud_job(fraud.medium))
query("e3_fraud_full")(_fraud_job(fraud.full))


@query(
    "e6_artworks_refined",
    date_sql("ordinal").replace(" SELECT object_ID,", " SELECT culture, CASE WHEN object_name IN ('Vase', 'vase ') THEN 'Vase' ELSE"
                                " 'Painted Vase' END AS object_name, object_ID,").replace(
        "SELECT object_ID, trim(regexp_replace(", "SELECT culture, object_name, object_ID, trim(regexp_replace(")
    .replace("CASE WHEN a2 IS NOT NULL THEN CASE", "coalesce(CASE WHEN a2 IS NOT NULL THEN CASE").replace(" ELSE y1 END AS year_start", " ELSE y1 END, 0) AS year_start")
    .replace("THEN d1 + 9 END AS year_end", "THEN d1 + 9 END, 0) AS year_end")
    .replace("CASE WHEN a2 IS NOT NULL THEN ab", "coalesce(CASE WHEN a2 IS NOT NULL THEN ab").replace("THEN yb END AS start_is_bce", "THEN yb END, false) AS start_is_bce")
    .replace("CASE WHEN a2 IS NOT NULL THEN bb", "coalesce(CASE WHEN a2 IS NOT NULL THEN bb").replace("THEN false END AS end_is_bce", "THEN false END, false) AS end_is_bce"),
)
def e6r(spark, sf):
    out = artworks.refined(
        Inputs(artworks=view(spark, sf, "artworks")), Context("fit"),
        SemGenFeatures(how_many=0, keep_all=True, proposer=lambda profile, hint: []),
    )
    return out.select("culture", "object_name", "object_ID", "year_start", "start_is_bce", "year_end", "end_is_bce")


@query("e6_artworks_culture")
def e6(spark, sf):
    train, test = halves(Inputs(artworks=view(spark, sf, "artworks")), "artworks", "object_ID")
    return report(Learner(artworks.build).fit(train).predict(test), "label")


@query(
    "e7_two_class_features",
    oracle_with("baskets", "products") + ", s AS (SELECT ID FROM (SELECT *, row_number() OVER (PARTITION BY fraud_flag ORDER BY ID) AS n"
    " FROM baskets) WHERE n <= CASE fraud_flag WHEN 0 THEN 4000 ELSE 1000 END) SELECT ID, ['A','B','C'][1 + "
    + duck_hash("ID", 8) + " % 3] AS random_col2, round(sum(cash_price), 6) AS cash_price_sum, count(cash_price) AS cash_price_count,"
    " any_value(make_mode) AS make_mode, round(avg(cash_price / (qty + 1)), 6) AS price_per_qty_mean FROM s LEFT JOIN products ON"
    f" ID = products.basket_ID LEFT JOIN {MODES.format(c='make')} a ON a.basket_ID = ID GROUP BY ID",
)
def e7(spark, sf):
    inputs = basket_inputs(spark, sf)
    inputs = inputs.rebind(baskets=fraud.two_class_sample(inputs["baskets"]))
    none = SemGenFeatures(how_many=0, proposer=lambda profile, hint: [], keep_all=True)
    three = SemGenFeatures(how_many=3, proposer=fixed_candidates, keep_all=True)
    out = fraud.search_features(inputs, Context("fit"), none, three)
    return out.select(
        "ID", "random_col2", r("cash_price_sum", 6).alias("cash_price_sum"), "cash_price_count", "make_mode",
        r("price_per_qty_mean", 6).alias("price_per_qty_mean"),
    )


def _house_search(spark, sf, policy: str, trials: int = 3):
    inputs = house_inputs(spark, sf)
    train, test = halves(inputs, "facts", "house_id")
    gen = SemGenFeatures(how_many=3, y="price", exclude=["house_id", "image_id", "image_path"])

    def build(tables, ctx):
        data = houses.cleaned_houses(ctx.pin(houses.join_houses(tables)), ctx)
        data = ctx.step("generated", gen, data)
        nums = [c for c, t in data.dtypes if t in ("double", "bigint", "int") and c not in ("price", "house_id", "image_id")]
        data = data.fillna(0, subset=nums)
        vec = VectorAssembler(inputCols=nums, outputCol="features").transform(data)
        return ctx.model("price_model", M.regressor("price", kind="linear"), vec)

    nums = ["sqft", "bed", "bath"]
    pool = mutations(propose({"numeric": nums, "string": ["city_name"], "timestamp": []}, "difference ratio"), 3)

    def make_state(parent, t):
        """A generator over the trial's candidates; what it keeps is learned inside each fold."""
        chosen = pool(parent, t)
        own = SemGenFeatures(how_many=3, y="price", exclude=["house_id", "image_id", "image_path"], proposer=lambda profile, hint: chosen)
        return own, chosen

    search = optimise(
        build, "generated", train, "facts", "house_id", "price", make_state, trials, "r2", cv=2, policy=policy,
    )
    return search, train, test


@query("e8_g2_search")
def e8(spark, sf):
    """Three trials over the generated features, then the best state refitted and scored on held-out rows."""
    search, train, test = _house_search(spark, sf, "tree")
    best = search.best_learner(spark).fit(train).predict(test)
    score = M.score(best, "price", "r2")
    return search.trials(spark).select("trial", "parent_trial", "operator", "score").withColumn("held_out", F.lit(score))


# --- models ----------------------------------------------------------------------------------


def planted_vectors(spark, sf):
    """Three numbers per basket as a vector, and the planted flag.

    A model reads them dozens of times, and each time Spark would send the keys of `part` to the driver and to all
    executors, twice. If what is read of `lineitem` is beyond BROADCAST_BYTES, they are written once, without a broadcast.
    """
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
    large = plan_bytes(lines) > session.BROADCAST_BYTES
    if large:
        products = stage(view(spark, sf, "products", {"part": "merge"}).select("basket_ID", "cash_price", "qty"))
        inputs = Inputs(baskets=fraud.planted(view(spark, sf, "baskets"), products, staged=True), products=products)
    else:
        inputs = basket_inputs(spark, sf, planted=True, staged=False)  # forests draw by the order of the rows, which staging changes
    agg = inputs["products"].groupBy("basket_ID").agg(
        F.sum("cash_price").alias("total"), F.count(F.lit(1)).alias("n"), F.avg("qty").alias("qty")
    )
    data = inputs["baskets"].join(agg.hint("merge") if large else agg, F.col("ID") == F.col("basket_ID")).drop("basket_ID")
    out = VectorAssembler(inputCols=["total", "n", "qty"], outputCol="features").transform(data)
    return stage(out) if large else out


@query("m6_boosted_classifier")
def m6(spark, sf):
    data = planted_vectors(spark, sf)
    train, test = L.split(data, 0.25, "ID", 42)
    return report(M.boosted_classifier(fraud.FLAG, iterations=5).fit(train).transform(test), fraud.FLAG)


@query("m8_regressor")
def m8(spark, sf):
    data = planted_vectors(spark, sf)
    train, test = L.split(data, 0.25, "ID", 42)
    return report(M.regressor("total", iterations=5).fit(train).transform(test), "total", "regression")


@query(
    "m6_m8_better_than_constant",
    oracle_with("baskets", "products") + ", t AS (SELECT count(*) AS n FROM baskets WHERE EXISTS (SELECT 1 FROM products WHERE basket_ID = ID)"
    f" AND {duck_fraction('ID', 42)} < 0.25) SELECT m AS model, n AS rows, true AS better FROM t, (VALUES ('boosted'), ('regression')) v(m)",
)
def m6m8(spark, sf):
    """Held-out rows of two models, and whether they beat the majority class and the mean."""
    train, test = L.split(stage(planted_vectors(spark, sf)), 0.25, "ID", 42)
    flags = report(M.boosted_classifier(fraud.FLAG, iterations=5).fit(train).transform(test), fraud.FLAG)
    share = test.agg(F.greatest(F.avg(fraud.FLAG), 1 - F.avg(fraud.FLAG)).alias("share"))
    first = flags.select(F.lit("boosted").alias("model"), "rows", (F.col("accuracy") > F.lit(share.first()["share"])).alias("better"))
    total = report(M.regressor("total", iterations=5).fit(train).transform(test), "total", "regression")
    return first.unionByName(total.select(F.lit("regression").alias("model"), "rows", (F.col("r2") > 0).alias("better")))


@query(
    "e6_predicts_every_artwork",
    f"SELECT count(*) AS rows, count(lang) AS known, true AS better FROM documents WHERE {duck_fraction('doc_id', 42)} < 0.25",
)
def e6n(spark, sf):
    """Every seventh culture is missing: those rows are predicted too, and not learned from."""
    art = view(spark, sf, "artworks")
    inputs = Inputs(artworks=art.withColumn("culture", F.when(F.col("object_ID") % 7 != 0, F.col("culture"))))
    train, test = halves(inputs, "artworks", "object_ID")
    out = stage(Learner(artworks.build).fit(train).predict(test).select("object_ID", "predicted_culture"))
    true = art.select("object_ID", F.col("culture").alias("truth"))
    most = art.groupBy("culture").count().agg(F.max("count") / F.sum("count")).first()[0]
    joined = out.join(true, "object_ID")
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count("predicted_culture").alias("known"),
        (F.avg((F.col("predicted_culture") == F.col("truth")).cast("double")) >= F.lit(most) - 0.05).alias("better"),
    )


@query("m9_folds_in_range", "SELECT unnest([0, 1, 2]) AS fold, true AS in_range")
def m9f(spark, sf):
    data = stage(planted_vectors(spark, sf))
    out = M.cross_validate(M.multiclass_classifier(fraud.FLAG, kind="logistic"), data, fraud.FLAG, 3, "f1", key="ID")
    return out.select("fold", F.col("score").between(0.0, 1.0).alias("in_range"))


@query("m9_cross_validate")
def m9(spark, sf):
    data = stage(planted_vectors(spark, sf))
    return M.cross_validate(M.multiclass_classifier(fraud.FLAG, kind="logistic"), data, fraud.FLAG, 3, "f1", key="ID")


@query("q14_q15_fit_with_choices")
def q15(spark, sf):
    data = planted_vectors(spark, sf)
    grid = choices(max_depth="Try 2 and 4")
    model = fit_with_choices(M.multiclass_classifier(fraud.FLAG, trees=5), data, fraud.FLAG, grid, k=2, key="ID")
    rows = [(int(p), float(s)) for p, s in zip(grid["maxDepth"], model.avgMetrics)]
    scores = spark.createDataFrame(rows, "max_depth int, score double")
    n = model.transform(data).groupBy("prediction").agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("max_depth", F.lit(int(model.bestModel.getOrDefault("maxDepth")))).join(scores, "max_depth")


@query(
    "m10_m12_learner_state",
    oracle_with("baskets") + f" SELECT count(*) AS rows, 0 AS differing FROM baskets WHERE {duck_fraction('ID', 42)} < 0.25",
)
def m10(spark, sf):
    """A learner is saved, loaded and predicts the same for every held-out basket."""
    train, test = halves(basket_inputs(spark, sf, planted=True), "baskets", "ID")
    learner = Learner(fraud.simple).fit(train)
    path = fresh(spark, "learner")
    learner.save(spark, path)
    # each replay is written on its own, else one task sorts the rows of both
    again = stage(Learner.load(spark, path, fraud.simple).predict(test).select("ID", "prediction"))
    first = stage(learner.predict(test).select("ID", F.col("prediction").alias("p")))
    both = again.join(first, "ID")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("prediction") != F.col("p"), 1)).alias("differing"))


@query(
    "q10_strongest_feature",
    oracle_with("baskets", "products") + " SELECT ID, round(sum(cash_price), 4) AS cash_price_sum FROM baskets LEFT JOIN products ON ID = basket_ID"
    " GROUP BY ID",
)
def q10s(spark, sf):
    """Of all aggregates the one that decides the label is kept."""
    inputs = basket_inputs(spark, sf)
    value = inputs["products"].groupBy("basket_ID").agg((2 * F.sum("cash_price") + 1).alias("y"))
    ids = inputs["baskets"].select("ID").join(value, F.col("ID") == F.col("basket_ID"), "left").drop("basket_ID")
    op = SemAggFeatures("ID", "basket_ID", how_many=1, y="y", exclude=["line"], nunique=False)
    return op.fit_transform(ids, child=inputs["products"]).drop("y").withColumn("cash_price_sum", r("cash_price_sum"))


@query(
    "st5_score_stream",
    oracle_with("products") + FILL_SQL + " SELECT basket_ID, line, make, make_source FROM filled",
)
def st5(spark, sf):
    """A program learned on the table replays on a stream of the same rows."""
    from featureflow.streaming.events import write_append

    p = view(spark, sf, "products")
    learner = Learner(lambda t, ctx: ctx.step("fill", SemFillNA("make", ["item", "model"], hint="item model"), t["products"]))
    learner.fit(Inputs(products=p))
    src, out = fresh(spark, "products"), fresh(spark, "scored")
    p.write.parquet(src)
    stream = spark.readStream.schema(p.schema).parquet(src)
    scored = learner.transform_stream(Inputs(products=stream)).select("basket_ID", "line", "make", "make_source")
    finish(write_append(scored, out, fresh(spark, "cp")))
    return spark.read.parquet(out)
