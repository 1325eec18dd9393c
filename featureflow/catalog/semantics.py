"""Checked queries for semantic operators, candidate scores and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from featureflow.catalog.registry import query
from featureflow.catalog.relational import duck_fraction, duck_hash, fresh, r
from featureflow.catalog.scalars import date_sql
from featureflow.models import prep as P
from featureflow.operators import columns as C
from featureflow.operators import joins as J
from featureflow.operators import quantiles as QN
from featureflow.plans.scenario import oracle_with, table, view
from featureflow.search.score import score_candidates
from featureflow.semantic.aggregate import SemAggFeatures
from featureflow.semantic.augment import SemAugment
from featureflow.semantic.clean import SemClean
from featureflow.semantic.distill import SemDistill
from featureflow.semantic.extract import LEXICON, PERSON, PHRASE, SemExtract, annotate, extract_distinct
from featureflow.semantic.fillna import SemFillNA
from featureflow.semantic.generate import SemGenFeatures
from featureflow.semantic.program import FeatureProgram, chain
from featureflow.semantic.refine import SemRefine
from featureflow.semantic.select import SemSelect, column_report

FILL_SQL = """, k AS (SELECT * FROM products WHERE make IS NOT NULL),
 l2 AS (SELECT item, model, make FROM (SELECT item, model, make, row_number() OVER (PARTITION BY item, model
   ORDER BY count(*) DESC, make) AS n FROM k GROUP BY item, model, make) WHERE n = 1),
 l1 AS (SELECT item, make FROM (SELECT item, make, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, make) AS n
   FROM k GROUP BY item, make) WHERE n = 1),
 l0 AS (SELECT make FROM k GROUP BY make ORDER BY count(*) DESC, make LIMIT 1),
 filled AS (SELECT p.* EXCLUDE (make), coalesce(p.make, l2.make, l1.make, (SELECT make FROM l0)) AS make,
   CASE WHEN p.make IS NOT NULL THEN 'given' WHEN l2.make IS NOT NULL OR l1.make IS NOT NULL THEN 'group' ELSE 'overall' END
   AS make_source FROM products p LEFT JOIN l2 USING (item, model) LEFT JOIN l1 ON l1.item = p.item)"""


@query(
    "q1_fillna_group_mode",
    oracle_with("products") + FILL_SQL + " SELECT basket_ID, line, cash_price, make, make_source FROM filled",
)
def q1(spark, sf):
    p = view(spark, sf, "products")
    out = SemFillNA("make", ["item", "model"], hint="from the item and the model").fit_transform(p)
    return out.select("basket_ID", "line", "cash_price", "make", "make_source")


@query(
    "q1_fillna_dictionary",
    "WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END AS kind FROM part),"
    " o AS (SELECT kind FROM p WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 1)"
    " SELECT p_partkey, coalesce(p.kind, t.kind, (SELECT kind FROM o)) AS kind, CASE WHEN p.kind IS NOT NULL THEN 'given'"
    " WHEN t.kind IS NOT NULL THEN 'text' ELSE 'overall' END AS kind_source FROM p LEFT JOIN"
    " (SELECT DISTINCT kind FROM p WHERE kind IS NOT NULL) t ON t.kind = split_part(p_name, ' ', 2)",
)
def q1d(spark, sf):
    p = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_name", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END AS kind"
    )
    return SemFillNA("kind", text=["p_name"]).fit_transform(p).select("p_partkey", "kind", "kind_source")


@query(
    "q1_fillna_median",
    oracle_with("facts") + ", f AS (SELECT house_id, city_id, CASE WHEN bed = 0 THEN NULL ELSE price END AS price FROM facts)"
    " SELECT house_id, round(coalesce(price, m), 4) AS price FROM f LEFT JOIN"
    " (SELECT city_id, median(price) AS m FROM f GROUP BY 1) USING (city_id)",
)
def q1m(spark, sf):
    f = view(spark, sf, "facts").select("house_id", "city_id", F.when(F.col("bed") != 0, F.col("price")).alias("price"))
    out = SemFillNA("price", ["city_id"], existing_only=False).fit_transform(f)
    return out.select("house_id", r("price").alias("price"))


@query(
    "q2_clean_numeric",
    oracle_with("facts") + ", q AS (SELECT quantile_cont(sqft, 0.25) AS a, quantile_cont(sqft, 0.75) AS b FROM facts WHERE sqft > 0)"
    " SELECT house_id, CASE WHEN sqft > 0 THEN round(greatest(least(sqft, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 4) END AS sqft"
    " FROM facts, q",
)
def q2(spark, sf):
    out = SemClean(["sqft"], invalid="<= 0").fit_transform(view(spark, sf, "facts"))
    return out.select("house_id", r("sqft").alias("sqft"))


@query(
    "q2_exact_quantiles",
    "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 4) AS q05,"
    " round(median(l_extendedprice), 4) AS q50, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99 FROM lineitem GROUP BY 1, 2",
)
def q2b(spark, sf):
    out = QN.exact_quantiles(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
        {"q05": 0.05, "q50": 0.5, "q99": 0.99}, small_group=1000,
    )
    return out.select("l_returnflag", "l_linestatus", *[r(q).alias(q) for q in ("q05", "q50", "q99")])


NAMES = "CASE o_orderkey % 5 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN ' ' || lower(o_orderpriority) ELSE o_orderpriority END"


@query(
    "q3_clean_text",
    f"WITH v AS (SELECT o_orderkey, trim(regexp_replace({NAMES}, '\\s+', ' ', 'g')) AS s FROM orders),"
    " b AS (SELECT k, s FROM (SELECT lower(s) AS k, s, row_number() OVER (PARTITION BY lower(s) ORDER BY count(*) DESC, s) AS n"
    " FROM v GROUP BY s) WHERE n = 1) SELECT o_orderkey, b.s AS priority FROM v JOIN b ON b.k = lower(v.s)",
)
def q3(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{NAMES} AS priority")
    return SemClean(["priority"], kind="text").fit_transform(o)


@query(
    "q4_refine",
    oracle_with("artworks") + ", v AS (SELECT object_ID, object_name, array_to_string(list_sort(list_distinct("
    "regexp_extract_all(lower(object_name), '[\\p{L}\\p{N}]+'))), ' ') AS k FROM artworks), b AS (SELECT k, object_name AS best"
    " FROM (SELECT k, object_name, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, object_name) AS n FROM v GROUP BY k, object_name)"
    " WHERE n = 1) SELECT object_ID, trim(best) AS object_name FROM v JOIN b USING (k)",
)
def q4(spark, sf):
    art = view(spark, sf, "artworks").select("object_ID", "object_name")
    out = SemRefine("object_name", existing_only=True).fit_transform(art)
    return out.withColumn("object_name", F.trim("object_name"))


@query(
    "q4_refine_fuzzy",
    "SELECT l_orderkey, l_linenumber, l_shipmode AS mode FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN"
    " 'ground parcel' WHEN 'N' THEN 'airmail express' ELSE 'courier' END AS l_shipmode FROM lineitem)",
)
def q4f(spark, sf):
    base = F.when(F.col("l_returnflag") == "A", "ground parcel").when(F.col("l_returnflag") == "N", "airmail express")
    base = base.otherwise("courier")
    # one letter is lost in every seventh line
    typo = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.substring(base, 1, 4), F.substring(base, 6, 20))).otherwise(base)
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", typo.alias("mode"))
    return SemRefine("mode", existing_only=True, max_deletes=1).fit_transform(li)


#: Part names, about three of five with one or two edits.
MISSPELT = (
    "CASE p_partkey % 5 WHEN 0 THEN concat(substring(p_name, 1, 2), substring(p_name, 4)) WHEN 1 THEN concat(substring(p_name, 1, 3), 'zq', substring(p_name, 4))"
    " WHEN 2 THEN concat('x', substring(p_name, 2)) ELSE p_name END"
)


@query(
    "q4_refine_distance",
    f"WITH RECURSIVE p AS (SELECT p_partkey, {MISSPELT} AS name FROM part), k AS (SELECT p_partkey, name,"
    " array_to_string(list_sort(list_distinct(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'))), ' ') AS k FROM p),"
    " d AS (SELECT DISTINCT k FROM k), r AS (SELECT k, k AS g FROM d UNION SELECT r.k, d.k FROM r JOIN d ON levenshtein(r.g, d.k) <= 2),"
    " c AS (SELECT k, min(g) AS g FROM r GROUP BY 1), n AS (SELECT g, name, count(*) AS n FROM k JOIN c USING (k) GROUP BY ALL),"
    " b AS (SELECT g, name AS best FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, name) AS i FROM n) WHERE i = 1)"
    " SELECT p_partkey, best AS name FROM k JOIN c USING (k) JOIN b USING (g)",
)
def q4d(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{MISSPELT} AS name")
    return SemRefine("name", existing_only=True, max_distance=2).fit_transform(p)


@query("q5_extract_dates", date_sql("ordinal"))
def q5(spark, sf):
    meanings = {
        "year_start": "Start year", "start_is_bce": "Is starting year BCE?", "year_end": "End year",
        "end_is_bce": "Is end year BCE?",
    }
    art = view(spark, sf, "artworks").select("object_ID", "date")
    return SemExtract(["date"], meanings, "date_interval").fit_transform(art).drop("date")


WORDS = "regexp_extract_all(lower(translate({c}, '" + "{a}', '{p}')), '[\\p{{L}}\\p{{N}}]+')"


def words_sql(c: str) -> str:
    from featureflow.functions.text import ACCENTED, PLAIN

    return WORDS.format(c=c, a=ACCENTED, p=PLAIN)


def list_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


TERMS = {"metal": ["widget", "bolt", "gear"], "mood": ["cold", "small", "large", "red"]}


@query(
    "q6_extract_dictionary",
    "SELECT p_partkey, " + ", ".join(
        f"len(list_intersect(w, {list_sql(t)})) > 0 AS is_{n}, len(list_intersect(w, {list_sql(t)})) AS {n}_count,"
        f" array_to_string(list_sort(list_distinct(list_intersect(w, {list_sql(t)}))), ', ') AS {n}_terms" for n, t in TERMS.items()
    ) + f" FROM (SELECT p_partkey, {words_sql('p_name')} AS w FROM part)",
)
def q6(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    found = extract_distinct(p, "p_name", SemExtract(["p_name"], dictionaries=TERMS))
    return J.merge(p, found, on="p_name", how="left").drop("p_name")


@query("q7_extract_batch", "SELECT page_id, length(html) - length(replace(html, '<', '')) AS n_tags FROM pages")
def q7(spark, sf):
    def count_tags(frame):
        return frame.assign(n_tags=frame["html"].str.count("<"))[["page_id", "n_tags"]]

    op = SemExtract(["html"], batch_fn=count_tags, schema="page_id bigint, n_tags bigint")
    return op.fit_transform(table(spark, sf, "pages").select("page_id", "html"))


#: Terms of several words, with accents, one inside another, two spellings of the same words, and one without words.
PLACES = ["New York", "York", "café", "Cafe", "Café de la Paix", "são  paulo", "red widget", "--", "ring near the"]
PLACED = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' in New-York, near the Café!' WHEN 1 THEN ' of SÃO Paulo, de la Paix' WHEN 2 THEN ' CAFÉ de  la paix; new' ELSE ' near york' END"


def phrases_sql(terms: list[str], text: str, feature: str) -> str:
    """Flag, count and list of the terms whose plain words stand side by side in a text."""
    spelled = "(SELECT array_to_string(" + words_sql("t") + ", ' ') AS k, min(lower(t)) AS t FROM (SELECT unnest(" + list_sql(terms) + ") AS t) GROUP BY 1 HAVING k <> '')"
    return (
        f"WITH p AS (SELECT p_partkey, ' ' || array_to_string({words_sql(text)}, ' ') || ' ' AS w FROM part),"
        f" h AS (SELECT p_partkey, list_sort(list(t)) AS l FROM p JOIN {spelled} ON contains(w, ' ' || k || ' ') GROUP BY 1)"
        f" SELECT p_partkey, l IS NOT NULL AS is_{feature}, coalesce(len(l), 0) AS {feature}_count, coalesce(array_to_string(l, ', '), '') AS {feature}_terms"
        " FROM p LEFT JOIN h USING (p_partkey)"
    )


@query("q6_extract_phrases", phrases_sql(PLACES, PLACED, "place"))
def q6p(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{PLACED} AS text")
    return SemExtract(["text"], dictionaries={"place": PLACES}).fit_transform(p).drop("text")


#: Too many to be literals of an expression.
MANY_PLACES = [*PLACES, *(f"{a} {b} no {i}" for a in ("red", "old", "hot") for b in ("ring", "gear", "rod") for i in range(230))]
NUMBERED = f"{PLACED} || ' no ' || p_partkey % 300 || ' ' || p_name || ' no ' || p_size"


@query("q6_extract_many_phrases", phrases_sql(MANY_PLACES, NUMBERED, "place"))
def q6m(spark, sf):
    """A long list, stored and loaded, behind another program."""
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{NUMBERED} AS text")
    path = fresh(spark, "terms")
    chain(SemExtract(["text"], dictionaries={"color": ["red"]}).fit(p), SemExtract(["text"], dictionaries={"place": MANY_PLACES}).fit(p)).save(spark, path)
    return FeatureProgram.load(spark, path).transform(p).select("p_partkey", "is_place", "place_count", "place_terms")


@query("q8_annotate_phrases", "SELECT p_partkey, place_terms AS ent_location FROM (" + phrases_sql(PLACES, PLACED, "place") + ")")
def q8p(spark, sf):
    lists = {"cultural_group": ["ring near"], "location": PLACES, "period": [], "adjective": ["old"]}
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{PLACED} AS text")
    return annotate(p, "text", lists).select("p_partkey", "ent_location")


@query(
    "q8_annotate",
    "SELECT doc_id, "
    + ", ".join(
        f"array_to_string(list_sort(list_distinct(list_intersect(w, {list_sql(LEXICON[k])}))), ', ') AS {n}"
        for k, n in (("cultural_group", "ent_cultural_group"), ("location", "ent_location"), ("period", "ent_period"))
    )
    + ", "
    + ", ".join(
        f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{p}'),"
        f" lambda x: regexp_replace(x, '\\s+', ' ', 'g')))), ', ') AS {n}"
        for p, n in ((PERSON, "ent_people"), (PHRASE, "desc_noun_phrases"))
    )
    + f", round(len(list_filter(w, lambda x: list_contains({list_sql(LEXICON['adjective'])}, x))) / len(w), 6)"
    f" AS desc_adjective_density FROM (SELECT doc_id, text, {words_sql('text')} AS w FROM documents)",
)
def q8(spark, sf):
    out = annotate(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")
    return out.withColumn("desc_adjective_density", r("desc_adjective_density", 6))


def fixed_candidates(profile, hint):
    """Three recipes whose values are spelled in the oracle."""
    return [
        {"name": "price_per_qty", "expr": "try_divide(cash_price, qty + 1)", "needs": []},
        {"name": "freq_make", "expr": "_freq_make", "needs": [["freq", "make"]]},
        {"name": "cash_price_vs_item_mean", "expr": "cash_price - _mean_item_cash_price", "needs": [["mean", "item", "cash_price"]]},
        {"name": "broken", "expr": "no_such_column + 1", "needs": []},
        {"name": "flat", "expr": "1 + 0", "needs": []},
    ]


@query(
    "q9_generated_recipes",
    oracle_with("products") + " SELECT basket_ID, line, cash_price, round(cash_price / (qty + 1), 9) AS price_per_qty,"
    " n AS freq_make, round(cash_price - m, 4) AS cash_price_vs_item_mean FROM products LEFT JOIN"
    " (SELECT make, count(*) AS n FROM products GROUP BY 1) USING (make) LEFT JOIN"
    " (SELECT item, avg(cash_price) AS m FROM products GROUP BY 1) USING (item)",
)
def q9(spark, sf):
    op = SemGenFeatures(how_many=5, proposer=fixed_candidates, keep_all=True)
    out = op.fit_transform(view(spark, sf, "products"))
    return out.select(
        "basket_ID", "line", "cash_price", r("price_per_qty", 9).alias("price_per_qty"), "freq_make",
        r("cash_price_vs_item_mean").alias("cash_price_vs_item_mean"),
    )


@query("q9_generated_choice")
def q9c(spark, sf):
    """Default proposer, scored against the price; the tries with their scores."""
    facts = view(spark, sf, "facts")
    program = SemGenFeatures(how_many=4, y="price", exclude=["house_id", "image_id"], hint="ratio sqft").fit(facts)
    made = [c for c in program.transform(facts).columns if c not in facts.columns]
    return program.transform(facts).select("house_id", *made)


MODES = """(SELECT basket_ID, {c} AS {c}_mode FROM (SELECT basket_ID, {c}, row_number() OVER (PARTITION BY basket_ID
 ORDER BY count(*) DESC, {c}) AS n FROM products WHERE {c} IS NOT NULL GROUP BY basket_ID, {c}) WHERE n = 1)"""


@query(
    "q10_aggregate_child",
    oracle_with("baskets", "products") + " SELECT ID, round(avg(cash_price), 6) AS cash_price_mean, round(sum(cash_price), 6) AS"
    " cash_price_sum, count(cash_price) AS cash_price_count, round(stddev_samp(cash_price), 4) AS cash_price_std,"
    " any_value(make_mode) AS make_mode, count(DISTINCT make) AS make_nunique, any_value(item_mode) AS item_mode,"
    " count(DISTINCT item) AS item_nunique FROM baskets LEFT JOIN products ON ID = products.basket_ID"
    f" LEFT JOIN {MODES.format(c='make')} a ON a.basket_ID = ID LEFT JOIN {MODES.format(c='item')} b ON b.basket_ID = ID GROUP BY ID",
)
def q10(spark, sf):
    op = SemAggFeatures("ID", "basket_ID", hint="price statistics", exclude=["line", "qty", "model"])
    out = op.fit_transform(view(spark, sf, "baskets").select("ID"), child=view(spark, sf, "products"))
    digits = {"cash_price_mean": 6, "cash_price_sum": 6, "cash_price_std": 4}
    return out.select(*[r(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


@query(
    "q11_augment",
    "WITH s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT max(n) AS top FROM s),"
    " x AS (SELECT o.o_orderkey, o.o_orderstatus, (top - n) * 1.0 / n AS want FROM orders o JOIN s USING (o_orderstatus), m),"
    " c AS (SELECT *, CAST(floor(want) AS BIGINT) + CASE WHEN " + duck_fraction("o_orderkey", 0)
    + " < want - floor(want) THEN 1 ELSE 0 END AS copies FROM x)"
    " SELECT o_orderstatus, false AS is_augmented, count(*) AS n FROM c GROUP BY 1 UNION ALL"
    " SELECT o_orderstatus, true, CAST(sum(copies) AS BIGINT) FROM c WHERE copies > 0 GROUP BY 1",
)
def q11(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = SemAugment("o_orderstatus", "o_orderkey").augment(o)
    return out.groupBy("o_orderstatus", "is_augmented").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q12_column_report",
    oracle_with("facts") + " SELECT unnest(['sqft', 'bed', 'bath', 'city_id']) AS \"column\", 0.0::DOUBLE AS null_ratio,"
    " unnest([round(abs(corr(sqft, price)), 6), round(abs(corr(bed, price)), 6), round(abs(corr(bath, price)), 6),"
    " round(abs(corr(city_id, price)), 6)]) AS score FROM facts",
)
def q12r(spark, sf):
    f = view(spark, sf, "facts").select("sqft", "bed", "bath", "city_id", "price")
    return column_report(f, "price").select("column", "null_ratio", r("score", 6).alias("score"))


@query("q12_select", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem")
def q12(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax", F.lit(1).alias("flat")
    )
    op = SemSelect("l_extendedprice", k=1, keep=["l_orderkey", "l_linenumber"])
    return op.fit_transform(li)


QUOTA_SQL = """WITH s AS (SELECT lang, count(*) AS c FROM documents GROUP BY 1), u AS (SELECT lang, c, sum(c) OVER (ORDER BY lang)
 AS cum, (SELECT count(*) FROM documents) AS total FROM s), q AS (SELECT lang, floor(cum * 150.0 / total + 0.5)
 - floor((cum - c) * 150.0 / total + 0.5) AS quota FROM u) SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER
 (PARTITION BY lang ORDER BY md5('5:' || doc_id)) AS n FROM documents) JOIN q USING (lang) WHERE n <= quota"""


@query("q13_distill_strata", QUOTA_SQL)
def q13(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return SemDistill(150, "doc_id", ["lang"], seed=5).distill(d)


@query("q13_distill_centres")
def q13k(spark, sf):
    """The row nearest to each of eight centres."""
    f = view(spark, sf, "facts")
    return SemDistill(8, "house_id", method="kmeans", features=["price", "sqft"], seed=1).distill(f)


@query(
    "g1_score_candidates",
    oracle_with("facts") + f", f AS (SELECT *, {duck_hash('house_id', 0)} % 3 AS fold FROM facts)"
    " SELECT 'log_price' AS candidate, fold, round(abs(corr(ln(1 + price), sqft)), 6) AS score, count(*) AS rows FROM f GROUP BY fold"
    " UNION ALL SELECT 'rooms', fold, round(abs(corr(bed + bath, sqft)), 6), count(*) FROM f GROUP BY fold"
    " UNION ALL SELECT 'style', fold, round(sqrt(greatest((sum(s * s / n) - sum(s) * sum(s) / sum(n))"
    " / (sum(q) - sum(s) * sum(s) / sum(n)), 0)), 6), CAST(sum(n) AS BIGINT) FROM (SELECT fold, 'b' || bed AS v, count(*) AS n,"
    " sum(sqft) AS s, sum(sqft * sqft) AS q FROM f GROUP BY ALL) GROUP BY fold",
)
def g1(spark, sf):
    out = score_candidates(
        view(spark, sf, "facts"),
        {"log_price": "log1p(price)", "rooms": "bed + bath", "style": "concat('b', bed)", "bad": "nothing + 1"},
        "sqft", 3, "house_id",
    )
    return out.select("candidate", F.col("fold").cast("bigint").alias("fold"), r("score", 6).alias("score"), "rows")


@query(
    "g1_large_labels",
    "SELECT 'parity' AS candidate, 1.0::DOUBLE AS score, count(*) AS rows FROM orders UNION ALL SELECT 'named', 1.0::DOUBLE, count(*) FROM orders",
)
def g1l(spark, sf):
    """Labels near 10^9 that differ by one: the number and the text that decide them score 1."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "1e9 + o_orderkey % 2 AS y")
    out = score_candidates(o, {"parity": "o_orderkey % 2", "named": "concat('p', o_orderkey % 2)"}, "y")
    return out.select("candidate", r("score", 6).alias("score"), "rows")


@query(
    "q1_fill_long_values",
    "SELECT p_partkey, p_type, CASE WHEN p_partkey % 4 = 0 THEN 'text' ELSE 'given' END AS p_type_source FROM part",
)
def q1l(spark, sf):
    """Values of three and more words are found in the text that names them, among others that share their words."""
    p = table(spark, sf, "part").withColumn("p_type", F.concat_ws(" ", F.lit("made of"), "p_type"))
    p = p.withColumn("note", F.concat(F.lit("it was "), "p_type", F.lit(" as they say")))
    gaps = p.withColumn("p_type", F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")))
    known = gaps.where("p_type IS NOT NULL").select("p_type").distinct()
    gaps = gaps.join(known.withColumnRenamed("p_type", "_k"), F.col("note").contains(F.col("_k")), "left_semi")
    out = SemFillNA("p_type", text=["note"]).fit_transform(gaps)
    return out.select("p_partkey", F.expr("substring(p_type, 9)").alias("p_type"), "p_type_source")


@query(
    "q1_fill_types",
    "WITH t AS (SELECT o_orderkey, CAST(o_orderkey % 5 AS DECIMAL(10,2)) + 0.25 AS d, CAST('2020-01-01' AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS t,"
    " o_orderkey % 5 = 1 AS b FROM orders), g AS (SELECT *, o_orderkey % 7 = 0 AS gap FROM t),"
    " m AS (SELECT (SELECT d FROM g WHERE NOT gap GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS md,"
    " (SELECT t FROM g WHERE NOT gap GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mt,"
    " (SELECT b FROM g WHERE NOT gap GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mb)"
    " SELECT o_orderkey, CASE WHEN gap THEN md ELSE d END::VARCHAR AS d, CASE WHEN gap THEN mt ELSE t END::VARCHAR AS t,"
    " CASE WHEN gap THEN mb ELSE b END AS b FROM g, m",
)
def q1t(spark, sf):
    """Decimals, dates and booleans come back as the values seen."""
    o = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CAST(CAST(o_orderkey % 5 AS DECIMAL(10,2)) + 0.25 AS DECIMAL(10,2)) AS d",
        "date_add(DATE'2020-01-01', CAST(o_orderkey % 5 AS INT)) AS t", "o_orderkey % 5 = 1 AS b",
    )
    for c in ("d", "t", "b"):
        o = o.withColumn(c, F.when(F.col("o_orderkey") % 7 != 0, F.col(c)))
    for c in ("d", "t", "b"):
        o = SemFillNA(c).fit_transform(o)
    return o.select("o_orderkey", F.col("d").cast("string").alias("d"), F.col("t").cast("string").alias("t"), "b")


TIED = "SELECT p_partkey, p_partkey // 3 AS g, CASE p_partkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 10 END AS n, CASE p_partkey % 3 WHEN 0 THEN 10.5 WHEN 1 THEN 9.5 END::DECIMAL(6,1) AS d FROM part"


@query(
    "q1_fill_ties",
    f"WITH t AS ({TIED}), b AS (SELECT g, min(n) AS bn, min(d) AS bd FROM t GROUP BY 1) SELECT p_partkey, coalesce(n, bn, 9)::BIGINT AS n, coalesce(d, bd, 9.5)::VARCHAR AS d,"
    " CASE WHEN n IS NOT NULL THEN 'given' WHEN bn IS NOT NULL THEN 'group' ELSE 'overall' END AS n_source FROM t LEFT JOIN b USING (g)",
)
def q1ties(spark, sf):
    """Of values that are met equally often the least goes, as a number and not as text."""
    p = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_partkey div 3 AS g", "CASE p_partkey % 3 WHEN 0 THEN 9L WHEN 1 THEN 10L END AS n",
        "CAST(CASE p_partkey % 3 WHEN 0 THEN 10.5 WHEN 1 THEN 9.5 END AS DECIMAL(6,1)) AS d",
    )
    out = SemFillNA("d", ["g"]).fit_transform(SemFillNA("n", ["g"]).fit_transform(p))
    return out.select("p_partkey", "n", F.col("d").cast("string").alias("d"), "n_source")


@query(
    "q9_doubled_rows",
    oracle_with("products") + ", n AS (SELECT 2 * count(*) AS rows FROM products) SELECT candidate, state, rows FROM n, (VALUES ('price_per_qty', 'kept'),"
    " ('freq_make', 'kept'), ('cash_price_vs_item_mean', 'kept'), ('broken', 'refused'), ('flat', 'constant'), ('again', 'duplicate')) AS v(candidate, state)",
)
def q9d(spark, sf):
    """Rows that come twice don't make different candidates look alike."""
    p = view(spark, sf, "products")
    twice = p.unionByName(p)
    copy = [{"name": "again", "expr": "try_divide(cash_price, qty + 1) * 1", "needs": []}]
    program = SemGenFeatures(how_many=9, proposer=lambda profile, hint: fixed_candidates(profile, hint) + copy).fit(twice)
    tries = [(t["candidate"], t["state"]) for t in program.attempts[0]["tries"]]
    return spark.createDataFrame(tries, "candidate string, state string").withColumn("rows", F.lit(twice.count()).cast("long"))


# --- programs, preparation ---------------------------------------------------------------


@query(
    "q_program_saved_and_replayed",
    oracle_with("products") + FILL_SQL + " SELECT basket_ID, line, cash_price, make, item FROM filled",
)
def q_saved(spark, sf):
    """Two programs are chained, saved, loaded and replayed; nothing is fitted again."""
    p = view(spark, sf, "products")
    first = SemFillNA("make", ["item", "model"], hint="from the item and the model").fit(p)
    second = SemClean(["item"], kind="text").fit(first.transform(p))
    path = fresh(spark, "program")
    chain(first, second).save(spark, path)
    out = FeatureProgram.load(spark, path).transform(p)
    return out.select("basket_ID", "line", "cash_price", "make", "item")


@query(
    "m2_mean_impute",
    oracle_with("facts") + ", f AS (SELECT house_id, CASE WHEN sqft > 0 THEN sqft END AS sqft FROM facts)"
    " SELECT house_id, round(coalesce(sqft, (SELECT avg(sqft) FROM f)), 6) AS sqft FROM f",
)
def m2(spark, sf):
    f = view(spark, sf, "facts").select("house_id", F.when(F.col("sqft") > 0, F.col("sqft")).alias("sqft"))
    return P.mean_impute(f, ["sqft"]).select("house_id", r("sqft", 6).alias("sqft"))


@query(
    "m3_standardize",
    oracle_with("facts") + " SELECT house_id, round((sqft - a) / s, 6) AS sqft FROM facts,"
    " (SELECT avg(sqft) AS a, stddev_pop(sqft) AS s FROM facts)",
)
def m3(spark, sf):
    f = view(spark, sf, "facts").select("house_id", "sqft")
    return P.standardize(f, ["sqft"]).select("house_id", r("sqft", 6).alias("sqft"))


@query(
    "m4_label_codec",
    "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS label, lang AS decoded FROM documents",
)
def m4(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    codec = P.LabelCodec("lang").fit(d)
    return codec.decode(codec.encode(d), "label", "decoded")


@query("m5_drop_low_variance", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def m5(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    return P.drop_low_variance(li, 0.01)


JB = """SELECT '{c}' AS "column", count({c}) AS n, round(count({c}) / 6.0 * (pow(avg(pow({c} - m{i}, 3)) / pow(var_pop({c}), 1.5), 2)
 + pow(avg(pow({c} - m{i}, 4)) / pow(var_pop({c}), 2) - 3, 2) / 4), 3) AS statistic FROM facts, (SELECT avg({c}) AS m{i} FROM facts)"""


@query(
    "m11_normality",
    oracle_with("facts") + " " + " UNION ALL ".join(JB.format(c=c, i=i) for i, c in enumerate(("price", "bed", "bath"))),
)
def m11(spark, sf):
    out = P.normality(view(spark, sf, "facts"), ["price", "bed", "bath"])
    return out.select("column", "n", r("statistic", 3).alias("statistic"))


@query("m1_table_vectorizer")
def m1(spark, sf):
    """Feature vectors of all products."""
    p = view(spark, sf, "products")
    model = P.TableVectorizer(exclude=["basket_ID", "line"]).fit(p)
    return P.without_scratch(model.transform(p)).select("basket_ID", "line", "features")


@query("p9_roles_survive", oracle_with("facts") + " SELECT house_id, sqft, price FROM facts")
def p9b(spark, sf):
    f = C.mark(view(spark, sf, "facts"), X=["house_id", "sqft"], y="price", description="houses")
    kept = f.where("price IS NOT NULL")
    return kept.select(*C.marked(kept, "X"), *C.marked(kept, "y"))
