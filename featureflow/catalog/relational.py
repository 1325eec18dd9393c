"""Checked queries for sources, columns, filters, joins, aggregates, windows, samples and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from featureflow.catalog.registry import query
from featureflow.functions import numbers as N
from featureflow.operators import aggs as A
from featureflow.operators import columns as C
from featureflow.operators import filters as FL
from featureflow.operators import joins as J
from featureflow.operators import sampling as L
from featureflow.operators import setops as V
from featureflow.operators import udf as U
from featureflow.operators import windows as W
from featureflow.plans.scenario import oracle_with, table, view
from featureflow.session import scratch_dir
from featureflow.sources import tables as S


def r(c, digits=4):
    return F.round(c, digits)


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def duck_fraction(key: str, seed: int) -> str:
    return f"('0x' || substring(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0"


def duck_hash(key: str, seed: int) -> str:
    return f"('0x' || substring(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


def duck_digest(key: str, seed: int) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def fresh(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources ---------------------------------------------------------------------------


@query("s1_csv_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s1(spark, sf):
    path = fresh(spark, "csv")
    src = table(spark, sf, "customer")
    src.write.csv(path, header=True)
    return S.read_table(spark, path, src.schema)


@query(
    "s2_named_inputs",
    "SELECT 'train' AS binding, count(*) AS products, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem"
    " WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE " + duck_fraction("o_orderkey", 42) + " >= 0.25)"
    " UNION ALL SELECT 'test', count(*), CAST(sum(l_linenumber) AS BIGINT) FROM lineitem"
    " WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE " + duck_fraction("o_orderkey", 42) + " < 0.25)",
)
def s2(spark, sf):
    baskets = view(spark, sf, "baskets")
    train, test = L.split(baskets, 0.25, "ID", 42)
    inputs = S.Inputs(products=view(spark, sf, "products"), baskets=train)

    def pipeline(tables, name):
        kept = FL.keep_in(tables["products"], "basket_ID", tables["baskets"], "ID")
        return kept.agg(F.count(F.lit(1)).alias("products"), F.sum("line").alias("lines")).select(
            F.lit(name).alias("binding"), "products", "lines"
        )

    return pipeline(inputs, "train").unionByName(pipeline(inputs.rebind(baskets=test), "test"))


@query(
    "s3_packaged_dataset",
    "SELECT o_orderkey, count(l_linenumber) AS children FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"
    " GROUP BY o_orderkey",
)
def s3(spark, sf):
    d = S.load_dataset(spark, sf, ["orders", "lineitem"])
    joined = J.merge(d["orders"], d["lineitem"], left_on="o_orderkey", right_on="l_orderkey", how="left")
    return joined.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("children"))


@query(
    "s8_result_table",
    "SELECT o_orderpriority AS cache_key, 'totals' AS operation, o_custkey, count(*) AS n FROM orders GROUP BY ALL",
)
def s8(spark, sf):
    path = fresh(spark, "results")
    o = table(spark, sf, "orders")
    keyed = o.select(F.col("o_orderpriority").alias("cache_key"), F.lit("totals").alias("operation"), "o_custkey")
    first = keyed.withColumn("n", F.lit(0).cast("bigint"))
    S.write_results(first, path)
    S.write_results(keyed.groupBy("cache_key", "operation", "o_custkey").agg(F.count(F.lit(1)).alias("n")), path)
    return S.read_results(spark, path)


@query(
    "s9_result_archive",
    "SELECT o_orderpriority AS cache_key, 'archived' AS state, count(*) AS n FROM orders"
    " WHERE o_orderpriority = '1-URGENT' GROUP BY ALL UNION ALL"
    " SELECT o_orderpriority, 'live', count(*) FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL",
)
def s9(spark, sf):
    path = fresh(spark, "results")
    o = table(spark, sf, "orders")
    S.write_results(
        o.select(F.col("o_orderpriority").alias("cache_key"), F.lit("rows").alias("operation"), "o_orderkey"), path
    )
    S.archive_results(spark, path, "1-URGENT")
    old = S.read_archive(spark, path).select("cache_key", F.lit("archived").alias("state"))
    live = S.read_results(spark, path).select("cache_key", F.lit("live").alias("state"))
    return old.unionByName(live).groupBy("cache_key", "state").agg(F.count(F.lit(1)).alias("n"))


# --- columns ---------------------------------------------------------------------------


@query("p1_select", "SELECT o_orderkey, o_totalprice FROM orders")
def p1(spark, sf):
    return C.select(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])


@query("p2_drop_strict", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def p2(spark, sf):
    return C.drop_columns(table(spark, sf, "customer"), ["c_name", "c_acctbal"])


@query("p3_drop_ignore", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def p3(spark, sf):
    return C.drop_columns(table(spark, sf, "customer"), ["c_name", "absent"], errors="ignore")


@query(
    "p4_assign",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net,"
    " l_quantity * 2 AS l_quantity, l_quantity + 1 AS after FROM lineitem",
)
def p4(spark, sf):
    li = table(spark, sf, "lineitem")
    return C.assign(
        li, net=lambda d: r(d.l_extendedprice * (1 - d.l_discount), 6), l_quantity="l_quantity * 2",
        after=F.col("l_quantity") + 1,
    ).select("l_orderkey", "l_linenumber", "net", "l_quantity", "after")


@query("p5_copy_column", "SELECT s_suppkey, s_name, s_name AS s_name_raw FROM supplier")
def p5(spark, sf):
    return C.copy_column(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_name", "s_name_raw")


@query("p6_columns_by_type", "SELECT l_orderkey, l_returnflag, l_linestatus, l_discount > 0.05 AS cheap FROM lineitem")
def p6(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("cheap", F.col("l_discount") > 0.05)
    return li.select("l_orderkey", *C.cols_of(li, "string"), *C.cols_of(li, "boolean"))


@query("p7_all_but", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def p7(spark, sf):
    p = table(spark, sf, "part")
    return p.select(*C.cols_except(p, "p_retailprice"))


@query("p8_apply_excluding", "SELECT c_custkey, c_name, ln(1 + abs(c_acctbal)) IS NOT NULL AS seen FROM customer")
def p8(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return C.apply_excluding(
        c, lambda d: d.withColumn("seen", F.log1p(F.abs("c_acctbal")).isNotNull()).drop("c_acctbal"), ["c_name"]
    )


@query("p9_roles", "SELECT o_orderkey AS ID, CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END AS fraud_flag FROM orders")
def p9(spark, sf):
    b = C.mark(view(spark, sf, "baskets"), X=["ID"], y="fraud_flag", description="baskets and their fraud flag")
    return b.select(*C.marked(b, "X"), *C.marked(b, "y"))


@query(
    "p10_random_columns",
    f"SELECT o_orderkey, round({duck_fraction('o_orderkey', 7)}, 9) AS random_col1,"
    f" ['A','B','C'][1 + {duck_hash('o_orderkey', 8)} % 3] AS random_col2 FROM orders",
)
def p10(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return C.random_columns(o, "o_orderkey", 7).withColumn("random_col1", r("random_col1", 9))


@query(
    "p11_row_id",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS row_id"
    " FROM lineitem",
)
def p11(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return C.with_row_id(li, ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")


@query(
    "p12_vector_to_columns",
    "SELECT l_orderkey, l_linenumber, l_quantity AS v0, l_tax AS v1 FROM lineitem",
)
def p12(spark, sf):
    from pyspark.ml.functions import array_to_vector

    li = table(spark, sf, "lineitem")
    vec = li.select("l_orderkey", "l_linenumber", array_to_vector(F.array("l_quantity", "l_tax")).alias("vec"))
    return C.as_frame(C.vector_columns(vec, "vec", 2))


# --- filters ---------------------------------------------------------------------------


@query("f1_equals", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def f1(spark, sf):
    return FL.equals(table(spark, sf, "orders"), "o_orderstatus", "F").select("o_orderkey")


@query(
    "f2_keep_in",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders"
    " WHERE o_orderpriority = '1-URGENT')",
)
def f2(spark, sf):
    urgent = FL.equals(table(spark, sf, "orders"), "o_orderpriority", "1-URGENT")
    return FL.keep_in(table(spark, sf, "lineitem"), "l_orderkey", urgent, "o_orderkey").select(
        "l_orderkey", "l_linenumber"
    )


@query("f3_missing_from", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def f3(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return FL.missing_from(table(spark, sf, "orders").select("o_orderkey"), li, "o_orderkey")


@query("f4_like_label", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')")
def f4(spark, sf):
    return FL.like_label(table(spark, sf, "part"), "p_name", "WIDGET").select("p_partkey", "p_name")


@query(
    "f5_match_config",
    "SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND abs(p_size / 50.0 - 0.3) <= 1e-6",
)
def f5(spark, sf):
    p = table(spark, sf, "part").withColumn("temperature", F.col("p_size") / 50.0)
    return FL.match_config(FL.match_config(p), model="PROMO", temp=0.3, model_col="p_type").select("p_partkey")


@query(
    "f6_take_last_texts",
    "SELECT o_orderstatus, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS n"
    " FROM orders) WHERE n <= CASE o_orderstatus WHEN 'F' THEN 300 WHEN 'O' THEN 50 ELSE 0 END",
)
def f6t(spark, sf):
    """In descending order of a text, ties by a number."""
    out = FL.take_per_class(table(spark, sf, "orders"), "o_orderstatus", {"F": 300, "O": 50}, ["-o_orderpriority", "o_totalprice", "o_orderkey"])
    return out.select("o_orderstatus", "o_orderkey", "o_orderpriority")


@query(
    "f6_take_per_class",
    oracle_with("baskets") + " SELECT ID, fraud_flag FROM (SELECT *, row_number() OVER (PARTITION BY fraud_flag"
    " ORDER BY ID) AS n FROM baskets) WHERE n <= CASE fraud_flag WHEN 0 THEN 4000 WHEN 1 THEN 1000 END",
)
def f6(spark, sf):
    return FL.take_per_class(view(spark, sf, "baskets"), "fraud_flag", {0: 4000, 1: 1000}, ["ID"])


# --- joins -----------------------------------------------------------------------------


@query(
    "j1_merge_inner",
    oracle_with("facts", "cities") + " SELECT house_id, city_id, city_name FROM facts JOIN cities USING (city_id)",
)
def j1(spark, sf):
    return J.merge(view(spark, sf, "facts"), view(spark, sf, "cities"), on="city_id").select(
        "house_id", "city_id", "city_name"
    )


@query(
    "j2_star_join",
    oracle_with("facts", "cities", "images")
    + " SELECT house_id, city_id, image_id, bed, bath, sqft, price, city_name, image_path"
    " FROM facts JOIN cities USING (city_id) JOIN images USING (image_id)",
)
def j2(spark, sf):
    return J.star_join(
        view(spark, sf, "facts"), [(view(spark, sf, "cities"), "city_id"), (view(spark, sf, "images"), "image_id")]
    )


@query(
    "j3_merge_left",
    "SELECT o_custkey AS c_custkey, o_orderkey, c_name FROM orders LEFT JOIN"
    " (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
)
def j3(spark, sf):
    good = table(spark, sf, "customer").where("c_acctbal > 0")
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.merge(o, good, on="c_custkey", how="left").select("c_custkey", "o_orderkey", "c_name")


@query(
    "j4_merge_two_keys",
    oracle_with("baskets", "products") + " SELECT ID, basket_ID, line, fraud_flag FROM baskets JOIN products"
    " ON ID = basket_ID",
)
def j4(spark, sf):
    return J.merge(view(spark, sf, "baskets"), view(spark, sf, "products"), left_on="ID", right_on="basket_ID").select(
        "ID", "basket_ID", "line", "fraud_flag"
    )


@query(
    "j5_merge_left_two_keys",
    oracle_with("baskets", "products") + " SELECT ID, line FROM baskets LEFT JOIN products ON ID = basket_ID",
)
def j5(spark, sf):
    joined = J.merge(
        view(spark, sf, "baskets"), view(spark, sf, "products"), left_on="ID", right_on="basket_ID", how="left"
    )
    return C.drop_columns(joined, ["basket_ID"]).select("ID", "line")


@query(
    "j6_suffixes",
    "SELECT a.l_orderkey, a.n AS n_x, b.n AS n_y FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a"
    " JOIN (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1) b"
    " ON a.l_orderkey = b.l_orderkey",
)
def j6(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey")
    return J.merge(g.agg(F.count(F.lit(1)).alias("n")), g.agg(F.sum("l_linenumber").alias("n")), on="l_orderkey")


@query(
    "j7_align_by_occurrence",
    "SELECT a.c AS city, a.n AS occurrence, a.c_custkey, b.s_suppkey FROM"
    " (SELECT c_nationkey AS c, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) n"
    " FROM customer) a JOIN (SELECT s_nationkey AS c, s_suppkey, row_number() OVER (PARTITION BY s_nationkey"
    " ORDER BY s_acctbal, s_suppkey) n FROM supplier) b ON a.c = b.c AND a.n = b.n",
)
def j7(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("city"), "c_custkey", "c_acctbal")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("city"), "s_suppkey", "s_acctbal")
    out = J.align_by_occurrence(c, s, "city", ["c_acctbal", "c_custkey"], ["s_acctbal", "s_suppkey"])
    return out.select("city", "occurrence", "c_custkey", "s_suppkey")


@query(
    "j8_remap_ids",
    "SELECT o_orderkey, coalesce('S' || a.s_suppkey, 'C' || o_custkey) AS source,"
    " coalesce('S' || b.s_suppkey, 'C' || (o_orderkey // 2)) AS target FROM orders"
    " LEFT JOIN supplier a ON a.s_suppkey = o_custkey LEFT JOIN supplier b ON b.s_suppkey = o_orderkey // 2",
)
def j8(spark, sf):
    edges = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("C"), F.col("o_custkey")).alias("source"),
        F.concat(F.lit("C"), F.floor(F.col("o_orderkey") / 2)).alias("target"),
    )
    mapping = table(spark, sf, "supplier").select(
        F.concat(F.lit("C"), F.col("s_suppkey")).alias("old_id"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("new_id"),
    )
    return J.remap_ids(edges, mapping)


@query(
    "j9_lookup_chain",
    "SELECT o_orderkey, coalesce(s_name, CASE WHEN c_acctbal > 5000 THEN c_name END) AS value,"
    " coalesce(s_name, CASE WHEN c_acctbal > 5000 THEN c_name END) IS NULL AS is_error FROM orders"
    " LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN customer ON c_custkey = o_custkey",
)
def j9(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rich = table(spark, sf, "customer").where("c_acctbal > 5000")
    return J.lookup_chain(
        o,
        [(table(spark, sf, "supplier"), "o_custkey", "s_suppkey", "s_name"), (rich, "o_custkey", "c_custkey", "c_name")],
    ).drop("o_custkey")


# --- aggregates ------------------------------------------------------------------------


@query(
    "a1_group_mean",
    oracle_with("products") + " SELECT make, round(avg(cash_price), 4) AS cash_price, round(avg(qty), 4) AS qty"
    " FROM products WHERE make IS NOT NULL GROUP BY make",
)
def a1(spark, sf):
    out = A.group_mean(view(spark, sf, "products").select("make", "cash_price", "qty"), "make")
    return out.select("make", r("cash_price").alias("cash_price"), r("qty").alias("qty"))


STATS_SQL = """ SELECT make, round(avg(cash_price), 4) AS price_mean, round(stddev_samp(cash_price), 4) AS price_std,
 round(CASE WHEN count(*) > 2 THEN (avg(pow(cash_price - m, 3))) / pow(var_pop(cash_price), 1.5) ELSE 0 END, 4)
   AS price_skew,
 round(CASE WHEN count(*) > 3 THEN avg(pow(cash_price - m, 4)) / pow(var_pop(cash_price), 2) - 3 ELSE 0 END, 4)
   AS price_kurtosis
 FROM products JOIN (SELECT make, avg(cash_price) AS m FROM products GROUP BY make) USING (make) GROUP BY make"""


@query("a2_a3_a4_group_stats", oracle_with("products") + STATS_SQL)
def a234(spark, sf):
    out = A.group_stats(view(spark, sf, "products"), "make", "cash_price")
    return out.select("make", *[r(c).alias(c) for c in out.columns[1:]])


@query(
    "a5_segment_profile",
    oracle_with("facts") + " SELECT city_id, count(*) AS num_houses, round(avg(price), 0) AS avg_price,"
    " round(median(price), 0) AS median_price, round(median(sqft), 1) AS median_sqft, round(avg(bed), 1) AS avg_bed"
    " FROM facts GROUP BY city_id",
)
def a5(spark, sf):
    return A.segment_profile(
        view(spark, sf, "facts"), "city_id", "num_houses",
        {"avg_price": ("price", 0), "avg_bed": ("bed", 1)}, {"median_price": ("price", 0), "median_sqft": ("sqft", 1)},
    )


MODE_SQL = """(SELECT {key}, v AS {c}_mode FROM (SELECT {key}, {c} AS v, row_number() OVER (PARTITION BY {key}
 ORDER BY count(*) DESC, {c}) AS n FROM products WHERE {c} IS NOT NULL GROUP BY {key}, {c}) WHERE n = 1)"""


@query(
    "a6_agg_features",
    oracle_with("products")
    + " SELECT p.basket_ID, cash_price_mean, cash_price_sum, cash_price_count, qty_mean, qty_sum, qty_count,"
    " make_mode, item_mode FROM (SELECT basket_ID, round(avg(cash_price), 6) AS cash_price_mean,"
    " round(sum(cash_price), 6) AS cash_price_sum, count(cash_price) AS cash_price_count, round(avg(qty), 6) AS qty_mean,"
    " round(sum(qty), 6) AS qty_sum, count(qty) AS qty_count FROM products GROUP BY basket_ID) p"
    f" LEFT JOIN {MODE_SQL.format(key='basket_ID', c='make')} m ON m.basket_ID = p.basket_ID"
    f" LEFT JOIN {MODE_SQL.format(key='basket_ID', c='item')} i ON i.basket_ID = p.basket_ID",
)
def a6(spark, sf):
    out = A.agg_features(view(spark, sf, "products"), "basket_ID", ["cash_price", "qty"], ["make", "item"])
    digits = {"cash_price_mean": 6, "cash_price_sum": 6, "qty_mean": 6, "qty_sum": 6}
    return out.select(*[r(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


@query("a7_group_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def a7(spark, sf):
    return A.group_count(table(spark, sf, "orders"), "o_custkey", "n")


@query("a8_unique_values", oracle_with("products") + " SELECT DISTINCT make, item FROM products")
def a8(spark, sf):
    return A.unique_values(view(spark, sf, "products"), ["make", "item"])


@query("a9_value_counts", oracle_with("products") + " SELECT make, count(*) AS n FROM products WHERE make IS NOT NULL GROUP BY 1")
def a9(spark, sf):
    return A.value_counts(view(spark, sf, "products"), "make", "n")


@query(
    "a10_cost_rollup",
    oracle_with("run_events") + " SELECT run_id, type AS operator, round(sum(coalesce(cost, 0)), 2) AS cost_usd,"
    " count(*) AS attempts, round(any_value(t), 2) AS run_cost_usd, any_value(c) AS run_attempts FROM run_events JOIN"
    " (SELECT run_id, sum(coalesce(cost, 0)) AS t, count(*) AS c FROM run_events GROUP BY 1) USING (run_id) GROUP BY 1, 2",
)
def a10(spark, sf):
    ev = view(spark, sf, "run_events").withColumnRenamed("type", "operator")
    return A.cost_rollup(ev).withColumns({"cost_usd": r("cost_usd", 2), "run_cost_usd": r("run_cost_usd", 2)})


@query(
    "a11_score_summary",
    oracle_with("trials") + " SELECT run_id, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std"
    " FROM trials GROUP BY 1",
)
def a11(spark, sf):
    out = A.score_summary(view(spark, sf, "trials"), "run_id")
    return out.withColumns({"score_mean": r("score_mean", 6), "score_std": r("score_std", 6)})


BEST_SQL = """ SELECT run_id, trial, parent_trial, operator, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id
 ORDER BY coalesce(score, '-inf'::DOUBLE) DESC, trial) AS n FROM trials) WHERE n = 1"""


@query("a12_best_by", oracle_with("trials") + BEST_SQL)
def a12(spark, sf):
    return A.best_by(view(spark, sf, "trials"), "run_id")


@query(
    "a13_distinct_options",
    "SELECT DISTINCT 'vendor/' || p_type AS model, p_size / 10.0 AS temperature,"
    " p_type || ' (t=' || CAST(p_size / 10.0 AS VARCHAR) || ')' AS label FROM part",
)
def a13(spark, sf):
    t = table(spark, sf, "part").select(
        F.concat(F.lit("vendor/"), F.col("p_type")).alias("model"), (F.col("p_size") / 10.0).alias("temperature")
    )
    return A.distinct_options(t)


@query(
    "a14_profile",
    oracle_with("artworks")
    + " SELECT count(*) AS row_count, 5::BIGINT AS column_count, 'date' AS name, 'string' AS dtype,"
    " count(*) - count(date) AS null_count FROM artworks"
    + "".join(
        f" UNION ALL SELECT count(*), 5::BIGINT, '{c}', '{t}', count(*) - count({c}) FROM artworks"
        for c, t in (("object_ID", "bigint"), ("description", "string"), ("culture", "string"), ("object_name", "string"))
    ),
)
def a14(spark, sf):
    return A.profile(view(spark, sf, "artworks"))


PRED_SQL = (
    " p AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END"
    " AS pred FROM lineitem), c AS (SELECT label, pred, count(*) AS n FROM p GROUP BY 1, 2),"
    " k AS (SELECT DISTINCT label AS k FROM p UNION SELECT DISTINCT pred FROM p),"
    " f AS (SELECT k, coalesce((SELECT sum(n) FROM c WHERE label = k AND pred = k), 0) AS h,"
    " coalesce((SELECT sum(n) FROM c WHERE label = k), 0) AS s, coalesce((SELECT sum(n) FROM c WHERE pred = k), 0) AS q FROM k)"
)


@query(
    "a15_classification_metrics",
    "WITH" + PRED_SQL + " SELECT round(sum(h) / sum(s), 6) AS accuracy, round(avg(2.0 * h / (s + q)), 6) AS f1_macro,"
    " round(sum(2.0 * h / (s + q) * s) / sum(s), 6) AS f1_weighted FROM f",
)
def a15(spark, sf):
    q = F.col("l_quantity")
    p = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.when(q < 20, "A").when(q < 35, "N").otherwise("R").alias("pred")
    )
    out = A.classification_metrics(p, "label", "pred")
    return out.select(*[r(c, 6).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")])


@query(
    "a15_binary_f1",
    "SELECT round(2.0 * sum(y * p) / (sum(y) + sum(p)), 6) AS f1 FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,"
    " CASE WHEN l_quantity >= 35 THEN 1 ELSE 0 END AS p FROM lineitem)",
)
def a15b(spark, sf):
    p = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") >= 35).cast("double").alias("p")
    )
    return A.metrics(p, "y", "p").select(r("f1", 6).alias("f1"))


@query(
    "a15_regression_metrics",
    "SELECT round(avg(pow(l_extendedprice - l_quantity * 1000, 2)), 2) AS mse,"
    " round(1 - sum(pow(l_extendedprice - l_quantity * 1000, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2"
    " FROM lineitem",
)
def a15r(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 1000)
    return A.regression_metrics(li, "l_extendedprice", "guess").select(r("mse", 2).alias("mse"), r("r2", 6).alias("r2"))


@query(
    "a15_roc_auc",
    "WITH s AS (SELECT l_quantity AS q, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R')"
    " AS n FROM lineitem GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY q) AS cn FROM s)"
    " SELECT round(sum(p * (cn - n / 2.0)) / (sum(p) * sum(n)), 6) AS roc_auc FROM c",
)
def a15a(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return A.roc_auc(li, "y", "l_quantity").select(r("roc_auc", 6).alias("roc_auc"))


# --- windows ---------------------------------------------------------------------------


@query(
    "w1_ntile",
    oracle_with("facts") + " SELECT house_id, CAST(ntile(4) OVER (ORDER BY price, house_id) AS BIGINT) AS price_quartile"
    " FROM facts",
)
def w1(spark, sf):
    out = W.ntile_global(view(spark, sf, "facts"), 4, "price", "house_id", "price_quartile")
    return out.select("house_id", big("price_quartile").alias("price_quartile"))


@query(
    "w2_rank",
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent, rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC)"
    " AS spent_rank FROM orders GROUP BY 1",
)
def w2(spark, sf):
    spent = table(spark, sf, "orders").groupBy("o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("spent"))
    return W.rank_desc(spent, "spent", "spent_rank")


@query(
    "w3_latest_per_key",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,"
    " event_id DESC) AS n FROM events) WHERE n = 1",
)
def w3(spark, sf):
    return W.latest_per_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type"
    )


@query(
    "w4_first_by_priority",
    "SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey)"
    " AS n FROM part) WHERE n = 1",
)
def w4(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_partkey", "p_size")
    return W.first_by_priority(p, "p_name", ["p_size", "p_partkey"])


RUNS_SQL = """WITH e AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
 k AS (SELECT * FROM e WHERE nxt IS NULL OR nxt <> event_type) SELECT user_id, event_id, event_type,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM k"""


@query("w5_last_of_run", RUNS_SQL)
def w5(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return W.last_of_run(e, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query(
    "w6_first_emission",
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type"
    " ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
)
def w6(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return W.first_emission(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "w7_trajectory_progress",
    oracle_with("trials") + " SELECT t.run_id, t.trial, max(t.score) OVER (PARTITION BY t.run_id ORDER BY t.trial)"
    " AS best_so_far, round(t.score - p.score, 4) AS improvement,"
    " coalesce(t.score = max(t.score) OVER (PARTITION BY t.run_id ORDER BY t.trial), false) AS is_best_so_far"
    " FROM trials t LEFT JOIN trials p ON p.run_id = t.run_id AND p.trial = t.parent_trial",
)
def w7(spark, sf):
    out = W.trajectory_progress(view(spark, sf, "trials"))
    return out.select("run_id", "trial", "best_so_far", r("improvement").alias("improvement"), "is_best_so_far")


# --- sorts, limits, samples ------------------------------------------------------------


@query(
    "l1_order_by_aggregate",
    "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY 1 ORDER BY 2 DESC, 1",
)
def l1(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(r(F.avg("o_totalprice"), 2).alias("avg_price"))
    return g.orderBy(F.col("avg_price").desc(), "o_orderpriority")


@query("l2_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def l2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return L.preview(o, 5, [F.col("o_totalprice").desc(), "o_orderkey"])


@query(
    "l3_top_k",
    oracle_with("trials") + " SELECT run_id, trial, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id"
    " ORDER BY score DESC NULLS LAST, trial) AS n FROM trials) WHERE n <= 3",
)
def l3(spark, sf):
    t = view(spark, sf, "trials").select("run_id", "trial", "score")
    return W.top_k(t, ["run_id"], 3, [F.col("score").desc_nulls_last(), F.col("trial")])


@query("l4_sample_n", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {duck_digest('o_orderkey', 42)}, o_orderkey LIMIT 500")
def l4(spark, sf):
    return L.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 500, "o_orderkey", 42)


@query(
    "l4_sample_many",
    "SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ORDER BY md5('3:' || l_orderkey || ':' || l_linenumber) LIMIT 20000",
)
def l4b(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    li = li.dropDuplicates()
    return L.sample_n(li, 20_000, ["l_orderkey", "l_linenumber"], 3)


@query("l5_subsample_switch", "SELECT count(*) AS full_rows, least(count(*), 1000) AS design_rows FROM orders")
def l5(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    part = L.subsample(o, 1000, "o_orderkey", keep=True).count()
    full = L.subsample(o, 1000, "o_orderkey", keep=False).agg(F.count(F.lit(1)).alias("full_rows"))
    return full.withColumn("design_rows", F.lit(part).cast("bigint"))


@query(
    "l6_split",
    f"SELECT o_orderkey, CASE WHEN {duck_fraction('o_orderkey', 42)} < 0.25 THEN 'test' ELSE 'train' END AS part FROM orders",
)
def l6(spark, sf):
    train, test = L.split(table(spark, sf, "orders").select("o_orderkey"), 0.25, "o_orderkey", 42)
    return V.concat(train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")))


@query("l7_folds", f"SELECT o_orderkey, {duck_hash('o_orderkey', 0)} % 3 AS fold FROM orders")
def l7(spark, sf):
    return L.with_fold(table(spark, sf, "orders").select("o_orderkey"), 3, "o_orderkey").withColumn("fold", big("fold"))


@query("l8_cap_rows", f"SELECT o_orderkey FROM orders ORDER BY {duck_digest('o_orderkey', 0)} LIMIT 10000")
def l8(spark, sf):
    return L.cap_rows(table(spark, sf, "orders").select("o_orderkey"), 10_000, "o_orderkey")


# --- sets ------------------------------------------------------------------------------


@query(
    "v1_concat",
    "SELECT c_custkey AS id, c_acctbal AS bal, NULL AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name"
    " FROM supplier",
)
def v1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name")
    )
    return V.concat(c, s)


@query(
    "v2_union_distinct",
    "SELECT l_orderkey AS source, l_partkey AS target FROM lineitem UNION SELECT l_orderkey, l_suppkey FROM lineitem",
)
def v2(spark, sf):
    li = table(spark, sf, "lineitem")
    return V.union_distinct(
        li.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")),
        li.select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target")),
    )


# --- user-defined steps ----------------------------------------------------------------


@query("u1_apply_func", "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def u1(spark, sf):
    def with_nation(df, nations):
        return J.merge(df, nations, left_on="c_nationkey", right_on="n_nationkey").select(
            "c_custkey", "c_nationkey", "n_name"
        )

    return U.apply_func(table(spark, sf, "customer"), with_nation, nations=table(spark, sf, "nation"))


@query("u2_tap", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def u2(spark, sf):
    sink = fresh(spark, "tap")
    U.tap(table(spark, sf, "orders"), lambda d: A.group_count(d, "o_orderstatus", "n"), sink)
    return spark.read.parquet(sink)


@query("u3_observe_step", "SELECT count(*) AS row_count, 0::BIGINT AS nulls_o_custkey, count(DISTINCT o_custkey) AS seen FROM orders")
def u3(spark, sf):
    path = fresh(spark, "observed")
    df, seen = U.observe_step(table(spark, sf, "orders").select("o_custkey"), "orders_step")
    df.groupBy("o_custkey").count().write.parquet(path)
    got = seen.get
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("seen")).select(
        F.lit(got["row_count"]).cast("bigint").alias("row_count"),
        F.lit(got["nulls_o_custkey"]).cast("bigint").alias("nulls_o_custkey"), "seen",
    )


@query("u4_map_value", "SELECT p_partkey, length(p_name) * 2 AS twice FROM part")
def u4(spark, sf):
    return table(spark, sf, "part").select("p_partkey", U.map_value("p_name", lambda s: len(s) * 2, "bigint").alias("twice"))


@query(
    "u5_custom_aggregate",
    "SELECT o_custkey, round(sqrt(sum(o_totalprice * o_totalprice) / count(*)), 2) AS rms FROM orders GROUP BY 1",
)
def u5(spark, sf):
    p = F.col("o_totalprice")
    return U.agg_udf(
        table(spark, sf, "orders"), ["o_custkey"], "o_totalprice",
        {"ss": F.sum(p * p), "n": F.count(p)}, r(F.sqrt(F.col("ss") / F.col("n")), 2), "rms",
    )


@query("u6_map_batches", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents")
def u6(spark, sf):
    def count_lines(frame, mark):
        return frame.assign(n_lines=frame["text"].str.count(mark) + 1)[["doc_id", "n_lines"]]

    d = table(spark, sf, "documents").select("doc_id", "text")
    return U.map_batches(d, count_lines, "doc_id bigint, n_lines bigint", 256, resource=lambda: "\n")


@query("x9_fill_by_type", oracle_with("artworks") + " SELECT object_ID, coalesce(date, '') AS date FROM artworks")
def x9(spark, sf):
    return N.fill_by_type(view(spark, sf, "artworks").select("object_ID", "date"))
