"""Checked queries for scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from featureflow.catalog.registry import query
from featureflow.catalog.relational import r
from featureflow.functions import dates as D
from featureflow.functions import numbers as N
from featureflow.functions import text as X
from featureflow.plans.scenario import oracle_with, table, view

PLAIN = f"lower(translate({{c}}, '{X.ACCENTED}', '{X.PLAIN}'))"
TOKENS = "regexp_extract_all(" + PLAIN + r", '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')"


@query("x1_normalize_text", "SELECT doc_id, md5(" + PLAIN.format(c="text") + ") AS normalized FROM documents")
def x1(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.normalize_text("text").cast("binary")).alias("normalized"))


STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


@query(
    "x2_x5_text_features",
    "SELECT doc_id, md5(array_to_string(t, '|')) AS tokens, len(t) AS word_count, list_has_any(t, " + STOP + ") AS has_stopwords,"
    " round(coalesce(list_sum(list_transform(t, lambda x: length(x))) / nullif(len(t), 0), 0), 6) AS avg_word_length"
    " FROM (SELECT doc_id, " + TOKENS.format(c="text") + " AS t FROM documents)",
)
def x25(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(F.array_join(X.tokens("text"), "|").cast("binary")).alias("tokens"),
        X.word_count("text").alias("word_count"),
        X.has_stopwords("text").alias("has_stopwords"),
        r(X.avg_word_length("text"), 6).alias("avg_word_length"),
    )


@query(
    "x6_x7_x8_numbers",
    oracle_with("facts") + " SELECT house_id, round(ln(1 + price), 6) AS log_price, round(bed / (bath + 1.0), 6) AS ratio1,"
    " round(price / nullif(sqft, 0), 1) AS price_per_sqft, round(price, 0) AS rounded FROM facts",
)
def x678(spark, sf):
    return view(spark, sf, "facts").select(
        "house_id", r(N.log1p("price"), 6).alias("log_price"), r(N.ratio("bed", "bath"), 6).alias("ratio1"),
        N.rounded(N.ratio("price", "sqft", plus=0), 1).alias("price_per_sqft"), N.rounded("price", 0).alias("rounded"),
    )


@query(
    "x10_join_distinct",
    "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '</?[a-z0-9]+'))), ', ') AS tags"
    " FROM pages",
)
def x10(spark, sf):
    tags = F.regexp_extract_all("html", F.lit("</?[a-z0-9]+"), F.lit(0))
    return table(spark, sf, "pages").select("page_id", X.join_distinct(tags).alias("tags"))


def date_sql(convention: str) -> str:
    """DuckDB text of the date rules over artworks."""
    k = 1 if convention == "ordinal" else 0

    def g(p: str, i: int) -> str:
        return f"regexp_extract(t, '{p}', {i})"

    def num(p: str, i: int) -> str:
        return f"TRY_CAST({g(p, i)} AS INTEGER)"

    def century(n: str, part: str, bce: str, end: bool) -> str:
        lo = f"CASE {part} WHEN 'mid' THEN 33 WHEN 'late' THEN 66 ELSE 0 END"
        hi = f"CASE {part} WHEN 'early' THEN 32 WHEN 'mid' THEN 65 ELSE 99 END"
        off = hi if end else lo
        return f"CASE WHEN {bce} THEN {n} * 100 - 1 + {k} - {off} ELSE ({n} - 1) * 100 + {k} + {off} END"

    return (
        oracle_with("artworks")
        + ", c AS (SELECT object_ID, trim(regexp_replace(regexp_replace(lower(date), '[–—−]', '-', 'g'), '\\s+', ' ', 'g')) AS t"
        " FROM artworks), p AS (SELECT *,"
        f" {num(D.CENTURY_PAIR, 2)} AS a1, {num(D.CENTURY_PAIR, 5)} AS a2, {g(D.CENTURY_PAIR, 1)} AS ap, {g(D.CENTURY_PAIR, 4)} AS bp,"
        f" {g(D.CENTURY_PAIR, 3)} AS ae, {g(D.CENTURY_PAIR, 6)} AS be,"
        f" {num(D.CENTURY, 2)} AS c1, {g(D.CENTURY, 1)} AS cp, {g(D.CENTURY, 3)} AS ce,"
        f" {num(D.YEAR_RANGE, 1)} AS r1, {num(D.YEAR_RANGE, 3)} AS r2, {g(D.YEAR_RANGE, 2)} AS re1, {g(D.YEAR_RANGE, 4)} AS re2,"
        f" {g(D.YEAR_RANGE, 1)} AS rs1, {g(D.YEAR_RANGE, 3)} AS rs2,"
        f" {num(D.DECADE, 1)} AS d1, {num(D.YEAR, 1)} AS y1, {g(D.YEAR, 2)} AS ye FROM c), q AS (SELECT *,"
        " be LIKE 'b%' AS bb, CASE WHEN ae = '' THEN be LIKE 'b%' ELSE ae LIKE 'b%' END AS ab, ce LIKE 'b%' AS cb,"
        " re2 LIKE 'b%' AS rb2, CASE WHEN re1 = '' THEN re2 LIKE 'b%' ELSE re1 LIKE 'b%' END AS rb1, ye LIKE 'b%' AS yb FROM p)"
        " SELECT object_ID,"
        f" CASE WHEN a2 IS NOT NULL THEN {century('a1', 'ap', 'ab', False)} WHEN c1 IS NOT NULL THEN {century('c1', 'cp', 'cb', False)}"
        " WHEN r2 IS NOT NULL THEN r1 WHEN d1 IS NOT NULL THEN d1 ELSE y1 END AS year_start,"
        " CASE WHEN a2 IS NOT NULL THEN ab WHEN c1 IS NOT NULL THEN cb WHEN r2 IS NOT NULL THEN rb1 WHEN d1 IS NOT NULL THEN false"
        " WHEN y1 IS NOT NULL THEN yb END AS start_is_bce,"
        f" CASE WHEN a2 IS NOT NULL THEN {century('a2', 'bp', 'bb', True)} WHEN c1 IS NOT NULL THEN {century('c1', 'cp', 'cb', True)}"
        " WHEN r2 IS NOT NULL THEN CASE WHEN length(rs2) < length(rs1) AND NOT rb1 AND NOT rb2"
        " THEN CAST(floor(r1 / pow(10, length(rs2))) * pow(10, length(rs2)) + r2 AS INTEGER) ELSE r2 END"
        " WHEN d1 IS NOT NULL THEN d1 + 9 END AS year_end,"
        " CASE WHEN a2 IS NOT NULL THEN bb WHEN c1 IS NOT NULL THEN cb WHEN r2 IS NOT NULL THEN rb2 WHEN d1 IS NOT NULL THEN false"
        " END AS end_is_bce FROM q"
    )


def _dates(convention):
    def run(spark, sf):
        parsed = D.parse_date_interval("date", convention)
        return view(spark, sf, "artworks").select("object_ID", parsed.alias("d")).select("object_ID", "d.*")

    return run


query("x11_dates_ordinal", date_sql("ordinal"))(_dates("ordinal"))
query("x11_dates_zero_based", date_sql("zero_based"))(_dates("zero_based"))


CODE = (
    r"""^((?:[^#"''\\]+|\\.|"[^"\\]*(?:\\.[^"\\]*)*(?:"|$)|''[^''\\]*(?:\\.[^''\\]*)*(?:''|$))*)#.*$"""
)
SCRIPT = """text || chr(10) || '  # note ' || source || chr(10) || 'x = "#' || lang || '"  # tail' || chr(10) || '    y = 1  '"""
NORMAL = (
    "array_to_string(list_filter(list_transform(string_split(script, chr(10)), lambda x: regexp_replace(regexp_replace(x, '"
    + CODE + r"', '\1'), '\s+$', '')), lambda x: length(x) > 0), chr(10))"
)


def scripts(spark, sf):
    nl = F.lit("\n")
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "n_chars",
        F.concat(
            "text", nl, F.lit("  # note "), "source", nl, F.lit('x = "#'), "lang", F.lit('"  # tail'), nl, F.lit("    y = 1  ")
        ).alias("script"),
    )


@query(
    "x12_x13_x14_fingerprint",
    "SELECT doc_id, md5(n) AS normalized, substring(sha256(n || '|' || CASE WHEN n_chars > 1000 THEN printf('%.2f',"
    " (n_chars // 10) / 100.0) ELSE 'none' END || '|' || lower(trim(' ' || lang))), 1, 16) AS fingerprint FROM"
    f" (SELECT doc_id, lang, n_chars, {NORMAL} AS n FROM (SELECT doc_id, lang, n_chars, {SCRIPT} AS script FROM documents))",
)
def x1214(spark, sf):
    temp = F.when(F.col("n_chars") > 1000, F.floor(F.col("n_chars") / 10) / 100.0)
    name = F.concat(F.lit(" "), F.upper("lang"))
    return scripts(spark, sf).select(
        "doc_id",
        F.md5(X.normalize_script("script").cast("binary")).alias("normalized"),
        X.fingerprint("script", X.normalize_number(temp), X.normalize_name(name)).alias("fingerprint"),
    )


@query(
    "x15_finite",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS a,"
    " CASE WHEN l_tax = 0 THEN NULL ELSE round(l_quantity / l_tax, 6) END AS b FROM lineitem",
)
def x15(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.struct(
            F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_tax", "l_discount")).alias("a"),
            F.array(F.when(F.col("l_tax") == 0, F.lit(float("-inf"))).otherwise(F.try_divide("l_quantity", "l_tax"))).alias("b"),
        ).alias("s"),
    )
    clean = N.finite_frame(li)
    return clean.select("l_orderkey", "l_linenumber", r("s.a", 6).alias("a"), r(F.col("s.b")[0], 6).alias("b"))


@query(
    "x16_code_block",
    "SELECT event_id, event_type AS code, value AS cost_usd, greatest(CAST(json_extract(props, '$.k') AS BIGINT) - 50, 1)"
    " AS attempts FROM events",
)
def x16(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint") - 50
    by_type = F.when(F.col("event_type") == "click", F.struct(k.alias("attempts"), F.lit(None).cast("bigint").alias("retries")))
    by_type = by_type.otherwise(F.struct(F.lit(None).cast("bigint").alias("attempts"), k.alias("retries")))
    body = F.to_json(F.struct(F.col("event_type").alias("code"), F.col("value").alias("cost_usd"), by_type["attempts"].alias("attempts"), by_type["retries"].alias("retries")))
    e = table(spark, sf, "events").select("event_id", X.parse_code_block(body).alias("b"))
    return e.select("event_id", "b.code", "b.cost_usd", "b.attempts")


@query("x17_quoted_name", "SELECT c_custkey, nullif(regexp_extract('<Var ''' || c_name || '''>', '''([^'']*)''', 1), '') AS name FROM customer")
def x17(spark, sf):
    label = F.concat(F.lit("<Var '"), F.col("c_name"), F.lit("'>"))
    return table(spark, sf, "customer").select("c_custkey", X.quoted_name(label).alias("name"))


LABELS = (
    "CASE l_linenumber % 6 WHEN 0 THEN '<Apply LearnedImputer>' WHEN 1 THEN 'Apply CAAFE ' || l_returnflag WHEN 2 THEN"
    " '<Apply RandomForestClassifier>' WHEN 3 THEN 'sem_choose' WHEN 4 THEN '<Apply SelectCols>' ELSE 'filter ' || l_linestatus END"
)


def labels(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{LABELS} AS label")


@query(
    "x18_map_label",
    f"SELECT l_orderkey, l_linenumber, CASE WHEN contains(lower(label), 'learnedimputer') THEN 'sem_fillna'"
    " WHEN contains(lower(label), 'caafe') THEN 'sem_gen_features' WHEN contains(lower(label), 'selectcols') THEN 'sem_select'"
    " WHEN contains(lower(label), 'randomforestclassifier') THEN 'apply_with_sem_choose' ELSE label END AS operator"
    f" FROM (SELECT l_orderkey, l_linenumber, {LABELS} AS label FROM lineitem)",
)
def x18(spark, sf):
    return labels(spark, sf).select("l_orderkey", "l_linenumber", X.map_label("label").alias("operator"))


@query(
    "x19_is_semantic",
    f"SELECT l_orderkey, l_linenumber, l_linenumber % 6 IN (0, 1, 2, 3) AS semantic FROM lineitem",
)
def x19(spark, sf):
    return labels(spark, sf).select("l_orderkey", "l_linenumber", X.is_semantic("label").alias("semantic"))


@query(
    "x20_maps_to_edges",
    "SELECT o_custkey AS graph_id, 'o' || o_orderkey AS source, x AS target FROM orders, unnest(['p' || (o_orderkey + 1),"
    " 'q' || o_custkey]) AS u(x) UNION SELECT o_custkey, 's' || o_orderstatus, 'o' || o_orderkey FROM orders",
)
def x20(spark, sf):
    o = F.concat(F.lit("o"), F.col("o_orderkey"))
    kids = F.create_map(o, F.array(F.concat(F.lit("p"), F.col("o_orderkey") + 1), F.concat(F.lit("q"), F.col("o_custkey"))))
    up = F.create_map(o, F.array(F.concat(F.lit("s"), F.col("o_orderstatus"))))
    g = table(spark, sf, "orders").select(F.col("o_custkey").alias("graph_id"), kids.alias("children"), up.alias("parents"))
    return X.maps_to_edges(g, "graph_id", "parents", "children")


@query("x9_fill_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN 0 ELSE l_tax END AS tax,"
       " coalesce(CASE WHEN l_tax > 0.04 THEN NULL ELSE l_linestatus = 'O' END, false) AS flag FROM lineitem")
def x9b(spark, sf):
    low = F.col("l_tax") <= 0.04
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(low, F.col("l_tax")).alias("tax"), F.when(low, F.col("l_linestatus") == "O").alias("flag")
    )
    return N.fill_by_type(li)


