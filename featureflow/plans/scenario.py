"""The three business scenarios as views over the given tables.

`VIEWS` is the text for Spark, `oracle_with` the same text as common table expressions
for DuckDB (integer division is the one difference in spelling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS = {
    "baskets": """
        SELECT o_orderkey AS ID, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS fraud_flag FROM orders""",
    "products": """
        SELECT l_orderkey AS basket_ID, l_linenumber AS line, p_type AS item, p_name AS model,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE p_brand END AS make,
               l_extendedprice AS cash_price, l_quantity AS qty
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "facts": """
        SELECT o_orderkey AS house_id, c_nationkey AS city_id, o_custkey AS image_id,
               o_orderkey % 6 AS bed, o_orderkey % 4 AS bath,
               CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0.0 WHEN o_orderkey % 89 = 0 THEN 90000.0
                    ELSE 500.0 + (o_orderkey * 37) % 4000 END AS DOUBLE) AS sqft, o_totalprice AS price
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "cities": "SELECT n_nationkey AS city_id, n_name AS city_name FROM nation",
    "images": "SELECT p_partkey AS image_id, concat('img/', p_name, '.jpg') AS image_path FROM part",
    "artworks": """
        SELECT doc_id AS object_ID, text AS description, lang AS culture,
               CASE doc_id % 4 WHEN 0 THEN 'Vase' WHEN 1 THEN 'vase ' WHEN 2 THEN 'VASE, painted'
                    ELSE 'Painted vase' END AS object_name,
               CASE doc_id % 8 WHEN 0 THEN concat(CAST(doc_id % 15 + 4 AS STRING), 'th century BCE')
                    WHEN 1 THEN CAST(1500 + doc_id % 400 AS STRING) WHEN 2 THEN '3rd–4th century'
                    WHEN 3 THEN 'early 18th century'
                    WHEN 4 THEN concat(CAST(1700 + doc_id % 100 AS STRING), '–', CAST(1800 + doc_id % 100 AS STRING))
                    WHEN 5 THEN '5th century b.c.' WHEN 6 THEN 'undated' ELSE NULL END AS date
        FROM documents""",
    "trials": """
        SELECT o_orderkey DIV 64 AS run_id, o_orderkey % 64 AS trial,
               CASE WHEN o_orderkey % 64 = 0 THEN NULL ELSE (o_orderkey % 64 - 1) DIV 2 END AS parent_trial,
               CASE o_orderkey % 3 WHEN 0 THEN 'brand' WHEN 1 THEN 'basket' ELSE 'agg' END AS operator,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round(o_totalprice / 500000.0, 4) END AS score
        FROM orders""",
    "run_events": """
        SELECT user_id AS run_id, event_id AS seq, ts, event_type AS type, value AS cost, props FROM events""",
}

#: Tables each view reads.
SOURCES = {
    "baskets": ["orders"], "products": ["lineitem", "part"], "facts": ["orders", "customer"], "cities": ["nation"],
    "images": ["part"], "artworks": ["documents"], "trials": ["orders"], "run_events": ["events"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, hints: dict[str, str] | None = None) -> DataFrame:
    """One scenario table; the view text runs over frames passed by name, no catalog state. `hints` are join hints by table."""
    frames = {t: table(spark, sf_dir, t) for t in SOURCES[name]}
    for t, hint in (hints or {}).items():
        frames[t] = frames[t].hint(hint)
    text = VIEWS[name]
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}} AS {t}")
    return spark.sql(text, **frames)


def oracle_with(*names: str) -> str:
    """`WITH ...` clause that defines the named views for DuckDB."""
    parts = [f"{n} AS ({VIEWS[n].replace(' DIV ', ' // ')})" for n in names]
    return "WITH " + ", ".join(parts)
