"""Paths for hot groups and large results give the same rows as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from featureflow.functions.hashing import key_digest
from featureflow.lineage.graphs import producer_edges
from featureflow.models.prep import LabelCodec
from featureflow.operators import aggs
from featureflow.operators import windows as W
from featureflow.operators.joins import align_by_occurrence
from featureflow.operators.quantiles import exact_quantiles
from featureflow.operators.sampling import hash_top_n, sample_n
from featureflow.semantic.distill import SemDistill

HOT = {"hot_rows": 10, "chunk_rows": 7}


@pytest.fixture(scope="module")
def rows(spark):
    """300 rows; one key holds a third, some values repeat, some are null."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(300):
        k = "hot" if i % 3 == 0 else f"k{i % 17}"
        v = None if i % 11 == 0 else float(rng.integers(0, 6))
        data.append((i, k, v, "abc"[int(rng.integers(0, 3))]))
    return spark.createDataFrame(data, "id int, k string, v double, c string").persist()


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_running_in_chunks(rows):
    what = {"n": ("count", F.lit(1)), "s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}
    plain = W.running(rows, ["k"], ["id"], what)
    assert as_set(plain) == as_set(W.running(rows, ["k"], ["id"], what, **HOT))
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    direct = rows.select("*", F.count(F.lit(1)).over(w), F.sum("v").over(w), F.max("v").over(w), F.last("v", True).over(w))
    assert as_set(plain) == as_set(direct)


def test_last_of_run_in_chunks(rows):
    plain = as_set(W.last_of_run(rows, ["k"], ["id"], "c"))
    assert plain == as_set(W.last_of_run(rows, ["k"], ["id"], "c", **HOT))
    by_key = {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        by_key.setdefault(r["k"], []).append(r)
    want = 0
    for group in by_key.values():
        want += sum(1 for a, b in zip(group, [*group[1:], None]) if b is None or a["c"] != b["c"])
    assert len(plain) == want


def test_producers_and_alignment_in_chunks(rows):
    refs = rows.select(
        F.lit(1).alias("graph_id"), F.col("id").alias("pos"), F.col("id").alias("node"), F.col("k").alias("var"),
        F.when(F.col("c") == "a", "produces").otherwise("consumes").alias("role"),
    )
    assert as_set(producer_edges(refs)) == as_set(producer_edges(refs, **HOT))
    a, b = rows.select("k", "id"), rows.select("k", F.col("id").alias("j"))
    assert as_set(align_by_occurrence(a, b, "k", ["id"], ["j"])) == as_set(align_by_occurrence(a, b, "k", ["id"], ["j"], **HOT))


def test_global_position_and_rank(rows):
    got = {r["id"]: r["_pos"] for r in W.global_position(rows, ["v", "id"]).collect()}
    order = sorted(rows.collect(), key=lambda r: (r["v"] is None, r["v"] or 0, r["id"]))
    assert [got[r["id"]] for r in order] == list(range(300))
    assert as_set(W.rank_desc(rows, "v")) == as_set(W.rank_desc(rows, "v", bound=5).select("id", "k", "v", "c", "rank"))


def test_ntile_with_ties_and_nulls(rows):
    got = W.ntile_global(rows, 7, "v", "id", "t").select("id", "t")
    want = rows.select("id", F.ntile(7).over(Window.orderBy(F.col("v").asc_nulls_last(), "id")).alias("t"))
    assert as_set(got) == as_set(want)


@pytest.mark.parametrize("small,accuracy", [(50_000, 20_000), (10, 50)])
def test_quantiles(rows, small, accuracy):
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    out = {r["k"]: r for r in exact_quantiles(rows, ["k"], "v", probs, accuracy, small).collect()}
    groups = {}
    for r in rows.collect():
        if r["v"] is not None:
            groups.setdefault(r["k"], []).append(r["v"])
    for k, values in groups.items():
        assert np.allclose([out[k][n] for n in probs], np.quantile(values, list(probs.values())))


def test_quantiles_of_a_hot_group_in_chunks(spark):
    """One group holds nearly all of many distinct values: its cells are ranked in chunks."""
    df = spark.range(60_000).selectExpr("CASE WHEN id % 50 = 0 THEN 'cold' ELSE 'hot' END AS k", "cast((id * 7919) % 60013 AS double) + 0.5 AS v")
    probs = {"a": 0.01, "b": 0.5, "c": 0.93}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy=50, small_group=10, hot_cells=500).collect()}
    values = {"hot": [], "cold": []}
    for i in range(60_000):
        values["cold" if i % 50 == 0 else "hot"].append((i * 7919) % 60013 + 0.5)
    for k, own in values.items():
        assert np.allclose([got[k][n] for n in probs], np.quantile(own, list(probs.values())))


def test_many_classes_stay_in_a_table(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 11 = 0 THEN NULL ELSE concat('c', (id * 37) % 500) END AS c", "id")
    codec, plain = LabelCodec("c", inline=100).fit(df), LabelCodec("c").fit(df)
    assert codec.classes is None and len(plain.classes) == codec.size
    more = df.unionByName(spark.createDataFrame([("new", -1), (None, -2)], "c string, id long"))
    a, b = codec.encode(more), plain.encode(more)
    assert as_set(a.select("id", "label")) == as_set(b.select("id", "label"))
    assert as_set(codec.decode(a, "label", "d").select("id", "d")) == as_set(plain.decode(b, "label", "d").select("id", "d"))


def test_quantiles_over_distinct_values(spark):
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).cast("double").alias("v"))
    values = np.array([(i * 7919) % 20_011 for i in range(20_000)], dtype=float)
    got = exact_quantiles(df, [], "v", {"q": 0.25, "r": 0.777}, accuracy=100, small_group=10).first()
    assert np.allclose([got["q"], got["r"]], np.quantile(values, [0.25, 0.777]))


@pytest.mark.parametrize("n", [0, 1, 57, 299, 300, 500])
def test_hash_top_n(rows, n):
    got = sorted(r["id"] for r in hash_top_n(rows, n, "id", 9).collect())
    order = [r["id"] for r in rows.orderBy(key_digest("id", 9)).collect()]
    assert got == sorted(order[:n])
    assert sorted(r["id"] for r in sample_n(rows, n, "id", 9).collect()) == got


def test_top_per_group_cut_before_the_shuffle(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS k", "CASE WHEN id % 11 = 0 THEN NULL ELSE hash(id) % 5000 END AS v", "id")
    for k in (1, 40, 3000):
        want = as_set(W.top_per_group(df, ["k"], k, ["v", "id"]))
        assert as_set(W.top_per_group(df, ["k"], k, ["v", "id"], small=0)) == want and len(want) == 3 * k


@pytest.mark.parametrize("kind", ["double", "bigint", "date", "string", "timestamp"])
@pytest.mark.parametrize("sign", ["", "-"])
def test_cut_by_descending_orders_and_texts(spark, kind, sign):
    value = {"double": "cast(v AS double)", "bigint": "v - 2500L", "date": "date_add(DATE'2000-01-01', v)", "string": "concat(CASE WHEN v % 2 = 0 THEN 'é' ELSE 'prefix ' END, v)",
             "timestamp": "timestamp_seconds(v * 1000)"}[kind]
    df = spark.range(40_000).selectExpr("id % 3 AS k", "CASE WHEN id % 11 = 0 THEN NULL ELSE abs(hash(id)) % 5000 END AS v", "id").selectExpr("k", f"{value} AS o", "id")
    cut = W._cut_by_order(df, ["k"], 40, W._as_number(df, f"{sign}o"))
    assert kind == "string" or cut.count() < 20_000
    want = Window.partitionBy("k").orderBy(F.col("o").desc_nulls_last() if sign else F.col("o").asc_nulls_last(), "id")
    plain = df.withColumn("n", F.row_number().over(want)).where("n <= 40").drop("n")
    assert as_set(W.top_per_group(df, ["k"], 40, [f"{sign}o", "id"], small=0)) == as_set(plain)


def test_rank_of_many_equal_values(spark):
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL ELSE id % 40 END AS v")
    want = as_set(W.rank_desc(df, "v"))
    assert as_set(W.rank_desc(df, "v", bound=100).select("id", "v", "rank")) == want  # counted values in one window
    assert as_set(W.rank_desc(df, "v", bound=7).select("id", "v", "rank")) == want  # in chunks


def test_top_per_group_salted(rows):
    got = W.top_per_group(rows, ["k"], 5, ["id"])
    w = Window.partitionBy("k").orderBy("id")
    want = rows.withColumn("n", F.row_number().over(w)).where("n <= 5").drop("n")
    assert as_set(got) == as_set(want)


def test_distill_is_exact(rows):
    out = SemDistill(40, "id", ["k"]).distill(rows)
    assert out.count() == 40 and out.select("id").distinct().count() == 40
    assert out.where("k = 'hot'").count() in (13, 14)


@pytest.mark.parametrize("accuracy", [10, 100, 1000, 20_000])
def test_quantiles_of_all_sizes(spark, accuracy):
    import numpy as np

    rnd = np.random.default_rng(9)
    rows = []
    for n in (1, 2, 3, 5, 17, 40, 99, 101, 400, 1003, 5000):
        rows += [(f"even{n}", float(x)) for x in rnd.normal(size=n)]
        rows += [(f"skew{n}", float(x)) for x in np.exp(3 * rnd.normal(size=n))]
        rows += [(f"ties{n}", float(x)) for x in rnd.integers(0, 4, size=n)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.777, "e": 0.99, "f": 1.0}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    for r in exact_quantiles(df, ["k"], "v", probs, accuracy, small_group=1).collect():
        for name, p in probs.items():
            assert abs(r[name] - np.quantile(by[r["k"]], p)) < 1e-9, (r["k"], name)
    whole = exact_quantiles(df, [], "v", probs, accuracy, small_group=1).first()
    assert all(abs(whole[n] - np.quantile([v for _, v in rows], p)) < 1e-9 for n, p in probs.items())


def test_modes_of_small_groups_are_one_aggregate_and_equal_the_cells(spark, monkeypatch):
    rows = [(i % 7 if i % 10 else None, [None, "b", "a", "", "ü"][i * i % 5], [None, True][i % 2], float(i)) for i in range(300)]
    rows += [(7, None, None, 1.0), (8, "z", None, None), (8, "y", None, None), (9, "B", None, 2.0), (9, "a", None, 2.0)]
    df = spark.createDataFrame(rows, "k int, t string, b boolean, x double")
    whole = aggs.agg_features(df, "k", ["x"], ["t", "b"], nunique=True)
    monkeypatch.setattr(aggs, "WHOLE_GROUP", 0)
    cells = aggs.agg_features(df, "k", ["x"], ["t", "b"], nunique=True)
    assert whole.schema.simpleString() == cells.schema.simpleString()
    assert sorted(whole.collect()) == sorted(cells.collect()) and whole.count() == 10
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan(cells) and "Generate" not in plan(whole)
    # a feature that nobody selects is not worked out
    assert "mode(" not in plan(whole.select("k", "x_sum"))


def test_aggregates_are_scored_from_one_written_copy(spark, monkeypatch):
    from featureflow.semantic import aggregate

    ids = spark.createDataFrame([(i, 3.0 * i) for i in range(20)], "ID long, y double")
    child = spark.createDataFrame([(i, float(i), "abc"[i * i % 3]) for i in range(20)], "k long, x double, t string")
    plans, score = [], aggregate.score_candidates
    monkeypatch.setattr(aggregate, "score_candidates", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or score(df, *a))
    out = aggregate.SemAggFeatures("ID", "k", how_many=1, y="y").fit_transform(ids, child=child)
    assert len(plans) == 1 and "Aggregate" not in plans[0] and "Join" not in plans[0]
    assert len(out.columns) == 3 and out.count() == 20
