"""Null, tie, text and date rules on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from featureflow.functions import dates as D
from featureflow.functions import numbers as N
from featureflow.functions import text as X
from featureflow.lineage import graphs as K
from featureflow.lineage import trajectories as TR
from featureflow.operators import aggs as A
from featureflow.operators import columns as C
from featureflow.operators import filters as FL
from featureflow.operators import joins as J
from featureflow.operators import sampling as L
from featureflow.sources import documents as DOC
from featureflow.sources import logs as LOG
from featureflow.sources import tables as S


def one(spark, c, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(c.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,convention,want",
    [
        ("5th century BCE", "ordinal", (500, True, 401, True)),
        ("1500", "ordinal", (1500, False, None, None)),
        ("5th century", "zero_based", (400, False, 499, False)),
        ("3rd–4th century", "zero_based", (200, False, 399, False)),
        ("5th century b.c.", "zero_based", (499, True, 400, True)),
        ("early 18th century", "zero_based", (1700, False, 1732, False)),
        ("late 2nd century BC", "ordinal", (134, True, 101, True)),
        ("300–200 BCE", "ordinal", (300, True, 200, True)),
        ("100 BCE–50 CE", "ordinal", (100, True, 50, False)),
        ("1880–85", "ordinal", (1880, False, 1885, False)),
        ("1850s", "ordinal", (1850, False, 1859, False)),
        ("undated", "ordinal", (None,) * 4),
        (None, "ordinal", (None,) * 4),
    ],
)
def test_dates(spark, text, convention, want):
    assert tuple(one(spark, D.parse_date_interval("x", convention), text)) == want
    df = spark.createDataFrame([(text,)], "x string")
    fields = ["year_start", "start_is_bce", "year_end", "end_is_bce"]
    assert tuple(D.with_date_interval(df, "x", dict(zip(fields, "abcd")), convention).drop("x").first()) == want


def test_fingerprint(spark):
    base = "a = 1\nif a:\n    b = '#x'"
    same = ["a = 1   \n\nif a:  # note\n    b = '#x'", "# head\na = 1\nif a:\n    b = '#x' # tail\n"]
    other = ["a = 1\nif a:\n  b = '#x'", "a = 1\nif a:\n    b = '#y'"]
    fp = {s: one(spark, X.fingerprint("x"), s) for s in [base, *same, *other]}
    assert len({fp[s] for s in [base, *same]}) == 1 and len(set(fp.values())) == 3 and len(fp[base]) == 16
    assert one(spark, X.normalize_number(F.col("x")), None, "double") == "none"
    assert one(spark, X.normalize_number(F.col("x")), 0.504, "double") == "0.50"
    assert one(spark, X.normalize_name("x"), " GPT ") == "gpt"
    long_line = "x = '" + "a#" * 50_000 + "' # end"
    assert one(spark, X.normalize_script("x"), long_line) == long_line[:-6]


def test_text(spark):
    assert one(spark, X.normalize_text("x"), "Éclair À LA") == "eclair a la"
    assert one(spark, X.normalize_text("x", full=True), "Éclair") == "eclair"
    assert one(spark, X.tokens("x"), "It's 2, ok") == ["it", "'", "s", "2", ",", "ok"]
    assert one(spark, X.avg_word_length("x"), "") == 0.0
    assert one(spark, X.avg_word_length("x"), None) is None
    assert one(spark, X.map_label("x"), "<Apply SemSelectLLM>") == "sem_select"
    assert one(spark, X.map_label("x"), "filter rows") == "filter rows"


def test_numbers(spark):
    df = spark.createDataFrame([(1.0, None, None, None), (float("nan"), "a", True, 2)], "d double, s string, b boolean, i int")
    assert [tuple(r) for r in N.fill_by_type(df).collect()] == [(1.0, "", False, 0), (0.0, "a", True, 2)]
    assert one(spark, N.ratio("x", F.lit(0), plus=0), 3.0, "double") is None
    nested = spark.createDataFrame([([1.0, float("inf")],)], "a array<double>")
    assert N.finite_frame(nested).first()["a"] == [1.0, None]


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", True)], "i int, s string, b boolean")
    with pytest.raises(KeyError):
        C.drop_columns(df, ["nope"])
    assert C.drop_columns(df, ["nope", "i"], "ignore").columns == ["s", "b"]
    assert C.cols_of(df, "numeric") == ["i"] and C.cols_except(df, "s") == ["i", "b"]
    assert C.marked(C.mark(df, ["i"], "b", "d").where("i > 0"), "y") == ["b"]
    import numpy as np

    assert C.as_frame(np.zeros((3, 2)), spark).count() == 3
    assert C.as_frame({"a": 1}, spark) is None and C.as_frame("text") is None


def test_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    assert J.merge(a, b, on="k").columns == ["k", "v_x", "v_y"]
    assert J.merge(a, b, on="k").count() == 1 and J.merge(a, b, on="k", null_safe=True).count() == 2
    assert FL.keep_in(a, "k", b, "k").count() == 1 and FL.keep_in(a, "k", b, "k", True).count() == 2
    assert A.group_count(a, "k").count() == 1


def test_moments_guard(spark):
    rows = [("a", 1.0)] + [("b", float(x)) for x in (1, 2)] + [("c", float(x)) for x in (1, 2, 4)]
    rows += [("d", float(x)) for x in (1, 2, 4, 8)] + [("e", 3.0)] * 5
    got = {r["k"]: r for r in A.group_stats(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got["a"]["price_skew"] == 0 and got["b"]["price_skew"] == 0 and got["c"]["price_skew"] > 0
    assert got["c"]["price_kurtosis"] == 0 and got["d"]["price_kurtosis"] is not None
    assert got["e"]["price_skew"] is None and got["e"]["price_kurtosis"] is None


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.4)] * 3, "y double, p double, s double")
    m = A.metrics(df, "y", "p", "s").first()
    assert m["accuracy"] == 1.0 and m["f1_macro"] == 1.0 and m["roc_auc"] is None
    assert A.regression_metrics(df, "y", "p").first()["r2"] is None


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(1000)
    train, test = L.split(df, 0.25, "id")
    assert train.intersect(test).count() == 0 and train.count() + test.count() == 1000
    again = L.split(df.repartition(7), 0.25, "id")[1]
    assert sorted(again.collect()) == sorted(test.collect())


def test_blocks(spark):
    log = (
        'start\n##RUNNER_NODE_CODE##\n{"index": 0, "code": "x", "retries": 0, "node_id": "7"}\n##END##\nnoise\n'
        '##NODE_PREVIEW##\n{"node_id": "1", "row_count": 3}\n##END##\n##VAR_PREVIEW##\n{"row_count": 3}\n##END##\n'
        '##EXECUTION_STATS##\n{"duration_ms": 5}\n##END##\n##NODE_CODE##\n{broken\n##END##'
    )
    out = LOG.parse_marked_blocks(spark.createDataFrame([(log,)], "t string"), "t").collect()
    assert [r["kind"] for r in out] == ["NODE_CODE", "NODE_PREVIEW", "EXECUTION_STATS"]
    b = one(spark, X.parse_code_block("x"), out[0]["json"])
    assert b["attempts"] == 1 and b["node_id"] == "7"


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text('x\n##GRAPH##\n{"nodes": [{"id": "1"}], "parents": {"2": ["1"]}}\n##END##\ny\n##NODE_CODE##\n{"code": "z"}\n##END##\n')
    got = LOG.read_log_blocks(spark, str(tmp_path))
    assert sorted(r["kind"] for r in got.collect()) == ["GRAPH", "NODE_CODE"]


def test_log_files_cut_off(spark, tmp_path):
    block = '##NODE_CODE##\n{"code": "%s"}\n##END##\n'
    (tmp_path / "a.log").write_text("x\n" + block % "a" + "noise ##END##\n" + block % "b" + '##NODE_CODE##\n{"code": "c"}\n')
    (tmp_path / "b.log").write_text((block % "d" + block % "e").rstrip("\n"))
    (tmp_path / "c.log").write_text("##NODE_CODE##\n{broken\n##END##\n" + block % "f")
    got = [(r["file_path"][-5:], r["position"], r["fields"]["code"]) for r in LOG.read_log_blocks(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a.log", 0, "a"), ("a.log", 1, "b"), ("b.log", 0, "d"), ("b.log", 1, "e"), ("c.log", 1, "f")]


def test_indented_documents_take_the_name_of_their_file(spark, tmp_path):
    import json

    doc = {"outcomes": [{"search_node": {"trial": i, "parent_trial": None if not i else 0, "operator_to_evolve": "op"}, "score": 0.5 + i / 10} for i in range(3)]}
    for name in ("first", "second"):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    t = TR.explode_outcomes(DOC.read_trajectories(spark, str(tmp_path)))
    assert sorted({r["run_id"] for r in t.collect()}) == ["first", "second"] and t.count() == 6
    assert sorted((r["run_id"], r["trial"]) for r in TR.best_path(t).collect()) == [("first", 0), ("first", 2), ("second", 0), ("second", 2)]


def test_documents_of_all_runs_take_the_name_of_their_folder(spark, tmp_path):
    text = '{\n  "outcomes": [{"search_node": {"trial": 0},\n  "score": 0.5}]\n}'
    names = [f"run-{i}" for i in range(12)] + ["a b:c%2B+d"]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(n, text) for n in names], "run string, value string").write.partitionBy("run").text(path)
    got = TR.explode_outcomes(DOC.read_trajectories(spark, path)).collect()
    assert sorted(r["run_id"] for r in got) == sorted(names) and {(r["trial"], r["score"]) for r in got} == {(0, 0.5)}


def test_written_documents_lie_as_spark_lays_them_out_one_file_each(spark, tmp_path, monkeypatch):
    texts = {"run-1": "{\n}", 'a b:c%2B+d"#\'*/=?\\x{[]^\x01\x7f': "Zürich\n 2", "": "e", None: "n", "v": None}
    docs = spark.createDataFrame(list(texts.items()), "run string, value string")
    mine, sparks = tmp_path / "mine", tmp_path / "sparks"
    docs.write.partitionBy("run").option("compression", "none").text(str(sparks))

    def files(root):
        return {(p.parent.name, p.read_text()) for p in root.rglob("*.txt")}

    monkeypatch.setattr("pyspark.sql.DataFrame.write", property(lambda df: pytest.fail("the writer of Spark forks for each file")))
    DOC.write_documents(docs.where("run IS NOT NULL AND run <> ''"), f"file://{mine}", "run")
    # Spark joins the rows of a folder, here '' and NULL share one
    named = {f for f in files(sparks) if "__HIVE" not in f[0]}
    assert files(mine) == named and len(named) == 3 and len(list(mine.rglob("*.*"))) == 3
    DOC.write_documents(docs.where("run IS NULL"), str(tmp_path / "null"), "run")
    assert files(tmp_path / "null") == {("run=__HIVE_DEFAULT_PARTITION__", "n\n")}


def test_trajectory_files(spark, tmp_path):
    import json

    doc = {
        "run_id": "r", "some_config": {"llm_for_code_generation": {"name": "v/m", "parameters": {"temperature": 0.2}}},
        "outcomes": [
            {"search_node": {"trial": 0, "parent_trial": None, "operator_to_evolve": None}, "score": 0.75, "state": {"generated_code": "a"}},
            {"search_node": {"trial": 1, "parent_trial": 0, "operator_to_evolve": "op"}, "score": 0.82, "state": {"generated_code": ["b", "c"]}},
            {"search_node": {"trial": None}, "score": 1.0},
        ],
    }
    (tmp_path / "one.json").write_text(json.dumps(doc))
    (tmp_path / "two.json").write_text(json.dumps(json.dumps({**doc, "run_id": "s"})))
    (tmp_path / "three.json").write_text("[1, 2]")
    (tmp_path / "four.json").write_text("{oops")
    t = DOC.read_trajectories(spark, str(tmp_path))
    assert sorted(r["run_id"] for r in t.collect()) == ["r", "s"]
    assert [r["label"] for r in A.distinct_options(t).collect()] == ["m (t=0.2)"]
    trials = TR.explode_outcomes(t)
    assert trials.count() == 4 and trials.where("trial = 0").first()["operator"] == "root"
    assert trials.where("trial = 1").first()["code"] == {"0": "b", "1": "c"}
    best = TR.best_path(trials)
    assert sorted((r["run_id"], r["trial"]) for r in best.collect()) == [("r", 0), ("r", 1), ("s", 0), ("s", 1)]


def graph(spark, n, edges):
    nodes = spark.createDataFrame([(1, i, "op", f"l{i}") for i in n], "graph_id int, id int, type string, label string")
    return nodes, spark.createDataFrame([(1, a, b) for a, b in edges], "graph_id int, source int, target int")


def test_contract(spark):
    nodes, edges = graph(spark, range(5), [(0, 1), (1, 2), (2, 3), (3, 4)])
    kept, short = K.contract(nodes, edges, nodes.where("id IN (1, 2, 3)"))
    assert sorted(r["id"] for r in kept.collect()) == [0, 4]
    assert [(r["source"], r["target"]) for r in short.collect()] == [(0, 4)]


def test_cycles_and_levels(spark):
    nodes, edges = graph(spark, range(5), [(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (2, 2)])
    assert not K.acyclic(nodes, edges).first()["is_acyclic"]
    got = {r["id"]: r["level"] for r in K.levels(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: None, 4: None}
    only_self = graph(spark, range(2), [(0, 0), (0, 1)])
    assert K.acyclic(*only_self).first()["is_acyclic"]
    errors = K.validate_graphs(nodes, edges.unionByName(edges.limit(1).select("graph_id", F.lit(0).alias("source"), F.lit(9).alias("target"))))
    assert [r["error"] for r in errors.collect()] == ["target not in nodes"]
    assert [r["error"] for r in K.validate_graphs(nodes, edges).collect()] == ["cycle"]


def test_prune(spark):
    nodes, edges = graph(spark, range(5), [(0, 1), (1, 2), (0, 3)])
    final = spark.createDataFrame([(1, 2)], "graph_id int, id int")
    kept, left = K.prune(nodes, edges, final)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2] and left.count() == 2


def test_components_of_a_long_chain(spark):
    nodes, edges = graph(spark, range(200), [(i, i + 1) for i in range(149)])
    got = K.connected_components(nodes, edges).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 50 + [150]


def test_merge_missing_edges(spark):
    run = spark.createDataFrame([(1, "a", "clean"), (1, "in_0", "fit")], "graph_id int, id string, label string")
    run_e = spark.createDataFrame([(1, "a", "in_0")], "graph_id int, source string, target string")
    plan = spark.createDataFrame([(1, "p0", "var", 0), (1, "p1", "sub", 1), (1, "p2", "clean", 2)], "graph_id int, id string, label string, pos int")
    plan_e = spark.createDataFrame([(1, "p0", "p1"), (1, "p1", "p2")], "graph_id int, source string, target string")
    n, e = K.merge_missing(run, run_e, plan, plan_e)
    assert sorted(r["id"] for r in n.collect()) == ["a", "in_0", "in_1", "in_2"]
    assert sorted((r["source"], r["target"]) for r in e.collect()) == [("a", "in_0"), ("in_1", "in_2"), ("in_2", "a")]


def test_result_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "cache_key string, operation string, v int")
    S.write_results(rows, path)
    assert S.archive_results(spark, path, "a") == 1
    assert [r["cache_key"] for r in S.list_keys(spark, path).collect()] == ["b"]
    S.write_results(rows.where("cache_key = 'a'"), path)
    assert S.archive_results(spark, path, "a") == 2
    assert S.read_archive(spark, path, "a").count() == 2 and S.read_results(spark, path).count() == 1


def test_child_rows_follow_only_after_keep_in(spark):
    baskets = spark.range(100).withColumnRenamed("id", "ID")
    products = spark.range(200).select((F.col("id") % 100).alias("basket_ID"))
    for n in (5, 10, 25, 50, 75):
        few = L.sample_n(baskets, n, "ID", 1)
        assert few.count() == n and products.count() == 200
        assert FL.keep_in(products, "basket_ID", few, "ID").count() == 2 * n


def test_vectorless_log1p(spark):
    assert math.isclose(one(spark, N.log1p("x"), "3"), math.log(4))


def test_describe_frame(spark):
    got = A.describe_frame(spark.range(12).select("id", F.lit(None).cast("string").alias("s"))).first()
    assert got["row_count"] == 12 and len(got["sample"]) == 5 and got["sample"][0]["s"] is None
    assert [f["name"] for f in got["schema"]] == ["id", "s"]


def test_levels_by_brute_force(spark):
    import random

    rnd = random.Random(11)
    nodes, edges, want = [], [], {}
    for g in range(12):
        n = rnd.randrange(1, 25)
        own = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(0, 40))}
        if g % 3:  # without cycles
            own = {(min(a, b), max(a, b)) for a, b in own}
        if g % 4 == 1:
            own.add((99, 0))  # an unknown source
        nodes += [(g, i) for i in range(n)]
        edges += [(g, a, b) for a, b in own]
        level, open_ = {}, {i: {a for a, b in own if b == i and a != b} for i in range(n)}
        while ready := [i for i in open_ if i not in level and all(a in level for a in open_[i])]:
            for i in ready:
                level[i] = max((level[a] + 1 for a in open_[i]), default=0)
        want.update({(g, i): level.get(i) for i in range(n)})
    chain = 3000
    nodes += [(50, i) for i in range(chain)]
    edges += [(50, i, i + 1) for i in range(chain - 1)]
    want.update({(50, i): i for i in range(chain)})
    got = K.levels(spark.createDataFrame(nodes, "graph_id int, id int"), spark.createDataFrame(edges, "graph_id int, source int, target int"))
    assert {(r["graph_id"], r["id"]): r["level"] for r in got.collect()} == want


def test_best_path_sends_no_side_to_the_driver(spark):
    from featureflow.lineage.trajectories import best_path

    rows = [(run, t, (t - 1) // 2 if t else None, "a", float(t)) for run in range(3) for t in range(9)]
    out = best_path(spark.createDataFrame(rows, "run_id long, trial long, parent_trial long, operator string, score double"))
    assert sorted((r.run_id, r.trial) for r in out.collect()) == [(run, t) for run in range(3) for t in (0, 1, 3, 8)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_are_whole_sums_without_decimals_in_the_scan(spark):
    from featureflow.search.score import candidate_quality

    d = spark.range(2000).selectExpr("id", "cast(id % 7 AS double) AS v")
    got = candidate_quality(d, {"v": "v"}).first()
    want = d.selectExpr("sum(cast(xxhash64(xxhash64(id, v), v) AS decimal(38,0))) AS s").first()["s"]
    assert (got["fingerprint"], got["nulls"], got["constant"]) == (want, 0, False)


def test_wide_scans_run_in_methods_that_are_compiled(spark, monkeypatch):
    from featureflow.search import score

    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before, whole = spark.conf.get(name), score.stage
    spark.conf.set(name, "65535")
    monkeypatch.setattr(score, "stage", lambda df: seen.append(spark.conf.get(name)) or whole(df))
    try:
        score.candidate_quality(spark.range(9).selectExpr("id", "id AS v"), {"v": "v"}).collect()
        assert seen == ["8000"] and spark.conf.get(name) == "65535"
    finally:
        spark.conf.set(name, before)


def test_planted_baskets_are_read_from_files(spark, sf):
    from featureflow.catalog.jobs import basket_inputs
    from featureflow.session import read_folders, staged_path

    baskets = basket_inputs(spark, sf, planted=True)["baskets"]
    assert read_folders(baskets) == {staged_path(baskets).rpartition("/")[2]}


def test_many_candidates_are_judged_in_one_scan(spark, monkeypatch):
    from featureflow.search import score

    plans, whole = [], score.stage
    monkeypatch.setattr(score, "stage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df))
    rows = spark.range(50).selectExpr(
        "id", "9223372036854775807L - id % 2 AS big", "cast(id % 2 AS decimal(9, 2)) AS m", "id % 2 = 0 AS b", "id AS again", "array(id) AS a",
        "if(id % 2 = 0, 0D, -0D) AS z", "cast(null AS double) AS none", "'é' AS s", "date'2020-01-01' AS d", "if(id = 9, cast('nan' AS double), 1D) AS f",
    )
    exprs = {c: c for c in rows.columns} | {f"x{i}": f"id + {i}" for i in range(60)}
    got = {r["candidate"]: r for r in score.candidate_quality(rows, exprs).collect()}
    assert len(got) == len(exprs) and plans[0].count("Range (0, 50") == 2  # all plain values in one scan, the array in its own
    assert [n for n in exprs if got[n]["constant"]] == ["z", "none", "s", "d", "f"]
    assert {n: got[n]["nulls"] for n in exprs if got[n]["nulls"]} == {"none": 50, "f": 1}
    assert got["x5"]["fingerprint"] != got["x6"]["fingerprint"] and got["id"]["fingerprint"] == got["again"]["fingerprint"] == got["x0"]["fingerprint"]
    assert (got["x5"]["mean"], got["s"]["mean"], got["m"]["mean"]) == (29.5, None, 0.5)
    empty = score.candidate_quality(rows.where("id < 0"), exprs).collect()
    assert len(empty) == len(exprs) and all((r["nulls"], r["constant"], r["mean"], r["fingerprint"]) == (0, True, None, None) for r in empty)


def test_one_scan_judges_and_scores(spark, monkeypatch):
    from featureflow.search import score

    rows = spark.range(300).selectExpr(
        "id", "nullif(id * id % 13, 4) AS a", "cast(id % 7 AS double) AS b", "id % 2 = 0 AS c", "concat('t', id % 3) AS t", "cast(id % 5 AS decimal(9, 2)) AS m",
        "cast(null AS double) AS none", "if(id % 9 = 0, cast('nan' AS double), 2D) AS flat", "nullif(cast(id % 4 AS int), 3) AS y",
    )
    exprs = {c: c for c in rows.columns if c != "y"} | {"bad": "no_such", "sum": "a + b"}
    plans, whole = [], score.stage
    monkeypatch.setattr(score, "stage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df))
    for data in (rows, rows.where("id < 0"), rows.withColumn("y", F.lit(None).cast("int"))):
        near = lambda d: {r[0]: tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()}
        plans.clear()
        quality, scores = score.judge_candidates(data, exprs, "y")
        assert sum("xxhash64" in p and "sum(" not in p for p in plans) <= 1
        assert near(quality) == near(score.candidate_quality(data, exprs)) and near(scores) == near(score.score_candidates(data, exprs, "y"))
    plain = {n: e for n, e in exprs.items() if n not in ("t", "m", "bad")}
    plans.clear()
    score.judge_candidates(rows, plain, "y")
    assert sum("Range (0, 300" in p for p in plans) == 1  # numbers and booleans are read once
