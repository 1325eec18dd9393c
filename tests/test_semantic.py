"""Fit/transform operators: edge cases, replay without refitting, learners, streams."""

import pytest
from pyspark.sql import functions as F

from featureflow.models.estimators import regressor
from featureflow.models.learner import Learner
from featureflow.models.prep import TableVectorizer, standardize
from featureflow.search.score import score_candidates
from featureflow.semantic import extract as EX
from featureflow.semantic import fillna as FN
from featureflow.semantic.augment import SemAugment
from featureflow.semantic.choose import choices
from featureflow.semantic.clean import SemClean
from featureflow.semantic.extract import SemExtract
from featureflow.semantic.fillna import SemFillNA
from featureflow.semantic.generate import SemGenFeatures, propose
from featureflow.semantic.program import FeatureProgram
from featureflow.semantic.refine import SemRefine
from featureflow.semantic.select import SemSelect
from featureflow.sources.tables import Inputs
from featureflow.streaming.events import read_updates, run_status, write_updates


@pytest.fixture(scope="module")
def goods(spark):
    rows = [(1, "red acme box", "acme", 5), (2, "blue acme jar", "acme", 7), (3, "big bolt co pin", "bolt co", 2),
            (4, "old acme lid", None, 4), (5, "bolt co nut", None, 3), (6, "plain thing", None, 1), (7, None, None, None)]
    return spark.createDataFrame(rows, "id int, title string, make string, n int")


def test_fillna_from_text_and_overall(spark, goods, monkeypatch):
    want = {1: "acme", 2: "acme", 3: "bolt co", 4: "acme", 5: "bolt co", 6: "acme", 7: "acme"}
    op = SemFillNA("make", text=["title"])
    program = op.fit(goods)
    assert {r["id"]: r["make"] for r in program.transform(goods).collect()} == want
    assert {r["make_source"] for r in program.transform(goods).collect()} == {"given", "text", "overall"}
    monkeypatch.setattr(FN, "INLINE_VALUES", 0)  # the joined form of a large dictionary
    assert {r["id"]: r["make"] for r in op.fit(goods).transform(goods).collect()} == want


def test_fillna_of_an_empty_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "c int, t string")
    assert [r["t"] for r in SemFillNA("t", ["c"]).fit_transform(df).collect()] == [None, None]


def test_program_saved_equals_loaded(spark, goods, tmp_path):
    program = SemFillNA("make", ["n"], text=["title"]).fit(goods)
    program.save(spark, str(tmp_path / "p"))
    again = FeatureProgram.load(spark, str(tmp_path / "p"))
    assert sorted(program.transform(goods).collect(), key=str) == sorted(again.transform(goods).collect(), key=str)
    unseen = goods.select(F.lit(9).alias("id"), F.lit("zzz").alias("title"), F.lit(None).cast("string").alias("make"), F.lit(99).alias("n"))
    assert again.transform(unseen).first()["make"] == "acme"


def test_refine(spark):
    names = ["Vase", "vase ", "VASE, painted", "Painted vase", "Vase", "vaze"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    got = [r["name"] for r in SemRefine("name").fit_transform(df).orderBy("id").collect()]
    assert got == ["Vase", "Vase", "Painted Vase", "Painted Vase", "Vase", "Vaze"]
    fuzzy = [r["name"] for r in SemRefine("name", existing_only=True, max_deletes=1).fit_transform(df).orderBy("id").collect()]
    assert fuzzy[5] == "Vase" and fuzzy[2] == fuzzy[3]
    with pytest.raises(ValueError):
        SemRefine("name").fit(df.unionByName(spark.createDataFrame([(9, None)], "id int, name string")))


def test_clean_text_is_idempotent(spark):
    df = spark.createDataFrame([("A  b",), ("a b",), ("A b",), ("A b ",)], "x string")
    program = SemClean(["x"], kind="text").fit(df)
    once = program.transform(df)
    assert {r["x"] for r in once.collect()} == {"A b"} and program.transform(once).collect() == once.collect()


def test_terms_inline_and_joined(spark, goods, monkeypatch):
    op = SemExtract(["title"], dictionaries={"metal": ["pin", "nut", "jar"]})
    key = ["id", "is_metal", "metal_count", "metal_terms"]
    inline = sorted(op.fit_transform(goods).select(*key).collect())
    monkeypatch.setattr(EX, "INLINE_TERMS", 0)
    assert inline == sorted(op.fit_transform(goods).select(*key).collect())


def test_generator_rejects_and_records(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("a"), F.lit(1.0).alias("b"), F.lit(None).cast("string").alias("e"),
                                 (F.col("id") % 10 * 3 + 1).cast("double").alias("y"))
    program = SemGenFeatures(how_many=2, y="y", exclude=["id"]).fit(df)
    out = program.transform(df)
    assert "b" not in out.columns and "e" not in out.columns and "a" in out.columns
    states = {t["state"] for t in program.attempts[0]["tries"]}
    assert "constant" in states and sum(t["state"] == "kept" for t in program.attempts[0]["tries"]) == 2


def test_pairs_of_a_wide_table(spark):
    """Of many numbers only those that the hint names or that say something alone are paired."""
    noise = [F.rand(i).alias(f"n{i}") for i in range(40)]
    df = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), *noise)
    df = df.withColumn("y", F.col("a") / (F.col("b") + 1))
    seen = []

    def watched(profile, hint):
        seen.append(profile["pairs"])
        return propose(profile, hint)

    program = SemGenFeatures(how_many=1, y="y", exclude=["id"], pair_columns=4, hint="n7", proposer=watched).fit(df)
    assert len(seen[0]) == 4 and {"a", "b", "n7"} <= set(seen[0])
    assert [t["candidate"] for t in program.attempts[0]["tries"] if t["state"] == "kept"] == ["a_per_b"]
    assert len(program.attempts[0]["tries"]) < 42 * 2 + 40


def test_constant_target(spark):
    df = spark.range(50).select("id", F.lit(1).alias("y"), F.col("id").cast("double").alias("a"))
    assert [r["score"] for r in score_candidates(df, {"a": "a"}, "y").collect()] == [None]
    assert SemSelect("y").fit_transform(df).columns == ["id", "y", "a"]


def test_augment_only_adds(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 10, 1).otherwise(0).alias("y"), F.rand(1).alias("x"))
    out = SemAugment("y", "id").augment(df)
    assert out.where("NOT is_augmented").count() == 100 and out.where("y = 1").count() == 90
    assert out.where("is_augmented AND y = 0").count() == 0


def test_choices():
    assert choices(max_depth="Try 3, 5 or 7") == {"maxDepth": [3, 5, 7]}
    assert choices(max_depth="Common range")["maxDepth"] and choices(regParam=[0.1])["regParam"] == [0.1]
    with pytest.raises(ValueError):
        choices(nothing="none")


def test_standardize_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in standardize(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_vectorizer_unseen_and_null(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, None), (None, 3.0, None)], "c string, n double, z string")
    model = TableVectorizer().fit(df)
    new = spark.createDataFrame([("zzz", None, "q")], "c string, n double, z string")
    v = model.transform(new).first()["features"]
    assert 2.0 in v.toArray() and v.toArray().sum() == 3.0


def test_learner_replays_without_fitting(spark, goods, tmp_path):
    def build(inputs, ctx):
        df = ctx.step("fill", SemFillNA("make", text=["title"]), inputs["goods"])
        df = df.where("n IS NOT NULL").withColumn("label", F.col("n") * 2.0)
        vec = ctx.vectorize("vec", df, exclude=["id", "label", "title"])
        return ctx.model("reg", regressor("label", kind="linear"), vec)

    learner = Learner(build)
    with pytest.raises(RuntimeError):
        learner.predict(Inputs(goods=goods))
    learner.fit(Inputs(goods=goods))
    before = dict(learner.state)
    first = [r["prediction"] for r in learner.predict(Inputs(goods=goods)).orderBy("id").collect()]
    assert learner.state == before
    learner.save(spark, str(tmp_path / "l"))
    again = Learner.load(spark, str(tmp_path / "l"), build).predict(Inputs(goods=goods))
    assert [round(r["prediction"], 6) for r in again.orderBy("id").collect()] == [round(p, 6) for p in first]
    given = Learner(build, state={"fill": before["fill"]}).fit(Inputs(goods=goods))
    assert given.state["fill"] is before["fill"]


@pytest.mark.parametrize("last,want", [("done", "done"), ("error", "error"), ("log", None)])
def test_stream_status_equals_batch(spark, tmp_path, last, want):
    rows = [("r", i, float(i), "node_code", 0.5) for i in range(4)] + [("r", 9, 9.0, last, None)]
    df = spark.createDataFrame(rows, "run_id string, seq int, t double, type string, cost double").withColumn("ts", F.timestamp_seconds("t"))
    src = str(tmp_path / "src")
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = write_updates(run_status(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = read_updates(spark, str(tmp_path / "out"), ["run_id"]).first().asDict()
    assert got == run_status(df).first().asDict() and got["status"] == want and got["nodes"] == 4


def test_large_dictionaries_in_a_chain(spark, tmp_path):
    from featureflow.semantic.extract import SemExtract
    from featureflow.semantic.program import FeatureProgram, chain

    df = spark.createDataFrame([(1, "a word17 and word2400"), (2, "nothing")], "id int, t string")
    terms = [f"word{i}" for i in range(2500)]
    for few in (terms, terms[:100]):
        p = SemExtract(["t"], dictionaries={"k": few}).fit(df)
        both = chain(p)
        want = [tuple(r) for r in p.transform(df).orderBy("id").collect()]
        assert [tuple(r) for r in both.transform(df).orderBy("id").collect()] == want and want[0][3] >= 1
        path = f"{tmp_path}/p{len(few)}"
        both.save(spark, path)
        assert [tuple(r) for r in FeatureProgram.load(spark, path).transform(df).orderBy("id").collect()] == want


def test_long_known_values(spark):
    rows = [(1, "the big red shop", "x"), (2, "acme", "y"), (3, "acme", "z"), (4, None, "sold by the big red shop today")]
    df = spark.createDataFrame(rows, "id int, make string, note string")
    got = SemFillNA("make", text=["note"]).fit_transform(df).where("id = 4").first()
    assert got["make"] == "the big red shop" and got["make_source"] == "text"


def test_clean_leaves_nulls(spark):
    from featureflow.semantic.clean import SemClean

    df = spark.createDataFrame([(float(i) if i else None,) for i in range(20)], "v double")
    assert SemClean(["v"], invalid=None).fit_transform(df).where("v IS NULL").count() == 1


def test_unknown_classes_decode_to_null(spark):
    from featureflow.models.prep import LabelCodec

    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    codec = LabelCodec("c").fit(df)
    assert [r["d"] for r in codec.decode(codec.encode(df), "label", "d").collect()] == ["a", "b", None]


def test_one_f1_everywhere(spark):
    from featureflow.models.estimators import evaluator, score

    rows = [(1.0, 1.0)] * 4 + [(1.0, 0.0)] * 6 + [(0.0, 1.0)] * 8 + [(0.0, 0.0)] * 30
    pred = spark.createDataFrame(rows, "y double, prediction double")
    assert abs(score(pred, "y", "f1") - 8 / 22) < 1e-12 and abs(evaluator("f1", "y").evaluate(pred) - 8 / 22) < 1e-12


def test_text_scores_of_large_labels(spark):
    df = spark.range(200).selectExpr("1e9 + id % 2 AS y", "concat('p', id % 2) AS t", "id % 2 AS n")
    got = {r["candidate"]: r["score"] for r in score_candidates(df, {"t": "t", "n": "n"}, "y").collect()}
    assert abs(got["t"] - 1) < 1e-6 and abs(got["n"] - 1) < 1e-6
