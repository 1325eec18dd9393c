"""Models in sessions that have made an Observation, joins and vectors that grow."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Observation
from pyspark.sql import functions as F

from featureflow.models import estimators as M
from featureflow.models import prep as P
from featureflow.models.learner import Context
from featureflow.operators import joins as J
from featureflow.semantic.choose import choices, fit_with_choices


@pytest.fixture
def two_classes(spark):
    spark.range(3).observe(Observation("seen"), F.count(F.lit(1)).alias("n")).count()
    rows = spark.range(200).selectExpr("id", "cast(id % 2 AS double) AS x", "cast(id % 2 AS int) AS y")
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)


@pytest.mark.parametrize("kind", ["forest", "logistic"])
def test_folds_are_scored_after_an_observation(two_classes, kind):
    out = M.cross_validate(M.multiclass_classifier("y", kind=kind, trees=3, depth=2), two_classes, "y", 2, "f1", key="id")
    assert [tuple(r) for r in out.orderBy("fold").collect()] == [(0, 1.0), (1, 1.0)]


def test_choices_are_scored_after_an_observation(two_classes):
    model = fit_with_choices(M.multiclass_classifier("y", trees=3), two_classes, "y", choices(max_depth="Try 1 and 2"), k=2, key="id")
    assert model.avgMetrics == [1.0, 1.0]
    assert model.transform(two_classes).where("prediction = y").count() == 200


def test_a_dimension_of_many_rows_is_not_broadcast(spark):
    dim = spark.range(J.BROADCAST_ROWS + 1).selectExpr("id AS k", "id % 7 AS v")
    fact = spark.range(1000).selectExpr("id AS n", "id * 3 AS k")
    joined = lambda d: J.star_join(fact, [(d, "k")])
    kinds = lambda d: joined(d)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in kinds(dim) and "BroadcastHashJoin" in kinds(dim.where("k < 1000"))
    assert joined(dim).where("v = (n * 3) % 7").count() == 1000


def test_a_fit_reads_wide_vectors_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P.spread, "__defaults__", ("features", 1000))
    rows = spark.range(500).selectExpr("id", *[f"cast(id % 2 AS double) AS x{i}" for i in range(20)], "cast(id % 2 AS int) AS y")
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(20)], outputCol="features").transform(rows).select("id", "features", "y").coalesce(1)
    seen = []

    def fit(pieces):
        seen.append((pieces.rdd.getNumPartitions(), pieces.count(), pieces.select("id").distinct().count()))
        return M.boosted_classifier("y", iterations=1).fit(pieces)

    out = Context("fit").model("m", None, data, fit=fit)
    assert seen == [(10, 500, 500)]
    assert out.where("prediction = y").count() == 500


def test_hashed_words_are_written_once_and_give_the_same_vectors(spark, monkeypatch):
    text = "concat_ws(' ', 'word', id % 7, 'other', id * 31, CASE WHEN id % 3 = 0 THEN 'third' END)"
    rows = spark.range(120).selectExpr("id", f"{text} AS words", "cast(id % 5 AS string) AS few", "cast(nullif(id % 4, 3) AS double) AS x")
    want = P.TableVectorizer(["id"]).fit(rows).transform(rows).select("id", "features").collect()
    ctx, written, pin = Context("fit"), [], Context.pin
    monkeypatch.setattr(Context, "pin", lambda self, df: written.append(df.columns) or pin(self, df))
    out = ctx.vectorize("v", rows, exclude=["id"])
    assert [("_s_words_h" in c, "_s_words_w" in c) for c in written] == [(False, False), (True, False)]
    assert len(ctx.pinned) == 1 and out.columns == ["id", "words", "few", "x", "features"]  # the first files have gone
    near = lambda got: [(r.id, [round(v, 9) for v in r.features]) for r in sorted(got, key=lambda r: r.id)]
    again = Context("predict", ctx.state).vectorize("v", rows)
    assert near(want) == near(out.collect()) == near(again.select("id", "features").collect())


def test_candidates_are_judged_without_the_texts_that_none_reads(spark, monkeypatch):
    from featureflow.semantic import generate as G

    seen, judge = [], G.candidate_quality
    monkeypatch.setattr(G, "candidate_quality", lambda df, exprs: seen.append(df.columns) or judge(df, exprs))
    rows = spark.range(60).selectExpr("id", "cast(id AS string) AS body", "cast(id % 9 AS double) AS a", "cast(id % 9 AS double) AS b", "concat('n', id % 5) AS name")
    op = G.SemGenFeatures(how_many=3, keep_all=True, exclude=["id", "body"], hint="log1p frequency")
    program = op.fit(rows)
    assert "body" not in seen[0] and {"a", "b", "name", "_others"} <= set(seen[0])
    states = {t["candidate"]: t["state"] for t in program.attempts[0]["tries"]}
    assert (states["log1p_a"], states["log1p_b"], states["freq_name"]) == ("kept", "duplicate", "constant")
    every = [{"name": "h", "expr": "xxhash64(*)", "recipe": "hash", "needs": []}]
    assert G._needed(rows, every).columns == rows.columns


def test_people_are_found_by_their_first_letters(spark):
    import re

    from featureflow.semantic import extract as E

    titles = re.match(r"\(\?:([^)]*)\)", E.PERSON)[1].split("|")
    guard = re.match(r"\(\?=\[(\w+)\]\)", E.TITLED)[1]
    assert {t[0] for t in titles} == set(guard)
    texts = [f"x{t} Élan Brûlé, {t}. Ada {t} low" for t in titles] + ["Msgr. A Mrs Bo Saint St John", "", "Dr Who Dr\nWho"]
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (E.PERSON, E.TITLED)]).collect()
    assert all(a == b for a, b in both) and sum(len(a) for a, _ in both) > 2 * len(titles)


def test_replays_of_a_learner_are_compared_from_files(spark, sf):
    from featureflow.catalog.registry import QUERIES

    import featureflow.catalog.jobs  # noqa: F401

    out = QUERIES["m10_m12_learner_state"](spark, sf)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == 1 and plan.count("Relation [") == 2  # no task holds the sorted rows of both replays
    got = out.first()
    assert got["rows"] > 100 and got["differing"] == 0


def test_large_planted_vectors_are_written_once_without_a_broadcast(spark, sf, monkeypatch):
    from featureflow import session
    from featureflow.catalog import jobs

    rows = lambda d: sorted((r.ID, r.fraud_flag, r.n, *[round(v, 6) for v in (r.total, r.qty, *r.features)]) for r in d.collect())
    few = jobs.planted_vectors(spark, sf)
    plans, write = [], jobs.stage
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jobs, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    many = jobs.planted_vectors(spark, sf)
    assert session.read_folders(many) == {session.staged_path(many).rpartition("/")[2]}
    assert len(plans) == 2 and "BroadcastHashJoin" not in plans[0] + plans[1] and "part.parquet" in plans[0] and "part.parquet" not in plans[1]
    assert few.schema.simpleString() == many.schema.simpleString() and rows(few) == rows(many)


def test_text_candidates_are_worked_out_once_per_value(spark, monkeypatch):
    from featureflow.semantic import generate as G

    rows = spark.range(300).selectExpr("id", "nullif(concat_ws(' ', slice(split('a bb ccc dddd', ' '), 1, cast(id % 5 AS int))), 'a') AS t", "cast(id * id % 11 AS double) AS y")
    seen, judge = [], G.judge_candidates
    monkeypatch.setattr(G, "judge_candidates", lambda df, exprs, y: seen.append(exprs) or judge(df, exprs, y))

    def tries(proposer):
        program = G.SemGenFeatures(how_many=3, y="y", exclude=["id"], proposer=proposer).fit(rows)
        out = program.transform(rows)
        assert not any(c.startswith("_v") for c in out.columns)
        near = [t | {"score": round(t["score"] or 0, 9)} for t in program.attempts[0]["tries"]]  # tasks' sums merge in any order
        return near, sorted(out.collect(), key=lambda r: r.id)

    plain = lambda profile, hint: [c | {"needs": [n for n in c["needs"] if n[0] != "text"]} for c in G.propose(profile, hint)]
    assert tries(G.propose) == tries(plain)
    by_value, by_row = seen
    assert by_value["words_t"].startswith("CASE WHEN `t` IS NULL THEN ") and by_row["words_t"].startswith("size(")
