"""What operators stage is removed, but for what their results read."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from featureflow.session import read_folders, scratch_dir, stage, tidy


def folders(spark):
    return {p.name for p in (Path(scratch_dir(spark)) / "staged").iterdir()}


def test_only_what_the_result_reads_is_left(spark):
    @tidy
    def inner(df):
        a = stage(df.where("id < 5"))
        b = stage(df.where("id > 7"))
        stage(a.unionByName(b))
        return a.join(F.broadcast(b), "id", "left")

    @tidy
    def outer(df):
        x = inner(df)
        return stage(x.withColumn("y", F.lit(1)))

    given = stage(spark.range(10))
    before = folders(spark)
    out = inner(given)
    assert len(folders(spark) - before) == 2 and folders(spark) - before <= read_folders(out) and out.count() == 5
    middle = folders(spark)
    out = outer(given)
    assert folders(spark) - middle == read_folders(out) and out.count() == 5
    assert read_folders(given) <= folders(spark) and given.count() == 10


def test_a_failing_call_keeps_the_scope_of_its_caller(spark):
    @tidy
    def fails(df):
        stage(df)
        raise ValueError

    @tidy
    def caller(df):
        with pytest.raises(ValueError):
            fails(df)
        return stage(df)

    assert caller(spark.range(3)).count() == 3


@pytest.mark.parametrize("name", ["k7_contract", "k9_levels", "q4_refine_distance", "g1_score_candidates", "q2_exact_quantiles"])
def test_queries_leave_what_their_results_read(spark, sf, name):
    from featureflow.catalog import QUERIES

    names = [n for n in QUERIES if n.startswith(name.split("_")[0] + "_")] if name not in QUERIES else [name]
    spark.range(1).transform(stage)
    before = folders(spark)
    out = QUERIES[names[0]](spark, sf)
    assert folders(spark) - before <= read_folders(out) and out.count()
