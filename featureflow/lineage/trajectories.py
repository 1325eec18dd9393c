"""Search trajectories as tables (K1-K4): trials(run_id, trial, parent_trial, operator, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.numbers import finite
from featureflow.operators.aggs import best_by
from featureflow.session import stage, staged_path

MAX_DOUBLINGS = 64


def explode_outcomes(trajs: DataFrame, run: str = "run_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Outcomes → trials; outcomes without a trial number are dropped, a missing operator is "root"."""
    o = trajs.select(run, *keep, F.explode("outcomes").alias("o"))
    node = F.col("o.search_node")
    return o.where(node["trial"].isNotNull()).select(
        run,
        *keep,
        node["trial"].alias("trial"),
        node["parent_trial"].alias("parent_trial"),
        F.coalesce(F.nullif(node["operator_to_evolve"], F.lit("")), F.lit("root")).alias("operator"),
        finite(F.col("o.score").cast("double"), T.DoubleType()).alias("score"),
        generated_code(F.get_json_object("o.state", "$.generated_code")).alias("code"),
    )


def generated_code(c: Column) -> Column:
    """Code text, list of texts or map of texts → map from operator (or position) to code."""
    as_map = F.from_json(c, T.MapType(T.StringType(), T.StringType()))
    as_list = F.from_json(c, T.ArrayType(T.StringType()))
    numbered = F.map_from_entries(
        F.transform(as_list, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    )
    return (
        F.when(F.ltrim(c).startswith("{"), as_map)
        .when(F.ltrim(c).startswith("["), numbered)
        .when(c.isNotNull(), F.create_map(F.lit("code"), c))
    )


def best_path(trials: DataFrame, run: str = "run_id") -> DataFrame:
    """Trials on the path from each run's best trial to its root, both included.

    Every round doubles the length of the known path, so a path of d trials takes log2(d) joins.
    Both sides grow with the trials, and their files are far smaller than their rows: they are
    merged, never sent whole to the driver.
    """
    start = best_by(trials, run).select(run, "trial")
    path = stage(start)
    jump = stage(
        trials.where("parent_trial IS NOT NULL").select(run, F.col("trial"), F.col("parent_trial").alias("_to"))
    )
    size = path.count()
    for _ in range(MAX_DOUBLINGS):
        ahead = path.join(jump.hint("merge"), [run, "trial"]).select(run, F.col("_to").alias("trial"))
        longer = stage(path.unionByName(ahead).distinct())
        n = longer.count()
        if n == size:
            break
        path, size = longer, n
        hop = jump.select(run, F.col("trial").alias("_to"), F.col("_to").alias("_next"))
        jump = stage(jump.join(hop.hint("merge"), [run, "_to"]).select(run, "trial", F.col("_next").alias("_to")),
                     replaces=staged_path(jump))
    else:
        raise RuntimeError("parent chains did not end")
    return trials.join(path.hint("merge"), [run, "trial"], "left_semi")


def subtree_sums(trials: DataFrame, values: dict[str, Column], run: str = "run_id") -> DataFrame:
    """(run, trial, depth, sums of the values over the subtree of each trial).

    Round i adds, to every trial, the sums of the descendants 2^i below it; sums then cover
    twice the distance. Linear in the trials per round, log2(depth) rounds.
    """
    names = list(values)
    known = trials.select(run, F.col("trial").alias("parent_trial"), F.lit(True).alias("_ok"))
    state = stage(
        trials.join(known, [run, "parent_trial"], "left").select(
            run, "trial", F.when(F.col("_ok"), F.col("parent_trial")).alias("_up"),
            F.when(F.col("_ok"), 1).otherwise(0).cast("bigint").alias("depth"),
            *[values[n].alias(n) for n in names],
        )
    )
    for _ in range(MAX_DOUBLINGS):
        if state.where("_up IS NOT NULL").limit(1).count() == 0:
            return state.drop("_up")
        up = state.where("_up IS NOT NULL")
        adds = up.groupBy(run, F.col("_up").alias("trial")).agg(*[F.sum(n).alias(f"_a_{n}") for n in names])
        hop = state.select(run, F.col("trial").alias("_up"), F.col("_up").alias("_up2"), F.col("depth").alias("_d2"))
        joined = state.join(adds, [run, "trial"], "left").join(hop, [run, "_up"], "left")
        state = stage(
            joined.select(
                run, "trial", F.col("_up2").alias("_up"),
                (F.col("depth") + F.coalesce("_d2", F.lit(0))).alias("depth"),
                *[(F.col(n) + F.coalesce(f"_a_{n}", F.lit(0))).alias(n) for n in names],
            ),
            replaces=staged_path(state),
        )
    raise RuntimeError("parent chains did not end: the parents form a cycle")


def subtree_stats(trials: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, trial, depth, children, subtree_size, subtree_leaves); the trial itself counts."""
    kids = trials.where("parent_trial IS NOT NULL").groupBy(run, F.col("parent_trial").alias("trial")).agg(
        F.count(F.lit(1)).alias("children")
    )
    base = trials.join(kids, [run, "trial"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    base = base.select(run, "trial", "parent_trial", F.col("children").cast("bigint").alias("children"))
    sums = subtree_sums(
        base,
        {
            "subtree_size": F.lit(1).cast("bigint"),
            "subtree_leaves": F.when(F.col("children") == 0, 1).otherwise(0).cast("bigint"),
        },
        run,
    )
    return sums.join(base.select(run, "trial", "children"), [run, "trial"]).select(
        run, "trial", "depth", "children", "subtree_size", "subtree_leaves"
    )


def trajectory_summary(trials: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, trials, best, last_trial, last_score) with missing scores as -infinity."""
    score = F.coalesce(F.col("score"), F.lit(float("-inf")))
    return trials.groupBy(run).agg(
        F.count(F.lit(1)).alias("trials"), F.max(score).alias("best"), F.max("trial").alias("last_trial"),
        F.max_by(score, "trial").alias("last_score"),
    )


def same_trajectory(a: DataFrame, b: DataFrame, run: str = "run_id", eps: float = 1e-6) -> DataFrame:
    """(run, same): equal count, best score, last trial and last score (scores within eps).

    A run that only one side has is not the same.
    """
    x = trajectory_summary(a, run)
    y = trajectory_summary(b, run)
    y = y.select(F.col(run), *[F.col(c).alias(f"_{c}") for c in y.columns if c != run])

    def close(p: str) -> Column:
        q = f"_{p}"
        return (F.col(p) == F.col(q)) | (F.abs(F.col(p) - F.col(q)) <= F.lit(eps))

    same = (
        (F.col("trials") == F.col("_trials")) & close("best") & (F.col("last_trial") == F.col("_last_trial"))
        & close("last_score")
    )
    return x.join(y, run, "full").select(run, F.coalesce(same, F.lit(False)).alias("same"))
