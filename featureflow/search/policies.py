"""Which trial to extend next, as queries over the trials table (G3-G5). One row per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.lineage.trajectories import subtree_sums
from featureflow.operators.windows import top_k

def _best_first() -> list:
    return [F.col("score").desc_nulls_last(), F.col("trial")]



def evolutionary(trials: DataFrame, population_size: int = 6, run: str = "run_id") -> DataFrame:
    """(run, parent): the population is the best trials; its members take turns by trial count."""
    ranked = top_k(trials.where("score IS NOT NULL"), [run], population_size, _best_first())
    # a population is at most population_size rows per run
    members = ranked.groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("trial").alias("t")))).alias("p")
    )
    turns = trials.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    at = (F.pmod(F.col("n"), F.size("p")) + 1).cast("int")
    return turns.join(members, run, "left").select(run, F.element_at("p", at)["t"].alias("parent"))


def tree(trials: DataFrame, min_num_drafts: int = 2, run: str = "run_id") -> DataFrame:
    """(run, parent): NULL (a new root) until there are enough roots, then the best childless trial."""
    has_child = trials.where("parent_trial IS NOT NULL").select(run, F.col("parent_trial").alias("trial")).distinct()
    leaves = trials.join(has_child, [run, "trial"], "left_anti").where("score IS NOT NULL")
    order = F.struct(F.col("score"), (-F.col("trial")).alias("t"))
    best = leaves.groupBy(run).agg(F.max_by("trial", order).alias("leaf"))
    roots = trials.groupBy(run).agg(F.count(F.when(F.col("parent_trial").isNull(), 1)).alias("roots"))
    return roots.join(best, run, "left").select(
        run, F.when(F.col("roots") >= min_num_drafts, F.col("leaf")).alias("parent")
    )


def mcts(trials: DataFrame, exploration: float = 2.0**0.5, run: str = "run_id") -> DataFrame:
    """(run, parent): the trial with the highest upper confidence bound.

    Visits are the trials of a subtree, the value is the mean of their scores; a root competes
    within all trials of its run.
    """
    s = subtree_sums(
        trials,
        {
            "visits": F.lit(1).cast("bigint"),
            "scored": F.when(F.col("score").isNotNull(), 1).otherwise(0).cast("bigint"),
            "total": F.coalesce(F.col("score"), F.lit(0.0)),
        },
        run,
    )
    above = s.select(run, F.col("trial").alias("parent_trial"), F.col("visits").alias("_pv"))
    size = trials.groupBy(run).agg(F.count(F.lit(1)).alias("_all"))
    full = trials.select(run, "trial", "parent_trial").join(s, [run, "trial"]).join(
        above, [run, "parent_trial"], "left"
    ).join(size, run)
    mean = F.coalesce(F.try_divide(F.col("total"), F.col("scored")), F.lit(0.0))
    ucb = mean + F.lit(exploration) * F.sqrt(F.log(F.coalesce("_pv", "_all").cast("double")) / F.col("visits"))
    order = F.struct(F.round(ucb, 9).alias("u"), (-F.col("trial")).alias("t"))
    return full.groupBy(run).agg(F.max_by("trial", order).alias("parent"))


POLICIES = {"evolutionary": evolutionary, "tree": tree, "mcts": mcts}
