"""Search over the state of one operator (G2, G6-G8). Trials are rows; scores come from Spark jobs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.hashing import key_fraction
from featureflow.lineage.trajectories import best_path
from featureflow.models.learner import Learner
from featureflow.operators.aggs import best_by
from featureflow.operators.sampling import with_fold
from featureflow.search.policies import POLICIES
from featureflow.sources.documents import write_trajectory
from featureflow.session import remove_path, scratch_dir, stage, staged_path

TRIALS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("trial", T.LongType()),
        T.StructField("parent_trial", T.LongType()),
        T.StructField("operator", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("code", T.StringType()),
    ]
)


class Search:
    """Result of a search: its run id, trials table and the best state.

    `best_learner` puts the best state into a new learner; its fit refits everything else
    and replays that operator (G7).
    """

    def __init__(self, run_id: str, path: str, states: dict, build: Callable, operator: str):
        self.run_id, self.path, self.states, self.build, self.operator = run_id, path, states, build, operator
        self.settings: dict[int, dict] = {}

    def trials(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(TRIALS).parquet(self.path).where(F.col("run_id") == self.run_id)

    def best(self, spark: SparkSession) -> dict:
        return best_by(self.trials(spark), "run_id").first().asDict()

    def best_path(self, spark: SparkSession) -> DataFrame:
        return best_path(self.trials(spark))

    def best_learner(self, spark: SparkSession) -> Learner:
        trial = self.best(spark)["trial"]
        own = self.settings.get(trial)
        return Learner(partial(self.build, **own) if own else self.build, state={self.operator: self.states[trial]})


def mutations(candidates: list[dict], how_many: int) -> Callable[[list | None, int], list[dict]]:
    """Proposal of trial t: a window over the ranked candidates, or the parent's set with one swap."""

    def propose(parent: list[dict] | None, t: int) -> list[dict]:
        n = len(candidates)
        if not parent:
            return [candidates[(t * how_many + i) % n] for i in range(min(how_many, n))]
        held = {c["name"] for c in parent}
        fresh = [c for c in candidates if c["name"] not in held]
        if not fresh:
            return list(parent)
        out = list(parent)
        out[t % len(out)] = fresh[t % len(fresh)]
        return out

    return propose


def _side_by_side(spark: SparkSession, fn: Callable, jobs: list, n_jobs: int) -> list:
    """`fn` of every job, up to `n_jobs` at a time; each thread has the caller's local properties and the pool "search"."""

    def run(job):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "search")
        return fn(job)

    if n_jobs <= 1:
        return [fn(j) for j in jobs]
    with ThreadPoolExecutor(n_jobs) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), jobs))


def optimise(
    build: Callable, operator: str, inputs: Mapping[str, DataFrame], split_on: str, key: str, y: str,
    make_state: Callable[[object, int], tuple[object, object]], num_trials: int = 10, scoring: str = "f1", cv: int = 3,
    policy: str = "tree", policy_args: dict | None = None, run_name: str | None = None, path: str | None = None,
    hpo: Callable[[Learner, int], Learner] | None = None, seed: int = 0,
    settings: list[dict] | None = None, hpo_iterations: int = 1, n_jobs: int = 1, rungs: tuple[float, ...] = (1.0,),
) -> Search:
    """Run `num_trials` trials; each gets a state for `operator` and its mean k-fold score.

    `make_state(parent_code, trial)` returns (state, code): the state goes into the learner, the
    code (JSON-able) describes it. The input `split_on` is cut into folds by hashed `key`; other
    inputs are whole. A state that is an operator is fitted on the training rows of each fold.
    The next parent is a query over the trials table. With `settings` each trial tries
    `hpo_iterations` of them (keyword arguments of `build`), in turn, and keeps the best; `hpo`
    may wrap the learner of a trial instead. With `rungs`, rising shares of the rows that end with
    1, all settings of a trial start on the first share (rows by hashed `key`) and the better half goes on
    to the next. Up to `n_jobs` folds of all settings run at a time, in a pool of their own of
    the fair scheduler if the session has one. At the end the trials are written as a trajectory
    document beside the trials table.
    """
    from featureflow.models.estimators import score as score_of

    if list(rungs) != sorted(rungs) or not rungs or rungs[0] <= 0 or rungs[-1] != 1:
        raise ValueError("rungs are rising shares that end with 1")
    table = inputs[split_on]
    spark = table.sparkSession
    run_id = run_name or uuid.uuid4().hex
    path = path or f"{scratch_dir(spark)}/trials-{uuid.uuid4().hex}"
    folded = stage(with_fold(table, cv, key, seed, "_fold"))
    states, codes = {}, {}
    search = Search(run_id, path, states, build, operator)
    try:
        for t in range(num_trials):
            parent = None
            if t:
                got = POLICIES[policy](search.trials(spark), **(policy_args or {})).first()
                parent = got["parent"] if got is not None else None
            state, code = make_state(codes.get(parent), t)
            states[t], codes[t] = state, code

            def fold_score(job: tuple, state=state, t=t) -> float:
                own, f, share = job
                rows = folded if share == 1 else folded.where(key_fraction(key, seed + 1) < share)
                train = {**inputs, split_on: rows.where(F.col("_fold") != f).drop("_fold")}
                test = {**inputs, split_on: rows.where(F.col("_fold") == f).drop("_fold")}
                learner = Learner(partial(build, **own) if own else build, state={operator: state})
                learner = hpo(learner, t) if hpo else learner
                return score_of(learner.fit(train).predict(test), y, scoring)

            tries = [settings[(t * hpo_iterations + i) % len(settings)] for i in range(hpo_iterations)] if settings else [{}]
            for share in rungs if len(tries) > 1 else rungs[-1:]:
                scores = _side_by_side(spark, fold_score, [(own, f, share) for own in tries for f in range(cv)], n_jobs)
                found = [(sum(scores[i * cv : (i + 1) * cv]) / cv, own) for i, own in enumerate(tries)]
                sign = 1 if scoring == "mse" else -1
                found.sort(key=lambda x: sign * x[0] if x[0] == x[0] else float("inf"))  # of equal ones the earlier stays ahead
                tries = [own for _, own in found[: max(1, len(found) // 2)]] if share < 1 else tries
            value, search.settings[t] = found[0]
            row = (run_id, t, parent, operator, None if value != value else float(value), json.dumps(code))
            spark.createDataFrame([row], TRIALS).write.mode("append").parquet(path)
    finally:
        remove_path(spark, staged_path(folded))
    args = {"operator_name": operator, "scoring": scoring, "num_trials": num_trials, "cv": cv, "policy": policy}
    write_trajectory(search.trials(spark), f"{path}-trajectory", args)
    return search
