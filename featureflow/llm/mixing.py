"""Mixing sources to target weights over a domain - language - source tree.

Weights go down the tree: the children of a node share its budget in proportion to
their weights. A child can't take more tokens than its leaves hold in `max_epochs`
epochs; what it leaves is shared out among its siblings again, and only what no
sibling can take goes back to the parent's own siblings. All amounts are whole
tokens; what rounding leaves goes one token each to the first unfilled siblings by
name.

A leaf with budget b and t tokens takes b div t whole epochs and, of the next epoch,
the longest prefix of its seeded order that fits the rest. The order of an epoch is
that of md5(seed:epoch:doc_id). No leaf is sorted as a whole: hash ranges are summed
first, and only the range in which the prefix ends is put in order.

Defined results: NULL lang or source is a leaf named `unknown`; a NULL text has no
tokens; a leaf without tokens gets and gives nothing; rows that repeat a doc_id
are ordered by tokens and text hash and count one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.llm.common import WORD, staged_side, text_of
from featureflow.session import stage, tidy

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Target of a mixture. Weights are whole numbers; names without one get `other`.

    A level without weights follows its own sizes, in thousandths of the parent's tokens.
    """

    domains: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    other: int = 1
    budget: int | None = None  # tokens; None: as many as the table holds
    share: tuple[int, int] = (1, 1)  # of the budget, as a fraction
    max_epochs: int = 4
    seed: int = 17


#: The mixture of the registered query: web text is held back, reference text is repeated.
PRODUCTION = Mix(
    domains={
        "web": tuple(f"src{i}" for i in range(8)),
        "books": tuple(f"src{i}" for i in range(8, 12)),
        "reference": tuple(f"src{i}" for i in range(12, 16)),
    },
    weights={
        "domain": {"web": 40, "books": 25, "reference": 25, "other": 10},
        "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    },
)


#: The mixture of the pipeline: near the sizes at hand, each document twice at most.
PIPELINE = Mix(domains=PRODUCTION.domains, weights={"domain": {"web": 55, "books": 17, "reference": 17, "other": 11}}, max_epochs=2)


def word_count(column: str = "text") -> Column:
    """Tokens of a text as the mixture counts them: words between ASCII white space."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def _names(mix: Mix) -> list[Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    domain = F.lit("other")
    for name, members in mix.domains.items():
        domain = F.when(source.isin(*members), F.lit(name)).otherwise(domain)
    return [domain.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"), source.alias("source")]


def _weight(level: str, parents: list[str], mix: Mix) -> Column:
    if not mix.weights.get(level):
        by = ", ".join(parents) or "0"
        return F.expr(f"1 + coalesce(1000 * tokens DIV nullif(sum(tokens) OVER (PARTITION BY {by}), 0), 0)")
    out = F.lit(mix.other)
    for name, w in mix.weights[level].items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds `share`: each node's part of `budget` (the same for all children of a parent).

    Needs columns weight, capacity, budget. A child is full if its capacity is at
    most its part of what the fuller children before it leave; the others part the
    rest by weight.
    """
    same = Window.partitionBy(*parents)
    line = same.orderBy(F.col("capacity") / F.col("weight"), name)
    total = lambda c: F.sum(c).over(same)
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0))
    nodes = nodes.withColumn("weight", F.greatest("weight", F.lit(1)))
    nodes = nodes.withColumns(
        {
            "part": F.least("budget", total("capacity")),
            "c_before": F.coalesce(F.sum("capacity").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "w_from": F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    nodes = nodes.withColumn("full", F.expr("capacity * w_from <= weight * (part - c_before)"))
    nodes = nodes.withColumns(
        {
            "rest": F.col("part") - total(F.when(F.col("full"), F.col("capacity")).otherwise(0)),
            "w_open": total(F.when(~F.col("full"), F.col("weight")).otherwise(0)),
            "nth": F.row_number().over(Window.partitionBy(*parents, "full").orderBy(name)),
        }
    )
    nodes = nodes.withColumn("down", F.expr("CASE WHEN full THEN 0 ELSE weight * rest DIV w_open END"))
    left = F.col("rest") - total("down")
    share = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("down") + F.when(F.col("nth") <= left, 1).otherwise(0))
    out = nodes.withColumn("share", share.cast("long"))
    return out.drop("part", "c_before", "w_from", "full", "rest", "w_open", "nth", "down")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, n_rows, tokens, budget of every leaf (one row per leaf)."""
    num, den = mix.share
    start = F.lit(mix.budget).cast("long") if mix.budget is not None else F.expr(f"sum(tokens) OVER (PARTITION BY 0) * {num} DIV {den}")
    nodes = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    budgets, keys = None, []
    for level in LEVELS:
        below = nodes.groupBy(*keys, level).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        below = below.withColumn("weight", _weight(level, keys, mix))
        below = below.join(budgets, keys) if keys else below.withColumn("budget", start)
        shared = share_out(below, keys or [F.lit(0)], level)
        keys = [*keys, level]
        budgets = shared.select(*keys, F.col("share").alias("budget"))
    return leaves.join(budgets, list(LEVELS))


def _order(mix: Mix, epoch: Column) -> Column:
    """60 bits of md5(seed:epoch:doc_id)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _placed(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """Rows with their leaf's plan, their place `u` in its last epoch and hash range `part`."""
    out = rows.join(leaves, list(LEVELS)).where("tokens > 0")
    out = out.withColumn("u", _order(mix, F.col("whole")))
    return out.withColumn("part", F.floor(F.col("u") / float(1 << 60) * F.col("n_parts")).cast("long"))


@tidy
def mix_rows(docs: DataFrame, mix: Mix = PRODUCTION, whole_rows: bool = False) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, leaf_budget of every chosen row.

    With `whole_rows` the rows of `docs` themselves, all columns, once per epoch.
    """
    own = [*_names(mix), F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("n_tokens"), F.xxhash64(text_of()).alias("tie")]
    rows = stage(docs.select(*own))
    leaves = rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(stage(leaves), mix).withColumns(
        {
            "whole": F.expr("CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 0 END"),
            "rest": F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END"),
            "n_parts": F.greatest(F.lit(1), F.floor(F.sqrt("n_rows"))),
        }
    )
    plan = staged_side(plan)
    parts = _placed(rows, plan, mix).groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    line = Window.partitionBy(*LEVELS).orderBy("part")
    parts = parts.withColumn("before", F.sum("t").over(line) - F.col("t"))
    cut = parts.where("before <= rest AND rest < before + t").select(*LEVELS, F.col("part").alias("cut"), "before")
    plan = staged_side(plan.join(cut, list(LEVELS), "left"))
    if whole_rows:
        names = docs.columns
        rows = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), *own)
    placed = _placed(rows, plan, mix)
    last = placed.where("part = cut")  # the one range per leaf that is put in order
    order = Window.partitionBy(*LEVELS).orderBy("u", F.col("doc_id").asc_nulls_last(), "n_tokens", "tie").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("taken", F.col("before") + F.sum("n_tokens").over(order)).where("taken <= rest").drop("taken")
    partial = placed.where("part < cut").unionByName(last).withColumn("epoch", F.col("whole"))
    full = placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    chosen = full.unionByName(partial)
    if whole_rows:
        return chosen.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
    return chosen.select("doc_id", *LEVELS, "epoch", "n_tokens", F.col("budget").alias("leaf_budget"))


def mix_sql(mix: Mix = PRODUCTION) -> str:
    """The same result in DuckDB's SQL, for tables with unique doc_id."""
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    domain = "CASE " + " ".join(f"WHEN source IN ({listed(m)}) THEN '{d}'" for d, m in mix.domains.items()) + " ELSE 'other' END"

    def weight(level: str, by: str) -> str:
        cases = "".join(f" WHEN {level} = '{n}' THEN {w}" for n, w in mix.weights.get(level, {}).items())
        return f"CASE{cases} ELSE {mix.other} END" if cases else f"1 + coalesce(1000 * tokens // nullif(sum(tokens) OVER ({by}), 0), 0)"

    def shared(level: str, parents: list[str], above: str) -> str:
        keys, by = ", ".join([*parents, level]), f"PARTITION BY {', '.join(parents)}" if parents else ""
        budget = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
        return f"""
{level}_t AS (SELECT {keys}, sum(capacity)::BIGINT AS capacity, sum(tokens)::BIGINT AS tokens FROM leaves GROUP BY ALL),
{level}_n AS (SELECT {keys}, capacity, ({weight(level, by)})::BIGINT AS weight FROM {level}_t),
{level}_a AS (SELECT *, least(budget, sum(capacity) OVER ({by})) AS part,
  coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
  sum(weight) OVER ({by} ORDER BY capacity / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM {level}_n {budget}),
{level}_f AS (SELECT *, capacity * w_from <= weight * (part - c_before) AS filled FROM {level}_a),
{level}_r AS (SELECT *, part - sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({by}) AS rest,
  sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}) AS w_open,
  row_number() OVER (PARTITION BY {', '.join([*parents, 'filled'])} ORDER BY {level}) AS nth FROM {level}_f),
{level}_d AS (SELECT *, CASE WHEN filled THEN 0 ELSE weight * rest // w_open END AS down FROM {level}_r),
{level}_b AS (SELECT {keys}, (CASE WHEN filled THEN capacity ELSE down + CASE WHEN nth <= rest - sum(down) OVER ({by}) THEN 1 ELSE 0 END END)::BIGINT AS budget
  FROM {level}_d)"""

    num, den = mix.share
    start = str(mix.budget) if mix.budget is not None else f"(sum(tokens)::BIGINT * {num} // {den})"
    digest = "('0x' || substring(md5('{s}:' || {e} || ':' || doc_id), 1, 15))::BIGINT".replace("{s}", str(mix.seed))
    return f"""
WITH docs AS (SELECT doc_id, {domain} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {mix.max_epochs})::BIGINT AS capacity FROM docs GROUP BY ALL),
start AS (SELECT {start} AS budget FROM leaves),{shared("domain", [], "start")},{shared("lang", ["domain"], "domain_b")},{shared("source", ["domain", "lang"], "lang_b")},
plan AS (SELECT domain, lang, source, tokens, budget, budget // tokens AS whole, budget % tokens AS rest
  FROM leaves JOIN source_b USING (domain, lang, source) WHERE tokens > 0),
placed AS (SELECT *, {digest.replace("{e}", "whole")} AS u FROM docs JOIN plan USING (domain, lang, source)),
taken AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS t FROM placed)
SELECT doc_id, domain, lang, source, whole::BIGINT AS epoch, n_tokens, budget AS leaf_budget FROM taken WHERE t <= rest
UNION ALL
SELECT doc_id, domain, lang, source, unnest(range(0, whole::BIGINT)) AS epoch, n_tokens, budget AS leaf_budget FROM placed"""
