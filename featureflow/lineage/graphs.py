"""Many graphs in two tables: nodes(graph_id, id, type, label) and edges(graph_id, source, target).

All walks are keyed joins. Iterations stage their state in the shared folder, so plans stay
short and a lost executor costs one round; parent chains are walked by doubling.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.operators.windows import running
from featureflow.session import remove_path, stage, staged_path

G = "graph_id"
#: Graphs of at most so many nodes and edges are walked whole, one task each; larger ones by joins.
WHOLE = 200_000


def validate_graphs(nodes: DataFrame, edges: DataFrame, check_cycles: bool = True) -> DataFrame:
    """(graph_id, error, subject): empty or repeated ids, missing type or label, dangling edges.

    Graphs without such errors are also tested for cycles.
    """
    no_id = F.coalesce(F.col("id").cast("string"), F.lit("")) == ""
    parts = [
        nodes.where(no_id).select(G, F.lit("missing id").alias("error"), F.lit(None).cast("string").alias("subject")),
        nodes.where(~no_id).groupBy(G, "id").count().where("count > 1").select(
            G, F.lit("duplicate id").alias("error"), F.col("id").cast("string").alias("subject")
        ),
    ]
    for c in ("type", "label"):
        parts.append(
            nodes.where(F.col(c).isNull()).select(
                G, F.lit(f"missing {c}").alias("error"), F.col("id").cast("string").alias("subject")
            )
        )
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    parts.append(
        edges.where(~whole).select(
            G, F.lit("missing source or target").alias("error"),
            F.coalesce(F.col("source"), F.col("target")).cast("string").alias("subject"),
        )
    )
    ids = nodes.where(~no_id).select(G, "id").distinct()
    src = edges.where(whole).join(ids.withColumnRenamed("id", "source"), [G, "source"], "left_anti")
    parts.append(src.select(G, F.lit("source not in nodes").alias("error"), F.col("source").cast("string").alias("subject")))
    known = edges.where(whole).join(ids.withColumnRenamed("id", "source"), [G, "source"], "left_semi")
    tgt = known.join(ids.withColumnRenamed("id", "target"), [G, "target"], "left_anti")
    parts.append(tgt.select(G, F.lit("target not in nodes").alias("error"), F.col("target").cast("string").alias("subject")))
    errors = reduce(lambda a, b: a.unionByName(b), parts)
    if not check_cycles:
        return errors
    errors = stage(errors)
    bad = errors.select(G).distinct()
    clean_nodes, clean_edges = nodes.join(bad, G, "left_anti"), edges.join(bad, G, "left_anti")
    cyc = acyclic(clean_nodes, clean_edges).where(~F.col("is_acyclic"))
    return errors.unionByName(
        cyc.select(G, F.lit("cycle").alias("error"), F.lit(None).cast("string").alias("subject"))
    )


def _heads(left: DataFrame, inward: DataFrame) -> DataFrame:
    """(graph_id, id, head, far), staged: where the walk up over single parents ends, and its length.

    Nodes with one incoming edge point at its source; pointers double their reach per round.
    The head is NULL for nodes that end in a cycle or at an unknown node.
    """
    up = F.when(F.col("_n") == 1, F.col("_up"))
    state = left.join(inward, [G, "id"], "left").select(
        G, "id", F.coalesce(up, F.col("id")).alias("head"), up.isNotNull().cast("int").alias("far"), up.isNotNull().alias("_open")
    )
    state = stage(state)
    size = state.groupBy(G).count().agg(F.max("count")).first()[0] or 0
    for _ in range(size.bit_length() + 1):
        if state.where("_open").isEmpty():
            break
        hop = state.select(G, F.col("id").alias("head"), F.col("head").alias("_h"), F.col("far").alias("_f"), F.col("_open").alias("_o"))
        moved = state.join(hop, [G, "head"], "left").select(
            G, "id",
            F.when(F.col("_open"), F.col("_h")).otherwise(F.col("head")).alias("head"),
            F.when(F.col("_open"), F.col("far") + F.coalesce("_f", F.lit(0))).otherwise(F.col("far")).alias("far"),
            (F.col("_open") & F.coalesce("_o", F.lit(False)) & F.col("_h").isNotNull()).alias("_open"),
        )
        state = stage(moved, replaces=staged_path(state))
    return stage(state.select(G, "id", F.when(~F.col("_open"), F.col("head")).alias("head"), "far"), replaces=staged_path(state))


def _walk_whole() -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Levels of one graph's nodes, by taking off nodes whose sources all have levels."""

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        at = {x: i for i, x in enumerate(nodes.column("id").to_pylist())}
        level, waits, after = [0] * len(at), [0] * len(at), [[] for _ in at]
        for source, target in zip(edges.column("source").to_pylist(), edges.column("target").to_pylist(), strict=True):
            if source != target and target in at:
                waits[at[target]] += 1
                if source in at:  # an unknown source never comes off
                    after[at[source]].append(at[target])
        ready = [i for i, n in enumerate(waits) if n == 0]
        for i in ready:  # grows while it is walked
            for j in after[i]:
                level[j] = max(level[j], level[i] + 1)
                waits[j] -= 1
                if waits[j] == 0:
                    ready.append(j)
        found = pa.array([None if n else x for x, n in zip(level, waits, strict=True)], pa.int32())
        return nodes.select([G, "id"]).append_column("level", found)

    return run


def _peel(nodes: DataFrame, edges: DataFrame, whole: int | None = None) -> DataFrame:
    """(graph_id, id, level): the longest distance from a root.

    Nodes in or behind a cycle, or behind an unknown source, get NULL. Self-loops do not
    count. Graphs of at most `whole` nodes and edges are walked in one round, a task each.
    """
    whole = WHOLE if whole is None else whole
    left = stage(nodes.select(G, "id").distinct())
    links = stage(edges.where("source <> target").select(G, "source", "target").distinct())
    sizes = left.select(G).unionAll(links.select(G)).groupBy(G).count()
    large = stage(sizes.where(F.col("count") > whole).select(G))
    out = f"{G} {left.schema[G].dataType.simpleString()}, id {left.schema['id'].dataType.simpleString()}, level int"
    no_large = large.isEmpty()
    if no_large:
        remove_path(nodes.sparkSession, staged_path(large))
    some_left, some_links = (left, links) if no_large else (left.join(large, G, "left_anti"), links.join(large, G, "left_anti"))
    small = some_left.groupBy(G).cogroup(some_links.groupBy(G)).applyInArrow(_walk_whole(), out)
    if no_large:
        return small
    return small.unionByName(_peel_by_joins(left.join(large, G, "left_semi"), links.join(large, G, "left_semi")))


def _peel_by_joins(left: DataFrame, links: DataFrame) -> DataFrame:
    """The same for graphs of any size. Runs of nodes with one parent are walked by doubling, so chains and trees take
    as many rounds as their depth has binary digits; only where several edges meet do
    levels go up one round at a time, over the meeting nodes alone.
    """
    inward = links.groupBy(G, F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.max("source").alias("_up"))
    inward = stage(inward)
    heads = _heads(left, inward)
    meeting = inward.where("_n > 1").select(G, F.col("id").alias("target"))
    into = links.join(meeting, [G, "target"], "left_semi").join(heads.withColumnRenamed("id", "source"), [G, "source"], "left")
    # one edge per (head, meeting node): the longest way; a way from nowhere keeps its node without a level
    into = stage(into.groupBy(G, "target", "head").agg((F.max("far") + 1).alias("_w")))
    need = into.groupBy(G, "target").agg(F.count(F.lit(1)).alias("_need"))
    need = stage(need)
    front = stage(left.join(inward.select(G, "id"), [G, "id"], "left_anti").withColumn("level", F.lit(0)))
    known, paths, seen = front, [staged_path(front)], None
    while not front.isEmpty():
        came = into.join(front.withColumnRenamed("id", "head"), [G, "head"]).select(
            G, "target", (F.col("level") + F.col("_w")).alias("_best"), F.lit(1).cast("bigint").alias("_got")
        )
        both = came if seen is None else seen.unionByName(came)
        seen_now = stage(both.groupBy(G, "target").agg(F.max("_best").alias("_best"), F.sum("_got").alias("_got")), replaces=staged_path(seen) if seen else None)
        ready = seen_now.join(need, [G, "target"]).where("_got = _need")
        done = known.select(G, F.col("id").alias("target"))
        front = stage(ready.join(done, [G, "target"], "left_anti").select(G, F.col("target").alias("id"), F.col("_best").cast("int").alias("level")))
        seen = seen_now
        paths.append(staged_path(front))
        known = left.sparkSession.read.schema(front.schema).parquet(*paths)
    level = known.select(G, F.col("id").alias("head"), F.col("level").alias("_l"))
    out = stage(heads.join(level, [G, "head"], "left").select(G, "id", (F.col("_l") + F.col("far")).cast("int").alias("level")))
    for old in (*paths, *(staged_path(x) for x in (inward, heads, into, need, seen) if x is not None)):
        remove_path(left.sparkSession, old)
    return out


def acyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, is_acyclic) for every graph that has nodes."""
    return _peel(nodes, edges).groupBy(G).agg((F.count(F.when(F.col("level").isNull(), 1)) == 0).alias("is_acyclic"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with `level` (longest distance from a root); NULL = in or behind a cycle, ordered last."""
    return nodes.join(_peel(nodes, edges), [G, "id"], "left")


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(G, F.col("target").alias("source"), F.col("source").alias("target"), F.col("_t").alias("_s"), F.col("_s").alias("_t"))


def _pass_through(edges: DataFrame) -> DataFrame:
    """`edges` (staged, replaced) without removed nodes that lead to one node only, and without ways that end in a removed node.

    A run of such nodes is walked by doubling: what leads into it leads to its end. A
    cycle of them leads nowhere.
    """
    loops = F.col("_s") & (F.col("source") == F.col("target"))
    out = edges.where("_s").where(~loops).groupBy(G, F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.max("target").alias("_up"))
    out = stage(out)
    ends = edges.where("_t").select(G, F.col("target").alias("id")).unionByName(out.where("_n = 1").select(G, F.col("_up").alias("id"))).unionByName(out.select(G, "id"))
    heads = _heads(ends.distinct(), out)
    # a removed node stays if it leads to several nodes
    forks = out.where("_n > 1").select(G, F.col("id").alias("head"), F.lit(True).alias("_fork"))
    gone = edges.where("_s").select(G, F.col("source").alias("head"), F.lit(True).alias("_gone")).unionByName(edges.where("_t").select(G, F.col("target").alias("head"), F.lit(True).alias("_gone"))).distinct()
    led = heads.where("head IS NOT NULL").join(gone, [G, "head"], "left").join(forks, [G, "head"], "left").where("_gone IS NULL OR _fork")
    led = led.select(G, F.col("id").alias("target"), "head", F.col("_fork").isNotNull().alias("_t"))
    kept = edges.where("_s").join(forks.select(G, F.col("head").alias("source")), [G, "source"], "left_semi").unionByName(edges.where("NOT _s"))
    through = kept.where("_t").drop("_t").join(led, [G, "target"]).select(G, "source", F.col("head").alias("target"), "_s", "_t")
    whole = kept.where("NOT _t").unionByName(through.where(~(F.col("_s") & (F.col("source") == F.col("target")))))
    done = stage(whole.distinct(), replaces=staged_path(edges))
    for old in (out, heads):
        remove_path(edges.sparkSession, staged_path(old))
    return done


def contract(nodes: DataFrame, edges: DataFrame, internal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove internal nodes; every kept source reaches every kept target behind them.

    Returns (nodes, edges); edges are distinct. Removed nodes with one way out, then those with one way in,
    are taken out first, again and again until none is left: that keeps or lowers the number of
    edges, and whole chains go in one round. Only from the removed nodes where ways both meet and part are
    pairs (source, removed node) formed, each once.
    """
    spark = nodes.sparkSession
    gone = stage(internal.select(G, "id").distinct())
    kept_nodes = nodes.join(gone, [G, "id"], "left_anti")
    marks_t = gone.select(G, F.col("id").alias("target"), F.lit(True).alias("_t"))
    marks_s = gone.select(G, F.col("id").alias("source"), F.lit(True).alias("_s"))
    flagged = stage(
        edges.select(G, "source", "target").distinct().join(marks_s, [G, "source"], "left")
        .join(marks_t, [G, "target"], "left")
        .select(G, "source", "target", F.col("_s").isNotNull().alias("_s"), F.col("_t").isNotNull().alias("_t"))
    )
    if not flagged.where("_s AND _t").isEmpty():
        left, before = flagged.count(), None
        while left != before:
            flagged = _pass_through(flagged)
            back = stage(_flip(flagged), replaces=staged_path(flagged))
            back = _pass_through(back)
            flagged = stage(_flip(back), replaces=staged_path(back))
            left, before = flagged.count(), left
    direct = flagged.where("NOT _s AND NOT _t").select(G, "source", "target")
    inner = flagged.where("_s").select(G, F.col("source").alias("_at"), F.col("target").alias("_to"), "_t")
    front = stage(flagged.where("NOT _s AND _t").select(G, "source", F.col("target").alias("_at")))
    steps, fronts = [], [front]
    while not front.isEmpty():  # each round reaches new pairs, so it ends
        steps.append(stage(front.join(inner, [G, "_at"]).select(G, "source", "_to", "_t").distinct()))
        ahead = steps[-1].where("_t").select(G, "source", F.col("_to").alias("_at"))
        seen = spark.read.schema(front.schema).parquet(*[staged_path(f) for f in fronts])
        front = stage(ahead.join(seen, [G, "source", "_at"], "left_anti"))
        fronts.append(front)
    found = [direct, *(s.where("NOT _t").select(G, "source", F.col("_to").alias("target")) for s in steps)]
    out = stage(reduce(lambda a, b: a.unionByName(b), found).distinct())
    for old in (flagged, *steps, *fronts):
        remove_path(spark, staged_path(old))
    return kept_nodes, out


def prune(nodes: DataFrame, edges: DataFrame, final: DataFrame | None = None,
          prune_isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Remove isolated nodes, and dead ends that are not the graph's declared output. One pass.

    `final` is (graph_id, id); dead ends are removed only in graphs whose output is a node.
    """
    sources = edges.select(G, F.col("source").alias("id"))
    ends = sources.unionByName(edges.select(G, F.col("target").alias("id"))).distinct()
    flagged = nodes.join(ends.withColumn("_touched", F.lit(True)), [G, "id"], "left").join(
        sources.distinct().withColumn("_leads", F.lit(True)), [G, "id"], "left"
    )
    drop = F.lit(False)
    if prune_isolated:
        drop = F.col("_touched").isNull()
    if final is not None:
        out = final.select(G, F.col("id").alias("_out")).join(
            nodes.select(G, F.col("id").alias("_out")).distinct(), [G, "_out"], "left_semi"
        )
        flagged = flagged.join(out, G, "left")
        dead = F.col("_out").isNotNull() & (F.col("id") != F.col("_out")) & F.col("_leads").isNull()
        drop = drop | dead
    flagged = flagged.withColumn("_drop", F.coalesce(drop, F.lit(False)))
    kept = flagged.where(~F.col("_drop")).select(*nodes.columns)
    gone = flagged.where("_drop").select(G, "id")
    kept_edges = edges.join(gone.withColumnRenamed("id", "source"), [G, "source"], "left_anti").join(
        gone.withColumnRenamed("id", "target"), [G, "target"], "left_anti"
    )
    return kept, kept_edges.select(*edges.columns)


def nearest_mapped(nodes: DataFrame, parents: DataFrame, mapping: DataFrame) -> DataFrame:
    """(graph_id, id, mapped): own mapping, else that of the nearest ancestor over first parents.

    `parents` is (graph_id, id, parent) with one row per node; `mapping` is (graph_id, id, mapped).
    Nodes without a mapped ancestor get NULL. Rounds double the distance.
    """
    state = stage(
        nodes.select(G, "id").distinct().join(mapping, [G, "id"], "left").join(parents, [G, "id"], "left").select(
            G, "id", "mapped", F.when(F.col("mapped").isNull(), F.col("parent")).alias("_up")
        )
    )
    size = state.groupBy(G).count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(size - 1, 0).bit_length() + 1):
        if state.where("_up IS NOT NULL").limit(1).count() == 0:
            break
        hop = state.select(G, F.col("id").alias("_up"), F.col("mapped").alias("_m"), F.col("_up").alias("_u"))
        state = stage(
            state.join(hop, [G, "_up"], "left").select(
                G, "id", F.coalesce("mapped", "_m").alias("mapped"), F.col("_u").alias("_up")
            ),
            replaces=staged_path(state),
        )
    return state.select(G, "id", "mapped")


def merge_missing(run_nodes: DataFrame, run_edges: DataFrame, plan_nodes: DataFrame, plan_edges: DataFrame,
                  prefix: str = "in_") -> tuple[DataFrame, DataFrame]:
    """Complete a run graph with plan nodes whose label it lacks.

    plan_nodes carry `pos`. Added nodes get ids `in_<n>` in plan order, after any such ids in use.
    Edges between added nodes follow the plan; the last added node leads to the run node that
    consumes it in the plan (by label), else to the first run root.
    """
    missing = plan_nodes.join(run_nodes.select(G, "label").distinct(), [G, "label"], "left_anti")
    used = (
        run_nodes.where(F.col("id").rlike(f"^{prefix}[0-9]+$"))
        .groupBy(G)
        .agg(F.max(F.expr(f"substring(id, {len(prefix) + 1})").cast("bigint")).alias("_used"))
    )
    numbered = running(missing, [G], ["pos"], {"_n": ("count", F.lit(1))}).join(used, G, "left")
    new_id = F.concat(F.lit(prefix), (F.col("_n") - 1 + F.coalesce(F.col("_used") + 1, F.lit(0))).cast("string"))
    named = stage(numbered.select(G, "pos", F.col("id").alias("_plan"), new_id.alias("id"), "label"))
    nodes = run_nodes.select(G, "id", "label").unionByName(named.select(G, "id", "label"))

    a = named.select(G, F.col("_plan").alias("source"), F.col("id").alias("_s"))
    b = named.select(G, F.col("_plan").alias("target"), F.col("id").alias("_t"))
    among = plan_edges.join(a, [G, "source"]).join(b, [G, "target"]).select(
        G, F.col("_s").alias("source"), F.col("_t").alias("target")
    )
    last = named.groupBy(G).agg(F.max_by(F.struct("_plan", "id"), "pos").alias("l")).select(
        G, F.col("l._plan").alias("source"), F.col("l.id").alias("_s")
    )
    labels = plan_nodes.select(G, F.col("id").alias("target"), "label")
    by_label = run_nodes.groupBy(G, "label").agg(F.min("id").alias("_t"))
    eaters = (
        plan_edges.join(last, [G, "source"]).join(labels, [G, "target"]).join(by_label, [G, "label"])
        .groupBy(G).agg(F.min("_t").alias("_eater"))
    )
    roots = run_nodes.join(run_edges.select(G, F.col("target").alias("id")), [G, "id"], "left_anti")
    first_root = roots.groupBy(G).agg(F.min("id").alias("_root"))
    bridge = last.join(first_root, G).join(eaters, G, "left").select(
        G, F.col("_s").alias("source"), F.coalesce("_eater", "_root").alias("target")
    )
    edges = run_edges.select(G, "source", "target").unionByName(among).unionByName(bridge).distinct()
    return nodes, edges


def producer_edges(refs: DataFrame, hot_rows: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Distinct (graph_id, source, target): each consumer and the last earlier producer of its name.

    `refs` is (graph_id, pos, node, var, role) with role "produces" or "consumes". A node that
    consumes and produces one name at one position sees the earlier producer.
    """
    keyed = refs.withColumns(
        {
            "_late": F.when(F.col("role") == "produces", 1).otherwise(0),
            "_p": F.when(F.col("role") == "produces", F.col("node")),
        }
    )
    linked = running(keyed, [G, "var"], ["pos", "_late", "node"], {"_src": ("last", "_p")}, hot_rows, chunk_rows)
    ok = (F.col("role") == "consumes") & F.col("_src").isNotNull() & (F.col("_src") != F.col("node"))
    return linked.where(ok).select(G, F.col("_src").alias("source"), F.col("node").alias("target")).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, component): smallest id of the undirected component.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so rounds grow with the logarithm of the diameter. A hub costs one partial minimum.
    """
    both = edges.where("source <> target").select(G, "source", "target")
    both = stage(both.unionByName(both.select(G, F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    state = stage(nodes.select(G, "id").distinct().withColumn("component", F.col("id")))
    while True:  # components only fall, so rounds end
        near = (
            both.join(state.select(G, F.col("id").alias("target"), "component"), [G, "target"])
            .groupBy(G, F.col("source").alias("id")).agg(F.min("component").alias("_m"))
        )
        better = stage(
            state.join(near, [G, "id"], "left").select(
                G, "id", F.col("component").alias("_old"), F.least("component", "_m").alias("component")
            )
        )
        hop = better.select(G, F.col("id").alias("component"), F.col("component").alias("_c"))
        nxt = stage(
            better.join(hop, [G, "component"], "left").select(
                G, "id", "_old", F.least("component", "_c").alias("component")
            ),
            replaces=staged_path(state),
        )
        moved = nxt.where("component <> _old").limit(1).count()
        state = nxt
        if not moved:
            return state.select(G, "id", "component")
