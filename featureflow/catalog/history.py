"""Checked queries for run logs, trajectories, lineage graphs, search policies and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from featureflow.catalog.registry import query
from featureflow.catalog.relational import BEST_SQL, fresh, r
from featureflow.lineage import graphs as K
from featureflow.lineage import trajectories as TR
from featureflow.plans.scenario import oracle_with, table, view
from featureflow.search import policies as PO
from featureflow.sources import documents as DOC
from featureflow.sources import logs as LOG
from featureflow.streaming import events as ST


def as_json_text(c):
    """A JSON string literal that holds the text (double encoding)."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def documents(spark, sf):
    """Every run twice: a document (plain or doubly encoded) and a broken copy of it."""
    docs = DOC.outcomes_json(view(spark, sf, "trials"))
    config = F.lit('{"search_config": {"llm_for_code_generation": {"name": "vendor/model-a", "parameters": {"temperature": 0.5}}}, ')
    whole = docs.withColumn("document", F.concat(config, F.expr("substring(document, 2)")))
    packed = F.when(F.col("run_id") % 2 == 0, F.col("document")).otherwise(as_json_text(F.col("document")))
    good = whole.select(packed.alias("value"))
    bad = whole.select(F.expr("substring(document, 1, length(document) - 5)").alias("value"))
    return good.unionByName(bad)


@query(
    "s4_k1_g8_trajectory_documents",
    oracle_with("trials") + " SELECT CAST(run_id AS VARCHAR) AS run_id, trial, parent_trial, operator, score, 'vendor/model-a' AS model,"
    " 0.5::DOUBLE AS temperature FROM trials",
)
def s4(spark, sf):
    t = DOC.parse_trajectories(documents(spark, sf), "value")
    return TR.explode_outcomes(t, keep=("model", "temperature")).drop("code")


@query(
    "s4_trajectory_lines_roundtrip",
    oracle_with("trials") + " SELECT CAST(run_id AS VARCHAR) AS run_id, trial, parent_trial, operator, score FROM trials",
)
def s4f(spark, sf):
    path = fresh(spark, "trajectories")
    DOC.write_trajectory(view(spark, sf, "trials"), path, {"scoring": "f1"}, {"llm_for_code_generation": {"name": "m"}})
    return TR.explode_outcomes(DOC.read_trajectories(spark, path, one_per_file=False)).drop("code")


def indented_runs(spark, sf):
    """Whole indented files of several lines, one document each, in folders named after their run and without a run id."""
    trials = view(spark, sf, "trials")
    node = F.struct(F.col("trial"), F.col("parent_trial"), F.col("operator").alias("operator_to_evolve"))
    runs = trials.groupBy("run_id").agg(F.collect_list(F.struct(node.alias("search_node"), "score")).alias("outcomes"))
    text = F.to_json(F.struct("outcomes"), {"pretty": "true"})
    path = fresh(spark, "indented")
    # a run is one row, so there is one file in its folder
    DOC.write_documents(runs.select(F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("run"), text.alias("value")), path, "run")
    return TR.explode_outcomes(DOC.read_trajectories(spark, path)).drop("code")


@query(
    "s4_indented_files_all_runs",
    oracle_with("trials") + " SELECT 'run-' || run_id AS run_id, trial, parent_trial, operator, score FROM trials",
)
def s4ia(spark, sf):
    return indented_runs(spark, sf)


@query(
    "s4_indented_files",
    oracle_with("trials") + " SELECT 'run-' || run_id AS run_id, count(*) AS trials, max(score) AS best, count(parent_trial) AS children FROM trials GROUP BY 1",
)
def s4i(spark, sf):
    """Every run in one row."""
    return indented_runs(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("trials"), F.max("score").alias("best"), F.count("parent_trial").alias("children"))


@query(
    "g8_s5_k1_long_runs",
    oracle_with("trials") + " SELECT CAST(run_id % 3 AS VARCHAR) AS run_id, count(*) AS trials, min(score) AS low FROM trials GROUP BY 1",
)
def g8s5(spark, sf):
    """Runs of many trials are written twice in parts; the newest export is read back with all its parts."""
    t = view(spark, sf, "trials")
    order = F.row_number().over(Window.partitionBy(F.col("run_id") % 3).orderBy("run_id", "trial"))
    long = t.withColumn("trial", (order - 1).cast("bigint")).withColumn("run_id", F.col("run_id") % 3)
    path = fresh(spark, "long-runs")
    DOC.write_trajectory(long.withColumn("score", F.col("score") - 1), path)
    DOC.write_trajectory(long, path)
    docs = DOC.newest_files(DOC.read_trajectories(spark, path, one_per_file=False), "run_id")
    return TR.explode_outcomes(docs).groupBy("run_id").agg(F.count(F.lit(1)).alias("trials"), F.min("score").alias("low"))


@query(
    "s5_newest_files",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase'"
    " THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1",
)
def s5(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", "event_id", F.col("ts").alias("modified"),
        F.concat(F.lit("/runs/"), F.col("event_type"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".json")).alias("file_path"),
        F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("prio"),
    )
    return DOC.newest_files(e, "user_id", "error", priority="prio").select("user_id", "event_id")


def run_logs(spark, sf):
    """One log text per document: its text, blocks of four kinds and one malformed block."""
    d = table(spark, sf, "documents")
    nl = F.lit("\n")

    def block(kind, body):
        return F.concat(nl, F.lit(f"##{kind}##"), nl, body, nl, F.lit("##END##"), nl)

    code = F.to_json(F.struct(F.col("doc_id").alias("index"), F.col("text").alias("code"), (F.col("n_chars") / 8.0).alias("cost_usd"), F.lit(2).alias("retries")))
    preview = F.to_json(F.struct(F.col("doc_id").cast("string").alias("node_id"), F.col("n_chars").alias("row_count")))
    unnamed = F.to_json(F.struct(F.col("n_chars").alias("row_count")))
    stats = F.to_json(F.struct((F.col("n_chars") * 2).alias("duration_ms")))
    log = F.concat(
        "text", block("RUNNER_NODE_CODE", code), block("NODE_PREVIEW", preview), F.lit("noise"), block("VAR_PREVIEW", unnamed),
        block("NODE_CODE", F.lit('{"code": ')), block("EXECUTION_STATS", stats), "text",
    )
    return d.select("doc_id", log.alias("log"))


@query(
    "s6_marked_blocks",
    "SELECT doc_id, 0::BIGINT AS position, 'NODE_CODE' AS kind, md5(text) AS code, n_chars / 8.0 AS cost, NULL::BIGINT AS row_count,"
    " NULL::DOUBLE AS duration FROM documents UNION ALL SELECT doc_id, 1, 'NODE_PREVIEW', NULL, NULL, n_chars, NULL FROM documents"
    " UNION ALL SELECT doc_id, 4, 'EXECUTION_STATS', NULL, NULL, NULL, n_chars * 2.0 FROM documents",
)
def s6(spark, sf):
    b = LOG.parse_marked_blocks(run_logs(spark, sf), "log")
    return b.select(
        "doc_id", "position", "kind", F.md5(F.col("fields.code").cast("binary")).alias("code"),
        F.col("fields.cost_usd").alias("cost"), F.col("fields.row_count").alias("row_count"),
        F.col("fields.duration_ms").alias("duration"),
    )


def event_lines(spark, sf):
    """Event lines with one note line and one broken line for every event."""
    e = view(spark, sf, "run_events")
    body = F.to_json(
        F.struct(
            F.col("type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("run_id").cast("string").alias("run_id"),
            F.col("seq").cast("string").alias("node_id"), F.col("cost").alias("cost_usd"),
        )
    )
    lines = F.explode(
        F.array(F.concat(F.lit("data: "), body, F.lit("  ")), F.lit(": keep-alive"), F.concat(F.lit("data: "), F.substring(body, 1, 20)))
    )
    return e.select(lines.alias("value"))


EVENTS_SQL = (
    oracle_with("run_events") + " SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(seq AS VARCHAR) AS node_id, type, cost AS cost_usd,"
    " epoch_us(ts) // 1000 AS ts_ms FROM run_events"
)


@query("s7_event_lines", EVENTS_SQL)
def s7(spark, sf):
    return LOG.parse_event_lines(event_lines(spark, sf)).select("run_id", "node_id", "type", "cost_usd", "ts_ms")


# --- trajectories -----------------------------------------------------------------------

CHAIN = """ , b AS (SELECT run_id, trial FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY
 coalesce(score, '-inf'::DOUBLE) DESC, trial) AS n FROM trials) WHERE n = 1), p AS (SELECT run_id, trial FROM b UNION ALL
 SELECT t.run_id, t.parent_trial FROM p JOIN trials t USING (run_id, trial) WHERE t.parent_trial IS NOT NULL)"""


@query(
    "k2_best_path",
    oracle_with("trials").replace("WITH ", "WITH RECURSIVE ", 1) + CHAIN
    + " SELECT t.run_id, t.trial, t.parent_trial, t.operator, t.score FROM trials t JOIN p USING (run_id, trial)",
)
def k2(spark, sf):
    return TR.best_path(view(spark, sf, "trials"))


CLOSURE = """, a AS (SELECT run_id, trial, trial AS top, 0 AS d FROM trials UNION ALL SELECT a.run_id, a.trial, t.parent_trial, d + 1
 FROM a JOIN trials t ON t.run_id = a.run_id AND t.trial = a.top JOIN trials u ON u.run_id = t.run_id AND u.trial = t.parent_trial),
 kids AS (SELECT run_id, parent_trial AS trial, count(*) AS children FROM trials WHERE parent_trial IS NOT NULL GROUP BY 1, 2)"""


@query(
    "k3_subtree_stats",
    oracle_with("trials").replace("WITH ", "WITH RECURSIVE ", 1) + CLOSURE
    + ", dep AS (SELECT run_id, trial, max(d) AS depth FROM a GROUP BY 1, 2) SELECT t.run_id, t.trial, CAST(depth AS BIGINT) AS depth,"
    " coalesce(k.children, 0) AS children, s.subtree_size, s.subtree_leaves FROM trials t JOIN dep USING (run_id, trial)"
    " LEFT JOIN kids k USING (run_id, trial) JOIN (SELECT a.run_id, a.top AS trial, count(*) AS subtree_size,"
    " count(*) FILTER (k.children IS NULL) AS subtree_leaves FROM a LEFT JOIN kids k ON k.run_id = a.run_id AND k.trial = a.trial"
    " GROUP BY 1, 2) s USING (run_id, trial)",
)
def k3(spark, sf):
    return TR.subtree_stats(view(spark, sf, "trials"))


@query(
    "k4_same_trajectory",
    oracle_with("trials") + ", b AS (SELECT run_id, trial, CASE WHEN operator = 'brand' AND score > 0.6 THEN score + 0.1 ELSE score END"
    " AS score FROM trials), x AS (SELECT run_id, count(*) AS n, max(coalesce(score, -1e9)) AS m, arg_max(coalesce(score, -1e9), trial)"
    " AS l FROM trials GROUP BY 1), y AS (SELECT run_id, count(*) AS n, max(coalesce(score, -1e9)) AS m,"
    " arg_max(coalesce(score, -1e9), trial) AS l FROM b GROUP BY 1) SELECT run_id, x.n = y.n AND abs(x.m - y.m) <= 1e-6 AND"
    " abs(x.l - y.l) <= 1e-6 AS same FROM x JOIN y USING (run_id)",
)
def k4(spark, sf):
    t = view(spark, sf, "trials")
    up = (F.col("operator") == "brand") & (F.col("score") > 0.6)
    return TR.same_trajectory(t, t.withColumn("score", F.when(up, F.col("score") + 0.1).otherwise(F.col("score"))))


# --- graphs -----------------------------------------------------------------------------


def graph(spark, sf):
    """Search trees as graphs; runs with an even spare number get one back edge to the root."""
    t = view(spark, sf, "trials")
    nodes = t.select(
        F.col("run_id").alias("graph_id"), F.col("trial").alias("id"), F.col("operator").alias("type"),
        F.when(F.col("score").isNotNull(), F.col("operator")).alias("label"),
    )
    edges = t.where("parent_trial IS NOT NULL").select(
        F.col("run_id").alias("graph_id"), F.col("parent_trial").alias("source"), F.col("trial").alias("target")
    )
    return nodes, edges


def cyclic(spark, sf):
    """The same with a back edge from trial 9 to trial 4 in every tenth run (4 is its parent)."""
    nodes, edges = graph(spark, sf)
    back = edges.where("target = 9 AND graph_id % 10 = 0").select("graph_id", F.col("target").alias("source"), F.col("source").alias("target"))
    return nodes, edges.unionByName(back)


TREE = oracle_with("trials") + """, nodes AS (SELECT run_id AS graph_id, trial AS id, operator AS type,
 CASE WHEN score IS NOT NULL THEN operator END AS label FROM trials), edges AS (SELECT run_id AS graph_id, parent_trial AS source,
 trial AS target FROM trials WHERE parent_trial IS NOT NULL)"""


@query(
    "k5_validate_graphs",
    TREE + " SELECT graph_id, 'missing label' AS error, CAST(id AS VARCHAR) AS subject FROM nodes WHERE label IS NULL UNION ALL"
    " SELECT graph_id, 'duplicate id', CAST(id AS VARCHAR) FROM nodes GROUP BY ALL HAVING count(*) > 1 UNION ALL"
    " SELECT graph_id, 'source not in nodes', CAST(source AS VARCHAR) FROM edges ANTI JOIN (SELECT graph_id, id AS source FROM nodes)"
    " USING (graph_id, source)",
)
def k5(spark, sf):
    nodes, edges = graph(spark, sf)
    return K.validate_graphs(nodes, edges)


@query(
    "k6_acyclic",
    oracle_with("trials") + " SELECT run_id AS graph_id, NOT (run_id % 10 = 0 AND count(*) FILTER (trial = 9) > 0 ) AS is_acyclic"
    " FROM trials GROUP BY 1",
)
def k6(spark, sf):
    nodes, edges = cyclic(spark, sf)
    known = edges.join(nodes.select("graph_id", F.col("id").alias("source")), ["graph_id", "source"], "left_semi")
    return K.acyclic(nodes, known)


@query(
    "k7_contract",
    TREE.replace("WITH ", "WITH RECURSIVE ", 1) + ", walk AS (SELECT graph_id, source, target FROM edges WHERE source % 5 <> 3 UNION"
    " SELECT w.graph_id, w.source, e.target FROM walk w JOIN edges e ON e.graph_id = w.graph_id AND e.source = w.target"
    " WHERE w.target % 5 = 3) SELECT DISTINCT * FROM walk WHERE target % 5 <> 3",
)
def k7(spark, sf):
    nodes, edges = graph(spark, sf)
    return K.contract(nodes, edges, nodes.where("id % 5 = 3"))[1]


@query(
    "k8_prune",
    TREE + ", o AS (SELECT graph_id, max(id) AS id FROM nodes GROUP BY 1), d AS (SELECT n.graph_id, n.id FROM nodes n JOIN o USING"
    " (graph_id) WHERE n.id <> o.id AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.source = n.id)"
    " UNION SELECT graph_id, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND"
    " (e.source = n.id OR e.target = n.id))) SELECT graph_id, id, type, label FROM nodes ANTI JOIN d USING (graph_id, id)",
)
def k8(spark, sf):
    nodes, edges = graph(spark, sf)
    final = nodes.groupBy("graph_id").agg(F.max("id").alias("id"))
    return K.prune(nodes, edges, final)[0]


def whole_graph(nodes, edges):
    """Nodes and edges as rows of one table."""
    none = F.lit(None).cast(dict(nodes.dtypes)["id"])
    rows = nodes.select(F.lit("node").alias("kind"), "graph_id", F.col("id").alias("a"), none.alias("b"))
    return rows.unionByName(edges.select(F.lit("edge").alias("kind"), "graph_id", F.col("source").alias("a"), F.col("target").alias("b")))


@query(
    "k7_contract_graph",
    TREE.replace("WITH ", "WITH RECURSIVE ", 1) + ", walk AS (SELECT graph_id, source, target FROM edges WHERE source % 5 <> 3 UNION"
    " SELECT w.graph_id, w.source, e.target FROM walk w JOIN edges e ON e.graph_id = w.graph_id AND e.source = w.target"
    " WHERE w.target % 5 = 3) SELECT 'node' AS kind, graph_id, id AS a, NULL::BIGINT AS b FROM nodes WHERE id % 5 <> 3"
    " UNION ALL SELECT DISTINCT 'edge', graph_id, source, target FROM walk WHERE target % 5 <> 3",
)
def k7g(spark, sf):
    nodes, edges = graph(spark, sf)
    return whole_graph(*K.contract(nodes, edges, nodes.where("id % 5 = 3")))


@query(
    "k8_prune_graph",
    TREE + ", o AS (SELECT graph_id, max(id) AS id FROM nodes GROUP BY 1), d AS (SELECT n.graph_id, n.id FROM nodes n JOIN o USING"
    " (graph_id) WHERE n.id <> o.id AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.source = n.id)"
    " UNION SELECT graph_id, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND"
    " (e.source = n.id OR e.target = n.id))) SELECT 'node' AS kind, graph_id, id AS a, NULL::BIGINT AS b FROM nodes ANTI JOIN d USING (graph_id, id)"
    " UNION ALL SELECT 'edge', e.graph_id, e.source, e.target FROM edges e WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.graph_id = e.graph_id"
    " AND (d.id = e.source OR d.id = e.target))",
)
def k8g(spark, sf):
    nodes, edges = graph(spark, sf)
    final = nodes.groupBy("graph_id").agg(F.max("id").alias("id"))
    return whole_graph(*K.prune(nodes, edges, final))


@query(
    "k9_levels",
    TREE.replace("WITH ", "WITH RECURSIVE ", 1) + ", w AS (SELECT graph_id, id, 0 AS level FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM"
    " edges e WHERE e.graph_id = n.graph_id AND e.target = n.id) UNION ALL SELECT e.graph_id, e.target, level + 1 FROM w JOIN edges e"
    " ON e.graph_id = w.graph_id AND e.source = w.id) SELECT n.graph_id, n.id, n.type, n.label, CAST(max(level) AS BIGINT) AS level"
    " FROM nodes n LEFT JOIN w USING (graph_id, id) GROUP BY ALL",
)
def k9(spark, sf):
    nodes, edges = graph(spark, sf)
    return K.levels(nodes, edges).withColumn("level", F.col("level").cast("bigint"))


@query(
    "k10_nearest_mapped",
    TREE.replace("WITH ", "WITH RECURSIVE ", 1) + ", m AS (SELECT graph_id, id, 'c' || id AS mapped FROM nodes WHERE type = 'agg'),"
    " w AS (SELECT graph_id, id, id AS at FROM nodes UNION ALL SELECT w.graph_id, w.id, e.source FROM w JOIN edges e ON"
    " e.graph_id = w.graph_id AND e.target = w.at ANTI JOIN m ON m.graph_id = w.graph_id AND m.id = w.at)"
    " SELECT n.graph_id, n.id, x.mapped FROM nodes n LEFT JOIN (SELECT w.graph_id, w.id, m.mapped FROM w JOIN m ON"
    " m.graph_id = w.graph_id AND m.id = w.at) x USING (graph_id, id)",
)
def k10(spark, sf):
    nodes, edges = graph(spark, sf)
    mapping = nodes.where("type = 'agg'").select("graph_id", "id", F.concat(F.lit("c"), F.col("id")).alias("mapped"))
    parents = edges.select("graph_id", F.col("target").alias("id"), F.col("source").alias("parent"))
    return K.nearest_mapped(nodes, parents, mapping)


@query(
    "k11_merge_missing",
    oracle_with("trials") + ", r AS (SELECT run_id AS graph_id, 'n' || trial AS id, 'op' || trial AS label FROM trials WHERE operator <>"
    " 'brand'), m AS (SELECT run_id AS graph_id, 'in_' || (row_number() OVER (PARTITION BY run_id ORDER BY trial) - 1) AS id,"
    " 'op' || trial AS label FROM trials WHERE operator = 'brand') SELECT * FROM r UNION ALL SELECT * FROM m",
)
def k11(spark, sf):
    t = view(spark, sf, "trials")
    plan = t.select(
        F.col("run_id").alias("graph_id"), F.concat(F.lit("p"), "trial").alias("id"), F.concat(F.lit("op"), "trial").alias("label"),
        F.col("trial").alias("pos"),
    )
    run = t.where("operator <> 'brand'").select(
        F.col("run_id").alias("graph_id"), F.concat(F.lit("n"), "trial").alias("id"), F.concat(F.lit("op"), "trial").alias("label")
    )
    pe = t.where("parent_trial IS NOT NULL").select(
        F.col("run_id").alias("graph_id"), F.concat(F.lit("p"), "parent_trial").alias("source"), F.concat(F.lit("p"), "trial").alias("target")
    )
    empty = pe.where("false")
    return K.merge_missing(run, empty, plan, pe)[0]


@query(
    "k12_producer_edges",
    "WITH e AS (SELECT *, event_type IN ('signup', 'purchase') AS p FROM events) SELECT DISTINCT user_id AS graph_id, src AS source,"
    " event_id AS target FROM (SELECT *, last_value(CASE WHEN p THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id,"
    " json_extract_string(props, '$.k') ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM e)"
    " WHERE NOT p AND src IS NOT NULL",
)
def k12(spark, sf):
    refs = table(spark, sf, "events").select(
        F.col("user_id").alias("graph_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("node"),
        F.get_json_object("props", "$.k").alias("var"),
        F.when(F.col("event_type").isin("signup", "purchase"), "produces").otherwise("consumes").alias("role"),
    )
    return K.producer_edges(refs)


# --- search policies ----------------------------------------------------------------------


@query(
    "g3_evolutionary_parent",
    oracle_with("trials") + ", n AS (SELECT run_id, count(*) AS n FROM trials GROUP BY 1), p AS (SELECT run_id, trial, row_number() OVER"
    " (PARTITION BY run_id ORDER BY score DESC, trial) - 1 AS i FROM trials WHERE score IS NOT NULL), q AS (SELECT *, count(*) OVER"
    " (PARTITION BY run_id) AS size FROM p WHERE i < 6) SELECT n.run_id, q.trial AS parent FROM n LEFT JOIN q ON q.run_id = n.run_id"
    " AND q.i = n.n % q.size",
)
def g3(spark, sf):
    return PO.evolutionary(view(spark, sf, "trials"), 6)


@query(
    "g4_tree_parent",
    oracle_with("trials") + ", l AS (SELECT * FROM trials t WHERE score IS NOT NULL AND NOT EXISTS (SELECT 1 FROM trials c WHERE"
    " c.run_id = t.run_id AND c.parent_trial = t.trial)), b AS (SELECT run_id, trial FROM (SELECT *, row_number() OVER (PARTITION BY"
    " run_id ORDER BY score DESC, trial) AS n FROM l) WHERE n = 1) SELECT r.run_id, CASE WHEN roots >= 1 THEN b.trial END AS parent"
    " FROM (SELECT run_id, count(*) FILTER (parent_trial IS NULL) AS roots FROM trials GROUP BY 1) r LEFT JOIN b USING (run_id)",
)
def g4(spark, sf):
    return PO.tree(view(spark, sf, "trials"), min_num_drafts=1)


@query(
    "g5_mcts_parent",
    oracle_with("trials").replace("WITH ", "WITH RECURSIVE ", 1) + CLOSURE
    + ", s AS (SELECT a.run_id, a.top AS trial, count(*) AS visits, coalesce(avg(t.score), 0) AS mean FROM a JOIN trials t ON"
    " t.run_id = a.run_id AND t.trial = a.trial GROUP BY 1, 2), z AS (SELECT run_id, count(*) AS total FROM trials GROUP BY 1),"
    " u AS (SELECT t.run_id, t.trial, round(s.mean + sqrt(2) * sqrt(ln(coalesce(p.visits, z.total)) / s.visits), 9) AS ucb FROM trials t"
    " JOIN s USING (run_id, trial) JOIN z USING (run_id) LEFT JOIN s p ON p.run_id = t.run_id AND p.trial = t.parent_trial)"
    " SELECT run_id, trial AS parent FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ucb DESC, trial) AS n FROM u)"
    " WHERE n = 1",
)
def g5(spark, sf):
    return PO.mcts(view(spark, sf, "trials"))


@query("g7_best_trial", oracle_with("trials") + BEST_SQL.replace("SELECT run_id, trial, parent_trial, operator, score", "SELECT run_id, trial, score", 1))
def g7(spark, sf):
    from featureflow.operators.aggs import best_by

    return best_by(view(spark, sf, "trials").select("run_id", "trial", "score"), "run_id")


# --- streams --------------------------------------------------------------------------------


def source_stream(spark, sf):
    """The events table as a stream of files."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("type"), F.col("value").alias("cost"),
    )


def finish(q):
    """Wait for a bounded run to end; a failed stream raises here."""
    q.awaitTermination()


@query("st1_stream_events", EVENTS_SQL)
def st1(spark, sf):
    src, out = fresh(spark, "lines"), fresh(spark, "events")
    event_lines(spark, sf).write.text(src)
    q = ST.write_append(
        ST.stream_events(spark, src).select("run_id", "node_id", "type", "cost_usd", "ts_ms"), out, fresh(spark, "cp")
    )
    finish(q)
    return spark.read.parquet(out)


@query(
    "st2_dedupe_stream",
    "SELECT DISTINCT user_id AS run_id, event_type AS type FROM events",
)
def st2(spark, sf):
    out = fresh(spark, "dedupe")
    first = ST.dedupe_stream(source_stream(spark, sf), ["run_id", "type"], "3650 days")
    finish(ST.write_append(first, out, fresh(spark, "cp")))
    return spark.read.parquet(out).select("run_id", "type")


@query(
    "st3_run_status",
    "SELECT user_id AS run_id, round(sum(coalesce(value, 0)), 4) AS cost_usd, count(*) AS events, count(*) FILTER (event_type = 'click')"
    " AS nodes, arg_max(event_type, struct_pack(a := ts, b := event_id)) FILTER (event_type IN ('purchase', 'error')) AS status"
    " FROM events GROUP BY 1",
)
def st3(spark, sf):
    out = fresh(spark, "status")
    status = ST.run_status(source_stream(spark, sf), done=("purchase", "error"), node_type="click")
    finish(ST.write_updates(status, out, fresh(spark, "cp")))
    return ST.read_updates(spark, out, ["run_id"]).withColumn("cost_usd", r("cost_usd"))


@query(
    "st4_replay",
    "SELECT user_id AS run_id, event_id AS seq, event_type AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    " AS step FROM events",
)
def st4(spark, sf):
    return ST.replay(view(spark, sf, "run_events")).select("run_id", "seq", "type", "step")


@query(
    "st6_run_profile",
    "SELECT user_id AS run_id, round(sum(value) FILTER (event_type = 'view'), 4) AS prepare_ms, round(sum(value) FILTER (event_type ="
    " 'click'), 4) AS exec_ms, round(sum(value) FILTER (event_type = 'purchase'), 4) AS post_ms, round(sum(value) FILTER (event_type ="
    " 'signup'), 4) AS emit_ms, round(sum(value), 4) AS total_ms FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def st6(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("view", "prepare", "click", "exec", "purchase", "post", "signup", "emit")])
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.try_element_at(names, F.col("event_type")).alias("stage"), F.col("value").alias("ms")
    )
    out = ST.run_profile(e)
    return out.select("run_id", *[r(c).alias(c) for c in out.columns if c != "run_id"])
