"""Document fingerprints: Merkle trees over pieces, paragraphs and sections. DataFrame operations only.

A paragraph is a line of the text; its leaves are its pieces up to and with
punctuation marks (200 characters at most). A section ends after a paragraph whose
hash begins with 0 or 1, one in eight, so that an edit moves no section border
but its own. Every inner node is the hash of its children's hashes; equal roots
mean equal texts.

A fingerprint writes the tree out: the root (32 hex digits), then for each section
`|` and 16 digits, for each of its paragraphs `:` and 16 digits, for each piece `.` and 8.
Two fingerprints are alike by the share of nodes they have in common (twice the
common ones over all, each label counted once); `differing_paragraphs` follows
differing branches only.

Defined results: a NULL text counts as empty (one empty paragraph); a NULL doc_id comes
after all others in descending order; rows that repeat a doc_id follow one another by
text; a table of one row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.llm.common import let, range_bucket, text_of
from featureflow.session import tidy

PIECE = r"[^.,;:!?]{1,200}[.,;:!?]*|[.,;:!?]+"

#: Characters per range of documents that one task puts in order.
RANGE_CHARS = 16 << 20
MOST_RANGES = 1 << 14

_FIRST = -(1 << 63)


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _paragraph(text: Column) -> Column:
    leaves = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), F.md5)

    def node(ls: Column) -> Column:
        written = _joined(F.transform(ls, lambda x: F.concat(F.lit("."), F.substring(x, 1, 8))))
        return F.struct(F.md5(F.concat(F.lit("p"), _joined(ls))).alias("hash"), written.alias("written"))

    return let(leaves, node)


def _section(paragraphs: Column) -> Column:
    def node(ps: Column) -> Column:
        own = F.md5(F.concat(F.lit("s"), _joined(F.transform(ps, lambda p: p["hash"]))))
        below = _joined(F.transform(ps, lambda p: F.concat(F.lit(":"), F.substring(p["hash"], 1, 16), p["written"])))
        return F.struct(own.alias("hash"), F.concat(F.lit("|"), F.substring(own, 1, 16), below).alias("written"))

    return let(paragraphs, node)


def _sections(ps: Column) -> Column:
    last = F.size(ps)
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | F.substring(F.get(ps, i - 1)["hash"], 1, 1).isin("0", "1"))

    def cut(es: Column) -> Column:
        start = lambda k: F.coalesce(F.get(es, k - 1), F.lit(0)) + 1
        return F.transform(es, lambda e, k: _section(F.slice(ps, start(k), e - start(k) + 1)))

    return let(ends, cut)


def fingerprint(text: Column) -> Column:
    """The written tree of a non-NULL text."""
    paragraphs = F.transform(F.split(text, "\n"), _paragraph)

    def root(ss: Column) -> Column:
        own = F.md5(F.concat(F.lit("r"), _joined(F.transform(ss, lambda s: s["hash"]))))
        return F.concat(own, _joined(F.transform(ss, lambda s: s["written"])))

    return let(paragraphs, lambda ps: let(_sections(ps), root))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: share of tree nodes that two fingerprints have in common; 1 only for equal roots."""
    labels = lambda c: F.array_distinct(F.split(c, "[|:.]"))
    dice = let(labels(a), lambda x: let(labels(b), lambda y: 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))))
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.lit(1.0)).otherwise(dice)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of paragraphs of `a` in whose section and own hash it differs from `b`."""

    def found(theirs: Column) -> Column:
        sections = F.slice(F.split(a, r"\|"), F.lit(2), F.greatest(F.size(F.split(a, r"\|")) - 1, F.lit(0)))
        marked = F.flatten(
            F.transform(
                sections,
                lambda s: F.transform(
                    F.slice(F.split(s, ":"), F.lit(2), F.greatest(F.size(F.split(s, ":")) - 1, F.lit(0))),
                    lambda p: ~F.array_contains(theirs, F.substring(s, 1, 16)) & ~F.array_contains(theirs, F.substring(p, 1, 16)),
                ),
            )
        )
        return let(marked, lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i)))

    same = F.substring(a, 1, 32) == F.substring(b, 1, 32)
    return F.when(same, F.expr("cast(array() as array<int>)")).otherwise(let(F.split(b, "[|:.]"), found))


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """doc_id, text, print, next_text, next_print: each row with the next by descending doc_id.

    Documents are dealt to ranges of doc_id of about equal size, one per shuffle partition or more. The first row of each
    range also goes, as a guest, to the end of the range before it, so that the row after
    a range's last is at hand and texts are shuffled once. The last range's guest is
    the first row of all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(_FIRST).cast("long")))
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(MOST_RANGES, size["n"], max(tasks, (size["chars"] or 0) // range_chars + 1)))
    cuts: list[int] = []
    if ranges > 1:
        steps = [i / ranges for i in range(1, ranges)]
        cuts = rows.agg(F.percentile_approx("k", steps, max(10_000, 10 * ranges)).alias("cuts")).first()["cuts"]
        cuts = sorted(set(cuts))
    rows = rows.withColumn("part", range_bucket(F.col("k"), cuts))
    tops = rows.groupBy("part").agg(F.max("k").alias("top")).orderBy(F.desc("part")).collect()  # a row per range
    # the range after a range is the next lower one that has rows; after the last comes the first
    guests = [(tops[(i + 1) % len(tops)]["top"], t["part"]) for i, t in enumerate(tops)]
    guest = rows.sparkSession.createDataFrame(guests, "k long, host int") if guests else None
    whole = rows.select("k", "doc_id", "text", "part", F.lit(0).alias("guest"))
    if guest is not None:
        come = rows.join(F.broadcast(guest), "k").select("k", "doc_id", "text", F.col("host").alias("part"), F.lit(1).alias("guest"))
        whole = whole.unionByName(come)
    dealt = whole.repartition("part").withColumn("print", fingerprint(F.col("text")))
    order = Window.partitionBy("part").orderBy("guest", F.desc("k"), "text")
    nexts = {"next_text": F.lead("text").over(order), "next_print": F.lead("print").over(order)}
    return dealt.withColumns(nexts).where("guest = 0").select("doc_id", "text", "print", "next_text", "next_print")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last half replaced by the beginning of the next one."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


@tidy
def edit_likeness(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    rows = with_next(docs, range_chars).withColumn("changed", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"), "next_print", F.explode(F.array(fingerprint(F.col("changed")))).alias("edited_fingerprint"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )


def _tree_sql(text: str) -> str:
    """DuckDB's fingerprint of a text expression: one list step per level of the tree."""
    leaves = f"list_transform(regexp_extract_all(p, '{PIECE}'), lambda x: md5(x))"
    pars = (
        f"list_transform(list_transform(string_split({text}, chr(10)), lambda p: {leaves}), lambda ls: "
        "{'h': md5('p' || array_to_string(ls, '')), 'w': array_to_string(list_transform(ls, lambda x: '.' || x[1:8]), '')})"
    )
    return pars


def edit_sql() -> str:
    """The query's result in DuckDB's SQL, for tables with unique, non-NULL doc_id."""
    ends = "list_filter(range(1, len(ps) + 1), lambda i: i = len(ps) OR ps[i].h[1:1] IN ('0', '1'))"
    cut = "list_transform(range(1, len(es) + 1), lambda k: ps[CASE WHEN k = 1 THEN 1 ELSE es[k - 1] + 1 END:es[k]])"
    section = "{'h': md5('s' || array_to_string(list_transform(s, lambda p: p.h), '')), 'b': array_to_string(list_transform(s, lambda p: ':' || p.h[1:16] || p.w), '')}"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text)::BIGINT AS n_chars, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
        coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC)),
t AS (SELECT doc_id, next_id, n_chars, text, substring(text, 1, n_chars - n_chars // 2) || substring(next_text, 1, n_chars // 2) AS changed FROM n),
a AS (SELECT doc_id, 0 AS kind, text AS x FROM t UNION ALL SELECT doc_id, 1, changed FROM t),
p AS (SELECT doc_id, kind, {_tree_sql('x')} AS ps FROM a),
e AS (SELECT *, {ends} AS es FROM p),
s AS (SELECT doc_id, kind, list_transform({cut}, lambda s: {section}) AS ss FROM e),
f AS (SELECT doc_id, kind, md5('r' || array_to_string(list_transform(ss, lambda s: s.h), '')) ||
        array_to_string(list_transform(ss, lambda s: '|' || s.h[1:16] || s.b), '') AS print FROM s),
l AS (SELECT *, list_distinct(regexp_split_to_array(print, '[|:.]')) AS nodes FROM f)
SELECT t.doc_id, t.n_chars, sha256(t.changed) AS edited_sha256, o.print AS fingerprint, c.print AS edited_fingerprint,
  CASE WHEN o.print[1:32] = c.print[1:32] THEN 1.0 ELSE 2.0 * len(list_intersect(o.nodes, c.nodes)) / (len(o.nodes) + len(c.nodes)) END::DOUBLE AS near_edited,
  CASE WHEN o.print[1:32] = x.print[1:32] THEN 1.0 ELSE 2.0 * len(list_intersect(o.nodes, x.nodes)) / (len(o.nodes) + len(x.nodes)) END::DOUBLE AS near_next
FROM t JOIN l o ON o.doc_id = t.doc_id AND o.kind = 0 JOIN l c ON c.doc_id = t.doc_id AND c.kind = 1 JOIN l x ON x.doc_id = t.next_id AND x.kind = 0"""
