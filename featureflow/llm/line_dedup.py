"""Line deduplication by a join over deletion neighbourhoods. DataFrame operations only.

Lines are sequences of words. A line with at least `min_words` words goes if an earlier line (by doc_id, then line
number) has the same words, or, where both have `near_words` words at least, is
one word edit away: a word put in, left out or replaced. "Earlier" looks at all lines of
the table, kept or not.

Distinct lines within one edit share an equal variant: for a replaced word both
without that word, else the shorter line and the longer one without the extra word. All
variants with one word deleted are emitted as hashed keys (XOR of hashes of word
and place, so all variants of a line take time linear in its words), equal keys are
joined, and the edit is confirmed on the words themselves. A group of equal keys is
never paired up: replacement keys name the deleted place, so that all lines of
a group are one edit apart and each is held against the group's earliest only.

Before variants are emitted, lines that can't have a partner are left out: one
edit leaves the first or the second half of a line as it is, so a line none of whose
half keys is shared by another line has no partner. The lines left are numbered in their
order, and variants carry the number only.

Defined results: a NULL text counts as empty (one line without words, which stays);
NULL doc_id comes last; rows that repeat doc_id and text count as one document; an empty
table gives no rows; other columns are carried through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import WHITE, WORD, let, running, staged_side, text_of
from featureflow.operators.windows import global_position
from featureflow.session import stage, tidy

MIN_WORDS = 1
NEAR_WORDS = 10

_LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    """The lines of a text, with blanks as their only white space."""
    for c in WHITE.replace("\n", "").replace(" ", ""):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, "\n")


def _words(line: Column) -> Column:
    """Words of a line of `_lines`; splitting by one character needs no pattern."""
    return F.array_remove(F.split(line, " "), "")


def _pair_hash(words: Column) -> list[Column]:
    """Two 64-bit hashes of a word list."""
    return [F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(7), words).alias("h2")]


def _half_keys(words: Column) -> Column:
    """Hashes of the halves that a partner one edit away may share (see the module's text)."""
    n = F.size(words)
    front = lambda k: F.xxhash64(F.lit(1), k, F.slice(words, F.lit(1), k))
    back = lambda k: F.xxhash64(F.lit(2), k, F.slice(words, n - k + 1, k))
    half = lambda k: F.floor(k / 2).cast("int")
    # as long as the partner or shorter by one: n div 2 words in front; longer by one: (n - 1) div 2
    return F.array_distinct(F.array(front(half(n)), front(half(n - 1)), back(n - half(n)), back(n - 1 - half(n - 1))))


def _id_columns() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(text_of()).alias("tie")]


def _hashed(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """Place, hashes and half keys of all lines with at least `min_words` words."""
    lines = docs.select(*_id_columns(), F.posexplode(_lines(text_of())).alias("line_no", "line"))
    lines = lines.select("d", "tie", "line_no", F.explode(F.array(_words(F.col("line")))).alias("ws"))
    halves = F.when(F.size("ws") >= near_words, _half_keys(F.col("ws")))
    return lines.where(F.size("ws") >= min_words).select("d", "tie", "line_no", *_pair_hash(F.col("ws")), halves.alias("halves"))


def _candidates(lines: DataFrame) -> DataFrame:
    """h1 of distinct lines that share a half key with another line."""
    keyed = lines.where("halves IS NOT NULL").select("h1", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half")
    return keyed.join(staged_side(shared), "half", "left_semi").select("h1").distinct()


def _numbered(lines: DataFrame) -> DataFrame:
    """Candidates (h1, h2) with the place (d, tie, line_no) of their first occurrence and a number `k` in that order."""
    long = lines.where("halves IS NOT NULL").join(staged_side(_candidates(lines)), "h1", "left_semi")
    firsts = long.groupBy("h1", "h2").agg(F.min(F.struct("d", "tie", "line_no")).alias("p")).select("h1", "h2", "p.*")
    return stage(global_position(firsts, ["d", "tie", "line_no"], "k"))


def _with_words(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """k and the words of the candidates, cut out of the documents that hold their first occurrences."""
    wanted = numbered.groupBy("d", "tie").agg(F.collect_list(F.struct("line_no", "k")).alias("own"))  # at most a document's lines
    texts = docs.select(*_id_columns(), text_of().alias("text")).join(staged_side(wanted), ["d", "tie"])
    lines = texts.select(F.explode(let(_lines(F.col("text")), lambda ls: F.transform("own", lambda o: F.struct(o["k"].alias("k"), F.get(ls, o["line_no"]).alias("line"))))).alias("x"))
    return stage(lines.groupBy("x.k").agg(F.min("x.line").alias("line")).select("k", _words(F.col("line")).alias("ws")))


def _variants(known: DataFrame) -> DataFrame:
    """Keys of distinct lines: `n` words, `at` the deleted place (-1: none), hash `v`."""

    def keys(ws: Column) -> Column:
        here = F.transform(ws, lambda w, i: F.xxhash64(w, i))
        moved = F.transform(ws, lambda w, i: F.xxhash64(w, i - 1))
        def without(a: Column) -> Column:
            def each(b: Column) -> Column:
                end = F.element_at(b, -1)
                front = lambda i: F.coalesce(F.get(a, i - 1), F.lit(0).cast("long"))
                return F.transform(b, lambda x, i: front(i).bitwiseXOR(end).bitwiseXOR(x))
            return let(running(moved, xor=True), each)
        return let(running(here, xor=True), lambda a: F.concat(F.array(F.element_at(a, -1)), without(a)))

    spread = known.select("k", F.size("ws").alias("size"), F.posexplode(let(F.col("ws"), keys)).alias("nth", "v"))
    whole = F.col("nth") == 0
    return spread.select("k", F.when(whole, F.col("size")).otherwise(F.col("size") - 1).alias("n"), (F.col("nth") - 1).alias("at"), "v")


def _near_removed(known: DataFrame) -> DataFrame:
    """k of the distinct lines (k, ws) that have an earlier line one edit away."""
    keys = stage(_variants(known))
    groups = stage(keys.groupBy("v", "n", "at").agg(F.min("k").alias("e"), F.max("k").alias("latest")))
    replaced = groups.where("at >= 0 AND e <> latest").select("v", "n", F.col("at").alias("r_at"), "e", F.lit("replaced").alias("how"))
    shorter = groups.where("at < 0").select("v", "n", F.col("e").alias("s"))
    longer = groups.where("at >= 0").join(shorter, ["v", "n"])
    # a replaced word: every line of the group against its earliest; a word more: the longer line against the shorter
    more = longer.where("latest > s").select("v", "n", F.col("at").alias("r_at"), F.col("s").alias("e"), F.lit("longer").alias("how"))
    against = staged_side(replaced.unionByName(more))
    earlier = keys.where("at >= 0").join(against, ["v", "n"]).where("r_at = at AND k > e")
    one_two = earlier.select("k", "e", "at", "how")
    # and the shorter line against the earliest longer one of each group
    three = longer.where("s > e").select(F.col("s").alias("k"), "e", "at", F.lit("shorter").alias("how"))
    pairs = one_two.unionByName(three)
    held = pairs.join(known, "k").join(known.select(F.col("k").alias("e"), F.col("ws").alias("es")), "e")
    less = lambda ws: F.concat(F.slice(ws, F.lit(1), F.col("at")), F.slice(ws, F.col("at") + 2, F.greatest(F.size(ws) - F.col("at") - 1, F.lit(0))))
    ws, es = F.col("ws"), F.col("es")
    confirmed = F.when(F.col("how") == "replaced", less(ws) == less(es)).when(F.col("how") == "longer", less(ws) == es).otherwise(ws == less(es))
    return held.where(confirmed).select("k").distinct()


@tidy
def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """d, tie and `gone`, the ascending numbers (from 0) of the lines that go, of documents that lose any."""
    lines = stage(_hashed(docs, min_words, near_words))
    numbered = _numbered(lines)
    near = _near_removed(_with_words(docs, numbered)).join(numbered, "k").select("h1", "h2", F.lit(True).alias("near"), F.lit(None).cast("long").alias("d0"))
    equal = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d0")).where("n > 1").select("h1", "h2", F.lit(False).alias("near"), "d0")
    marked = equal.unionByName(near).groupBy("h1", "h2").agg(F.max("near").alias("near"), F.min("d0").alias("d0"))
    hit = stage(lines.select("d", "tie", "line_no", "h1", "h2").join(staged_side(marked), ["h1", "h2"]))
    # all occurrences go, but of a line without an earlier near one the first, which is in a document with the least d
    firsts = hit.where("NOT near AND d = d0").groupBy("h1", "h2").agg(F.min(F.struct("d", "tie", "line_no")).alias("p")).select("p.*")
    places = hit.select("d", "tie", "line_no", F.lit(False).alias("stays")).unionByName(firsts.select("d", "tie", "line_no", F.lit(True).alias("stays")))
    of = lambda side: F.collect_set(F.when(F.col("stays") == F.lit(side), F.col("line_no")))
    gone = places.groupBy("d", "tie").agg(F.array_sort(F.array_except(of(False), of(True))).alias("gone"))
    return gone.where(F.size("gone") > 0)


@tidy
def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """All rows and columns of `docs` as c0, c1, ..., with n_lines, gone (line numbers) and kept_text."""
    gone = staged_side(repeated_lines(docs, min_words, near_words))
    names = docs.columns
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], *_id_columns(), F.split(text_of(), "\n").alias("lines"))
    out = plain.join(gone, ["d", "tie"], "left")
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
    text = let(F.col("lines"), lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n"))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(text)
    return out.select(*[f"c{i}" for i in range(len(names))], F.size("lines").alias("n_lines"), F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("gone"), kept.alias("kept_text"))


@tidy
def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The rows of `docs` with what stays of their text; rows that lose all their lines with words go.

    A column n_chars follows the text. Rows that lose no line come through as they are.
    """
    names = docs.columns
    lost = F.size("gone") > 0
    out = dedup_lines(docs, min_words, near_words).where(~lost | F.col("kept_text").rlike(WORD))

    def column(i: int, name: str) -> Column:
        c, kind = F.col(f"c{i}"), docs.schema[i].dataType
        if name == "text":
            c = F.when(lost, F.col("kept_text")).otherwise(c)
        elif name == "n_chars":
            c = F.when(lost, F.length("kept_text").cast(kind)).otherwise(c)
        return c.alias(name)

    return out.select(*[column(i, c) for i, c in enumerate(names)])


def dedup_sql(min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> str:
    """The query's result in DuckDB's SQL, for tables with unique doc_id."""
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line, regexp_extract_all(ls[i], '{WORD}') AS ws FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT *, array_to_string(ws, ' ') AS g, doc_id * 1000000 + line_no AS place FROM l WHERE len(ws) >= {min_words}),
u AS (SELECT g, min(place) AS first, any_value(ws) AS ws FROM k GROUP BY g),
v AS (SELECT g, first, i, len(ws) - 1 AS n, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS v
      FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM u WHERE len(ws) >= {near_words})),
e AS (SELECT v, n, i, min(first) AS first FROM v GROUP BY ALL),
near AS (
  SELECT v.g FROM v JOIN e USING (v, n, i) WHERE e.first < v.first
  UNION SELECT v.g FROM v JOIN u ON v.v = u.g WHERE len(u.ws) >= {near_words} AND u.first < v.first
  UNION SELECT u.g FROM v JOIN u ON v.v = u.g WHERE len(u.ws) >= {near_words} AND v.first < u.first),
gone AS (SELECT k.doc_id, k.line_no FROM k JOIN u USING (g) WHERE k.place <> u.first OR k.g IN (SELECT g FROM near)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.line_no) AS n_gone,
  coalesce(string_agg(gone.line_no::VARCHAR, ',' ORDER BY l.line_no) FILTER (gone.line_no IS NOT NULL), '') AS gone,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (gone.line_no IS NULL), '') AS kept_text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line_no = l.line_no GROUP BY 1)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_gone::BIGINT AS n_gone, gone, kept_text FROM kept"""
