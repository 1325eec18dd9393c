"""Listed terms in texts, of any number of words and with any accents (Q6, Q8).

Terms and texts are cut into the same plain words. A list is a trie over words: a state is a
run of words that begins a term, and a step leads from a state by the next word to another.
Short lists are written into expressions that walk the trie at all places of a text side by side; long
ones are a table (level, state, word, next, term) that the words are joined with, one level at a time.
Every listed term that occurs is found, also inside another one. Terms that are the same plain words
count as one and go by the first spelling in order; terms without a word are never found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featureflow.semantic import sqltext
from featureflow.semantic.program import text_literal
from featureflow.session import broadcast_if_small, remove_path, stage, staged_path

def spelled(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(words, term): plain words of the terms and their first lower-case spelling."""
    listed = spark.createDataFrame([(t.lower(),) for t in terms], "term string")
    cut = listed.select(F.expr(sqltext.words("term")).alias("words"), "term").where(F.size("words") > 0)
    return cut.groupBy("words").agg(F.min("term").alias("term"))


def trie(known: DataFrame) -> DataFrame:
    """(level, state, word, next, term, more) of all steps; `term` where the step ends one, `more` where others go on."""
    steps = known.select("words", "term", F.posexplode("words").alias("level", "word"))
    upto = lambda n: F.array_join(F.slice("words", F.lit(1), n), " ")
    last = F.col("level") + 1 == F.size("words")
    named = steps.select("level", upto(F.col("level")).alias("state"), "word", upto(F.col("level") + 1).alias("next"), F.when(last, F.col("term")).alias("term"), (~last).alias("more"))
    return named.groupBy("level", "state", "word", "next").agg(F.max("term").alias("term"), F.max("more").alias("more"))


def walk_inline(words: str, prefix: str, known: list[tuple[list[str], str]]) -> tuple[list[dict[str, str]], str]:
    """Column expressions, one dict per step, and the column that then holds the terms of the array column `words`, in order.

    All columns begin with `prefix`. Level n keeps the places where n words lead to a state.
    """
    listed = lambda items: ", ".join(text_literal(x) for x in sorted(set(items)))
    ends: dict[int, list[str]] = {}
    for cut, _ in known:
        ends.setdefault(len(cut), []).append(" ".join(cut))
    steps, found = [], []
    if 1 in ends:
        found.append(f"array_intersect({words}, array({listed(ends[1])}))")
    deepest = max(ends, default=1)
    for n in range(1, deepest + 1) if deepest > 1 else []:
        states = listed(" ".join(cut[:n]) for cut, _ in known if len(cut) >= max(n, 2))
        run = f"array_join(slice({words}, i + 1, {n}), ' ')"
        places = f"{prefix}at{n - 1}" if n > 1 else f"CASE WHEN size({words}) > 0 THEN sequence(0, size({words}) - 1) ELSE cast(array() AS array<int>) END"
        steps.append({f"{prefix}at{n}": f"filter({places}, i -> {run} IN ({states}))"})
        if n > 1 and n in ends:
            found.append(f"filter(transform({prefix}at{n}, i -> {run}), x -> x IN ({listed(ends[n])}))")
    hits = f"array_distinct(concat({', '.join(found)}))" if found else "cast(array() AS array<string>)"
    other = {" ".join(cut): term for cut, term in known if " ".join(cut) != term}
    if other:
        table = ", ".join(f"{text_literal(k)}, {text_literal(v)}" for k, v in sorted(other.items()))
        hits = f"transform({hits}, x -> coalesce(try_element_at(map({table}), x), x))"
    steps.append({f"{prefix}hit": f"array_sort({hits})"})
    return steps, f"{prefix}hit"


def walk_joined(texts: DataFrame, text: str, steps: DataFrame, depth: int, name: str) -> DataFrame:
    """(text, `name`): the terms of each distinct text that has any, in order.

    A place carries the words that may follow it, so that each level is one join with the level's steps.
    """
    places = "transform(_w, (x, i) -> named_struct('word', x, 'rest', slice(_w, i + 2, {n})))".format(n=max(depth - 1, 0)) if depth > 1 else "transform(_w, x -> named_struct('word', x))"
    cut = texts.select(F.col(text).alias("_text"), F.expr(sqltext.words(text)).alias("_w"))
    walk = cut.select("_text", F.explode(F.array_distinct(F.expr(places))).alias("p")).select("_text", "p.*")

    def level(n: int) -> DataFrame:
        own = steps.where(F.col("level") == n)
        kept = own.select("word", F.when(F.col("more"), F.col("next")).alias("_next"), F.col("term").alias("_term"), *([F.col("state").alias("_state")] if n else []))
        return broadcast_if_small(kept)

    rest = ["rest"] if depth > 1 else []
    walk = walk.join(level(0), "word").select("_text", *rest, F.col("_next").alias("_state"), F.array("_term").alias("_hit"))
    for n in range(1, depth):
        walk = walk.withColumn("word", F.get("rest", F.lit(n - 1))).join(level(n), ["_state", "word"], "left")
        walk = walk.select("_text", *rest, F.col("_next").alias("_state"), F.concat("_hit", F.array("_term")).alias("_hit"))
    hits = walk.select("_text", F.explode(F.array_compact("_hit")).alias("_term"))
    # at most one entry per listed term of one text
    return hits.groupBy("_text").agg(F.array_sort(F.collect_set("_term")).alias(name))


class TermList:
    """A list of terms: literals (`known`) up to `inline` terms, else a staged table (`steps`, `depth`)."""

    def __init__(self, spark: SparkSession, terms: list[str], inline: int):
        known = spelled(spark, terms)
        self.inline = len(terms) <= inline
        if self.inline:
            self.known = [(list(r["words"]), r["term"]) for r in known.collect()]
        else:
            known = stage(known)
            self.depth = known.agg(F.max(F.size("words"))).first()[0] or 0
            self.steps = stage(trie(known))
            remove_path(spark, staged_path(known))


def with_hits(df: DataFrame, text: str, words: str, held: TermList, name: str) -> DataFrame:
    """`df` with `name`: the listed terms of the text column, whose plain words are in the column `words`, in order."""
    if held.inline:
        steps, hit = walk_inline(words, "_t_", held.known)
        for s in steps:
            df = df.withColumns({n: F.expr(e) for n, e in s.items()})
        return df.withColumn(name, F.col(hit)).drop(*[n for s in steps for n in s])
    found = walk_joined(df.select(text).where(F.col(text).isNotNull()).distinct(), text, held.steps, held.depth, name)
    none = F.expr("cast(array() AS array<string>)")
    return df.join(found.withColumnRenamed("_text", text), text, "left").withColumn(name, F.coalesce(name, none))
