"""Personal data: base patterns and contextual bootstrapping. DataFrame operations only.

Base spans come from four patterns (email, ip, card, phone), leftmost and not
overlapping within a kind; matches that fail their kind's check are dropped.

Base spans are seeds. An occurrence has patterns of four families: the words on both sides,
two words to the left, or two to the right, each with a coarse class (with an at sign, or with
four digits or more: no identifier has fewer), and the word to the left with the shape of the
string (letters as a, digits as 9, runs of up to three as one). A fifth family backs off where words
are rare: the class of the word to the left (a word, a number, a mark, none), the shape, and the
kinds whose own pattern and check the string passes. A bipartite graph joins
patterns and strings by how often they meet; rounds score patterns by the share of known
strings among all they extract and strings by the patterns that extract them (the best family
counts). Strings met in a pattern that scores at least `least_score` and holds at least
`least_seeds` different seeds are added as spans of that kind.

Candidates are runs with a digit or an at sign, groups of such runs joined by single spaces,
slashes, colons and brackets, and words around a bracketed at. Runs of a group are candidates
too, but a group counts once in a pattern, and where the group is added its runs are not.

All rows of a text are worked on within its row; the graph is aggregated by
(pattern, string) before it is joined, so that a frequent word is one row per string.

Defined results: a NULL text counts as empty and has no spans; of overlapping base
spans of different kinds all stay; an added span never overlaps a base span; of
two kinds for one added span the better scored stays, ties go to the first listed kind;
rows that repeat a doc_id are kept apart; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import let, running, text_of
from featureflow.session import stage, tidy

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive loops and a start only where a run begins (or the last
#: match ended) give the same leftmost matches in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Strings that may be identifiers: runs with a digit or an at sign, and groups of them.
_STARTS = r"(?<![0-9A-Za-z_%+@.-])"
_RUN = r"[A-Za-z_%+.-]*+[0-9@][0-9A-Za-z_%+@.-]*+"
_PART_AT = r"[0-9A-Za-z_%+.-]++"
CANDIDATE = _STARTS + _RUN
GROUP = (
    rf"{_STARTS}{_PART_AT}(?:\x20?+[(\[](?i:at|dot)[)\]]\x20?+{_PART_AT})++"
    rf"|(?:[(\[]|{_STARTS}){_RUN}[)\]]?+(?:(?:\x20|[/:]{{1,2}}+)?+[(\[]?+{_RUN}[)\]]?+)*+"
)

LEAST_SCORE = 0.9
LEAST_SEEDS = 3
ROUNDS = 3


def _spans(text: Column, pattern: str) -> Column:
    """start, end (code points), left and right (up to 80 characters around) and string of all matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(ms: Column) -> Column:
        def between(gaps: Column) -> Column:
            ends = running(F.transform(ms, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long")))

            def span(es: Column) -> Column:
                at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
                before = lambda i: F.concat(at(gaps, i - 2), at(ms, i - 2), at(gaps, i - 1), at(ms, i - 1), at(gaps, i))
                after = lambda i: F.concat(at(gaps, i + 1), at(ms, i + 1), at(gaps, i + 2), at(ms, i + 2), at(gaps, i + 3))
                return F.transform(
                    ms,
                    lambda m, i: F.struct(
                        (F.get(es, i) - F.length(m)).alias("start"), F.get(es, i).alias("end"),
                        F.right(before(i), F.lit(80)).alias("left"), m.alias("string"), F.left(after(i), F.lit(80)).alias("right"),
                    ),
                )

            return let(ends, span)

        return let(F.split(text, pattern), between)

    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,left:string,string:string,right:string>>)")
    return let(matches, lambda ms: F.when(F.size(ms) == 0, empty).otherwise(placed(ms)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Check digit rule; `digits` holds 12 to 19 ASCII digits."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda s: s.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return lambda s: let(_digits(s), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return lambda s: F.length(_digits(s)).between(9, 15)
    return lambda s: F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of start, end, left, string, kind (number in KINDS), ordered by start, then kind."""
    found = []
    for i, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)):
        hint = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        found.append(F.when(hint, _tagged(_spans(text, pattern), i)).otherwise(_none()))
    return F.array_sort(F.concat(*found))


def _tagged(spans: Column, kind: int) -> Column:
    ok = _valid(KINDS[kind])
    return F.transform(F.filter(spans, lambda x: ok(x["string"])), lambda x: _occurrence(x, F.lit(kind)))


def _occurrence(x: Column, kind: Column) -> Column:
    return F.struct(
        x["start"].alias("start"), kind.cast("int").alias("kind"), x["end"].alias("end"), x["left"].alias("left"), x["string"].alias("string"),
        x["right"].alias("right"), x["start"].alias("unit"), F.lit(True).alias("whole"),
    )


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,left:string,string:string,right:string,unit:bigint,whole:boolean>>)")


def _core(x: Column, unit: Column, whole: Column) -> Column:
    """A candidate without the marks at its ends and without brackets that don't belong to it."""

    def cut(front: Column) -> Column:
        rest = F.substring(x["string"], F.length(front) + 1, F.length(x["string"]))

        def inner(r: Column) -> Column:
            closed = r.rlike(r"[(\[][^()\[\]]*+[)\]]$")
            return F.when(closed, r).otherwise(F.regexp_replace(r, r"(?<![.%_+)\]-])[.%_+)\]-]++$", ""))

        def made(r: Column) -> Column:
            start = x["start"] + F.length(front)
            return let(inner(r), lambda s: F.struct(
                start.alias("start"), F.lit(None).cast("int").alias("kind"), (start + F.length(s)).alias("end"),
                F.right(F.concat(x["left"], front), F.lit(80)).alias("left"), s.alias("string"),
                F.left(F.concat(F.substring(r, F.length(s) + 1, F.length(r)), x["right"]), F.lit(80)).alias("right"),
                unit.alias("unit"), whole.alias("whole"),
            ))

        return let(rest, made)

    # an opening bracket stays if it is closed before the end
    return let(F.regexp_extract(x["string"], r"^(?:[.%_-]|[(\[](?![^()\[\]]*+[)\]].))*+", 0), cut)


def _candidates(text: Column, base: Column) -> Column:
    """Occurrences of identifier-like strings that touch no base span: groups and the runs in them.

    `unit` is the place of the group, `whole` is false for a run that is a part of one.
    """

    def runs(g: Column) -> Column:
        shifted = lambda x: F.struct(
            (g["start"] + x["start"]).alias("start"), x["string"].alias("string"),
            F.right(F.concat(g["left"], x["left"]), F.lit(80)).alias("left"), F.left(F.concat(x["right"], g["right"]), F.lit(80)).alias("right"),
        )
        return F.transform(_spans(g["string"], CANDIDATE), lambda x: _core(shifted(x), g["start"], F.lit(False)))

    # base spans are few and both lists are ordered by start, so each candidate meets the base spans of its row only
    free = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    fit = lambda x: _class(x["string"]).isNotNull() & free(x)

    def both(g: Column) -> Column:
        def chosen(w: Column) -> Column:
            # a run as long as its group is the group; the runs of a group that touches a base span stand alone
            parts = F.when(
                w["string"].rlike(r"[\x20()\[\]/:]"),
                F.transform(
                    F.filter(runs(g), lambda x: fit(x) & ~((x["start"] == w["start"]) & (x["end"] == w["end"]))),
                    lambda x: x.withField("whole", ~free(w)),
                ),
            ).otherwise(_none())
            return F.concat(F.filter(F.array(w), fit), parts)

        return let(_core(g, g["start"], F.lit(True)), chosen)

    return F.flatten(F.transform(_spans(text, GROUP), both))


def _word(words: Column, at: int) -> Column:
    return F.coalesce(F.regexp_replace(F.try_element_at(words, F.lit(at)), "[0-9]", "9"), F.lit(""))


def _context(text: Column) -> Column:
    """The words of a context, lower case."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _class(s: Column) -> Column:
    """Coarse class of a string; NULL for what is no identifier of any kind."""
    at = s.contains("@") | s.rlike(r"(?i)[(\[]at[)\]]")
    return F.when(at, F.lit("@")).when(F.length(_digits(s)) >= 4, F.lit("9"))


def _shape(s: Column) -> Column:
    short = F.regexp_replace(s, "(?<![0-9])[0-9]{1,3}(?![0-9])", "9")  # longer runs keep their length
    return _key(F.regexp_replace(F.regexp_replace(short, "[0-9]", "9"), r"\p{L}+", "a"))


def _key(s: Column) -> Column:
    return F.when(F.length(s) > 64, F.md5(s)).otherwise(s)


def _word_class(w: Column) -> Column:
    """What a word ends with: a letter, a digit, a colon or equals sign, another mark; nothing if there is no word."""
    return F.when(w == "", "").when(w.rlike(r"\p{L}$"), "w").when(w.rlike("[0-9]$"), "9").when(w.rlike('[:="]$'), ":").otherwise(".")


def _passes(s: Column) -> Column:
    """The kinds, one letter each, whose pattern the whole string matches and whose check it passes."""
    found = []
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True):
        found.append(F.when(s.rlike(f"^(?:{pattern})$") & _valid(kind)(s), kind[0]).otherwise(""))
    return F.concat(*found)


def _patterns(left: Column, right: Column, string: Column) -> Column:
    """Array of (family, pattern); contexts without any word are none."""

    def pattern(family: int, *parts: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), F.concat_ws("\x01", *parts).alias("pattern"))

    def made(l1: Column, l2: Column, r1: Column, r2: Column) -> Column:
        cls = _class(string)
        return F.array_compact(F.array(
            pattern(0, l1, _shape(string)),
            F.when((l1 != "") | (r1 != ""), pattern(1, l1, r1, cls)),
            F.when(l1 != "", pattern(2, l2, l1, cls)),
            F.when(r1 != "", pattern(3, r1, r2, cls)),
            pattern(4, _word_class(l1), _shape(string), _passes(string)),
        ))

    return let(_context(left), lambda ls: let(_context(right), lambda rs: made(_word(ls, -1), _word(ls, -2), _word(rs, 1), _word(rs, 2))))


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (family, pattern, kind, score, seeds) and of strings (string, kind, score).

    `seen`: one row per occurrence with patterns, string, whole and kind (NULL: not known).
    """
    by = ["family", "pattern"]
    met = seen.select("string", "whole", F.explode("patterns").alias("p")).select("p.*", "string", "whole")
    # parts of a group are scored, but it is the group that counts for its patterns
    edges = stage(met.groupBy(*by, "string").agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("n_whole")))
    known = stage(seen.where("kind IS NOT NULL").select("string", "kind").distinct().withColumn("score", F.lit(1.0)))
    totals = stage(edges.groupBy(*by).agg(F.sum("n_whole").alias("total")))
    weights = stage(seen.groupBy("string").agg(F.count(F.lit(1)).alias("total")))
    seeds = edges.join(known, "string").groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("seeds"))
    seeds = stage(seeds.where(F.col("seeds") >= least_seeds))
    # edges of patterns without seeds lead nowhere
    edges = stage(edges.join(seeds.select(*by).distinct(), by, "left_semi"))
    strings = known
    for _ in range(rounds):
        good = edges.join(strings, "string").groupBy(*by, "kind").agg(F.sum(F.col("n_whole") * F.col("score")).alias("good"))
        patterns = good.join(seeds, [*by, "kind"]).join(totals, by)
        patterns = stage(patterns.select(*by, "kind", "seeds", (F.col("good") / (F.col("total") + 1)).alias("score")))
        reached = edges.join(patterns, by).groupBy("string", "kind", "family").agg(F.sum(F.col("n") * F.col("score")).alias("s"))
        reached = reached.groupBy("string", "kind").agg(F.max("s").alias("s"))
        scored = reached.join(weights, "string").select("string", "kind", (F.col("s") / F.col("total")).alias("score"))
        strings = stage(known.unionByName(scored.join(known, ["string", "kind"], "left_anti")))
    return patterns, strings


def _with_hidden(rows: DataFrame, hidden: Callable[[Column], Column]) -> DataFrame:
    """Base spans whose string is hidden become candidates of no known kind."""
    keep = F.filter("base", lambda x: ~hidden(x["string"]))
    as_new = F.transform(F.filter("base", lambda x: hidden(x["string"])), lambda x: x.withField("kind", F.lit(None).cast("int")))
    return rows.withColumns({"base": keep, "maybe": F.concat("maybe", as_new)})


@tidy
def hidden_seeds(docs: DataFrame, fold: int = 0, folds: int = 5, **settings) -> DataFrame:
    """Per kind: spans of every `folds`th distinct base string, hidden from the seeds, how many of them come back, and other spans added.

    This measures discovery on the documents themselves, with the settings that `find` would use.
    """
    hidden = lambda s: F.pmod(F.xxhash64(F.lit(17), s), F.lit(folds)) == fold
    found = find(docs, hidden=hidden, **settings)
    met = lambda y: F.exists("hidden", lambda x: x == y)

    def counted(kind: int) -> Column:
        of = lambda spans, ok: F.size(F.filter(spans, lambda x: (x["kind"] == kind) & ok(x)))
        return F.struct(
            F.lit(KINDS[kind]).alias("kind"), of("hidden", lambda x: F.lit(True)).alias("hidden"),
            of("added", met).alias("found"), of("added", lambda x: ~met(x)).alias("other"),
        )

    rows = found.select(F.explode(F.array(*[counted(i) for i in range(len(KINDS))])).alias("k")).select("k.*")
    return rows.groupBy("kind").agg(*[F.sum(c).cast("long").alias(c) for c in ("hidden", "found", "other")])


@tidy
def find(
    docs: DataFrame, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS, rounds: int = ROUNDS, hidden: Callable[[Column], Column] | None = None
) -> DataFrame:
    """doc_id, `base` and `added`: ordered arrays of (start, kind, end) of every row.

    Base strings for which `hidden` holds are not seeds: their spans are in `hidden` instead of `base`, and may be added.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    hint = F.col("text").rlike(r"[0-9@]|[(\[](?i:at)[)\]]")
    rows = rows.select("doc_id", "text", F.explode(F.array(F.when(hint, base_spans(F.col("text"))).otherwise(_none()))).alias("base"))
    rows = rows.withColumn("maybe", F.when(hint, _candidates(F.col("text"), F.col("base"))).otherwise(_none()))
    short = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    gone = []
    if hidden is not None:
        rows = _with_hidden(rows.withColumn("hidden", short(F.filter("base", lambda x: hidden(x["string"])))), hidden)
        gone = ["hidden"]
    # row numbers and spans are written out once; texts are not needed again
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "maybe", *gone))
    seen = rows.select("row", F.explode(F.concat("base", "maybe")).alias("o")).select("row", "o.*")
    seen = stage(seen.select("row", "start", "end", "unit", "whole", "kind", _key(F.col("string")).alias("string"), _patterns(F.col("left"), F.col("right"), F.col("string")).alias("patterns")))
    patterns, strings = bootstrap(seen, rounds, least_seeds)
    sure = patterns.where(F.col("score") >= least_score).select("family", "pattern", F.col("kind").alias("new_kind"), "score")
    likely = strings.where(F.col("score") >= least_score).select("string", F.col("kind").alias("new_kind"))
    maybe = seen.where("kind IS NULL").select("row", "start", "end", "unit", "string", F.explode("patterns").alias("p")).select("*", "p.*").drop("p")
    found = maybe.join(sure, ["family", "pattern"]).join(likely, ["string", "new_kind"], "left_semi")
    best = found.groupBy("row", "unit", "start", "end").agg(F.max_by("new_kind", F.struct("score", -F.col("new_kind"))).alias("kind"))
    # of a group and its runs, found both, the group stays
    spans = best.groupBy("row", "unit").agg(F.collect_list(F.struct("start", "kind", "end")).alias("x"), F.min("start").alias("lo"), F.max("end").alias("hi"))
    group = F.filter("x", lambda o: (o["start"] == F.col("lo")) & (o["end"] == F.col("hi")))
    spans = spans.select("row", F.explode(let(group, lambda g: F.when(F.size(g) > 0, g).otherwise(F.col("x")))).alias("o"))
    added = spans.groupBy("row").agg(F.array_sort(F.collect_list("o")).alias("added"))
    out = rows.join(added, "row", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    return out.select("doc_id", short(F.col("base")).alias("base"), F.coalesce("added", none).alias("added"), *gone)


def written(spans: Column) -> Column:
    """kind:start:end of ordered spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


@tidy
def report(docs: DataFrame, **settings) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans of every row."""
    rows = find(docs, **settings)
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return rows.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
