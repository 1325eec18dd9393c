"""sem_extract_features and text annotation (Q5-Q8)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.functions.dates import with_date_interval
from featureflow.functions.text import words
from featureflow.operators.udf import map_batches
from featureflow.semantic import sqltext
from featureflow.semantic.program import FeatureProgram, Operator, quote
from featureflow.semantic.terms import TermList, walk_inline, walk_joined, with_hits

# Small word lists by class. Callers pass their own for other domains.
LEXICON = {
    "cultural_group": (
        "american british chinese dutch egyptian english etruscan flemish french german greek indian iranian islamic "
        "italian japanese korean mexican persian peruvian roman russian spanish swiss turkish venetian"
    ).split(),
    "location": (
        "africa america athens austria berlin boston britain china egypt england europe florence france germany greece "
        "india iran italy japan korea london madrid mexico milan moscow naples paris peru rome russia spain turkey "
        "venice vienna york"
    ).split(),
    "period": "ancient baroque byzantine classical gothic hellenistic medieval modern renaissance victorian century dynasty".split(),
    "adjective": (
        "big black blue bright brown cold dark early fine gold golden gray great green high large late light little long "
        "low new old painted pale red rich round short silver small tall thin white wide yellow"
    ).split(),
}

PHRASE = r"[\p{Lu}][\p{L}]+(?:\s[\p{Lu}][\p{L}]+)+"
PERSON = r"(?:Mr|Mrs|Ms|Dr|Sir|Lady|Lord|Saint|St|King|Queen|Prince|Princess)\.?\s[\p{Lu}][\p{L}]+(?:\s[\p{Lu}][\p{L}]+)*"
#: The same matches as PERSON; other places of a text are passed over by their first letter.
TITLED = rf"(?=[DKLMPQS]){PERSON}"

#: Lists of terms up to this size are written into the expression; larger ones are joined.
INLINE_TERMS = 2000


class SemExtract(Operator):
    """New columns from the input columns.

    recipe="date_interval": year_start, start_is_bce, year_end, end_is_bce of a free-text date.
    recipe="dictionary": for every entry {feature: terms} a flag, a count and the matched terms.
    batch_fn: a batch model or annotator (rows in, rows out) with a declared schema.
    """

    def __init__(self, inputs: list[str], outputs: dict[str, str] | None = None, recipe: str = "dictionary",
                 dictionaries: dict[str, list[str]] | None = None, century: str = "ordinal",
                 batch_fn: Callable | None = None, schema: str | None = None, batch_size: int = 256, hint: str = ""):
        if recipe not in ("date_interval", "dictionary", "batch"):
            raise ValueError(f"unknown recipe {recipe!r}")
        self.inputs, self.outputs, self.recipe = inputs, dict(outputs or {}), "batch" if batch_fn else recipe
        self.dictionaries, self.century = dict(dictionaries or {}), century
        self.batch_fn, self.schema, self.batch_size, self.hint = batch_fn, schema, batch_size, hint

    def fit(self, df: DataFrame, **tables) -> FeatureProgram:
        program = FeatureProgram("sem_extract_features")
        program.attempts.append({"operator": "sem_extract_features", "hint": self.hint, "recipe": self.recipe})
        if self.recipe == "batch":
            return BatchProgram("sem_extract_features", fn=self.batch_fn, schema=self.schema, size=self.batch_size)
        if self.recipe == "date_interval":
            fields = ["year_start", "start_is_bce", "year_end", "end_is_bce"]
            names = list(self.outputs) or fields
            program.steps.append(
                {"op": "dates", "col": self.inputs[0], "century": self.century, "cols": dict(zip(fields, names))}
            )
            return program
        joined = f"concat_ws(' ', {', '.join(quote(c) for c in self.inputs)})"
        for i, (feature, terms) in enumerate(self.dictionaries.items()):
            held = TermList(df.sparkSession, terms, INLINE_TERMS)
            if not held.inline:
                program.tables[f"terms_{feature}"] = held.steps
                program.steps.append({"op": "terms", "table": f"terms_{feature}", "text": joined, "feature": feature, "depth": held.depth})
                continue
            words, prefix = f"_d{i}_w", f"_d{i}_"
            program.columns(**{words: sqltext.words(joined)})
            steps, hit = walk_inline(words, prefix, held.known)
            for step in steps:
                program.columns(**step)
            program.columns(
                **{
                    f"is_{feature}": f"size({hit}) > 0",
                    f"{feature}_count": f"cast(size({hit}) AS bigint)",
                    f"{feature}_terms": f"array_join({hit}, ', ')",
                }
            )
            program.drop(words, *[n for step in steps for n in step])
        return program


class BatchProgram(FeatureProgram):
    """Per-row model calls on Arrow batches; the model is a caller's function, not stored state."""

    def __init__(self, operator: str, fn: Callable, schema: str, size: int):
        super().__init__(operator)
        self.fn, self.schema, self.size = fn, schema, size

    def transform(self, df: DataFrame, **bound) -> DataFrame:
        return map_batches(df, self.fn, self.schema, self.size)

    def save(self, spark, path):
        """Stores the import path of the function, which must be found there on loading."""
        name = f"{self.fn.__module__}:{self.fn.__qualname__}"
        if "<" in name or _imported(name) is not self.fn:
            raise TypeError("only a function that can be imported by its name can be stored")
        self.steps = [{"op": "batch", "fn": name, "schema": self.schema, "size": self.size}]
        super().save(spark, path)


def _imported(name: str) -> Callable:
    module, _, path = name.partition(":")
    out = import_module(module)
    for part in path.split("."):
        out = getattr(out, part)
    return out


def _batch(self, df: DataFrame, step: dict, bound) -> DataFrame:
    return map_batches(df, _imported(step["fn"]), step["schema"], step["size"])


def _dates(self, df: DataFrame, step: dict, bound) -> DataFrame:
    return with_date_interval(df, step["col"], step["cols"], step["century"])


def _terms(self, df: DataFrame, step: dict, bound) -> DataFrame:
    """Large word list: distinct texts are walked level by level, then joined back to the rows."""
    feature = step["feature"]
    df = df.withColumn("_text", F.expr(step["text"]))
    hit = walk_joined(df.select("_text").distinct(), "_text", self.tables[step["table"]], step["depth"], "_hit")
    n = F.when(F.col("_hit").isNull(), F.lit(0)).otherwise(F.size("_hit")).cast("bigint")
    return (
        df.join(hit, "_text", "left")
        .withColumns(
            {
                f"is_{feature}": n > 0,
                f"{feature}_count": n,
                f"{feature}_terms": F.coalesce(F.array_join("_hit", ", "), F.lit("")),
            }
        )
        .drop("_text", "_hit")
    )


FeatureProgram._batch = _batch
FeatureProgram._dates = _dates
FeatureProgram._terms = _terms


def extract_distinct(df: DataFrame, column: str, op: SemExtract) -> DataFrame:
    """Score each distinct value of a column once, one row per value (join back with merge)."""
    return op.fit_transform(df.select(column).where(F.col(column).isNotNull()).dropDuplicates())


def annotate(df: DataFrame, text: str, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Annotation columns of a text: distinct terms per class, names, phrases, adjective share.

    Classes come from lists of terms of any number of words; people from titles before names; phrases are
    runs of capitalised words. The share of adjectives is of single words. Everything stays in JVM
    expressions over the whole text, and in joins where the lists are long.
    """
    lex = lexicon or LEXICON
    body = F.coalesce(F.col(text), F.lit(""))
    w = F.col("_w")
    classes = ("cultural_group", "location", "period")
    # all classes are walked at once; the few hits are then told apart by class
    listed = [(kind, t) for kind in (*classes, "adjective") for t in lex[kind]]
    cut = df.sparkSession.createDataFrame(listed, "kind string, term string").select("kind", "term", F.expr(sqltext.words("term")).alias("words")).collect()
    spelling: dict[str, str] = {}
    for r in sorted((r for r in cut if r["kind"] != "adjective"), key=lambda r: r["term"].lower()):
        spelling.setdefault(" ".join(r["words"]), r["term"].lower())
    plain = [r["words"][0] for r in cut if r["kind"] == "adjective" and len(r["words"]) == 1]

    def terms(kind: str) -> Column:
        own = F.array(*[F.lit(t) for t in sorted({spelling[" ".join(r["words"])] for r in cut if r["kind"] == kind})])
        return F.array_join(F.array_sort(F.array_intersect("_hit", own.cast("array<string>"))), ", ")

    def matches(pattern: str) -> Column:
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        tidy = F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " "))
        return F.array_join(F.array_sort(F.array_distinct(tidy)), ", ")

    adjectives = F.size(F.filter(w, lambda x: x.isin(*plain)))
    held = TermList(df.sparkSession, sorted(set(spelling.values())), INLINE_TERMS)
    return with_hits(df.withColumn("_w", words(body)), text, "_w", held, "_hit").withColumns(
        {
            "ent_cultural_group": terms("cultural_group"),
            "ent_people": matches(TITLED),
            "ent_location": terms("location"),
            "ent_period": terms("period"),
            "desc_noun_phrases": matches(PHRASE),
            "desc_adjective_density": F.coalesce(F.try_divide(adjectives, F.size(w)), F.lit(0.0)),
        }
    ).drop("_w", "_hit")
