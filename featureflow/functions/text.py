"""Text, fingerprint, JSON and label functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.hashing import _col

# Latin letters with marks and their plain forms.
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöøōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžÀÁÂÃÄÅĀĂĄÇĆĈĊČĎÈÉÊËĒĔĖĘĚĜĞĠĢĤÌÍÎÏĨĪĬĮİĴĶĹĻĽÑŃŅŇÒÓÔÕÖØŌŎŐŔŖŘŚŜŞŠŢŤÙÚÛÜŨŪŬŮŰŲŴÝŸŶŹŻŽ"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzzAAAAAAAAACCCCCDEEEEEEEEEGGGGHIIIIIIIIIJKLLLNNNNOOOOOOOOORRRSSSSTTUUUUUUUUUUWYYYZZZ"

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now"
).split()

NON_ASCII = r"[^\x00-\x7f]"
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
WORD_PATTERN = r"[\p{L}\p{N}]+"


def unaccent(c) -> Column:
    """Latin letters without marks; plain ASCII text is passed on as it is."""
    c = _col(c).cast("string")
    return F.when(c.rlike(NON_ASCII), F.translate(c, ACCENTED, PLAIN)).otherwise(c)


def normalize_text(c, full: bool = False) -> Column:
    """Lower-case text without accents; NULL stays NULL.

    `full=True` decomposes every script (NFKD) in a vectorised function.
    """
    return F.lower(_nfkd(_col(c).cast("string"))) if full else F.lower(unaccent(c))


def _nfkd(c: Column) -> Column:
    @F.pandas_udf("string")
    def strip_marks(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(
            lambda x: None
            if x is None
            else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)),
            na_action="ignore",
        )

    return strip_marks(c)


def tokens(c) -> Column:
    """Words and single punctuation marks of the normalised text."""
    return F.regexp_extract_all(normalize_text(c), F.lit(TOKEN_PATTERN), F.lit(0))


def words(c) -> Column:
    return F.regexp_extract_all(normalize_text(c), F.lit(WORD_PATTERN), F.lit(0))


def word_count(c) -> Column:
    return F.size(tokens(c)).cast("bigint")


def has_stopwords(c, stop_words=STOP_WORDS) -> Column:
    return F.arrays_overlap(tokens(c), F.array(*[F.lit(w) for w in stop_words]))


def avg_word_length(c) -> Column:
    """Mean token length, 0 when there is no token."""
    t = tokens(c)
    total = F.aggregate(t, F.lit(0), lambda acc, x: acc + F.length(x))
    return F.when(_col(c).isNotNull(), F.coalesce(F.try_divide(total, F.size(t)), F.lit(0.0)))


def join_distinct(arr) -> Column:
    """Distinct strings in order, joined by ", "."""
    return F.array_join(F.array_sort(F.array_distinct(_col(arr))), ", ")


# --- fingerprints -----------------------------------------------------------------

# Up to the first # that stands outside quotes; a quote after a backslash does not count.
# Possessive, so the time is linear in the line.
_CODE_PART = (
    r"""^((?:[^#"'\\]++|\\.|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|$))*+)#.*$"""
)


def normalize_script(c) -> Column:
    """Script text without line-end blanks, blank lines and comments; indentation stays."""
    lines = F.split(_col(c), "\n", -1)
    bare = F.transform(
        lines, lambda x: F.regexp_replace(F.regexp_replace(x, _CODE_PART, "$1"), r"\s+$", "")
    )
    return F.array_join(F.filter(bare, lambda x: F.length(x) > 0), "\n")


def normalize_number(c, digits: int = 2) -> Column:
    """A parameter as text with fixed digits, "none" for NULL."""
    c = _col(c).cast("double")
    return F.when(c.isNull(), F.lit("none")).otherwise(F.format_string(f"%.{digits}f", F.bround(c, digits)))


def normalize_name(c) -> Column:
    """Lower-case trimmed name, "none" for NULL or empty."""
    c = _col(c)
    return F.when(F.length(c) > 0, F.lower(F.trim(c))).otherwise(F.lit("none"))


def fingerprint(text, *params, length: int = 16) -> Column:
    """First hex digits of the sha-256 of the normalised script and parameters."""
    parts = [normalize_script(text), *[_col(p) for p in params]]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


# --- JSON and labels ----------------------------------------------------------------

CODE_BLOCK = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("retries", T.LongType()),
        T.StructField("node_id", T.StringType()),
    ]
)


def parse_code_block(c) -> Column:
    """Code block JSON → struct; `attempts` falls back to `retries` and is at least 1."""
    j = F.from_json(_col(c), CODE_BLOCK)
    return F.when(
        j.isNotNull(),
        F.struct(
            j["index"].alias("index"),
            F.coalesce(j["code"], F.lit("")).alias("code"),
            F.coalesce(j["cost_usd"], F.lit(0.0)).alias("cost_usd"),
            F.greatest(F.coalesce(j["attempts"], j["retries"], F.lit(1)), F.lit(1)).cast("bigint").alias("attempts"),
            F.nullif(F.trim(j["node_id"]), F.lit("")).alias("node_id"),
        ),
    )


def quoted_name(c) -> Column:
    """The first text between single quotes, NULL if there is none."""
    return F.nullif(F.regexp_extract(_col(c), r"'([^']*)'", 1), F.lit(""))


# Words of step labels and the operator each stands for; the first hit wins.
OPERATOR_WORDS = (
    ("llmimputer", "sem_fillna"),
    ("learnedimputer", "sem_fillna"),
    ("imputedlearner", "sem_fillna"),
    ("semfillnawithllm", "sem_fillna"),
    ("semfillnalllmplusmodel", "sem_fillna"),
    ("llmfeaturegenerator", "sem_gen_features"),
    ("caafe", "sem_gen_features"),
    ("semgenfeaturescaafe", "sem_gen_features"),
    ("selectcols", "sem_select"),
    ("semselectllm", "sem_select"),
    ("codedataaugmentor", "sem_augment"),
    ("directdataaugmentor", "sem_augment"),
    ("codeaugmentor", "sem_augment"),
    ("semaugmentdata", "sem_augment"),
    ("llmcleaner", "sem_clean"),
    ("semcleanwithllm", "sem_clean"),
    ("llmdeduplicator", "sem_refine"),
    ("semrefinewithllm", "sem_refine"),
    ("llmcodegensemaggfeaturesestimator", "sem_agg_features"),
    ("llmcodegensemaaggjoinfeaturesoperator", "sem_agg_features"),
    ("semaggfeatures", "sem_agg_features"),
    ("codedatadistiller", "sem_distill"),
    ("semdistilldata", "sem_distill"),
    ("codebasedfeatureextractor", "sem_extract_features"),
    ("llmfeatureextractor", "sem_extract_features"),
    ("semextractfeaturesllm", "sem_extract_features"),
    ("histgradientboostingclassifier", "apply_with_sem_choose"),
    ("histgradientboostingregressor", "apply_with_sem_choose"),
    ("randomforestclassifier", "apply_with_sem_choose"),
    ("randomforestregressor", "apply_with_sem_choose"),
    ("gradientboostingclassifier", "apply_with_sem_choose"),
    ("gradientboostingregressor", "apply_with_sem_choose"),
    ("xgbclassifier", "apply_with_sem_choose"),
    ("xgbregressor", "apply_with_sem_choose"),
    ("lgbmclassifier", "apply_with_sem_choose"),
    ("lgbmregressor", "apply_with_sem_choose"),
)


def map_label(c, pairs=OPERATOR_WORDS) -> Column:
    """Category of the first keyword the label contains (any case), else the label itself."""
    c = _col(c)
    low = F.lower(c)
    hits = [F.when(low.contains(word), F.lit(category)) for word, category in pairs]
    return F.coalesce(*hits, c)


def is_semantic(c, pairs=OPERATOR_WORDS) -> Column:
    """Label names an operator that learns from data: by prefix, by name or by keyword."""
    low = F.lower(F.trim(_col(c)))
    named = low.startswith("sem_") | low.isin("apply_with_sem_choose", "sem_choose")
    for word, category in pairs:
        if category != "sem_select":
            named = named | low.contains(word)
    return F.coalesce(named, F.lit(False))


def maps_to_edges(df: DataFrame, graph: str, parents: str | None = None, children: str | None = None) -> DataFrame:
    """Parent and child maps (node → list of nodes) → distinct edge rows."""
    parts = []
    if children:
        parts.append(
            df.select(graph, F.explode(children).alias("source", "_t")).select(
                graph, "source", F.explode("_t").alias("target")
            )
        )
    if parents:
        parts.append(
            df.select(graph, F.explode(parents).alias("target", "_s")).select(
                graph, F.explode("_s").alias("source"), "target"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()
