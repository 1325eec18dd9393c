import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

EXTRA = "fp string, slot string, gone string, line string, d string, tie string, row string, n_words string, lines string, c0 string, lang_pred string, root string, h1 string, score string, u string, part string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA

LONG = "word and then another one, with marks. " * 3000
LINE = "one line of ten words that many of the documents share"


def rows(pairs):
    return [(i, t, lang, source, None if t is None else len(t), *["x"] * len(EXTRA.split(", "))) for i, t, lang, source in pairs]


ODD = [
    (1, None, None, None),
    (2, "", "en", "src0"),
    (3, LONG, "en", "src0"),
    (3, LONG, "en", "src0"),
    (4, LONG, None, "src9"),
    (None, "no id here but some words", "de", None),
    (5, LINE + "\n" + "a", "fr", "src1"),
    (6, LINE + "\n" + LINE.replace("many", "some"), "fr", "src1"),
    (7, "\n\n \n", "es", "src12"),
    (8, "é" * 500 + "   mail a@b.co +1 (234) 555-0100 " + "9" * 3000, "es", "src12"),
    (9, "the same short text", "en", "src1"),
    (10, "the same short text", "en", "src1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(ODD), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
