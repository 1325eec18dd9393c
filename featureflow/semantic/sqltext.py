"""SQL texts of the text rules that programs use (same rules as functions.text)."""

from __future__ import annotations

from featureflow.functions.text import ACCENTED, NON_ASCII, PLAIN, WORD_PATTERN
from featureflow.semantic.program import text_literal


def plain(c: str) -> str:
    """Lower case without accents."""
    marked = f"translate(cast({c} AS string), '{ACCENTED}', '{PLAIN}')"
    return f"lower(CASE WHEN cast({c} AS string) RLIKE {text_literal(NON_ASCII)} THEN {marked} ELSE cast({c} AS string) END)"


def words(c: str) -> str:
    return f"regexp_extract_all({plain(c)}, {text_literal(WORD_PATTERN)}, 0)"


def squeezed(c: str) -> str:
    """Trimmed, with single blanks."""
    return f"trim(regexp_replace({c}, '\\\\s+', ' '))"


def folded(c: str) -> str:
    """Key of a spelling: lower case, single blanks."""
    return f"lower({squeezed(c)})"


def collision_key(c: str) -> str:
    """Key of a variant group: plain words without punctuation, each once, in order."""
    return f"array_join(array_sort(array_distinct({words(c)})), ' ')"


def word_grams(c: str, sizes: list[int]) -> str:
    """All runs of neighbouring words of the given sizes."""
    w = words(c)
    runs = [
        f"transform(sequence(1, greatest(size(w) - {n - 1}, 0) + 1), i -> CASE WHEN i + {n - 1} <= size(w) "
        f"THEN array_join(slice(w, i, {n}), ' ') END)"
        for n in sizes
    ]
    inner = f"array_distinct(array_compact(concat({', '.join(runs)})))"
    return f"transform(array({w}), w -> {inner})[0]"
