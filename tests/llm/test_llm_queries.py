"""Queries against DuckDB, and cases that every operator must survive with defined results."""

import pytest
from compare import connect, diff

from featureflow.llm import (
    cotraining,
    filter_audit,
    lang_id,
    line_dedup,
    merkle,
    mixing,
    packing,
    pii,
    quality_rules,
    resampling,
    simhash,
    swap_packing,
    training_order,
)
from featureflow.llm.queries import ORACLES, QUERIES

CASES = {
    "op1": lambda d: mixing.mix_rows(d),
    "op1 rows": lambda d: mixing.mix_rows(d, mixing.PIPELINE, whole_rows=True),
    "op2": merkle.edit_likeness,
    "op3": lambda d: lang_id.predict(d, lang_id.learn(d)),
    "op4": pii.report,
    "op5": packing.pack,
    "op6": lambda d: quality_rules.apply_policy(quality_rules.ledger(d)),
    "op6 rows": quality_rules.keep_documents,
    "op7": line_dedup.dedup_lines,
    "op7 rows": line_dedup.without_repeats,
    "op8": training_order.materialise,
    "op9": lambda d: cotraining.score(d, cotraining.learn(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) quality"))),
    "op10": simhash.near_duplicates,
    "op10 rows": simhash.one_of_each,
    "op11": lambda d: filter_audit.audit(d, d.selectExpr("doc_id", "1 AS quality", "cast(NULL AS int) AS toxic")),
    "op12": swap_packing.pack,
    "op13": lambda d: resampling.resample(d, d.select("text")),
}
ONE_ROW_EACH = ("op2", "op3", "op4", "op6", "op7", "op9", "op10", "op13")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, sf, name):
    assert diff(spark, connect(sf), sf, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("case", sorted(CASES))
def test_odd_rows(odd, case):
    found = CASES[case](odd).collect()
    if case in ONE_ROW_EACH:
        assert len(found) == odd.count()
    if case.endswith("rows"):
        assert found and found[0].__fields__ == odd.columns


@pytest.mark.parametrize("case", sorted(CASES))
def test_empty_table(empty, case):
    assert CASES[case](empty).collect() == []
