"""The queries as production runs them: with whole-stage code generation, which other tests leave off."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_mixing", "op2_url_filter", "op3_substring_dedup", "op5_personal_data", "op6_simhash", "op7_decontamination", "op8_topk_search", "op9_token_files", "op10_language_id", "op12_lexical_search", "op13_sharding", "pipeline"])
def test_generated_code_gives_the_same_rows(spark, name):
    rows = lambda: Counter(tuple(r) for r in e.queries()[name](spark, SF).collect())
    plain = rows()
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        assert rows() == plain and plain
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
