"""What a row's result is made of must be computed once for each row: plans stay small, and no generator's list is computed again in an inferred filter."""

import pytest

from tessera.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["Q1_Q4_rewrites", "Q1_Q5_deep_rewrites", "Q12_enhanced"])
def test_rewrites_are_computed_once(spark, name):
    assert len(plan(spark, name)) < 100_000  # Q1_Q4_rewrites had 1.5 million letters, Q12_enhanced 0.7


@pytest.mark.parametrize("name", ["Q1_Q4_rewrites", "Q12_enhanced"])
def test_questions_are_dealt_to_all_cores(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(("name", "most"), [("G19_table_blocks", 1), ("H12_chunks_data", 1), ("H13_without_tables", 1), ("M5_data_metadata", 1), ("G22_charts", 1)])
def test_pieces_of_reports_are_cut_once(spark, name, most):
    text = plan(spark, name)
    caption = text.count("(?i)(?=(?:Table|Annexure)") + text.count("(?i)(?=(?:(?:Table|Annexure)")
    assert caption == most  # H12 cut a report for its tables and for what is left; charts did for each of its pieces
    assert text.count("[^\\n]*\\|[^\\n]*\\|") <= 2  # the test of a line: once for a block's lines, not at each use of the block's end


def test_markers_of_schemes_are_looked_for_once(spark):
    assert plan(spark, "H10_H11_chunks_scheme").count("HOW TO APPLY|APPLICATION") == 1
