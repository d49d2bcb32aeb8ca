import pytest

from contract.check import compare, oracle_connection
from contract.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_oracle(spark, oracle, name):
    if name in ORACLES:
        problem, _ = compare(spark, oracle, SMALL, QUERIES[name], ORACLES[name])
        assert problem is None, problem
    else:
        assert QUERIES[name](spark, SMALL).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that only lay out a plan (no stored steps) are cheap to explain.
@pytest.mark.parametrize("name", [
    "q_rule_issues", "q_chunks", "q_profile", "q_line_owner", "q_archaeology", "q_top_files",
    "q_verdicts", "q_index_new", "q_nearest_packed", "q_call_edges", "q_call_nodes", "q_choose_patches"])
def test_no_cross_join_in_plans(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned_at_the_scan(spark):
    text = plan(QUERIES["q_secret_lines"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(QUERIES["q_rule_issues"](spark, SMALL))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text


def test_line_rules_run_without_shuffle_or_python(spark):
    text = plan(QUERIES["q_secret_lines"](spark, SMALL))
    assert "Exchange" not in text and "Python" not in text


def test_top_k_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["q_top_files"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan(QUERIES["q_recent"](spark, SMALL))


def test_neighbours_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["q_nearest_packed"](spark, SMALL))
