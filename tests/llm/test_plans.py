"""Plan shapes of the operators' queries that must hold at any size."""

import re

import pytest

from daywatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op7_mix_sources"])
def test_native_queries_start_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", text)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["op4_chat_format", "op8_neighbours"])
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_neighbours_send_every_entry_once(spark):
    text = plan(QUERIES["op8_neighbours"](spark, SF))
    assert "Generate" not in text and "CoGroup" not in text
    assert text.count("MapInArrow") == 3         # entries, queries, and where they meet
