"""Registered queries against their SQL on whole small tables."""

import pytest

from custos.llm.oracles import ORACLE_SQL
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001


@pytest.mark.parametrize("name", ["op5_minhash_jaccard_join", "op10_doubling_substring_dedup", "op13_induced_suffix_dedup"])
def test_whole_table_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF001)
    cursor = duck.execute(ORACLE_SQL[name])
    assert [d[0] for d in cursor.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, cursor.fetchall()))
