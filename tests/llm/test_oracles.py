import pytest

from tests import oracle
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    oracle.same(spark, oracle.connect(), queries.QUERIES[name], queries.ORACLES[name])


def test_lines_query_runs_whole_table(spark):
    out = queries.QUERIES["op10_fuzzy_lines"](spark, oracle.DATA)
    c = oracle.connect()
    want = c.sql(r"SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')").fetchall()[0][0]
    assert out.count() == want
