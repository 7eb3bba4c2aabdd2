import pytest

from tidemark.llm import pseudonyms

CASES = [("4111 1111 1111 1111", " 12/27", "card"), ("4111 1111 1111 1111", " 3 times", "card"), ("ES91 2100 0418 4502 0005 1332", " 12", "iban"), ("AT61 1904 3002 3457 3201", " IN WIEN", "iban"), ("+1 555 123 4567", " 22", "phone"), ("+49 30 1234567", " ok", "phone"), ("+44 20 7946 0958", " 22", "phone")]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(2 * i + k, "pay " + value + (after if k else "")) for i, (value, after, _) in enumerate(CASES) for k in (0, 1)]
    out = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k")
    return {r["doc_id"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_values_followed_by_short_groups(got, i):
    value, after, kind = CASES[i]
    alone, followed = got[2 * i], got[2 * i + 1]
    assert alone["kinds"] == followed["kinds"] == kind
    assert value not in alone["text"] and followed["text"] == alone["text"] + after
