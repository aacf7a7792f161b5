"""Every registered key against its SQL oracle (DuckDB) at sf0.001."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from deckflow.plans import catalog

catalog.load_all()

KEYS = sorted(catalog.QUERIES)  # the subpackage llm has its own tests


@pytest.fixture(scope="module")
def results(spark):
    from compare import compare
    return compare(spark, SF_SMALL, verbose=True)


def test_every_key_has_oracle():
    assert set(catalog.SQL) == set(KEYS)
    assert set(KEYS) <= set(E.queries()) and set(KEYS) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(results, key):
    r = results[key]
    assert "error" not in r, r
    assert r["match"], r
    assert r["types_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["user_id", "position", "source", "card_id", "concept", "title", "topic", "depth"]
    assert df.count() > 0


def test_adjacent_cards_are_whole(spark):
    """The card rows of the neighbour concepts give every count of adjacent_cards."""
    q = E.queries()
    rows, near, counts = (q[k](spark, SF_SMALL) for k in ("adjacent_card_rows", "adjacent_concepts", "adjacent_cards"))
    got = near.join(rows, "neighbour").groupBy("user_id", "neighbour").count()
    want = {tuple(r) for r in counts.select("user_id", "neighbour", "n_cards").collect()}
    assert want and {tuple(r) for r in got.select("user_id", "neighbour", "count").collect()} == want
