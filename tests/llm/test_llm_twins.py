"""Registered queries against DuckDB, or against each other where SQL has no form for them."""

import pytest
import twins

from textreg.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return twins.connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, folder, con, name):
    assert twins.differences(QUERIES[name](spark, folder), con, ORACLES[name]) == []


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_counts_are_the_encoder_lengths(spark, folder):
    coded = {r["doc_id"]: (r["n_pieces"], r["round_trip"]) for r in QUERIES["op5_sentencepiece"](spark, folder).collect()}
    counts = {r["doc_id"]: (r["n_tokens"], True) for r in QUERIES["op8_token_counts"](spark, folder).collect()}
    assert coded == counts
