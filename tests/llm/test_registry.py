"""Corpus queries against their SQL."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])
from oracle import check  # noqa: E402

from ebbtide.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    check(spark, sf_dir, registry.QUERIES[name], registry.SQL[name])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
