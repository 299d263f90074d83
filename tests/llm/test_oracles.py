"""Queries with SQL against DuckDB, and all of them for schema and rows."""

import pytest

import corpus_pipeline
from cambium.llm import oracles, queries
from tests.oracle import expected, got


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_oracle(spark, sf, name):
    assert got(queries.QUERIES[name](spark, sf)) == expected(oracles.ORACLES[name], sf)


def test_ten_operators():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 11))


def test_nothing_else_imports_llm():
    import re
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent / "cambium"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", f.read_text(), re.M), f
