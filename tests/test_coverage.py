"""COVERAGE.md names only what is there."""

import importlib
import re
from pathlib import Path

import __spark_entry__ as entry


def test_named_functions_and_queries():
    text = (Path(__file__).parent.parent / "COVERAGE.md").read_text()
    rows = re.findall(r"^\| ([A-Z]\d+) \| (.+?) \| (\S+) \|$", text, re.M)
    assert len(rows) > 180 and len({r[0] for r in rows}) == len(rows)
    queries = entry.queries()
    for name, functions, query in rows:
        optional = "llm." in functions
        for path in re.findall(r"\b((?:operators|functions|sources|streaming|llm)\.\w+)\.(\w+)", functions):
            try:
                module = importlib.import_module(f"tessera.{path[0]}")
            except ImportError:
                assert optional, (name, path)
                continue
            assert callable(getattr(module, path[1], None)), (name, path)
        assert query == "-" or query in queries or optional, (name, query)
