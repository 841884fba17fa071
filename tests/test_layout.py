"""The library stands without its optional part."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_nothing_imports_the_optional_part():
    for path in (ROOT / "quaystone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(x.startswith("quaystone.llm") or x.startswith("corpus_pipeline") for x in imported(path)), path


def test_every_query_is_named_once():
    from quaystone.plans.catalogue import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 60
