import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_subpackage():
    for path in (ROOT / "docketry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"docketry\.llm|from \.+llm", path.read_text()), path
