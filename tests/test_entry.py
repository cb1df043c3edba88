"""The entry without the corpus operators, or without what they need."""

from __future__ import annotations

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(missing: str) -> list[str]:
    """Queries that the entry registers if ``missing`` can't be imported."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*e.queries())"
    return subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True, capture_output=True, text=True).stdout.split()


def test_a_missing_dependency_of_the_corpus_operators_costs_only_these():
    for missing in ("xxhash", "laborlens.llm"):
        left = names(missing)
        assert "c01_skill_demand" in left and not [n for n in left if n.startswith("op") or n == "pipeline"]


def test_no_module_defines_a_name_twice():
    for file in (ROOT / "laborlens").rglob("*.py"):
        names = [n.name for n in ast.parse(file.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), (file.name, [n for n in names if names.count(n) > 1])
