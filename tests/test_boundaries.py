"""The library stands without the llm subpackage, and says so in its imports."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_else_imports_llm():
    for p in (ROOT / "ldlake").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.M), p


def test_entry_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "ldlake", tmp_path / "ldlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)
