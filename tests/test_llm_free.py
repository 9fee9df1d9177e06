"""The library stands without its optional subpackage and the pipeline on it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_optional_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" in path.parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py", Path(__file__).name):
            continue
        text = path.read_text()
        assert "mediaweave.llm" not in text and "corpus_pipeline" not in text, path


def test_entry_without_the_optional_subpackage():
    code = (
        "import sys; sys.modules['mediaweave.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
