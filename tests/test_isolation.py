"""Without the text operators' folders the rest still registers its queries."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_without_the_text_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md"))
    for keep_pipeline in (True, False):
        if not keep_pipeline and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        script = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'co_change' in q and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
        subprocess.run([sys.executable, "-c", script], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"}, check=True)
