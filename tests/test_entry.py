"""The entry module with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') for n in q), set(o) <= set(q))"


def _ask(root):
    out = subprocess.run([sys.executable, "-W", "always", "-c", ASK], cwd=root, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(root)}, check=True)
    return *out.stdout.split()[:3], out.stderr


def test_entry_with_and_without_the_subpackage(tmp_path):
    keep = shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json")
    shutil.copytree(ROOT, tmp_path / "a", ignore=keep)
    whole = _ask(tmp_path / "a")
    if os.path.isdir(f"{ROOT}/tidemark/llm"):
        with open(tmp_path / "a" / "tidemark" / "llm" / "registry.py", "a", encoding="utf-8") as f:
            f.write("\nimport a_module_that_is_not_there\n")
        broken = _ask(tmp_path / "a")
        assert broken[1] == "0" and "a_module_that_is_not_there" in broken[3]  # not in silence
        shutil.rmtree(tmp_path / "a" / "tidemark" / "llm")
    (tmp_path / "a" / "corpus_pipeline.py").unlink(missing_ok=True)
    bare = _ask(tmp_path / "a")
    assert bare[1] == "0" and int(bare[0]) >= 150 and bare[2] == "True" and "left out" not in bare[3]
    assert int(whole[0]) >= int(bare[0])
