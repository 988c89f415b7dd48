"""The entry points without the training-text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LOOK = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
print(len(names), any(n.startswith("op") for n in names), "pipeline" in names)
"""


def look(root) -> list[str]:
    return subprocess.run([sys.executable, "-c", LOOK.format(root=str(root))], cwd=str(root), env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__")
    for k, left_out in enumerate(([], ["corpus_pipeline.py"])):
        copy = shutil.copytree(ROOT, tmp_path / str(k), ignore=skip)
        for name in left_out:
            (copy / name).unlink(missing_ok=True)
        found = look(copy)
        assert int(found[0]) > 40 and found[1:] == ["False", "False"]
