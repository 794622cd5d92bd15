"""The library without its text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def _copy(to: Path, *left_out: str) -> Path:
    skip = shutil.ignore_patterns("__pycache__", ".git", *left_out)
    for name in ("buildlens", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, to / name, ignore=skip)
        elif source.exists() and name not in left_out:
            shutil.copy(source, to / name)
    return to


def _count(folder: Path) -> list[str]:
    return subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_text_operators(tmp_path):
    for at, left_out in enumerate((["llm"], ["llm", "corpus_pipeline.py"])):
        (tmp_path / str(at)).mkdir()
        folder = _copy(tmp_path / str(at), *left_out)
        n, ops, pipeline, twins = _count(folder)
        assert int(n) > 100 and (ops, pipeline, twins) == ("0", "False", "True")


def test_entry_beside_an_empty_folder(tmp_path):
    folder = _copy(tmp_path, "llm")
    (folder / "buildlens/llm/__pycache__").mkdir(parents=True)
    assert _count(folder)[1:3] == ["0", "False"]
