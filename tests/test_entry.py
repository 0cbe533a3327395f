"""Registered queries and their SQL agree in names."""

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 3


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """With both folders and the pipeline gone, the entry point imports and keeps its other queries."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    for name in ("longview", "__spark_entry__.py"):
        copy = shutil.copytree if (root / name).is_dir() else shutil.copy
        copy(root / name, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if (root / name).is_dir() else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 120 and not [k for k in q if k.startswith('op') and k[2].isdigit()] and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True).returncode == 0
