"""The driver's entry, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("larkspan", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "larkspan").mkdir()
    for p in (ROOT / "larkspan").iterdir():
        if p.name != "llm":
            (tmp_path / "larkspan" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'airtime_report' in n and 'pipeline' not in n and not any(k.startswith('op1') for k in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
