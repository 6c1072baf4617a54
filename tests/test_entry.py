"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_optional_subpackage():
    code = "import sys, bitweave.catalog, bitweave.streaming.units, bitweave.functions.audio_layout; assert not [m for m in sys.modules if m.startswith('bitweave.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_without_it(tmp_path):
    import shutil

    for name in ("bitweave", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ts_pid_counts' in q and not [x for x in q if x[:2] == 'op' or x == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
