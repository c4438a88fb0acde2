"""The repository without the subpackage of the ten operators: everything else imports and answers."""

import shutil
import subprocess
import sys

import pytest

from conftest import ROOT


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_the_rest_stands_alone(tmp_path, with_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "inkledger" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if not with_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(len(names), 'pipeline' in names, any(n.startswith('op') and n[2].isdigit() for n in names))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    count, pipeline, operators = said.stdout.split()
    assert int(count) > 70 and (pipeline, operators) == ("False", "False")
