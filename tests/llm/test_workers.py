"""Queries in workers that do not have the repository on their path."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("names", [["op8_quality_classifier", "op9_near_dedup"], ["op11_spelling_variants", "op12_importance_resampling", "op13_suffix_array_dedup"], ["pipeline"]])
def test_workers_need_no_repository(tmp_path, names):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})  # of the driver alone
import __spark_entry__ as entry
from brookmill.session import local_session
spark = local_session("far", 2, **{{"spark.checkpoint.dir": {str(tmp_path / 'shared')!r}}})
for name in {names!r}:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=600)
