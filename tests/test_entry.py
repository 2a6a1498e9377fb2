"""The driver's contract, also where the training-data operators are taken away."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_part():
    code = (
        "import sys; sys.modules['brookmill.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names\n"
        "assert set(e.oracle_sql()) <= names"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_of_a_tree_without_the_optional_folders(tmp_path):
    """A copy of the repository without them, with and without the pipeline beside it."""
    skipped = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", ".pytest_cache", ".hypothesis")
    tree = shutil.copytree(ROOT, tmp_path / "tree", ignore=skipped)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and 'pipeline' not in n and not any(x.startswith('op1_') for x in n)"
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tree, check=True, timeout=120)
        (tree / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry_does_not_hide_other_import_errors():
    code = (
        "import sys; sys.modules['brookmill.plans.text_queries'] = None\n"
        "try:\n    import __spark_entry__\nexcept ImportError:\n    sys.exit(0)\nsys.exit(1)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
