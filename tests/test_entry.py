import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_every_annotation_query_has_sql():
    from helixtab.plans.annotation import ORACLES, QUERIES

    assert len(QUERIES) > 60 and set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {r["sample_id"] for r in entry.entry(spark).collect()} == {"gen0", "gen1000", "gen2000", "gen3000"}


def test_imports_without_the_optional_part(tmp_path):
    """The rest imports and registers its queries where the subpackage and the pipeline are missing."""
    import os
    import shutil

    for name in ("__spark_entry__.py", "helixtab"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "helixtab" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'category_counts' in e.queries() and not any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in e.queries())"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode == 0


def test_imports_with_the_folder_alone_deleted(tmp_path):
    """corpus_pipeline.py is there, but what it imports isn't."""
    import os
    import shutil

    for name in ("__spark_entry__.py", "helixtab"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "helixtab" / "llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").write_text("from helixtab.llm import quality\n")
    code = "import __spark_entry__ as e; assert 'category_counts' in e.queries() and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True).returncode == 0
