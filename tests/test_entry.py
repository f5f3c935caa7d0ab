import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_a_run(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["path", "location", "score", "file_id"]


def test_without_the_llm_subpackage(tmp_path):
    """The rest still imports when the subpackage and the pipeline are gone; a broken import inside them is not hidden."""
    shutil.copytree(ROOT / "trawl", tmp_path / "trawl", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_and' in q and not any(n.startswith('op') for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode
