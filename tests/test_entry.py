"""The driver's entry imports, and every query with SQL has a query."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from narrata import catalog


#: What SQL cannot say; test_narration.py and test_books.py hold these against cases worked out by hand or by brute force.
WITHOUT_SQL = {
    "apply_and_commit", "apply_spans", "associate_block_ids", "html_to_blocks", "ingest", "ingest_blocks", "pack_sentences", "plan_book", "prepass", "split_oversized", "suggestion_order", "union_detectors",
}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    queries, sql = catalog.load()
    assert set(queries) - set(sql) == WITHOUT_SQL
    assert set(sql) <= set(queries)


def test_entry_has_rows(spark):
    rows = entry.entry(spark)
    assert rows.limit(1).count() == 1
    assert {"start", "end", "original", "replacement"} <= set(rows.columns)


def test_entry_imports_without_the_training_data_operators(tmp_path):
    """Whether corpus_pipeline.py stays behind or not."""
    top, rest = Path(entry.__file__).parent, tmp_path / "rest"
    shutil.copytree(top / "narrata", rest / "narrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (top / name).exists():
            shutil.copy(top / name, rest)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=rest).returncode == 0
    (rest / "corpus_pipeline.py").unlink(missing_ok=True)
    assert subprocess.run([sys.executable, "-c", code], cwd=rest).returncode == 0
