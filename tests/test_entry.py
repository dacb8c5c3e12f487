import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 25


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_corpus_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['boxwright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'A1' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
