"""Driver contract smoke: entry() runs on sf0.001; names line up."""


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.limit(5).collect()
    assert df.columns == ["word", "cnt"] and len(rows) == 5
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_library_query_has_an_oracle():
    """Itself, or, where it needs a whole vocabulary, its form with a small one."""
    from lipi.plans import MODEL_QUERIES, ORACLES, QUERIES
    assert set(ORACLES) == set(QUERIES) - MODEL_QUERIES
    assert {f"{n}_v160" for n in MODEL_QUERIES} <= set(ORACLES)


def test_entry_without_the_training_data_operators(tmp_path):
    """The folder of the operators and the pipeline taken out: all else is there."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(os.path.join(root, "lipi", "llm")):
        return
    shutil.copytree(os.path.join(root, "lipi"), tmp_path / "lipi", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as E; print(len(E.queries()), 'pipeline' in E.queries(), len(E.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1] == "False" and int(out[2]) > 50
