def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert {"op1_chat_format", "op4_exact_dedup", "op11_hilbert_neighbours", "op13_lexical_search"} <= set(E.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import lipi
    root = pathlib.Path(lipi.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f


def test_the_entry_loads_no_pandas():
    """The driver and every Python worker would hold it."""
    import pathlib
    import subprocess
    import sys
    root = pathlib.Path(__file__).parents[2]
    code = "import sys, __spark_entry__; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
