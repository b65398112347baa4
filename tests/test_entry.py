import __spark_entry__ as E


def test_registry_and_oracles_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "quality" in df.columns and all(0.0 <= r.quality <= 1.0 for r in rows)


def test_every_query_plans(spark):
    from tests.conftest import SMOKE

    for name, fn in E.queries().items():
        if name == "A10_write_corpus":
            continue
        fn(spark, SMOKE).schema  # analysis must succeed


def test_inventory_resolves_and_is_registered():
    import re

    import webspin

    keys = E.queries()
    for inv in webspin.INVENTORY:
        assert callable(webspin.resolve(inv)), inv
        base = inv.split("-")[0]
        if "-" not in inv:
            assert any(re.match(rf"^{base}_", k) for k in keys), inv


def test_entry_without_the_optional_subpackage(tmp_path):
    """The rest registers its queries with webspin/llm, tests/llm and the
    pipeline's file gone, or with only the folders gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    home = pathlib.Path(E.__file__).parent
    for pipeline in (True, False):
        to = tmp_path / str(pipeline)
        to.mkdir()
        for name in ("webspin", "checks"):
            shutil.copytree(home / name, to / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(home / "__spark_entry__.py", to)
        if pipeline:
            shutil.copy(home / "corpus_pipeline.py", to)
        code = ("import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); "
                "print(len(q), set(s) <= set(q), 'pipeline' in q, any(k.startswith('op') for k in q))")
        out = subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
        n, *flags = out.stdout.split()
        assert int(n) >= 100 and flags == ["True", "False", "False"]
