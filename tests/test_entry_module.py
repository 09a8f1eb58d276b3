import sys



def test_flagship_runs(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["doc_id"] and found.count() > 0


def test_oracles_belong_to_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_does_not_import_the_optional_folder():
    import subprocess

    code = "import sys, docquarry.plans.catalog; assert not [m for m in sys.modules if m.startswith('docquarry.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_entry_without_the_optional_folders(tmp_path):
    import shutil
    import subprocess

    root = __file__.rsplit("/tests/", 1)[0]
    shutil.copytree(f"{root}/docquarry", tmp_path / "docquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'word_attr' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
