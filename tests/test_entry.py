import __spark_entry__


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "_there", lambda module: False)
    names = __spark_entry__.queries()
    assert "fea01_lexical_profile" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
