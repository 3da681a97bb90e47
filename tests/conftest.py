import pytest

from cartloom.runtime import drop_scratch, local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "cartloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    drop_scratch(session)


@pytest.fixture
def large(monkeypatch):
    """Every table counts as large and every group of some rows as hot."""
    import cartloom.operators.ordered as ordered
    import cartloom.runtime as runtime

    monkeypatch.setattr(runtime, "SMALL_BYTES", 0)
    monkeypatch.setattr(ordered, "HOT_ROWS", 30)
