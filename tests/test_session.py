from __future__ import annotations

from docweave import session


class Fake:
    def __init__(self, **conf):
        self.conf = conf


def test_configured_folder_is_qualified(spark):
    """A path without a scheme lies in the default file system, not on each machine's own disk."""
    hadoop = spark._jsc.hadoopConfiguration()
    assert session.qualified(spark, "/shared/x/") == "file:/shared/x"
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "hdfs://127.0.0.1:9")
    try:
        assert session.qualified(spark, "/shared/x/") == "hdfs://127.0.0.1:9/shared/x"
        assert session.qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"
        assert session.qualified(spark, "file:///shared/x") == "file:/shared/x"
    finally:
        hadoop.set("fs.defaultFS", before)
    assert session.stage_dir(spark) == session.qualified(spark, spark.conf.get("spark.checkpoint.dir"))


def test_temporary_folder_only_locally():
    import pytest

    local = Fake(**{"spark.master": "local[2]"})
    assert session.stage_dir(local) == session.stage_dir(local)
    with pytest.raises(ValueError):
        session.stage_dir(Fake(**{"spark.master": "yarn"}))


def test_staged_rows_are_the_same(golden):
    staged = session.stage(golden)
    assert sorted((r["doc"], sorted(r["m"].items())) for r in staged.collect()) == sorted(
        (r["doc"], sorted(r["m"].items())) for r in golden.collect()
    )
