"""Where written cuts of the lineage go."""

from types import SimpleNamespace

import pytest

from tidemark import session


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default),
                           sparkContext=SimpleNamespace(master=master))


def test_the_cluster_folder_is_used():
    assert session.scratch_root(fake("yarn", "hdfs:///shared/ck/")) == "hdfs:///shared/ck"


def test_a_cluster_never_falls_back_to_a_local_folder():
    with pytest.raises(ValueError):
        session.scratch_root(fake("spark://host:7077"))


def test_a_local_session_gets_one_temporary_folder():
    assert session.scratch_root(fake("local[2]")) == session.scratch_root(fake("local[2]"))


def test_the_cut_holds_the_same_rows(spark):
    df = spark.range(5).withColumnRenamed("id", "n")
    again = session.materialize(df, "t")
    assert again.dtypes == df.dtypes and sorted(r.n for r in again.collect()) == list(range(5))
