"""The scratch folder is the shared one, never a guess on a cluster."""

from types import SimpleNamespace

import pytest

from cohortloom.session import scratch_path


def session(master, folder=None):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(session(master), "x")
    assert scratch_path(session(master, "hdfs://shared/"), "x").startswith("hdfs://shared/cohortloom/x-")


def test_a_local_session_sets_its_own():
    spark = session("local[4]")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
