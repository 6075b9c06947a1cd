"""The shared folder: named by the session, private on one machine, an error on a cluster."""

from types import SimpleNamespace

import pytest

from srcfacts.session import shared_folder


def _session(master, conf=None, known=None):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: known, getConf=lambda: SimpleNamespace(get=lambda key: (conf or {}).get(key))))


def test_where_files_are_shared():
    assert shared_folder(_session("yarn", known="hdfs:/c/1")) == "hdfs:/c/1"
    assert shared_folder(_session("spark://h:7077", {"spark.checkpoint.dir": "s3a://b/c"})) == "s3a://b/c"
    for master in ("local", "local[4]", "local[*]"):
        assert "srcfacts-" in shared_folder(_session(master))
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://h"):
        with pytest.raises(ValueError):
            shared_folder(_session(master))
