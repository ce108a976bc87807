from unittest.mock import MagicMock

import pytest

from opsledger.session import ensure_checkpoint_dir


def _session(master, named=None):
    spark = MagicMock()
    sc = spark.sparkContext
    sc.master, state = master, {"dir": None}
    sc.getCheckpointDir.side_effect = lambda: state["dir"]
    sc.setCheckpointDir.side_effect = lambda d: state.update(dir=d)
    sc.getConf().get.side_effect = lambda k, d=None: named
    spark.conf.get.side_effect = lambda k, d=None: None
    return spark


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_has_to_name_the_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_session(master))
    assert ensure_checkpoint_dir(_session(master, "hdfs:///shared")) == "hdfs:///shared"


def test_a_local_session_gets_a_scratch_folder():
    assert ensure_checkpoint_dir(_session("local[4]"))
