import os
from types import SimpleNamespace as N

import pytest

from quillspark import session


def test_cluster_without_a_shared_folder_is_refused():
    none = N(isDefined=lambda: False)
    spark = N(sparkContext=N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none))), conf=N(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(spark)


def test_checkpoints_are_removed(spark):
    df = session.cut(spark.range(5).repartition(2))
    assert df.count() == 5
    folder = session.checkpoint_folder(spark).removeprefix("file:")
    assert os.listdir(folder)
    session.remove_checkpoints(spark)
    assert not os.path.exists(folder)
    assert session.cut(spark.range(3)).count() == 3  # made anew
