import os
from types import SimpleNamespace

import pytest

from lexiflow.plans import lineage


def test_tables_are_written_to_the_shared_folder_and_deleted(spark):
    table = lineage.cut_table(spark.range(5).toDF("a"))
    path = table.inputFiles()[0].replace("file:///", "/")
    assert path.startswith(lineage.checkpoint_dir(spark).removeprefix("file:")) and os.path.exists(path) and table.count() == 5
    lineage.release()
    assert not os.path.exists(path)


def test_a_cluster_without_a_shared_folder_is_an_error():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.checkpoint_dir(session)
