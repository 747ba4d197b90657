import os

import pytest

from tabmeter.llm.common import Staged, shared_folder


class Session:
    """A session with or without a shared folder, on a master of some kind."""

    def __init__(self, master, folder=None):
        self.conf = self.sparkContext = self
        self.master, self.folder = master, folder

    def getConf(self):
        return self

    def get(self, name, default=None):
        return self.folder or default


def test_clusters_must_name_a_shared_folder():
    assert shared_folder(Session("spark://host", "hdfs://store/x/")) == "hdfs://store/x"
    assert shared_folder(Session("local[2]")) == shared_folder(Session("local"))
    for master in ("spark://host", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Session(master))


def test_staged_tables_are_read_again_and_dropped(spark):
    staged = Staged(spark)
    written = staged.write(spark.range(5).selectExpr("id", "id * 2 AS twice"), "t")
    assert sorted(tuple(r) for r in written.collect()) == [(i, 2 * i) for i in range(5)]
    assert os.path.isdir(staged.paths[0])
    staged.drop(written)
    assert not os.path.isdir(staged.paths[0])
