"""Where staged tables go: context folder, then the setting, then (local only) a scratch folder."""

from __future__ import annotations

import os

import pytest

from seatledger.session import ensure_checkpoint_dir


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class Session:
    def __init__(self, master, setting=None, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}


def test_the_contexts_folder_comes_first():
    assert ensure_checkpoint_dir(Session("yarn", "hdfs://a/set", "hdfs://a/context")) == "hdfs://a/context"


def test_the_setting_is_used_as_given():
    s = Session("spark://host:1", "hdfs://a/set")
    assert ensure_checkpoint_dir(s) == "hdfs://a/set"
    assert s.sparkContext.folder == "hdfs://a/set"


def test_a_scratch_folder_only_with_a_local_master():
    s = Session("local[2]")
    first = ensure_checkpoint_dir(s)
    assert os.path.isdir(first) and ensure_checkpoint_dir(s) == first
    for master in ("yarn", "spark://host:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(Session(master))
