import os
from types import SimpleNamespace

import pytest

from parley.llm import simhash
from parley.llm.scratch import Scratch, scope
from parley.sources.stored import shared_folder


def session(master, folder=None, context_folder=None):
    made = {}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context_folder, setCheckpointDir=lambda d: made.update(dir=d))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context), made


def test_clusters_need_a_shared_folder():
    for master in ("spark://x:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master)[0])
        assert shared_folder(session(master, "hdfs://x/y/")[0]) == "hdfs://x/y"
        assert shared_folder(session(master, None, "hdfs://z")[0]) == "hdfs://z"
    spark, made = session("local[2]")
    assert shared_folder(spark) == made["dir"] and os.path.isdir(made["dir"])
    os.rmdir(made["dir"])


def test_scope_deletes_what_calls_have_written(spark, small_docs):
    folder = spark.conf.get("spark.checkpoint.dir")
    outside = Scratch(spark, "kept").keep(spark.range(3))
    before = set(os.listdir(folder))
    with scope(spark):
        rows = simhash.near_duplicates(small_docs).collect()
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before and len(rows) == small_docs.count() and outside.count() == 3
