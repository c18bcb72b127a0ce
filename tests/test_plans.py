"""Written tables and settings that are put back."""

import os
from types import SimpleNamespace

import pytest

from quillmatch.plans.batches import small_batches
from quillmatch.plans.components import connected_components
from quillmatch.plans.storage import Scratch, shared_dir, written

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tables(spark):
    top = f"{shared_dir(spark)}/quillmatch"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_scratch_tables_go_and_others_stay(spark):
    df = spark.range(5).toDF("k")
    before = tables(spark)
    with Scratch(spark) as tmp:
        assert tmp.written(df, "one").count() == 5
        kept = tmp.written(df, "two")
        tmp.keep_last()
        assert len(tables(spark) - before) == 2
    assert kept.count() == 5 and {x.partition("-")[0] for x in tables(spark) - before} == {"two"}
    with pytest.raises(RuntimeError), Scratch(spark) as tmp:
        tmp.written(df, "three")
        raise RuntimeError
    assert written(df, "four").count() == 5
    assert {x.partition("-")[0] for x in tables(spark) - before} == {"two", "four"}


def test_components_leave_one_table(spark):
    before = tables(spark)
    made = connected_components(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"))
    assert len(tables(spark) - before) == 1 and {r.component for r in made.collect()} == {0}


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app", getConf=lambda: conf))

    assert shared_dir(session("spark://host:7077", "hdfs://host/tmp/")) == "hdfs://host/tmp"
    assert shared_dir(session("local[4]")).endswith("/app") and shared_dir(session("local"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_batches_are_bounded_within_the_block_only(spark):
    before = spark.conf.get(ROWS, None)
    with pytest.raises(RuntimeError), small_batches(spark, rows=7):
        sizes = spark.range(0, 30, 1, 1).mapInArrow(lambda batches: iter([b for b in batches if b.num_rows <= 7]), "id long")
        assert spark.conf.get(ROWS) == "7" and sizes.count() == 30
        raise RuntimeError
    assert spark.conf.get(ROWS, None) == before
