import os
import threading
from types import SimpleNamespace

import pytest

from docloom import session


def local(path):
    return path.removeprefix("file://")


def test_scratch_goes_and_other_results_stay(spark):
    kept = session.new_path(spark, "kept")
    with session.scratch(spark):
        inside = session.new_path(spark, "inside")
        with session.scratch(spark):
            deeper = session.materialise(spark.range(5), "deeper")
            deeper.write.parquet(inside)
            assert deeper.count() == 5
        assert spark.read.parquet(inside).count() == 5
        spark.range(3).write.parquet(kept)
    assert not os.path.exists(local(inside)) and spark.read.parquet(kept).count() == 3


def test_scratch_goes_after_an_error(spark):
    with pytest.raises(RuntimeError), session.scratch(spark):
        path = session.new_path(spark, "lost")
        spark.range(3).write.parquet(path)
        raise RuntimeError
    assert not os.path.exists(local(path))


def test_a_cluster_needs_a_shared_folder():
    def of(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(of(master))
        assert session.shared_dir(of(master, "hdfs://n/x/")) == "hdfs://n/x"
    assert session.shared_dir(of("local[4]")).startswith("file://")


def test_two_threads_have_scratch_folders_of_their_own(spark):
    """One thread's folder goes while the other's, begun inside that time, stays."""
    began, ended, result = threading.Event(), threading.Event(), {}

    def other():
        began.wait(30)
        with session.scratch(spark):
            rows = session.materialise(spark.range(7), "other")
            ended.set()
            gone.wait(60)
            result["n"] = rows.count()

    gone = threading.Event()
    thread = threading.Thread(target=other)
    thread.start()
    with session.scratch(spark):
        session.materialise(spark.range(3), "own")
        began.set()
        ended.wait(60)
    gone.set()
    thread.join(60)
    assert result == {"n": 7}


def test_a_callers_batch_size_stays(spark):
    other = spark.newSession()
    session.ship_package(other)
    assert other.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(session.BATCH_ROWS)
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    session.ship_package(own)
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
