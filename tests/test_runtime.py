import glob
import time

import pytest

from codewell import runtime


class FakeContext:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return self

    def get(self, _):
        return None


def test_no_local_folder_on_a_cluster():
    class Session:
        sparkContext = FakeContext()

    with pytest.raises(RuntimeError):
        runtime.checkpoint_dir(Session())


def test_checkpoints_go_when_out_of_use(spark):
    folder = runtime.checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/rdd-*"))
    df = runtime.cut(spark.range(1000))
    mine = set(glob.glob(f"{folder}/rdd-*")) - before
    assert mine and df.count() == 1000
    del df
    for _ in range(60):
        runtime.release(spark)
        if not mine & set(glob.glob(f"{folder}/rdd-*")):
            return
        time.sleep(0.25)
    pytest.fail("the checkpoint is still there")


def test_scratch_folders_differ(spark):
    assert runtime.scratch(spark) != runtime.scratch(spark)


def test_session_and_store_by_environment(spark, tmp_path):
    assert runtime.configuration({})["spark.master"] == "local[*]" and "spark.checkpoint.dir" not in runtime.configuration({})
    found = runtime.configuration({"CODEWELL_MASTER": "local[2]", "CODEWELL_CHECKPOINTS": "/shared"}, **{"spark.sql.shuffle.partitions": "7"})
    assert (found["spark.master"], found["spark.checkpoint.dir"], found["spark.sql.shuffle.partitions"]) == ("local[2]", "/shared", "7")
    spark.range(3).write.parquet(str(tmp_path / "things.parquet"))
    assert runtime.stored(spark, "things", {"CODEWELL_DATA": str(tmp_path)}).count() == 3
