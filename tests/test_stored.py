"""Stored tables: broken writes, changed inputs, and two callers at once."""

import os
import shutil
import uuid

from jobloom.plans import stored
from jobloom.session import shared_dir
from tests.conftest import SF_SMALL


def names(spark, folder, name):
    return sorted(r.x for r in spark.read.parquet(f"{folder}/{name}").collect())


def writer(spark, value, log):
    def write(folder, own):
        log.append(own)
        spark.createDataFrame([(value,)], "x int").write.parquet(f"{folder}/{own}")
    return write


def test_a_broken_write_is_made_again(spark):
    folder, log = shared_dir(spark, f"jobloom/test-store-{uuid.uuid4().hex}"), []
    os.makedirs(f"{folder.removeprefix('file:')}/t")                    # half written: no mark
    with open(f"{folder.removeprefix('file:')}/t/part-0.parquet", "w") as f:
        f.write("half")
    stored.published(spark, folder, "t", writer(spark, 1, log))
    assert names(spark, folder, "t") == [1] and len(log) == 1
    stored.published(spark, folder, "t", writer(spark, 2, log))         # whole: not written again
    assert names(spark, folder, "t") == [1] and len(log) == 1


def test_a_write_that_fails_leaves_the_name_free(spark):
    folder, log = shared_dir(spark, f"jobloom/test-store-{uuid.uuid4().hex}"), []

    def dies(at, own):
        writer(spark, 7, log)(at, own)
        raise RuntimeError("lost")
    try:
        stored.published(spark, folder, "t", dies)
    except RuntimeError:
        pass
    stored.published(spark, folder, "t", writer(spark, 8, log))
    assert names(spark, folder, "t") == [8]


def test_the_later_of_two_callers_takes_the_table_of_the_first(spark):
    folder, log = shared_dir(spark, f"jobloom/test-store-{uuid.uuid4().hex}"), []

    def slow(at, own):                      # another caller is done before this one
        stored.published(spark, folder, "t", writer(spark, 1, log))
        writer(spark, 2, log)(at, own)
    stored.published(spark, folder, "t", slow)
    assert names(spark, folder, "t") == [1] and len(log) == 2
    assert [n for n in os.listdir(folder.removeprefix("file:")) if n.startswith("_")] == []


def test_state_follows_files_of_equal_size(spark, tmp_path):
    for t in stored.INPUTS:
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    sf = str(tmp_path)
    before = stored.state(spark, sf)
    assert stored.state(spark, sf) == before
    path = tmp_path / "part.parquet"
    os.utime(path, (1, 1))                  # as long as before, written at another time
    assert stored.state(spark, sf) != before
