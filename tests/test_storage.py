import glob

import pytest

from credsieve import storage


def test_steps_are_deleted_when_dropped(spark):
    steps = storage.Steps(spark)
    before = spark.conf.get(storage._CLEANUP, "false")
    one = steps.write(spark.range(100).repartition(3))
    two = steps.write(one.selectExpr("id + 1 AS id"))
    place = f"{storage.work_folder(spark).removeprefix('file:')}/{steps.database}"
    assert two.count() == 100 and len(glob.glob(f"{place}/*")) == 2
    steps.drop(one)
    assert two.count() == 100 and len(glob.glob(f"{place}/*")) == 1
    steps.drop(two, two)
    assert glob.glob(f"{place}/*") == []
    assert spark.conf.get(storage._CLEANUP, "false") == before


def test_a_failed_step_restores_the_setting(spark):
    steps = storage.Steps(spark)
    before = spark.conf.get(storage._CLEANUP, "false")
    with pytest.raises(Exception):
        steps.write(spark.range(1).selectExpr("raise_error('no') AS x"))
    assert spark.conf.get(storage._CLEANUP, "false") == before


def test_clear_deletes_what_was_written(spark):
    steps = storage.Steps(spark)
    steps.write(spark.range(3))
    assert storage.cut_lineage(spark.range(5)).count() == 5
    folder = storage.lineage_folder(spark).removeprefix("file:")
    assert glob.glob(f"{folder}/*")
    storage.clear(spark)
    assert not glob.glob(folder) and not spark.catalog.databaseExists(steps.database)
    # and the application goes on
    assert storage.cut_lineage(spark.range(5)).count() == 5
    storage.clear(spark)
