import os

import pytest

from eventloom.llm import common


def test_written_tables(spark):
    first, second = (common.written(spark.range(5), name) for name in ("first", "second"))
    assert first.count() == 5 and first.dtypes == spark.range(5).dtypes
    place = first._written_at.removeprefix("file://")
    assert place.startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) and os.path.isdir(place)
    common.dropped(first)
    assert not os.path.exists(place) and second.count() == 5
    common.clear_shared(spark)
    assert not os.path.exists(second._written_at.removeprefix("file://"))


def test_small_sides_are_counted(spark):
    plan = lambda rows: spark.range(9).join(common.small_side(spark.range(5), rows), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(5) and "broadcast" not in plan(4)


def test_small_sides_are_weighed(spark):
    rows = spark.createDataFrame([(1, "x" * 100, ["a", "bc"], [1, 2, 3]), (2, None, None, None)], "id long, s string, t array<string>, n array<long>")
    assert [r[0] for r in rows.select(common.value_bytes(rows)).collect()] == [8 + 108 + 19 + 32, 8 + 8 + 8 + 8]
    plan = lambda size: rows.join(common.small_side(rows, size=size), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(199) and "broadcast" not in plan(198)


def test_no_local_folder_on_a_cluster():
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session) == common.shared_dir(Session)


def test_input_size(spark, sf):
    assert common.input_bytes(spark.read.parquet(f"{sf}/documents.parquet")) >= os.path.getsize(f"{sf}/documents.parquet") // 2
