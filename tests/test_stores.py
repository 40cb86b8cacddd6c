"""Prepared entries and streamed statistics that survive a stop between write and commit."""

import pytest
from pyspark.sql import functions as F

from rasterforest import streaming, tables
from rasterforest.operators import attributes, entries, stats, trees
from rasterforest.streaming import committed, read_stats, stream_stats

PIXELS = "image_id string, channel int, row int, col int, pixel_id long, value int"


@pytest.fixture(scope="module")
def pixels(spark):
    images = {"a": [1, 2, 2, 5], "b": [1, 2, 2, 5], "c": [4, 4, 4, 4], "d": [3, 1, 2, 1]}
    return spark.createDataFrame([(k, 0, i // 2, i % 2, i, v) for k, vs in images.items() for i, v in enumerate(vs)], PIXELS).cache()


def stop_at(monkeypatch, nth, folder):
    """publish() fails at its nth call for a folder of that name."""
    real, calls = tables.publish, []

    def publish(spark, path, name):
        if path.endswith(folder):
            calls.append(name)
            if len(calls) == nth:
                raise OSError("stopped")
        real(spark, path, name)

    monkeypatch.setattr(tables, "publish", publish)


def test_entries_are_built_once_and_resumed(spark, pixels, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    run = lambda names=("AREA",), **o: entries.prepare_entries(pixels, ["max", "min"], list(names), path, per_block=2, **o)
    stop_at(monkeypatch, 2, "commits")
    with pytest.raises(OSError):
        run()
    monkeypatch.undo()
    assert entries.read_store(spark, path, "summaries").select("entry_key").distinct().count() == 2
    second = tables.settle(run(), "second")
    assert second.count() == 8 and second.where("built").select("entry_key").distinct().count() == 4
    assert second.select("entry_key").distinct().count() == 6  # a and b are equal
    third = run()
    assert third.where("built").count() == 0
    with pytest.raises(ValueError, match="contract"):
        run(radius=1.0)
    with pytest.raises(ValueError, match="contract"):
        run(names=("AREA", "VOLUME"))
    with pytest.raises(ValueError, match="differ"):
        entries.prepare_entries(pixels, ["max", "max"], ["AREA"], path)
    want = stats.merge_stats(*[stats.fit_stats(attributes.compute(make(pixels), ["AREA"]), ["AREA"], key) for key, make in (("max", trees.max_tree), ("min", trees.min_tree))])
    columns = ["stat_key", *entries.STATS]
    assert {tuple(r) for r in entries.entry_stats(second, path).select(columns).collect()} == {tuple(r) for r in want.select(columns).collect()}


def test_small_rasters_share_a_block(spark, tmp_path):
    path, n = str(tmp_path / "many"), 1500
    many = spark.range(n * 2).selectExpr("concat('i', id div 2) AS image_id", "0 AS channel", "0 AS row", "cast(id % 2 AS int) AS col", "id % 2 AS pixel_id", "cast(id div 2 + id % 2 AS int) AS value")
    made = tables.settle(entries.prepare_entries(many, ["max"], ["AREA"], path), "made")
    assert made.where("built").count() == n and len(tables.published(spark, f"{path}/commits")) == 1
    assert entries.read_store(spark, path, "summaries").count() == n


def test_streamed_statistics_replace_each_other_whole(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(2.0,), (5.0,), (3.0,)], "A double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: stream_stats(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["A"], table, checkpoint)
    with pytest.raises(ValueError, match="committed"):
        read_stats(spark, table)
    stop_at(monkeypatch, 2, "commits")
    with pytest.raises(Exception, match="stopped"):
        run().awaitTermination()
    assert read_stats(spark, table).first()["count"] == 1  # the former fit
    monkeypatch.undo()
    run().awaitTermination()
    assert tuple(read_stats(spark, table).first()) == tuple(stats.fit_stats(df, ["A"]).first()) and len(committed(spark, table)) == 2


def test_frozen_statistics(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "stats", "check"))

    def arrive(*values):
        spark.createDataFrame([(v,) for v in values], "A double").write.mode("append").parquet(source)
        streaming.stream_stats(spark.readStream.schema("A double").parquet(source), ["A"], table, checkpoint).awaitTermination()
        return streaming.read_stats(spark, table).first()["sum"]

    assert arrive(1.0, 2.0) == 3.0
    streaming.freeze_stats(spark, table)
    streaming.freeze_stats(spark, table)
    assert arrive(10.0) == 3.0
    streaming.unfreeze_stats(spark, table)
    streaming.unfreeze_stats(spark, table)
    assert arrive(4.0) == 7.0


def test_portions_go_by_rows_not_bytes(spark):
    same = spark.range(1000).selectExpr("cast(id div 10 AS string) AS image_id", "0 AS value").cache()
    dealt = tables.in_portions(same, ["image_id"], rows=100)
    assert dealt.rdd.getNumPartitions() == 10
    assert stats.per_image_normalize(same, ["image_id"]).where("value = 0").count() == 1000
