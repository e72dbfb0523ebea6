"""The packed sink of cut scripts: files a task, commits, retries, odd scripts."""

import os

import pytest
from pyspark.sql import functions as F

from cutplan.sources import packed


def scripts(spark, n, parts=4, tag="s"):
    text = F.concat(F.lit(f"{tag}é\n;"), F.repeat(F.lit("[v0]"), (F.col("id") % 5).cast("int")))
    return spark.range(0, n, 1, parts).select(F.col("id").alias("video_id"), text.alias("script"))


def pairs(df):
    return sorted((r.video_id, r.script) for r in df.collect())


def test_many_videos_in_a_part_a_task(spark, tmp_path):
    path, rows = str(tmp_path / "s"), scripts(spark, 100_000)
    packed.write_scripts(rows, path)
    assert len([f for f in os.listdir(path) if f.endswith(".txt")]) == 4 and len(os.listdir(path)) == 9
    got = packed.read_scripts(spark, path)
    assert got.exceptAll(rows).isEmpty() and got.count() == 100_000


def test_append_overwrite_and_parts_without_commit(spark, tmp_path):
    path = str(tmp_path / "s")
    packed.write_scripts(scripts(spark, 10), path)
    packed.write_scripts(scripts(spark, 3, 2, "t"), path)
    assert pairs(packed.read_scripts(spark, path)) == sorted(pairs(scripts(spark, 10)) + pairs(scripts(spark, 3, 2, "t")))
    # a part of a task that was tried twice: no manifest names it
    (tmp_path / "s" / "part-0.txt").write_text("lost")
    packed.write_scripts(scripts(spark, 2, 1, "u"), path, "overwrite")
    assert pairs(packed.read_scripts(spark, path)) == pairs(scripts(spark, 2, 1, "u"))
    assert sorted(f.split(".")[-1] for f in os.listdir(path)) == ["index", "json", "txt", "txt"]


def test_a_failed_job_leaves_what_was_committed(spark, tmp_path):
    path = str(tmp_path / "s")
    packed.write_scripts(scripts(spark, 5), path)
    bad = scripts(spark, 8).withColumn("script", F.when(F.col("video_id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("script")))
    with pytest.raises(Exception, match="broken"):
        packed.write_scripts(bad, path, "overwrite")
    assert pairs(packed.read_scripts(spark, path)) == pairs(scripts(spark, 5))


def test_empty_null_long_and_repeated(spark, tmp_path):
    odd = spark.createDataFrame([(1, None), (None, "a"), (2, ""), (2, ""), (3, "中" * 2_000_000)], packed.SCHEMA)
    packed.write_scripts(odd.withColumn("more", F.lit(1)), str(tmp_path / "odd"))
    key = lambda r: (str(r.video_id), str(r.script))
    assert sorted(packed.read_scripts(spark, str(tmp_path / "odd")).collect(), key=key) == sorted(odd.collect(), key=key)
    packed.write_scripts(odd.limit(0), str(tmp_path / "none"))
    assert packed.read_scripts(spark, str(tmp_path / "none")).collect() == []
