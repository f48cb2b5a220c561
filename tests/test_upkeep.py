"""The chunk table that follows a stream of pages."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import upkeep

SCHEMA = "url string, content string, version long"


def words(c):
    return F.filter(F.split(c, " "), lambda w: w != "")


def state(spark, path):
    return {(r["url"], r["chunk_index"]): (r["chunk"], r["version"]) for r in upkeep.chunk_rows(spark, path).collect()}


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_only_changed_pages_and_their_ranges_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    pages = [(f"u{i}", f"a{i} b{i}", 1) for i in range(40)] + [("empty", "", 1), ("none", None, 1), (None, "x", 1)]
    absorb = lambda rows, split=words: upkeep.absorb(spark.createDataFrame(rows, SCHEMA), path, split, 8)
    assert absorb(pages) == 42 and len(state(spark, path)) == 80
    before = files(path)
    assert absorb(pages) == 0 and absorb(pages[:3] * 2) == 0 and files(path) == before  # again, and copies
    assert absorb([("u3", "new", 2), ("u3", "older", 1), ("u4", "stale", 0), ("u5", "a5 b5", 9)]) == 1
    now = state(spark, path)
    assert now[("u3", 0)] == ("new", 2) and ("u3", 1) not in now and now[("u4", 0)] == ("a4", 1) and now[("u5", 1)] == ("b5", 1) and len(now) == 79
    same = [p for p in files(path) if before.get(p) == files(path)[p]]
    assert len({p.parent for p in same}) == len({p.parent for p in before}) - 1  # one range has new files
    assert absorb([("u3", "", 3)]) == 1 and len(state(spark, path)) == 78 and absorb([("u3", "", 3)]) == 0
    assert absorb([]) == 0


def test_a_write_that_fails_leaves_the_old_chunks(spark, tmp_path):
    path = str(tmp_path / "t")
    upkeep.absorb(spark.createDataFrame([("a", "x y", 1), ("b", "z", 1)], SCHEMA), path, words, 4)
    old = state(spark, path)
    broken = lambda c: F.when(F.contains(c, F.lit("bad")), F.array(F.raise_error(F.lit("cannot split")).cast("string"))).otherwise(words(c))
    with pytest.raises(Exception, match="cannot split"):
        upkeep.absorb(spark.createDataFrame([("a", "bad", 2), ("b", "zz", 2)], SCHEMA), path, broken, 4)
    assert state(spark, path) == old
    assert upkeep.absorb(spark.createDataFrame([("a", "good", 2), ("b", "zz", 2)], SCHEMA), path, words, 4) == 2


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "t")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda checkpoint: upkeep.followed(spark.readStream.schema(SCHEMA).parquet(str(source)), path, str(tmp_path / checkpoint), words, 4).awaitTermination()
    put([("a", "x y", 1), ("b", "z", 1)])
    run("c")
    put([("a", "q", 2)])
    run("c")
    now = state(spark, path)
    assert now == {("a", 0): ("q", 2), ("b", 0): ("z", 1)}
    run("other")  # all batches once more
    assert state(spark, path) == now
