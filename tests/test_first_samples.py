from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmill.operators.scoring import score, summarize
from fieldmill.streaming.first_samples import first_samples, least_of_tasks
from fieldmill.streaming.scoring import append_to, drop_resent
from fieldmill.streaming.versions import commit_changes, commits, publish_changes, read_version

SCHEMA = "run_id string, step long, index long, gold string, raw string, arrived timestamp"
START = datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Every task of the state starts a worker; these tables need few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def batches(draw):
    """Answers in four files: indexes with gaps, in any order, some sent again, one gold broken."""
    rows = []
    for run, step, size in (("a", 100, 60), ("a", 200, 9), ("b", 100, 3), ("hot", 100, 400)):
        for place in draw.sample(range(size), size):
            gold = json.dumps({"a": str(place), "b": "x"})
            raw = draw.choice(["no json", gold, json.dumps({"a": str(place)})])
            rows.append((run, step, place * 7 - 20, "broken" if place == 1 else gold, raw))
    draw.shuffle(rows)
    rows += draw.sample(rows, 60)
    rows.append(("a", 100, None, "{}", "{}"))
    return [rows[i::4] for i in range(4)]


def stored(spark, folder, files):
    for number, rows in enumerate(files):
        timed = [(*row, START + timedelta(minutes=10 * number, seconds=i % 60)) for i, row in enumerate(rows)]
        spark.createDataFrame(timed, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def batch_answer(spark, files, n):
    rows = [row for file in files for row in file]
    df = spark.createDataFrame(rows, "run_id string, step long, index long, gold string, raw string")
    once = df.where("index IS NOT NULL").dropDuplicates(["run_id", "step", "index"])
    order = Window.partitionBy("run_id", "step").orderBy("index")
    first = once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    return summarize(score(first), "run_id", "step")


def cells(df):
    names = ["run_id", "step", "n", "n_json_valid", "n_exact_match", "f1_millionths", "field_f1", "json_valid_rate"]
    return sorted(map(tuple, df.select(*names).collect()))


def test_any_order_gives_the_batch_answer(spark, tmp_path):
    files = batches(random.Random(3))
    stream = stored(spark, str(tmp_path / "in"), files)
    place = str(tmp_path / "table")
    publish_changes(first_samples(stream, 5), place, str(tmp_path / "c"), ["run_id", "step"], retain=2).awaitTermination()
    assert cells(read_version(spark, place)) == cells(batch_answer(spark, files, 5))
    assert len(commits(spark, place)) == 2
    # a later, smaller index takes a place; the rest of the table stays as it was
    more = [[("a", 200, -1000, '{"a":"1"}', '{"a":"1"}')]]
    stream = stored(spark, str(tmp_path / "in"), more)
    publish_changes(first_samples(stream, 5), place, str(tmp_path / "c"), ["run_id", "step"], retain=2).awaitTermination()
    assert cells(read_version(spark, place)) == cells(batch_answer(spark, files + more, 5))
    changed = spark.read.parquet(f"{place}/{commits(spark, place)[-1].parts[-1]}")
    assert [(r.run_id, r.step) for r in changed.collect()] == [("a", 200)]


def test_idle_steps_close(spark, tmp_path):
    files = [
        [("a", 1, 5, "{}", "{}"), ("b", 1, 1, "{}", "{}")],
        [("a", 1, 3, "{}", "no")],
        *[[("b", 1, 10 + i, "{}", "{}")] for i in range(4)],
    ]
    stream = stored(spark, str(tmp_path / "in"), files)
    place = str(tmp_path / "table")
    rows = first_samples(stream, 2, arrived="arrived", idle="15 minutes")
    publish_changes(rows, place, str(tmp_path / "c"), ["run_id", "step"]).awaitTermination()
    got = {r.run_id: r for r in read_version(spark, place).collect()}
    assert got["a"].closed and got["a"].n == 2 and got["a"].n_json_valid == 1
    assert got["b"].n == 2


def test_tasks_pass_on_the_least_only(spark):
    rows = spark.range(1000).select(
        F.lit("hot").alias("run_id"), F.lit(1).cast("long").alias("step"), (F.col("id") % 50).alias("index")
    )
    assert least_of_tasks(rows.coalesce(1), 4).count() <= 4 * 1
    with pytest.raises(ValueError):
        first_samples(rows, 0)


def table(spark, *rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_versions(spark, tmp_path):
    place = str(tmp_path)
    assert commits(spark, place) == []
    with pytest.raises(ValueError):
        read_version(spark, place)
    commit_changes(table(spark, (1, "a"), (2, "b")), 0, place, ["k"])
    commit_changes(table(spark, (2, "c")), 1, place, ["k"])
    assert sorted(map(tuple, read_version(spark, place).collect())) == [(1, "a"), (2, "c")]
    # a batch that comes again changes nothing
    commit_changes(table(spark, (2, "other")), 1, place, ["k"])
    assert sorted(map(tuple, read_version(spark, place).collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, read_version(spark, place, 0).collect())) == [(1, "a"), (2, "b")]
    # a part without its record is not read, and written anew by the next attempt
    table(spark, (1, "half")).withColumn("_version", F.lit(2)).write.parquet(f"{place}/parts/{2:012d}")
    assert sorted(map(tuple, read_version(spark, place).collect())) == [(1, "a"), (2, "c")]
    commit_changes(table(spark, (3, "d")), 2, place, ["k"])
    assert sorted(map(tuple, read_version(spark, place).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    # nothing changed: no version
    commit_changes(table(spark, (9, "x")).where("false"), 3, place, ["k"])
    assert [c.version for c in commits(spark, place)] == [0, 1, 2]


def test_old_versions_go_and_parts_merge(spark, tmp_path):
    place = str(tmp_path)
    for version in range(7):
        commit_changes(table(spark, (version % 3, f"v{version}")), version, place, ["k"], retain=2, most_parts=3)
        want = {k: f"v{v}" for v in range(version + 1) for k in [v % 3]}
        assert {r.k: r.v for r in read_version(spark, place).collect()} == want
    assert [c.version for c in commits(spark, place)] == [5, 6]
    named = {part for c in commits(spark, place) for part in c.parts}
    assert {f"parts/{p.name}" for p in (tmp_path / "parts").iterdir() if not p.name.startswith(".")} == named


def test_resent_rows_across_triggers(spark, tmp_path):
    """A row sent again within the delay counts once, whichever trigger it comes in."""
    rows = [("r", 1, i, "{}", "{}") for i in range(6)]
    stream = stored(spark, str(tmp_path / "in"), [rows, rows[:3], rows[2:]])
    append_to(drop_resent(stream, "arrived", "1 hour"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r["index"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(6))
