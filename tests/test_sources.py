"""Splittable JSON arrays, publication under a version, cached candidates and wide metrics."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from stepjudge.operators import rows as R
from stepjudge.sources import io as IO
from stepjudge.sources.json_arrays import read_json_arrays
from stepjudge.sources.publication import publish, published, read_published

SCHEMA = "problem string, generations array<string>, meta struct<a:int,b:string>"


def examples(n, seed=3):
    rng = random.Random(seed)
    hard = ['\\boxed{4}', '}, {"problem": "no"}', '"', "\\", '\\"}', "é\n{", "[]", "{}", "{{", "}}", "plain"]
    return [{"problem": f"p{i} " + rng.choice(hard), "generations": [rng.choice(hard) for _ in range(rng.randrange(4))], "meta": {"a": i, "b": rng.choice(hard)}} for i in range(n)]


def as_rows(found):
    return sorted((r.problem, tuple(r.generations), r.meta.a, r.meta.b) for r in found)


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_by_many_tasks(spark, tmpdir_path, indent):
    want = examples(400)
    for i, part in enumerate((want[:390], want[390:], [])):
        with open(os.path.join(tmpdir_path, f"run{i}_all_outputs.json"), "w") as f:
            json.dump(part, f, indent=indent)
    with open(os.path.join(tmpdir_path, "other.json"), "w") as f:
        f.write("not read")
    got = read_json_arrays(spark, [tmpdir_path], SCHEMA, "*all_outputs*", split_bytes=4000)
    assert as_rows(got.collect()) == sorted((e["problem"], tuple(e["generations"]), e["meta"]["a"], e["meta"]["b"]) for e in want)
    pieces = spark.read.option("lineSep", "}").text(tmpdir_path)
    assert pieces.rdd.getNumPartitions() >= 1


def test_one_file_is_read_by_many_tasks(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "large.json")
    with open(path, "w") as f:
        json.dump(examples(600), f)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 4
        assert read_json_arrays(spark, [path], SCHEMA).count() == 600
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", [
    '[{"problem": "a"}, {"problem": "b"', '[{"problem": "a"} {"problem": "b"}]', '{"problem": "a"}', '[{"problem": "a"}, oops, {"problem": "b"}]', '[{"problem": "a"},]',
    '[{"problem": "a}]', '[{"problem": 1, "meta": "x"}]',
])
def test_malformed_arrays_fail(spark, tmpdir_path, text):
    path = os.path.join(tmpdir_path, "bad.json")
    with open(path, "w") as f:
        f.write(text)
    with pytest.raises(Exception):
        read_json_arrays(spark, [path], SCHEMA).collect()


def test_of_two_writers_one_publishes(spark, tmpdir_path):
    path, wins = os.path.join(tmpdir_path, "runs"), {}

    def write(who):
        wins[who] = publish(spark.range(50).select(F.lit(who).alias("who"), "id").repartition(3), path, "v1")

    threads = [threading.Thread(target=write, args=(w,)) for w in ("a", "b", "c")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [w for w, won in wins.items() if won]
    got = read_published(spark, path, "v1")
    assert got.count() == 50 and [r.who for r in got.select("who").distinct().collect()] == [winner]
    assert len([d for d in os.listdir(os.path.join(path, "_attempts")) if not d.startswith(".")]) == 1  # the others withdrew
    assert publish(spark.range(1), path, "v1") is False and got.count() == 50


def test_a_write_that_breaks_off_publishes_nothing(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "runs")
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception):
        publish(bad, path, "v1")
    assert not published(spark, path, "v1")
    with pytest.raises(FileNotFoundError):
        read_published(spark, path, "v1")
    # an attempt without a manifest, as a killed writer leaves it, is never read
    spark.range(5).write.parquet(os.path.join(path, "_attempts", "v1-dead", "data"))
    assert IO.write_if_absent(spark.range(3), path, "v1") is True and read_published(spark, path, "v1").count() == 3


def test_readers_follow_the_manifest(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    assert IO.materialize(spark.range(7), path).count() == 7
    assert IO.materialize(spark.range(9), path).count() == 7  # the first load stays
    (attempt,) = [d for d in os.listdir(os.path.join(path, "_attempts")) if not d.startswith(".")]
    data = os.path.join(path, "_attempts", attempt, "data")
    spark.range(4).write.mode("append").parquet(data)  # not in the manifest
    assert read_published(spark, path, "table").count() == 7
    with open(os.path.join(path, "_published", "table.json")) as f:
        name = json.load(f)["files"][0][0]
    with open(name.replace("file:", ""), "ab") as f:
        f.write(b"x")
    with pytest.raises(OSError):
        read_published(spark, path, "table")


def test_candidates_without_a_list_are_too_few(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "c.jsonl")
    with open(path, "w") as f:
        f.write(json.dumps({"problem": "p", "completions": ["a", "b"], "completion_tokens": [1, 2]}) + "\n" + json.dumps({"problem": "q", "completions": None}) + "\n")
    with pytest.raises(ValueError):
        IO.read_cached_candidates(spark, path, 1)
    with open(path, "w") as f:
        f.write(json.dumps({"problem": "p", "completions": ["a", "b"], "completion_tokens": [1]}) + "\n")
    with pytest.raises(ValueError):
        IO.read_cached_candidates(spark, path, 2)
    df = spark.createDataFrame([(1, ["a"], [1]), (2, None, [1]), (3, None, None), (4, [], [])], "k int, a array<string>, b array<int>")
    assert sorted(r.k for r in R.check(df, "same_length", cols=["a", "b"]).collect()) == [2, 3]


def test_metrics_records_need_one_row_per_n(spark, tmpdir_path, monkeypatch):
    out = os.path.join(tmpdir_path, "m")
    with pytest.raises(ValueError):
        IO.write_metrics(spark.createDataFrame([(1, 0.5), (1, 0.6)], "n int, acc double"), out)
    monkeypatch.setattr(IO, "METRIC_ROWS", 3)
    with pytest.raises(ValueError):
        IO.write_metrics(spark.range(4).select(F.col("id").alias("n"), F.lit(0.1).alias("acc")), out)
