"""Sources, sinks and the streaming path, on files written to a scratch folder."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from stepjudge.sources import io as IO
from stepjudge import streaming as S


def test_jsonl_round_trip_and_failfast(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c")
    df = spark.createDataFrame([("q", "1", ["a", "b"])], "problem string, answer string, completions array<string>")
    IO.write_jsonl(df, p)
    back = IO.read_jsonl(spark, p, "problem string, answer string, completions array<string>")
    assert back.first().completions == ["a", "b"]
    bad = os.path.join(tmpdir_path, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"problem": "x"}\n{not json\n')
    with pytest.raises(Exception):
        IO.read_jsonl(spark, bad, "problem string").collect()


def test_generation_dirs(spark, tmpdir_path):
    for i in range(2):
        with open(os.path.join(tmpdir_path, f"run{i}_all_outputs.json"), "w") as f:
            json.dump([{"problem": f"p{i}", "prefix": "a\nb", "traj_gt_labels": ["+", "-"], "prompt": "x",
                        "generations": ["g"]}], f)
    with open(os.path.join(tmpdir_path, "other.json"), "w") as f:
        json.dump([{"problem": "skip"}], f)
    df = IO.read_generation_dirs(spark, [tmpdir_path])
    assert sorted(r.problem for r in df.collect()) == ["p0", "p1"]


def test_cached_candidates(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cache.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"problem": "p", "completions": ["a", "b", "c"], "agg_scores": [0.1, 0.2, 0.3]}) + "\n")
    df = IO.read_cached_candidates(spark, p, 2)
    assert df.first().completions == ["a", "b"]
    with pytest.raises(ValueError):
        IO.read_cached_candidates(spark, p, 4)


def test_metrics_and_versions(spark, tmpdir_path):
    m = spark.createDataFrame([(1, 50.0), (2, 60.0)], "n int, acc double")
    out = os.path.join(tmpdir_path, "metrics")
    IO.write_metrics(m, out)
    r = spark.read.json(out).first()
    assert r.n == [1, 2] and r.acc == [50.0, 60.0]
    v = IO.run_version({"n": 4, "approach": "best_of_n"})
    assert v == IO.run_version({"approach": "best_of_n", "n": 4})
    assert IO.write_if_absent(m, os.path.join(tmpdir_path, "runs"), v) is True
    assert IO.write_if_absent(m, os.path.join(tmpdir_path, "runs"), v) is False


def test_stream_grading(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.jsonl"), "w") as f:
        f.write(json.dumps({"problem_id": 1, "idx": 0, "text": "so \\boxed{4}", "gold": "4"}) + "\n")
        f.write(json.dumps({"problem_id": 1, "idx": 1, "text": "The answer is 5.", "gold": "4"}) + "\n")
    out = os.path.join(tmpdir_path, "out")
    q = S.start_grading(S.read_candidate_stream(spark, src), out, name=f"g{int(time.time() * 1000)}")
    q.processAllAvailable()
    q.stop()
    got = {r.idx: r.is_correct for r in spark.read.parquet(out).collect()}
    assert got == {0: True, 1: False}


def test_benchmark_log_and_materialize(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "bench")
    os.makedirs(os.path.join(root, "gsm8k"))
    with open(os.path.join(root, "gsm8k", "test.jsonl"), "w") as f:
        f.write(json.dumps({"question": "q", "answer": "x #### 3"}) + "\n")
    b = IO.read_benchmark(spark, "gsm8k", "test", root)
    assert b.first().answer == "x #### 3"
    cached = IO.materialize(b, os.path.join(tmpdir_path, "cache"))
    assert cached.count() == 1
    log = spark.createDataFrame([("p", 0.5, ["v1", "v2"])], "input string, score double, verifications array<string>")
    out = os.path.join(tmpdir_path, "log")
    IO.write_verification_log(log, out)
    assert spark.read.json(out).first().verifications == ["v1", "v2"]


def test_stream_restart_resumes(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in2")
    os.makedirs(src)
    out = os.path.join(tmpdir_path, "out2")
    name = f"r{int(time.time() * 1000)}"
    with open(os.path.join(src, "a.jsonl"), "w") as f:
        f.write(json.dumps({"problem_id": 1, "idx": 0, "text": "The answer is 3.", "gold": "3"}) + "\n")
    q = S.start_grading(S.read_candidate_stream(spark, src), out, name=name)
    q.processAllAvailable()
    q.stop()
    with open(os.path.join(src, "b.jsonl"), "w") as f:
        f.write(json.dumps({"problem_id": 2, "idx": 0, "text": "\\boxed{5}", "gold": "4"}) + "\n")
    q = S.start_grading(S.read_candidate_stream(spark, src), out, name=name)  # same progress folder
    q.processAllAvailable()
    q.stop()
    got = sorted((r.problem_id, r.is_correct) for r in spark.read.parquet(out).collect())
    assert got == [(1, True), (2, False)]
