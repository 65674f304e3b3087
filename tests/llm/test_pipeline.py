"""Every stage of the pipeline against a brute-force version of what it does."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from stepjudge.llm import mixing, private, queries, toxicity
from stepjudge.llm.common import learnable, table

from .test_learned_operators import base_spans, slow_classes

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of each stage, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), table(spark, SMALL, "documents"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / str(i))
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "private_data", "mixture", "sentencepiece"]
    for name, before, after in stages:
        assert after.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (after.columns == before.columns) == (name != "sentencepiece")


def test_toxicity_stage(spark, stages):
    _, before, after = stages[0]
    machine = toxicity.train(before, table(spark, SMALL, "labels").where(learnable("doc_id", 3, 1)))
    reader = toxicity.Reader(machine)
    rows = before.collect()
    p = machine.probability(reader.features([r["text"] for r in rows]))
    assert sorted(map(tuple, after.collect())) == sorted(tuple(r) for r, x in zip(rows, p, strict=True) if x < 0.7)


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c, _, _ in slow_classes(rows)})


def test_private_data_stage(stages):
    _, before, after = stages[2]
    found = {r["doc_id"]: r["spans"] for r in private.find(before).collect()}
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        t, at, out = text[r["doc_id"]], 0, []
        marks = [s.split(":") for s in found[r["doc_id"]].split(",") if s]
        assert {m for _, _, m in base_spans(t)} <= {":".join(m) for m in marks}
        for kind, a, b in marks:
            if int(a) >= at:
                out += [t[at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        assert r["text"] == "".join([*out, t[at:]]) and r["n_chars"] == len(r["text"])


def test_mixture_stage(stages):
    _, before, after = stages[3]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(before).collect()}  # ids are unique here
    got = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in copies.items() if n}


def test_sentencepiece_stage(stages):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for r in stages[4][2].collect():
        ids = library.encode(r["text"])
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)


def test_run_writes_every_stage(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(tuple(r[c] for c in ("doc_id", "text")) for r in got.collect()) == sorted((r["doc_id"], r["text"]) for r in stages[4][2].collect())
    assert re.search("corpus-pipeline-", got.inputFiles()[0])


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SMALL).collect()
