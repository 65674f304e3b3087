"""The registered queries of this subpackage, with their parameters and, where SQL can express them, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepjudge.llm import audit, fingerprint, hamming, jaccard, language, maxent, mixing, periodic, private, sentencepiece_table, substrings, suffixes, toxicity
from stepjudge.llm.common import held_out, learnable, table, with_struct

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def piece_model() -> str:
    """The public 32k vocabulary file; the operator takes any model file as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels are learned from those whose remainder isn't 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(learnable("doc_id", 3, 1)))
    out = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), toxicity.score("text", machine).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= toxicity.TOXIC).cast("int"))


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 16 words or more that several documents share, one row per document and distinct run."""
    return substrings.repeated_runs(table(spark, sf_dir, "documents")).drop("text_hash").distinct()


@query("op3_private_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data of every document."""
    return private.find(table(spark, sf_dir, "documents"))


@query("op4_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every hundredth."""
    return hamming.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; learned from those whose remainder isn't 2."""
    docs = table(spark, sf_dir, "documents")
    return maxent.score_documents(docs, docs.where(learnable("doc_id", 7, 2)), held_out("doc_id", 7, 2))


@query("op6_mixing", mixing.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("copies", "source")


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.next_pairs(table(spark, sf_dir, "documents"))


@query("op8_jaccard_join", jaccard.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document: five words, a similarity of 0.8."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    fields = ["n_tokens", "ids_sha256", "decoded_sha256"]
    docs = table(spark, sf_dir, "documents")
    return with_struct(docs, fields, sentencepiece_table.digests("text", piece_model()), ["doc_id"])


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; languages are learned from documents whose remainder isn't 2."""
    docs = table(spark, sf_dir, "documents")
    names, logp = language.weights(language.learn(docs.where(learnable("doc_id", 4, 2))))
    fields = ["lang_pred", "score", "langs"]
    out = docs.withColumn("held_out", held_out("doc_id", 4, 2))
    return with_struct(out, fields, language.predict("text", names, logp), ["doc_id", "held_out"])


@query("op11_filter_audit", audit.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order of applying them, per source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_suffix_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    return suffixes.report(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, the greatest one, and what is left without the repeats."""
    return periodic.report(table(spark, sf_dir, "documents"), change=periodic.planted)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of the corpus pipeline, with the digests of what they end in."""
    import corpus_pipeline

    docs = corpus_pipeline.run(spark, sf_dir)
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return docs.select("doc_id", "text", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), ids.alias("ids_sha256"))
