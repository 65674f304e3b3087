"""SentencePiece, language, fingerprints, substrings, mixing: brute force, and odd tables."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stepjudge.llm import fingerprint, language, mixing, queries, sentencepiece_table, substrings
from stepjudge.llm.chunking import GEAR, WINDOW, Buffer, local, normalised
from stepjudge.llm.common import with_struct

from .conftest import ODD

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def test_sentencepiece_equals_the_library(make, library):
    texts = [r[1] for r in ODD] + ["  a  b\n\nc\tdé▁x  y", " ", "a ", "▁", "▁▁", "<s> </s> <unk> <0x0A>", " a\xa0b　c", "x" * 300]
    docs = make([(i, t) for i, t in enumerate(texts)])
    got = with_struct(docs, ["n_tokens", "ids_sha256", "decoded_sha256"], sentencepiece_table.digests("text", queries.piece_model()), ["doc_id"])
    for r in got.collect():
        ids = library.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_encoded_documents_equal_the_library(odd, library):
    got = sentencepiece_table.encoded(odd, queries.piece_model())
    assert got.columns == [c for c in odd.columns if c != "ids"] + ["ids", "decoded"]
    for r in got.collect():
        ids = library.encode(r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)


def test_sentencepiece_table_starts_anew_when_full(library):
    table = sentencepiece_table.ChunkTable(queries.piece_model(), limit=3)
    for text in ["a b c", "d e f", "a d g"]:
        words = table.words(text)
        table.learn(set(words))
        assert [i for w in words for i in table.ids[w]] == library.encode(text) and len(table.ids) <= 3


def test_language_prediction_and_mixtures(make):
    en, de = "the ship of the north and then others ", "das schiff nach norden und dann andere "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de", "s") for i in range(40)]
    names, logp = language.weights(language.learn(make(rows)))
    docs = make([(1, en), (2, de.upper()), (3, en * 20 + de * 20), (4, "123 !?"), (5, None), (6, ""), (7, "ß")])
    got = {r["doc_id"]: r for r in with_struct(docs, ["lang_pred", "score", "langs"], language.predict("text", names, logp), ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4, 5, 6)] == ["en", "de", "und", "und", "und"]
    assert sorted(got[3]["langs"]) == ["de", "en"] and got[1]["langs"] == ["en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and 0.3 < got[3]["score"] < 0.7


def test_language_trigram_counts_are_the_texts_own():
    bucket, size = language._trigrams(["ab", "", "cde f"])
    alone = [language._trigrams([t]) for t in ("ab", "", "cde f")]
    assert bucket.tolist() == [b for part in alone for b in part[0].tolist()] and size.tolist() == [int(part[1][0]) for part in alone]


def slow_hash(data: bytes) -> list[int]:
    return [sum(int(GEAR[data[i - k]]) << k for k in range(min(WINDOW, i + 1))) % 2**32 for i in range(len(data))]


def test_gear_hash_and_cuts_against_the_definition():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdé \n"), n)) for n in (0, 5, 400, 33, 900)]
    buf = Buffer(texts)
    row, start, end = normalised(buf, 12, 40, 160, 5)
    at, lo, hi = local(buf, 5, 64)
    for i, t in enumerate(texts):
        raw = t.encode()
        h = slow_hash(raw)
        assert buf.hash[buf.start[i] : buf.end[i]].tolist() == h
        cuts, s = [], 0
        while s < len(raw):
            stop = min(s + 160, len(raw))
            for e in range(s + 12, stop):
                if h[e - 1] >> (32 - (6 if e <= s + 40 else 4)) == 0:
                    stop = e
                    break
            cuts.append((s, stop))
            s = stop
        mine = row == i
        assert list(zip(start[mine] - buf.start[i], end[mine] - buf.start[i], strict=True)) == cuts
        own = at == i
        assert b"".join(raw[a:b] for a, b in zip(lo[own] - buf.start[i], hi[own] - buf.start[i], strict=True)) == raw
        for a, b in zip(lo[own] - buf.start[i], hi[own] - buf.start[i], strict=True):
            raw[a:b].decode()  # never inside a code point
    d = buf.digests(start, end)
    pieces = [bytes(buf.bytes[a:b]) for a, b in zip(start, end, strict=True)]
    assert len(set(d.tolist())) == len(set(pieces)) == len(set(zip(d.tolist(), pieces, strict=True)))


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_fingerprints_of_next_documents(make, buckets):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = [(i * 7 - 30, " ".join(rng.choice(words, int(rng.integers(0, 300))))) for i in range(60)] + [(None, "no id"), (5, None)]
    rows = [r for r in rows if r[0] != 5] + [(5, None), (5, "second of five")]
    got = fingerprint.next_pairs(make(rows), buckets=buckets).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    left = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"], r["n_chars"]) for r in got)
    want = []
    for i, (k, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 4
        want.append((k is not None, k or 0, sha(t[: len(t) - cut] + n[:cut]), len(t)))
    assert left == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert np.mean([r["near_edited"] for r in got if r["n_chars"] > 600]) > 0.6


def test_equal_texts_have_equal_fingerprints_and_shifts_keep_most():
    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(500))
    a, b, c, none = fingerprint.chunk_sets([text, text, text[:700] + "inserted " + text[700:], ""])
    assert fingerprint.text_of(a) == fingerprint.text_of(b) and fingerprint.likeness(a, b) == 1
    assert fingerprint.likeness(a, c) > 0.9 and fingerprint.likeness(a, none) == 0 and fingerprint.likeness(none, none) == 1


def test_substring_runs_are_found_and_removed(make):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    own = lambda n: " ".join(word() for _ in range(n))
    passage = own(55)
    docs = make([(1, own(80)), (2, f"{own(60)} {passage} {own(10)}"), (3, f"é{own(31)} {passage}"), (4, own(70)), (5, f"{passage} {own(3)}"), (6, None), (7, "")])
    runs = substrings.repeated_runs(docs)
    got = {r["doc_id"]: r for r in runs.collect()}
    assert set(got) == {2, 3, 5} and all(r["first_doc"] == 2 for r in got.values())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, r in got.items():
        assert text[k][r["start"] : r["end"]] in passage + text[k][text[k].index(passage) + len(passage) :] and r["end"] - r["start"] > 200
        assert r["n_words"] >= 16
    after = {r["doc_id"]: r["text"] for r in substrings.remove_runs(docs, runs).collect()}
    assert [after[k] for k in (1, 2, 4, 6, 7)] == [text[k] for k in (1, 2, 4, 6, 7)]
    for k in (3, 5):
        assert after[k] == text[k][: got[k]["start"]] + text[k][got[k]["end"] :]


def test_a_text_in_many_languages_keeps_them_all(make):
    rng = np.random.default_rng(6)
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "zéèüö"]
    own = lambda x, n: " ".join("".join(rng.choice(list(x), 6)) for _ in range(n))
    names, logp = language.weights(language.learn(make([(i, own(x, 200), f"l{i}", "a") for i, x in enumerate(letters)])))
    docs = make([(10, " ".join(own(x, 60) for x in letters)), (11, " ".join(own(x, 60) for x in letters[:5])), (12, own(letters[2], 60))])
    got = {r["doc_id"]: r["langs"] for r in with_struct(docs, ["lang_pred", "score", "langs"], language.predict("text", names, logp), ["doc_id"]).collect()}
    assert sorted(got[10]) == [f"l{i}" for i in range(6)] and sorted(got[11]) == [f"l{i}" for i in range(5)] and got[12] == ["l2"]


def test_rows_of_one_id_with_different_texts(make):
    rng = np.random.default_rng(3)
    own = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    a, b = own(80), own(80)
    rows = [(1, a), (2, b), (3, f"{own(7)} {a}"), (3, f"{own(9)} {b}"), (3, own(120))]
    docs, apart = make(rows), make([(i + 1, t) for i, (_, t) in enumerate(rows)])  # apart: an id for each text
    spans = lambda runs: sorted((r["start"], r["end"], r["n_words"], r["first_doc"], r["removable"]) for r in runs.where("doc_id > 2").collect())
    runs, want = substrings.repeated_runs(docs), substrings.repeated_runs(apart)
    assert spans(runs) == spans(want) and [r[3] for r in sorted(spans(want), key=lambda r: r[3])] == [1, 2]
    cut = lambda docs, runs: sorted(r["text"] for r in substrings.remove_runs(docs, runs).where("doc_id > 2").collect())
    assert cut(docs, runs) == cut(apart, want) and max(map(len, cut(docs, runs))) == len(rows[-1][1])


def clamp(sizes, weights, times=3.0):
    """Water-filling step by step."""
    total, free, out = sum(sizes), set(range(len(sizes))), {}
    while free:
        level = (total - sum(out.values())) / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * level > times * sizes[i]}
        if not over:
            out |= {i: weights[i] * level for i in free}
            break
        out |= {i: times * sizes[i] for i in over}
        free -= over
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10], [1, 100, 100, 5], [0, 7, 0], [3, 3, 3, 900, 1, 20, 0], [50, 1, 1, 1, 1, 1]])
def test_targets_against_stepwise_clamping(spark, sizes):
    table = spark.createDataFrame([(f"s{i:02d}" if i < len(sizes) - 1 else None, n) for i, n in enumerate(sizes)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    want = clamp(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    for i, t in enumerate(want):
        assert got[f"s{i:02d}" if i < len(sizes) - 1 else None] == pytest.approx(t)


def test_mixture_equals_its_sql_and_reaches_targets(make):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), "en", None if i % 11 == 0 else f"s{i % 7 * (i % 2)}") for i in range(900)] + ODD
    docs = make(rows)
    got = mixing.mixture(docs).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r if len(r) == 4 else (*r, "en", "src0") for r in rows])
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    flat = lambda rows: sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in rows), key=key)
    want = flat(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall())
    assert flat([(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got]) == want
    by = {}
    for r in got:
        t, s, _ = by.get(r["source_size"], (0, 0, 0))
        by[r["source_size"]] = (t + r["taken"], r["target"], 0)
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(t - goal) <= 31 or size > 20000 for size, (t, goal, _) in by.items())
    out = mixing.mixed(docs.where("doc_id >= 0 and doc_id < 900"))
    assert out.columns == docs.columns
    assert out.select(F.sum(mixing.words("text"))).first()[0] == sum(r["taken"] for r in mixing.mixture(docs.where("doc_id >= 0 and doc_id < 900")).collect())


def test_mixture_cuts_within_one_id_and_text(make):
    """A third of a source without ids, another third copies of one row: the cut falls among them."""
    rows = [(None, "w " * (1 + i % 5), "en", "a") for i in range(60)] + [(7, "same words here", "en", "a")] * 60 + [(i, "w " * 4, "en", "a") for i in range(100, 140)]
    rows += [(None, "x " * 9, "en", "b")] * 300 + [(None, None, None, None)] * 5 + [(i, "y " * 50, "en", "c") for i in range(200, 240)]
    docs = make(rows)
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", "c"):
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2
    partly = {r["copies"] for r in got if r["doc_id"] is None and r["source"] == "b"}
    assert len(partly) == 2
    again = mixing.mixture(docs.repartition(5)).collect()
    count = lambda rows: sorted((str(r["doc_id"]), r["source"] or "", r["size"], r["copies"]) for r in rows)
    assert count(got) == count(again)
    out = mixing.mixed(docs)
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.words("text")).alias("n")).collect()}
    assert {s: n for s, n in words.items() if n} == {s: sum(r["taken"] for r in got if r["source"] == s) for s in ("a", "b", "c")}


def test_odd_rows_and_empty_tables(odd, empty):
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        names, logp = language.weights(language.learn(docs))
        assert with_struct(docs, ["lang_pred"], language.predict("text", names, logp), ["doc_id"]).count() == n
        assert fingerprint.next_pairs(docs).count() == n
        assert mixing.mixture(docs).count() == n
        mixing.mixed(docs).collect()
        assert {r["doc_id"] for r in substrings.repeated_runs(docs).collect()} <= {4, 5}
        assert substrings.remove_runs(docs, substrings.repeated_runs(docs)).count() == n
        assert sentencepiece_table.encoded(docs, queries.piece_model()).count() == n
