"""Toxicity, personal data, nearest neighbours, language model, Jaccard join: brute force, and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stepjudge.llm import hamming, jaccard, maxent, private, queries, toxicity
from stepjudge.llm.components import components

from .conftest import ODD

SMALL = "/root/testdata/sf0.001"


# --- toxicity


def slow_kernel(a, b):
    def weights(w):
        out = Counter()
        x = toxicity._encoded(w)
        for at in combinations(range(len(x)), 3):
            out[tuple(x[list(at)])] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q[u] for u, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)), dot(x, x)


def test_string_kernel_against_the_definition():
    words = ["idiot", "idxiot", "aaaa", "a", "clown", "réeuxê"]
    got = toxicity.kernel(words, toxicity.Landmarks.of(["idiot", "clown", "aab"]))
    for i, w in enumerate(words):
        for j, mark in enumerate(["idiot", "clown", "aab"]):
            assert got[i, j] == pytest.approx(slow_kernel(w, mark)[0], abs=1e-4)
        x = toxicity._encoded(w)[None, :]
        assert toxicity.self_kernel(x)[0] == pytest.approx(slow_kernel(w, w)[1], rel=1e-4)
    assert got[1, 0] > 2 * got[4, 0]


def test_toxic_words_with_gaps_and_insertions(make, spark):
    rng = np.random.default_rng(1)
    common = ["".join(rng.choice(list("abcdefghilmnorstu"), int(rng.integers(2, 9)))) for _ in range(300)]
    insults = ["grumblat", "snorkface", "wettlepig"]
    text = lambda bad: " ".join([*rng.choice(common, 40), *(rng.choice(insults, 2) if bad else [])])
    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    machine = toxicity.train(make(rows), labels)
    more = ["g.r.u.m.b.l.a.t", "snork-face", "w e t t l e p i g", "GRUMBxLAT", "wettllepig!"]
    docs = make(rows + [(1000 + i, f"{text(False)} {w} {text(False)}") for i, w in enumerate(more)])
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", toxicity.score("text", machine).alias("p")).collect()}
    held = range(300, 400)
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.97
    assert all(got[1000 + i] > 0.5 for i in range(len(more)))


def test_toxicity_on_odd_rows(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    one = spark.createDataFrame([(1, 1), (4, 1), (4, 0)], "doc_id bigint, toxic int")
    two = spark.createDataFrame([(1, 1), (8, 0), (10, 0)], "doc_id bigint, toxic int")
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        for labels in (none, one, two):
            got = docs.select(toxicity.score("text", toxicity.train(docs, labels)).alias("p")).collect()
            assert len(got) == n and all(0 <= r["p"] <= 1 for r in got)


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def strict(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        odd = [int(c) for c in d[::-1]]
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if strict(k, m.group(0)))


def check_private(rows, got):
    assert len(got) == len(rows)
    want = Counter()
    for k, t in rows:
        base = base_spans(t)
        want[(k, hashlib.sha256(",".join(s for _, _, s in base).encode()).hexdigest(), *[sum(b[1] == i for b in base) for i in range(4)])] += 1
    assert Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    for r in got:
        marks = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
        assert marks == sorted(marks, key=lambda m: m[0]) and len(marks) == r["n_added"] + sum(r[f"n_{k}"] for k in private.KINDS)


def test_base_spans_against_plain_patterns(make):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("0123456789+-(). a@é\U0001f600"), int(rng.integers(0, 120))))) for i in range(500)]
    rows += [(1000 + i, "".join(rng.choice(list("ab@.-%c +"), 60))) for i in range(200)]
    rows += [(2000, "a@b@c.d.e%f@g.h 4111-1111 1111 1111. 1.2.3.4.5 000255.1.1.1 256.1.1.1 +1 (017) 555-7713")]
    check_private(rows, private.find(make(rows)).collect())


def test_candidates_like_base_spans_are_added_and_redacted(make):
    rows = [(i, f"call now +1 (0{i % 90 + 10}) 555-77{i % 90 + 10} or write me{i}@mail.example.com, pages 12 of 2024 and item 77-12") for i in range(60)]
    rows += [(100, "call now (017) 555-7713 please"), (101, "nothing here, room 12")]
    got = {r["doc_id"]: r for r in private.find(make(rows)).collect()}
    assert got[100]["spans"].startswith("phone:") and got[100]["n_added"] == 1 and got[101]["spans"] == ""
    docs = make(rows)
    out = {r["doc_id"]: r["text"] for r in private.redact(docs).collect()}
    assert out[101] == "nothing here, room 12" and "[PHONE]" in out[100] and "555" not in out[100]
    assert out[3] == "call now [PHONE] or write [EMAIL], pages 12 of 2024 and item 77-12"
    assert private.redact(docs).columns == docs.columns


def test_numbers_behind_other_numbers_are_added(make):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881"]
    rows = [(i, f"call now +1 (0{i % 90 + 10}) 555-77{i % 90 + 10}, card {cards[i % 3]}, host 10.0.{i}.1 since 2024{i % 9 + 101:04d} and room {i}") for i in range(60)]
    rows += [(100, "card 20240131 4111 1111 1111 1111, host"), (101, "call 10.0.0.1 555-7713, card"), (102, "card 4111 1111 1111 1111 017 555-7713, host")]
    got = {r["doc_id"]: r for r in private.find(make(rows)).collect()}
    at = lambda k, kind, m: f"{kind}:{dict(rows)[k].index(m)}:{dict(rows)[k].index(m) + len(m)}"
    assert got[100]["spans"] == at(100, "card", cards[0])
    assert got[101]["spans"] == at(101, "ip", "10.0.0.1") + "," + at(101, "phone", "555-7713") and got[101]["n_added"] == 1
    assert got[102]["spans"] == at(102, "card", cards[0]) + "," + at(102, "phone", "017 555-7713")
    assert all(got[i]["n_added"] == 0 and got[i]["n_card"] == got[i]["n_ip"] == got[i]["n_phone"] == 1 for i in range(60))


def test_every_sequence_of_groups_is_proposed(make):
    text = "x +12 (34) 567.8-90 1234 5678 9012 3456-7 1.2.3.4.5"
    want = set()
    groups = [m.span() for m in re.finditer("[0-9]+", text)]
    for i, (a, _) in enumerate(groups):
        for _, b in groups[i:]:
            m, n = text[a:b], len(re.sub("[^0-9]", "", text[a:b]))
            if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", m):
                want.add((1, a, b))
            if re.fullmatch("[0-9]+([ -][0-9]+)*", m) and 12 <= n <= 19:
                want.add((2, a, b))
            if text[a - 1] == "+" and 9 <= n <= 15:
                want.add((3, a - 1, b))
            if text[a - 1] != "+" and re.fullmatch(r"[0-9]+((\) ?|[ .-])\(?[0-9]+)+", m) and 7 <= n <= 15:
                want.add((3, a, b))
    got = private.candidates(make([(1, text)])).collect()
    assert {(r["kind"], r["start"], r["end"]) for r in got} >= want and len(want) > 20


def test_private_on_odd_rows(odd, empty):
    check_private([(r[0], r[1]) for r in ODD], private.find(odd).collect())
    assert private.redact(odd).count() == len(ODD) and private.find(empty).count() == 0 and private.redact(empty).count() == 0


# --- nearest neighbours


def brute(x, ids, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 24))
    codes = hamming.learn(x[:300])
    own = codes.encode(x)
    q, r = hamming.Index(own).within(own[:40], codes.radius)
    apart = np.bitwise_count(own[:40, None, :] ^ own[None]).sum(axis=2, dtype=int)
    assert set(zip(q.tolist(), r.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(apart <= codes.radius)), strict=True))


def test_recall_and_scores_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), dtype=np.float64), rows["vec_id"].to_numpy()
    got = {}
    for r in hamming.nearest(spark.createDataFrame(rows), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(x, ids)
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 11)) for g in got.values())
    found = np.mean([len({v for v, _ in g.values()} & {v for v, _ in want[q]}) / 10 for q, g in got.items()])
    assert found >= 0.95
    for q, g in got.items():
        far = [g[i][1] for i in range(1, 11)]
        assert far == sorted(far)
        for v, s in g.values():
            assert s == pytest.approx(np.linalg.norm(x[ids == v][0] - x[ids == q][0]), abs=1e-9)


def test_vectors_that_take_no_part_ties_and_small_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 1.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1),
            (9, [float("inf"), 1.0], 1), (10, [1.0], 1), (None, [1.0, 1.0], 1), (200, None, 1), (4, [0.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in hamming.nearest(table, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 3, 0.0), (0, 2, 100, 0.0), (0, 3, 4, 1.414214), (100, 1, 0, 0.0), (100, 2, 3, 0.0), (100, 3, 4, 1.414214)]
    assert hamming.nearest(table.where("false"), F.lit(True)).count() == 0
    assert hamming.nearest(table.where("vec_id = 4"), F.lit(True)).count() == 0


# --- language model


def test_counts_and_base_score_against_brute_force(make):
    rng = np.random.default_rng(1)
    words = ["Alpha", "beta", "ÉÈ", "x\xa0y", "gamma"] + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(150)] + [(r[0], r[1]) for r in ODD]
    docs = make(rows)
    trained = [t for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 7 != 2]
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group(0).lower(), t or "")) + [""]
    c = Counter(w for t in trained for w in low(t))
    n, v = sum(c.values()), len(c)
    from stepjudge.llm.common import held_out, learnable

    counts = maxent.checkpoint(maxent.token_counts(docs.where(learnable("doc_id", 7, 2))))
    for head in (5, 1 << 17):  # nearly all words in the tail, and none
        vocab = maxent.vocabulary(counts, head)
        weights = maxent.train(maxent.history_counts(docs.where(learnable("doc_id", 7, 2)), vocab), steps=3)
        got = maxent.score(docs, counts, vocab, weights, held_out("doc_id", 7, 2)).collect()
        assert len(got) == len(rows) and all(r["train_tokens"] == n for r in got)
        want = Counter((k, len(low(t)), sum(w in c for w in low(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t)), 5)) for k, t in rows)
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want


def test_probabilities_sum_to_one(make):
    rows = [(i, "a b c d " * (1 + i % 3) + f"w{i % 5} zz{i % 9}") for i in range(60)]
    docs = make(rows)
    counts = maxent.checkpoint(maxent.token_counts(docs))
    vocab = maxent.vocabulary(counts)
    weights = maxent.train(maxent.history_counts(docs, vocab))
    table = np.exp(maxent.log_softmax(weights, np.arange(maxent.SYMBOLS**2)))
    assert np.allclose(table.sum(axis=1), 1)
    inside = np.zeros(maxent.CLASSES)
    np.add.at(inside, vocab.cls, 10**vocab.inside)
    seen = np.unique(vocab.cls[maxent.SINGLES :]) if len(vocab.cls) > maxent.SINGLES else []
    single = min(maxent.SINGLES, len(vocab.cls))
    assert np.allclose(inside[:single], 1) and all(inside[k] + 10 ** -vocab.total[k] == pytest.approx(1) for k in seen)


def test_gradient_steps_follow_the_likelihood(make):
    rows = [(i, " ".join("abcd"[(i + j) % 4] for j in range(40))) for i in range(30)]
    docs = make(rows)
    vocab = maxent.vocabulary(maxent.checkpoint(maxent.token_counts(docs)))
    n = maxent.history_counts(docs, vocab)
    found = n.toPandas()

    def likelihood(steps):
        table = maxent.log_softmax(maxent.train(n, steps), found["history"].to_numpy(dtype=np.int64))
        return (found["n"].to_numpy() * table[np.arange(len(found)), found["cls"]]).sum()

    values = [likelihood(k) for k in (1, 3, 6)]
    assert values == sorted(values)


def test_model_beats_the_base_on_held_out_documents(spark):
    got = queries.QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_language_model_on_empty_tables(odd, empty):
    none = odd.where("false")
    got = maxent.score_documents(odd, none, F.lit(False)).collect()
    assert len(got) == len(ODD) and all(r["n_known"] == 0 and r["base_score"] == 0 and r["score"] <= 0 for r in got)
    assert maxent.score_documents(empty, odd, F.lit(False)).count() == 0


# --- Jaccard join


def slow_classes(rows):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = [(k, t or "") for k, t in rows if k is not None]
    texts = sorted({t for _, t in rows})
    rep = {t: min(k for k, u in rows if u == t) for t in texts}
    g = {t: grams(t) for t in texts}
    links = {t: [u for u in texts if u != t and g[t] and len(g[t] & g[u]) / len(g[t] | g[u]) >= 0.8 - 1e-12] for t in texts}
    root = {}
    for t in texts:
        if t in root:
            continue
        todo, seen = [t], {t}
        while todo:
            for u in links[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        for u in seen:
            root[u] = min(rep[x] for x in seen)
    copies = Counter(t for _, t in rows)
    return Counter((k, root[t], copies[t], len(links[t])) for k, t in rows)


def answers(rows):
    return Counter((r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in rows)


def test_classes_and_links_against_brute_force(make):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, int(rng.integers(20, 200))))
        for _ in range(int(rng.integers(1, 6))):
            t = list(base)
            for _ in range(int(rng.integers(0, 5))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(t)))
    base = list(rng.choice(words, 120))  # a group far beyond a block: every text differs in one word of its own
    for i in range(200):
        t = list(base)
        t[i % 120] = f"own{i}"
        rows.append((len(rows), "  ".join(t)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["a b", "a b", "a  b", "a b c d", "", None, " "])] + [(3, rows[3][1]), (3, "another text under id three")]
    got = jaccard.near_duplicates(make(rows))
    assert answers(got.collect()) == slow_classes(rows)
    kept = jaccard.one_of_each(make(rows))
    classes = {c for _, c, _, _ in slow_classes(rows)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*classes, 3]) and kept.columns == make(rows).columns


def test_join_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = Counter(con.execute(f"SELECT doc_id, class_id, n_copies, n_links FROM ({jaccard.SQL})").fetchall())
    assert answers(queries.QUERIES["op8_jaccard_join"](spark, SMALL).collect()) == want


def test_pruning_keeps_what_may_reach_the_threshold():
    for total, least in jaccard._LEAST:
        tail = lambda s: sum(math.comb(total + 1, i) * 0.8**i * 0.2 ** (total + 1 - i) for i in range(s + 1))
        assert tail(least) >= jaccard.TOLERANCE and (least == 0 or tail(least - 1) < jaccard.TOLERANCE)
    a = np.zeros((3, 160), dtype=np.uint16)
    b = a.copy()
    b[1, ::6] = 1  # 83 % agree
    b[2, ::2] = 1  # half
    assert jaccard.promising(a, b).tolist() == [True, True, False]


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted((r["v"], r["root"]) for r in got) == sorted(root.items())


def test_join_on_odd_rows(odd, empty):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and answers([r for r in got if r["doc_id"] is not None]) == slow_classes([(r[0], r[1]) for r in ODD])
    kept = [r["doc_id"] for r in jaccard.one_of_each(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [-3, 1, 3, 4, 7, 8, 9, 10, 11] and kept.count(None) == 2
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0
