"""Filter audit, removal of earlier byte strings, periodic runs: brute force, odd and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest

from stepjudge.llm import audit, periodic, queries, suffixes
from stepjudge.llm.common import table

from .conftest import ODD

SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id bigint, quality int, toxic int"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# ------------------------------------------------------------------------------ filter audit


def slow_audit(docs, labels):
    good, toxic = ({k for k, q, t in labels if (q, t)[i] == 1 and k is not None} for i in (0, 1))
    first = {}
    for k, text, _ in docs:
        if k is not None:
            first[text or ""] = min(first.get(text or "", k), k)
    rows = []
    for k, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and first[t] < k}
        rows.append((source or "", {f for f in fails if fails[f]}, k in good, k in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                failing = sum(f in r[1] for r in mine)
                alive = [r for r in alive if f not in r[1]]
                removed_by[f] += len(gone)
                out[part, order, step] = [f, len(alive), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[v[0]])
    return {(*k, *v) for k, v in out.items()}


def audited(docs, labels):
    names = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {tuple(r[c] for c in names) for r in audit.audit(docs, labels).collect()}


def test_audit_against_brute_force(spark, make):
    rng = random.Random(4)
    words = ["the", "Ship", "north", "x$", "AND", "a|b", "and", "of", "sea"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([2, 9, 309])]) for _ in range(rng.choice([0, 3, 199, 200, 260]))) for _ in range(25)]
    rows = [(rng.choice([None, *range(60)]), rng.choice([*texts, None]), "en", rng.choice(["a", "b", "", None])) for _ in range(120)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    got = audited(make(rows), spark.createDataFrame(labels, LABELS))
    assert got == slow_audit([(r[0], r[1], r[3]) for r in rows], labels) and len(got) == 600 * 3


def test_audit_on_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (5, 0, None), (9, None, 1)], LABELS)
    rows = [(r[0], r[1], (*r, "en", "src0")[3]) for r in ODD]
    assert audited(odd, labels) == slow_audit(rows, [tuple(r) for r in labels.collect()])
    assert audited(empty, labels) == set()
    assert len(audited(odd, labels.where("false"))) == 600 * len({r[2] or "" for r in rows})


def test_audit_plan_folds_once_and_uses_no_python(spark):
    out = audit.audit(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 1 and "Python" not in plan and "Join Cross" not in plan


def test_audit_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES["op11_filter_audit"](spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLES["op11_filter_audit"]).fetchall())


# ------------------------------------------------------------------------------ suffix removal


def slow_removal(rows, span):
    first, out = {}, []
    for k, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - span + 1 if k is not None else 0):
            w = raw[i : i + span]
            if first.get(w, k) >= k:
                first[w] = k
    for k, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - span + 1 if k is not None else 0):
            if first[raw[i : i + span]] < k:
                gone[i : i + span] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((k, len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def passages(n, seed):
    rng = random.Random(seed)
    some = ["".join(rng.choice("abé \n") for _ in range(rng.choice([5, 30, 60, 120]))) for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(8)):
            p = rng.choice(some)
            parts.append(p if rng.random() < 0.5 else p[rng.randrange(len(p)) :] if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(80))))
        rows.append((rng.randrange(n) if rng.random() < 0.95 else None, "".join(parts)))
    return rows + [(3, "x" * 200), (5, "x" * 130), (6, "x" * 49), (7, ""), (8, None), (None, None)]


@pytest.mark.parametrize("span, batches, rounds, hot", [(50, 4, 2, 50_000), (20, 5, 2, 5), (50, 1, 1, 1)])
def test_removal_against_brute_force(make, monkeypatch, span, batches, rounds, hot):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20_000)
    rows = passages(120, span + batches)
    got = suffixes.kept(make(rows).repartition(3), span=span, batches=batches, rounds=rounds, hot=hot)
    want = slow_removal(rows, span)
    assert Counter(tuple(map(bytes, r[4:])) + tuple(r[:4]) for r in map(tuple, got.collect())) == Counter((w[4], *w[:4]) for w in want)
    assert sum(w[2] for w in want) > 1000


def test_removal_on_odd_and_empty_tables(odd, empty):
    got = suffixes.report(odd)
    want = slow_removal([r[:2] for r in ODD], 50)
    assert Counter(map(tuple, got.collect())) == Counter((*w[:4], sha(w[4])) for w in want)
    assert suffixes.report(empty).collect() == []
    with pytest.raises(ValueError):
        suffixes.report(odd, span=70)


def test_sampled_suffixes_are_those_of_every_window():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (0, 49, 50, 51, 400, 1000)]
    text, place, gram, data, bound = suffixes.sampled(texts, 50)
    at = defaultdict(set)
    for i, p in zip(text.tolist(), place.tolist(), strict=True):
        at[i].add(p)
    for i, t in enumerate(texts):
        all_grams = suffixes.grams(np.frombuffer(t, dtype=np.uint8), 20)
        for s in range(len(t) - 49):
            assert s + int(np.argmin(all_grams[s : s + 31])) in at[i]
    digests = dict(zip(gram.tolist(), [bytes(data[bound[i] + p : bound[i] + p + 20]) for i, p in zip(text, place, strict=True)], strict=True))
    assert len(set(digests.values())) == len(digests)


def test_levels_merge_geometrically(spark, make):
    family, sizes = suffixes.Family(spark, 2, 50), []
    docs = make(passages(100, 9)).where("doc_id IS NOT NULL AND text IS NOT NULL")
    for b in range(6):
        family.add(docs.where(f"doc_id >= {b * 17} AND doc_id < {b * 17 + 17}").select("doc_id", "text"))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    for _, name in family.levels:
        for row in spark.table(name).where("bucket >= 0").collect():
            gram = np.frombuffer(row["grams"], dtype=np.int64)
            assert (np.sort(gram) == gram).all() and set((gram.view(np.uint64) % np.uint64(2)).tolist()) == {row["bucket"]}
    (big,) = [n for s, n in family.levels if s == 4]
    assert all(len(g) == len(set(g.tolist())) for g in (np.frombuffer(r["grams"], dtype=np.int64) for r in spark.table(big).collect()))
    plan = family.beside(*[n for _, n in family.levels][:1], [n for _, n in family.levels][1:], "full")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    family.close()


# ------------------------------------------------------------------------------ periodic runs


def slow_runs(words):
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, n, out = np.array([ids[w] for w in words], dtype=np.int64), len(words), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            root = x[a : a + q]
            if b - a + q >= max(6, 4 * q) and not any(q % d == 0 and (root == np.tile(root[:d], q // d)).all() for d in range(1, q)):
                out.append((a, b - a + q, q))
    return sorted(out)


def slow_planted(key, words):
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def slow_report(rows, change):
    out = []
    for k, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        words = slow_planted(k, words) if change else words
        runs = slow_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        out.append((k, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def periodic_words(rng):
    out = []
    for _ in range(rng.randrange(5)):
        root = [str(rng.randrange(3)) for _ in range(rng.choice([1, 2, 3, 7, 20]))]
        out += root * rng.randrange(1, 9) + root[: rng.randrange(len(root))] + [str(rng.randrange(40)) for _ in range(rng.randrange(20))]
    return out


@pytest.mark.parametrize("low, core", [(9, 8192), (2, 16), (1, 8), (3, 40)])
def test_fragments_of_tiles_stitch_to_the_runs(monkeypatch, low, core):
    monkeypatch.setattr(periodic, "LOW", low)
    monkeypatch.setattr(periodic, "CORE", core)
    rng = random.Random(low)
    for _ in range(25):
        docs = [periodic_words(rng) for _ in range(10)]
        names = {w: i for i, w in enumerate({w for d in docs for w in d})}
        for words, found in zip(docs, periodic.fragments([np.array([names[w] for w in d], dtype=np.int64) for d in docs]), strict=True):
            merged = []
            for q, a, b in sorted(found):
                if merged and merged[-1][0] == q and a <= merged[-1][2]:
                    merged[-1][2] = max(merged[-1][2], b)
                else:
                    merged.append([q, a, b])
            assert sorted((a, b - a + q, q) for q, a, b in merged if b - a + q >= max(6, 4 * q)) == slow_runs(words)


def test_long_documents_are_stitched_across_tiles(make):
    rng = random.Random(8)
    root = [str(rng.randrange(9)) for _ in range(700)]
    rows = [(1, " ".join(root * 40)), (2, "same " * 30000), (3, " ".join([str(i) for i in range(9000)] + root * 5 + ["end"] * 7)), (4, " ".join(["a", "b"] * 9000 + root * 6))]
    assert Counter(map(tuple, periodic.report(make(rows)).collect())) == Counter(slow_report(rows, False))


def test_report_on_odd_and_empty_tables(odd, empty):
    rows = [r[:2] for r in ODD]
    for change in (None, periodic.planted):
        assert Counter(map(tuple, periodic.report(odd, change=change).collect())) == Counter(slow_report(rows, change))
    assert periodic.report(empty).collect() == [] and periodic.periodic_runs(empty).collect() == []
    assert periodic.periodic_runs(odd).where("doc_id = 8").select("start", "length", "period").first() == (0, 20000, 1)


def test_periodic_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert Counter(map(tuple, queries.QUERIES["op13_periodic_runs"](spark, SMALL).collect())) == Counter(slow_report(rows, True))


def test_suffix_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    want = Counter((*w[:4], sha(w[4])) for w in slow_removal(rows, 50))
    assert Counter(map(tuple, queries.QUERIES["op12_suffix_dedup"](spark, SMALL).collect())) == want
