"""Runs, whitening and language filters against brute force, with odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintloom.llm import language_id, text_runs, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# runs


def brute_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(s, least, periods):
    out = set()
    for p in range(1, len(s) // periods + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            n = j - i + p
            smaller = any(all(s[x] == s[x + q] for x in range(i, i + n - q)) for q in range(1, p))
            if j > i and n >= max(least, periods * p) and not smaller:
                out.add((i, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def as_rows(found):
    return [tuple(r) for r in found.tolist()]


def test_lyndon_array_and_all_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        s = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(1, 28))]
        assert text_runs.lyndon_array(s) == brute_lyndon(s)
        assert as_rows(text_runs.runs_of(np.array(s), 2, 2)) == brute_runs(s, 2, 2)


def test_long_runs_lie_in_stretches_of_repeated_windows():
    rng = random.Random(2)
    for _ in range(150):
        s = []
        for _ in range(rng.randrange(1, 6)):
            s += [rng.randrange(4) for _ in range(rng.randrange(1, 14))] * rng.randrange(1, 9) + [rng.randrange(90) for _ in range(rng.randrange(12))]
        assert as_rows(text_runs.text_runs(np.array(s))) == brute_runs(s, 24, 3)


def test_many_equal_words_are_linear():
    n = 200_000
    assert as_rows(text_runs.text_runs(np.zeros(n, np.int64))) == [(0, n, 1)]
    assert as_rows(text_runs.text_runs(np.arange(n) % 7)) == [(0, n, 7)]


def brute_row(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 24, 3)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t).hexdigest()
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "a b", "x y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 160))) for _ in range(150)]
    texts += [" ".join([rng.choice(words) for _ in range(p)] * 9) + "\n\ttail " + "u v " * 13 for p in (1, 2, 3, 5, 9)] + [None, "", " \n ", "one", texts[0]]
    rows = [(i, t, "en", "s", 1, "clash", [7]) for i, t in enumerate(texts)] + [(None, "a b " * 20, "en", "s", 1, "clash", [7]), (5, texts[5], "en", "s", 1, "clash", [7])]
    docs = spark.createDataFrame(rows, SCHEMA + ", collapsed string, runs array<int>")
    got = sorted((tuple(r) for r in text_runs.digests(text_runs.find_runs(docs, planted=True)).collect()), key=lambda r: (r[0] is None, r))
    assert got == sorted((brute_row(r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r))
    assert sum(r[1] > 0 for r in got) > 10
    plain = {r.doc_id: r for r in text_runs.find_runs(docs).where("doc_id = 151").collect()}[151]
    assert [tuple(x) for x in plain.runs] == brute_runs((texts[151]).encode().split(), 24, 3) and plain.collapsed.endswith("tail u v")
    assert text_runs.digests(text_runs.find_runs(docs.limit(0))).count() == 0


def test_strongest_run_breaks_ties_by_start_then_period(spark):
    runs = [[(9, 30, 10), (2, 24, 8), (1, 24, 8), (1, 27, 9)], [(0, 24, 1), (30, 25, 1)], []]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "id int, runs array<struct<start:long,length:long,period:long>>")
    got = {r.id: r.b and tuple(r.b) for r in rows.select("id", text_runs.strongest().alias("b")).collect()}
    assert got == {0: (1, 24, 8), 1: (30, 25, 1), 2: None}


# whitening


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_leading_components_match_numpy(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d + 9, d))
    m = a.T @ a
    values, vectors = whitening.leading_components(m, 8)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:8], rtol=1e-13)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
    assert np.abs(m @ vectors.T - vectors.T * values).max() < 1e-12 * values[0]


def test_clusters_of_equal_eigenvalues():
    close = np.concatenate([[1, 1 - 1e-9, 1 - 2e-9, 1 - 1e-4], np.linspace(1e-3, 1e-4, 26)])
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((30, 30)))[0]
    for m in (np.eye(9), np.kron(np.eye(5), [[2.0, 1], [1, 2]]), np.ones((6, 6)), np.diag([5.0, 5, 5, 1, 1, 0, 0, 0]), (q * close) @ q.T, np.zeros((3, 3))):
        m = (m + m.T) / 2
        values, vectors = whitening.leading_components(m, 8)
        want = np.linalg.eigvalsh(m)[::-1][:8]
        want = want[want > 1e-12 * max(want[0], 1e-300)]
        assert np.allclose(values, want, rtol=1e-12, atol=1e-14)
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max(initial=0) < 1e-13
        assert np.abs(m @ vectors.T - vectors.T * values).max(initial=0) < 1e-13 * np.abs(m).max(initial=1)


def brute_whiten(vectors, k=8):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x], centred @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_op12_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    good = (rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32).tolist()
    good[7] = good[8]
    bad = [None, [], [1.0] * 11, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11, [float("inf")] + [0.0] * 11]
    rows = [(i, v, 3, "x") for i, v in enumerate(good + bad)] + [(None, good[0], 3, "x"), (0, good[0], 3, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, x string")
    got = whitening.whiten(table.repartition(5)).collect()
    kept = good + [good[0], good[0]]
    deviation, white, explained = brute_whiten(kept)
    assert len(got) == 8 * len(kept) and {r.n for r in got} == {len(kept)}
    ids = [r[0] for r in rows[:300]]
    for r in got:
        k = ids.index(r.vec_id) if r.vec_id is not None else 0
        assert r.deviation == deviation[k]
        assert abs(abs(r.whitened) - abs(white[k, r.component - 1])) < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10 and r.identity_error < 1e-10
    signs = {(r.component, np.sign(r.whitened * white[ids.index(r.vec_id), r.component - 1])) for r in got if r.vec_id is not None and abs(r.whitened) > 1e-6}
    assert len(signs) == 8  # one sign for each component


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    empty = whitening.whiten(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [1.0, 2.0])], schema)).count() == 0  # one vector has no direction
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], schema))
    assert {r.component for r in flat.collect()} == {1}
    wide = spark.createDataFrame([(i, [1e9 * i, -(2.0**41) * i]) for i in range(2)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(wide).collect()} == {None}
    assert whitening.products(np.array([[2**40, 3], [5, 2**41]])).tolist() == [[2**80 + 25, 3 * 2**40 + 5 * 2**41], [3 * 2**40 + 5 * 2**41, 9 + 2**82]]


# language filters


def made_texts(seed, n):
    rng = random.Random(seed)
    parts = {"aa": "ba be bo lu ma".split(), "bb": "cho ga lu ma ñi".split(), "cc": "zu ße ga be tt".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(3, 40))).title(), lang, "s", 1))
    return rows


def test_grams_are_those_of_marked_words():
    words = ["ab", "x²y", "ñ"]
    keys, owner = language_id.grams_of(words)
    text = lambda k: "".join(" " if c == 0x1FFFFF else chr(c) for c in (k >> 42 & 0x1FFFFF, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) if c)
    got = [sorted(text(int(k)) for k in keys[owner == i]) for i in range(3)]
    assert got == [sorted(["a", "b", " a", "ab", "b ", " ab", "ab "]), sorted(["x", "y", " x", "x ", " y", "y ", " x ", " y "]), sorted(["ñ", " ñ", "ñ ", " ñ "])]


def test_filters_return_all_languages_of_an_ngram(spark):
    docs = spark.createDataFrame(made_texts(1, 400), SCHEMA)
    filters = language_id.learn(docs, min_share=1e-3)
    counts = {}
    for _, text, lang, _, _ in made_texts(1, 400):
        words = language_id.words_of(text)
        keys, _ = language_id.grams_of(words)
        for k in keys.tolist():
            counts.setdefault(lang, {}).setdefault(k, 0)
            counts[lang][k] += 1
    got = {(r.lang, r.gram): r.n for r in language_id.gram_counts(docs).collect()}
    assert got == {(lang, k): n for lang, c in counts.items() for k, n in c.items()}
    length = lambda k: 1 + (k >> 21 > 0) + (k >> 42 > 0)
    everything = sorted({k for c in counts.values() for k in c})
    hits = filters.hits(np.array(everything, np.uint64))
    wrong = 0
    for row, k in zip(hits, everything, strict=True):
        for i, lang in enumerate(filters.languages):
            total = sum(n for g, n in counts[lang].items() if length(g) == length(k))
            member = counts[lang].get(k, 0) >= 1e-3 * total
            assert row[i] or not member  # never misses
            wrong += bool(row[i]) and not member
    assert filters.languages == ["aa", "bb", "cc"] and wrong < 0.02 * len(everything) * 3
    assert np.all(filters.mistakes < 0.01) and len(filters.slots) & (len(filters.slots) - 1) == 0


def test_mistakes_are_taken_out_of_the_score():
    f = language_id.LanguageFilters(["a", "b"], 1, np.zeros((64, 1), np.uint64), np.array([0.5, 0.0]))
    best, score = f.decide(np.array([[6, 5], [5, 0], [10, 10]]), np.array([10, 10, 10]))
    assert best.tolist() == [1, 1, 0] and np.allclose(score, [0.5, 0.0, 1.0])


def test_more_than_64_languages(spark):
    rows = [(i, chr(0x4E00 + i) * 20, f"l{i:03d}", "s", 1) for i in range(70)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language_id.identify(docs, language_id.learn(docs)).collect()
    assert all(r.lang_pred == r.lang and r.score > 0.99 for r in got)


def test_op13_on_held_out_and_odd_rows(spark):
    odd = [(9000, None, "aa", "s", 1), (9001, "", "aa", "s", 1), (9002, " 12 _ ²\n!", "bb", "s", 1), (9003, "babe " * 30000, None, "s", 1), (9004, "Ω", None, "s", 1), (None, "ñicho ñi", None, "s", 1)]
    rows = made_texts(2, 600) + odd
    docs = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], SCHEMA + ", lang_pred string, score double")
    got = language_id.predictions(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows if r[0] is not None)
    held = [r for r in made_texts(2, 600) if by[r[0]].held_out]
    assert len(held) > 100 and np.mean([by[r[0]].lang_pred == r[2] for r in held]) > 0.98
    assert [(by[i].lang_pred, by[i].score) for i in (9000, 9001, 9002)] == [("und", 0.0)] * 3
    assert by[9003].lang_pred == "aa" and by[9004].lang_pred in ("aa", "bb", "cc") and by[9004].score == 0 and by[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    filters = language_id.learn(docs.limit(0))
    assert filters.languages == [] and {r.lang_pred for r in language_id.identify(docs, filters).collect()} == {"und"}
    assert language_id.predictions(docs.limit(0)).count() == 0


def test_predictions_do_not_look_at_labels_of_held_out_rows(spark):
    rows = made_texts(5, 200)
    docs = spark.createDataFrame(rows, SCHEMA)
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    assert sorted(map(tuple, language_id.predictions(docs).collect())) == sorted(map(tuple, language_id.predictions(other).collect()))


# shards


def test_written_shards_keep_null_and_repeated_ids(spark, tmp_path):
    from glintloom.llm import sharding

    rows = [(None, "a"), (None, "a"), (None, "b"), (1, "a"), (1, "a"), (1, "c"), (2, None), (2, ""), (3, "x y")] * 3
    docs = spark.createDataFrame([(i, t, "en", "s" if i != 3 else None, k, "old") for k, (i, t) in enumerate(rows)], SCHEMA + ", slot string")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n_chars for r in out.collect()) == list(range(len(rows)))
    assert sorted((r.shard, r.slot) for r in out.collect()) == sorted((r.shard, r.slot) for r in sharding.assign_shards(docs, 4).collect())
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"), shards=4)
