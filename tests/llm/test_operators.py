"""Small tests of the corpus operators: brute force, edge cases, exact round trips."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from glintloom.llm import decontamination, license_scan, line_dedup, linking, near_duplicates, prefix_counts, quality_rules, secret_scan, sharding, token_automaton, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "


def frame(spark, texts, start=0, source="s"):
    rows = [(start + i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tiny, repeated and very long texts, a null id, and an extra column that clashes with results."""
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two\nthree"), (4, "One two\nthree"), (5, "One two\nthree"), (None, "lost row with some words in it"), (6, LONG * 3000), (7, "x" * 70000), (8, "a\n\n\na\nb")]
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "s", 1, "extra") for i, t in rows], SCHEMA + ", shard string").withColumn("n_tokens", F.lit("clash"))


# linking and near-duplicates


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220)) if a != b] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(60)]
    got = {r.node: r.component for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = set(edges) | {(b, a) for a, b in edges}
    nodes = sorted({n for e in edges for n in e})
    assert got == brute_components(nodes, lambda a, b: (a, b) in ends)


def test_components_of_nothing(spark):
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_is_the_majority_of_xxh64():
    words = "the cat sat on the mat and the cat ran".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert near_duplicates.simhash("The\tcat  SAT on the mat\nand the cat ran ") == want
    assert near_duplicates.simhash("Two words") == xxhash.xxh64_intdigest("two words", 42)
    assert near_duplicates.simhash(None) == near_duplicates.simhash(" \n") == 0
    # only A-Z are lower-cased, only ASCII white space parts words
    assert near_duplicates.simhash("É\u00a0A") == xxhash.xxh64_intdigest("É\u00a0a".encode(), 42)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = []
    for c in centres:
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            prints.append(x)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    nodes = spark.createDataFrame([(s, s) for s in signed], "id long, sig long")
    got = {r.node: r.component for r in linking.bucket_components(near_duplicates.variants(nodes), linking.within(4), refine=near_duplicates.finer_keys).collect()}
    want = brute_components(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)
    assert {n: got.get(n, n) for n in signed} == want


def test_near_duplicates_edges(spark, odd):
    got = [(r.doc_id, r.component_id) for r in near_duplicates.near_duplicate_components(odd).collect()]
    assert len(got) == odd.count()
    found = dict(got)
    assert found[0] == found[1] == found[2] == 0
    assert found[4] == found[5] == 4 and found[3] == 3
    kept = near_duplicates.first_of_groups(odd)
    assert kept.columns == odd.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [-1, 0, 3, 4, 6, 7, 8]
    assert near_duplicates.near_duplicate_components(odd.limit(0)).count() == 0


def test_near_dedup_stage_matches_brute_force_on_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [None, "", "one two", "One  two", "one three"]
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(8, 300))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                words[rng.randrange(len(words))] = "x"
            texts.append(" ".join(words))

    def sets(t):
        words = (t or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    plain = [sets(t) for t in texts]
    share = lambda a, b: len(plain[a] & plain[b]) / len(plain[a] | plain[b])
    want = brute_components(list(range(len(texts))), lambda a, b: share(a, b) >= 0.8)
    near = sum(0.8 <= share(a, b) < 0.9 for a in want for b in want if a < b)
    docs = frame(spark, texts)
    assert {r.doc_id: r.component_id for r in near_duplicates.similar_components(docs).collect()} == want and near > 30
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(want.values()))
    assert near_duplicates.similar_components(docs.limit(0)).count() == 0


# fuzzy lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_similarity_matches_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "é "])
        b = "".join(b)
        distance, most = levenshtein(a, b), int(max(len(a), len(b)) * 0.2 + 1e-9)
        assert line_dedup.edit_distance(a, b) == distance
        assert (line_dedup.edit_distance(a, b, 3) == distance) if distance <= 3 else line_dedup.edit_distance(a, b, 3) > 3
        assert line_dedup._word_bound(a.split(" "), b.split(" "), 1000) >= distance
        assert line_dedup.similar(a, b) == (distance <= most)


def brute_word_hash(word):
    def mix(x):
        x = x + 0x9E3779B97F4A7C15 & (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        return x ^ x >> 31

    if len(word) > 1024:
        word = xxhash.xxh64_hexdigest(word.encode())
    h = sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(word.encode(), 1))
    return mix(mix(h & (1 << 64) - 1) >> 28 << 4 | min(len(word.encode()), 15))


def brute_simhash(words):
    hashes = [brute_word_hash(w) for w in words]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_line_simhash_matches_brute_force():
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(n)) for n in (1, 2, 17, 255, 256, 700, 1500, 9000)] + ["é ü \x07x", "x " + "q" * 3000, "x"]
    for line, got in zip(lines, line_dedup.fingerprinted(lines)[0].tolist(), strict=True):
        words = set(line.split(" "))
        assert got & (1 << 64) - 1 == (brute_simhash(words) if len(words) > 15 else 0)


def test_lines_that_differ_in_fewer_words_than_blocks_share_a_key():
    rng = random.Random(6)
    for n in (4, 9, 15, 24, 40, 70, 130):
        words = [f"word{k:05d}x{rng.randint(0, 999)}" for k in range(n)]
        struck = words[:3] + words[4:]
        swapped = [*words[:-1], "other"]
        keys = [set(k.tolist()) for k in line_dedup.fingerprinted([" ".join(x) for x in (words, struck, swapped)])[1]]
        assert keys[0] & keys[1] and keys[0] & keys[2], n
    one, other = (set(k.tolist()) for k in line_dedup.fingerprinted(["read more", "read mores"])[1])
    assert one & other


def test_lines_without_spaces_share_a_key():
    rng = random.Random(12)
    han = "".join(chr(rng.randrange(0x4E00, 0x6E00)) for _ in range(120))
    token = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100))
    url = "https://example.org/" + "/".join("".join(rng.choices("abcdefgh-", k=9)) for _ in range(8))
    for line in (han, token, url, han + " " + token, token[:40], han * 400):
        for edits in (1, 3):
            other = list(line)
            for k in rng.sample(range(len(line)), edits):
                other[k] = "_"
            other = "".join(other)
            sigs, keys = line_dedup.fingerprinted([line, other])
            assert line_dedup.similar(line, other) and set(keys[0].tolist()) & set(keys[1].tolist()) and not sigs.any(), (line[:30], edits)
    assert not line_dedup.similar(han, han[::-1]) and not line_dedup.similar(token * 9, token[::-1] * 9)
    # pieces bound the distance from above only: the verdict is that of the distance
    for _ in range(60):
        a = "".join(rng.choices("abcde", k=700))
        b = list(a)
        for k in rng.sample(range(700), rng.choice((5, 60, 130, 160, 400))):
            b[k] = rng.choice("abcdefg")
        b = "".join(b)
        assert line_dedup.similar(a, b) == (line_dedup.edit_distance(a, b) <= 140)


def test_unspaced_line_recall_against_edit_similarity_alone(spark):
    rng = random.Random(13)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    base = ["".join(rng.choices(letters, k=rng.randrange(30, 200))) for _ in range(40)]
    docs = []
    for i in range(160):
        line = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(line) // 8)):
            line[rng.randrange(len(line))] = rng.choice(letters)
        docs.append((i, "".join(line)))
    got = {r.doc_id: r.removed for r in line_dedup.repeated_lines(frame(spark, [t for _, t in docs])).collect()}
    want = brute_lines(docs)
    total, found = sum(map(len, want.values())), sum(len(set(v) & set(want[i])) for i, v in got.items())
    assert total > 60 and found >= 0.9 * total and sum(map(len, got.values())) <= total


def brute_lines(docs):
    """Components over edit similarity alone, without any candidate search."""
    lines = {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if plain := line_dedup.normalised(line):
                lines.setdefault(plain, []).append((i, k))
    plain = sorted(lines, key=len)

    def linked(a, b):
        most = int(max(len(a), len(b)) * 0.2 + 1e-9)
        return abs(len(a) - len(b)) <= most and line_dedup.edit_distance(a, b) <= most

    groups = {}
    for line, root in brute_components(plain, linked).items():
        groups.setdefault(root, []).extend(lines[line])
    out = {i: [] for i, _ in docs}
    for places in groups.values():
        for i, k in sorted(places)[1:]:
            out[i].append(k)
    return {i: sorted(v) for i, v in out.items()}


def test_line_dedup_against_edit_similarity_alone(spark):
    rng = random.Random(9)
    letters = "etaoinshrdlu"
    vocabulary = ["".join(rng.choices(letters, k=rng.randrange(2, 10))) for _ in range(600)]
    base = [" ".join(rng.choices(vocabulary, k=n)) for n in [*range(2, 12), *rng.choices(range(12, 90), k=30)]]
    docs = []
    for i in range(90):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            words = rng.choice(base).split()
            for _ in range(rng.randrange(0, 1 + len(words) // 7)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words).upper() if rng.random() < 0.2 else "  ".join(words))
        docs.append((i, "\n".join(lines)))
    got = {r.doc_id: r.removed for r in line_dedup.repeated_lines(frame(spark, [t for _, t in docs])).collect()}
    want = brute_lines(docs)
    total, found = sum(map(len, want.values())), sum(len(set(v) & set(want[i])) for i, v in got.items())
    assert total > 100 and found >= 0.95 * total
    # nothing goes that edit similarity does not join: a group cut in two keeps a line more, never a stranger
    assert sum(map(len, got.values())) <= total


def test_line_dedup_edges(spark, odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[1] == "" and texts[2] == " \n\t " and texts[4] == "One two\nthree" and texts[5] == "" and texts[8] == "a\n\n\nb"
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# decontamination


def test_contamination_by_hand(spark):
    bench = spark.createDataFrame([(7, "The quick, brown FOX! jumps over the lazy dog and then runs away home"), (9, "short item"), (None, "lost item"), (8, None)], "item_id long, text string")
    item = "the quick brown fox jumps over the lazy dog and then runs away home".split()
    docs = frame(spark, [" ".join(item[:13]), " ".join(item[1:]) + " x" * 300, "a SHORT Item here", None, "", " ".join(item[:12]), "lost item"])
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontamination.contamination(docs, bench).collect()}
    assert got[0] == (13, 13, ["7"], True)
    assert got[1] == (313, 13, ["7"], False)
    assert got[2] == (4, 2, ["9"], True)
    assert got[3] == got[4] == (0, 0, [], False)
    # the item without an id has no name, but its words are hit
    assert got[5][1] == 0 and got[6] == (2, 2, [], True)
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, bench).collect()) == [1, 3, 4, 5]
    spans = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert spans[0] == "" and spans[2] == "a here" and spans[1] == "x " * 299 + "x" and spans[3] is None


def test_contamination_of_very_long_texts_is_linear(spark):
    item = [f"item{k}" for k in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    words = [f"w{k % 977}" for k in range(200_000)]
    words[150_000:150_030] = item
    taken, counts = [], []
    for n in (50_000, 200_000):
        docs = frame(spark, [" ".join(words[-n:])])
        start = time.perf_counter()
        counts.append(decontamination.contamination(docs, bench).select("n_words", "n_hit", "item_ids").first())
        taken.append(time.perf_counter() - start)
    assert [tuple(c) for c in counts] == [(50_000, 30, ["1"]), (200_000, 30, ["1"])]
    assert taken[1] < 6 * taken[0] + 5


def test_contamination_edges(spark, odd):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = decontamination.contamination(odd, bench)
    assert got.count() == odd.count() and got.where("contaminated").count() == 3
    assert decontamination.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(odd.limit(0), bench).count() == 0
    assert decontamination.decontaminate(odd, bench).columns == odd.columns


# tokens


@pytest.fixture(scope="module")
def tricky():
    rng = random.Random(11)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "1", "23", "'s", "<|endoftext|>", "<s>", "▁", "ﬁ", "日本", "\U0001f600", "ing", "\x85", "\xa0", "aaaa", "...", "²", "\r", "THEATRE", "_"]
    return [None, "", " ", LONG * 50] + ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(300)]


def test_prefix_counts_match_the_library(spark, tricky):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    counted = prefix_counts.prefix_token_counts(frame(spark, tricky), path)
    rows = prefix_counts.truncate_to_budget(counted, 7).collect()
    assert len(rows) == len(tricky)
    for r in rows:
        text = r.text or ""
        assert r.n_tokens == len(library.encode(text))
        for k in {0, len(text) // 3, len(text) // 2}:
            assert prefix_counts.tokens_of_prefix(r.prefix_steps, k) == len(library.encode(text[:k]))
        if r.text and len(text) < 60:
            fits = [k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= 7]
            assert r.truncated == text[: max(fits)]


def test_automaton_matches_the_library(spark, tricky):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoded = token_automaton.bpe_encode(frame(spark, tricky), path)
    for r in token_automaton.bpe_decode(encoded, path).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == want
        assert r.decoded == library.decode(want, skip_special_tokens=False) == (r.text or "")
    both = token_automaton.bpe_round_trip(frame(spark, tricky), path)
    assert both.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "decoded"]
    assert sorted(both.collect()) == sorted(token_automaton.bpe_decode(encoded, path).collect())


def test_automaton_caches_are_bounded(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_automaton, "WORD_CACHE", 3000)
    monkeypatch.setattr(token_automaton, "TABLE_CACHE", 3000)
    small, whole = token_automaton.TokenAutomaton(path), token_automaton.loaded(path)
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 12))) for _ in range(30))
        assert small.encode(text) == whole.encode(text)
        assert len(small._encoded) <= 16 and len(small._table) <= 26


def test_automaton_states_are_deterministic():
    a = token_automaton.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    assert a.states <= len(a._born) + 1


def test_token_edges(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_automaton.bpe_encode(odd, path)
    assert out.columns == [*odd.columns, "token_ids"] and out.count() == odd.count()
    assert token_automaton.digests(token_automaton.bpe_decode(out, path)).where("doc_id = 0").first().ids_sha256 == hashlib.sha256(b"").hexdigest()
    counted = prefix_counts.prefix_token_counts(odd, public_tokenizers.path("piece_bpe_32k.model"))
    assert dict(counted.dtypes)["n_tokens"] == "bigint" and counted.count() == odd.count()
    assert token_automaton.bpe_encode(odd.limit(0), path).count() == 0


# quality rules


def brute_quality(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r\n")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_metrics_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a#b <c>\n\n a#b <c>\na#b <c>", "x " * 30]
    for _ in range(40):
        words = rng.choices(["u", "v", "w&", "é|", "\n", "\t"], k=rng.randrange(1, 200))
        texts.append(" ".join(words + words[: rng.randrange(0, 30)]))
    got = {r.doc_id: r for r in quality_rules.measured(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), t


def test_boilerplate_lines_are_removed_and_depleted_documents_rejected(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    menu = words(30)
    texts = [words(40) + "\n" + menu.upper() for _ in range(60)] + [menu + f"\n{words(2)}" for _ in range(10)] + [words(50) for _ in range(30)]
    copy = words(80)
    near = [copy + f"\n{words(3)} {i}" for i in range(50)]
    docs = frame(spark, texts + [words(80)] * 200 + near)
    out = {r.doc_id: r.text for r in quality_rules.apply_quality_rules(docs).collect()}
    # of a page with many copies, equal or nearly so, the first stays; so does the first document with the menu
    assert set(out) == set(range(60)) | set(range(70, 101)) | {300}
    assert all(menu.upper() not in out[i] for i in range(1, 60)) and menu.upper() in out[0] and out[300] == near[0]


def test_boilerplate_of_a_large_source_is_removed_in_the_pipeline(spark):
    import corpus_pipeline

    # one source holds a third of all rows; its menu line stands in 30 of its 900 documents, another line in 20
    texts = [" ".join(f"{hashlib.md5(f'{i} {k}'.encode()).hexdigest()[:6]}" for k in range(25)) for i in range(2700)]
    texts[:30] = [f"{t}\nHome News  About us" for t in texts[:30]]
    texts[30:50] = [f"{t}\nnot often enough" for t in texts[30:50]]
    docs = frame(spark, texts[:900], source="hot").unionByName(frame(spark, texts[900:], 900).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 60)))
    out = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert len(out) == 2700 and all(out[i] == texts[i].split("\n")[0] for i in range(1, 30)) and all(out[i] == texts[i] for i in [0, *range(30, 2700)])


def test_quality_edges(spark, odd):
    judged = quality_rules.judged(quality_rules.line_verdicts(odd))
    assert judged.count() == odd.count() and {r.doc_id for r in judged.where("kept").collect()} == set()
    assert quality_rules.apply_quality_rules(odd).columns == odd.columns
    assert quality_rules.apply_quality_rules(odd.limit(0)).count() == 0


# sharding


def test_shards_are_even_and_match_the_mixture(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 7}", 0) for i in range(1003)]
    got = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), 24).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 1003 and len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    hot = got[got.stratum == "shot"].groupby("shard").size()
    assert hot.max() - hot.min() <= 2
    assert all(zlib.crc32(f"text {i}".encode()) == c for i, c in zip(got.doc_id, got.text_crc32, strict=True))
    again = sharding.assign_shards(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), 24).toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    other = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), 24, seed=1).toPandas()
    assert other.sort_values("doc_id").shard.tolist() != got.sort_values("doc_id").shard.tolist()


def test_sharding_edges(spark, odd, tmp_path):
    got = sharding.assign_shards(odd, 4).toPandas()
    assert len(got) == odd.count() and sorted(got.groupby("shard").size()) == [2, 3, 3, 3]
    assert got[got.doc_id == 0]["size"].tolist() == [8] and got[got.doc_id == 0].text_crc32.tolist() == [0]
    assert sharding.assign_shards(odd.limit(0), 4).count() == 0
    assert sharding.assign_shards(odd.limit(2), 24).count() == 2
    docs = frame(spark, [f"t{i}" for i in range(50)])
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.groupBy("shard").count().where("count = 10").count() == 5


# urls


def test_urls_rules_and_reputation(spark):
    urls = {
        "plain": "https://WWW.Bad.example.com/x?y", "query": "http://a.b.co.uk?q=://z", "none": "no scheme", "null": None, "frag": "x://H#f/://", "com": "http://q.com/en/1", "allow": "http://example.com/en/77",
        "sub": "http://w.example.com/en/7", "net": "http://x.net/de/1", "netblock": "http://example.net/de/8a", "org": "http://my.org/es/", "notorg": "http://my.org/ES/",
    }
    pages = spark.createDataFrame([(i, u, k) for i, (k, u) in enumerate(urls.items())], "page_id long, url string, host string")
    labelled = spark.createDataFrame([("http://www.bad.example.com/1", True)] * 40 + [(f"http://h{i}.fine.net/", i % 10 == 0) for i in range(60)] + [(None, True), ("http://u/", None)], "url string, bad boolean")
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    got = {k: r for k, r in zip(urls, sorted(url_filters.judge_urls(pages, labelled, rules).collect(), key=lambda r: r.page_id), strict=True)}
    assert (got["plain"].host, got["plain"].path, got["plain"].verdict) == ("www.bad.example.com", "/x", "block")
    assert (got["query"].host, got["query"].path) == ("a.b.co.uk", "")
    assert (got["none"].host, got["none"].path, got["none"].verdict) == ("", "", "allow") and (got["null"].host, got["null"].path) == ("", "")
    assert (got["frag"].host, got["frag"].path) == ("h", "")
    assert [(got[k].rule, got[k].verdict) for k in ("com", "allow", "sub", "net", "netblock", "org", "notorg")] == [
        ("com/en/", "block"), ("example.com/en/7", "allow"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")
    ]
    # a host without labels of its own takes its domain's rate
    more = url_filters.judge_urls(spark.createDataFrame([(1, "http://new.example.com/")], "page_id long, url string"), labelled, []).first()
    assert more.bad_bound > 0.3
    assert url_filters.judge_urls(pages.limit(0), labelled.limit(0), rules).count() == 0
    assert url_filters.allowed_pages(pages, labelled.limit(0), rules).columns == pages.columns


def test_registered_domains(spark):
    hosts = {
        "a.b.example.com": ("example.com", "com"), "x.y.or.jp": ("y.or.jp", "or.jp"), "www.sat.gob.mx": ("sat.gob.mx", "gob.mx"), "me.github.io": ("me.github.io", "github.io"),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "u@h.co.uk:80": ("h.co.uk", "co.uk"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    names = url_filters._names(F.col("h"))
    got = {r.h: (r.domain, r.suffix) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", names["domain"].alias("domain"), names["suffix"].alias("suffix")).collect()}
    assert got == hosts


def test_posterior_tells_hosts_apart(spark):
    labelled = spark.createDataFrame([(f"http://h{i % 20}.com/{i}", i % 20 < 5 or i % 50 == 7) for i in range(1000)], "url string, bad boolean")
    pages = spark.createDataFrame([(i, f"http://h{i}.com/", "x") for i in range(20)], "page_id long, url string, verdict string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages, labelled, []).collect()}
    assert got == {i: "block" if i < 5 else "allow" for i in range(20)}


# classifiers


def test_scans_of_odd_tables(spark, odd):
    clash = odd.withColumns({c: F.lit("clash") for c in ("number", "value", "family", "probability", "key", "words", "host", "rule")})
    forest = secret_scan.train(secret_scan.made_findings(spark, 400))
    assert secret_scan.scan(clash, forest).columns == ["doc_id", "number", "value", "probability", "is_secret"]
    assert secret_scan.scan(clash, forest).count() == 0
    assert secret_scan.redact(clash, forest).columns == clash.columns
    model = license_scan.train(license_scan.made_paragraphs(spark, 1500))
    assert license_scan.scan(clash, model).where("confirmed").count() == 0
    pages = clash.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "host", "rule")
    judged = url_filters.judge_urls(pages, pages.select("url", F.lit(True).alias("bad")), [("block", "com/"), ("allow", "org/")])
    assert judged.count() == odd.count() and judged.where("host <> '' OR rule IS NOT NULL").count() == 0


def test_pipeline_stages_on_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        assert set(odd.columns) <= set(out.columns)
        left[name] = out.count()
    assert left == {"quality rules": 0, "line dedup": 11, "SimHash near-dedup": 7, "benchmark decontamination": 8, "BPE encoding and decoding": 11}


def test_secret_forest_on_held_out_findings(spark):
    rows = secret_scan.made_findings(spark, 3000).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(4)))
    model = secret_scan.train(rows.where("part > 0").drop("part"))
    held = model.transform(secret_scan.with_features(rows.where("part = 0")))
    right = held.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.95
    docs = frame(spark, [None, "", 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" now', "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 fixed it", "plain words only"])
    got = {r.doc_id: r.is_secret for r in secret_scan.scan(docs, model).collect()}
    assert got == {2: True, 3: False}
    assert {r.doc_id: r.text for r in secret_scan.redact(docs, model).collect()}[2] == 'set token = "<SECRET>" now'
    assert secret_scan.scan(docs.limit(0), model).count() == 0


def test_secrets_directly_behind_an_equals_sign(spark):
    model = secret_scan.train(secret_scan.made_findings(spark))
    value, upper, hexa = "Xk39fjQ02mmZ81bbQw77", "XK39FJQ02MMZ81BBQW77", "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    cases = {
        f"password={value}": value, f'export TOKEN="{upper}"': upper, f"http://h.net/a?page=2&api_key={hexa}&x=1": hexa, f"token={value}==": value + "==",
        f"AWS_SECRET_ACCESS_KEY={value}": value, f"AWS_SECRET_ACCESS_KEY='{value}'": value, f'secret="{value}=", b': value + "=",
    }
    docs = frame(spark, list(cases))
    assert {r.doc_id: r.value for r in secret_scan.scan(docs, model).where("is_secret").collect()} == dict(enumerate(cases.values()))
    assert [r.text for r in secret_scan.redact(docs, model).orderBy("doc_id").collect()] == [t.replace(v, "<SECRET>") for t, v in cases.items()]
    assert [r.value for r in secret_scan.candidates(frame(spark, [f"sha256={hexa}"])).collect()] == [hexa]


def test_license_classifier_on_held_out_paragraphs(spark):
    model = license_scan.train(license_scan.made_paragraphs(spark, 3000))
    docs = frame(spark, [None, "", "Released under the MIT License.\nSome other words follow here", "THIS work is licensed under the GNU General Public License, version 3.", "A driver's license is required to rent a car", "Th ndinly thbleing ering and thines by threreatsh"])
    got = {(r.doc_id, r.number): r.family for r in license_scan.scan(docs, model).where("confirmed").collect()}
    assert got == {(2, 0): "MIT", (3, 0): "GPL-3.0"}
    fresh = license_scan.made_paragraphs(spark, 4000).withColumn("n", F.monotonically_increasing_id())
    unknown = model.scored(fresh.where("family = 'unknown'").select("words"), model.least).count() / fresh.where("family = 'unknown'").count()
    assert unknown < 0.05
    assert license_scan.scan(docs.limit(0), model).count() == 0


# pipeline


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    sentence = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8))) for _ in range(n))
    bench = [sentence(20) for _ in range(3)]
    texts = [sentence(60) + "\n" + sentence(30) for _ in range(30)]
    texts += [texts[3], texts[4], "short one", None, sentence(10) + " " + bench[1] + " " + sentence(20), (sentence(8) + " ") * 10]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # copies lose all lines and then are near-duplicates of each other: one empty document stays
    assert sorted(r.doc_id for r in rows) == [*range(31)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    for r in rows:
        assert r.text == (texts[r.doc_id] if r.doc_id < 30 else "") and r.exact
        assert list(r.token_ids) == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
