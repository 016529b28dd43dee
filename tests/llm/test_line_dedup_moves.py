"""What line dedup moves between tasks and how many pairs it tests."""

from __future__ import annotations

import random

from glintloom.llm import line_dedup


def _lines() -> list[str]:
    """60 near copies of a line, each with another word changed, and 30 lines of their own."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    whole = [word() for _ in range(70)]
    return [" ".join([*whole[:k], word(), *whole[k + 1 :]]) for k in range(60)] + [" ".join(word() for _ in range(40)) for _ in range(30)]


def test_only_shared_keys_are_moved_and_pairs_held_together_are_not_tested(spark, monkeypatch):
    lines = _lines()
    members, tested = [], []
    components, verified = line_dedup.bucket_components, line_dedup._verified
    monkeypatch.setattr(line_dedup, "bucket_components", lambda m, *more: members.extend(m.collect()) or components(m, *more))
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs: tested.append(pairs.count()) or verified(pairs))
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines + [lines[-1], None, " "])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {k: (int(k < 91), [0] if 0 < k < 60 or k == 90 else []) for k in range(93)}
    holders: dict[int, set[str]] = {}
    for line, keys in zip(lines, line_dedup.fingerprinted(lines)[1], strict=True):
        for key in keys.tolist():
            holders.setdefault(key, set()).add(line)
    assert {(r.key, r.size) for r in members} == {(key, len(x)) for key, held in holders.items() if len(held) > 1 for x in held}
    # a chain that holds 60 lines together has 59 links
    assert 59 <= sum(tested) <= 90


def test_links_in_either_order_and_chains_have_one_root(spark):
    links = spark.createDataFrame([(1, 2), (2, 5), (5, 7), (7, 9), (3, 4)], "a long, b long")
    assert {r.node: r.root for r in line_dedup._roots(links, 5).collect()} == {2: 1, 5: 1, 7: 1, 9: 1, 4: 3}
