"""Periodic runs of words by Baier grouping and Lyndon roots (operator 11).

A run is a stretch of words with smallest period q that no neighbouring word extends.
Phase one of Baier's suffix sorter puts suffixes into groups that share their longest
Lyndon prefix; the length of a group's prefix is kept as groups are split, so the
Lyndon array falls out directly. Done under both orders of the words, every run has a
Lyndon root among the entries of one of the arrays. Each root is extended to both sides
through longest common extensions, which are read from a table of doubled ranks.

A run as long as asked for (24 words and three periods) repeats each of its eight-word
windows. So the words outside stretches of repeated windows are in no such run, and
grouping works on the stretches alone; this is exact, see stretches().

Texts are independent: Spark deals the rows out, and a helper per row works in
mapInArrow on one text at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fewest words and fewest periods of a run.
LEAST_WORDS, LEAST_PERIODS = 24, 3
_WINDOW = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def lyndon_array(words: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place, by phase one of Baier's suffix sorter.

    Groups are taken from the highest down. When one is taken its places leave a linked
    list of places, so what is then left of a place is the nearest one in a lower group;
    each place that is hit so many times gets the group's prefix appended so many times
    and moves to a new group just above its own. Every place leaves once and causes one
    move at most: the time is linear but for sorting the words and small counts.
    """
    n = len(words)
    left, right = list(range(-1, n)), list(range(1, n + 2))  # the place n closes the list; -1 is the same as the last cell
    right.append(0)
    first: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        first.setdefault(w, []).append(i)
    members = [first[w] for w in sorted(first)]
    group = [0] * n
    for g, places in enumerate(members):
        for i in places:
            group[i] = g
    length = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    out = [0] * n
    g = len(members) - 1
    while g >= 0:
        hit: list[int] = []
        times: list[int] = []
        last = -1
        size = length[g]
        for i in members[g]:
            if group[i] != g:
                continue
            out[i] = size
            p, q = left[i], right[i]
            left[q] = p
            if p < 0:
                continue
            right[p] = q
            if p == last:
                times[-1] += 1
            else:
                hit.append(p)
                times.append(1)
                last = p
        members[g] = []
        if hit:
            parts: dict[tuple[int, int], list[int]] = {}
            for p, c in zip(hit, times, strict=True):
                parts.setdefault((c, group[p]), []).append(p)
            for c, old in sorted(parts, reverse=True):
                new = len(members)
                moved = parts[c, old]
                members.append(moved)
                length.append(length[old] + c * size)
                for p in moved:
                    group[p] = new
                up = above[old]
                above[old] = new
                below.append(old)
                above.append(up)
                below[up] = new  # up is there: the group in hand lies above all groups that it hits
        g = below[g]
    return out


def doubled_ranks(words: np.ndarray) -> list[np.ndarray]:
    """Tables of numbers for the stretches of 1, 2, 4, .. words; equal stretches have equal numbers, and only those."""
    tables = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while 2 * step <= len(words):
        t = tables[-1]
        pair = t[: len(t) - step] * (int(t.max()) + 1) + t[step:]
        tables.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return tables


def _forward(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Words that agree from places a and b on (a < b <= n)."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        step, t = 1 << k, tables[k]
        # twice, as a stretch may be as long as almost two of the largest steps
        for _ in range(2):
            open_ = np.flatnonzero(b + total + step <= n)
            same = open_[t[a[open_] + total[open_]] == t[b[open_] + total[open_]]]
            total[same] += step
    return total


def _backward(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that agree before places a and b (a < b)."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        step, t = 1 << k, tables[k]
        for _ in range(2):
            open_ = np.flatnonzero(a - total - step >= 0)
            same = open_[t[a[open_] - total[open_] - step] == t[b[open_] - total[open_] - step]]
            total[same] += step
    return total


def runs_of(words: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """All runs (start, length, period) of at least `least` words and `periods` periods (2 or more), by start and period."""
    n = len(words)
    if n < max(least, periods):
        return np.zeros((0, 3), np.int64)
    tables = doubled_ranks(words)
    ranks = tables[0]
    roots = []
    for order in (ranks, ranks.max() - ranks):
        size = np.array(lyndon_array(order.tolist()), np.int64)
        at = np.flatnonzero(size * periods <= n)
        roots.append(np.stack([at, size[at]], axis=1))
    at, period = np.unique(np.concatenate(roots), axis=0).T
    behind = _forward(tables, at, at + period, n)
    # two periods are certain only together with what lies before
    before = _backward(tables, at, at + period)
    found = np.stack([at - before, before + period + behind, period], axis=1)
    found = found[(found[:, 1] >= least) & (found[:, 1] >= periods * period)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(words: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Stretches (start, end) of words that hold every run of `least` (24 or more) words and three periods.

    Let a run of L words have period q, L >= 24 and L >= 3q. Then L >= 2q + 8: the
    window of eight words at any place of the run is found q words later or q words
    earlier within the run. So all its windows repeat in the text and the run lies in
    one stretch of places with repeated windows. Equal hashes of different windows only
    make stretches longer.
    """
    n = len(words)
    if n < least:
        return []
    h = words.astype(np.uint64) * _MULTIPLIER + np.uint64(1)
    for step in (1, 2, 4):
        h = h[:-step] * _MULTIPLIER + (h[step:] ^ (h[step:] >> np.uint64(29)))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    repeated = np.zeros(len(h) + 2, np.int8)
    repeated[order[1:][same] + 1] = 1
    repeated[order[:-1][same] + 1] = 1
    turn = np.diff(repeated)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + _WINDOW - 1
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b - a >= least]


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers; equal words have equal numbers."""
    at = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(at.__getitem__, words), np.int64, len(words))


def text_runs(words: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) of a whole text, by start and period."""
    found = [runs_of(words[a:b]) + np.array([a, 0, 0]) for a, b in stretches(words)]
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def repeated_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words is in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def periodic_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that query op11 looks at: for one doc_id in ten the words from a place on are made periodic."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def find_runs(docs: DataFrame, text: str = "text", planted: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs: its runs (start, length, period) in words, and its words without those that only repeat a period.

    Words are what lies between ASCII white space. collapsed joins the kept words with
    one space. With planted the words are first changed as periodic_words() says. A null
    or empty text has no words, no runs and an empty collapsed text; a null doc_id counts
    as an empty name where words are planted. Repeated rows stand for themselves, very
    long texts are read whole, columns other than doc_id and text are not looked at, and
    an empty table gives an empty table.
    """
    read = docs.select("doc_id", F.col(text).alias("__text"))
    schema = T.StructType([read.schema.fields[0], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.field("element", pa.struct([pa.field(n, pa.int64()) for n in ("start", "length", "period")]), nullable=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, all_runs, kept = [], [], []
                for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = (value or "").encode().split()
                    if planted:
                        words = periodic_words(doc_id, words)
                    found = text_runs(numbered(words))
                    if len(found):
                        drop = repeated_words(len(words), found)
                        words_left = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                    else:
                        words_left = words
                    sizes.append(len(words))
                    all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                    kept.append(b" ".join(words_left).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(all_runs, kind), pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return read.mapInArrow(run, schema)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length / period; of equals the one with the smallest start, then period. Null without runs."""
    better = "b.length * a.period > a.length * b.period OR (b.length * a.period = a.length * b.period AND (b.start < a.start OR (b.start = a.start AND b.period < a.period)))"
    return F.expr(f"aggregate(slice({runs}, 2, greatest(size({runs}) - 1, 0)), get({runs}, 0), (a, b) -> IF({better}, b, a))")


def digests(found: DataFrame) -> DataFrame:
    """The columns of query op11 from the result of find_runs()."""
    best = found.withColumn("best", strongest())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

