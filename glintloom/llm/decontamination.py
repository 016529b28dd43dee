"""Benchmark decontamination with a broadcast hash set of test windows (operator 4).

All windows of n words of the benchmark are hashed into a set. Documents are scanned
window by window: each window is a hash and its place, without any words, and goes
through the set. Of documents with hashes in it the words are made again, and at these
places compared with the window word by word; the words of a true occurrence are hit.
The work is linear in the length of a text. Only DataFrame functions are used.

The set, one long for each window, is broadcast if it has at most MAX_BROADCAST_WINDOWS
(about 20 MB); a larger one is joined by hash after a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintloom.llm.common import ascii_lower, join_sized, let, materialise, split_words, text_key

MAX_BROADCAST_WINDOWS = 500_000
#: Fixed value: words are runs of digits, letters and characters beyond ASCII; these characters part them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
_SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _hashes(words: Column, length: int) -> Column:
    """Hash of each window of `length` words, in order; none if there are fewer words."""

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - length)
        return F.when(F.size(h) >= length, F.transform(at, lambda i: F.xxhash64(*[h[i + k] for k in range(length)]))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def window_set(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(length, window, items): the distinct windows of all items, with the ids of the items that hold them.

    An item of fewer than n words, but not none, is one window. Windows of rows without
    an item_id are windows like any others, only that they have no id to name.
    """
    items = benchmark.select("item_id", _words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    windows = items.where(F.size("words") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, n))).alias("window"))
    lengths = windows.withColumn("length", F.size("window"))
    return lengths.groupBy("length", "window").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, key, spans, item_ids): of each document with an occurrence of a benchmark window all places (start, length), starts counted from 0, and the ids as strings.

    key is the hash of the text and tells documents apart where doc_id repeats.
    """
    windows = materialise(window_set(benchmark, n))
    sizes = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # n rows at most
    read = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    found = []
    for length in sorted(sizes) or [n]:
        # hashes alone: an exploded row that held the words would hold all words of its document
        scanned = read.select("doc_id", "key", F.posexplode(_hashes(_words(F.col("text")), length)).alias("start", "hash"))
        known = windows.where(F.col("length") == length).select(_hashes(F.col("window"), length)[0].alias("hash"), F.array_join("window", " ").alias("window"), "items")
        if sizes.get(length, 0) <= MAX_BROADCAST_WINDOWS:
            scanned, known = scanned.join(F.broadcast(known.select("hash").distinct()), "hash", "left_semi"), F.broadcast(known)
        found.append(scanned.join(known, "hash").select("doc_id", "key", F.struct("start", F.lit(length).alias("length"), "window", "items").alias("m")))
    # repeated rows repeat their matches
    maybe = reduce(DataFrame.unionByName, found).groupBy("doc_id", "key").agg(F.collect_set("m").alias("matches"))
    maybe = materialise(maybe.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "matches"))
    # a window counts as four cells
    size = maybe.agg(F.sum(F.aggregate("matches", F.lit(1), lambda a, m: a + 4 + F.size(m["items"])).cast("long"))).first()[0] or 0
    same = (text_key(docs["text"]) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__id"))
    texts = join_sized(docs.select("doc_id", "text"), maybe, same, "inner", size).select("__id", "__key", "text", "matches")
    true = let(_words(F.col("text")), lambda w: F.filter("matches", lambda m: F.array_join(F.slice(w, m["start"] + 1, m["length"]), " ") == m["window"]))
    rows = texts.select(F.col("__id").alias("doc_id"), F.col("__key").alias("key"), true.alias("m")).where(F.size("m") > 0).dropDuplicates(["doc_id", "key"])
    ids = F.array_distinct(F.flatten(F.transform("m", lambda m: m["items"])))
    return rows.select(
        "doc_id",
        "key",
        F.array_sort(F.array_distinct(F.transform("m", lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))))).alias("spans"),
        F.array_sort(F.transform(ids, lambda i: i.cast("string"))).alias("item_ids"),
    )


def _covered(spans: Column) -> Column:
    """Number of places covered by spans, an array of (start, length) in order."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc: Column, s: Column) -> Column:
        stop = s["start"].cast("long") + s["length"]
        return F.struct((acc["n"] + F.greatest(stop - F.greatest(s["start"].cast("long"), acc["end"]), F.lit(0))).alias("n"), F.greatest(stop, acc["end"]).alias("end"))

    return F.aggregate(spans, zero, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """One row for each row of docs: doc_id, key, n_words, n_hit, n_items, item_ids (strings, sorted), spans and contaminated.

    spans are the occurrences (start, length), counted in words. A document is
    contaminated if at least a twentieth of its words, and at least one, is hit. Null
    and empty texts have no words and are clean. Documents with equal doc_id and text
    get equal rows. Other columns of docs are not looked at. Without documents the
    result is empty; without benchmark items all documents are clean.
    """
    found = hits(docs, benchmark, n).select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "spans", "item_ids", _covered(F.col("spans")).alias("covered"))
    words = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(split_words(F.col("text"), _SEPARATORS_ANY_CASE)).cast("long").alias("n_words"))
    found = materialise(found)
    both = join_sized(words, found, (words["key"] == found["hit_key"]) & words["doc_id"].eqNullSafe(found["hit_id"]), "left")
    n_hit = F.coalesce("covered", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return both.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, remove: str = "documents") -> DataFrame:
    """docs without contamination, columns as before.

    remove="documents" drops contaminated documents and leaves the others as they are.
    remove="spans" keeps all documents and takes out the hit words, each with the
    separators behind it, wherever a benchmark window occurs. Null and empty texts stay
    as they are. Repeated rows are judged alike and all stay or all go. Other columns,
    whatever their names, are carried along. An empty table gives an empty table.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    report = contamination(docs, benchmark, n).where("contaminated" if remove == "documents" else "n_hit > 0")
    report = materialise(report.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"]))
    same = (text_key(docs["text"]) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__id"))
    if remove == "documents":
        return join_sized(docs, report, same, "left_anti")
    cleaned = let(
        # words with what follows them; what stands before the first word is kept
        F.regexp_extract_all(docs["text"], F.lit("((?:[0-9A-Za-z]|[^\\x00-\\x7F])+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)"), F.lit(1)),
        lambda words: F.concat(
            F.regexp_extract(docs["text"], r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0),
            F.array_join(F.filter(words, lambda w, i: ~F.exists(F.col("__spans"), lambda s: (s["start"] <= i) & (i < s["start"] + s["length"]))), ""),
        ),
    )
    joined = join_sized(docs, report, same, "left")
    return joined.select(*[(F.when(F.col("__spans").isNull(), docs["text"]).otherwise(cleaned).alias("text") if c == "text" else docs[c]) for c in docs.columns])


def digests(report: DataFrame) -> DataFrame:
    """The report with the SHA-256 of the comma-joined item ids instead of spans and ids."""
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def oracle(n: int = 13) -> str:
    """DuckDB SQL for digests(contamination(documents, benchmark))."""
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
    WITH item AS (SELECT item_id, {words} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, list_slice(w, s, least(s + {n} - 1, len(w))) AS win FROM item, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS t(s) WHERE len(w) > 0),
    doc AS (SELECT doc_id, {words} AS w FROM documents),
    size AS (SELECT DISTINCT len(win) AS k FROM win),
    scan AS (SELECT doc_id, s, k, list_slice(w, s, s + k - 1) AS win FROM doc, size, unnest(range(1, len(w) - k + 2)) AS t(s)),
    hit AS (SELECT doc_id, s, k, item_id FROM scan JOIN win USING (win)),
    place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + k)) AS t(p) GROUP BY doc_id),
    item_list AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc d LEFT JOIN place USING (doc_id) LEFT JOIN item_list USING (doc_id)"""
