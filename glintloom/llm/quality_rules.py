"""Quality rules with cross-document line frequency (operator 9).

Lines are normalised and hashed, and of each host (here: source) the distinct documents
that hold a line are counted. Lines above the limit are boilerplate and are removed, but
for the first document of the host that holds them; a document of which too little is
left is rejected. So of a page with very many copies, equal or nearly so, the first one
stays. Only DataFrame functions are used.

One pass over the texts makes a narrow table of metrics and line hashes; counts and
verdicts come from that table. Counts are taken before rows are moved, so that a line
that stands in a third of all documents is one row for each task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintloom.llm.common import join_sized, let, materialise, split_words, text_key

#: What parts words, and the characters that count as symbols.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_HAS_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate in a host if more than min_docs of its distinct documents hold it.

    A document is depleted if less than min_left of its words are left, or fewer than min_words.
    """

    min_docs: int = 20
    min_left: float = 0.2
    min_words: int = 10


def _repeated_words(words: Column, window: int) -> Column:
    """Number of words that lie in windows of `window` words found twice or more."""
    none = F.lit(0).cast("long")

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - window)
        return F.when(F.size(h) > window, let(F.transform(at, lambda i: F.xxhash64(*[h[i + k] for k in range(window)])), covered)).otherwise(none)

    def covered(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(let(F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), in_order))

    def in_order(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), union)

    def union(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, k: F.when(k < F.size(starts) - 1, F.least(F.lit(window), F.get(starts, k + 1) - x)).otherwise(window))
        return F.aggregate(gaps, none, lambda a, b: a + b)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measured(docs: DataFrame, host: str = "source", window: int = 8) -> DataFrame:
    """One row for each row of docs: doc_id, key (hash of the text), host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines.

    lines holds number, hash and words of each line with a word; its hash is of the
    line in lower case with single spaces. Null texts have no words and no lines.
    """
    text = F.coalesce("text", F.lit(""))
    words = split_words(F.col("text"), SPACES)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_HAS_WORD))
    plain = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    numbered = F.transform(F.split(plain, "\n"), lambda x, i: F.struct(i.alias("number"), F.xxhash64(F.trim(x)).alias("hash"), F.size(split_words(x, " ")).alias("words")))
    return docs.select(
        "doc_id",
        text_key(F.col("text")).alias("key"),
        F.col(host).cast("string").alias("host"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w, window).alias("repeated"))).alias("w"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.filter(numbered, lambda x: x["words"] > 0).alias("lines"),
    ).select("doc_id", "key", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.repeated").alias("n_repeat_words"), "lines")


def frequent_lines(rows: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, hash, n_docs, first) of the lines above the limit, from measured rows; first is the (doc_id, key) that keeps the line.

    Rows with equal doc_id and text are one document. The smallest doc_id is the first, a
    null one before all; where it repeats, the smallest hash of the text. A null host is a
    host of its own.
    """
    each = rows.select(F.coalesce("host", F.lit("")).alias("host"), "doc_id", "key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    # distinct first, counted after: both halves are combined before rows move
    once = each.groupBy("host", "hash", "doc_id", "key").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "hash").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "key")).alias("first"))
    return counts.where(F.col("n_docs") > limits.min_docs)


def line_verdicts(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """One row for each row of docs: the metrics of measured(), removed (numbers of boilerplate lines), n_left (words) and depleted.

    Rows with equal doc_id, text and host get equal results. Documents without a word
    are depleted. Other columns of docs are not looked at; an empty table gives an
    empty one.
    """
    rows = materialise(measured(docs, host))
    frequent = materialise(frequent_lines(rows, limits))
    lines = rows.select("doc_id", "key", F.coalesce("host", F.lit("")).alias("host"), F.explode("lines").alias("line")).select("doc_id", "key", "host", "line.*")
    marked = join_sized(lines, frequent.select("host", "hash", "first"), ["host", "hash"], "inner", salts=16).where(~F.struct("doc_id", "key").eqNullSafe(F.col("first")))
    # repeated rows repeat their lines
    lost = marked.groupBy("doc_id", "key", "host", "number").agg(F.first("words").alias("words"))
    lost = lost.groupBy("doc_id", "key", "host").agg(F.sort_array(F.collect_list("number")).alias("removed"), F.sum("words").alias("n_removed"))
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("key").alias("lost_key"), F.col("host").alias("lost_host"), "removed", "n_removed")
    same = (F.col("key") == F.col("lost_key")) & (F.coalesce("host", F.lit("")) == F.col("lost_host")) & F.col("doc_id").eqNullSafe(F.col("lost_id"))
    both = rows.drop("lines").join(lost, same, "left")
    left = F.col("n_words") - F.coalesce("n_removed", F.lit(0))
    return both.select(
        *[c for c in rows.columns if c != "lines"],
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        left.alias("n_left"),
        ((left < limits.min_words) | (left < limits.min_left * F.col("n_words"))).alias("depleted"),
    )


def judged(verdicts: DataFrame, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """verdicts with base_failed (too few words, or over most_repeated per cent of them in repeated windows) and kept."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return verdicts.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("depleted"))


def apply_quality_rules(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """docs without rejected rows, and without the boilerplate lines of the others. Columns stay; n_chars, if there, is counted anew.

    Null, empty and blank texts have no words and are rejected. Rows equal in doc_id, text
    and host are judged alike, and a null host is a host of its own. Long texts are
    judged whole; other columns are carried along; an empty table stays empty.
    """
    verdict = judged(line_verdicts(docs, host, limits)).where("NOT kept OR size(removed) > 0")
    verdict = verdict.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.coalesce("host", F.lit("")).alias("__host"), F.col("kept").alias("__kept"), F.col("removed").alias("__removed"))
    verdict = materialise(verdict.groupBy("__id", "__key", "__host").agg(F.first("__kept").alias("__kept"), F.first("__removed").alias("__removed")))
    same = (text_key(docs["text"]) == F.col("__key")) & (F.coalesce(docs[host].cast("string"), F.lit("")) == F.col("__host")) & docs["doc_id"].eqNullSafe(F.col("__id"))
    joined = join_sized(docs, verdict, same, "left").where("__kept IS NULL OR __kept")
    cleaned = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    text = F.when(F.size("__removed") > 0, cleaned).otherwise(docs["text"])
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])


def oracle(limits: LineLimits = LineLimits()) -> str:
    """DuckDB SQL for the columns that the query op9 returns."""
    words = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    line = "trim(regexp_replace(lower(line), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), ' ')"
    return f"""
    WITH doc AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {words} AS w FROM documents),
    raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM doc),
    lines AS (SELECT doc_id, host, text, line, {line} AS norm, len(list_filter(string_split({line}, ' '), lambda w: w <> '')) AS k FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
    freq AS (SELECT host, norm, min(doc_id) AS first FROM lines GROUP BY host, norm HAVING count(DISTINCT doc_id) > {limits.min_docs}),
    lost AS (SELECT doc_id, sum(k) AS n_removed FROM lines JOIN freq USING (host, norm) WHERE doc_id <> first GROUP BY doc_id),
    win AS (SELECT doc_id, s, list_slice(w, s, s + 7) AS win FROM doc, unnest(range(1, len(w) - 6)) AS t(s)),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1), unnest(range(s, s + 8)) AS t(p) GROUP BY doc_id),
    m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      CAST(len(w) - coalesce(n_removed, 0) AS BIGINT) AS n_left
      FROM doc d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
    v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left, base_failed, NOT base_failed AND n_left >= {limits.min_words} AND n_left >= {limits.min_left} * n_words AS kept FROM v"""
