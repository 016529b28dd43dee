"""Language identification by language-bitmask n-gram filters (operator 13).

Every language has the set of its common character n-grams (one to three characters of
a lower-cased word, its ends marked). All sets share one bit-sliced Bloom filter: a slot
holds one bit for each language, so the slots of an n-gram, combined by AND, give all
languages that contain it in one look. Bits are counted by language over the n-grams of
a text; a language's share of hits is corrected for the share that its slice of the
filter would return by mistake; the largest corrected share decides.

An n-gram belongs to a language if at least MIN_SHARE of the language's n-grams of that
length are this one. At most 1 / MIN_SHARE n-grams of a length can be so common, so the
filter is bounded by the number of languages and not by the corpus, though all training
texts are counted.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lengths of n-grams; three code points fill 63 bits of a key.
LENGTHS = (1, 2, 3)
#: Least share of an n-gram among those of its language and length.
MIN_SHARE = 2e-5
#: Hash functions, and slots of the filter for each n-gram in it.
HASHES, SLOTS_EACH = 4, 8
#: The answer where a text has no letter.
UNKNOWN = "und"
_CUT = re.compile(r"[^\W\d_]+")
_EDGE = 0x1FFFFF
#: Distinct n-grams, and characters of words, that a worker holds before it passes them on or forgets them; bounds memory, not the result.
_HELD, _CACHED = 500_000, 8_000_000


@dataclass(frozen=True)
class LanguageFilters:
    """The bit-sliced filter: slots (a row of 64-bit words for each slot, a bit for each language) and what each slice returns by mistake."""

    languages: list[str]
    usual: int
    slots: np.ndarray
    mistakes: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """All languages of each n-gram, as rows of 64-bit words: its slots combined by AND."""
        out = None
        for at in slots_of(grams, len(self.slots)):
            found = self.slots[at]
            out = found if out is None else out & found
        return out

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram a row of 0 and 1 by language."""
        bits = np.unpackbits(self.masks(grams).view(np.uint8).reshape(len(grams), -1), axis=1, bitorder="little")
        return bits[:, : len(self.languages)]

    def decide(self, counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) for texts with so many hits by language and n-grams in all; ties go to the first language, texts without hits to the usual one."""
        share = (counts / np.maximum(n, 1)[:, None] - self.mistakes) / (1 - self.mistakes)
        share = np.clip(share, 0.0, 1.0)
        best = share.argmax(axis=1)
        score = share[np.arange(len(share)), best]
        return np.where(score > 0, best, self.usual), score


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the key reach all bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots_of(grams: np.ndarray, size: int) -> list[np.ndarray]:
    """The HASHES slots of each n-gram in a filter of `size` slots (a power of two)."""
    h = _mixed(grams + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _CUT.findall(text.lower()) if text else []


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as 64-bit keys, index of the word of each) for words of letters; an end of a word is a character of its own.

    What counts as a letter is a character of Unicode's letter categories; others that a
    word may hold, such as superscript digits, only part it.
    """
    joined = "".join([f" {w} " for w in words])
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    odd = {c for c in set(joined) if not c.isalpha()}
    edge = np.isin(code, np.array([ord(c) for c in odd], np.uint64)) if odd else np.zeros(len(code), bool)
    code[edge] = _EDGE
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    keys, owners = [], []
    shift = np.uint64(21)
    for n in LENGTHS:
        last = len(code) - n + 1
        if last <= 0:
            continue
        key = code[:last]
        good = owner[:last] == owner[n - 1 :]
        for k in range(1, n):
            key = (key << shift) | code[k : last + k]
        for k in range(n):
            # edges stand at the ends of an n-gram only, and not alone
            if n == 1 or 0 < k < n - 1:
                good = good & ~edge[k : last + k]
        if n == 2:
            good &= ~(edge[:last] & edge[1 : last + 1])
        keys.append(key[good])
        owners.append(owner[:last][good])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, by 4, leaves 2. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def gram_counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each n-gram stands in the texts of a language, over all rows.

    Counted by distinct word first and summed within each task, so what is shuffled
    grows with the tasks and the alphabet. Null languages and texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, counter in words.items():
                several = list(counter)
                for start in range(0, len(several), 50_000):
                    part = several[start : start + 50_000]
                    grams, owner = grams_of(part)
                    if len(grams):
                        times = np.fromiter((counter[w] for w in part), np.int64, len(part))
                        distinct, at = np.unique(grams, return_inverse=True)
                        n = np.zeros(len(distinct), np.int64)
                        np.add.at(n, at, times[owner])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(distinct)), pa.array(distinct.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            words.clear()

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counter = words.setdefault(name, Counter())
                before = len(counter)
                counter.update(words_of(value))
                held += len(counter) - before
                if held > _HELD:
                    yield from out()
                    held = 0
        yield from out()

    read = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return read.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _length(gram: str = "gram") -> Column:
    return F.lit(1) + (F.shiftrightunsigned(gram, 21) > 0).cast("int") + (F.shiftrightunsigned(gram, 42) > 0).cast("int")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> LanguageFilters:
    """Filters from all rows with a language and a text.

    At most 3 / min_share n-grams of a language are common enough, so the table that the
    driver turns into a filter is bounded. Rows without languages or texts teach nothing;
    without any language the filters are empty. Copies count as often as they stand.
    """
    from glintloom.llm.common import materialise

    counts = materialise(gram_counts(labelled, text, lang).withColumn("length", _length()))
    totals = counts.groupBy("lang", "length").agg(F.sum("n").alias("total"))
    common = counts.join(F.broadcast(totals), ["lang", "length"]).where(F.col("n") >= F.lit(min_share) * F.col("total"))
    documents = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang")).count().collect()  # one row for each language
    languages = sorted(r["lang"] for r in documents)
    kept = common.select("lang", "gram").toPandas()  # 3 / min_share rows for each language at most
    size = 1 << max(6, math.ceil(math.log2(max(1, SLOTS_EACH * kept["gram"].nunique()))))
    width = max(1, -(-len(languages) // 64))
    slots = np.zeros((size, width), np.uint64)
    index = {name: i for i, name in enumerate(languages)}
    for name, grams in kept.groupby("lang")["gram"]:
        word, bit = divmod(index[name], 64)
        for at in slots_of(grams.to_numpy(np.int64).view(np.uint64), size):
            slots[at, word] |= np.uint64(1 << bit)
    fill = np.array([np.count_nonzero(slots[:, i // 64] & np.uint64(1 << (i % 64))) / size for i in range(len(languages))])
    usual = max(range(len(languages)), key=lambda i: next(r["count"] for r in documents if r["lang"] == languages[i]), default=-1)
    return LanguageFilters(languages, usual, slots, np.minimum(fill**HASHES, 0.999))


class _Words:
    """Hits of the distinct words that a worker has met: a row by language and the number of n-grams."""

    def __init__(self, filters: LanguageFilters) -> None:
        self.filters, self.at, self.characters = filters, {}, 0
        self.rows = np.zeros((1024, len(filters.languages) + 1), np.int32)

    def learn(self, words: list[str]) -> None:
        if self.characters > _CACHED:
            self.at, self.characters = {}, 0
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            grams, owner = grams_of(part)
            rows = np.zeros((len(part), self.rows.shape[1]), np.int32)
            if len(grams):
                bits = self.filters.hits(grams)
                # owners come in order within each length only
                order = np.argsort(owner, kind="stable")
                owner = owner[order]
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                rows[owner[starts], :-1] = np.add.reduceat(bits[order], starts, axis=0, dtype=np.int32)
                rows[:, -1] = np.bincount(owner, minlength=len(part))
            first = len(self.at)
            while first + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(part)] = rows
            for k, w in enumerate(part):
                self.at[w] = first + k
                self.characters += len(w) + 8

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hits by language, number of n-grams) of each text."""
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.at})
        if new:
            before = len(self.at)
            self.learn(new)
            if len(self.at) < before + len(new):  # the words known before were forgotten
                self.learn(list({w for words in split for w in words if w not in self.at}))
        out = np.zeros((len(texts), self.rows.shape[1]), np.int64)
        for k, words in enumerate(split):
            if words:
                out[k] = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.int64)
        return out[:, :-1], out[:, -1]


_worker: dict[str, _Words] = {}


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    lang_pred is a learned language, or "und" with score 0 where the text is null, empty
    or has no letter, or where no language was learned. The score is the corrected share
    of the text's n-grams that the language contains. Every row is judged by its text
    alone: repeated rows alike, long texts whole. Columns named lang_pred or score are
    replaced; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    read = docs.select(*kept, F.col(text).alias("__text"))
    schema = T.StructType([*read.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if known.name not in _worker:
            _worker.clear()
            _worker[known.name] = _Words(known)
        words = _worker[known.name]
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                if known.languages:
                    counts, n = words.counts(texts)
                    best, score = known.decide(counts, n)
                    names = [known.languages[b] if m else UNKNOWN for b, m in zip(best.tolist(), n.tolist(), strict=True)]
                    score = np.where(n > 0, score, 0.0)
                else:
                    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return read.mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those that are not held out."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    filters = learn(marked.where("NOT held_out"))
    return identify(marked.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")
