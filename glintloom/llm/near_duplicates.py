"""SimHash near-duplicates by deletion-variant signatures (operator 3).

Fingerprints of 64 bits that differ in at most four are cut into three segments, fewer
than the five that exact segments would need: then one segment differs in at most one
bit. Of each segment every variant with one bit struck out is a key, so two such
fingerprints share a key and meet in an equality join, where they are verified.

Rows: 64 keys of 20 or 21 bits for each distinct fingerprint. Equal fingerprints are
one node, whatever the number of documents. In buckets only some members are compared,
see linking; the components are those of all links.

The pipeline takes these pairs as candidates for another relation, Jaccard similarity of
five-word shingles, at which SimHashes may differ in too many bits for such keys. So
similar_components finds more candidates by MinHash bands, and compares the shingles
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintloom.llm.common import join_sized, materialise, text_key
from glintloom.llm.linking import bucket_components, components, spread, within

MAX_BITS = 4
#: A signature is hot if more than one in so many rows have it.
HOT_SHARE = 1000
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_BLOCK = 1 << 16
MIN_JACCARD = 0.8
#: MinHash bands and values in each: of pairs with Jaccard 0.8 all but 1 in 1,400 share a band, 1 - (1 - 0.8 ** 6) ** 24.
BANDS, BAND_SIZE = 24, 6
_FACTORS, _SUMMANDS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND_SIZE), dtype=np.uint64)
_FACTORS = _FACTORS | np.uint64(1)


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text: over all its word shingles, repeats included, bit by bit the majority of their XXH64.

    A-Z are lower-cased; words are parts between ASCII white space. A text of fewer
    words is one shingle; one without words has fingerprint zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[shingle - 1 :]
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=False)), dtype="<u8", count=len(stops))
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[k : k + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, key, sig): hash of the text and SimHash, as a signed long, of each document. Null texts have no words."""
    read = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([simhash(t, shingle, seed) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made)], names=["doc_id", "key", "sig"])

    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, key long, sig long")


def _segment(bits: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, first).bitwiseAND((1 << width) - 1)


def variants(nodes: DataFrame) -> DataFrame:
    """(key, id, sig) for each node's deletion variants: segment values with one bit set to zero, marked with its place."""
    keys = []
    for first, width in SEGMENTS:
        value = F.shiftrightunsigned(F.col("sig"), first)
        keys += [value.bitwiseAND(((1 << width) - 1) & ~(1 << k)).bitwiseOR((first + k) << 32) for k in range(width)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "id", "sig")


def finer_keys(key: Column, sig: Column) -> Column:
    """Keys that cut a crowded bucket of variants: the bits outside its segment in five parts, one of which is equal where at most four bits differ."""
    place = F.shiftright(key, 32)
    out = F.lit(None).cast("array<bigint>")
    for first, width in SEGMENTS:
        rest = [b for b in range(64) if not first <= b < first + width]
        edges = [len(rest) * k // (MAX_BITS + 1) for k in range(MAX_BITS + 2)]
        parts = []
        for k in range(MAX_BITS + 1):
            mask = sum(1 << b for b in rest[edges[k] : edges[k + 1]])
            parts.append(F.xxhash64(F.lit(k), sig.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
        out = F.when((place >= first) & (place < first + width), F.array(*parts)).otherwise(out)
    return out


def near_duplicate_components(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, key, sig, component and component_id: the smallest doc_id reachable over fingerprints that differ in at most four bits.

    One row for each row of docs. Null, empty and blank texts have fingerprint zero and
    are linked like any others. Equal texts and ties fall into one component; repeated
    rows give repeated rows. A null doc_id is never the smallest unless a component has
    no other. Other columns of docs are not looked at. An empty table gives an empty one.
    """
    prints = materialise(fingerprints(docs, shingle, seed))
    nodes = prints.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.col("sig"))
    found = bucket_components(variants(spread(nodes.select("id", "sig"))), within(MAX_BITS), refine=finer_keys)
    return attach_components(prints, nodes, found)


def attach_components(prints: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """prints with component_id, the smallest doc_id of all nodes in the component of its signature.

    Signatures that more than one in HOT_SHARE rows have, of which there are fewer than
    HOT_SHARE, are looked up in a broadcast table; the others are joined after a shuffle.
    """
    least = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = materialise(least)
    smallest = materialise(least.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size"))
    # only components of several nodes need a look-up; salted, a component with very many is no hot key
    looked_up = join_sized(least, smallest, ["component"], "left", salts=16)
    by_sig = materialise(looked_up.select("sig", "component", F.coalesce("component_id", "least").alias("component_id"), "n"))
    most = prints.count() // HOT_SHARE
    hot, rest = (by_sig.where(c).drop("n") for c in (F.col("n") > most, F.col("n") <= most))
    if hot.isEmpty():
        joined = prints.join(rest, "sig")
    else:
        joined = prints.join(F.broadcast(hot), "sig").unionByName(prints.join(F.broadcast(hot.select("sig")), "sig", "left_anti").join(rest, "sig"))
    return joined.select("doc_id", "key", "sig", "component", "component_id")


def fingerprint_text(sig: Column) -> Column:
    """A signature as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(sig), 16, "0"))


def shingles(text: str | None, shingle: int = 5) -> set[bytes]:
    """The distinct word shingles of a text, words as for simhash. A text of fewer words is one shingle; one without words has none."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()


def band_keys(found: set[bytes]) -> list[int]:
    """For each band the hash of its number and its MinHash values, as signed longs."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    least = np.full(BANDS * BAND_SIZE, (1 << 64) - 1, dtype=np.uint64)
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[k : k + 1024, None] * _FACTORS + _SUMMANDS).min(axis=0))
    rows = least.reshape(BANDS, BAND_SIZE)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def alike(a: set[bytes], b: set[bytes], least: float = MIN_JACCARD) -> bool:
    """Whether two sets have at least this Jaccard similarity."""
    common = len(a & b)
    return common >= ceil(least * (len(a) + len(b) - common) - 1e-9)


def banded(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, key, sig, print, bands): hash of the text, hash of its words, SimHash, and band keys of each document; none for texts of fewer words, which only equal ones resemble."""
    read = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sigs, prints, bands = [], [], []
                for t in batch.column(2).to_pylist():
                    words = (t or "").encode().lower().split()
                    sigs.append(xxhash.xxh64_intdigest(b" ".join(words)) if words else 0)
                    prints.append(simhash(t))
                    bands.append(band_keys(shingles(t, shingle)) if len(words) >= shingle else [])
                sigs, prints = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (sigs, prints))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sigs, prints, pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "sig", "print", "bands"])

    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, key long, sig long, print long, bands array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                fits = [alike(shingles(x, shingle), shingles(y, shingle), least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    both = pairs.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))


def similar_components(docs: DataFrame, shingle: int = 5, least: float = MIN_JACCARD, with_simhash: bool = False) -> DataFrame:
    """doc_id, key, sig, component and component_id, as near_duplicate_components, but linked by Jaccard similarity of word shingles.

    Texts of equal words, as far as simhash tells words, are one node; sig is the hash of
    the words. Candidates share a MinHash band; all are compared, shingle by shingle,
    but for those that other comparisons have joined already. Texts without words, null
    ones included, are one component; repeated rows give repeated rows; a null doc_id is
    the smallest only where a component has no other. Other columns are not looked at;
    an empty table gives an empty result.

    with_simhash also takes texts whose SimHashes differ in at most four bits as candidates.
    """
    prints = materialise(banded(docs, shingle))
    nodes = prints.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "key", "bands")).alias("first"), F.min("print").alias("print"), F.count("*").alias("n"))
    nodes = materialise(nodes.select("sig", F.col("sig").alias("id"), "least", "n", "print", "first.*"))

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs)
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = materialise(nodes.join(ids, "id", "left_semi").select("id", F.col("doc_id").alias("__id"), F.col("key").alias("__key")))
        same = (text_key(docs["text"]) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__id"))
        # where doc_id and text repeat, a text is found more than once
        texts = materialise(join_sized(docs.select("doc_id", "text"), wanted, same, "inner").select("id", "text").dropDuplicates(["id"]))
        # one pair of each node first: in a dense group these leave little to compare
        mix = F.xxhash64("a", "b")
        once = pairs.groupBy("a").agg(F.min(F.struct(mix.alias("h"), "b")).alias("x")).select("a", "x.b")
        first = _compared(once, texts, shingle, least)
        groups = components(first)
        left = pairs.join(groups.toDF("a", "group_a"), "a", "left").join(groups.toDF("b", "group_b"), "b", "left")
        left = left.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).join(once, ["a", "b"], "left_anti")
        return first.unionByName(_compared(left, texts, shingle, least))

    members = spread(nodes.select("id", "bands")).select(F.explode("bands").alias("key"), "id", F.lit(0).cast("long").alias("sig"))
    found = bucket_components(members, within(0), confirm)
    if with_simhash:
        near = bucket_components(variants(spread(nodes.select("id", F.col("print").alias("sig")))), within(MAX_BITS), confirm, refine=finer_keys)
        links = found.unionByName(near).where("node <> component")
        found = materialise(components(links.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return attach_components(prints.drop("bands", "print"), nodes.select("sig", "id", "least", "n"), found)


def first_of_groups(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id. Columns stay as they are.

    found has the components of docs, those of near_duplicate_components by default.

    Where the smallest doc_id of a group stands on several texts, the one with the
    smallest hash stays; of rows equal in doc_id and text one stays. A group whose
    doc_ids are all null keeps the null row with the smallest hash.
    """
    read = docs.withColumn("__key", text_key(F.col("text")))
    found = near_duplicate_components(docs) if found is None else found
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    rows = found.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n"))
    firsts = rows.groupBy("component").agg(F.min(F.struct(rank.alias("r"), "n")).alias("first")).select("first.r.*", "first.n")
    firsts = materialise(firsts.select(F.col("doc_id").alias("__first"), F.col("key").alias("__first_key"), "n"))
    same = (F.col("__key") == F.col("__first_key")) & F.col("doc_id").eqNullSafe(F.col("__first"))
    kept = join_sized(read, firsts.drop("n"), same, "left_semi")
    if not firsts.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__key"])
    return kept.select(*docs.columns)
