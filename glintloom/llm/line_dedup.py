"""Fuzzy line deduplication (operator 1).

Lines are normalised (lower case, single spaces) and equal ones become one node. The
distinct words of a line are dealt by hash to blocks of a few words each, and its
fingerprint is the SimHashes of the blocks side by side. By the pigeonhole principle
two lines that differ in fewer words than they have blocks agree in at least one block:
the blocks are the keys of an equality join. A 64-bit SimHash of all words throws out
strangers, and candidate pairs are verified by edit similarity of the normalised lines.
Of every connected group the first occurrence, by doc_id and line number, stays.

One 64-bit SimHash cut into blocks of bits would not do: lines with edit similarity 0.8
differ in 7 bits in the median and up to 20, for which blocks of bits that are long
enough to tell lines apart find one pair in seven. Short lines have too few words for
blocks. Their keys are the SimHashes of the line with each word struck out in turn, and
for those of at most three words the line with each character struck out. Lines whose
words are few and long (text without spaces, addresses, codes) have blocks of the
trigrams of their characters as well.

What is joined is a few numbers for each line; texts are read again for candidate
lines only. Similar lines are not compared pair by pair within a group, see linking.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintloom.llm.common import join_sized, materialise, text_key
from glintloom.llm.linking import Fields, bucket_components

#: Bits in which the SimHashes of all words of candidates may differ: of pairs with edit similarity 0.8 that share a key about 1 in 80 differ in more.
MAX_BITS = 14
#: A line's blocks are a power of two, so many that they have from BLOCK_WORDS to twice as many words on average; near the next power it has blocks of both kinds.
BLOCK_WORDS, OVERLAP = 3, 0.15
#: Words and characters that a block needs to be a key (a word counts as 15 at most): fewer do not tell lines apart.
LEAST_WORDS, LEAST_CHARACTERS = 3, 15
#: Distinct words from which on a line has blocks, and up to which its words are struck out; only from here on is its SimHash looked at.
BLOCKS_FROM, STRUCK_TO = 8, 15
#: Words and characters up to which characters are struck out.
SHORT_WORDS, SHORT_CHARACTERS = 3, 64
#: Characters from which on a line has blocks of trigrams as well, if it has more than GRAM_WORD characters for each of its words, as text without spaces, addresses and codes have.
GRAMS_FROM, GRAM_WORD = 24, 12
#: Characters from which on similar() cuts such lines after some of their letters to align the pieces.
_PIECES_FROM = 512
#: Line hashes that a task remembers in order to make the keys of a line once, before it starts anew.
_REMEMBERED = 1 << 17
#: Parts of the key space for each task that looks for shared keys, and keys that are packed at once.
_PARTS, _PACKED = 4, 1 << 19
#: A key, and what is looked at of a line that has it.
_MEMBER = np.dtype([("key", "<i8"), ("id", "<i8"), ("sig", "<i8"), ("size", "<i4")])
MIN_SIMILARITY = 0.8
#: Characters of lines, and words, that are hashed at once.
_BLOCK, _CHUNK = 1 << 18, 1 << 12
#: Words of over 1,024 characters are replaced by their XXH64; so no word has more bytes than _POWERS entries.
_LONG_WORD = re.compile("[^ ]{1025,}")
_POWERS = np.cumprod(np.full(1 << 13, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
#: The bits of each byte, one to a byte of an integer.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
#: How many words of either side _word_bound passes over at most to find two that agree.
_SKIPS = sorted(((p, q) for p in range(7) for q in range(7) if p + q), key=lambda x: (sum(x), x))


def normalised(line: str) -> str:
    """The line in lower case, its words parted by single spaces; empty if it has no word."""
    return " ".join(line.lower().split())


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _distinct_words(lines: list[str]) -> np.ndarray:
    """Sorted numbers, each of a line's place, 36 bits of hash of one of its distinct words, and its length, 15 at most. At most 2**24 lines."""
    lines = [_LONG_WORD.sub(lambda m: xxhash.xxh64_hexdigest(m[0].encode("utf-8", "replace")), x) if len(x) > 1024 else x for x in lines]
    raw = np.frombuffer("\n".join([*lines, ""]).encode("utf-8", "replace"), dtype=np.uint8)
    stops = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate([[0], stops[:-1] + 1])
    last = raw[stops] == 10
    keys = (np.cumsum(last) - last).astype(np.uint64) << np.uint64(40)
    for k in range(0, len(stops), _CHUNK):
        s, e = starts[k : k + _CHUNK], stops[k : k + _CHUNK]
        values = (raw[s[0] : e[-1] + 1] + np.uint64(1)) * _POWERS[np.arange(s[0], e[-1] + 1) - np.repeat(s, e - s + 1)]
        values[e - s[0]] = 0
        hashes = _mixed(np.add.reduceat(values, s - s[0])) >> np.uint64(28)
        keys[k : k + _CHUNK] |= hashes << np.uint64(4) | np.minimum(e - s, 15).astype(np.uint64)
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def _has_grams(line: str) -> bool:
    """Whether the words of a line are too few and long to tell an edit of one of them."""
    return len(line) >= GRAMS_FROM and len(line) > GRAM_WORD * (line.count(" ") + 1)


def _distinct_grams(line: str) -> np.ndarray:
    """As _distinct_words for one line, number 0: of its distinct trigrams of characters, spaces left out. Each counts as five characters, so that three make a key."""
    codes = np.frombuffer(line.replace(" ", "").encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.uint64)
    grams = codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)
    return np.unique(_mixed(grams) >> np.uint64(28)) << np.uint64(4) | np.uint64(5)


def _bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, for each run of `sizes` hashes. Eight bits are counted at a time, in bytes of one integer."""
    pieces = (sizes + 254) // 255  # a byte counts to 255
    firsts = np.cumsum(pieces) - pieces
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(firsts, pieces))
    counts = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], starts, axis=0).view(np.uint8).reshape(-1, 64)
    return counts if len(counts) == len(sizes) else np.add.reduceat(counts, firsts, axis=0, dtype=np.int32)


def _majority(ones: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The SimHashes, unsigned, for counts of set bits among `sizes` hashes."""
    return np.packbits(ones > sizes[:, None] // 2, axis=1, bitorder="little").reshape(-1).view("<u8")


def _block_keys(words: np.ndarray, line: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines and keys of the blocks with enough words, for sorted words, the line of each and its level: the power of two of its blocks."""
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    block = (words & np.uint64((1 << 40) - 1)) >> (40 - levels).astype(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (block[1:] != block[:-1])]))
    sizes = np.diff(np.append(starts, len(words)))
    enough = (sizes >= LEAST_WORDS) & (np.add.reduceat((words & np.uint64(15)).astype(np.int64), starts) >= LEAST_CHARACTERS)
    if not enough.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    taken, kept = np.repeat(enough, sizes), starts[enough]
    simhashes = _majority(_bit_counts(_mixed(words[taken] & np.uint64((1 << 40) - 1)), sizes[enough]), sizes[enough])
    place = levels[kept].astype(np.uint64) << np.uint64(32) | block[kept]
    return line[kept], _mixed(simhashes ^ _mixed(place))


def _fingerprinted(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _keyed, for at most 2**24 lines."""
    keys = _distinct_words(lines)
    line = (keys >> np.uint64(40)).astype(np.int64)
    sizes = np.bincount(line, minlength=len(lines))
    hashes = _mixed(keys & np.uint64((1 << 40) - 1))
    ones = _bit_counts(hashes, sizes)
    sigs = _majority(ones, sizes)
    found = []
    # blocks
    fits = np.log2(sizes / BLOCK_WORDS)
    lower, upper = (np.maximum(1, np.floor(fits + x)).astype(np.int64) for x in (0, OVERLAP))
    for levels, chosen in ((lower, sizes >= BLOCKS_FROM), (upper, (sizes >= BLOCKS_FROM) & (upper > lower))):
        taken = chosen[line]
        found.append(_block_keys(keys[taken], line[taken], levels[line[taken]]))
    # words struck out, and none
    chosen = (sizes >= SHORT_WORDS) & (sizes <= STRUCK_TO)
    taken, whole = chosen[line], np.flatnonzero(chosen)
    if len(whole):
        at = line[taken]
        bits = np.unpackbits(hashes[taken].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        found += [(at, _mixed(_majority(ones[at].astype(np.int16) - bits, sizes[at] - 1))), (whole, _mixed(sigs[whole]))]
    # characters struck out, and none
    places, struck = [], []
    for k in np.flatnonzero(sizes <= SHORT_WORDS).tolist():
        if len(x := lines[k]) <= SHORT_CHARACTERS:
            made = {xxhash.xxh64_intdigest(y.encode("utf-8", "replace")) for y in [x, *(x[:i] + x[i + 1 :] for i in range(len(x)))]}
            places += [k] * len(made)
            struck += made
    found.append((np.array(places, dtype=np.int64), np.array(struck, dtype=np.uint64)))
    # trigrams of lines with few and long words: blocks of both kinds for all, an edit of one character meets three of them
    unspaced = [k for k, x in enumerate(lines) if _has_grams(x)]
    if unspaced:
        grams = [_distinct_grams(lines[k]) for k in unspaced]
        sizes_of = np.array([len(x) for x in grams])
        words, at = np.concatenate(grams), np.repeat(np.array(unspaced, dtype=np.int64), sizes_of)
        level = np.maximum(1, np.floor(np.log2(np.maximum(sizes_of, 1) / BLOCK_WORDS))).astype(np.int64)
        for levels in (level, level + 1):
            places_of, values_of = _block_keys(words, at, np.repeat(levels, sizes_of))
            found.append((places_of, _mixed(values_of)))  # mixed once more, apart from the keys of words
    lines_of, values = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(lines_of, kind="stable")
    looked_at = np.where(sizes > STRUCK_TO, sigs, np.uint64(0))
    looked_at[unspaced] = 0  # an edit in each of a few long words would change all of it
    return looked_at.view(np.int64), np.bincount(lines_of, minlength=len(lines)), values[order].view(np.int64)


def _keyed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As fingerprinted, with the number of keys of each line and all keys one after another."""
    found, first, held = [(np.zeros(0, dtype=np.int64),) * 3], 0, 0
    for k, line in enumerate(lines):
        held += len(line) + 1
        if held >= _BLOCK or k == len(lines) - 1:
            found.append(_fingerprinted(lines[first : k + 1]))
            first, held = k + 1, 0
    sigs, counts, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    return sigs, counts, keys


def fingerprinted(lines: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of normalised lines the signed 64-bit SimHashes of their distinct words, 0 for those too short for one to tell, and their keys."""
    sigs, counts, keys = _keyed(lines)
    return sigs, np.split(keys, np.cumsum(counts)[:-1]) if lines else []


def near(a: Fields, b: Fields) -> Column:
    """Whether lengths and SimHashes leave it open that two lines are similar; a SimHash of 0 always does.

    Lengths alone, as similar() looks at them first, part most lines that share no more
    than one long passage; no similar pair is lost by them.
    """
    alike = (a["sig"] == 0) | (b["sig"] == 0) | (F.bit_count(a["sig"].bitwiseXOR(b["sig"])) <= MAX_BITS)
    most = F.floor(F.greatest(a["size"], b["size"]) * round(1 - MIN_SIMILARITY, 6) + 1e-9)
    return (F.abs(a["size"] - b["size"]) <= most) & alike


def _cut(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of values as an array of so many values each."""
    ends = np.concatenate([[0], np.cumsum(sizes) * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, number, n_lines, line_hash, size, sig, blocks) for each line with a word; key is the hash of the text, size the length of the normalised line.

    A text without such lines has one row, with number -1 and no hash. The first row of
    each text has its number of such lines. blocks are the keys of the line, eight bytes
    each; where it has been met before in the same task they may be missing.
    """
    read = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                row, number, counts, hashes, lengths, new, places = [], [], [], [], [], [], []
                for r, t in enumerate(batch.column(2).to_pylist()):
                    found = [(k, plain) for k, line in enumerate((t or "").split("\n")) if (plain := normalised(line))] or [(-1, "")]
                    counts += [len(found) if found[0][0] >= 0 else 0] + [None] * (len(found) - 1)
                    for k, x in found:
                        h = xxhash.xxh64_intdigest(x.encode("utf-8", "replace"))
                        if k >= 0 and h not in seen:
                            seen.add(h)
                            new.append(x)
                            places.append(len(number))
                        row.append(r)
                        number.append(k)
                        hashes.append(h)
                        lengths.append(len(x))
                if len(seen) > _REMEMBERED:
                    seen.clear()
                sigs, sizes, keys = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int32), np.zeros(0, dtype=np.int64)
                if new:
                    sigs[places], sizes[places], keys = _keyed(new)
                blocks = _cut(keys, sizes)
                hashes = pa.array(np.array(hashes, dtype=np.uint64).view(np.int64), mask=np.array(number, dtype=np.int32) < 0)
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(counts, pa.int32()), hashes, pa.array(lengths, pa.int32()), pa.array(sigs), blocks],
                    names=["doc_id", "key", "number", "n_lines", "line_hash", "size", "sig", "blocks"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, key long, number int, n_lines int, line_hash long, size int, sig long, blocks binary")


def _shared_keys(lines: DataFrame) -> DataFrame:
    """(key, id, sig, size) of the lines of a line table, for keys that stand on two different lines or more.

    Most keys stand on one line alone. All are moved once to find the others: packed,
    those of many lines that go to one part of the key space in one row, so that a key
    costs its 28 bytes and no row of its own. A task holds one part at a time.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = tasks * _PARTS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            members = np.concatenate(held)
            held.clear()
            part = ((_mixed(members["key"].view(np.uint64)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            counts = np.bincount(part, minlength=parts)
            found = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), _cut(members[np.argsort(part, kind="stable")], counts[found])], names=["part", "members"])

        for batch in batches:
            blocks = batch.column(3).to_pylist()
            counts = np.array([len(x) // 8 for x in blocks], dtype=np.int64)
            some = np.empty(counts.sum(), dtype=_MEMBER)
            some["key"] = np.frombuffer(b"".join(blocks), dtype=np.int64)
            for k, name in enumerate(("id", "sig", "size")):
                some[name] = np.repeat(batch.column(k).to_numpy(zero_copy_only=False), counts)
            held.append(some)
            if sum(map(len, held)) >= _PACKED:
                yield packed()
        if any(map(len, held)):
            yield packed()

    def shared(held: list[bytes]) -> pa.RecordBatch:
        members = np.frombuffer(b"".join(held), dtype=_MEMBER)
        order = np.argsort(members["key"])
        keys = members["key"][order]
        again = np.append(keys[1:] == keys[:-1], False)
        again[1:] |= again[:-1]
        members = members[order[again]]
        firsts = np.flatnonzero(np.concatenate([[True], members["key"][1:] != members["key"][:-1]])[: len(members)])
        if len(firsts):
            several = np.minimum.reduceat(members["id"], firsts) != np.maximum.reduceat(members["id"], firsts)
            members = members[np.repeat(several, np.diff(np.append(firsts, len(members))))]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(members[x])) for x in _MEMBER.names], names=list(_MEMBER.names))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        for batch in batches:
            for part, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and part != now:
                    yield shared(held)
                    held.clear()
                now = part
                held.append(members)
        if held:
            yield shared(held)

    rows = lines.where(F.length("blocks") > 0).select("line_hash", "sig", "size", "blocks")
    dealt = rows.mapInArrow(pack, "part int, members binary").repartition(tasks, "part")
    return dealt.sortWithinPartitions("part").mapInArrow(find, "key long, id long, sig long, size int")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line): the normalised lines at wanted (id, doc_id, key, number), read from docs."""
    grouped = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("number", "id")).alias("lines"))
    grouped = materialise(grouped.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "lines"))
    same = (text_key(docs["text"]) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__id"))
    found = join_sized(docs.select("doc_id", "text"), grouped, same, "inner").select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                ids, lines = [], []
                for t, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    parts = t.split("\n")
                    for x in chosen:
                        ids.append(x["id"])
                        lines.append(normalised(parts[x["number"]]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], names=["id", "line"])

    # where doc_id and text repeat, a line is found more than once
    return found.mapInArrow(run, "id long, line string").groupBy("id").agg(F.first("line").alias("line"))


def _word_bound(a: list[str], b: list[str], most: int) -> int:
    """An upper bound of the edit distance of two lines from one alignment of their words; any number above `most` if it exceeds that."""
    size = lambda words: sum(map(len, words)) + len(words)
    i = j = cost = 0
    while i < len(a) and j < len(b) and cost <= most:
        if a[i] == b[j]:
            n = 8 if a[i : i + 8] == b[j : j + 8] else 1
            i, j = i + n, j + n
            continue
        p = q = 1
        if not set(a[i : i + 7]).isdisjoint(b[j : j + 7]):
            for p, q in _SKIPS:
                if a[i + p : i + p + 2] == b[j + q : j + q + 2]:
                    break
            else:
                p = q = 1
        cost += max(size(a[i : i + p]), size(b[j : j + q]))
        i, j = i + p, j + q
    return cost + max(size(a[i:]), size(b[j:]))


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """The Levenshtein distance, one column of the table at a time as bits of two integers; any number above `most` if it exceeds that."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    up, down = full, 0
    # values along the diagonal that ends in the last cell never fall: each step adds one where the bit of `level` is not set
    distance = len(b) - len(a)
    most = len(b) if most is None else most
    get, row = places.get, -distance
    for c in b:
        same = get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        if row >= 0 and not level >> row & 1:
            distance += 1
            if distance > most:
                return distance
        row += 1
        right, left = (down | ~(level | up)) << 1 | 1, (level & up) << 1
        up, down = (left | ~(level | right)) & full, right & level & full
    return distance


def _common(a: str, b: str) -> int:
    """Characters with which both begin."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _pieces(line: str) -> list[str]:
    """The line cut after about an eighth of its letters, chosen by their code alone, so that equal passages are cut alike."""
    ends = "".join(c for c in sorted(set(line)) if xxhash.xxh32_intdigest(c.encode("utf-8", "replace")) % 8 == 0)
    return re.split(f"(?<=[{re.escape(ends)}])", line) if ends else [line]


def similar(a: str, b: str) -> bool:
    """Whether a and b differ by at most 1 - MIN_SIMILARITY of the longer one's characters in edit distance.

    What both begin and end with adds nothing. Most candidates are alike but for a few
    words, which one look at the words shows; only for the others the distance of what
    is left is computed.
    """
    most = int(max(len(a), len(b)) * round(1 - MIN_SIMILARITY, 6) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    start = _common(a, b)
    a, b = a[start:], b[start:]
    end = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if max(len(a), len(b)) <= most:
        return True
    if a.count(" ") == b.count(" ") and sum([max(len(x), len(y)) for x, y in zip(a.split(" "), b.split(" "), strict=True) if x != y]) <= most:
        return True
    if _word_bound(a.split(" "), b.split(" "), most) <= most:
        return True
    if len(a) >= _PIECES_FROM and len(a) > GRAM_WORD * (a.count(" ") + 1) and _word_bound(_pieces(a), _pieces(b), most) <= most:
        return True
    return edit_distance(a, b, most) <= most


def _verified(pairs: DataFrame) -> DataFrame:
    """The rows (a, b) of pairs (a, b, line_a, line_b) whose lines are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                fits = pa.array([similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
                yield batch.select(["a", "b"]).filter(fits)

    return pairs.select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long")


def _roots(links: DataFrame, n: int) -> DataFrame:
    """(node, root) for the nodes b of n materialised links (a, b), a < b, at most one for each b: the node at the end of the way from b to a to the node that a has, and so on."""
    now = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        moved = materialise(join_sized(now.select("node", "root"), above, ["root"], "left", 2 * n).select("node", F.coalesce("higher", "root").alias("root"), "higher"))
        if moved.where("higher IS NOT NULL").isEmpty():
            return now
        now = moved.select("node", "root")


def line_components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The line table of docs, its distinct lines (id, doc_id, number, key, n: first place and number of occurrences), and (node, component) of those linked to others."""
    lines = materialise(line_table(docs))
    nodes = lines.where("number >= 0").groupBy(F.col("line_hash").alias("id")).agg(F.min(F.struct("doc_id", "number", "key")).alias("x"), F.count("*").alias("n"))
    nodes = materialise(nodes.select("id", "x.*", "n"))

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
        # few bytes but much work: dealt by pair, or adaptive execution would leave them to one task
        return _verified(both.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """Links that hold together the same lines as all similar pairs do: a pair that is held together already is not looked at."""
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        texts = materialise(_texts_of(docs, nodes.select("id", "doc_id", "key", "number").join(ids, "id", "left_semi")))
        # the pair of each line with its smallest partner goes first
        chosen = materialise(pairs.groupBy("b").agg(F.min("a").alias("least")))
        links = materialise(verified(chosen.select(F.col("least").alias("a"), "b"), texts))
        n = links.count()
        roots = _roots(links, n)
        rest = join_sized(pairs, chosen, ["b"], "inner").where("a <> least").select("a", "b")
        for x in ("a", "b"):
            rest = join_sized(rest, roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), [x], "left", 2 * n)
        rest = materialise(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
        return links.unionByName(verified(rest, texts))

    return lines.drop("size", "sig", "blocks"), nodes, bucket_components(_shared_keys(lines), near, confirm)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_lines, removed): of each document the number of its lines with a word, and the numbers of those that repeat another.

    Of a group of similar lines the one with the smallest (doc_id, number) stays, a null
    doc_id before all; where doc_id repeats, the smallest hash of the text decides, and
    rows equal in doc_id and text are one row. Null, empty and blank texts have no lines
    and lose none. Other columns of docs are not looked at. An empty table gives an
    empty one.
    """
    lines, nodes, linked = line_components(docs)
    # without a link a line is its own group; only groups of several occurrences lose any
    grouped = materialise(join_sized(nodes, linked.select(F.col("node").alias("id"), "component"), ["id"], "left").where("component IS NOT NULL OR n > 1").withColumn("component", F.coalesce("component", "id")))
    firsts = materialise(grouped.groupBy("component").agg(F.min(F.struct("doc_id", "number", "key")).alias("kept")))
    # distinct lines of a group know the occurrence that stays; salted, so that a group of very many is no hot key
    kept = materialise(join_sized(grouped.select("id", "component"), firsts, ["component"], "inner", salts=16).select(F.col("id").alias("line_hash"), "kept"))
    marked = join_sized(lines, kept, ["line_hash"], "left", salts=16)
    here = F.struct("doc_id", "number", "key")
    marked = marked.withColumn("gone", F.col("kept").isNotNull() & ~here.eqNullSafe(F.col("kept")))
    # lines that stay are not moved, but for the first of each text, which has their number
    moved = marked.where("gone OR n_lines IS NOT NULL")
    return moved.groupBy("doc_id", "key").agg(F.max("n_lines").cast("long").alias("n_lines"), F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("number")))).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of the text; columns and rows stay, n_chars, if there, is counted anew.

    Lines without a word are left as they are. Null and empty texts stay. Repeated rows
    with equal doc_id and text keep and lose the same lines. A document all of whose
    lines stand elsewhere keeps its row, with what is left. An empty table stays empty.
    """
    found = repeated_lines(docs).where(F.size("removed") > 0)
    found = materialise(found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("removed").alias("__removed")))
    same = (text_key(docs["text"]) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__id"))
    joined = join_sized(docs, found, same, "left")
    rest = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    text = F.when(F.col("__removed").isNull(), docs["text"]).otherwise(rest)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])
