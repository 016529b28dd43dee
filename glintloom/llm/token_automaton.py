"""BPE encoding and decoding by a tokenization automaton (operator 7).

The automaton reads tokens. It starts as one state with a loop for every byte and
takes in the merges one after another: the gadget of a merge (u, v) makes a copy,
without the arc v, of the state that u leads to, lets u lead to the copy, and lets the
new token uv lead on from wherever u does to where v went. All arcs of one token lead
to one state, so a merge adds at most one state and the automaton stays deterministic.
It accepts a token sequence if and only if BPE makes it from its own bytes.

A word is encoded by running all tokens that match its bytes from left to right through
the transition table; of every prefix exactly one sequence is accepted. Decoding emits
the bytes that label the arcs. A copied state shares the arcs of the state it was copied
from, so an arc is looked up by following creation times, and then kept in the table.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes, as estimated, that a worker keeps of words with their ids, and of transitions, before it starts anew. They bound its memory, not the result.
WORD_CACHE, TABLE_CACHE = 24 << 20, 24 << 20
#: What an entry takes beside its characters and ids: the objects and its place in the dictionary.
_WORD_BYTES, _ARC_BYTES = 200, 120
_LONGEST_KEPT = 64
#: Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters, decimal digits, ASCII signs and plain white space, where the faster re agrees.
_LATIN_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile(r"[^\t\n\r -~¡-ɏ]|[²³¹¼½¾]")
_loaded: dict[str, TokenAutomaton] = {}
_loaded_labels: dict[str, dict[int, bytes]] = {}


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _labels(spec: dict) -> dict[int, bytes]:
    """The bytes that the arcs of each token emit."""
    byte = _byte_of_character()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special} | {i: t.encode() for t, i in special.items()}


def emitted(label: dict[int, bytes], ids: list[int]) -> str:
    """The labels of the arcs, joined and read as UTF-8."""
    return b"".join([label[i] for i in ids]).decode("utf-8", "replace")


class TokenAutomaton:
    """The automaton of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are supported")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must match as they are")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = _labels(spec)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._compile([(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges])
        self._ends = ahocorasick.Automaton()
        added = set(self.special.values())
        for i, b in self.label.items():
            if i not in added and (len(b) == 1 or i in self._born):
                self._ends.add_word(b.decode("latin-1"), i << 8 | len(b))
        self._ends.make_automaton()
        special = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self._special = regex.compile(f"({special})") if special else None
        self._words = regex.compile(WORDS)
        #: Words met so far, with their ids as packed integers.
        self._encoded: dict[str, bytes] = {}
        self._kept = 0

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        #: Of each merged token its time and its parts; of each merge that took part, its time.
        self._born: dict[int, tuple[int, int, int]] = {}
        self._taken: dict[tuple[int, int], int] = {}
        #: State that each token leads to now. State 0 is the first one.
        self._state: dict[int, int] = {}
        states = 1
        for time, (u, v, uv) in enumerate(merges, 1):
            if uv in self._born or not self._arc_after(u, time - 1, v):
                continue  # no path u, v is left: the merge never happens
            to_v = self._state.get(v, 0)
            if u == v:
                to_v = self._state.get(u, 0)
            self._taken[u, v] = time
            self._born[uv] = (time, u, v)
            self._state[u] = states
            self._state[uv] = to_v
            states += 1
        self.states = states
        self._table: dict[int, bool] = {}

    def _arc_after(self, u: int, time: int, t: int) -> bool:
        """Whether the state that token u led to at this time has, or would get by then, an arc t."""
        while True:
            taken = self._taken.get((u, t))
            if taken is not None and taken <= time:
                return False  # the copy made then lacks t
            t_born, u_born = self._born.get(t), self._born.get(u)
            if t_born and (not u_born or t_born[0] >= u_born[0]):
                time, t = t_born[0], t_born[1]  # t was let in where its first part was
            elif u_born:
                # u first led to where its second part did before the gadget of u
                time, u = u_born[0] - (u_born[1] == u_born[2]), u_born[2]
            else:
                return True

    def accepts(self, before: int, t: int) -> bool:
        """The transition table: whether token t may follow token `before`."""
        key = before << 32 | t
        if (known := self._table.get(key)) is None:
            if len(self._table) * _ARC_BYTES >= TABLE_CACHE:
                self._table.clear()
            known = self._table[key] = self._arc_after(before, 1 << 60, t)
        return known

    def _word(self, word: str) -> bytes:
        if (known := self._encoded.get(word)) is not None:
            return known
        data = word.encode()
        last, back, table, n = [-1], [0], self._table, 1
        for end, found in self._ends.iter(data.decode("latin-1")):
            if n > end + 1:  # this prefix is read already
                continue
            length, t = found & 0xFF, found >> 8
            before = last[n - length]
            if before >= 0:
                if (fits := table.get(before << 32 | t)) is None:
                    fits = self.accepts(before, t)
                if not fits:
                    continue
            last.append(t)
            back.append(length)
            n += 1
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= back[at]
        known = array("i", reversed(out)).tobytes()
        if len(word) <= _LONGEST_KEPT:
            if self._kept >= WORD_CACHE:
                self._encoded.clear()
                self._kept = 0
            self._encoded[word] = known
            self._kept += _WORD_BYTES + 2 * len(word) + len(known)
        return known

    def packed(self, text: str) -> bytes:
        """Token ids of text as packed 32-bit integers. Strings of added tokens in the text become those tokens, as the library has it."""
        get, out = self._encoded.get, []
        words = self._words if _NOT_LATIN.search(text) else _LATIN_WORDS
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part:
                out += [get(w) or self._word(w) for w in words.findall(part)]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        """Token ids of text."""
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined and read as UTF-8."""
        return emitted(self.label, ids)


def loaded(path: str) -> TokenAutomaton:
    """The automaton of the file at path, compiled once per worker."""
    if path not in _loaded:
        _loaded[path] = TokenAutomaton(path)
    return _loaded[path]


def loaded_labels(path: str) -> dict[int, bytes]:
    """The labels alone, which are all that decoding needs."""
    if path in _loaded:
        return _loaded[path].label
    if path not in _loaded_labels:
        with open(path, encoding="utf-8") as f:
            _loaded_labels[path] = _labels(json.load(f))
    return _loaded_labels[path]


def _lists(packed: list[bytes]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, packed)]) // 4
    values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, type=pa.list_(pa.field("element", pa.int32(), False)))


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, by default all) with token_ids (array of int): the BPE encoding of each whole text.

    Null and empty texts get an empty array. Every row stands for itself, so repeated
    rows and ties need no care; long texts are read whole, word by word. A column named
    token_ids that docs has already is replaced. An empty table gives an empty table.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != ids.lower()]
    read = docs.select(*kept, F.col(text).alias("__text"))
    schema = T.StructType([*read.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = loaded(vocabulary).packed
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                made = _lists([packed(x) if x else b"" for x in batch.column("__text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*kept, ids])

    return read.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """encoded with decoded (string): the text of each row's token ids; null and empty ids give an empty text.

    Every row stands for itself, so repeated rows and ties need no care. A column named
    decoded that encoded has already is replaced. An empty table gives an empty table.
    """
    kept = encoded.drop(text)
    names = [*kept.columns, text]
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = loaded_labels(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                made = [emitted(label, x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in batch.column(ids)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=names)

    return kept.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """What bpe_decode(bpe_encode(docs)) gives, encoded and decoded by one Python worker for each task in place of two.

    Null and empty texts have no ids and decode to the empty text; long texts are encoded
    whole, every row stands for itself, and columns named as the results are replaced.
    An empty table stays empty.
    """
    new = (ids.lower(), decoded.lower())
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    read = docs.select(*kept, F.col(text).alias("__text"))
    schema = T.StructType([*read.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = loaded(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                packed = [automaton.packed(x) if x else b"" for x in batch.column("__text").to_pylist()]
                back = pa.array([automaton.decode(array("i", p).tolist()) for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(packed), back], names=[*kept, ids, decoded])

    return read.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, comma-joined) and of the decoded text."""
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
