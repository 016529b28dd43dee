"""Token counts by prefix dynamic programming (operator 6).

A BPE encoding of a prefix ends in exactly one token t, and what stands before t is
the encoding of a shorter prefix. So one pass from left to right finds, for every
prefix, its last token and its token count: t fits if it ends the prefix and if it
and the last token of the shorter prefix stay apart when merged by rank. A text falls
into pieces that no vocabulary entry crosses (a run of letters or of other characters,
each with the word marks before it), so pieces are solved once per worker and looked
up afterwards. An Aho-Corasick automaton finds the entries that end at each character.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries kept by a worker before it starts anew; bounds its memory, not the result.
CACHE_ENTRIES = 1_000_000
_MARK = "▁"
_LONGEST_KEPT = 48
_PIECES = re.compile(rf"{_MARK}*[^\W\d_¹²³]+|{_MARK}*(?:[\d_¹²³]|[^\w{_MARK}])+|{_MARK}+")
_loaded: dict[str, PrefixCounter] = {}


class PrefixCounter:
    """Exact token counts of a sentencepiece BPE model for all prefixes of a text.

    The model must have identity normalisation, a dummy prefix and byte fallback, as
    piece_bpe_32k.model does; others are refused. Empty texts have no tokens.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        for probe, out in (("", []), ("  ﬁ ", [_MARK * 3 + "ﬁ" + _MARK])):
            if ["".join(model.encode(probe, out_type=str))] * bool(out) != out:
                raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in ordinary]
        if any(len(_PIECES.findall(t)) > 1 for t in texts):
            raise ValueError("an entry of the vocabulary crosses the border of two pieces")
        order = sorted(range(len(texts)), key=lambda k: (-model.get_score(ordinary[k]), k))
        #: Rank of each entry: merges of a lower rank come first.
        self.rank = {texts[k]: r for r, k in enumerate(order)}
        self._parts: dict[str, tuple[str, str] | None] = {}
        self._apart: dict[int, bool] = {}
        self._steps: dict[str, bytes] = {}
        for t in sorted(self.rank, key=len):
            self._parts[t] = self._find_parts(t)
        self._texts = [texts[k] for k in order]
        self._ends = ahocorasick.Automaton()
        for t, r in self.rank.items():
            if len(t) == 1 or self._parts[t]:
                self._ends.add_word(t, r << 8 | len(t))
        self._ends.make_automaton()

    def _find_parts(self, t: str) -> tuple[str, str] | None:
        """The last merge that makes t; None for single characters. An entry that merging never makes gets no rank."""
        if len(t) == 1:
            return None
        for k in range(1, len(t)):
            a, b = t[:k], t[k:]
            if a in self.rank and b in self.rank and (len(a) == 1 or self._parts.get(a)) and (len(b) == 1 or self._parts.get(b)) and self._stay_apart(a, b, self.rank[t]):
                return a, b
        return None

    def _stay_apart(self, a: str, b: str, until: int) -> bool:
        """Whether no merge of a rank below `until` joins an end of a with a start of b.

        Undoes the latest merges on both sides of the border, one by one: a pair that
        was there at one time would have been merged if its rank is below the rank of
        the merge that next took one of the two away.
        """
        while True:
            r = self.rank.get(a + b)
            if r is not None and r < until:
                return False
            ra = self.rank[a] if len(a) > 1 else -1
            rb = self.rank[b] if len(b) > 1 else -1
            if ra < 0 and rb < 0:
                return True
            # equal pairs merge from the left, so what b was made of was taken later than an equal pair across the border
            if ra > rb:
                until, a = ra, self._parts[a][1]
            else:
                until, b = rb + 1, self._parts[b][0]

    def _fits(self, a: int, b: int) -> bool:
        if len(self._apart) >= CACHE_ENTRIES:
            self._apart.clear()
        known = self._apart[a << 32 | b] = self._stay_apart(self._texts[a], self._texts[b], len(self.rank))
        return known

    def _solve(self, piece: str) -> bytes:
        """Changes of the token count along piece.

        count[n] and last[n] are of the prefix of n characters; a last token of -1 stands
        for the start, or for bytes that stand for a character.
        """
        count, last, apart, n = [0], [-1], self._apart, 1
        for end, found in self._ends.iter(piece):
            if n > end + 1:  # this prefix is solved already
                continue
            while n <= end:  # characters outside the vocabulary: one token a byte
                count.append(count[-1] + len(piece[n - 1].encode()))
                last.append(-1)
                n += 1
            start, r = n - (found & 0xFF), found >> 8
            if (before := last[start]) >= 0:
                if (fits := apart.get(before << 32 | r)) is None:
                    fits = self._fits(before, r)
                if not fits:
                    continue
            count.append(count[start] + 1)
            last.append(r)
            n += 1
        for c in piece[n - 1 :]:
            count.append(count[-1] + len(c.encode()))
        return bytes([b - a & 255 for a, b in pairwise(count)])

    def _piece(self, piece: str) -> bytes:
        if (known := self._steps.get(piece)) is None:
            if len(self._steps) >= CACHE_ENTRIES:
                self._steps.clear()
            known = self._solve(piece)
            if len(piece) <= _LONGEST_KEPT:
                self._steps[piece] = known
        return known

    def steps(self, text: str) -> bytes:
        """By how much the token count changes with each further character of text, as signed bytes.

        The first byte also counts the dummy prefix. The sum of the first k bytes is
        the token count of text[:k]. Changes stay far inside a byte: a character adds
        at most its bytes and a merge takes at most the longest entry's length.
        """
        if not text:
            return b""
        get = self._steps.get
        whole = b"".join([get(p) or self._piece(p) for p in _PIECES.findall(_MARK + text.replace(" ", _MARK))])
        first = whole[0] + whole[1] - 256 * ((whole[0] > 127) + (whole[1] > 127))
        return bytes([first & 255]) + whole[2:]


def loaded(path: str) -> PrefixCounter:
    """The model at path, read once per worker."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def prefix_token_counts(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, by default all) with prefix_steps (binary, see PrefixCounter.steps) and n_tokens (long).

    A null or empty text has no steps and 0 tokens. Repeated rows, very long texts and
    ties need no care: each row stands for itself and nothing is cut. Columns of these
    names that docs has already are replaced; an empty table gives an empty table.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("prefix_steps", "n_tokens")]
    read = docs.select(*kept, F.col(text).alias("__text"))
    schema = T.StructType([*read.schema.fields[:-1], T.StructField("prefix_steps", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                steps = [counter.steps(t or "") for t in batch.column("__text").to_pylist()]
                sums = [int(np.frombuffer(s, dtype="<i1").sum(dtype=np.int64)) for s in steps]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(steps, pa.binary()), pa.array(sums, pa.int64())], names=[*kept, "prefix_steps", "n_tokens"])

    return read.mapInArrow(run, schema)


def tokens_of_prefix(steps: bytes, characters: int) -> int:
    """Token count of the first `characters` characters, from stored steps."""
    return int(np.frombuffer(steps, dtype="<i1")[:characters].sum(dtype=np.int64))


def longest_prefix_within(steps: bytes, budget: int) -> int:
    """The largest number of characters whose token count is at most budget, from stored steps."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(steps, dtype="<i1"), dtype=np.int64)])
    least = np.minimum.accumulate(counts[::-1])[::-1]
    return bisect_right(least.tolist(), budget) - 1 if budget >= 0 else 0


def truncate_to_budget(counted: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """counted (from prefix_token_counts) with truncated: the longest prefix of text with at most `budget` tokens.

    Answered from the stored steps; nothing is encoded again. Null texts stay null.
    """

    @F.pandas_udf("long")
    def cut(steps):
        return steps.map(lambda s: longest_prefix_within(bytes(s or b""), budget))

    return counted.withColumn("truncated", F.substring(F.col(text), F.lit(1), cut("prefix_steps").cast("int")))


def over_limit(n_tokens: Column, limit: int = 4096) -> Column:
    """Whether a text has more tokens than limit."""
    return n_tokens > limit
