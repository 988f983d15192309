"""Byte-level BPE encoding and decoding by prefix dynamic programming.

BPE gives every prefix of a piece of text exactly one encoding. A table therefore stores, for each byte prefix, its
unique valid last token: the token t that ends there such that the prefix before t is encodable, and merging t's
bytes with those of that prefix's own last token would give the same two tokens again. Following last tokens back
from the end gives the encoding. Bytes appended extend the table; bytes edited change it from the edit on, and only
until it agrees with the old one over the longest token's length. Work is linear in the piece's length, however long.

Text is first cut by the tokenizer's pattern; each match is encoded on its own. Pieces recur, so their ids are kept
in a cache of bounded size for each worker.

Defined results: null texts count as empty; empty texts have no ids, and hashes of the empty string. Repeated rows are encoded
each; texts may be of any length. Empty tables give empty results. round_trip() ignores extra columns; encoded() and decoded()
keep them, but for one named `token_ids` or `decoded`, which they replace.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import ship

RANKS = "byte_bpe_50k.tiktoken"
#: Words, pieces and pairs of tokens whose results a worker keeps; together some 100 MB.
WORDS, PIECES, PAIRS = 200_000, 200_000, 200_000
#: Bytes of a piece that is kept, at most.
SHORT = 64
#: The rank of a merge that doesn't exist.
NEVER = 1 << 60


class _Whole(dict):
    """By id, whether a token's own bytes merge to it."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary

    def __missing__(self, token: int) -> bool:
        self[token] = known = self.v.spine(self.v.bytes_of[token]) is not None
        return known


class Vocabulary:
    """Ranks by bytes, and what the table needs to know about tokens and pairs of them.

    As in any trained BPE, a token must rank above the two that merge to it; check() tests a vocabulary for that.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.spines: dict[bytes, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None] = {}
        self.pairs: dict[int, bool] = {}
        ends = ahocorasick.Automaton()  # finds all tokens that end at each byte, in one pass
        for token, i in ranks.items():
            ends.add_word(token.decode("latin-1"), (i, len(token)))
        ends.make_automaton()
        self.ends = ends
        self.whole = _Whole(self)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """BPE by its definition: the lowest-ranked adjacent pair first, leftmost among equals. For token-sized bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, token: bytes):
        """What stands at the token's left and at its right edge while its bytes merge, from its first byte on, each with the rank
        of the merge that ends it; None if the bytes don't merge to the token."""
        known = self.spines.get(token, 0)
        if known != 0:
            return known
        if len(token) == 1:
            out = ([(token, NEVER)], [(token, NEVER)])
        else:
            halves, out, rank = self.merged(token, 2), None, self.ranks[token]
            if len(halves) == 2:
                a, b = (self.spine(h) for h in halves)
                if a and b:
                    out = ([*a[0][:-1], (halves[0], rank), (token, NEVER)], [*b[1][:-1], (halves[1], rank), (token, NEVER)])
        self.spines[token] = out
        return out

    def check(self) -> bool:
        """Whether every token that its bytes merge to ranks above what merges to it."""
        return all(s is None or all(a < b for edge in s for a, b in zip([r for _, r in edge], [r for _, r in edge][1:], strict=False)) for s in map(self.spine, self.ranks))

    def adjacent(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay apart and whole when their bytes stand together.

        Merges happen in order of rank. So the right edge of `left` and the left edge of `right` grow step by step, and
        the tokens stay apart unless at some step the pair across the border has a lower rank than the next step's
        merge (at equal rank, the leftmost merges first).
        """
        a, b = self.spine(left), self.spine(right)
        if a is None or b is None:
            return False
        ends, starts, ranks, i, j = a[1], b[0], self.ranks, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = ends[i], starts[j]
            across = ranks.get(x + y, NEVER)
            if across < x_ends and across <= y_ends and across < NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            if y_ends <= x_ends:
                j += 1


    def fits(self, before: int, token: int) -> bool:
        """adjacent() by ids, remembered."""
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            known = self.adjacent(self.bytes_of[before], self.bytes_of[token])
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def extend(self, data: bytes, last: list[int]) -> None:
        """last: the ids of the valid last tokens of data[:1], data[:2], ...; add those of the longer prefixes."""
        done = len(last)
        last += [-1] * (len(data) - done)
        from_ = max(0, done + 1 - self.longest)
        pairs, whole = self.pairs.get, self.whole
        for end, (token, size) in self.ends.iter(data[from_:].decode("latin-1")):
            end += from_
            if last[end] < 0:
                start = end - size
                if start >= 0:
                    before = last[start]
                    known = pairs(before << 32 | token)
                    if known or known is None and self.fits(before, token):
                        last[end] = token
                elif whole[token]:
                    last[end] = token

    def follow(self, last: list[int]) -> list[int]:
        """The ids of the whole, from the last tokens of its prefixes."""
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            if token < 0:
                raise ValueError(f"no token ends at byte {end}")
            out.append(token)
            end -= len(self.bytes_of[token])
        return out[::-1]


class PrefixTable:
    """The last token of every prefix of some bytes, kept exact under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.v.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put `new` for bytes start:stop. Returns how many entries were computed again."""
        tail, rest, step = self.last[stop:], self.data[stop:], 4 * self.v.longest
        self.data, self.last = self.data[:start] + new, self.last[:start]
        self.v.extend(self.data, self.last)
        at = same = 0
        while at < len(tail):
            self.append(rest[at : at + step])
            for old in range(at, min(len(tail), at + step)):
                # Entries depend on bytes and entries within the longest token only: equal that far back, equal from here on.
                same = same + 1 if tail[old] == self.last[start + len(new) + old] else 0
            at = min(len(tail), at + step)
            if same >= self.v.longest:
                break
        computed = len(self.last) - start
        self.data += rest[at:]
        self.last += tail[at:]
        return computed

    def ids(self) -> list[int]:
        return self.v.follow(self.last)


class Encoder:
    """Texts to ids and back.

    With the usual patterns (` ?\\p{L}+` and the like; `spaced` says so), a single space between two characters that
    aren't blank always starts a match, whatever follows. So texts are first cut there; what stands between two such
    spaces is cut by the pattern and encoded once, then kept. A space and letters only are one match.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, spaced: bool = True):
        self.v = vocabulary
        self.spaced = spaced
        self.pieces = regex.compile(pattern).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> Sequence[int]:
        """The ids of one match of the pattern."""
        ids = self.known.get(text)
        if ids is None:
            data = text.encode()
            whole = self.v.ranks.get(data)
            if whole is not None:
                ids = [whole]
            else:
                last: list[int] = []
                self.v.extend(data, last)
                ids = self.v.follow(last)
            if len(data) <= SHORT:
                if len(self.known) >= PIECES:
                    self.known.clear()
                self.known[text] = tuple(ids)
        return ids

    def matches(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece(p)]

    def encode(self, text: str) -> list[int]:
        first, *rest = text.split(" ")
        if not self.spaced or not rest or not first or first[-1].isspace():
            return self.matches(text)
        out = self.matches(first)
        words, extend = self.words, out.extend
        for w in rest:
            ids = words.get(w)
            if ids is None:
                if not w or w[0].isspace() or w[-1].isspace():  # a run of blanks: the pattern must see all of it
                    return self.matches(text)
                ids = self.piece(" " + w) if w.isalpha() else self.matches(" " + w)
                if len(w) <= SHORT:
                    if len(words) >= WORDS:
                        words.clear()
                    words[w] = ids = tuple(ids)
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.load(path), pattern, r" ?\p{L}+" in pattern)


def default_path() -> str:
    """Where the ranks lie on this machine: a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_ROUND_TRIP = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of docs and `token_ids`, an array of ints."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path or default_path(), pattern or default_pattern())  # the executor's own file, unless a path is given
        for texts in batches:
            yield pd.Series([e.encode(t) for t in texts])

    return docs.withColumn("token_ids", ids(F.coalesce("text", F.lit(""))))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path or default_path(), pattern or default_pattern())
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for t in batch.column(1):
                ids = e.encode(t.as_py() or "")
                n.append(len(ids))
                of_ids.append(sha(" ".join(map(str, ids)).encode()))
                of_text.append(sha(e.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=_ROUND_TRIP.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROUND_TRIP)


def decoded(frame: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of a frame with `token_ids`, and `decoded`, the bytes they stand for; null ids give null."""
    ship(frame.sparkSession)

    @F.pandas_udf("binary")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = encoder(path or default_path(), default_pattern()).v.bytes_of
        for rows in batches:
            yield pd.Series([None if ids is None else b"".join(of[int(i)] for i in ids) for ids in rows], dtype=object)

    return frame.withColumn("decoded", back(F.col("token_ids")))
