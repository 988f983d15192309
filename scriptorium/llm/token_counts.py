"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where both sides prove to agree.

A tokenizer of this kind first takes out its special strings, then cuts the rest into words by a pattern that looks
ahead but never back, then encodes each word on its own. So two encodings that both start a word at the same place go on
alike from there, as long as both see what follows. Texts over `huge` characters (some 7 % of those of the check tables) are encoded in chunks that
overlap by `overlap` characters, with offsets and word numbers. A place counts as a proven common boundary if

- both chunks start a word there,
- it lies MARGIN characters past the later chunk's start, so that no special string or word that began before it is
  cut in half there, and
- it lies MARGIN characters before the earlier chunk's end, so that what ended there ended for what follows.

The earlier chunk counts up to it, the later one from it on. Where there is no such place, the later chunk starts
further back and the earlier one ends further on, twice as far each time, until the two are aligned or are one.

Other texts are counted by words, whose counts a worker keeps.

Defined results: null texts count as empty; empty texts have no bytes and no tokens. Repeated rows are counted each. Empty
tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ship

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters beyond which a text is encoded in chunks, and their size and first overlap.
HUGE = 1 << 13
CHUNK = 1 << 13
OVERLAP = 1 << 8
#: More than the longest special string and than the pattern looks ahead.
MARGIN = 64
#: Texts encoded in one call of the library, by characters.
BATCH_CHARS = 1 << 20
#: Words encoded in one call, and words whose counts a worker keeps.
BATCH_WORDS = 1 << 14
CACHE = 800_000


@lru_cache(4)
def load(path: str):
    """(tokenizer, the same with offsets that keep blanks)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors

    plain, exact = Tokenizer.from_file(path), Tokenizer.from_file(path)
    for t in (plain, exact):
        t.no_truncation()
        t.no_padding()
    exact.post_processor = processors.ByteLevel(trim_offsets=False)
    return plain, exact


class Chunk:
    """text[start:stop], encoded: for each word its start in the whole text and the tokens before it; the text's own start counts as one."""

    def __init__(self, exact, text: str, start: int, stop: int):
        self.start, self.stop = start, min(stop, len(text))
        e = exact.encode(text[start : self.stop], add_special_tokens=False)
        self.tokens = len(e.ids)
        self.words: dict[int, int] = {} if start else {0: 0}
        last: object = self
        for i, (w, (at, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if w != last or w is None:
                self.words.setdefault(start + at, i)
                last = w


def count(tokenizers, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text, as the library gives it for the whole."""
    plain, exact = tokenizers
    if len(text) <= chunk:
        return len(plain.encode(text, add_special_tokens=False).ids)
    total, here = 0, Chunk(exact, text, 0, chunk)
    begin = 0  # the place from which `here` counts
    while here.stop < len(text):
        wide = overlap
        while True:
            then = Chunk(exact, text, max(begin, here.stop - wide), here.stop + chunk)
            low = then.start + (MARGIN if then.start > 0 else 0)
            common = [at for at in then.words if low <= at <= here.stop - MARGIN and at > begin and at in here.words]
            if common:
                break
            wide *= 2
            here = Chunk(exact, text, here.start, here.stop + wide)
            if here.stop == len(text):
                return total + here.tokens - here.words[begin]
        cut = max(common)
        total += here.words[cut] - here.words[begin]
        here, begin = then, cut
    return total + here.tokens - here.words[begin]


class Counter:
    """Token counts by word for a worker. Most text is words seen before.

    A single space between two characters that aren't blank always starts a word, and no special string holds a space.
    So what stands between two such spaces is encoded once by the library, in batches, and its count kept.
    """

    def __init__(self, tokenizers):
        self.tokenizers = tokenizers
        self.known: dict[str, int] = {}
        added = tokenizers[0].get_added_tokens_decoder().values()
        self.splits = not any(t.lstrip or t.rstrip or " " in t.content for t in added)

    def encode(self, texts: list[str]) -> list[int]:
        """The library's counts."""
        return [len(e) for e in self.tokenizers[0].encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Of texts that are not huge."""
        parts = [(first, rest) if self.splits and rest and first and not first[-1].isspace() and all(w and not w[0].isspace() and not w[-1].isspace() for w in set(rest)) else (t, []) for t in texts for first, *rest in (t.split(" "),)]
        known = self.known
        new = list({w for _, rest in parts for w in rest if w not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({w for _, rest in parts for w in rest})
        for at in range(0, len(new), BATCH_WORDS):
            words = new[at : at + BATCH_WORDS]
            known.update(zip(words, self.encode([" " + w for w in words]), strict=True))
        firsts = self.encode([first for first, _ in parts])
        get = known.__getitem__
        return [n + sum(map(get, rest)) for n, (_, rest) in zip(firsts, parts, strict=True)]


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(load(path))


def counts(own: Counter, texts: list[str], huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Of each text; the ones that are not huge in batches of bounded size."""
    out, batch, size = [0] * len(texts), [], 0
    for i, t in enumerate(texts):
        if len(t) > huge:
            out[i] = count(own.tokenizers, t, chunk, overlap)
        elif t:
            batch.append(i)
            size += len(t)
        if batch and (size >= BATCH_CHARS or i == len(texts) - 1):
            for k, n in zip(batch, own.count([texts[k] for k in batch]), strict=True):
                out[k] = n
            batch, size = [], 0
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path or default_path())  # the executor's own file, unless a path is given
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counts(own, texts, huge, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
