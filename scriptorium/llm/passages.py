"""Substring dedup: paragraphs by MinHash banding with exact Jaccard, passages by MinHash of sliding windows with exact words.

Words are runs without ASCII blanks, A-Z in lower case; positions count words. Three kinds of spans of WORDS words and more are
found: shorter ones are common phrases rather than copies.

Texts of equal words meet first, by a digest of 128 bits: each is a span as a whole, and the first of them stands for all
in what follows, so that copies of one text cost a row each.

Paragraphs are lines of WORDS words and more; shorter lines that follow each other without a blank line make up one
paragraph. Each gets a MinHash signature over five-word shingles; bands are tuned so that pairs of similarity THRESHOLD
collide with probability RECALL. Equal paragraphs meet before, by a digest of 128 bits, and count once. In each bucket all
others are compared with a centre, the one of fewest rare shingles, by the exact Jaccard similarity of their words, so near
copies of one text cost rows in proportion to their number.

Bands miss near pairs by chance, and so do centres. What they leave apart is found exactly by prefixes: of two sets of shingles in one
common order, whose similarity reaches the threshold, each has a shingle of the other among its first (1 - THRESHOLD) of them.
The order is by how often a shingle occurs in a sample of SAMPLE_TEXTS texts, then by hash, so that crowds share few prefixes; the
sample decides on cost only. Pairs that share a prefix, are not in one component yet and may have enough in common by their sizes
and places are compared by their words, too. So components are those of all pairs at the threshold.

Passages may begin and end inside paragraphs: WORDS consecutive words and more that two documents share. The units are all
windows of WORDS words, and their MinHash the least hash of GRAM words in them: neighbours have mostly the same one, so a
text has some 2 / (WORDS - GRAM + 2) of them for a word. Equal windows collide always. A window also has SIDE words before its
least gram, or SIDE after: where another document has the gram and one of its sides too, the windows that hold both are
compared by their whole words (hashes of 64 bits within buckets of 64 bits). Each shared window has as home its first occurrence; neighbouring shared windows make up a run, so a run has exactly the words shared.

Removals are clustered by components: of near paragraphs, and of runs with the runs of their windows' homes. In each cluster the
occurrence of least (doc_id, start) stays. A run is split into stretches of words that an earlier document has in a passage
and stretches first seen here, and only the latter stay: no text goes without a copy that stays.

Defined results: null and empty texts, and texts without words, have no spans. Rows without doc_id take no part. Rows that
share a doc_id but not their text are documents of their own, told apart by a hash of the text; equal rows count once.
Repeats inside one document only are left alone. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..tables import by_checked_size, discard, materialise, ship

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99
#: Words of a span, at least: passages of over 50 words.
WORDS = 51
GRAM = 25
#: Every window holds so many words before or after any GRAM of its words.
SIDE = (WORDS - GRAM) // 2
ROWS = 4
#: Words of texts worked on together, at least (a longer text is worked on alone): a call of numpy costs as much as hundreds of words.
JOINED_WORDS = 1 << 15
#: Texts whose shingles are counted, on average, and the shingles known as common, at most.
SAMPLE_TEXTS = 1 << 14
COMMON = 1 << 17

_PRIME, _MIX = 0x100000001B3, 0x9E3779B97F4A7C15
_TOP = np.uint64(1 << 63)


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of `rows` hashes in which a pair at the threshold collides with probability `recall`."""
    n = 1
    while 1 - (1 - threshold**rows) ** n < recall:
        n += 1
    return n


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(_MIX)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def lines(text: str) -> tuple[list[bytes], list[int]]:
    """All words of a text, and the word at which each line ends."""
    words: list[bytes] = []
    ends = []
    for line in text.encode().lower().split(b"\n"):
        words += line.split()
        ends.append(len(words))
    return words, ends


def paragraphs(ends: list[int], least: int = WORDS) -> list[tuple[int, int]]:
    """(start, stop) of long lines, and of short lines joined up to a blank line, a long line or the end, if they make up as many words."""
    out, held = [], 0
    for start, stop in zip([0, *ends], ends, strict=False):
        if stop == start or stop - start >= least:
            if start - held >= least:
                out.append((held, start))
            if stop - start >= least:
                out.append((start, stop))
            held = stop
    if ends and ends[-1] - held >= least:
        out.append((held, ends[-1]))
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _mixed(np.fromiter(map(crc32, words), np.uint64, len(words)))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A hash for each window of five words; one for the whole if there are fewer."""
    n = min(SHINGLE_WORDS, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(_PRIME) + hashes[j : len(hashes) - n + j + 1]
    return _mixed(out)


def _doubled(x: np.ndarray, n: int, join) -> np.ndarray:
    """join over each n neighbours of x, from joins of two spans: join(left, right, number of right)."""
    spans = {1: x}
    width = 1
    while 2 * width <= n:
        spans[2 * width] = join(spans[width][:-width], spans[width][width:], width)
        width *= 2
    out, have = spans[width], width
    while have < n:
        width = max(w for w in spans if w <= n - have)
        rest = spans[width][have:]
        out = join(out[: len(rest)], rest, width)
        have += width
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words."""
    with np.errstate(over="ignore"):
        return _mixed(_doubled(hashes, n, lambda a, b, m: a * np.uint64(pow(_PRIME, m, 1 << 64)) + b))


def candidates(hashes: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(p, c, before, after, least) of texts of WORDS words and more, joined, that end at `ends` (one text by default): where the least grams of
    windows are, their hashes, those of the gram with SIDE words before and after it (0 where there are not so many in the text), and each
    window's least hash (0 where it reaches into the next text)."""
    ends = np.array([len(hashes)]) if ends is None else ends
    sizes = np.diff(ends, prepend=0)
    end = np.repeat(ends, sizes)
    g = grams(hashes, GRAM)
    least = _doubled(g, WORDS - GRAM + 1, lambda a, b, n: np.minimum(a, b))
    least[np.arange(WORDS, WORDS + len(least)) > end[: len(least)]] = 0
    none = np.zeros(WORDS - GRAM, np.uint64)
    p = np.flatnonzero(_doubled(np.concatenate((none, least, none)), WORDS - GRAM + 1, lambda a, b, n: np.maximum(a, b)) == g)  # the least of a window that holds it
    sides = grams(hashes, GRAM + SIDE)
    before = np.where(p - SIDE >= end[p] - np.repeat(sizes, sizes)[p], sides[np.maximum(p - SIDE, 0)], 0).astype(np.uint64)
    after = np.where(p + GRAM + SIDE <= end[p], sides[np.minimum(p, len(sides) - 1)] ^ np.uint64(_MIX), 0).astype(np.uint64)
    return p, g[p].view(np.int64), before.view(np.int64), after.view(np.int64), least.view(np.int64)


def window_starts(hashes: np.ndarray, some: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, least): the windows that hold a gram and a side of it that is in `some`, and have that gram as their least. Texts as for candidates()."""
    p, c, before, after, least = candidates(hashes, ends)
    reach = WORDS - GRAM
    wanted = np.zeros(len(least), bool)
    for at, key, low, high in ((before, np.isin(before, some), reach, SIDE), (after, np.isin(after, some), reach - SIDE, 0)):
        for q, h in zip(p[key & (at != 0)].tolist(), c[key & (at != 0)].tolist(), strict=True):
            a, b = max(0, q - low), min(len(least), q - high + 1)
            if a < b:
                wanted[a:b] |= least[a:b] == h
    starts = np.flatnonzero(wanted)
    return starts, least[starts]


def signatures(s: np.ndarray, spans: np.ndarray, n_bands: int, rows: int = ROWS) -> np.ndarray:
    """For each span (start, stop in words) of shingles s: n_bands longs, equal where all hashes of a band are."""
    cuts = (spans - [0, SHINGLE_WORDS - 1]).ravel()
    s = np.append(s >> np.uint64(32), 0).astype(np.uint32)  # one more, so that a cut may stand at the end
    n = n_bands * rows
    odd = (_mixed(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = np.empty((n, len(spans)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = s * odd[i]
            h ^= h >> np.uint32(15)
            least[i] = np.minimum.reduceat(h, cuts)[::2]
        out = np.zeros((n_bands, len(spans)), np.uint64)
        for j in range(rows):
            out = out * np.uint64(_PRIME) + _mixed(least[j::rows])
        out = _mixed(out + np.arange(n_bands, dtype=np.uint64)[:, None])
    return np.ascontiguousarray(out.T).view(np.int64)


def prefixes(s: np.ndarray, spans: np.ndarray, common: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, ...]:
    """(n, rare, many, tokens): for each span of shingles s the number of different ones, how many are not in `common`, how many are first in
    order; and those, span by span: ones not in `common` by hash, then the others by rank. A token tells its place in that order.

    One more than the threshold asks for: two words of one hash may make a set smaller.
    """
    keys = s & ~_TOP
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], s.view(np.int64)), len(common[0]) - 1)
        keys = np.where(common[0][at] == s.view(np.int64), common[1][at].astype(np.uint64) | _TOP, keys)
    starts, stops = spans[:, 0], spans[:, 1] - SHINGLE_WORDS + 1
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        keys[a:b].sort()
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    new[starts] = True
    count = lambda x: np.concatenate(([0], np.cumsum(x)))
    every, low = count(new), count(new & (keys < _TOP))
    n, rare = every[stops] - every[starts], low[stops] - low[starts]
    many = np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 2)
    at = np.arange(many.sum()) + np.repeat(every[starts] - np.cumsum(many) + many, many)
    return n, rare, many, keys[np.flatnonzero(new)[at]].view(np.int64)


def prefix(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """n, rare and the tokens of prefixes() for one set of shingles."""
    n, rare, _, first = prefixes(tokens, np.array([[0, len(tokens) + SHINGLE_WORDS - 1]]), common, threshold)
    return np.concatenate((n, rare, first))


def marks(s: np.ndarray, spans: np.ndarray, n_bands: int, common: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, longs): for each span its signature, n, rare and prefix, one after the other."""
    n, rare, many, tokens = prefixes(s, spans, common, threshold)
    sizes = many + n_bands + 2
    out = np.empty(sizes.sum(), np.int64)
    at = np.cumsum(sizes) - sizes
    fixed = np.zeros(len(out), bool)
    fixed[(at[:, None] + np.arange(n_bands + 2)).ravel()] = True
    out[fixed] = np.column_stack((signatures(s, spans, n_bands), n, rare)).ravel()
    out[~fixed] = tokens
    return sizes, out


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, rank from 1: rarest first) of shingles that several sampled texts have; COMMON at most reach the driver."""
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(word_hashes(w))) for w in (lines(t)[0] for t in batch.column(0).to_pylist()) if len(w) >= WORDS]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["token"])

    some = texts.where(F.pmod(F.xxhash64("doc_id", "t", F.lit("common")), F.lit(max(1, n // SAMPLE_TEXTS))) == 0).select("text")
    counts = some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    token = rows.column("token").to_numpy()
    rank = np.arange(len(token), 0, -1)
    order = np.argsort(token)
    return token[order], rank[order]


def _offsets(words: list[bytes]) -> np.ndarray:
    """Where each word begins in the words joined by blanks."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return at


class _Joined:
    """Texts worked on together: their numbers in the batch, words, where each text ends, and each text's line ends."""

    def __init__(self) -> None:
        self.texts: list[int] = []
        self.words: list[bytes] = []
        self.ends: list[int] = []
        self.lines: list[list[int]] = []

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text within this, (start, stop) in all words) of each paragraph."""
        of, spans = [], []
        for k, (first, ends) in enumerate(zip([0, *self.ends], self.lines, strict=False)):
            own = paragraphs(ends)
            of += [k] * len(own)
            spans += [(first + a, first + b) for a, b in own]
        return np.array(of, np.int64), np.array(spans, np.int64).reshape(-1, 2)


def joined(texts: list[str]) -> Iterator[_Joined]:
    """The texts of WORDS words and more, in groups of JOINED_WORDS words or one text."""
    group = _Joined()
    for k, text in enumerate(texts):
        words, ends = lines(text)
        if len(words) < WORDS:
            continue
        group.texts.append(k)
        group.words += words
        group.ends.append(len(group.words))
        group.lines.append(ends)
        if len(group.words) >= JOINED_WORDS:
            yield group
            group = _Joined()
    if group.texts:
        yield group


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text): t is 0, or a hash of the text for ids that several texts share."""
    some = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    repeated = some.groupBy(F.col("doc_id").alias("again")).agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a < b").select("again")
    repeated = materialise(repeated, "repeated")
    n = repeated.count()
    if not n:
        return some.select("doc_id", F.lit(0).cast("long").alias("t"), "text")
    some = some.join(by_checked_size(repeated, n), F.col("doc_id") == F.col("again"), "left")
    return some.select("doc_id", F.when(F.col("again").isNotNull(), F.col("hash")).otherwise(0).alias("t"), "text")


def units(texts: DataFrame, n_bands: int, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, t, kind, start, stop, digest, marks, c, before, after. Kind 0: a paragraph, its digest, signature and prefix; kind 1: a
    least gram and its sides, each once for a text; kind 2: the whole text and its digest."""
    ship(texts.sparkSession)
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))  # 16 bytes each
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("digest", pa.binary()), ("marks", pa.list_(pa.int64())), ("c", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh128_digest
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(2)]
            spans, grams_ = [], []
            for group in joined(batch.column(2).to_pylist()):
                texts_, ends, hashes = np.array(group.texts), np.array(group.ends), word_hashes(group.words)
                p, *found = candidates(hashes, ends)[:4]
                own = np.searchsorted(ends, p, "right")
                with np.errstate(over="ignore"):
                    key = (np.stack([own, *found]).view(np.uint64) * np.array([[_mixed(np.array([1], np.uint64))[0]], [_MIX], [_PRIME], [1]], np.uint64)).sum(axis=0)
                once = np.sort(np.unique(key, return_index=True)[1])
                grams_.append([texts_[own[once]], *(x[once] for x in found)])
                line, at = b" ".join(group.words), _offsets(group.words)
                digests = lambda s: [digest(line[a : b - 1]) for a, b in zip(at[s[:, 0]].tolist(), at[s[:, 1]].tolist(), strict=True)]  # noqa: E731, B023
                whole = np.column_stack((np.concatenate(([0], ends[:-1])), ends))
                spans.append((2, texts_, whole - whole[:, :1], digests(whole), np.zeros(len(texts_), np.int64), np.empty(0, np.int64)))
                of, long = group.paragraphs()
                if len(long):
                    spans.append((0, texts_[of], long - whole[of, :1], digests(long), *marks(shingles(hashes), long, n_bands, common.value, threshold)))
            if not spans:
                continue
            kinds = np.repeat(np.array([x[0] for x in spans], np.int32), [len(x[1]) for x in spans])
            _, at, ranges, digests_, sizes, longs = ([y for x in spans for y in x[i]] if i == 3 else np.concatenate([x[i] for x in spans]) if i else None for i in range(6))
            n = len(kinds)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.append(kinds == 2, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(longs, pa.int64()))
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array(kinds), *(pa.array(ranges[:, i].astype(np.int32)) for i in range(2)), pa.array(digests_, pa.binary()), lists, none, none, none], schema=schema)
            at, c, before, after = (np.concatenate(x) for x in zip(*grams_, strict=True))
            n = len(c)
            none = lambda kind: pa.nulls(n, kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array(np.ones(n, np.int32)), none(pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.list_(pa.int64())), pa.array(c), pa.array(before), pa.array(after)], schema=schema)

    return texts.mapInArrow(run, "doc_id long, t long, kind int, start int, stop int, digest binary, marks array<long>, c long, before long, after long")


def _spans_of(texts: DataFrame, by_doc: DataFrame, column: str, width: int) -> DataFrame:
    """texts with the array `column` of by_doc (doc_id, t, column), a table with a row for each text that has something.

    Its bytes decide: `width` for each element. Within the bound it is broadcast; beyond it, texts are shuffled to it.
    """
    rows, elements = by_doc.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), column)
    joined = texts.join(by_checked_size(by_doc, 64 * rows + width * elements, 1), (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("u")))
    return joined.select("doc_id", "t", "text", column)


def _words_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, words): the words of each wanted span (doc_id, t, start, stop, id), joined by blanks."""
    by_doc = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "stop", "id")).alias("spans"))  # bounded by a text's lines
    by_doc = materialise(by_doc, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = lines(text)[0]
                for s in spans:
                    ids.append(s["id"])
                    out.append(b" ".join(words[s["start"] : s["stop"]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "words"])

    return _spans_of(texts, by_doc, "spans", 40).mapInArrow(run, "id long, words string").dropDuplicates(["id"])


def near(a: str, b: str, threshold: float) -> bool:
    """Whether the exact Jaccard similarity of two texts' five-word shingles is at least the threshold."""
    sets = []
    for words in (a.split(" "), b.split(" ")):
        n = min(SHINGLE_WORDS, len(words))
        sets.append(set(zip(*(words[j : len(words) - n + j + 1] for j in range(n)), strict=True)))
    x, y = sorted(map(len, sets))
    if x < threshold * y:
        return False
    common = len(sets[0] & sets[1])
    return common >= threshold * (x + y - common)


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs (a, b), those whose words are near."""

    @F.pandas_udf("boolean")
    def test(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([near(a, b, threshold) for a, b in zip(left, right, strict=True)], dtype=bool)

    w = lambda i, c: words.select(F.col("id").alias(i), F.col("words").alias(c))
    both = pairs.join(w("i", "left"), F.col("a") == F.col("i")).join(w("j", "right"), F.col("b") == F.col("j"))
    return both.where(test("left", "right")).select("a", "b")


def _compared(texts: DataFrame, every: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of ids, those whose words are near, as a table."""
    pairs = materialise(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).distinct()
    words = materialise(_words_of(texts, every.join(ids, F.col("id") == F.col("x"), "left_semi").select("id", "doc_id", "t", "start", "stop")), "words")
    out = materialise(_verified(pairs, words, threshold), "close")
    discard(pairs, words)
    return out


def paragraph_links(texts: DataFrame, every: DataFrame, n_bands: int, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), as a table: ids of different paragraphs of similarity >= threshold: those of the centre of each bucket with the others.

    every: a table of distinct paragraphs: id, doc_id, t, start, stop (of one occurrence), marks.
    """
    rows = every.select("id", F.element_at("marks", n_bands + 2).alias("rare"), F.explode(F.slice("marks", 1, n_bands)).alias("key"))
    first = F.min(F.struct("rare", "id"))  # what copies were made of has fewer shingles of its own than they
    centres = rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("members"), first.alias("first")).where("members > 1").select("k", F.col("first.id").alias("centre"))
    met = rows.hint("merge").join(centres, F.col("key") == F.col("k")).where("id <> centre")
    return _compared(texts, every, met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")), threshold)


def missed_links(texts: DataFrame, every: DataFrame, roots: DataFrame, n_bands: int, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), as a table: all pairs of similarity >= threshold whose roots (node, root) differ. every: as for paragraph_links()."""
    at = n_bands + 1
    rows = every.select("id", F.posexplode(F.slice("marks", at + 2, 1 << 30)).alias("place", "token"))
    own = Window.partitionBy("token")
    rows = rows.withColumns({"low": F.min("id").over(own), "high": F.max("id").over(own)}).where("low < high").select("id", "place", "token")
    rows = materialise(rows, "prefixes")  # few: most shingles are of one paragraph, and each row was shuffled once, without its root
    of = every.select(F.col("id").alias("i"), F.element_at("marks", at).cast("int").alias("n")).join(roots, F.col("i") == F.col("node"), "left").select("i", "n", F.coalesce("root", "i").alias("root"))
    table = materialise(rows.join(of, F.col("id") == F.col("i")).select("id", "place", "token", "n", "root"), "placed")
    discard(rows)
    left = table.select("token", *(F.col(c).alias(f"{c}_a") for c in ("id", "root", "n", "place"))).hint("merge")
    right = table.select(F.col("token").alias("other"), *(F.col(c).alias(f"{c}_b") for c in ("id", "root", "n", "place")))
    share = threshold / (1 + threshold)
    enough = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1 >= share * (F.col("n_a") + F.col("n_b"))  # one for words of one hash
    alike = F.least("n_a", "n_b") + 1 >= threshold * F.greatest("n_a", "n_b")
    pairs = left.join(right, (F.col("token") == F.col("other")) & (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & enough & alike)
    out = _compared(texts, every, pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), threshold)
    discard(table)
    return out


def near_paragraphs(texts: DataFrame, table: DataFrame, n_bands: int, threshold: float) -> DataFrame:
    """The spans of paragraphs that are near or equal to others, clustered."""
    place = F.struct("doc_id", "t", "start", "stop")
    every = table.groupBy("digest").agg(F.min(place).alias("first"), F.first("marks").alias("marks"))
    every = materialise(every.select(F.monotonically_increasing_id().alias("id"), F.col("digest").alias("g"), "first.*", "marks"), "paragraphs")
    links = paragraph_links(texts, every.drop("g"), n_bands, threshold)
    links = links.unionByName(missed_links(texts, every.drop("g"), components(links), n_bands, threshold))
    roots = components(links)
    named = every.select("g", "id").join(roots, F.col("id") == F.col("node"), "left").select("g", F.coalesce("root", "id").alias("cluster_id"))
    rows = table.select("doc_id", "t", "start", "stop", "digest").distinct()
    spans = rows.join(named, F.col("digest") == F.col("g")).select("doc_id", "t", F.lit("paragraph").alias("kind"), "start", "stop", "cluster_id", F.lit(False).alias("kept"))
    out = _clustered(spans)
    discard(every)
    return out


def _held_by_two(rows: DataFrame, key: str) -> DataFrame:
    """(x): values of `key` that rows of two documents and more have. Minima and maxima are partial aggregates."""
    own = F.struct("doc_id", "t")
    return rows.groupBy(F.col(key).alias("x")).agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low < high").select("x")


def _windows(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, t, start, c, h): the windows whose least gram c and one side of it another document has too, with a hash of all their words."""
    near_ = found.join(_held_by_two(found, "c"), F.col("c") == F.col("x"))
    sides = near_.select("doc_id", "t", F.explode(F.array("before", "after")).alias("side")).where("side <> 0")
    sides = materialise(sides.distinct(), "sides")
    by_doc = sides.join(_held_by_two(sides, "side"), F.col("side") == F.col("x")).groupBy("doc_id", "t").agg(F.collect_set("side").alias("some"))  # bounded by a text's words
    by_doc = materialise(by_doc, "candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            keys, wanted = [batch.column(i).to_numpy() for i in range(2)], batch.column(3)
            for group in joined(batch.column(2).to_pylist()):
                some = np.unique(pa.compute.list_flatten(wanted.take(pa.array(group.texts))).to_numpy())  # a text that has another's side has it in its own list, too
                ends = np.array(group.ends)
                starts, least = window_starts(word_hashes(group.words), some, ends)
                if not len(starts):
                    continue
                line, at = b" ".join(group.words), _offsets(group.words)
                h = np.fromiter((digest(line[a : b - 1]) for a, b in zip(at[starts].tolist(), at[starts + WORDS].tolist(), strict=True)), np.uint64, len(starts))
                of = np.searchsorted(ends, starts, "right")
                first = np.concatenate(([0], ends[:-1]))[of]
                yield pa.RecordBatch.from_arrays([*(pa.array(k[np.array(group.texts)[of]]) for k in keys), pa.array((starts - first).astype(np.int32)), pa.array(least), pa.array(h.view(np.int64))], ["doc_id", "t", "start", "c", "h"])

    return _spans_of(texts, by_doc, "some", 8).mapInArrow(run, "doc_id long, t long, start int, c long, h long")


def segments(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, t, run, new, home, shift, a, b), as a table: shared windows from start a to b whose first occurrence is in the document
    `home`, `shift` words before; `new`: that is this document. Windows of neighbouring starts make up a run."""
    every = materialise(_windows(texts, found), "windows")
    place = F.struct("doc_id", "t", "start")
    key = F.struct("doc_id", "t")
    homes = every.groupBy(F.col("c").alias("x"), F.col("h").alias("y")).agg(F.min(place).alias("home"), F.max(key).alias("last")).where("struct(home.doc_id, home.t) < last").select("x", "y", "home")
    again = every.join(homes, (F.col("c") == F.col("x")) & (F.col("h") == F.col("y")))
    new = (F.col("home.doc_id") == F.col("doc_id")) & (F.col("home.t") == F.col("t"))
    again = again.select("doc_id", "t", "start", new.alias("new"), F.col("home.doc_id").alias("home_doc"), F.col("home.t").alias("home_t"), (F.col("start") - F.col("home.start")).alias("shift"))
    order = lambda *by: F.dense_rank().over(Window.partitionBy("doc_id", "t", *by).orderBy("start"))  # noqa: E731  a document's own words
    again = again.withColumns({"run": F.col("start") - order(), "island": F.col("start") - order("new")})
    out = again.groupBy("doc_id", "t", "run", "new", "island", "home_doc", "home_t", "shift").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    out = materialise(out.select("doc_id", "t", "run", "new", "island", "home_doc", "home_t", "shift", "a", "b"), "segments")
    discard(every)
    return out


def stretches(parts: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, t, run, start, stop, kept): the words of each run, cut into those that an earlier document has and those first seen here.

    Words in a passage that an earlier document has count as repeated, even if a passage first seen here has them too.
    """
    parts = parts.groupBy("doc_id", "t", "run", "new", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    run = Window.partitionBy("doc_id", "t", "run")
    parts = parts.withColumns({"from": F.min("a").over(run), "to": F.max("b").over(run)})
    begin = F.expr(f"IF(new AND a > from, a + {words - 1}, a)")
    end = F.expr(f"IF(new AND b < to, b + 1, b + {words})")
    parts = parts.select("doc_id", "t", "run", "new", begin.alias("start"), end.alias("stop")).where("start < stop")
    order = run.orderBy("start")
    parts = parts.withColumn("other", F.coalesce(F.col("new") != F.lag("new").over(order), F.lit(False)).cast("int"))
    parts = parts.withColumn("part", F.sum("other").over(order))
    return parts.groupBy("doc_id", "t", "run", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("new").alias("kept")).drop("part")


def shared_passages(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, t, kind, start, stop, cluster_id, kept) of all runs' stretches; runs that have words in common share a cluster."""
    parts = segments(texts, found)
    runs = parts.groupBy("doc_id", "t", "run").agg(F.min("a").alias("from"), F.max("b").alias("to"))
    runs = materialise(runs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").alias("d"), F.col("t").alias("u"), F.col("run").alias("r"), "from", "to"), "runs")
    away = parts.where("NOT new").join(runs.select(F.col("id").alias("a_run"), "d", "u", "r"), (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("u")) & (F.col("run") == F.col("r"))).drop("d", "u", "r")
    home = (F.col("home_doc") == F.col("d")) & (F.col("home_t") == F.col("u")) & (F.col("a") - F.col("shift")).between(F.col("from"), F.col("to"))
    roots = components(away.join(runs, home).select(F.col("a_run").alias("x"), F.col("id").alias("y")).distinct())
    named = runs.join(roots, F.col("id") == F.col("node"), "left").select("d", "u", "r", F.coalesce("root", "id").alias("cluster_id"))
    cut = stretches(parts)
    out = cut.join(named, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("u")) & (F.col("run") == F.col("r")))
    return out.select("doc_id", "t", F.lit("passage").alias("kind"), "start", "stop", "cluster_id", "kept")


def _clustered(spans: DataFrame) -> DataFrame:
    """Spans with a cluster: those of clusters in two documents and more, and whether they stay (the first does anyhow)."""
    spans = materialise(spans, "spans")
    key = F.struct("doc_id", "t")
    sizes = spans.groupBy(F.col("cluster_id").alias("c")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.min(F.struct("doc_id", "t", "start")).alias("first"), F.count("*").alias("cluster_size")).where("low < high")
    sizes = materialise(sizes.select("c", "first", "cluster_size"), "clusters")
    out = spans.join(sizes, F.col("cluster_id") == F.col("c"))
    kept = F.col("kept") | (F.struct("doc_id", "t", "start") == F.col("first"))
    return out.select("doc_id", "kind", "start", "stop", "cluster_id", "cluster_size", F.col("first.doc_id").alias("keep_doc_id"), kept.alias("kept"))


def equal_texts(whole: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(spans of all texts that are equal to others; (d, u) of all but the first of each, as a table; its rows). whole: rows of kind 2."""
    key = F.struct("doc_id", "t")
    whole = whole.select("doc_id", "t", "start", "stop", "digest").distinct()
    same = whole.groupBy(F.col("digest").alias("g")).agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first < last")
    same = materialise(same.select(F.monotonically_increasing_id().alias("cluster_id"), "g", "first"), "same")
    members = whole.join(same, F.col("digest") == F.col("g"))
    copied = materialise(members.where(key != F.col("first")).select(F.col("doc_id").alias("d"), F.col("t").alias("u")), "copied")
    spans = members.select("doc_id", "t", F.lit("text").alias("kind"), "start", "stop", "cluster_id", F.lit(False).alias("kept"))
    return _clustered(spans), copied, copied.count()


def repeated_spans(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, kind, start, stop (words), cluster_id, cluster_size, keep_doc_id, kept: the spans that repeat across documents."""
    ship(docs.sparkSession)
    n_bands, texts = bands(threshold, recall), keyed(docs)
    table = materialise(units(texts, n_bands, threshold), "units", "kind")
    by_text, copied, n = equal_texts(table.where("kind = 2"))
    once = lambda kind: table.where(F.col("kind") == kind).join(by_checked_size(copied, n, 96), (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("u")), "left_anti")
    by_paragraph = near_paragraphs(texts, once(0).select("doc_id", "t", "start", "stop", "digest", "marks"), n_bands, threshold)
    by_passage = _clustered(shared_passages(texts, once(1).select("doc_id", "t", "c", "before", "after")))
    return by_text.unionByName(by_paragraph).unionByName(by_passage)


def passages_query(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs)
