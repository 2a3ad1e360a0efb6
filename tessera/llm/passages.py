"""Repeated passages: word windows that also start in a document with a smaller id.

Both operators here send every window of `length` words to one place by content:

* the minimiser of a window is its m-gram of words with the least hash (leftmost on ties);
* consecutive windows with the same minimiser position form one super-k-mer: a string of
  length + k - 1 words that stands for k windows;
* super-k-mers travel as packed strings to the bucket of their minimiser. A map task keeps equal strings once, with the
  least and greatest doc_id they occur in, and packs the strings of a bucket into one zstandard blob. So a passage that a
  third of all documents share is one string for each blob, not one for each document.

m-grams that are frequent in the whole corpus (licence lines, menus) are the last choice as minimisers; windows that hold
nothing else are the same passages, whose strings are equal. A bucket's blobs come sorted and are read one bucket at a time.

Of a bucket's strings the two operators find, for each window, the least doc_id it starts in:

* substring dedup sorts the windows of all strings; equal ones are neighbours (compared as bytes);
* suffix-array dedup sorts the suffixes that begin at the strings' minimisers, and their left contexts from right to left,
  and computes how many words neighbours have in common. Two strings match from `left` words before to `right` words after the start
  of the minimiser, which is the least of what neighbours between them have in common in either order. A window that
  begins o words before the minimiser is shared by those strings that no neighbour with fewer than o words to the
  left, or length - o to the right, lies between.

What comes back is a row for each run of windows of a distinct string: its 128-bit digest, the run, the least doc_id. Documents are
read again and their super-k-mers looked up: in a broadcast table if that is small in bytes, else by a join
of digests, whose hot keys Spark splits, since each occurrence is a row of its own.

Results of both: a word is removed if it is covered by a window whose word sequence also starts in a
document with a smaller doc_id. Windows are judged on the input, so removal in one document does not
change another's. Null or empty text has no words. Rows with null doc_id match nothing and keep all
words. Repeated rows with one doc_id do not remove each other. Extra columns pass through `remove`; those named like
a column it adds are replaced. An empty table gives an empty table. A very long text is cut into the same super-k-mers as others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import shared, words

#: Words of a window, and of a minimiser.
LENGTH, GRAM = 50, 3
#: An m-gram is frequent if it is at least this part of all m-grams: so at most 1 / PART are, a bounded list (3 MB).
PART = 1 / 400_000
#: m-grams counted at once by a task.
COUNTED = 1 << 21
#: Bytes of packed strings that a task holds before it writes blobs, and that are compared at once.
HELD, CHUNK = 16 << 20, 4 << 20
#: Bytes of the table of found runs that may be broadcast, and of one of its rows.
TABLE, ROW = 32 << 20, 40
#: log2 of the bits of the filter that lets a digest's occurrences through to the join beyond that.
FILTER = 26


def frequent(docs: DataFrame, gram: int, part: float = PART, least: int = 50, fold: bool = False, counts: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Hashes of the word m-grams that make up at least `part` of all m-grams of all texts, sorted.

    Each task counts all its m-grams in groups and reports those that reach the part within a group:
    what reaches it over all does so in some group. At most 1 / part values come back; with `counts`, their counts too."""
    alphabet = words.LOWER if fold else words.SAME

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(2, int(n.sum() * part))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(values[keep], np.uint64(0)).view(np.int64)), pa.array(np.append(n[keep], n.sum())), pa.array(np.append(np.ones(keep.sum(), bool), False))],
                ["gram", "n", "is_gram"],
            )

        for batch in batches:
            for _, texts in words.slices(batch.column(0)):
                w = words.split(texts, fold=alphabet)
                g = words.windows(w.hashes(), gram)
                g = g[words.same_row(w.doc, gram)]
                held.append(g)
                size += len(g)
                if size >= COUNTED:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    found = docs.select("text").mapInArrow(count, "gram long, n long, is_gram boolean").groupBy("gram", "is_gram").agg(F.sum("n").alias("n"))
    found = shared.cut(found)
    total = found.where("NOT is_gram").agg(F.sum("n")).head()[0] or 0
    rows = found.where(F.col("is_gram") & (F.col("n") >= max(least, int(total * part)))).select("gram", "n").toArrow()
    values, n = (rows.column(c).to_numpy() for c in ("gram", "n"))
    values = values.view(np.uint64)
    order = np.argsort(values)
    return (values[order], n[order]) if counts else values[order]


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def super_kmers(w: words.Words, length: int, gram: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of the minimiser, its position, first word, end word, row) of each super-k-mer of a slice."""
    h = w.hashes()
    g = words.windows(h, gram)
    if len(h) < length:
        return (g[:0], *[np.empty(0, dtype=np.int64)] * 4)
    rank = (g >> np.uint64(33) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    rank |= member(g, common).astype(np.uint64) << np.uint64(63)
    least = words.sliding_min(rank, length - gram + 1)
    inside = words.same_row(w.doc, length)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(new & inside)
    last = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
    return g[at[begin]], at[begin], begin, last + length, w.doc[begin]


_HEAD = np.dtype([("key", "<u8"), ("low", "<i8"), ("high", "<i8"), ("digest", "S16"), ("words", "<i4"), ("anchor", "<i4"), ("size", "<i4")])
_FOUND = "digest binary, first int, last int, least long"


class Strings:
    """Distinct strings, each with its minimiser, the words before that and in all, and the least and greatest doc_id."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.rows: list[tuple[int, int, int]] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.size = 0

    def add(self, digest: bytes, text: bytes, row: tuple[int, int, int], low: int, high: int) -> None:
        i = self.at.setdefault(digest, len(self.texts))
        if i == len(self.texts):
            self.texts.append(text)
            self.rows.append(row)
            self.low.append(low)
            self.high.append(high)
            self.size += len(text)
        else:
            if low < self.low[i]:
                self.low[i] = low
            if high > self.high[i]:
                self.high[i] = high

    def head(self) -> np.ndarray:
        out = np.empty(len(self.texts), dtype=_HEAD)
        key, words_, anchor = zip(*self.rows, strict=True) if self.rows else ((), (), ())
        out["key"], out["words"], out["anchor"] = np.array(key, dtype=np.uint64), words_, anchor
        out["low"], out["high"], out["digest"] = self.low, self.high, np.array(list(self.at), dtype="S16")
        out["size"] = [len(t) for t in self.texts]
        return out


def _cut(w: words.Words, length: int, gram: int, common: np.ndarray) -> Iterator[tuple[bytes, bytes, tuple[int, int, int], int, int]]:
    """(digest, text, (minimiser, words, words before it), row, first word in the row) of a slice's super-k-mers."""
    key, at, first, end, row = super_kmers(w, length, gram, common)
    raw = w.text.tobytes()
    columns = (key, end - first, at - first, w.starts[first] if len(first) else first, w.ends[end - 1] if len(end) else end, row, first - w.first[row])
    for k, n, anchor, a, b, r, f in zip(*(c.tolist() for c in columns), strict=True):
        text = raw[a:b]
        yield xxhash.xxh3_128_digest(text), text, (k, n, anchor), r, f


def _emit(length: int, gram: int, buckets: int, common: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        held = Strings()

        def flush():
            head = held.head()
            bucket = (words.mix(head["key"]) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((head["key"], bucket))
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for rows in np.split(order, cuts[1:]):
                blob = len(rows).to_bytes(8, "little") + head[rows].tobytes() + b"".join([held.texts[i] for i in rows.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[rows[0]])]), pa.array([packer.compress(blob)], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            ids = batch.column(0)
            known, ids = ids.is_valid().to_pylist(), ids.fill_null(0).to_pylist()
            for begin, texts in words.slices(batch.column(1)):
                w = words.split([t if known[begin + i] else b"" for i, t in enumerate(texts)])
                for digest, text, about, row, _ in _cut(w, length, gram, common.value):
                    doc = ids[begin + row]
                    held.add(digest, text, about, doc, doc)
                if held.size >= HELD:
                    yield from flush()
                    held = Strings()
        if held.texts:
            yield from flush()

    return emit


def _read(held: Strings, blob: bytes) -> None:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(blob[:8], "little")
    head = np.frombuffer(blob, dtype=_HEAD, count=n, offset=8)
    ends = (np.cumsum(head["size"], dtype=np.int64) + 8 + n * _HEAD.itemsize).tolist()
    digests = head["digest"].tobytes()
    for i, (key, low, high, size, n_words, anchor) in enumerate(zip(*(head[c].tolist() for c in ("key", "low", "high", "size", "words", "anchor")), strict=True)):
        held.add(digests[16 * i : 16 * i + 16], blob[ends[i] - size : ends[i]], (key, n_words, anchor), low, high)


def sorted_windows(texts: list[bytes], anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, window, least doc_id it starts in) of windows that start in two documents or more, by sorting all windows."""
    w = words.split(texts)
    value = words.windows(w.hashes(), length)
    at = np.flatnonzero(words.same_row(w.doc, length))
    value, owner = value[at], w.doc[at]
    order = np.argsort(value, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(value[order]) != 0)) if len(order) else np.empty(0, dtype=np.int64)
    if not len(cuts):
        return (np.empty(0, dtype=np.int64),) * 3
    least, most = np.minimum.reduceat(low[owner[order]], cuts), np.maximum.reduceat(high[owner[order]], cuts)
    sizes = np.diff(np.append(cuts, len(order)))
    found = np.zeros(len(order), dtype=np.int64)
    found[order] = np.repeat(least, sizes)
    hit = np.zeros(len(order), dtype=bool)
    hit[order] = np.repeat(least < most, sizes)
    raw, begins, ends = w.text.tobytes(), w.starts[at], w.ends[at + length - 1]
    for g in np.flatnonzero((least < most) & (sizes > 1)).tolist():
        rows = order[cuts[g] : cuts[g] + sizes[g]].tolist()
        cut = [raw[a:b] for a, b in zip(begins[rows].tolist(), ends[rows].tolist(), strict=True)]
        if cut.count(cut[0]) < len(cut):  # different windows with one hash
            for x in set(cut):
                same = [r for r, c in zip(rows, cut, strict=True) if c == x]
                found[same] = low[owner[same]].min()
    hit &= found < high[owner]
    return owner[hit], at[hit] - w.first[owner[hit]], found[hit]


def _shared_words(a: bytes, b: bytes) -> int:
    """Whole words that two strings, in which a space follows every word, begin with."""
    n = min(len(a), len(b))
    differ = (int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length()
    return a.count(b" ", 0, n - (differ + 7) // 8)


def _sorted_with_common(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings in sorted order, and the words each has in common with its neighbour before."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    common = [0] + [_shared_words(strings[i], strings[j]) for i, j in zip(order, order[1:])]
    return np.array(order), np.array(common)


def sorted_suffixes(texts: list[bytes], anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, window, least doc_id it starts in) of windows that start in two documents or more, from the common prefixes of
    sorted suffixes at the strings' minimisers, extended to the left by those of the sorted left contexts."""
    right, left = [], []
    for text, k in zip(texts, anchor.tolist(), strict=True):
        suffix = text.split(b" ", k)[-1]
        right.append(suffix + b" ")
        left.append((b" " + text[: len(text) - len(suffix) - 1])[::-1] if k else b"")
    n = anchor + np.array([x.count(b" ") for x in right])
    by_right, common_right = _sorted_with_common(right)
    by_left, common_left = _sorted_with_common(left)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64),) * 3]
    right_group, left_group = np.empty(len(texts), dtype=np.int64), np.empty(len(texts), dtype=np.int64)
    for before in range(length - gram + 1):
        has = np.flatnonzero((anchor >= before) & (n - anchor >= length - before))
        if not len(has):
            continue
        # neighbours with that many words in common on both sides share the window
        right_group[by_right] = np.cumsum(common_right < length - before)
        left_group[by_left] = np.cumsum(common_left < before)
        key = right_group[has] * (len(texts) + 1) + left_group[has]
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        least = np.repeat(np.minimum.reduceat(low[has[order]], cuts), np.diff(np.append(cuts, len(order))))
        rows = has[order]
        hit = least < high[rows]
        found.append((rows[hit], anchor[rows[hit]] - before, least[hit]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


Work = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def bucket_runs(held: Strings, work: Work, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(digest, first window, last window, least doc_id) of runs of windows, for a bucket's strings. Strings are compared in chunks of
    whole minimisers; those whose minimiser is in one document only are left out."""
    head = held.head()
    order = np.argsort(head["key"], kind="stable")
    key = head["key"][order]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(cuts[1:], len(order))
    many = np.minimum.reduceat(head["low"][order], cuts) < np.maximum.reduceat(head["high"][order], cuts)
    sizes = np.add.reduceat(head["size"][order].astype(np.int64), cuts)
    some: list[np.ndarray] = []
    size = 0
    for a, b, s in [*zip(cuts[many].tolist(), ends[many].tolist(), sizes[many].tolist(), strict=True), (0, 0, CHUNK)]:
        if some and size + s > CHUNK:
            rows = np.concatenate(some)
            h = head[rows]
            owner, window, least = work([held.texts[i] for i in rows.tolist()], h["anchor"].astype(np.int64), h["low"], h["high"], length, gram)
            if len(owner):
                sort = np.lexsort((window, owner))
                owner, window, least = owner[sort], window[sort], least[sort]
                new = np.append(True, (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1]))
                begin = np.flatnonzero(new)
                yield h["digest"][owner[begin]], window[begin], window[np.append(begin[1:], len(window)) - 1], least[begin]
            some, size = [], 0
        some.append(order[a:b])
        size += s


def _reduce(work: Work, length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Strings(), None

        def close():
            for digest, first, last, least in bucket_runs(held, work, length, gram):
                raw = digest.tobytes()
                digests = pa.array([raw[16 * i : 16 * i + 16] for i in range(len(digest))], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(least)], ["digest", "first", "last", "least"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held.texts:
                    yield from close()
                    held = Strings()
                now = bucket
                _read(held, blob.as_py())
        if held.texts:
            yield from close()

    return reduce


@dataclass
class Repeats:
    """Runs of windows of distinct super-k-mers that a document with a smaller id has too, and how texts are cut into super-k-mers."""

    runs: DataFrame
    common: Broadcast
    length: int
    gram: int


def repeats(docs: DataFrame, work: Work, length: int = LENGTH, gram: int = GRAM) -> Repeats:
    """The repeated windows of all documents, found by `work`."""
    spark = docs.sparkSession
    shared.lean(spark)
    n = shared.partitions(spark, 3 * shared.text_bytes(docs))
    common = spark.sparkContext.broadcast(frequent(docs, gram))
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_emit(length, gram, 4 * n, common), "bucket long, blob binary")
    found = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_reduce(work, length, gram), _FOUND)
    return Repeats(shared.cut(found), common, length, gram)


def substring_repeats(docs: DataFrame, length: int = LENGTH) -> Repeats:
    """Substring dedup by super-k-mer partitioning: windows of `length` words, counted by sorting."""
    return repeats(docs, sorted_windows, length)


def suffix_repeats(docs: DataFrame, length: int = LENGTH) -> Repeats:
    """Suffix-array dedup by sparse suffix arrays: matches of `length` words or more around minimisers."""
    return repeats(docs, sorted_suffixes, length)


_ADDED = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]


def _kept(names: list[str], flags: Callable[[pa.RecordBatch], Callable[[int, words.Words], dict[int, np.ndarray]]]):
    """A function of batches that cuts the words flagged out of texts. flags(batch) gives a function of (first row of a
    slice, its words) that returns which words of which rows go."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = flags(batch)
            for begin, texts in words.slices(batch.column("text")):
                w = words.split(texts)
                found = of(begin, w)
                kept, gone = [], []
                for i in range(len(texts)):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    if i in found:
                        gone.append(int(found[i].sum()))
                        kept.append(b" ".join(w.joined(a + x, a + y) for x, y in zip(*words.runs(~found[i]), strict=True)))
                    else:
                        gone.append(0)
                        kept.append(w.joined(a, b))
                part = batch.slice(begin, len(texts))
                columns = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(w.first).astype(np.int64)), pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, *(f.name for f in _ADDED)])

    return apply


def remove(docs: DataFrame, found: Repeats, most: int = TABLE) -> DataFrame:
    """docs, with kept_text (words that no repeated window covers, joined by one space), n_words and n_removed. Runs of up to
    `most` bytes are broadcast."""
    docs = docs.drop(*(f.name for f in _ADDED))
    rows = shared.packed(docs)
    rows = _remove_by_join(rows, found) if found.runs.count() * ROW > most else _remove_by_table(rows, found)
    return shared.unpacked(rows, docs.columns, *(f.name for f in _ADDED))


def _remove_by_table(docs: DataFrame, found: Repeats) -> DataFrame:
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *_ADDED])
    length, gram, common = found.length, found.gram, found.common
    rows = found.runs.toArrow()
    digests = np.frombuffer(b"".join(rows.column("digest").to_pylist()), dtype="S16")
    order = np.argsort(digests, kind="stable")
    table = docs.sparkSession.sparkContext.broadcast((digests[order], *(rows.column(c).to_numpy()[order] for c in ("first", "last", "least"))))

    def flags(batch: pa.RecordBatch):
        known, firsts, lasts, least = table.value
        ids = batch.column("doc_id").cast(pa.int64()).to_pylist()

        def of(begin: int, w: words.Words) -> dict[int, np.ndarray]:
            out: dict[int, np.ndarray] = {}
            if not len(known):
                return out
            cut = [(digest, row, first) for digest, _, _, row, first in _cut(w, length, gram, common.value)]
            mine = np.frombuffer(b"".join(c[0] for c in cut), dtype="S16")
            a, b = np.searchsorted(known, mine, "left"), np.searchsorted(known, mine, "right")
            for k in np.flatnonzero(b > a).tolist():
                _, row, first = cut[k]
                doc = ids[begin + row]
                for r in range(a[k], b[k]):
                    if doc is not None and least[r] < doc:
                        if row not in out:
                            out[row] = np.zeros(int(w.first[row + 1] - w.first[row]), dtype=bool)
                        out[row][first + firsts[r] : first + lasts[r] + length] = True
            return out

        return of

    return docs.mapInArrow(_kept(names, flags), schema)


def _remove_by_join(docs: DataFrame, found: Repeats) -> DataFrame:
    """`remove` for runs too many to broadcast: occurrences of their super-k-mers are joined by digest, and spans by doc_id."""
    spark = docs.sparkSession
    length, gram, common = found.length, found.gram, found.common
    place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % (1 << FILTER)
    filled = found.runs.select((place / 8).cast("int").alias("byte"), F.pow(F.lit(2), place % 8).cast("int").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    # a filter of a fixed size, whatever the data: it comes in as many rows as it has bytes at most
    bits = np.zeros(1 << (FILTER - 3), dtype=np.uint8)
    for part in filled.toArrow().to_batches():
        bits[part.column(0).to_numpy()] = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, texts in words.slices(batch.column(2)):
                rows = []
                for digest, _, _, row, first in _cut(words.split(texts), length, gram, common.value):
                    at = int.from_bytes(digest[:4], "big") & ((1 << FILTER) - 1)
                    if sent.value[at >> 3] >> (at & 7) & 1 and ids[begin + row] is not None:
                        rows.append((digest, ids[begin + row], keys[begin + row], first))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["digest", "doc", "key", "at"])

    spots = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(occurrences, "digest binary, doc long, key long, at int")
    spans = spots.join(found.runs, "digest").where("least < doc").select("doc", "key", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + length).alias("end"))
    spans = spans.distinct().groupBy(F.col("doc").alias("__doc"), F.col("key").alias("__key")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    rows = docs.join(spans, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64("text") == F.col("__key")), "left").drop("__doc", "__key")

    def flags(batch: pa.RecordBatch):
        spans = batch.column("__spans").to_pylist()

        def of(begin: int, w: words.Words) -> dict[int, np.ndarray]:
            out = {}
            for row in range(len(w.first) - 1):
                if spans[begin + row]:
                    out[row] = np.zeros(int(w.first[row + 1] - w.first[row]), dtype=bool)
                    for s in spans[begin + row]:
                        out[row][s["start"] : s["end"]] = True
            return out

        return of

    return rows.mapInArrow(_kept(docs.columns, flags), T.StructType([*docs.schema.fields, *_ADDED]))


def _digest(docs: DataFrame, found: Repeats, most: int = TABLE) -> DataFrame:
    return remove(docs, found, most).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def substring_dedup(docs: DataFrame, length: int = LENGTH, most: int = TABLE) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select("doc_id", "text")
    return _digest(docs, substring_repeats(docs, length), most)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, most: int = TABLE) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select("doc_id", "text")
    return _digest(docs, suffix_repeats(docs, length), most)


def oracle(length: int = LENGTH) -> str:
    """The same result in SQL."""
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(ws[i:i + {length - 1}], ' ') AS k
        FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {length} + 2)) AS i FROM w)),
first_in AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, i FROM win JOIN first_in USING (k) WHERE doc_id > least),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + {length})) AS p FROM hit) GROUP BY r),
word AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
bad AS (SELECT r, unnest(ps) AS p FROM gone),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN bad USING (r, p) GROUP BY r)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""
