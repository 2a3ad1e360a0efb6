"""Periodic runs of words, by the runs theorem.

Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of words with least period q (words q apart are equal) and length at least
max(least, power * q), which no neighbouring word extends with that period.

The texts of a batch are numbered words, one array with a sentinel of its own behind each text. In every task:

* suffixes are sorted by doubled prefixes, of which only those that still have equals are sorted again;
* the longest Lyndon word at each place ends before the next smaller value of the inverse suffix array, in the reversed order of words
  before the next greater one. Every run has a root (one period of it) among these: comparisons that matter are decided within the text, or at its end,
  where the sentinel is the least;
* a root at i of length q extends to the right by the common prefix of the suffixes i and i + q: the least of the LCP array between their ranks,
  from a sparse table; to the left by the longest common suffix, searched by halving with common prefixes of earlier suffixes;
* roots of one run give the same stretch, and of those with one stretch the least length is its period.

Words get their numbers from Arrow's dictionary, so they are compared as bytes. Memory is about 200 bytes for each word of a slice (1 MB of text,
or one longer document), time grows with n log n.

Null or empty text has no words and no runs; its collapsed text is empty. A null doc_id is judged like others (the query repeats no words in it).
Repeated rows are judged each. Very long texts are judged whole. Extra columns stay; those named `runs`, `n_words` or `collapsed` are replaced.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import shared, words

#: Least words of a run, and least length in periods.
LEAST, POWER = 6, 4

_RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
_RUNS = pa.list_(pa.struct([pa.field(c, pa.int64(), nullable=False) for c in ("start", "length", "period")]))


def suffix_ranks(values: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4... values; the last are those of whole suffixes. The values end with one that is nowhere else,
    so that all suffixes differ; a rank is the number of suffixes that are less, so equal prefixes have equal ranks."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = first
    several = ~(new & np.append(new[1:], True))
    left = order[several]
    levels, step = [rank], 1
    while len(left):
        rank = rank.copy()
        own = levels[-1][left].astype(np.int64)
        key = own * n + levels[-1][left + step]  # a prefix that has equals ends before the last sentinel
        by = np.argsort(key)
        left, own, key = left[by], own[by], key[by]
        at = np.arange(len(left))
        new_own, new_key = np.ones(len(left), dtype=bool), np.ones(len(left), dtype=bool)
        new_own[1:], new_key[1:] = own[1:] != own[:-1], key[1:] != key[:-1]
        rank[left] = own + np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_own, at, 0))
        levels.append(rank)
        left = left[~(new_key & np.append(new_key[1:], True))]
        step *= 2
    return levels


def neighbours_lcp(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """For each rank but the first, the values that its suffix has in common with the one before; 0 for the first."""
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    common = np.zeros(len(a), dtype=np.int64)
    last = len(order) - 1
    for k in reversed(range(len(levels))):
        rank = levels[k]
        common += (rank[np.minimum(a + common, last)] == rank[np.minimum(b + common, last)]).astype(np.int64) << k
    return np.concatenate([[0], common]).astype(np.int32)


def least_tables(values: np.ndarray, most: int) -> list[np.ndarray]:
    """Sparse table: the least of every 1, 2, 4... neighbours, up to `most` of them."""
    out = [values]
    while 2 << (len(out) - 1) <= min(most, len(values)):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def next_smaller(values: np.ndarray, most: int) -> np.ndarray:
    """For each place the next one with a smaller value, at most `most` places on; places without one get a place with a value that is not smaller."""
    tables = least_tables(values, most)
    at = np.arange(1, len(values) + 1)
    for k in reversed(range(len(tables))):
        inside = at < len(tables[k])
        skip = np.zeros(len(at), dtype=bool)
        skip[inside] = tables[k][at[inside]] > values[inside]
        at[skip] += 1 << k
    return at


class Common:
    """Values that two suffixes have in common: the least of the LCP array between their ranks."""

    def __init__(self, lcp: np.ndarray, rank: np.ndarray):
        self.tables, self.rank = least_tables(lcp, len(lcp)), rank

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a].astype(np.int64), self.rank[b].astype(np.int64)
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level).tolist():
            of = level == k
            out[of] = np.minimum(self.tables[k][low[of]], self.tables[k][high[of] - (1 << k)])
        return out

    def suffix(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Values before places a and b (a < b) that agree, at most `most`."""
        low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            fits = self.prefix(a - np.where(open_, middle, 0), b - np.where(open_, middle, 0)) >= middle
            low, high = np.where(open_ & fits, middle, low), np.where(open_ & ~fits, middle - 1, high)
        return low


def find(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """(row, start, length, period) of all runs of some sequences of numbers, one behind the other with these sizes; sorted by row, start, period."""
    rows = len(sizes)
    none = (np.empty(0, dtype=np.int64),) * 4
    longest = int(sizes.max(initial=0))
    if longest < least:
        return none
    ends = np.cumsum(sizes + 1) - 1  # places of sentinels
    values = np.empty(len(ids) + rows, dtype=np.int64)
    own = np.ones(len(values), dtype=bool)
    own[ends] = False
    values[own], values[ends] = ids + rows, np.arange(rows)
    begins = ends - sizes
    of = np.repeat(np.arange(rows), sizes + 1)
    levels = suffix_ranks(values)
    rank = levels[-1]
    order = np.empty(len(rank), dtype=np.int32)
    order[rank] = np.arange(len(rank), dtype=np.int32)
    place = np.arange(len(values))
    farthest = max(1, longest // power) + 1
    starts, periods = [], []
    for values_ in (rank, -rank):
        after = next_smaller(values_, farthest)
        period = after - place
        # within a period of its first word, a run's root is followed by so many words with the same period
        rest = np.maximum(least, power * period) - 2 * period + 1
        fits = own & (after + rest <= ends[of])
        at, period = place[fits], period[fits]
        same = values[at] == values[at + period]
        starts.append(at[same])
        periods.append(period[same])
    at, period = np.concatenate(starts), np.concatenate(periods)
    if not len(at):
        return none
    common = Common(neighbours_lcp(levels, order), rank)
    del levels
    right = common.prefix(at, at + period)
    stay = right >= np.maximum(least, power * period) - 2 * period + 1
    at, period, right = at[stay], period[stay], right[stay]
    # a run's first whole root begins within its first period; later ones find the same stretch
    left = common.suffix(at, at + period, np.minimum(at - begins[of[at]], period))
    stay = (left < period) & (left + period + right >= np.maximum(least, power * period))
    start, period, length = (at - left)[stay], period[stay], (left + period + right)[stay]
    by = np.lexsort((period, length, start))
    start, period, length = start[by], period[by], length[by]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, period, length = start[first], period[first], length[first]
    by = np.lexsort((period, start))
    start, period, length = start[by], period[by], length[by]
    row = of[start]
    return row, start - begins[row], length, period


def _numbers(w: words.Words) -> np.ndarray:
    """Equal numbers for equal words."""
    if not len(w):
        return np.empty(0, dtype=np.int64)
    offsets = np.append(w.starts, w.ends[-1] + 1).astype(np.int64)  # each word and its space
    column = pa.Array.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(offsets), pa.py_buffer(np.append(w.text, np.uint8(0x20)))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _collapsed(w: words.Words, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """Each row's words that no run contains after its first period, joined by one space."""
    rows = len(w.first) - 1
    if not len(row):
        return [w.joined(int(a), int(b)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    edges = np.zeros(len(w) + 1, dtype=np.int64)
    at = w.first[row] + start
    np.add.at(edges, at + period, 1)
    np.add.at(edges, at + length, -1)
    keep = np.cumsum(edges[:-1]) == 0
    out = []
    for i in range(rows):
        a, b = int(w.first[i]), int(w.first[i + 1])
        of = keep[a:b]
        if of.all():
            out.append(w.joined(a, b))
            continue
        pieces = words.runs(of)
        out.append(b" ".join(w.joined(a + int(x), a + int(y)) for x, y in zip(*pieces, strict=True)))
    return out


def detect(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """docs with n_words, runs (start, length and period in words, by start, then period) and collapsed: the text's words but those that
    a run contains after its first period, joined by one space."""
    shared.lean(docs.sparkSession)
    docs = docs.drop("n_words", "runs", "collapsed")
    names = docs.columns
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("collapsed", T.StringType())]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in words.slices(batch.column("text")):
                w = words.split(texts)
                sizes = np.diff(w.first)
                row, start, length, period = find(_numbers(w), sizes, least, power)
                offsets = np.zeros(len(texts) + 1, dtype=np.int32)
                np.cumsum(np.bincount(row, minlength=len(texts)), out=offsets[1:])
                found = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(_RUNS.value_type))
                runs = pa.ListArray.from_arrays(pa.array(offsets), found, type=pa.list_(pa.field("element", found.type, nullable=False)))
                collapsed = pa.array(_collapsed(w, row, start, length, period), pa.binary()).cast(pa.string())
                some = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(sizes.astype(np.int64)), runs, collapsed], [*names, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, *added]))


def planted(docs: DataFrame) -> DataFrame:
    """docs whose texts repeat themselves where h = crc32(decimal doc_id) ends in 0: of n words, each word i >= a is word
    a + (i - a) % p, with g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    ws, trimmed = F.col("__words"), F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    held = docs.withColumn("__words", F.when((h % 10 == 0) & (trimmed != ""), F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    n, g = F.size(ws).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return held.withColumn("text", F.when(ws.isNull(), F.col("text")).otherwise(F.array_join(again, " "))).drop("__words")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_runs; start, length, period and exponent_milli of its longest run (null without one);
    runs_sha256, collapsed_sha256."""
    rows = detect(planted(docs.select("doc_id", "text")).select("doc_id", "text"))
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
