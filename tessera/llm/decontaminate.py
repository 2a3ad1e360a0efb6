"""Benchmark decontamination: find windows of benchmark items in documents, remove spans or documents.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of text whose A-Z are lower case. A window is 10 consecutive
words of an item; an item of fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit. Null text has no words; a null item id hits words but is not counted.

Very long texts are scanned whole, in one slice. Repeated rows are judged each. Extra columns stay. Empty tables: no documents give no
rows, an empty benchmark hits nothing.

Windows of the benchmark are broadcast in blocks of at most BLOCK windows, whatever the benchmark's size;
documents pass CHAINED blocks in one job, without a shuffle, and are written before the next ones. In a document every window's hash is looked up in
a bit table, the few candidates in a dictionary of strings, so hits are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import shared, words

#: Words of a window, and windows broadcast at once (about 100 bytes each).
WINDOW, BLOCK = 10, 200_000
#: Blocks that documents pass in one job, each in a Python worker; then they are written.
CHAINED = 4
_BITS = 22

_HIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_LISTS = [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]


def _words(text: str | None) -> list[bytes]:
    w = words.split([(text or "").encode()], words.NOT_ALNUM, words.LOWER)
    return [w.text[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK) -> Iterator[dict[int, dict[bytes, list[str | None]]]]:
    """{words: {window: item ids}} of at most so many windows each; an item may be in several blocks."""
    held: dict[int, dict[bytes, list[str | None]]] = defaultdict(dict)
    n = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator(prefetchPartitions=False):
        ws = _words(text)
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1 if size else 0):
            ids = held[size].setdefault(b" ".join(ws[i : i + size]), [])
            if item not in ids:
                ids.append(item)
            n += 1
            if n >= most:
                yield dict(held)
                held, n = defaultdict(dict), 0
    if n:
        yield dict(held)


def _lookup(block: dict[int, dict[bytes, list[str | None]]]) -> list[tuple[int, np.ndarray, dict[bytes, list[str | None]]]]:
    """For each window size: its bit table and its windows."""
    out = []
    for size, of in sorted(block.items()):
        w = words.split(list(of), words.NOT_ALNUM, words.LOWER)
        h = words.windows(w.hashes(), size)[w.first[:-1]]
        bits = np.zeros(1 << _BITS, dtype=bool)
        bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        out.append((size, bits, of))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """docs, with n_words, n_hit, hits (start and end word of runs of hit words) and items (ids, each once); columns of these
    names are replaced."""
    shared.lean(docs.sparkSession)
    docs = docs.drop("n_words", "n_hit", "hits", "items")
    sc = docs.sparkSession.sparkContext
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(_HIT)), T.StructField("items", T.ArrayType(T.StringType()))])

    def step(block):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = _lookup(block.value) if block else []
            for batch in batches:
                n, hits, items = [], batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                for begin, texts in words.slices(batch.column("text")):
                    w = words.split(texts, words.NOT_ALNUM, words.LOWER)
                    n += np.diff(w.first).tolist()
                    h = w.hashes()
                    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
                    for size, bits, of in tables:
                        maybe = bits[(words.windows(h, size) >> np.uint64(64 - _BITS)).astype(np.int64)] & words.same_row(w.doc, size)
                        for i in np.flatnonzero(maybe).tolist():
                            if (ids := of.get(w.joined(i, i + size))) is not None:
                                row = int(w.doc[i])
                                found[row].append((i, i + size))
                                items[begin + row] = items[begin + row] + ids
                    for row, spans in found.items():
                        first = int(w.first[row])
                        flags = np.zeros(int(w.first[row + 1]) - first, dtype=bool)
                        for s in hits[begin + row]:
                            flags[s["start"] : s["end"]] = True
                        for a, b in spans:
                            flags[a - first : b - first] = True
                        hits[begin + row] = [{"start": int(a), "end": int(b)} for a, b in zip(*words.runs(flags), strict=True)]
                        items[begin + row] = sorted({x for x in items[begin + row] if x is not None})
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(hits, _LISTS[0]), pa.array(items, _LISTS[1])], [*names, "n_words", "hits", "items"])

        return apply

    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast(T.ArrayType(_HIT)), "items": F.array().cast("array<string>")})
    k = 0
    for k, block in enumerate(blocks(benchmark, window, most), 1):
        if k > 1 and k % CHAINED == 1:
            out = shared.cut(out)
        out = out.mapInArrow(step(sc.broadcast(block)), schema)
    if not k:
        out = out.mapInArrow(step(None), schema)
    return out.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit word; what holds a passage of the benchmark goes."""
    rows = scan(shared.packed(docs), benchmark).where("n_hit = 0")
    return shared.unpacked(rows, docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = F.array_join(F.array_sort("items"), ",")
    return scan(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def oracle(window: int = WINDOW) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ws = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ws} AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), {window}) AS l FROM (SELECT item_id, {ws} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS k FROM (SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM b)),
dw AS (SELECT r, i, l, array_to_string(ws[i:i + l - 1], ' ') AS k
       FROM (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT l FROM b) WHERE len(ws) >= l)),
hit AS (SELECT r, i, l, item_id FROM dw JOIN iw USING (l, k)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)"""
