"""How five filters of documents interact, in all 120 orders of applying them.

A document fails (words: `[^\\x20\\x09-\\x0D]+`, case-sensitive; null text: empty)

* A: with under 200 words;
* B: if 100 * distinct words < 50 * words;
* C: if 100 * characters `[A-Z]` > 2 * code points;
* D: if it holds any of `[#$%&*|]`;
* E: if its text is identical to that of any smaller doc_id, anywhere in the table, removed or not.

A document's failures are a mask of five bits, so a part of the table (a value of `source`; null is the empty string) is
32 cells of counts: documents, those labelled good (quality 1), those labelled toxic. All that follows is made
from the cells. The permutations are visited by single swaps of neighbours; a swap of the filters at steps k and k + 1 changes
these two steps only, which are read again from the cells; Shapley sums run along the walk. Parts of a batch are
walked together, as columns of one array.

Texts meet as 256-bit digests. Copies with the same part and labels are one row before they meet, so a text that a third of
all documents share is at most as many rows as there are parts and labels in each task.

Null doc_id: such a document equals no smaller doc_id, is smaller than none, and has no labels. Repeated rows of one doc_id count each and are
no copies of each other. A document with several label rows is good or toxic if any says so. Very long texts are judged whole; an empty
text fails A, and E from its second doc_id on. Extra columns are ignored. No documents give no rows, no labels give zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shared

FILTERS = "ABCDE"
#: Fewest words; least share of distinct words and largest share of capitals, in percent; characters that no text may hold.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
#: Parts whose orders are held at once (34 KB each).
PARTS = 256
_SPACE = " \t\n\x0b\x0c\r"
_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and mask: bits 0 to 3 are failures of A to D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (
        F.size(words) < WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * DISTINCT,
        capitals.cast("long") * 100 > F.char_length(text).cast("long") * CAPITALS,
        text.rlike(MARKS),
    )
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return docs.select(F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with `good` and `toxic`."""
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flags = shared.small(shared.cut(flags.where("good = 1 OR toxic = 1")))
    # rows without doc_id match nothing, wherever they are: they are dealt by their digest
    spare = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("__spare", spare).join(flags.withColumn("__none", F.lit(0).cast("long")), (F.col("doc_id") == F.col("__id")) & (F.col("__spare") == F.col("__none")), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("doc_id", "part", "digest", "mask", "n", flag("good"), flag("toxic"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit 4: failure of E), n, good, toxic: counts of documents."""
    rows = masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = labelled(rows, labels)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    named = F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), named.alias("named"), first.alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    # of the documents with an id, all but those of the text's least id are copies
    copies = F.col("named") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("least", least).select("part", "mask", "good", "toxic", "n", copies.alias("copies"))
    either = F.explode(F.array(F.struct(F.col("mask").alias("m"), (F.col("n") - F.col("copies")).alias("k")), F.struct((F.col("mask") + 16).alias("m"), F.col("copies").alias("k"))))
    return (
        split.select("part", "good", "toxic", either.alias("e"))
        .where("e.k > 0")
        .groupBy("part", F.col("e.m").alias("mask"))
        .agg(F.sum("e.k").alias("n"), F.sum(F.col("e.k") * F.col("good")).alias("good"), F.sum(F.col("e.k") * F.col("toxic")).alias("toxic"))
    )


def swaps(n: int) -> Iterator[int]:
    """Places k, so that swapping k and k + 1 in turn visits every order of n things once."""
    at, step = list(range(n)), [-1] * n  # place of each thing, and the way it moves
    while True:
        order = sorted(range(n), key=at.__getitem__)
        for x in reversed(range(n)):
            to = at[x] + step[x]
            if 0 <= to < n and order[to] < x:
                yield min(at[x], to)
                at[x], at[order[to]] = to, at[x]
                for y in range(x + 1, n):
                    step[y] = -step[y]
                break
        else:
            return


def walk(counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Of cells (part, mask, 3: all, good, toxic): the orders, and an array (order, step, part, measure)."""
    mask = np.arange(1 << len(FILTERS))
    orders = ["".join(p) for p in permutations(FILTERS)]
    place = {o: i for i, o in enumerate(orders)}
    parts = counts.shape[0]
    out = np.zeros((len(orders), len(FILTERS), parts, len(_MEASURES)), dtype=np.int64)
    failing = np.stack([counts[:, (mask >> f & 1) == 1, 0].sum(1) for f in range(len(FILTERS))])
    alone = np.stack([counts[:, 1 << f, 0] for f in range(len(FILTERS))])
    total = counts[:, :, 0].sum(1)
    order, removed = list(range(len(FILTERS))), np.zeros((len(FILTERS), parts, 3), dtype=np.int64)
    shapley = np.zeros((len(FILTERS), parts), dtype=np.int64)

    def read(k: int) -> None:
        before = sum(1 << f for f in order[:k])
        removed[k] = counts[:, (mask >> order[k] & 1 == 1) & (mask & before == 0)].sum(1)

    def visit() -> None:
        now = out[place["".join(FILTERS[f] for f in order)]]
        now[:, :, 0] = total - np.cumsum(removed[:, :, 0], axis=0)
        now[:, :, 1] = removed[:, :, 0]
        now[:, :, 2] = failing[order] - removed[:, :, 0]
        now[:, :, 3] = alone[order]
        now[:, :, 4:6] = removed[:, :, 1:]
        shapley[order] += removed[:, :, 0]

    for k in range(len(FILTERS)):
        read(k)
    visit()
    for k in swaps(len(FILTERS)):
        order[k], order[k + 1] = order[k + 1], order[k]
        read(k)
        read(k + 1)
        visit()
    for name, i in place.items():
        out[i, :, :, 6] = shapley[[FILTERS.index(f) for f in name]]
    return orders, out


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, PARTS):
            some = batch.slice(begin, PARTS)
            names = some.column("part").to_pylist()
            counts = np.zeros((len(names), 1 << len(FILTERS), 3), dtype=np.int64)
            for i, of in enumerate(some.column("cells").to_pylist()):
                for c in of:
                    counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
            orders, out = walk(counts)
            steps, parts = len(FILTERS), len(names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names * (len(orders) * steps)),
                    pa.array([o for o in orders for _ in range(steps * parts)]),
                    pa.array(np.tile(np.repeat(np.arange(1, steps + 1, dtype=np.int32), parts), len(orders))),
                    *(pa.array(out[:, :, :, m].ravel()) for m in range(len(_MEASURES))),
                ],
                ["part", "filter_order", "step", *_MEASURES],
            )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(_orders, f"part string, filter_order string, step int, {', '.join(f'{m} long' for m in _MEASURES)}")


def first_failures(docs: DataFrame, labels: DataFrame, order: str = FILTERS) -> DataFrame:
    """part, filter (the first that removes; null: kept), documents, good, toxic, if the filters are applied in this order."""
    bit: Column = F.lit(None).cast("string")
    for f in reversed(order):
        bit = F.when(F.col("mask").bitwiseAND(1 << FILTERS.index(f)) != 0, f).otherwise(bit)
    return cells(docs, labels).groupBy("part", bit.alias("filter")).agg(F.sum("n").alias("documents"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def oracle() -> str:
    return """
WITH RECURSIVE l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < w.doc_id, false)} AS f FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
fails AS (SELECT part, f, n, good, toxic, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END, CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS s FROM cells),
perms AS (SELECT '' AS o UNION ALL SELECT o || x FROM perms CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)),
steps AS (SELECT o, step, o[step] AS x, o[1:step - 1] AS before FROM perms CROSS JOIN range(1, 6) r(step) WHERE length(o) = 5),
counted AS (SELECT part, o, step, x, sum(CASE WHEN translate(s, before || x, '') = s THEN n ELSE 0 END) AS kept,
       sum(CASE WHEN contains(s, x) AND translate(s, before, '') = s THEN n ELSE 0 END) AS removed,
       sum(CASE WHEN contains(s, x) AND translate(s, before, '') <> s THEN n ELSE 0 END) AS redundant,
       sum(CASE WHEN s = x THEN n ELSE 0 END) AS unique_fails,
       sum(CASE WHEN contains(s, x) AND translate(s, before, '') = s THEN good ELSE 0 END) AS good_lost,
       sum(CASE WHEN contains(s, x) AND translate(s, before, '') = s THEN toxic ELSE 0 END) AS toxic_lost
     FROM fails CROSS JOIN steps GROUP BY part, o, step, x)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted"""
