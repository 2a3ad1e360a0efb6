"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Words are `[^\\x20\\x09-\\x0D]+` of text whose A-Z are lower case. A document's set holds its distinct 5-word shingles (of
fewer words, the whole sequence as one; of none, nothing, and it links with nothing). Two documents link when
100 * intersection >= 80 * union; a component's id is the smallest doc_id that links reach.

T-occurrence search, spread over a cluster. Documents that link share at least T = ceil(0.8 n) shingles of either one, n
being its set's size. So a document's T - 1 longest inverted lists can be left out of the merge, and every partner
still occurs in one of the others (DivideSkip with all lists but the n - T + 1 shortest as long ones):

1. Documents with equal sets are one class, known by a 64-bit hash of the set (of 128 bits where a second hash shows that
   different sets share it). Copies go no further.
2. Each class sends its n - T + 1 shingles that are rarest in the corpus, so that lists of common lines stay out of it, to
   the shingles' partitions, where short inverted lists form. Lists with one class are dropped there.
3. Of short lists all pairs are looked at. Long ones are cut where sizes differ too much. In each piece the class that shares
   most lists, the middle of a cluster, is checked with the others; in the next round, those still apart are checked with one
   that is chosen by hash.
4. Pairs that share a long list but are not in one component by then are checked, all of them. So no link between
   components is lost, and a group of thousands of near copies does not become all its pairs.

Before a check, a pair must pass bounds that never drop a link: the places of the shared shingle in both orders, the
number of lists that each class shares with any other from that one on (what a pair does not share within the lists it
must share beyond them, and there is no room for more than T - 1), and the number of bits in which the classes' parity bitmaps (about 4 to 8 bits a shingle) differ, which is at most the number
of shingles that only one of the two has. So sets travel only for pairs that are very likely to link.

A check of a leader with its partners builds their inverted lists in blocks, heap-merges the short ones with a
threshold of T less the number of long ones, and probes the long ones by binary search for what reaches it.
Components come from alternating large-star and small-star steps over the links.

Null or empty text has an empty set. Rows with null doc_id stay, link with nothing, and have a null component_id. Repeated rows
are copies of each other. A very long text is one large set. An empty table gives an empty table. Shingles are compared by 64-bit
hashes. `join` does not read extra columns, `deduplicate` keeps them, whatever they are called.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import passages, shared, words

#: Words of a shingle; similarity in percent; a shingle is common if it makes up this part of all, so at most 1 / COMMON do (64 MB).
SHINGLE, PERCENT, COMMON = 5, 80, 1 / 4_000_000
#: Partners checked at once, and by one task; classes of a list of which all pairs are looked at at once.
BLOCK, TASK, SHORT = 256, 2048, 8
#: Classes of a list that one task compares with each other; classes with many copies that are joined by broadcast.
CELL, HOT = 4096, 2000


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a set of n shares with whatever links with it, at least."""
    return -(-n * percent // 100)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all distinct shingles, by row and then hash, and the sets' sizes."""
    w = words.split(texts, fold=words.LOWER)
    h = w.hashes()
    g = words.windows(h, size)
    inside = words.same_row(w.doc, size)
    row, value = w.doc[: len(g)][inside], g[inside]
    n_words = np.diff(w.first)
    for k in range(1, size):
        short = np.flatnonzero(n_words == k)
        if len(short):
            row, value = np.append(row, short), np.append(value, words.windows(h, k)[w.first[short]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=len(texts))


def pair_overlap(n, percent: int = PERCENT):
    """Of n, two sets' sizes together: what the sets share at least if they link."""
    return -(-n * percent // (100 + percent))


def bitmaps(row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each row's set, the parity of the number of its values in each of 4 to 8 buckets for each value."""
    width = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(4 * sizes, 64))).astype(np.int64), 0)
    ends = np.cumsum(width)
    at = (ends - width)[row] + (value & (width - 1).astype(np.uint64)[row]).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8))
    return [packed[(e - w) // 8 : e // 8].tobytes() for e, w in zip(ends.tolist(), width.tolist(), strict=True)]


def may_link(n_a: int, a: bytes, n_b: int, b: bytes, percent: int = PERCENT) -> bool:
    """Whether two sets' bitmaps leave it open that they link. A wider bitmap is folded onto the other."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return n_a + n_b - int(np.bitwise_count(x ^ y).sum()) >= 2 * pair_overlap(n_a + n_b, percent)


def signatures(row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each row's set."""
    ends = np.cumsum(sizes)
    out = []
    for seed in (1, 0xA0761D6478BD642F):
        sums = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(words.mix(words.mix(value + np.uint64(seed)) ^ np.uint64(seed)), out=sums[1:])
        out.append(words.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _named(sig: np.ndarray, check: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """A class's name: the first hash, or, where different sets share it, one made of both."""
    clash = passages.member(sig, twice)
    if clash.any():
        sig = np.where(clash, words.mix(sig.view(np.uint64) ^ words.mix(check.view(np.uint64))).view(np.int64), sig)
    return sig


def _classes():
    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in words.slices(batch.column(1)):
                row, value, sizes = shingle_sets(texts)
                sig, check = signatures(row, value, sizes)
                columns = [batch.column(0).slice(begin, len(texts)), pa.array(sizes.astype(np.int64)), pa.array(sig), pa.array(check), pa.array(bitmaps(row, value, sizes), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sig", "check", "bits"])

    return classes


def _rarest(common, twice: np.ndarray, percent: int):
    """Each class's rarest shingles, as many as must hold one of every partner's."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = common.value
        seen: set[int] = set()
        for batch in batches:
            for _, texts in words.slices(batch.column(0)):
                row, value, sizes = shingle_sets(texts)
                sig = _named(*signatures(row, value, sizes), twice)
                send = np.zeros(len(texts), dtype=bool)
                # a set of n links with a larger one only if n of n + 1 are enough
                for i in np.flatnonzero(sizes * (100 - percent) >= percent).tolist():
                    if int(sig[i]) not in seen:
                        seen.add(int(sig[i]))
                        send[i] = True
                keep = send[row]
                row, value = row[keep], value[keep]
                if not len(row):
                    continue
                often = np.zeros(len(value), dtype=np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, value), len(values) - 1)
                    often = np.where(values[at] == value, counts[at], 0)
                if often.any():
                    order = np.lexsort((value, often, row))
                    row, value = row[order], value[order]
                first = np.searchsorted(row, row)
                place = np.arange(len(row)) - first
                take = place < (sizes - least_overlap(sizes, percent) + 1)[row]
                row, value, place = row[take], value[take], place[take]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(sig[row]), pa.array(sizes[row].astype(np.int32)), pa.array(place.astype(np.int32))], ["shingle", "sig", "n", "place"])

    return rarest


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists with two classes or more."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not parts:
        return
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    del parts
    shingle, sig, n, _ = columns
    order = np.lexsort((sig, n, shingle))
    columns = [c[order] for c in columns]
    shingle, sig = columns[:2]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (sig[1:] != sig[:-1])
    columns = [c[new] for c in columns]
    cuts = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
    length = np.diff(np.append(cuts, len(columns[0])))
    columns.append(np.repeat(length, length).astype(np.int32))
    many = columns[-1] > 1
    yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in columns], ["shingle", "sig", "n", "place", "length"])


def _pieces(shingle: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, end of those that may be partners of the first) of pieces of lists: rows of one list in order of size,
    cut where sizes differ too much from the piece's first."""
    cuts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shingle)], strict=True):
        while a < b:
            end = a + int(np.searchsorted(n[a:b], n[a] * 100 // percent, "right"))
            yield a, end, b
            a = end


def _allowed(i, j, n: np.ndarray, left: np.ndarray, room: np.ndarray, root: np.ndarray, percent: int) -> np.ndarray:
    """Which rows j of a list may link with its rows i (arrays that broadcast): sizes, places of the shingle in both orders, and
    the number of shared lists from this one on must leave room for the overlap, and they have no component in common."""
    both = n[i] + n[j]
    overlap = pair_overlap(both, percent)
    least_lists = overlap - np.maximum(least_overlap(n[i], percent), least_overlap(n[j], percent)) + 1
    ok = (np.minimum(left[i], left[j]) >= overlap) & (np.minimum(room[i], room[j]) >= least_lists)
    return ok & (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))


def _pairs(percent: int, step: str):
    """Pairs of each list's classes that may link. Step "first": all pairs of short lists, and of long ones those of each piece's
    class that shares most lists with the others; "more": those of long lists' pieces with one chosen by hash; "all": all pairs of long lists."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort((columns[1], columns[2], columns[0]))
        shingle, sig, n, place, length, many, room, root = (c[order] for c in columns)
        n, left = n.astype(np.int64), (n - place).astype(np.int64)
        found = [np.empty((0, 2), dtype=np.int64)]
        rows = np.flatnonzero(length <= SHORT)
        for k in range(1, SHORT if step == "first" else 1):
            rows = rows[rows + k < len(sig)]
            rows = rows[shingle[rows + k] == shingle[rows]]
            ok = rows[_allowed(rows, rows + k, n, left, room, root, percent)]
            found.append(np.column_stack([sig[ok], sig[ok + k]]))
        long = np.flatnonzero(length > SHORT)
        shingle, sig, n, left, many, room, root = (c[long] for c in (shingle, sig, n, left, many, room, root))
        for a, end, last in _pieces(shingle, n, percent) if len(long) else ():
            if step == "all":
                for i in range(a, end, 512):
                    own, others = np.arange(i, min(end, i + 512))[:, None], np.arange(i, last)[None, :]
                    x, y = np.nonzero(_allowed(own, others, n, left, room, root, percent) & (others > own))
                    found.append(np.column_stack([sig[i + x], sig[i + y]]))
            else:
                key = words.mix(sig[a:end].view(np.uint64))
                lead = a + int(np.lexsort((key, -many[a:end]))[0] if step == "first" else key.argmin())
                others = np.arange(a, end)
                others = others[_allowed(np.array([lead]), others, n, left, room, root, percent)]
                found.append(np.column_stack([np.full(len(others), sig[lead]), sig[others]]))
        pair = np.concatenate(found)
        # the leader of a check is the class with the least hash, whatever list a pair comes from
        swap = words.mix(pair[:, 0].view(np.uint64)) > words.mix(pair[:, 1].view(np.uint64)) if step != "more" and len(pair) else np.zeros(len(pair), dtype=bool)
        pair[swap] = pair[swap][:, ::-1]
        pair = np.unique(pair, axis=0) if len(pair) else pair
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], ["a", "b"])

    return pairs


def divide_skip(query: np.ndarray, sets: list[np.ndarray], needed: list[int]) -> list[int]:
    """Which of the sets share at least so many values with the query; all are sorted."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    at = np.minimum(np.searchsorted(query, values), len(query) - 1)
    hit = query[at] == values
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order].tolist()
    if not owner:
        return []
    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist()
    lists = sorted((owner[a:b] for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True)), key=len)
    least = min(needed)
    if len(lists) < least:
        return []
    n_long = min(least - 1, int(least / (0.01 * len(lists[-1]).bit_length() + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    count: dict[int, int] = {}
    for x in heapq.merge(*short):
        count[x] = count.get(x, 0) + 1
    found = []
    for x, n in count.items():
        if n < needed[x] - n_long:
            continue
        for k, own in enumerate(long):
            if n >= needed[x] or n + n_long - k < needed[x]:
                break
            i = bisect_left(own, x)
            n += i < len(own) and own[i] == x
        if n >= needed[x]:
            found.append(x)
    return sorted(found)


def _check(percent: int):
    """Of rows by (a, salt), the leader's own row first (b null): pairs that link."""

    def block(lead: int, query: np.ndarray, held: list[tuple[int, np.ndarray]], out: list[tuple[int, int]]) -> None:
        # |x & y| * (100 + p) >= p * (|x| + |y|) is the condition on the union
        needed = [pair_overlap(len(query) + len(s), percent) for _, s in held]
        out.extend((lead, held[i][0]) for i in divide_skip(query, [s for _, s in held], needed))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = query = None
        held: list[tuple[int, np.ndarray]] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for a, b, values in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "values")), strict=True):
                values = np.frombuffer(values, dtype="<u8")
                if b is None or len(held) >= BLOCK:
                    if held:
                        block(lead, query, held, out)
                        held = []
                if b is None:
                    lead, query = a, values
                elif a == lead:
                    held.append((b, values))
        if held:
            block(lead, query, held, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return check


def _sets(twice: np.ndarray):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in words.slices(batch.column(0)):
                row, value, sizes = shingle_sets(texts)
                ends = np.cumsum(sizes).tolist()
                found = [value[e - s : e].tobytes() for e, s in zip(ends, sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_named(*signatures(row, value, sizes), twice)), pa.array(found, pa.binary())], ["sig", "values"])

    return sets


def _open_pairs(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")]
            stay = pa.array([may_link(*x, percent) for x in zip(*rows, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(stay)

    return keep


def linked(pairs: DataFrame, docs: DataFrame, bits: DataFrame, twice: np.ndarray, n: int, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b: classes) that link. bits has a row for each class: sig, n, bits, and the least doc_id. Sets are
    read again, of one document for each class in the pairs."""
    side = lambda c: bits.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_open_pairs(percent), "a long, b long")
    pairs = shared.cut(pairs)
    if pairs.isEmpty():
        return pairs
    named = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = bits.join(named, "sig", "left_semi").select(F.col("least").alias("__id")).distinct()
    rows = docs.join(shared.small(shared.cut(wanted)), F.col("doc_id").cast("long") == F.col("__id"), "left_semi").select("text")
    sets = rows.mapInArrow(_sets(twice), "sig long, values binary").join(shared.small(shared.cut(named)), "sig", "left_semi").dropDuplicates(["sig"])
    sets = shared.cut(sets)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TASK).cast("int").alias("parts"))
    partners = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    leaders = parts.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    own = leaders.join(sets, F.col("a") == F.col("sig")).drop("sig")
    others = partners.join(sets, F.col("b") == F.col("sig")).drop("sig")
    ready = own.unionByName(others).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ready.mapInArrow(_check(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b); root is the least node of the component."""
    stars = shared.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        stars = shared.cut(small.where("u <> v").distinct())
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    shared.lean(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = shared.partitions(spark, shared.text_bytes(docs))
    rows = shared.cut(docs.mapInArrow(_classes(), "doc_id long, n long, sig long, check long, bits binary"))
    # rows of a class are summed before they meet, and its bits are those of its least document
    by_sig = rows.where("n > 0").groupBy("sig").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("sig")
    twice = np.sort(np.array([r[0] for r in by_sig.collect()], dtype=np.int64))  # different sets with one 64-bit hash: none below some 10^9
    if len(twice):
        rows = rows.withColumn("sig", F.when(F.col("sig").isin(*twice.tolist()), _renamed()(F.col("sig"), F.col("check"))).otherwise(F.col("sig")))
    first = F.min(F.struct("doc_id", "n", "bits"))
    bits = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(first.alias("f"), F.count("*").alias("copies"))
    bits = shared.cut(bits.select("sig", "f.n", "f.bits", F.col("f.doc_id").alias("least"), "copies"))
    common = spark.sparkContext.broadcast(passages.frequent(docs, SHINGLE, COMMON, least=20, fold=True, counts=True))
    postings = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_rarest(common, twice, percent), "shingle long, sig long, n int, place int")
    lists = postings.repartition(n, "shingle").mapInArrow(_lists, "shingle long, sig long, n int, place int, length int")
    own = Window.partitionBy("sig")
    lists = lists.withColumns({"many": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("place"))})
    lists = shared.cut(lists.withColumn("room", F.col("many") - F.col("rank") + 1).drop("rank"))
    roots = None
    for step in ("first", "more", "all"):
        if roots is None:
            rooted = lists.withColumn("root", F.col("sig"))
        else:
            rooted = lists.where(F.col("length") > SHORT)
            if rooted.isEmpty():
                break
            rooted = rooted.join(roots, F.col("sig") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sig"))
        if step == "all":
            rooted = _cells(rooted)
        found = rooted.select("shingle", "sig", "n", "place", "length", "many", "room", "root").repartition(n, "shingle")
        found = shared.cut(linked(found.mapInArrow(_pairs(percent, step), "a long, b long"), docs, bits, twice, n, percent))
        if roots is None:
            roots = shared.small(shared.cut(components(found)))
        elif not found.isEmpty():
            roots = shared.small(shared.cut(_joined_roots(roots, found)))
    sized = shared.cut(bits.select("sig", "least", "copies").join(roots, F.col("sig") == F.col("node"), "left").select("sig", "least", "copies", F.coalesce("root", "sig").alias("root")))
    least = sized.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k")
    named = sized.join(shared.small(shared.cut(least)), "root", "left").select("sig", "copies", F.coalesce("component_id", "least").alias("component_id"), "least")
    named = shared.cut(named.where("copies > 1 OR component_id <> least").drop("least"))
    return _with_component(rows, named)


def _joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b): components of the roots, which are few, and then of their nodes."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = shared.cut(components(ends.distinct())).select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = roots.join(shared.small(new), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(new.join(roots, F.col("node") == new["root"], "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root")))


def _renamed():
    @F.pandas_udf("long")
    def renamed(sig: pd.Series, check: pd.Series) -> pd.Series:
        return pd.Series(_named(sig.to_numpy(), check.to_numpy(), np.unique(sig.to_numpy())))

    return renamed


def _cells(lists: DataFrame) -> DataFrame:
    """Lists of more than CELL classes are dealt in blocks, each pair of blocks to a place of its own: all of a list's pairs still meet,
    but not in one task."""
    k = F.ceil(F.col("length") / CELL).cast("int")
    own = F.pmod(F.xxhash64("sig"), k).cast("int")
    other = F.explode(F.when(k > 1, F.sequence(F.lit(0), k - 1)).otherwise(F.array(F.lit(0))))
    rows = lists.withColumns({"__k": k, "__own": own}).withColumn("__other", other)
    cell = F.xxhash64("shingle", F.least("__own", "__other"), F.greatest("__own", "__other"))
    return rows.withColumn("shingle", F.when(F.col("__k") > 1, cell).otherwise(F.col("shingle"))).drop("__k", "__own", "__other")


def _with_component(rows: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents. Classes with many copies are joined by broadcast (at most HOT of them);
    rows that have nothing to join are dealt by doc_id, not by their class."""
    total = named.agg(F.sum("copies")).head()[0] or 0
    many = F.col("copies") > max(1, total // HOT)
    hot = F.broadcast(named.where(many).select(F.col("sig").alias("hot_sig"), F.col("component_id").alias("hot")))
    rest = shared.small(named.where(~many).select(F.col("sig").alias("cold_sig"), F.lit(0).alias("cold_salt"), F.col("component_id").alias("cold")))
    out = rows.select("doc_id", "n", "sig").join(hot, (F.col("sig") == F.col("hot_sig")) & (F.col("n") > 0), "left")
    joins = (F.col("n") > 0) & F.col("hot").isNull()
    salt = F.when(joins, 0).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.lit(4096))).cast("int")
    out = out.withColumn("salt", salt).join(rest, (F.col("sig") == F.col("cold_sig")) & (F.col("salt") == F.col("cold_salt")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("hot", "cold", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all columns.

    Documents without words link with nothing and stay, as do those with null doc_id. Of repeated rows (doc_id and text) one stays."""
    found = shared.cut(join(docs, percent).where("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")))
    by_id = F.col("doc_id").cast("long") == F.col("__id")
    once, often = found.where("__n = 1"), found.where("__n > 1")
    rows = shared.packed(docs)
    kept = rows.join(shared.small(once), by_id, "left_semi").unionByName(rows.where("doc_id IS NULL"))
    if not often.isEmpty():
        again = rows.join(shared.small(often), by_id, "left_semi").withColumn("__key", F.xxhash64("text"))
        kept = kept.unionByName(again.dropDuplicates(["doc_id", "__key"]).drop("__key"))
    return shared.unpacked(kept, docs.columns)
