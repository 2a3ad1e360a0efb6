"""License scans, periodic runs and the filter audit against brute force, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import audit, licenses, periodic, queries

LONG = " ".join(f"w{i % 700}" for i in range(3_000))
VERY_LONG = " ".join(f"some{i % 9}" for i in range(300_000))
LOOP = "head " + "a b c " * 9 + "a tail"
ROWS = [
    (1, "Plain words.", "s1", "x"), (2, None, "s1", "x"), (2, None, "s1", "x"), (3, "", None, "y"), (4, " \n ", "", "y"), (None, LOOP, "s2", "y"), (5, LOOP, "s2", None),
    (6, LONG, "s1", "z"), (7, LONG + " tail", "s1", "z"), (8, "ABC def # ghi", "s2", "z"), (9, "abc DEF", "s2", "z"), (10, "é ü " * 150, "s1", "z"), (11, "é ü " * 150, "s1", "z"),
    (12, "Released under the MIT License. CC BY-NC, cc by nc cc by nc.", "s1", "z"), (13, "x x x x x x y y y y y z z", "s3", "z"), (20, "one two three four five six seven", "s3", "z"),
    (13, "x x x x x x y y y y y z z", "s3", "z"), (5, "other text of number five", "s2", None),
]
SCHEMA = "doc_id long, text string, source string, runs string"
LABELS = [(1, 1, 0), (5, 1, 1), (5, 0, None), (8, None, 1), (10, 1, 0), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Runs


def runs_by_brute_force(ws, least=6, power=4):
    found = {}
    for q in range(1, len(ws) // power + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def report_by_brute_force(doc_id, text):
    ws = split(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(ws), h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = runs_by_brute_force(ws)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = best[1] * 1000 // best[2] if runs else None
    return doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))


def test_runs(spark, docs, none):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    repeating = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    rng = np.random.default_rng(3)
    more = [(i, " ".join(f"v{x}" for x in rng.integers(0, 3, int(rng.integers(0, 90)))), None, None) for i in [*repeating, *range(300, 340)]]
    rows = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    expected = [report_by_brute_force(r[0], r[1]) for r in [*ROWS, *more]]
    assert sum(r[1] for r in expected) > 20
    assert sorted(map(repr, map(tuple, periodic.report(rows).select(*columns).collect()))) == sorted(map(repr, expected))
    assert periodic.report(none).columns == columns and periodic.report(none).count() == 0
    out = periodic.detect(docs)
    assert out.columns == ["doc_id", "text", "source", "n_words", "runs", "collapsed"] and out.count() == len(ROWS)
    found = out.where("doc_id = 5 AND text LIKE 'head%'").head()
    assert [tuple(r) for r in found.runs] == [(1, 28, 3)] and found.collapsed == "head a b c tail"
    found = periodic.detect(spark.createDataFrame([(1, VERY_LONG)], "doc_id long, text string")).head()
    assert (found.n_words, [tuple(r) for r in found.runs], found.collapsed) == (300_000, [(0, 300_000, 9)], VERY_LONG[: 9 * 6 - 1])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_runs_of_numbers(lists, bounds):
    """Also with exponents from 2 on, where runs overlap most; sequences beside each other do not mix."""
    found = periodic.find(np.array(sum(lists, []), dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64), *bounds)
    got = [[] for _ in lists]
    for row, *run in zip(*(c.tolist() for c in found), strict=True):
        got[row].append(tuple(run))
    assert got == [runs_by_brute_force(x, *bounds) for x in lists]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_ranks(values):
    values = np.array([*values, -1])
    order = sorted(range(len(values)), key=lambda i: values[i:].tolist())
    levels = periodic.suffix_ranks(values)
    assert np.argsort(levels[-1]).tolist() == order
    shared = [0] + [next(k for k in range(len(values)) if values[a + k] != values[b + k]) for a, b in itertools.pairwise(order)]
    assert periodic.neighbours_lcp(levels, np.array(order)).tolist() == shared
    after = periodic.next_smaller(levels[-1], len(values))
    smaller = [next((j for j in range(i + 1, len(values)) if levels[-1][j] < levels[-1][i]), None) for i in range(len(values))]
    assert all(b is None or a == b for a, b in zip(after.tolist(), smaller, strict=True))


# Filters


def interactions_by_brute_force(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, text, *_ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    judged = []
    for d, text, source, *_ in rows:
        text, ws = text or "", split(text)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and least[text] < d}
        judged.append((source or "", fails, d in good, d in toxic))
    out = []
    for part in sorted({j[0] for j in judged}):
        mine = [j for j in judged if j[0] == part]
        shapley, some = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                failing = [j for j in mine if j[1][f]]
                shapley[f] += len(gone)
                some.append((f, part, order, k + 1, len(left), len(gone), len(failing) - len(gone), sum(sum(j[1].values()) == 1 for j in failing), sum(j[2] for j in gone), sum(j[3] for j in gone)))
        out += [(*r[1:], shapley[r[0]]) for r in some]
    return out


def test_filters(spark, docs, none):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = [*ROWS, *((100 + i, "one text of all", f"s{i % 3}", None) for i in range(200))]
    got = audit.interactions(docs.unionByName(spark.createDataFrame(rows[len(ROWS) :], SCHEMA)), labels)
    assert got.columns == columns and [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert sorted(map(tuple, got.collect())) == sorted(interactions_by_brute_force(rows, LABELS))
    assert audit.interactions(none, labels).count() == 0
    assert sorted(map(tuple, audit.interactions(docs, labels.limit(0)).collect())) == sorted(interactions_by_brute_force(ROWS, []))
    first = {(r.part, r.filter): r.documents for r in audit.first_failures(docs, labels, "EDCBA").collect()}
    assert sum(first.values()) == len(ROWS) and first["s2", "D"] == 1


def test_walk_visits_every_order():
    order, seen = list("ABCDE"), {"ABCDE"}
    for k in audit.swaps(5):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add("".join(order))
    assert len(seen) == 120 and sum(1 for _ in audit.swaps(5)) == 119


# Licenses


def low_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def base_by_brute_force(text):
    ws = low_words(text)
    places = sorted((i, t.label) for t in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(t.text.split())] == t.text.split())
    return len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_licenses(spark, docs, none):
    mit = next(t.text for t in licenses.NOTICES if t.label == "mit")
    bsd = next(t.text for t in licenses.NOTICES if t.label == "bsd-3")
    cut = mit.split()
    edited = " ".join([*cut[:20], "kindly", *cut[20:40], *cut[43:70], "and", "x", *cut[70:]])
    more = [
        (50, f"Start. {mit} End"), (51, edited), (52, " ".join(cut[:30])), (53, f"{bsd} {mit} {mit}"), (54, "licensed under the gnu general public license version 2"),
        (55, "LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3"), (56, " ".join(f"{w} gap gap gap" for w in cut)), (None, "apache license version 2 apache license version 2 0 under the mit license"), (57, "cc by nc " * 3000),
    ]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = licenses.report(rows)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = got.collect()
    expected = [(r[0], *base_by_brute_force(r[1])) for r in [*ROWS, *more]]
    assert sorted((repr(tuple(r)[:6]) for r in found)) == sorted(map(repr, expected))
    of = {r.doc_id: r for r in found}
    assert of[50].labels == "mit" and of[50].score == 1 and of[50].n_base == 0
    assert of[51].labels == "mit" and 0.8 < of[51].score < 1
    assert of[52].labels == "" and 0.2 < of[52].score < 0.5
    assert of[53].labels == "bsd-3,mit"
    assert (of[54].labels, of[55].labels, of[56].labels, of[1].labels) == ("gpl-2", "gpl-3", "", "")
    assert (of[57].labels, of[57].n_base, of[57].score, of[1].score) == ("cc-by-nc", 3000, 1.0, 0.0)
    assert licenses.report(none).count() == 0
    assert [tuple(r)[5:] for r in licenses.report(docs, licenses.NOTICES).where("doc_id = 12").collect()] == [("", "", 0.0)]
    spans = licenses.detect(rows).where("doc_id = 53").head().spans
    assert [(s.label, s.end - s.start) for s in spans if s.label] == [("bsd-3", len(low_words(bsd))), ("mit", len(low_words(mit))), ("mit", len(low_words(mit)))]
    with pytest.raises(ValueError):
        licenses.table([licenses.Template("x", "two words")])


@pytest.mark.parametrize("name", ["op11_license_scan", "op13_filter_audit"])
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    names, found = duck(queries.ORACLE_SQL[name])
    at = [names.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in found)


def test_runs_query(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    some = [(r.doc_id, r.text) for r in texts if len(split(r.text)) < 400]
    wanted = {d for d, _ in some}
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, DATA).collect() if r.doc_id in wanted]
    assert sorted(got) == sorted(report_by_brute_force(*r) for r in some)
