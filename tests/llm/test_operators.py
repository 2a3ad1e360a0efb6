"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and clashing columns."""

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, host_reputation, jaccard, neighbours, passages, quality, queries, shared, token_files, words, wrappers

LONG = " ".join(f"w{i % 5000}" for i in range(40_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, f"start one {PASSAGE} end one"), (2, f"begin two {PASSAGE} finish two"), (2, f"begin two {PASSAGE} finish two"), (3, None), (4, ""), (5, " \n "), (None, f"x {PASSAGE}"),
    (6, LONG), (7, LONG + " tail"), (8, "Few words here"), (9, "few WORDS here"), (10, "é ü"), (11, f"{PASSAGE} " * 2),
]
SCHEMA = "doc_id long, text string"


def linked_by_brute_force(rows, percent=80):
    """(doc_id, shingles, component) by comparing all pairs; a null doc_id links with nothing."""
    sets = []
    for doc, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 5 + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and None not in (rows[i][0], rows[j][0]) and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated(rows, length=50):
    first = {}
    cut = [((t or "").split(), d) for d, t in rows]
    for ws, d in cut:
        for i in range(len(ws) - length + 1):
            k = tuple(ws[i : i + length])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for ws, d in cut:
        gone = set()
        for i in range(len(ws) - length + 1):
            if d is not None and first[tuple(ws[i : i + length])] < d:
                gone |= set(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("operator", [passages.substring_dedup, passages.suffix_dedup])
def test_passages(docs, none, operator):
    assert sorted(map(tuple, operator(docs).collect()), key=str) == repeated(ROWS)
    assert sorted(map(tuple, operator(docs, most=0).collect()), key=str) == repeated(ROWS)
    assert operator(none).count() == 0
    assert operator(none, most=-1).count() == 0


@pytest.mark.parametrize("operator", [passages.substring_dedup, passages.suffix_dedup])
def test_passages_of_random_words(spark, operator):
    rng = np.random.default_rng(8)
    parts = [[f"r{i}" for i in rng.integers(0, 4, 12)] for _ in range(5)]
    rows = [(int(d), " ".join(w for k in rng.integers(0, 5, int(n)) for w in parts[k])) for d, n in zip(rng.integers(0, 50, 60), rng.integers(0, 9, 60), strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (passages.TABLE, 0):
        assert sorted(map(tuple, operator(df, 9, most).collect()), key=str) == repeated(rows, 9)


def test_suffixes_need_their_order(monkeypatch):
    texts = [b"a b c d x y z q", b"b c d x y r", b"z c d x y z q", b"a b c d x y z q s"]
    args = texts, np.array([3, 2, 2, 3]), np.array([1, 2, 3, 4]), np.array([1, 2, 3, 4]), 5, 2
    rows = lambda found: sorted(zip(*(c.tolist() for c in found), strict=True))
    found = rows(passages.sorted_suffixes(*args))
    assert found == rows(passages.sorted_windows(*args)) == [(1, 0, 1), (2, 1, 1), (2, 2, 1), (3, 0, 1), (3, 1, 1), (3, 2, 1), (3, 3, 1)]
    monkeypatch.setattr(passages, "sorted", lambda x, key: list(x), raising=False)
    assert rows(passages.sorted_suffixes(*args)) != found


def test_passages_keep_extra_columns(docs):
    clash = docs.select(F.lit(1).alias("digest"), "*", F.lit(2).alias("n_words"), F.lit(3).alias("__spans"), F.lit("x").alias("key"))
    for most in (passages.TABLE, 0):
        rows = passages.remove(clash, passages.suffix_repeats(clash), most).collect()
        assert {(r["digest"], r["key"], r["__spans"]) for r in rows} == {(1, "x", 3)} and {r.n_words for r in rows if r.doc_id == 1} == {64}


def test_jaccard(docs, none):
    assert sorted(map(tuple, jaccard.join(docs).collect()), key=str) == sorted(linked_by_brute_force(ROWS), key=str)
    assert jaccard.join(none).count() == 0
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("n", "__id", "__key", "sig")))
    kept = jaccard.deduplicate(clash)
    assert kept.columns == clash.columns
    kept = sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None)
    assert [k for _, k in kept] == [1, 3, 4, 5, 6, 8, 10]


def test_near_copies_of_one_text(spark):
    base = [f"b{i}" for i in range(120)]
    rng = np.random.default_rng(5)
    rows = []
    for d in range(60):
        ws = list(base)
        for i in rng.choice(120, size=d % 7, replace=False):
            ws[i] = f"m{d}_{i}"
        rows.append((d, " ".join(ws)))
    found = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == sorted(linked_by_brute_force(rows))


def test_lists_in_cells_and_shared_hashes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(d, " ".join([f"x{d // 3}_{i}" for i in range(int(rng.integers(1, 4)))] + [common])) for d in range(90)]
    monkeypatch.setattr(jaccard, "CELL", 7)
    monkeypatch.setattr(jaccard, "HOT", 1)
    two = jaccard.signatures
    monkeypatch.setattr(jaccard, "signatures", lambda *a: (two(*a)[0] >> 57, two(*a)[1]))
    found = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == sorted(linked_by_brute_force(rows))


def test_near_copies_of_short_texts(spark):
    w = [f"s{i}" for i in range(40)]
    eight = " ".join(w[1:9])
    texts = [eight, " ".join(w[:9]), " ".join(w[1:10]), " ".join(w[1:8]), " ".join(w[20:28]), " ".join(w[20:29]), " ".join(w[20:30]), " ".join(w[30:34]), " ".join(w[30:35]), " ".join(w[30:36]), eight.upper()]
    rows = [(d, t) for d, t in enumerate(texts, 1)]
    found = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == sorted(linked_by_brute_force(rows))
    assert {c for d, _, c in found if d in (1, 2, 3, 11)} == {1} and {c for d, _, c in found if d in (5, 6, 7)} == {5}


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(7, " ".join(f"p{i}" for i in range(5, 30))), (10, "few words"), (9, "..."), (8, None), (None, "w1 w2"), (7, "FINISH two")], "item_id long, text string")
    found = {(r.doc_id, r.n_words): r for r in decontaminate.report(docs, bench).collect() if r.doc_id is not None}
    assert {k: (r.n_hit, r.n_items) for k, r in found.items() if r.contaminated} == {(1, 64): (25, 1), (2, 64): (27, 1), (6, 40000): (16, 0), (7, 40001): (16, 0), (8, 3): (2, 1), (9, 3): (2, 1), (11, 120): (50, 1)}
    assert found[8, 3].items_sha256 == hashlib.sha256(b"10").hexdigest() and found[3, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    small = {tuple(r)[:4] for r in decontaminate.scan(docs.where("doc_id < 3"), bench, most=3).select("doc_id", "n_words", "n_hit", F.size("items")).collect()}
    assert small == {(1, 64, 25, 1), (2, 64, 27, 1)}
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_added_columns_replace_those_of_their_names(spark, docs):
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("token_ids", "score", "items", "n_hit", "other")))
    bench = spark.createDataFrame([(10, "few words")], "item_id long, text string")
    made = bpe.encode(clash)
    assert made.columns.count("token_ids") == 1 and {r.other for r in made.collect()} == {1}
    scored = quality.score(clash, quality.fit([]))
    assert scored.columns.count("score") == 1 and {r.score for r in scored.collect()} == {0.5}
    found = decontaminate.scan(clash, bench)
    assert found.columns.count("items") == 1 and {(r.n_hit, tuple(r["items"])) for r in found.where("doc_id IN (8, 9)").collect()} == {(2, ("10",))}
    kept = decontaminate.decontaminate(clash, bench)
    assert kept.columns == clash.columns and kept.count() == len(ROWS) - 2


def test_bpe(docs, none):
    one = bpe.Bpe(bpe.read_ranks())
    found = sorted(map(tuple, bpe.round_trip(docs).collect()), key=str)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert found == sorted(((d, len(one.encode(t or "")) // 4, digest(one.encode(t or "")), digest((t or "").encode())) for d, t in ROWS), key=str)
    assert bpe.round_trip(none).count() == 0
    both = bpe.decode(bpe.encode(docs)).select("text", F.col("decoded").cast("string")).collect()
    assert all((r[0] or "") == r[1] for r in both)


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.TOKENIZER)
    index = token_files.write(docs, frame_bytes=64)
    found = [tuple(r) for r in token_files.read(index).select("doc_id", "start", "n_tokens", F.crc32("token_ids")).orderBy("start").collect()]
    at, expected = 0, []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == expected
    part = token_files.read_frames(token_files.starts(index).where("first_id <= 9 AND last_id >= 9"))
    assert 9 in {r.doc_id for r in part.collect()} and part.count() < len(ROWS)
    assert token_files.written(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, None), (6, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id is not None} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in ROWS if d is not None}
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_of_a_fit_with_a_text_beyond_its_bytes(spark):
    """One labelled text that is longer than all that a fit may read does not keep others out, wherever it sorts."""
    good, bad = "the river ran past the old mill", "BUY now $$$ click here"
    rows = [(i, " ".join([good if i % 2 else bad] * 3) + f" w{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    for long in (0, 3, 9):
        docs = spark.createDataFrame([(i, "x" * 20_000 if i == long else t) for i, t in rows], SCHEMA)
        found = quality.score(docs, quality.train(docs, labels, most=9_000)).collect()
        assert np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in found if r.doc_id != long]) > 0.9


def test_quality_by_a_plain_score(spark):
    """A document's score from the model by hand: the table's values at its features' buckets, averaged, through the logistic function."""
    docs = spark.createDataFrame([(1, "Some words, some words."), (2, ""), (3, None), (4, "x"), (5, "é " * 50)], SCHEMA)
    model = quality.fit([("good words here", 1), ("bad $$$", 0)] * 20)
    for r in quality.score(docs, model).collect():
        w = words.split([(r.text or "").encode()])
        buckets = [int(b) for bs, _ in quality.features(w, len(model.table)) for b in bs]
        expected = 1 / (1 + np.exp(-(model.offset + np.mean([model.table[b] for b in buckets])))) if buckets else model.prior
        assert r.score == pytest.approx(float(expected))


def test_quality_on_held_out_rows(spark):
    read = lambda t: spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet")
    labels = read("labels")
    rows = quality.classify(read("documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.9


def test_host_reputation(spark, duck):
    pages = [
        (1, "https://Blog.Example.com/en/7?x"), (2, "http://example.com/en/7/1"), (3, "http://a.net/de/81"), (4, "http://example.net/de/8"), (5, "HTTP://x.org/es/#a"), (6, None), (7, "no host"),
        (8, "http://z.com/en/"), (8, "http://z.com/en/"), (9, "http://h:80?q"), (10, "http://bad.example.io/p/1"), (11, "http://notexample.com/en/7"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (81, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    found = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(df, labels).collect() if r.rule)
    assert found == [
        (1, "blog.example.com", "/en/7", "example.com/en/7", "allow"), (2, "example.com", "/en/7/1", "example.com/en/7", "allow"), (3, "a.net", "/de/81", "net/de/", "allow"),
        (4, "example.net", "/de/8", "example.net/de/8", "block"), (5, "x.org", "/es/", "org/es/", "block"), (8, "z.com", "/en/", "com/en/", "block"), (8, "z.com", "/en/", "com/en/", "block"),
        (11, "notexample.com", "/en/7", "com/en/", "block"),
    ]
    rest = {r.page_id: (r.host, r.path) for r in host_reputation.judge(df, labels).collect() if not r.rule}
    assert rest == {6: ("", ""), 7: ("", ""), 9: ("h:80", ""), 10: ("bad.example.io", "/p/1")}
    assert host_reputation.judge(df.limit(0), labels).count() == 0
    assert host_reputation.judge(df, labels.limit(0)).count() == len(pages)


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "www.x.com.", "x.com:80", "10.0.0.7:8080", "[::1]:80", "", "localhost"]
    suffix, domain = host_reputation.domains_of(F.col("h"))
    found = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(suffix, domain).collect()]
    assert found == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("com", "x.com"), ("com", "x.com"), ("10.0.0.7", "10.0.0.7"), ("[::1]", "[::1]"), ("", ""), ("localhost", "localhost")]


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 4}.io/x/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    assert {(r.host[:3], r.verdict) for r in host_reputation.judge(pages, labels).collect()} == {("bad", "block"), ("goo", "allow")}


def test_wrappers(spark):
    page = "<nav>menu</nav><article><h1>T</h1><p>a &amp; b</p></article>"
    rows = [(1, "http://h/1", page), (1, "http://h/1", page), (2, "http://h/2", None), (3, None, "<p>x</p>"), (4, "http://g/", ""), (5, "http://h/3", page.replace("<p>", "<p>c</p>" * 2000 + "<p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("wrapper", F.lit(1))
    found = sorted((r.page_id, r.text, r.n_chars) for r in wrappers.extract(df).collect())
    assert found == [(1, "T\na & b", 7), (1, "T\na & b", 7), (2, "", 0), (3, "x", 1), (4, "", 0), (5, "T\n" + "c\n" * 2000 + "a & b", 4007)]
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_tell_template_from_content(spark):
    rows = [(i, f"http://h/{i}", f"<body class='no-sidebar'><div>Welcome to our site</div><div class='with-sidebar'><p>text {i}</p><p>more {i}</p></div></body>") for i in range(6)]
    rows += [(10, "http://h/10", "<article><p>own</p></article><p>around</p>"), (11, "http://h/11", "<h1 class='main-title'>title</h1><p>below</p>"), (12, "http://h/12", "<h1 class='main'>top</h1><p>under</p>")]
    rows += [(20 + i, "http://copies/", "<p>same</p>") for i in range(9)] + [(30 + i, f"http://near/{i}", f"<nav>{i}</nav><p>same</p>") for i in range(9)]
    rows += [(40 + i, f"http://few/{i}", "<div>Welcome</div><p>x</p>" if i else "<div>Welcome</div><p>y</p>") for i in range(4)]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {
        **{i: f"text {i}\nmore {i}" for i in range(6)}, 10: "own", 11: "title\nbelow", 12: "top\nunder", **{20 + i: "same" for i in range(9)}, **{30 + i: "same" for i in range(9)},
        **{40 + i: "Welcome\nx" if i else "Welcome\ny" for i in range(4)},
    }


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700 + i, x[3].tolist()) for i in range(40)] + [(800, None), (900, [0.0] * 8), (1000, [float("nan")] * 8), (1100, [1.0] * 7 + [None]), (None, x[0].tolist()), (1200, [1.0, 2.0]), (1201, [1.0, 3.0]), (1202, [4.0, 6.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("clash"))
    found = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.pop(1200) == [(1201, 1.0), (1202, 5.0)]
    assert sorted(found) == [0, 100, 200, 300, 400, 500, 700]
    ids = np.array([*range(600), *range(700, 740)])
    y = np.concatenate([x, np.repeat(x[3:4], 40, axis=0)])
    hit = total = 0
    for q, got in found.items():
        d = np.sqrt(((y - y[list(ids).index(q)]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit += len({int(ids[i]) for i in order} & {v for v, _ in got})
        total += len(order)
        assert len(got) == 10
    assert [v for v, _ in found[700]] == [3, *range(701, 710)]
    assert hit / total >= 0.9
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_wrappers_do_not_need_telling_names(spark):
    def page(i):
        return f"<div class='q7'><ul><li>Start</li><li>Imprint</li></ul></div><div class='z1'>Buy now</div><div class='k3'><h1>title {i}</h1>" + "".join(f"<p>text {i} {k}</p>" for k in range(i % 3 + 1)) + "</div><div class='z9'>All rights reserved</div>"

    rows = [(i, f"http://h/{i}", page(i)) for i in range(200)] + [(200 + i, f"http://odd/{i}", "".join(f"<h{1 + (i >> k & 1)}>a{i}{k}</h{1 + (i >> k & 1)}>" for k in range(7))) for i in range(128)]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == "\n".join([f"title {i}", *(f"text {i} {k}" for k in range(i % 3 + 1))]) for i in range(200))
    assert all(found[200 + i] == "\n".join(f"a{i}{k}" for k in range(7)) for i in range(128))


class PlainArticle(HTMLParser):
    """The blocks of h1 and p in article, by the standard library's parser alone."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("h1", "p", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("h1", "p"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    @property
    def text(self):
        return "\n".join(filter(None, (" ".join(b.split()) for b in self.blocks)))


def without_names(page):
    """The page with div for all names of elements that make blocks, and all their ends written out."""
    out, chain, at = [], [], 0
    for m in wrappers._TOKEN.finditer(page):
        out.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name in wrappers.INLINE or name in wrappers.VOID:
            out.append(m[0])
        elif m[2]:
            before = len(chain)
            wrappers.leave(chain, name)
            out.append("</div>" * (before - len(chain)))
        elif name:
            before = len(chain)
            wrappers.enter(chain, name)
            out.append("</div>" * (before + 1 - len(chain)) + f"<div{m[4]}>")
    return "".join([*out, page[at:]])


def test_wrappers_are_a_plain_parser_with_names_or_without(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").toPandas()
    expected = {i: PlainArticle(h or "").text for i, h in zip(pages["page_id"], pages["html"], strict=True)}
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages)).collect()}
    assert found == expected and sum(map(bool, expected.values())) > 40
    one_host = pages.assign(url="http://h/", html=[without_names(h or "") for h in pages["html"]])
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(one_host)).collect()}
    assert found == expected


def test_wrappers_decide_slots_by_their_sums(spark):
    def page(i):
        links = "".join(f"<div><a href='/{i}{k}'>place {i} {k} and more of it</a></div>" for k in range(i % 4 + 1))
        body = "".join(f"<div>Sentence {i} {k} of the text, which is longer than what is around it.</div>" for k in range(i % 3 + 2))
        return f"<div><div>{links}</div><div class='x'>{body}</div><div>Written by author {i}</div></div>"

    rows = [(i, f"http://h/{i}", page(i)) for i in range(30)] + [(40, "http://h/40", "<section><h2>another kind</h2><p>of page</p></section>"), (41, "http://h/41", "<nav>only a menu</nav>")]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == "\n".join(f"Sentence {i} {k} of the text, which is longer than what is around it." for k in range(i % 3 + 2)) for i in range(30))
    assert found[40] == "another kind\nof page" and found[41] == ""


def recall(spark, x, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.search(df, lambda i: i % 100 == 0, **how).collect()
    hit = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        hit += len({int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q and i in {r.vec_id for r in found if r.query_id == q}} & set(np.argsort(np.where(np.arange(len(x)) == q, np.inf, d), kind="stable")[:10].tolist()))
    return hit / len(range(0, len(x), 100)) / 10


def test_neighbours_far_from_the_origin(spark):
    x = 4000 + 1e-6 * np.random.default_rng(3).normal(size=(900, 6))
    assert recall(spark, x, fit_rows=20) == 1.0  # one part: all of it is compared


def test_neighbours_whose_squares_overflow_or_vanish(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    x[7], x[8], x[100], x[109] = 1e200, -1e200, [3e200, 0, 0, 0], 1e-170
    x[200] = [3e-170, 1e-170, 1e-170, 1e-170]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(found) == [0, 100, 200, 300] and all(len(v) == 10 for v in found.values())
    for q in (0, 300):
        d = np.sqrt(((np.delete(x, [7, 8, 100], axis=0) - x[q]) ** 2).sum(1))
        assert np.isclose(found[q][0][1], np.sort(d)[1]) and not {7, 8, 100} & {v for v, _ in found[q]}
    assert np.isclose(found[100][0][1] / 1e200, np.sqrt(4 + 3)) and found[100][0][0] == 7
    assert found[200][0][0] == 109 and np.isclose(found[200][0][1] / 1e-170, 2)


def test_parts_are_cut_again(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4)) + 6 * rng.normal(size=(20, 4))[rng.integers(20, size=3000)]
    assert recall(spark, x, fit_rows=800, split=300) >= 0.9


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(80)
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("score", "hits", "items", "n_hit", "n_words", "n_removed", "kept_text", "sig")))
    clash = clash.unionByName(spark.createDataFrame([(None, None), (90_001, ""), (90_001, "")], SCHEMA), allowMissingColumns=True)
    now = clash
    for name, stage in pipeline.STAGES:
        out = shared.cut(stage(spark, now, DATA))
        if name != "encode":
            assert out.columns == clash.columns and 0 < out.count() <= now.count()
        else:
            assert out.count() == now.count()
        empty = stage(spark, clash.limit(0), DATA)
        assert empty.count() == 0
        now = out
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts


def test_pipeline_is_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(4)
    say = lambda kind, n: [f"{kind}{i}" for i in rng.integers(0, 300, n)]
    good = [say("good", int(n)) for n in rng.integers(30, 90, 60)]
    passage, item, short = say("good", 55), say("good", 12), say("good", 10)
    near = list(good[5])
    near[0] = "good_other"
    good += [near, list(good[7]), short[1:9], short[:9], short[1:], say("good", 80) + passage, say("good", 90) + passage + say("good", 40), passage + say("good", 70), passage]
    good += [say("good", 20) + item + say("good", 20), say("good", 40) + [item[0].upper(), *item[1:]]]
    bad = [say("bad", int(n)) for n in rng.integers(30, 90, 40)]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(good, 1)] + [(i, " ".join(ws)) for i, ws in enumerate(bad, 1001)]
    d = str(tmp_path)
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, "nowhere at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    kept = {"quality": [r for r in rows if r[0] < 1000]}
    own = {i for i, _, c in linked_by_brute_force(kept["quality"]) if i == c}
    kept["near_duplicates"] = [r for r in kept["quality"] if r[0] in own]
    assert len(kept["near_duplicates"]) == len(good) - 4
    first, kept["repeated_passages"] = set(), []
    for i, text in kept["near_duplicates"]:
        ws = text.split()
        windows = [tuple(ws[k : k + 50]) for k in range(len(ws) - 49)]
        gone = {k + j for k, w in enumerate(windows) if w in first for j in range(50)}
        first |= set(windows)
        if len(gone) < len(ws):
            kept["repeated_passages"].append((i, " ".join(w for k, w in enumerate(ws) if k not in gone) if gone else text))
    assert sum(len(t) for _, t in kept["near_duplicates"]) > sum(len(t) for _, t in kept["repeated_passages"])
    kept["benchmark_passages"] = [r for r in kept["repeated_passages"] if not any(f" {' '.join(item[k : k + 10])} " in f" {r[1].lower()} " for k in range(3))]
    assert len(kept["benchmark_passages"]) == len(kept["repeated_passages"]) - 2
    one = bpe.Bpe(bpe.read_ranks())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    tokens = sorted((i, digest(one.encode(t)), digest(t.encode())) for i, t in kept["benchmark_passages"])

    now = spark.createDataFrame(rows, SCHEMA)
    for name, stage in pipeline.STAGES:
        now = shared.cut(stage(spark, now, d))
        if name == "encode":
            assert sorted(map(tuple, now.select("doc_id", "ids_sha256", "decoded_sha256").collect())) == tokens
        else:
            assert sorted(map(tuple, now.select("doc_id", "text").collect())) == kept[name], name


def test_pipeline_query_is_whole(spark):
    assert pipeline_rows(spark) > 0
    assert "pipeline" in queries.QUERIES


def pipeline_rows(spark):
    import corpus_pipeline as pipeline

    return pipeline.run(spark, DATA).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    names, found = duck(queries.ORACLE_SQL[name])
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in found)
