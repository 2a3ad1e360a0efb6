"""The vectorised words, encoders and file format against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, jaccard, neighbours, quality, token_files, words, wrappers

TEXT = st.text(alphabet="aB é\n\t-1.'st 漢\x1c\x85", max_size=60)


def lists(w, n):
    return [[w.text[a:b].tobytes() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)] for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words(texts):
    raw = [t.encode() for t in texts]
    w = words.split(raw)
    assert lists(w, len(raw)) == [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in raw]
    lower = words.split(raw, words.NOT_ALNUM, words.LOWER)
    assert lists(lower, len(raw)) == [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for t in raw]
    known = {}
    for x, h in zip([x for row in lists(w, len(raw)) for x in row], w.hashes().tolist(), strict=True):
        assert known.setdefault(x, h) == h
    assert len(set(known.values())) == len(known)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_min(values, n):
    assert words.sliding_min(np.array(values), n).tolist() == [min(values[i : i + n]) for i in range(len(values) - n + 1)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Bpe(bpe.read_ranks())


@settings(max_examples=500, deadline=None)
@given(text=TEXT)
def test_bpe_equals_merging_by_rank(encoder, text):
    plain = tiktoken.Encoding("own", pat_str=regex.compile(bpe.public_tokenizers.PATTERN).pattern, mergeable_ranks={t: i for i, t in enumerate(encoder.tokens)}, special_tokens={}) if not hasattr(encoder, "plain") else encoder.plain
    encoder.plain = plain
    ids = encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [b" ".join(rng.choice([b"a", b"bc", b"def", b"g" * 90], 400)), b"x" * 1000, b"a bc " + b"y" * 300]
    w = words.split(texts)
    whole = w.hashes(), words.windows(w.hashes(), 7)
    monkeypatch.setattr(words, "BLOCK", 64)
    assert np.array_equal(w.hashes(), whole[0]) and np.array_equal(words.windows(whole[0], 7), whole[1])


def test_tokenizer_by_chunks(monkeypatch):
    random.seed(1)
    monkeypatch.setattr(token_files, "CHUNKS", 300)
    made = token_files.Encoder(open(token_files.TOKENIZER).read())
    texts = ["".join(random.choice("ab eé'st \n\t 12漢.,!\x1c\x85") for _ in range(random.randrange(40))) for _ in range(3000)] + ["x<|endoftext|> y", "a" * 500 + " " + "b" * 700, ""]
    found = [x for a in range(0, len(texts), 64) for x in made.encode(pa.array(texts[a : a + 64]))]
    assert found == [made.one(x) for x in texts]


def test_chunks_are_encoded_once(monkeypatch):
    """op7_token_files: a word is encoded once for all words that a line break or further spaces put beside it, not once for each pair."""
    words_ = [a + b for a in "kmnprt" for b in ("abel", "iron", "ém", "ost", "ul")]
    lines = [f"so {a}.\n{b}\n{a} x" for a in words_ for b in words_]
    spaces = [f"so {a}  {b} x" for a in words_ for b in words_]
    made = token_files.Encoder(open(token_files.TOKENIZER).read())
    expected = [made.one(x) for x in lines + spaces]
    encoded, singly = [], []
    learn, one = token_files.Encoder.learn, made.tokenizer.encode
    monkeypatch.setattr(token_files.Encoder, "learn", lambda self, new, *space: encoded.extend(new) or learn(self, new, *space))
    monkeypatch.setattr(token_files.Encoder, "one", lambda self, x: singly.append(x) or np.array(one(x, add_special_tokens=False).ids, "<u4").tobytes())
    made.first.encode = made.tails.encode = made.one
    found = [x for texts in (lines, spaces) for a in range(0, len(texts), 100) for x in made.encode(pa.array(texts[a : a + 100]))]
    assert found == expected
    assert len(encoded) <= 4 * len(words_) and len(singly) <= 4 * len(words_)


def test_chunks_of_every_character():
    """Arrow's letters and white space fit the tokenizer's, wherever texts are cut by them; large strings too."""
    made = token_files.Encoder(open(token_files.TOKENIZER).read())
    texts = [f"a{c} b\n{c}c x{c}. {c}!\n{c}.\nx{c}\ny{c}\n{c}; q {c}{c}\nq" for c in map(chr, [*range(0x3100), *range(0xA640, 0xAC00), *range(0x1E900, 0x1E960)])]
    assert made.encode(pa.array(texts, pa.large_string())) == [made.one(x) for x in texts]


def test_token_file(tmp_path):
    path = f"file://{tmp_path}/a.zst"
    fs, inner = pa.fs.FileSystem.from_uri(path)
    writer = token_files.ShardWriter(fs.open_output_stream(inner, compression=None))
    docs = [[(1, [5, 6]), (2, [])], [(9, [70000])]]
    for frame in docs:
        writer.frame(token_files.pack([i for i, _ in frame], [np.array(x, "<u4").tobytes() for _, x in frame]))
    writer.close()
    file = token_files._open(path)
    table = token_files.read_table(file)
    for entry, frame in zip(table, docs, strict=True):
        assert [(i, np.frombuffer(x, "<u4").tolist()) for i, x in token_files.unpack(token_files.read_frame(file, entry))] == frame
    raw = bytearray((tmp_path / "a.zst").read_bytes())
    raw[-12] ^= 1  # a checksum in the table
    (tmp_path / "b.zst").write_bytes(raw)
    bad = token_files._open(f"file://{tmp_path}/b.zst")
    with pytest.raises(ValueError):
        for entry in token_files.read_table(bad):
            token_files.read_frame(bad, entry)


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_divide_skip(data):
    values = st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True).map(sorted)
    query = np.array(data.draw(values), dtype=np.uint64)
    sets = [np.array(x, dtype=np.uint64) for x in data.draw(st.lists(values, min_size=1, max_size=8))]
    needed = [data.draw(st.integers(1, 12)) for _ in sets]
    assert jaccard.divide_skip(query, sets, needed) == [i for i, s in enumerate(sets) if len(np.intersect1d(query, s)) >= needed[i]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), min_size=2, max_size=2))
def test_bitmaps_never_drop_a_link(texts):
    row, value, sizes = jaccard.shingle_sets([t.encode() for t in texts])
    if not sizes.all():
        return
    bits = jaccard.bitmaps(row, value, sizes)
    a, b = value[: sizes[0]], value[sizes[0] :]
    both = len(np.intersect1d(a, b))
    if 100 * both >= 80 * (len(a) + len(b) - both):
        assert jaccard.may_link(int(sizes[0]), bits[0], int(sizes[1]), bits[1])


def test_router_finds_neighbours():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(12, size=3000)]
    router = neighbours.fit(x[:2000], 8)
    own, order = router.order(x, 1)[:, 0], router.order(x[:200], router.probes)
    near = neighbours.neighbour_graph(x, 10)[:200]
    assert np.mean([np.isin(own[n], o).mean() for n, o in zip(near, order, strict=True)]) >= 0.9
    part = neighbours.balanced_parts(x[:2000], neighbours.neighbour_graph(x[:2000]), 8)
    assert np.bincount(part, minlength=8).max() <= 1.1 * 250 + 1


def test_classifier():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("th", "er", "on", "an")) for _ in range(3))
    good = [" ".join(word() for _ in range(60)) for _ in range(150)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(75)] + [" ".join([word()] * 30 + [word()] * 30) for _ in range(75)]
    model = quality.fit([(t, 1) for t in good[:100]] + [(t, 0) for t in bad[:50] + bad[75:125]])

    def score(text):
        found = [b for b, _ in quality.features(words.split([text.encode()]))]
        return model.offset + np.concatenate([model.table[b] for b in found]).mean()

    right = [score(t) > 0 for t in good[100:]] + [score(t) < 0 for t in bad[50:75] + bad[125:]]
    assert np.mean(right) >= 0.95
    assert np.array_equal(model.table, quality.fit([(t, 1) for t in good[:100]] + [(t, 0) for t in bad[:50] + bad[75:125]]).table)
    assert quality.fit([]).prior == 0.5 and quality.fit([("a b", 1), (None, 1)]).prior > 0.5


PAGES = [
    '<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five</article><footer>f</footer></body></html>',
    '<html><body><nav><ul><li>x<li>y</ul></nav><article><h1>C</h1><p>six</p><div class="comments"><p>no</p></div></article><aside>s</aside><!-- <p>gone --><script>var a = "</p>";</script>',
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    found = wrappers.common(a, b)
    assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_long_pages_are_aligned():
    rng = random.Random(2)
    pages = ["".join(rng.choice(("<p>x</p>", "<h2>y</h2>", "<ul><li>z</li></ul>", "<hr>")) for _ in range(4000)) for _ in range(2)]
    wrapper = wrappers.infer([wrappers.stream(p) for p in pages])
    assert wrapper


def test_blocks_belong_to_slots():
    wrapper = "<ul>(<li>#)+</ul><div>#</div><div>(<h2>#</h2><p>#)+</div>(<p>#)?"
    reader = wrappers.Reader(wrapper)
    found = [(b.slot, b.text) for b in reader.blocks("<ul><li>a<li>b</ul><div>c</div><div><h2>d</h2><p>e<h2>f</h2><p>g</div><p>h<form>i</form>")]
    assert found == [(0, "a"), (0, "b"), (1, "c"), (2, "d"), (3, "e"), (2, "f"), (3, "g"), (4, "h"), (-1, "i")]
    found = [(b.slot, b.text) for b in reader.blocks("<div><h2>d</h2><p>e</div>")]
    assert found == [(2, "d"), (3, "e")]  # what a page leaves out moves nothing
    assert reader.blocks("") == [] and [b.slot for b in wrappers.Reader("").blocks("x<p>y")] == [-1, -1]


def test_turns_hold_whole_elements():
    assert wrappers.fold("<div><div><div>#</div><div>#</div></div></div>") == "<div><div>(<div>#</div>)+</div></div>"
    assert wrappers.fold("<p>#<p>#<p>#") == "(<p>#)+" and wrappers.fold("<div><div></div></div>") == "<div><div></div></div>"


def test_names_of_several_parts():
    assert [wrappers._names_aside(x) for x in ("cookie-notice", "with-sidebar", "sidebar", "site_nav", "entry-header", "menu-button-text")] == [True, False, True, True, False, False]


def test_wrappers():
    streams = [wrappers.stream(p) for p in PAGES]
    wrapper = wrappers.infer(streams)
    assert all(wrappers.accepts(wrapper, s) for s in streams)
    reader = wrappers.Reader(wrapper)
    assert reader.text(PAGES[0]) == "A & B\none two three four\nfive"
    assert reader.text(PAGES[1]) == "C\nsix"
    assert reader.text("") == "" and wrappers.Reader("").text("plain &lt;") == "plain <"
    assert wrappers.infer([wrappers.stream("<ul><li>a<li>b</ul><p>x"), wrappers.stream("<ul><li>a</li></ul><h1>q</h1><p>x</p><p>y")]).startswith("<ul>(<li>#)+</ul>")
    assert wrappers.Reader("").text('<div class="cookie-notice">no</div><form>q</form><p>yes</p><header>h</header>') == "yes"
