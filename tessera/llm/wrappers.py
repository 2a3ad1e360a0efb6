"""HTML extraction by union-free regular expressions, one inferred for each host.

A page is a stream of tokens: block-level start and end tags (with their class, id and role words) and text slots.
Inline tags do not break a slot, comments and raw-text elements are no tokens, end tags that HTML lets out (p, li, td,
...) are dropped so that sloppy and tidy pages agree. Streams of one host are aligned one after the other:

* a run of equal neighbours becomes a repeated group (...)+,
* what only one of two aligned streams has becomes an optional group (...)?,
* texts become slots #.

The result, the host's wrapper, is a regular expression without unions; a stream that it accepts already does not change it.
Tasks first fold streams and count distinct ones, so a host with a third of all pages sends few rows; streams are merged
in groups of 64 by (host, salt), in rounds, until each host has one. Wrappers of all hosts are joined to pages by broadcast only if they are
small in bytes. Alignment takes memory linear in the streams, so very long pages are aligned like others.

Each page is then matched with its host's wrapper. Both are trees of elements and slots; from the root down, an element's children are
given to those of the same key in the wrapper's element (also inside optional elements, which the page may leave out), in order: first one that holds the same
kinds of elements, ahead or else before, then any one of that key. Children in a repeated group may be taken again and again. So each block of text (block-level tags end one; character references are
decoded, white space becomes one space) belongs to a slot of the wrapper, or to none if the wrapper has no such place.

For each host, slot and kind of element right around its texts it is summed over the host's different pages on how many it is, with how many different texts, with how many characters and how many of
these in links. Hosts with at least 5 different pages take the roles of slots from these sums:

* a slot in such an element, on 5 pages or more, whose texts are each on half of its pages on average, is template,
* the region of the host is found by going down the wrapper from the root into the element that holds 60 % or more of the characters outside links, templates
  and elements with names of asides, as long as there is one that has elements of its own,
* a slot has votes: +1 in the region, -1 out of it, -1 if half of its characters are in links, and a page's block there +1 if its element is a heading, paragraph, item or cell, +2 in an
  article or main element. The block is main if they are not negative and no element around it has the name of an aside.

So names (of tags, whole class and id names and roles) are one feature among others; hosts with fewer pages, and places unknown to the wrapper, have names only. Of a page's
main blocks, those in an article or main element are its text, if there are any, else all of them; templates are left out, unless nothing else
remains: then the page is one of many copies. A page with no main block is of another kind than its host's pages: it is read by names only.

An empty table gives no rows. A null html is an empty page, a null url has the empty host. A page without main text has the empty text. Repeated
rows are pages of their own. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import html as _html
import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.host_reputation import parts

#: Streams of one host that a task merges at once; more are merged in rounds.
GROUP = 64
#: Different pages that a template slot is on, at least; part of them that one of its texts is on, on average.
PAGES, SHARE = 5, 0.5
#: Part of a host's text that an element holds, at least, to contain its region; part of a slot's characters that are links, to count as links.
REGION, LINKS = 0.6, 0.5
#: Hosts whose wrappers may be broadcast (about 1 KB each).
HOSTS = 20_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMING = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag HTML lets out, and which open elements a start tag ends.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Elements, and class, id or role words, that are not main text.
ASIDE_TAGS = frozenset("nav header footer aside form head button dialog menu input script style noscript template textarea iframe svg title select object".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead footer contentinfo sidebar aside complementary notice notices alert cookie cookies consent banner ad ads advert adverts advertisement"
    " advertising sponsor sponsored promo promotion comment comments respond reply replies disqus share sharing social related breadcrumb breadcrumbs newsletter subscribe subscription"
    " popup modal widget toolbar copyright form search login signup pagination pager".split()
)
#: Such words that also count at the end of a name of several parts (cookie-notice), but not after those that say whether something is there.
ASIDE_ENDS = ASIDE_WORDS - frozenset("header masthead form search login signup share sharing related".split())
SAYS_WHETHER = frozenset("with without has have no not is show hide".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that the name main makes main; elements that are around main text, whatever they are called.
MAIN_BOXES = frozenset(("div", "section", "td", "center"))
NEVER_ASIDE = frozenset(("html", "body", "main", "article"))
#: Elements that hold running text, items or cells.
PROSE_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th figcaption".split())


def _key(name: str, attributes: str) -> str:
    """Name and sorted class, id and role names of a start tag."""
    if "=" not in attributes:
        return name
    found = {w for m in _NAMING.finditer(attributes) for w in re.sub(r"[^\w\s-]", "_", (m[2] or m[3] or m[4] or "").lower()).split()}
    return ".".join([name, *sorted(found)]) if found else name


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(kind, value): "<" key, ">" name, "#" raw text, "-" an inline tag (its name, after a slash if it ends)."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "#", page[at : m.start()]
        at = m.end()
        if m[3]:
            name = m[3].lower()
            if name in INLINE:
                yield "-", m[2] + name
            elif m[2]:
                yield ">", name
            else:
                yield "<", _key(name, m[4])
    if at < len(page):
        yield "#", page[at:]


def enter(chain: list[str], key: str) -> None:
    """Opens an element, and ends those that its start tag ends."""
    name = key.partition(".")[0]
    ends = _ENDS.get(name, {"p"})
    while chain and chain[-1].partition(".")[0] in ends:
        chain.pop()
    if name not in VOID:
        chain.append(key)


def leave(chain: list[str], name: str) -> None:
    """Closes the last open element of that name, and what is open in it; nothing if there is none."""
    for i in range(len(chain) - 1, -1, -1):
        if chain[i].partition(".")[0] == name:
            del chain[i:]
            return


_ITEM = re.compile(r"<[^<>]*>|#|\([^()]*\)[+?]")
_AGAIN = re.compile(r"(\(([^()]*)\)\+)\2")
#: Items that a turn of a repeated group has, at most, when it is found.
TURN = 12


def _whole(turn: list[str]) -> bool:
    """Whether all elements that begin in a turn end in it, and no others (but for those that have no end tag in streams)."""
    names: list[str] = []
    for item in turn:
        if item[:2] == "</":
            if not names or names.pop() != item[2:-1]:
                return False
        elif item[0] == "<":
            name = item[1:-1].partition(".")[0]
            if name not in LOOSE and name not in VOID:
                names.append(name)
    return not names


def fold(stream: str) -> str:
    """Runs of equal neighbours become repeated groups (one level, the innermost runs first); a turn holds whole elements."""
    while True:
        items, out, i = _ITEM.findall(stream), [], 0
        while i < len(items):
            for k in range(1, min(TURN, (len(items) - i) // 2) + 1):
                if items[i] == items[i + k] and items[i : i + k] == items[i + k : i + 2 * k]:
                    turn, grouped = items[i : i + k], any(x[0] == "(" for x in items[i : i + k])
                    if (turn[0].endswith(")+") and k == 1) if grouped else _whole(turn):
                        end = i + 2 * k
                        while items[end : end + k] == turn:
                            end += k
                        out.append(turn[0] if grouped else f"({''.join(turn)})+")
                        i = end
                        break
            else:
                out.append(items[i])
                i += 1
        new = _AGAIN.sub(r"\1", "".join(out))
        if new == stream:
            return stream
        stream = new


def stream(page: str) -> str:
    """The folded token stream of a page."""
    out: list[str] = []
    for kind, value in tokens(page):
        if kind == "<":
            out.append(f"<{value}>")
        elif kind == ">":
            if value not in LOOSE:
                out.append(f"</{value}>")
        elif kind == "#" and (not out or out[-1] != "#") and not value.isspace():
            out.append("#")
    return fold("".join(out))


def _bare(item: str) -> str:
    return item[1:-2] if item[0] == "(" else item


def _joined(x: str, y: str) -> str:
    """Of two items with equal content: optional if one is, else repeated if one is."""
    if x == y:
        return x
    kinds = {i[-1] if i[0] == "(" else "" for i in (x, y)}
    return f"({_bare(x)})?" if "?" in kinds else f"({_bare(x)})+"


def _regroup(stream: str, like: str) -> str:
    """The stream, with what is a repeated group in another one written as that group."""
    for group in sorted({g for g in _ITEM.findall(like) if g.endswith(")+")}, key=len, reverse=True):
        inner = re.escape(group[1:-2])
        stream = re.sub(rf"\([^()]*\)[+?]|(?:{inner})+", lambda m, g=group: m[0] if m[0][0] == "(" else g, stream)
        stream = stream.replace(f"({group[1:-2]})?{group}", group).replace(f"{group}({group[1:-2]})?", group).replace(group + group, group)
    return stream


def _prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a and of each prefix of b, from the empty one on. The bits of one number stand for b."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks = {}
    for x in set(a) & places.keys():
        bits = np.zeros(len(b), dtype=np.uint8)
        bits[places[x]] = 1
        masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = now = (1 << len(b)) - 1
    for x in a:
        both = now & masks.get(x, 0)
        now = ((now + both) | (now - both)) & full
    left = np.unpackbits(np.frombuffer(now.to_bytes(-(-len(b) // 8), "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - left.astype(np.int64))])


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both lists, by halving a, in memory linear in their lengths."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append((a0, b.index(a[a0], b0, b1)))
            continue
        mid = (a0 + a1) // 2
        left, right = _prefix_lengths(a[a0:mid], b[b0:b1]), _prefix_lengths(a[mid:a1][::-1], b[b0:b1][::-1])
        cut = b0 + int(np.argmax(left + right[::-1]))
        todo += [(mid, a1, cut, b1), (a0, mid, b0, cut)]
    return sorted(out)


def align(one: str, two: str) -> str:
    """The wrapper of two wrappers or streams: longest common subsequence of items, the rest optional."""
    one, two = _regroup(one, two), _regroup(two, one)
    a, b = _ITEM.findall(one), _ITEM.findall(two)
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        for item in run:
            out.append(item if item.endswith(")?") else f"({_bare(item)})?")
        run.clear()

    i = j = 0
    for x, y in [*common([_bare(k) for k in a], [_bare(k) for k in b]), (len(a), len(b))]:
        run += a[i:x] + b[j:y]
        close()
        if x < len(a):
            out.append(_joined(a[x], b[y]))
        i, j = x + 1, y + 1
    return "".join(out)


def accepts(wrapper: str, page_stream: str) -> bool:
    """Whether a wrapper already describes a stream; a group's repetitions may be any number."""
    a, b = _ITEM.findall(wrapper), _ITEM.findall(_regroup(page_stream, wrapper))
    j = 0
    for item in a:
        if j < len(b) and _bare(b[j]) == _bare(item) and (item[0] == "(" or b[j][0] != "("):
            j += 1
        elif not item.endswith(")?"):
            return False
    return j == len(b)


def infer(streams: list[str]) -> str:
    """The wrapper of some streams, taken in order of size."""
    wrapper = None
    for s in sorted(set(streams), key=lambda s: (-len(s), s)):
        if wrapper is None:
            wrapper = s
        elif not accepts(wrapper, s):
            wrapper = align(wrapper, s)
    return wrapper or ""


def _is_aside(key: str) -> bool:
    name, _, rest = key.partition(".")
    return name not in NEVER_ASIDE and (name in ASIDE_TAGS or bool(rest) and any(map(_names_aside, rest.split("."))))


def _names_aside(name: str) -> bool:
    first, *_, last = re.split("[-_]+", name.strip("-_")) if "-" in name or "_" in name else (name, name)
    return name in ASIDE_WORDS or last in ASIDE_ENDS and first not in SAYS_WHETHER


def _is_main(key: str) -> bool:
    name, _, rest = key.partition(".")
    return name in MAIN_TAGS or name in MAIN_BOXES and "main" in rest.split(".")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Node:
    """An element, or a block of text (its key is #), of a page or a wrapper."""

    __slots__ = ("key", "within", "children", "aside", "main", "text", "linked", "slot", "at", "again", "optional", "shape", "places")

    def __init__(self, key: str, parent: Node | None = None):
        self.key = key
        self.within = parent.key if parent is not None else ""
        self.children: list[Node] = []
        self.text, self.linked, self.slot, self.shape = "", 0, -1, frozenset()
        self.aside = parent is not None and (parent.aside or key != "#" and _is_aside(key))
        self.main = parent is not None and (parent.main or key != "#" and _is_main(key))
        if parent is not None:
            parent.children.append(self)


class Tree:
    """Elements and texts as they come; nodes are in the order of their starts."""

    def __init__(self) -> None:
        self.nodes = [Node("")]
        self.open = [self.nodes[0]]
        self.chain: list[str] = []

    def add(self, key: str) -> Node:
        self.nodes.append(Node(key, self.open[-1]))
        return self.nodes[-1]

    def start(self, key: str) -> Node | None:
        """The new element; none for those without content."""
        enter(self.chain, key)
        holds = key.partition(".")[0] not in VOID
        del self.open[len(self.chain) + 1 - holds :]
        if not holds:
            return None
        self.open.append(self.add(key))
        return self.open[-1]

    def end(self, name: str) -> None:
        leave(self.chain, name)
        del self.open[len(self.chain) + 1 :]

    def shaped(self) -> Tree:
        """Gives each node its shape: the paths of keys below it, two levels deep. Equal shapes are one object."""
        known: dict[frozenset[str], frozenset[str]] = {}
        for node in reversed(self.nodes):
            if node.children:
                shape = frozenset([c.key for c in node.children] + [f"{c.key}>{d.key}" for c in node.children for d in c.children])
                node.shape = known.setdefault(shape, shape)
        return self


def page_tree(page: str) -> Tree:
    tree = Tree()
    held: list[str] = []
    linked = 0
    in_link = False
    for kind, value in itertools.chain(tokens(page), [(">", "")]):
        if kind == "#":
            held.append(value)
            linked += len(value) if in_link else 0
        elif kind == "-":
            if value in ("br", "/br"):
                held.append(" ")
            elif value in ("a", "/a"):
                in_link = value == "a"
        else:
            raw = "".join(held)
            if raw and not raw.isspace():
                node = tree.add("#")
                node.text = " ".join(_html.unescape(raw).split())
                node.linked = min(linked, len(node.text))
            held.clear()
            linked = 0
            if kind == "<":
                tree.start(value)
            else:
                tree.end(value)
                in_link = False
    return tree.shaped()


def wrapper_tree(wrapper: str) -> Tree:
    """A wrapper's slots are numbered in their order. A node knows from which node on its next sibling is looked for (again): behind all it holds, or
    from the start of its repeated group."""
    tree = Tree()
    n = 0
    for item in _ITEM.findall(wrapper):
        first: dict[int, int] = {}
        for part in re.findall(r"<[^<>]*>|#", item):
            if part[:2] == "</":
                tree.end(part[2:-1])
                continue
            node = tree.add("#") if part == "#" else tree.start(part[1:-1])
            if node is not None:
                node.at = len(tree.nodes) - 1
                node.optional = item.endswith(")?")
                node.again = first.setdefault(id(tree.open[-1 if part == "#" else -2]), node.at) if item.endswith(")+") else None
                if part == "#":
                    node.slot = n
                    n += 1
    for node in reversed(tree.shaped().nodes[1:]):
        node.places = None
        if node.again is None:
            last = node
            while last.children:
                last = last.children[-1]
            node.again = last.at + 1
    tree.nodes[0].places = None
    return tree


def _places(node: Node) -> dict:
    """Where keys, and keys with shapes, are among a wrapper's node's children, and among those of optional ones: a page that leaves these out may have what they hold."""
    if node.places is None:
        node.places = {}
        todo = node.children[::-1]
        while todo:
            child = todo.pop()
            node.places.setdefault(child.key, []).append(child)
            node.places.setdefault((child.key, child.shape), []).append(child)
            if child.optional:
                todo += child.children[::-1]
    return node.places


def match(wrapper: Tree, page: Tree) -> None:
    """Gives each text of the page its slot in the wrapper, -1 if there is none."""
    todo = [(wrapper.nodes[0], page.nodes[0])]
    while todo:
        w, p = todo.pop()
        at = 0
        for child in p.children:
            for key in ((child.key, child.shape), child.key):
                if places := _places(w).get(key):
                    k = bisect.bisect_left(places, at, key=lambda node: node.at)
                    found = places[k if k < len(places) else -1]
                    at = found.again
                    child.slot = found.slot
                    todo.append((found, child))
                    break


class Reader:
    """Reads pages of a host by its wrapper and the sums of its slots: (slot, hash of the element right around it in pages, characters, those in links, whether it is template)."""

    def __init__(self, wrapper: str, sums: Iterable[tuple[int, int, int, int, bool]] | None = None):
        self.wrapper = wrapper_tree(wrapper)
        self.template: frozenset[tuple[int, int]] = frozenset()
        #: votes of all slots, without those for elements of a page
        self.votes: dict[int, int] = {}
        self.hashes: dict[str, int] = {}
        if sums:
            self._decide(list(sums))

    def _decide(self, sums: list[tuple[int, int, int, int, bool]]) -> None:
        self.template = frozenset((slot, element) for slot, element, _, _, fixed in sums if fixed)
        chars, linked, own = Counter(), Counter(), Counter()
        for slot, _, c, k, fixed in sums:
            chars[slot] += c
            linked[slot] += k
            own[slot] += 0 if fixed else c - k
        weight: dict[int, int] = {}
        for node in reversed(self.wrapper.nodes):
            weight[id(node)] = (0 if node.aside or node.key != "#" else own[node.slot]) + sum(weight[id(c)] for c in node.children)
        region = self.wrapper.nodes[0]
        while weight[id(region)]:
            best = max(region.children, key=lambda c: weight[id(c)])
            if weight[id(best)] < REGION * weight[id(region)] or all(c.key == "#" for c in best.children):
                break
            region = best
        inside = set()
        todo = [region]
        while todo:
            node = todo.pop()
            inside.add(node.slot)
            todo += node.children
        self.votes = {slot: (1 if slot in inside else -1) - (linked[slot] >= LINKS * chars[slot]) for slot in chars}

    def place(self, block: Node) -> tuple[int, int]:
        """A block's slot, and the hash of the element right around it."""
        if block.within not in self.hashes:
            self.hashes[block.within] = _hash(block.within)
        return block.slot, self.hashes[block.within]

    def blocks(self, page: str) -> list[Node]:
        """The page's blocks of text in their order, with their slots."""
        tree = page_tree(page)
        match(self.wrapper, tree)
        return [n for n in tree.nodes if n.key == "#" and n.text]

    def _is_main(self, block: Node) -> bool:
        return self.votes.get(block.slot, 0) + (block.within.partition(".")[0] in PROSE_TAGS) + 2 * block.main >= 0

    def text(self, page: str) -> str:
        named = [b for b in self.blocks(page) if not b.aside]
        own = [b for b in named if self.place(b) not in self.template]
        found = [b for b in own if self._is_main(b)] or own or [b for b in named if self._is_main(b)] or named
        found = [b for b in found if b.main] or found
        return "\n".join(b.text for b in found)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = Counter((h, stream(x or "")) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n]), pa.array([k[1] for k in n]), pa.array(list(n.values()), pa.int64())], ["host", "stream", "n"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n_pages) of all hosts, from all pages."""
    host, _ = parts(F.col("url"))
    seen = pages.select(host.alias("host"), "html").mapInArrow(_streams, "host string, stream string, n long")
    distinct = seen.groupBy("host", "stream").agg(F.sum("n").alias("n"))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "stream": [infer(group["stream"].tolist())], "n": [int(group["n"].sum())]})

    rows = shared.cut(distinct)
    while True:
        counts = rows.groupBy("host").agg(F.count("*").alias("k")).where(F.col("k") > GROUP)
        counts = shared.cut(counts)
        if counts.isEmpty():
            break
        salt = F.coalesce(F.pmod(F.xxhash64("stream"), F.ceil(F.col("k") / GROUP)), F.lit(0))
        salted = rows.join(shared.small(counts, size=F.octet_length("host") + 8), "host", "left").withColumn("salt", salt)
        rows = shared.cut(salted.groupBy("host", "salt").applyInPandas(merge, "host string, stream string, n long"))
    return rows.groupBy("host").applyInPandas(merge, "host string, stream string, n long").select("host", F.col("stream").alias("wrapper"), F.col("n").alias("n_pages"))


def _readers(batch: pa.RecordBatch, readers: dict[str, Reader]) -> Iterator[tuple[str, Reader]]:
    """Page and reader of rows (html, host, wrapper, and maybe sums of its slots)."""
    columns = [batch.column(c).to_pylist() for c in batch.schema.names]
    for page, host, wrapper, *sums in zip(*columns, strict=True):
        if host not in readers:
            if len(readers) > 1000:
                readers.clear()
            readers[host] = Reader(wrapper or "", [tuple(s.values()) for s in sums[0] or ()] if sums else None)
        yield page or "", readers[host]


_SLOTS = pa.list_(pa.struct([("slot", pa.int32()), ("element", pa.int64()), ("value", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())]))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    readers: dict[str, Reader] = {}
    for batch in batches:
        pages, found = [], []
        for page, reader in _readers(batch, readers):
            pages.append(_hash(page))
            sums: dict[tuple[int, int, int], list[int]] = {}
            for b in reader.blocks(page):
                if b.slot >= 0:
                    own = sums.setdefault((*reader.place(b), _hash(b.text)), [0, 0])
                    own[0] += len(b.text)
                    own[1] += b.linked
            found.append([{"slot": s, "element": e, "value": v, "chars": c, "linked": k} for (s, e, v), (c, k) in sums.items()])
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pages, pa.int64()), pa.array(found, _SLOTS)], ["host", "page", "slots"])


def slot_sums(rows: DataFrame) -> DataFrame:
    """(host, sums: array of slot, element, chars, linked, fixed) of rows (html, host, wrapper), for hosts with enough different pages."""
    schema = "host string, page long, slots array<struct<slot: int, element: long, value: long, chars: long, linked: long>>"
    pages = rows.select("html", "host", "wrapper").mapInArrow(_slots, schema).dropDuplicates(["host", "page"])
    pages = shared.cut(pages)  # pages are read once for the three counts below
    key = ["host", "slot", "element"]
    texts = pages.select("host", F.explode("slots").alias("s")).select("host", "s.*")
    own = texts.groupBy(*key, "value").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    uses = own.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    places = F.array_distinct(F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["element"].alias("element"))))
    on = pages.select("host", F.explode(places).alias("s")).select("host", "s.*").groupBy(*key).agg(F.count("*").alias("n_pages"))
    fixed = (F.col("n_pages") >= PAGES) & (F.col("n") >= SHARE * F.col("n_texts") * F.col("n_pages"))
    sums = uses.join(on, key).groupBy("host").agg(F.collect_list(F.struct("slot", "element", "chars", "linked", fixed.alias("fixed"))).alias("sums"))
    return sums.join(pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES), "host").select("host", "sums")


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    host, _ = parts(F.col("url"))
    size = F.octet_length("wrapper")
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    found = shared.cut(wrappers(pages).select("host", "wrapper"))
    known = found.join(slot_sums(rows.join(shared.small(found, HOSTS, size), "host", "left")), "host", "left")
    rows = rows.join(shared.small(shared.cut(known), HOSTS, size + 40 * F.coalesce(F.size("sums"), F.lit(0))), "host", "left").select("page_id", "url", "html", "host", "wrapper", "sums")
    schema = pages.select("page_id", "url").schema.add("text", "string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        for batch in batches:
            out = [reader.text(page) for page, reader in _readers(batch.select(["html", "host", "wrapper", "sums"]), readers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(read, schema).withColumn("n_chars", F.char_length("text").cast("long"))
