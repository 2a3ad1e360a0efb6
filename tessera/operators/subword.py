"""Subword models: byte-pair encoding, WordPiece and Unigram, each as one Arrow function over arrays of pieces.

Arrow numbers the distinct pieces of a batch, only these are looked up one by one, and their tokens or ids are dealt
out again by position. A worker keeps what it has tokenized (texts repeat their words), so a piece is worked out once per worker.
Vocabularies have a fixed size and travel in the function's closure."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import sys
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.normalize import without_marks
from tessera.functions.text import BLANK, CJK, PUNCTUATION, python_class

#: Bytes, by estimate, of the pieces that a worker remembers of a model, and characters beyond which it does not remember one.
REMEMBERED, LONGEST = 64 << 20, 200
#: Bytes of pieces that are worked on at once.
HELD = 8 << 20

TOKENS = T.ArrayType(T.StringType())
IDS = T.ArrayType(T.LongType())

IDEOGRAPH = regex.compile(rf"([{python_class(CJK)}]\p{{M}}*)")
BLANKS = regex.compile(rf"[{BLANK}]+")
#: A punctuation mark with the marks on it, or what lies between.
PARTS = regex.compile(rf"[{PUNCTUATION}]\p{{M}}*|[^{PUNCTUATION}]+")

#: Before an added token, where a section begins, and before a piece that begins with one of these itself.
RAW, CUT, ESCAPE = "\ue001", "\ue002", "\ue003"


class Model:
    """Piece to tokens, and tokens to ids and back."""

    def __init__(self, vocab: dict[str, int], unk: str | None = None, fuse: bool = False):
        self.vocab, self.unk, self.fuse = vocab, unk, fuse
        self.unk_id = vocab.get(unk) if unk is not None else None
        self.by_id = {i: t for t, i in vocab.items()}

    def tokens(self, piece: str) -> list[str]:
        raise NotImplementedError

    def many(self, pieces: list[str]) -> list[tuple[str, ...]]:
        """The tokens of each piece."""
        return [tuple(self.tokens(p)) for p in pieces]

    def id(self, token: str) -> int | None:
        return self.vocab.get(token, self.unk_id)

    def token(self, i: int) -> str | None:
        return self.by_id.get(i)


class Bpe(Model):
    """Lowest rank first, leftmost on ties. Tokens outside the vocabulary (or unknown) become <0xNN> of their bytes.

    Merges are pairs, or legacy "a b" strings; added tokens win over the vocabulary's."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[str | tuple[str, str]], unk: str | None = None, fuse: bool = False, added: dict[str, int] | None = None):
        super().__init__({**vocab, **(added or {})}, unk, fuse)
        pairs = (tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges)
        self.ranks = {p: i for i, p in enumerate(pairs)}

    def merge(self, piece: str) -> list[str]:
        """Of short pieces the ranks of all neighbours are kept in a list; of long ones, symbols in a linked list and candidate merges
        in a heap, where entries whose symbols have changed since are skipped."""
        parts: list[str | None] = list(piece)
        n = len(parts)
        if n < 2:
            return [piece] if piece else []
        if n <= 64:
            return self._merge_short(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := self.ranks.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _merge_short(self, parts: list[str]) -> list[str]:
        rank, never = self.ranks.get, len(self.ranks)
        ranks = [rank(p, never) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            for j in (i - 1, i):
                if 0 <= j < len(ranks):
                    ranks[j] = rank((parts[j], parts[j + 1]), never)
        return parts

    def tokens(self, piece: str) -> list[str]:
        out: list[str] = []
        for p in self.merge(piece):
            known = self.vocab.get(p)
            # one string for all its places, so that a long piece does not hold one for each
            out += [sys.intern(p)] if known is not None and known != self.unk_id else [f"<0x{b:02X}>" for b in p.encode()]
        return out


#: Words that the basic stage leaves as they are (fixed values).
NEVER_SPLIT = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")


class Basic(Model):
    """Words and single punctuation marks of a piece. Ideographs stand alone if `cjk`; with `lower`, without nonspacing marks and
    in lower case. Spaces and tabs split, line feeds do not. A word that is one of NEVER_SPLIT stays."""

    def __init__(self, lower: bool = True, cjk: bool = True):
        super().__init__({})
        self.lower, self.cjk = lower, cjk

    def tokens(self, piece: str) -> list[str]:
        if self.cjk and not piece.isascii():
            piece = IDEOGRAPH.sub(r" \1 ", piece)
        if self.lower:
            piece = without_marks(piece)
        out: list[str] = []
        for word in BLANKS.split(piece):
            out += [word] if word in NEVER_SPLIT else PARTS.findall(word.lower() if self.lower else word)
        return out


class WordPiece(Model):
    """Greedy longest match with a prefix for continuations; a word that is too long or has no match is unknown as a whole.
    With `basic`, a piece's words come from that stage; else the piece is one word."""

    def __init__(self, vocab: dict[str, int], unk: str = "[UNK]", prefix: str = "##", longest: int = 100, added: dict[str, int] | None = None, basic: Basic | None = None):
        super().__init__({**vocab, **(added or {})}, unk)
        self.prefix, self.longest, self.basic = prefix, longest, basic

    def tokens(self, piece: str) -> list[str]:
        if self.basic is None:
            return self._word(piece)
        return [t for word in self.basic.tokens(piece) for t in self._word(word)]

    def _word(self, piece: str) -> list[str]:
        if len(piece) > self.longest:
            return [self.unk]
        out: list[str] = []
        at = 0
        while at < len(piece):
            for end in range(len(piece), at, -1):
                part = (self.prefix if at else "") + piece[at:end]
                if part in self.vocab:
                    out.append(part)
                    at = end
                    break
            else:
                return [self.unk]
        return out


class Trie:
    """Entries by their characters."""

    def __init__(self, entries: Iterable[str] = ()):
        self.root: dict = {}
        for e in entries:
            self.insert(e)

    def insert(self, entry: str) -> None:
        node = self.root
        for c in entry:
            node = node.setdefault(c, {})
        node[""] = True

    def prefixes(self, text: str, at: int = 0):
        """Entries that the text has at a place, shortest first."""
        node = self.root
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                return
            if "" in node:
                yield text[at : i + 1]


class FlatTrie:
    """Entries as a double array: from state s a character with the number c leads to base[s] + c, if check[base[s] + c] is s. `value` is the place of
    the entry that ends in a state, or -1. The root is state 0; characters that occur in no entry have the number 0."""

    def __init__(self, entries: list[str]):
        trie, at = Trie(entries), {e: i for i, e in enumerate(entries)}
        alphabet = sorted({c for e in entries for c in e})
        numbers = {c: i for i, c in enumerate(alphabet, 1)}
        self.number = np.zeros(ord(alphabet[-1]) + 2 if alphabet else 1, dtype=np.int32)
        self.number[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        # room for all states, and for the children of any beyond them
        size = sum(map(len, entries)) + len(alphabet) + 2
        base, check, value = np.zeros(2 * size, dtype=np.int32), np.full(2 * size, -1, dtype=np.int32), np.full(2 * size, -1, dtype=np.int32)
        taken = bytearray(2 * size)
        taken[0], free = 1, 1
        queue = deque([(trie.root, 0, "")])
        while queue:
            node, state, prefix = queue.popleft()
            if "" in node:
                value[state] = at[prefix]
            children = sorted((numbers[c], c) for c in node if c)
            if not children:
                continue
            free = taken.index(0, free)
            first, slot = children[0][0], free
            while slot < first or any(taken[slot - first + k] for k, _ in children):
                slot = taken.index(0, slot + 1)
            base[state] = slot - first
            for k, c in children:
                to = slot - first + k
                taken[to], check[to] = 1, state
                queue.append((node[c], to, prefix + c))
        used = taken.rindex(1) + len(alphabet) + 1
        self.base, self.check, self.value = base[:used], check[:used], value[:used]

    def codes(self, text: str) -> np.ndarray:
        """The numbers of a text's characters."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return self.number[np.minimum(code, len(self.number) - 1)]

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one more character, and whether there is one."""
        to = self.base[states] + codes
        return to, (self.check[to] == states) & (codes > 0)

    def prefixes(self, text: str, at: int = 0) -> Iterator[str]:
        """Entries that the text has at a place, shortest first."""
        state = 0
        for i, c in enumerate(self.codes(text[at:]).tolist(), at + 1):
            state, parent = int(self.base[state]) + c, state
            if not c or self.check[state] != parent:
                return
            if self.value[state] >= 0:
                yield text[at:i]


class Unigram(Model):
    """The path of pieces with the greatest sum of scores, in 32-bit floats. At a character without a piece of its own, an unknown
    of length 1 with the least score less 10. Of equal paths the one whose last piece is longest, at each place."""

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int):
        if len({p for p, _ in pieces}) < len(pieces):
            raise ValueError("a piece occurs twice")
        super().__init__({p: i for i, (p, _) in enumerate(pieces)}, pieces[unk_id][0], fuse=True)
        self.scores = {p: np.float32(s) for p, s in pieces}
        self.unk_score = np.float32(min(s for _, s in pieces)) - np.float32(10)
        self.trie = FlatTrie([p for p, _ in pieces])
        self.score_of = np.array([s for _, s in pieces], dtype=np.float32)

    def many(self, pieces: list[str]) -> list[tuple[str, ...]]:
        """Short pieces side by side, by one character of all of them at a time; long ones alone."""
        out: list[tuple[str, ...] | None] = [None if len(p) <= LONGEST else tuple(self.tokens(p)) for p in pieces]
        short = sorted((i for i, p in enumerate(pieces) if out[i] is None), key=lambda i: -len(pieces[i]))
        for i, tokens in zip(short, self._side_by_side([pieces[i] for i in short]), strict=True):
            out[i] = tokens
        return out

    def _side_by_side(self, pieces: list[str]) -> Iterator[tuple[str, ...]]:
        """Of pieces from long to short."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        codes, begins = self.trie.codes("".join(pieces)), np.cumsum(sizes) - sizes
        # one more place than characters in each piece
        places = begins + np.arange(len(pieces))
        best = np.full(len(codes) + len(pieces), -np.inf, dtype=np.float32)
        back = np.zeros(len(best), dtype=np.int32)
        best[places] = 0

        def offer(to: np.ndarray, total: np.ndarray, at: int) -> None:
            # starts ascend, so at equal scores the earlier start, the longer piece, stays
            more = total > best[to]
            best[to[more]], back[to[more]] = total[more], at

        for at in range(int(sizes[0]) if len(sizes) else 0):
            open_ = np.arange(np.searchsorted(-sizes, -at, "left"))
            here, states, alone = best[places[open_] + at], np.zeros(len(open_), dtype=np.int32), np.ones(len(open_), dtype=bool)
            length = 0
            while len(open_):
                states, found = self.trie.step(states, codes[begins[open_] + at + length])
                open_, states = open_[found], states[found]
                length += 1
                entry = self.trie.value[states]
                ends = open_[entry >= 0]
                if length == 1:
                    alone[ends] = False
                offer(places[ends] + at + length, here[ends] + self.score_of[entry[entry >= 0]], at)
                inside = at + length < sizes[open_]
                open_, states = open_[inside], states[inside]
            unknown = np.flatnonzero(alone)
            offer(places[unknown] + at + 1, here[unknown] + self.unk_score, at)
        back_of = back.tolist()
        for piece, place in zip(pieces, places.tolist(), strict=True):
            tokens, end = [], len(piece)
            while end:
                begin = back_of[place + end]
                tokens.append(piece[begin:end])
                end = begin
            yield tuple(tokens[::-1])

    def tokens(self, piece: str) -> list[str]:
        n, trie = len(piece), self.trie
        codes, base, check, value = trie.codes(piece).tolist(), trie.base, trie.check, trie.value
        best: list[np.float32 | None] = [None] * (n + 1)
        back: list[int] = [0] * (n + 1)
        best[0] = np.float32(0)
        for at in range(n):
            found, state = {}, 0
            for end in range(at, n):
                to = base.item(state) + codes[end]
                if not codes[end] or check.item(to) != state:
                    break
                state = to
                if (entry := value.item(state)) >= 0:
                    found[end + 1 - at] = self.score_of[entry]
            if 1 not in found:
                found[1] = self.unk_score
            for size, s in found.items():
                # starts ascend, so at equal scores the earlier start, the longer piece, stays
                total = best[at] + s
                if best[at + size] is None or total > best[at + size]:
                    best[at + size], back[at + size] = total, at
        out: list[str] = []
        while n:
            out.append(piece[back[n] : n])
            n = back[n]
        return out[::-1]


class _Kept:
    """What a model gave for short pieces; all is forgotten when it gets too much. Texts that are one long piece are not kept."""

    def __init__(self, model: Model):
        self.model, self.kept, self.size = model, {}, 0

    def many(self, pieces: list[str]) -> list[tuple[str, ...]]:
        found = [self.kept.get(p) for p in pieces]
        missing = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(missing, self.model.many([pieces[i] for i in missing]), strict=True):
            found[i] = x
            if len(pieces[i]) <= LONGEST:
                self.size += 200 + len(pieces[i]) + 70 * len(x)
                if self.size > REMEMBERED:
                    self.kept, self.size = {}, 0
                self.kept[pieces[i]] = x
        return found


#: What this worker remembers of a few models, by their digest.
_MADE: dict[str, _Kept] = {}


class _Lazy:
    """A model with the pieces a worker remembers of it; these stay in the worker, from task to task, and do not travel."""

    def __init__(self, model: Model):
        self.model, self.key = model, hashlib.blake2b(pickle.dumps(model), digest_size=16).hexdigest()

    def get(self) -> _Kept:
        if self.key not in _MADE:
            while len(_MADE) >= 3:
                _MADE.pop(next(iter(_MADE)))
            _MADE[self.key] = _Kept(self.model)
        return _MADE[self.key]


def _lists(rows: pa.Array, values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Lists of so many values each, null where rows is null."""
    ends = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=rows.is_null())


def _flat(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All values of lists, and the lists' sizes (a null list has none)."""
    return rows.flatten(), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def escaped(text: Column, pieces: Column) -> Column:
    """The pieces of a text, where those that begin like a mark get one more."""
    marks = f"[{RAW}-{ESCAPE}]"
    one = lambda x: F.when(x.rlike("^" + marks), F.concat(F.lit(ESCAPE), x)).otherwise(x)
    return F.when(text.rlike(marks), F.transform(pieces, one)).otherwise(pieces)


def _in_parts(rows: pa.Array, run: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """What a function gives for lists of pieces, some MB of pieces at a time; a longer row is alone."""
    flat, sizes = _flat(rows)
    bytes_at = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    ends = bytes_at[np.cumsum(sizes)]
    if not len(ends) or ends[-1] <= HELD:
        return run(rows)
    out, at = [], 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
        out.append(run(rows.slice(at, end - at)))
        at = end
    return pa.concat_arrays(out)


class _Batch:
    """Tokens of a batch's pieces: positions in the tokens of its distinct pieces, and how many each row has."""

    def __init__(self, rows: pa.Array, model: Model, known: _Kept, piece: Callable[[str], str], fuse: bool, marked: bool):
        flat, sizes = _flat(rows)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if marked:
            # a section's begin, and an added token, end a run of unknowns: None stands for that
            marks = {i: (None,) if x == CUT else (None, x[1:], None) for i, x in enumerate(distinct) if x == CUT or x.startswith(RAW)}
            rest = known.many([piece(x.removeprefix(ESCAPE)) for i, x in enumerate(distinct) if i not in marks])
            others = iter(rest)
            found = [marks[i] if i in marks else next(others) for i in range(len(distinct))]
        else:
            found = known.many(distinct if piece is _same else [piece(x) for x in distinct])
        self.tokens = list(chain.from_iterable(found))
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        place = coded.indices.to_numpy(zero_copy_only=False)
        own = n[place]
        ends = np.cumsum(own)
        at = np.repeat((np.cumsum(n) - n)[place] - ends + own, own) + np.arange(int(ends[-1]) if len(ends) else 0)
        row = np.repeat(np.repeat(np.arange(len(sizes)), sizes), own)
        keep = np.array([t is not None for t in self.tokens], dtype=bool)[at] if marked else np.ones(len(at), dtype=bool)
        if fuse:
            ids = np.array(list(map(model.vocab.get, self.tokens, repeat(model.unk_id))), dtype=object if model.unk_id is None else np.int64)
            unknown = (ids == model.unk_id)[at]
            if marked:
                unknown &= keep
            keep[1:] &= ~(unknown[1:] & unknown[:-1] & (row[1:] == row[:-1]))
        self.at, self.sizes = at[keep], np.bincount(row[keep], minlength=len(sizes))


def _same(x: str) -> str:
    return x


def tokenize(model: Model, piece: Callable[[str], str] = _same, fuse: bool = False, marked: bool = False) -> Callable[[Column], Column]:
    """Array of pieces to array of tokens; `piece` changes a piece first. If pieces are marked, sections and added tokens are minded; with `fuse`
    only the first of unknowns in a row within a section stays."""
    known = _Lazy(model)

    def part(rows: pa.Array) -> pa.Array:
        b = _Batch(rows, model, known.get(), piece, fuse, marked)
        return _lists(rows, pa.array(b.tokens, pa.string()).take(pa.array(b.at)), b.sizes)

    @F.arrow_udf(TOKENS)
    def run(rows: pa.Array) -> pa.Array:
        return _in_parts(rows, part)

    return run


def encode(model: Model, piece: Callable[[str], str] = _same, marked: bool = False) -> Callable[[Column], Column]:
    """Array of pieces to array of ids, as `ids` of `tokenize` gives them, with unknowns fused where the model says so."""
    known = _Lazy(model)

    def part(rows: pa.Array) -> pa.Array:
        b = _Batch(rows, model, known.get(), piece, model.fuse, marked)
        of = [-1 if t is None else i for t, i in zip(b.tokens, map(model.vocab.get, b.tokens, repeat(model.unk_id)), strict=True)] if marked else list(map(model.vocab.get, b.tokens, repeat(model.unk_id)))
        if None in of:
            raise ValueError(f"no id for the token {b.tokens[of.index(None)]!r}, and no unknown token")
        return _lists(rows, pa.array(np.array(of, dtype=np.int64)[b.at]), b.sizes)

    @F.arrow_udf(IDS)
    def run(rows: pa.Array) -> pa.Array:
        return _in_parts(rows, part)

    return run


def count_tokens(model: Model, piece: Callable[[str], str] = _same, only: str | None = None, marked: bool = False) -> Callable[[Column], Column]:
    """The number of tokens of an array of pieces, or of those that are the one given."""
    known = _Lazy(model)

    def part(rows: pa.Array) -> pa.Array:
        b = _Batch(rows, model, known.get(), piece, model.fuse, marked)
        if only is None:
            return pa.array(b.sizes, pa.int64(), mask=rows.is_null().to_numpy(zero_copy_only=False))
        hit = np.array([t == only for t in b.tokens], dtype=bool)[b.at]
        row = np.repeat(np.arange(len(b.sizes)), b.sizes)
        return pa.array(np.bincount(row[hit], minlength=len(b.sizes)), pa.int64(), mask=rows.is_null().to_numpy(zero_copy_only=False))

    @F.arrow_udf(T.LongType())
    def run(rows: pa.Array) -> pa.Array:
        return _in_parts(rows, part)

    return run


def ids(model: Model, strict: bool = True) -> Callable[[Column], Column]:
    """Array of tokens to array of ids; a token without id is an error if strict, else null."""
    vocab, unk = model.vocab, model.unk_id

    @F.arrow_udf(IDS)
    def run(rows: pa.Array) -> pa.Array:
        flat, sizes = _flat(rows)
        coded = flat.dictionary_encode()
        found = [vocab.get(t, unk) for t in coded.dictionary.to_pylist()]
        if strict and None in found:
            raise ValueError(f"no id for the token {coded.dictionary[found.index(None)].as_py()!r}, and no unknown token")
        return _lists(rows, pa.array(found, pa.int64()).take(coded.indices), sizes)

    return run


def _tokens_of(model: Model, skip: frozenset[int]):
    """A function of lists of ids: tokens of those that are known and not to be skipped, and how many each row has."""
    known = sorted((i, t) for i, t in model.by_id.items() if i not in skip)
    numbers, names = np.array([i for i, _ in known], dtype=np.int64), pa.array([t for _, t in known], pa.string())

    def find(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
        flat, sizes = _flat(rows)
        wanted = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(numbers, wanted), max(len(numbers) - 1, 0))
        hit = numbers[at] == wanted if len(numbers) else np.zeros(len(wanted), dtype=bool)
        row = np.repeat(np.arange(len(sizes)), sizes)
        return names.take(pa.array(at[hit])), np.bincount(row[hit], minlength=len(sizes))

    return find


def tokens(model: Model, skip: frozenset[int] = frozenset()) -> Callable[[Column], Column]:
    """Array of ids to array of tokens; unknown ids and those to skip are dropped."""
    find = _tokens_of(model, skip)

    @F.arrow_udf(TOKENS)
    def run(rows: pa.Array) -> pa.Array:
        return _lists(rows, *find(rows))

    return run


def joined_bytes(model: Model, byte_of: dict[str, int], skip: frozenset[int] = frozenset()) -> Callable[[Column], Column]:
    """Array of ids to the bytes that their tokens' characters stand for, in one string. Characters that stand for none are an error."""
    raw = {t: bytes(map(byte_of.__getitem__, t)) for t in model.by_id.values() if all(c in byte_of for c in t)}
    find = _tokens_of(model, skip)

    @F.arrow_udf(T.BinaryType())
    def run(rows: pa.Array) -> pa.Array:
        found, sizes = find(rows)
        coded = found.dictionary_encode()
        bad = [t for t in coded.dictionary.to_pylist() if t not in raw]
        if bad:
            raise ValueError(f"a character of the token {bad[0]!r} is not in the byte alphabet")
        values = pa.array([raw[t] for t in coded.dictionary.to_pylist()], pa.binary()).take(coded.indices)
        return pc.binary_join(_lists(rows, values, sizes), b"")

    return run


def within(ids: Column, longest: int = 512) -> Column:
    """The ids, or an error if there are more than a model's longest sequence; `too_long` tells such rows apart before."""
    message = F.concat(F.lit("too_long: "), F.size(ids).cast("string"), F.lit(f" ids, more than {longest}"))
    return F.when(too_long(ids, longest), F.raise_error(message)).otherwise(ids)


def too_long(ids: Column, longest: int = 512) -> Column:
    return F.size(ids) > longest


def vocab_table(model: Model, spark) -> DataFrame:
    """(token, id), for lookups by join."""
    return spark.createDataFrame(list(model.vocab.items()), "token string, id long")


def lookup(rows: DataFrame, vocab: DataFrame, unk_id: int | None = None) -> DataFrame:
    """rows with the id of their column `token`, that of the unknown token where there is none. A vocabulary has a fixed size,
    so it is broadcast."""
    return rows.join(F.broadcast(vocab), "token", "left").withColumn("id", F.coalesce("id", F.lit(unk_id).cast("long")))


def fuse_unknown(tokens: Column, unk: str) -> Column:
    """An array without those unknowns that follow an unknown."""
    return F.filter(tokens, lambda x, i: (x != unk) | (i == 0) | (F.get(tokens, i - 1) != unk))


def prefix_join(rows: DataFrame, entries: DataFrame, text: str, entry: str, longest: int) -> DataFrame:
    """Rows with each entry that their text begins with: an equi-join on prefixes of 1 to `longest` characters, so nothing is
    compared with everything."""
    prefixes = rows.withColumn(entry, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.char_length(text), F.lit(longest))), lambda n: F.substring(F.col(text), F.lit(1), n))))
    return prefixes.where(F.char_length(text) > 0).join(entries, entry)


def wordpiece_text(ts: Column, prefix: str = "##") -> Column:
    """Tokens joined by spaces, continuations without prefix and space."""
    joined = F.concat(F.lit(" "), F.array_join(ts, " "))
    return F.regexp_replace(F.replace(joined, F.lit(f" {prefix}"), F.lit("")), "^ ", "")
