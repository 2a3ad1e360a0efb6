"""Byte-level BPE encoding and decoding by a table of ranks.

A piece's bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton finds every token that occurs
in it in one pass. Encoding then goes left to right: take the longest token that fits the one before it, else a
shorter one, else step back. Two adjacent tokens fit if merging by rank would not cross the point between them; this
depends on the two tokens alone and is memoised. The result is the one that merging by rank gives, in time
proportional to the piece.

Texts repeat their words, so a worker keeps the ids of chunks. A chunk begins with a space that a character other
than white space follows: the pattern that splits texts always starts a new match there, so chunks can be encoded
one by one.

Null text is the empty text and has no ids. A very long text is encoded whole, chunk by chunk. Repeated rows stay, each with its
ids; further columns stay as they are, but those named like a column that is added are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import shared

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Chunks (twice, see Chunks) and token pairs a worker remembers.
CHUNKS, PAIRS = 150_000, 200_000
#: Rows handled at once.
ROWS = 256

_INNER = re.compile(r" (?:\s|$)")


def chunks(text: str) -> list[str]:
    """Parts of the text without the space they begin with (the first part has none)."""
    parts = text.split(" ")
    if not _INNER.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out


class Chunks(dict):
    """Encoded chunks by their text; `encode` gets the chunk with its space. When it is full, it starts anew but keeps what
    it held as `old`, from which chunks that occur again come back."""

    def __init__(self, encode: Callable[[str], bytes], space: str = " ", most: int = CHUNKS):
        super().__init__()
        self.encode, self.space, self.most, self.old = encode, space, most, {}

    def add(self, part: str, found: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[part] = found

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = self.encode(self.space + part)
        if len(part) < 200:
            self.add(part, found)
        return found


def read_ranks(path: str = RANKS) -> list[bytes]:
    """Tokens by id, of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        of = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(of) != list(range(len(of))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [of[i] for i in range(len(of))]


def join(tokens: list[bytes], ids: bytes) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN):
        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.size = [len(t) for t in tokens]
        id_of = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for t, i in id_of.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((id_of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in id_of), -1) for t in tokens]
        self.halves = [(i, i) for i in range(len(tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            a = self.shorter[i]
            while a >= 0:
                b = id_of.get(t[self.size[a] :])
                if a < i and b is not None and b < i and self._fits(a, b):
                    self.halves[i] = (a, b)
                    self.merged[a, b] = i
                    break
                a = self.shorter[a]
        self.pieces = Chunks(self._piece, "", 100_000)
        self.first, self.rest = Chunks(self._chunk, "", 20_000), Chunks(self._chunk)

    def _fits(self, a: int, b: int) -> bool:
        """Whether a merge across the point between a and b would come later than those that made a and b."""
        limit = len(self.tokens)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            # undo the later of the two merges that touch the point
            undo_left = self.halves[a][0] != a and (a > b or self.halves[b][0] == b)
            if undo_left:
                limit, a = a, self.halves[a][1]
            elif self.halves[b][0] != b:
                limit, b = b + 1, self.halves[b][0]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        found = self.fit.get((a, b))
        if found is None:
            if len(self.fit) >= PAIRS:
                self.fit.clear()
            found = self.fit[a, b] = self._fits(a, b)
        return found

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one piece (a match of the pattern)."""
        longest = [-1] * len(piece)
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - self.size[i]] = i
        out: list[int] = []
        dead = set()
        at, end = 0, len(piece)
        token = longest[0] if piece else -1
        while at < end:
            while token >= 0 and (at + self.size[token] in dead or out and not self.fits(out[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.size[token]
                token = longest[at] if at < end else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                at -= self.size[out[-1]]
                token = self.shorter[out.pop()]
        return out

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_bytes(piece.encode()), dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = chunks(text)
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))

    def decode(self, ids: bytes) -> bytes:
        return join(self.tokens, ids)


_MADE: dict[str, Bpe] = {}


def _made(tokens, key: str) -> Bpe:
    """The worker's encoder of a broadcast vocabulary, built once."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Bpe(tokens.value)
    return _MADE[key]


def _vocabulary(spark: SparkSession, path: str):
    """A vocabulary has a fixed size, a few MB whatever the data."""
    return spark.sparkContext.broadcast(read_ranks(path))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _with(rows: DataFrame, path: str, add: list[str], made: Callable[[Bpe | list[bytes], pa.RecordBatch], list[list[bytes]]], encoder: bool) -> DataFrame:
    """rows with binary columns that a worker's encoder (or the tokens alone) makes of small batches."""
    shared.lean(rows.sparkSession)
    rows = rows.drop(*add)
    names, tokens = rows.columns, _vocabulary(rows.sparkSession, path)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(x, T.BinaryType()) for x in add)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _made(tokens, path) if encoder else tokens.value
        for batch in _small(batches):
            columns = [pa.array(c, pa.binary()) for c in made(of, batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *add])

    return rows.mapInArrow(apply, schema)


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """docs, with token_ids (binary, little-endian unsigned 32-bit)."""
    return _with(docs, path, ["token_ids"], lambda bpe, b: [[bpe.encode(x or "") for x in b.column("text").to_pylist()]], True)


def decode(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """rows, with decoded (binary: bytes of token_ids)."""
    return _with(rows, path, ["decoded"], lambda tokens, b: [[join(tokens, x or b"") for x in b.column("token_ids").to_pylist()]], False)


def encode_and_decode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """docs, with token_ids and what they decode to, in one pass (one worker holds the vocabulary, not two)."""

    def both(bpe: Bpe, b: pa.RecordBatch) -> list[list[bytes]]:
        ids = [bpe.encode(x or "") for x in b.column("text").to_pylist()]
        return [ids, [bpe.decode(x) for x in ids]]

    return _with(docs, path, ["token_ids", "decoded"], both, True)


def round_trip(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = encode_and_decode(docs.select("doc_id", "text"), path)
    n = (F.octet_length("token_ids") / 4).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
