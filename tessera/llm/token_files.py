"""Token-id files: independent zstandard frames with a trailing seek table.

A file (shard) holds documents in ascending doc_id order:

    frame 0, frame 1, ..., seek table

Each frame is a zstandard frame of its own (with its content checksum) over

    n documents (u32), bytes of an id, 2 or 4 (u32), doc_ids (i64 each, n), lengths in ids (u32 each, n), ids

and the seek table is a skippable frame in the published seekable format of zstandard: for each frame its compressed
size, decompressed size and checksum (low 32 bits of xxhash64 of the content), then the number of frames, a descriptor
byte and a magic number. A reader gets the table from the end of a file, and fetches, checks and decompresses only
frames that hold the documents asked for. `write` also returns an index with a row for each frame.

Documents are range-partitioned by doc_id, each partition writes one shard into the shared folder under a name of its
own attempt, and the index names the shards of the attempts that succeeded; files of lost attempts are never read. The
index is checkpointed, so that nothing is written twice.

Null text is the empty text: its only id is the end id. Rows with null doc_id come first. Repeated rows stay; rows with
the same doc_id are in the order of their texts. An empty table gives an empty index.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.bpe import Chunks, chunks

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 2
#: Bytes of ids in a frame, before compression (a longer document has a frame of its own).
FRAME_BYTES = 1 << 18
#: Chunks a worker remembers between batches, about 60 bytes each; bytes of texts encoded at once.
CHUNKS, TEXT_BYTES = 500_000, 8 << 20

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = "shard int, path string, frame int, offset long, size long, content_size long, first_id long, last_id long, n_docs long, n_tokens long"


def pack(ids: list[int], tokens: list[bytes]) -> bytes:
    """Content of a frame; tokens are little-endian unsigned 32-bit."""
    all_ids = np.frombuffer(b"".join(tokens), dtype="<u4")
    kind = "<u2" if not len(all_ids) or all_ids.max() < 1 << 16 else "<u4"
    head = np.array([len(ids), np.dtype(kind).itemsize], dtype="<u4").tobytes()
    return head + np.array(ids, dtype="<i8").tobytes() + np.array([len(t) // 4 for t in tokens], dtype="<u4").tobytes() + all_ids.astype(kind).tobytes()


def unpack(content: bytes) -> list[tuple[int, bytes]]:
    """(doc_id, ids as little-endian unsigned 32-bit) of a frame's documents."""
    n, width = np.frombuffer(content, dtype="<u4", count=2).tolist()
    ids = np.frombuffer(content, dtype="<i8", count=n, offset=8).tolist()
    sizes = np.frombuffer(content, dtype="<u4", count=n, offset=8 + 8 * n)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    tokens = np.frombuffer(content, dtype=f"<u{width}", offset=8 + 12 * n).astype("<u4")
    return [(i, tokens[b - s : b].tobytes()) for i, b, s in zip(ids, ends, sizes.tolist(), strict=True)]


class ShardWriter:
    """Writes frames to an open file and keeps the table."""

    def __init__(self, out):
        self.out, self.table, self.offset = out, [], 0
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=True)

    def frame(self, content: bytes) -> tuple[int, int]:
        """Offset and size of the frame written."""
        data = self.packer.compress(content)
        self.out.write(data)
        self.table.append((len(data), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.offset += len(data)
        return self.offset - len(data), len(data)

    def close(self) -> None:
        body = np.array(self.table, dtype="<u4").reshape(-1, 3).tobytes()
        foot = np.array([len(self.table)], dtype="<u4").tobytes() + bytes([0x80]) + np.array([_SEEKABLE], dtype="<u4").tobytes()
        self.out.write(np.array([_SKIPPABLE, len(body) + len(foot)], dtype="<u4").tobytes() + body + foot)
        self.out.close()


def read_table(file) -> np.ndarray:
    """(offset, compressed size, content size, checksum) of each frame of an open file."""
    size = file.size()
    foot = file.read_at(9, size - 9)
    n = int.from_bytes(foot[:4], "little")
    if int.from_bytes(foot[5:], "little") != _SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    table = np.frombuffer(file.read_at(12 * n, size - 9 - 12 * n), dtype="<u4").reshape(-1, 3).astype(np.int64)
    return np.column_stack([np.cumsum(table[:, 0]) - table[:, 0], table])


def read_frame(file, entry: np.ndarray) -> bytes:
    """Content of one frame, checked against the table."""
    offset, size, content_size, checksum = (int(x) for x in entry)
    content = zstandard.ZstdDecompressor().decompress(file.read_at(size, offset))
    if len(content) != content_size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
        raise ValueError("a frame differs from its entry in the seek table")
    return content


def _open(path: str):
    fs, inner = pa.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


#: White space (and \x1c to \x1f, where texts are cut with more care than needed), for Arrow's expressions.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A line break between two other characters; a space before further white space or at the end.
_BREAK, _INNER = f"([^{_SPACE}])\n([^{_SPACE}])", f" (?:[{_SPACE}]|$)"
#: Letters and the ASCII marks after them, but for apostrophes, which may begin a contraction.
_HEAD, _TAIL = r"^(\n?\p{L}+)[!-&(-/:-@\[-`{-~]+$", r"^\n?\p{L}+"


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[b : b + s] of each b and s, in one array."""
    ends = np.cumsum(size)
    at = np.repeat(begin - ends + size, size)
    at += np.arange(len(at))
    return pool[at]


class Encoder:
    """A tokenizer, with the chunks it has encoded so far."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocab = self.tokenizer.get_vocab()
        # a byte-level token has a character for each byte
        self.size = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)
        self.first = Chunks(self.one, "", 20_000)
        self.tails = Chunks(self.one, "", 1000)
        # chunks, where their ids lie in the pool, and the batch that last used each
        self.known, self.pool = pa.array([], pa.string()), np.array([], dtype="<u4")
        self.begin, self.length, self.used = (np.array([], dtype=np.int64) for _ in range(3))
        self.batch = 0

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, new: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks behind this white space, and their numbers, encoded in one go: no token crosses the place where a
        chunk begins, so their ids are cut apart by size."""
        ids = np.array(self.tokenizer.encode_batch_fast([space + space.join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        sizes = np.array(list(map(len, map(str.encode, new)))) + 1
        return ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(sizes)) + 1, prepend=0)

    def forget(self) -> None:
        """Drops the half of the chunks that were not used for longest, and long ones."""
        middle = np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        keep = self.used >= middle
        if keep.sum() > CHUNKS:
            keep = self.used > middle
        keep &= pc.binary_length(self.known).to_numpy() < 200
        self.pool = _gather(self.pool, self.begin[keep], self.length[keep])
        self.known, self.length, self.used = self.known.filter(pa.array(keep)), self.length[keep], self.used[keep]
        self.begin = np.cumsum(self.length) - self.length

    def slots(self, parts: pa.Array) -> np.ndarray:
        """Places of distinct chunks among the known ones; new ones are encoded."""
        if len(self.known) > CHUNKS or self.known.nbytes > 64 * CHUNKS:
            self.forget()
        self.batch += 1
        found = pc.index_in(parts, value_set=self.known)
        new = parts.filter(found.is_null())
        lines = pc.starts_with(new, "\n")
        spaced, broken = new.filter(pc.invert(lines)).to_pylist(), [x[1:] for x in new.filter(lines).to_pylist()]
        some = [self.learn(x[a : a + 256], space) for x, space in ((spaced, " "), (broken, "\n")) for a in range(0, len(x), 256)]
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if some:
            missing, lined = at < 0, lines.to_numpy(zero_copy_only=False)
            at[missing] = len(self.known) + np.where(lined, len(spaced) + np.cumsum(lined), np.cumsum(~lined)) - 1
            self.known = pa.concat_arrays([self.known, new.filter(pc.invert(lines)), new.filter(lines)])
            self.pool = np.concatenate([self.pool, *(ids for ids, _ in some)])
            self.length = np.concatenate([self.length, *(n for _, n in some)])
            self.begin = np.cumsum(self.length) - self.length
            self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])
        self.used[at] = self.batch
        return at

    def chunks(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and their numbers. The tokenizer splits between letters and punctuation marks, so letters with
        marks behind them are looked up without these."""
        heads = pc.replace_substring_regex(parts, _HEAD, r"\1")
        cut = pc.not_equal(pc.binary_length(heads), pc.binary_length(parts))
        tails = pc.replace_substring_regex(parts.filter(cut), _TAIL, "").dictionary_encode()
        heads = heads.dictionary_encode()
        at = self.slots(heads.dictionary)[heads.indices.to_numpy()]
        marks = [self.tails[x] for x in tails.dictionary.to_pylist()]
        n_marks = np.fromiter(map(len, marks), dtype=np.int64, count=len(marks)) // 4
        # chunk, marks, chunk, marks, ...
        begin, size = np.zeros((2, len(parts), 2), dtype=np.int64)
        begin[:, 0], size[:, 0] = self.begin[at], self.length[at]
        where, which = np.flatnonzero(cut.to_numpy(zero_copy_only=False)), tails.indices.to_numpy()
        begin[where, 1], size[where, 1] = (len(self.pool) + np.cumsum(n_marks) - n_marks)[which], n_marks[which]
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(marks), dtype="<u4")])
        return _gather(pool, begin.ravel(), size.ravel()), size.sum(axis=1)

    def join(self, split: pa.ListArray) -> list[bytes]:
        """Ids of texts that are given as chunks: the first begins the text, others come behind a space, or begin with a line break."""
        if not len(split):
            return []
        offsets = split.offsets.to_numpy()
        offsets, coded = offsets - offsets[0], split.flatten().dictionary_encode()
        del split  # as large as the texts
        place, first = coded.indices.to_numpy(), offsets[:-1]
        behind = np.zeros(len(coded.dictionary), dtype=bool)
        behind[np.delete(place, first)] = True
        ids, found = self.chunks(coded.dictionary.filter(pa.array(behind)))
        size = np.zeros(len(behind), dtype=np.int64)
        size[behind] = found
        n = size[place]
        n[first] = 0
        tokens = _gather(ids, (np.cumsum(size) - size)[place], n).tobytes()
        after = np.cumsum(n)[offsets[1:] - 1] * 4
        begins = coded.dictionary.take(pa.array(place[first])).to_pylist()
        return [self.first[x] + tokens[a:b] for x, a, b in zip(begins, [0, *after[:-1].tolist()], after.tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty): what encode(text, add_special_tokens=False) gives.

        Arrow splits texts at spaces and single line breaks, where tokens begin, numbers distinct parts and finds the known ones.
        Texts with further white space behind a space are split one by one."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, _INNER)
        some = texts.filter(pc.invert(odd)) if pc.any(odd).as_py() else texts
        plain = iter(self.join(pc.split_pattern(pc.replace_substring_regex(some, _BREAK, "\\1 \n\\2"), " ")))
        rest = iter(self.join(pa.array(list(map(chunks, texts.filter(odd).to_pylist())), pa.list_(pa.string()))))
        return [next(rest if x else plain) for x in odd.to_pylist()]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(definition, key: str) -> Encoder:
    """The worker's encoder of a broadcast definition, built once."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition.value)
    return _ENCODERS[key]


def write(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes all documents; returns the index, a row for each frame."""
    spark = docs.sparkSession
    shared.lean(spark)
    place = shared.folder(spark, "tokens")
    if "://" not in place and place.startswith("/"):
        place = f"file://{place}"
    with open(tokenizer) as f:
        definition = spark.sparkContext.broadcast(f.read())
    fs, inner = pa.fs.FileSystem.from_uri(place)
    fs.create_dir(inner, recursive=True)
    last = np.array([end], dtype="<u4").tobytes()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        path = f"{place}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
        writer, rows, ids, tokens, held = None, [], [], [], 0
        encoder = _encoder(definition, tokenizer)

        def flush():
            content = pack(ids, tokens)
            offset, size = writer.frame(content)
            rows.append((shard, path, len(rows), offset, size, len(content), ids[0], ids[-1], len(ids), sum(map(len, tokens)) // 4))

        for batch in batches:
            if writer is None:
                fs, inner = pa.fs.FileSystem.from_uri(path)
                writer = ShardWriter(fs.open_output_stream(inner, compression=None))
            keys = batch.column(0).fill_null(-1 << 63).to_pylist()
            for a, n in shared.runs(batch.column(1), TEXT_BYTES):
                for key, found in zip(keys[a : a + n], encoder.encode(batch.column(1).slice(a, n)), strict=True):
                    ids.append(key)
                    tokens.append(found + last)
                    held += len(tokens[-1])
                    if held >= frame_bytes:
                        flush()
                        ids, tokens, held = [], [], 0
        if ids:
            flush()
        if writer:
            writer.close()
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "path", "frame", "offset", "size", "content_size", "first_id", "last_id", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = shared.partitions(spark, shared.text_bytes(docs))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return shared.cut(ordered.mapInArrow(save, _INDEX))


def read(index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and token_ids (binary, little-endian unsigned 32-bit) of
    the documents in the frames of an index. Only these frames are fetched and decompressed, but `start` counts from the
    first row of this index: filter the result of `starts` to read a part of the files."""
    return read_frames(starts(index))


def starts(index: DataFrame) -> DataFrame:
    """The index with frame_start: ids in all frames before. Shards are few, frames are summed within theirs."""
    by_shard = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = by_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("frame")) - F.col("n_tokens")
    return index.withColumn("within", within).join(before, "shard").withColumn("frame_start", F.col("shard_start") + F.col("within")).drop("within", "shard_start")


def read_frames(index: DataFrame) -> DataFrame:
    """The documents of the frames of an index that `starts` returned."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] not in tables:
                    tables = {row["path"]: (f := _open(row["path"]), read_table(f))}
                file, table = tables[row["path"]]
                docs = unpack(read_frame(file, table[row["frame"]]))
                sizes = np.array([len(x) // 4 for _, x in docs], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == -1 << 63 else i for i, _ in docs], pa.int64()), pa.array(row["frame_start"] + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([x for _, x in docs], pa.binary())],
                    ["doc_id", "start", "n_tokens", "token_ids"],
                )

    spark = index.sparkSession
    n = shared.partitions(spark, index.agg(F.sum("content_size")).head()[0] or 0)
    rows = index.select("path", "frame", "frame_start").repartitionByRange(n, "path", "frame").sortWithinPartitions("path", "frame")
    return rows.mapInArrow(fetch, "doc_id long, start long, n_tokens long, token_ids binary")


def written(docs: DataFrame) -> DataFrame:
    """One row for each document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    return read(write(docs)).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
