"""Token ids in binary files of shuffled planes, written in ascending doc_id order and read back.

A file holds blocks of a fixed number of ids. A block is transposed into byte planes (or bit planes), every plane is
compressed with zstandard on its own, and the footer holds the chunk index (offset, ids, compressed size of each
plane) and the document index (doc_id, ids). Documents are range-partitioned by (doc_id, text hash), so even a
doc_id that a third of all rows share is spread over files; one file per partition is written as a stream, under a
name of its own per task attempt, and only the names of committed attempts enter the manifest.

Layout, little endian: b"TPL1" | planes... | zstd(footer) | u64 footer length | b"TPL1". The footer is
i64[5] (version, plane kind, block ids, blocks, documents), i64[blocks, 2 + planes], i64[documents, 2], u8[documents].

Defined results: null text is empty and gives the end id alone; a null doc_id comes after all others; rows of equal
doc_id are ordered by a hash of their text; an empty table writes no file and gives an empty table.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapline.llm.common import mapped, saved, shared_folder, table

MAGIC = b"TPL1"
BLOCK = 1 << 16
END_ID = 2
CACHE = 500_000  # pieces of a generation
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: ASCII letters and digits, and the letters of U+00C0 to U+024F: the pre-tokenizer always cuts between one of them and ASCII punctuation.
LETTERS = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
BEFORE_CUT = f"[{LETTERS}]$"
#: One line end between such characters is a token of its own; there a text is cut too, and the line's first piece is marked.
LINE, MARK = f"([{LETTERS}!-/:-@\\[-`{{-~])\\n([{LETTERS}])", "\0"
READ_ROWS = 8192


class Encoder:
    """The tokenizers library behind a cache of space-delimited pieces.

    The pre-tokenizer never joins a non-space with a following space, so a text whose spaces all follow
    non-spaces is the sequence of its pieces " x"; any other text, and any that holds an added token's string
    (the library takes that out before it splits), goes to the library whole. Unknown pieces are encoded many at a
    time: no id inside a piece begins with a space, so ids that do mark where pieces start. A piece that ends in ASCII
    punctuation after a letter or digit is its core and that ending, so one core serves all its endings; lines that follow each
    other without a space are cut at the line end, where the library cuts as well (texts that hold ``MARK`` go whole). The cache has two
    generations: when the newer one is full it becomes the older, and pieces still in use move on.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        size = self.lib.get_vocab_size()
        self.starts = np.array([(self.lib.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.endings: dict[str, bytes] = {}
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        spaces = "".join(f"\\x{{{i:x}}}" for i in range(0x3001) if chr(i).isspace())
        self.uneasy = "|".join([f"[{spaces}] "] + ["".join(f"\\x{{{ord(c):x}}}" for c in a) for a in added] + ["\\x00"])
        self.line = self.lib.token_to_id("Ċ")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        lines = [p for p in pieces if p[:1] == MARK]
        words = [p for p in pieces if p[:1] != MARK]
        for found, before, begins in ((words, " ", self.starts), (lines, "\n", np.arange(len(self.starts)) == self.line)):
            bare = [p.removeprefix(MARK) for p in found]
            easy = [(p, b) for p, b in zip(found, bare) if b and b.strip() == b]
            for at in range(0, len(easy), 1000):
                part, texts = zip(*easy[at:at + 1000])
                ids = np.array(self.whole_ids(before + before.join(texts)), "<u4")
                cuts = (np.flatnonzero(begins[ids]) * 4).tolist()
                if len(cuts) == len(part):
                    raw = ids.tobytes()
                    self.known.update(zip(part, map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)]))))
                else:
                    self.known.update(zip(part, self.whole([before + b for b in texts])))
            rest = [(p, b) for p, b in zip(found, bare) if not b or b.strip() != b]
            self.known.update(zip([p for p, _ in rest], self.whole([before + b for _, b in rest])))

    def whole_ids(self, text: str) -> list[int]:
        return self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        odd = np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), self.uneasy).to_numpy(zero_copy_only=False)).tolist()
        easy = sorted(set(range(len(texts))) - set(odd))
        out = dict(zip(odd, self.whole([texts[i] for i in odd])))
        out.update(zip(easy, self._pieced([texts[i] for i in easy])))
        return [out[i] for i in range(len(texts))]

    def _pieced(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts cut at spaces and line ends: every distinct piece is looked up once, its ids are gathered by position."""
        if not texts:
            return
        split = pc.split_pattern(pc.replace_substring_regex(pa.array(texts, pa.large_string()), LINE, f"\\1 {MARK}\\2"), " ")
        coded = split.flatten().dictionary_encode()
        pieces, edges = coded.dictionary, split.offsets.to_numpy()
        at = coded.indices.to_numpy().astype(np.int64)
        names, head = np.unique(at[edges[:-1]], return_inverse=True)  # first pieces follow no space
        at[edges[:-1]] = len(pieces) + head
        raw = self._ids(pieces) + self.whole(_strings(pieces.take(pa.array(names))))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        begins, n = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(raw), "<u4")[np.arange(ends[-1]) + np.repeat(begins[at] - ends[:-1], n)]
        bounds = ends[edges]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield ids[a:b].tobytes()

    def _ids(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces that follow a space, or a line end if marked."""
        bare = pc.utf8_rtrim(pieces, PUNCTUATION)
        cut = pc.and_(pc.not_equal(bare, pieces), pc.match_substring_regex(bare, BEFORE_CUT))
        coded = pc.if_else(cut, bare, pieces).dictionary_encode()
        cores = _strings(coded.dictionary)
        self._know(cores)
        raw = list(map(list(map(self.known.__getitem__, cores)).__getitem__, coded.indices.to_numpy().tolist()))
        for i, p, c in zip(np.flatnonzero(cut.to_numpy(zero_copy_only=False)).tolist(), _strings(pieces.filter(cut)), _strings(bare.filter(cut))):
            raw[i] += self._ending(p[len(c):])
        return raw

    def _ending(self, text: str) -> bytes:
        if text not in self.endings:
            if len(self.endings) >= CACHE:
                self.endings.clear()
            self.endings[text] = self.whole([text])[0]
        return self.endings[text]

    def _know(self, pieces: list[str]) -> None:
        """Put all the pieces into the newer generation."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, self.older, new = {}, self.known, pieces
        held = {p: ids for p, ids in zip(new, map(self.older.get, new)) if ids is not None}
        self.known.update(held)
        self._learn([p for p in new if p not in held])


def _strings(found: pa.Array) -> list[str]:
    return found.to_numpy(zero_copy_only=False).tolist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class Writer:
    """Streams ids of consecutive documents into one file."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.out, self.kind, self.block = out, kind, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC) and len(MAGIC)
        self.rest, self.held, self.total = [], 0, 0
        self.chunks: list[list[int]] = []
        self.docs: list[tuple[int, int]] = []
        self.nulls = bytearray()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, len(ids) // 4))
        self.nulls.append(doc_id is None)
        self.rest.append(ids)
        self.held += len(ids) // 4
        self.total += len(ids) // 4
        if self.held >= self.block:
            data = np.frombuffer(b"".join(self.rest), "<u4")
            full = len(data) - len(data) % self.block
            for a in range(0, full, self.block):
                self._block(data[a:a + self.block])
            self.rest, self.held = [data[full:].tobytes()], len(data) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), *map(len, planes)])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._block(np.frombuffer(b"".join(self.rest), "<u4"))
        head = np.array([1, self.kind == "bit", self.block, len(self.chunks), len(self.docs)], "<i8")
        foot = self.zip.compress(head.tobytes() + np.array(self.chunks, "<i8").tobytes()
                                 + np.array(self.docs, "<i8").tobytes() + bytes(self.nulls))
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)


class Reader:
    """Random access to blocks and documents of one file."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._read(size - 12, 12)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file")
        n = int.from_bytes(tail[:8], "little")
        foot = zstandard.ZstdDecompressor().decompress(self._read(size - 12 - n, n))
        _, bit, self.block, chunks, docs = np.frombuffer(foot, "<i8", 5).tolist()
        self.kind, planes = ("bit", 32) if bit else ("byte", 4)
        at = 40 + chunks * (2 + planes) * 8
        self.chunks = np.frombuffer(foot[40:at], "<i8").reshape(chunks, 2 + planes)
        self.docs = np.frombuffer(foot[at:at + docs * 16], "<i8").reshape(docs, 2)
        self.nulls = foot[at + docs * 16:]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, chunk: int) -> np.ndarray:
        at, n, *sizes = self.chunks[chunk].tolist()
        raw, planes, unzip = self._read(at, sum(sizes)), [], zstandard.ZstdDecompressor()
        for size in sizes:
            planes.append(unzip.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, ids, the ids in parts by block), one block in memory at a time."""
        chunk, data, at = -1, np.empty(0, "<u4"), 0
        for (doc_id, n), null in zip(self.docs.tolist(), self.nulls):
            parts, left = [], n
            while left:
                if at == len(data):
                    chunk, at = chunk + 1, 0
                    data = self.ids(chunk)
                parts.append(data[at:at + left])
                at += len(parts[-1])
                left -= len(parts[-1])
            yield None if null else doc_id, n, parts


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte") -> DataFrame:
    """Encode ``text`` and write the files; returns the manifest: part, path, n_ids, n_docs, first id position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = file = None
        part = TaskContext.get().partitionId()
        where, base = pafs.FileSystem.from_uri(folder)
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex[:8]}.tpl"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                where.create_dir(base, recursive=True)
                file = where.open_output_stream(path)
                writer = Writer(file, kind)
            coded = encoder(tokenizer).encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded):
                writer.add(doc_id, ids + END_ID.to_bytes(4, "little"))
        if writer is not None:
            writer.close()
            file.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [path], "n_ids": [writer.total], "n_docs": [len(writer.docs)]})

    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_last(), "_h")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "_h"))
    manifest = saved(ordered.mapInArrow(run, "part int, path string, n_ids long, n_docs long"), "planes-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row per file
    return manifest.withColumn("first", F.sum("n_ids").over(before) - F.col("n_ids"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files of a manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out, start = ([], [], [], []), row["first"]

                def emit() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])

                with where.open_input_file(row["path"]) as file:
                    for doc_id, n, parts in Reader(file, file.size()).documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p.tobytes(), crc)
                        for column, value in zip(out, (doc_id, start, n, crc)):
                            column.append(value)
                        start += n
                        if len(out[0]) >= READ_ROWS:
                            yield emit()
                            out = ([], [], [], [])
                yield emit()

    files = manifest.repartition(max(1, manifest.count()), F.col("part"))  # as many tasks as files, not coalesced
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    folder = shared_folder(spark, "planes")
    manifest = saved(write(docs, folder, tokenizer_file()), "planes-files")
    return read(manifest, folder)
