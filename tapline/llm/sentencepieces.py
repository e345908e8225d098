"""SentencePiece BPE encoding by a max-plus scan over chunks, and decoding.

A sequence of pieces is the BPE encoding of its text exactly if every adjacent pair is the encoding of its own
concatenation. So encoding is a path through a lattice with weight 0 between such pairs and minus infinity elsewhere, and
from a given last piece at most one such path reaches any position. A giant text is cut into chunks. The states of a
cut are the pieces that may cover or end at it; a chunk yields the max-plus transfer matrix from the states of its
left cut to those of its right cut. Matrices of a document are combined associatively, the states on the one finite path are
read off, and every chunk is traced back on its own, in another task. Pieces never cross the start of a word, so
words between cuts come from a cache of words that the same lattice has encoded.

The text is normalised as the model states (identity, a dummy leading space, spaces as U+2581); unknown characters
fall back to bytes. Decoding turns ids back into text; only U+2581 in a text is lost, as in the library.

Defined results: null is empty and has no pieces; an empty table gives an empty table; repeated rows stay.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.llm.common import mapped, saved, struct_of, table
from tapline.llm.graph import streamed_groups

CHUNK = 65_536
CACHE = 700_000
BAR = "▁"
FRESH = 0  # the unknown piece: nothing merges with it, as at a word's start
_SEGMENT = re.compile(f"{BAR}+[^{BAR}]*")

State = tuple[int, int]  # a piece that starts before a cut, and how far it reaches beyond


class Lattice:
    """Pieces of a model, pair compatibility, and paths over strings."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.vocab = {p: i for i, p in enumerate(self.text) if not special[i]}
        self.score = [lib.get_score(i) for i in range(n)]
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.value = {i: b for b, i in enumerate(self.bytes)}
        self.longest = max(map(len, self.vocab))
        if any(BAR in p.lstrip(BAR) for p in self.vocab) or any(c not in self.vocab for p in self.vocab for c in p):
            raise ValueError("pieces of this model cross word starts or hold unknown characters")
        self.begun = {p[:k]: self.vocab.get(p[:k], -1) for p in self.vocab for k in range(1, len(p) + 1)}
        self.codes = [i.to_bytes(2, "little") for i in range(n)]
        self.raw = [b"" if s else p.replace(BAR, " ").encode() for p, s in zip(self.text, special)]
        for i, b in self.value.items():
            self.raw[i] = bytes([b])
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def _merged(self, text: str) -> list[str]:
        """BPE of a short string: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.vocab.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, piece: int) -> tuple[list, list] | None:
        """Along the left and right edge of a piece's merge tree: (text, formed, merged away), times being ranks.

        None if a part has a worse score than the whole it forms: its times would not be in order.
        """
        if piece not in self.spines:
            nodes = [(c, -np.inf, None, None) for c in self.text[piece]]
            ordered = True
            while len(nodes) > 1:
                found = [(self.score[q], -i) for i in range(len(nodes) - 1)
                         if (q := self.vocab.get(nodes[i][0] + nodes[i + 1][0])) is not None]
                if not found:
                    break
                score, i = max(found)
                x, y = nodes[-i], nodes[1 - i]
                ordered &= -score > max(x[1], y[1])
                nodes[-i:2 - i] = [(x[0] + y[0], -score, x, y)]
            sides = []
            for child in (2, 3):
                node, until, side = nodes[0], np.inf, []
                while node is not None:
                    side.append((node[0], node[1], until))
                    node, until = node[child], node[1]
                sides.append(side)
            self.spines[piece] = tuple(sides) if ordered and len(nodes) == 1 else None
        return self.spines[piece]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (FRESH: start a stretch): no merge crosses between them."""
        if right == FRESH:
            return True
        if left == FRESH:
            ok = self.alone.get(right)
            if ok is None:
                ok = self.alone[right] = self._merged(self.text[right]) == [self.text[right]]
            return ok
        key = left << 20 | right
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = self._compatible(left, right)
        return ok

    def _compatible(self, left: int, right: int) -> bool:
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return self._merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
        get = self.vocab.get
        for x, x_from, x_until in a[1]:
            for y, y_from, y_until in b[0]:
                across = get(x + y)
                if across is not None:
                    at = max(-self.score[across], x_from, y_from)
                    if at < x_until and at <= y_until:
                        return False
        return True

    def chain(self, w: str, start: int, last: int, stop: int) -> tuple[list[int | None], list[int]]:
        """The last piece and its start for the one path from ``start`` to each position up to ``stop``."""
        n, get, pairs, alone, longest = stop - start, self.begun.get, self.pairs, self.alone, self.longest
        ends: list[int | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        ends[0] = last
        for s in range(n):
            left = ends[s]
            if left is None:
                continue
            at, e = start + s, s + 1
            piece = get(w[at])
            if piece is None:
                ends[e], back[e] = FRESH, s
                continue
            most = min(n, s + longest)
            while True:
                if piece > 0 and ends[e] is None:
                    ok = pairs.get(left << 20 | piece) if left else alone.get(piece)
                    if ok or ok is None and self.fits(left, piece):
                        ends[e], back[e] = piece, s
                if e == most:
                    break
                e += 1
                piece = get(w[at:start + e])
                if piece is None:
                    break
        return ends, back

    def trace(self, w: str, start: int, back: list[int], ends: list[int | None], e: int) -> bytes:
        """Ids of the path to position ``start + e`` as 16-bit integers."""
        out = []
        while e > 0:
            out.append(self.codes[ends[e]] if ends[e] else self.code(FRESH, w[start + back[e]]))
            e = back[e]
        out.reverse()
        return b"".join(out)

    def code(self, piece: int, char: str) -> bytes:
        if piece != FRESH:
            return self.codes[piece]
        return b"".join([self.codes[self.bytes[b]] for b in char.encode("utf-8", "replace")])

    def word(self, w: str) -> bytes:
        """Ids of a word; words of letters and words with more to them are cached apart."""
        cache = self.words if w[-1].isalpha() else self.others
        ids = cache.get(w)
        if ids is None:
            if len(cache) > (CACHE if cache is self.words else CACHE // 3):
                cache.clear()
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            if "\n" in w:  # a line feed is unknown: nothing merges across it
                ids = self.code(FRESH, "\n").join([self.word(x) if x else b"" for x in w.split("\n")])
            else:
                ids = self._core_and_tail(w)
                if ids is None:
                    ends, back = self.chain(w, 0, FRESH, len(w))
                    ids = self.trace(w, 0, back, ends, len(w))
            cache[w] = ids
        return ids

    def _core_and_tail(self, w: str) -> bytes | None:
        """Paths of a word and of its closing punctuation, joined where their pieces are compatible."""
        core = w.rstrip(string.punctuation)
        if len(core) in (0, len(w)):
            return None
        a, b = self.word(core), self.word(w[len(core):])
        left, right = int.from_bytes(a[-2:], "little"), int.from_bytes(b[:2], "little")
        return a + b if left not in self.value and right not in self.value and self.fits(left, right) else None

    def encode(self, text: str) -> bytes:
        """Ids of a whole text in one chunk."""
        if not text:
            return b""
        segments = _SEGMENT.findall(prepared(text))
        get, also = self.words.get, self.others.get
        return b"".join([get(w) or also(w) or self.word(w) for w in segments])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids, with the dummy leading space."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u2").tolist()))

    # --- chunks -------------------------------------------------------------------------------

    def states(self, w: str, cut: int, end: bool) -> list[State]:
        """All pieces that may be the last to start before a cut."""
        out = []
        for s in range(max(0, cut - self.longest), cut):
            for e in range(cut, cut + 1 if end else min(len(w), s + self.longest) + 1):
                piece = self.vocab.get(w[s:e])
                if piece is not None:
                    out.append((piece, e - cut))
                elif e == cut and s == cut - 1:
                    out.append((FRESH, 0))
        return out

    def _outs(self, w: str, start: int, ends: list[int | None], stop: int) -> dict[State, int]:
        """States reached at the right cut, with the start of their piece."""
        out: dict[State, int] = {}
        for s in range(max(start, stop - self.longest), stop):
            left = ends[s - start]
            if left is None:
                continue
            for e in range(stop, min(len(w), s + self.longest) + 1):
                piece = self.vocab.get(w[s:e])
                if piece is None:
                    if not (e == stop and s == stop - 1):
                        continue
                    piece = FRESH
                if self.fits(left, piece):
                    out[piece, e - stop] = s
        return out

    def _cuts(self, w: str, start: int, stop: int) -> tuple[int, int] | None:
        """First and last word start in [start, stop)."""
        first = next((i for i in range(max(1, start), stop) if w[i] == BAR and w[i - 1] != BAR), None)
        if first is None:
            return None
        return first, next(i for i in range(stop - 1, 0, -1) if w[i] == BAR and w[i - 1] != BAR)

    def transfer(self, w: str, low: int, size: int, first: bool, last: bool) -> np.ndarray:
        """Max-plus matrix of a chunk w[low:low + size] with its context."""
        stop = low + size
        rows = [(FRESH, 0)] if first else self.states(w, low, False)
        columns = {s: i for i, s in enumerate(self.states(w, stop, last))}
        out = np.full((len(rows), len(columns)), -np.inf)
        tail = None
        for i, (piece, over) in enumerate(rows):
            start = low + over
            if start >= stop:
                if (piece, start - stop) in columns:
                    out[i, columns[piece, start - stop]] = 0.0
                continue
            cuts = self._cuts(w, start, stop)
            if cuts is None:
                reached = self._outs(w, start, self.chain(w, start, piece, stop)[0], stop)
            else:
                if self.chain(w, start, piece, cuts[0])[0][-1] is None:
                    continue
                if tail is None:
                    tail = self._outs(w, cuts[1], self.chain(w, cuts[1], FRESH, stop)[0], stop)
                reached = tail
            for state in reached:
                if state in columns:
                    out[i, columns[state]] = 0.0
        return out

    def back(self, w: str, low: int, size: int, first: bool, last: bool, row: int, column: int) -> bytes:
        """Ids of the pieces that start in a chunk, on the path between two states of its cuts."""
        stop = low + size
        piece, over = (FRESH, 0) if first else self.states(w, low, False)[row]
        goal = self.states(w, stop, last)[column]
        start = low + over
        if start >= stop:
            return b""
        cuts, out = self._cuts(w, start, stop), b""
        if cuts:
            ends, back = self.chain(w, start, piece, cuts[0])
            out = self.trace(w, start, back, ends, cuts[0] - start)
            out += b"".join(self.word(x) for x in _SEGMENT.findall(w[cuts[0]:cuts[1]]))
            start, piece = cuts[1], FRESH
        ends, back = self.chain(w, start, piece, stop)
        s = self._outs(w, start, ends, stop)[goal]
        return out + self.trace(w, start, back, ends, s - start) + self.code(goal[0], w[s])


def prepared(text: str) -> str:
    return BAR + text.replace(" ", BAR)


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Associative product: best sums over the middle state."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


def path_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Row and column of every chunk's matrix on the finite path: prefix products, then the states backwards."""
    before = [np.zeros((1, 1))]
    for m in matrices:
        before.append(maxplus(before[-1], m))
    state, out = int(np.argmax(before[-1][0])), []
    for vector, m in zip(reversed(before[:-1]), reversed(matrices)):
        row = int(np.argmax(vector[0] + m[:, state]))
        out.append((row, state))
        state = row
    return out[::-1]


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One per Python worker."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def parts(docs: DataFrame, model: str, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: _uid, doc_id, chunk, chunks, text_sha256, ids; ids null where a scan must follow, then with text."""
    kept = [F.struct(*carry).alias("_carry")] if carry else []
    names = "_uid long, doc_id long, chunk int, chunks int, text_sha256 string, ids binary, w string, low int, size int, n_chars long"
    state: dict[str, int] = {}

    def run(batch: pa.RecordBatch) -> dict:
        model_ = lattice(model)
        uid = state.get("n", 0) + (TaskContext.get().partitionId() << 36)
        out: dict[str, list] = {c.split()[0]: [] for c in names.split(", ")}
        owner: list[int] = []
        for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
            text = text or ""
            sha = hashlib.sha256(text.encode()).hexdigest()
            if len(text) < chunk:
                rows = [(0, 1, model_.encode(text), None, None, None)]
            else:
                w, margin = prepared(text), model_.longest
                n = -(-len(w) // chunk)
                rows = [(i, n, None, w[max(0, i * chunk - margin):(i + 1) * chunk + margin], min(margin, i * chunk),
                         min(chunk, len(w) - i * chunk)) for i in range(n)]
            for i, n, ids, w, low, size in rows:
                for name, x in zip(out, (uid + k, doc_id, i, n, sha, ids, w, low, size, len(text))):
                    out[name].append(x)
                owner.append(k)
        state["n"] = state.get("n", 0) + batch.num_rows
        return out | ({"_carry": batch.column("_carry").take(pa.array(owner, pa.int64()))} if carry else {})

    return saved(mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *kept), run, names,
                        struct_of(docs, carry) if carry else None), "pieces-parts", "zstd")


def scanned(rows: DataFrame, model: str) -> DataFrame:
    """_uid, chunk, ids of the chunks of giant texts."""
    giant = rows.filter("ids IS NULL").select("_uid", "chunk", "chunks", "w", "low", "size").repartition("_uid", "chunk")

    def matrices(batch: pa.RecordBatch) -> dict:
        found = [lattice(model).transfer(r["w"], r["low"], r["size"], r["chunk"] == 0, r["chunk"] == r["chunks"] - 1)
                 for r in batch.to_pylist()]
        return {"_uid": batch.column("_uid"), "chunk": batch.column("chunk"), "states": [m.shape[0] for m in found],
                "matrix": [np.packbits(m == 0).tobytes() for m in found], "columns": [m.shape[1] for m in found]}

    moved = saved(mapped(giant, matrices, "_uid long, chunk int, states int, matrix binary, columns int"), "pieces-matrices")

    def combine(group: list[tuple]) -> list[tuple]:
        group.sort(key=lambda r: r[1])
        found = [np.where(np.unpackbits(np.frombuffer(m, np.uint8), count=n * k).reshape(n, k), 0.0, -np.inf)
                 for _, _, n, m, k in group]
        return [(r[0], r[1], *ends) for r, ends in zip(group, path_states(found))]

    states = streamed_groups(moved, ["_uid"], combine, "_uid long, chunk int, row int, col int")

    def back(batch: pa.RecordBatch) -> dict:
        return {"_uid": batch.column("_uid"), "chunk": batch.column("chunk"), "ids": [
            lattice(model).back(r["w"], r["low"], r["size"], r["chunk"] == 0, r["chunk"] == r["chunks"] - 1, r["row"], r["col"])
            for r in batch.to_pylist()]}

    return mapped(giant.join(states, ["_uid", "chunk"]), back, "_uid long, chunk int, ids binary")


def encoded(docs: DataFrame, model: str, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: _uid, doc_id, text_sha256, n_chars, ids (16-bit little-endian), and the carried columns."""
    rows = parts(docs, model, chunk, carry)
    more = ["_carry"] if carry else []
    small = rows.filter("ids IS NOT NULL").select("_uid", "doc_id", "text_sha256", "n_chars", *more, "ids")

    def join(group: list[tuple]) -> list[tuple]:
        return [(group[0][0], b"".join(r[2] for r in sorted(group, key=lambda r: r[1])))]

    whole = streamed_groups(scanned(rows, model), ["_uid"], join, "_uid long, ids binary")
    large = rows.filter("ids IS NULL AND chunk = 0").select("_uid", "doc_id", "text_sha256", "n_chars", *more).join(whole, "_uid")
    return small.unionByName(large)


def digested(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as unsigned 32-bit integers), decoded_chars, round_trip."""
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_pieces", "ids_crc32", "decoded_chars", "round_trip")}
        for ids, sha in zip(batch.column("ids").to_pylist(), batch.column("text_sha256").to_pylist()):
            text = lattice(model).decode(ids)[1:]
            out["n_pieces"].append(len(ids) // 2)
            out["ids_crc32"].append(zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
            out["decoded_chars"].append(len(text.decode("utf-8", "replace")))
            out["round_trip"].append(hashlib.sha256(text).hexdigest() == sha)
        return out | {"doc_id": batch.column("doc_id")}

    return mapped(rows.select("doc_id", "text_sha256", "ids"), run,
                  "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, round_trip boolean")


def listed(rows: DataFrame) -> DataFrame:
    """The carried columns, n_pieces and ids as integers."""
    def run(batch: pa.RecordBatch) -> dict:
        held = [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]
        ends = np.cumsum([0] + [len(x) for x in held])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held).astype(np.int32)))
        return {"doc_id": batch.column("doc_id"), "n_pieces": np.diff(ends), "ids": ids, "_carry": batch.column("_carry")}

    out = mapped(rows.select("doc_id", "ids", "_carry"), run, "doc_id long, n_pieces long, ids array<int>",
                 rows.schema["_carry"].dataType)
    return out.select("doc_id", "_carry.*", "n_pieces", "ids")


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return digested(encoded(docs, model_file()), model_file())
