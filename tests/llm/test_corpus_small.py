"""Mixing, exact duplicates, plane files and SentencePiece against brute force."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest

from tapline.llm import bitplanes, exact_dedup, mixing, sentencepieces
from tests.llm.helpers import awkward, by_id, documents

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_rows(texts, more):
    return [(i, t, ["src0", "src0", "src1", None][i % 4]) for i, t in enumerate(texts)] + [(i, t, s) for i, t, _, s in more]


# --- mixing -----------------------------------------------------------------------------------


def level_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mixing(spark):
    texts, more = awkward()
    rows = all_rows(texts, more)
    got = mixing.mix(mixing.sized(documents(spark, texts, more))).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    goal = level_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert t == int(goal[s] + 1e-9)
    again = mixing.mix(mixing.sized(documents(spark, texts, more))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_empty_and_wordless(spark):
    assert mixing.mix(mixing.sized(documents(spark, []))).count() == 0
    rows = mixing.mix(mixing.sized(documents(spark, [None, "", " "]))).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3


def test_repeated_keeps_columns(spark):
    docs = documents(spark, ["a b c", "d e f g", None, "h"])
    out = mixing.repeated(mixing.mix(mixing.sized(docs, carry=tuple(docs.columns))))
    assert out.columns == docs.columns and out.filter("text IS NULL").count() == 1


# --- exact duplicates -------------------------------------------------------------------------


def test_exact_groups(spark):
    texts, more = awkward(2)
    rows = all_rows(texts, more)
    norm = [SPACE.sub(" ", t or "") for _, t, _ in rows]
    got = exact_dedup.grouped(exact_dedup.fingerprinted(documents(spark, texts, more))).collect()
    assert len(got) == len(rows)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in norm]
    for r in got:
        same = [i for (i, _, _), h in zip(rows, sha) if h == r.text_sha256]
        known = [i for i in same if i is not None]
        assert r.group_size == len(same) and r.keep_id == (min(known) if known else None)
    assert sorted((r.doc_id, r.text_sha256) for r in got if r.doc_id is not None) == sorted(
        (i, h) for (i, _, _), h in zip(rows, sha) if i is not None)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(set(sha))


def test_exact_groups_carrying_columns(spark):
    texts, more = awkward(12)
    docs = documents(spark, texts, more)
    plain = exact_dedup.grouped(exact_dedup.fingerprinted(docs)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    carried = exact_dedup.grouped(exact_dedup.fingerprinted(docs, tuple(docs.columns)))
    assert carried.select("_carry.*").columns == docs.columns
    assert sorted(map(str, carried.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_exact_empty(spark):
    assert exact_dedup.grouped(exact_dedup.fingerprinted(documents(spark, []))).count() == 0


def test_fingerprints_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(150_000))
    base = exact_dedup.BASES[0]

    def whole(part):
        out = 0
        for b in part:
            out = (out * base + b + 1) % exact_dedup.PRIME
        return out

    assert exact_dedup.fingerprint(data) >> 31 == whole(data)
    a, b = data[:1234], data[1234:60_000]
    joined = exact_dedup.combine((whole(a), len(a)), (whole(b), len(b)), base)
    assert joined == (whole(a + b), 60_000)
    assert not exact_dedup.same(b"a" * 70_000, b"a" * 69_999 + b"b")


FINGERPRINTED = "_uid long, doc_id long, fp long, text_sha256 string, _like long, first boolean, norm binary"


def test_equal_fingerprints_of_different_texts_stay_apart(spark):
    """One fingerprint and one digest for all rows: the comparison alone can tell the two texts."""
    rows = spark.createDataFrame(
        [(1, 10, 5, "s", 1, True, b"one"), (2, 11, 5, "s", 2, True, b"two"), (3, 12, 5, "s", 3, True, b"one"),
         (4, 13, 5, "s", 2, False, None), (5, 14, 6, "s", 5, True, b"two")], FINGERPRINTED)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.grouped(rows).collect()}
    assert got == {10: (10, 2, True), 12: (10, 2, False), 11: (11, 2, True), 13: (11, 2, False), 14: (14, 1, True)}


def test_hot_fingerprints_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 3)
    texts = [[b"one", b"two", b"three"][i % 3 if i % 7 else 0] for i in range(60)]
    rows = spark.createDataFrame([(i, i, 5, "s", i, True, t) for i, t in enumerate(texts)], FINGERPRINTED)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.grouped(rows).collect()}
    assert got == {i: (texts.index(t), texts.count(t)) for i, t in enumerate(texts)}


def test_long_texts_are_hashed_in_chunks(spark, monkeypatch):
    """Chunks hashed apart give the fingerprint of the whole text, and the same groups."""
    rng = random.Random(8)
    long = "".join(rng.choice("ab c\n") for _ in range(200_000))
    texts = [long, long + "x", long.replace("\n", " \n"), "short", None, "y" * 65_536 * 3, "short "]
    docs = documents(spark, texts, [(50, long, "en", "src0")])
    plain = exact_dedup.fingerprinted(docs).select("doc_id", "fp").collect()
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = exact_dedup.grouped(exact_dedup.fingerprinted(docs)).select(columns).collect()
    monkeypatch.setattr(exact_dedup, "LONG", 60_000)
    apart = exact_dedup.fingerprinted(docs, tuple(docs.columns))
    assert sorted(apart.select("doc_id", "fp").collect()) == sorted(plain)
    assert sorted(exact_dedup.grouped(apart).select(columns).collect()) == sorted(want)


def test_recent_texts_fall_out_by_size():
    seen = exact_dedup.Recent(1000)
    assert [seen.first(k, t, u) for u, (k, t) in enumerate([(1, b"a"), (1, b"a"), (1, b"b"), (2, b"c" * 900), (1, b"a")])] == [
        0, 0, 2, 3, 4]


# --- planes -----------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_file_round_trip(kind):
    rng = np.random.default_rng(3)
    docs = [(i if i % 5 else None, rng.integers(0, 50_257, n).astype("<u4")) for i, n in enumerate([0, 1, 7, 1000, 3, 260, 0])]
    out = io.BytesIO()
    writer = bitplanes.Writer(out, kind, block=256)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    writer.close()
    reader = bitplanes.Reader(out, len(out.getvalue()))
    got = [(d, n, np.concatenate([np.empty(0, "<u4"), *p])) for d, n, p in reader.documents()]
    assert [(d, n) for d, n, _ in got] == [(d, len(x)) for d, x in docs]
    assert all((g == x).all() for (_, _, g), (_, x) in zip(got, docs))
    assert (reader.ids(2) == np.concatenate([x for _, x in docs])[512:768]).all()


def test_encoder_equals_the_library():
    e, rng = bitplanes.Encoder(bitplanes.tokenizer_file()), random.Random(4)
    bits = ["a", "bc", "é", " ", " ", "  ", "\n", "x's", "'ll", ".", "!!", "12", "²", "日本", "<|endoftext|>", "\x1c", "I'm "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(3000)]
    assert e.encode(texts) == library_ids(texts)


def library_ids(texts):
    """Ids by the library as it comes."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bitplanes.tokenizer_file())
    return [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_one_core_serves_all_endings_and_lines():
    e = bitplanes.Encoder(bitplanes.tokenizer_file())
    texts = ["a haus haus, haus. haus!!\nhaus, it's' 12, über; x\u00b2. haus.\n\nhaus", "a\nb\nhaus.\nEs haus,\n", "a \0 b", "\u00d7, haus\u3000\nhaus", ""]
    assert e.encode(texts) == [e.whole([t])[0] for t in texts]
    assert {"haus", "\0haus"} <= set(e.known) and not {"haus,", "haus!!", "haus!!\nhaus,"} & set(e.known)


def test_encoder_special_strings_and_generations(monkeypatch):
    monkeypatch.setattr(bitplanes, "CACHE", 40)
    e, rng = bitplanes.Encoder(bitplanes.tokenizer_file()), random.Random(6)
    special = ["<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext", "<|endoftext|><|endoftext|>  x"]
    assert e.encode(special) == library_ids(special)
    assert 50256 in np.frombuffer(e.encode(["a <|endoftext|>"])[0], "<u4")
    for _ in range(30):  # batches that fill the cache several times
        texts = [" ".join(str(int(rng.expovariate(0.02))) for _ in range(12)) for _ in range(3)]
        assert e.encode(texts) == library_ids(texts)
        assert len(e.known) <= 40 and len(e.older) <= 40


def test_planes_query_rows(spark):
    texts, more = awkward(5, 30)
    texts += ["one <|endoftext|> two"]
    docs = documents(spark, texts, more)
    from tapline.llm.common import saved, shared_folder

    folder = shared_folder(spark, "planes")
    got = bitplanes.read(saved(bitplanes.write(docs, folder, bitplanes.tokenizer_file()), "m"), folder).collect()
    rows = [(i, t or "") for i, t, _ in all_rows(texts, more)]
    want = {}
    for (i, t), ids in zip(rows, library_ids([t for _, t in rows])):
        ids += bitplanes.END_ID.to_bytes(4, "little")
        want.setdefault(i, []).append((len(ids) // 4, zlib.crc32(ids)))
    assert {k: sorted(v) for k, v in want.items()} == {
        k: sorted((r["n_tokens"], r["ids_crc32"]) for r in v) for k, v in by_id(bitplanes.read(
            saved(bitplanes.write(docs, folder, bitplanes.tokenizer_file()), "m"), folder)).items()}
    got.sort(key=lambda r: r.start)
    at, last = 0, -1
    for r in got:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else 10**9


def test_planes_empty(spark):
    from tapline.llm.common import saved, shared_folder

    folder = shared_folder(spark, "planes")
    manifest = saved(bitplanes.write(documents(spark, []), folder, bitplanes.tokenizer_file()), "m")
    assert bitplanes.read(manifest, folder).count() == 0


# --- SentencePiece ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = sentencepieces.model_file()
    return sentencepieces.Lattice(path), sentencepiece.SentencePieceProcessor(model_file=path)


def ids_of(raw):
    return np.frombuffer(raw, "<u2").tolist()


def chunked(lat, text, size):
    w = sentencepieces.prepared(text)
    n, margin = -(-len(w) // size), lat.longest
    parts = [(w[max(0, i * size - margin):(i + 1) * size + margin], min(margin, i * size), min(size, len(w) - i * size), i == 0,
              i == n - 1) for i in range(n)]
    path = sentencepieces.path_states([lat.transfer(*p) for p in parts])
    return b"".join(lat.back(*p, *ends) for p, ends in zip(parts, path))


def test_lattice_equals_the_library(pieces):
    lat, lib = pieces
    rng = random.Random(6)
    bits = ["a", "the", "ing", "é", " ", " ", "  ", "\n", "x's", "日本", "!!", "12", "ß", "▁", "<s>", "<0x41>", "er", "   ", "🙂"]
    for k in range(1500):
        text = "".join(rng.choices(bits, k=rng.randint(1, 40)))
        want = lib.encode(text)
        assert ids_of(lat.encode(text)) == want
        if k % 5 == 0:
            assert all(ids_of(chunked(lat, text, size)) == want for size in (17, 33))
    solid = "".join(rng.choices(["er", "on", "thing", "a", "é", "q"], k=1500))
    assert ids_of(chunked(lat, solid, 400)) == lib.encode(solid)


def test_compatibility_is_that_of_merging(pieces):
    lat, _ = pieces
    rng, vocab = random.Random(7), list(lat.vocab.values())
    for _ in range(4000):
        a, b = rng.choice(vocab), rng.choice(vocab)
        x, y = lat.text[a], lat.text[b]
        assert lat._compatible(a, b) == (lat._merged(x + y) == [x, y])


def test_maxplus_is_associative():
    rng = np.random.default_rng(8)
    a, b, c = (np.where(rng.random(s) < 0.4, 0.0, -np.inf) for s in ((3, 4), (4, 5), (5, 2)))
    assert (sentencepieces.maxplus(sentencepieces.maxplus(a, b), c) == sentencepieces.maxplus(a, sentencepieces.maxplus(b, c))).all()


def test_sentencepieces_rows(spark, pieces):
    lat, lib = pieces
    texts, more = awkward(9, 30)
    docs = documents(spark, texts, more)
    model = sentencepieces.model_file()
    got = by_id(sentencepieces.digested(sentencepieces.encoded(docs, model, chunk=500), model))
    want = {}
    for i, t, _ in all_rows(texts, more):
        ids = lib.encode(t or "")
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted((r["n_pieces"], r["ids_crc32"]) for r in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(r["round_trip"] for v in got.values() for r in v)
    listed = sentencepieces.listed(sentencepieces.encoded(docs, model, chunk=500, carry=("lang", "source")))
    assert listed.columns == ["doc_id", "lang", "source", "n_pieces", "ids"] and listed.count() == len(texts) + len(more)
    assert sentencepieces.digested(sentencepieces.encoded(documents(spark, []), model), model).count() == 0
