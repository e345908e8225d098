"""Scores, language models, neighbours, personal data, near duplicates and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapline.llm import chosen_path, graph, hmm, language, nn_descent, pii, stages, toxicity
from tapline.llm.common import fold
from tests.llm.helpers import awkward, documents, prose

# --- toxicity ---------------------------------------------------------------------------------


def labelled(rng, n=240):
    bad = ["idiot", "scum", "trash"]
    texts, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(15, 40)).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ".", "!!"]))
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 5 == 0)))
    return texts, labels


def test_toxicity_scores(spark):
    texts, labels = labelled(random.Random(1))
    extra = [(None, "an idiot and scum, trash", None, None), (500, None, "en", "s"), (501, "", "en", "s"), (1, texts[1], "en", "s")]
    docs = documents(spark, texts, extra)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    _, rows, index = toxicity.fit(docs, lab, toxicity.training_rows())
    got = toxicity.scored(rows, index).collect()
    assert len(got) == len(texts) + len(extra)
    for r in got:
        assert 0 <= r.score <= 1
        toxic = r.doc_id is None or r.doc_id < 240 and r.doc_id % 5 == 0
        assert (r.score >= toxicity.REJECT) == toxic
        assert all(d % 5 == 0 for d in r.evidence_ids)
    clean = stages.without_toxic
    assert clean.__doc__


def test_toxicity_without_labels_or_rows(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    _, rows, index = toxicity.fit(documents(spark, ["a", None]), lab, toxicity.training_rows())
    assert [r.score for r in toxicity.scored(rows, index).collect()] == [0.0, 0.0]
    _, rows, index = toxicity.fit(documents(spark, []), lab, toxicity.training_rows())
    assert toxicity.scored(rows, index).count() == 0


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(2)
    idf = rng.uniform(1, 5, 40)
    rows = []
    for d in range(700):
        ids = sorted(rng.choice(40, rng.integers(0, 6), replace=False).tolist())
        rows.append((d, int(rng.random() < 0.3), ids, rng.integers(1, 4, len(ids)).tolist()))
    index = toxicity.Index(rows, idf, (1.0, 1.0))
    dense = np.zeros((700, 40))
    for d, _, ids, counts in rows:
        if ids:
            dense[d, ids] = index._unit(ids, counts)
    for _ in range(60):
        ids = np.array(sorted(rng.choice(40, 4, replace=False)))
        unit = index._unit(ids, [1, 2, 1, 3])
        cos = np.round(dense[:, ids] @ unit, 12)
        want = sorted((-c, d) for d, c in enumerate(cos) if c > 0)[:index.k]
        at, found = index.nearest(ids, unit)
        assert [d for _, d in want] == index.doc[at].tolist()
        assert np.allclose([-c for c, _ in want], found)


# --- language model ---------------------------------------------------------------------------


def test_forward_and_expected_counts_by_enumeration():
    rng = np.random.default_rng(3)
    k, s = 3, 5
    p = hmm.Parameters(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T)
    seqs = [np.array(x) for x in ([0], [1, 2, 0, 4], [3, 3], [2, 1, 0, 0, 4])]
    counts, logs = np.zeros((s + k + 1, k)), []
    for seq in seqs:
        paths = {}
        for path in itertools.product(range(k), repeat=len(seq)):
            w = p.start[path[0]] * p.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                w *= p.move[path[t - 1], path[t]] * p.emit[seq[t], path[t]]
            paths[path] = w
        total = sum(paths.values())
        logs.append(math.log(total))
        for path, w in paths.items():
            counts[s + k, path[0]] += w / total
            for t, z in enumerate(path):
                counts[seq[t], z] += w / total
                if t:
                    counts[s + path[t - 1], z] += w / total
    assert np.allclose(hmm.forward(seqs, p), logs)
    assert np.allclose(hmm.expected(seqs, p), counts)


def test_language_model_rows(spark):
    texts, more = awkward(4, 80)
    texts = [t for t in texts if t is None or len(t) < 60_000]
    docs = documents(spark, texts, more)
    got = hmm.modelled(docs, fold(10) == 0, head=12, states=3, sample_texts=40, sample_steps=2, full_steps=2).collect()
    rows = [(i, t or "") for i, t in enumerate(texts)] + [(i, t or "") for i, t, _, _ in more]
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 10:
            counts.update([*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        found = [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None]
        want.append((str(i), len(found), sum(counts[w] > 0 for w in found),
                     round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in found), 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert hmm.modelled(documents(spark, []), fold(10) == 0, head=5, states=2).count() == 0


def test_language_model_is_a_distribution(spark):
    """Known and unknown words of a position, with the end, sum to one under the model's first step."""
    docs = documents(spark, ["a b c a", "b c d", "a a", "e f g a", "b"] * 4)
    words = hmm.word_counts(docs, F.lit(True))
    vocabulary = hmm.Vocabulary(words, 20, head=2)
    unigram = vocabulary.unigram()
    p = hmm.Parameters.initial(unigram, 3)
    first = (p.start * p.emit).sum(axis=1)
    assert first.sum() == pytest.approx(1)
    mass = vocabulary.class_mass()
    inside = np.zeros(hmm.CLASSES)
    for r in vocabulary.tail(words).collect():
        inside[r["cls"]] += (r["c"] + hmm.SMOOTH) / mass[r["cls"]]
    assert np.allclose(inside + hmm.SMOOTH / mass, 1)  # the rest is an unknown word


def test_expectation_steps_grow_with_the_corpus(spark, monkeypatch):
    docs = documents(spark, [f"a b{i % 7} c{i % 11}" for i in range(3000)])
    vocabulary = hmm.Vocabulary(hmm.word_counts(docs, F.lit(True)), 3000, head=8)
    rows, seen, plain = hmm.encoded(docs, vocabulary, F.lit(False)), [], hmm.step
    monkeypatch.setattr(hmm, "step", lambda r, p, u: seen.append(r.count()) or plain(r, p, u))
    hmm.train(rows, vocabulary, states=2, sample_texts=10)
    assert seen[-2:] == [3000, 3000] and all(60 <= n <= 140 for n in seen[:-2])


def test_a_round_of_expectation_steps_takes_every_text_once(spark, monkeypatch):
    docs = documents(spark, [f"a b{i % 7} c{i} d{i % 5}" for i in range(300)])
    vocabulary = hmm.Vocabulary(hmm.word_counts(docs, F.lit(True)), 300, head=8)
    rows, seen, plain = hmm.encoded(docs, vocabulary, F.lit(False)), [], hmm.step
    texts = sorted(bytes(r.sym) for r in rows.select("sym").collect())

    def step(r, p, u):
        seen.append([bytes(x.sym) for x in r.select("sym").collect()])
        return plain(r, p, u)

    monkeypatch.setattr(hmm, "step", step)
    p = hmm.train(rows, vocabulary, states=2, sample_texts=50, sample_steps=4, full_steps=0)
    assert len(seen) == 6 and sorted(x for part in seen for x in part) == texts
    assert np.allclose(p.counts[:vocabulary.symbols].sum(), sum(len(x) // 2 for x in texts))  # every position counts once


def test_long_texts_step_together(monkeypatch):
    monkeypatch.setattr(hmm, "CELLS", 2000)
    assert [len(part) for part, _, _ in hmm._lockstep([np.zeros(n, np.int64) for n in [10] * 100 + [1000]])] == [101]


def test_counts_are_passed_on_once_a_core(spark):
    docs = documents(spark, [f"a b{i % 7} c{i} d{i % 5}" for i in range(90)])
    vocabulary = hmm.Vocabulary(hmm.word_counts(docs, F.lit(True)), 90, head=8)
    p = hmm.Parameters.initial(vocabulary.unigram(), 2)
    rows = hmm.encoded(docs, vocabulary, F.lit(False)).select("sym").repartition(40)
    got = hmm._partial_counts(rows, spark.sparkContext.broadcast(p), ["k0", "k1"])
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    total = hmm.expected([np.frombuffer(r.sym, "<u2").astype(np.int64) for r in rows.collect()], p)
    assert got.agg(F.sum("k0") + F.sum("k1")).first()[0] == pytest.approx(total.sum())


# --- language identification ------------------------------------------------------------------


def plain_bits(model, counts, text, lang):
    total = 0.0
    for i in range(len(text)):
        k, bits = min(i, model.order), 0.0
        while True:
            seen = {w[-1]: c for w, c in counts[lang].items() if len(w) == k + 1 and w[:-1] == text[i - k:i]}
            if seen:
                n, d = sum(seen.values()), len(seen)
                if text[i] in seen:
                    bits -= math.log2(seen[text[i]] / (n + d))
                    break
                bits -= math.log2(d / (n + d))
            if k == 0:
                bits += 8
                break
            k -= 1
        total += bits
    return total


def test_code_lengths_are_exact():
    samples = {"en": b"the thing then that this thing of the end", "fr": "le chat était là, le père".encode()}
    counts = {lang: Counter(t[i:i + n] for n in range(1, 5) for i in range(len(t) - n + 1)) for lang, t in samples.items()}
    held = {}
    for lang, t in samples.items():
        for n in range(1, 5):
            codes, c = np.unique(language.grams(np.frombuffer(t, np.uint8), n), return_counts=True)
            held[lang, n] = (codes, c.astype(float))
    model = language.Model(held)
    texts = [b"", b"t", b"thing", "là-bas 日".encode(), "zzz the père".encode()]
    bits = model.many_bits(texts)
    for t, row in zip(texts, bits):
        assert np.allclose(row, [plain_bits(model, counts, t, lang) for lang in model.langs])
        assert np.allclose(row, model.bits(t))


def test_language_predictions(spark):
    rng = random.Random(5)
    en, fr = ["the", "thing", "of", "with", "then"], ["le", "eau", "que", "était", "où"]
    texts = [" ".join(rng.choice(en if i % 3 == 0 else fr) for _ in range(30)) for i in range(60)]
    texts = [t for i, t in enumerate(texts) if i % 3 != 2]
    texts = [t for pair in zip(texts[::2], texts[1::2]) for t in (*pair, None)]  # language by position, as in the helper
    docs = documents(spark, texts, [(900, "123 !!", "en", "s"), (901, "", None, "s"), (None, "le où était", "fr", "s")])
    got = language.identified(docs, language.fit(docs, fold(4) != 2)).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r.doc_id is None:
            assert r.lang_pred == "fr"
        elif r.doc_id >= 900 or texts[r.doc_id] is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == ("en" if r.doc_id % 3 == 0 else "fr") and 0.5 <= r.score <= 1
    assert [r.lang_pred for r in language.identified(docs, language.Model({})).collect()] == ["und"] * len(got)
    none = documents(spark, [])
    assert language.identified(none, language.fit(none, fold(4) != 2)).count() == 0


def test_training_chunks_of_giant_and_repeated_texts(spark):
    """A giant text neither passes the bound nor hides its language's other texts; copies are drawn apart."""
    rows = [(i, "le eau que " * 20, "fr") for i in range(40)] + [(99, "the thing of " * 60_000, "en")]
    rows += [(i, "with then " * 20, "en") for i in range(100, 140)] + [(7, "oder aber nicht " * 60, "de")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = language.training_counts(docs, F.lit(True), train_chars=20_000).filter("n = 1").groupBy("lang").agg(
        F.sum("count").alias("n")).collect()
    got = {r["lang"]: r["n"] for r in counts}
    assert got.keys() == {"de", "en", "fr"} and got["fr"] == 40 * 220
    assert all(20_000 <= got[k] <= 20_000 + language.CHUNK for k in ("de", "en"))
    whole = language.training_counts(docs, F.lit(True)).filter("lang = 'en' AND n = 4").agg(F.sum("count")).first()[0]
    assert whole == 60_000 * 13 - 3 + 40 * 197


# --- neighbours -------------------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, _uid long, shard string")


def test_neighbours_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "SHARD_FLOATS", 16 * 1500)  # two shards
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2400, 16)).astype(np.float32) * rng.uniform(0.5, 1.5, (2400, 1)).astype(np.float32)
    rows = [(i, v.tolist(), 0, 5, "s") for i, v in enumerate(x)]
    got = nn_descent.neighbours(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, degree=12, rounds=2, beam=128).toPandas()
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    hit = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21))
        assert np.allclose(part["score"], exact[q][part["vec_id"].astype(int)], atol=1e-12)
        assert (np.diff(part["score"]) <= 0).all() and q not in set(part["vec_id"])
        hit += len(set(part["vec_id"]) & set(np.argsort(-exact[q])[:20]))
    assert got["query_id"].nunique() == 120 and hit / (120 * 20) >= 0.9


def test_neighbours_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0, 1, "a"), (1, [1.0, 0.0], 0, 1, "a"), (2, [1.0, 0.0], 0, 1, "a"), (3, [0.0, 0.0], 0, 1, "a"), (4, None, 0, 1, "a"),
            (5, [nan, 1.0], 0, 1, "a"), (6, [inf, 1.0], 0, 1, "a"), (7, [None, 1.0], 0, 1, "a"), (20, [0.5, 2.0], 0, 1, "a"),
            (20, [0.5, 2.0], 0, 1, "a"), (None, [3.0, 0.0], 0, 1, "a"), (40, [1.0, 1.0, 1.0], 0, 1, "a")]
    got = nn_descent.neighbours(vectors_of(spark, rows), F.col("vec_id") % 20 == 0).collect()
    first = [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 0]
    assert sorted(first) == [(1, None, 3.0), (2, 1, 1.0), (3, 2, 1.0), (4, 20, 0.5), (5, 20, 0.5)]
    assert sorted(r.vec_id for r in got if r.query_id == 20 and r.rank == 1) == [20, 20]
    assert not [r for r in got if r.query_id == 40]
    assert nn_descent.neighbours(vectors_of(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_shards_in_small_rows(spark, monkeypatch):
    for name, value in (("SHARD_FLOATS", 16 * 1500), ("NODE_BLOCK", 200), ("QUERY_BLOCK", 16), ("PART_BYTES", 4096)):
        monkeypatch.setattr(nn_descent, name, value, raising=False)
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(2400, 16)).astype(np.float32), rng.normal(size=(40, 3)).astype(np.float32)
    rows = [(i, v.tolist(), 0, 5, "s") for i, v in enumerate([*x, *y])]
    placed = nn_descent.points(vectors_of(spark, rows))
    shards = nn_descent.packed(placed)
    linked = nn_descent.graph(shards, degree=12)
    for df in (shards, linked):  # no row grows with a shard
        for c in (c for c, kind in df.dtypes if kind == "binary"):
            assert df.agg(F.max(F.length(c))).first()[0] <= 4500, c
    parts = shards.orderBy("shard", "first").collect()
    assert len({p["shard"] for p in parts}) == 3
    ids = [i for p in parts for i in np.frombuffer(p["ids"], np.int64).tolist()]
    assert sorted(ids) == list(range(2440))
    for p in parts:
        here = np.frombuffer(p["ids"], np.int64)
        vecs = np.frombuffer(p["matrix"], np.float32).reshape(-1, p["dim"])
        assert (np.diff(here) > 0).all() and all((v == (x[i] if i < 2400 else y[i - 2400])).all() for i, v in zip(here, vecs))
    nodes = {}
    for p in linked.collect():
        n = len(p["near"]) // 4 // 12
        nodes.setdefault(p["shard"], []).extend(range(p["first"], p["first"] + n))
        assert np.frombuffer(p["near"], np.int32).max() < p["n"]
    assert {s: sorted(n) for s, n in nodes.items()} == {p["shard"]: list(range(p["n"])) for p in parts}
    got = nn_descent.search(shards, linked, placed.filter("vec_id % 20 = 0").drop("shard"), beam=128).toPandas()
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    hit = [len(set(got.loc[got["query_id"] == q, "vec_id"]) & set(np.argsort(-exact[q])[:20])) for q in range(0, 2400, 20)]
    assert np.mean(hit) >= 18
    small = y.astype(float) @ y.astype(float).T
    np.fill_diagonal(small, -np.inf)
    for q in (0, 20):
        part = got[got["query_id"] == 2400 + q].sort_values("rank")
        assert part["vec_id"].tolist() == (2400 + np.argsort(-small[q])[:20]).tolist()


def test_neighbours_of_doubles(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5))
    got = nn_descent.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"),
                                F.col("vec_id") == 7).orderBy("rank").collect()
    assert [r.score for r in got] == pytest.approx(sorted(np.delete(x @ x[7], 7))[::-1][:20], abs=1e-14)


def test_neighbours_reverse_lists(spark):
    """Of the nodes that list a node, the least by Spark's hash for each residue of it."""
    rng = np.random.default_rng(10)
    near = np.stack([rng.permutation(300)[:4] for _ in range(300)]).astype(np.int32)
    near[5:9, 2:] = -1
    edges = spark.createDataFrame([(u, int(v)) for u in range(300) for v in near[u] if v >= 0], "u int, node int")
    least = edges.withColumn("h", F.xxhash64("u", "node")).groupBy("node", F.pmod("h", F.lit(4)).alias("r")).agg(F.min_by("u", "h").alias("u"))
    want = {n: set(near[n].tolist()) - {-1} for n in range(300)}
    for r in least.collect():
        want[r["node"]].add(r["u"])
    got = nn_descent.around(near)
    assert got.shape == (300, 8) and {n: set(got[n].tolist()) - {-1} for n in range(300)} == want


# --- personal data ----------------------------------------------------------------------------

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                                    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    def keep(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == 1:
            return all(int(p) <= 255 for p in found.split("."))
        if kind == 2:
            odd = [int(d) for d in digits[::-1]]
            check = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd))
            return 13 <= len(digits) <= 19 and check % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if keep(k, m.group())]


def test_pattern_spans():
    rng = random.Random(7)
    bits = ["a", "b.c", "@", "@x.y", "1", "23", "255", "300", ".", " ", "-", "+", "+49 ", "(", "4111111111111111", "é", "001", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 24)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 200_000 + "@") == []


def test_disclosing_terms(spark):
    rng = random.Random(8)
    words = ["river", "stone", "cloud", "green", "small", "house", "light"]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{fill(12)} Zwanziger wrote from bob@mail.example.org today {fill(12)}" for _ in range(5)]
    texts += [f"{fill(30)}" for _ in range(200)] + [f"{fill(5)} about ZWANZIGER, once more {fill(5)}", None, ""]
    docs = documents(spark, texts, [(None, texts[0], "en", "s")])
    blocks = pii._blocks(pii.disclosing(docs))
    assert blocks[0].value.keys() >= {b"zwanziger"} and not blocks[0].value.keys() & {w.encode() for w in words}
    got = pii.spans(docs, blocks).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = (texts[r.doc_id] if r.doc_id is not None else texts[0]) or ""
        base = plain_spans(text)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert r.n_email == sum(s[0] == 0 for s in base)
        marked = [text[int(a):int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"]
        assert ("zwanziger" in [m.lower() for m in marked]) == ("zwanziger" in text.lower()) and r.n_term == len(marked)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, blocks).collect()}
    assert "bob@" not in clean[0] and "Zwanziger" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10]
    assert pii.spans(documents(spark, []), []).count() == 0


def test_terms_of_entities_in_one_document(spark):
    """An address of one document is disclosed by that document's own words: short, of digits, far away."""
    rng = random.Random(9)
    words = ["river", "stone", "cloud", "green", "small", "house", "light"]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"Jo, file 77120 {fill(400)} ann@mail.example.org {fill(40)}", f"{fill(5)} Kim {fill(5)}"]
    texts += [f"{fill(60)}" for _ in range(200)]
    found = {bytes(r["term"]): r["bits"] for r in pii.disclosing(documents(spark, texts)).collect()}
    assert found.keys() == {b"jo", b"file", b"77120", b"ann", b"mail", b"example", b"org"}
    assert found[b"jo"] == pytest.approx(math.log2(1 / 1.5 * len(texts)))


# --- near duplicates --------------------------------------------------------------------------


def plain_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links, root = [0] * len(texts), list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            root[max(top(a), top(b))] = min(top(a), top(b))
    return links, [top(i) for i in range(len(texts))]


def family(rng, size, length, changes):
    words = [f"w{rng.randrange(10_000)}" for _ in range(length)]
    out = []
    for _ in range(size):
        w = list(words)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(length)] = f"v{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("split", [256, 6])
def test_near_duplicates(spark, monkeypatch, split):
    """Also with buckets that must be split, and with dense ones."""
    monkeypatch.setattr(chosen_path, "SPLIT", split)
    monkeypatch.setattr(chosen_path, "PART", 7)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = family(rng, 25, 120, 4) + family(rng, 6, 40, 2) + family(rng, 4, 7, 1)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(20)] + [None, "", " ", "One two", "one TWO", "three"]
    texts += [texts[3], texts[3].upper(), texts[3].replace(" ", "\n")]
    links, root = plain_classes(texts)
    got = {r.doc_id: r for r in chosen_path.near_duplicates(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i].links for i in range(len(texts))] == links
    assert [got[i].class_id for i in range(len(texts))] == root
    assert [got[i]["first"] for i in range(len(texts))] == [root[i] == i for i in range(len(texts))]


def test_sets_dealt_anew_are_as_many_as_their_tokens(spark):
    further = spark.createDataFrame([(u, 8 * t + 1, 1) for u in range(5) for t in range(3)], "uid long, token long, run long")
    again = spark.createDataFrame([(u, 1) for u in range(4) for _ in range(7)] + [(4, 2)], "uid long, run long")
    got = chosen_path._dealt_anew(further, again, 2).collect()
    assert len(got) == 12 and len(set(got)) == 12 and {r.bucket & 7 for r in got} == {1}


def test_sets_dealt_anew_join_once_with_their_tokens(spark):
    further = spark.createDataFrame([(u, [8 * t + r for t in range(3) for r in range(2)]) for u in range(5)], "uid long, tokens array<long>")
    again = spark.createDataFrame([(u, 1) for u in range(4) for _ in range(7)] + [(0, 0), (4, 2)], "uid long, run long")
    got = chosen_path._dealt_anew(further, again, 2).collect()
    assert len(got) == len(set(got)) == 15 and {r.bucket & 7 for r in got if r.uid} == {1}
    assert sum(r.uid == 0 for r in got) == 6


def test_near_duplicates_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = chosen_path.near_duplicates(documents(spark, ["x y"], [(7, text, None, None), (7, text, None, None), (None, text, None, None)])).collect()
    assert sorted((r.class_id, r.links, r["first"]) for r in got) == [(0, 0, True), (7, 2, False), (7, 2, False), (7, 2, True)]
    assert chosen_path.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("most", [graph.BROADCAST_ROWS, 0])
def test_stars_that_broadcast_and_stars_in_parts_agree(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
    edges = [(0, i) for i in range(1, 40)] + [(50 + i, 51 + i) for i in range(6)] + [(53, 53), (51, 50)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(40)} | {i: 50 for i in range(50, 57)}


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 260)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in list(root)}


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    texts, labels = labelled(rng, 120)
    texts += [texts[1], texts[1].replace(" ", "  "), None, "", *family(rng, 3, 100, 1)]
    docs = documents(spark, texts, [(None, "lonely text without an id", "en", "src9")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        counts[name] = at.count()
    assert counts["toxicity"] == len(texts) + 1 - 24
    kept = spark.read.parquet(f"{tmp_path}/exact_dedup").select("doc_id").toPandas()["doc_id"].tolist()
    assert 1 in kept and 120 not in kept and 121 not in kept and counts["exact_dedup"] == counts["toxicity"] - 3
    assert counts["ngram_jaccard"] == counts["exact_dedup"] - 2
    assert counts["sentencepiece"] == counts["mixing"] and {"doc_id", "n_pieces", "ids"} <= set(at.columns)
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_words_of_a_batch_are_looked_up_once(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aÄb \t\n\x0b\x0c\r\x1c\x85\xa0日X.\0") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", " "]
    words, at, edges = hmm.words_of(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}))
    found = words.to_pylist()
    assert len(set(found)) == len(found) and b"" not in found
    assert [[found[i] for i in at[a:b]] for a, b in zip(edges[:-1], edges[1:])] == [hmm.tokens((t or "").encode()) for t in texts]
    assert hmm.word_classes(words).tolist() == [hmm.word_class(w) for w in found]
    counted = hmm.word_counts(documents(spark, texts), F.lit(True)).collect()
    assert {bytes(r["word"]): (r["cls"], r["c"]) for r in counted} == {w: (hmm.word_class(w), int((at == i).sum())) for i, w in enumerate(found)}


def test_rows_dealt_anew_grow_as_the_sets(spark):
    def dealt(n: int) -> int:
        """Sets of 19 chosen tokens, of which two runs are in large buckets, one of them in many."""
        sets = spark.createDataFrame([(i, [(i * 50 + t) << 3 | t % 5 for t in range(19)]) for i in range(n)], "uid long, tokens array<long>")
        again = spark.createDataFrame([(i, run) for i in range(n) for run in (0, 0, 0, 3)], "uid long, run long")
        return chosen_path._dealt_anew(sets, again, 2).count()

    assert [dealt(100), dealt(200), dealt(400)] == [800, 1600, 3200]
