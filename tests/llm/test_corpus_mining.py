"""Whitening, decontamination and collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tapline.llm import collocations, decontaminate, whitening
from tapline.llm.common import prepare

from .helpers import awkward, by_id, documents


# --- whitening -----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, component int, whitened double, x array<long>, n long"


def vectors(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, v, 9, 1.0, [1], 5) for i, v in rows], VECTORS).repartition(3)


def by_hand(rows, k=4):
    x = np.array([np.floor(256 * np.array(v, float)) + 0 for v in rows])
    u = np.unique(x, axis=0)
    e, q = np.linalg.eigh(np.cov(u.T, bias=True))
    return x, u, e[::-1][:k], q[:, ::-1][:, :k]


def checked(out, rows, ids):
    x, u, e, q = by_hand(rows)
    got = out.toPandas().sort_values(["vec_id", "component"])
    assert got.vec_id.tolist() == [i for i in ids for _ in e] and got.component.tolist() == [*range(1, len(e) + 1)] * len(ids)
    ref = (x - u.mean(0)) @ q / np.sqrt(e)
    w = got.whitened.to_numpy().reshape(len(ids), -1)
    assert np.abs(ref * np.sign((ref * w).sum(0)) - w).max() < 1e-9
    sums, n = u.sum(0).astype(int), len(u)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert got.deviation.tolist() == [v for v in exact for _ in e] and set(got.n) == {n}
    total = np.trace(np.cov(u.T, bias=True))
    assert np.abs(got.explained.to_numpy().reshape(len(ids), -1) - e / total).max() < 1e-12
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    rows = (rng.standard_normal((400, 64)) * 0.2).tolist()
    rows += rows[:50]  # repeated vectors are whitened and fitted once
    checked(whitening.whiten(vectors(spark, list(enumerate(rows)))), rows, range(len(rows)))


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    rows = (rng.standard_normal((60, 6)) * [5, 3, 1, 0.5, 0.3, 0.2] - 40).tolist()
    rows[3] = [-0.0, 0.0, -0.001, 0.001, 1.0, -1.0]
    extra = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6),
             (904, [float("inf")] + [0.0] * 5), (905, [1.0, 2.0])]
    checked(whitening.whiten(vectors(spark, [*enumerate(rows), *extra])), rows, range(60))


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, r.deviation) for r in flat] == [
        (1, None, None, None, 0), (2, None, None, None, 0)] * 2
    line = whitening.whiten(vectors(spark, [(i, [float(i), 0.0, 0.0]) for i in range(5)])).collect()
    assert all((r.whitened is not None) == (r.component == 1) for r in line)
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0]), (None, [0.0, 1.0])])).collect()
    assert {r.deviation for r in huge} == {None}


def test_filter_certifies_spectra_that_hardly_separate():
    rng = np.random.default_rng(5)
    for values in (np.linspace(1, 1.1, 96), np.r_[np.ones(90), 3, 3, 3, 3, 3, 3], np.r_[1e-9 * np.ones(92), 1, 2, 3, 4]):
        q = np.linalg.qr(rng.standard_normal((96, 96)))[0]
        v = q * values @ q.T
        e, y = whitening.components(lambda m: v @ m, 96, 4)
        assert np.allclose(e, np.sort(values)[::-1][:4], rtol=1e-12)
        assert np.linalg.norm(v @ y - y * e) < 1e-11 and np.abs(y.T @ y - np.eye(4)).max() < 1e-13


# --- decontamination ---------------------------------------------------------------------------------

ITEM = re.compile(rb"[0-9a-z\x80-\xff]+")


def hits_by_hand(text, items):
    words = ITEM.findall((text or "").encode().lower())
    hit, found = set(), set()
    for item, content in items:
        own = ITEM.findall((content or "").encode().lower())
        for w in decontaminate.windows_of(own):
            for i in range(len(words) - len(w) + 1):
                if words[i:i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add("null" if item is None else str(item))
    return len(words), len(hit), len(found), decontaminate.digest(found), bool(hit)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 3, "w") for i, t in rows], "item_id long, text string, n_words long, window string")


def test_contamination_equals_brute_force(spark):
    texts, more = awkward(5)
    rng = random.Random(2)
    long = " ".join(f"w{rng.randint(0, 30)}" for _ in range(40))
    items = [(1, long), (2, long.upper()), (2, "Über, THING"), (None, "la"), (4, None), (5, ""), (6, "!!"), (7, texts[3]), (7, texts[3]),
             (8, "日本 tí")]
    texts += [f"x {long}, y", long.replace(" ", "--")[:60], "ÜBER thing", "überx thing", "a" * 50 + " la", "LA la. La", long[5:90] + "\x00" + long]
    docs = documents(spark, texts, more)
    by_text = by_id(decontaminate.hits(docs, benchmark(spark, items)))
    want = {i: sorted([hits_by_hand(t, items)] + [hits_by_hand(m[1], items) for m in more if m[0] == i]) for i, t in enumerate(texts)}
    want[None] = sorted(hits_by_hand(m[1], items) for m in more if m[0] is None)

    def shown(rows):
        return sorted((r["n_words"], sum(x["b"] - x["a"] for x in r["runs"]), len(r["items"]), decontaminate.digest(set(r["items"])), bool(r["runs"]))
                      for r in rows)

    assert {k: shown(v) for k, v in by_text.items()} == want
    blocks = by_id(decontaminate.hits(docs, benchmark(spark, items), block=7))
    assert {k: shown(v) for k, v in blocks.items()} == want


def test_contaminated_spans_lead_to_the_original(spark):
    text = "Ä ñ; The QUICK-brown… fox, ÜBER 日本!"
    out = decontaminate.hits(documents(spark, [text]), benchmark(spark, [(1, "quick brown"), (2, "日本")])).first()
    assert [text[s.a:s.b] for s in out.spans] == ["日本"]  # "brown…" is one word
    out = decontaminate.hits(documents(spark, [text]), benchmark(spark, [(1, "the quick")])).first()
    assert [text[s.a:s.b] for s in out.spans] == ["The QUICK"]


def test_contamination_of_empty_tables(spark):
    docs = documents(spark, ["a b", None])
    none = benchmark(spark, [(1, "a")]).limit(0)
    assert [r.items for r in decontaminate.hits(docs, none).collect()] == [[], []]
    assert decontaminate.hits(docs.limit(0), none).collect() == []


# --- collocations ----------------------------------------------------------------------------------------

def phrases_by_hand(rows, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        over = {}
        for q in found:
            for s in range(2, len(q)):
                for i in range(len(q) - s + 1):
                    over[q[i:i + s]] = max(over.get(q[i:i + s], 0), counts[q])
        rows = []
        for p in found:
            a = counts[p]
            if p in over and 100 * over[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(spark, rows, least, top, size):
    prepare(spark)
    docs = spark.createDataFrame([(t, la, "g", 1, 2) for t, la in rows], "text string, lang string, gram string, at int, c long").repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(docs, least, top, size=size).collect())


def test_collocations_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["The", "of", "a", "b", "ñu", "日本", "x1", "-", "\x00z", "of\x1fthe"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", ".", "\x0b"]) for _ in range(rng.randint(0, 80))),
             rng.choice(["en", "en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", "en"), (" \n.", "fr"), ("one two three four five " * 40, "fr"), ("only", "xx"), ("A a A a a a a", "de")] + rows[:5]
    for size, least, top in ((200, 4, 30), (collocations.SHARD, 6, 2000)):
        assert mined(spark, rows, least, top, size) == phrases_by_hand(rows, least, top)


def test_collocations_of_nothing(spark):
    assert mined(spark, [(None, None)], 2, 5, 100) == []
    assert mined(spark, [("a b. c d", "en")], 2, 5, 100) == []
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []


def test_index_extends_both_ways():
    rng = np.random.default_rng(1)
    ids = collocations.gapped(rng.integers(0, 5, 400).astype(np.int32))
    text = ids.tolist()
    fwd, rev, width = collocations.transform(ids), collocations.transform(ids[::-1]), 5
    grams, _, _, counts = collocations.two_words(fwd, width)
    found = [(grams, counts), *collocations.longer(fwd, rev, width, np.arange(len(grams)))]
    for k, (grams, counts) in zip((2, 3, 4), found):
        want = Counter(tuple(text[i:i + k]) for i in range(len(text) - k + 1) if 0 not in text[i:i + k])
        assert dict(zip(map(tuple, grams.tolist()), counts.tolist())) == want and len(grams) == len(want)
    some = {tuple(g) for g in found[0][0][::2].tolist()}
    for k, (grams, counts) in zip((3, 4), collocations.longer(fwd, rev, width, np.arange(0, len(found[0][0]), 2))):
        want = Counter(tuple(text[i:i + k]) for i in range(len(text) - k + 1) if all(tuple(text[j:j + 2]) in some for j in range(i, i + k - 1)))
        assert dict(zip(map(tuple, grams.tolist()), counts.tolist())) == want
