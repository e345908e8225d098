"""Small document tables with awkward rows."""

from __future__ import annotations

import random

from tapline.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _uid long, n long, score double, _key string"
WORDS = ["the", "of", "and", "thing", "eau", "que", "über", "niño", "haus", "la", "word,", "End.", "x1", "A", "日本", "tí"]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n)).rstrip("\t")


def documents(spark, texts, extra=()):
    """Documents 0.. with clashing extra columns; ``extra`` are further (doc_id, text, lang, source) rows."""
    prepare(spark)
    rows = [(i, t, ["en", "fr", None][i % 3], ["src0", "src0", "src1", None][i % 4], None) for i, t in enumerate(texts)]
    rows += [(*r, None) for r in extra]
    return spark.createDataFrame([(*r, 7, 8, 9.0, "k") for r in rows], SCHEMA).repartition(3)


def awkward(seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(n)]
    texts += [None, "", " ", "\n\t", "a", "ÄÖ", texts[0], texts[0], texts[1].replace(" ", "  "), "x" * 70_000, prose(rng, 9000)]
    more = [(None, "null id", "en", "src0"), (3, texts[3], "fr", "src0"), (3, texts[3], "fr", "src0"), (None, None, None, None)]
    return texts, more


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r.asDict())
    return out
