"""Queries of the corpus operators, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapline.llm import (
    bitplanes, chosen_path, collocations, decontaminate, exact_dedup, hmm, language, mixing, nn_descent, pii, sentencepieces,
    toxicity, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_hmm": hmm.query,
    "op3_language": language.query,
    "op4_bitplanes": bitplanes.query,
    "op5_mixing": mixing.query,
    "op6_sentencepieces": sentencepieces.query,
    "op7_nn_descent": nn_descent.query,
    "op8_pii": pii.query,
    "op9_chosen_path": chosen_path.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_whitening": whitening.query,
    "op12_decontamination": decontaminate.query,
    "op13_collocations": collocations.query,
}
ORACLE = {"op5_mixing": mixing.SQL, "op10_exact_dedup": exact_dedup.SQL, "op12_decontamination": decontaminate.SQL,
          "op13_collocations": collocations.SQL}
