"""Exact spectra of windows too large for one array, as a distributed Fourier transform.

A length-N transform is rewritten as a circular convolution of power-of-two length M = M1 * M2
(Bluestein). Each length-M transform is split into M2 transforms of length M1, a twiddle, and M1
transforms of length M2, so no task ever holds more than about sqrt(M) points of a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.config import Config
from tapline.operators import windows
from tapline.operators.spectral import SPECTRAL

POINTS = "w string, n long, m1 long, m2 long, j long, re double, im double"


def _split(n: Column) -> dict[str, Column]:
    bits = F.ceil(F.log2((2 * n - 1).cast("double"))).cast("int")
    low = (bits / 2).cast("int")
    return {"m1": F.pow(F.lit(2.0), low).cast("bigint"), "m2": F.pow(F.lit(2.0), bits - low).cast("bigint")}


def transform(points: DataFrame) -> DataFrame:
    """Forward transform of every series `w`; absent points are zero. Result index k replaces j."""

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        m1, m2 = int(pdf.m1.iloc[0]), int(pdf.m2.iloc[0])
        j2 = int(pdf.j.iloc[0]) % m2
        a = np.zeros(m1, dtype=complex)
        a[(pdf.j // m2).to_numpy()] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        k1 = np.arange(m1)
        # The product stays below 2**53, so the phase is exact before it is scaled.
        out = np.fft.fft(a) * np.exp(-2j * np.pi * ((j2 * k1) % (m1 * m2)) / (m1 * m2))
        return pd.DataFrame({"w": pdf.w.iloc[0], "n": pdf.n.iloc[0], "m1": m1, "m2": m2,
                             "j": k1 * m2 + j2, "re": out.real, "im": out.imag})

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        m1, m2 = int(pdf.m1.iloc[0]), int(pdf.m2.iloc[0])
        k1 = int(pdf.j.iloc[0]) // m2
        a = np.zeros(m2, dtype=complex)
        a[(pdf.j % m2).to_numpy()] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        out = np.fft.fft(a)
        return pd.DataFrame({"w": pdf.w.iloc[0], "n": pdf.n.iloc[0], "m1": m1, "m2": m2,
                             "j": k1 + m1 * np.arange(m2), "re": out.real, "im": out.imag})

    first = points.withColumn("_g", F.col("j") % F.col("m2")).groupBy("w", "_g").applyInPandas(
        columns, schema=POINTS)
    return first.withColumn("_g", F.expr("j div m2")).groupBy("w", "_g").applyInPandas(rows, schema=POINTS)


def _times(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> dict[str, Column]:
    return {"re": a_re * b_re - a_im * b_im, "im": a_re * b_im + a_im * b_re}


def _chirp(index: Column) -> tuple[Column, Column]:
    angle = F.pmod(index * index, 2 * F.col("n")).cast("double") / F.col("n") * F.lit(np.pi)
    return F.cos(angle), -F.sin(angle)


def magnitudes(series: DataFrame) -> DataFrame:
    """``series(w, n, j, x)`` with j in 0..n-1 to ``(w, n, k, magnitude)`` for k in 1..n/2."""
    from tapline.session import materialise

    sized = series.withColumns(_split(F.col("n")))
    c_re, c_im = _chirp(F.col("j"))
    a = sized.select("w", "n", "m1", "m2", "j", (F.col("x") * c_re).alias("re"), (F.col("x") * c_im).alias("im"))
    one = sized.filter("j = 0").select("w", "n", "m1", "m2")
    # The convolution kernel: conjugate chirp at +j and at M - j, generated in blocks.
    block = 1 << 16
    kernel = (one.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {block}"))))
              .repartition("w", "_b")
              .withColumn("j0", F.explode(F.sequence(
                  F.col("_b") * block, F.least(F.col("n") - 1, F.col("_b") * block + block - 1)))))
    k_re, k_im = _chirp(F.col("j0"))
    kernel = kernel.withColumns({"re": k_re, "im": -k_im}).withColumn("j", F.explode(F.array_distinct(F.array(
        F.col("j0"), F.pmod(F.col("m1") * F.col("m2") - F.col("j0"), F.col("m1") * F.col("m2"))))))
    fa = transform(a)
    fb = transform(kernel.select("w", "n", "m1", "m2", "j", "re", "im"))
    prod = fa.alias("a").join(fb.select("w", "j", F.col("re").alias("b_re"), F.col("im").alias("b_im")), ["w", "j"])
    mult = _times(F.col("re"), F.col("im"), F.col("b_re"), F.col("b_im"))
    # Inverse transform through conjugation; only magnitudes are needed, so the final chirp,
    # which has modulus one, and the outer conjugate drop out.
    conj = prod.select("w", "n", "m1", "m2", "j", mult["re"].alias("re"), (-mult["im"]).alias("im"))
    back = transform(materialise(conj, "bigfft"))
    return back.filter((F.col("j") >= 1) & (F.col("j") <= F.expr("n div 2"))).select(
        "w", "n", F.col("j").alias("k"),
        (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("m1") * F.col("m2"))).alias("magnitude"))


def spectra(series: DataFrame, means: DataFrame) -> DataFrame:
    """Spectral struct per series; ``means(w, mean)`` are mean gaps in seconds."""
    mag = F.col("magnitude")
    agg = magnitudes(series).groupBy("w", "n").agg(
        F.max_by("k", F.struct("magnitude", -F.col("k"))).alias("_k"), F.max("magnitude").alias("_max"),
        F.sum("magnitude").alias("_sum"), F.avg("magnitude").alias("_avg"),
        F.avg(F.log(mag + 1e-12)).alias("_log"), F.sum(mag * F.col("k")).alias("_wk"))
    f1 = 1.0 / (F.col("n") * F.greatest(F.col("mean"), F.lit(1e-6)))  # frequency step
    vals = [F.col("_k") * f1, F.exp("_log") / (F.col("_avg") + 1e-12), F.col("_max") / (F.col("_sum") + 1e-12),
            F.col("_wk") * f1 / (F.col("_sum") + 1e-12), F.col("_max") / (F.col("_avg") + 1e-12)]
    flat = F.col("_max") == 0
    return agg.join(means, "w").select("w", F.struct(*[
        F.when(flat, F.lit(0.0)).otherwise(v).alias(c) for v, c in zip(vals, SPECTRAL)]).alias("_big"))


def oversized(df: DataFrame, cfg: Config, group_cols: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Windows with a slot beyond the array bound."""
    n = df.groupBy(*group_cols, windows.slot_of(cfg).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    big = n.filter(F.col("n") > windows.slot_capacity(cfg))
    return windows.explode_slots(big, cfg, whole).select(*group_cols, "window_end").distinct()


def fill(f: DataFrame, df: DataFrame, cfg: Config, group_cols: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Complete the null `_sp` of oversized windows; one small job decides whether there are any.

    Fewer than four gaps, or gaps equal in whole microseconds, have no spectrum, as for windows held as arrays.
    """
    big = oversized(df, cfg, group_cols, whole)
    if not big.take(1):
        return f
    keys = [*group_cols, "window_end"]
    ev = windows.explode_slots(df.select(*group_cols, "ts_us", "event_id", windows.slot_of(cfg).alias("slot")),
                               cfg, whole).join(big, keys, "left_semi")
    in_slot = Window.partitionBy(*keys, "slot").orderBy("ts_us", "event_id")
    ev = ev.withColumns({"_r": F.row_number().over(in_slot), "_prev": F.lag("ts_us").over(in_slot)})
    counts = ev.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("_n"), F.min("ts_us").alias("_first"),
                                           F.max("ts_us").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("slot")  # at most window/slot rows each
    counts = counts.withColumns({
        "_off": F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"),
        "_before": F.lag("_last").over(across), "_total": F.sum("_n").over(Window.partitionBy(*keys)),
        "_t0": F.min("_first").over(Window.partitionBy(*keys)), "_t1": F.max("_last").over(Window.partitionBy(*keys)),
    })
    rows = ev.join(counts.select(*keys, "slot", "_off", "_before", "_total", "_t0", "_t1"), [*keys, "slot"])
    prev = F.coalesce("_prev", "_before")
    iat = (F.col("ts_us") / 1e6 - prev / 1e6) if cfg.iat_mode == "double" else (F.col("ts_us") - prev) / 1e6
    wid = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    n = (F.col("_total") - 1).cast("bigint")
    mean = (F.col("_t1") - F.col("_t0")) / 1e6 / n
    series = rows.filter(prev.isNotNull()).select(
        wid.alias("w"), n.alias("n"), (F.col("_off") + F.col("_r") - 2).cast("bigint").alias("j"), (iat - mean).alias("x"))
    means = (counts.select(wid.alias("w"), mean.alias("mean")).distinct())
    gap = F.col("ts_us") - prev
    flat = rows.filter(prev.isNotNull()).groupBy(wid.alias("w")).agg(
        ((F.count(gap) < 4) | ((F.min(gap) == F.max(gap)) if cfg.iat_mode != "double" else F.lit(False))).alias("_flat"))
    zeros = F.struct(*[F.lit(0.0).alias(c) for c in SPECTRAL])
    done = spectra(series, means).join(flat, "w").select("w", F.when(F.col("_flat"), zeros).otherwise(F.col("_big")).alias("_big"))
    return (f.withColumn("_w", wid).join(done.withColumnRenamed("w", "_w"), "_w", "left")
            .withColumn("_sp", F.when(F.col("_big").isNotNull(), F.col("_big")).otherwise(F.col("_sp"))).drop("_w", "_big"))
