"""Fourier spectra on a uniform grid: slabs are transformed in x-y per plane, pencils in z, then shells are grouped."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transform(cells: DataFrame, name: str, n: int) -> DataFrame:
    """kx, ky, kz (0 to n - 1), re, im: the Fourier coefficients, divided by n**3. A task holds a plane or a pencil at a time."""
    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((n, n))
        a[pdf["i"], pdf["j"]] = pdf["v"]
        f = np.fft.fft2(a)
        x, y = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        return pd.DataFrame({"kx": x.ravel(), "ky": y.ravel(), "k": int(pdf["k"].iloc[0]), "re": f.real.ravel(), "im": f.imag.ravel()})

    def pencil(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((len(pdf) // n, n), complex)
        pdf = pdf.sort_values(["ky", "k"])
        a[:] = (pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()).reshape(-1, n)
        f = np.fft.fft(a, axis=1).ravel() / n**3
        return pd.DataFrame({"kx": pdf["kx"].to_numpy(), "ky": pdf["ky"].to_numpy(), "kz": pdf["k"].to_numpy(), "re": f.real, "im": f.imag})

    planes = cells.select("i", "j", "k", F.col(name).alias("v")).groupBy("k").applyInPandas(plane, "kx long, ky long, k long, re double, im double")
    return planes.groupBy("kx").applyInPandas(pencil, "kx long, ky long, kz long, re double, im double")


def transform_fields(cells: DataFrame, names: list[str], n: int, ndim: int = 3) -> DataFrame:
    """kx, ky (and kz), and re_ and im_ of each name: the Fourier coefficients of several fields in one pass, divided by the number of cells.

    Cells are i, j, k (i, j in two dimensions). All fields move together: once by plane (by line in two dimensions) and once by kx. A task
    holds one plane of the fields at a time; cells that are not there count as 0.
    """
    last, modes = ("k", "kz") if ndim == 3 else ("j", "ky")
    index = ["i", "j"] if ndim == 3 else ["i"]
    waves = ["kx", "ky"] if ndim == 3 else ["kx"]
    parts = [f"{p}_{c}" for c in names for p in ("re", "im")]

    def flat(pdf: pd.DataFrame) -> pd.DataFrame:
        out = dict(zip(waves, (x.ravel() for x in np.meshgrid(*[np.arange(n)] * len(waves), indexing="ij"))))
        out[last] = np.full(n ** len(waves), int(pdf[last].iloc[0]))
        for c in names:
            a = np.zeros((n,) * len(index))
            a[tuple(pdf[x].to_numpy() for x in index)] = pdf[c].to_numpy()
            f = np.fft.fftn(a).ravel()
            out[f"re_{c}"], out[f"im_{c}"] = f.real, f.imag
        return pd.DataFrame(out)

    def deep(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf["ky"].to_numpy() if ndim == 3 else np.zeros(len(pdf), int)
        shape = (n if ndim == 3 else 1, n)
        out = {"kx": np.full(shape[0] * n, int(pdf["kx"].iloc[0]))}
        if ndim == 3:
            out["ky"] = np.repeat(np.arange(n), n)
        out[modes] = np.tile(np.arange(n), shape[0])
        for c in names:
            a = np.zeros(shape, complex)
            a[rows, pdf[last].to_numpy()] = pdf[f"re_{c}"].to_numpy() + 1j * pdf[f"im_{c}"].to_numpy()
            f = np.fft.fft(a, axis=1).ravel() / n**ndim
            out[f"re_{c}"], out[f"im_{c}"] = f.real, f.imag
        return pd.DataFrame(out)

    values = ", ".join(f"`{c}` double" for c in parts)
    planes = cells.select(*index, last, *names).groupBy(last).applyInPandas(flat, ", ".join(f"{w} long" for w in [*waves, last]) + f", {values}")
    return planes.groupBy("kx").applyInPandas(deep, ", ".join(f"{w} long" for w in [*waves, modes]) + f", {values}")


def powers(modes: DataFrame, names: list[str]) -> DataFrame:
    """The modes with the power of each field instead of its coefficients."""
    keys = [c for c in ("kx", "ky", "kz") if c in modes.columns]
    return modes.select(*keys, *((F.col(f"re_{c}") * F.col(f"re_{c}") + F.col(f"im_{c}") * F.col(f"im_{c}")).alias(c) for c in names))


def split_power(modes: DataFrame, v: tuple[str, ...], n: int) -> DataFrame:
    """The modes with total, longitudinal and transverse power of a vector field of two or three components."""
    keys = [c for c in ("kx", "ky", "kz") if c in modes.columns]
    k = [wave(c, n) for c in keys]
    k2 = sum((w * w for w in k), F.lit(0.0))
    along = [sum((w * F.col(f"{p}_{c}") for w, c in zip(k, v)), F.lit(0.0)) for p in ("re", "im")]
    total = sum((F.col(f"{p}_{c}") * F.col(f"{p}_{c}") for p in ("re", "im") for c in v), F.lit(0.0))
    long = F.when(k2 > 0, (along[0] * along[0] + along[1] * along[1]) / k2).otherwise(0.0)
    return modes.select(*keys, total.alias("total"), long.alias("long")).withColumn("trans", F.col("total") - F.col("long"))


def wave(c: str, n: int):
    return F.when(F.col(c) > n // 2, F.col(c) - n).otherwise(F.col(c))


def shells(modes: DataFrame, n: int, power=None) -> DataFrame:
    """shell, n_modes, mean power, 4 pi k**2 <P>; the mean mode is in shell 1, shells are [b - 1/2, b + 1/2)."""
    k2 = wave("kx", n) * wave("kx", n) + wave("ky", n) * wave("ky", n) + wave("kz", n) * wave("kz", n)
    power = power if power is not None else F.col("re") * F.col("re") + F.col("im") * F.col("im")
    rows = modes.select(F.greatest(F.lit(1), F.floor(F.sqrt(k2) + 0.5)).cast("long").alias("shell"), k2.alias("k2"), power.alias("p"))
    return rows.groupBy("shell").agg(F.count("*").alias("n_modes"), F.sum("p").alias("power"), F.avg("p").alias("mean_power"), (F.avg("p") * F.avg("k2") * 4 * np.pi).alias("spectrum"))


def helmholtz(modes: list[DataFrame], n: int) -> DataFrame:
    """kx, ky, kz, total, longitudinal and transverse power of a vector's three transforms."""
    out = None
    for c, m in zip("xyz", modes):
        m = m.select("kx", "ky", "kz", F.col("re").alias(f"re_{c}"), F.col("im").alias(f"im_{c}"))
        out = m if out is None else out.join(m, ["kx", "ky", "kz"])
    w = {c: wave(f"k{c}", n) for c in "xyz"}
    k2 = w["x"] * w["x"] + w["y"] * w["y"] + w["z"] * w["z"]
    along = [sum((w[c] * F.col(f"{p}_{c}") for c in "xyz"), F.lit(0.0)) for p in ("re", "im")]
    total = sum((F.col(f"{p}_{c}") * F.col(f"{p}_{c}") for p in ("re", "im") for c in "xyz"), F.lit(0.0))
    long = F.when(k2 > 0, (along[0] * along[0] + along[1] * along[1]) / k2).otherwise(0.0)
    return out.select("kx", "ky", "kz", total.alias("total"), long.alias("long"), (total - long).alias("trans"))


def inverse(modes: DataFrame, n: int, name: str) -> DataFrame:
    """i, j, k and the real field of modes as from transform(): pencils in z first, then planes."""
    def pencil(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ky", "kz"])
        f = np.fft.ifft((pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()).reshape(-1, n), axis=1).ravel() * n
        return pd.DataFrame({"kx": pdf["kx"].to_numpy(), "ky": pdf["ky"].to_numpy(), "k": pdf["kz"].to_numpy(), "re": f.real, "im": f.imag})

    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((n, n), complex)
        a[pdf["kx"], pdf["ky"]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        f = np.fft.ifft2(a).real * n * n
        x, y = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        return pd.DataFrame({"i": x.ravel(), "j": y.ravel(), "k": int(pdf["k"].iloc[0]), name: f.ravel()})

    pencils = modes.select("kx", "ky", "kz", "re", "im").groupBy("kx").applyInPandas(pencil, "kx long, ky long, k long, re double, im double")
    return pencils.groupBy("k").applyInPandas(plane, f"i long, j long, k long, {name} double")


def wave_squared(n: int, ndim: int = 3):
    return sum((wave(c, n) * wave(c, n) for c in ("kx", "ky", "kz")[:ndim]), F.lit(0.0))


def top_hat(n: int, low: float = 0.0, high: float = float("inf")):
    """1 for wave numbers strictly between the two (the mean mode passes if low is 0), else 0."""
    k = F.sqrt(wave_squared(n))
    return F.when((k < high) & ((k > low) if low > 0 else F.lit(True)), 1.0).otherwise(0.0)


def log_gaussian(n: int, centre: float, fwhm: float):
    """A Gaussian in the logarithm of the wave number; the mean mode is dropped."""
    sigma = fwhm / 2.355
    x = F.log(F.sqrt(wave_squared(n)) / centre)
    return F.when(wave_squared(n) > 0, F.exp(-x * x / (2 * sigma * sigma))).otherwise(0.0)


def filtered(modes: DataFrame, weight) -> DataFrame:
    return modes.withColumns({c: F.col(c) * weight for c in ("re", "im")})


def vector_potential(modes: list[DataFrame], n: int) -> DataFrame:
    """kx, ky, kz and re_, im_ of the x, y, z parts of A with curl A = B and div A = 0: i k x B / (2 pi k**2)."""
    both = None
    for c, m in zip("xyz", modes):
        m = m.select("kx", "ky", "kz", F.col("re").alias(f"re_{c}"), F.col("im").alias(f"im_{c}"))
        both = m if both is None else both.join(m, ["kx", "ky", "kz"])
    k = [wave(f"k{c}", n) for c in "xyz"]
    out = []
    for a, c in enumerate("xyz"):
        p, q = (a + 1) % 3, (a + 2) % 3
        turn = {r: k[p] * F.col(f"{r}_{'xyz'[q]}") - k[q] * F.col(f"{r}_{'xyz'[p]}") for r in ("re", "im")}
        scale = F.when(wave_squared(n) > 0, 1 / (2 * np.pi * wave_squared(n))).otherwise(0.0)
        out += [(-turn["im"] * scale).alias(f"re_{c}"), (turn["re"] * scale).alias(f"im_{c}")]
    return both.select("kx", "ky", "kz", *out)


def fields(cells: DataFrame, names: list[str], dens: str = "dens") -> DataFrame:
    """cells with scalars of the density for a spectrum, by name: varrho, varlnrho, rho (its square root), lnrho (over the mean), weight (w / mean - 1)."""
    d = F.col(dens)
    means = cells.agg(F.avg(d).alias("mq_mean"), F.avg(F.ln(d)).alias("mq_log"))
    forms = {"varrho": d - F.col("mq_mean"), "varlnrho": F.ln(d) - F.col("mq_log"), "rho": F.sqrt(d), "lnrho": F.ln(d / F.col("mq_mean")), "weight": d / F.col("mq_mean") - 1}
    return cells.crossJoin(F.broadcast(means)).withColumns({c: forms[c] for c in names}).drop("mq_mean", "mq_log")  # one row


def field(cells: DataFrame, name: str, dens: str = "dens") -> DataFrame:
    """cells with f, one of the scalars of fields()."""
    return fields(cells, [name], dens).withColumnRenamed(name, "f")


def power_of(modes: DataFrame, name: str = "power") -> DataFrame:
    return modes.select("kx", "ky", "kz", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias(name))


def table(powers: DataFrame, n: int, names: list[str], weight: DataFrame | None = None, ndim: int = 3) -> DataFrame:
    """The rows of a spectrum: bin, k_stag, k, dk, n_cells, and for each power its mean density, the deviation, and both times 4 pi k_stag**2
    (in two dimensions, where shells are rings, 2 pi k_stag).

    powers: kx, ky, kz and a column for each name; weight: kx, ky, kz, power, by which modes count. The mean mode is in bin 1; the last
    bin, which collects the corners, has no row.
    """
    k2, keys = wave_squared(n, ndim), ["kx", "ky", "kz"][:ndim]
    rows = powers.withColumn("w", F.lit(1.0))
    if weight is not None:
        rows = powers.join(weight.select(*keys, F.col("power").alias("w")), keys)
    rows = rows.select(F.least(F.lit(n // 2 + 1), F.greatest(F.lit(1), F.floor(F.sqrt(k2) + 0.5))).cast("long").alias("bin"), "w", *names)
    aggs = []
    for c in names:
        mean = F.sum(F.col(c) * F.col("w")) / F.sum("w")
        aggs += [mean.alias(f"dens_{c}"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(c) * F.col(c) * F.col("w")) / F.sum("w") - mean * mean)).alias(f"sigma_{c}")]
    out = rows.groupBy("bin").agg(F.count("*").alias("n_cells"), *aggs).where(F.col("bin") <= n // 2)
    at = F.col("bin").cast("double")
    surface = 4 * np.pi * at * at if ndim == 3 else 2 * np.pi * at
    for c in names:
        out = out.withColumns({f"func_{c}": surface * F.col(f"dens_{c}"), f"func_sigma_{c}": surface * F.col(f"sigma_{c}")})
    return out.withColumns({"k_stag": at, "k": at + 0.5, "dk": F.when(F.col("bin") == 1, at + 0.5).otherwise(1.0)})


def compensated(shells_: DataFrame) -> DataFrame:
    """A spectrum times k**2 and times k**(5/3)."""
    k = F.col("shell").cast("double")
    return shells_.withColumns({"k2_spectrum": F.col("spectrum") * k * k, "k53_spectrum": F.col("spectrum") * F.pow(k, F.lit(5 / 3))})


def hann(r, radius: float):
    """A radial window: 1 in the centre, 0 from the radius on."""
    return F.when(r < radius, 0.5 * (1 + F.cos(np.pi * r / radius))).otherwise(0.0)
