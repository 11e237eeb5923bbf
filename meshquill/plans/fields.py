"""Queries of stencils, spectra and pair statistics on a mesh made of lineitem, and of the model functions, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import derived, models
from ..operators import pairs, spectral, stats, stencil
from .queries import CELLS, cells, dft_sql, query, rounded, split_sql, sql_mean, sql_std, view

N = 8
MESH = """SELECT CAST(l_partkey % 8 AS BIGINT) AS i, CAST(l_suppkey % 8 AS BIGINT) AS j, CAST(l_orderkey % 8 AS BIGINT) AS k, avg(l_quantity) AS dens, avg(l_extendedprice) / 1e4 AS pres,
 avg(l_discount) * 1e2 - 5e0 AS velx, avg(l_tax) * 1e2 - 4e0 AS vely, avg(l_linenumber) * 1e0 - 4e0 AS velz, sin(avg(l_quantity)) + 2e0 AS magx, cos(avg(l_quantity)) AS magy, avg(l_discount) * 1e1 AS magz FROM lineitem GROUP BY 1, 2, 3"""
WITH = f"WITH mesh AS ({MESH})"
V, B = ("velx", "vely", "velz"), ("magx", "magy", "magz")


def mesh(spark, sf):
    """An 8**3 periodic mesh of means over all rows."""
    return view(spark, sf, "lineitem", MESH)


# ---------------------------------------------------------------- spectra
def _table_sql(names, source="s", weight="1e0"):
    out = []
    for c in names:
        mean = f"sum({c} * {weight}) / sum({weight})"
        spread = f"sqrt(greatest(0e0, sum({c} * {c} * {weight}) / sum({weight}) - ({mean}) * ({mean})))"
        out += [f"round({mean}, 9) AS dens_{c}", f"round({spread}, 7) AS sigma_{c}", f"round(4 * pi() * bin * bin * ({mean}), 7) AS func_{c}"]
    return f"SELECT bin, bin + 5e-1 AS k, CASE WHEN bin = 1 THEN 1.5e0 ELSE 1e0 END AS dk, count(*) AS n_cells, {', '.join(out)} FROM {source} WHERE bin <= 4 GROUP BY bin"


def _digits(df, names):
    return rounded(df.select("bin", "k", "dk", "n_cells", *(f"{p}_{c}" for c in names for p in ("dens", "sigma", "func"))), **{f"dens_{c}": 9 for c in names}, **{f"{p}_{c}": 7 for c in names for p in ("sigma", "func")})


def _split(m, v):
    return spectral.split_power(spectral.transform_fields(m, list(v), N), v, N)


@query(f"{WITH}, {dft_sql({'u': 'velx', 'v': 'vely', 'w': 'velz'})}, {split_sql()} {_table_sql(['long', 'trans', 'total'])}")
def velocity_spectrum(spark, sf):
    return _digits(spectral.table(_split(mesh(spark, sf), V), N, ["long", "trans", "total"]), ["long", "trans", "total"])


@query(f"{WITH}, {dft_sql({'u': 'magx', 'v': 'magy', 'w': 'magz'})}, {split_sql()} {_table_sql(['long', 'trans', 'total'])}")
def magnetic_spectrum(spark, sf):
    return _digits(spectral.table(_split(mesh(spark, sf), B), N, ["long", "trans", "total"]), ["long", "trans", "total"])


@query(f"{WITH}, {dft_sql({'u': 'sqrt(dens) * velx', 'v': 'sqrt(dens) * vely', 'w': 'sqrt(dens) * velz'})}, {split_sql()}, t AS ({_table_sql(['long', 'trans', 'total'])}) "
       "SELECT bin, round(func_long * bin * bin, 4) AS comp_long, round(func_trans * pow(bin, 5e0 / 3e0), 4) AS comp_trans, round(func_total * bin * bin, 4) AS diss FROM t")
def compensated_spectrum(spark, sf):
    m = mesh(spark, sf).select("i", "j", "k", *(derived.variable(f"sqrtrho_{v}").alias(v) for v in V))
    t = rounded(spectral.table(_split(m, V), N, ["long", "trans", "total"]), func_long=7, func_trans=7, func_total=7)
    k = F.col("k_stag")
    return t.select("bin", F.round(F.col("func_long") * k * k, 4).alias("comp_long"), F.round(F.col("func_trans") * F.pow(k, F.lit(5 / 3)), 4).alias("comp_trans"), F.round(F.col("func_total") * k * k, 4).alias("diss"))


_scalars = {"varrho": "dens - (SELECT avg(dens) FROM mesh)", "varlnrho": "ln(dens) - (SELECT avg(ln(dens)) FROM mesh)", "rho": "sqrt(dens)", "lnrho": "ln(dens / (SELECT avg(dens) FROM mesh))"}
_shell = "CAST(greatest(1, floor(sqrt(" + " + ".join(f"pow(CASE WHEN {c} > 4 THEN {c} - 8 ELSE {c} END, 2)" for c in ("kx", "ky", "kz")) + ") + 5e-1)) AS BIGINT)"


@query(f"{WITH}, m2 AS (SELECT i, j, k, " + ", ".join(f"{e} AS {n}" for n, e in _scalars.items()) + f" FROM mesh), {dft_sql({n: n for n in _scalars}, 'm2')}, s AS (SELECT {_shell} AS bin, "
       + ", ".join(f"re_{n} * re_{n} + im_{n} * im_{n} AS {n}" for n in _scalars) + f" FROM f), t AS ({_table_sql(list(_scalars))}) SELECT bin, n_cells, " + ", ".join(f"func_{n}" for n in _scalars) + " FROM t")
def density_spectra(spark, sf):
    modes = spectral.transform_fields(spectral.fields(mesh(spark, sf), list(_scalars)), list(_scalars), N)
    out = spectral.powers(modes, list(_scalars))
    return _digits(spectral.table(out, N, list(_scalars)), list(_scalars)).select("bin", "n_cells", *(f"func_{n}" for n in _scalars))


@query(f"{WITH}, m2 AS (SELECT i, j, k, velx, dens / (SELECT avg(dens) FROM mesh) - 1 AS w FROM mesh), {dft_sql({'velx': 'velx', 'w': 'w'}, 'm2')}, s AS (SELECT {_shell} AS bin, re_velx * re_velx + im_velx * im_velx AS velx, re_w * re_w + im_w * im_w AS w FROM f), "
       f"t AS ({_table_sql(['velx'], weight='w')}) SELECT bin, n_cells, func_velx FROM t WHERE bin > 1")
def weighted_spectrum(spark, sf):
    m = mesh(spark, sf)
    weight = spectral.power_of(spectral.transform(spectral.field(m, "weight"), "f", N))
    t = spectral.table(spectral.power_of(spectral.transform(m, "velx", N), "velx"), N, ["velx"], weight)
    return _digits(t, ["velx"]).select("bin", "n_cells", "func_velx").where("bin > 1")


@query(f"{WITH}, m2 AS (SELECT i, j, k, ln(dens) AS f FROM mesh), {dft_sql({'f': 'f'}, 'm2')}, g AS (SELECT kx, ky, kz, re_f * w AS re, im_f * w AS im FROM (SELECT *, CASE WHEN kx + ky + kz > 0 THEN exp(-pow(ln(sqrt(" + " + ".join(f"pow(CASE WHEN {c} > 4 THEN {c} - 8 ELSE {c} END, 2)" for c in ("kx", "ky", "kz")) + f") / 2e0), 2) / (2 * pow(1e0 / 2.355e0, 2))) ELSE 0e0 END AS w FROM f)) "
       f"SELECT a.i, a.j, a.k, round(sum(re * cos({2 * math.pi / N!r} * (a.i * kx + a.j * ky + a.k * kz)) - im * sin({2 * math.pi / N!r} * (a.i * kx + a.j * ky + a.k * kz))), 8) + 0e0 AS value FROM mesh a, g GROUP BY 1, 2, 3")
def log_density_filter(spark, sf):
    modes = spectral.transform(mesh(spark, sf).select("i", "j", "k", F.ln("dens").alias("f")), "f", N)
    return spectral.inverse(spectral.filtered(modes, spectral.log_gaussian(N, 2.0, 1.0)), N, "value").select("i", "j", "k", (F.round("value", 8) + F.lit(0.0)).alias("value"))


FLAT = """SELECT CAST(l_partkey % 16 AS BIGINT) AS i, CAST(l_suppkey % 16 AS BIGINT) AS j, avg(l_discount) * 1e2 - 5e0 AS velx, avg(l_tax) * 1e2 - 4e0 AS vely, avg(l_quantity) AS dens FROM lineitem GROUP BY 1, 2"""
_flat_modes = f"""WITH mesh AS ({FLAT}), r AS (SELECT * FROM range(16) a(kx), range(16) b(ky)), f AS (SELECT kx, ky, CASE WHEN kx > 8 THEN kx - 16 ELSE kx END AS wx, CASE WHEN ky > 8 THEN ky - 16 ELSE ky END AS wy, """ + ", ".join(
    f"sum({c} * {t}({2 * math.pi / 16!r} * (i * kx + j * ky))) / 256 AS {t}_{c}" for c in ("velx", "vely", "dens") for t in ("cos", "sin")) + """ FROM mesh, r GROUP BY 1, 2, 3, 4),
p AS (SELECT wx * wx + wy * wy AS k2, cos_velx * cos_velx + sin_velx * sin_velx + cos_vely * cos_vely + sin_vely * sin_vely AS total, cos_dens * cos_dens + sin_dens * sin_dens AS dens, pow(wx * cos_velx + wy * cos_vely, 2) + pow(wx * sin_velx + wy * sin_vely, 2) AS along FROM f),
s AS (SELECT CAST(greatest(1, floor(sqrt(k2) + 5e-1)) AS BIGINT) AS bin, total, CASE WHEN k2 > 0 THEN along / k2 ELSE 0e0 END AS long, dens FROM p)"""


@query(_flat_modes + """ SELECT bin, count(*) AS n_cells, round(2 * pi() * bin * avg(long), 8) AS func_long, round(2 * pi() * bin * avg(total - long), 8) AS func_trans, round(2 * pi() * bin * avg(total), 8) AS func_total, round(2 * pi() * bin * avg(dens), 5) AS func_dens
 FROM s WHERE bin <= 8 GROUP BY 1""")
def flat_spectra(spark, sf):
    """Rings of a two-dimensional mesh, of a vector and a scalar in one transform."""
    modes = spectral.transform_fields(view(spark, sf, "lineitem", FLAT), ["velx", "vely", "dens"], 16, ndim=2)
    both = spectral.split_power(modes, ("velx", "vely"), 16).join(spectral.powers(modes, ["dens"]), ["kx", "ky"])
    t = spectral.table(both, 16, ["long", "trans", "total", "dens"], ndim=2)
    return rounded(t.select("bin", "n_cells", *(f"func_{c}" for c in ("long", "trans", "total", "dens"))), func_long=8, func_trans=8, func_total=8, func_dens=5)


# ---------------------------------------------------------------- stencils
def _neighbours(table, names):
    joins, columns = [], []
    for a, c in zip("xyz", "ijk"):
        for side, step in (("p", 1), ("m", 7)):
            t = f"{a}{side}"
            joins.append(f"JOIN {table} {t} ON " + " AND ".join(f"{t}.{x} = " + (f"(m.{x} + {step}) % 8" if x == c else f"m.{x}") for x in "ijk"))
        columns += [f"({a}p.{n} - {a}m.{n}) * 4e0 AS d_{n}_{a}" for n in names]
    return f"SELECT m.*, {', '.join(columns)} FROM {table} m {' '.join(joins)}"


_all = ["dens", "pres", *V, *B]
_d = lambda n, a: f"d_{n}_{a}"
_curl = lambda v: [f"({_d(v[2], 'y')} - {_d(v[1], 'z')})", f"({_d(v[0], 'z')} - {_d(v[2], 'x')})", f"({_d(v[1], 'x')} - {_d(v[0], 'y')})"]
_div = lambda v: f"({_d(v[0], 'x')} + {_d(v[1], 'y')} + {_d(v[2], 'z')})"
_j = _curl(B)
_grid = f"{WITH}, g AS ({_neighbours('mesh', _all)})"


@query(f"{_grid} SELECT i, j, k, round(magx * {_j[0]} + magy * {_j[1]} + magz * {_j[2]}, 5) AS dot, round(magy * {_j[2]} - magz * {_j[1]}, 5) AS crossx, round(magz * {_j[0]} - magx * {_j[2]}, 5) AS crossy, round(magx * {_j[1]} - magy * {_j[0]}, 5) AS crossz, "
       f"round(magx * d_magx_x + magy * d_magx_y + magz * d_magx_z, 5) AS tenx, round(-d_pres_x, 5) AS accx, round({_div(B)}, 5) AS divb FROM g")
def current_terms(spark, sf):
    d = stencil.derivatives(mesh(spark, sf), _all, N, 1 / N)
    x = stencil.cross_current(B)
    out = {"dot": stencil.dot_current(B), "crossx": x[0], "crossy": x[1], "crossz": x[2], "tenx": stencil.tension(B)[0], "accx": stencil.gradient("pres", -1.0)[0], "divb": stencil.divergence(B)}
    return d.select("i", "j", "k", *(F.round(c, 5).alias(n) for n, c in out.items()))


@query(f"{WITH}, e AS (SELECT i, j, k, vely * magz - velz * magy AS ex, velz * magx - velx * magz AS ey, velx * magy - vely * magx AS ez FROM mesh), g AS ({_neighbours('e', ['ex', 'ey', 'ez'])}) "
       "SELECT i, j, k, round(d_ez_y - d_ey_z, 5) AS indx, round(d_ex_z - d_ez_x, 5) AS indy, round(d_ey_x - d_ex_y, 5) AS indz FROM g")
def induction(spark, sf):
    e = stencil.electromotive(V, B)
    d = stencil.derivatives(mesh(spark, sf).select("i", "j", "k", *(c.alias(n) for n, c in zip(("ex", "ey", "ez"), e))), ["ex", "ey", "ez"], N, 1 / N)
    return d.select("i", "j", "k", *(F.round(c, 5).alias(n) for n, c in zip(("indx", "indy", "indz"), stencil.curl(("ex", "ey", "ez")))))


_s = lambda a, b: f"pow(5e-1 * ({_d(V['xyz'.index(a)], b)} + {_d(V['xyz'.index(b)], a)})" + (f" - {_div(V)} / 3e0" if a == b else "") + ", 2)"
_strain = "(" + " + ".join(_s(a, b) for a in "xyz" for b in "xyz") + ")"


@query(f"{_grid} SELECT i, j, k, round(2 * dens * 3e-1 * {_strain}, 3) AS given, round(2 * dens * sqrt(velx * velx + vely * vely + velz * velz) / 8e0 * {_strain}, 3) AS estimated FROM g")
def dissipation_rates(spark, sf):
    d = stencil.derivatives(mesh(spark, sf), _all, N, 1 / N)
    return d.select("i", "j", "k", F.round(stencil.dissipation_rate(V, "dens", 1 / N, 0.3), 3).alias("given"), F.round(stencil.dissipation_rate(V, "dens", 1 / N), 3).alias("estimated"))


_w = ("wx", "wy", "wz")


@query(f"{_grid}, h AS (SELECT *, " + ", ".join(f"{c} AS {n}" for n, c in zip(_w, _curl(V))) + " FROM g), e AS (SELECT *, " + ", ".join(f"{v} * 5e-1 * (wx * wx + wy * wy + wz * wz) AS f{a}" for v, a in zip(V, "xyz")) + f" FROM h), e2 AS (SELECT i, j, k, fx, fy, fz FROM e), a AS ({_neighbours('e2', ['fx', 'fy', 'fz'])}) "
       f"SELECT i, j, k, round(-(a.d_fx_x + a.d_fy_y + a.d_fz_z), 3) AS advection, round(" + " + ".join(f"{_w[p]} * {_w[q]} * {_d(V[p], 'xyz'[q])}" for p in range(3) for q in range(3)) + f", 3) AS stretching, round(-5e-1 * (wx * wx + wy * wy + wz * wz) * {_div(V)}, 3) AS compression, "
       "round((wx * (d_dens_y * d_pres_z - d_dens_z * d_pres_y) + wy * (d_dens_z * d_pres_x - d_dens_x * d_pres_z) + wz * (d_dens_x * d_pres_y - d_dens_y * d_pres_x)) / (dens * dens), 5) AS baroclinic FROM h JOIN a USING (i, j, k)")
def enstrophy_budget(spark, sf):
    d = stencil.derivatives(mesh(spark, sf), _all, N, 1 / N)
    d = d.withColumns(dict(zip(_w, stencil.curl(V))))
    flux = ("fx", "fy", "fz")
    half = 0.5 * (F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy") + F.col("wz") * F.col("wz"))
    moved = stencil.derivatives(d.select("i", "j", "k", *((F.col(v) * half).alias(f) for v, f in zip(V, flux))), list(flux), N, 1 / N)
    terms = stencil.enstrophy_terms(V, _w, flux, "dens", "pres")
    out = d.join(moved.drop(*flux), ["i", "j", "k"])
    digits = {"advection": 3, "stretching": 3, "compression": 3, "baroclinic": 5}
    return out.select("i", "j", "k", *(F.round(terms[n], digits[n]).alias(n) for n in digits))


# ---------------------------------------------------------------- pairs
LAGS = pairs.lags_within(N, 2.5)
_pairs = f"""{WITH}, l AS (SELECT *, sqrt(a * a + b * b + c * c) AS r FROM (VALUES {', '.join(map(str, LAGS))}) t(a, b, c)),
p AS (SELECT CAST(floor(r + 1e-9) AS BIGINT) AS bin, a / r AS ra, b / r AS rb, c / r AS rc, m.dens AS d1, n.dens AS d2, m.velx AS u1, m.vely AS v1, m.velz AS w1, n.velx AS u2, n.vely AS v2, n.velz AS w2, m.magx AS x1, n.magx AS x2, m.i AS i1, m.j AS j1, m.k AS k1, n.i AS i2, n.j AS j2, n.k AS k2
 FROM mesh m, l JOIN mesh n ON n.i = (m.i + a + 8) % 8 AND n.j = (m.j + b + 8) % 8 AND n.k = (m.k + c + 8) % 8)"""


def _vector_sql(x, y, z):
    along = f"(CASE WHEN ({y}) = 0 AND ({z}) = 0 THEN ({x}) ELSE ({x}) * ra + ({y}) * rb + ({z}) * rc END)"
    return along, f"sqrt(greatest(0e0, ({x}) * ({x}) + ({y}) * ({y}) + ({z}) * ({z}) - {along} * {along}))"


_sf_types = {"vels": _vector_sql("u2 - u1", "v2 - v1", "w2 - w1"), "rhov": _vector_sql("d2 * u2 - d1 * u1", "d2 * v2 - d1 * v1", "d2 * w2 - d1 * w1"), "rho": ("d2 - d1", "0e0"), "rhotohalf": ("sqrt(d2) - sqrt(d1)", "0e0"), "lnrho": ("ln(d2) - ln(d1)", "0e0")}
_orders = lambda k, n: ", ".join(f"round(avg(pow(lo, {p})), 7) + 0e0 AS {k}{p}_long, round(avg(pow(tr, {p})), {6 if p == 1 else 7}) + 0e0 AS {k}{p}_trans" for p in range(1, n + 1))
_union = lambda types: " UNION ALL ".join(f"SELECT '{n}' AS type, bin, {lo} AS lo, {tr} AS tr FROM p" for n, (lo, tr) in types.items())


def _tidy(df, kind, orders):
    return df.select("type", "bin", "n", *((F.round(f"{kind}{p}_{c}", 6 if (p, c) == (1, "trans") else 7) + F.lit(0.0)).alias(f"{kind}{p}_{c}") for p in range(1, orders + 1) for c in ("long", "trans")))


@query(f"{_pairs}, q AS ({_union(_sf_types)}) SELECT type, bin, count(*) AS n, {_orders('sf', 3)} FROM q GROUP BY 1, 2")
def signed_structure_functions(spark, sf):
    fields = {"vels": tuple(F.col(v) for v in V), "rhov": tuple(F.col("dens") * F.col(v) for v in V), "rho": (F.col("dens"),), "rhotohalf": (F.sqrt("dens"),), "lnrho": (F.ln("dens"),)}
    return _tidy(pairs.pair_statistics(mesh(spark, sf), fields, N, LAGS, orders=3), "sf", 3)


_cf = "(u1 * ra + v1 * rb + w1 * rc) * (u2 * ra + v2 * rb + w2 * rc)"


@query(f"{_pairs}, q AS ({_union({'vels': (_cf, f'u1 * u2 + v1 * v2 + w1 * w2 - {_cf}'), 'rho': ('d1 * d2', '0e0')})}) SELECT type, bin, count(*) AS n, round(avg(lo), 6) + 0e0 AS cf1_long, round(avg(tr), 6) + 0e0 AS cf1_trans FROM q GROUP BY 1, 2")
def correlation_functions(spark, sf):
    out = pairs.pair_statistics(mesh(spark, sf), {"vels": tuple(F.col(v) for v in V), "rho": (F.col("dens"),)}, N, LAGS, kind="cf")
    return out.select("type", "bin", "n", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("cf1_long", "cf1_trans")))


_br = "(5e-1 * ((d2 * u2 - d1 * u1) * (u2 - u1) + (d2 * v2 - d1 * v1) * (v2 - v1) + (d2 * w2 - d1 * w1) * (w2 - w1)) + (d2 - d1) * (ln(d2) - ln(d1)) - 5e-1 * (d1 + d2))"
_fl = lambda c: f"{_br} * ({c}2 - {c}1) + 5e-1 * (ln(d1) + ln(d2)) * (d2 * {c}2 - d1 * {c}1)"
_en = lambda a, b: f"(d{a} * (5e-1 * (u{a} * u{a} + v{a} * v{a} + w{a} * w{a}) + ln(d{a})))"
_rr = lambda a, b: f"(d{a} * (5e-1 * (u1 * u2 + v1 * v2 + w1 * w2) + ln(d{b})))"
_div_join = f", g AS ({_neighbours('mesh', list(V))}), z AS (SELECT i, j, k, {_div(V)} AS divv FROM g), p2 AS (SELECT p.*, y.divv AS s1, t.divv AS s2 FROM p JOIN z y ON y.i = i1 AND y.j = j1 AND y.k = k1 JOIN z t ON t.i = i2 AND t.j = j2 AND t.k = k2)"
_sq = lambda c: f"(x2 - x1) * (x2 - x1) * ({c}2 - {c}1)"


@query(f"{_pairs}{_div_join}, q AS ({_union({'flux': (_vector_sql(_fl('u'), _fl('v'), _fl('w'))[0], '0e0'), 'velsq': (_vector_sql(_sq('u'), _sq('v'), _sq('w'))[0], '0e0')})} UNION ALL SELECT 'source', bin, s2 * ({_rr(1, 2)} - {_en(1, 2)}) + s1 * ({_rr(2, 1)} - {_en(2, 1)}), 0e0 FROM p2) "
       "SELECT type, bin, count(*) AS n, round(avg(lo), 4) + 0e0 AS sf1_long FROM q GROUP BY 1, 2")
def energy_transfer(spark, sf):
    m = mesh(spark, sf)
    div = stencil.derivatives(m, list(V), N, 1 / N).select("i", "j", "k", stencil.divergence(V).alias("divv"))
    special = {"flux": pairs.energy_flux(V), "source": pairs.energy_source(V), "velsq": pairs.squared_times(V, ("magx",))}
    out = pairs.pair_statistics(m.join(div, ["i", "j", "k"]), {}, N, LAGS, orders=1, special=special)
    return out.select("type", "bin", "n", (F.round("sf1_long", 4) + F.lit(0.0)).alias("sf1_long"))


# ---------------------------------------------------------------- models
def _bessel_sql(lam, theta):
    """The jump PDF at x by the series of I1."""
    u = f"({lam!r} / {1 + theta!r} - x / {theta!r})"
    terms = f"(SELECT sum(exp((2 * m + 1) * ln(sqrt({lam!r} * {u})) - lgamma(m + 1) - lgamma(m + 2) - {lam!r} - {u})) FROM (SELECT unnest(range(400))::DOUBLE AS m))"
    return f"CASE WHEN {u} > 0 THEN {terms} * sqrt({lam!r} / ({theta * theta!r} * {u})) ELSE 0e0 END"


_norm = math.exp(-0.25 / 2) * math.sqrt(2 * math.pi) / math.erfc(0.5 / math.sqrt(2))


@query(f"""WITH p AS (SELECT DISTINCT p_size / 1e1 - 3e0 AS x FROM part) SELECT x, round({_bessel_sql(1.0 / (2 * 0.3**2), 0.3)}, 8) AS hopkins, round({_bessel_sql(1.5 * (1 + 1 / 0.4) * math.log(3.0), 0.4)}, 8) AS squire,
 round({_norm!r} / (pi() * 5e-1 * (1 + pow(x - 2e-1, 2) / 2.5e-1)) * exp(-pow(x - 2e-1, 2) / 2) / sqrt(2 * pi()), 8) AS cauchy, round(exp(1e-1 - 2e-1 * x - 3e-1 * x * x + 1e-2 * x * x * x - 2e-2 * x * x * x * x), 8) AS quartic FROM p""")
def model_pdfs(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size") / 10.0 - 3.0).alias("x")).distinct()
    x = F.col("x")
    out = {"hopkins": models.hopkins_pdf(1.0, 0.3)(x), "squire": models.squire_pdf(0.4, 1.5, 3.0)(x), "cauchy": models.cauchy_pdf(x, 0.2, 1.0, 0.5), "quartic": F.exp(models.quartic_log_pdf(x, (0.1, -0.2, -0.3, 0.01, -0.02)))}
    return p.select("x", *(F.round(c, 8).alias(n) for n, c in out.items()))


_G = repr(derived.G)


@query(f"""WITH p AS (SELECT p_partkey, p_retailprice * 1e-24 AS rho, p_size * 1e17 AS l, p_size * 1e3 AS s, CASE WHEN p_partkey % 3 = 0 THEN 0e0 ELSE p_size * 1e-6 END AS b FROM part), q AS (SELECT *, pi() / 6 * pow(l, 3) AS v, l / 2 AS r FROM p), m AS (SELECT *, rho * v AS m FROM q)
SELECT p_partkey, round(m / 1e30, 6) AS mass, round(5 * s * s * l / (6 * {_G} * m), 6) AS virial, round(sqrt(3 * pi() / (32 * {_G} * rho)) / 1e12, 6) AS t_ff, round(s / 2e4, 6) AS mach, round(6e-1 * {_G} * m * m / r / 1e40, 4) AS e_grav, round(5e-1 * m * s * s / 1e40, 4) AS e_turb,
 round(2e-1 * m * 1e-28 * r * r / 1e38, 4) AS e_rot, round(b * b * v / (8 * pi()) / 1e38, 4) AS e_mag, round(b / sqrt(4 * pi() * rho) / 1e4, 6) AS v_alf, CASE WHEN b > 0 THEN round(s / (b / sqrt(4 * pi() * rho)), 6) END AS mach_alf,
 CASE WHEN b > 0 THEN round(2 * 4e8 * 4 * pi() * rho / (b * b), 6) END AS beta, CASE WHEN b > 0 THEN round(m / (b * pi() * r * r) / (53e-2 / (3 * pi()) * sqrt(5 / {_G})), 6) END AS mass_to_flux FROM m""")
def cloud_conditions(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    size = F.col("p_size")
    out = models.cloud_conditions(F.col("p_retailprice") * 1e-24, size * 1e17, size * 1e3, F.lit(1e-14), F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(size * 1e-6))
    scale = {"mass": (1e30, 6), "t_ff": (1e12, 6), "e_grav": (1e40, 4), "e_turb": (1e40, 4), "e_rot": (1e38, 4), "e_mag": (1e38, 4), "v_alf": (1e4, 6)}
    finite = lambda c: F.when(c < float("inf"), c)
    return p.select("p_partkey", *(F.round(finite(c) / scale.get(n, (1.0, 6))[0], scale.get(n, (1.0, 6))[1]).alias(n) for n, c in out.items()))


@query("""WITH p AS (SELECT DISTINCT p_size / 5e1 AS x FROM part) SELECT x, round(CASE WHEN x < 5e-1 THEN 2 * x * x ELSE 1 - pow(-2 * x + 2, 2) / 2 END, 9) AS in_out_quad, round(x * x, 9) AS in_quad, round(1 - pow(1 - x, 2), 9) AS out_quad,
 round(CASE WHEN x < 5e-1 THEN pow(2 * x, 2) * ((1.70158e0 * 1.525e0 + 1) * 2 * x - 1.70158e0 * 1.525e0) / 2 ELSE (pow(2 * x - 2, 2) * ((1.70158e0 * 1.525e0 + 1) * (x * 2 - 2) + 1.70158e0 * 1.525e0) + 2) / 2 END, 9) AS in_out_back FROM p""")
def easing_curves(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size") / 50.0).alias("x")).distinct()
    return p.select("x", *(F.round(models.ease(F.col("x"), n), 9).alias(n) for n in ("in_out_quad", "in_quad", "out_quad", "in_out_back")))


@query("""WITH a AS (SELECT count(DISTINCT o_custkey) AS n, max(o_totalprice) AS top FROM orders), f AS (SELECT n, top, unnest(range(0, n, 2)) AS frame FROM a)
SELECT frame, round(1e0 + (top - 1e0) * pow(frame / (n - 1e0), 2), 6) AS low, round(top - top * pow(frame / (n - 1e0), 2), 6) AS high FROM f""")
def eased_frames(spark, sf):
    """A frame for every other customer, from 1 to the highest price and back from it to 0."""
    told = spark.read.parquet(f"{sf}/orders.parquet").agg(F.countDistinct("o_custkey").alias("n"), F.max("o_totalprice").alias("top")).first()
    return rounded(models.eased_frames(spark, told["n"], "in_quad", {"low": 1.0, "high": told["top"]}, {"low": told["top"], "high": 0.0}, every=2), low=6, high=6)


@query("""WITH p AS (SELECT DISTINCT p_size / 5e1 AS r FROM part) SELECT r, round(sin(r * pi()) * cos(r / 1.2e0 * pi() / 2), 9) AS mass, round(25e-2 * CASE WHEN r <= 1.2e0 THEN cos(r / 1.2e0 * pi() / 2) ELSE 0e0 END + 75e-2 * CASE WHEN r <= 2e-1 THEN cos(r / 2e-1 * pi() / 2) ELSE 0e0 END, 9) AS speed,
 round(CASE WHEN r < 5e-1 THEN r / 5e-1 ELSE 1e0 END, 9) AS ramp FROM p""")
def outflow_shapes(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size") / 50.0).alias("r")).distinct()
    r = F.col("r")
    return p.select("r", F.round(models.outflow_mass_shape(r, r, 1.0, 1.2), 9).alias("mass"), F.round(models.outflow_velocity_shape(r, 1.2), 9).alias("speed"), F.round(models.ramp(r, 0.5), 9).alias("ramp"))


@query("""WITH p AS (SELECT DISTINCT p_size * 1e1 AS m FROM part) SELECT m, round(2.98e0 * pow(log10(m), 6) / (29 + pow(log10(m), 6)) + log10(m * 3.828e33), 8) AS log_light, round(46.7e0 * pow(log10(m), 6) / (7.28e0 + pow(log10(m), 6)) + log10(m), 8) AS log_photons FROM p""")
def cluster_light(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size") * 10.0).alias("m")).distinct()
    light, photons = models.cluster_luminosity(F.col("m") * 1.989e33)
    return p.select("m", F.round(F.log10(light), 8).alias("log_light"), F.round(F.log10(photons), 8).alias("log_photons"))


@query("""WITH p AS (SELECT p_partkey, 8e0 * pow(2e0, p_size % 5) AS n FROM part) SELECT p_partkey, n AS n_eff, round(1e2 / n, 9) AS dx, round(25e-1 * 1e2 / n, 9) AS r_sink, round(16 * 1e2 / n, 9) AS r_outflow FROM p""")
def sink_scales(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") % 5 + 1).cast("double").alias("level"))
    out = models.sink_scales(F.lit(100.0), F.col("level"), F.lit(8.0), F.lit(1.0))
    return p.select("p_partkey", *((F.round(out[n], 9) if n != "n_eff" else out[n]).alias(n) for n in ("n_eff", "dx", "r_sink", "r_outflow")))


# ---------------------------------------------------------------- bins
_edges = [repr(e) for e in stats.edges_of("symlog", -2.0, 40.0, 7)]
_case = "CASE " + " ".join(f"WHEN x >= {a} AND x {'<=' if k == 5 else '<'} {b} THEN {k}" for k, (a, b) in enumerate(zip(_edges, _edges[1:]))) + " END"


@query(f"WITH c AS ({CELLS}), b AS (SELECT CAST({_case} AS BIGINT) AS bin, pres, dvol FROM (SELECT *, dens - 3e0 AS x FROM c)) SELECT bin, count(*) AS n, round({sql_mean('pres', 'dvol')}, 4) AS mean, round({sql_std('pres', 'dvol')}, 4) AS std FROM b WHERE bin IS NOT NULL GROUP BY bin")
def symlog_binned_statistic(spark, sf):
    out = stats.binned_statistic(cells(spark, sf), F.col("dens") - 3.0, F.col("pres"), F.col("dvol"), stats.edges_of("symlog", -2.0, 40.0, 7))
    return rounded(out.drop("total"), mean=4, std=4)


@query(f"""WITH c AS ({CELLS}), r AS (SELECT *, log10(sqrt((i - 8e0) * (i - 8e0) + (j - 8e0) * (j - 8e0) + (k - 4e0) * (k - 4e0))) AS r FROM c WHERE i <> 8 OR j <> 8 OR k <> 4)
SELECT CAST(trunc(r / 25e-2) AS BIGINT) + 1 AS bin, count(*) AS n, round({sql_mean('pres', 'dens')}, 4) AS mean, round({sql_std('pres', 'dens')}, 4) AS std, round(pow(1e1, (CAST(trunc(r / 25e-2) AS BIGINT) + 5e-1) * 25e-2), 6) AS radius FROM r WHERE r > -25e-2 AND r < 125e-2 GROUP BY 1, 5""")
def log_radial_profile(spark, sf):
    r = derived.radius((8.0, 8.0, 4.0), names=("i", "j", "k"))
    return rounded(stats.radial_profile(cells(spark, sf), F.col("pres"), F.col("dens"), r, 0.0, 1.25, 0.25, log=True), mean=4, std=4, radius=6)


@query(f"WITH c AS ({CELLS}), g AS (SELECT i, j, CASE WHEN avg(dens) > 25e0 THEN avg(pres) END AS v FROM c GROUP BY 1, 2) SELECT count(v) AS n, round(min(v), 4) AS min, round(max(v), 4) AS max, round(sum(v), 2) AS sum, round(sum(v * 25e-2), 2) AS sum_vw FROM g")
def grid_reductions(spark, sf):
    g = cells(spark, sf).groupBy("i", "j").agg(F.when(F.avg("dens") > 25, F.avg("pres")).alias("v")).withColumn("vol", F.lit(0.25))
    return rounded(stats.regular_reductions(g, "v", "vol"), min=4, max=4, sum=2, sum_vw=2)


# ---------------------------------------------------------------- more variables
_more = f"SELECT *, velx + 2e0 AS oadv, 1e17 + dvol AS dx, 2e17 AS dy, 1e17 AS dz, dens * 1e-20 AS rho, sin(dens) + 2e0 AS magx, cos(dens) + 2e0 AS magy, dens / 1e1 AS magz, vely AS vecpotx, velz AS vecpoty, velx AS vecpotz, dens * 1e1 AS temp FROM ({CELLS})"


@query(f"WITH c AS ({_more}) SELECT block, round(avg(oadv * dens), 6) AS outflow_dens, round(avg(dens * vely), 8) AS momy, round(avg(dens * velz), 8) AS momz, round(avg(vecpotx * magx + vecpoty * magy + vecpotz * magz), 8) AS magnetic_helicity, round(avg(vecpotx * velx + vecpoty * vely + vecpotz * velz), 9) AS adotv, "
       f"round(avg(velz - (velx * magx + vely * magy + velz * magz) / (magx * magx + magy * magy + magz * magz) * magz), 9) AS vz_perp_b, round(avg(vely / sqrt(temp * {derived.K_B!r} / 2e0 / {derived.M_P!r})) * 1e6, 6) AS mach_vely, "
       f"round(avg(sqrt(pi() / {derived.G!r}) / 2e17 * sqrt({5 / 3!r} * pres / rho / rho)) * 1e6, 6) AS jnum FROM c GROUP BY block")
def more_variables(spark, sf):
    c = view(spark, sf, "lineitem", _more)
    names = {"outflow_dens": 6, "momy": 8, "momz": 8, "magnetic_helicity": 8, "adotv": 9, "vz_perp_b": 9}
    jnum = derived.variable("jnum")
    out = c.groupBy("block").agg(*(F.round(F.avg(derived.variable(n)), d).alias(n) for n, d in names.items()), F.round(F.avg(derived.variable("mach_vely", mu=2.0)) * 1e6, 6).alias("mach_vely"))
    numbers = c.withColumn("dens", F.col("rho")).groupBy("block").agg(F.round(F.avg(jnum) * 1e6, 6).alias("jnum"))
    return out.join(numbers, "block")


_wrap = lambda c, o, n: f"pow(CASE WHEN {c} - {o} > {n} / 2e0 THEN {c} - {o} - {n} WHEN {c} - {o} < -{n} / 2e0 THEN {c} - {o} + {n} ELSE {c} - {o} END, 2)"


@query(f"WITH c AS ({CELLS}) SELECT block, round(avg(sqrt({_wrap('i', '2e0', '16e0')} + {_wrap('j', '14e0', '16e0')} + {_wrap('k', '1e0', '8e0')})), 9) AS r FROM c GROUP BY block")
def periodic_radius(spark, sf):
    r = derived.radius((2.0, 14.0, 1.0), (16.0, 16.0, 8.0), names=("i", "j", "k"))
    return cells(spark, sf).groupBy("block").agg(F.round(F.avg(r), 9).alias("r"))


_bv = lambda p: f"sqrt((x{p} * x{p} + y{p} * y{p} + z{p} * z{p}) / (4 * pi() * d{p}))"
_named = {"mags": [f"{c}2 - {c}1" for c in "xyz"], "valf": [f"{c}2 / sqrt(4 * pi() * d2) - {c}1 / sqrt(4 * pi() * d1)" for c in "xyz"], "amach": [f"{c}2 / {_bv(2)} - {c}1 / {_bv(1)}" for c in "uvw"],
          "msmach": [f"{c}2 / sqrt(1 + 5e-1 * pow({_bv(2)}, 2)) - {c}1 / sqrt(1 + 5e-1 * pow({_bv(1)}, 2))" for c in "uvw"], "sqrtrho": [f"sqrt(d2) * {c}2 - sqrt(d1) * {c}1" for c in "uvw"], "rho3": [f"cbrt(d2) * {c}2 - cbrt(d1) * {c}1" for c in "uvw"]}
_pairs_b = _pairs.replace("m.magx AS x1, n.magx AS x2,", "m.magx AS x1, n.magx AS x2, m.magy AS y1, n.magy AS y2, m.magz AS z1, n.magz AS z2,")


@query(f"{_pairs_b}, q AS ({_union({n: _vector_sql(*e) for n, e in _named.items()})}) SELECT type, bin, count(*) AS n, {_orders('sf', 2)} FROM q GROUP BY 1, 2")
def field_structure_functions(spark, sf):
    names = {"mags": B, "valf": tuple(f"valf_{b}" for b in B)} | {t: tuple(f"{t}_{v}" for v in V) for t in ("amach", "msmach", "sqrtrho", "rho3")}
    have = ["dens", *V, *B]
    fields = {t: tuple(derived.variable(n, have=have) for n in v) for t, v in names.items()}
    return _tidy(pairs.pair_statistics(mesh(spark, sf), fields, N, LAGS, orders=2), "sf", 2)


@query("""WITH p AS (SELECT p_partkey, p_size * 1e0 AS v, p_retailprice AS x, p_partkey % 5 * 1e0 AS z FROM part)
SELECT p_partkey, round(x * pow(1 + z, -2) + 5e-1 * (v * v + 4 * v * v + 9 * v * v), 6) AS ener, round(70 * sqrt(3e-1 * pow(1 + z, 3) + 7e-1) / (1 + z) * x + v / (1 + z), 6) AS velocity, round(x * (1 + z), 6) AS pres, round(x * pow(1 + z, -2), 8) AS temp FROM p""")
def proper_quantities(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("v"), F.col("p_retailprice").alias("x"), (F.col("p_partkey") % 5).cast("double").alias("z"))
    v, x, z = F.col("v"), F.col("x"), F.col("z")
    out = {"ener": (models.proper_energy(x, (v, 2 * v, 3 * v), z), 6), "velocity": (models.proper_velocity(x, v, z, 70.0, 0.3), 6), "pres": (models.proper("pres", x, z), 6), "temp": (models.proper("temp", x, z), 8)}
    return p.select("p_partkey", *(F.round(c, d).alias(n) for n, (c, d) in out.items()))
