"""Pruning, selection, rotation, regridding and maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sinks import cut_lineage

AXES = ("x", "y", "z")


def blocks_in_box(blocks: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Blocks that overlap an open box."""
    out = blocks
    for a, lo, hi in zip(AXES, low, high):
        out = out.where((F.col(f"hi_{a}") > lo) & (F.col(f"lo_{a}") < hi))
    return out


def blocks_in_sphere(blocks: DataFrame, centre: list[float], radius: float) -> DataFrame:
    """Blocks whose closest point is within the radius."""
    total = F.lit(0.0)
    for a, c in zip(AXES, centre):
        d = F.greatest(F.col(f"lo_{a}") - c, F.lit(0.0), c - F.col(f"hi_{a}"))
        total = total + d * d
    return blocks.where(total <= radius * radius)


def inside_box(low: list[float], high: list[float], closed: bool = False, names=AXES) -> Column:
    """Cells by centre: open bounds; particles: closed."""
    out = F.lit(True)
    for a, lo, hi in zip(names, low, high):
        out = out & (F.col(a).between(lo, hi) if closed else (F.col(a) > lo) & (F.col(a) < hi))
    return out


def overlaps(x: Column, dx: Column, low: float, high: float) -> Column:
    return (x + dx / 2 >= low) & (x - dx / 2 <= high)


def rotated(x: Column, y: Column, z: Column, axis: tuple[float, float, float], degrees: float, centre=(0.0, 0.0, 0.0)) -> tuple[Column, Column, Column]:
    """Rotation by an angle about an axis through a centre."""
    n = math.sqrt(sum(a * a for a in axis))
    k = [a / n for a in axis]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    p = [v - o for v, o in zip((x, y, z), centre)]
    along = p[0] * k[0] + p[1] * k[1] + p[2] * k[2]
    cross = [k[1] * p[2] - k[2] * p[1], k[2] * p[0] - k[0] * p[2], k[0] * p[1] - k[1] * p[0]]
    return tuple(p[i] * c + cross[i] * s + k[i] * (1 - c) * along + centre[i] for i in range(3))


def perspective_scale(z: Column, focal: float, centre: float = 0.0) -> Column:
    """How large things look at a depth z, for an eye a focal length before the centre's plane."""
    return focal / (focal + z - centre)


def perspective(x: Column, z: Column, focal: float, centre: float = 0.0, depth: float = 0.0) -> Column:
    """A coordinate scaled about the centre; depth: the centre's place along the line of sight."""
    return (x - centre) * perspective_scale(z, focal, depth) + centre


def taper(r: Column, rmax: float, rchr: float) -> Column:
    return F.when(r > rmax, F.exp(-(r - rmax) / (rchr - rmax))).otherwise(1.0)


def opacity(z: Column, zmax: float, depth: float, o: float) -> Column:
    return 2 / (2 + o) * (1 + o * (zmax - z) / depth)


def replicas(df: DataFrame, lengths: tuple[float, float, float]) -> DataFrame:
    """The 27 periodic images of points."""
    spark = df.sparkSession
    shifts = spark.range(27).select((F.col("id") % 3 - 1).alias("sx"), (F.floor(F.col("id") / 3) % 3 - 1).alias("sy"), (F.floor(F.col("id") / 9) - 1).alias("sz"))
    out = df.crossJoin(F.broadcast(shifts))  # 27 rows
    return out.withColumns({a: F.col(a) + F.col(f"s{a}") * lengths[i] for i, a in enumerate(AXES)})


def pixels_of(x: Column, dx: Column, low: float, size: float, count: int | None = None) -> Column:
    """The pixels that a cell reaches, to explode; with a count only those of a map of so many."""
    first, last = F.floor((x - dx / 2 - low) / size + 1e-9).cast("long"), F.ceil((x + dx / 2 - low) / size - 1e-9).cast("long") - 1
    if count is not None:
        first, last = F.greatest(first, F.lit(0).cast("long")), F.least(last, F.lit(count - 1).cast("long"))
    return F.when(first <= last, F.sequence(first, last))


def overlap(x: Column, dx: Column, pixel: Column, low: float, size: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(x + dx / 2, low + (pixel + 1) * size) - F.greatest(x - dx / 2, low + pixel * size))


def project(cells: DataFrame, value: Column, low: tuple[float, float], size: float, shape: tuple[int, int], weight: Column | None = None) -> DataFrame:
    """ix, iy, value: the mean along z of cells (x, y, z, dx, dy, dz), weighted by overlap (and weight); missing pixels have no row."""
    rows = cells.withColumns({"q": value, "w0": weight if weight is not None else F.lit(1.0)})
    rows = rows.withColumn("ix", F.explode(pixels_of(F.col("x"), F.col("dx"), low[0], size, shape[0])))
    rows = rows.withColumn("iy", F.explode(pixels_of(F.col("y"), F.col("dy"), low[1], size, shape[1])))
    w = overlap(F.col("x"), F.col("dx"), F.col("ix"), low[0], size) * overlap(F.col("y"), F.col("dy"), F.col("iy"), low[1], size) * F.col("dz") * F.col("w0")
    return rows.groupBy("ix", "iy").agg((F.sum(F.col("q") * w) / F.sum(w)).alias("value"), F.sum(w).alias("weight"))


def downsample(cells: DataFrame, factor: int, value: Column, weight: Column) -> DataFrame:
    """Block means over factor**3 cells."""
    key = [F.col("block")] + [F.floor(F.col(c) / factor).cast("long").alias(f"c{c}") for c in "ijk"]
    return cells.groupBy(*key).agg((F.sum(value * weight) / F.sum(weight)).alias("value"), F.count("*").alias("n"))


def split_cells(cells: DataFrame, finest: int) -> DataFrame:
    """Cells of coarse levels as 2**(finest - level) cells in each direction."""
    n = F.pow(F.lit(2), F.lit(finest) - F.col("level")).cast("long")
    out = cells.withColumn("n_split", n)
    for a in AXES:
        out = out.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_split") - 1)))
        out = out.withColumn(a, F.col(a) - F.col(f"d{a}") / 2 + (F.col("s") + 0.5) * F.col(f"d{a}") / F.col("n_split")).withColumn(f"d{a}", F.col(f"d{a}") / F.col("n_split"))
    return out.drop("s", "n_split")


#: From this deviation on a Gaussian is three box blurs: their work does not grow with the width.
WIDE = 1.8


def smooth(pixels: DataFrame, fwhm: float, shape: tuple[int, int], reach: int | None = None) -> DataFrame:
    """Gaussian smoothing of a map (ix, iy, value) by its full width at half maximum.

    A narrow kernel is summed directly, one pass along each axis, and divided by the weight of the pixels there are. A deviation from
    WIDE on (unless a reach is given) takes three box blurs along each axis, for which a map must be full: an edge's pixel is repeated.
    """
    sigma = fwhm / 2.35482
    if reach is None and sigma >= WIDE:
        for width in box_widths(sigma):
            pixels = box_blur(box_blur(pixels, "ix", "iy", (width - 1) // 2), "iy", "ix", (width - 1) // 2)
        return pixels.select("ix", "iy", "value")
    reach = reach or max(1, math.ceil(3 * sigma))
    rows = pixels.select("ix", "iy", F.col("value").alias("v"), F.lit(1.0).alias("w"))
    for c, n in zip(("ix", "iy"), shape):
        other = "iy" if c == "ix" else "ix"
        rows = rows.withColumn("o", F.explode(F.sequence(F.greatest(F.lit(-reach), -F.col(c)), F.least(F.lit(reach), n - 1 - F.col(c)))))
        k = F.exp(-F.col("o") * F.col("o") / (2 * sigma * sigma))
        rows = rows.groupBy((F.col(c) + F.col("o")).alias(c), other).agg(F.sum(F.col("v") * k).alias("v"), F.sum(F.col("w") * k).alias("w"))
    return rows.select("ix", "iy", (F.col("v") / F.col("w")).alias("value"))


def box_widths(sigma: float, boxes: int = 3) -> list[int]:
    """Odd widths of box blurs that together have about a Gaussian's variance: the two odd numbers about the ideal width, the smaller ones first.

    A box of width w has the variance (w * w - 1) / 12; the number of smaller boxes is the one that comes nearest.
    """
    wanted = 12 * sigma * sigma
    ideal = math.sqrt(wanted / boxes + 1)
    small = math.floor(ideal) - (math.floor(ideal) % 2 == 0)
    fewer = (boxes * ((small + 2) ** 2 - 1) - wanted) / ((small + 2) ** 2 - small**2)
    count = math.floor(fewer + 0.5)
    return [small] * count + [small + 2] * (boxes - count)


def box_blur(pixels: DataFrame, along: str, across: str, reach: int) -> DataFrame:
    """Running means of 2 * reach + 1 pixels of a full map; beyond an edge the edge's pixel is repeated."""
    line = Window.partitionBy(across).orderBy(along)
    whole = Window.partitionBy(across)
    first, last = F.min(F.struct(along, "value")).over(whole), F.max(F.struct(along, "value")).over(whole)
    before = F.greatest(F.lit(0), first[along] - F.col(along) + reach)
    after = F.greatest(F.lit(0), F.col(along) + reach - last[along])
    total = F.sum("value").over(line.rowsBetween(-reach, reach)) + before * first["value"] + after * last["value"]
    return pixels.select(along, across, (total / (2 * reach + 1)).alias("value"))


def rolled(pixels: DataFrame, steps: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """A map moved periodically."""
    return pixels.withColumns({c: F.pmod(F.col(c) + s, F.lit(n)) for c, s, n in zip(("ix", "iy"), steps, shape)})


def resampled(pixels: DataFrame, shape: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """A map on another number of pixels, bilinear between pixel centres; missing pixels are left out of the mean."""
    out = pixels.sparkSession.range(new[0] * new[1]).select((F.col("id") % new[0]).alias("ix"), F.floor(F.col("id") / new[0]).alias("iy"))
    for c, n, m in zip(("ix", "iy"), shape, new):
        at = F.least(F.greatest((F.col(c) + 0.5) * n / m - 0.5, F.lit(0.0)), F.lit(n - 1.0))
        low = F.floor(at)
        ends = F.array(F.struct(low.alias("at"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("at"), (at - low).alias("w")))
        out = out.withColumn(f"s{c}", F.explode(F.filter(ends, lambda e: e["w"] > 0)))
    near = out.select("ix", "iy", F.col("six.at").alias("sx"), F.col("siy.at").alias("sy"), (F.col("six.w") * F.col("siy.w")).alias("w"))
    met = near.join(pixels.select(F.col("ix").alias("sx"), F.col("iy").alias("sy"), "value"), ["sx", "sy"])
    return met.groupBy("ix", "iy").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def rotation_sequence(points: DataFrame, n: int, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Points (x, y, z) turned about the z axis in n equal steps of a full turn, with the number of the image."""
    out = points.withColumn("image", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = F.col("image") * (2 * math.pi / n)
    x, y = F.col("x") - centre[0], F.col("y") - centre[1]
    return out.withColumns({"x": x * F.cos(angle) - y * F.sin(angle) + centre[0], "y": x * F.sin(angle) + y * F.cos(angle) + centre[1]})


def extract(cells: DataFrame, value: Column, low: tuple[float, float, float], size: float, shape: tuple[int, int, int], weight: Column | None = None, lengths: tuple[float, float, float] | None = None) -> DataFrame:
    """ix, iy, iz, value: a uniform cube from cells (x, y, z, dx, dy, dz), weighted by overlap (and weight).

    With lengths the domain repeats: a cell comes up in each image that reaches the cube, and in no other.
    """
    rows = cells.withColumns({"q": value, "w": weight if weight is not None else F.lit(1.0)})
    for a, lo, m, k in zip(AXES, low, shape, range(3)):
        x, dx, high = F.col(a), F.col(f"d{a}"), lo + m * size
        if lengths:
            first, last = F.ceil((lo - x - dx / 2) / lengths[k] + 1e-9), F.floor((high - x + dx / 2) / lengths[k] - 1e-9)
            images = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
            rows = rows.withColumn("image", F.explode(images)).withColumn(a, x + F.col("image") * lengths[k]).drop("image")
        rows = rows.where((x + dx / 2 > lo) & (x - dx / 2 < high)).withColumn(f"i{a}", F.explode(pixels_of(x, dx, lo, size, m)))
        rows = rows.withColumn("w", F.col("w") * overlap(x, dx, F.col(f"i{a}"), lo, size))
    return rows.groupBy("ix", "iy", "iz").agg((F.sum(F.col("q") * F.col("w")) / F.sum("w")).alias("value"), F.sum("w").alias("weight"))


#: A face without a neighbour.
MISSING = -21


def neighbours(blocks: DataFrame, low: tuple[float, float, float], lengths: tuple[float, float, float], finest: float, coarsest: float, periodic: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """block, face (x-, x+, y-, ...), neighbour: the leaf blocks that share a face, one row each (finer ones are several); MISSING at an edge.

    blocks: leaves with lo_ and hi_ bounds, whose sides are finest to coarsest and which are nested in cubes of the coarsest. Blocks on both sides of a
    face lie in one plane and, across it, in one column of coarsest cubes, so all faces meet in one equi-join. Blocks are worked out once.
    """
    b = cut_lineage(blocks.select("block", *(f"{e}_{c}" for e in ("lo", "hi") for c in AXES)))
    ours, theirs = [], []
    for a, c in enumerate(AXES):
        others = [x for x in range(3) if x != a]
        plane = lambda end, a=a, c=c: F.round((F.col(f"{end}_{c}") - low[a]) / finest).cast("long")
        planes = round(lengths[a] / finest)
        column = [F.floor(((F.col(f"lo_{AXES[x]}") + F.col(f"hi_{AXES[x]}")) / 2 - low[x]) / coarsest).cast("long").alias(f"q{k}") for k, x in enumerate(others)]
        bounds = lambda p, others=others: [F.col(f"{e}_{AXES[x]}").alias(f"{p}{e}{k}") for k, x in enumerate(others) for e in ("lo", "hi")]
        for face, near, far in ((f"{c}-", "lo", "hi"), (f"{c}+", "hi", "lo")):
            at = plane(near)
            wrapped = F.when((at == 0) & F.lit(near == "lo"), F.lit(planes)).when((at == planes) & F.lit(near == "hi"), F.lit(0)).otherwise(at) if periodic[a] else at
            ours.append(F.struct(F.lit(face).alias("face"), wrapped.cast("long").alias("plane"), *column, *bounds("a")))
            theirs.append(F.struct(F.lit(face).alias("face"), plane(far).alias("plane"), *column, *bounds("b")))
    one = b.select("block", F.inline(F.array(*ours)))
    other = b.select(F.col("block").cast("long").alias("neighbour"), F.inline(F.array(*theirs)))
    touch = F.lit(True)
    for x in range(2):
        touch = touch & (F.least(F.col(f"ahi{x}"), F.col(f"bhi{x}")) - F.greatest(F.col(f"alo{x}"), F.col(f"blo{x}")) > 1e-9 * finest)
    found = cut_lineage(one.join(other, ["face", "plane", "q0", "q1"]).where(touch).select("block", "face", "neighbour"))
    lonely = one.select("block", "face").join(found, ["block", "face"], "left_anti").withColumn("neighbour", F.lit(MISSING).cast("long"))
    return found.unionAll(lonely)


def inward(t: Column, size: Column, length: float, boundary: str) -> Column:
    """The place (from the domain's low end) that stands for a place t of a cell; null if there is none."""
    if boundary == "periodic":
        return F.pmod(t, F.lit(float(length)))
    if boundary == "outflow":  # the edge's cell goes on
        return F.least(F.greatest(t, size / 2), length - size / 2)
    if boundary == "reflecting":
        return F.when(t < 0, -t).when(t > length, 2 * length - t).otherwise(t)
    if boundary == "none":
        return F.when((t > 0) & (t < length), t)
    raise ValueError(f"unknown boundary {boundary!r}")


def halo(cells: DataFrame, blocks: DataFrame, values: list[str], cells_per_block: int, guard: int, low: tuple[float, float, float], lengths: tuple[float, float, float], coarsest: float,
         boundary: tuple[str, str, str] = ("periodic", "periodic", "periodic"), turned: tuple[str | None, str | None, str | None] = (None, None, None)) -> DataFrame:
    """block, i, j, k (beyond 0 to cells_per_block - 1) and the values of each block's guard cells on a refined mesh.

    cells: x, y, z, dx; blocks: block, lo_ and hi_ bounds. Cells of all levels are nested in cubes of the coarsest cell size, so a
    guard cell meets just the cells of its own cube: one equi-join and a grouped mean, weighted by overlap. By axis the domain is periodic,
    goes on as at its edge (outflow), is mirrored (reflecting; of the values the one named in turned for this axis changes its sign), or ends
    (none: guard cells beyond have no row).
    """
    n, reach = cells_per_block, F.sequence(F.lit(-guard), F.lit(cells_per_block + guard - 1))
    want = blocks.withColumn("size", (F.col("hi_x") - F.col("lo_x")) / n)
    for c in "ijk":
        want = want.withColumn(c, F.explode(reach))
    want = want.where(~(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1) & F.col("k").between(0, n - 1)))
    have = cells.select(*AXES, "dx", *values)
    for a, c, lo, length in zip(AXES, "ijk", low, lengths):
        place, rule = F.col(f"lo_{a}") + (F.col(c) + 0.5) * F.col("size") - lo, boundary[AXES.index(a)]
        want = want.withColumn(f"flip_{a}", F.when(((place < 0) | (place > length)) & F.lit(rule == "reflecting"), -1.0).otherwise(1.0))
        want = want.withColumn(f"t_{a}", inward(place, F.col("size"), length, rule)).where(F.col(f"t_{a}").isNotNull()).withColumn(f"q{a}", F.floor(F.col(f"t_{a}") / coarsest).cast("long"))
        have = have.withColumn(a, F.col(a) - lo).withColumn(f"q{a}", F.floor(F.col(a) / coarsest).cast("long"))
    met = want.select("block", "i", "j", "k", "size", *(f"{p}_{a}" for p in ("t", "flip") for a in AXES), *(f"q{a}" for a in AXES)).join(have, [f"q{a}" for a in AXES])
    w = F.lit(1.0)
    for a in AXES:
        t, s, x, d = F.col(f"t_{a}"), F.col("size") / 2, F.col(a), F.col("dx") / 2
        w = w * F.greatest(F.lit(0.0), F.least(t + s, x + d) - F.greatest(t - s, x - d))
    met = met.withColumn("w", w).where("w > 0")
    met = met.withColumns({v: F.col(v) * F.col(f"flip_{a}") for v, a in zip(turned, AXES) if v})
    return met.groupBy("block", "i", "j", "k").agg(*((F.sum(F.col(v) * F.col("w")) / F.sum("w")).alias(v) for v in values))


def starlight(stars: DataFrame, cells: DataFrame, opacity_: float, pixel: float) -> DataFrame:
    """tag, tau, light: a star's luminosity times exp(-tau), tau from the gas between it and an eye at large z.

    cells: x, y, z, dx, dy, dz, dens. Cells are laid on columns of the pixel size and meet the stars of their columns; a column with
    many cells is summed by star with partial aggregation.
    """
    at = stars.select("tag", F.col("luminosity"), *(F.col(a).alias(f"s_{a}") for a in AXES), F.floor(F.col("x") / pixel).cast("long").alias("px"), F.floor(F.col("y") / pixel).cast("long").alias("py"))
    gas = cells.withColumn("px", F.explode(pixels_of(F.col("x"), F.col("dx"), 0.0, pixel))).withColumn("py", F.explode(pixels_of(F.col("y"), F.col("dy"), 0.0, pixel)))
    hit = F.lit(True)
    for a in ("x", "y"):
        hit = hit & (F.col(f"s_{a}") >= F.col(a) - F.col(f"d{a}") / 2) & (F.col(f"s_{a}") < F.col(a) + F.col(f"d{a}") / 2)
    front = F.greatest(F.lit(0.0), F.least(F.col("dz"), F.col("z") + F.col("dz") / 2 - F.col("s_z")))
    depth = at.join(gas.select("px", "py", *AXES, "dx", "dy", "dz", "dens"), ["px", "py"]).where(hit).groupBy("tag").agg(F.sum(opacity_ * F.col("dens") * front).alias("tau"))
    out = stars.join(depth, "tag", "left").withColumn("tau", F.coalesce("tau", F.lit(0.0)))
    return out.withColumn("light", F.col("luminosity") * F.exp(-F.col("tau")))


def starfield(lights: DataFrame, radius: float, low: tuple[float, float], size: float, shape: tuple[int, int], depth: float | None = None) -> DataFrame:
    """ix, iy, value: each star's light spread over a disc, by the height of a hemisphere. A star's shares add up to its light; with the depth of the
    view a pixel has the light times its own volume (area times depth) times the height over the radius instead."""
    rows = lights.select("tag", "x", "y", "light")
    for a, lo in zip(("x", "y"), low):
        rows = rows.withColumn(f"i{a}", F.explode(F.sequence(F.floor((F.col(a) - radius - lo) / size).cast("long"), F.floor((F.col(a) + radius - lo) / size).cast("long"))))
    gap = [(F.col(f"i{a}") + 0.5) * size + lo - F.col(a) for a, lo in zip(("x", "y"), low)]
    height = F.sqrt(F.greatest(F.lit(0.0), radius * radius - gap[0] * gap[0] - gap[1] * gap[1]))
    rows = rows.withColumn("h", height).withColumn("share", F.col("h") / F.sum("h").over(Window.partitionBy("tag"))).where("h > 0")
    inside = F.col("ix").between(0, shape[0] - 1) & F.col("iy").between(0, shape[1] - 1)
    share = F.col("share") if depth is None else F.col("h") / radius * (size * size * depth)
    return rows.where(inside).groupBy("ix", "iy").agg(F.sum(F.col("light") * share).alias("value"))


def view_range(domain: list[tuple[float, float]], finest: float, slice_: bool = False, zoom: float = 1.0, axis: int = 2) -> list[tuple[float, float]]:
    """The bounds of a view: the domain, cut to one finest cell about the middle of the line of sight for a slice, then zoomed about its middle."""
    out = list(domain)
    if slice_:
        low, high = out[axis]
        out[axis] = ((low + high) / 2 - finest / 2, (low + high) / 2 + finest / 2)
    return [((a + b) / 2 - (b - a) / 2 / zoom, (a + b) / 2 + (b - a) / 2 / zoom) for a, b in out]


def fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that later filters and projections take as they are: through an explode of one struct. Else Catalyst puts the whole
    expression wherever its name stands, also in filters it pushes down, and code for nested ones grows beyond what is compiled."""
    others = [c for c in df.columns if c not in columns]
    one = df.select(*others, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("mq_fixed"))
    return one.select(*others, *(F.col(f"mq_fixed.{n}").alias(n) for n in columns))


def seen(points: DataFrame, bounds: list[tuple[float, float]], turn: tuple[tuple[float, float, float], float] | None = None, focal: float | None = None,
         sphere: tuple[float, float] | None = None, opaque: float = 0.0, vector: tuple[str, str, str] | None = None) -> DataFrame:
    """Points or cells (x, y, z) as seen along z: turned about an axis through the view's centre, in perspective, with weights.

    Adds scale (of sizes) and seen_weight: that of scale squared, of a sphere (rmax, rchr: outside rmax it falls off) and of opacity. A
    vector's three columns turn with the points, about 0.
    """
    centre = tuple((a + b) / 2 for a, b in bounds)
    weight = F.lit(1.0)
    if sphere:
        d = [F.col(a) - c for a, c in zip(AXES, centre)]
        r = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        weight = taper(r, *sphere)
    out = points.withColumn("seen_weight", weight)
    if turn:
        axis, degrees = turn
        new = dict(zip(AXES, rotated(*(F.col(a) for a in AXES), axis, degrees, centre)))
        if vector:
            new |= dict(zip(vector, rotated(*(F.col(v) for v in vector), axis, degrees)))
        out = fixed(out, new | {"seen_weight": F.col("seen_weight")})
    opacity_weight = opacity(F.col("z"), bounds[2][1], bounds[2][1] - bounds[2][0], opaque) if opaque else F.lit(1.0)
    if not focal:
        return out.withColumns({"scale": F.lit(1.0), "seen_weight": F.col("seen_weight") * opacity_weight})
    out = fixed(out, {"scale": perspective_scale(F.col("z"), focal, centre[2])})
    return fixed(out, {a: (F.col(a) - c) * F.col("scale") + c for a, c in zip(("x", "y"), centre)} | {"seen_weight": F.col("scale") * F.col("scale") * F.col("seen_weight") * opacity_weight})


def moment_maps(cells: DataFrame, value: Column, bounds: list[tuple[float, float]], size: float, shape: tuple[int, int], weight: Column | None = None, **view) -> DataFrame:
    """ix, iy, weight, moment_0, moment_1, moment_2 along z: the weight's mean along the line of sight times its length, and the mean and the
    deviation of a value. cells: x, y, z, dx, dy, dz; view: options of seen(). Cells that touch the view's bounds count by overlap."""
    rows = seen(cells, bounds, **view).withColumns({f"d{a}": F.col(f"d{a}") * F.col("scale") for a in ("x", "y")})
    for a, (low, high) in zip(AXES, bounds):
        rows = rows.where(overlaps(F.col(a), F.col(f"d{a}"), low, high))
    rows = rows.withColumns({"q": value, "w": F.col("seen_weight") * (weight if weight is not None else F.lit(1.0))}).where(F.col("seen_weight") >= 1e-6)
    for k, a in enumerate(("x", "y")):
        rows = rows.withColumn(f"i{a}", F.explode(pixels_of(F.col(a), F.col(f"d{a}"), bounds[k][0], size, shape[k])))
        rows = rows.withColumn("w", F.col("w") * overlap(F.col(a), F.col(f"d{a}"), F.col(f"i{a}"), bounds[k][0], size))
    depth = bounds[2][1] - bounds[2][0]
    inside = F.least(F.col("z") + F.col("dz") / 2, F.lit(bounds[2][1])) - F.greatest(F.col("z") - F.col("dz") / 2, F.lit(bounds[2][0]))
    rows = rows.withColumn("w", F.col("w") * inside)
    w, q = F.col("w"), F.col("q")
    total, mean = F.sum(w), F.sum(q * w) / F.sum(w)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(q * q * w) / F.sum(w) - mean * mean))
    return rows.groupBy("ix", "iy").agg((total / (size * size * depth)).alias("weight"), (total / (size * size)).alias("moment_0"), mean.alias("moment_1"), spread.alias("moment_2"))


def particles_on_map(particles: DataFrame, bounds: list[tuple[float, float]], lengths: tuple[float, float, float], sink_type: int = 2, **view) -> DataFrame:
    """Particles and their periodic images within a view, as seen; type becomes 0 for sinks and 1 for tracers, tapered ones (weight < 1) go."""
    images = seen(replicas(particles, lengths), bounds, **view)
    if "sphere" in view:
        images = images.where(F.col("seen_weight") / (F.col("scale") * F.col("scale")) >= 1.0)
    for a, (low, high) in zip(AXES, bounds):
        images = images.where(F.col(a).between(low, high))
    return images.withColumn("type", F.when(F.col("type") == sink_type, 0).otherwise(1))


def with_geometry(cells: DataFrame, blocks: DataFrame, per_block: int) -> DataFrame:
    """Cells (block, i, j, k) of leaf blocks with centre, size and volume: the join of cells with their blocks' bounds."""
    leaves = blocks.where("node_type = 1").select("block", *(F.col(f"lo_{a}") for a in AXES), *(((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / per_block).alias(f"d{a}") for a in AXES))
    out = cells.join(leaves, "block")
    out = out.withColumns({a: F.col(f"lo_{a}") + (F.col(c) + 0.5) * F.col(f"d{a}") for a, c in zip(AXES, "ijk")})
    return out.withColumn("vol", F.col("dx") * F.col("dy") * F.col("dz")).drop(*(f"lo_{a}" for a in AXES))


def cell_of(x: Column, low: Column, size: Column) -> Column:
    """The cell (or block) that a point is in, by truncation."""
    return ((x - low) / size).cast("long")


def block_summary(blocks: DataFrame, per_block: int) -> DataFrame:
    """One row: blocks, leaves, levels, finest and coarsest cell, bounds and volume of the domain and the cells at the finest level along x."""
    leaf = F.col("node_type") == 1
    size = (F.col("hi_x") - F.col("lo_x")) / per_block
    ends = [F.min(f"lo_{a}").alias(f"lo_{a}") for a in AXES] + [F.max(f"hi_{a}").alias(f"hi_{a}") for a in AXES]
    out = blocks.agg(F.count("*").alias("blocks"), F.sum(leaf.cast("long")).alias("leaves"), F.min("level").alias("min_level"), F.max("level").alias("max_level"),
                     F.min(F.when(leaf, size)).alias("min_dx"), F.max(F.when(leaf, size)).alias("max_dx"), *ends)
    spans_ = [F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES]
    return out.withColumns({"volume": spans_[0] * spans_[1] * spans_[2], "finest": F.round(spans_[0] / F.col("min_dx")).cast("long")})


def map_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """ix, iy, value: the product of two maps on the pixels that both have."""
    return a.select("ix", "iy", F.col("value").alias("mq_a")).join(b.select("ix", "iy", F.col("value").alias("mq_b")), ["ix", "iy"]).select("ix", "iy", (F.col("mq_a") * F.col("mq_b")).alias("value"))
