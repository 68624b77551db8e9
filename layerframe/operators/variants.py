"""Structure variants: weighted draws, displaced and defective atoms, stacked layers, simulator input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_normal, hash_uniform
from .blobs import disc_offsets

# Atomic numbers of the elements the structure files use.
ATOMIC_NUMBERS = {"H": 1, "C": 6, "N": 7, "O": 8, "S": 16, "Cl": 17, "Cr": 24, "Se": 34, "Br": 35, "Mo": 42, "Te": 52, "I": 53, "Ta": 73, "W": 74, "Re": 75}
# Constant lines of a simulator parameter file.
PARAM_CONSTANTS = {"replicas": "1 1 1", "beam": "300 0 0 {defocus} 21.3", "angles": "39 200", "aberrations": "C12a 0 C12b 0 C21a 0 C21b 0 C23a 0 C23b 0 END", "tail": ["0 ", "n", "-1"]}


def cumulative(items: DataFrame, keys: list[str], weight: str = "weight", order: str = "ord") -> DataFrame:
    """Cumulative weight intervals (lo, hi] of a short item list per key, with the total."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = items.withColumn("hi", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = items.groupBy(*keys).agg(F.sum(weight).alias("total"))
    return d.withColumn("lo", F.col("hi") - F.col(weight)).join(total, keys)


def weighted_draw(rows: DataFrame, items: DataFrame, keys: list[str], mark: Column, name: str = "name") -> DataFrame:
    """One item per row: the first whose cumulative weight reaches mark·total (mark in 0..1).

    The item list of a key (a handful of presets) travels as one array on the join, so a row stays a row.
    """
    arr = cumulative(items, keys).groupBy(*keys, "total").agg(F.sort_array(F.collect_list(F.struct("ord", "hi", name, "weight"))).alias("_items"))
    d = rows.withColumn("_m", mark).join(arr, keys)
    hit = F.filter("_items", lambda e: F.col("_m") * F.col("total") <= e["hi"])
    pick = F.coalesce(F.try_element_at(hit, F.lit(1)), F.element_at("_items", -1))
    return d.withColumn("_p", pick).withColumn(name, F.col("_p")[name]).withColumn("weight", F.col("_p")["weight"]).drop("_m", "_items", "_p", "total")


def uniform_choice(values: Column, u: Column) -> Column:
    """Element of an array for u in 0..1."""
    return F.element_at(values, F.least(F.size(values), F.floor(u * F.size(values)).cast("int") + 1))


def thermal(atoms: DataFrame, sigma: Column, seed: int, ident: list[str]) -> DataFrame:
    """Normal displacement of every coordinate where sigma > 0."""
    out = atoms
    for k, c in enumerate("xyz"):
        out = out.withColumn(c, F.col(c) + F.when(sigma > 0, sigma * hash_normal(seed + k, *ident)).otherwise(0.0))
    return out


def vacancies(atoms: DataFrame, rates: Column, seed: int, ident: list[str]) -> DataFrame:
    """Drop each atom with the rate its symbol has in the map."""
    r = F.coalesce(F.try_element_at(rates, F.col("symbol")), F.lit(0.0))
    return atoms.filter((r <= 0) | (hash_uniform(seed, *ident) >= r))


def stack_layers(atoms: DataFrame, sweeps: DataFrame, keys: list[str]) -> DataFrame:
    """Layers of every sweep row: translate, turn about the cell centre (degrees, z), flip (180° about y), lift.

    ``atoms``: keys, atom_id, symbol, x, y, z. ``sweeps``: keys, sweep_id, layer, mx, my, mz, rot, flip and
    the cell centre ccx, ccy, ccz.
    """
    j = atoms.join(sweeps, keys)
    x, y, z = F.col("x") + F.col("mx"), F.col("y") + F.col("my"), F.col("z") + F.col("mz")
    a = F.radians("rot")
    dx, dy = x - F.col("ccx"), y - F.col("ccy")
    j = j.withColumns({"_x": F.cos(a) * dx - F.sin(a) * dy + F.col("ccx"), "_y": F.sin(a) * dx + F.cos(a) * dy + F.col("ccy"), "_z": z})
    j = j.withColumn("_x", F.when(F.col("flip"), 2.0 * F.col("ccx") - F.col("_x")).otherwise(F.col("_x")))
    j = j.withColumn("_z", F.when(F.col("flip"), 2.0 * F.col("ccz") - F.col("_z")).otherwise(F.col("_z")))
    return j.select(*keys, "sweep_id", "layer", "atom_id", "symbol", F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"))


def bilayer_sweep(structures: DataFrame, xs: tuple[int, int, int], ys: tuple[int, int, int], step: float = 0.1, lift: float = 0.67) -> DataFrame:
    """Sweep rows of a two-layer scan: layer 1 at rest, layer 2 moved by (i, j)·step and lifted."""
    i = F.sequence(F.lit(xs[0]), F.lit(xs[1] - 1), F.lit(xs[2]))
    j = F.sequence(F.lit(ys[0]), F.lit(ys[1] - 1), F.lit(ys[2]))
    s = structures.withColumn("i", F.explode(i)).withColumn("j", F.explode(j))
    s = s.withColumn("sweep_id", F.concat_ws("_", (F.col("i") * step).cast("string"), (F.col("j") * step).cast("string"), F.lit("0"), F.lit("0")))
    s = s.withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2))))
    on = F.col("layer") == 2
    return s.withColumns({"mx": F.when(on, F.col("i") * step).otherwise(0.0), "my": F.when(on, F.col("j") * step).otherwise(0.0), "mz": F.when(on, lift).otherwise(0.0),
                          "rot": F.lit(0.0), "flip": F.lit(False)}).drop("i", "j")


def twist_sweep(structures: DataFrame, angles: tuple[float, ...], flips: tuple[bool, ...] = (False,), lift: float = 6.7) -> DataFrame:
    """Sweep rows of a twist scan: layer 1 at rest, layer 2 lifted, turned by each angle (degrees) and flipped or not."""
    s = structures.withColumn("angle", F.explode(F.array(*[F.lit(float(a)) for a in angles]))).withColumn("turned", F.explode(F.array(*[F.lit(f) for f in flips])))
    s = s.withColumn("sweep_id", F.concat_ws("_", F.lit("0"), F.lit("0"), F.col("angle").cast("string"), F.col("turned").cast("int").cast("string")))
    s = s.withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2))))
    on = F.col("layer") == 2
    return s.withColumns({"mx": F.lit(0.0), "my": F.lit(0.0), "mz": F.when(on, lift).otherwise(0.0), "rot": F.when(on, F.col("angle")).otherwise(0.0), "flip": on & F.col("turned")}).drop("angle", "turned")


def third_layer_offset(m1: Column, m2: Column) -> Column:
    """Offset of the third layer from the two in-plane moves."""
    return m2 + 0.5 * m1


def trilayer_sweep(structures: DataFrame, moves: list[tuple[float, float]], more: list[tuple[float, float]], lifts: tuple[float, float] = (7.0, 14.0)) -> DataFrame:
    """Sweep rows of a three-layer scan: layer 2 takes each of ``moves``, layer 3 each of ``more`` on top of half of it."""
    point = lambda xy: F.struct(F.lit(float(xy[0])).alias("x"), F.lit(float(xy[1])).alias("y"))
    s = structures.withColumn("a", F.explode(F.array(*map(point, moves)))).withColumn("b", F.explode(F.array(*map(point, more))))
    s = s.withColumn("sweep_id", F.concat_ws("_", "a.x", "a.y", "b.x", "b.y")).withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    at = lambda c: F.when(F.col("layer") == 2, F.col(f"a.{c}")).when(F.col("layer") == 3, third_layer_offset(F.col(f"a.{c}"), F.col(f"b.{c}"))).otherwise(0.0)
    lift = F.when(F.col("layer") == 2, lifts[0]).when(F.col("layer") == 3, lifts[1]).otherwise(0.0)
    return s.withColumns({"mx": at("x"), "my": at("y"), "mz": lift, "rot": F.lit(0.0), "flip": F.lit(False)}).drop("a", "b")


def composition(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Element counts per structure."""
    return atoms.groupBy(*keys, "symbol").agg(F.count("*").alias("n"), F.min("atom_id").alias("first_id"))


def atomic_number(symbol: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in ATOMIC_NUMBERS.items() for v in kv])
    return F.try_element_at(table, symbol)


def simulator_lines(atoms: DataFrame, cells: DataFrame, keys: list[str], exclude: list[str] = ()) -> DataFrame:
    """Lines of the simulator's structure input: ``keys, line_no, line``; excluded species count in the header only.

    A structure with a symbol that is neither known nor excluded has no lines; :func:`unknown_symbols` lists it.

    ``cells``: keys, lx, ly, lz. Lines are rows, so a structure of any size is written in parallel.
    """
    bad = unknown_symbols(atoms, keys).filter(~F.col("symbol").isin(*exclude) if exclude else F.lit(True)).select(*keys).distinct()
    atoms, cells = (t.join(bad, keys, "left_anti") for t in (atoms, cells))
    comp = composition(atoms, keys).withColumn("part", F.concat("symbol", F.col("n").cast("string")))
    head = comp.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_id", "part"))), lambda s: s["part"]), "").alias("h"), F.sum("n").alias("n"))  # one entry per element
    tab = lambda *c: F.concat_ws("\t", *[v.cast("string") for v in c])
    h1 = head.select(*keys, F.lit(-2).cast("bigint").alias("line_no"), tab(F.col("h"), F.col("n")).alias("line"))
    h2 = cells.select(*keys, F.lit(-1).cast("bigint").alias("line_no"), tab(F.col("lx"), F.col("ly"), F.col("lz")).alias("line"))
    z = atomic_number(F.col("symbol"))
    body = atoms.filter(~F.col("symbol").isin(*exclude) if exclude else F.lit(True)).filter(z.isNotNull())
    body = body.select(*keys, F.col("atom_id").cast("bigint").alias("line_no"), F.concat(tab(z, F.col("x"), F.col("y"), F.col("z"), F.lit(1), F.lit(0)), F.lit("\t")).alias("line"))
    end = cells.select(*keys, F.lit((1 << 62)).alias("line_no"), F.lit("-1").alias("line"))
    return h1.unionByName(h2).unionByName(body).unionByName(end)


def unknown_symbols(atoms: DataFrame, keys: list[str]) -> DataFrame:
    return composition(atoms, keys).filter(atomic_number(F.col("symbol")).isNull()).select(*keys, "symbol", F.lit("unknown_symbol").alias("problem"))


def parameter_grid(variants: DataFrame, n_defocus: int = 5, n_source: int = 5) -> DataFrame:
    """Defocus 35 + i·10/n and source size 0.6 + j·0.1/n for every variant row."""
    d = variants.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_defocus - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_source - 1))))
    return d.withColumn("defocus", 35.0 + F.col("i") * (10.0 / n_defocus)).withColumn("source_size", 0.6 + F.col("j") * (0.1 / n_source))


def parameter_text(xyz: Column, tif: Column, width: Column, height: Column, defocus: Column, source: Column) -> Column:
    c = PARAM_CONSTANTS
    before, after = c["beam"].split("{defocus}")
    lines = [xyz, F.lit(c["replicas"]), tif, F.concat_ws(" ", width.cast("string"), height.cast("string")), F.concat(F.lit(before), defocus.cast("string"), F.lit(after)), F.lit(c["angles"]),
             F.lit(c["aberrations"]), source.cast("string"), *[F.lit(t) for t in c["tail"]]]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def label_raster(atoms: DataFrame, cells: DataFrame, keys: list[str], size: int, radius: int = 15, symbol: str = "Re", shift: int = 1) -> DataFrame:
    """Disc masks around the heavy atoms, one channel per layer; the shorter cell side spans ``size`` pixels."""
    unit = F.least("lx", "ly") / size
    d = atoms.filter(F.col("symbol") == symbol).join(cells.select(*keys, "lx", "ly"), keys).withColumn("_u", unit)
    d = d.withColumn("px", F.floor(F.col("x") / F.col("_u")).cast("int") + shift).withColumn("py", F.floor(F.col("y") / F.col("_u")).cast("int") + shift)
    d = d.withColumn("w", F.floor(F.col("lx") / F.col("_u")).cast("int")).withColumn("h", F.floor(F.col("ly") / F.col("_u")).cast("int"))
    o = d.withColumn("o", F.explode(disc_offsets(radius)))
    o = o.withColumn("x", F.col("px") + F.col("o.i")).withColumn("y", F.col("py") + F.col("o.j"))
    return o.filter("x >= 0 and x < w and y >= 0 and y < h").select(*keys, F.col("layer").alias("channel"), "x", "y").distinct()


def preset_counts(manifest: DataFrame, keys: list[str]) -> DataFrame:
    return manifest.groupBy(*keys, "defect_preset").agg(F.count("*").alias("n"))
