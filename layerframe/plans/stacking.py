"""Stacking analysis end to end: gray pixel tables of paired layers -> stacking and interlayer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..iterate import cut
from ..operators import interlayer as IL
from ..operators import keys as K
from ..operators.blobs import detect_atoms
from ..operators.lattice import layer_lattice
from ..operators.pixels import image_size
from ..sources.files import point_cloud_json


def analyse_folders(px: DataFrame, out_scale: float = 4.0, slip_deg: float = 5.0, use_highpass: bool = True, max_points: int | None = None) -> dict[str, DataFrame]:
    """All tables of the analysis. ``px``: image_id (a path), x, y, v.

    points: detected atoms in scaled coordinates, per folder and layer. lattice: origin and vectors per layer.
    stacking: class per folder. interlayer: shift and twist per folder. clouds: JSON texts of the points.
    """
    px = cut(px)
    size = cut(image_size(px))
    pairs = cut(K.pair_layers(size.select(F.col("image_id").alias("path"))))
    members = pairs.filter("reason = ''").select("folder", F.explode(F.array(F.struct(F.lit(0).alias("layer"), F.col("img0").alias("name")), F.struct(F.lit(1).alias("layer"), F.col("img1").alias("name")))).alias("m"))
    members = members.select("folder", "m.layer", F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), "m.name").alias("image_id"))
    atoms = detect_atoms(px.join(members, "image_id", "left_semi"), use_highpass=use_highpass, max_points=max_points)
    key = ["folder", "layer"]
    pts = cut(atoms.join(members, "image_id").select(*key, "pt_id", "x", "y"))
    side = K.side_angstrom(K.size_tag(F.col("folder"), "folder"))
    images = members.join(size, "image_id").select(*key, "w", "h", side.alias("side_angstrom"))
    lattice = cut(layer_lattice(pts, images, key, out_scale=out_scale))
    big = [F.col(f"{c}_512").alias(c) for c in ("origin", "da", "db")]
    half = lambda n: lattice.filter(F.col("layer") == n).select("folder", "ok", "reason", *big)
    stacking = pairs.select("folder", "img0", "img1").join(IL.stacking_class(half(0), half(1), ["folder"], slip_deg), "folder", "left")
    stacking = cut(stacking.withColumn("reason", F.coalesce("reason", F.lit("missing__0_or__1"))).withColumn("class", F.coalesce("class", F.lit("unknown"))).withColumn("ok", F.coalesce("ok", F.lit(False))))
    scaled = cut(pts.select(*key, "pt_id", (F.col("x") * out_scale).alias("x"), (F.col("y") * out_scale).alias("y")))
    return {"points": scaled, "lattice": lattice, "stacking": stacking, "interlayer": IL.analyse(stacking, scaled, ["folder"], side), "clouds": point_cloud_json(scaled, key)}
