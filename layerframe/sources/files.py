"""File listings, images, structures, point clouds, checksums and audits."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keys import DEFAULT_EXCLUDES, IMAGE_EXTENSIONS, base_name, dir_name, stem
from ..operators.pixels import luma

# Rules of the artifact audit.
FORBIDDEN_DIRS = ["__pycache__", ".venv", "venv", "trash", "tmp"]
FORBIDDEN_SUFFIXES = ["pt", "pth", "ckpt", "safetensors", "onnx", "tar", "gz", "zip", "docx", "pptx"]
MAX_BYTES = 20 * 1024 * 1024


# ---------------------------------------------------------------- listings

def _glob_regex(pattern: str) -> str:
    """Java regex for a shell pattern, anchored at both ends."""
    return "^" + re.sub(r"\\[zZ]$", "$", fnmatch.translate(pattern))


def filter_listing(files: DataFrame, extensions: list[str] | None = None, exclude_dirs: list[str] = (), skip_names: list[str] = ()) -> DataFrame:
    """Keep image files whose directories match no excluded pattern; ``rel`` is the path below the root with '/'."""
    ext = "|".join(re.escape(e) for e in (extensions or IMAGE_EXTENSIONS))
    d = files.filter(F.col("rel").rlike(rf"(?i)\.({ext})$"))
    if skip_names:
        d = d.filter(~base_name(F.col("rel")).isin(*skip_names))
    dirs = F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1)
    for pat in exclude_dirs:
        d = d.filter(~_any_dir(dirs, _glob_regex(pat)))
    return d


def _any_dir(dirs: Column, regex: str) -> Column:
    return F.exists(dirs, lambda s: s.rlike(regex))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing: path, rel, length; file contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return d.withColumn("rel", F.regexp_replace("path", r"^.*?" + re.escape(root.rstrip("/")) + "/", ""))


def list_images(spark: SparkSession, root: str, exclude_dirs: list[str] | None = None, extensions: list[str] | None = None, training: bool = False) -> DataFrame:
    """Images under ``root``; order by ``rel`` when a sorted list is wanted."""
    return filter_listing(list_files(spark, root), extensions, DEFAULT_EXCLUDES if exclude_dirs is None else exclude_dirs, ["mask.png"] if training else [])


def derive_excludes(input_rel_output: str | None, configured: list[str] | None = None) -> list[str]:
    """Directory patterns to skip: configured or default ones, plus the top folder of an output inside the input."""
    out = list(configured) if configured is not None else list(DEFAULT_EXCLUDES)
    if input_rel_output:
        out.append(input_rel_output.strip("/").split("/")[0])
    return [p for p in dict.fromkeys(out) if p]


def pending_items(items: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Items with at least one expected output missing. ``items``: item, expected ARRAY<STRING>; ``outputs``: path."""
    if force:
        return items
    need = items.select("item", F.explode("expected").alias("path"))
    todo = need.join(outputs.select("path"), "path", "left_anti").select("item").distinct()
    return items.join(todo, "item", "left_semi")


# ---------------------------------------------------------------- images

def _images(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").load(root).select("image.*")


def unreadable_images(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root`` that :func:`read_gray` cannot decode: ``image_id, problem``."""
    return _images(spark, root).filter("height is null or height <= 0").select(F.col("origin").alias("image_id"), F.lit("unreadable").alias("problem"))


def read_gray(spark: SparkSession, root: str) -> DataFrame:
    """Gray pixel table of every image under ``root`` by the built-in image source: ``image_id, x, y, v``.

    Colour rows hold BGR bytes and are reduced by luma. Files that cannot be decoded have no pixels;
    :func:`unreadable_images` lists them.
    """
    im = _images(spark, root).filter("height > 0")
    # unpack row by row so that the exploded unit is one image row
    n = F.col("nChannels")
    rows = im.withColumn("y", F.explode(F.expr("sequence(0, height - 1)")))
    rows = rows.select(F.col("origin").alias("image_id"), "y", "width", n.alias("n"), F.expr("substring(data, y * width * nChannels + 1, width * nChannels)").alias("b"))
    px = rows.withColumn("x", F.explode(F.expr("sequence(0, width - 1)")))

    def byte(k: str) -> Column:
        return F.conv(F.hex(F.expr(f"substring(b, x * n + 1 + {k}, 1)")), 16, 10).cast("double")

    gray = F.when(F.col("n") == 1, byte("0")).otherwise(luma(byte("2"), byte("1"), byte("0")))
    return px.select("image_id", F.col("x").cast("int"), F.col("y").cast("int"), gray.alias("v"))


def layer_dataset(spark: SparkSession, path_list: str, images: DataFrame, left_of: int = 300, top_of: int = 800, side: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Pixels of the listed folders' images, cut to the fixed box, and the folders without an image.

    ``images``: folder, layer, x, y, v, w, h. The box starts at (w//2 − top_of, h//2 − left_of) rows/columns.
    """
    wanted = spark.read.text(path_list).select(F.trim("value").alias("folder")).filter("folder <> ''").distinct()
    hit = images.join(wanted, "folder", "left_semi")
    top, left = F.floor(F.col("w") / 2) - top_of, F.floor(F.col("h") / 2) - left_of
    cut_ = hit.filter((F.col("x") >= left) & (F.col("x") < left + side) & (F.col("y") >= top) & (F.col("y") < top + side))
    out = cut_.select("folder", "layer", (F.col("x") - left).cast("int").alias("x"), (F.col("y") - top).cast("int").alias("y"), "v")
    return out, wanted.join(images.select("folder").distinct(), "folder", "left_anti")


# ---------------------------------------------------------------- structures

def _cell(head: Column, comment: Column) -> list[Column]:
    """Atom count, lattice and periodicity from the two leading lines."""
    lattice = F.transform(F.split(F.regexp_extract(comment, r'Lattice="([^"]*)"', 1), r"\s+"), lambda s: s.try_cast("double"))
    return [F.trim(head).try_cast("int").alias("n"), lattice.alias("lattice"), F.regexp_extract(comment, r'pbc="([^"]*)"', 1).alias("pbc")]


def _atom(line: Column) -> list[Column]:
    p = F.split(F.trim(line), r"\s+")
    return [F.get(p, 0).alias("symbol"), *[F.get(p, i + 1).try_cast("double").alias(c) for i, c in enumerate("xyz")]]


def parse_xyz(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms and cells of extended-XYZ texts (``structure, text``) that are short enough for a row; :func:`read_xyz` reads files of any size."""
    d = texts.withColumn("ls", F.split("text", r"\r?\n"))
    body = d.select("structure", F.posexplode(F.slice("ls", 3, F.greatest(F.lit(0), F.size("ls") - 2))).alias("atom_id", "line")).filter(F.trim("line") != "")
    return body.select("structure", "atom_id", *_atom(F.col("line"))), d.select("structure", *_cell(F.get("ls", 0), F.get("ls", 1)))


def read_xyz(spark: SparkSession, path: str, files: bool = False) -> tuple[DataFrame, DataFrame]:
    """Atoms and cells of the XYZ files under ``path``, as :func:`parse_xyz` gives them; with ``files`` also the ``file`` of each, for names that recur in several folders.

    Files are read as byte ranges, so one large file is many tasks. A line's number is its place in its range plus the
    lines of the ranges before it, which are counted once; no file is ever one row or one task.
    """
    row = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", stem(F.col("_metadata.file_name")).alias("structure"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), row.alias("row"))
    ranges = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranges.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = lines.join(shift, ["file", "start"]).select("file", "structure", "value", (F.col("row") + F.col("shift")).alias("no"))
    origin = ["file"] if files else []
    cells = numbered.filter("no < 2").groupBy("file", "structure").agg(F.max(F.when(F.col("no") == 0, F.col("value"))).alias("head"), F.max(F.when(F.col("no") == 1, F.col("value"))).alias("comment"))
    atoms = numbered.filter((F.col("no") >= 2) & (F.trim("value") != "")).select("structure", (F.col("no") - 2).alias("atom_id"), *_atom(F.col("value")), *origin)
    return atoms, cells.select("structure", *_cell(F.col("head"), F.col("comment")), *origin)


# ---------------------------------------------------------------- point clouds

def point_rows(index: DataFrame, clouds: DataFrame, default_scale: float = 4.0) -> DataFrame:
    """Points of every indexed cloud. ``index``: image, atoms_json, out_scale; ``clouds``: file, text (JSON list of x, y).

    The scale is the first non-null one of the image's rows, else the default.
    """
    i = index.groupBy("image").agg(F.first("atoms_json", ignorenulls=True).alias("file"), F.coalesce(F.first("out_scale", ignorenulls=True), F.lit(default_scale)).alias("out_scale"))
    p = clouds.select("file", F.posexplode(F.from_json("text", "array<struct<x:double,y:double>>")).alias("pt_id", "p"))
    return i.join(p, "file").select("image", "out_scale", "pt_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def point_cloud_json(points: DataFrame, keys: list[str], chunk: int = 100_000) -> DataFrame:
    """JSON text of each cloud in chunks of bounded length, with the number of points per chunk."""
    d = points.withColumn("chunk", F.floor(F.col("pt_id") / chunk))
    g = d.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("pt_id", "x", "y"))).alias("s"))
    return g.select(*keys, "chunk", F.size("s").alias("n_points"), F.to_json(F.transform("s", lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y")))).alias("text"))


# ---------------------------------------------------------------- checksums and audit

def verify_checksums(content: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status per expected artifact: ok, mismatch, missing or no_url. ``content``: path, content; ``manifest``: path, sha256, url."""
    have = content.select("path", F.sha2("content", 256).alias("actual"))
    j = manifest.join(have, "path", "left")
    s = F.when(F.col("actual") == F.lower("sha256"), "ok").when(F.col("actual").isNotNull(), "mismatch").when(F.coalesce(F.col("url"), F.lit("")) == "", "no_url").otherwise("missing")
    return j.select("path", s.alias("status"))


def audit(files: DataFrame, marker: str, allowed: list[str], config_glob: str = r"^configs/.*\.ya?ml$", reference: str = "models/checkpoints/") -> DataFrame:
    """Problem rows of a release listing (``rel, length, text``): one filter per rule.

    forbidden_dir, large_file, forbidden_suffix, local_path, foreign_checkpoint.
    """
    parts = F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1)
    bad_dir = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in FORBIDDEN_DIRS]))
    pieces = F.split(base_name(F.col("rel")), r"\.")
    suffixes = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda s: F.lower(s))
    bad_suffix = F.arrays_overlap(suffixes, F.array(*[F.lit(x) for x in FORBIDDEN_SUFFIXES]))
    rest = F.col("text")
    for a in allowed:
        rest = F.replace(rest, F.lit(a), F.lit(""))
    rules = [
        ("forbidden_dir", bad_dir, dir_name(F.col("rel"))), ("large_file", F.col("length") > MAX_BYTES, F.col("rel")), ("forbidden_suffix", bad_suffix, F.col("rel")),
        ("local_path", F.col("text").contains(marker), F.col("rel")), ("foreign_checkpoint", F.col("rel").rlike(config_glob) & rest.contains(reference), F.col("rel")),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), what.alias("what"))) for name, cond, what in rules]))
    return files.select("rel", F.explode(found).alias("p")).select("rel", "p.rule", "p.what")
