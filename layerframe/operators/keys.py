"""Keys and filters on paths, file names and text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..iterate import global_order

# Name patterns and defaults that file-producing tools agree on.
SIZE_IN_NAME = r"[-_]\s*([0-9]+(?:\.[0-9]+)?)\s*[xX×]\s*([0-9]+(?:\.[0-9]+)?)"
SIZE_AT_END = r"_([0-9]+(?:\.[0-9]+)?)x([0-9]+(?:\.[0-9]+)?)$"
SIZE_AT_END_BLANKS = r"_([0-9]+(?:\.[0-9]+)?)x([0-9]+(?:\.[0-9]+)?)\s*$"
SIZE_ANYWHERE = r"([0-9]+\.?[0-9]*)\s*[xX×]\s*([0-9]+\.?[0-9]*)"
STACK_PARAMS = r"^([-+]?[0-9]+(?:\.[0-9]+)?)_([-+]?[0-9]+(?:\.[0-9]+)?)_([-+]?[0-9]+(?:\.[0-9]+)?)_([-+]?[0-9]+(?:\.[0-9]+)?)_"
DEFAULT_SIDE_ANGSTROM = 27.9
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "tif", "tiff", "bmp"]
DEFAULT_EXCLUDES = ["result", "result_*", "step_*"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(name: Column) -> Column:
    """Without the last extension (a leading dot is not one)."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def _pair(s: Column, pattern: str) -> Column:
    w = F.regexp_extract(s, pattern, 1).try_cast("double")
    h = F.regexp_extract(s, pattern, 2).try_cast("double")
    return F.when((w > 0) & (h > 0), F.struct(w.alias("w"), h.alias("h")))


def size_tag(path: Column, dialect: str = "name") -> Column:
    """Physical size (w, h) in nm from a path; null when there is none.

    ``name``: first ``[-_]W×H`` of the base name. ``parents``: ``_WxH`` at the end of the parent, else the
    grand-parent folder. ``folder``: at the end of the base name, blanks allowed. ``anywhere``: in the base
    name, else in the parent folder.
    """
    b, parent = base_name(path), base_name(dir_name(path))
    if dialect == "name":
        return _pair(b, SIZE_IN_NAME)
    if dialect == "parents":
        return F.coalesce(_pair(parent, SIZE_AT_END), _pair(base_name(dir_name(dir_name(path))), SIZE_AT_END))
    if dialect == "folder":
        return _pair(b, SIZE_AT_END_BLANKS)
    if dialect == "anywhere":
        return F.coalesce(_pair(b, SIZE_ANYWHERE), _pair(parent, SIZE_ANYWHERE))
    raise ValueError(f"unknown dialect {dialect}")


def side_angstrom(tag: Column, fallback: float = DEFAULT_SIDE_ANGSTROM) -> Column:
    """Field-of-view side: 10·(w+h)/2, or the fallback."""
    return F.coalesce((tag["w"] + tag["h"]) * 0.5 * 10.0, F.lit(fallback))


def stack_key(name: Column, layers: int = 2) -> Column:
    """Stacking key of a file name, '' when it does not match: ``x{}_y{}_rot{}_flip{}`` or the raw four numbers."""
    g = [F.regexp_extract(name, STACK_PARAMS, i) for i in (1, 2, 3, 4)]
    made = F.concat(F.lit("x"), g[0], F.lit("_y"), g[1], F.lit("_rot"), g[2], F.lit("_flip"), g[3]) if layers == 2 else F.concat_ws("_", *g)
    return F.when(g[0] == "", "").otherwise(made)


def request_key(raw: Column, layers: int = 2) -> Column:
    """Key of a requested stack; null unless it has exactly four parts."""
    p = F.split(raw, "_")
    made = F.concat(F.lit("x"), p[0], F.lit("_y"), p[1], F.lit("_rot"), p[2], F.lit("_flip"), p[3]) if layers == 2 else raw
    return F.when(F.size(p) == 4, made)


def latest_per_key(files: DataFrame, layers: int = 2) -> DataFrame:
    """One file per (layer, key): of colliding keys the last path stays."""
    d = files.withColumn("key", stack_key(base_name(F.col("path")), layers)).filter("key <> ''")
    return d.groupBy("layer", "key").agg(F.max("path").alias("path"))


def unmatched_names(files: DataFrame) -> DataFrame:
    return files.filter(stack_key(base_name(F.col("path"))) == "").select("path")


def key_variants(path: Column) -> Column:
    """Lookup variants of a path in order of preference: path, without extension, base name, base stem."""
    b = base_name(path)
    return F.array(*[F.struct(F.lit(i).alias("rank"), k.alias("k")) for i, k in enumerate((path, stem(path), b, stem(b)))])


def resolve_selection(selected: DataFrame, files: DataFrame) -> DataFrame:
    """Files named by a selection list (any variant of either side); ``(path, selected)``."""
    s = selected.select(F.col("name").alias("selected"), F.explode(key_variants(F.regexp_replace("name", r"\\", "/"))).alias("v"))
    f = files.select("path", F.explode(key_variants(F.col("path"))).alias("v"))
    return s.select("selected", "v.k").distinct().join(f.select("path", "v.k").distinct(), "k").groupBy("path").agg(F.min("selected").alias("selected"))


def missing_selection(selected: DataFrame, files: DataFrame) -> DataFrame:
    """Selection entries that name no file."""
    hit = resolve_all(selected, files).select("name")
    return selected.join(hit, "name", "left_anti")


def resolve_all(selected: DataFrame, files: DataFrame) -> DataFrame:
    s = selected.select("name", F.explode(key_variants(F.regexp_replace("name", r"\\", "/"))).alias("v")).select("name", "v.k").distinct()
    f = files.select("path", F.explode(key_variants(F.col("path"))).alias("v")).select("path", "v.k").distinct()
    return s.join(f, "k").select("name", "path").distinct()


def lookup_plan(images: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan of each image by the best-ranked key variant; of equal base names the first plan (by ``ord``) holds the name."""
    p = plans.select("plan_id", "ord", F.explode(key_variants(F.col("path"))).alias("v"))
    # full paths are unique, later plans overwrite; shared base names keep the first
    table = p.groupBy(F.col("v.k").alias("k")).agg(
        F.min_by("plan_id", F.when(F.col("v.rank") >= 2, F.col("ord")).otherwise(-F.col("ord") - 1)).alias("plan_id"))
    i = images.select("path", F.explode(key_variants(F.col("path"))).alias("v")).select("path", "v.rank", "v.k")
    # variants are laid out from names that are small as files: never a broadcast by file size
    hit = i.join(table.hint("merge"), "k").groupBy("path").agg(F.min_by("plan_id", "rank").alias("plan_id"))
    return images.select("path").join(hit.hint("merge"), "path", "left")


def pair_layers(files: DataFrame, by_base: bool = False) -> DataFrame:
    """Layer pair per folder (or per folder and base): first ``*_0.png`` and ``*_1.png``, with a reason when one is missing."""
    b = base_name(F.col("path"))
    d = files.select(dir_name(F.col("path")).alias("folder"), b.alias("name")).filter(F.col("name").rlike(r"_[01]\.png$"))
    keys = ["folder"]
    if by_base:
        d = d.withColumn("base", F.regexp_replace("name", r"_[01]\.png$", ""))
        keys.append("base")
    zero = F.col("name").endswith("_0.png")
    out = d.groupBy(*keys).agg(F.min(F.when(zero, F.col("name"))).alias("img0"), F.min(F.when(~zero, F.col("name"))).alias("img1"))
    if not by_base:
        folders = files.select(dir_name(F.col("path")).alias("folder")).distinct()
        out = folders.join(out, "folder", "left")
    return out.withColumn("reason", F.when(F.col("img0").isNull() | F.col("img1").isNull(), "missing__0_or__1").otherwise(""))


def image_id(path: Column) -> Column:
    """Stable id: first 10 hex digits of sha1(path), then the stem."""
    return F.concat(F.substring(F.sha1(path.cast("binary")), 1, 10), F.lit("_"), stem(base_name(path)))


def parse_vector(text: Column) -> Column:
    """``[x, y]`` text -> struct; blank, invalid, wrong length or non-finite -> null."""
    a = F.from_json(text, "array<double>")
    x, y = F.get(a, 0), F.get(a, 1)
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))  # false for NaN as well: it sorts above infinity
    return F.when((F.size(a) == 2) & finite, F.struct(x.alias("x"), y.alias("y")))


def class_ids(files: DataFrame, name: str = "name") -> DataFrame:
    """Class number = rank of the file-name prefix before ``_`` among the sorted distinct prefixes."""
    d = files.withColumn("prefix", F.element_at(F.split(F.col(name), "_"), 1))
    ids = global_order(d.select("prefix").distinct(), ["prefix"], "class_id")
    return d.join(ids, "prefix")


def shard(rows: DataFrame, order: list[str], n: int, which: int) -> DataFrame:
    """Every n-th row of the ordered list, starting at ``which``."""
    return global_order(rows, order).filter(F.col("rn") % n == which)


def shard_number(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return global_order(rows, order).withColumn("shard", (F.col("rn") % n).cast("int"))


def numeric_sort(files: DataFrame, name: str = "name") -> DataFrame:
    """Files with the number that their stem holds, ``num``, and their place in that order, ``pos``; names without a number come first."""
    return global_order(files.withColumn("num", stem(F.col(name)).try_cast("bigint")), ["num", name], "pos")


def resume_steps(files: DataFrame, ema_rate: str = "0.9999") -> DataFrame:
    """Step of each ``…modelNNNNNN.pt`` checkpoint (0 when the name holds none) and its EMA companion if present.

    Steps have six digits at least; longer ones are written whole.
    """
    step = F.coalesce(F.regexp_extract("path", r"model([0-9]+)\.[^/]*$", 1).try_cast("bigint"), F.lit(0))
    m = files.filter(F.col("path").rlike(r"model[^/]*\.pt$")).withColumn("step", step)
    m = m.withColumn("ema_path", F.concat(dir_name(F.col("path")), F.lit("/ema_" + ema_rate + "_"), F.format_string("%06d", "step"), F.lit(".pt")))
    have = files.select(F.col("path").alias("ema_path"), F.lit(True).alias("has_ema"))
    return m.join(have, "ema_path", "left").withColumn("has_ema", F.coalesce("has_ema", F.lit(False)))


def latest_checkpoint(files: DataFrame) -> DataFrame:
    return resume_steps(files).groupBy(dir_name(F.col("path")).alias("folder")).agg(F.max("step").alias("step"), F.max_by("path", "step").alias("path"))


def train_batches(rows: DataFrame, order: list[str], batch: int) -> DataFrame:
    """Deterministic batches of ``batch`` rows; the incomplete last one is dropped."""
    d = global_order(rows, order).withColumn("batch", F.floor(F.col("rn") / batch))
    full = d.groupBy("batch").agg(F.count("*").alias("_n")).filter(F.col("_n") == batch).select("batch")
    return d.join(full, "batch", "left_semi")


def mask_pairs(images: DataFrame, masks: DataFrame, modes: tuple[str, ...] = ("L", "RGB", "RGBA")) -> DataFrame:
    """Image/mask pairs with a reject reason: both present, allowed mode, equal size. Images carry a stem."""
    m = masks.select("stem", F.col("h").alias("mh"), F.col("w").alias("mw"))
    d = images.join(m, "stem", "left")
    reason = (
        F.when(F.col("mh").isNull(), "mask_not_found").when(~F.col("mode").isin(*modes), "unsupported_mode")
        .when((F.col("h") != F.col("mh")) | (F.col("w") != F.col("mw")), "size_mismatch")
    )
    return d.withColumn("reason", reason)
