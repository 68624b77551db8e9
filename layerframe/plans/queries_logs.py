"""Queries: evaluation and logs (I), structure variants (G), sources and audits (A), streams (J)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..iterate import checkpoint_dir
from ..operators import evallog as E
from ..operators import variants as V
from ..operators.augment import draw_parameters
from ..sources import configs as CF
from ..sources import files as FS
from ..sources import tables as TB
from ..streaming import streams as ST
from . import standins as T
from .queries_tables import rounded
from .registry import query

# ---------------------------------------------------------------- I: scores


def scores(spark, d):
    """Pixels with three logits and a label: one per document that has a label."""
    j = T.table(spark, d, "labels").join(T.table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    z = F.array(F.lit(0.5), F.col("n_chars") % 100 / 50.0, F.col("n_chars") % 7 / 4.0)
    return j.select((F.col("doc_id") % 5).alias("batch"), (F.col("doc_id") % 2).alias("epoch"), F.col("doc_id").alias("pixel"), F.transform(z, lambda v: v.cast("double")).alias("logits"),
                    (F.col("quality") + F.when(F.col("toxic") == 1, 1).otherwise(0)).cast("int").alias("label"))


SCO = """sco AS (SELECT l.doc_id % 5 AS batch, l.doc_id % 2 AS epoch, l.doc_id AS pixel, 0.5::DOUBLE AS z0, n_chars % 100 / 50.0::DOUBLE AS z1, n_chars % 7 / 4.0::DOUBLE AS z2, quality + CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
pr AS (SELECT *, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS pred FROM sco)"""


@query("i01_argmax_class", f"WITH {SCO} SELECT pixel, pred FROM pr")
def argmax_class(spark, d):
    return scores(spark, d).select("pixel", E.argmax_class(F.col("logits")).alias("pred"))


DI = f"""{SCO}, cl AS (SELECT batch, c, sum(CASE WHEN pred=c AND label=c THEN 1 ELSE 0 END) AS i, sum(CASE WHEN pred=c THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label=c THEN 1 ELSE 0 END) AS t FROM pr, (SELECT unnest([1,2]) AS c) GROUP BY ALL),
di AS (SELECT batch, avg((2.0*i+1)/(p+t+1)) AS dice, coalesce(avg(CASE WHEN p+t-i > 0 THEN (i+1.0)/(p+t-i+1) END), 0) AS iou FROM cl GROUP BY batch)"""


def _pred(spark, d):
    return scores(spark, d).withColumn("pred", E.argmax_class(F.col("logits")))


@query("i02_dice_iou", f"WITH {DI} SELECT batch, round(dice,6) AS dice, round(iou,6) AS iou FROM di")
def dice_iou(spark, d):
    return rounded(E.dice_iou(_pred(spark, d), ["batch"], 3))


@query("i03_losses", f"""WITH {SCO}, s AS (SELECT *, ln(exp(z0)+exp(z1)+exp(z2)) AS l FROM sco), q AS (SELECT *, exp(z0-l) AS p0, exp(z1-l) AS p1, exp(z2-l) AS p2, CASE label WHEN 0 THEN z0-l WHEN 1 THEN z1-l ELSE z2-l END AS lt, CASE label WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.3 END AS w FROM s),
g AS (SELECT batch, avg(-power(1-exp(lt),3)*lt) AS focal, -sum(w*lt)/sum(w) AS ce, 1-((2*sum(CASE WHEN label=0 THEN p0 ELSE 0 END)+1)/(sum(p0)+count(*) FILTER (label=0)+1+1e-7)+(2*sum(CASE WHEN label=1 THEN p1 ELSE 0 END)+1)/(sum(p1)+count(*) FILTER (label=1)+1+1e-7)+(2*sum(CASE WHEN label=2 THEN p2 ELSE 0 END)+1)/(sum(p2)+count(*) FILTER (label=2)+1+1e-7))/3 AS dl FROM q GROUP BY batch)
SELECT batch, round(dl,6) AS dice_loss, round(focal,6) AS focal, round(ce,6) AS cross_entropy, round(dl+focal,6) AS combined FROM g""")
def losses(spark, d):
    return rounded(E.losses(scores(spark, d), ["batch"], 3, weight=[0.2, 0.5, 0.3]))


@query("i04_epoch_metrics", f"""WITH {SCO}, cl AS (SELECT epoch, batch, c, sum(CASE WHEN pred=c AND label=c THEN 1 ELSE 0 END) AS i, sum(CASE WHEN pred=c THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label=c THEN 1 ELSE 0 END) AS t FROM pr, (SELECT unnest([1,2]) AS c) GROUP BY ALL),
di AS (SELECT epoch, batch, avg((2.0*i+1)/(p+t+1)) AS dice, coalesce(avg(CASE WHEN p+t-i > 0 THEN (i+1.0)/(p+t-i+1) END), 0) AS iou FROM cl GROUP BY ALL) SELECT epoch, round(avg(dice),6) AS dice, round(avg(iou),6) AS iou FROM di GROUP BY epoch""")
def epoch_metrics(spark, d):
    return rounded(E.epoch_metrics(E.dice_iou(_pred(spark, d), ["epoch", "batch"], 3), ["epoch"], ["dice", "iou"]))


def runs(spark, d):
    """One score per run and epoch: orders of a customer in key order."""
    o = T.table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 200).alias("run"), F.col("o_orderkey").alias("epoch"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"))


RUN = "ru AS (SELECT o_custkey % 200 AS run, o_orderkey AS epoch, floor(o_totalprice / 1000)::DOUBLE AS score FROM orders)"


@query("i05_kept_checkpoints", f"WITH {RUN}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) AS rank FROM ru) SELECT run, epoch, score, rank, rank = 1 AS is_best FROM k WHERE rank <= 3")
def kept_checkpoints(spark, d):
    return E.keep_best(runs(spark, d), ["run"], "score", 3)


@query("i06_early_stop", f"""WITH {RUN}, b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM ru),
l AS (SELECT *, max(CASE WHEN pb IS NULL OR score > pb THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM b) SELECT run, min(CASE WHEN n - last >= 20 THEN epoch END) AS stop_epoch, max(score) AS best FROM l GROUP BY run""")
def early_stop(spark, d):
    return E.early_stop(runs(spark, d), ["run"], "score", 20)


@query("i07_log_dumps", f"WITH {T.LOG} SELECT run, step // 1000 AS dump, key, round(avg(value),6) AS mean_value, round(arg_max(value, step),6) AS last_value, count(*) AS n FROM log GROUP BY ALL")
def log_dumps(spark, d):
    g = T.log(spark, d)
    return rounded(E.dump_mean(g, 1000).withColumnRenamed("value", "mean_value").join(E.dump_last(g, 1000).withColumnRenamed("value", "last_value"), ["run", "dump", "key"]))


@query("i08_weighted_mean", f"WITH {T.LOG} SELECT key, round(sum(value * (step % 9 + 1)) / sum(step % 9 + 1), 6) AS value, sum(step % 9 + 1)::BIGINT AS cnt FROM log WHERE run % 7 <> 0 GROUP BY key")
def weighted_mean(spark, d):
    g = T.log(spark, d)
    v = g.select("key", F.when(F.col("run") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"), (F.col("step") % 9 + 1).alias("cnt"))
    return rounded(E.weighted_mean(v, ["key"]))


@query("i09_i10_i13_loss_quartiles", "SELECT event_id AS step, floor(4 * (event_id % 1000) / 1000.0)::BIGINT AS quartile, round(0.0001 * (1 - event_id / 200000.0), 12) AS lr, (event_id + 10 + 1) * 16 AS samples FROM events")
def loss_quartiles(spark, d):
    e = T.table(spark, d, "events")
    return e.select(F.col("event_id").alias("step"), E.loss_quartile(F.col("event_id") % 1000, 1000).alias("quartile"), F.round(E.linear_lr(1e-4, F.col("event_id"), 200000), 12).alias("lr"),
                    E.samples_seen(F.col("event_id"), 10, 16).alias("samples"))


@query("i11_i12_timestep_weights", """WITH l AS (SELECT event_type AS run, user_id % 8 AS t, event_id AS seq, value AS loss FROM events), h AS (SELECT *, row_number() OVER (PARTITION BY run, t ORDER BY seq DESC) AS r FROM l),
g AS (SELECT run, t, sqrt(avg(loss*loss)) AS m, count(*) AS c FROM h WHERE r <= 10 GROUP BY ALL), s AS (SELECT run, sum(m) AS s, count(*) FILTER (c >= 10) = 8 AS warm FROM g GROUP BY run),
f AS (SELECT run, t FROM (SELECT DISTINCT run FROM l), (SELECT unnest(generate_series(0, 7)) AS t)), w AS (SELECT f.run, f.t, CASE WHEN warm THEN m/s*0.999+0.001/8 ELSE 1.0 END AS weight FROM f LEFT JOIN g ON g.run=f.run AND g.t=f.t JOIN s ON s.run=f.run)
SELECT run, t, round(weight,6) AS weight, round(weight/sum(weight) OVER (PARTITION BY run),6) AS p, round(1/(8*(weight/sum(weight) OVER (PARTITION BY run))),6) AS loss_weight FROM w""")
def timestep_weights(spark, d):
    l = T.table(spark, d, "events").select(F.col("event_type").alias("run"), (F.col("user_id") % 8).alias("t"), F.col("event_id").alias("seq"), F.col("value").alias("loss"))
    return rounded(E.importance_probabilities(E.timestep_weights(l, ["run"], 8), ["run"]))


# ---------------------------------------------------------------- G: variants

@query("g01_g08_weighted_draw", """WITH it AS (SELECT o_orderpriority AS name, row_number() OVER (ORDER BY o_orderpriority) AS ord, count(*)::DOUBLE AS weight FROM orders GROUP BY 1), iv AS (SELECT *, sum(weight) OVER (ORDER BY ord) AS hi, sum(weight) OVER () AS total FROM it),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey * 7 + l_linenumber) % 1000 / 1000.0::DOUBLE AS m FROM lineitem), d AS (SELECT r.*, (SELECT min(ord) FROM iv WHERE m * total <= hi) AS ord FROM r)
SELECT it.name AS defect_preset, count(*) AS n FROM d JOIN it ON it.ord = d.ord GROUP BY 1""")
def weighted_draw(spark, d):
    o = T.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").cast("double").alias("weight")).withColumn("material", F.lit("m"))
    from pyspark.sql import Window

    items = o.withColumn("ord", F.row_number().over(Window.partitionBy("material").orderBy("name")))  # five presets
    rows = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("m").alias("material"))
    drawn = V.weighted_draw(rows, items, ["material"], (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000 / 1000.0)
    return V.preset_counts(drawn.withColumnRenamed("name", "defect_preset"), ["material"]).drop("material")


def _atoms(spark, d):
    """One structure per label: atoms are the label's embeddings in a 40 × 30 × 6 cell."""
    e = T.table(spark, d, "embeddings")
    x = lambda i, s: (F.col("embedding")[i].cast("double") + 0.5) * s
    sym = F.when(F.col("vec_id") % 3 == 0, "Re").when(F.col("vec_id") % 3 == 1, "S").otherwise("Xx")
    return e.select(F.col("label").alias("structure"), F.col("vec_id").alias("atom_id"), sym.alias("symbol"), x(0, 40).alias("x"), x(1, 30).alias("y"), x(2, 6).alias("z"))


ATM = """atm AS (SELECT label AS structure, vec_id AS atom_id, CASE vec_id % 3 WHEN 0 THEN 'Re' WHEN 1 THEN 'S' ELSE 'Xx' END AS symbol, (CAST(embedding[1] AS DOUBLE)+0.5)*40 AS x, (CAST(embedding[2] AS DOUBLE)+0.5)*30 AS y, (CAST(embedding[3] AS DOUBLE)+0.5)*6 AS z FROM embeddings)"""


@query("g02_g03_displaced_and_defective", f"""WITH {ATM} SELECT structure, symbol, count(*) AS n, round(avg(x + 0.1::DOUBLE * {T.normal(5, "structure", "atom_id")}), 6) AS mean_x, round(avg(z + 0.1::DOUBLE * {T.normal(7, "structure", "atom_id")}), 6) AS mean_z FROM atm
WHERE symbol <> 'S' OR {T.uniform(6, "structure", "atom_id")} >= 0.2::DOUBLE GROUP BY structure, symbol""")
def displaced(spark, d):
    a = V.thermal(_atoms(spark, d), F.lit(0.1), 5, ["structure", "atom_id"])
    a = V.vacancies(a, F.create_map(F.lit("S"), F.lit(0.2)), 6, ["structure", "atom_id"])
    return rounded(a.groupBy("structure", "symbol").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("z").alias("mean_z")))


@query("g04_stacked_layers", f"""WITH {ATM}, sw AS (SELECT i*0.1::DOUBLE AS mx, j*0.1::DOUBLE AS my, l AS layer FROM (SELECT unnest([-32, 0]) AS i), (SELECT unnest([-28, 0]) AS j), (SELECT unnest([1, 2]) AS l))
SELECT structure, layer, count(*) AS n, round(sum(x + CASE WHEN layer=2 THEN mx ELSE 0 END),4) AS sx, round(sum(y + CASE WHEN layer=2 THEN my ELSE 0 END),4) AS sy, round(sum(z + CASE WHEN layer=2 THEN 0.67 ELSE 0 END),4) AS sz FROM atm, sw GROUP BY ALL""")
def stacked_layers(spark, d):
    a = _atoms(spark, d)
    s = a.select("structure").distinct().withColumns({"ccx": F.lit(20.0), "ccy": F.lit(15.0), "ccz": F.lit(3.0)})
    st = V.stack_layers(a, V.bilayer_sweep(s, (-32, 32, 32), (-28, 28, 28)), ["structure"])
    return rounded(st.groupBy("structure", "layer").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("z").alias("sz")), 4)


@query("g04_twisted_layers", f"""WITH {ATM}, sw AS (SELECT a AS angle, f AS flip, l AS layer FROM (SELECT unnest([0, 60]) AS a), (SELECT unnest([false, true]) AS f), (SELECT unnest([1, 2]) AS l)),
r AS (SELECT structure, atom_id, layer, angle, flip, CASE WHEN layer = 2 THEN radians(angle::DOUBLE) ELSE 0.0 END AS a, layer = 2 AND flip AS fl, x - 20.0 AS dx, y - 15.0 AS dy, z + CASE WHEN layer = 2 THEN 6.7 ELSE 0 END AS z FROM atm, sw),
t AS (SELECT *, cos(a) * dx - sin(a) * dy + 20.0 AS tx, sin(a) * dx + cos(a) * dy + 15.0 AS ty FROM r)
SELECT structure, '0_0_' || angle || '.0_' || flip::INT AS sweep_id, layer, count(*) AS n, round(sum((atom_id % 13) * CASE WHEN fl THEN 40.0 - tx ELSE tx END), 4) AS sx, round(sum((atom_id % 13) * ty), 4) AS sy, round(sum((atom_id % 13) * CASE WHEN fl THEN 6.0 - z ELSE z END), 4) AS sz FROM t GROUP BY ALL""")
def twisted_layers(spark, d):
    a = _atoms(spark, d)
    s = a.select("structure").distinct().withColumns({"ccx": F.lit(20.0), "ccy": F.lit(15.0), "ccz": F.lit(3.0)})
    st = V.stack_layers(a, V.twist_sweep(s, (0.0, 60.0), (False, True)), ["structure"]).withColumn("w", F.col("atom_id") % 13)
    return rounded(st.groupBy("structure", "sweep_id", "layer").agg(F.count("*").alias("n"), *[F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in "xyz"]), 4)


@query("g04_trilayers", f"""WITH {ATM}, sw AS (SELECT ax, bx, ax * 0.5::DOUBLE AS ay, bx * -1.0::DOUBLE AS yb, l AS layer FROM (SELECT unnest([0.0::DOUBLE, 1.5]) AS ax), (SELECT unnest([-0.5::DOUBLE, 2.0]) AS bx), (SELECT unnest([1, 2, 3]) AS l))
SELECT structure, layer, count(*) AS n, round(sum(x + CASE layer WHEN 2 THEN ax WHEN 3 THEN bx + 0.5 * ax ELSE 0 END), 4) AS sx, round(sum(y + CASE layer WHEN 2 THEN ay WHEN 3 THEN yb + 0.5 * ay ELSE 0 END), 4) AS sy, round(sum(z + CASE layer WHEN 2 THEN 7.0 WHEN 3 THEN 14.0 ELSE 0 END), 4) AS sz FROM atm, sw GROUP BY ALL""")
def trilayers(spark, d):
    a = _atoms(spark, d)
    s = a.select("structure").distinct().withColumns({"ccx": F.lit(20.0), "ccy": F.lit(15.0), "ccz": F.lit(3.0)})
    st = V.stack_layers(a, V.trilayer_sweep(s, [(0.0, 0.0), (1.5, 0.75)], [(-0.5, 0.5), (2.0, -2.0)]), ["structure"])
    return rounded(st.groupBy("structure", "layer").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("z").alias("sz")), 4)


@query("g05_composition", f"WITH {ATM} SELECT structure, symbol, count(*) AS n, min(atom_id) AS first_id FROM atm GROUP BY ALL")
def composition(spark, d):
    return V.composition(_atoms(spark, d), ["structure"])


@query("g05_simulator_lines", f"""WITH {ATM}, c AS (SELECT structure, symbol, count(*) AS n, min(atom_id) AS f FROM atm GROUP BY ALL) SELECT structure, count(*) AS lines, max(CASE WHEN line_no = -2 THEN line END) AS header, sum(length(line)) FILTER (line_no < 0)::BIGINT AS head_chars FROM (
 SELECT structure, -2 AS line_no, string_agg(symbol || n, '' ORDER BY f) || chr(9) || sum(n)::BIGINT AS line FROM c GROUP BY structure UNION ALL SELECT DISTINCT structure, -1, '40.0' || chr(9) || '30.0' || chr(9) || '6.0' FROM atm
 UNION ALL SELECT structure, atom_id, 'a' FROM atm WHERE symbol = 'Re' UNION ALL SELECT DISTINCT structure, 999999999, '-1' FROM atm) GROUP BY structure""")
def simulator_lines(spark, d):
    a = _atoms(spark, d)
    cells = a.select("structure").distinct().withColumns({"lx": F.lit(40.0), "ly": F.lit(30.0), "lz": F.lit(6.0)})
    ln = V.simulator_lines(a, cells, ["structure"], ["S", "Xx"])
    return ln.groupBy("structure").agg(F.count("*").alias("lines"), F.max(F.when(F.col("line_no") == -2, F.col("line"))).alias("header"), F.sum(F.when(F.col("line_no") < 0, F.length("line"))).alias("head_chars"))


@query("g05_unknown_symbols", f"WITH {ATM} SELECT DISTINCT structure, symbol, 'unknown_symbol' AS problem FROM atm WHERE symbol = 'Xx'")
def unknown_symbols(spark, d):
    return V.unknown_symbols(_atoms(spark, d), ["structure"])


@query("g06_parameter_grid", "SELECT p_partkey, i, j, round(35.0 + i * 2.0, 6) AS defocus, round(0.6 + j * 0.02, 6) AS source_size, 11 AS n_lines FROM part, (SELECT unnest(generate_series(0, 4)) AS i), (SELECT unnest(generate_series(0, 4)) AS j)")
def parameter_grid(spark, d):
    g = V.parameter_grid(T.table(spark, d, "part").select("p_partkey", "p_size"))
    t = V.parameter_text(F.lit("a.xyz"), F.lit("a.tif"), F.lit(512), F.lit(512), F.col("defocus"), F.col("source_size"))
    return g.select("p_partkey", "i", "j", r6(F.col("defocus")).alias("defocus"), r6(F.col("source_size")).alias("source_size"), (F.size(F.split(t, "\n")) - 1).alias("n_lines"))


@query("g07_label_raster", f"""WITH {ATM}, p AS (SELECT structure, floor(x/0.5::DOUBLE)::INT+1 AS px, floor(y/0.5::DOUBLE)::INT+1 AS py FROM atm WHERE symbol='Re'), o AS (SELECT i, j FROM (SELECT unnest(generate_series(-2,2)) AS i), (SELECT unnest(generate_series(-2,2)) AS j) WHERE i*i+j*j <= 4)
SELECT structure, count(*) AS n FROM (SELECT DISTINCT structure, px+i AS x, py+j AS y FROM p, o WHERE px+i BETWEEN 0 AND 79 AND py+j BETWEEN 0 AND 59) GROUP BY structure""")
def label_raster(spark, d):
    a = _atoms(spark, d).withColumn("layer", F.lit(0))
    cells = a.select("structure").distinct().withColumns({"lx": F.lit(40.0), "ly": F.lit(30.0)})
    return V.label_raster(a, cells, ["structure"], 60, 2).groupBy("structure").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- A: sources, sinks, audits

def _listing(spark, d):
    """Listing built from part and page rows: nested paths with mixed extensions."""
    p = T.table(spark, d, "part")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("PNG", "tif", "txt", "jpg", "pt")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(x) for x in ("in", "result", "result_a", "step_1", "tmp")]), (F.col("p_size") % 5 + 1).cast("int"))
    return p.select("p_partkey", F.concat(F.lit("a/"), top, F.lit("/"), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("rel"), (F.col("p_partkey") * 20000).alias("length"), F.concat("p_type", F.lit(" /local/root")).alias("text"))


LST = """ls AS (SELECT p_partkey, 'a/' || ['in','result','result_a','step_1','tmp'][p_size % 5 + 1] || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.' || ['PNG','tif','txt','jpg','pt'][p_partkey % 5 + 1] AS rel, p_partkey * 20000 AS length FROM part)"""


@query("a01_a02_image_listing", f"WITH {LST} SELECT p_partkey, rel FROM ls WHERE regexp_matches(lower(rel), '\\.(png|tif|jpg)$') AND split_part(rel, '/', 2) IN ('in', 'tmp')")
def image_listing(spark, d):
    return FS.filter_listing(_listing(spark, d), exclude_dirs=FS.derive_excludes(None)).select("p_partkey", "rel")


@query("a05_xyz_structures", "SELECT label AS structure, count(*) AS n, 9 AS lattice_len, round(sum(round(CAST(embedding[1] AS DOUBLE)*40,6)),4) AS sx FROM embeddings GROUP BY label")
def xyz_structures(spark, d):
    e = T.table(spark, d, "embeddings")
    line = F.format_string("Re      %.6f       %.6f       %.6f", *[F.col("embedding")[i].cast("double") * 40 for i in range(3)])
    g = e.groupBy(F.col("label").cast("string").alias("structure")).agg(F.collect_list(line).alias("l"))  # one text per file, as read from disk
    text = F.concat_ws("\n", F.size("l").cast("string"), F.lit('Lattice="1.0 0 0 0 1.0 0 0 0 1.0" Properties=species:S:1:pos:R:3 pbc="F F F"'), F.concat_ws("\n", "l"))
    atoms, cells = FS.parse_xyz(g.select("structure", text.alias("text")))
    s = atoms.groupBy("structure").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"))
    return s.join(cells.select("structure", F.size("lattice").alias("lattice_len")), "structure").select(F.col("structure").cast("int").alias("structure"), "n", "lattice_len", "sx")


@query("a05_xyz_files", """SELECT doc_id % 8 AS structure, count(*) AS n, 9 AS lattice_len, count(*)::INT AS header_n, round(sum(n_chars / 8.0::DOUBLE), 4) AS sx, sum((pos - 1) * (n_chars % 7))::BIGINT AS order_sum
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS pos FROM documents) GROUP BY 1""")
def xyz_files(spark, d):
    """Eight structure files with an atom per document, written as text and read back line by line."""
    docs = T.table(spark, d, "documents").select((F.col("doc_id") % 8).alias("part"), "doc_id", "n_chars")
    atom = F.format_string("Re %.6f %.6f %.1f", F.col("n_chars") / 8.0, (F.col("n_chars") % 7).cast("double"), F.col("part").cast("double"))
    cell = F.lit('\nLattice="1.0 0 0 0 1.0 0 0 0 1.0" pbc="F F F"')
    head = docs.groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit(-1).cast("bigint").alias("doc_id"), F.concat(F.col("n").cast("string"), cell).alias("value"))
    path = _scratch(spark)
    rows = head.unionByName(docs.select("part", "doc_id", atom.alias("value")))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    atoms, cells = FS.read_xyz(spark, path, files=True)
    # files are named by the writer; the third coordinate tells which one it is
    s = atoms.groupBy("file").agg(F.max("z").cast("bigint").alias("part"), F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.sum(F.col("atom_id") * F.col("y")).cast("bigint").alias("order_sum"))
    return s.join(cells.select("file", F.size("lattice").alias("lattice_len"), F.col("n").alias("header_n")), "file").select(F.col("part").alias("structure"), "n", "lattice_len", "header_n", "sx", "order_sum")


@query("a06_source_configs", "SELECT p_partkey::VARCHAR AS path, 1 AS n_thermal, CASE WHEN p_size % 4 = 0 THEN 'negative preset weight' ELSE '' END AS problem, p_size % 3 = 0 AS legacy FROM part")
def source_configs(spark, d):
    p = T.table(spark, d, "part")
    th = F.element_at(F.array(F.lit("0.1"), F.lit("[0.1]"), F.lit('[{"value": 0.1, "weight": 2.0}]')), (F.col("p_partkey") % 3 + 1).cast("int"))
    w = F.when(F.col("p_size") % 4 == 0, -0.5).otherwise(1.0)
    raw = p.select(F.col("p_partkey").cast("string").alias("path"), F.to_json(F.struct(F.lit("m").alias("material"), F.lit(3).alias("num"), F.lit(512).alias("image_size"))).alias("base"), th.alias("th"), w.alias("w"), (F.col("p_size") % 3 == 0).alias("legacy"))
    cfg = raw.select("path", "legacy", F.from_json("base", CF.RAW_SCHEMA).alias("c"), "th", "w")
    st = F.struct(F.lit(None).cast("string").alias("defocus_A"), F.lit("[1, 2]").alias("source_size_A"), F.col("th").alias("thermal_displacement_A"))
    two = F.array(*[F.struct(F.lit(n).alias("name"), F.create_map(F.lit("S"), F.lit(0.1)).alias("rates"), wt.alias("weight")) for n, wt in (("a", F.col("w")), ("", F.lit(2.0)))])
    full = cfg.select("path", "legacy", "c.material", "c.num", "c.seed", "c.structure_path", "c.image_size", st.alias("simulator"), two.alias("defect_presets"), "c.defects")
    parsed = CF.parse_configs(full)
    prob = CF.config_problems(parsed)
    out = parsed.select("path", F.size("thermal_displacement_A").alias("n_thermal")).join(prob, "path", "left").join(full.select("path", "legacy"), "path")
    return out.select("path", "n_thermal", F.coalesce("problem", F.lit("")).alias("problem"), "legacy")


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/layerframe/{uuid.uuid4().hex}"


@query("a07_a08_manifest_round_trip", "SELECT o_orderpriority AS defect_preset, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1")
def manifest_round_trip(spark, d):
    o = T.table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"), F.col("o_orderpriority").alias("defect_preset"), F.col("o_totalprice").alias("defocus_A"))
    path = _scratch(spark)
    CF.append_manifest(o, path)
    back = spark.read.schema(CF.MANIFEST_SCHEMA).json(path)
    return rounded(back.groupBy("defect_preset").agg(F.count("*").alias("n"), F.sum("defocus_A").alias("total")), 2)


@query("a08_config_snapshots", """SELECT p_partkey::VARCHAR AS path, 'm' || p_size AS material, p_partkey % 512 + 1 AS width, CASE WHEN p_size % 3 = 2 THEN 0 ELSE p_size END AS tag, 'mask.png' AS mask_path FROM part""")
def config_snapshots(spark, d):
    """Snapshots of one configuration per part, read back field by field; every third has metadata that is no object."""
    text = F.when(F.col("p_size") % 3 == 2, F.lit("[1, 2]")).otherwise(F.to_json(F.struct(F.col("p_size").alias("tag"))))
    raw = T.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("m"), "p_size").alias("material"), (F.col("p_partkey") % 512 + 1).cast("string").alias("image_size"), text.alias("metadata"))
    none = spark.createDataFrame([], CF.RAW_SCHEMA).drop("metadata", "material", "image_size")
    snap = CF.snapshot(CF.parse_configs(raw.unionByName(none, allowMissingColumns=True)))
    back = F.from_json("text", "source_config string, material string, image_size struct<width: bigint>, mask_path string, metadata struct<tag: bigint>")
    return snap.select(back.alias("b")).select(F.col("b.source_config").alias("path"), "b.material", "b.image_size.width", F.coalesce("b.metadata.tag", F.lit(0)).alias("tag"), "b.mask_path")


@query("a09_point_clouds", f"WITH {T.PTS}, i AS (SELECT sample, count(*) AS n FROM pts GROUP BY sample) SELECT pts.sample, n AS n_points, 4.0::DOUBLE AS out_scale, round(sum(x),4)+0.0 AS sx FROM pts JOIN i ON i.sample=pts.sample GROUP BY ALL")
def point_clouds(spark, d):
    p = T.pts(spark, d)
    js = FS.point_cloud_json(p, ["sample"]).withColumn("file", F.concat_ws("_", "sample", "chunk"))
    idx = js.select(F.col("file").alias("image"), F.col("file").alias("atoms_json"), F.lit(None).cast("double").alias("out_scale"))
    r = FS.point_rows(idx, js.select("file", "text"))
    g = r.groupBy(F.split("image", "_")[0].cast("int").alias("sample"), "out_scale").agg(F.count("*").alias("n_points"), F.sum("x").alias("sx"))
    return g.select("sample", "n_points", "out_scale", r6(F.col("sx"), 4).alias("sx"))


@query("a10_csv_text", "SELECT c_name AS folder, '' AS img0, c_nationkey::VARCHAR AS n0, printf('%.4f', c_acctbal) AS \"sideA_A\", CASE WHEN c_nationkey % 2 = 0 THEN '1' ELSE '0' END AS is_flip FROM customer")
def csv_text(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_name").alias("folder"), F.col("c_nationkey").alias("n0"), F.col("c_acctbal").alias("sideA_A"), (F.col("c_nationkey") % 2 == 0).alias("is_flip"))
    return TB.csv_frame(c, TB.INTERLAYER_COLUMNS, TB.INTERLAYER_DECIMALS).select("folder", "img0", "n0", "sideA_A", "is_flip")


@query("a11_pending_items", "SELECT c_custkey AS item FROM customer WHERE c_custkey * 2 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') OR c_custkey * 2 + 1 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def pending_items(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.array((F.col("c_custkey") * 2).cast("string"), (F.col("c_custkey") * 2 + 1).cast("string")).alias("expected"))
    o = T.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("path"))
    return FS.pending_items(c, o).select("item")


@query("a12_layer_dataset", f"""WITH {T.LAYERS}, f AS (SELECT DISTINCT 'sim/' || (c_custkey % 300) AS folder FROM customer), i AS (SELECT 'sim/' || image_id AS folder, layer, x, y, v FROM layers)
SELECT i.folder, layer, x - 1 AS x, y - 2 AS y, round(v, 6) AS v FROM i JOIN f ON f.folder = i.folder WHERE x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 5 UNION ALL SELECT folder, NULL, NULL, NULL, NULL FROM f WHERE folder NOT IN (SELECT folder FROM i)""")
def layer_dataset(spark, d):
    lst = _scratch(spark)
    folder = F.concat(F.lit("sim/"), (F.col("c_custkey") % 300).cast("string"))
    T.table(spark, d, "customer").select(folder.alias("value")).write.text(lst)
    im = T.layers(spark, d).select(F.concat(F.lit("sim/"), F.col("image_id").cast("string")).alias("folder"), "layer", "x", "y", "v", F.lit(8).alias("w"), F.lit(8).alias("h"))
    px, missing = FS.layer_dataset(spark, lst, im, left_of=3, top_of=2, side=4)
    return rounded(px.unionByName(missing, allowMissingColumns=True))


@query("a14_validation_dump", f"WITH {SCO} SELECT batch AS image, count(*) AS n, sum(pred)::BIGINT AS pred_sum, sum(label)::BIGINT AS label_sum FROM pr GROUP BY batch")
def validation_dump(spark, d):
    v = E.validation_dump(_pred(spark, d).withColumnRenamed("batch", "image"))
    add = lambda c: F.aggregate(c, F.lit(0), lambda a, b: a + b)
    return rounded(v.groupBy("image").agg(F.sum(F.size("pred")).alias("n"), F.sum(add("pred")).alias("pred_sum"), F.sum(add("label")).alias("label_sum")))


@query("a15_checksums", "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 3 = 0 THEN 'ok' WHEN page_id % 3 = 1 THEN 'mismatch' WHEN page_id % 2 = 0 THEN 'no_url' ELSE 'missing' END AS status FROM pages")
def checksums(spark, d):
    p = T.table(spark, d, "pages")
    content = p.filter("page_id % 3 <> 2").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    man = p.select(F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 3 == 1, "00").otherwise(F.upper(F.sha2(F.col("html").cast("binary"), 256))).alias("sha256"), F.when(F.col("page_id") % 2 == 0, "").otherwise("u").alias("url"))
    return FS.verify_checksums(content, man)


@query("a15_content_hashes", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("a16_audit", f"""WITH {LST} SELECT rel, 'forbidden_dir' AS rule FROM ls WHERE split_part(rel, '/', 2) = 'tmp' UNION ALL SELECT rel, 'large_file' FROM ls WHERE length > 20*1024*1024 UNION ALL SELECT rel, 'forbidden_suffix' FROM ls WHERE rel LIKE '%.pt' UNION ALL SELECT rel, 'local_path' FROM ls""")
def audit(spark, d):
    return FS.audit(_listing(spark, d), "/local/root", []).select("rel", "rule")


@query("a17_pivoted_log", f"WITH {T.LOG} SELECT run, sum(CASE WHEN key='click' THEN 1 ELSE 0 END)::BIGINT AS click, sum(CASE WHEN key='view' THEN 1 ELSE 0 END)::BIGINT AS view FROM log GROUP BY run")
def pivoted_log(spark, d):
    w = TB.pivot_log(T.log(spark, d), ["click", "view"])
    wide = TB.union_growing([w.select("run", "step", "click"), w.select("run", "step", "view")])
    return wide.groupBy("run").agg(F.count("click").alias("click"), F.count("view").alias("view"))


@query("a17_log_rows", f"WITH {T.LOG}, o AS (SELECT run, step % 50 AS slot, key, arg_max(value, step) AS v FROM log GROUP BY ALL) SELECT run, slot, count(*) AS n_keys, round(sum(v), 6) AS total, round(max(CASE WHEN key = 'click' THEN v END), 6) AS click FROM o GROUP BY run, slot")
def log_rows(spark, d):
    long = T.log(spark, d).withColumnRenamed("step", "seq").withColumn("step", F.col("seq") % 50)
    rows = TB.log_rows(long, seq=["seq"])
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, b: a + b)
    return rounded(rows.select("run", F.col("step").alias("slot"), F.size("values").cast("bigint").alias("n_keys"), total.alias("total"), F.try_element_at("values", F.lit("click")).alias("click")))


@query("a17_growing_log", f"WITH {T.LOG} SELECT run, count(*) AS n, count(CASE WHEN step % 3 >= 1 THEN value END) AS n_second, round(coalesce(sum(CASE WHEN step % 3 = 2 THEN step END), 0), 0)::BIGINT AS third FROM log GROUP BY run")
def growing_log(spark, d):
    """Three batches: the second brings one new column, the third another."""
    g, path = T.log(spark, d), _scratch(spark)
    for part, columns in enumerate((["run", "step"], ["run", "step", "value"], ["run", "step", "value", "late"])):
        TB.append_log(g.filter(F.col("step") % 3 == part).withColumn("late", F.col("step")).select(*columns), path)
    wide = TB.read_log(spark, path)
    return wide.groupBy("run").agg(F.count("*").alias("n"), F.count("value").alias("n_second"), F.coalesce(F.sum("late"), F.lit(0)).cast("bigint").alias("third"))


@query("a04_gray_tables", """SELECT count(*) AS n, round(sum(l_quantity), 4) AS layer1, round(sum(l_tax), 4) AS bilayer, (count(*) * (count(*) - 1) / 2)::BIGINT AS index_sum FROM lineitem GROUP BY l_orderkey % 4""")
def gray_tables(spark, d):
    """Four gray-value tables made of the order lines, written as CSV beside one that lacks a column, and read back."""
    li = T.table(spark, d, "lineitem").select((F.col("l_orderkey") % 4).alias("part"), F.col("l_linenumber").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_quantity").alias("layer1_gray"), F.col("l_discount").alias("layer2_gray"), F.col("l_tax").alias("bilayer_gray"))
    path = _scratch(spark)
    for i in range(5):
        one = li.filter(F.col("part") == i % 4).drop("part")
        (one.drop("bilayer_gray") if i == 4 else one).coalesce(1).write.option("header", True).csv(f"{path}/gray_values_{i}.csv")
    t = TB.read_gray_tables(spark, path, 2)
    return rounded(t.groupBy("source_image").agg(F.count("*").alias("n"), F.sum("layer1_gray").alias("layer1"), F.sum("bilayer_gray").alias("bilayer"), F.sum("pixel_index").alias("index_sum")).drop("source_image"), 4)


# ---------------------------------------------------------------- J: streams over the event table

def _drain(stream: DataFrame, mode: str = "append", conf: dict | None = None) -> DataFrame:
    """Run a stream over everything available and return its output table."""
    spark = stream.sparkSession
    out = _scratch(spark)
    old = {k: spark.conf.get(k, None) for k in (conf or {})}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        name = "t" + uuid.uuid4().hex
        w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/ck").trigger(availableNow=True)
        if mode == "append":
            w.format("parquet").option("path", f"{out}/data").start().awaitTermination()
            return spark.read.schema(stream.schema).parquet(f"{out}/data")
        w.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/data")).queryName(name).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/data")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _events(spark, d):
    schema = T.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("j01_ingest_once", "SELECT DISTINCT props AS file FROM events")
def ingest_once(spark, d):
    return _drain(ST.ingest_once(_events(spark, d).select(F.col("props").alias("file")), "file"))


@query("j02_running_means", "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS w, event_type AS key, round(avg(value),6) AS value, count(*) AS n FROM events GROUP BY ALL")
def running_means(spark, d):
    s = ST.running_means(_events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value"), "1 hour")
    out = _drain(s, "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("w"), "key", r6(F.col("value")).alias("value"), "n")


@query("j03_bounded_draws", "SELECT count(DISTINCT user_id) * 2 AS draws, count(DISTINCT user_id) AS sources FROM events")
def bounded_draws(spark, d):
    out = _scratch(spark)
    s = ST.ingest_once(_events(spark, d).select(F.col("user_id").alias("source")), "source")
    run = ST.draws_per_batch(["source"], 2, 3, lambda b, i: b.write.mode("append").parquet(f"{out}/data"))
    s.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").agg(F.count("*").alias("draws"), F.countDistinct("source").alias("sources"))


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.noDataMicroBatches.enabled": "false"}  # state with a time to live asks for another batch for ever


def _event_batches(spark, d):
    """The events in four files, one micro-batch each: the same user comes in several of them."""
    path = _scratch(spark)
    e = T.table(spark, d, "events")
    e.repartitionByRange(4, "event_id").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("j01_ingest_remembered", "SELECT DISTINCT user_id AS file FROM events WHERE user_id IS NOT NULL")
def ingest_remembered(spark, d):
    return _drain(ST.ingest_remembered(_event_batches(spark, d).select(F.col("user_id").alias("file")), "file"), "append", ROCKS)


@query("j03_quota_draws", """WITH b AS (SELECT user_id AS source, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1) SELECT source, 3 AS draws, 0 AS first_draw, 2 AS last_draw FROM b""")
def quota_draws(spark, d):
    """Three draws per source and batch, three in all: a source of several batches gets no more."""
    out = _drain(ST.quota_draws(_event_batches(spark, d), "user_id", 3, 3), "append", ROCKS)
    p = draw_parameters(out, ["source"], 3)
    return p.groupBy("source").agg(F.count("*").alias("draws"), F.min("draw").alias("first_draw"), F.max("draw").alias("last_draw"))


@query("j04_early_stopping_stream", """WITH e AS (SELECT user_id AS run, event_id AS epoch, value AS score FROM events), b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM e),
l AS (SELECT *, max(CASE WHEN pb IS NULL OR score > pb THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM b) SELECT run, min(CASE WHEN n - last >= 20 THEN epoch END) AS stop_epoch, round(max(score),6) AS best FROM l GROUP BY run""")
def early_stopping_stream(spark, d):
    s = _events(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("score"))
    out = _drain(ST.early_stopping(s, 20), "append", ROCKS)
    return rounded(out.groupBy("run").agg(F.min(F.when(F.col("stopped"), F.col("epoch"))).alias("stop_epoch"), F.max("best").alias("best")))


