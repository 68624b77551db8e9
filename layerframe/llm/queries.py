"""The registered queries of the operators: whole tables, production parameters, the agreed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, language, mixing, negatives, outliers, pitman_yor, setsketch, sharding, spelling, suffixdedup, urls
from .registry import query, table


@query("op1_chat_formatting", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\1x', 'g')) AS role_n,
  length(regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\1x', 'g')) AS text_n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(6 + role_n + 7 + text_n + 4))::BIGINT AS formatted_chars FROM e GROUP BY conv_id""")
def op1(spark, d):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_conversations(rows)).drop("n_tokens", "n_loss_tokens")


@query("op2_mixing", r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM p),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  coalesce(sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w),
l AS (SELECT caps, all_weight - gone AS rest FROM o WHERE (total - caps) * weight <= cap * (all_weight - gone) ORDER BY caps, all_weight - gone LIMIT 1),
t AS (SELECT o.source, source_size, least((total - l.caps)::DOUBLE * weight / l.rest, cap::DOUBLE) AS target FROM o, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
u AS (SELECT source, h, sum(size) AS unit FROM s GROUP BY ALL),
c AS (SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY h) AS upto FROM u),
k AS (SELECT c.source, c.h, CASE WHEN c.upto <= b.target - b.passes * b.source_size THEN 1
   WHEN c.upto - c.unit > b.target - b.passes * b.source_size THEN 0
   WHEN c.upto - (b.target - b.passes * b.source_size) < (b.target - b.passes * b.source_size) - (c.upto - c.unit) THEN 1 ELSE 0 END AS more
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source)
SELECT s.doc_id, s.source, s.size, b.source_size, b.target, (s.size * (b.passes + k.more))::BIGINT AS taken
FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source JOIN k ON s.source IS NOT DISTINCT FROM k.source AND s.h = k.h""")
def op2(spark, d):
    return mixing.mix_sources(table(spark, d, "documents"))


_CRC_STEPS = ",\n".join(f"t{k} AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END AS v FROM t{k - 1})" for k in range(1, 9))


@query("op3_sharding", f"""
WITH t0 AS (SELECT i, i::UBIGINT AS v FROM range(256) r(i)),
{_CRC_STEPS},
tbl AS (SELECT list(v ORDER BY i) AS t FROM t8),
x AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, encode(coalesce(text, '')) AS b FROM documents),
y AS (SELECT doc_id, key, octet_length(b) + 1 AS size, list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda p: ('0x' || p)::UBIGINT)) AS bytes FROM x),
z AS (SELECT doc_id, key, size, xor(list_reduce(bytes, lambda a, v: xor(a >> 8, t[(xor(a, v) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM y, tbl),
s AS (SELECT z.*, r.i AS shard, -1.0::DOUBLE / ln((('0x' || substr(md5(key || '/' || r.i), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS score FROM z, range(17) r(i)),
w AS (SELECT doc_id, key, size, crc, arg_max(shard, (score, shard)) FILTER (shard < 16) AS shard, arg_max(shard, (score, shard)) AS grown FROM s GROUP BY ALL)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot/' || key), 1, 15))::BIGINT, doc_id, size, crc) - 1 AS slot, grown::INT AS grown_shard FROM w""")
def op3(spark, d):
    return sharding.shard_rows(table(spark, d, "documents"))


@query("op6_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS k FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, lens WHERE len(ws) >= n)),
m AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS w FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op6(spark, d):
    marked = decontaminate.mark_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return decontaminate.verdicts(marked).drop("hit_spans", "item_ids")


@query("op7_url_filter")
def op7(spark, d):
    return urls.judge(table(spark, d, "pages"))


@query("op9_language_id")
def op9(spark, d):
    docs = table(spark, d, "documents")
    held_out = language.fold(F.col("doc_id")) == 0
    model = language.train(docs, held_out)
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=("doc_id", "held_out")).drop("langs")


@query("op10_setsketch_near_dedup")
def op10(spark, d):
    return setsketch.near_duplicates(table(spark, d, "documents"))


@query("op8_pitman_yor_scoring")
def op8(spark, d):
    return pitman_yor.score_documents(table(spark, d, "documents"))


@query("op5_quality_outliers")
def op5(spark, d):
    return outliers.reject_outliers(table(spark, d, "documents"))


@query("op4_suffix_dedup")
def op4(spark, d):
    return suffixdedup.remove_repeats(table(spark, d, "documents"))


@query("op11_hard_negatives", r"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def op11(spark, d):
    rows = negatives.quantise(table(spark, d, "embeddings"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


_LETTER_RUNS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')".replace("\u00C0", "À").replace("\u00FF", "ÿ")


@query("op12_spelling_variants", f"""
WITH RECURSIVE t0 AS (SELECT i, i::UBIGINT AS v FROM range(256) r(i)),
{_CRC_STEPS},
tbl AS (SELECT list(v ORDER BY i) AS t FROM t8),
x AS (SELECT doc, run, count(*) AS n, list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda p: ('0x' || p)::UBIGINT)) AS bytes
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest({_LETTER_RUNS}) AS run FROM documents) GROUP BY doc, run),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda a, v: xor(a >> 8, t[(xor(a, v) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM x, tbl),
w AS (SELECT CASE WHEN h % 97 = 0 THEN run[:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
o AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM o a JOIN o b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT o.word, w.word, w.n FROM o JOIN w ON o.rest = w.word UNION SELECT w.word, o.word, o.n FROM o JOIN w ON o.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_max(near, m) AS one, max(m) AS m FROM pairs GROUP BY word),
tie AS (SELECT b.word, b.n_near, b.m, min(p.near) AS near FROM best b JOIN pairs p ON b.word = p.word AND b.m = p.m GROUP BY ALL),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN tie USING (word)),
walk AS (SELECT word, word AS here, 0 AS k FROM f UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)""")
def op12(spark, d):
    return spelling.group_variants(table(spark, d, "documents"))


@query("op13_bpe_round_trip")
def op13(spark, d):
    return bpe.digest(bpe.decode_texts(bpe.encode_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "token_ids")))
