"""Registered queries of the operators, and their SQL where SQL can say them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontam, langid, merkle, neardup, periodic, pivots, quality, secrets, tokencount, urls, warc
from .common import materialise, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), warc.new_archive_dir(spark))
    headers = materialise(warc.read_archives(spark, path, payloads=False), "headers")  # archives are parsed once
    return warc.with_originals(headers).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TRICKY = "\\### Assistant: </turn> ok"


def op6_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return chat.read_back(chat.format_turns(rows.union(added)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = "quality.measures."
    return q.select("doc_id", *[m + c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    "quality.base_failed", "quality.kept")


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.with_planted_run(F.col("doc_id"), F.col("text")).alias("text"))
    r, best = F.col("runs"), F.col("best")
    line = lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))
    return periodic.find_runs(docs).withColumn("best", periodic.longest(r)).select(
        "doc_id", F.size(r).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(r, line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = merkle.leaf(**{f: F.when(tampered, F.col(f) + 1).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in merkle.FIELDS})
    return merkle.audit(merkle.build(docs, check=changed)).withColumn("doc_id", F.col("key").cast("long")).drop("key")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_warc_revisits, op3_language_crf, op4_superminhash, op5_decontamination, op6_chat_grammar,
    op7_token_counts, op8_quality_rules, op9_url_cascade, op10_byte_bpe, op11_periodic_runs, op12_pivot_permutation, op13_merkle_manifest, pipeline)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# crc32 of the decimal id: one step a byte, eight steps a bit
_CRC = r"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""
_PART = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"

SQL = {
    "op2_warc_revisits": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS m, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 1000 AND c > 1 AND p.page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND c > 1 AND p.page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d""",
    "op4_superminhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, """ + _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + r""" AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS x FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * k >= 85 * (za.n + zb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op6_chat_grammar": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '### ' || role || ': ' || replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') || '</turn>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, formatted) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op8_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, """ + _WORDS + r""" AS ws FROM documents),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM t WHERE len(ws) >= 5),
v AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 4], ' ')) AS c FROM g),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM v, range(5) q(k) WHERE c > 1 GROUP BY rid),
m AS (SELECT t.rid, doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(list_filter(ws, lambda w: list_contains([""" + ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS)) + r"""], lower(trim(w, '""" + quality.EDGES.replace("'", "''") + r"""'))))) AS n_stop_words,
  len(list_filter(ls, lambda s: regexp_matches(ltrim(s), '^[-*•+]\s'))) AS n_bullet_lines,
  len(list_filter(ls, lambda s: rtrim(s) LIKE '%...' OR rtrim(s) LIKE '%…')) AS n_ellipsis_lines
  FROM t JOIN l USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words OR 100 * n_symbols > 8 * word_chars
    OR (n_words >= 30 AND 100 * n_stop_words < 2 * n_words) OR 100 * n_dup_lines > 40 * n_lines
    OR 100 * n_bullet_lines > 90 * n_lines OR 100 * n_ellipsis_lines > 30 * n_lines) AS kept
FROM b""",
    "op9_url_cascade": r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM r),
x AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '""" + urls.LISTED_LABELS + r"""') THEN 'block' ELSE 'allow' END AS verdict
FROM x""",
    "op11_periodic_runs": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, """ + _WORDS + r""" AS ws, """ + _CRC + r""" AS h FROM documents),
e AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM e),
x AS (SELECT rid, i, ws[CASE WHEN p IS NULL OR i < a THEN i ELSE a + (i - a) % p END + 1] AS w, n FROM (SELECT *, unnest(range(n)) AS i FROM f)),
m AS (SELECT b.rid, b.i - c.i AS q, c.i FROM x c JOIN x b ON b.rid = c.rid AND b.w = c.w AND b.i > c.i AND 4 * (b.i - c.i) <= b.n),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS grp FROM m),
r AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY rid, q, grp HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT rid, start, length, min(q) AS period FROM r GROUP BY ALL),
best AS (SELECT rid, start, length, period, row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM u),
t AS (SELECT rid, count(*) AS c, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS line FROM u GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM u),
kept AS (SELECT x.rid, string_agg(w, ' ' ORDER BY x.i) AS words FROM x ANTI JOIN dropped o ON o.rid = x.rid AND o.i = x.i GROUP BY x.rid)
SELECT doc_id, coalesce(c, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN best ON best.rid = d.rid AND k = 1 LEFT JOIN kept ON kept.rid = d.rid""",
    "op12_pivot_permutation": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND len(list_filter(e, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a, count(*) AS c FROM p GROUP BY a)
SELECT vec_id, coalesce(any_value(n.c), 0) AS n_links, min(r.b) AS component_id, vec_id = min(r.b) AS kept
FROM v JOIN r ON r.a = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, """ + _CRC + r""" % 7 = 0 AS tampered,
  sha256(""" + " || ".join(map(_PART, ("doc_id", "source", "lang", "n_chars", "text"))) + r""") AS leaf,
  sha256(""" + " || ".join(map(_PART, ("doc_id", "source", "lang", "(n_chars + 1)", "text"))) + r""") AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT g, 0 AS lv, pos AS i, leaf AS h, n FROM p
  UNION ALL SELECT g, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lv, i // 2, n),
s AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
o AS (SELECT 0 AS lv, pos AS i, h, n FROM s
  UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM o WHERE n > 1 GROUP BY lv, i // 2, n),
below AS (SELECT p.g, p.pos, string_agg(t.h, '' ORDER BY t.lv) AS hs FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.i = xor(p.pos >> t.lv, 1) GROUP BY p.g, p.pos),
above AS (SELECT s.g, string_agg(o.h, '' ORDER BY o.lv) AS hs FROM s JOIN o ON o.n > 1 AND o.i = xor(s.pos >> o.lv, 1) GROUP BY s.g),
f AS (SELECT g, pos, 0 AS lv, n, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM p
  UNION ALL SELECT f.g, f.pos, f.lv + 1, (f.n + 1) // 2, sha256(CASE WHEN (f.pos >> f.lv) & 1 = 1 THEN t.h || f.h ELSE f.h || coalesce(t.h, '') END)
  FROM f LEFT JOIN t ON t.g = f.g AND t.lv = f.lv AND t.i = xor(f.pos >> f.lv, 1) WHERE f.n > 1),
k AS (SELECT f.g, f.pos, 0 AS lv, s.n, s.pos AS sp, f.h FROM f JOIN s ON s.g = f.g WHERE f.n = 1
  UNION ALL SELECT k.g, k.pos, k.lv + 1, (k.n + 1) // 2, k.sp, sha256(CASE WHEN (k.sp >> k.lv) & 1 = 1 THEN o.h || k.h ELSE k.h || coalesce(o.h, '') END)
  FROM k LEFT JOIN o ON o.lv = k.lv AND o.i = xor(k.sp >> k.lv, 1) WHERE k.n > 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, o.h AS root, sha256(coalesce(below.hs, '') || coalesce(above.hs, '')) AS proof_sha256,
  k.h AS folded_root, k.h = o.h AS verified
FROM p JOIN s ON s.g = p.g JOIN o ON o.n = 1 JOIN k ON k.g = p.g AND k.pos = p.pos AND k.n = 1
LEFT JOIN below ON below.g = p.g AND below.pos = p.pos LEFT JOIN above ON above.g = p.g""",
}
