"""The operators of this subpackage applied to whole tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, html_text, language, line_dedup, near_vectors, ngram_join, quality, suffix_dedup, token_counts
from tessera.llm.base import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.prepare(table(spark, sf_dir, "documents"))
    return quality.score_rows(rows, quality.fit(rows, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, "byte_bpe_50k.json").drop("text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()).select("doc_id", "text", "lang"))
    found = language.predict(docs.select("doc_id", "text"), model).drop("text")
    return found.withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"), F.col("start").cast("long").alias("start_word"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, "word_bpe_49k.json").drop("text")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_token_counts, op3_language_id, op4_benchmark_decontamination, op5_line_dedup, op6_suffix_dedup, op7_html_text, op8_near_vectors, op9_bpe_codec, op10_ngram_join)}


LINES_SQL = r"""
WITH split AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
alllines AS (SELECT doc_id, text, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
kept AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words,
  row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS seq FROM alllines WHERE trim(line, ' ') <> ''),
ends AS (SELECT a.doc_id, a.text, a.pos, a.seq, min(b.seq) AS stop FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, text ORDER BY pos) AS total FROM kept) a
  JOIN (SELECT doc_id, text, seq, sum(words) OVER (PARTITION BY doc_id, text ORDER BY pos) AS total FROM kept) b
  ON a.doc_id = b.doc_id AND a.text = b.text AND b.seq >= a.seq AND b.total - a.total + a.words >= 10 GROUP BY ALL),
runs AS (SELECT e.doc_id, e.text, e.pos, string_agg(k.line, chr(10) ORDER BY k.seq) AS run, max(k.pos) AS last
  FROM ends e JOIN kept k ON e.doc_id = k.doc_id AND e.text = k.text AND k.seq BETWEEN e.seq AND e.stop GROUP BY e.doc_id, e.text, e.pos),
firsts AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(pos) OVER w AS fa, first_value(last) OVER w AS fl FROM runs
  WINDOW w AS (PARTITION BY run ORDER BY doc_id, pos)),
gone AS (SELECT doc_id, text, unnest(range(CASE WHEN doc_id = fd THEN greatest(pos, fl + 1) ELSE pos END, last + 1)) AS pos FROM firsts WHERE NOT (doc_id = fd AND pos = fa)),
marked AS (SELECT e.*, g.pos IS NOT NULL AS dead FROM alllines e LEFT JOIN (SELECT DISTINCT * FROM gone) g USING (doc_id, text, pos)),
final AS (SELECT doc_id, text, count(*)::BIGINT AS n_lines, count(*) FILTER (dead)::BIGINT AS n_removed_lines,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dead), '')) AS kept_md5 FROM marked GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(kept_md5, md5('')) AS kept_md5
FROM documents d LEFT JOIN final f ON d.doc_id = f.doc_id AND d.text = f.text
"""

#: All windows that share a shingle with an item, as multisets of shingles; no fingerprints.
LEAKS_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, n, unnest(s) AS s, unnest(range(len(s))) AS pos FROM (SELECT doc_id, len(w) AS n,
  CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END AS s FROM dw WHERE len(w) > 0)),
its AS (SELECT item_id, n, m, unnest(s) AS s, unnest(range(len(s))) AS q FROM (SELECT *, len(s) AS m FROM (SELECT item_id, len(w) AS n,
  CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END AS s FROM iw WHERE len(w) > 0))),
starts AS (SELECT DISTINCT doc_id, item_id, m, unnest(range(greatest(0, pos - m + 1), least(pos, greatest(0, dn - n)) + 1)) AS start
  FROM (SELECT ds.doc_id, its.item_id, its.m, ds.n AS dn, its.n, pos FROM ds JOIN its ON ds.s = its.s)),
win AS (SELECT st.doc_id, st.item_id, st.m, st.start, ds.s, count(*) AS c FROM starts st JOIN ds ON ds.doc_id = st.doc_id AND ds.pos >= st.start AND ds.pos < st.start + st.m GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM its GROUP BY ALL),
sims AS (SELECT win.doc_id, win.item_id, win.start, sum(least(win.c, coalesce(ic.c, 0))) AS shared, sum(win.c) + any_value(win.m) AS total
  FROM win LEFT JOIN ic ON ic.item_id = win.item_id AND ic.s = win.s GROUP BY ALL),
good AS (SELECT *, shared / (total - shared) AS sim FROM sims WHERE shared >= 0.8 * (total - shared) - 1e-9)
SELECT doc_id, item_id, round(max(sim), 6) AS similarity, arg_min(start, (-sim, start))::BIGINT AS start_word FROM good GROUP BY doc_id, item_id
"""


#: All pairs; components by spreading the smallest id.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN low ON low.a = v.vec_id
"""

#: All pairs of documents that share a shingle; components by spreading the smallest id.
NGRAMS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM d),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM d LEFT JOIN low ON low.a = d.doc_id
"""

#: Every 200-byte window by its MD5; successive repeated windows that touch are one run.
REPEATS_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 400)) AS m FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS p FROM h)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY m) AS n FROM win) WHERE n > 1),
marked AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 200, true) AS new FROM again),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 200 AS hi FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run),
cut AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
kept AS (SELECT c.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS left_over FROM cut c JOIN h USING (doc_id) GROUP BY c.doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, x))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_benchmark_decontamination": LEAKS_SQL, "op5_line_dedup": LINES_SQL, "op6_suffix_dedup": REPEATS_SQL, "op8_near_vectors": VECTORS_SQL, "op10_ngram_join": NGRAMS_SQL}
