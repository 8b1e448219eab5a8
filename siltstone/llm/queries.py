"""Queries over the test tables: one for each operator, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, cover_tree, decontam, html_density, huffman_ids, line_dedup, minhash_join, pareto_mix, sharding, suffix_dedup


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", "text", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard(docs, 8, keep=("doc_id", "size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_huffman_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return huffman_ids.encode(_read(spark, sf_dir, "documents"), tokenizer, end_id=1)


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), length=50)


def op5_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_units(_read(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", gone.alias("n_removed_chars"), F.size("spans").cast("long").alias("n_removed"), "n_sentences", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_cover_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return cover_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(_read(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(_read(spark, sf_dir, "documents"), words=3, percent=85)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n=8, least_items=2)


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", "quality_score", "toxic_score", "kept")


def queries() -> dict:
    return {f.__name__: f for f in (op1_sampled_splitters, op2_text_density, op3_huffman_ids, op4_suffix_arrays, op5_line_hashing, op6_cover_trees, op7_pareto_mix, op8_minhash_join, op9_decontaminate, op10_cotraining)}


_OP7 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level FROM w),
f AS (SELECT min_by(level, pos) AS free FROM l WHERE level * w < cap),
t AS (SELECT source, source_size, least(cap, coalesce(free * w, cap)) AS target FROM l LEFT JOIN f ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0.0 END AS whole FROM t),
p AS (SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0.0 END AS p FROM r),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.rest, p.p,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY CASE WHEN p.p > 0 THEN (d.u / (1 - d.u)) / (p.p / (1 - p.p)) END, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN p > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q
"""

_OP9 = r"""
WITH dw AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bx AS (SELECT item_id, w, least(len(w), 8) AS n FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bx, unnest(range(1, len(w) - n + 2)) AS r(i)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM dw, ns, unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.gram = bg.gram),
places AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS r(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


# Windows of 50 bytes are 100 hexadecimal digits (w); those that a smaller id has too (g) merge into runs (s).
_OP4 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM d, unnest(range(0, n - 49)) AS r(i)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > low),
m AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) < i - 50, true) AS head FROM g),
r AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
s AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS upto FROM s),
a AS (SELECT k.doc_id, sum(hi - lo) AS gone, count(*) AS spans, string_agg(substr(h, CAST(2 * upto + 1 AS BIGINT), CAST(2 * (lo - upto) AS BIGINT)), '' ORDER BY lo) || substr(any_value(h), CAST(2 * max(hi) + 1 AS BIGINT)) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""


# Units are sentences (u), whole lines (l) and the shortest runs of sentences of 100 characters (r); e holds first and last sentence of each.
_OP5 = r"""
WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).*?(?:[.!?][ \t-\r]+|[。！？][ \t-\r]*|\n[ \t-\r]*)|.+') AS p FROM documents),
v AS (SELECT doc_id, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS k FROM x),
u AS (SELECT *, CAST(length(regexp_replace(s, '[ \t-\r]+', '', 'g')) AS BIGINT) AS size, contains(s, chr(10)) AS ends FROM v),
c AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) AS upto, CAST(sum(length(s)) OVER w AS BIGINT) AS hi, count_if(ends) OVER w - CASE WHEN ends THEN 1 ELSE 0 END AS line FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT a.doc_id, a.k AS k1, b.k AS k2 FROM (SELECT *, upto - size + 100 AS need FROM c WHERE size > 0) a ASOF JOIN (SELECT * FROM c WHERE size > 0) b ON a.doc_id = b.doc_id AND a.need <= b.upto),
l AS (SELECT doc_id, min(k) AS k1, max(k) AS k2 FROM c GROUP BY doc_id, line HAVING sum(size) >= 100),
e AS (SELECT * FROM r UNION SELECT * FROM l),
n AS (SELECT e.doc_id, e.k1, e.k2, a.hi - length(a.s) AS lo, md5(trim(regexp_replace(lower(substr(x.text, CAST(a.hi - length(a.s) + 1 AS BIGINT), CAST(b.hi - a.hi + length(a.s) AS BIGINT))), '[ \t-\r]+', ' ', 'g'))) AS d
    FROM e JOIN c a ON a.doc_id = e.doc_id AND a.k = e.k1 JOIN c b ON b.doc_id = e.doc_id AND b.k = e.k2 JOIN x ON x.doc_id = e.doc_id),
f AS (SELECT d, min((doc_id, lo)) AS first FROM n GROUP BY d),
g AS (SELECT DISTINCT doc_id, unnest(range(k1, k2 + 1)) AS k FROM n JOIN f USING (d) WHERE (doc_id, lo) <> first),
m AS (SELECT c.doc_id, c.k, c.s, g.k IS NOT NULL AS gone, g.k IS NOT NULL AND coalesce(lag(g.k IS NULL) OVER (PARTITION BY c.doc_id ORDER BY c.k), true) AS head FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.k = c.k),
a AS (SELECT doc_id, count(*) AS n, CAST(count_if(head) AS BIGINT) AS runs, CAST(coalesce(sum(CASE WHEN gone THEN length(s) END), 0) AS BIGINT) AS chars, coalesce(string_agg(s, '' ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(chars, 0) AS n_removed_chars, coalesce(runs, 0) AS n_removed, coalesce(n, 0) AS n_sentences, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)
"""


_OP6 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


# Holds for the markup of the test pages (one article of h1, p, b and br); tests/llm has other pages.
_OP2 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<br>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(x, '</?(?:p|h1)>'), lambda t: trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[ \t\n\r\f]+', ' ', 'g'))), lambda t: t <> '') AS blocks FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM b
"""

_OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:least(i + 2, len(w))], ' ')) AS g FROM w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept FROM w JOIN m ON m.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_text_density": _OP2, "op4_suffix_arrays": _OP4, "op5_line_hashing": _OP5, "op6_cover_trees": _OP6, "op7_pareto_mix": _OP7, "op8_minhash_join": _OP8, "op9_decontaminate": _OP9}
