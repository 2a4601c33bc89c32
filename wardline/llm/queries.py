"""The registered queries of the corpus operators, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, near_dup, ogg, packing, ppm, sharding, suffix_dedup, toxicity, url_filter
from .common import PRIVATE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PRIVATE + "out"
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return done.select("doc_id", F.col(out + ".n_lines").alias("n_lines"), F.col(out + ".n_dropped").alias("n_dropped"), F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("kept_sha256"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokens=4096)


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.described(ogg.store(_table(spark, sf_dir, "documents")))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, cover=20)
    items = F.array_join(F.array_sort(F.col("items")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), length=100)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40, seed=sharding.SEED)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return done.select("doc_id", (F.length(raw) + sharding.ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), F.col(PRIVATE + "shard").alias("shard"), F.col(PRIVATE + "slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_near_dup, op3_packing, op4_ogg, op5_ppm, op6_toxicity, op7_decontaminate, op8_suffix_dedup, op9_url_filter, op10_sharding, pipeline)}



def url_sql() -> str:
    """op9 in SQL, the trained weights as a table of the buckets that aren't 0."""
    values, bias = url_filter.weights()
    used = [k for k, w in enumerate(values) if w]
    grams = " UNION ALL ".join(f"SELECT page_id, '{kind}' || substr(t, k, {n}) AS g FROM (SELECT page_id, '^' || {own} || '$' AS t, unnest(range(1, length({own}) + {4 - n})) AS k FROM p)" for kind, own in (("h", "host"), ("p", "path")) for n in url_filter.SIZES)
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    rule = " ".join(f"WHEN {fits(h, q)} THEN '{h}{q}'" for h, q, _ in ordered)
    verdict = " ".join(f"WHEN {fits(h, q)} THEN '{v}'" for h, q, v in ordered)
    return f"""WITH w AS (SELECT unnest({used}) AS bucket, unnest({[values[k] for k in used]}) AS weight),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
g AS ({grams}),
z AS (SELECT page_id, {bias} + coalesce(sum(weight), 0) / count(*) AS z FROM g LEFT JOIN w ON bucket = CAST('0x' || substr(md5(g), 1, 4) AS INTEGER) % {url_filter.BUCKETS} GROUP BY page_id)
SELECT p.page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN coalesce(z, {bias}) >= 0 THEN 'block' ELSE 'allow' END AS verdict FROM p LEFT JOIN z ON p.page_id = z.page_id"""


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL: dict[str, str] = {
    "op1_line_dedup": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM d),
x AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS stays FROM x WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT x.*, c.key IS NOT NULL AND doc_id <> stays AS gone FROM x LEFT JOIN c ON x.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op7_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
p AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS key FROM p),
q AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
h AS (SELECT doc_id, i, s.n, item FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS key FROM q) s JOIN v ON v.key = s.key AND v.n = s.n),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM h) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN found ON d.doc_id = found.doc_id""",
    "op2_near_dup": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_suffix_dedup": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i + 1 : i + 100]) AS h FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 99)) AS i FROM d)),
v AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
x AS (SELECT doc_id, i, sum(far) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100 THEN 1 ELSE 0 END AS far FROM v)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM x GROUP BY doc_id, span),
g AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM s UNION ALL SELECT d.doc_id, coalesce(m, 0), octet_length(b) FROM d LEFT JOIN (SELECT doc_id, max(z) AS m FROM s GROUP BY doc_id) t ON t.doc_id = d.doc_id),
k AS (SELECT g.doc_id, string_agg(hex(b[a + 1 : z]), '' ORDER BY a, z) AS kept, count(*) - 1 AS n_spans FROM g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, octet_length(b) AS n_bytes, octet_length(b) - length(kept) // 2 AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k ON k.doc_id = d.doc_id""",
    "op9_url_filter": url_sql(),
}
