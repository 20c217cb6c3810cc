"""Registered queries of the pipeline operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.llm.decontaminate import contamination
from boxlens.llm.fim import digests
from boxlens.llm.langid import identify
from boxlens.llm.line_dedup import dedup_lines
from boxlens.llm.mixing import taken_words
from boxlens.llm.near_dup import near_duplicates
from boxlens.llm.quality import quality_scores
from boxlens.llm.ranked import ranked_search
from boxlens.llm.secrets import scan
from boxlens.llm.simhash_dup import simhash_groups
from boxlens.llm.topk import top_k
from boxlens.llm.url_filter import judge
from boxlens.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; held-out accuracy is tested."""
    return identify(_table(spark, sf_dir, "documents")).drop("th")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back by byte ranges."""
    return round_trip(_table(spark, sf_dir, "pages")).drop("archive", "place")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("th", "matches", "longest")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mixture takes of every document."""
    return taken_words(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts of every document."""
    return scan(_table(spark, sf_dir, "documents")).drop("n_linked")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; held-out accuracy is tested."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier similar line."""
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(_table(spark, sf_dir, "pages"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best neighbours of every vector whose id is divisible by 20, among all others."""
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item, among all documents."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix and put in the order of its form; digests
    of the output and of the text restored from it."""
    return digests(_table(spark, sf_dir, "documents"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

ORACLE: dict[str, str] = {}

# Windows of ten words, joined by their text; whole items of fewer words alike.
ORACLE["op3_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
d AS (SELECT doc_id, CASE WHEN w IS NULL THEN [] ELSE w END w FROM dw),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') k
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
t AS (SELECT doc_id, unnest(w) x, generate_subscripts(w, 1) i FROM d),
u AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) l FROM t),
occ AS (SELECT doc_id, n, i, array_to_string(l[1:n], ' ') k FROM u, sizes WHERE len(l) >= n),
hits AS (SELECT doc_id, occ.n, occ.i, item_id FROM occ JOIN win ON occ.n = win.n AND occ.k = win.k),
cov AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

ORACLE["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') w FROM documents),
t AS (SELECT doc_id, len(w) m, unnest(w) x, generate_subscripts(w, 1) i FROM dw),
u AS (SELECT doc_id, m, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) l FROM t),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(l, ' ')) k FROM u WHERE len(l) = 5 OR (m < 5 AND i = 1)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) both_n FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_n >= 85 * (nx.n + ny.n - both_n)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x doc_id, min(y) m FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) component_id,
       d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

ORACLE["op2_warc_round_trip"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d FROM pages),
g AS (SELECT d, n, max(page_id) first FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, CAST(p.n AS BIGINT) payload_bytes, p.d payload_digest,
       CASE WHEN g.first IS NULL OR g.first = p.page_id THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN g.first <> p.page_id THEN g.first END refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n"""

ORACLE["op8_url_filter"] = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path FROM a),
r(rule, h, p, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                     ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (SELECT page_id, host, path, rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) k
      FROM (SELECT DISTINCT page_id, host, path FROM b) b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT b.page_id, b.host, b.path, f.rule,
       coalesce(f.v, CASE WHEN regexp_matches(b.host || b.path, '^([^/]*\.)?(ads-track|free-bets|cheap-pills|spam-farm)\.')
                          OR regexp_matches(b.host || b.path, '(^|[^A-Za-z0-9%])(adserver|doubleclick)([^A-Za-z0-9%]|$)')
                          OR regexp_matches(b.host || b.path, '/popunder([^A-Za-z0-9%]|$)')
                          OR regexp_matches(b.host || b.path, '(?s)(^|[^A-Za-z0-9%])casino-.*/bonus([^A-Za-z0-9%]|$)') THEN 'block' ELSE 'allow' END) verdict
FROM b LEFT JOIN f ON f.k = 1 AND f.page_id IS NOT DISTINCT FROM b.page_id AND f.host = b.host AND f.path = b.path"""

ORACLE["op9_exact_top_k"] = """
WITH e AS (SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) score
      FROM e q, e c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""

# Tokens as a list; the cuts are list slices.  The restored text is the text.
ORACLE["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, sha256('1:' || CAST(doc_id AS VARCHAR)) h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') w,
             [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] r FROM d),
c AS (SELECT *, CAST(len(w) AS BIGINT) n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
                  WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END form FROM u),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') pre, coalesce(array_to_string(w[a + 1:b], ''), '') mid, coalesce(array_to_string(w[b + 1:], ''), '') suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) output_sha256,
       sha256(t) restored_sha256
FROM p"""

ORACLE["op11_ranked_search"] = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, r, w, CAST(len(w) AS BIGINT) n FROM dw WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) nn, CAST(sum(n) AS BIGINT) l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT r, t, CAST(count(*) AS BIGINT) tf FROM (SELECT r, unnest(w) t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) wt FROM p, s GROUP BY t, nn),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * n * nn) // l) m FROM d, s),
g AS (SELECT item_id, doc_id, r, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) score
      FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM g WHERE score > 0 QUALIFY rank <= 10"""
