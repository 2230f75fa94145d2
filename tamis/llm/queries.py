"""One query per operator, over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.llm.bpe import bpe_round_trip
from tamis.llm.cross_polytope import cross_polytope_search
from tamis.llm.frames import table
from tamis.llm.lengths import token_counts
from tamis.llm.lexical import lexical_search
from tamis.llm.licenses import license_scan
from tamis.llm.minmax import link_near_duplicates
from tamis.llm.mtree import mtree_search
from tamis.llm.packing import packing
from tamis.llm.sharding import sharding
from tamis.llm.substring import substring_dedup
from tamis.llm.tokenstore import token_store
from tamis.llm.toxicity import toxicity
from tamis.llm.vafile import va_clusters


def _over(name: str, operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, name))
    return query


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_cross_polytope": _over("embeddings", cross_polytope_search),
    "op3_token_counts": _over("documents", token_counts),
    "op4_byte_bpe": _over("documents", bpe_round_trip),
    "op5_substring_dedup": _over("documents", substring_dedup),
    "op6_packing": _over("documents", packing),
    "op7_mtree": _over("embeddings", mtree_search),
    "op8_minmax_dedup": _over("documents", link_near_duplicates),
    "op9_external_shuffle": _over("documents", sharding),
    "op10_license_templates": _over("documents", license_scan),
    "op11_token_store": _over("documents", token_store),
    "op12_va_file": _over("embeddings", va_clusters),
    "op13_aho_corasick": op13_aho_corasick,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op5_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
bad AS (SELECT win.doc_id, win.i FROM win JOIN least USING (k) WHERE win.doc_id > least.m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM bad),
tok AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT tok.doc_id, string_agg(t, ' ' ORDER BY tok.i) AS s, count(*) AS n
         FROM tok LEFT JOIN gone ON gone.doc_id = tok.doc_id AND gone.i = tok.i WHERE gone.i IS NULL GROUP BY tok.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op7_mtree": """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20
""",
    "op8_minmax_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, array_to_string(w, ' ') AS s FROM d WHERE len(w) BETWEEN 1 AND 4
       UNION SELECT doc_id, array_to_string(w[i:i + 4], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, b AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other),
c AS (SELECT node, min(other) AS m FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
""",
}



def _va_round(i: int) -> str:
    """The assignment to the centroids c{i} and the centroids c{i + 1} it gives."""
    return f"""
a{i} AS (SELECT r, c, d FROM (SELECT v.r, c, CAST(list_inner_product(q, q) - 2 * list_inner_product(q, m) + list_inner_product(m, m) AS BIGINT) AS d
         FROM v CROSS JOIN c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
p{i} AS (SELECT c, unnest(q) AS x, unnest(range(64)) AS j FROM v JOIN a{i} USING (r)),
n{i} AS (SELECT c, list(f ORDER BY j) AS m FROM (SELECT c, j, floor(sum(x) / count(*)) AS f FROM p{i} GROUP BY c, j) GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} ON n{i}.c = c{i}.c),"""


SQL["op12_va_file"] = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
           WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS c, q AS m FROM v QUALIFY c < 16),
{"".join(_va_round(i) for i in range(4))}
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM t) AS inertia,
       sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN m], ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN t USING (c) JOIN c3 USING (c)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL["op13_aho_corasick"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN s GROUP BY t, n),
m AS (SELECT r, doc_id, CAST(50 + (50 * len(w) * n) // l AS BIGINT) AS m FROM d CROSS JOIN s WHERE len(w) > 0),
part AS (SELECT tf.r, tf.t, CAST(w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS BIGINT) AS p FROM tf JOIN wt USING (t) JOIN m USING (r)),
sc AS (SELECT item_id, r, CAST(sum(p) AS BIGINT) AS score FROM i JOIN part USING (t) GROUP BY item_id, r HAVING sum(p) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM sc JOIN m USING (r) QUALIFY rank <= 50
"""


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
