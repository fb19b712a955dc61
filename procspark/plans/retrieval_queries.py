"""Registered queries: chunks, vectors, contracts. The label of a vector stands for its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.operators import cases as C
from procspark.operators import text, vectors
from procspark.registry import query
from procspark.sources.tables import spend, table


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("contract_id"),
                                                 F.col("embedding").alias("vec"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One query per contract: the mean direction of its vectors (64 numbers, whatever the number of vectors)."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(
        F.avg("x").alias("x"))
    rows = cells.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    return rows.select(F.col("label").alias("query_id"), F.col("label").alias("contract_id"),
                       vectors.l2_normalize(F.transform("cells", lambda c: c["x"])).alias("vec"))


VECTORS_SQL = """WITH v AS (SELECT vec_id AS chunk_id, label AS contract_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
cells AS (SELECT contract_id, pos, avg(x) AS x FROM (SELECT contract_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM v) GROUP BY 1, 2),
c AS (SELECT contract_id, list(x ORDER BY pos) AS raw FROM cells GROUP BY 1),
q AS (SELECT contract_id AS query_id, contract_id, list_transform(raw, lambda x: x / sqrt(list_inner_product(raw, raw))) AS vec FROM c)"""


@query("chunk_text")
def _(spark, sf):
    return text.chunk_text(table(spark, sf, "documents"), "doc_id", "text", ["source"])


@query("chunk_text_paragraphs", """WITH p AS (SELECT doc_id, 1 + doc_id % 9 AS n FROM documents),
c AS (SELECT doc_id, n, unnest(range((n + 1) // 2)) AS k FROM p),
par AS (SELECT *, rpad(md5(concat_ws('-', doc_id, 2 * k)), 250, 'lorem, ') AS one, rpad(md5(concat_ws('-', doc_id, 2 * k + 1)), 250, 'lorem, ') AS two FROM c)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(504 * k AS INTEGER) AS start_index,
  trim(one || CASE WHEN 2 * k + 1 < n THEN chr(10) || chr(10) || two ELSE '' END) AS text FROM par""")
def _(spark, sf):
    """Texts of 1 to 9 paragraphs of 250 characters, one text per document: two of them fill a chunk."""
    paragraph = lambda i: F.rpad(F.md5(F.concat_ws("-", "doc_id", i)), 250, "lorem, ")
    n = (F.col("doc_id") % 9).cast("int")
    built = F.array_join(F.transform(F.sequence(F.lit(0), n), paragraph), "\n\n")
    docs = table(spark, sf, "documents").select("doc_id", built.alias("text"))
    return text.chunk_text(docs, "doc_id", "text")


@query("content_hash_dedup", """SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents GROUP BY text
HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de')""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    stored = docs.filter(F.col("lang") == "de").select(F.sha2("text", 256).alias("file_hash"))
    return text.content_hash_dedup(docs, "text", "doc_id", stored).select("doc_id", "file_hash")


@query("vector_topk", VECTORS_SQL + """ SELECT query_id, v.chunk_id, round(list_inner_product(v.vec, q.vec), 4) AS score FROM v, q
WHERE list_inner_product(v.vec, q.vec) >= 0.20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(v.vec, q.vec) DESC, v.chunk_id) <= 5""")
def _(spark, sf):
    return vectors.vector_topk(chunk_vectors(spark, sf), centroids(spark, sf)).select("query_id", "chunk_id", "score")


@query("vector_topk_all", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
q AS (SELECT vec_id * 3 + m AS query_id, CASE m WHEN 1 THEN list_transform(vec, lambda x: -x) ELSE vec END AS vec, m FROM v, (VALUES (0), (1), (2)) t(m)),
p AS (SELECT query_id, v.vec_id AS chunk_id, list_inner_product(v.vec, q.vec) AS s FROM v, q)
SELECT query_id, chunk_id, round(s, 4) AS score FROM p WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 3""")
def _(spark, sf):
    """Every vector three times as a query, once turned round: more queries than one block holds."""
    v = chunk_vectors(spark, sf)
    m = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("m")
    turned = F.when(F.col("m") == 1, F.transform("vec", lambda x: -x)).otherwise(F.col("vec"))
    queries = v.select("chunk_id", "vec", m).select((F.col("chunk_id") * 3 + F.col("m")).alias("query_id"), turned.alias("vec"))
    return vectors.vector_topk(v, queries, k=3, threshold=0.3).select("query_id", "chunk_id", "score")


@query("vector_topk_filtered", VECTORS_SQL + """ SELECT query_id, v.contract_id, v.chunk_id, round(list_inner_product(v.vec, q.vec), 4) AS score FROM v JOIN q USING (contract_id)
WHERE list_inner_product(v.vec, q.vec) >= 0.20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(v.vec, q.vec) DESC, v.chunk_id) <= 3""")
def _(spark, sf):
    return vectors.vector_topk_filtered(chunk_vectors(spark, sf), centroids(spark, sf)).select("query_id", "contract_id", "chunk_id", "score")


@query("vector_delete", """SELECT label AS contract_id, count(*) AS removed FROM embeddings WHERE label % 2 = 0 GROUP BY 1""")
def _(spark, sf):
    v = chunk_vectors(spark, sf)
    _, removed = vectors.vector_delete(v, v.filter(F.col("contract_id") % 2 == 0).select("contract_id").distinct())
    return removed


@query("vector_delete_rest", "SELECT vec_id AS chunk_id, label AS contract_id FROM embeddings WHERE label % 2 = 1")
def _(spark, sf):
    v = chunk_vectors(spark, sf)
    rest, _ = vectors.vector_delete(v, v.filter(F.col("contract_id") % 2 == 0).select("contract_id").distinct())
    return rest.select("chunk_id", "contract_id")


@query("vector_stats", "SELECT label AS contract_id, count(*) AS chunks FROM embeddings GROUP BY 1")
def _(spark, sf):
    return vectors.vector_stats(chunk_vectors(spark, sf))


@query("l2_normalize", """SELECT vec_id, i AS pos, round(vec[i] / sqrt(list_inner_product(vec, vec)), 6) AS x
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, unnest(range(1, 65)) AS i FROM embeddings)""")
def _(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("p", "x"))
    return unit.select("vec_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


# contracts of the retrieval: contract c belongs to the vendors with id % 10 = c and its neighbour
@query("clause_retrieval_per_tx", """WITH v AS (SELECT vec_id AS chunk_id, label AS contract_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
own AS (SELECT s_suppkey AS vendor_id, s_suppkey % 10 AS contract_id FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey + 1) % 10 FROM supplier),
act AS (SELECT * FROM own WHERE contract_id <> 3 AND NOT (contract_id = 5 AND vendor_id % 2 = 0)),
qs AS (SELECT DISTINCT l_partkey % (SELECT count(*) FROM embeddings) AS query_id, l_suppkey AS vendor_id FROM lineitem),
p AS (SELECT query_id, a.vendor_id, a.contract_id, v.chunk_id, list_inner_product(v.vec, q.vec) AS s FROM qs JOIN act a USING (vendor_id) JOIN v USING (contract_id) JOIN v q ON q.chunk_id = query_id),
two AS (SELECT * FROM p WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id, vendor_id, contract_id ORDER BY s DESC, chunk_id) <= 2),
three AS (SELECT *, row_number() OVER (PARTITION BY query_id, vendor_id ORDER BY s DESC, chunk_id) AS rank FROM two QUALIFY rank <= 3)
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS tx_id, contract_id, chunk_id, round(s, 4) AS score, rank
FROM lineitem JOIN three ON query_id = l_partkey % (SELECT count(*) FROM embeddings) AND vendor_id = l_suppkey""")
def _(spark, sf):
    supplier = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    own = supplier.select(k.alias("vendor_id"), F.explode(F.array(k % 10, (k + 1) % 10)).alias("contract_id"))
    contracts = own.select("vendor_id", F.col("contract_id").cast("int").alias("contract_id"),
                           F.when(F.col("contract_id") == 3, "EXPIRED").otherwise("ACTIVE").alias("status"),
                           (~((F.col("contract_id") == 5) & (F.col("vendor_id") % 2 == 0))).alias("is_indexed"))
    tx = spend(spark, sf).select("tx_id", "vendor_id", (F.col("l_partkey") % chunk_vectors(spark, sf).count()).alias("query_id"))
    queries = chunk_vectors(spark, sf).select(F.col("chunk_id").alias("query_id"), "vec")
    return vectors.clause_retrieval(tx, queries, contracts, chunk_vectors(spark, sf))


CONTRACTS_SQL = """WITH contracts AS (SELECT doc_id AS contract_id, doc_id % 7 AS vendor_id, CASE lang WHEN 'en' THEN 'ACTIVE' WHEN 'fr' THEN 'EXPIRED' WHEN 'de' THEN 'DRAFT' ELSE 'UNDER_REVIEW' END AS status,
  lang = 'en' AS is_indexed, n_chars FROM documents)"""


def contracts_of(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("contract_id"), (F.col("doc_id") % 7).alias("vendor_id"),
        F.when(lang == "en", "ACTIVE").when(lang == "fr", "EXPIRED").when(lang == "de", "DRAFT").otherwise("UNDER_REVIEW").alias("status"),
        (lang == "en").alias("is_indexed"), "n_chars")


@query("contract_list", CONTRACTS_SQL + " SELECT contract_id, status FROM contracts WHERE status = 'ACTIVE' AND vendor_id = 3 ORDER BY contract_id DESC LIMIT 10 OFFSET 10")
def _(spark, sf):
    found = vectors.list_contracts(contracts_of(spark, sf), "ACTIVE", 3)
    return C.page_of(found, "contract_id", 2, 10, newest="contract_id").select("contract_id", "status")


@query("contract_detail", CONTRACTS_SQL + " SELECT contract_id, vendor_id, status, is_indexed FROM contracts WHERE contract_id = 17")
def _(spark, sf):
    return contracts_of(spark, sf).filter(F.col("contract_id") == 17).select("contract_id", "vendor_id", "status", "is_indexed")


@query("contract_soft_delete", CONTRACTS_SQL + """ SELECT contract_id, CASE WHEN n_chars > 2000 THEN 'TERMINATED' ELSE status END AS status, is_indexed AND n_chars <= 2000 AS is_indexed FROM contracts""")
def _(spark, sf):
    df = contracts_of(spark, sf)
    return vectors.contract_soft_delete(df, df.filter(F.col("n_chars") > 2000)).select("contract_id", "status", "is_indexed")


@query("contract_index_state", CONTRACTS_SQL + """, n AS (SELECT vec_id % (SELECT count(*) FROM documents) AS contract_id, CAST(count(*) AS INTEGER) AS n FROM embeddings GROUP BY 1)
SELECT c.contract_id, CASE WHEN n IS NOT NULL AND status = 'DRAFT' THEN 'ACTIVE' ELSE status END AS status, n IS NOT NULL OR is_indexed AS is_indexed,
  coalesce(n, 0) AS chunk_count, CASE WHEN n IS NOT NULL THEN 'unit-64' END AS embedding_model FROM contracts c LEFT JOIN n USING (contract_id)""")
def _(spark, sf):
    df = contracts_of(spark, sf).select("contract_id", "status", "is_indexed", F.lit(0).alias("chunk_count"), F.lit(None).cast("string").alias("embedding_model"))
    chunks = table(spark, sf, "embeddings").select((F.col("vec_id") % df.count()).alias("contract_id"))
    return vectors.contract_index_state(df, chunks, "unit-64")


@query("vendor_keyword_match", """WITH h(contract_key, kw) AS (VALUES ('rings', 'ring'), ('widgets', 'WIDGET'), ('cold', 'cold'), ('none', 'zzz'))
SELECT contract_key, coalesce(min(p_partkey) FILTER (WHERE p_name ILIKE '%' || kw || '%'), min(p_partkey)) AS vendor_id, count(*) FILTER (WHERE p_name ILIKE '%' || kw || '%') > 0 AS matched
FROM h, part GROUP BY 1""")
def _(spark, sf):
    vendors = table(spark, sf, "part").select(F.col("p_partkey").alias("vendor_id"), F.col("p_name").alias("name"))
    return vectors.vendor_keyword_match(vendors, {"rings": "Ring makers", "widgets": "WIDGET works", "cold": "cold", "none": "zzz top"})
