"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark import registry
from procspark.llm import (
    centroid_search, chat_format, decontaminate, edit_embedding, html_extract, line_spread, lm_maxent, merkle, packing, quality_bands, secret_scan, simhash_golay,
    substring_dedup,
)
from procspark.llm.common import hex_sha256, ready, tokenizer_path
from procspark.sources.tables import table


def query(name: str, sql: str | None = None):
    def add(fn):
        return registry.query(name, sql)(lambda spark, sf_dir: fn(ready(spark), sf_dir))

    return add


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op2_secret_scans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = {r.kind for r in secret_scan.RULES if r.base}

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        hex_sha256(listed(F.filter("spans", lambda s: s["kind"].isin(*base)))).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.measure(table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = packing.Limits()
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), tokens=limits.tokens)
    return packing.pack(pieces, limits)


LINE_SQL = r"""
WITH rows AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines, length(text) AS size FROM documents),
cut AS (SELECT doc_id, source, trim(u.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM rows, unnest(lines) AS u(line)),
spread AS (SELECT line FROM cut WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (SELECT doc_id, list(DISTINCT line) AS gone FROM cut JOIN spread USING (line) GROUP BY doc_id),
judged AS (
  SELECT doc_id, lines, size,
         list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS stays
  FROM rows LEFT JOIN marked USING (doc_id)),
summed AS (SELECT *, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(stays, lambda x: length(x))), 0) <= size * 0.5 AS take FROM judged)
SELECT doc_id, CASE WHEN take THEN array_to_string(stays, chr(10)) ELSE array_to_string(lines, chr(10)) END AS text,
       CAST(len(list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '')) AS BIGINT) AS n_lines,
       CAST(CASE WHEN take THEN len(lines) - len(stays) ELSE 0 END AS BIGINT) AS n_removed
FROM summed"""


@query("op5_line_dedup", LINE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.strip_boilerplate(table(spark, sf_dir, "documents"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", hex_sha256(F.col("text")).alias("kept_sha256"))


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS goes_on,
         regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS escaped
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + CASE WHEN goes_on THEN 8 ELSE length(role) + 11 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""
# a run of one role has one header `<|role|>` and one `<|end|>`; every further turn of it has one `<|turn|>`


@query("op8_chat_formatting", CHAT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)", {"t": control})
    found = chat_format.read_back(chat_format.format_chats(rows.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("under_mask", "")
    fits = F.when(F.col("fits"), loss).otherwise(F.raise_error(F.lit("the mask does not fit the text")))
    return found.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), hex_sha256(told).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), hex_sha256(fits).alias("loss_sha256"), F.col("n_chars").cast("bigint").alias("formatted_chars"))


@query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_maxent.score_texts(table(spark, sf_dir, "documents"))


LEAK_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                               lambda w: w <> '') AS w FROM texts),
runs AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM words),
sized AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM runs WHERE kind = 'b')
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, n AS n_shingles, count(*) / n AS containment
FROM runs d JOIN sized b USING (s) WHERE kind = 'd' GROUP BY d.id, b.id, n HAVING count(*) >= 0.8 * n"""


@query("op10_benchmark_decontamination", LEAK_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_edit_fingerprints")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.with_neighbours(table(spark, sf_dir, "documents"))


def _cluster_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Plain nearest centroids, one pair of common tables for each round."""
    parts = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c
  FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept) ORDER BY h, v LIMIT {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
far{r} AS MATERIALIZED (
  SELECT row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{r}),
a{r} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d FROM far{r} GROUP BY row)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY cluster, i),
n{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n USING (cluster))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


@query("op12_centroid_clustering", _cluster_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_search.clusters(table(spark, sf_dir, "embeddings"))


def _told(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


MERKLE_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, sha256({" || ".join(map(_told, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
         sha256({" || ".join(map(_told, ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")))}) AS bare,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, b:
             list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295) AS crc
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3),
tops AS (
  SELECT 0 AS level, tree - 1 AS pos, count(*) OVER () AS n, digest FROM nodes WHERE n = 1
  UNION ALL SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3),
up AS (
  SELECT row, tree, 0 AS level, pos, n, CASE WHEN crc % 2 = 0 THEN bare ELSE leaf END AS now, '' AS told FROM leaves
  UNION ALL SELECT up.row, up.tree, up.level + 1, up.pos // 3, (any_value(up.n) + 2) // 3, sha256(string_agg(CASE WHEN m.pos = up.pos THEN now ELSE digest END, '' ORDER BY m.pos)),
         told || string_agg(CASE WHEN m.pos = up.pos THEN '' ELSE digest END, '' ORDER BY m.pos)
  FROM up JOIN nodes m ON m.tree = up.tree AND m.level = up.level AND m.pos // 3 = up.pos // 3 WHERE up.n > 1 GROUP BY up.row, up.tree, up.level, up.pos, now, told),
over_ AS (
  SELECT row, tree, 0 AS level, tree - 1 AS pos, (SELECT any_value(n) FROM tops WHERE level = 0) AS n, now, told FROM up WHERE n = 1
  UNION ALL SELECT o.row, o.tree, o.level + 1, o.pos // 3, (any_value(o.n) + 2) // 3, sha256(string_agg(CASE WHEN m.pos = o.pos THEN now ELSE digest END, '' ORDER BY m.pos)),
         told || string_agg(CASE WHEN m.pos = o.pos THEN '' ELSE digest END, '' ORDER BY m.pos)
  FROM over_ o JOIN tops m ON m.level = o.level AND m.pos // 3 = o.pos // 3 WHERE o.n > 1 GROUP BY o.row, o.tree, o.level, o.pos, now, told)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(told) AS proof_sha256, now AS folded_root, now = r.digest AS verified
FROM leaves JOIN over_ o USING (row) JOIN nodes s ON s.tree = leaves.tree AND s.n = 1 JOIN tops r ON r.n = 1 WHERE o.n = 1"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")

    bare = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    told = [merkle.field(n) for n in names]
    rows = docs.select("doc_id", "source", merkle.digest(*told).alias("digest"), "lang", "n_chars", F.coalesce(bare, "text").alias("text"), (bare != F.col("text")).alias("touched"))
    rows = rows.select("doc_id", "source", "digest", F.when(F.col("touched"), merkle.digest(*told)).alias("tampered"))
    proofs = merkle.proofs(merkle.build(rows, carried=("tampered",)))
    folded = merkle.fold(F.coalesce("tampered", "digest"), F.col("proof"))
    told = proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
