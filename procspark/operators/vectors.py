"""Exact vector retrieval over a table of unit vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procspark.operators.graph import neighbour_classes
from procspark.session import cut, lookup, shuffle_width

SCORE_MIN = 0.20
QUERY_BLOCK, PART_ROWS = 1_000, 50_000
_CELLS = 1 << 22  # scores at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best per group. Spark keeps only k rows per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(x: np.ndarray, matrix: np.ndarray, chunk: np.ndarray, k: int, threshold: float, held: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the best ``k`` products of every row of ``x`` with the rows of ``matrix``, from the threshold on; of equal ones the
    smaller chunk. ``held``: what is kept of the matrix from call to call, empty at first.

    The product of two matrices, in single precision where its numbers are in range, only says what can be among the best, by a bound of its error; that is
    then summed up vector by vector in double precision, so equal vectors tie.
    """
    if not held:
        far = float(np.sqrt((matrix * matrix).sum(axis=1)).max(initial=0.0))
        held.update(far=far, light=np.ascontiguousarray((matrix.astype(np.float32) if far < 1e15 else matrix).T))
    far, light = held["far"], held["light"]
    norm = np.sqrt((x * x).sum(axis=1))
    if not norm.max(initial=0.0) < 1e15:
        light = matrix.T
    kind = light.dtype
    rough = x.astype(kind) @ light
    slack = (matrix.shape[1] + 8) * float(np.finfo(kind).eps) * norm * far + 1e-30
    if not np.isfinite(slack).all():  # what has no number is not found, and hides nothing
        rough, slack = np.nan_to_num(rough, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.full(len(x), np.inf)
    least, n = threshold - slack, len(matrix)
    if n > 4 * k:
        # the k-th best of the best of each stripe is at most the k-th best of all
        stripes = n // 32 if n >= 128 * k else n
        top = rough[:, :n // stripes * stripes].reshape(len(x), -1, stripes).max(axis=1)
        least = np.maximum(least, np.partition(top, stripes - k, axis=1)[:, stripes - k] - 2 * slack)
    row, col = np.nonzero(rough >= least[:, None])
    score = (x[row] * matrix[col]).sum(axis=1)
    good = score >= threshold
    row, col, score = row[good], col[good], score[good]
    order = np.lexsort((chunk[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], col[top], score[top]


def _part_topk(chunks: DataFrame, queries: DataFrame, k: int, threshold: float, part_rows: int = PART_ROWS, query_rows: int = QUERY_BLOCK) -> DataFrame:
    """``grp, query_id, chunk_id, score``: for every query (``grp, query_id, vec``) the best ``k`` chunks (``grp, chunk_id, vec``) of each part of its own group.

    The chunks of a group are dealt into parts and its queries into slices, as many as their numbers ask for; a part and a slice meet in one task as two
    matrices, chunks first, and queries are multiplied batch by batch. Each meeting hands on ``k`` rows per query. A group of any size is
    split this way; groups without queries are not sent. Rows without a vector match nothing.
    """
    chunks, queries = chunks.filter(F.col("vec").isNotNull()), queries.filter(F.col("vec").isNotNull())
    parts = chunks.groupBy("grp").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    slices = queries.groupBy("grp").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("slices"))
    # the rows foretold for chunks or queries may be far too few, so they are never sent whole
    sizes = lookup(parts.join(slices, "grp"))
    c, q = chunks.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    g = chunks.schema["grp"].dataType.simpleString()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    single = {chunks.schema["vec"].dataType.simpleString(), queries.schema["vec"].dataType.simpleString()} == {"array<float>"}
    vec = F.col("vec").cast("array<float>" if single else "array<double>").alias("vec")
    own = chunks.hint("merge").join(sizes, "grp").select("grp", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int").alias("part"), every("slices").alias("slice"), F.lit(0).alias("kind"),
                                           "chunk_id", F.lit(None).cast(q).alias("query_id"), vec)
    asked = queries.hint("merge").join(sizes, "grp").select("grp", every("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"),
                                              F.lit(None).cast(c).alias("chunk_id"), "query_id", vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, matrix, ids, order_of, now, kept = [], None, None, None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(3).to_numpy()
            place = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))))
            cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1] or kind[i] != kind[i - 1]), len(place)]
            for lo, hi in zip(cuts, cuts[1:]):
                if place[lo] != now:
                    now, held, matrix, kept = place[lo], [], None, {}
                rows = batch.slice(lo, hi - lo)
                x = rows.column(6).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(hi - lo, -1)
                if kind[lo] == 0:
                    held.append((rows.column(4), x))
                    continue
                if not held:
                    continue
                if matrix is None:
                    ids, matrix = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    order_of = np.array(ids.to_pylist())
                    held = held[:1]
                step = max(1, _CELLS // len(matrix))
                for at in range(0, hi - lo, step):
                    row, col, score = _best(x[at:at + step], matrix, order_of, k, threshold, kept)
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([now[0]] * len(row), batch.schema.field(0).type), rows.column(5).take(pa.array(at + row)), ids.take(pa.array(col)), pa.array(score)],
                            names=["grp", "query_id", "chunk_id", "score"])

    width = shuffle_width(chunks.sparkSession)
    met = own.unionByName(asked).repartition(width, "grp", "part", "slice").sortWithinPartitions("grp", "part", "slice", "kind")
    return met.mapInArrow(run, f"grp {g}, query_id {q}, chunk_id {c}, score double")


def grouped_topk(chunks: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """``grp, query_id, chunk_id, score, rank``: the best ``k`` chunks of its own group for every query."""
    return _ranked(_part_topk(chunks, queries, k, threshold), ["grp", "query_id"], k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float = SCORE_MIN, part_rows: int = PART_ROWS) -> DataFrame:
    """``query_id, chunk_id, score, rank`` over all vectors (``chunk_id, vec``), for any number of queries: one group of all."""
    # vectors go to every slice and queries to every part: for a number of meetings the fewest rows move if both are cut in this proportion
    n, m, meetings = vectors.count(), queries.count(), 2 * shuffle_width(vectors.sparkSession)
    parts = max(1, -(-n // part_rows), min(meetings, math.ceil(math.sqrt(meetings * n / max(m, 1)))))
    slices = max(1, min(-(-meetings // parts), -(-m // QUERY_BLOCK)))
    chunks = vectors.select(F.lit(0).alias("grp"), "chunk_id", "vec")
    asked = queries.select(F.lit(0).alias("grp"), "query_id", "vec")
    found = _part_topk(chunks, asked, k, threshold, max(1, -(-n // parts)), max(1, -(-m // slices))).drop("grp")
    return _ranked(found, ["query_id"], k).withColumn("score", F.round("score", 4))


def vector_topk_filtered(vectors: DataFrame, queries: DataFrame, k: int = 3, threshold: float = SCORE_MIN) -> DataFrame:
    """As above, each query within its own contract: the restriction is the group, so it comes first."""
    chunks = vectors.select(F.col("contract_id").alias("grp"), "chunk_id", "vec")
    found = grouped_topk(chunks, queries.select(F.col("contract_id").alias("grp"), "query_id", "vec"), k, threshold)
    return found.select("query_id", F.col("grp").alias("contract_id"), "chunk_id", F.round("score", 4).alias("score"), "rank")


def vector_delete(vectors: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors that stay, and the number removed per contract."""
    gone = contracts.select("contract_id")
    removed = vectors.join(gone, "contract_id", "left_semi").groupBy("contract_id").agg(F.count("*").alias("removed"))
    return vectors.join(gone, "contract_id", "left_anti"), removed


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Chunks per contract; the grand total is the sum of it."""
    return vectors.groupBy("contract_id").agg(F.count("*").alias("chunks"))


def clause_retrieval(tx: DataFrame, queries: DataFrame, contracts: DataFrame, chunks: DataFrame, per_contract: int = 2,
                     per_tx: int = 3, threshold: float = SCORE_MIN) -> DataFrame:
    """Best clauses of the vendor's active indexed contracts for every transaction.

    Vendors with equal sets of such contracts are one class, and transactions with the same query and class get the same clauses; vectors are
    compared once per distinct (query, contract), as matrices of a contract's chunks and queries.
    """
    active = contracts.filter((F.col("status") == "ACTIVE") & F.col("is_indexed")).select("vendor_id", "contract_id").distinct()
    classes = cut(neighbour_classes(active, "vendor_id", "contract_id").select("vendor_id", "class"))
    owned = active.join(classes.filter(F.col("vendor_id") == F.col("class")).select("vendor_id"), "vendor_id", "left_semi").withColumnRenamed("vendor_id", "class")
    placed = tx.join(classes, "vendor_id")
    asks = placed.select("query_id", "class").distinct().join(owned, "class")
    meets = asks.select("query_id", "contract_id").distinct().join(queries.select("query_id", "vec"), "query_id")
    grouped = chunks.select(F.col("contract_id").alias("grp"), "chunk_id", "vec")
    top = grouped_topk(grouped, meets.select(F.col("contract_id").alias("grp"), "query_id", "vec"), per_contract, threshold).drop("rank")
    best = _ranked(asks.join(top.withColumnRenamed("grp", "contract_id"), ["query_id", "contract_id"]), ["query_id", "class"], per_tx)
    return placed.join(best, ["query_id", "class"]).select(
        "tx_id", "contract_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


# ---------------------------------------------------------------------------------------------
# contracts


def list_contracts(contracts: DataFrame, status: str | None = None, vendor_id: int | None = None) -> DataFrame:
    out = contracts
    if status is not None:
        out = out.filter(F.col("status") == status)
    if vendor_id is not None:
        out = out.filter(F.col("vendor_id") == vendor_id)
    return out


def contract_soft_delete(contracts: DataFrame, ids: DataFrame) -> DataFrame:
    gone = contracts.join(ids.select("contract_id").distinct().withColumn("gone", F.lit(True)), "contract_id", "left")
    hit = F.col("gone").isNotNull()
    return gone.withColumns({"status": F.when(hit, "TERMINATED").otherwise(F.col("status")),
                             "is_indexed": ~hit & F.col("is_indexed")}).drop("gone").select(*contracts.columns)


def contract_index_state(contracts: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """Contracts with chunks become indexed: a draft turns active, counts and model name are set."""
    counts = chunks.groupBy("contract_id").agg(F.count("*").cast("int").alias("n"))
    joined = contracts.join(counts, "contract_id", "left")
    hit = F.col("n").isNotNull()
    changed = {
        "status": F.when(hit & (F.col("status") == "DRAFT"), "ACTIVE").otherwise(F.col("status")),
        "is_indexed": hit | F.col("is_indexed"),
        "chunk_count": F.coalesce("n", "chunk_count"),
        "embedding_model": F.when(hit, model).otherwise(F.col("embedding_model")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in contracts.columns])


def vendor_keyword_match(vendors: DataFrame, hints: dict[str, str]) -> DataFrame:
    """For each hint the first vendor whose name contains the hint's first word, else the first vendor of all.

    The hints are a short argument list, so one aggregate over the vendors answers all of them.
    """
    name = F.lower("name")
    first = [F.min(F.when(F.contains(name, F.lit(text.split()[0].lower())), F.col("vendor_id"))).alias(f"h{i}")
             for i, text in enumerate(hints.values())]
    found = vendors.agg(F.min("vendor_id").alias("any"), *first)
    rows = F.array(*[F.struct(F.lit(key).alias("contract_key"), F.coalesce(f"h{i}", "any").alias("vendor_id"),
                              F.col(f"h{i}").isNotNull().alias("matched")) for i, key in enumerate(hints)])
    return found.select(F.inline(rows))
