"""Exact top-k search with block-at-a-time pruning.

Rows are vectors of whole numbers; each dimension is a term, its value an impact. Rows are cut
into groups by a hash of their id, and inside a group, ordered by their largest term, into
blocks of neighbouring rows. A block knows each term's largest and smallest impact, which bound
every score in it. For each query, blocks are taken in the order of their bounds and scored
through their rows until the bound falls below the k-th score.

Queries are cut into chunks; each chunk meets each group once, by an equi-join on (group,
chunk). Group and chunk sizes are fixed, so tasks stay small; copies of a vector are spread like
any other rows. Each meeting returns k rows per query, and a window ranks them.

Defined results: rows without an id, with a null vector, or with null or non-finite components
take no part. Shorter vectors count as ending in zeros. Rows that share the query's id are its
own and are not returned. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.llm.common import materialize, table
from odflux.llm.registry import query

GROUP = 4096  # rows of a group
CHUNK = 2048  # queries of a chunk
BLOCK = 64  # rows of a block
_NONE = np.iinfo(np.int64).min


def quantized(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(wide, lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


def _matrix(part: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = part.column("id").to_numpy()
    column = part.column("v").combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(ids), width), np.int64)
    filled = np.arange(width) < lengths[:, None]
    out[filled] = column.flatten().to_numpy()
    return ids, out


def search(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the best k rows for each query; missing places have the lowest score."""
    (qid, q), (rid, r) = queries, rows
    top = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * q.shape[1]
    kind = np.float64 if top < 2.0**53 else np.int64  # exact either way
    order = np.lexsort((rid, r.max(axis=1), r.argmax(axis=1)))
    rid, r = rid[order], r[order]
    blocks = -(-len(rid) // BLOCK)
    pad = blocks * BLOCK - len(rid)
    known = np.concatenate((np.ones(len(rid), bool), np.zeros(pad, bool))).reshape(blocks, BLOCK)
    ids = np.concatenate((rid, np.full(pad, np.iinfo(np.int64).max))).reshape(blocks, BLOCK)
    starts = np.arange(blocks) * BLOCK
    high, low = np.maximum.reduceat(r, starts), np.minimum.reduceat(r, starts)
    cube = np.concatenate((r, np.zeros((pad, r.shape[1]), r.dtype))).reshape(blocks, BLOCK, -1).astype(kind)
    q = q.astype(kind)
    best_s, best_i = np.full((len(qid), k), _NONE), np.full((len(qid), k), np.iinfo(np.int64).max)
    for at in range(0, len(qid), 256):
        part = slice(at, at + 256)
        qs, own = q[part], qid[part]
        bounds = (np.maximum(qs, 0) @ high.T.astype(kind) + np.minimum(qs, 0) @ low.T.astype(kind)).astype(np.int64)
        turn = np.argsort(-bounds, axis=1, kind="stable")
        scores, found = best_s[part], best_i[part]
        active = np.arange(len(qs))
        for step in range(blocks):
            block = turn[active, step]
            alive = bounds[active, block] >= scores[active, -1]
            active, block = active[alive], block[alive]
            if not len(active):
                break
            s = np.matmul(cube[block], qs[active][:, :, None])[:, :, 0].astype(np.int64)
            i = ids[block]
            s = np.where(known[block] & (i != own[active][:, None]), s, _NONE)
            s, i = np.concatenate((scores[active], s), axis=1), np.concatenate((found[active], i), axis=1)
            o = np.lexsort((i, -s.astype(np.float64) if kind is np.float64 else np.where(s == _NONE, np.iinfo(np.int64).max, -s)), axis=1)[:, :k]
            scores[active], found[active] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)
    return best_i, best_s


def _meet(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        width = max(
            int(pc.max(t.column("v").combine_chunks().value_lengths()).as_py() or 0) for t in (rows, queries)
        ) or 1
        q, r = _matrix(queries, width), _matrix(rows, width)
        ids, scores = search(q, r, k)
        there = scores > _NONE
        return pa.table([np.repeat(q[0], k).reshape(-1, k)[there], ids[there], scores[there]], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantized ``vectors`` (id, v); ``is_query`` is a
    condition on ``id``."""
    vectors = materialize(vectors, "vectors")
    asked = vectors.where(is_query)
    rows, wanted = vectors.count(), asked.count()
    groups, chunks = max(1, -(-rows // GROUP)), max(1, -(-wanted // CHUNK))
    left = vectors.select(
        "id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"),
    )
    right = asked.select(
        "id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).alias("chunk"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
    )
    found = left.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk")).applyInArrow(
        _meet(k), "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s
)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 5
"""


@query("op2_exact_top_k", ORACLE)
def op2(spark, sf_dir):
    return top_k(quantized(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)
