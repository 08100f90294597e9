"""Sharding by a k-d tree over metadata, with leaves of nearly equal bytes.

Documents with equal texts form a group that is never split; a group is a weighted point. Each
node of the tree is split along its widest dimension (its range over that of all points) at the
weighted median, found by distributed histograms: one over the dimension's values in the node,
one over a hash of the groups inside the median's bin, so that ties are split as well. All nodes
of a level are split together; the driver holds one row per node. Splitting ends when leaves
reach the target, which for 2^k shards is an even 2^-k of the bytes.

The text is read once, for its size and checksums, and not shuffled.

Defined results: a null text is an empty one. Null metadata counts as the lowest value. A group
larger than a shard makes its shard larger. Repeated rows share a group. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.llm.common import materialize, table, with_rank
from odflux.llm.registry import query

BINS = 1 << 12


def _positions(nodes: DataFrame, bin_column: str, before: str) -> DataFrame:
    """Per node the bin in which the running weight passes half, the weight in front of it, and
    whether it stays on the left, as the nearer of both cuts."""
    bins = nodes.groupBy("node", bin_column).agg(
        F.sum("weight").alias("w"), F.first(before).alias("before"), F.first("half").alias("half")
    )
    # At most BINS entries per node.
    listed = bins.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct(F.col(bin_column).alias("bin"), "w"))).alias("bins"),
        F.first("before").alias("before"), F.first("half").alias("half"),
    )
    start = F.struct(F.lit(-1).cast("long").alias("bin"), F.col("before").alias("sum"), F.lit(0.0).alias("w"))
    passed = F.aggregate("bins", start, lambda a, x: F.when(
        (a["bin"] < 0) | (a["sum"] < F.col("half")),
        F.struct(x["bin"].alias("bin"), (a["sum"] + x["w"]).alias("sum"), x["w"].alias("w")),
    ).otherwise(a))
    return listed.withColumn("hit", passed).select(
        "node", F.col("hit.bin").alias(f"{bin_column}_cut"), (F.col("hit.sum") - F.col("hit.w")).alias(f"{bin_column}_before"),
        (F.col("hit.sum") - F.col("half") <= F.col("half") - (F.col("hit.sum") - F.col("hit.w"))).alias(f"{bin_column}_left"),
    )


def kd_tree(points: DataFrame, dims: list[str], levels: int) -> DataFrame:
    """(group, node) for points (group, hash, weight and dims): leaves 0 to 2^levels - 1."""
    spans = points.agg(*[(F.max(d) - F.min(d)).alias(f"w_{d}") for d in dims]).first()
    whole = {d: float(spans[f"w_{d}"] or 0.0) for d in dims}
    now = points.withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        now = materialize(now, "nodes")
        ranges = [x for d in dims for x in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]
        nodes = now.groupBy("node").agg((F.sum("weight") / 2).alias("half"), *ranges)
        width = F.greatest(*[
            F.struct(((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / (whole[d] or 1.0)).alias("width"), F.lit(-k).alias("k"))
            for k, d in enumerate(dims)
        ]) if len(dims) > 1 else F.struct(F.lit(0.0).alias("width"), F.lit(0).alias("k"))
        nodes = materialize(nodes.withColumn("axis", -width["k"]).drop("w"), "splits")
        value = F.coalesce(*[F.when(F.col("axis") == k, F.col(d)) for k, d in enumerate(dims)])
        low = F.coalesce(*[F.when(F.col("axis") == k, F.col(f"lo_{d}")) for k, d in enumerate(dims)])
        high = F.coalesce(*[F.when(F.col("axis") == k, F.col(f"hi_{d}")) for k, d in enumerate(dims)])
        share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
        # A node's row is small; the points are not, and are spread over all tasks.
        placed = now.join(nodes, "node").select(
            *now.columns, "half", F.floor(share * (BINS - 1)).alias("bin"),
            F.pmod(F.xxhash64(F.lit(level), "hash", "group"), F.lit(BINS)).alias("tie"), F.lit(0.0).alias("zero"),
        )
        placed = materialize(placed, "placed")
        first = materialize(_positions(placed, "bin", "zero"), "medians")
        inside = placed.join(first, "node").where(F.col("bin") == F.col("bin_cut"))
        second = materialize(_positions(inside, "tie", "bin_before"), "medians")
        beyond = (F.col("tie") > F.col("tie_cut")) | ((F.col("tie") == F.col("tie_cut")) & ~F.col("tie_left"))
        right = (F.col("bin") > F.col("bin_cut")) | ((F.col("bin") == F.col("bin_cut")) & beyond)
        now = placed.join(first, "node").join(second, "node").select(
            *points.columns, (F.col("node") * 2 + right.cast("long")).alias("node")
        )
    return now.select("group", "node")


def shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source", "n_chars"), levels: int = 4
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): 2^levels shards of nearly equal bytes.

    Metadata of strings is placed by a hash in [0, 1), numbers by their logarithm.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def place(c: str):
        if kinds[c] == "string":
            found = F.pmod(F.xxhash64(c), F.lit(1 << 20)) / float(1 << 20)
        else:
            found = F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))
        return F.coalesce(found, F.lit(-1.0))

    sized = materialize(docs.select(
        F.col(doc_id).alias("id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("hash"),
        *[place(c).alias(f"d{k}") for k, c in enumerate(dims)],
    ), "sized")
    names = [f"d{k}" for k in range(len(dims))]
    sized = sized.withColumn("group", F.concat_ws(":", F.col("hash"), F.col("text_crc32"), F.col("size")))
    points = sized.groupBy("group").agg(
        F.first("hash").alias("hash"), F.sum("size").cast("double").alias("weight"), *[F.min(d).alias(d) for d in names]
    )
    leaves = materialize(kd_tree(materialize(points, "points"), names, levels), "leaves")
    placed = materialize(
        sized.join(leaves, "group").select("id", "size", "text_crc32", "hash", F.col("node").cast("int").alias("shard")), "shards"
    )
    ranked = with_rank(placed, ["shard"], ["id", "hash"], "slot")
    return ranked.select(F.col("id").alias(doc_id), "size", "text_crc32", "shard", "slot")


@query("op10_sharding")
def op10(spark, sf_dir):
    found = shards(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
