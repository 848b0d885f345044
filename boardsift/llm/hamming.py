"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code has four segments of 16 bits, and codes are indexed by each segment's value.  In round s every open
query visits the buckets whose value differs from its own segment in exactly s bits.  A code within distance
4 s + 3 must agree with the query on some segment up to s bits, so after round s all of them have been seen: a query
is done when its k-th distance is at most that.  Equal codes are one entry of the index (with its smallest ids), and
equal queries are one query, so a code that a third of all rows share costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardsift.llm.common import arrow_batches, staged

SEGMENTS, BITS = 4, 16
K = 10
#: Numbers below 2^16 by how many bits they have.
_BY_WEIGHT = [np.flatnonzero(np.bitwise_count(np.arange(1 << BITS)) == s) for s in range(BITS + 1)]


def sign_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id and its code: bit i is set where component i is over 0 (null and NaN components: not set).  Rows whose
    vector or id is null have no code and are left out; vectors of over 64 components are refused."""
    bits = F.expr("aggregate(transform(embedding, (x, i) -> CASE WHEN x > 0 AND NOT isnan(x) THEN shiftleft(1L, i) ELSE 0L END), 0L, (a, b) -> a | b)")
    code = F.when(F.size("embedding") > 64, F.raise_error(F.lit("a vector has over 64 components"))).otherwise(bits)
    return embeddings.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), code.cast("long").alias("code")).distinct()


def _segment(code, j: int):
    return F.shiftrightunsigned(code, BITS * j).bitwiseAND(F.lit((1 << BITS) - 1))


def _probes(exists: np.ndarray, radius: int):
    """The index's buckets that differ from a query's segment in ``radius`` bits."""
    masks = _BY_WEIGHT[radius]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query = batch.column("query").to_numpy()
            for part in (query[i : i + 256] for i in range(0, len(query), 256)):
                for j in range(SEGMENTS):
                    value = ((part.view(np.uint64) >> np.uint64(BITS * j)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    near = value[:, None] ^ masks[None, :]
                    row, column = np.nonzero(exists[j][near])
                    yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(np.full(len(row), j, np.int64)), pa.array(near[row, column])], names=["query", "segment", "value"])

    return work


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k nearest codes of every query: vec_id, rank (from 1), neighbor_id, distance.

    ``codes`` and ``queries`` hold vec_id and code.  A query's own id is no neighbour of it; ties go to the smaller
    id; a query with fewer than k others gets them all.  Repeated rows count once, other columns are ignored, and
    without codes or queries the result is empty.
    """
    codes, queries = codes.select("vec_id", "code"), queries.select("vec_id", "code")
    order = Window.partitionBy("code").orderBy("vec_id")
    # of a code's ids the k + 1 smallest are enough, as one of them may be the query itself; the limit is taken before rows move
    index = codes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    index = staged(index.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "codes")
    entry = F.explode(F.array(*(F.struct(F.lit(j).cast("long").alias("segment"), _segment(F.col("code"), j).alias("value")) for j in range(SEGMENTS))))
    buckets = staged(index.select("code", F.element_at("ids", 1).alias("first_id"), F.size("ids").alias("n"), entry.alias("e")).select("code", "first_id", "n", "e.segment", "e.value"), "buckets")
    # at most SEGMENTS * 2^16 buckets, however many codes
    exists = np.zeros((SEGMENTS, 1 << BITS), bool)
    for row in buckets.select("segment", "value").distinct().toLocalIterator():
        exists[row["segment"], row["value"]] = True
    arrow_batches(codes)
    open_ = staged(queries.select(F.col("code").alias("query")).distinct(), "open")
    found = None
    done = []
    nearest = Window.partitionBy("query").orderBy("distance", "first_id")
    for radius in range(BITS + 1):
        probes = open_.mapInArrow(_probes(exists, radius), "query long, segment long, value long")
        # merged: how many buckets a query visits can't be told from the size of the queries, and either side may be large
        met = probes.join(buckets.hint("merge"), ["segment", "value"])
        differ = F.col("code").bitwiseXOR(F.col("query"))
        met = met.withColumn("distance", F.bit_count(differ).cast("long"))
        # a code met by several segments counts where it was met first
        for j in range(SEGMENTS):
            apart = F.bit_count(_segment(differ, j))
            met = met.where(F.when(F.col("segment") > j, apart > radius).otherwise(apart >= radius))
        met = met.select("query", "code", "first_id", "n", "distance")
        if found is not None:
            met = met.unionByName(found.join(open_, "query", "left_semi"))
        met = met.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
        # the distance at which k ids besides the query's own are sure
        met = met.withColumn("upto", F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
        whole = Window.partitionBy("query")
        met = met.withColumn("kth", F.min(F.when(F.col("upto") > k, F.col("distance"))).over(whole))
        found = staged(met.select("query", "code", "first_id", "n", "distance", "kth"), f"round{radius}")
        covered = SEGMENTS * (radius + 1) - 1
        closed = F.col("kth") <= covered if radius < BITS else F.lit(True)
        done.append(found.where(F.coalesce(closed, F.lit(False))))
        if radius == BITS:
            break
        left = open_.join(done[-1].select("query").distinct(), "query", "left_anti")
        open_ = staged(left, f"open{radius}")
        found = found.drop("kth")
        if open_.isEmpty():
            break
    best = done[0].select("query", "code", "distance")
    for more in done[1:]:
        best = best.unionByName(more.select("query", "code", "distance"))
    near = best.join(index, "code").select("query", F.explode("ids").alias("id"), "distance")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("place") <= k + 1)
    near = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    mine = queries.select("vec_id", F.col("code").alias("query")).distinct().join(near, "query")
    others = F.slice(F.expr("filter(near, x -> x.id <> vec_id)"), 1, k)
    out = mine.select("vec_id", F.posexplode(others).alias("at", "x"))
    return out.select("vec_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"))
