"""Filling fixed-capacity containers with items by sum-of-squares packing.

Each document goes where the sum over residual gaps of the squared number of open bins becomes smallest:
moving a bin from gap ``g`` to ``g - size`` changes the sum by ``2 (N[g - size] - N[g]) + 2``, a new bin
by ``2 N[capacity - size] + 1``; full bins are closed.  Documents larger than the capacity are split into
full pieces and one rest; no other document is split.

The sequence is packed in shards of about ``SHARD_ITEMS`` pieces chosen by a seeded hash, so that a hot
source never makes a hot task; each shard leaves only its own few open bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import VOCABULARY, count_tokens

SHARD_ITEMS = 20_000
SEED = 17


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, numbered from 0 in order of opening.  Ties go to the smallest gap, then to a new bin."""
    count = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    bins = 0
    for i, s in enumerate(sizes):
        s = int(s)
        if s >= capacity:
            out[i] = bins
            bins += 1
            continue
        open_ = count[s:capacity]
        cost = 2 * (count[: capacity - s] - open_) + 2
        cost[0] -= 1  # an exactly filled bin is closed and no longer counts
        gap = -1
        if bins:
            cost[open_ == 0] = 1 << 60
            at = int(np.argmin(cost))
            if cost[at] <= 2 * count[capacity - s] + 1:
                gap = at + s
        if gap < 0:
            b, left = bins, capacity - s
            bins += 1
        else:
            b, left = stacks[gap].pop(), gap - s
            count[gap] -= 1
        out[i] = b
        if left:
            count[left] += 1
            stacks.setdefault(left, []).append(b)
    return out


def pack(documents: DataFrame, limits: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(container, capacity_tokens, bin, doc_id, piece, tokens)``: every piece of every document once.

    ``bin`` is unique within a container kind; ``piece`` counts from 0 within a split document.  Null and
    empty texts have no tokens and take no space.  Containers without a positive capacity are left out, as
    are rows without id; a repeated id is placed once per row.
    """
    sized = materialize(count_tokens(documents.where(F.col(doc_id).isNotNull()), text, (doc_id,), path).select(F.col(doc_id).cast("long").alias("doc_id"), "tokens").where("tokens > 0"), "sizes")
    kinds = limits.where("capacity_tokens > 0 AND container IS NOT NULL").select("container", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct().collect()
    schema = "container string, capacity_tokens long, bin long, doc_id long, piece int, tokens long"
    if not kinds:
        return documents.sparkSession.createDataFrame([], schema)
    # pieces of each kind of container, which a corpus of long documents has many more of than documents
    total = sized.agg(*[F.sum(F.ceil(F.col("tokens") / r[1])).cast("long") for r in kinds]).first()
    shards = [max(1, -(-(n or 0) // shard_items)) for n in total]
    kind = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("container"), F.lit(r[1]).alias("capacity_tokens"), F.lit(int(n)).cast("long").alias("shards")) for r, n in zip(kinds, shards)]))
    items = sized.withColumn("k", kind).select("doc_id", "tokens", "k.*")
    pieces = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity_tokens")).cast("int"))
    items = items.withColumn("piece", F.explode(pieces)).withColumn("size", F.least("capacity_tokens", F.col("tokens") - F.col("piece") * F.col("capacity_tokens")))
    placed = items.select("container", "capacity_tokens", "doc_id", "piece", "size", "shards", F.xxhash64("doc_id", "piece", F.lit(SEED)).alias("h")).withColumn("shard", F.pmod("h", "shards"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "piece"], kind="stable")
        bins = sum_of_squares(pdf["size"].to_numpy(), int(key[1]))
        return pd.DataFrame({"container": pdf["container"], "capacity_tokens": pdf["capacity_tokens"], "bin": bins * pdf["shards"].to_numpy() + int(key[2]), "doc_id": pdf["doc_id"], "piece": pdf["piece"], "tokens": pdf["size"]})

    return placed.groupBy("container", "capacity_tokens", "shard").applyInPandas(run, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """``(container, capacity_tokens, bins, pieces, tokens, overfull, fill)`` per container kind."""
    per_bin = packed.groupBy("container", "capacity_tokens", "bin").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return per_bin.groupBy("container", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("bins"),
        F.sum("n").alias("pieces"),
        F.sum("t").alias("tokens"),
        F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"),
        F.round(F.sum("t") / F.sum("capacity_tokens"), 6).alias("fill"),
    )
