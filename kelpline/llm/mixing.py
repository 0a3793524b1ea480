"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length.  Each source gets a budget of tokens; whole passes over the
source come first, and the rest is fitted by a proportional choice of each length and a bounded-knapsack
dynamic program over the last ``WINDOW`` tokens.  Within a length, documents are chosen by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import salted_join
from ..session import materialize
from .tokens import VOCABULARY, count_tokens

SEED = 23
#: tokens that the dynamic program fits exactly
WINDOW = 32_768
#: parts of the hash space for exact ranks within a length
BUCKETS = 256


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take for a total as near below ``budget`` as can be reached."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64).copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((lengths * take).sum())
    rng = np.random.default_rng(seed)
    # from the proportional choice down to the window, one document at a time in seeded order
    moved = True
    while rest > window and moved:
        moved = False
        for i in rng.permutation(len(lengths)):
            if take[i] < counts[i] and lengths[i] <= rest - window // 2:
                take[i] += 1
                rest -= int(lengths[i])
                moved = True
                if rest <= window:
                    break
    parts: list[tuple[int, int]] = []
    for i in rng.permutation(len(lengths)):
        left, size = min(int(counts[i] - take[i]), rest // int(lengths[i])), 1
        while left > 0:
            n = min(size, left)
            parts.append((int(i), n))
            left -= n
            size *= 2
    mask = (1 << (rest + 1)) - 1
    reach, states = 1, []
    for i, n in parts:
        states.append(reach)
        reach |= (reach << (n * int(lengths[i]))) & mask
        if reach >> rest & 1:
            break
    goal = reach.bit_length() - 1
    for (i, n), before in zip(reversed(parts[: len(states)]), reversed(states)):
        w = n * int(lengths[i])
        if not before >> goal & 1:
            take[i] += n
            goal -= w
    return take


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``(source, tokens, full, extra)``: copies of every document of a length, and how many get one more."""
    goals = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").cast("long").alias("cap"))
    hist = materialize(sized.join(F.broadcast(goals) if _small(targets) else goals, "source", "left_semi").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
    have = hist.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("have")).join(goals, "source").where("have > 0 AND cap > 0")
    # one number: the largest total at which every present source can meet its share within its cap
    row = have.agg(F.sum("share").alias("present"), F.min(F.col("cap") * F.col("have") / F.col("share")).alias("most")).first()
    schema = "source string, tokens long, full long, extra long"
    if row is None or row["present"] is None:
        return sized.sparkSession.createDataFrame([], schema)
    present = float(row["present"])
    largest = int(row["most"] * present)
    budget = largest if total_tokens is None else total_tokens
    goals_of = have.select("source", F.floor(F.lit(float(budget)) * F.col("share") / F.lit(present)).cast("long").alias("budget"), "cap", "have")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tokens")
        lengths, counts = pdf["tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        have, cap = int(pdf["have"].iloc[0]), int(pdf["cap"].iloc[0])
        want = min(int(pdf["budget"].iloc[0]), cap * have)
        full, rest = divmod(want, have)
        extra = fit_budget(lengths, counts, rest) if full < cap else np.zeros(len(lengths), np.int64)
        return pd.DataFrame({"source": pdf["source"], "tokens": lengths, "full": full, "extra": extra})

    return hist.join(goals_of, "source").groupBy("source").applyInPandas(run, schema)


def _small(df: DataFrame, rows: int = 10_000) -> bool:
    """Checked before a side is broadcast: has it at most ``rows`` rows?"""
    return df.limit(rows + 1).count() <= rows


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens, copies)`` for every document used, ``copies`` at most ``max_repeats``.

    ``total_tokens`` is the size of the mix; by default the largest at which every source that occurs can
    meet its share within its cap.  Shares are taken relative to the sources that occur.  Null and empty
    texts, null sources and sources without a target are not used.
    """
    sized = materialize(count_tokens(documents.where(F.col(source).isNotNull() & F.col(doc_id).isNotNull()), text, (doc_id, source), path).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), "tokens").where("tokens > 0"), "mix-sizes")
    counts = materialize(plan(sized, targets, total_tokens), "mix-plan")
    # exact ranks in two steps: whole hash buckets, then the rows of the one bucket in which the count ends
    h = F.xxhash64("doc_id", F.lit(SEED))
    rows = salted_join(sized, counts, ["source", "tokens"], "inner", by="doc_id").withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    per = rows.groupBy("source", "tokens", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("extra").alias("extra"))
    w = Window.partitionBy("source", "tokens").orderBy("bucket")
    edges = per.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("left", F.col("extra") - F.col("before")).select("source", "tokens", "bucket", "left", "n")
    rows = rows.join(edges.withColumnRenamed("n", "in_bucket"), ["source", "tokens", "bucket"])
    sure = rows.where((F.col("left") <= 0) | (F.col("left") >= F.col("in_bucket"))).withColumn("more", (F.col("left") > 0).cast("long"))
    edge = rows.where((F.col("left") > 0) & (F.col("left") < F.col("in_bucket")))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "bucket").orderBy("h", "doc_id"))
    edge = edge.withColumn("rn", rank).withColumn("more", (F.col("rn") <= F.col("left")).cast("long")).drop("rn")
    chosen = sure.unionByName(edge).withColumn("copies", F.col("full") + F.col("more"))
    return chosen.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, documents, tokens, most_copies, actual_share)`` for every target."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["documents", "tokens", "most_copies"])
    total = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("total"))
    return out.join(F.broadcast(total)).withColumn("actual_share", F.round(F.col("tokens") / F.col("total"), 6)).drop("total")
