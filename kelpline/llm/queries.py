"""Queries of the training-data operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import codepairs, encoding, knn, markup, mixing, packing, residue, scans, syntax


def _records(spark: SparkSession, d: str, points: bool = False, images: bool = False) -> DataFrame:
    """``(record_table, record_id, text)`` of documents and of points or images."""
    out = table(spark, d, "documents").select(F.lit("documents").alias("record_table"), F.col("doc_id").alias("record_id"), "text")
    if points:
        out = out.unionByName(table(spark, d, "points").select(F.lit("points").alias("record_table"), F.col("id").alias("record_id"), F.col("document").alias("text")))
    if images:
        out = out.unionByName(table(spark, d, "images").select(F.lit("images").alias("record_table"), F.col("image_id").alias("record_id"), F.col("surrounding_text").alias("text")))
    return out


def p2_found(spark, d):
    return syntax.check_files(table(spark, d, "source_files"), ("file_id",)).where("NOT valid").select("file_id").distinct()


def p2_files(spark, d):
    return syntax.check_files(table(spark, d, "source_files"))


def p2_rates(spark, d):
    return syntax.invalid_rates(syntax.check_files(table(spark, d, "source_files")))


def p3_found(spark, d):
    done = markup.clean_markup(_records(spark, d, points=True), keep=("record_table", "record_id"))
    return done.where(F.size("families") > 0).select("record_table", "record_id").distinct()


def p3_clean(spark, d):
    return markup.clean_markup(_records(spark, d, points=True), keep=("record_table", "record_id"))


def p4_found(spark, d):
    return codepairs.documented_symbols(table(spark, d, "source_files"), table(spark, d, "symbols")).select("file_id", "qualified_name")


def p4_pairs(spark, d):
    return codepairs.documented_symbols(table(spark, d, "source_files"), table(spark, d, "symbols"))


def p5_found(spark, d):
    return encoding.repair_encoding(table(spark, d, "documents")).where("garbled").select("doc_id").distinct()


def p5_restored(spark, d):
    return encoding.repair_encoding(table(spark, d, "documents"))


def p6_found(spark, d):
    return knn.neighbour_pairs(table(spark, d, "points"))


def p6_neighbours(spark, d):
    return knn.neighbours(table(spark, d, "points"))


def p7_found(spark, d):
    return scans.noisy_records(scans.repair_scans(_records(spark, d, images=True)))


def p7_paragraphs(spark, d):
    return scans.repair_scans(_records(spark, d, images=True))


def p8_packed(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p8_fill(spark, d):
    return packing.fill_report(p8_packed(spark, d))


def p9_mixed(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.share_report(p9_mixed(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return residue.template_residue(table(spark, d, "documents")).select("doc_id")


def p10_kept(spark, d):
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "lang", "source", "text")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_files, p2_rates, p3_found, p3_clean, p4_found, p4_pairs, p5_found, p5_restored, p6_found, p6_neighbours,
        p7_found, p7_paragraphs, p8_packed, p8_fill, p9_mixed, p9_shares, p10_found, p10_kept,
    )
}

ORACLES = {
    "p6_found": """
        WITH v AS (
            SELECT id, max(vector)::DOUBLE[] AS x FROM points
            WHERE vector IS NOT NULL AND len(list_filter(vector, lambda y: y <> 0)) > 0 GROUP BY id
        ), s AS (
            SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 12) AS sim FROM v a JOIN v b ON a.id <> b.id
        ), t AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s) WHERE rn <= 5)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t
    """,
}
