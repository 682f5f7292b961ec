"""Merging of result sets: lowest edit by taxon or by (taxon, gi), set union, and support by taxon."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from readloom.schema import InvalidParameter


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def collapse_taxid(hits: DataFrame) -> DataFrame:
    """Lowest edit of each (read_id, tax_id); partial aggregation runs before the one shuffle."""
    return hits.groupBy("read_id", "tax_id").agg(F.min("edit").alias("edit"))


def collapse_taxid_gi(hits: DataFrame) -> DataFrame:
    """Lowest (edit, offset) of each (read_id, tax_id, gi).

    Hits without gi end the query, and so does a mix of hits with and without offset anywhere in the input. The groups
    count their hits, so the mix is found from the same shuffle that finds the lowest, as one row joined by broadcast.
    """
    least = hits.groupBy("read_id", "tax_id", "gi").agg(F.min(F.struct("edit", "offset")).alias("m"), F.count("offset").alias("placed"), F.count(F.lit(1)).alias("n"))
    forms = least.agg(F.count_if(F.col("gi").isNull()).alias("no_gi"), F.sum("placed").alias("placed"), F.sum("n").alias("all"))
    bad = F.when(F.col("no_gi") > 0, F.raise_error(F.lit("a hit has no gi"))).when((F.col("placed") > 0) & (F.col("placed") < F.col("all")), F.raise_error(F.lit("hits with and without offset are mixed"))).otherwise(F.lit(True))
    return least.drop("n", "placed").join(F.broadcast(forms.where(bad).select("all"))).select("read_id", "tax_id", "gi", F.col("m.offset").alias("offset"), F.col("m.edit").alias("edit"))


def collapse(hits: DataFrame, mode: str = "taxid") -> DataFrame:
    if mode not in ("taxid", "taxid-gi"):
        raise InvalidParameter(f"mode must be taxid or taxid-gi, not {mode!r}")
    return collapse_taxid(hits) if mode == "taxid" else collapse_taxid_gi(hits)


def collapse_union(findings: DataFrame) -> DataFrame:
    """Distinct taxa of each read over all inputs (read_id, taxa) -> (read_id, taxa)."""
    flat = findings.select("read_id", F.explode("taxa").alias("tax_id")).distinct()
    return flat.groupBy("read_id").agg(F.array_sort(F.collect_list("tax_id")).alias("taxa"))


def _support(hits: DataFrame) -> DataFrame:
    """classify_support, and whether a row is the first of its read."""
    w = W.partitionBy("read_id")
    t = collapse_taxid(hits).withColumns({"best": F.min("edit").over(w), "n": F.count(F.lit(1)).over(w), "first": F.col("tax_id") == F.min("tax_id").over(w)})
    t = t.withColumn("n_best", F.count_if(F.col("edit") == F.col("best")).over(w))
    kind = F.when(F.col("n") == 1, "only_hit").when(F.col("edit") > F.col("best"), "not_best").when(F.col("n_best") == 1, "only_best").otherwise("tied_best")
    return t.select("read_id", "tax_id", "edit", kind.alias("class"), "first")


def classify_support(hits: DataFrame) -> DataFrame:
    """(read_id, tax_id, edit, class): only_hit, only_best, tied_best or not_best within the read."""
    return _support(hits).drop("first")


def taxon_report(hits: DataFrame) -> DataFrame:
    """Reads of each taxon by class, with percentages of all reads that have a hit: a read counts at its first taxon, so
    the total is a sum over the counts of taxa."""
    counts = _support(hits).groupBy("tax_id").agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("only_hit", "only_best", "tied_best", "not_best")], F.count(F.lit(1)).alias("total_reads"), F.count_if("first").alias("reads"))
    total = counts.agg(F.sum("reads").alias("all_reads"))
    denominator = F.greatest(F.col("all_reads"), F.lit(1)).cast("double")
    pct = lambda c: (F.col(c).cast("double") / denominator * F.lit(100.0))
    return counts.join(F.broadcast(total)).select(
        "tax_id", *[x for c in ("only_hit", "only_best", "tied_best", "not_best") for x in (F.col(c), pct(c).alias(f"{c}_pct"))],
        "total_reads", pct("total_reads").alias("total_pct"))
