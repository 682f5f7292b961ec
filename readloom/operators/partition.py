"""Reads divided by whether results mention them, resume offsets, and extraction of references."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from readloom.schema import InvalidParameter, MissingMapping


def matched(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """Reads whose id is among ids; duplicates stay."""
    return reads.join(ids.select("read_id"), "read_id", "left_semi")


def unmatched(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """The other reads; with matched() they make up the input exactly."""
    return reads.join(ids.select("read_id"), "read_id", "left_anti")


def resume_offset(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (resume_offset): 1 + the largest ordinal of a read in ids, 0 if there is none."""
    return matched(reads, ids).agg(F.coalesce(F.max("read_ord") + 1, F.lit(0)).cast("bigint").alias("resume_offset"))


def combine_offsets(resume: int, requested: int, mode: str = "exact") -> int:
    """exact: the larger, as both are absolute; compat: their sum, which skips reads when both are used."""
    if mode not in ("exact", "compat"):
        raise InvalidParameter(f"resume mode must be exact or compat, not {mode!r}")
    return resume + requested if mode == "compat" else max(resume, requested)


def skip_reads(reads: DataFrame, offset: int) -> DataFrame:
    return reads.where(F.col("read_ord") >= offset)


def apply_mapping(fasta: DataFrame, mapping: DataFrame, skip_missing: bool = False) -> DataFrame:
    """fasta (header, ...) with tax_id and gi of its mapping; records without one go, or end the query."""
    if skip_missing:
        return fasta.join(mapping, "header")
    joined = fasta.join(mapping.withColumn("__found", F.lit(True)), "header", "left")
    header = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit(f"{MissingMapping.__name__}: "), F.col("header")))).otherwise(F.col("header"))
    return joined.withColumn("header", header).drop("__found")


def missing_mapping(fasta: DataFrame, mapping: DataFrame) -> DataFrame:
    return fasta.join(mapping.select("header"), "header", "left_anti")


def valid_taxids(arguments: list[str]) -> list[int]:
    """Command-line taxids; those that are no u32 are left out."""
    return [int(a) for a in arguments if a.lstrip("+").isdigit() and a.isascii() and int(a) < 2**32 and a.count("+") <= 1]


def extract_references(refs: DataFrame, tax_ids: list[int]) -> DataFrame:
    """(arg_ord, n, tax_id, seq): the sequences of each requested taxon, numbered from 1, in argument order; repeats repeat.

    The filter on tax_id is pushed to the scan; only the few wanted rows are joined and numbered.
    """
    wanted = refs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(tax_ids)], "arg_ord int, tax_id bigint")
    rows = refs.where(F.col("tax_id").isin(sorted(set(tax_ids)))).join(F.broadcast(wanted), "tax_id")
    n = F.row_number().over(W.partitionBy("arg_ord").orderBy("ord", "gi"))
    return rows.select("arg_ord", n.alias("n"), "tax_id", "seq")
