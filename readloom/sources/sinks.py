"""Lines, reports and FASTA/FASTQ files out of DataFrames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def default_line(key: list[str], hits: DataFrame, read_id: str = "read_id") -> DataFrame:
    """READ:TAX=EDIT,... by taxon, lowest edit of each; reads without hits have no line."""
    least = hits.groupBy(*key, read_id, "tax_id").agg(F.min("edit").alias("edit"))
    items = F.array_sort(F.collect_list(F.struct("tax_id", "edit")))
    text = F.array_join(F.transform(items, lambda h: F.concat_ws("=", h["tax_id"].cast("string"), h["edit"].cast("string"))), ",")
    return least.groupBy(*key, read_id).agg(F.concat(F.first(read_id), F.lit(":"), text).alias("line"))


def long_line(key: list[str], hits: DataFrame, read_id: str = "read_id") -> DataFrame:
    """READ:TAX-GI-OFFSET=EDIT,... by (taxon, gi, offset); the offset is left out where it is NULL."""
    least = hits.groupBy(*key, read_id, "tax_id", "gi", "offset").agg(F.min("edit").alias("edit"))
    items = F.array_sort(F.collect_list(F.struct("tax_id", "gi", "offset", "edit")))

    def one(h: Column) -> Column:
        return F.concat(F.concat_ws("-", h["tax_id"].cast("string"), h["gi"].cast("string"), h["offset"].cast("string")), F.lit("="), h["edit"].cast("string"))

    return least.groupBy(*key, read_id).agg(F.concat(F.first(read_id), F.lit(":"), F.array_join(F.transform(items, one), ",")).alias("line"))


def taxa_line(hits: DataFrame) -> DataFrame:
    """READ:TAX,TAX in numeric order."""
    taxa = F.transform(F.array_sort(F.collect_set("tax_id")), lambda t: t.cast("string"))
    return hits.where(F.col("tax_id").isNotNull()).groupBy("read_id").agg(F.concat(F.first("read_id"), F.lit(":"), F.array_join(taxa, ",")).alias("line"))


def write_lines(lines: DataFrame, path: str, append: bool = False) -> None:
    lines.select("line").write.mode("append" if append else "overwrite").text(path)


REPORT_COLUMNS = ("only_hit", "only_best", "tied_best", "not_best")


def write_report(report: DataFrame, path: str) -> None:
    """The taxon report as one TSV file, percentages with two decimals.

    It has a row a taxon, so it is small; Python formats it, since Java rounds halves of the decimal text instead of the binary value.
    """
    def text(rows):
        for r in rows:
            cells = [str(r["tax_id"])]
            for c in (*REPORT_COLUMNS, "total"):
                n, p = r["total_reads" if c == "total" else c], r[f"{c}_pct"]
                cells += [str(n), f"{p:.2f}"]
            yield ("\t".join(cells),)

    head = "\t".join(["taxid", *[x for c in REPORT_COLUMNS for x in (c, f"{c}_pct")], "total_reads", "total_pct"])
    spark = report.sparkSession
    ordered = report.orderBy("tax_id").coalesce(1)
    body = ordered.rdd.mapPartitions(lambda rows: [("\n".join([head, *[x[0] for x in text(rows)]]),)])
    spark.createDataFrame(body, "value string").write.mode("overwrite").text(path)


def fasta_record(name: Column, seq: Column, desc: Column | None = None) -> Column:
    head = F.concat(F.lit(">"), name)
    if desc is not None:
        head = F.concat(head, F.coalesce(F.concat(F.lit(" "), desc), F.lit("")))
    return F.concat(head, F.lit("\n"), seq)


def fastq_record(name: Column, seq: Column, qual: Column, desc: Column | None = None) -> Column:
    head = F.concat(F.lit("@"), name)
    if desc is not None:
        head = F.concat(head, F.coalesce(F.concat(F.lit(" "), desc), F.lit("")))
    return F.concat(head, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def write_records(reads: DataFrame, path: str, kind: str) -> None:
    """Reads with id, description, sequence and (FASTQ) quality kept."""
    c = F.col
    record = fastq_record(c("read_id"), c("seq"), c("qual"), c("desc")) if kind.lower() == "fastq" else fasta_record(c("read_id"), c("seq"), c("desc"))
    reads.select(record.alias("value")).write.mode("overwrite").text(path)


def write_chunks(chunked: DataFrame, path: str) -> None:
    """One folder a chunk of records >gi-tax, whose files hold them in (tax_id, ord, gi) order one after the other."""
    name = F.concat_ws("-", F.col("gi").cast("string"), F.col("tax_id").cast("string"))
    n = int(chunked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["chunk_id", "tax_id", "ord", "gi", "value"]
    records = chunked.select(*order[:-1], fasta_record(name, F.col("seq")).alias("value"))
    records.repartitionByRange(n, *order).sortWithinPartitions(*order).select("chunk_id", "value").write.mode("overwrite").partitionBy("chunk_id").text(path)
