"""FASTA and FASTQ as DataFrames.

read_reference_fasta splits large files through Spark's text reader. read_fastx keeps exact record ordinals: one
partition a file, gzip recognised by its first two bytes whatever the file is called.
"""
from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.functions.sequence import header_parts_or_fail
from readloom.schema import InvalidParameter, READS, ReadloomError


def open_maybe_gzip(path: str) -> io.TextIOBase:
    raw = open(path, "rb")
    magic = raw.read(2)
    raw.seek(0)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if magic == b"\x1f\x8b" else raw, encoding="utf-8", newline="")


def parse_fasta(lines: Iterator[str]) -> Iterator[tuple]:
    name, parts = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if name is not None:
                yield (*name, "".join(parts), None)
            words = line[1:].split(None, 1)
            name, parts = (line[1:].split(" ")[0].split("\t")[0], words[1] if len(words) > 1 else None), []
        elif name is None:
            if line.strip():
                raise ReadloomError(f"FASTA must start with '>': {line[:60]!r}")
        else:
            parts.append(line.strip())
    if name is not None:
        yield (*name, "".join(parts), None)


def parse_fastq(lines: Iterator[str]) -> Iterator[tuple]:
    it = iter(lines)
    for line in it:
        line = line.rstrip("\r\n")
        if not line.strip():
            continue
        if not line.startswith("@"):
            raise ReadloomError(f"FASTQ record must start with '@': {line[:60]!r}")
        head, seq = line[1:].split(None, 1), []
        for line in it:
            line = line.rstrip("\r\n")
            if line.startswith("+"):
                break
            seq.append(line)
        else:
            raise ReadloomError("FASTQ record without a '+' line")
        text, qual = "".join(seq), ""
        while len(qual) < len(text):
            part = next(it, None)
            if part is None:
                raise ReadloomError("FASTQ record with a short quality line")
            qual += part.rstrip("\r\n")
        if len(qual) != len(text):
            raise ReadloomError("FASTQ quality is longer than its sequence")
        yield head[0] if head else "", head[1] if len(head) > 1 else None, text, qual


PARSERS = {"fasta": parse_fasta, "fastq": parse_fastq}


#: Ordinals of a file start at its number times this.
FILE = 1 << 40


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.first = path, number * FILE


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.parse = options["paths"].split("\n"), PARSERS[options["kind"]]

    def partitions(self) -> list[_File]:
        return [_File(p, i) for i, p in enumerate(self.paths)]

    def read(self, part: _File) -> Iterator[tuple]:
        with open_maybe_gzip(part.path) as lines:
            for i, (name, desc, seq, qual) in enumerate(self.parse(lines)):
                yield part.first + i, name, desc, seq, qual, part.path


class FastxSource(DataSource):
    """format("readloom_fastx") with options kind (fasta or fastq) and paths (one a line)."""

    @classmethod
    def name(cls) -> str:
        return "readloom_fastx"

    def schema(self) -> str:
        return "read_ord bigint, read_id string, desc string, seq string, qual string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_fastx(spark: SparkSession, paths: str | list[str], kind: str, offset: int = 0) -> DataFrame:
    """Records (read_ord, read_id, desc, seq, qual, path); ordinals below offset are skipped.

    read_ord counts from 0 in the first file, from FILE in the second and so on: unique, and in the order of the input. Empty files give no rows; a malformed record ends the query.
    """
    kind = kind.lower()
    if kind not in PARSERS:
        raise InvalidParameter(f"input kind must be FASTA or FASTQ, not {kind!r}")
    spark.dataSource.register(FastxSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("readloom_fastx").option("kind", kind).option("paths", "\n".join(paths)).load().where(F.col("read_ord") >= offset)


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def read_reference_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(header, desc, seq, ord) of FASTA files of any size; files are split between tasks at record starts.

    ord is unique and rises with files by name, the place of the split in its file, and the record in the split.
    """
    record = F.regexp_replace(F.col("value"), "^>", "")
    line = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s", "")
    text = spark.read.option("lineSep", "\n>").text(paths)
    number = {_plain(p): i for i, p in enumerate(sorted(text.inputFiles()))}
    known = F.create_map(*[F.lit(x) for kv in number.items() for x in kv]) if number else F.lit(None).cast("map<string,int>")
    name = F.regexp_replace("file", "^file:/+", "/")
    file = F.coalesce(F.element_at(known, name), F.raise_error(F.concat(F.lit("unlisted input file "), name)).cast("int"))
    # a split has at most 2^33 records, as partitions do in Spark's own ids
    place = F.col("begin").cast("decimal(38,0)") * F.lit(1 << 33) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ord_ = (file.cast("decimal(7,0)") * F.lit(Decimal(10**30)) + place).cast("decimal(38,0)")
    found = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")).withColumn("ord", ord_)
    return (found.where(F.trim("value") != "")
            .select(F.regexp_extract(line, r"^(\S*)", 1).alias("header"), F.nullif(F.regexp_extract(line, r"^\S*\s+(.*)$", 1), F.lit("")).alias("desc"), body.alias("seq"), "ord"))


def references_by_header(fasta: DataFrame) -> DataFrame:
    """References (tax_id, gi, ord, seq) from records named GI-TAXID, in the order of the files."""
    parsed = fasta.withColumn("h", header_parts_or_fail(F.col("header")))
    return parsed.select("h.tax_id", "h.gi", "ord", "seq")


def probe(df: DataFrame) -> DataFrame:
    """Fails early, with a clear message, when there is no record."""
    if df.isEmpty():
        raise ReadloomError("the input holds no record")
    return df
