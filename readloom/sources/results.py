"""Result lines, findings and mapping files: parsing to columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from readloom.functions.sequence import strip_line_end
from readloom.schema import InvalidMapping, U32_MAX, u32, u32_or_fail

#: Fixed pattern of one hit: TAX[-GI[-OFFSET]]=EDIT.
HIT_PATTERN = r"^(\+?[0-9]+)(?:-(\+?[0-9]+))?(?:-(\+?[0-9]+))?=(\+?[0-9]+)$"
#: Delimiters of mapping files in order of preference; white space if none of them is in the header row.
DELIMITERS = (",", "\t", ";", "|")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, file) without blank lines."""
    return spark.read.text(paths).select(strip_line_end(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("file")).where(F.trim("line") != "")


def split_line(line: Column) -> tuple[Column, Column]:
    """The id and the hits of a line: the last colon divides them, as ids may hold colons."""
    hits = F.substring_index(line, ":", -1)
    read_id = F.when(line.contains(":"), F.left(line, F.length(line) - F.length(hits) - 1))
    bad = read_id.isNull() | (read_id == "")
    return F.when(bad, F.raise_error(F.concat(F.lit("line without a read id: "), line))).otherwise(read_id), hits


def hit_parts(token: Column) -> Column:
    """A token with the numbers in it and whether it is a hit; taken apart once, before its numbers are read."""
    return F.struct(token.alias("token"), F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0)).alias("n"), token.rlike(HIT_PATTERN).alias("ok"))


def hit_numbers(parts: Column) -> Column:
    """struct(tax_id, gi, offset, edit) of hit_parts, gi and offset NULL where absent; a malformed token ends the query."""
    token, n = parts["token"], parts["n"]
    number = lambda i: F.get(n, i).try_cast("bigint")
    last = F.size(n) - 1
    wide = F.exists(n, lambda x: F.coalesce(x.try_cast("bigint") > U32_MAX, F.lit(True)))
    hit = F.struct(number(F.lit(0)).alias("tax_id"), F.when(last > 1, number(F.lit(1))).alias("gi"), F.when(last > 2, number(F.lit(2))).alias("offset"), number(last).alias("edit"))
    return F.when(~parts["ok"], F.raise_error(F.concat(F.lit("invalid hit: "), token))).when(wide, F.raise_error(F.concat(F.lit("invalid number: "), token))).otherwise(hit)


def parse_hit(token: Column) -> Column:
    """One hit as struct(tax_id, gi, offset, edit)."""
    return hit_numbers(hit_parts(token))


def parse_results(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """One row a hit (read_id, tax_id, gi, offset, edit) from (line); lines without hits give no rows.

    mode "permissive" skips malformed tokens instead of failing.
    """
    read_id, hits = split_line(F.col("line"))
    tokens = F.filter(F.split(hits, ","), lambda t: t != "")
    if mode == "permissive":
        tokens = F.filter(tokens, lambda t: t.rlike(HIT_PATTERN))
    keep = [c for c in lines.columns if c not in {"line", "read_id", "tax_id", "gi", "offset", "edit"}]
    flat = lines.select(*keep, read_id.alias("read_id"), F.explode(F.transform(tokens, hit_parts)).alias("parts"))
    return flat.select(*keep, "read_id", hit_numbers(F.col("parts")).alias("h")).select(*keep, "read_id", "h.*")


def parse_findings(lines: DataFrame) -> DataFrame:
    """(read_id, taxa array<bigint>) sorted and distinct, from lines READ:TAX,TAX."""
    line = F.trim("line")
    hits = F.substring_index(line, ":", -1)
    read_id, _ = split_line(line)
    taxa = F.transform(F.filter(F.split(hits, ","), lambda t: t != ""), lambda t: u32_or_fail(F.trim(t), "invalid taxon"))
    return lines.select(read_id.alias("read_id"), F.array_sort(F.array_distinct(taxa)).alias("taxa"))


def parse_edit_findings(lines: DataFrame) -> DataFrame:
    """(read_id, hits array<struct<tax_id, gi, offset, edit>>) from lines READ:TAX=EDIT; gi and offset are 0, longer tokens fail. Other columns stay."""
    line = F.trim("line")
    read_id, hits = split_line(line)

    def one(token: Column) -> Column:
        tax, edit = F.substring_index(token, "=", 1), F.substring_index(token, "=", -1)
        return F.struct(u32_or_fail(tax, "invalid taxon").alias("tax_id"), F.lit(0).cast("bigint").alias("gi"), F.lit(0).cast("bigint").alias("offset"), u32_or_fail(edit, "invalid edit").alias("edit"))

    return lines.select(*[c for c in lines.columns if c != "line"], read_id.alias("read_id"), F.transform(F.filter(F.split(hits, ","), lambda t: t != ""), one).alias("hits"))


def read_ids(lines: DataFrame) -> DataFrame:
    """Distinct read ids of result lines."""
    return lines.select(split_line(F.col("line"))[0].alias("read_id")).distinct()


def detect_delimiter(header: str) -> str | None:
    return next((d for d in DELIMITERS if d in header), None)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(header, tax_id, gi) of a mapping file with a header row; columns in any order and case, others are ignored."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.head()
    if first is None:
        raise InvalidMapping(f"{path} is empty")
    top = first.value
    delimiter = detect_delimiter(top)
    names = [n.strip().lower() for n in (top.split(delimiter) if delimiter else top.split())]
    at = {}
    for want, accepted in (("header", ("header",)), ("tax_id", ("taxid",)), ("gi", ("seqid", "gi"))):
        found = [i for i, n in enumerate(names) if n in accepted]
        if not found:
            raise InvalidMapping(f"{path} has no column {accepted[0]}")
        at[want] = found[0]
    pattern = "\\" + delimiter if delimiter in ("|",) else delimiter or r"\s+"
    cell = F.transform(F.split(F.trim("value") if delimiter is None else F.col("value"), pattern, -1), lambda x: F.trim(x))
    get = lambda c: F.get(cell, F.lit(at[c]))
    header = F.when(F.coalesce(get("header"), F.lit("")) == "", F.raise_error(F.concat(F.lit("mapping row without a header: "), F.col("value")))).otherwise(get("header"))
    rows = lines.where(F.col("value") != top).select(header.alias("header"), u32_or_fail(get("tax_id"), "invalid taxid").alias("tax_id"), u32_or_fail(get("gi"), "invalid seqid").alias("gi"))
    return unique_headers(rows)


def unique_headers(mapping: DataFrame) -> DataFrame:
    """The mapping, or an error if a header occurs twice."""
    twice = mapping.groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.first("tax_id").alias("tax_id"), F.first("gi").alias("gi"))
    one = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate header: "), F.col("header")))).otherwise(F.col("header"))
    return twice.select(one.alias("header"), "tax_id", "gi")


__all__ = ["detect_delimiter", "parse_edit_findings", "parse_findings", "hit_numbers", "hit_parts", "parse_hit", "parse_results", "read_ids", "read_lines", "read_mapping", "split_line", "u32", "unique_headers"]
