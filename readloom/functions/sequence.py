"""Scalar functions on sequences, all JVM-side columns."""
from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, functions as F

from readloom.schema import InvalidParameter, u32


def header_parts(header: Column) -> Column:
    """GI-TAXID as struct(gi, tax_id); NULL if it is anything else."""
    parts = F.split(header, "-", -1)
    gi, tax = u32(parts[0]), u32(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & gi.isNotNull() & tax.isNotNull(), F.struct(gi.alias("gi"), tax.alias("tax_id")))


def header_parts_or_fail(header: Column) -> Column:
    """As header_parts, but a bad header ends the query."""
    parsed = header_parts(header)
    return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("invalid header: "), F.coalesce(header, F.lit("(null)"))))).otherwise(parsed)


def normalize(seq: Column) -> Column:
    """Upper case; whatever is not one of ACGTN becomes N."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGTN]", "N")  # upper() would lengthen some letters


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def mask_n(seq: Column) -> Column:
    """N in a read matches nothing, so it is replaced by a character no reference holds."""
    return F.translate(seq, "N", ".")


def base_codes(seq: Column) -> Column:
    """A, C, G, T as 0 to 3 and everything else as 4, one digit a base."""
    return F.regexp_replace(F.translate(seq, "ACGT", "0123"), "[^0-3]", "4")


def edit_budget(length: Column, rate: float) -> Column:
    """ceil(length * rate) in doubles: decimal arithmetic gives other budgets (100 * 0.07)."""
    return F.ceil(length.cast("double") * F.lit(float(rate)).cast("double")).cast("int")


def seeds(seq: Column, size: int, gap: int) -> Column:
    """array<struct<q_off, kmer>> at 0, gap, 2 gap ...; empty when the sequence is shorter than a seed."""
    if size < 1 or gap < 1:
        raise InvalidParameter("seed size and gap must be positive")
    last = F.length(seq) - size
    offsets = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(gap))).otherwise(F.array().cast("array<int>"))
    return F.transform(offsets, lambda i: F.struct(i.alias("q_off"), F.substr(seq, i + 1, F.lit(size)).alias("kmer")))


def min_seeds(n_seeds: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n_seeds.cast("double") * F.lit(float(share)))).cast("bigint")


def window_bounds(site: Column, q_off: Column, length: Column, budget: Column, start: Column, end: Column) -> Column:
    """struct(s, e): where in the concatenated text a read may lie, given one seed hit; NULL if too little of it is inside its bin."""
    s = F.greatest(start.cast("bigint"), site - q_off - budget)
    e = F.least(end.cast("bigint"), site + (length - q_off) + budget)
    ok = (s < e) & (s >= start) & (e <= end) & (e - s >= length - budget)
    return F.when(ok, F.struct(s.alias("s"), e.alias("e")))


def strip_line_end(line: Column) -> Column:
    return F.regexp_replace(line, "[\r\n]+$", "")


def normalize_line(line: Column) -> Column:
    return F.concat(strip_line_end(line), F.lit("\n"))


def percentage(value: Column, total: Column) -> Column:
    return value.cast("double") / F.greatest(total, F.lit(1)).cast("double") * F.lit(100.0)


def base_name(path: str) -> str:
    return Path(path).stem


def budget_of(length: int, rate: float) -> int:
    """Driver-side twin of edit_budget, for tests and command lines."""
    return math.ceil(length * float(rate))
