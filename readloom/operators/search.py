"""Reads against an index: seeds, windows, ranking and verification, for both strands.

Everything is keyed by (read_ord, strand, chunk_id); limits hold within that key.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from readloom.functions.kernels import infix_edit_distance
from readloom.functions.sequence import edit_budget, mask_n, min_seeds, normalize, reverse_complement, seeds, window_bounds
from readloom.operators.index import Index, TEXT, seed_counts, seed_positions, stable, text_blocks
from readloom.schema import InvalidParameter

KEY = ["read_ord", "strand", "chunk_id"]


@dataclass(frozen=True)
class SearchParams:
    edit_rate: float = 0.13
    seed_size: int = 18
    seed_interval: int = 15
    min_seed: float = 0.015
    max_hits: int = 2000
    tune_max_hits: int = 200
    max_assignments: int | None = None
    max_candidates: int | None = None
    #: Both strands and folding to ACGTN; off for collections that are no nucleotides.
    nucleotides: bool = True
    #: No hits for reads with 2 * budget > length.
    compat: bool = False

    def __post_init__(self):
        if not 0 <= self.edit_rate <= 1:
            raise InvalidParameter("edit_rate must lie in 0..1")
        if not 0 < self.min_seed <= 1:
            raise InvalidParameter("min_seed must lie in (0, 1]")
        if self.seed_size < 1 or self.seed_interval < 1:
            raise InvalidParameter("seed_size and seed_interval must be positive")


def strands(reads: DataFrame, p: SearchParams) -> DataFrame:
    """(read_ord, read_id, strand, seq, len, budget)."""
    base = reads.select("read_ord", "read_id", (normalize(F.col("seq")) if p.nucleotides else F.col("seq")).alias("seq"))
    if p.nucleotides:
        both = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))
        base = base.select("read_ord", "read_id", F.explode(both).alias("s")).select("read_ord", "read_id", "s.strand", "s.seq")
    else:
        base = base.withColumn("strand", F.lit("+")).select("read_ord", "read_id", "strand", "seq")
    return base.withColumns({"len": F.length("seq"), "budget": edit_budget(F.length("seq"), p.edit_rate)})


def read_seeds(stranded: DataFrame, p: SearchParams) -> DataFrame:
    return stranded.select("read_ord", "strand", F.explode(seeds(F.col("seq"), p.seed_size, p.seed_interval)).alias("s")).select("read_ord", "strand", "s.q_off", "s.kmer")


def tuned_seeds(counted: DataFrame, p: SearchParams) -> DataFrame:
    """(KEY, kept array<q_off>, n_seeds, min_seeds) from (KEY, q_off, n_hits).

    A seed with more than tune_max_hits occurrences doubles the distance to the next one that is used; the doubling
    lasts for the rest of the read. Absent and over-frequent seeds have been left out before: they do not change the fold.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("next"), F.lit(p.seed_interval).cast("bigint").alias("step"), F.array().cast("array<int>").alias("kept"))

    def fold(acc, s):
        use = s["q_off"] >= acc["next"]
        wide = use & (s["n_hits"] > p.tune_max_hits)
        step = F.when(wide, acc["step"] * 2).otherwise(acc["step"])
        return F.struct(F.when(wide, s["q_off"] + step).otherwise(acc["next"]).cast("bigint").alias("next"), step.alias("step"), F.when(use, F.concat(acc["kept"], F.array(s["q_off"]))).otherwise(acc["kept"]).alias("kept"))

    kept = counted.groupBy(*KEY).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("q_off", "n_hits"))), start, fold)["kept"].alias("kept"))
    n = F.size("kept").cast("bigint")
    return kept.select(*KEY, "kept", n.alias("n_seeds"), min_seeds(n, p.min_seed).alias("min_seeds"))


def coalesce_hits(hits: DataFrame) -> DataFrame:
    """Candidates (KEY, bin_id, c_start, c_end, num_seeds, min_seeds, none_grp, island) from hits with windows s, e.

    Hits in (site, q_off) order join the open candidate of their bin while windows overlap; a hit without a valid
    window closes it. The groups come from running sums, so one shuffle on KEY serves all steps.
    """
    order = ["site", "q_off"]
    w = W.partitionBy(*KEY).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    t = hits.withColumn("none_grp", F.sum(F.col("s").isNull().cast("int")).over(w)).where(F.col("s").isNotNull())
    in_bin = W.partitionBy(*KEY, "bin_id", "none_grp").orderBy(*order)
    t = t.withColumn("prev", F.max("e").over(in_bin.rowsBetween(W.unboundedPreceding, -1)))
    t = t.withColumn("island", F.sum((F.col("prev").isNull() | (F.col("s") >= F.col("prev"))).cast("int")).over(in_bin.rowsBetween(W.unboundedPreceding, 0)))
    return (t.groupBy(*KEY, "bin_id", "none_grp", "island").agg(F.min("s").alias("c_start"), F.max("e").alias("c_end"), F.count(F.lit(1)).alias("num_seeds"), F.first("min_seeds").alias("min_seeds"))
            .where(F.col("num_seeds") >= F.col("min_seeds")))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    w = W.partitionBy(*KEY).orderBy(F.desc("num_seeds"), "bin_id", "none_grp", "island")
    return candidates.withColumn("rank", F.row_number().over(w))


def found_seeds(wanted: DataFrame, index: Index, p: SearchParams) -> tuple[DataFrame, DataFrame]:
    """Places (chunk_id, kmer, site, bin_id) of the wanted seeds, and their occurrences (chunk_id, kmer, n_hits) if 1..max_hits.

    Stored seeds are read; without them the texts are taken apart once, and what no read has is dropped before any other step.
    """
    kmers = wanted.select("kmer").distinct()
    if index.seeds is not None and index.seed_size == p.seed_size:
        found = index.seeds.where(F.col("n_hits") <= p.max_hits).join(kmers, "kmer", "left_semi")
        return found.drop("n_hits"), found.select("chunk_id", "kmer", "n_hits").distinct()
    found = stable(seed_positions(index.bins, p.seed_size).join(kmers, "kmer", "left_semi"))
    return found, seed_counts(found).where(F.col("n_hits") <= p.max_hits)


def as_index(index: Index | DataFrame) -> Index:
    return index if isinstance(index, Index) else Index(index)


def seed_hits(reads: DataFrame, index: Index | DataFrame, p: SearchParams) -> DataFrame:
    """(KEY, q_off, kmer, n_hits) for seeds with 1..max_hits occurrences."""
    wanted = read_seeds(strands(reads, p), p)
    return wanted.join(found_seeds(wanted, as_index(index), p)[1], "kmer")


def candidates(reads: DataFrame, index: Index | DataFrame, p: SearchParams) -> DataFrame:
    """Ranked candidates of every read."""
    index = as_index(index)
    stranded = strands(reads, p)
    wanted = read_seeds(stranded, p)
    positions, counts = found_seeds(wanted, index, p)
    counted = wanted.join(counts, "kmer")
    kept = tuned_seeds(counted, p).select(*KEY, "min_seeds", F.explode("kept").alias("q_off"))
    used = kept.join(counted.select(*KEY, "q_off", "kmer"), [*KEY, "q_off"])
    sites = used.join(positions, ["chunk_id", "kmer"]).join(stranded.select("read_ord", "strand", "len", "budget"), ["read_ord", "strand"])
    sites = sites.join(index.bins.select("chunk_id", "bin_id", "start", "end"), ["chunk_id", "bin_id"])
    bounds = window_bounds(F.col("site"), F.col("q_off"), F.col("len"), F.col("budget"), F.col("start"), F.col("end"))
    hits = sites.withColumn("w", bounds).select(*KEY, "bin_id", "site", "q_off", "min_seeds", F.col("w.s").alias("s"), F.col("w.e").alias("e"))
    return rank_candidates(coalesce_hits(hits))


def windows(t: DataFrame, index: Index) -> DataFrame:
    """t (KEY, rank, bin_id, chunk_id, w_start, w_len) with window, cut from those blocks of the text that it touches."""
    blocks = index.blocks if index.blocks is not None else text_blocks(index.bins)
    size = TEXT[-1]
    touched = F.sequence(F.floor(F.col("w_start") / size), F.floor((F.col("w_start") + F.col("w_len") - 1) / size))
    parts = t.select(*KEY, "rank", "bin_id", "w_start", "w_len", F.explode(touched).alias("block")).join(blocks, ["chunk_id", "bin_id", "block"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "")
    joined = parts.groupBy(*KEY, "rank").agg(whole.alias("whole"), F.min("block").alias("first"), F.first("w_start").alias("w_start"), F.first("w_len").alias("w_len"))
    cut = F.substr("whole", (F.col("w_start") - F.col("first") * size + 1).cast("int"), F.col("w_len").cast("int"))
    return t.join(joined.select(*KEY, "rank", cut.alias("window")), [*KEY, "rank"])


def verify(ranked: DataFrame, stranded: DataFrame, index: Index | DataFrame, p: SearchParams) -> DataFrame:
    """Hits (KEY, read_id, tax_id, gi, offset, edit, rank): the first candidate of each taxon within the budget, by rank."""
    index = as_index(index)
    if p.max_candidates is not None:
        ranked = ranked.where(F.col("rank") <= p.max_candidates)
    t = ranked.join(stranded, ["read_ord", "strand"]).join(index.bins.select("chunk_id", "bin_id", "tax_id", "gi", "start"), ["chunk_id", "bin_id"])
    if p.compat:
        t = t.where(2 * F.col("budget") <= F.col("len"))
    t = t.withColumns({"w_start": F.col("c_start") - F.col("start"), "w_len": F.col("c_end") - F.col("c_start")})
    t = windows(t, index).select(*KEY, "read_id", "tax_id", "gi", F.col("w_start").alias("offset"), "rank", "budget", infix_edit_distance(mask_n(F.col("seq")), F.col("window")).cast("bigint").alias("edit"))
    t = t.where(F.col("edit") <= F.col("budget"))
    first = F.row_number().over(W.partitionBy(*KEY, "tax_id").orderBy("rank"))
    t = t.withColumn("nth", first).where(F.col("nth") == 1)
    if p.max_assignments is not None:
        among = F.row_number().over(W.partitionBy(*KEY).orderBy("rank"))
        t = t.withColumn("nth", among).where(F.col("nth") <= max(1, p.max_assignments))
    return t.drop("nth", "budget")


def search(reads: DataFrame, index: Index | DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """All hits (read_ord, strand, chunk_id, read_id, tax_id, gi, offset, edit, rank); reads shorter than a seed have none.

    index is a stored one, or bins alone."""
    return verify(stable(candidates(reads, index, p)), strands(reads, p), index, p)


def best_by_taxon(hits: DataFrame) -> DataFrame:
    return hits.groupBy("read_ord", "read_id", "chunk_id", "tax_id").agg(F.min("edit").alias("edit"))


def best_by_place(hits: DataFrame) -> DataFrame:
    return hits.groupBy("read_ord", "read_id", "chunk_id", "tax_id", "gi", "offset").agg(F.min("edit").alias("edit"))
