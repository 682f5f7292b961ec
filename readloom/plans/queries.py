"""Every operator applied to the driver's tables, with the same query in DuckDB SQL.

References are documents (gi = doc_id, tax_id = rank of the source), reads are benchmark items, result lines are made
of lineitem. Nucleotide functions work on letters mapped to ACGT.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from readloom.functions import sequence as Q
from readloom.operators import collapse as C, index as I, partition as P, search as S
from readloom.sources import results as R, sinks

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"
#: The search is one of prose here: letters map to four bases only where a nucleotide function is shown.
PROSE = S.SearchParams(nucleotides=False)
#: Limits that bind on these tables, for the query that shows the tuning.
TIGHT = S.SearchParams(edit_rate=0.05, max_hits=400, tune_max_hits=20, nucleotides=False)
CHUNK_BYTES = 200_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def references(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    tax = F.regexp_extract("source", "([0-9]+)$", 1).cast("bigint")
    return d.select(tax.alias("tax_id"), F.col("doc_id").alias("gi"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("seq"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("read_ord"), F.concat(F.lit("b:"), F.col("item_id").cast("string")).alias("read_id"), F.coalesce("text", F.lit("")).alias("seq"))


def binned(spark: SparkSession, sf: str) -> DataFrame:
    refs = references(spark, sf).withColumn("chunk_id", F.pmod("tax_id", F.lit(4)))
    return I.bins(refs, normalized=False)


def pseudo(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


def line_hits(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r:"), c("l_orderkey").cast("string")).alias("read_id"), c("l_suppkey").alias("tax_id"), c("l_partkey").alias("gi"),
        c("l_linenumber").cast("bigint").alias("offset"), c("l_quantity").cast("bigint").alias("edit"), (c("l_linenumber") % 3).alias("file_id"))


def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.long_line(["file_id"], line_hits(spark, sf)).select("file_id", "line")


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return R.parse_results(result_lines(spark, sf))


def _order_reads(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select((F.col("o_orderkey")).alias("read_ord"), F.concat(F.lit("r:"), F.col("o_orderkey").cast("string")).alias("read_id"))


def _hit_ids(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_ids(result_lines(spark, sf).where(F.col("file_id") == 2))


def _fasta(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("header"), F.col("c_name").alias("seq"))


def _mapping(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    rows = s.select(F.concat(F.lit("Supplier#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("header"), F.col("s_nationkey").cast("bigint").alias("tax_id"), F.col("s_suppkey").alias("gi"))
    return R.unique_headers(rows)


def q_header_parse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("header"))
    return o.withColumn("h", Q.header_parts_or_fail(F.col("header"))).select("o_orderkey", "h.gi", "h.tax_id")


def q_normalize(spark, sf):
    return references(spark, sf).select("gi", Q.normalize(F.col("seq")).alias("seq"))


def q_revcomp(spark, sf):
    return references(spark, sf).select("gi", Q.reverse_complement(Q.normalize(pseudo(F.col("seq")))).alias("seq"))


def q_base_codes(spark, sf):
    return reads(spark, sf).select("read_ord", Q.base_codes(Q.normalize(F.col("seq"))).alias("codes"), Q.mask_n(Q.normalize(F.col("seq"))).alias("masked"))


def q_edit_budget(spark, sf):
    return references(spark, sf).select("gi", *[Q.edit_budget(F.length("seq"), r).cast("bigint").alias(f"b{i}") for i, r in enumerate((0.07, 0.13, 1.0))])


def q_seed_extract(spark, sf):
    return S.read_seeds(S.strands(reads(spark, sf), PROSE), PROSE).select("read_ord", F.col("q_off").cast("bigint").alias("q_off"), "kmer")


def q_bin_offsets(spark, sf):
    return binned(spark, sf).select("chunk_id", "bin_id", "tax_id", "gi", F.col("start").alias("b_start"), F.col("end").alias("b_end"))


def q_kmer_counts(spark, sf):
    p, b = PROSE, binned(spark, sf)
    wanted = S.read_seeds(S.strands(reads(spark, sf), p), p).select("kmer").distinct()
    return I.seed_counts(I.seed_positions(b, p.seed_size).join(wanted, "kmer", "left_semi"))


def q_seed_hits(spark, sf):
    h = S.seed_hits(reads(spark, sf), binned(spark, sf), PROSE)
    return h.select("read_ord", "chunk_id", F.col("q_off").cast("bigint").alias("q_off"), "kmer", "n_hits")


def q_seed_tuning(spark, sf):
    t = S.tuned_seeds(S.seed_hits(reads(spark, sf), binned(spark, sf), TIGHT), TIGHT)
    return t.select("read_ord", "chunk_id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "n_seeds", "min_seeds")


def q_rank_candidates(spark, sf):
    return S.candidates(reads(spark, sf), binned(spark, sf), PROSE).select("read_ord", "chunk_id", "bin_id", "c_start", "c_end", "num_seeds", F.col("rank").cast("bigint").alias("cand_rank"))


def q_classify_best(spark, sf):
    return S.best_by_taxon(S.search(reads(spark, sf), binned(spark, sf), PROSE))


def q_classify_long(spark, sf):
    return S.best_by_place(S.search(reads(spark, sf), binned(spark, sf), PROSE))


def q_classify_strands(spark, sf):
    p = S.SearchParams()
    r = reads(spark, sf).withColumn("seq", pseudo(F.col("seq")))
    return S.best_by_place(S.search(r, I.bins(I.single_chunk(references(spark, sf).withColumn("seq", pseudo(F.col("seq"))))), p))


def q_local_score(spark, sf):
    from readloom.functions.kernels import infix_edit_distance, local_alignment_score
    r = reads(spark, sf)
    pairs = r.alias("a").join(r.alias("b"), F.col("b.read_ord") == F.col("a.read_ord") + 1).select(F.col("a.read_ord").alias("read_ord"), F.col("a.seq").alias("x"), F.col("b.seq").alias("y"))
    return pairs.select("read_ord", local_alignment_score("x", "y").alias("score"), infix_edit_distance("x", "y").alias("edit"))


def q_chunk_assign(spark, sf):
    return I.assign_chunks(references(spark, sf), CHUNK_BYTES).select("chunk_id", "tax_id", "gi")


def q_parse_result_lines(spark, sf):
    return parsed(spark, sf)


def q_format_default(spark, sf):
    return sinks.default_line(["file_id"], line_hits(spark, sf)).select("file_id", "line")


def q_format_long(spark, sf):
    return result_lines(spark, sf)


def q_format_taxa_only(spark, sf):
    return sinks.taxa_line(line_hits(spark, sf)).select("line")


def q_parse_findings(spark, sf):
    t = R.parse_findings(sinks.taxa_line(line_hits(spark, sf)))
    return t.select("read_id", F.array_join(F.transform("taxa", lambda x: x.cast("string")), " ").alias("taxa"))


def q_parse_edit_findings(spark, sf):
    t = R.parse_edit_findings(sinks.default_line(["file_id"], line_hits(spark, sf)).select("file_id", "line"))
    return t.select("file_id", "read_id", F.explode("hits").alias("h")).select("file_id", "read_id", "h.*")


def q_collapse_taxid(spark, sf):
    return C.collapse_taxid(parsed(spark, sf))


def q_collapse_taxid_gi(spark, sf):
    return C.collapse_taxid_gi(parsed(spark, sf))


def q_collapse_union(spark, sf):
    lines = parsed(spark, sf).groupBy("file_id", "read_id").agg(F.collect_set("tax_id").alias("taxa"))
    return C.collapse_union(lines).select("read_id", F.array_join(F.transform("taxa", lambda x: x.cast("string")), " ").alias("taxa"))


def q_classify_support(spark, sf):
    return C.classify_support(parsed(spark, sf))


def q_taxon_report(spark, sf):
    return C.taxon_report(parsed(spark, sf))


def q_partition_matched(spark, sf):
    return P.matched(_order_reads(spark, sf), _hit_ids(spark, sf)).select("read_id", "read_ord")


def q_partition_unmatched(spark, sf):
    return P.unmatched(_order_reads(spark, sf), _hit_ids(spark, sf)).select("read_id", "read_ord")


def q_resume_offset(spark, sf):
    return P.resume_offset(_order_reads(spark, sf), _hit_ids(spark, sf))


def q_read_offset(spark, sf):
    return P.skip_reads(_order_reads(spark, sf), 1000)


def q_mapping_join(spark, sf):
    return P.apply_mapping(_fasta(spark, sf), _mapping(spark, sf), skip_missing=True)


def q_mapping_missing(spark, sf):
    return P.missing_mapping(_fasta(spark, sf), _mapping(spark, sf))


def q_reference_extract(spark, sf):
    return P.extract_references(references(spark, sf), P.valid_taxids(["7", "x", "3", "7", "4000000000", "99999999999"])).select(F.col("arg_ord").cast("bigint").alias("arg_ord"), F.col("n").cast("bigint").alias("n"), "tax_id", "seq")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Support by taxon of the classified reads: search, merge of chunks, report."""
    return C.taxon_report(S.best_by_taxon(S.search(reads(spark, sf), binned(spark, sf), PROSE)))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_REFS = "refs AS (SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS tax_id, doc_id AS gi, doc_id AS ord, coalesce(text, '') AS seq FROM documents)"
_READS = "reads AS (SELECT item_id AS read_ord, coalesce(text, '') AS seq FROM benchmark)"
_BINS = _REFS + """, bins AS (SELECT *, tax_id % 4 AS chunk_id, row_number() OVER w - 1 AS bin_id,
  CAST(coalesce(sum(length(seq)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b_start
  FROM refs WINDOW w AS (PARTITION BY tax_id % 4 ORDER BY tax_id, ord, gi))"""
def _seeds(p: S.SearchParams) -> str:
    return _READS + f""", seeds AS (SELECT read_ord, length(seq) AS len, q_off, substr(seq, CAST(q_off + 1 AS BIGINT), {p.seed_size}) AS kmer
  FROM reads, unnest(generate_series(0, length(seq) - {p.seed_size}, {p.seed_interval})) AS t(q_off) WHERE length(seq) >= {p.seed_size})"""


def _positions(p: S.SearchParams) -> str:
    return _BINS + ", " + _seeds(p) + f""", whole AS (SELECT chunk_id, string_agg(seq, '' ORDER BY b_start, bin_id) AS txt FROM bins GROUP BY 1),
  ext AS (SELECT b.chunk_id, bin_id, b_start, seq, substr(txt, b_start + 1, length(seq) + {p.seed_size - 1}) AS x FROM bins b JOIN whole USING (chunk_id) WHERE length(seq) > 0),
  pos AS (SELECT chunk_id, bin_id, b_start + i AS site, substr(x, CAST(i + 1 AS BIGINT), {p.seed_size}) AS kmer
  FROM ext, unnest(generate_series(0, least(length(seq) - 1, length(x) - {p.seed_size}))) AS t(i) WHERE length(x) >= {p.seed_size}),
  found AS (SELECT * FROM pos WHERE kmer IN (SELECT kmer FROM seeds)),
  kc AS (SELECT chunk_id, kmer, count(*) AS n_hits FROM found GROUP BY 1, 2),
  sh AS (SELECT read_ord, chunk_id, q_off, kmer, n_hits FROM seeds JOIN kc USING (kmer) WHERE n_hits <= {p.max_hits})"""


def _tuned(p: S.SearchParams) -> str:
    return "WITH RECURSIVE " + _positions(p) + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY read_ord, chunk_id ORDER BY q_off) AS i FROM sh),
  fold AS (SELECT read_ord, chunk_id, i, q_off, true AS used, CASE WHEN n_hits > {p.tune_max_hits} THEN {2 * p.seed_interval} ELSE {p.seed_interval} END AS step,
    CASE WHEN n_hits > {p.tune_max_hits} THEN q_off + {2 * p.seed_interval} ELSE 0 END AS nxt FROM numbered WHERE i = 1
  UNION ALL SELECT n.read_ord, n.chunk_id, n.i, n.q_off, n.q_off >= f.nxt,
    CASE WHEN n.q_off >= f.nxt AND n.n_hits > {p.tune_max_hits} THEN f.step * 2 ELSE f.step END,
    CASE WHEN n.q_off >= f.nxt AND n.n_hits > {p.tune_max_hits} THEN n.q_off + f.step * 2 ELSE f.nxt END
  FROM fold f JOIN numbered n ON n.read_ord = f.read_ord AND n.chunk_id = f.chunk_id AND n.i = f.i + 1),
  tuned AS (SELECT read_ord, chunk_id, string_agg(CAST(q_off AS VARCHAR), ',' ORDER BY q_off) AS kept, count(*) AS n_seeds,
    CAST(greatest(1, floor(CAST(count(*) AS DOUBLE) * {p.min_seed}::DOUBLE)) AS BIGINT) AS min_seeds FROM fold WHERE used GROUP BY 1, 2)"""


def _ranked(p: S.SearchParams) -> str:
    return _tuned(p) + f""", hits AS (SELECT f.read_ord, f.chunk_id, p.bin_id, p.site, f.q_off, min_seeds,
    greatest(b.b_start, p.site - f.q_off - budget) AS s, least(b.b_start + length(b.seq), p.site + (len - f.q_off) + budget) AS e, len, budget, b.b_start AS bs, b.b_start + length(b.seq) AS be
    FROM fold f JOIN tuned USING (read_ord, chunk_id) JOIN sh ON sh.read_ord = f.read_ord AND sh.chunk_id = f.chunk_id AND sh.q_off = f.q_off
    JOIN found p ON p.chunk_id = sh.chunk_id AND p.kmer = sh.kmer JOIN bins b ON b.chunk_id = p.chunk_id AND b.bin_id = p.bin_id
    JOIN (SELECT read_ord, length(seq) AS len, CAST(ceil(length(seq) * {p.edit_rate}::DOUBLE) AS BIGINT) AS budget FROM reads) r ON r.read_ord = f.read_ord WHERE f.used),
  v AS (SELECT * REPLACE (CASE WHEN s < e AND s >= bs AND e <= be AND e - s >= len - budget THEN s END AS s) FROM hits),
  g AS (SELECT *, sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY read_ord, chunk_id ORDER BY site, q_off ROWS UNBOUNDED PRECEDING) AS ng FROM v),
  k AS (SELECT *, max(e) OVER (PARTITION BY read_ord, chunk_id, bin_id, ng ORDER BY site, q_off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM g WHERE s IS NOT NULL),
  i AS (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY read_ord, chunk_id, bin_id, ng ORDER BY site, q_off ROWS UNBOUNDED PRECEDING) AS isl FROM k),
  c AS (SELECT read_ord, chunk_id, bin_id, ng, isl, min(s) AS c_start, max(e) AS c_end, count(*) AS num_seeds, min(min_seeds) AS ms FROM i GROUP BY 1, 2, 3, 4, 5),
  ranked AS (SELECT read_ord, chunk_id, bin_id, c_start, c_end, num_seeds, row_number() OVER (PARTITION BY read_ord, chunk_id ORDER BY num_seeds DESC, bin_id, ng, isl) AS cand_rank FROM c WHERE num_seeds >= ms)"""


def _distance(p: S.SearchParams) -> str:
    """Verification of the candidates: a row of the distance table a step, in which min() over a window carries insertions along."""
    return _ranked(p) + """, x AS (SELECT row_number() OVER (ORDER BY c.read_ord, c.chunk_id, cand_rank) AS id, c.read_ord, 'b:' || c.read_ord AS read_id, c.chunk_id, cand_rank, tax_id, gi,
    c_start - b_start AS "offset", translate(r.seq, 'N', '.') AS needle, substr(b.seq, c_start - b_start + 1, c_end - c_start) AS hay, CAST(ceil(length(r.seq) * @@RATE@@::DOUBLE) AS BIGINT) AS budget
    FROM ranked c JOIN bins b USING (chunk_id, bin_id) JOIN reads r ON r.read_ord = c.read_ord),
  """.replace("@@RATE@@", str(p.edit_rate)) + _INFIX + """, d AS (SELECT x.*, edit FROM x JOIN dist USING (id) WHERE edit <= budget),
  first_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_ord, chunk_id, tax_id ORDER BY cand_rank) AS nth FROM d) WHERE nth = 1)"""


#: Least distance of needle to any part of hay, of x (id, needle, hay).
_INFIX = """cells AS (SELECT id, 0 AS i, j, CAST(0 AS BIGINT) AS v FROM (SELECT id, unnest(generate_series(0, length(hay))) AS j FROM x)
  UNION ALL SELECT id, i, j, j + min(v - j) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) FROM (
    SELECT c.id, c.i + 1 AS i, c.j, least(c.v + 1, lag(c.v) OVER (PARTITION BY c.id ORDER BY c.j) + CASE WHEN substr(needle, CAST(c.i + 1 AS BIGINT), 1) = substr(hay, c.j, 1) THEN 0 ELSE 1 END) AS v
    FROM cells c JOIN x USING (id) WHERE c.i < length(needle))),
  dist AS (SELECT c.id, min(v) AS edit FROM cells c JOIN x USING (id) WHERE c.i = length(needle) GROUP BY c.id)"""
_LOCAL = """grid AS (SELECT id, 0 AS i, j, CAST(0 AS BIGINT) AS v FROM (SELECT id, unnest(generate_series(0, length(hay))) AS j FROM x)
  UNION ALL SELECT id, i, j, greatest(0, max(v + j) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) - j) FROM (
    SELECT g.id, g.i + 1 AS i, g.j, greatest(0, g.v - 1, lag(g.v) OVER (PARTITION BY g.id ORDER BY g.j) + CASE WHEN substr(needle, CAST(g.i + 1 AS BIGINT), 1) = substr(hay, g.j, 1) THEN 1 ELSE -1 END) AS v
    FROM grid g JOIN x USING (id) WHERE g.i < length(needle))),
  best AS (SELECT id, max(v) AS score FROM grid GROUP BY id)"""
_LINES = """h AS (SELECT 'r:' || l_orderkey AS read_id, l_suppkey AS tax_id, l_partkey AS gi, CAST(l_linenumber AS BIGINT) AS "offset",
  CAST(l_quantity AS BIGINT) AS edit, l_linenumber % 3 AS file_id FROM lineitem),
  p AS (SELECT file_id, read_id, tax_id, gi, "offset", min(edit) AS edit FROM h GROUP BY ALL)"""
_SUPPORT = _LINES + """, t AS (SELECT read_id, tax_id, min(edit) AS edit FROM p GROUP BY 1, 2),
  b AS (SELECT *, min(edit) OVER w AS best, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY read_id)),
  c AS (SELECT *, sum(CASE WHEN edit = best THEN 1 ELSE 0 END) OVER (PARTITION BY read_id) AS nb FROM b),
  s AS (SELECT read_id, tax_id, edit, CASE WHEN n = 1 THEN 'only_hit' WHEN edit > best THEN 'not_best' WHEN nb = 1 THEN 'only_best' ELSE 'tied_best' END AS class FROM c)"""
_IDS = "reads AS (SELECT o_orderkey AS read_ord, 'r:' || o_orderkey AS read_id FROM orders), ids AS (SELECT DISTINCT 'r:' || l_orderkey AS read_id FROM lineitem WHERE l_linenumber % 3 = 2)"
_MAP = """fasta AS (SELECT 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS header, c_name AS seq FROM customer),
  m AS (SELECT 'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS header, CAST(s_nationkey AS BIGINT) AS tax_id, s_suppkey AS gi FROM supplier)"""
_NORM = "regexp_replace(translate({0}, 'acgt', 'ACGT'), '[^ACGTN]', 'N', 'g')"
_PSEUDO = f"translate(regexp_replace(lower(seq), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"

ORACLES = {
    "header_parse": "SELECT o_orderkey, o_orderkey AS gi, o_custkey AS tax_id FROM orders",
    "normalize": f"WITH {_REFS} SELECT gi, {_NORM.format('seq')} AS seq FROM refs",
    "revcomp": f"WITH {_REFS} SELECT gi, translate(reverse({_NORM.format(_PSEUDO)}), 'ACGT', 'TGCA') AS seq FROM refs",
    "base_codes": f"WITH {_READS} SELECT read_ord, regexp_replace(translate({_NORM.format('seq')}, 'ACGT', '0123'), '[^0-3]', '4', 'g') AS codes, translate({_NORM.format('seq')}, 'N', '.') AS masked FROM reads",
    "edit_budget": f"WITH {_REFS} SELECT gi, " + ", ".join(f"CAST(ceil(length(seq) * {r}::DOUBLE) AS BIGINT) AS b{i}" for i, r in enumerate((0.07, 0.13, 1.0))) + " FROM refs",
    "seed_extract": f"WITH {_seeds(PROSE)} SELECT read_ord, q_off, kmer FROM seeds",
    "bin_offsets": f"WITH {_BINS} SELECT chunk_id, bin_id, tax_id, gi, b_start, b_start + length(seq) AS b_end FROM bins",
    "kmer_counts": f"WITH {_positions(PROSE)} SELECT chunk_id, kmer, n_hits FROM kc",
    "seed_hits": f"WITH {_positions(PROSE)} SELECT read_ord, chunk_id, q_off, kmer, n_hits FROM sh",
    "seed_tuning": f"{_tuned(TIGHT)} SELECT read_ord, chunk_id, kept, n_seeds, min_seeds FROM tuned",
    "rank_candidates": _ranked(PROSE) + " SELECT * FROM ranked",
    "classify_best": _distance(PROSE) + " SELECT read_ord, read_id, chunk_id, tax_id, min(edit) AS edit FROM first_hits GROUP BY ALL",
    "classify_long": _distance(PROSE) + ' SELECT read_ord, read_id, chunk_id, tax_id, gi, "offset", min(edit) AS edit FROM first_hits GROUP BY ALL',
    "local_score": f"WITH RECURSIVE {_READS}, x AS (SELECT a.read_ord AS id, a.seq AS needle, b.seq AS hay FROM reads a JOIN reads b ON b.read_ord = a.read_ord + 1), {_INFIX}, {_LOCAL} SELECT id AS read_ord, score, edit FROM dist JOIN best USING (id)",
    "chunk_assign": f"""WITH RECURSIVE {_REFS}, n AS (SELECT tax_id, gi, length(seq) + length(gi || '-' || tax_id) + 3 AS bytes, row_number() OVER (ORDER BY tax_id, ord, gi) AS i FROM refs),
  f AS (SELECT i, CAST(0 AS BIGINT) AS chunk_id, CASE WHEN bytes >= {CHUNK_BYTES} THEN 1 ELSE 0 END AS up, CASE WHEN bytes >= {CHUNK_BYTES} THEN 0 ELSE bytes END AS used FROM n WHERE i = 1
  UNION ALL SELECT n.i, f.chunk_id + f.up, CASE WHEN f.used + n.bytes >= {CHUNK_BYTES} THEN 1 ELSE 0 END, CASE WHEN f.used + n.bytes >= {CHUNK_BYTES} THEN 0 ELSE f.used + n.bytes END FROM f JOIN n ON n.i = f.i + 1)
  SELECT chunk_id, tax_id, gi FROM f JOIN n USING (i)""",
    "parse_result_lines": f"WITH {_LINES} SELECT file_id, read_id, tax_id, gi, \"offset\", edit FROM p",
    "format_default": f"WITH {_LINES}, t AS (SELECT file_id, read_id, tax_id, min(edit) AS edit FROM h GROUP BY ALL) SELECT file_id, read_id || ':' || string_agg(tax_id || '=' || edit, ',' ORDER BY tax_id) AS line FROM t GROUP BY file_id, read_id",
    "format_long": f"WITH {_LINES} SELECT file_id, read_id || ':' || string_agg(tax_id || '-' || gi || '-' || \"offset\" || '=' || edit, ',' ORDER BY tax_id, gi, \"offset\") AS line FROM p GROUP BY file_id, read_id",
    "format_taxa_only": f"WITH {_LINES}, t AS (SELECT DISTINCT read_id, tax_id FROM h) SELECT read_id || ':' || string_agg(CAST(tax_id AS VARCHAR), ',' ORDER BY tax_id) AS line FROM t GROUP BY read_id",
    "parse_findings": f"WITH {_LINES}, t AS (SELECT DISTINCT read_id, tax_id FROM h) SELECT read_id, string_agg(CAST(tax_id AS VARCHAR), ' ' ORDER BY tax_id) AS taxa FROM t GROUP BY read_id",
    "parse_edit_findings": f"WITH {_LINES} SELECT file_id, read_id, tax_id, CAST(0 AS BIGINT) AS gi, CAST(0 AS BIGINT) AS \"offset\", min(edit) AS edit FROM h GROUP BY file_id, read_id, tax_id",
    "collapse_taxid": f"WITH {_LINES} SELECT read_id, tax_id, min(edit) AS edit FROM p GROUP BY 1, 2",
    "collapse_taxid_gi": f"WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY read_id, tax_id, gi ORDER BY edit, \"offset\") AS n FROM p) SELECT read_id, tax_id, gi, \"offset\", edit FROM r WHERE n = 1",
    "collapse_union": f"WITH {_LINES}, t AS (SELECT DISTINCT read_id, tax_id FROM h) SELECT read_id, string_agg(CAST(tax_id AS VARCHAR), ' ' ORDER BY tax_id) AS taxa FROM t GROUP BY read_id",
    "classify_support": f"WITH {_SUPPORT} SELECT * FROM s",
    "taxon_report": f"WITH {_SUPPORT}, d AS (SELECT count(DISTINCT read_id) AS d FROM s) SELECT tax_id, " + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}, CAST(count(*) FILTER (class = '{c}') AS DOUBLE) / CAST(greatest(any_value(d), 1) AS DOUBLE) * 100.0::DOUBLE AS {c}_pct" for c in ("only_hit", "only_best", "tied_best", "not_best")) + ", count(*) AS total_reads, CAST(count(*) AS DOUBLE) / CAST(greatest(any_value(d), 1) AS DOUBLE) * 100.0::DOUBLE AS total_pct FROM s, d GROUP BY tax_id",
    "partition_matched": f"WITH {_IDS} SELECT read_id, read_ord FROM reads WHERE read_id IN (SELECT read_id FROM ids)",
    "partition_unmatched": f"WITH {_IDS} SELECT read_id, read_ord FROM reads WHERE read_id NOT IN (SELECT read_id FROM ids)",
    "resume_offset": f"WITH {_IDS} SELECT coalesce(max(read_ord) + 1, 0) AS resume_offset FROM reads WHERE read_id IN (SELECT read_id FROM ids)",
    "read_offset": f"WITH {_IDS} SELECT * FROM reads WHERE read_ord >= 1000",
    "mapping_join": f"WITH {_MAP} SELECT header, seq, tax_id, gi FROM fasta JOIN m USING (header)",
    "mapping_missing": f"WITH {_MAP} SELECT header, seq FROM fasta WHERE header NOT IN (SELECT header FROM m)",
    "reference_extract": f"""WITH {_REFS}, a(arg_ord, tax_id) AS (VALUES (0::BIGINT, 7::BIGINT), (1, 3), (2, 7), (3, 4000000000))
  SELECT arg_ord, row_number() OVER (PARTITION BY arg_ord ORDER BY ord, gi) AS n, tax_id, seq FROM a JOIN refs USING (tax_id)""",
}
