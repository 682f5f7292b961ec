import gzip
import random

import pytest
from pyspark.sql import functions as F
from readloom import cli
from readloom.functions import kernels, sequence as Q
from readloom.operators import collapse as C, index as I, partition as P, search as S
from readloom.schema import InvalidMapping, InvalidParameter, ReadloomError
from readloom.sources import fastx, results as R, sinks


def infix(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def local(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(0, row[j] - 1, row[j - 1] - 1, last + (1 if x == y else -1))
            best = max(best, row[j])
    return best


def test_kernels_like_plain_versions():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("ACGTN") for _ in range(rng.randrange(n))) for n in (40, 60))
        assert kernels.infix_distance(a, b) == infix(a, b)
        assert kernels.local_score(a, b) == local(a, b)


def test_headers(spark):
    good = {"7-31": (7, 31), "+8-9": (8, 9), "000-4294967295": (0, 4294967295)}
    bad = ["7", "7-", "-31", "7--31", "7_31", "7-31-", "7 -31", "0x7-31", "4294967296-1", "1-99999999999999999999999", " 1-2", "1-2\n"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "h string").select("h", Q.header_parts(F.col("h")).alias("p"))
    got = {r.h: r.p and (r.p.gi, r.p.tax_id) for r in df.collect()}
    assert got == good | dict.fromkeys(bad)


def test_window(spark):
    """Against the rule, for all places of a read of 12 around a bin of 40."""
    rows_ = [(site, q, 12, e, 1000, 1040) for site in range(985, 1060) for q in (0, 5, 11) for e in (0, 2, 6)]
    df = spark.createDataFrame(rows_, "site long, q int, len int, e int, s long, t long")
    for r in df.withColumn("w", Q.window_bounds(*map(F.col, ("site", "q", "len", "e", "s", "t")))).collect():
        lo, hi = max(r.s, r.site - r.q - r.e), min(r.t, r.site + 12 - r.q + r.e)
        fits = lo < hi and hi - lo >= 12 - r.e
        assert (r.w and (r.w.s, r.w.e)) == ((lo, hi) if fits else None)


def lines(spark, *x):
    return spark.createDataFrame([(y,) for y in x], "line string")


def test_lines_and_collapse(spark):
    hits = spark.createDataFrame([("q:7 x", 40, 3, 0, 2), ("q:7 x", 9, 71, 15, 3), ("q:7 x", 9, 8, 15, 1), ("q:7 x", 9, 8, 15, 6)], "read_id string, tax_id long, gi long, offset long, edit long")
    assert sinks.default_line([], hits).head().line == "q:7 x:9=1,40=2"
    assert sinks.long_line([], hits).head().line == "q:7 x:9-8-15=1,9-71-15=3,40-3-0=2"
    assert sinks.taxa_line(hits).head().line == "q:7 x:9,40"
    parsed = R.parse_results(lines(spark, "r1:1-5-2=4,2-8-1=7\r", "r1:2-8-1=6", "r2:2-9-1=2", "r3:"))
    assert sorted(r.line for r in sinks.long_line([], C.collapse(parsed, "taxid-gi")).collect()) == ["r1:1-5-2=4,2-8-1=6", "r2:2-9-1=2"]
    assert sorted(r.line for r in sinks.default_line([], C.collapse(parsed)).collect()) == ["r1:1=4,2=6", "r2:2=2"]
    for bad in ("x", ":1=2", "r:1=2=3", "r:1-2-3-4=5", "r:a=1", "r:1", "r:4294967296=1"):
        with pytest.raises(Exception):
            R.parse_results(lines(spark, bad)).collect()
    with pytest.raises(Exception):
        C.collapse_taxid_gi(R.parse_results(lines(spark, "r:1-2-3=4", "s:1-2=4"))).collect()
    with pytest.raises(InvalidParameter):
        C.collapse(parsed, "other")
    taxa = C.collapse_union(R.parse_findings(lines(spark, "a:1,2,3", "a:100,5", "b:7")))
    assert {r.read_id: r.taxa for r in taxa.collect()} == {"a": [1, 2, 3, 5, 100], "b": [7]}


def test_report(spark):
    t = C.taxon_report(R.parse_results(lines(spark, "a:1=2", "b:1=2,2=3", "c:1=1,2=1,3=4")))
    got = {r.tax_id: (r.only_hit, r.only_best, r.tied_best, r.not_best, r.total_reads) for r in t.collect()}
    assert got == {1: (1, 1, 1, 0, 3), 2: (0, 0, 1, 1, 2), 3: (0, 0, 0, 1, 1)}


def procedural(read, bins, p):
    """One strand and one chunk, seed by seed."""
    text, n, hits = "".join(b[2] for b in bins), len(read), []
    starts, at = [], 0
    for b in bins:
        starts.append(at)
        at += len(b[2])
    budget = Q.budget_of(n, p.edit_rate)
    nxt, step, used = 0, p.seed_interval, 0
    for q in range(0, n - p.seed_size + 1, p.seed_interval):
        if q < nxt:
            continue
        k = read[q:q + p.seed_size]
        sites = [i for i in range(len(text) - len(k) + 1) if text[i:i + len(k)] == k]
        if not 0 < len(sites) <= p.max_hits:
            continue
        if len(sites) > p.tune_max_hits:
            step *= 2
            nxt = q + step
        used += 1
        hits += [(s, q) for s in sites]
    need, open_, cands = max(1, int(used * p.min_seed)), None, []

    def close():
        if open_ and open_[3] >= need:
            cands.append(tuple(open_))

    for site, q in sorted(hits):
        b = max(i for i in range(len(bins)) if starts[i] <= site and len(bins[i][2]))
        lo, hi = starts[b], starts[b] + len(bins[b][2])
        s, e = max(lo, site - q - budget), min(hi, site + n - q + budget)
        if not (s < e and s >= lo and e <= hi and e - s >= n - budget):
            close()
            open_ = None
        elif open_ and open_[0] == b and s < open_[2] and e > open_[1]:
            open_[1:] = [min(s, open_[1]), max(e, open_[2]), open_[3] + 1]
        else:
            close()
            open_ = [b, s, e, 1]
    close()
    out, taxa = [], set()
    for k, (b, s, e, _) in enumerate(sorted(cands, key=lambda c: -c[3])):
        if p.max_candidates is not None and k >= p.max_candidates:
            break
        if bins[b][0] in taxa:
            continue
        d = infix(read.replace("N", "."), text[s:e])
        if d <= budget:
            out.append((bins[b][0], bins[b][1], s - starts[b], d))
            taxa.add(bins[b][0])
            if p.max_assignments is not None and len(out) >= p.max_assignments:
                break
    return out


@pytest.mark.parametrize("limits", [(None, None), (1, None), (None, 2), (0, 0), (2, 3)])
def test_search_like_procedure(spark, limits):
    rng, want, refs, reads = random.Random(str(limits)), [], [], []
    p = S.SearchParams(edit_rate=0.15, seed_size=4, seed_interval=3, min_seed=0.3, max_hits=12, tune_max_hits=4, max_assignments=limits[0], max_candidates=limits[1], nucleotides=False)
    for case in range(60):
        bins = [(rng.randrange(1, 5), k, "".join(rng.choice("ACGN" if rng.random() < .1 else "AC") for _ in range(rng.choice([0, 3, 30, 60])))) for k in range(4)]
        bins.sort(key=lambda b: b[0])
        text = "".join(b[2] for b in bins)
        a = rng.randrange(max(1, len(text) - 20))
        read = list(text[a:a + rng.randrange(2, 28)])
        for _ in range(rng.randrange(3)):
            if read:
                read[rng.randrange(len(read))] = rng.choice("ACGTN")
        read = "".join(read)
        refs += [(case, t, g, o, s) for o, (t, g, s) in enumerate(bins)]
        reads.append((case, f"r{case}", read))
        want += [(case, *h) for h in procedural(read, bins, p)]
    r = spark.createDataFrame(refs, "chunk_id long, tax_id long, gi long, ord long, seq string")
    b = I.bins(r, normalized=False)
    got = S.search(spark.createDataFrame(reads, "read_ord long, read_id string, seq string"), b, p).where("read_ord = chunk_id")
    assert sorted((x.read_ord, x.tax_id, x.gi, x.offset, x.edit) for x in got.collect()) == sorted(want)


def plain_chunks(refs, limit):
    out, used, chunk = [], 0, 0
    for r in sorted(refs, key=lambda r: (r[0], r[2], r[1])):
        out.append((chunk, *r))
        used += len(r[3]) + len(f"{r[1]}-{r[0]}") + 3
        if used >= limit:
            chunk, used = chunk + 1, 0
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 30, 100, 1000, 10**9])
def test_chunks_and_bins_like_folds(spark, limit):
    """Repeated records keep their count, and sums run across partitions."""
    rng = random.Random(limit)
    refs = [(rng.randrange(5), rng.randrange(40), rng.randrange(8), "ACGT"[rng.randrange(4)] * rng.choice([0, 1, 7, 60])) for _ in range(300)]
    refs += refs[:40] + refs[:1] * 30
    schema = "tax_id long, gi long, ord long, seq string"
    chunked = I.assign_chunks(spark.createDataFrame(refs, schema).repartition(7), limit)
    got = [tuple(r) for r in chunked.select("chunk_id", "tax_id", "gi", "ord", "seq").collect()]
    assert sorted(x[1:] for x in got) == sorted(refs)
    size = lambda c: sum(len(r[4]) + len(f"{r[2]}-{r[1]}") + 3 for r in got if r[0] == c)
    chunks = sorted({r[0] for r in got})
    assert chunks == list(range(len(chunks))) and all(size(c) >= limit for c in chunks[:-1])
    unique = [(t, g, i, s) for i, (t, g, _, s) in enumerate(refs)]
    df = spark.createDataFrame(unique, schema).repartition(5)
    assert sorted(tuple(r) for r in I.assign_chunks(df, limit).select("chunk_id", "tax_id", "gi", "ord", "seq").collect()) == plain_chunks(unique, limit)
    at = {}
    want = []
    for c, t, g, o, s in sorted(plain_chunks(unique, limit), key=lambda x: (x[0], x[1], x[3], x[2])):
        n, place = at.get(c, (0, 0))
        want.append((c, o, n, place, place + len(s)))
        at[c] = n + 1, place + len(s)
    binned = I.bins(I.assign_chunks(df, limit), normalized=False)
    assert sorted(tuple(r) for r in binned.select("chunk_id", "ord", "bin_id", "start", "end").collect()) == sorted(want)


def test_partition_resume_reference(spark):
    refs = spark.createDataFrame([(8, 55, 0, "GAT"), (3, 70, 0, "C"), (3, 61, 1, "TTGA"), (3, 61, 2, "TTGA")], "tax_id long, gi long, ord long, seq string")
    assert [r.seq for r in P.extract_references(refs, [3, 5]).orderBy("n").collect()] == ["C", "TTGA", "TTGA"]
    reads = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "b", "a", "c"])], "read_ord long, read_id string")
    ids = R.read_ids(lines(spark, "a:1=2", "z:1=3"))
    assert P.matched(reads, ids).count() == 2 and P.unmatched(reads, ids).count() == 2
    assert P.resume_offset(reads, ids).head()[0] == 3 and P.resume_offset(reads, ids.limit(0)).head()[0] == 0
    assert (P.combine_offsets(3, 2), P.combine_offsets(3, 2, "compat")) == (3, 5)
    assert P.valid_taxids(["1", "x", "99999999999", "+7"]) == [1, 7]


def test_files_and_command_line(spark, tmp_path):
    ref, reads, fq = tmp_path / "ref.fasta", tmp_path / "reads.bin", tmp_path / "r.fq"
    rng = random.Random(9)
    seq = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(3)]
    ref.write_text("".join(f">{10 + i}-{i % 2 + 1} note\n{s[:200]}\n{s[200:]}\n" for i, s in enumerate(seq)))
    reads.write_bytes(gzip.compress((f">a:1 x\n{seq[0][20:170]}\n>b\n{seq[1][100:250]}\n>c\n" + "".join(rng.choice("ACGT") for _ in range(150)) + "\n").encode()))
    fq.write_text("@r1 d\nACGT\n+\n@!!!\n@r2\nAC\n+\n!!\n")
    assert [(r.read_ord, r.read_id, r.desc, r.seq, r.qual) for r in fastx.read_fastx(spark, str(fq), "FASTQ").collect()] == [(0, "r1", "d", "ACGT", "@!!!"), (1, "r2", None, "AC", "!!")]
    with pytest.raises(InvalidParameter):
        fastx.read_fastx(spark, str(fq), "bam")
    assert {(r.header, r.seq) for r in fastx.read_reference_fasta(spark, str(ref)).collect()} == {(f"{10 + i}-{i % 2 + 1}", s) for i, s in enumerate(seq)}
    out = lambda x: str(tmp_path / x)
    run = lambda *a: cli.main(list(a))
    assert run("build", "--fasta", str(ref), "--index", out("ix")) == 0
    assert run("classify", "--fasta", str(reads), "--index", out("ix"), "--results", out("res")) == 0
    assert sorted(r.value for r in spark.read.text(out("res")).collect()) == ["a:1:1=0", "b:2=0"]
    assert run("classify", "--fasta", str(reads), "--index", out("ix"), "--results", out("long"), "--output-format", "long") == 0
    assert run("collapse", out("res"), out("res"), "--output", out("col"), "--report", out("rep")) == 0
    assert sorted(r.value for r in spark.read.text(out("col")).collect()) == ["a:1:1=0", "b:2=0"]
    report = [r.value.split("\t") for r in spark.read.text(out("rep")).collect()]
    assert report[0][0] == "taxid" and len(report[0]) == 11 and report[1][:3] == ["1", "1", "50.00"]
    assert run("partition", out("res"), "--fasta", str(reads), "--matched", out("m"), "--unmatched", out("u")) == 0
    assert len(fastx.read_reference_fasta(spark, out("u")).collect()) == 1
    assert run("reference", "2", "--index", out("ix"), "--results", out("rf")) == 0
    assert run("chunk", "--input", str(ref), "--output", out("ch"), "--gb", "0.000001") == 0
    assert run("resume-point", "--results", out("res"), "--fasta", str(reads)) == 0


def test_order_and_ordinals_of_several_files(spark, tmp_path):
    """References keep the order of their files, repeated ones too; ordinals of reads go on over files."""
    seqs = ["AAAA", "CCCC", "AAAA", "GGGG", "TTTT"]
    for k, part in enumerate((seqs[:3], seqs[3:])):
        (tmp_path / f"r{k}.fasta").write_text("".join(f">{g}-9\n{s}\n" for g, s in zip((5, 4, 5), part)))
    paths = [str(tmp_path / f"r{k}.fasta") for k in (0, 1)]
    refs = fastx.references_by_header(fastx.read_reference_fasta(spark, paths))
    assert [r.seq for r in P.extract_references(refs, [9]).orderBy("n").collect()] == seqs
    assert I.assign_chunks(refs, 10).count() == 5
    reads = fastx.read_fastx(spark, paths, "fasta")
    assert [r.read_ord for r in reads.orderBy("read_ord").collect()] == [0, 1, 2, fastx.FILE, fastx.FILE + 1]
    text = "".join(random.Random(2).choice("ACGT") for _ in range(300))
    for k in (0, 1):
        (tmp_path / f"q{k}.fasta").write_text(f">x{k}\n{text[20 + k:140 + k]}\n")
    binned = I.bins(I.single_chunk(spark.createDataFrame([(1, 1, 0, text)], "tax_id long, gi long, ord long, seq string")))
    hits = S.search(fastx.read_fastx(spark, [str(tmp_path / f"q{k}.fasta") for k in (0, 1)], "fasta"), binned, S.SearchParams(max_assignments=1))
    assert sorted(r.read_id for r in hits.collect()) == ["x0", "x1"]


def test_stored_index_gives_the_same_hits(spark, tmp_path):
    rng = random.Random(6)
    refs = [(t, t, 0, "".join(rng.choice("ACGT") for _ in range(9000))) for t in range(3)]
    binned = I.bins(I.single_chunk(spark.createDataFrame(refs, "tax_id long, gi long, ord long, seq string")))
    reads = spark.createDataFrame([(i, f"r{i}", refs[i % 3][3][4000 + 37 * i:4150 + 37 * i]) for i in range(12)], "read_ord long, read_id string, seq string")
    I.write_index(binned, str(tmp_path / "ix"), 18)
    index = I.read_index(spark, str(tmp_path / "ix"))
    rows_ = lambda df: sorted(tuple(r) for r in df.select("read_ord", "tax_id", "offset", "edit").collect())
    for p in (S.SearchParams(), S.SearchParams(seed_size=12)):
        found = rows_(S.search(reads, index, p))
        assert found == rows_(S.search(reads, binned, p)) and len(found) == 12


def test_errors_have_exit_codes(spark, tmp_path):
    (tmp_path / "bad").write_text("no id here\n")
    assert cli.main(["collapse", str(tmp_path / "bad"), "--output", str(tmp_path / "o")]) == 1
    (tmp_path / "empty.fq").write_text("")
    assert cli.main(["classify", "--fastq", str(tmp_path / "empty.fq"), "--index", str(tmp_path / "none"), "--results", str(tmp_path / "r")]) == 2
    assert cli.main(["reference", "1", "--index", str(tmp_path / "none"), "--results", str(tmp_path / "r")]) == 3


def test_mapping(spark, tmp_path):
    m = tmp_path / "m.tsv"
    m.write_text("note\tHeader\t SeqID\ttaxid\n-\tfoo\t31\t8\n\n-\tbar\t5\t4294967295\n")
    got = {r.header: (r.tax_id, r.gi) for r in R.read_mapping(spark, str(m)).collect()}
    assert got == {"foo": (8, 31), "bar": (4294967295, 5)}
    fasta = spark.createDataFrame([("foo", "A"), ("zip", "C")], "header string, seq string")
    assert P.apply_mapping(fasta, R.read_mapping(spark, str(m)), True).count() == 1
    with pytest.raises(Exception):
        P.apply_mapping(fasta, R.read_mapping(spark, str(m))).collect()
    m.write_text("header,gi\nfoo,1\n")
    with pytest.raises(InvalidMapping):
        R.read_mapping(spark, str(m))
    m.write_text("header taxid gi\nfoo 1 2\nfoo 1 2\n")
    with pytest.raises(Exception):
        R.read_mapping(spark, str(m)).collect()
    with pytest.raises(ReadloomError):
        fastx.probe(fasta.limit(0))


def test_stream(spark, tmp_path):
    from readloom.schema import READS
    from readloom.streaming.incremental import classify_stream, stream_reads
    text = "".join(random.Random(1).choice("ACGT") for _ in range(300))
    binned = I.bins(I.single_chunk(spark.createDataFrame([(1, 1, 0, text)], "tax_id long, gi long, ord long, seq string"))).cache()
    spark.createDataFrame([(0, "a", None, text[50:150], None)], READS).write.parquet(str(tmp_path / "in"))
    classify_stream(stream_reads(spark, str(tmp_path / "in")), binned, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [(r.read_id, r.tax_id, r.edit) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 1, 0)]
