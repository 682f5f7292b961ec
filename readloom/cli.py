"""Command line: chunk, build, classify, collapse, partition, reference and resume-point."""
from __future__ import annotations

import argparse
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.operators import collapse as C, index as I, partition as P, search as S
from readloom.schema import ReadloomError
from readloom.sources import fastx, results, sinks


def _session() -> SparkSession:
    return SparkSession.builder.appName("readloom").getOrCreate()


def _reads(spark: SparkSession, a: argparse.Namespace, offset: int = 0) -> tuple[DataFrame, str]:
    kind = "fasta" if a.fasta else "fastq"
    return fastx.probe(fastx.read_fastx(spark, a.fasta or a.fastq, kind, offset)), kind


def _ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    return results.read_ids(results.read_lines(spark, paths))


def _references(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    fasta = fastx.read_reference_fasta(spark, a.fasta)
    if not getattr(a, "mapping", None):
        return fastx.references_by_header(fasta)
    mapped = P.apply_mapping(fasta, results.read_mapping(spark, a.mapping), a.skip_missing)
    return mapped.select("tax_id", "gi", "ord", "seq")


def chunk(a: argparse.Namespace) -> None:
    refs = fastx.references_by_header(fastx.read_reference_fasta(_session(), a.input))
    sinks.write_chunks(I.assign_chunks(refs, I.chunk_limit(a.gb)), a.output)


def build(a: argparse.Namespace) -> None:
    refs = _references(_session(), a)
    chunked = I.assign_chunks(refs, I.chunk_limit(a.gb)) if a.gb else I.single_chunk(refs)
    I.write_index(I.bins(chunked), a.index, a.seed_size)


def classify(a: argparse.Namespace) -> None:
    spark, offset = _session(), a.read_offset
    reads, _ = _reads(spark, a)
    exists = not a.force_overwrite and _exists(spark, a.results)
    if exists:
        done = P.resume_offset(reads, _ids(spark, [a.results])).head()[0]
        offset = P.combine_offsets(done, offset, a.resume)
    p = S.SearchParams(a.edit_rate, a.seed_size, a.seed_interval, a.min_seed, a.max_hits, a.tune_max_hits, a.max_assignments, a.max_candidates)
    hits = S.search(P.skip_reads(reads, offset), I.read_index(spark, a.index), p)
    line = sinks.long_line if a.output_format == "long" else sinks.default_line
    sinks.write_lines(line(["read_ord", "chunk_id"], hits), a.results, append=exists)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def collapse(a: argparse.Namespace) -> None:
    spark = _session()
    hits = results.parse_results(results.read_lines(spark, a.files))
    merged = C.collapse(hits, a.mode)
    if a.mode == "taxid":
        lines = sinks.default_line([], merged)
    else:
        lines = sinks.long_line([], merged)
    sinks.write_lines(lines.orderBy("read_id"), a.output)
    if a.report:
        sinks.write_report(C.taxon_report(merged), a.report)


def partition(a: argparse.Namespace) -> None:
    spark = _session()
    reads, kind = _reads(spark, a)
    ids = _ids(spark, a.results)
    for part, path in ((P.matched, a.matched), (P.unmatched, a.unmatched)):
        sinks.write_records(part(reads, ids), path, kind)


def reference(a: argparse.Namespace) -> None:
    found = P.extract_references(I.read_index(_session(), a.index).bins, P.valid_taxids(a.taxid))
    name = F.concat_ws("-", F.col("n").cast("string"), F.col("tax_id").cast("string"))
    found.orderBy("arg_ord", "n").select(sinks.fasta_record(name, F.col("seq")).alias("line")).write.mode("overwrite").text(a.results)


def resume_point(a: argparse.Namespace) -> None:
    spark = _session()
    print(P.resume_offset(_reads(spark, a)[0], _ids(spark, [a.results])).head()[0])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name, run, code):
        p = sub.add_parser(name)
        p.set_defaults(run=run, code=code)
        return p

    def reads(p):
        g = p.add_mutually_exclusive_group(required=True)
        g.add_argument("--fasta")
        g.add_argument("--fastq")

    p = command("chunk", chunk, 1)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--gb", type=float, default=10.0)
    p = command("build", build, 1)
    p.add_argument("--fasta", required=True)
    p.add_argument("--index", required=True)
    p.add_argument("--mapping")
    p.add_argument("--skip-missing", action="store_true")
    p.add_argument("--gb", type=float, help="also split into chunks of this size")
    p.add_argument("--seed-size", type=int, default=18, help="size of the stored seeds; a search with another takes the texts apart again")
    p.add_argument("--sa-sample", type=int, default=32, help="accepted, no effect")
    p.add_argument("--sample-interval", type=int, default=64, help="accepted, no effect")
    p = command("classify", classify, 2)
    reads(p)
    p.add_argument("--index", required=True)
    p.add_argument("--results", required=True)
    p.add_argument("--force-overwrite", action="store_true")
    p.add_argument("--threads", type=int, default=4, help="accepted, no effect: tasks are the cluster's")
    for name, kind, default in (("edit-rate", float, 0.13), ("seed-size", int, 18), ("seed-interval", int, 15), ("min-seed", float, 0.015), ("max-hits", int, 2000), ("tune-max-hits", int, 200), ("max-assignments", int, None), ("max-candidates", int, None), ("read-offset", int, 0)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--output-format", choices=["default", "long"], default="default")
    p.add_argument("--resume", choices=["exact", "compat"], default="exact")
    p = command("collapse", collapse, 1)
    p.add_argument("files", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--mode", choices=["taxid", "taxid-gi"], default="taxid")
    p.add_argument("--threads", type=int, default=4, help="accepted, no effect")
    p.add_argument("--report")
    p = command("partition", partition, 3)
    p.add_argument("results", nargs="+")
    reads(p)
    p.add_argument("--matched", required=True)
    p.add_argument("--unmatched", required=True)
    p = command("reference", reference, 3)
    p.add_argument("taxid", nargs="+")
    p.add_argument("--index", required=True)
    p.add_argument("--results", required=True)
    p = command("resume-point", resume_point, 2)
    p.add_argument("--results", required=True)
    reads(p)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(a)
    except (ReadloomError, OSError, PySparkException, Py4JError) as e:
        print(str(e).split("\n\nJVM stacktrace", 1)[0], file=sys.stderr)
        return a.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
