"""Tables in text: delimited files, alignment tables, gene-caller reports, lists of files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of twelve-column alignment tables, fixed values.
HITS = (
    "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, "
    "sstart int, send int, evalue double, bitscore double"
)
#: Columns of a relation report, fixed values.
RELATIONS = "gene string, relationship string, representative string"


def read(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t", comment: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("sep", sep).option("header", header).option("ignoreTrailingWhiteSpace", True)
    return (r.option("comment", comment) if comment else r).csv(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, HITS)


def read_piped(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Dumps with fields between pipes and tabs, a pipe at the end; fields are trimmed strings."""
    parts = F.split(F.regexp_replace("value", r"\s*\|\s*$", ""), r"\|")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.trim(F.regexp_replace(F.get(parts, F.lit(k)), r"^\s+|\s+$", "")).alias(n) for k, n in enumerate(names)])


def read_sam(spark: SparkSession, path: str, drop: DataFrame | None = None) -> DataFrame:
    """Alignment lines (query, flag, target, rest), header lines left out, and targets listed in ``drop`` (target)."""
    t = spark.read.text(path).where(~F.startswith("value", F.lit("@")))
    p = F.split("value", "\t", 4)
    out = t.select(p[0].alias("query"), p[1].cast("int").alias("flag"), p[2].alias("target"), p[3].alias("rest"))
    return out if drop is None else out.join(drop, "target", "left_anti")


def with_sample(df: DataFrame, pattern: str = r"([^/.]+)\.[^/]*$") -> DataFrame:
    """Adds sample, taken from the name of the file that a row comes from."""
    return df.withColumn("sample", F.regexp_extract(F.input_file_name(), pattern, 1))


def mapped_name(name: Column) -> Column:
    """Read-pair file names in the mirror's form; other names are an error."""
    return (
        F.when(F.endswith(name, F.lit("_1.fastq.gz")), F.regexp_replace(name, r"_1\.fastq\.gz$", ".pair.1.fq.gz"))
        .when(F.endswith(name, F.lit("_2.fastq.gz")), F.regexp_replace(name, r"_2\.fastq\.gz$", ".pair.2.fq.gz"))
        .when(F.endswith(name, F.lit(".fastq.gz")), F.regexp_replace(name, r"\.fastq\.gz$", ".single.fq.gz"))
        .otherwise(F.raise_error(F.concat(F.lit("unexpected file name "), name)))
    )


def mirror_state(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """manifest (name, bytes, md5) with ok: whether the landed file has that size and digest."""
    f = spark.read.format("binaryFile").load(path)
    return checked(f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "content"), manifest)


def checked(landed: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (name, bytes, md5) with ok: whether the file of that name among landed (name, length, content) agrees."""
    have = landed.select("name", F.col("length").alias("_n"), F.md5("content").alias("_m"))
    return manifest.join(have, "name", "left").withColumn("ok", F.coalesce((F.col("_n") == F.col("bytes")) & (F.col("_m") == F.col("md5")), F.lit(False))).drop("_n", "_m")


def unpacked(packs: DataFrame) -> DataFrame:
    """name, length, content of files that lie in packs (name, content): many small ones to a file of the store.

    A file of its own costs the store several calls to create, list and open, which for short ones is all their time.
    """
    return packs.select("name", F.octet_length("content").cast("bigint").alias("length"), "content")


GENES = "sample string, gene string, contig string, strand string, start bigint, end bigint, complete boolean"
_SECTION = re.compile(r"^\s*(Predicted genes|Predicted proteins:|Nucleotide sequence of predicted genes:|FASTA definition line:)(.*)$", re.M)
_ROW = re.compile(r"^\s*(\d+)\s+([+-])\s+([<>]?)(\d+)\s+([<>]?)(\d+)\b", re.M)
_RECORD = re.compile(r"^>([^|\s]*)[^\n]*\n([^>]*)", re.M)


def _sections(text: str):
    """(title, rest of the title's line, what follows it) of each section of a gene-caller report."""
    found = list(_SECTION.finditer(text))
    for k, m in enumerate(found):
        end = found[k + 1].start() if k + 1 < len(found) else len(text)
        yield m[1], m[2].strip(), text[m.end() : end]


def parse_gene_report(text: str) -> list[tuple]:
    """(number, contig, strand, start, end, complete) of the gene tables of one report.

    ``<`` and ``>`` mark ends that run off the sequence. A definition line, where there is one, names the contig.
    """
    contig, out = None, []
    for title, rest, body in _sections(text):
        if title.startswith("FASTA"):
            contig = (rest.split() or [""])[0]
        elif title == "Predicted genes":
            out += [(m[1], contig, m[2], int(m[4]), int(m[6]), not (m[3] or m[5])) for m in _ROW.finditer(body)]
    return out


def _by_report(reports: DataFrame, parse, schema: str, names: list[str]) -> DataFrame:
    def run(it):
        for pdf in it:
            rows = []
            for s, t in zip(pdf["sample"], pdf["text"], strict=True):
                short = (s or "").replace("-assembled", "")
                rows += [(s, *r) for r in parse(t or "", short)]
            yield pd.DataFrame(rows, columns=names)

    return reports.select("sample", "text").mapInPandas(run, schema)


def gene_reports(reports: DataFrame) -> DataFrame:
    """Genes of (sample, text) reports, a report being one row; a gene's name is sample_number."""
    parse = lambda t, s: [(f"{s}_{k}", *rest) for k, *rest in parse_gene_report(t)]
    return _by_report(reports, parse, GENES, ["sample", "gene", "contig", "strand", "start", "end", "complete"])


def gene_sequences(reports: DataFrame) -> DataFrame:
    """sample, gene, seq of the nucleotide sections of (sample, text) reports; ``gene`` in names becomes the sample."""

    def parse(t: str, s: str):
        for title, _, body in _sections(t):
            if title.startswith("Nucleotide"):
                yield from ((m[1].replace("gene", s), "".join(m[2].split())) for m in _RECORD.finditer(body))

    return _by_report(reports, parse, "sample string, gene string, seq string", ["sample", "gene", "seq"])


def contig_order(headers: DataFrame) -> DataFrame:
    """gene, contig, strand, at from numbered headers ``gene|...|strand|... >contig``; runs of one gene collapse."""
    from loomery.operators.ordered import collapse_runs

    g = headers.select("sample", "at", F.regexp_extract("value", r"^>?(\S+?)(?:\|.*)?\s", 1).alias("gene"), F.regexp_extract("value", r"\|([+-])\|", 1).alias("strand"), F.regexp_extract("value", r"\s>(\S+)", 1).alias("contig"))
    return collapse_runs(g, "sample", ["at"], ["gene", "contig", "strand"])
