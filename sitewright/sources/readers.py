"""Scans with explicit schemas. Text tables are read as strings and cast, NaN becomes NULL at the scan."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import missing_to_null
from ..functions.intervals import bin_start
from ..functions.sequences import base_identifier, packed_field
from ..operators.intervals import covering_nodes, nodes_of_position
from ..operators.joins import matching
from ..operators.ranking import best_row, join_spread, nulls_last, row_positions
from ..session import fresh_folder

ASSOCIATION = "SNP_hg19 string, rsid string, A1 string, A2 string, beta double, se double, `P-value` double"
EQTL = "gene_id string, variant_id string, slope double, slope_se double, pval_nominal double"
CAQTL = "variant string, peak string, beta double, varbeta double, pvalue double"
SAMPLES = "sample string, super_pop string"
MPRA = (
    "Chrom string, Pos string, Ref string, Alt string, Element string, Release string, Barcodes string, DNA string, "
    "RNA string, Coefficient string, pValue string"
)
REPAIR = "Reads string, VarFreq string, IndelFreq string, `Position (hg18)` string, Ref string, Cons string"
EXPRESSION = "Gene string, `Gene name` string, Tissue string, nTPM string"
CHAIN_BLOCKS = (
    "chain_id bigint, score bigint, source_chrom string, source_start bigint, source_end bigint, target_chrom string, "
    "target_start bigint, target_strand string, target_size bigint"
)


def delimited(spark: SparkSession, path: str | Sequence[str], schema: str, *, sep: str = "\t", partitions: int | None = None) -> DataFrame:
    """Headed delimited text. A gzip file is one split, so ``partitions`` spreads it right after the scan."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, nullValue="", nanValue="NaN", enforceSchema=False)
    return missing_to_null(df.repartition(partitions) if partitions else df)


def association_table(spark: SparkSession, path: str, *, chrom: str, low: int, high: int, **options) -> DataFrame:
    """Association records of one region with their packed position unpacked."""
    raw = delimited(spark, path, ASSOCIATION, **options)
    return (
        raw.withColumn("chrom", F.split_part("SNP_hg19", F.lit(":"), F.lit(1)))
        .withColumn("pos", F.split_part("SNP_hg19", F.lit(":"), F.lit(2)).try_cast("bigint"))
        .where((F.col("chrom") == chrom) & F.col("pos").between(low, high))
        .select("chrom", "pos", "rsid", F.upper("A1").alias("effect_allele"), F.upper("A2").alias("other_allele"), "beta", "se", F.col("P-value").alias("p"))
    )


def eqtl_pairs(spark: SparkSession, path: str, wanted: DataFrame, *, on: Sequence[str] = ("gene_id", "pos"), **options) -> DataFrame:
    """All-pairs records restricted to wanted keys before anything else touches them."""
    raw = delimited(spark, path, EQTL, **options)
    split = raw.select(
        "gene_id",
        packed_field("variant_id", "_", 0).alias("chrom"),
        packed_field("variant_id", "_", 1).try_cast("bigint").alias("pos"),
        packed_field("variant_id", "_", 2).alias("ref"),
        packed_field("variant_id", "_", 3).alias("alt"),
        "slope",
        F.col("slope_se").alias("se"),
        F.col("pval_nominal").alias("p"),
    )
    return matching(split, wanted, on)


def caqtl_table(spark: SparkSession, path: str, **options) -> DataFrame:
    raw = delimited(spark, path, CAQTL, **options)
    fields = [packed_field("variant", ":", i) for i in range(4)]
    return raw.select(
        fields[0].alias("chrom"), fields[1].try_cast("bigint").alias("pos"), fields[2].alias("ref"), fields[3].alias("alt"),
        "peak", "beta", "varbeta", "pvalue",
    )


def mpra_elements(spark: SparkSession, path: str, *, release: str, elements: Sequence[str], single_bases: bool = True, digits: int | None = 2, **options) -> DataFrame:
    """Reporter-assay rows of one release and element list; the chromosome may carry a ".0" suffix."""
    raw = delimited(spark, path, MPRA, **options).where((F.col("Release") == release) & F.col("Element").isin(*elements))
    ref, alt = F.upper("Ref"), F.upper("Alt")
    if single_bases:
        raw = raw.where(ref.isin("A", "C", "G", "T") & alt.isin("A", "C", "G", "T"))
    effect = F.col("Coefficient").try_cast("double")
    return raw.select(
        "Element",
        F.regexp_replace("Chrom", r"\.0$", "").alias("chrom"),
        F.col("Pos").try_cast("double").cast("bigint").alias("pos"),
        ref.alias("ref"),
        alt.alias("alt"),
        (effect if digits is None else F.round(effect, digits)).alias("effect"),
        F.col("pValue").try_cast("double").alias("p"),
        *[F.col(c).try_cast("double").cast("bigint").alias(n) for c, n in (("Barcodes", "tags"), ("DNA", "dna"), ("RNA", "rna"))],
    )


def annotation(spark: SparkSession, path: str, *, feature: str, chrom: str | None = None) -> DataFrame:
    """One feature class of a columnar annotation; both predicates reach the Parquet scan."""
    df = spark.read.parquet(path).where(F.col("Feature") == feature)
    if chrom is not None:
        df = df.where(F.col("Chromosome") == chrom)
    return df.select(
        F.col("Chromosome").alias("chrom"), F.col("Start").cast("bigint").alias("start"), F.col("End").cast("bigint").alias("end"),
        F.col("Strand").alias("strand"), "gene_name", "gene_id", base_identifier("gene_id").alias("gene_id_base"), "gene_type",
        "transcript_id", "transcript_type",
    )


def genotype_calls(lines: DataFrame, *, line: str = "value") -> DataFrame:
    """Long (pos, id, ref, alts, sample, genotype) records from tab-separated text with SAMPLE=CALL fields."""
    fields = F.split(F.col(line), "\t")
    long = lines.select(
        fields[0].cast("bigint").alias("pos"),
        fields[1].alias("id"),
        fields[2].alias("ref"),
        F.split(fields[3], ",").alias("alts"),
        F.explode(F.slice(fields, F.lit(5), F.greatest(F.size(fields) - 4, F.lit(0)))).alias("_c"),
    )
    return long.select(
        "pos", "id", "ref", "alts", F.split_part("_c", F.lit("="), F.lit(1)).alias("sample"), F.split_part("_c", F.lit("="), F.lit(2)).alias("genotype")
    )


def contact_records(records: DataFrame, by: Sequence[str], *, low: int, high: int) -> DataFrame:
    """Sparse contacts with both bins in range, both triangles."""
    inside = records.where(F.col("bin_x").between(low, high) & F.col("bin_y").between(low, high) & F.col("value").isNotNull())
    mirrored = inside.where(F.col("bin_x") != F.col("bin_y")).select(
        *by, F.col("bin_y").alias("bin_x"), F.col("bin_x").alias("bin_y"), "value"
    )
    return inside.select(*by, "bin_x", "bin_y", "value").unionByName(mirrored)


def fasta_tiles(lines: DataFrame, *, tile: int) -> DataFrame:
    """Tiled sequence table from (chrom, line_start, text) rows of known offset; lines may cross tiles."""
    pieces = lines.withColumn(
        "tile_start",
        F.explode(F.sequence(bin_start("line_start", tile), bin_start(F.col("line_start") + F.length("text") - 1, tile), F.lit(tile).cast("bigint"))),
    )
    low = F.greatest(F.col("tile_start") - F.col("line_start"), F.lit(0).cast("bigint"))
    high = F.least(F.col("tile_start") + tile - F.col("line_start"), F.length("text").cast("bigint"))
    cut = pieces.withColumn("_p", F.substring(F.upper("text"), (low + 1).cast("int"), (high - low).cast("int")))
    # at most ``tile`` characters are gathered per tile
    return cut.groupBy("chrom", "tile_start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "_p"))), lambda p: p["_p"]), "").alias("sequence")
    )


def matrix_records(records: DataFrame, *, text: str = "value") -> DataFrame:
    """Long (matrix_id, name, offset, base, count) table from '>'-separated count-matrix records; a record that
    lacks one of the four rows is dropped."""
    head = F.trim(F.split_part(F.col(text), F.lit("\n"), F.lit(1)))
    rows = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^([ACGT])\s*\[[^\]]+\]\s*$"), F.lit(0))
    parsed = (
        records.where(F.trim(F.regexp_replace(text, "^>", "")) != "")
        .withColumn("_h", F.regexp_replace(head, "^>", ""))
        .withColumn("_rows", rows)
        .where(F.size(F.array_distinct(F.transform("_rows", lambda r: F.substring(r, 1, 1)))) == 4)
        .select(
            F.regexp_extract("_h", r"^(\S+)", 1).alias("matrix_id"),
            F.coalesce(F.nullif(F.trim(F.regexp_replace("_h", r"^\S+\s*", "")), F.lit("")), F.regexp_extract("_h", r"^(\S+)", 1)).alias("name"),
            F.explode("_rows").alias("_r"),
        )
    )
    return parsed.select(
        "matrix_id",
        "name",
        F.substring("_r", 1, 1).alias("base"),
        F.posexplode(F.regexp_extract_all("_r", F.lit(r"[0-9.]+"), F.lit(0))).alias("offset", "_n"),
    ).select("matrix_id", "name", "offset", "base", F.col("_n").cast("double").cast("bigint").alias("count"))


def repair_outcomes(df: DataFrame, *, experiment: str) -> DataFrame:
    """Modelled insertion and deletion events with their rank and read share inside each experiment."""
    typed = (
        df.where(F.coalesce(F.col("Cons").rlike(r"^\*/[+-][ACGT]+$"), F.lit(False)))
        .withColumn("reads", F.col("Reads").try_cast("double").cast("bigint"))
        .withColumn("position", F.col("Position (hg18)").try_cast("double").cast("bigint"))
        .withColumn("operation", F.when(F.substring("Cons", 3, 1) == "-", "deletion").otherwise("insertion"))
        .withColumn("event_sequence", F.upper(F.substring(F.col("Cons"), F.lit(4), F.length("Cons"))))
        .withColumn("event_length", F.length("event_sequence"))
    )
    ranked = row_positions(typed, [experiment], [-F.col("reads"), F.col("position"), F.col("Cons")], name="rank_in_experiment")
    totals = typed.groupBy(experiment).agg(F.sum("reads").alias("_t"))
    rank = F.col("rank_in_experiment").cast("string")
    padded = F.when(F.col("rank_in_experiment") < 1000, F.lpad(rank, 3, "0")).otherwise(rank)
    label = F.concat_ws(
        "_", F.col(experiment), F.concat(F.lit("rank"), padded),
        F.col("position").cast("string"), F.regexp_replace("Cons", r"^\*/", ""),
    )
    return (
        join_spread(ranked, totals, [experiment], F.col("rank_in_experiment"))
        .withColumn("share", F.col("reads") / F.col("_t"))
        .withColumn("edit_id", F.translate(label, "+/", "__"))
        .drop("_t")
    )


def tissue_expression(spark: SparkSession, path: str, *, tissue: str, eligible: DataFrame | None = None, **options) -> DataFrame:
    """One numeric value per gene of a tissue, first by name; restricted to eligible genes if given."""
    raw = delimited(spark, path, EXPRESSION, **options).where(F.lower("Tissue") == tissue.lower())
    typed = raw.select(
        base_identifier("Gene").alias("gene_id_base"), F.upper("Gene name").alias("gene_name"), F.col("nTPM").try_cast("double").alias("value")
    ).where(F.col("value").isNotNull())
    first = best_row(typed, ["gene_id_base"], [F.col("gene_name"), F.col("value")])
    return first if eligible is None else matching(first, eligible, ["gene_id_base"])


def lift_positions(variants: DataFrame, blocks: DataFrame, *, chrom: str, pos: str, key: Sequence[str], bin_width: int = 1 << 20) -> DataFrame:
    """Map 1-based positions through chain blocks: the covering block of the best chain, strand-aware.

    Every block is cut into nodes of growing width, of which a position lies in one per level. A node keeps the best block
    of each strand, so a position meets a few of them however many blocks cover it; positions are looked up once each.
    (``bin_width`` no longer matters.)"""
    zero, strand = F.col("_zero"), F.col("target_strand")
    # equal chains on one strand differ by what they add to a position, so the order among them is the same everywhere
    shift = F.when(strand == "-", F.col("target_size") - F.col("target_start") + F.col("source_start")).otherwise(
        F.col("target_start") - F.col("source_start") + 1
    )
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(nulls_last([-F.col("score"), F.col("chain_id"), shift]))])
    block = F.struct("score", "chain_id", shift.alias("shift"), strand.alias("strand"), "target_chrom")
    nodes = covering_nodes(blocks, "source_start", "source_end").withColumn("_minus", F.coalesce(strand == "-", F.lit(False)))
    best_blocks = nodes.groupBy("source_chrom", "_level", "_node", "_minus").agg(F.min_by(block, order).alias("_b"))

    placed = variants.select(*key, F.col(chrom).alias("source_chrom"), (F.col(pos) - 1).cast("bigint").alias("_zero"))
    places = placed.select("source_chrom", "_zero").distinct()
    looked = places.withColumn("_n", F.explode(nodes_of_position(zero))).select("source_chrom", "_zero", "_n.*")
    met = looked.join(best_blocks, ["source_chrom", "_level", "_node"]).select("source_chrom", "_zero", "_b.*")
    lifted = F.when(F.col("strand") == "-", F.col("shift") - zero).otherwise(F.col("shift") + zero)
    choice = [-F.col("score"), F.col("chain_id"), F.col("lifted_pos")]
    best = best_row(met.withColumn("lifted_pos", lifted), ["source_chrom", "_zero"], choice)
    found = placed.join(best, ["source_chrom", "_zero"])
    # a key that names several positions keeps the best of theirs
    chosen = best_row(found, key, choice).select(*key, "target_chrom", "lifted_pos", F.col("strand").alias("lifted_strand"))
    return variants.join(chosen, list(key), "left")


def select_tracks(tracks: DataFrame, by: Sequence[str], wanted: Column) -> DataFrame:
    """Tracks that satisfy the predicate; a key with no such track keeps all of its tracks."""
    flag = F.coalesce(wanted, F.lit(False))
    by = list(by)
    known = tracks.groupBy(*by).agg(F.bool_or(flag).alias("_any"))
    joined = tracks.join(known, by) if by else tracks.join(F.broadcast(known), F.lit(True))
    return joined.where(flag | ~F.col("_any")).drop("_any")


def strict_tracks(tracks: DataFrame, by: Sequence[str], wanted: Column, expected: int) -> DataFrame:
    """Tracks that satisfy the predicate; a key with another count than ``expected`` fails the job."""
    by = list(by)
    hits = tracks.where(F.coalesce(wanted, F.lit(False)))
    counts = tracks.groupBy(*by).agg(F.count(F.when(F.coalesce(wanted, F.lit(False)), 1)).alias("_n"))
    message = F.concat(F.lit(f"expected {expected} tracks, found "), F.col("_n").cast("string"))
    checked = counts.where(F.when(F.col("_n") == expected, F.lit(True)).otherwise(F.raise_error(message)))
    return hits.join(checked.select(*by), by)


def strand_compatible(gene_strand: str, track_strand: str) -> Column:
    """A stranded gene accepts its own strand and unstranded tracks; an unstranded gene accepts all."""
    g, t = F.col(gene_strand), F.col(track_strand)
    return F.when(g.isin("+", "-"), (t == g) | (t == ".")).otherwise(F.lit(True))


def recover_scores(states: DataFrame, store: DataFrame, *, key: str = "sequence_sha256") -> DataFrame:
    return states.join(store.dropDuplicates([key]), key, "left")


def design_inputs(spark: SparkSession, path: str, schema: str, *, fmt: str = "csv") -> DataFrame:
    """Frozen design inputs: recipient lists as CSV, track specifications as JSON."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.json(path, multiLine=True)


#: Bytes of a file that its task holds at a time.
BLOCK = 1 << 22


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = []
        for path in frame["path"]:
            digest = hashlib.sha256()
            with open(path.removeprefix("file:"), "rb") as file:
                while block := file.read(BLOCK):
                    digest.update(block)
            found.append(digest.hexdigest())
        yield frame.assign(sha256=found)


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the file that a partition has the lines of (path, bytes, line), in their order."""
    digest, done, path = hashlib.sha256(), 0, None
    for batch in batches:
        paths, sizes, lines = (column.to_pylist() for column in batch.columns)
        if not lines:
            continue
        if path is None:
            path, size = paths[0], sizes[0]
        else:
            lines.insert(0, b"")
        if set(paths) != {path}:
            raise ValueError("a partition has the lines of several files")
        piece = b"\n".join(lines)
        digest.update(piece)
        done += len(piece)
    if path is not None:
        if done == size - 1:  # the last line has an end
            digest.update(b"\n")
        elif done != size:  # a byte order mark or a packed file, whose bytes Spark keeps to itself
            raise ValueError(f"{path} has {size} bytes, its lines {done}")
        yield pa.RecordBatch.from_pydict({"path": [unquote(path)], "bytes": [size], "sha256": [digest.hexdigest()]})


def _manifest_by_lines(spark: SparkSession, path: str, pattern: str, above: int) -> DataFrame:
    """The manifest of files of more than ``above`` bytes, which Spark reads in order, a task each, without a whole file in
    memory: as lines, whose bytes and ends make up any file."""
    session = spark.newSession()  # its own settings: a file is not cut and shares its partition with no other
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        session.conf.set(name, str(1 << 44))
    lines = session.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    about = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")]
    lines = lines.select(*about, F.col("value").cast("binary").alias("line")).where(F.col("bytes") > above)
    return lines.mapInArrow(_line_digests, "path string, bytes bigint, sha256 string")


def file_manifest(spark: SparkSession, path: str, *, pattern: str = "*", largest_value: int = 1 << 30) -> DataFrame:
    """Path, bytes and SHA-256 of every file below a folder.

    Spark lists the files and deals them over tasks. Files that tasks can open are read there by blocks, whatever their
    size. In a store that only Spark reads, a file of up to ``largest_value`` bytes is one value; the lines of a larger one
    stream through a task."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )
    listed = files.select("path", F.col("length").alias("bytes"))
    one = listed.first()  # all lie in one file system
    if one is not None and one.path.startswith("file:"):
        return listed.mapInPandas(_digests, "path string, bytes bigint, sha256 string")
    small = files.where(F.col("length") <= largest_value).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if listed.where(F.col("bytes") > largest_value).isEmpty():
        return small
    folder = fresh_folder(spark, "manifest")  # a row per file, from a session with other settings
    _manifest_by_lines(spark, path, pattern, largest_value).write.parquet(folder)
    return small.unionByName(spark.read.schema("path string, bytes bigint, sha256 string").parquet(folder))


def whole_texts(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    """One row per text file."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def label_rows(df: DataFrame, label: str, order: Sequence[Column], *, name: str = "column_label") -> DataFrame:
    """Append " (k)" to the k-th repetition of a label in row order."""
    counted = row_positions(df, [label], order, name="_k")
    return counted.withColumn(
        name, F.when(F.col("_k") == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" ("), F.col("_k").cast("string"), F.lit(")")))
    ).drop("_k")

