"""String expressions over nucleotide sequences and packed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import col

BASES = "ACGT"


def complement(s: str | Column) -> Column:
    return F.translate(col(s), "ACGT", "TGCA")


def reverse_complement(s: str | Column) -> Column:
    return F.reverse(complement(F.upper(col(s))))


def is_single_base(s: str | Column) -> Column:
    return F.coalesce(col(s).rlike("^[ACGT]$"), F.lit(False))


def is_substitution(ref: str | Column, alt: str | Column) -> Column:
    """Single canonical bases that differ."""
    return is_single_base(ref) & is_single_base(alt) & (col(ref) != col(alt))


def variant_label(position: str | Column, ref: str | Column, alt: str | Column) -> Column:
    return F.concat(col(position).cast("string"), F.lit(":"), col(ref), F.lit(">"), col(alt))


def occurrences(s: str | Column, pattern: str) -> Column:
    """0-based starts of every occurrence of ``pattern``, overlapping ones included."""
    # the text is parted before every occurrence, so what is gathered grows with the occurrences and not with the text;
    # all pieces begin one but the first, which may
    pieces = F.split(col(s), f"(?=\\Q{pattern}\\E)")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def gather(seen: Column, piece: Column) -> Column:
        begins = (seen["at"] > 0) | F.startswith(col(s), F.lit(pattern))
        found = F.when(begins, F.array_append(seen["found"], seen["at"])).otherwise(seen["found"])
        return F.struct((seen["at"] + F.length(piece)).alias("at"), found.alias("found"))

    found = F.aggregate(pieces, none, gather, lambda seen: seen["found"])
    return F.coalesce(found, F.array().cast("array<int>"))


def canonical_count(s: str | Column) -> Column:
    return F.length(col(s)) - F.length(F.translate(col(s), "ACGT", ""))


def ambiguous_fraction(s: str | Column) -> Column:
    n = F.length(col(s))
    return F.lit(1.0) - canonical_count(s) / F.when(n > 0, n)


def gc_fraction(s: str | Column) -> Column:
    """G+C over all canonical bases; NULL when there is none."""
    canonical = canonical_count(s)
    gc = F.length(F.regexp_replace(col(s), "[^GC]", ""))
    return gc / F.when(canonical > 0, canonical)


def cpg_density(s: str | Column) -> Column:
    """CG dinucleotides per step of the canonical bases."""
    kept = F.regexp_replace(col(s), "[^ACGT]", "")
    n = F.length(kept)
    hits = (n - F.length(F.replace(kept, F.lit("CG"), F.lit("")))) / F.lit(2)
    return F.when(n > 0, hits / F.greatest(F.lit(1), n - F.lit(1)))


def base_at(s: str | Column, index0: str | Column | int) -> Column:
    i = F.lit(index0) if isinstance(index0, int) else col(index0)
    return F.substring(col(s), i + F.lit(1), F.lit(1))


def replace_segment(s: str | Column, start0: str | Column | int, end0: str | Column | int, replacement: str | Column) -> Column:
    """Swap the half-open slice [start0, end0) for ``replacement`` (a literal string or a Column)."""
    a = F.lit(start0) if isinstance(start0, int) else col(start0)
    b = F.lit(end0) if isinstance(end0, int) else col(end0)
    new = F.lit(replacement) if isinstance(replacement, str) else replacement
    n = F.length(col(s))
    return F.concat(
        F.substring(col(s), F.lit(1), F.greatest(a, F.lit(0))),
        new,
        F.substring(col(s), b + F.lit(1), F.greatest(n - b, F.lit(0))),
    )


def set_base(s: str | Column, index0: str | Column | int, base: str | Column) -> Column:
    i = F.lit(index0) if isinstance(index0, int) else col(index0)
    return replace_segment(s, i, i + F.lit(1), base)


def apply_edits(s: str | Column, edits: str | Column) -> Column:
    """Carry out non-overlapping edits (start, stop, text; 0-based, half-open, ascending) on a sequence."""

    def apply(text: Column, e: Column) -> Column:
        return replace_segment(text, e["start"], e["stop"], e["text"])

    # from the last to the first, so that places before an edit stay; one edit, which most states have, is not left to a
    # function that Spark interprets
    size, text = F.size(col(edits)), col(s)
    several = F.aggregate(F.reverse(col(edits)), text, apply)
    return F.when(size == 0, text).when(size == 1, apply(text, F.get(col(edits), F.lit(0)))).otherwise(several)


def content_hash(s: str | Column) -> Column:
    return F.sha2(col(s), 256)


def strip_version(identifier: str | Column) -> Column:
    return F.regexp_replace(col(identifier), r"\.[0-9]+$", "")


def base_identifier(identifier: str | Column) -> Column:
    return F.split_part(col(identifier), F.lit("."), F.lit(1))


def safe_identifier(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")


def packed_field(key: str | Column, delimiter: str, index: int) -> Column:
    """Field ``index`` (0-based) of a delimiter-packed key; NULL beyond the last field."""
    return F.get(F.split(col(key), delimiter), F.lit(index))


def as_nucleotides(text: str | Column) -> Column:
    """Fold the ASCII letters of free text onto A, C, G, T by alphabet position; drop everything else."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bases = "".join(BASES[i % 4] for i in range(26))
    return F.translate(F.regexp_replace(col(text), "[^A-Za-z]", ""), letters + letters.lower(), bases + bases)
