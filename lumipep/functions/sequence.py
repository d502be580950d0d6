"""Protein sequences, peptides and flustrings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a protease cuts: between the characters that the two looks name. Fixed values.
PROTEASES = {
    "trypsin": r"(?<=[KR])(?!P|\z)",
    "cyanogen bromide": r"(?<=M)(?!\z)",
    "endopro": r"(?<=[PA])(?!\z)",
}
#: Residues of each dye channel. Fixed values.
LABELS = ("DE", "C", "Y")


def sequence_of(text: Column) -> Column:
    """Letters only, upper case; filtered first, since upper() makes two letters of some."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", ""))


def peptides(sequence: Column, protease: str = "trypsin") -> Column:
    """Array of peptides, in order; an empty sequence gives one empty peptide."""
    if protease not in PROTEASES:
        raise ValueError(f"unknown protease {protease!r}; known: {', '.join(PROTEASES)}")
    return F.split(sequence, PROTEASES[protease], -1)


def flustring(peptide: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Dye string: the channel's digit for a labelled residue, a dot for others; dots at the end are cut. Of channels that share a residue the last wins."""
    channel = {residue: str(i) for i, residues in enumerate(labels) for residue in residues}
    seen = "".join(channel)
    dots = F.regexp_replace(F.coalesce(peptide, F.lit("")), f"[^{seen}]", ".")
    return F.rtrim(F.translate(dots, seen, "".join(channel.values())), F.lit("."))


def dye_count(flu: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(flu, F.lit("")), "[^0-9]", ""))


def p_observable(n_dyes: Column, p_miss: float = 0.07) -> Column:
    """Chance that at least one of the dyes is seen."""
    return 1 - F.pow(F.lit(float(p_miss)), n_dyes)


def ramp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def gene_token(header: Column, tag: str = "GN=") -> Column:
    """Text after the tag up to white space; empty if the tag is missing."""
    return F.regexp_extract(header, tag + r"(\S+)", 1)


def engineering(x: Column, digits: int = 0) -> Column:
    """1500000 as '2M' (digits=0) or '1.5M': thousands K, millions M, billions B; smaller numbers with as many digits."""
    f = f"%.{digits}f"
    return F.when(x >= 1e9, F.concat(F.format_string(f, x / 1e9), F.lit("B"))).when(x >= 1e6, F.concat(F.format_string(f, x / 1e6), F.lit("M"))).when(x >= 1e3, F.concat(F.format_string(f, x / 1e3), F.lit("K"))).otherwise(F.format_string(f, x))


def three_digits(x: Column) -> Column:
    """1234567 as '1.23M', 2000 as '2K': three significant digits of the number's thousands (K), millions (M) or billions (B), without zeros after the point; numbers below 1000 as they are."""
    def short(y: Column) -> Column:
        # 9.995 and up have two digits before the point when they are rounded.
        fixed = F.when(y < 9.995, F.format_string("%.2f", y)).when(y < 99.95, F.format_string("%.1f", y)).otherwise(F.format_string("%.0f", y))
        return F.when(F.contains(fixed, F.lit(".")), F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))).otherwise(fixed)

    return F.when(x >= 1e9, F.concat(short(x / 1e9), F.lit("B"))).when(x >= 1e6, F.concat(short(x / 1e6), F.lit("M"))).when(x >= 1e3, F.concat(short(x / 1e3), F.lit("K"))).otherwise(x.cast("string"))


def dye_track(flu: Column, cycles: int, channels: int = 3) -> Column:
    """Dyes left after 0..cycles removals of the first residue, for each channel: cycles + 1 arrays of `channels` counts."""
    left = lambda c, ch: F.regexp_count(F.substring(flu, c + 1, F.length(flu)), F.lit(str(ch))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(cycles)), lambda c: F.array(*[left(c, ch) for ch in range(channels)]))
