"""Sequence functions as columns: residue codes, tokens, ids and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token ids 0 to 3 are pad, bos, eos and unk; the residues follow in this order from 4.
PAD, BOS, EOS, UNK = 0, 1, 2, 3
RESIDUES = "ARNDCEQGHILKMFPSTWYVXBZUO"

# Three-letter residue names and their letters, standard and modified (with the parent's letter).
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "ASX": "B", "GLX": "Z", "SEC": "U", "PYL": "O", "XLE": "J", "XAA": "X",
}
PARENTS = {"MSE": "MET", "SEP": "SER", "TPO": "THR", "PTR": "TYR", "HYP": "PRO", "CSO": "CYS", "KCX": "LYS", "MLY": "LYS", "CME": "CYS", "PCA": "GLU"}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def tokens(sequence: Column) -> Column:
    """Token ids of a sequence's residues; unknown letters are UNK."""
    known = literal_map({c: i + 4 for i, c in enumerate(RESIDUES)})
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.coalesce(F.try_element_at(known, c), F.lit(UNK)))


def residue_letter(name: Column) -> Column:
    """One letter for a residue name, directly or by its parent; else X."""
    letters, parents = literal_map(LETTERS), literal_map(PARENTS)
    return F.coalesce(F.try_element_at(letters, name), F.try_element_at(letters, F.try_element_at(parents, name)), F.lit("X"))


def chain_of(accession: Column) -> Column:
    """What follows the first dot of an id, else A."""
    return F.coalesce(F.try_element_at(F.split(accession, r"\."), F.lit(2)), F.lit("A"))


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def chain_header(name: Column, chain: Column) -> Column:
    """stem.chain, or the stem alone for a blank chain."""
    return F.when(F.trim(F.coalesce(chain, F.lit(""))) == "", name).otherwise(F.concat_ws(".", name, chain))


def residue_token(index: Column, chain: Column | None = None, res: Column | None = None) -> Column:
    return index.cast("string") if chain is None else F.concat_ws(":", index.cast("string"), chain, res.cast("string"))


def without_ends(a: Column) -> Column:
    """An array without its first and last element."""
    return F.slice(a, F.lit(2), F.greatest(F.lit(0), F.size(a) - 2))


def four_decimals(x: Column) -> Column:
    """Text with four decimals of the exact value, ties to even; nan for null and NaN."""
    x = x.cast("double")
    # what rounding took from the product, by the halves of x: it tells a tie from a product that only looks like one
    scaled = x * 10_000
    high = x * 134217729.0 - (x * 134217729.0 - x)
    lost = (high * 10_000 - scaled) + (x - high) * 10_000
    below = F.floor(scaled).cast("double")
    rounded = F.when((scaled - below == 0.5) & (lost != 0), below + (lost > 0).cast("double")).otherwise(F.rint(scaled))
    return F.when(x.isNull() | F.isnan(x), "nan").otherwise(F.format_string("%.4f", F.when(F.abs(x) < 1e11, rounded / 10_000).otherwise(x)))
