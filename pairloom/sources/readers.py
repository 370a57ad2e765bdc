"""Readers. Every schema is declared; nothing is inferred. The string "NA" is an id like any other."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.sequences import stem

PAIRS = "domain_i STRING, domain_j STRING, score FLOAT"
DUAL_PAIRS = "domain_i STRING, domain_j STRING, score_max FLOAT, score FLOAT"
CLASSES = "domain STRING, class STRING"
ATOMS = "unit STRING, model INT, chain STRING, ord LONG, res_id INT, res_name STRING, atom_name STRING, alt_loc STRING, hetero BOOLEAN, x DOUBLE, y DOUBLE, z DOUBLE"
STRUCTURE_ENDINGS = r"\.(pdb|ent|cif)$"


def _csv(spark: SparkSession, path: str, schema: str, separator: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(sep=separator, nullValue="", emptyValue="", **options).csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Headerless comma-separated scored pairs."""
    return _csv(spark, path, PAIRS, ",")


def read_dual_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, DUAL_PAIRS, ",")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated (domain, class)."""
    return _csv(spark, path, CLASSES, "\t")


def read_identity_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated scored pairs; lines from # on are comments, and a header (a score that is no number) is left out.

    A score of nan is NaN.
    """
    raw = _csv(spark, path, "domain_i STRING, domain_j STRING, score STRING", "\t", comment="#")
    return raw.where("try_cast(score AS FLOAT) IS NOT NULL").withColumn("score", F.expr("try_cast(score AS FLOAT)"))


def read_ids(spark: SparkSession, path: str, name: str = "id", distinct: bool = False) -> DataFrame:
    """One trimmed id a line; empty lines are skipped."""
    ids = spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")
    return ids.distinct() if distinct else ids


def read_list_with_header(spark: SparkSession, path: str, name: str = "entry") -> DataFrame:
    """Ids below a header line, which is dropped whatever it says."""
    return spark.read.option("header", "true").schema(f"{name} STRING").csv(path, enforceSchema=True)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(at, record) of FASTA text: records without their >; what stands before the first one is left out."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    firsts = raw.where("block = 0").groupBy("file").agg(F.min("at").alias("first"))  # one row a file
    rows = raw.join(firsts, "file", "left")
    head = F.coalesce(F.col("at") == F.col("first"), F.lit(False))
    opened = F.col("value").startswith(">")
    rows = rows.where(~head | opened)
    return rows.select("at", F.when(head, F.substr("value", F.lit(2))).otherwise(F.col("value")).alias("record"))


def read_fasta(spark: SparkSession, path: str, whole_header: bool = False, alphabet: str | None = None) -> DataFrame:
    """(header, sequence) of FASTA files, lines of a sequence joined.

    The header is its first word, and of records with one header the last counts; with whole_header it is the
    whole line, and all records stay. With an alphabet, sequences with other letters are left out.
    """
    line = F.substring_index("record", "\n", 1)
    body = F.regexp_replace(F.substr("record", F.length(line) + 1), r"\s", "")
    cut = _records(spark, path).select("at", F.trim(line).alias("line"), body.alias("sequence"))
    rows = cut if alphabet is None else cut.where(F.col("sequence").rlike(f"^[{re.escape(alphabet)}]*$"))
    if whole_header:
        return rows.select(F.col("line").alias("header"), "sequence")
    named = rows.select(F.substring_index("line", " ", 1).alias("header"), "at", "sequence")
    return named.groupBy("header").agg(F.max_by("sequence", "at").alias("sequence"))


def read_neighbours(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """(i, nbrs) of ragged tab-separated lines; blank lines are skipped, and of lines with one index the last counts.

    With `by`, of a directory for each of its values, which is a first column then.
    """
    own = [by] if by else []
    lines = spark.read.schema(", ".join(["value STRING", *[f"{c} STRING" for c in own]])).text(path)
    lines = lines.where("trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    numbers = lines.select(*own, "at", F.split("value", "\t").cast("array<int>").alias("n"))
    rows = numbers.select(*own, "at", F.get("n", 0).alias("i"), F.slice("n", F.lit(2), F.size("n")).alias("nbrs"))
    return rows.groupBy(*own, "i").agg(F.max_by("nbrs", "at").alias("nbrs"))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last in order (a later line of a map file wins)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def list_entries(spark: SparkSession, path: str, pattern: str = STRUCTURE_ENDINGS) -> DataFrame:
    """(file, id): files of a directory, in order of name; the id is the name without a structure file's ending.

    Contents are not read.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.select("file", F.when(F.col("file").rlike(pattern), stem(F.col("file"))).otherwise(F.col("file")).alias("id")).orderBy("file")


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of PDB files by their fixed columns; unit is the file's stem, a blank chain is '0', a blank alternative '.'."""
    from pyspark.sql import Window

    raw = spark.read.text(path).select("value", stem(F.col("_metadata.file_name")).alias("unit"), F.monotonically_increasing_id().alias("ord"))
    in_file = Window.partitionBy("unit").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    model = F.when(F.col("value").startswith("MODEL "), F.expr("try_cast(trim(substr(value, 7)) AS INT)"))
    rows = raw.withColumn("model", F.coalesce(F.last(model, ignorenulls=True).over(in_file), F.lit(1)))
    rows = rows.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    part = lambda a, n: F.trim(F.substring("value", a, n))
    number = lambda a, n, kind: F.expr(f"try_cast(trim(substr(value, {a}, {n})) AS {kind})")
    blank = lambda c, other: F.when(c == "", other).otherwise(c)
    return rows.select(
        "unit", "model", blank(part(22, 1), "0").alias("chain"), "ord", number(23, 4, "INT").alias("res_id"), part(18, 3).alias("res_name"), part(13, 4).alias("atom_name"),
        blank(part(17, 1), ".").alias("alt_loc"), F.col("value").startswith("HETATM").alias("hetero"), number(31, 8, "DOUBLE").alias("x"), number(39, 8, "DOUBLE").alias("y"), number(47, 8, "DOUBLE").alias("z"),
    )


_CIF_WORD = re.compile(r"""'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(\S+)""")


def _cif_words(text: str) -> Iterator[tuple[bool, str]]:
    """(bare, word) of an mmCIF text. Names and keywords are bare; what is quoted, or stands between lines that begin with
    a semicolon, is a value, whatever it says. Comments are left out."""
    block = None
    for line in text.replace("\r\n", "\n").split("\n"):
        if block is not None and not line.startswith(";"):
            block.append(line)
            continue
        if line.startswith(";"):
            if block is None:
                block = [line[1:]]
                continue
            yield False, "\n".join(block)
            block, line = None, line[1:]
        for m in _CIF_WORD.finditer(line):
            quoted = m[1] if m[1] is not None else m[2]
            if quoted is None and m[3].startswith("#"):
                break
            yield (True, m[3]) if quoted is None else (False, quoted)


def cif_rows(text: str, category: str) -> list[dict[str, str]]:
    """The rows of one category of an mmCIF text's first block that has it, as dicts of item names: those of a loop,
    or one of single items. A last row without all its values is left out."""
    prefix = f"_{category}."
    rows, single, names, values = [], {}, [], []
    loop = heading = False  # within a loop; within its names
    name = None  # of a single item whose value comes next
    for bare, word in _cif_words(text):
        if bare and (word.lower() == "loop_" or word.lower().startswith(("data_", "save_"))):
            if word.lower() != "loop_" and (rows or single):
                break
            loop = heading = word.lower() == "loop_"
            names, values, name = [], [], None
        elif bare and word.startswith("_"):
            loop = loop and heading
            if loop:
                names.append(word)
            else:
                name = word
        elif loop:
            heading = False
            if names and names[0].startswith(prefix):
                values.append(word)
                if len(values) == len(names):
                    rows.append(dict(zip([n[len(prefix) :] for n in names], values, strict=True)))
                    values = []
        elif name is not None:
            if name.startswith(prefix):
                single[name[len(prefix) :]] = word
            name = None
    return rows or ([single] if single else [])


def _cif_atoms(author: bool):
    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, seq = ("auth_asym_id", "auth_seq_id") if author else ("label_asym_id", "label_seq_id")
        for b in files:
            for unit, content in zip(b["unit"], b["content"], strict=True):
                rows = cif_rows(bytes(content).decode(), "atom_site")
                number = lambda v: int(v) if v.lstrip("-").isdigit() else None
                out = [
                    (unit, int(r.get("pdbx_PDB_model_num", "1")), r.get(chain, "A"), k, number(r.get(seq, "")), r.get("label_comp_id"), r.get("label_atom_id"), r.get("label_alt_id", "."),
                     r.get("group_PDB") == "HETATM", float(r["Cartn_x"]), float(r["Cartn_y"]), float(r["Cartn_z"]))
                    for k, r in enumerate(rows)
                ]
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in ATOMS.split(", ")]).astype({"res_id": "Int32"})

    return run


def read_mmcif(spark: SparkSession, path: str, author: bool = False) -> DataFrame:
    """Atoms of mmCIF files, with the label ids, or the author's."""
    files = spark.read.format("binaryFile").load(path).select(stem(F.element_at(F.split("path", "/"), -1)).alias("unit"), "content")
    return files.mapInPandas(_cif_atoms(author), ATOMS)
