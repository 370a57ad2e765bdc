"""The logical inputs over the supplied tables, as DataFrames and as the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.geometry import point

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: A total order of pairs: all columns of lineitem, whose rows are unique.
ORDER_SQL = ", ".join(LINE)
SCALE = 60.0
#: A domain's residues are one label's vectors among so many ids in a row, so that larger tables have more domains and not longer ones.
UNIT = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str, extra: list[str] | None = None) -> DataFrame:
    score = (F.col("l_quantity") / 50).cast("float").alias("score")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("domain_i"), F.col("l_suppkey").cast("string").alias("domain_j"), score, *(extra or []))


def dual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.greatest("score", (1 - F.col("l_discount") * 5).cast("float")).alias("score_max")
    return pairs(spark, sf_dir, ["l_discount"]).select("domain_i", "domain_j", top, "score")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("domain"), F.col("p_brand").alias("class"), F.col("p_partkey").alias("ord"))


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").cast("string").alias("id"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("domain"), "embedding")


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, pos, vec, vec_id): a label's vectors of each UNIT of ids, in order of id; later units have their number in the name."""
    unit = F.floor(F.col("vec_id") / UNIT)
    label = F.col("label").cast("string")
    rows = table(spark, sf_dir, "embeddings").withColumn("domain", F.when(unit == 0, label).otherwise(F.concat_ws("-", label, unit.cast("string"))))
    w = Window.partitionBy("domain").orderBy("vec_id")
    return rows.select("domain", F.row_number().over(w).alias("pos"), F.col("embedding").alias("vec"), "vec_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, i, res_id, p): residues with coordinates; ids follow on but for breaks."""
    xyz = [F.get("vec", k).cast("double") * SCALE for k in range(3)]
    return residues(spark, sf_dir).select(F.col("domain").alias("unit"), (F.col("pos") - 1).alias("i"), (F.col("vec_id") % 37).cast("int").alias("res_id"), point(*xyz).alias("p"))


def steady_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As points, with ids that follow on except after each seventh residue."""
    return points(spark, sf_dir).withColumn("res_id", (F.col("i") + F.floor(F.col("i") / 7)).cast("int"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms over embeddings: three chains a label, some hetero, some of a second model or alternative, some odd names."""
    v = F.col("vec_id")
    names = F.element_at(F.array(*[F.lit(n) for n in ("ALA", "GLY", "MSE", "UNK", "LYS", "HOH", "SER", "LIGAND")]), (v % 8 + 1).cast("int"))
    xyz = [(F.get("vec", k).cast("double") * SCALE).alias(c) for k, c in enumerate("xyz")]
    return residues(spark, sf_dir).select(
        F.col("domain").alias("unit"), F.when(v % 11 == 5, 2).otherwise(1).alias("model"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("pos") / 13).cast("int") % 3 + 1).alias("chain"),
        v.alias("ord"), F.col("pos").cast("int").alias("res_id"), names.alias("res_name"), F.when(v % 5 == 4, "CB").otherwise("CA").alias("atom_name"),
        F.when(v % 9 == 7, "B").otherwise(".").alias("alt_loc"), (v % 8 == 5).alias("hetero"), (v % 3).alias("entity"), *xyz,
    )


def _letters() -> Column:
    return F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))


LETTERS_SQL = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's letters, whole."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("header"), _letters().alias("sequence"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark row's letters, whole; those that are no residue stand for one that they resemble."""
    residues = F.translate(_letters(), "JOU", "LKC").alias("sequence")
    return table(spark, sf_dir, "benchmark").select("item_id", F.format_string("B%04d", "item_id").alias("header"), residues)


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, op, numbers): events as changes of a store; every seventh deletes, every third of the rest updates."""
    op = F.when(F.col("event_id") % 7 == 0, "delete").when(F.col("event_id") % 3 == 0, "update").otherwise("set")
    numbers = F.format_string("[%d.0,%d.5]", "event_id", "user_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), numbers.alias("numbers"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = (1 - F.col("l_discount") * 5 - F.col("l_tax")).alias("pred")
    return pairs(spark, sf_dir, ["l_discount", "l_tax", "l_returnflag"]).select(F.when(F.col("score") > F.lit(0.7).cast("float"), 1).otherwise(0).alias("label"), "score", pred, "l_returnflag")


PAIRS = "SELECT CAST(l_partkey AS VARCHAR) AS domain_i, CAST(l_suppkey AS VARCHAR) AS domain_j, CAST(l_quantity / 50 AS FLOAT) AS score, * FROM lineitem"
DOMAIN = f"CASE WHEN vec_id < {UNIT} THEN CAST(label AS VARCHAR) ELSE label || '-' || vec_id // {UNIT} END"
RESIDUES = f"SELECT {DOMAIN} AS domain, row_number() OVER (PARTITION BY label, vec_id // {UNIT} ORDER BY vec_id) AS pos, embedding AS vec, vec_id FROM embeddings"
SQL = {
    "pairs": PAIRS,
    "dual_pairs": f"SELECT domain_i, domain_j, greatest(score, CAST(1 - l_discount * 5 AS FLOAT)) AS score_max, score FROM ({PAIRS})",
    "classes": "SELECT CAST(p_partkey AS VARCHAR) AS domain, p_brand AS class, p_partkey AS ord FROM part",
    "excluded": "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size <= 5",
    "catalog": "SELECT CAST(vec_id AS VARCHAR) AS domain, embedding FROM embeddings",
    "residues": RESIDUES,
    "points": f"SELECT domain AS unit, pos - 1 AS i, CAST(vec_id % 37 AS INTEGER) AS res_id, vec[1]::DOUBLE * {SCALE} AS x, vec[2]::DOUBLE * {SCALE} AS y, vec[3]::DOUBLE * {SCALE} AS z FROM ({RESIDUES})",
    "steady": f"SELECT domain AS unit, pos - 1 AS i, CAST(pos - 1 + (pos - 1) // 7 AS INTEGER) AS res_id, vec[1]::DOUBLE * {SCALE} AS x, vec[2]::DOUBLE * {SCALE} AS y, vec[3]::DOUBLE * {SCALE} AS z FROM ({RESIDUES})",
    "atoms": f"""SELECT domain AS unit, CASE WHEN vec_id % 11 = 5 THEN 2 ELSE 1 END AS model, ['A', 'B', 'C'][(pos // 13) % 3 + 1] AS chain, vec_id AS ord, CAST(pos AS INTEGER) AS res_id,
      ['ALA', 'GLY', 'MSE', 'UNK', 'LYS', 'HOH', 'SER', 'LIGAND'][vec_id % 8 + 1] AS res_name, CASE WHEN vec_id % 5 = 4 THEN 'CB' ELSE 'CA' END AS atom_name,
      CASE WHEN vec_id % 9 = 7 THEN 'B' ELSE '.' END AS alt_loc, vec_id % 8 = 5 AS hetero, vec_id % 3 AS entity,
      vec[1]::DOUBLE * {SCALE} AS x, vec[2]::DOUBLE * {SCALE} AS y, vec[3]::DOUBLE * {SCALE} AS z FROM ({RESIDUES})""",
    "fasta": f"SELECT 'D' || doc_id AS header, {LETTERS_SQL} AS sequence FROM documents",
    "sequences": f"SELECT item_id, printf('B%04d', item_id) AS header, translate({LETTERS_SQL}, 'JOU', 'LKC') AS sequence FROM benchmark",
    "kv_log": "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'update' ELSE 'set' END AS op, printf('[%d.0,%d.5]', event_id, user_id) AS numbers FROM events",
    "predictions": f"SELECT CASE WHEN score > 0.7::FLOAT THEN 1 ELSE 0 END AS label, score, 1 - l_discount * 5 - l_tax AS pred, l_returnflag FROM ({PAIRS})",
}


def with_views(sql: str, *names: str) -> str:
    """SQL with the named views before it; a statement that begins WITH goes on after them."""
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
