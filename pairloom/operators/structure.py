"""Operators on atoms (unit, chain, ord, res_id, res_name, atom_name, alt_loc, hetero, model, x, y, z) and residues
(unit, i, res_id, p), where p is a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import geometry as G
from pairloom.functions.sequences import LETTERS, residue_letter

MIN_RESIDUES = 10


def alpha_carbons(atoms: DataFrame) -> DataFrame:
    """CA atoms of amino acids (or UNK) of the first model, first alternative."""
    acid = F.col("res_name").isin(*LETTERS, "UNK")
    return atoms.where((F.col("atom_name") == "CA") & (F.col("model") == 1) & acid & F.col("alt_loc").isin(".", "A", ""))


def amino_atoms(atoms: DataFrame, chain: str | None = None) -> DataFrame:
    rows = atoms.where(F.col("res_name").isin(*LETTERS) & ~F.col("hetero"))
    return rows if chain is None else rows.where(F.col("chain") == chain)


def of_polymers(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows whose entity is a polymer."""
    return rows.join(entities.where("type = 'polymer'").select("entity").distinct(), "entity", "left_semi")


def long_chains(rows: DataFrame, least: int = MIN_RESIDUES) -> DataFrame:
    """Rows of the chains that have `least` different residues or more."""
    sizes = rows.groupBy("unit", "chain").agg(F.countDistinct("res_id").alias("n")).where(F.col("n") >= least)
    return rows.join(sizes.select("unit", "chain"), ["unit", "chain"], "left_semi")


def first_long_chain(rows: DataFrame, least: int = MIN_RESIDUES) -> DataFrame:
    """(unit, chain): the first chain, in order of its first row, with `least` residues or more."""
    sizes = rows.groupBy("unit", "chain").agg(F.countDistinct("res_id").alias("n"), F.min("ord").alias("first")).where(F.col("n") >= least)
    return sizes.groupBy("unit").agg(F.min_by("chain", "first").alias("chain"))


def as_single_chain(atoms: DataFrame) -> DataFrame:
    """Atoms renamed to chain A, none of them hetero, with over-long residue names as UNK."""
    return atoms.withColumns({"chain": F.lit("A"), "hetero": F.lit(False), "res_name": F.when(F.length("res_name") > 3, "UNK").otherwise(F.col("res_name"))})


def segments(rows: DataFrame, unit: str = "unit", order: str = "ord", res: str = "res_id", chain: str | None = None) -> DataFrame:
    """rows with `segment`, counted from 0 in each unit: a new one where the residue id falls or the chain changes."""
    w = Window.partitionBy(unit).orderBy(order)
    new = F.col(res) < F.lag(res).over(w)
    if chain:
        new = new | (F.col(chain) != F.lag(chain).over(w))
    marked = rows.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int"))
    return marked.withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def segment_sizes(rows: DataFrame, **columns) -> DataFrame:
    """(unit, segment, n): different residues of each segment."""
    cut = segments(rows, **columns)
    unit, res = columns.get("unit", "unit"), columns.get("res", "res_id")
    return cut.groupBy(unit, "segment").agg(F.countDistinct(res).alias("n"))


def disjoint_units(rows: DataFrame, **columns) -> DataFrame:
    """(unit, sizes) of the units with more than one segment, their sizes in order."""
    unit = columns.get("unit", "unit")
    sizes = segment_sizes(rows, **columns).groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("segment", "n"))).alias("s"))
    return sizes.where(F.size("s") > 1).select(unit, F.transform("s", lambda x: x["n"]).alias("sizes"))


def single_segment(rows: DataFrame, **columns) -> DataFrame:
    """Rows of the units with one segment only."""
    unit = columns.get("unit", "unit")
    whole = segment_sizes(rows, **columns).groupBy(unit).agg(F.count("*").alias("n")).where("n = 1")
    return rows.join(whole.select(unit), unit, "left_semi")


def chain_runs(rows: DataFrame) -> DataFrame:
    """(unit, chain, n): of each chain the last of its runs of neighbouring rows that is long enough, but for the
    chain of the unit's last run the first such."""
    w = Window.partitionBy("unit").orderBy("ord")
    new = F.coalesce((F.col("chain") != F.lag("chain").over(w)).cast("int"), F.lit(0))
    runs = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("unit", "run").agg(F.first("chain").alias("chain"), F.count("*").alias("n"))
    last = runs.groupBy("unit").agg(F.max("run").alias("__last"))
    runs = runs.join(last, "unit").where(F.col("n") >= MIN_RESIDUES)
    # the last run counts only if no earlier run of its chain did
    final = F.col("run") == F.col("__last")
    kept = runs.groupBy("unit", "chain").agg(F.max_by(F.when(~final, F.col("n")), F.when(~final, F.col("run"))).alias("__early"), F.max(F.when(final, F.col("n"))).alias("__final"))
    return kept.select("unit", "chain", F.coalesce("__early", "__final").alias("n"))


def chain_records(carbons: DataFrame) -> DataFrame:
    """(unit, chain, cas, seq, labels): coordinates, one-letter sequence and residue ids of each chain in order."""
    row = F.struct("ord", F.array("x", "y", "z").alias("ca"), residue_letter(F.col("res_name")).alias("letter"), F.col("res_id").alias("label"))
    grouped = carbons.groupBy("unit", "chain").agg(F.array_sort(F.collect_list(row)).alias("r"))
    part = lambda name: F.transform("r", lambda x: x[name])
    return grouped.select("unit", "chain", part("ca").alias("cas"), F.array_join(part("letter"), "").alias("seq"), part("label").alias("labels"))


def assembly_offsets(chains: DataFrame, unit: str = "unit", order: str = "chain_order", size: str = "n") -> DataFrame:
    """chains with `offset`: the slots of the chains before, each of which has two more than its residues."""
    before = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chains.withColumn("offset", F.coalesce(F.sum(F.col(size) + 2).over(before), F.lit(0)).cast("int"))


def index_map(chains: DataFrame, unit: str = "unit", order: str = "chain_order", size: str = "n") -> DataFrame:
    """(unit, order, j, index): the slot of the j-th residue of each chain, one after the chain's first."""
    placed = assembly_offsets(chains, unit, order, size).where(F.col(size) > 0)
    residues = placed.select(unit, order, "offset", F.explode(F.sequence(F.lit(0), F.col(size).cast("int") - 1)).alias("j"))
    return residues.select(unit, order, "j", (F.col("offset") + F.col("j") + 1).alias("index"))


def _cell(v: Column, width: float) -> Column:
    return F.floor(v / width).cast("int")


def within(residues: DataFrame, threshold: float, strict: bool, unit: str = "unit") -> DataFrame:
    """(unit, i, j, d): ordered pairs of different residues of a unit within a distance.

    A grid of cells as wide as the threshold makes it an equi-join: each residue meets those of its 27 cells.
    """
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    cell = lambda axis: _cell(F.col("p")[axis], threshold)
    here = residues.select(unit, F.col("i"), F.col("p").alias("__pi"), cell("x").alias("__cx"), cell("y").alias("__cy"), cell("z").alias("__cz"))
    there = residues.select(unit, F.col("i").alias("j"), F.col("p").alias("__pj"), cell("x").alias("__x"), cell("y").alias("__y"), cell("z").alias("__z"))
    for axis in "xyz":
        there = there.withColumn("__k", F.explode(near)).withColumn(f"__c{axis}", F.col(f"__{axis}") + F.col("__k")).drop("__k", f"__{axis}")
    met = here.join(there, [unit, "__cx", "__cy", "__cz"]).withColumn("d", G.distance(F.col("__pi"), F.col("__pj")))
    close = F.col("d") < threshold if strict else F.col("d") <= threshold
    return met.where((F.col("i") != F.col("j")) & close).select(unit, "i", "j", "d")


def neighbour_lists(residues: DataFrame, threshold: float, unit: str = "unit") -> DataFrame:
    """(unit, i, nbrs): for each residue the places of those within the threshold, in order; none gives an empty list."""
    pairs = within(residues, threshold, False, unit).groupBy(unit, "i").agg(F.array_sort(F.collect_list("j")).alias("nbrs"))
    return residues.select(unit, "i").join(pairs, [unit, "i"], "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<int>")))


def with_flanks(residues: DataFrame, unit: str = "unit") -> DataFrame:
    """residues with the points before and after, null unless the residue ids follow on."""
    w = Window.partitionBy(unit).orderBy("i")
    back = F.when(F.col("res_id") - F.lag("res_id").over(w) == 1, F.lag("p").over(w))
    fore = F.when(F.lead("res_id").over(w) - F.col("res_id") == 1, F.lead("p").over(w))
    return residues.withColumns({"back": back, "fore": fore})


def _sin_cos(angle: Column, there: Column) -> tuple[Column, Column]:
    return F.when(there, F.sin(angle)).otherwise(0.0), F.when(there, F.cos(angle)).otherwise(0.0)


def graph_nodes(residues: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, i, sin_a, cos_a, df, db): the angle at each residue and its closeness to the next and the last; 0 at breaks."""
    rows = with_flanks(residues, unit)
    both = F.col("back").isNotNull() & F.col("fore").isNotNull()
    rows = rows.withColumn("__a", F.when(both, G.angle_at(F.col("back"), F.col("p"), F.col("fore"))))
    sin, cos = _sin_cos(F.col("__a"), both)
    near = lambda c: F.when(F.col(c).isNotNull(), G.exp_distance(G.distance(F.col(c), F.col("p")))).otherwise(0.0)
    return rows.select(unit, "i", sin.alias("sin_a"), cos.alias("cos_a"), near("fore").alias("df"), near("back").alias("db"))


def directions(residues: DataFrame, unit: str = "unit") -> DataFrame:
    """residues with unit vectors: `ahead` to the next residue, `behind` from the last, and the `normal` of the plane of
    the three; null at breaks. They are made once a residue, not once a contact."""
    rows = with_flanks(residues, unit)
    steps = rows.withColumns({"__f": G.minus(F.col("fore"), F.col("p")), "__b": G.minus(F.col("p"), F.col("back")), "__n": G.normal(F.col("back"), F.col("p"), F.col("fore"))})
    have = {"ahead": ("__f", F.col("fore").isNotNull()), "behind": ("__b", F.col("back").isNotNull()), "normal": ("__n", F.col("fore").isNotNull() & F.col("back").isNotNull())}
    return steps.withColumns({k: F.when(ok, G.unit(F.col(c))) for k, (c, ok) in have.items()}).drop("__f", "__b", "__n", "fore", "back")


def graph_edges(residues: DataFrame, threshold: float = G.CONTACT, unit: str = "unit") -> DataFrame:
    """(unit, i, j, e, contiguous, es, ec, fs, fc, bs, bc): contacts nearer than the threshold, in both directions."""
    rows = directions(residues, unit)
    side = lambda k: rows.select(unit, F.col("i").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("res_id", "ahead", "behind", "normal")])
    met = within(residues, threshold, True, unit).join(side("i"), [unit, "i"]).join(side("j"), [unit, "j"])
    for name in ("normal", "ahead", "behind"):
        met = met.withColumn(f"__{name}", G.angle_of_units(F.col(f"{name}_i"), F.col(f"{name}_j")))
    there = lambda name: F.col(f"{name}_i").isNotNull() & F.col(f"{name}_j").isNotNull()
    next_to = (F.abs(F.col("res_id_i") - F.col("res_id_j")) == 1).cast("int")
    named = {"e": G.exp_distance(F.col("d")), "contiguous": next_to}
    for name, (sin, cos) in {"normal": ("es", "ec"), "ahead": ("fs", "fc"), "behind": ("bs", "bc")}.items():
        named[sin], named[cos] = _sin_cos(F.col(f"__{name}"), there(name))
    return met.select(unit, "i", "j", *[v.alias(k) for k, v in named.items()])
