"""Command line: python -m pairloom COMMAND ... ; each command reads files, runs one composition of operators, and writes."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import options
from pairloom.operators import metrics, models, pairs, sequences, structure, vectors, weights
from pairloom.session import ship
from pairloom.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pairloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, *options: tuple) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        for flags, kw in options:
            p.add_argument(*flags.split(), **kw)
        p.add_argument("--out", required=True, help="folder for the result")
        return p

    add("identity", "align all sequences, or two sets, and write identities", ("--fasta", {}), ("--structures", {}), ("--against", {}), ("--against-structures", {}), ("--window-size", {"type": int}), ("--window-step", {"type": int}), ("--single", {"action": "store_true"}))
    add("neighbours", "neighbour lists of CA atoms", ("--structures", {"required": True}), ("--threshold", {"type": float, "default": 10.0}), ("--assembly", {"action": "store_true"}), ("--labels", {"action": "store_true"}))
    add("sanitise", "keep pair lines whose ids have vectors", ("--pairs", {"required": True}), ("--vectors", {"required": True}), ("--missing", {}), ("--separator", {"default": ","}))
    add("split", "split sequences by length", ("--fasta", {"required": True}), ("--length", {"type": int, "required": True}))
    add("mean", "mean vectors of domains", ("--vectors", {"required": True}), ("--sum", {"action": "store_true"}))
    add("weights", "weights of scored pairs", ("--pairs", {"required": True}), ("--exclude", {}), ("--bins", {"type": int, "default": 5}), ("--identity-scale", {"type": float, "default": 0.25}))
    add("folds", "train and test pairs of a class fold", ("--pairs", {"required": True}), ("--classes", {"required": True}), ("--fold", {"type": int, "required": True}), ("--folds", {"type": int, "required": True}))
    add("evaluate", "error and areas of predictions (label, score, prediction)", ("--predictions", {"required": True}))
    net = (("--network", {"default": "transformer", "choices": sorted(models.NETWORKS)}), ("--weights", {}), ("--set", {"action": "append", "default": [], "metavar": "NAME=NUMBER"}))
    add("embed", "pooled vectors of listed domains", ("--ids", {"required": True}), ("--vectors", {"required": True}), *net)
    add("assemblies", "pooled vectors of assemblies from those of their chains (unit.chain)", ("--assemblies", {"required": True}), ("--vectors", {"required": True}), ("--max-residues", {"type": int, "required": True}), *net)
    add("sequences", "sequences of chains, with their class where there is one", ("--structures", {"required": True}), ("--classes", {}))
    add("coordinates", "coordinates and sequences of all domains of scored pairs", ("--pairs", {"required": True}), ("--structures", {"required": True}))
    return top


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """Options that exclude or need each other."""
    if args.command == "identity":
        wrong = options.problem(options.IDENTITY, {k for k, v in vars(args).items() if v is not None})
        if wrong:
            raise ValueError(wrong)
        args.window_step = args.window_step or args.window_size
    if args.command == "folds" and not 0 <= args.fold < args.folds:
        raise ValueError("--fold is from 0 to --folds less 1")
    return args


def chains(spark: SparkSession, path: str):
    atoms = readers.read_mmcif(spark, path) if path.endswith(".cif") else readers.read_pdb(spark, path)
    return structure.alpha_carbons(atoms)


def identity(spark: SparkSession, a: argparse.Namespace) -> None:
    def windowed(rows):
        return sequences.windows(rows, a.window_size, a.window_step) if a.window_size else rows

    def records(structures: str | None, fasta: str):
        if not structures:
            return windowed(readers.read_fasta(spark, fasta, whole_header=True))
        found = structure.chain_records(structure.long_chains(chains(spark, structures)))
        return windowed(found.select(F.concat_ws(".", "unit", "chain").alias("header"), F.col("seq").alias("sequence")))

    left = records(a.structures, a.fasta)
    against = a.against or a.against_structures
    found = sequences.cross_identities(left, records(a.against_structures, a.against)) if against else sequences.identities(left)
    sinks.write_identities(found, a.out, a.single)


def neighbours(spark: SparkSession, a: argparse.Namespace) -> None:
    from pyspark.sql import Window

    from pairloom.functions.geometry import point

    rows = structure.long_chains(chains(spark, a.structures))
    unit = F.col("unit") if a.assembly else F.concat_ws("_", "unit", "chain")
    order = Window.partitionBy("u").orderBy("ord")
    rows = rows.withColumn("u", unit).withColumn("i", F.row_number().over(order) - 1)
    changes = F.coalesce((F.col("chain") != F.lag("chain").over(order)).cast("int"), F.lit(0))
    # each chain has a slot before its first residue and one after its last
    rows = rows.withColumn("slot", F.col("i") + 1 + 2 * F.sum(changes).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    points = rows.select(F.col("u").alias("unit"), "i", point(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    label = F.concat_ws(":", F.col("slot").cast("string"), *(["chain", F.col("res_id").cast("string")] if a.labels else []))
    tokens = rows.select(F.col("u").alias("unit"), "i", label.alias("token"))
    lists = structure.neighbour_lists(points, a.threshold).join(tokens, ["unit", "i"])
    long = lists.select("unit", "i", "token", F.explode_outer("nbrs").alias("j"))
    named = long.join(tokens.select("unit", F.col("i").alias("j"), F.col("token").alias("other")), ["unit", "j"], "left")
    grouped = named.groupBy("unit", "i", "token").agg(F.array_sort(F.collect_list(F.struct("j", "other"))).alias("n"))
    others = F.filter(F.transform("n", lambda x: x["other"]), lambda t: t.isNotNull())
    lines = grouped.select("unit", "i", F.array_join(F.concat(F.array("token"), others), "\t").alias("value"))
    lines.repartition("unit").sortWithinPartitions("unit", "i").select("unit", "value").write.mode("overwrite").partitionBy("unit").text(a.out)


def sanitise(spark: SparkSession, a: argparse.Namespace) -> None:
    catalog = spark.read.parquet(a.vectors).select("domain").distinct()
    kept, missing, counters = pairs.sanitise(spark.read.text(a.pairs), catalog, a.separator)
    sinks.write_lines(kept, a.out)
    if a.missing:
        sinks.write_lines(missing.orderBy("domain").select(F.col("domain").alias("value")), a.missing)
    print(counters.first().asDict())


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = sequences.length_split(readers.read_fasta(spark, a.fasta, whole_header=True), a.length)
    for bucket in ("le", "gt"):
        sinks.write_fasta(rows.where(F.col("bucket") == bucket), f"{a.out}/{bucket}")


def mean(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_vectors(vectors.pooled(spark.read.parquet(a.vectors), "sum" if a.sum else "mean"), a.out)


def weigh(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.read_pairs(spark, a.pairs)
    if a.exclude:
        rows = pairs.exclude(rows, readers.read_ids(spark, a.exclude))
    sinks.write_vectors(weights.weighted(rows, a.bins, a.identity_scale), a.out)


def folds(spark: SparkSession, a: argparse.Namespace) -> None:
    classes = readers.read_classes(spark, a.classes).withColumn("ord", F.monotonically_increasing_id())
    train, test = pairs.fold_split(readers.read_pairs(spark, a.pairs), classes, pairs.fold_slice(classes, a.fold, a.folds, "ord"))
    sinks.write_pairs(train, f"{a.out}/train")
    sinks.write_pairs(test, f"{a.out}/test")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.predictions)
    areas = metrics.roc_auc(rows, "label", "prediction").join(metrics.pr_auc(rows, "label", "prediction"))
    sinks.write_vectors(areas.join(metrics.mse(rows, "prediction", "score")), a.out)


def _pool(spark: SparkSession, a: argparse.Namespace, residues: DataFrame, wanted: DataFrame) -> None:
    """The network on each domain's vectors: out/embeddings, and out/failures for what is listed and has none."""
    first = residues.select(F.size("vec").alias("n")).first()
    made = models.network(a.network, first.n if first else 1, **{k: int(n) for k, n in (s.split("=", 1) for s in a.set)})
    if a.weights:
        made = models.with_weights(made, models.load_weights(a.weights))
    found = wanted.join(models.predict(vectors.gathered(residues), made, "domain", "vecs"), "domain", "left")
    found = found.withColumn("error", F.when(F.col("embedding").isNull(), F.coalesce("error", F.lit("no vectors"))))
    sinks.write_with_failures(found, f"{a.out}/embeddings", f"{a.out}/failures")


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    wanted = readers.read_ids(spark, a.ids, "domain", distinct=True)
    _pool(spark, a, spark.read.parquet(a.vectors).join(wanted, "domain", "left_semi"), wanted)


def assemblies(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lines of --assemblies: an assembly and, after a tab each, its chains in order. Chains without vectors are left out, and
    the chain that takes the residues beyond the limit is the last."""
    parts = F.split("line", "\t")
    listed = readers.read_ids(spark, a.assemblies, "line", distinct=True).select(F.get(parts, 0).alias("assembly"), F.posexplode(F.slice(parts, 2, 1 << 20)).alias("at", "chain"))
    wanted = readers.read_ids(spark, a.assemblies, "line").select(F.get(parts, 0).alias("domain")).distinct()
    rows = spark.read.parquet(a.vectors).withColumnRenamed("domain", "chain").join(listed.select("chain").distinct(), "chain", "left_semi")
    sizes = rows.groupBy("chain").agg(F.count("*").alias("n"))
    used = vectors.within_limit(listed.join(sizes, "chain"), a.max_residues, "n", "assembly", "at")
    # a residue's place is (place of the chain, place in it), which sorts as a struct
    residues = used.join(rows, "chain").select(F.col("assembly").alias("domain"), F.struct("at", "pos").alias("pos"), "vec")
    _pool(spark, a, residues, wanted)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = structure.chain_records(chains(spark, a.structures)).select("unit", "chain", F.col("seq").alias("sequence"))
    named = F.concat_ws("|", "unit", "chain")
    if a.classes:
        known = readers.last_of_each(readers.read_classes(spark, a.classes).withColumn("at", F.monotonically_increasing_id()), "domain", "at")
        rows = pairs.enrich(rows, known.select(F.col("domain").alias("unit"), "class"), "unit", "class")
        named = F.concat_ws("|", "unit", "chain", "class")
    sinks.write_fasta(rows.select(named.alias("header"), "sequence"), a.out)


def coordinates(spark: SparkSession, a: argparse.Namespace) -> None:
    wanted = pairs.unique_ids(readers.read_pairs(spark, a.pairs))
    atoms = chains(spark, a.structures).join(wanted.withColumnRenamed("domain", "unit"), "unit", "left_semi")
    whole = structure.chain_records(atoms.withColumn("chain", F.lit("")))  # a domain's chains are one record
    found = wanted.join(whole.select(F.col("unit").alias("domain"), "cas", "seq"), "domain", "left")
    sinks.write_with_failures(found.withColumn("error", F.when(F.col("seq").isNull(), "no structure")), f"{a.out}/records", f"{a.out}/failures")


COMMANDS = {"identity": identity, "neighbours": neighbours, "sanitise": sanitise, "split": split, "mean": mean, "weights": weigh, "folds": folds, "evaluate": evaluate, "embed": embed, "assemblies": assemblies, "sequences": extract, "coordinates": coordinates}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = checked(parser().parse_args(argv))
    spark = spark or SparkSession.builder.appName("pairloom").getOrCreate()
    ship(spark)
    COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    main()
