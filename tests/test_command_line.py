from __future__ import annotations

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from pairloom.__main__ import checked, main, parser
from pairloom.operators import models, sequences
from pairloom.plans import views as v
from pairloom.session import scratch
from pairloom.sources import readers, sinks


@pytest.mark.parametrize(
    "line",
    ["identity --out o", "identity --fasta a --structures b --out o", "identity --fasta a --window-step 5 --out o", "identity --structures a --against b --against-structures c --out o", "folds --pairs a --classes b --fold 3 --folds 3 --out o"],
)
def test_options_that_do_not_go_together(line):
    with pytest.raises(ValueError):
        checked(parser().parse_args(line.split()))


def test_identity_split_and_weights(spark):
    fasta, out = scratch(spark, "cli"), scratch(spark, "cli-out")
    sinks.write_fasta(v.sequences(spark, oracle.DATA).orderBy("item_id").limit(6), fasta)
    main(["identity", "--fasta", fasta, "--out", out, "--single"], spark)
    found = readers.read_identity_pairs(spark, out)
    assert found.count() == 15 and found.where("score between 0 and 1").count() == 15
    main(["identity", "--fasta", fasta, "--against", fasta, "--window-size", "40", "--window-step", "20", "--out", out], spark)
    windows = sequences.windows(readers.read_fasta(spark, fasta), 40, 20).count()
    assert windows > 12 and readers.read_identity_pairs(spark, out).count() == windows**2
    main(["split", "--fasta", fasta, "--length", "59", "--out", out], spark)
    assert readers.read_fasta(spark, f"{out}/gt").count() == 6 and readers.read_fasta(spark, f"{out}/le").count() == 0
    pairs = scratch(spark, "cli-pairs")
    sinks.write_pairs(v.pairs(spark, oracle.DATA), pairs)
    main(["weights", "--pairs", pairs, "--out", out], spark)
    assert spark.read.parquet(out).agg(F.round(F.sum("weight"), 6)).first()[0] == 9.0


def test_neighbours_of_files(spark):
    path, out = scratch(spark, "cli-pdb"), scratch(spark, "cli-out")
    line = "ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f"
    rows = [line % (k, "AB"[k // 12], k % 12 + 1, 3.8 * (k % 12), 20.0 * (k // 12), 0.0) for k in range(24)]
    spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1).write.text(path)
    main(["neighbours", "--structures", path, "--threshold", "4", "--assembly", "--labels", "--out", out], spark)
    lines = [r.value for r in spark.read.text(f"{out}/*").collect()]
    assert len(lines) == 24 and "1:A:1\t2:A:2" in lines and "2:A:2\t1:A:1\t3:A:3" in lines and "15:B:1\t16:B:2" in lines


def test_sanitise_folds_and_evaluation(spark):
    pairs, vectors, out, missing = (scratch(spark, f"cli-{k}") for k in range(4))
    sinks.write_pairs(v.pairs(spark, oracle.DATA), pairs)
    sinks.write_vectors(v.residues(spark, oracle.DATA).withColumn("domain", F.col("vec_id").cast("string")), vectors)
    main(["sanitise", "--pairs", pairs, "--vectors", vectors, "--missing", missing, "--out", out], spark)
    assert readers.read_pairs(spark, out).count() == v.pairs(spark, oracle.DATA).count()
    main(["mean", "--vectors", vectors, "--out", out], spark)
    assert spark.read.parquet(out).count() == 500
    classes = scratch(spark, "cli-classes")
    sinks.write_pairs(v.classes(spark, oracle.DATA).select("domain", "class"), classes, "\t", single=True)
    main(["folds", "--pairs", pairs, "--classes", classes, "--fold", "1", "--folds", "5", "--out", out], spark)
    assert readers.read_pairs(spark, f"{out}/train").count() + readers.read_pairs(spark, f"{out}/test").count() == v.pairs(spark, oracle.DATA).count()
    sinks.write_vectors(v.predictions(spark, oracle.DATA).select("label", F.col("score").cast("double").alias("score"), F.col("pred").alias("prediction")), vectors)
    main(["evaluate", "--predictions", vectors, "--out", out], spark)
    assert set(spark.read.parquet(out).columns) == {"roc_auc", "pr_auc", "mse"}


def test_embeddings_of_ids_and_assemblies(spark, tmp_path):
    vectors, lists, out = scratch(spark, "cli-vectors"), scratch(spark, "cli-lists"), scratch(spark, "cli-out")
    rows = {"u.A": [[1.0, 2.0], [3.0, 5.0]], "u.B": [[0.5, 0.25]], "u.C": [[9.0, 1.0]]}
    sinks.write_vectors(spark.createDataFrame([(d, k, x) for d, xs in rows.items() for k, x in enumerate(xs)], "domain string, pos int, vec array<double>"), vectors)
    net = models.network("transformer", 2, heads=1, hidden=4, layers=1, seed=7)
    models.save_weights(net, str(tmp_path / "w.npz"))
    network = f"--network transformer --set heads=1 --set hidden=4 --set layers=1 --weights {tmp_path}/w.npz".split()

    def written(text: str) -> str:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(lists)
        return lists

    def expect(want: dict[str, list]) -> None:
        got = {r.domain: r.embedding for r in spark.read.parquet(f"{out}/embeddings").collect()}
        assert set(got) == set(want)
        for k, x in want.items():
            assert got[k] == pytest.approx(net(np.array(x)).tolist())

    main(["embed", "--ids", written("u.A\nu.C\nu.X\nu.A"), "--vectors", vectors, *network, "--out", out], spark)
    expect({k: rows[k] for k in ("u.A", "u.C")})
    assert [(r.domain, r.error) for r in spark.read.parquet(f"{out}/failures").collect()] == [("u.X", "no vectors")]
    main(["assemblies", "--assemblies", written("u-1\tu.C\tu.X\tu.A\tu.B\nu-2\tu.B\tu.B\nu-3\tu.X"), "--vectors", vectors, "--max-residues", "2", *network, "--out", out], spark)
    expect({"u-1": rows["u.C"] + rows["u.A"], "u-2": rows["u.B"] * 2})
    assert [r.domain for r in spark.read.parquet(f"{out}/failures").collect()] == ["u-3"]


def test_sequences_and_coordinates_of_files(spark):
    path, classes, pairs, out = (scratch(spark, f"cli-{k}") for k in ("pdb", "classes", "pairs", "out"))
    line = "ATOM  %5d  CA  %s %s%4d    %8.3f%8.3f%8.3f"
    rows = [line % (k, ("ALA", "GLY")[k % 2], "AB"[k // 3], k % 3 + 1, 1.0 * k, 0.0, 0.0) for k in range(6)]
    spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1).write.text(path)
    unit = readers.read_pdb(spark, path).first().unit
    spark.createDataFrame([(f"{unit}\told\n{unit}\ta.1",)], "value string").coalesce(1).write.text(classes)
    main(["sequences", "--structures", path, "--classes", classes, "--out", out], spark)
    assert {r.header: r.sequence for r in readers.read_fasta(spark, out).collect()} == {f"{unit}|A|a.1": "AGA", f"{unit}|B|a.1": "GAG"}
    main(["sequences", "--structures", path, "--out", out], spark)
    assert {r.header for r in readers.read_fasta(spark, out).collect()} == {f"{unit}|A", f"{unit}|B"}
    sinks.write_pairs(spark.createDataFrame([(unit, "other", 0.5)], readers.PAIRS), pairs)
    main(["coordinates", "--pairs", pairs, "--structures", path, "--out", out], spark)
    got = spark.read.parquet(f"{out}/records").collect()
    assert [(r.domain, r.seq, [c[0] for c in r.cas]) for r in got] == [(unit, "AGAGAG", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])]
    assert [r.domain for r in spark.read.parquet(f"{out}/failures").collect()] == ["other"]
