from __future__ import annotations

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import geometry as G
from pairloom.operators import sequences, structure
from pairloom.session import scratch
from pairloom.sources import readers, sinks


def test_angles_of_the_examples(spark):
    p = lambda *v: G.point(*map(F.lit, v))
    planes = G.angle_of_planes((p(0, 0, 0), p(1, 0, 0), p(1, 1, 0)), (p(0, 0, 0), p(0, 0, 1), p(0, 1, 1)))
    flat = G.angle(p(0, 0, 0), p(1, 0, 0))
    row = spark.range(1).select(planes, G.angle(p(1, 0, 0), p(0, 1, 0)), flat).first()
    assert math.isclose(row[0], math.pi / 2) and math.isclose(row[1], math.pi / 2) and math.isnan(row[2])


def test_index_offsets(spark):
    chains = spark.createDataFrame([("u", 0, 3), ("u", 1, 4)], "unit string, chain_order int, n int")
    assert sorted(r["index"] for r in structure.index_map(chains).collect()) == [1, 2, 3, 6, 7, 8, 9]


def test_grid_join_equals_nested_loops(spark):
    r = np.random.default_rng(2)
    xyz = r.uniform(-20, 20, (150, 3)).round(1)
    xyz[:3] = [[0, 0, 0], [8, 0, 0], [0, -8, 0]]
    rows = spark.createDataFrame([("u", i, tuple(map(float, p))) for i, p in enumerate(xyz)], "unit string, i int, p struct<x:double,y:double,z:double>")
    d = np.linalg.norm(xyz[:, None] - xyz, axis=2)
    for strict in (False, True):
        near = (d < 8) if strict else (d <= 8)
        want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i != j}
        assert {(x.i, x.j) for x in structure.within(rows, 8.0, strict).collect()} == want


def test_segments(spark):
    rows = spark.createDataFrame([("a", k, r) for k, r in enumerate([1, 2, 3, 2, 3, 1])] + [("b", 0, 5), ("b", 1, 9)], "unit string, ord int, res_id int")
    assert [tuple(r) for r in structure.disjoint_units(rows).collect()] == [("a", [3, 2, 1])]
    assert {r.unit for r in structure.single_segment(rows).collect()} == {"b"}


def test_short_chains_go(spark):
    rows = spark.createDataFrame([("u", c, k, k) for c, n in (("A", 9), ("B", 10)) for k in range(n)], "unit string, chain string, ord int, res_id int")
    assert {r.chain for r in structure.long_chains(rows).collect()} == {"B"}
    assert structure.first_long_chain(rows).first().chain == "B"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 130), min_size=1, max_size=5))
def test_windows_cover_the_sequence(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}", ("ACDEFGHIKL" * 13)[:n]) for k, n in enumerate(sizes)], "header string, sequence string")
    got = [tuple(r) for r in sequences.windows(rows, 50, 30).collect()]
    for k, n in enumerate(sizes):
        own = sorted((int(h.split("|")[1].split("-")[0]), int(h.split("-")[1]), s) for h, s in got if h.startswith(f"s{k}|"))
        assert own[0][0] == 1 and own[-1][1] == n and all(len(s) == 50 for *_, s in own)
        assert all(b[0] <= a[1] + 1 for a, b in zip(own, own[1:], strict=False))


def _exhaustive(a: str, b: str, scores) -> float:
    """The best score of any global alignment, by the textbook recurrences in three full tables."""
    n, m, low = len(a), len(b), -1e9
    s, u, w = np.zeros((n + 1, m + 1)), np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            o1, e1 = (0, 0) if j == m else (10, 1)
            o2, e2 = (0, 0) if i == n else (10, 1)
            u[i, j] = max(s[i - 1, j] - o1, u[i - 1, j] - e1)
            w[i, j] = max(s[i, j - 1] - o2, w[i, j - 1] - e2)
            s[i, j] = max(s[i - 1, j - 1] + scores[ord(a[i - 1]), ord(b[j - 1])], u[i, j], w[i, j])
    return s[n, m]


def test_identity_of_alignments():
    scores = sequences.substitution()
    assert sequences.identity("ACDEFGH", "ACDEFGH", scores) == 1.0
    assert sequences.identity("ACDEFGHIKLMN", "DEFGHIK", scores) == 1.0
    assert sequences.identity("", "ACD", scores) == 0.0 and math.isnan(sequences.identity("AC1", "ACD", scores))
    r = np.random.default_rng(4)
    for _ in range(40):
        a, b = ("".join(r.choice(list("ACDEFW"), r.integers(1, 14))) for _ in range(2))
        assert sequences.align(a, b, scores)[0] == _exhaustive(a, b, scores)
    assert scores[ord("W"), ord("W")] == 11 and scores[ord("A"), ord("R")] == -1 and (scores == scores.T).all()


def test_equal_pair_rows_cover_all_rows():
    for n, workers in ((40, 6), (3, 8), (100, 7), (1, 2)):
        ranges = sequences.equal_pair_rows(n, workers)
        assert [k for a, b in ranges for k in range(a, b)] == list(range(n)) and len(ranges) <= workers
    loads = [sum(99 - i for i in range(a, b)) for a, b in sequences.equal_pair_rows(100, 7)]
    assert max(loads) < 1.2 * 99 * 100 / 2 / 7
    assert sequences.equal_pair_rows(40, 6)[1:3] == [(4, 8), (8, 13)]
    assert [sequences.equal_pair_rows(n, w) for n, w in ((0, 3), (1, 1), (1, 4), (2, 1))] == [[], [(0, 1)], [(0, 1)], [(0, 2)]]
    assert sequences.equal_pair_rows(10**9, 3)[0][0] == 0


def test_symbols_of_sequences():
    scores = sequences.substitution()
    assert sequences.identity("ac*de", "AC*DE", scores) == 1.0 and sequences.identity("", "AC", scores) == 0.0
    assert all(np.isnan(sequences.identity(bad, "ACDE", scores)) and np.isnan(sequences.identity("ACDE", bad, scores)) for bad in ("ACJE", "ACO", "U", "AC-E", "é"))
    # score, equal pairs: end gaps cost nothing, an inner gap 10 and 1 for each further one
    assert sequences.align("ACDEFGHIKL", "DEFGHI", scores) == (6 + 5 + 6 + 6 + 8 + 4, 6)
    assert sequences.align("WWWWCCWWWW", "WWWWWWWW", scores) == (8 * 11 - 11, 8)


def test_four_decimals_are_those_of_the_exact_value(spark):
    from pairloom.functions.sequences import four_decimals

    values = [k / 64 for k in range(200)] + [0.00005, 0.00015, 0.12345, 1 / 3, 2 / 3, 1.0, 0.0, 0.99995, 0.999949999, 123456.78905, -0.00003, -1.00005, 1e12, 2.5e-5, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", four_decimals(F.col("x")).alias("t")).collect()
    assert all(r.t == f"{r.x:.4f}" for r in rows)


def test_windows_of_very_long_and_odd_steps(spark):
    text = "".join("ACDEFGHIKL"[k * k % 10] for k in range(200_003))
    rows = spark.createDataFrame([("s", text), ("t", "ACD"), ("e", "")], "header string, sequence string")
    for size, step in ((50, 30), (7, 7), (5, 9)):
        got = {r.header: r.sequence for r in sequences.windows(rows, size, step).collect()}
        starts = list(range(0, len(text) - size + 1, step))
        starts += [len(text) - size] * (starts[-1] + size < len(text))
        assert got == {f"s|{a + 1}-{a + size}": text[a : a + size] for a in starts} | {"t|1-3": "ACD".ljust(size, "X"), "e|1-0": "X" * size}


def _write(spark, label: str, text: str) -> str:
    path = scratch(spark, label)
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.text(path)
    return path


def test_fasta_forms(spark):
    path = _write(spark, "fa", "before\n>A one\nAC\nDE\n>B two\nFF\n\n>A\nGG\n>E\n")
    assert {tuple(r) for r in readers.read_fasta(spark, path).collect()} == {("A", "GG"), ("B", "FF"), ("E", "")}
    assert sorted(r.header for r in readers.read_fasta(spark, path, True).collect()) == ["A", "A one", "B two", "E"]
    assert sorted(r.header for r in readers.read_fasta(spark, path, True, "ACDE").collect()) == ["A one", "E"]


def test_identity_file_with_header_and_comments(spark):
    path = _write(spark, "tsv", "seq1\tseq2\tsequence_identity\n#x\ty\t0.5\nA\tNA\t0.5\nB\tC\tnan\n")
    rows = readers.read_identity_pairs(spark, path).collect()
    assert [(r.domain_i, r.domain_j) for r in rows] == [("A", "NA"), ("B", "C")] and math.isnan(rows[1].score)


def test_neighbour_file(spark):
    path = _write(spark, "nb", "1\t2\t3\n\n2\n1\t9\n")
    assert {(r.i, tuple(r.nbrs)) for r in readers.read_neighbours(spark, path).collect()} == {(1, (9,)), (2, ())}


def test_pdb_models_and_blanks(spark):
    atom = "ATOM      1  CA  ALA A   7      11.104   6.134  -6.504"
    path = _write(spark, "pdb", f"HEADER\nMODEL        1\n{atom}\nENDMDL\nMODEL        2\n{atom.replace('ALA A', 'MSE  ').replace('ATOM  ', 'HETATM')}\n")
    rows = readers.read_pdb(spark, path).orderBy("ord").collect()
    assert [(r.model, r.chain, r.res_id, r.res_name, r.atom_name, r.alt_loc, r.hetero, r.x) for r in rows] == [(1, "A", 7, "ALA", "CA", ".", False, 11.104), (2, "0", 7, "MSE", "CA", ".", True, 11.104)]


def test_cif_quotes():
    text = "data_x\nloop_\n_atom_site.id\n_atom_site.label_atom_id\n1 \"O5'\"\n2 'C A'\n#\n"
    assert readers.cif_rows(text, "atom_site") == [{"id": "1", "label_atom_id": "O5'"}, {"id": "2", "label_atom_id": "C A"}]


def test_cif_categories():
    text = """data_one
# _atom_site.id 9
_entry.id ONE
_struct.title
;a title of
_atom_site.id and more
;
_struct.note 'it''s; said'
loop_
_other.id
_other.text
1
;first line
second line
;
2 "a b"
loop_
_atom_site.id
_atom_site.label_atom_id
_atom_site.note
1 CA
;x
loop_
;
2 "_atom_site.id" . 3 CB
_after.id 7
data_two
loop_
_atom_site.id
5
"""
    for t in (text, text.replace("\n", "\r\n")):
        assert readers.cif_rows(t, "atom_site") == [{"id": "1", "label_atom_id": "CA", "note": "x\nloop_"}, {"id": "2", "label_atom_id": "_atom_site.id", "note": "."}]
        assert readers.cif_rows(t, "other") == [{"id": "1", "text": "first line\nsecond line"}, {"id": "2", "text": "a b"}]
        assert readers.cif_rows(t, "struct") == [{"title": "a title of\n_atom_site.id and more", "note": "it''s; said"}]
        assert readers.cif_rows(t, "entry") == [{"id": "ONE"}] and readers.cif_rows(t, "after") == [{"id": "7"}] and readers.cif_rows(t, "none") == []
    assert readers.cif_rows("", "atom_site") == readers.cif_rows("data_x\nloop_\n_atom_site.id\n", "atom_site") == []


def test_empty_sets(spark):
    none = spark.createDataFrame([], "header string, sequence string")
    assert sequences.identities(none).count() == sequences.windows(none, 5, 2).count() == 0
    path = scratch(spark, "none")
    sinks.write_fasta(none, path)
    assert spark.read.text(path).count() == 0
