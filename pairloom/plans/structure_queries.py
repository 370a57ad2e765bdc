"""Queries of structure and geometry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import geometry as G
from pairloom.functions import sequences as S
from pairloom.operators import structure
from pairloom.plans import views as v
from pairloom.plans.catalog import query

R6 = lambda c: F.round(c, 6)
ACIDS = "(" + ", ".join(f"'{n}'" for n in S.LETTERS) + ")"
CARBON = f"atom_name = 'CA' AND model = 1 AND (res_name IN {ACIDS} OR res_name = 'UNK') AND alt_loc IN ('.', 'A', '')"


@query("f4_alpha_carbons", f"SELECT unit, chain, ord, res_id, res_name FROM atoms WHERE {CARBON}", "atoms")
def f4(spark, d):
    return structure.alpha_carbons(v.atoms(spark, d)).select("unit", "chain", "ord", "res_id", "res_name")


@query("f3_long_chains", f"WITH ca AS (SELECT * FROM atoms WHERE {CARBON}) SELECT unit, chain, count(DISTINCT res_id) AS n FROM ca GROUP BY unit, chain HAVING count(DISTINCT res_id) >= 10", "atoms")
def f3(spark, d):
    kept = structure.long_chains(structure.alpha_carbons(v.atoms(spark, d)))
    return kept.groupBy("unit", "chain").agg(F.countDistinct("res_id").alias("n"))


@query("f5_polymer_entities", "SELECT unit, ord FROM atoms WHERE entity IN (0, 2)", "atoms")
def f5(spark, d):
    entities = spark.range(3).select(F.col("id").alias("entity"), F.when(F.col("id") == 1, "non-polymer").otherwise("polymer").alias("type"))
    return structure.of_polymers(v.atoms(spark, d), entities).select("unit", "ord")


@query("f6_amino_atoms", f"SELECT unit, ord FROM atoms WHERE res_name IN {ACIDS} AND NOT hetero AND chain = 'B'", "atoms")
def f6(spark, d):
    return structure.amino_atoms(v.atoms(spark, d), "B").select("unit", "ord")


@query("f7_chain_selection", "WITH t AS (SELECT CASE WHEN vec_id % 3 = 0 THEN 'E' || vec_id ELSE 'E' || vec_id || '.' || label || '.x' END AS acc FROM embeddings) SELECT acc, CASE WHEN contains(acc, '.') THEN split_part(acc, '.', 2) ELSE 'A' END AS chain FROM t")
def f7(spark, d):
    name = F.concat(F.lit("E"), F.col("vec_id").cast("string"))
    acc = F.when(F.col("vec_id") % 3 == 0, name).otherwise(F.concat(name, F.lit("."), F.col("label").cast("string"), F.lit(".x")))
    return v.table(spark, d, "embeddings").select(acc.alias("acc")).withColumn("chain", S.chain_of(F.col("acc")))


@query("f11_single_chain_names", "SELECT unit, ord, 'A' AS chain, false AS hetero, CASE WHEN length(res_name) > 3 THEN 'UNK' ELSE res_name END AS res_name FROM atoms", "atoms")
def f11(spark, d):
    return structure.as_single_chain(v.atoms(spark, d)).select("unit", "ord", "chain", "hetero", "res_name")


@query("o6_first_long_chain", f"WITH ca AS (SELECT * FROM atoms WHERE {CARBON}), s AS (SELECT unit, chain, min(ord) AS f FROM ca GROUP BY unit, chain HAVING count(DISTINCT res_id) >= 10) SELECT unit, min_by(chain, f) AS chain FROM s GROUP BY unit", "atoms")
def o6(spark, d):
    return structure.first_long_chain(structure.alpha_carbons(v.atoms(spark, d)))


LETTER = "CASE res_name " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in S.LETTERS.items()) + " " + " ".join(f"WHEN '{n}' THEN '{S.LETTERS[p]}'" for n, p in S.PARENTS.items()) + " ELSE 'X' END"


@query("a19_chain_records", f"SELECT unit, chain, string_agg({LETTER}, '' ORDER BY ord) AS seq, count(*) AS n, round(sum(x + 2 * y - z), 4) AS mark, min(res_id) AS first FROM atoms WHERE {CARBON} GROUP BY unit, chain", "atoms")
def a19(spark, d):
    rows = structure.chain_records(structure.alpha_carbons(v.atoms(spark, d)))
    mark = F.aggregate("cas", F.lit(0.0), lambda s, p: s + p[0] + 2 * p[1] - p[2])
    return rows.select("unit", "chain", "seq", F.size("cas").cast("long").alias("n"), F.round(mark, 4).alias("mark"), F.array_min("labels").alias("first"))


@query("s22_whole_sequences", f"SELECT unit, string_agg({LETTER}, '' ORDER BY chain, ord) AS seq FROM atoms WHERE {CARBON} GROUP BY unit", "atoms")
def s22(spark, d):
    rows = structure.chain_records(structure.alpha_carbons(v.atoms(spark, d)))
    ordered = F.array_sort(F.collect_list(F.struct("chain", "seq")))
    return rows.groupBy("unit").agg(F.array_join(F.transform(ordered, lambda r: r["seq"]), "").alias("seq"))


@query("j16_residue_letters", f"SELECT res_name, {LETTER} AS letter, count(*) AS n FROM atoms GROUP BY ALL", "atoms")
def j16(spark, d):
    return v.atoms(spark, d).groupBy("res_name", S.residue_letter(F.col("res_name")).alias("letter")).agg(F.count("*").alias("n"))


@query("j14_assembly_chains", "WITH a AS (SELECT u, c FROM (SELECT DISTINCT unit AS u FROM atoms), (VALUES ('A', 1), ('B', 2), ('Z', 3)) t(c, o)), n AS (SELECT unit, chain, count(*) AS n FROM atoms GROUP BY ALL) SELECT unit, chain, n FROM a JOIN n ON unit = u AND chain = c", "atoms")
def j14(spark, d):
    units = v.atoms(spark, d).select("unit").distinct()
    wanted = units.select("unit", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("Z"))).alias("chain"))
    have = v.atoms(spark, d).groupBy("unit", "chain").agg(F.count("*").alias("n"))
    return wanted.join(have, ["unit", "chain"])


SEGMENTS = "WITH f AS (SELECT *, coalesce((res_id < lag(res_id) OVER (PARTITION BY unit ORDER BY i))::INTEGER, 0) AS new FROM points), s AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY i) AS segment FROM f) "
BY_PLACE = {"unit": "unit", "order": "i", "res": "res_id"}


@query("w2_segments", SEGMENTS + "SELECT unit, CAST(segment AS INTEGER) AS segment, count(DISTINCT res_id) AS n FROM s GROUP BY ALL", "points")
def w2(spark, d):
    return structure.segment_sizes(v.points(spark, d), **BY_PLACE)


@query("w2_disjoint_units", SEGMENTS + ", z AS (SELECT unit, segment, count(DISTINCT res_id) AS n FROM s GROUP BY ALL) SELECT unit, string_agg(n::VARCHAR, ',' ORDER BY segment) AS sizes FROM z GROUP BY unit HAVING count(*) > 1", "points")
def w2_disjoint(spark, d):
    rows = structure.disjoint_units(v.points(spark, d), **BY_PLACE)
    return rows.select("unit", F.array_join(F.transform("sizes", lambda n: n.cast("string")), ",").alias("sizes"))


@query("w3_single_segment", SEGMENTS + "SELECT unit, i FROM s WHERE unit IN (SELECT unit FROM s GROUP BY unit HAVING max(segment) = 0)", "points")
def w3(spark, d):
    return structure.single_segment(v.points(spark, d), **BY_PLACE).select("unit", "i")


@query("a17_segment_chain_sizes", "WITH f AS (SELECT *, coalesce((chain <> lag(chain) OVER w OR res_id < lag(res_id) OVER w)::INTEGER, 0) AS new FROM atoms WINDOW w AS (PARTITION BY unit ORDER BY ord)), s AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY ord) AS segment FROM f) SELECT unit, CAST(segment AS INTEGER) AS segment, count(DISTINCT res_id) AS n FROM s GROUP BY ALL", "atoms")
def a17(spark, d):
    return structure.segment_sizes(v.atoms(spark, d), chain="chain")


@query(
    "w4_chain_runs",
    """WITH f AS (SELECT unit, chain, ord, coalesce((chain <> lag(chain) OVER (PARTITION BY unit ORDER BY ord))::INTEGER, 0) AS new FROM atoms), r AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY ord) AS run FROM f),
    g AS (SELECT unit, run, any_value(chain) AS chain, count(*) AS n, run = max(run) OVER (PARTITION BY unit) AS last FROM r GROUP BY unit, run), ok AS (SELECT * FROM g WHERE n >= 10)
    SELECT unit, chain, coalesce(max_by(n, run) FILTER (WHERE NOT last), max(n) FILTER (WHERE last)) AS n FROM ok GROUP BY unit, chain""",
    "atoms",
)
def w4(spark, d):
    return structure.chain_runs(v.atoms(spark, d))


CHAINS = "WITH c AS (SELECT unit, chain, ascii(chain) AS chain_order, count(*) AS n FROM atoms GROUP BY ALL) "


def _chains(spark, d):
    return v.atoms(spark, d).groupBy("unit", "chain", F.ascii("chain").alias("chain_order")).agg(F.count("*").alias("n"))


@query("w6_assembly_offsets", CHAINS + "SELECT unit, chain, n, CAST(coalesce(sum(n + 2) OVER (PARTITION BY unit ORDER BY chain_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS offset_ FROM c", "atoms")
def w6(spark, d):
    return structure.assembly_offsets(_chains(spark, d)).select("unit", "chain", "n", F.col("offset").alias("offset_"))


@query("w7_index_map", CHAINS + ", o AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY unit ORDER BY chain_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM c) SELECT unit, chain_order, CAST(j AS INTEGER) AS j, CAST(o + j + 1 AS INTEGER) AS index FROM o, range(100000) t(j) WHERE j < n", "atoms")
def w7(spark, d):
    return structure.index_map(_chains(spark, d))


NEAR = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


@query("j11_neighbours", f"WITH n AS (SELECT a.unit, a.i, b.i AS j FROM points a JOIN points b ON a.unit = b.unit AND a.i <> b.i AND {NEAR} <= 8) SELECT p.unit, p.i, coalesce(string_agg(j::VARCHAR, ',' ORDER BY j), '') AS nbrs FROM points p LEFT JOIN n ON n.unit = p.unit AND n.i = p.i GROUP BY p.unit, p.i", "points")
def j11(spark, d):
    rows = structure.neighbour_lists(v.points(spark, d), 8.0)
    return rows.select("unit", F.col("i").cast("long").alias("i"), F.array_join(F.transform("nbrs", lambda j: j.cast("string")), ",").alias("nbrs"))


@query("j12_contacts", f"SELECT a.unit, a.i, b.i AS j, round({NEAR}, 6) AS d, round(exp(0 - (({NEAR}) - 3.6) ** 2 / 12), 6) AS e FROM points a JOIN points b ON a.unit = b.unit AND a.i <> b.i AND {NEAR} < 8", "points")
def j12(spark, d):
    rows = structure.within(v.points(spark, d), 8.0, True)
    return rows.select("unit", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), R6(F.col("d")).alias("d"), R6(G.exp_distance(F.col("d"))).alias("e"))


def _angle(a: str, b: str) -> str:
    dot = " + ".join(f"({a}.{c}) * ({b}.{c})" for c in "xyz")
    size = lambda k: "sqrt(" + " + ".join(f"({k}.{c}) ** 2" for c in "xyz") + ")"
    return f"acos(greatest(-1.0, least(1.0, ({dot}) / ({size(a)} * {size(b)}))))"


def _minus(a: str, b: str) -> str:
    return "{" + ", ".join(f"'{c}': {a}.{c} - {b}.{c}" for c in "xyz") + "}"


def _cross(a: str, b: str) -> str:
    turn = {"x": "yz", "y": "zx", "z": "xy"}
    return "{" + ", ".join(f"'{c}': {a}.{p} * {b}.{q} - {a}.{q} * {b}.{p}" for c, (p, q) in turn.items()) + "}"


FLANKS = f"""WITH o AS (SELECT unit, i, res_id, {{'x': x, 'y': y, 'z': z}} AS p FROM steady),
  f AS (SELECT *, CASE WHEN res_id - lag(res_id) OVER w = 1 THEN lag(p) OVER w END AS back, CASE WHEN lead(res_id) OVER w - res_id = 1 THEN lead(p) OVER w END AS fore FROM o WINDOW w AS (PARTITION BY unit ORDER BY i)),
  k AS (SELECT *, {_minus("back", "p")} AS tb, {_minus("fore", "p")} AS tf, {_minus("p", "back")} AS fb FROM f), n AS (SELECT *, {_minus("p", "back")} AS n1, {_minus("fore", "back")} AS n2 FROM k), g AS (SELECT *, {_cross("n1", "n2")} AS nv FROM n) """


@query(
    "m7_graph_nodes",
    FLANKS
    + f"""SELECT unit, i, round(CASE WHEN back IS NULL OR fore IS NULL THEN 0 ELSE sin({_angle("tb", "tf")}) END, 6) AS sin_a, round(CASE WHEN back IS NULL OR fore IS NULL THEN 0 ELSE cos({_angle("tb", "tf")}) END, 6) AS cos_a,
    round(CASE WHEN fore IS NULL THEN 0 ELSE exp(0 - (sqrt(tf.x ** 2 + tf.y ** 2 + tf.z ** 2) - 3.6) ** 2 / 12) END, 6) AS df, round(CASE WHEN back IS NULL THEN 0 ELSE exp(0 - (sqrt(tb.x ** 2 + tb.y ** 2 + tb.z ** 2) - 3.6) ** 2 / 12) END, 6) AS db FROM g""",
    "steady",
)
def m7(spark, d):
    rows = structure.graph_nodes(v.steady_points(spark, d))
    return rows.select("unit", F.col("i").cast("long").alias("i"), *[(R6(F.col(c)) + 0.0).alias(c) for c in ("sin_a", "cos_a", "df", "db")])


def _pair(f: str, a: str, b: str, there: str) -> str:
    return f"round(CASE WHEN {there} THEN {f}({_angle(a, b)}) ELSE 0 END, 5)"


_BOTH = "a.back IS NOT NULL AND b.back IS NOT NULL AND a.fore IS NOT NULL AND b.fore IS NOT NULL"


@query(
    "m8_graph_edges",
    FLANKS
    + f"""SELECT a.unit, a.i, b.i AS j, round(exp(0 - (sqrt((a.p.x - b.p.x) ** 2 + (a.p.y - b.p.y) ** 2 + (a.p.z - b.p.z) ** 2) - 3.6) ** 2 / 12), 5) AS e, (abs(a.res_id - b.res_id) = 1)::INTEGER AS contiguous,
    {_pair("sin", "a.nv", "b.nv", _BOTH)} AS es, {_pair("cos", "a.nv", "b.nv", _BOTH)} AS ec,
    {_pair("sin", "a.tf", "b.tf", "a.fore IS NOT NULL AND b.fore IS NOT NULL")} AS fs, {_pair("cos", "a.tf", "b.tf", "a.fore IS NOT NULL AND b.fore IS NOT NULL")} AS fc,
    {_pair("sin", "a.fb", "b.fb", "a.back IS NOT NULL AND b.back IS NOT NULL")} AS bs, {_pair("cos", "a.fb", "b.fb", "a.back IS NOT NULL AND b.back IS NOT NULL")} AS bc
    FROM g a JOIN g b ON a.unit = b.unit AND a.i <> b.i AND sqrt((a.p.x - b.p.x) ** 2 + (a.p.y - b.p.y) ** 2 + (a.p.z - b.p.z) ** 2) < 8""",
    "steady",
)
def m8(spark, d):
    rows = structure.graph_edges(v.steady_points(spark, d))
    numbers = [(F.round(F.col(c), 5) + 0.0).alias(c) for c in ("e", "es", "ec", "fs", "fc", "bs", "bc")]
    return rows.select("unit", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "contiguous", *numbers)


@query(
    "m1_geometry",
    f"""WITH t AS (SELECT vec_id, {{'x': embedding[1]::DOUBLE, 'y': embedding[2]::DOUBLE, 'z': embedding[3]::DOUBLE}} AS p, {{'x': embedding[4]::DOUBLE, 'y': embedding[5]::DOUBLE, 'z': embedding[6]::DOUBLE}} AS q FROM embeddings), c AS (SELECT *, {_cross("p", "q")} AS r FROM t)
    SELECT vec_id, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) AS distance, round({_angle("p", "q")}, 6) AS angle, round({_angle("r", "p")}, 5) AS right_angle FROM c""",
)
def m1(spark, d):
    at = lambda k: G.point(*[F.get("embedding", k + n) for n in range(3)])
    rows = v.table(spark, d, "embeddings").select("vec_id", at(0).alias("p"), at(3).alias("q"))
    p, q = F.col("p"), F.col("q")
    return rows.select("vec_id", R6(G.distance(p, q)).alias("distance"), R6(G.angle(p, q)).alias("angle"), F.round(G.angle(G.cross(p, q), p), 5).alias("right_angle"))


AT = "{{'x': embedding[{0}]::DOUBLE, 'y': embedding[{1}]::DOUBLE, 'z': embedding[{2}]::DOUBLE}}"
FOUR = "WITH t AS (SELECT vec_id, " + ", ".join(f"{AT.format(3 * k + 1, 3 * k + 2, 3 * k + 3)} AS p{k}" for k in range(6)) + " FROM embeddings), d AS (SELECT *, " + ", ".join(f"{_minus(f'p{a}', f'p{b}')} AS d{a}{b}" for a, b in ((0, 1), (2, 1), (1, 0), (3, 2), (2, 0), (4, 3), (5, 3))) + f" FROM t), n AS (SELECT *, {_cross('d10', 'd20')} AS n1, {_cross('d43', 'd53')} AS n2 FROM d) "


def _points(spark, d):
    at = lambda k: G.point(*[F.get("embedding", 3 * k + n) for n in range(3)]).alias(f"p{k}")
    return v.table(spark, d, "embeddings").select("vec_id", *[at(k) for k in range(6)])


@query("m2_exp_distance", FOUR + "SELECT vec_id, round(exp(0 - (sqrt(d01.x ** 2 + d01.y ** 2 + d01.z ** 2) - 3.6) ** 2 / 12), 6) AS e FROM n")
def m2(spark, d):
    return _points(spark, d).select("vec_id", R6(G.exp_distance(G.distance(F.col("p0"), F.col("p1")))).alias("e"))


@query("m3_vector_angle", FOUR + f"SELECT vec_id, round({_angle('p0', 'p1')}, 6) AS a FROM n")
def m3(spark, d):
    return _points(spark, d).select("vec_id", R6(G.angle(F.col("p0"), F.col("p1"))).alias("a"))


@query("m4_angle_at_point", FOUR + f"SELECT vec_id, round({_angle('d01', 'd21')}, 6) AS a FROM n")
def m4(spark, d):
    return _points(spark, d).select("vec_id", R6(G.angle_at(F.col("p0"), F.col("p1"), F.col("p2"))).alias("a"))


@query("m5_angle_of_segments", FOUR + f"SELECT vec_id, round({_angle('d10', 'd32')}, 6) AS a FROM n")
def m5(spark, d):
    return _points(spark, d).select("vec_id", R6(G.angle_of_segments(F.col("p0"), F.col("p1"), F.col("p2"), F.col("p3"))).alias("a"))


@query("m6_angle_of_planes", FOUR + f"SELECT vec_id, round({_angle('n1', 'n2')}, 6) AS a FROM n")
def m6(spark, d):
    rows = _points(spark, d)
    rows = rows.select("vec_id", G.normal(*[F.col(f"p{k}") for k in range(3)]).alias("n1"), G.normal(*[F.col(f"p{k}") for k in range(3, 6)]).alias("n2"))
    return rows.select("vec_id", R6(G.angle(F.col("n1"), F.col("n2"))).alias("a"))


@query("w1_contiguity", "SELECT unit, i, coalesce(res_id - lag(res_id) OVER w = 1, false) AS back, coalesce(lead(res_id) OVER w - res_id = 1, false) AS fore FROM steady WINDOW w AS (PARTITION BY unit ORDER BY i)", "steady")
def w1(spark, d):
    rows = structure.with_flanks(v.steady_points(spark, d))
    return rows.select("unit", F.col("i").cast("long").alias("i"), F.col("back").isNotNull().alias("back"), F.col("fore").isNotNull().alias("fore"))


@query("m20_residue_labels", "SELECT unit, ord, chain || ':' || res_id AS label FROM atoms", "atoms")
def m20(spark, d):
    return v.atoms(spark, d).select("unit", "ord", F.concat("chain", F.lit(":"), F.col("res_id").cast("string")).alias("label"))


@query("m27_letters_of_names", f"SELECT DISTINCT res_name, {LETTER} AS letter FROM (SELECT unnest([{', '.join(repr(n) for n in [*S.LETTERS, *S.PARENTS, 'HOH', ''])}]) AS res_name)")
def m27(spark, d):
    names = F.explode(F.array(*[F.lit(n) for n in [*S.LETTERS, *S.PARENTS, "HOH", ""]])).alias("res_name")
    return spark.range(1).select(names).select("res_name", S.residue_letter(F.col("res_name")).alias("letter"))


@query("u14_chains_of_files", f"SELECT unit, chain, string_agg({LETTER}, '' ORDER BY ord) AS seq FROM atoms WHERE {CARBON} GROUP BY unit, chain HAVING count(DISTINCT res_id) >= 10", "atoms")
def u14(spark, d):
    rows = structure.long_chains(structure.alpha_carbons(v.atoms(spark, d)))
    return structure.chain_records(rows).select("unit", "chain", "seq")
