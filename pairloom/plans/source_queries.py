"""Queries of readers, writers and streams: tables are written in a format, read back, and worked on."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import sequences as S
from pairloom.operators import pairs, sequences, structure
from pairloom.plans import views as v
from pairloom.plans.catalog import query
from pairloom.session import scratch
from pairloom.sources import readers, sinks
from pairloom.streaming import streams


@query("s1_pairs_csv", "SELECT domain_i, domain_j, score FROM pairs WHERE domain_i NOT IN (SELECT id FROM excluded) AND domain_j NOT IN (SELECT id FROM excluded)", "pairs excluded")
def s1(spark, d):
    path = scratch(spark, "pairs")
    sinks.write_pairs(v.pairs(spark, d), path)
    return pairs.exclude(readers.read_pairs(spark, path), v.excluded(spark, d))


@query("s2_dual_pairs_csv", "SELECT domain_i, domain_j, score_max, score FROM dual_pairs", "dual_pairs")
def s2(spark, d):
    path = scratch(spark, "dual")
    sinks.write_pairs(v.dual_pairs(spark, d), path)
    return readers.read_dual_pairs(spark, path)


@query("s3_classes_tsv", "SELECT domain, class FROM classes", "classes")
def s3(spark, d):
    path = scratch(spark, "classes")
    sinks.write_pairs(v.classes(spark, d).select("domain", "class"), path, "\t")
    return readers.read_classes(spark, path)


@query("s4_identity_tsv", "SELECT domain_i, domain_j, score FROM pairs WHERE l_linenumber <> 1", "pairs")
def s4(spark, d):
    path = scratch(spark, "identity")
    i = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("#"), "domain_i")).otherwise(F.col("domain_i"))
    lines = v.pairs(spark, d, ["l_linenumber"]).select(F.concat_ws("\t", i, "domain_j", F.col("score").cast("string")).alias("value"))
    header = spark.range(1).select(F.lit("seq1\tseq2\tsequence_identity").alias("value"))
    sinks.write_lines(header.unionByName(lines), path)
    return readers.read_identity_pairs(spark, path)


@query("k4_identity_with_header", "SELECT domain_i, domain_j, CAST(printf('%.4f', score::DOUBLE) AS FLOAT) AS score FROM pairs", "pairs")
def k4(spark, d):
    path = scratch(spark, "identities")
    rows = v.pairs(spark, d).select(F.col("domain_i").alias("seq1"), F.col("domain_j").alias("seq2"), F.col("score").cast("double").alias("sequence_identity"))
    sinks.write_identities(rows, path, single=True)
    return readers.read_identity_pairs(spark, path)


@query("s6_chunk_counts", f"SELECT chunk, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY {v.ORDER_SQL}) - 1) // 10000 AS chunk FROM lineitem) GROUP BY chunk")
def s6(spark, d):
    rows = pairs.numbered(v.pairs(spark, d, v.LINE), *v.LINE)
    return rows.groupBy(F.floor(F.col("position") / 10000).cast("long").alias("chunk")).agg(F.count("*").alias("n"))


@query("s7_fasta_first_words", "SELECT header, length(sequence) AS n, md5(sequence) AS digest FROM fasta", "fasta")
def s7(spark, d):
    path = scratch(spark, "fasta")
    folded = F.regexp_replace("sequence", "(.{60})(?=.)", "$1\n")
    sinks.write_fasta(v.fasta(spark, d).select(F.concat("header", F.lit(" some words")).alias("header"), folded.alias("sequence")), path)
    rows = readers.read_fasta(spark, path)
    return rows.select("header", F.length("sequence").cast("long").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("digest"))


@query("s8_fasta_whole_headers", f"SELECT header || ' some words' AS header, length(sequence) AS n FROM fasta WHERE regexp_full_match(sequence, '[{S.RESIDUES}]*')", "fasta")
def s8(spark, d):
    path = scratch(spark, "fasta")
    sinks.write_fasta(v.fasta(spark, d).select(F.concat("header", F.lit(" some words")).alias("header"), "sequence"), path)
    rows = readers.read_fasta(spark, path, whole_header=True, alphabet=S.RESIDUES)
    return rows.select("header", F.length("sequence").cast("long").alias("n"))


@query("s9_id_list", "SELECT DISTINCT domain AS id FROM (SELECT domain_j AS domain FROM pairs)", "pairs")
def s9(spark, d):
    path = scratch(spark, "ids")
    sinks.write_lines(v.pairs(spark, d).select(F.concat(F.lit("  "), "domain_j", F.lit(" ")).alias("value")), path)
    return readers.read_ids(spark, path, distinct=True)


@query("s10_list_with_header", "SELECT header AS entry FROM sequences", "sequences")
def s10(spark, d):
    path = scratch(spark, "list")
    sinks.write_pairs(v.sequences(spark, d).select(F.col("header").alias("anything")), path, header=True)
    return readers.read_list_with_header(spark, path)


@query("s11_vector_lookup", "SELECT vec_id::VARCHAR AS domain, embedding[1] AS first FROM embeddings WHERE vec_id % 3 = 0")
def s11(spark, d):
    wanted = v.catalog(spark, d).where("cast(domain as bigint) % 3 = 0").select("domain")
    return v.catalog(spark, d).join(wanted, "domain", "left_semi").select("domain", F.get("embedding", 0).alias("first"))


@query("s12_directory_ids", "SELECT DISTINCT 'E' || label || '.pdb' AS file, 'E' || label AS id FROM embeddings")
def s12(spark, d):
    path = scratch(spark, "files")
    rows = v.table(spark, d, "embeddings").select(F.col("label")).distinct()
    rows.select(F.lit("x").alias("value"), F.concat(F.lit("E"), F.col("label").cast("string"), F.lit(".pdb")).alias("name")).repartition("name").write.partitionBy("name").text(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    names = listed.select(F.regexp_extract("path", "name=([^/]*)/", 1).alias("file")).distinct()
    return names.select("file", F.when(F.col("file").rlike(readers.STRUCTURE_ENDINGS), S.stem(F.col("file"))).otherwise(F.col("file")).alias("id"))


@query("o1_sorted_names", "SELECT DISTINCT 'E' || label || '.pdb' AS file FROM embeddings ORDER BY 1")
def o1(spark, d):
    name = F.concat(F.lit("E"), F.col("label").cast("string"), F.lit(".pdb")).alias("file")
    return v.table(spark, d, "embeddings").select(name).distinct().orderBy("file")


@query("f13_name_filters", "SELECT DISTINCT 'E' || label || '.pt' AS file, 'E' || label || '.csv' AS target FROM embeddings WHERE label % 2 = 0")
def f13(spark, d):
    ending = F.when(F.col("label") % 2 == 0, ".pt").otherwise(".txt")
    files = v.table(spark, d, "embeddings").select(F.concat(F.lit("E"), F.col("label").cast("string"), ending).alias("file")).distinct()
    return files.where(F.col("file").endswith(".pt")).select("file", F.regexp_replace("file", r"\.pt$", ".csv").alias("target"))


@query("f12_paths", "SELECT domain, 'vectors/' || domain || '.pt' AS path FROM (SELECT domain_i AS domain FROM pairs UNION SELECT domain_j FROM pairs)", "pairs")
def f12(spark, d):
    return pairs.unique_ids(v.pairs(spark, d)).select("domain", F.concat(F.lit("vectors/"), "domain", F.lit(".pt")).alias("path"))


@query("f10_not_done", "SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0")
def f10(spark, d):
    path = scratch(spark, "done")
    ids = v.table(spark, d, "embeddings").select("vec_id")
    sinks.write_vectors(ids.where("vec_id % 4 = 0"), path)
    return sinks.not_done(ids, spark.read.parquet(path), "vec_id")


#: A serial has five columns; after 99,999 it begins at 0 again, so that what follows it stays in its own.
SERIALS = 100_000
PDB_LINE = "%-6s%5d %-4s%1s%3s %1s%4d    %8.3f%8.3f%8.3f"


def _pdb(spark, d):
    kind = F.when(F.col("hetero"), "HETATM").otherwise("ATOM")
    rows = v.atoms(spark, d).where("model = 1 and length(res_name) <= 3")
    alt = F.when(F.col("alt_loc") == ".", " ").otherwise(F.col("alt_loc"))
    return rows.select(F.concat(F.lit("U"), "unit").alias("unit"), "ord", F.format_string(PDB_LINE, kind, F.col("ord") % SERIALS, F.col("atom_name"), alt, F.col("res_name"), F.col("chain"), F.col("res_id"), "x", "y", "z").alias("value"))


@query("s13_pdb_atoms", "SELECT res_id, chain, res_name, atom_name, alt_loc, hetero, count(*) AS n, round(sum(round(x, 3)), 3) AS x FROM atoms WHERE model = 1 AND length(res_name) <= 3 GROUP BY ALL", "atoms")
def s13(spark, d):
    path = scratch(spark, "pdb")
    _pdb(spark, d).repartition("unit").sortWithinPartitions("unit", "ord").select("value").write.text(path)
    rows = readers.read_pdb(spark, path)
    return rows.groupBy("res_id", "chain", "res_name", "atom_name", "alt_loc", "hetero").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"))


@query("s13_mmcif_atoms", "SELECT chain, res_name, count(*) AS n FROM atoms WHERE model = 1 GROUP BY ALL", "atoms")
def s13_cif(spark, d):
    path = scratch(spark, "cif")
    names = "group_PDB label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id Cartn_x Cartn_y Cartn_z pdbx_PDB_model_num".split()
    kind = F.when(F.col("hetero"), "HETATM").otherwise("ATOM")
    line = F.concat_ws(" ", kind, "atom_name", "alt_loc", F.concat(F.lit("'"), "res_name", F.lit("'")), "chain", "res_id", "x", "y", "z", "model")
    rows = v.atoms(spark, d).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("r"))
    head = "\n".join(["data_x", "#", "loop_", *[f"_atom_site.{n}" for n in names]])
    text = F.concat(F.lit(head + "\n"), F.array_join(F.transform("r", lambda r: r["line"]), "\n"), F.lit("\n#\n"))
    rows.repartition("unit").select(text.alias("value"), F.concat(F.lit("U"), "unit").alias("u")).write.partitionBy("u").text(path)
    return readers.read_mmcif(spark, f"{path}/*/part-*").where("model = 1").groupBy("chain", "res_name").agg(F.count("*").alias("n"))


@query("s14_chain_coordinates", "SELECT unit, chain, count(*) AS n, round(sum(x), 4) AS x FROM atoms WHERE atom_name = 'CA' AND model = 1 AND NOT hetero GROUP BY ALL", "atoms")
def s14(spark, d):
    rows = v.atoms(spark, d).where("atom_name = 'CA' and model = 1 and not hetero")
    made = structure.chain_records(rows)
    return made.select("unit", "chain", F.size("cas").cast("long").alias("n"), F.round(F.aggregate("cas", F.lit(0.0), lambda s, p: s + p[0]), 4).alias("x"))


NEAR = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
LISTS = f"SELECT a.unit, a.i, string_agg(b.i::VARCHAR, chr(9) ORDER BY b.i) AS nbrs FROM points a JOIN points b ON a.unit = b.unit AND a.i <> b.i AND {NEAR} <= 8 GROUP BY a.unit, a.i"


@query("k5_neighbour_lines", f"WITH l AS ({LISTS}) SELECT p.unit, CASE WHEN nbrs IS NULL THEN p.i::VARCHAR ELSE p.i || chr(9) || nbrs END AS value FROM points p LEFT JOIN l USING (unit, i)", "points")
def k5(spark, d):
    return sinks.neighbour_lines(structure.neighbour_lists(v.points(spark, d), 8.0), keep=["unit"])


@query("s17_neighbour_files", f"WITH l AS ({LISTS}) SELECT p.unit, p.i::INTEGER AS i, coalesce(nbrs, '') AS nbrs FROM points p LEFT JOIN l USING (unit, i)", "points")
def s17(spark, d):
    path = scratch(spark, "neighbours")
    sinks.write_lines(k5(spark, d), path, by="unit")
    rows = readers.read_neighbours(spark, path, by="unit")
    return rows.select("unit", "i", F.array_join(F.transform("nbrs", lambda j: j.cast("string")), "\t").alias("nbrs"))


@query("s18_last_class_wins", "SELECT brand AS domain, max_by(kind, k) AS class FROM (SELECT p_brand AS brand, p_type AS kind, p_partkey AS k FROM part) GROUP BY 1")
def s18(spark, d):
    rows = v.table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.col("p_type").alias("class"), F.col("p_partkey").alias("k"))
    return readers.last_of_each(rows, "domain", "k").select("domain", "class")


@query("s23_tensor_catalog", "SELECT domain, domain || '.pt' AS embedding FROM (SELECT domain_i AS domain FROM pairs UNION SELECT domain_j FROM pairs)", "pairs")
def s23(spark, d):
    return pairs.unique_ids(v.pairs(spark, d)).select("domain", F.concat("domain", F.lit(".pt")).alias("embedding"))


@query("k1_vector_files", "SELECT vec_id AS id, count(*) AS n, round(sum(x), 5) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def k1(spark, d):
    path = scratch(spark, "vectors")
    rows = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sinks.write_vector_files(rows, path)
    read = spark.read.schema("value STRING, id LONG").text(path)
    return read.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 5).alias("total"))


@query("k2_vector_dataset", "SELECT vec_id, embedding[1] AS first FROM embeddings")
def k2(spark, d):
    path = scratch(spark, "vectors")
    sinks.write_vectors(v.table(spark, d, "embeddings").select("vec_id", "embedding"), path)
    return spark.read.parquet(path).select("vec_id", F.get("embedding", 0).alias("first"))


@query("k6_fasta_file", "SELECT header, sequence FROM sequences", "sequences")
def k6(spark, d):
    path = scratch(spark, "fasta")
    sinks.write_fasta(v.sequences(spark, d), path)
    return readers.read_fasta(spark, path)


@query("k7_split_dataset", "SELECT CASE WHEN length(sequence) <= 200 THEN 'le' ELSE 'gt' END AS bucket, header FROM fasta", "fasta")
def k7(spark, d):
    path = scratch(spark, "split")
    sinks.write_split(sequences.length_split(v.fasta(spark, d), 200), path)
    return spark.read.schema("header STRING, sequence STRING, bucket STRING").parquet(path).select("bucket", "header")


@query("k9_coordinates_dataset", "SELECT unit, count(DISTINCT chain) AS chains FROM atoms WHERE atom_name = 'CA' AND model = 1 AND NOT hetero GROUP BY unit", "atoms")
def k9(spark, d):
    path = scratch(spark, "coordinates")
    sinks.write_vectors(structure.chain_records(v.atoms(spark, d).where("atom_name = 'CA' and model = 1 and not hetero")), path)
    return spark.read.parquet(path).groupBy("unit").agg(F.count("*").alias("chains"))


@query("k10_failures_apart", "SELECT 'failed' AS kind, count(*) AS n FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT 'good', count(*) FROM embeddings WHERE vec_id % 5 <> 0")
def k10(spark, d):
    good, bad = scratch(spark, "good"), scratch(spark, "bad")
    rows = v.table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("null_chain "), F.col("vec_id").cast("string"))).alias("error"))
    sinks.write_with_failures(rows, good, bad)
    count = lambda path, kind: spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(bad, "failed").unionByName(count(good, "good"))


@query("t1_resumed_stream", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids FROM embeddings")
def t1(spark, d):
    source, sink, check = (scratch(spark, k) for k in ("source", "sink", "check"))
    rows = v.table(spark, d, "embeddings").select("vec_id", "label")
    rows.where("label < 5").write.parquet(source)
    streams.resume(spark, source, "vec_id LONG, label INT", lambda s: s, sink, check)
    rows.where("label >= 5").write.mode("append").parquet(source)
    streams.resume(spark, source, "vec_id LONG, label INT", lambda s: s, sink, check)
    return spark.read.parquet(sink).agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"))


@query("t3_filtered_lines", "SELECT domain_i || ',' || domain_j || ',x' AS value FROM pairs WHERE domain_i IN (SELECT domain FROM catalog) AND domain_j IN (SELECT domain FROM catalog)", "pairs catalog")
def t3(spark, d):
    source, sink, check = (scratch(spark, k) for k in ("source", "sink", "check"))
    v.pairs(spark, d).select(F.concat_ws(",", "domain_i", "domain_j", F.lit("x")).alias("value")).write.parquet(source)
    have = v.catalog(spark, d)
    streams.resume(spark, source, "value STRING", lambda s: streams.filter_lines(s, have), sink, check)
    return spark.read.schema("value STRING").parquet(sink)


@query("t2_streamed_reservoirs", "WITH t AS (SELECT o_orderkey AS key, least(4, CAST(trunc((o_orderkey % 100) / 100.0::DOUBLE * 5) AS INTEGER)) AS bin FROM orders) SELECT bin, count(*) AS n, max(key) AS last FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY key) AS rn FROM t) WHERE rn <= 20 GROUP BY bin")
def t2(spark, d):
    source, check, sink = scratch(spark, "source"), scratch(spark, "check"), scratch(spark, "sink")
    score = ((F.col("o_orderkey") % 100) / 100.0).cast("float").cast("double")
    rows = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("domain_i"), F.lit("x").alias("domain_j"), F.round(score, 2).cast("float").alias("score"))
    rows.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{sink}/{number}")

    streams.each_batch(streams.reservoirs(stream, 5, 20, "key"), write, check, "update")
    last = spark.read.parquet(f"{sink}/0")
    return last.groupBy("bin").agg(F.count("*").alias("n"), F.max("key").alias("last"))


@query("t4_batch_writer", "SELECT count(*) AS n FROM embeddings")
def t4(spark, d):
    source, check, sink = scratch(spark, "source"), scratch(spark, "check"), scratch(spark, "sink")
    v.table(spark, d, "embeddings").select("vec_id").write.parquet(source)
    streams.each_batch(spark.readStream.schema("vec_id LONG").parquet(source), lambda b, k: b.write.mode("overwrite").parquet(f"{sink}/{k}"), check)
    return spark.read.parquet(f"{sink}/*").agg(F.count("*").alias("n"))


@query("s5_header_stripped", "SELECT domain_i, domain_j, score FROM pairs WHERE l_linenumber = 1", "pairs")
def s5(spark, d):
    path = scratch(spark, "headed")
    rows = v.pairs(spark, d, ["l_linenumber"]).where("l_linenumber = 1").select(F.col("domain_i").alias("seq1"), F.col("domain_j").alias("seq2"), F.col("score").alias("sequence_identity"))
    sinks.write_pairs(rows, path, "\t", header=True, single=True)
    return readers.read_identity_pairs(spark, path)


@query("k3_single_dataset", "SELECT vec_id::VARCHAR AS domain, len(embedding) AS width FROM embeddings")
def k3(spark, d):
    path = scratch(spark, "storage")
    sinks.write_vectors(v.catalog(spark, d).coalesce(1), path)
    return spark.read.parquet(path).select("domain", F.size("embedding").cast("long").alias("width"))


@query("k13_files_of_keys", "SELECT vec_id AS id, CASE WHEN vec_id % 10 = 3 THEN 1 ELSE 64 END AS n FROM embeddings")
def k13(spark, d):
    path = scratch(spark, "keys")
    rows = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sinks.write_vector_files(rows, path)
    sinks.write_vector_files(rows.where("id % 10 = 3").withColumn("embedding", F.array(F.lit(0.5))), path, replace_keys=True)
    return spark.read.schema("value STRING, id LONG").text(path).groupBy("id").agg(F.count("*").cast("int").alias("n"))
