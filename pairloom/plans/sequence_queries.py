"""Queries of sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import sequences as S
from pairloom.operators import pairs, sequences
from pairloom.plans import views as v
from pairloom.plans.catalog import query

N_WINDOWS = "SELECT header, sequence, length(sequence) AS n, unnest(CASE WHEN length(sequence) <= 50 THEN [0] WHEN (length(sequence) - 50) % 30 <> 0 THEN list_append(range(0, length(sequence) - 49, 30), length(sequence) - 50) ELSE range(0, length(sequence) - 49, 30) END) AS s FROM fasta"


@query("w13_sequence_windows", f"SELECT header || '|' || (s + 1) || '-' || least(n, s + 50) AS header, rpad(substr(sequence, s + 1, 50), 50, 'X') AS sequence FROM ({N_WINDOWS})", "fasta")
def w13(spark, d):
    return sequences.windows(v.fasta(spark, d), 50, 30)


TOKEN_SQL = f"CASE WHEN instr('{S.RESIDUES}', c) > 0 THEN instr('{S.RESIDUES}', c) + 3 ELSE 3 END"


@query("m14_tokens", f"SELECT header, string_agg(({TOKEN_SQL})::VARCHAR, ' ' ORDER BY k) AS tokens FROM (SELECT header, unnest(string_split(sequence, '')) AS c, generate_subscripts(string_split(sequence, ''), 1) AS k FROM fasta WHERE sequence <> '') GROUP BY header", "fasta")
def m14(spark, d):
    rows = v.fasta(spark, d).where("sequence <> ''")
    return rows.select("header", F.array_join(F.transform(S.tokens(F.col("sequence")), lambda t: t.cast("string")), " ").alias("tokens"))


@query("j13_token_cache", f"WITH used AS (SELECT DISTINCT 'D' || domain_j AS header FROM pairs) SELECT header, list_sum(list_transform(string_split(sequence, ''), lambda c: {TOKEN_SQL}))::BIGINT AS total FROM fasta WHERE header IN (SELECT header FROM used) AND sequence <> ''", "pairs fasta")
def j13(spark, d):
    used = v.pairs(spark, d).select(F.concat(F.lit("D"), "domain_j").alias("header")).distinct()
    rows = v.fasta(spark, d).where("sequence <> ''").join(used, "header", "left_semi")
    return rows.select("header", F.aggregate(S.tokens(F.col("sequence")), F.lit(0), lambda s, t: s + t).cast("long").alias("total"))


@query("m16_token_pad_mask", "WITH t AS (SELECT header, length(sequence) AS n, max(length(sequence)) OVER () AS m FROM sequences) SELECT header, n, m - n AS padded FROM t", "sequences")
def m16(spark, d):
    rows = v.sequences(spark, d).select("header", S.tokens(F.col("sequence")).alias("t"))
    top = rows.agg(F.max(F.size("t")).alias("m"))
    full = rows.join(F.broadcast(top)).withColumn("t", F.concat("t", F.array_repeat(F.lit(S.PAD), F.col("m") - F.size("t"))))
    shut = F.filter("t", lambda x: x == S.PAD)
    return full.select("header", (F.size("t") - F.size(shut)).cast("long").alias("n"), F.size(shut).cast("long").alias("padded"))


@query("k7_length_split", "SELECT CASE WHEN length(sequence) <= 200 THEN 'le' ELSE 'gt' END AS bucket, count(*) AS n, min(length(sequence)) AS least FROM fasta GROUP BY 1", "fasta")
def k7(spark, d):
    return sequences.length_split(v.fasta(spark, d), 200).groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.length("sequence")).cast("long").alias("least"))


@query("j9_all_pairs", "SELECT a.header AS header_i, b.header AS header_j FROM sequences a JOIN sequences b ON a.header < b.header", "sequences")
def j9(spark, d):
    return pairs.all_against_all(v.sequences(spark, d), "header", ["header"])


@query("j10_cross_pairs", "SELECT a.header AS header_i, b.header AS header_j FROM (SELECT * FROM sequences WHERE header < 'B0010') a, (SELECT * FROM sequences WHERE header >= 'B0010') b", "sequences")
def j10(spark, d):
    rows = v.sequences(spark, d)
    return pairs.set_against_set(rows.where("header < 'B0010'"), rows.where("header >= 'B0010'"), ["header"])


@query("u1_alignment_identity")
def u1(spark, d):
    return sequences.identities(v.sequences(spark, d))


@query("u1_cross_identity")
def u1_cross(spark, d):
    rows = v.sequences(spark, d)
    return sequences.cross_identities(rows.where("item_id % 50 = 0"), rows)


@query("a14_ungapped_identity", "SELECT a.header AS header_i, b.header AS header_j, round(CASE WHEN least(length(a.sequence), length(b.sequence)) = 0 THEN 0 ELSE list_sum(list_transform(range(1, least(length(a.sequence), length(b.sequence)) + 1), lambda k: (substr(a.sequence, k, 1) = substr(b.sequence, k, 1))::INTEGER))::DOUBLE / least(length(a.sequence), length(b.sequence)) END, 6) AS identity FROM sequences a JOIN sequences b ON a.header < b.header", "sequences")
def a14(spark, d):
    rows = pairs.all_against_all(v.sequences(spark, d), "header", ["header", "sequence"])
    return rows.select("header_i", "header_j", F.round(sequences.ungapped_identity(F.col("sequence_i"), F.col("sequence_j")), 6).alias("identity"))


@query("m21_id_parsing", "SELECT 'E' || vec_id || '-' || label || '.A.pdb' AS id, 'E' || vec_id AS entry, label || '.A.pdb' AS rest, 'E' || vec_id || '-' || label || '.A' AS stem, 'E' || vec_id || '-' || label || '.A' AS cut FROM embeddings")
def m21(spark, d):
    made = F.concat(F.lit("E"), F.col("vec_id").cast("string"), F.lit("-"), F.col("label").cast("string"), F.lit(".A.pdb"))
    rows = v.table(spark, d, "embeddings").select(made.alias("id"))
    return rows.select("id", F.substring_index("id", "-", 1).alias("entry"), F.get(F.split("id", "-"), 1).alias("rest"), S.stem(F.col("id")).alias("stem"), F.expr("substr(id, 1, length(id) - 4)").alias("cut"))


@query("m22_headers", "SELECT CASE WHEN vec_id % 4 = 0 THEN 'E' || vec_id ELSE 'E' || vec_id || '.' || label END AS header, concat_ws('|', 'E' || vec_id, label::VARCHAR, CASE WHEN vec_id % 3 = 0 THEN 'c' || label END) AS described FROM embeddings")
def m22(spark, d):
    entry, label = F.concat(F.lit("E"), F.col("vec_id").cast("string")), F.col("label").cast("string")
    chain = F.when(F.col("vec_id") % 4 == 0, " ").otherwise(label)
    klass = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("c"), label))
    return v.table(spark, d, "embeddings").select(S.chain_header(entry, chain).alias("header"), F.concat_ws("|", entry, label, klass).alias("described"))


@query("m19_residue_tokens", "SELECT vec_id, vec_id || ':' || label || ':' || (vec_id % 37) AS token, vec_id::VARCHAR AS plain, label || ':' || (vec_id % 37) AS named FROM embeddings")
def m19(spark, d):
    label, res = F.col("label").cast("string"), (F.col("vec_id") % 37).cast("string")
    return v.table(spark, d, "embeddings").select("vec_id", S.residue_token(F.col("vec_id"), label, res).alias("token"), S.residue_token(F.col("vec_id")).alias("plain"), F.concat_ws(":", label, res).alias("named"))


@query("m23_sequence_lengths", "SELECT header, length(sequence) AS n FROM fasta", "fasta")
def m23(spark, d):
    return v.fasta(spark, d).select("header", F.length("sequence").cast("long").alias("n"))


@query("m25_four_decimals", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'nan' ELSE printf('%.4f', (vec_id % 64) / 64.0::DOUBLE) END AS text FROM embeddings")
def m25(spark, d):
    value = F.when(F.col("vec_id") % 10 == 0, F.lit(None)).otherwise((F.col("vec_id") % 64) / 64.0)
    return v.table(spark, d, "embeddings").select("vec_id", S.four_decimals(value).alias("text"))


@query("m26_without_ends", "SELECT header, substr(sequence, 2, greatest(0, length(sequence) - 2)) AS inner_ FROM fasta WHERE sequence <> ''", "fasta")
def m26(spark, d):
    letters = F.filter(F.split("sequence", ""), lambda c: c != "")
    return v.fasta(spark, d).where("sequence <> ''").select("header", F.array_join(S.without_ends(letters), "").alias("inner_"))


BEFORE = "{0} * (n - 1) - {0} * ({0} - 1) // 2"


@query(
    "w11_equal_pair_rows",
    f"""WITH RECURSIVE n AS (SELECT count(*)::BIGINT AS n FROM benchmark), ends AS (SELECT e, {BEFORE.format("e")} AS b FROM n, unnest(range(1, n + 1)) AS t(e)),
    cuts AS (SELECT -1 AS worker, 0::BIGINT AS first, 0::BIGINT AS last UNION ALL
      SELECT worker + 1, last, coalesce(CASE WHEN worker < 4 THEN (SELECT min(e) FROM ends WHERE e > cuts.last AND b >= {BEFORE.format("cuts.last")} + n * (n - 1) // 2 / 6) END, n) FROM cuts, n WHERE last < n)
    SELECT worker, first::INTEGER AS first, last::INTEGER AS last, {BEFORE.format("last")} - ({BEFORE.format("first")}) AS pairs FROM cuts, n WHERE worker >= 0""",
)
def w11(spark, d):
    n = v.sequences(spark, d).count()
    ranges = sequences.equal_pair_rows(n, 6)
    return spark.createDataFrame([(k, a, b, sum(n - 1 - i for i in range(a, b))) for k, (a, b) in enumerate(ranges)], "worker int, first int, last int, pairs long")
