"""Queries of vector, model, augmentation and store operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import augment, kvstore, models, vectors
from pairloom.plans import views as v
from pairloom.plans.catalog import query

R6 = lambda c: F.round(c, 6)
POOL = "SELECT domain, k, round({f}, 6) AS value FROM (SELECT domain, pos, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) - 1 AS k FROM residues) GROUP BY domain, k"


def _long(pooled):
    return pooled.select("domain", F.posexplode("embedding").alias("k", "value")).withColumn("value", R6(F.col("value")))


@query("a7_mean_pool", POOL.format(f="avg(x)"), "residues")
def a7(spark, d):
    return _long(vectors.pooled(v.residues(spark, d)))


@query("a8_sum_pool", POOL.format(f="sum(x)"), "residues")
def a8(spark, d):
    return _long(vectors.pooled(v.residues(spark, d), "sum"))


@query("a9_masked_mean_pool", POOL.format(f="coalesce(sum(x) FILTER (WHERE pos % 3 <> 0), 0) / greatest(count(*) FILTER (WHERE pos % 3 <> 0), 1)"), "residues")
def a9(spark, d):
    return _long(vectors.pooled(v.residues(spark, d), "mean", F.col("pos") % 3 != 0))


@query("a9_masked_sum_pool", POOL.format(f="coalesce(sum(x) FILTER (WHERE pos % 3 <> 0), 0)"), "residues")
def a9_sum(spark, d):
    return _long(vectors.pooled(v.residues(spark, d), "sum", F.col("pos") % 3 != 0))


@query("a18_batch_longest", "SELECT batch, max(len(embedding)) AS longest FROM (SELECT embedding, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings) GROUP BY batch")
def a18(spark, d):
    rows = vectors.batches(v.table(spark, d, "embeddings").select("vec_id", "embedding"), 32, "vec_id")
    return rows.groupBy("batch").agg(F.max(F.size("embedding")).cast("long").alias("longest"))


@query("w14_batches", "SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings")
def w14(spark, d):
    return vectors.batches(v.table(spark, d, "embeddings").select("vec_id"), 32, "vec_id")


RAGGED = "SELECT vec_id, vec_id // 16 AS batch, embedding[1:vec_id % 16 + 1]::DOUBLE[] AS vec FROM embeddings"


def _ragged(spark, d):
    cut = F.slice("embedding", F.lit(1), (F.col("vec_id") % 16 + 1).cast("int")).cast("array<double>")
    return v.table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).cast("long").alias("batch"), cut.alias("vec"))


@query(
    "m15_padded_batches",
    f"""WITH r AS ({RAGGED}), p AS (SELECT *, max(len(vec)) OVER (PARTITION BY batch) AS m FROM r)
    SELECT vec_id, batch, array_to_string(list_transform(range(1, m + 1), lambda i: CASE WHEN i <= len(vec) THEN '0' ELSE '1' END), '') AS mask, m AS size, round(list_sum(vec), 6) AS total FROM p""",
)
def m15(spark, d):
    rows = vectors.padded_batches(_ragged(spark, d), "vec", F.lit(0.0))
    mask = F.array_join(F.transform("mask", lambda b: b.cast("int").cast("string")), "")
    return rows.select("vec_id", "batch", mask.alias("mask"), F.size("vec").cast("long").alias("size"), R6(V.total(F.col("vec"))).alias("total"))


@query("m9_cosine_pairs", "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m9(spark, d):
    rows = v.table(spark, d, "embeddings")
    a, b = (rows.select(F.col("vec_id").alias(k), (F.col("vec_id") + s).alias(f"at_{k}"), F.col("embedding").alias(f"e_{k}")) for k, s in (("i", 1), ("j", 0)))
    return a.join(b, F.col("at_i") == F.col("at_j")).select("i", "j", R6(V.cosine(F.col("e_i"), F.col("e_j"))).alias("cosine"))


@query("m10_l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS total FROM embeddings")
def m10(spark, d):
    unit = V.normalise(F.col("embedding"))
    return v.table(spark, d, "embeddings").select("vec_id", R6(V.total(F.transform(unit, lambda x: F.abs(x)))).alias("total"))


@query(
    "m11_layer_norm_relu",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY vec_id)
    SELECT vec_id, round(sum(greatest((x - m) / sqrt(v + 1e-5), 0)), 5) AS total FROM e JOIN s USING (vec_id) GROUP BY vec_id""",
)
def m11(spark, d):
    return v.table(spark, d, "embeddings").select("vec_id", F.round(V.total(V.relu(V.layer_norm(F.col("embedding")))), 5).alias("total"))


@query("m12_position_codes", "SELECT p AS pos, k, round(CASE WHEN k % 2 = 0 THEN sin(p * exp(k * -ln(10000) / 16)) ELSE cos(p * exp((k - 1) * -ln(10000) / 16)) END, 6) AS value FROM range(50) a(p), range(16) b(k)")
def m12(spark, d):
    codes = spark.range(50).select(F.col("id").alias("pos"), F.posexplode(V.position_code(F.col("id"), 16)).alias("k", "value"))
    return codes.select("pos", F.col("k").cast("long").alias("k"), R6(F.col("value")).alias("value"))


@query(
    "w5_capped_assembly",
    "WITH t AS (SELECT domain, pos, vec_id % 50 + 1 AS n FROM residues) SELECT domain, pos, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) WHERE before <= 200",
    "residues",
)
def w5(spark, d):
    rows = v.residues(spark, d).select("domain", F.col("pos").cast("long").alias("pos"), (F.col("vec_id") % 50 + 1).alias("n"))
    return vectors.within_limit(rows, 200, "n", "domain", "pos")


@query("v4_concatenated_parts", "SELECT domain, count(*) AS parts, sum(len(vec)) AS size, round(sum(list_sum(vec::DOUBLE[]) * pos), 4) AS mark FROM residues GROUP BY domain", "residues")
def v4(spark, d):
    parts = v.residues(spark, d).select("domain", "pos", F.array("vec").alias("vecs"))
    whole = vectors.concatenated(parts, "domain", "pos", "vecs")
    mark = F.aggregate(F.transform("vecs", lambda x, i: V.total(V.doubles(x)) * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return whole.select("domain", F.size("vecs").cast("long").alias("parts"), F.size(F.flatten("vecs")).cast("long").alias("size"), F.round(mark, 4).alias("mark"))


@query("x1_top_cosine", "SELECT query, rank, id, round(cosine, 6) AS cosine FROM (SELECT q.vec_id AS query, x.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) DESC, x.vec_id) AS rank FROM embeddings q, embeddings x WHERE q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id) WHERE rank <= 10")
def x1(spark, d):
    rows = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_cosine(rows.where("id % 50 = 0"), rows, 10).withColumn("cosine", R6(F.col("cosine")))


LISTS = "SELECT domain, CAST(pos AS INTEGER) AS i, list_filter([CAST(pos - 2 AS INTEGER), CAST(pos + 1 AS INTEGER), CAST(pos + 5 AS INTEGER)], lambda x: x > 0) AS nbrs FROM residues"


def _lists(spark, d):
    i = F.col("pos").cast("int")
    return v.residues(spark, d).select("domain", i.alias("i"), F.filter(F.array(i - 2, i + 1, i + 5), lambda x: x > 0).alias("nbrs"))


@query(
    "m17_neighbour_mask",
    f"""WITH lists AS ({LISTS}), size AS (SELECT domain, max(greatest(i, coalesce(list_max(nbrs), 0))) + 2 AS n FROM lists GROUP BY domain), cells AS (SELECT domain, n, r.r, c.c FROM size, unnest(range(n)) AS r(r), unnest(range(n)) AS c(c))
    SELECT cells.domain, CAST(r AS INTEGER) AS row, string_agg(CASE WHEN i IS NULL OR c = i OR list_contains(nbrs, c::INTEGER) THEN '0' ELSE '1' END, '' ORDER BY c) AS mask FROM cells LEFT JOIN lists ON lists.domain = cells.domain AND i = r GROUP BY ALL""",
    "residues",
)
def m17(spark, d):
    return vectors.neighbour_mask_rows(_lists(spark, d), vectors.default_length()).select("domain", "row", "mask")


@query("m18_mask_for_heads", "SELECT domain, h AS head, CAST(pos AS INTEGER) AS i FROM residues, range(4) t(h)", "residues")
def m18(spark, d):
    return _lists(spark, d).select("domain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("head"), "i")


@query("j15_mask_join", "SELECT r.domain, count(*) AS residues, any_value(n) AS listed FROM residues r JOIN (SELECT domain, count(*) AS n FROM residues GROUP BY domain) USING (domain) GROUP BY r.domain", "residues")
def j15(spark, d):
    lengths = v.residues(spark, d).groupBy("domain").agg(F.count("*").alias("residues"))
    return lengths.join(_lists(spark, d).groupBy("domain").agg(F.count("*").alias("listed")), "domain")


@query("m24_json_vectors", "SELECT vec_id, from_json(to_json(list_transform(embedding[1:4], lambda x: round(x::DOUBLE * 1000)::INTEGER)), '[\"INTEGER\"]') = list_transform(embedding[1:4], lambda x: round(x::DOUBLE * 1000)::INTEGER) AS same FROM embeddings")
def m24(spark, d):
    numbers = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double") * 1000))
    return v.table(spark, d, "embeddings").select("vec_id", (kvstore.decode(kvstore.encode(numbers)) == numbers).alias("same"))


FOLDED = """WITH cleared AS (SELECT id, max(seq) AS c FROM kv_log WHERE op = 'delete' GROUP BY id), live AS (SELECT l.* FROM kv_log l LEFT JOIN cleared USING (id) WHERE op <> 'delete' AND (c IS NULL OR seq > c)),
    firsts AS (SELECT id, min(seq) AS f FROM live WHERE op = 'set' GROUP BY id) SELECT id, max_by(numbers, seq) AS numbers FROM live JOIN firsts USING (id) WHERE seq >= f GROUP BY id"""


@query("k12_store_fold", FOLDED, "kv_log")
def k12(spark, d):
    return kvstore.fold(v.kv_log(spark, d))


@query("k12_store_put_delete", "WITH s AS (SELECT id, max_by(numbers, seq) AS numbers FROM kv_log GROUP BY id) SELECT id, CASE WHEN id::BIGINT % 4 = 0 THEN '[0.0]' ELSE numbers END AS numbers FROM s WHERE id::BIGINT % 3 <> 0 UNION ALL SELECT 'x' || r, '[0.0]' FROM range(5) t(r)", "kv_log")
def k12_put(spark, d):
    store = kvstore.last_writes(v.kv_log(spark, d).drop("op")).select("id", "numbers")
    new = store.where("cast(id as bigint) % 4 = 0").select("id").unionByName(spark.range(5).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id")))
    put = kvstore.put(store, new.select("id", F.lit("[0.0]").alias("numbers")))
    return kvstore.delete(put, store.where("cast(id as bigint) % 3 = 0"))


@query("k12_store_update", "WITH s AS (SELECT id, max_by(numbers, seq) AS numbers FROM kv_log WHERE seq % 2 = 0 GROUP BY id), n AS (SELECT id, max_by(numbers, seq) AS numbers FROM kv_log WHERE seq % 2 = 1 GROUP BY id) SELECT s.id, coalesce(n.numbers, s.numbers) AS numbers, n.id IS NOT NULL AS changed FROM s LEFT JOIN n USING (id)", "kv_log")
def k12_update(spark, d):
    log = v.kv_log(spark, d).drop("op")
    store, new = (kvstore.last_writes(log.where(f"seq % 2 = {k}")).select("id", "numbers") for k in (0, 1))
    after, _ = kvstore.update(store, new)
    changed = new.select("id", F.lit(True).alias("changed"))
    return after.join(changed, "id", "left").select("id", "numbers", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("s19_store_get", "WITH s AS (SELECT id, max_by(numbers, seq) AS numbers FROM kv_log GROUP BY id), q AS (SELECT CAST(k AS VARCHAR) AS id FROM range(40) t(k)) SELECT q.id, from_json(numbers, '[\"DOUBLE\"]')[1] AS first FROM q LEFT JOIN s USING (id)", "kv_log")
def s19(spark, d):
    store = kvstore.last_writes(v.kv_log(spark, d).drop("op")).select("id", "numbers")
    asked = spark.range(40).select(F.col("id").cast("string").alias("id"))
    return kvstore.get(store, asked).select("id", F.get("vector", 0).alias("first"))


@query("u8_permuted_regions", "WITH t AS (SELECT vec_id, embedding[1:vec_id % 16 + 1] AS a, len(embedding[1:vec_id % 16 + 1]) AS n FROM embeddings) SELECT vec_id, round(list_sum(list_transform(list_concat(list_concat(a[2 * n // 3 + 1:n], a[1:n // 3]), a[n // 3 + 1:2 * n // 3]), lambda x, i: x::DOUBLE * i)), 6) AS mark FROM t")
def u8(spark, d):
    a = F.slice("embedding", F.lit(1), (F.col("vec_id") % 16 + 1).cast("int"))
    out = augment.regions_permuted(a, F.array(F.lit(2), F.lit(0), F.lit(1)))
    return v.table(spark, d, "embeddings").select("vec_id", R6(V.total(F.transform(out, lambda x, i: x.cast("double") * (i + 1)))).alias("mark"))


@query("u9_removed_places", "SELECT vec_id, round(list_sum(list_transform(list_filter(embedding, lambda x, i: NOT list_contains([1, 4, 64], i)), lambda x, i: x::DOUBLE * i)), 6) AS mark FROM embeddings")
def u9(spark, d):
    out = augment.without_places(F.col("embedding"), F.array(F.lit(0), F.lit(3), F.lit(63)))
    return v.table(spark, d, "embeddings").select("vec_id", R6(V.total(F.transform(out, lambda x, i: x.cast("double") * (i + 1)))).alias("mark"))


@query("u7_augmented")
def u7(spark, d):
    rows = v.table(spark, d, "embeddings").select("vec_id", F.sequence(F.lit(0), F.lit(29)).alias("seq"), F.slice("embedding", 1, 30).alias("vec"))
    steps = [lambda r: augment.remove_fraction(r, ["seq", "vec"], "vec_id", seed=3), lambda r: augment.permute_regions(r, ["seq", "vec"], "vec_id", 0.5, seed=4)]
    return augment.composed(rows, steps).select("vec_id", "seq")


@query("u3_transformer_pool")
def u3(spark, d):
    width = 64
    network = models.TransformerAggregator(width, seed=1)
    return models.predict(vectors.gathered(v.residues(spark, d)), network, "domain", "vecs")


@query("u3_masked_transformer_pool")
def u3_masked(spark, d):
    rows = vectors.gathered(v.residues(spark, d))
    i = (F.col("pos") - 1).cast("int")
    lists = v.residues(spark, d).select("domain", i.alias("i"), F.filter(F.array(i - 2, i + 1, i + 5), lambda x: x >= 0).alias("nbrs"))
    masks = vectors.neighbour_mask(lists, F.size("rows")).select("domain", "mask")
    return models.predict(rows.join(masks, "domain"), models.TransformerAggregator(64, blocks=1, seed=2), "domain", "vecs", "mask")


@query("u4_linear_pool")
def u4(spark, d):
    return models.predict(vectors.gathered(v.residues(spark, d)), models.LinearAggregator(64, 32, seed=3), "domain", "vecs")


@query("u5_sequence_autoencoder")
def u5(spark, d):
    from pairloom.functions.sequences import tokens

    net = models.SequenceAutoencoder(seed=5)
    rows = v.sequences(spark, d).select("header", tokens(F.col("sequence")).alias("tokens"))
    # the latent vector, and the symbol that decoding it finds likeliest at each place of the sequence
    both = lambda t: np.concatenate([z := net.encode(t), net.decode(z, len(t)).argmax(axis=1)])
    return models.predict(rows, both, "header", "tokens")


@query("u16_failing_rows")
def u16(spark, d):
    rows = vectors.gathered(v.residues(spark, d)).withColumn("vecs", F.when(F.col("domain") == "3", F.lit(None)).when(F.col("domain") == "5", F.slice("vecs", 1, 0)).otherwise(F.col("vecs")))
    return models.predict(rows, models.TransformerAggregator(64, seed=1), "domain", "vecs").select("domain", F.size("embedding").alias("width"), F.col("error").isNotNull().alias("failed"))


@query("u12_collated_pairs", f"WITH r AS ({RAGGED}) SELECT a.batch, count(*) AS n, max(greatest(len(a.vec), len(b.vec))) AS size FROM r a JOIN r b ON b.vec_id = a.vec_id + 1 GROUP BY a.batch")
def u12(spark, d):
    rows = _ragged(spark, d)
    a, b = (rows.select((F.col("vec_id") + s).alias("k"), F.col("batch").alias(f"batch_{n}"), F.col("vec").alias(f"vec_{n}")) for n, s in (("i", 1), ("j", 0)))
    both = a.join(b, "k").select("k", F.col("batch_i").alias("batch"), "vec_i", "vec_j")
    for side in ("vec_i", "vec_j"):
        both = vectors.padded_batches(both, side, F.lit(0.0)).drop("mask")
    return both.groupBy("batch").agg(F.count("*").alias("n"), F.max(F.greatest(F.size("vec_i"), F.size("vec_j"))).cast("long").alias("size"))


@query("u13_store_provider", "WITH s AS (SELECT id, max_by(numbers, seq) AS numbers FROM kv_log GROUP BY id) SELECT count(*) AS n, count(DISTINCT numbers) AS different FROM s WHERE id::BIGINT % 2 = 0", "kv_log")
def u13(spark, d):
    store = kvstore.last_writes(v.kv_log(spark, d).drop("op")).select("id", "numbers")
    gone = store.where("cast(id as bigint) % 2 = 1").select("id")
    return kvstore.delete(kvstore.put(store.limit(0), store), gone).agg(F.count("*").alias("n"), F.countDistinct("numbers").alias("different"))


@query("t6_isolated_errors", "SELECT CASE WHEN domain = '5' THEN 'failed' ELSE 'good' END AS kind, count(DISTINCT domain) AS n FROM residues GROUP BY 1", "residues")
def t6(spark, d):
    rows = vectors.gathered(v.residues(spark, d)).withColumn("vecs", F.when(F.col("domain") == "5", F.slice("vecs", 1, 0)).otherwise(F.col("vecs")))
    done = models.predict(rows, models.TransformerAggregator(64, layers=1, seed=1), "domain", "vecs")
    return done.groupBy(F.when(F.col("error").isNotNull(), "failed").otherwise("good").alias("kind")).agg(F.count("*").alias("n"))
