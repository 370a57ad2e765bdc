"""Queries of pair, weight, sampling and metric operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import scores
from pairloom.functions import options
from pairloom.operators import metrics, pairs, sampling, weights
from pairloom.operators.vectors import cosine_pairs
from pairloom.plans import views as v
from pairloom.plans.catalog import query

BIN5 = "CAST(floor(5::FLOAT * score) AS INTEGER)"
R6 = lambda c: F.round(c, 6)


@query(
    "entry_weighted_cosine_error",
    f"""WITH kept AS (SELECT domain_i, domain_j, score FROM pairs WHERE domain_i NOT IN (SELECT id FROM excluded) AND domain_j NOT IN (SELECT id FROM excluded)),
    binned AS (SELECT *, {BIN5} AS bin FROM kept), w AS (SELECT bin, 1.0::DOUBLE / count(*) AS weight FROM binned GROUP BY bin),
    joined AS (SELECT bin, weight, score::DOUBLE AS score, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine
      FROM binned JOIN w USING (bin) JOIN catalog a ON a.domain = domain_i JOIN catalog b ON b.domain = domain_j)
    SELECT bin, count(*) AS n, round(any_value(weight), 9) AS weight, round(avg((cosine - score) * (cosine - score)), 6) AS mse FROM joined GROUP BY bin""",
    "pairs excluded catalog",
)
def weighted_cosine_error(spark: SparkSession, d: str) -> DataFrame:
    kept = pairs.exclude(v.pairs(spark, d), v.excluded(spark, d))
    joined = cosine_pairs(pairs.attach(weights.weighted(kept), v.catalog(spark, d)))
    joined = joined.withColumn("bin", scores.score_bin(F.col("score"), 5))
    error = metrics.squared_error(F.col("cosine"), F.col("score").cast("double"))
    return joined.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.first("weight"), 9).alias("weight"), R6(F.avg(error)).alias("mse"))


@query("f1_binary_score", "SELECT domain_i, domain_j, CASE WHEN score > 0.7::FLOAT THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, count(*) AS n FROM pairs GROUP BY ALL", "pairs")
def f1(spark, d):
    return v.pairs(spark, d).groupBy("domain_i", "domain_j", scores.binary_score(F.col("score"), 0.7).alias("label")).agg(F.count("*").alias("n"))


@query("f2_fraction_score", "SELECT score, round_even((10::FLOAT * score)::FLOAT::DOUBLE, 0) / 10 AS tenths, round_even((4::FLOAT * score)::FLOAT::DOUBLE, 0) / 4 AS quarters, count(*) AS n FROM pairs GROUP BY ALL", "pairs")
def f2(spark, d):
    s = F.col("score")
    return v.pairs(spark, d).groupBy("score", scores.fraction_score(s).alias("tenths"), scores.fraction_score(s, 4).alias("quarters")).agg(F.count("*").alias("n"))


@query("f8_nan_scores", "SELECT count(*) AS n, count(*) FILTER (WHERE score IS NOT NULL) AS valid FROM (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE score END AS score FROM pairs)", "pairs")
def f8(spark, d):
    rows = v.pairs(spark, d, ["l_linenumber"]).withColumn("score", F.when(F.col("l_linenumber") == 1, F.lit(float("nan")).cast("float")).otherwise(F.col("score")))
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.isnan("score")).alias("valid"))


LINES_SQL = "CASE WHEN l_linenumber = 1 THEN domain_i || ',' || domain_j || ',' || l_quantity::BIGINT WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 3 THEN domain_i ELSE domain_j || ',' || domain_i END AS value"
MARKED = f"""WITH lines AS (SELECT {LINES_SQL} FROM pairs), rows AS (SELECT value, split_part(value, ',', 1) AS a, split_part(value, ',', 2) AS b, trim(value) = '' AS blank, value NOT LIKE '%,%' AS short FROM lines),
    marked AS (SELECT *, NOT blank AND short AS malformed, NOT blank AND NOT short AS usable, NOT blank AND NOT short AND a IN (SELECT domain FROM catalog) AND b IN (SELECT domain FROM catalog) AS keep FROM rows) """


def _lines(spark, d):
    n, i, j = F.col("l_linenumber"), F.col("domain_i"), F.col("domain_j")
    rows = v.pairs(spark, d, ["l_linenumber", "l_quantity"])
    value = F.when(n == 1, F.concat_ws(",", i, j, F.col("l_quantity").cast("long").cast("string"))).when(n == 2, "").when(n == 3, i).otherwise(F.concat_ws(",", j, i))
    return rows.select(value.alias("value"))


@query("f9_malformed_rows", MARKED + "SELECT malformed, blank, count(*) AS n FROM marked GROUP BY ALL", "pairs catalog")
def f9(spark, d):
    return pairs.split_lines(_lines(spark, d)).groupBy("malformed", "blank").agg(F.count("*").alias("n"))


@query("k8_sanitise_lines", MARKED + "SELECT value FROM marked WHERE keep", "pairs catalog")
def k8(spark, d):
    return pairs.sanitise(_lines(spark, d), v.catalog(spark, d))[0]


@query("o2_missing_ids", MARKED + "SELECT DISTINCT id AS domain FROM (SELECT a AS id FROM marked WHERE usable UNION ALL SELECT b FROM marked WHERE usable) WHERE id NOT IN (SELECT domain FROM catalog) ORDER BY 1", "pairs catalog")
def o2(spark, d):
    return pairs.sanitise(_lines(spark, d), v.catalog(spark, d))[1].orderBy("domain")


@query("a15_sanitise_counters", MARKED + "SELECT count(*) FILTER (WHERE NOT blank) AS total, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE usable AND NOT keep) AS dropped, count(*) FILTER (WHERE malformed) AS malformed FROM marked", "pairs catalog")
def a15(spark, d):
    return pairs.sanitise(_lines(spark, d), v.catalog(spark, d))[2]


@query("j1_pair_vectors", "SELECT domain_i, domain_j, score, a.embedding[1]::DOUBLE AS first_i, b.embedding[1]::DOUBLE AS first_j FROM pairs JOIN catalog a ON a.domain = domain_i JOIN catalog b ON b.domain = domain_j", "pairs catalog")
def j1(spark, d):
    rows = pairs.attach(v.pairs(spark, d), v.catalog(spark, d))
    return rows.select("domain_i", "domain_j", "score", F.get("embedding_i", 0).cast("double").alias("first_i"), F.get("embedding_j", 0).cast("double").alias("first_j"))


@query("j2_exclude_anti", "SELECT domain_i, domain_j, score FROM pairs WHERE domain_i NOT IN (SELECT id FROM excluded) AND domain_j NOT IN (SELECT id FROM excluded)", "pairs excluded")
def j2(spark, d):
    return pairs.exclude(v.pairs(spark, d), v.excluded(spark, d))


@query("j3_known_both", "SELECT domain_i, domain_j, score FROM pairs WHERE domain_i IN (SELECT domain FROM catalog) AND domain_j IN (SELECT domain FROM catalog)", "pairs catalog")
def j3(spark, d):
    return pairs.known(v.pairs(spark, d), v.catalog(spark, d))


@query("j4_missing_in_catalog", "SELECT DISTINCT domain FROM (SELECT domain_i AS domain FROM pairs UNION ALL SELECT domain_j FROM pairs) WHERE domain NOT IN (SELECT domain FROM catalog)", "pairs catalog")
def j4(spark, d):
    return pairs.missing_ids(v.pairs(spark, d), v.catalog(spark, d))


@query("j5_class_enrichment", "SELECT f.header, f.header || '|' || c.class AS named, c.class FROM (SELECT 'D' || p_partkey AS header, CAST(p_partkey AS VARCHAR) AS domain FROM part) f LEFT JOIN (SELECT * FROM classes WHERE ord % 3 <> 0) c USING (domain)", "classes")
def j5(spark, d):
    rows = v.classes(spark, d).select(F.concat(F.lit("D"), "domain").alias("header"), "domain")
    some = v.classes(spark, d).where("ord % 3 <> 0")
    return pairs.enrich(rows, some, "domain", "class").select("header", F.concat(F.col("header"), F.lit("|"), F.col("class")).alias("named"), "class")


FOLD = """WITH firsts AS (SELECT class, min(ord) AS first_at FROM classes GROUP BY class), placed AS (SELECT class, row_number() OVER (ORDER BY first_at, class) - 1 AS k, count(*) OVER () // 5 AS size FROM firsts),
    fold AS (SELECT class FROM placed WHERE k >= 2 * size AND k < 3 * size), held AS (SELECT domain FROM classes WHERE class IN (SELECT class FROM fold)) """


def _fold(spark, d):
    return pairs.fold_slice(v.classes(spark, d), 2, 5, "ord")


@query("w8_fold_slice", FOLD + "SELECT class FROM fold", "classes")
def w8(spark, d):
    return _fold(spark, d)


@query("j6_class_semi", FOLD + "SELECT domain FROM held", "classes")
def j6(spark, d):
    return v.classes(spark, d).join(_fold(spark, d), "class", "left_semi").select("domain")


@query("j7_test_split", FOLD + "SELECT domain_i, domain_j, score FROM pairs WHERE domain_i IN (SELECT domain FROM held) OR domain_j IN (SELECT domain FROM held)", "pairs classes")
def j7(spark, d):
    return pairs.fold_split(v.pairs(spark, d), v.classes(spark, d), _fold(spark, d))[1]


@query("j8_train_split", FOLD + "SELECT domain_i, domain_j, score FROM pairs WHERE domain_i NOT IN (SELECT domain FROM held) AND domain_j NOT IN (SELECT domain FROM held)", "pairs classes")
def j8(spark, d):
    return pairs.fold_split(v.pairs(spark, d), v.classes(spark, d), _fold(spark, d))[0]


@query("a6_classes_in_fold", FOLD + "SELECT count(DISTINCT class) AS n FROM fold", "classes")
def a6(spark, d):
    return _fold(spark, d).agg(F.countDistinct("class").alias("n"))


@query("a1_score_histogram", f"SELECT {BIN5} AS bin, count(*) AS n, 1.0::DOUBLE / (count(*) * CASE WHEN {BIN5} = 5 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM pairs GROUP BY 1", "pairs")
def a1(spark, d):
    return weights.histogram(v.pairs(spark, d), 5, 0.25)


@query("a2_score_weights", f"SELECT domain_i, domain_j, score, round(1.0::DOUBLE / (count(*) OVER (PARTITION BY {BIN5}) * CASE WHEN {BIN5} = 5 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END), 12) AS weight FROM pairs", "pairs")
def a2(spark, d):
    return weights.weighted(v.pairs(spark, d), 5, 0.25).withColumn("weight", F.round("weight", 12))


@query(
    "a3_dual_weights",
    f"""WITH w AS (SELECT *, score < 0.5::FLOAT AND score_max >= 0.7::FLOAT AS own, {BIN5} AS bin FROM dual_pairs)
    SELECT domain_i, domain_j, score, score_max, round(CASE WHEN own THEN 1.0::DOUBLE / count(*) FILTER (WHERE own) OVER () ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY bin) END, 12) AS weight FROM w""",
    "dual_pairs",
)
def a3(spark, d):
    return weights.dual_weighted(v.dual_pairs(spark, d)).withColumn("weight", F.round("weight", 12))


@query("a4_binary_weights", "SELECT domain_i, domain_j, score, round(1.0::DOUBLE / count(*) OVER (PARTITION BY score >= 0.7::FLOAT), 12) AS weight FROM pairs", "pairs")
def a4(spark, d):
    return weights.binary_weighted(v.pairs(spark, d), 0.7).withColumn("weight", F.round("weight", 12))


@query("a5_unique_ids", "SELECT domain_i AS domain FROM pairs UNION SELECT domain_j FROM pairs", "pairs")
def a5(spark, d):
    return pairs.unique_ids(v.pairs(spark, d))


@query("a10_mse", "SELECT l_returnflag, round(avg((pred - score::DOUBLE) * (pred - score::DOUBLE)), 6) AS mse FROM predictions GROUP BY 1", "predictions")
def a10(spark, d):
    return metrics.mse(v.predictions(spark, d), "pred", "score", ["l_returnflag"]).withColumn("mse", R6(F.col("mse")))


RANKED = "WITH t AS (SELECT pred, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM predictions GROUP BY pred), r AS (SELECT *, sum(p) OVER (ORDER BY pred DESC) AS tp, sum(n) OVER (ORDER BY pred DESC) AS fp FROM t) "


@query("a11_pr_auc", RANKED + "SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) AS pr_auc FROM r", "predictions")
def a11(spark, d):
    return metrics.pr_auc(v.predictions(spark, d), "label", "pred").select(R6(F.col("pr_auc")).alias("pr_auc"))


@query("a12_roc_auc", RANKED + "SELECT round(1 - sum(p * (fp - n / 2)) / (sum(p)::DOUBLE * sum(n)), 6) AS roc_auc FROM r", "predictions")
def a12(spark, d):
    return metrics.roc_auc(v.predictions(spark, d), "label", "pred").select(R6(F.col("roc_auc")).alias("roc_auc"))


@query(
    "a21_mean_of_workers",
    """WITH t AS (SELECT l_returnflag AS w, pred, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM predictions GROUP BY ALL),
    r AS (SELECT *, sum(p) OVER (PARTITION BY w ORDER BY pred DESC) AS tp, sum(n) OVER (PARTITION BY w ORDER BY pred DESC) AS fp FROM t),
    a AS (SELECT w, sum(p * tp / (tp + fp)) / sum(p) AS pr, 1 - sum(p * (fp - n / 2)) / (sum(p)::DOUBLE * sum(n)) AS roc FROM r GROUP BY w)
    SELECT round(avg(pr), 6) AS pr_auc, round(avg(roc), 6) AS roc_auc FROM a""",
    "predictions",
)
def a21(spark, d):
    return metrics.mean_of_workers(v.predictions(spark, d), "label", "pred", "l_returnflag").select(R6(F.col("pr_auc")).alias("pr_auc"), R6(F.col("roc_auc")).alias("roc_auc"))


@query(
    "a13_cross_entropy",
    """WITH t AS (SELECT label AS grp, CAST(vec_id % 5 AS INTEGER) AS target, embedding[1:5]::DOUBLE[] AS logits FROM embeddings)
    SELECT grp, round(-avg(logits[target + 1] - ln(list_sum(list_transform(logits, lambda x: exp(x))))), 6) AS loss FROM t WHERE target <> 0 GROUP BY grp""",
)
def a13(spark, d):
    rows = v.table(spark, d, "embeddings").select(F.col("label").alias("grp"), (F.col("vec_id") % 5).cast("int").alias("target"), F.slice("embedding", 1, 5).cast("array<double>").alias("logits"))
    return metrics.cross_entropy(rows, "logits", "target", 0, ["grp"]).withColumn("loss", R6(F.col("loss")))


@query("o7_best_epoch", "SELECT max_by(l_returnflag, mse) AS l_returnflag, round(max(mse), 6) AS mse FROM (SELECT l_returnflag, avg((pred - score::DOUBLE) ** 2) AS mse FROM predictions GROUP BY 1)", "predictions")
def o7(spark, d):
    return metrics.best(metrics.mse(v.predictions(spark, d), "pred", "score", ["l_returnflag"]), "mse", "l_returnflag").withColumn("mse", R6(F.col("mse")))


RES5 = "least(4, CAST(trunc(score::DOUBLE * 5) AS INTEGER))"
KEY_SQL = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT, (l_extendedprice * 100)::BIGINT, (l_discount * 100)::BIGINT, (l_tax * 100)::BIGINT, l_returnflag, l_linestatus, epoch(l_shipdate)::BIGINT))"


def _keyed(spark, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    key = F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus", F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))).cast("binary"))
    return v.pairs(spark, d, v.LINE).withColumn("key", key)


@query("w15_bin_reservoirs", f"SELECT domain_i, domain_j, score, key FROM (SELECT *, {KEY_SQL} AS key, row_number() OVER (PARTITION BY {RES5} ORDER BY {KEY_SQL}) AS rn FROM pairs) WHERE rn <= 500 // 5", "pairs")
def w15(spark, d):
    return sampling.reservoirs(_keyed(spark, d).select("domain_i", "domain_j", "score", "key"), 500, 5, F.col("key"))


@query("a16_reservoir_counts", f"SELECT {RES5} AS bin, count(*) AS n FROM pairs GROUP BY 1", "pairs")
def a16(spark, d):
    return sampling.bin_counts(v.pairs(spark, d), 5)


U_SQL = "(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"


def _orders(spark, d):
    u = (F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return v.table(spark, d, "orders").select("o_orderkey", "o_totalprice", u.alias("u"))


@query("o3_weighted_without_replacement", f"SELECT o_orderkey FROM (SELECT o_orderkey, -ln({U_SQL}) / o_totalprice AS k FROM orders WHERE o_totalprice > 0) ORDER BY k, o_orderkey LIMIT 200")
def o3(spark, d):
    return sampling.weighted_without_replacement(_orders(spark, d), 200, "o_totalprice", F.col("u"), ["o_orderkey"]).select("o_orderkey")


@query(
    "o3_weighted_with_replacement",
    """WITH w AS (SELECT o_orderkey, (o_totalprice::BIGINT % 97) AS w FROM orders), r AS (SELECT o_orderkey, sum(w) OVER (ORDER BY o_orderkey) AS upto, w FROM w WHERE w > 0),
    d AS (SELECT k, (k + 0.5::DOUBLE) / 300 * (SELECT sum(w) FROM w) AS t FROM range(300) x(k)) SELECT k AS draw, o_orderkey FROM d JOIN r ON t >= upto - w AND t < upto""",
)
def o3_with(spark, d):
    rows = v.table(spark, d, "orders").select("o_orderkey", (F.rint("o_totalprice").cast("long") % 97).alias("w"))
    draws = spark.range(300).select(F.col("id").alias("draw"), ((F.col("id") + 0.5) / 300).alias("u"))
    return sampling.weighted_with_replacement(rows, draws, "w", ["o_orderkey"], 8).select("draw", "o_orderkey")


@query("o4_random_subset", f"SELECT o_orderkey FROM orders ORDER BY {U_SQL}, o_orderkey LIMIT 100")
def o4(spark, d):
    return sampling.subset(_orders(spark, d), 100, F.col("u"), ["o_orderkey"]).select("o_orderkey")


@query("o5_epoch_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 64")
def o5(spark, d):
    return sampling.epoch(v.table(spark, d, "orders").select("o_orderkey"), 64, ["o_orderkey"])


@query("o8_triangle_unranking", "WITH t AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS index FROM range(60) a(i), range(60) b(j) WHERE i < j) SELECT index, i AS x, j AS y FROM t")
def o8(spark, d):
    return pairs.pairs_of_indices(spark.range(60 * 59 // 2).withColumnRenamed("id", "index"), 60)


@query("v1_with_self_pairs", "SELECT domain_i, domain_j, score FROM pairs UNION ALL SELECT domain, domain, 1.0::FLOAT FROM (SELECT domain_i AS domain FROM pairs UNION SELECT domain_j FROM pairs)", "pairs")
def v1(spark, d):
    return pairs.with_self_pairs(v.pairs(spark, d))


@query("v3_id_set_difference", "WITH u AS (SELECT domain_i AS domain FROM pairs UNION SELECT domain_j FROM pairs) SELECT 'known' AS side, count(*) AS n FROM u WHERE domain IN (SELECT domain FROM catalog) UNION ALL SELECT 'missing', count(*) FROM u WHERE domain NOT IN (SELECT domain FROM catalog)", "pairs catalog")
def v3(spark, d):
    ids, have = pairs.unique_ids(v.pairs(spark, d)), v.catalog(spark, d).select("domain")
    known, missing = ids.intersect(have), ids.exceptAll(have)
    side = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return side("known", known).unionByName(side("missing", missing))


@query("w9_contiguous_split", "SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS part FROM orders")
def w9(spark, d):
    rows = pairs.numbered(v.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    n = rows.count()
    size, more = n // 7, n % 7
    at = F.col("position")
    part = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(1, size)))
    return rows.select("o_orderkey", part.cast("int").alias("part"))


@query("w10_round_robin_shards", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS shard FROM orders")
def w10(spark, d):
    return pairs.numbered(v.table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", (F.col("position") % 5).alias("shard"))


@query("w12_even_chunks", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // ((count(*) OVER () + 5) // 6) AS chunk FROM orders")
def w12(spark, d):
    rows = pairs.numbered(v.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    size = max(1, -(-rows.count() // 6))
    return rows.select("o_orderkey", F.floor(F.col("position") / size).cast("long").alias("chunk"))


@query("m13_learning_rate", "SELECT e AS epoch, round(CASE WHEN e < 10 THEN greatest(1e-6, e / 10.0::DOUBLE) ELSE 0.5 * (1 + cos(pi() * (e - 10) / 90.0::DOUBLE)) END, 9) AS factor FROM range(100) t(e)")
def m13(spark, d):
    return spark.range(100).select(F.col("id").alias("epoch"), F.round(scores.learning_rate(F.col("id"), 10, 100), 9).alias("factor"))


@query("t5_epoch_metric", "SELECT l_returnflag AS epoch, count(*) AS n, round(avg((pred - score::DOUBLE) ** 2), 6) AS mse FROM predictions GROUP BY 1", "predictions")
def t5(spark, d):
    from pairloom.streaming.streams import epoch_metric

    rows = v.predictions(spark, d).select(F.col("l_returnflag").alias("epoch"), "pred", F.col("score").cast("double").alias("score"))
    return epoch_metric(rows, "epoch", "pred", "score").withColumn("mse", R6(F.col("mse")))


@query("v2_union_distinct", "SELECT domain_i AS domain FROM pairs UNION SELECT domain_j FROM pairs UNION SELECT domain FROM catalog", "pairs catalog")
def v2(spark, d):
    return pairs.unique_ids(v.pairs(spark, d)).union(v.catalog(spark, d).select("domain")).distinct()


@query(
    "u2_pluggable_scores_and_weights",
    f"SELECT label, bin, count(*) AS n, round(sum(weight), 9) AS weight FROM (SELECT CASE WHEN score > 0.5::FLOAT THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, {BIN5} AS bin, 1.0::DOUBLE / count(*) OVER (PARTITION BY {BIN5}) AS weight FROM pairs) GROUP BY ALL",
    "pairs",
)
def u2(spark, d):
    def scored(rows, score, weigh):
        return weigh(rows).withColumn("label", score(F.col("score")))

    rows = scored(v.pairs(spark, d), lambda s: scores.binary_score(s, 0.5), weights.weighted)
    return rows.groupBy("label", scores.score_bin(F.col("score"), 5).alias("bin")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 9).alias("weight"))


@query("u15_row_access", "SELECT count(*) AS n, count(*) FILTER (WHERE k IN (0, 17, 99)) AS got, max(o_orderkey) FILTER (WHERE k = 17) AS seventeenth FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)")
def u15(spark, d):
    rows = pairs.numbered(v.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("position").isin(0, 17, 99)).alias("got"), F.max(F.when(F.col("position") == 17, F.col("o_orderkey"))).alias("seventeenth"))


GIVEN = {n: f"p_partkey // {1 << k} % 2 = 1" for k, n in enumerate(("fasta", "structures", "against", "against_structures", "window_size", "window_step"))}


@query(
    "f14_argument_checks",
    f"""SELECT p_partkey, CASE WHEN ({GIVEN["fasta"]}) = ({GIVEN["structures"]}) THEN 'give either --fasta or --structures' WHEN {GIVEN["against"]} AND {GIVEN["against_structures"]} THEN '--against and --against-structures exclude each other'
    WHEN {GIVEN["window_step"]} AND NOT {GIVEN["window_size"]} THEN '--window-step needs --window-size' END AS problem FROM part""",
)
def f14(spark, d):
    """Each part number's bits say which options are given."""
    bit = lambda k: F.shiftright("p_partkey", k).bitwiseAND(1) == 1
    return v.table(spark, d, "part").select("p_partkey", options.problem_column(options.IDENTITY, {n: bit(k) for k, n in enumerate(GIVEN)}).alias("problem"))
