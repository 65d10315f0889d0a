"""Queries over encoders, profiles, smoothing, densities and closed-form classifiers, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import vectors as v
from tessel.operators import density, features, gaussian, linear, neural, smoothing
from tessel.plans.tables import table
from tessel.sources import text

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def entries(data: DataFrame, key: str, array: Column, digits: int = 6, nonzero: bool = False) -> DataFrame:
    """(key, i, w): an array's entries as rows."""
    out = data.select(key, F.posexplode(array).alias("i", "w")).select(key, "i", r("w", digits).alias("w"))
    return out.filter("w <> 0") if nonzero else out


def _price(spark: SparkSession, sf: str) -> tuple[DataFrame, float, float]:
    lines = table(spark, sf, "lineitem").select(*LINE_KEY, "l_extendedprice")
    return (lines, *lines.agg(F.avg("l_extendedprice"), F.stddev_pop("l_extendedprice")).first())


def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    lines, mean, std = _price(spark, sf)
    return lines.select(*LINE_KEY, r(features.standardise(F.col("l_extendedprice"), mean, std)).alias("z"))


def standard_scale_revert(spark: SparkSession, sf: str) -> DataFrame:
    lines, mean, std = _price(spark, sf)
    return lines.select(*LINE_KEY, r(features.unstandardise(features.standardise(F.col("l_extendedprice"), mean, std), mean, std), 4).alias("x"))


def range_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    return entries(table(spark, sf, "part"), "p_partkey", features.rbf_range(F.col("p_retailprice"), (900.0, 2100.0), 10))


def category_mass_select(spark: SparkSession, sf: str) -> DataFrame:
    return features.mass_cut(features.category_masses(table(spark, sf, "part"), "p_brand"), 0.9).select("value", "n", r("p").alias("p"))


def category_onehot(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    kept = [x["value"] for x in features.mass_cut(features.category_masses(orders, "o_orderpriority"), 0.7).orderBy("value").collect()]
    return entries(orders, "o_orderkey", features.category_bits(F.col("o_orderpriority"), kept), nonzero=True)


def percentile_grid(spark: SparkSession, sf: str) -> DataFrame:
    return features.quantile_grid(table(spark, sf, "orders"), "o_totalprice", 20)


def _knots(spark: SparkSession, sf: str) -> list[float]:
    return [x["value"] for x in percentile_grid(spark, sf).orderBy("value").collect()]


def percentile_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    return entries(table(spark, sf, "orders"), "o_orderkey", features.percentile_bits(F.col("o_totalprice"), _knots(spark, sf)), nonzero=True)


def percentile_bitmap_accum(spark: SparkSession, sf: str) -> DataFrame:
    bits = features.thermometer_bits(F.col("o_totalprice"), _knots(spark, sf))
    return table(spark, sf, "orders").select("o_orderkey", v.total(bits).cast("long").alias("n_set"))


def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return features.profile(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment"]).select("name", "n_rows", "n_missing", "n_distinct", r("share_numeric").alias("share_numeric"), r("min", 4).alias("min"), r("max", 4).alias("max"))


def _part_metas(spark: SparkSession, sf: str) -> list[features.Meta]:
    part = table(spark, sf, "part")
    found = {m.name: m for m in features.explore(part, ["p_size", "p_brand", "p_retailprice"])}
    from dataclasses import replace

    edited = [replace(found["p_size"], type=features.PERCENTILES, values=(), num_intervals=12), found["p_brand"], replace(found["p_retailprice"], type=features.STANDARD)]
    return features.refine(part, edited)


def refine_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(m.name, i, float(x)) for m in _part_metas(spark, sf) if m.type != features.CATEGORICAL for i, x in enumerate(m.values)]
    return spark.createDataFrame(rows, "name string, i int, value double").select("name", "i", r("value", 4).alias("value"))


def encode_rows(spark: SparkSession, sf: str) -> DataFrame:
    return entries(features.encode(table(spark, sf, "part"), _part_metas(spark, sf)), "p_partkey", F.col("features"), 5, nonzero=True)


def encode_sparse_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts by a dictionary, brands by a list, prices standardised: the entries that are not zero."""
    part = table(spark, sf, "part")
    names, brands = features.explore(part, ["p_name", "p_brand"], inline=100)
    prices = features.refine(part, [features.Meta("p_retailprice", features.STANDARD)])
    out, _ = features.encode_sparse(part, [names, brands, *prices])
    return out.select("p_partkey", F.inline("features")).select("p_partkey", "i", r("w", 5).alias("w")).filter("w <> 0")


def encoded_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Phase three: only rows whose target encodes to something, here the brands that hold half of the mass."""
    part, metas = table(spark, sf, "part"), _part_metas(spark, sf)
    brands = tuple(x["value"] for x in features.mass_cut(features.category_masses(part, "p_brand"), 0.5).orderBy("value").collect())
    out = features.encoded_targets(part, [metas[2]], [features.Meta("p_brand", features.CATEGORICAL, values=brands)])
    return out.select("p_partkey", r(F.get("x", 0), 5).alias("x"), v.argmax(F.col("y")).alias("y"))


def _gappy(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).cast("double").alias("value"))


def nan_sentinel_fill(spark: SparkSession, sf: str) -> DataFrame:
    gappy = _gappy(table(spark, sf, "events"))
    low = gappy.filter(~features.is_missing(F.col("value"), "double")).agg(F.min("value")).first()[0]
    return gappy.select("event_id", r(features.fill_missing(F.col("value"), "double", min(-1.0, low) - 10), 4).alias("value"))


def excluded_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "orders").filter(features.without(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"]))
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def kernel_smooth(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    signals = table(spark, sf, "events").select(F.col("user_id").alias("signal_id"), idx.alias("idx"), F.col("value").alias("y"))
    return smoothing.smooth(signals, n_to=20, duration=10.0, h=0.8).select("signal_id", "t", r("y").alias("y"))


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"), v.vector(F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000).alias("features"))


def class_moments(spark: SparkSession, sf: str) -> DataFrame:
    m = gaussian.fit(_flagged(spark, sf))
    rows = [(c, float(m.log_prior[k]), *map(float, m.mu[k]), float(m.sigma[k][0, 0]), float(m.sigma[k][0, 1]), float(m.sigma[k][1, 1])) for k, c in enumerate(m.labels)]
    names = ["log_prior", "m0", "m1", "s00", "s01", "s11"]
    return spark.createDataFrame(rows, "label string, " + ", ".join(f"{n} double" for n in names)).select("label", *[r(n).alias(n) for n in names])


def _gaussian(covariance: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        data = _flagged(spark, sf)
        return gaussian.predict(gaussian.fit(data, covariance), data).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))

    return query


def lda_predict(spark: SparkSession, sf: str) -> DataFrame:
    data = _flagged(spark, sf)
    return linear.predict(linear.fit(data), data).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("qid"), v.vector(F.col("s_acctbal") / 1000, "s_nationkey").alias("features"))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("label"), v.vector(F.col("c_acctbal") / 1000, "c_nationkey").alias("features"))


def kde_score(spark: SparkSession, sf: str) -> DataFrame:
    return density.log_density(_suppliers(spark, sf), _customers(spark, sf), 1.5).select("qid", r("log_density").alias("log_density"))


def kde_classify(spark: SparkSession, sf: str) -> DataFrame:
    return density.classify(_suppliers(spark, sf), _customers(spark, sf), h=2.0)


def kde_two_class_score(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf)
    return density.two_class_score(_suppliers(spark, sf), c.filter("label = 'BUILDING'"), c.filter("label = 'MACHINERY'"), 1.5).select("qid", r("score").alias("score"))


def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return entries(table(spark, sf, "embeddings").select("vec_id", v.one_hot(F.col("label"), 10).alias("y")), "vec_id", F.col("y"), nonzero=True)


def _guess() -> Column:
    return F.pmod(F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0), F.lit(10))


def error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").agg(r(neural.error_rate(_guess(), F.col("label"))).alias("error_rate"))


def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    outputs = F.transform(v.one_hot(_guess(), 10), lambda h: 0.9 * h + 0.01)
    return table(spark, sf, "embeddings").agg(r(neural.cross_entropy(v.one_hot(F.col("label"), 10), outputs)).alias("cross_entropy"))


def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "supplier").select("s_suppkey", F.concat_ws("  ", F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string")).alias("value"))
    return entries(lines.withColumn("x", text.parse_vector(F.col("value"))), "s_suppkey", F.col("x"), 4)


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", r(v.norm(x)).alias("norm"), r(v.logsumexp(x)).alias("lse"), v.argmax(x).alias("first_max"), v.argmin(x).alias("first_min"))


def activations(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.functions.activations import activate

    x = F.array((F.col("value") - 50.0) / 10.0, F.lit(0.5))
    kinds = ("linear", "sigmoid", "tanh", "ReLU", "softmax")
    return table(spark, sf, "events").select("event_id", *[r(F.get(activate(k, x), 0)).alias(k.lower()) for k in kinds])


QUERIES = {f.__name__: f for f in (
    standard_scale, standard_scale_revert, range_bitmap, category_mass_select, category_onehot, percentile_grid, percentile_bitmap, percentile_bitmap_accum, profile_columns, refine_metadata, encode_rows, encode_sparse_rows,
    encoded_targets, nan_sentinel_fill, excluded_filter, kernel_smooth, class_moments, lda_predict, kde_score, kde_classify, kde_two_class_score, one_hot, error_rate, cross_entropy, text_vectors, vector_norms, activations)}
QUERIES |= {f"gaussian_predict_{c}": _gaussian(c) for c in gaussian.COVARIANCES}

_GRID = """
o AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS place, rank() OVER (ORDER BY o_totalprice) - 1 AS position, count(*) OVER () AS n FROM orders),
grid AS (SELECT DISTINCT CAST(position AS BIGINT) AS position, x AS value FROM o WHERE place % CAST(greatest(1, floor(n / 18.0)) AS BIGINT) = 0 OR place = n - 1)"""
_KNOTS = _GRID + ", k AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i, lag(value) OVER (ORDER BY value) AS before, lead(value) OVER (ORDER BY value) AS after FROM grid)"
_PARTS = """
p AS (SELECT CAST(p_size AS DOUBLE) AS x, row_number() OVER (ORDER BY p_size) - 1 AS place, count(*) OVER () AS n FROM part),
g AS (SELECT DISTINCT x FROM p WHERE place % CAST(greatest(1, floor(n / 10.0)) AS BIGINT) = 0 OR place = n - 1),
k AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, lag(x) OVER (ORDER BY x) AS before, lead(x) OVER (ORDER BY x) AS after FROM g),
s AS (SELECT avg(p_retailprice) AS mean, stddev_pop(p_retailprice) AS std FROM part)"""
_MASS = """
c AS (SELECT {column} AS value, count(*) AS n, count(*) / (sum(count(*)) OVER ()) AS p FROM {table} GROUP BY 1),
w AS (SELECT *, sum(p) OVER (ORDER BY p DESC, value ROWS UNBOUNDED PRECEDING) AS running FROM c),
kept AS (SELECT value, n, p FROM w WHERE p >= (SELECT coalesce(max(p) FILTER (WHERE running > {mass}), min(p)) FROM w))"""
_LINES = "d AS (SELECT l_returnflag AS label, l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem)"
_MOMENTS = _LINES + """,
m AS (SELECT label, count(*) AS n, ln(count(*)) - ln(sum(count(*)) OVER ()) AS log_prior, avg(x) AS m0, avg(y) AS m1, var_samp(x) AS s00, covar_samp(x, y) AS s01, var_samp(y) AS s11 FROM d GROUP BY label)"""
_KDE = """
q AS (SELECT s_suppkey AS qid, s_acctbal / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),
t AS (SELECT c_mktsegment AS label, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
z AS (SELECT qid, label, -((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y)) / (2 * {h} * {h}) AS z FROM q, t)"""
_EMB = "SELECT vec_id, label, (label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS guess FROM embeddings"

SQL = {
    "standard_scale": "WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - m) / d, 6) + 0.0::DOUBLE AS z FROM lineitem, s",
    "standard_scale_revert": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 4) AS x FROM lineitem",
    "range_bitmap": """WITH c AS (SELECT i, 900 + 1200.0::DOUBLE * i / 9 AS m FROM range(10) AS t(i)),
w AS (SELECT p_partkey, i, exp(-0.5 / ((1200.0::DOUBLE / 21) * (1200.0::DOUBLE / 21)) * (p_retailprice - m) * (p_retailprice - m)) AS w FROM part, c)
SELECT p_partkey, CAST(i AS INTEGER) AS i, round(w / sum(w) OVER (PARTITION BY p_partkey), 6) AS w FROM w""",
    "category_mass_select": f"WITH {_MASS.format(column='p_brand', table='part', mass=0.9)} SELECT value, n, round(p, 6) AS p FROM kept",
    "category_onehot": f"WITH {_MASS.format(column='o_orderpriority', table='orders', mass=0.7)}, k AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM kept) SELECT o_orderkey, CAST(i AS INTEGER) AS i, 1.0::DOUBLE AS w FROM orders JOIN k ON o_orderpriority = value",
    "percentile_grid": f"WITH {_GRID} SELECT position, value FROM grid",
    "percentile_bitmap": f"""WITH {_KNOTS} SELECT o_orderkey, CAST(i AS INTEGER) AS i, round(w, 6) AS w FROM (SELECT o_orderkey, i, CASE WHEN o_totalprice = k.x THEN 1.0
WHEN o_totalprice > before AND o_totalprice < k.x THEN (o_totalprice - before) / (k.x - before) WHEN o_totalprice > k.x AND o_totalprice < after THEN (after - o_totalprice) / (after - k.x) ELSE 0 END AS w FROM orders, k) WHERE round(w, 6) <> 0""",
    "percentile_bitmap_accum": f"WITH {_KNOTS} SELECT o_orderkey, count(*) AS n_set FROM orders JOIN k ON o_totalprice >= k.x GROUP BY o_orderkey",
    "profile_columns": """SELECT 'c_acctbal' AS name, count(*) AS n_rows, count(*) - count(c_acctbal) AS n_missing, count(DISTINCT c_acctbal) AS n_distinct, 1.0::DOUBLE AS share_numeric, round(min(c_acctbal), 4) AS min, round(max(c_acctbal), 4) AS max FROM customer
UNION ALL SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey), count(DISTINCT c_nationkey), 1.0::DOUBLE, CAST(min(c_nationkey) AS DOUBLE), CAST(max(c_nationkey) AS DOUBLE) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), round(avg(CASE WHEN try_cast(c_mktsegment AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END), 6), min(try_cast(c_mktsegment AS DOUBLE)), max(try_cast(c_mktsegment AS DOUBLE)) FROM customer""",
    "refine_metadata": f"WITH {_PARTS} SELECT 'p_size' AS name, CAST(i AS INTEGER) AS i, x AS value FROM k UNION ALL SELECT 'p_retailprice', 0, round(mean, 4) FROM s UNION ALL SELECT 'p_retailprice', 1, round(std, 4) FROM s",
    "encode_rows": f"""WITH {_PARTS}, nk AS (SELECT count(*) AS nk FROM k), b AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM (SELECT DISTINCT p_brand AS value FROM part)), nb AS (SELECT count(*) AS nb FROM b),
e AS (SELECT p_partkey, i, CASE WHEN p_size = k.x THEN 1.0 WHEN p_size > before AND p_size < k.x THEN (p_size - before) / (k.x - before) WHEN p_size > k.x AND p_size < after THEN (after - p_size) / (after - k.x) ELSE 0 END AS w FROM part, k
UNION ALL SELECT p_partkey, nk + b.i, 1.0 FROM part JOIN b ON p_brand = b.value, nk UNION ALL SELECT p_partkey, nk + nb, (p_retailprice - mean) / std FROM part, nk, nb, s)
SELECT p_partkey, CAST(i AS INTEGER) AS i, round(w, 5) + 0.0::DOUBLE AS w FROM e WHERE round(w, 5) <> 0""",
    "encode_sparse_rows": """WITH a AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM (SELECT DISTINCT p_name AS value FROM part)), b AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM (SELECT DISTINCT p_brand AS value FROM part)),
na AS (SELECT count(*) AS na FROM a), nb AS (SELECT count(*) AS nb FROM b), s AS (SELECT avg(p_retailprice) AS mean, stddev_pop(p_retailprice) AS std FROM part)
SELECT p_partkey, CAST(i AS BIGINT) AS i, w FROM (SELECT p_partkey, a.i, 1.0::DOUBLE AS w FROM part JOIN a ON p_name = a.value UNION ALL SELECT p_partkey, na + b.i, 1.0::DOUBLE FROM part JOIN b ON p_brand = b.value, na
UNION ALL SELECT p_partkey, na + nb, round((p_retailprice - mean) / std, 5) + 0.0::DOUBLE FROM part, na, nb, s) WHERE w <> 0""",
    "encoded_targets": f"WITH {_PARTS}, {_MASS.format(column='p_brand', table='part', mass=0.5)}, b AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM kept) SELECT p_partkey, round((p_retailprice - mean) / std, 5) + 0.0::DOUBLE AS x, CAST(b.i AS INTEGER) AS y FROM part JOIN b ON p_brand = value, s",
    "nan_sentinel_fill": "WITH g AS (SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events) SELECT event_id, round(coalesce(value, least(-1.0, (SELECT min(value) FROM g)) - 10), 4) AS value FROM g",
    "excluded_filter": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY 1",
    "kernel_smooth": """WITH p AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
x AS (SELECT user_id, y, CASE WHEN n > 1 THEN 10.0::DOUBLE * i / (n - 1) ELSE 0 END AS x FROM p),
w AS (SELECT user_id, t, y, exp(-0.5 * ((x - 10.0::DOUBLE * t / 19) / 0.8) * ((x - 10.0::DOUBLE * t / 19) / 0.8)) AS w FROM x, range(20) AS g(t))
SELECT user_id AS signal_id, CAST(t AS INTEGER) AS t, round(sum(w * y) / sum(w), 6) + 0.0::DOUBLE AS y FROM w GROUP BY user_id, t""",
    "class_moments": f"WITH {_MOMENTS} SELECT label, round(log_prior, 6) AS log_prior, round(m0, 6) AS m0, round(m1, 6) AS m1, round(s00, 6) AS s00, round(s01, 6) AS s01, round(s11, 6) AS s11 FROM m",
    "lda_predict": f"""WITH {_LINES}, g AS (SELECT sum(x * x) - 1e-5 AS a, sum(x * y) AS b, sum(y * y) - 1e-5 AS c FROM d), t AS (SELECT label AS k, sum(x) AS tx, sum(y) AS ty FROM d GROUP BY label),
w AS (SELECT k, (c * tx - b * ty) / (a * c - b * b) AS w0, (a * ty - b * tx) / (a * c - b * b) AS w1 FROM t, g),
s AS (SELECT d.label, w.k, row_number() OVER (PARTITION BY d.i ORDER BY x * w0 + y * w1 DESC, w.k) AS p FROM (SELECT *, row_number() OVER () AS i FROM d) AS d, w)
SELECT label, k AS predicted, count(*) AS n FROM s WHERE p = 1 GROUP BY label, k""",
    "kde_score": f"WITH {_KDE.format(h=1.5)}, m AS (SELECT qid, max(z) AS m FROM z GROUP BY qid) SELECT z.qid, round(-0.5 * ln(pi() * 1.5 * 1.5) + max(m) + ln(sum(exp(z - m))) - ln(count(*)), 6) AS log_density FROM z JOIN m ON m.qid = z.qid GROUP BY z.qid",
    "kde_classify": f"""WITH {_KDE.format(h=2.0)}, m AS (SELECT qid, label, max(z) AS m FROM z GROUP BY ALL), s AS (SELECT z.qid, z.label, max(m) + ln(sum(exp(z - m))) - ln(count(*)) AS s FROM z JOIN m ON m.qid = z.qid AND m.label = z.label GROUP BY ALL)
SELECT qid, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) AS p FROM s) WHERE p = 1""",
    "kde_two_class_score": f"""WITH {_KDE.format(h=1.5)}, d AS (SELECT qid, exp(-0.5 * ln(pi() * 1.5 * 1.5)) * avg(exp(z)) FILTER (WHERE label = 'BUILDING') AS d1, exp(-0.5 * ln(pi() * 1.5 * 1.5)) * avg(exp(z)) FILTER (WHERE label = 'MACHINERY') AS d2 FROM z GROUP BY qid)
SELECT qid, round(2 * d1 / greatest(1e-5, d1 + d2) - 1, 6) + 0.0::DOUBLE AS score FROM d""",
    "one_hot": "SELECT vec_id, label AS i, 1.0::DOUBLE AS w FROM embeddings",
    "error_rate": f"SELECT round(100 - 100 * avg(CASE WHEN guess = label THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM ({_EMB})",
    "cross_entropy": f"SELECT round(avg(-ln(CASE WHEN guess = label THEN 0.91 ELSE 0.01 END)), 6) AS cross_entropy FROM ({_EMB})",
    "text_vectors": "SELECT s_suppkey, 0 AS i, round(s_acctbal, 4) AS w FROM supplier UNION ALL SELECT s_suppkey, 1, CAST(s_nationkey AS DOUBLE) FROM supplier",
    "vector_norms": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda t: t * t))), 6) AS norm, round(ln(list_sum(list_transform(x, lambda t: exp(t)))), 6) AS lse, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS first_max, CAST(list_position(x, list_min(x)) - 1 AS INTEGER) AS first_min FROM e""",
    "activations": """WITH a AS (SELECT event_id, (value - 50.0) / 10.0 AS x FROM events)
SELECT event_id, round(x, 6) + 0.0::DOUBLE AS linear, round(1 / (1 + exp(-greatest(-40, least(40, x)))), 6) + 0.0::DOUBLE AS sigmoid, round(1.7159 * tanh(2.0::DOUBLE / 3 * x), 6) + 0.0::DOUBLE AS tanh,
round(greatest(0, x), 6) + 0.0::DOUBLE AS relu, round(1 / (1 + exp(0.5 - x)), 6) + 0.0::DOUBLE AS softmax FROM a""",
}
_OWN = {
    "full": "SELECT label, log_prior, m0, m1, s00, s01, s11 FROM m",
    "diag": "SELECT label, log_prior, m0, m1, greatest(1e-5, s00) AS s00, 0.0 AS s01, greatest(1e-5, s11) AS s11 FROM m",
    "tied": "SELECT label, log_prior, m0, m1, t.* FROM m, (SELECT var_samp(x) AS s00, covar_samp(x, y) AS s01, var_samp(y) AS s11 FROM d) AS t",
    "tied_diag": "SELECT label, log_prior, m0, m1, t.* FROM m, (SELECT var_samp(x) AS s00, 0.0 AS s01, var_samp(y) AS s11 FROM d) AS t",
}
for _name, _select in _OWN.items():
    SQL[f"gaussian_predict_{_name}"] = f"""WITH {_MOMENTS}, c AS ({_select}),
s AS (SELECT d.label, c.label AS k, row_number() OVER (PARTITION BY d.i ORDER BY log_prior - 0.5 * ((s11 * (x - m0) * (x - m0) - 2 * s01 * (x - m0) * (y - m1) + s00 * (y - m1) * (y - m1)) / (s00 * s11 - s01 * s01) + ln(s00 * s11 - s01 * s01) + ln(2 * pi())) DESC, c.label) AS p
FROM (SELECT *, row_number() OVER () AS i FROM d) AS d, c) SELECT label, k AS predicted, count(*) AS n FROM s WHERE p = 1 GROUP BY label, k"""
