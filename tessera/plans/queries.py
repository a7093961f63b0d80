"""The registered queries of the engine's own operators over the driver's tables, each with its SQL where there is one.

``embeddings`` serve as attributions: a vector of 64 is a (4, 16) matrix by rows, and as it is a projected attribution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import align, annotations, cluster, patterns, relational, seqlets, topics
from tessera.plans import plotdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector() -> Column:
    return F.col("embedding").cast("array<double>")


def matrix(v: Column) -> Column:
    return F.array(*(F.slice(v, 16 * r + 1, 16) for r in range(4)))


def argmax_one_hot(m: Column) -> Column:
    """One-hot of the first greatest base of each position."""
    return A.indicators(F.transform(A.transpose(m), A.first_argmax), [0, 1, 2, 3])


def micro(x: Column) -> Column:
    return F.round(x * 1_000_000).cast("long")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_idx"), "label", matrix(vector()).alias("contrib"))
    return m.withColumn("oh", argmax_one_hot(F.col("contrib")))


def micro_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_idx"), F.transform("embedding", lambda x: micro(x.cast("double"))).alias("x"))


CELLS = """c AS (SELECT vec_id, label, p, list_transform([p + 1, p + 17, p + 33, p + 49], lambda i: CAST(embedding[i] AS DOUBLE)) AS v
  FROM embeddings, (SELECT unnest(range(16)) AS p))"""
DBDS = ["ARID", "bHLH", "bZIP", "Ets", "GATA", "Homeo", "Zinc"]
DBD_SQL = "['ARID', 'bHLH', 'bZIP', 'Ets', 'GATA', 'Homeo', 'Zinc']"


@query(f"WITH {CELLS} SELECT vec_id AS example_idx, CAST(p AS INT) AS pos, round(list_max(v), 6) AS value FROM c")
def projected_attribution(spark, sf_dir):
    return examples(spark, sf_dir).select("example_idx", F.posexplode(A.project(F.col("contrib"), F.col("oh"))).alias("pos", "value")).withColumn("value", F.round("value", 6))


SPANS = """x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
q AS (SELECT vec_id, i, CAST(round(CAST(v AS DOUBLE) * 1000000) AS BIGINT) AS v FROM x),
u AS (SELECT vec_id, i + 1 AS i, CAST(sum(v) OVER (PARTITION BY vec_id ORDER BY i) AS BIGINT) AS c FROM q UNION ALL SELECT vec_id, 0, 0 FROM embeddings),
s AS (SELECT a.vec_id, l.len, a.i AS start, b.c - a.c AS s FROM u a, (SELECT unnest(range(4, 26)) AS len) l, u b WHERE b.vec_id = a.vec_id AND b.i = a.i + l.len),
g AS (SELECT len, coalesce(max(s) FILTER (s > 0), 0) AS xmax, coalesce(min(s) FILTER (s <= 0), 0) AS xmin, count(*) FILTER (s > 0) AS n_pos, count(*) FILTER (s <= 0) AS n_neg FROM s GROUP BY len)"""


@query(f"WITH {SPANS} SELECT CAST(len AS INT) AS len, xmax, xmin, n_pos, n_neg FROM g")
def span_background(spark, sf_dir):
    return seqlets.background(seqlets.spans(micro_vectors(spark, sf_dir)))


@query(
    f"WITH {SPANS}, h AS (SELECT s.len, s > 0 AS positive, coalesce(999 * s // CASE WHEN s > 0 THEN xmax ELSE nullif(xmin, 0) END, 0) AS bin, CASE WHEN s > 0 THEN n_pos ELSE n_neg END AS side FROM s JOIN g ON s.len = g.len), "
    "k AS (SELECT len, positive, bin, side, count(*) AS n FROM h GROUP BY ALL) "
    "SELECT CAST(len AS INT) AS len, positive, CAST(bin AS INT) AS bin, n, round(1 - sum(n) OVER (PARTITION BY len, positive ORDER BY bin) / side, 6) AS p FROM k"
)
def span_histogram(spark, sf_dir):
    found = seqlets.spans(micro_vectors(spark, sf_dir))
    return seqlets.histogram(found, seqlets.background(found), integer=True).withColumn("p", F.round("p", 6))


SPANNED = """x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
q AS (SELECT vec_id, i, CAST(round(CAST(v AS DOUBLE) * 1000000) AS BIGINT) AS v FROM x),
u AS (SELECT vec_id, i + 1 AS i, CAST(sum(v) OVER (PARTITION BY vec_id ORDER BY i) AS BIGINT) AS c FROM q UNION ALL SELECT vec_id, 0, 0 FROM embeddings),
s AS (SELECT a.vec_id, l.len, a.i AS start, b.c - a.c AS s FROM u a, (SELECT unnest(range(4, 26)) AS len) l, u b WHERE b.vec_id = a.vec_id AND b.i = a.i + l.len),
g AS (SELECT len, coalesce(max(s) FILTER (s > 0), 0) AS xmax, coalesce(min(s) FILTER (s <= 0), 0) AS xmin, count(*) FILTER (s > 0) AS n_pos, count(*) FILTER (s <= 0) AS n_neg FROM s GROUP BY len),
h AS (SELECT s.vec_id, s.len, s.start, s > 0 AS positive, coalesce(999 * s // CASE WHEN s > 0 THEN xmax ELSE nullif(xmin, 0) END, 0) AS bin, CASE WHEN s > 0 THEN n_pos ELSE n_neg END AS side FROM s JOIN g ON s.len = g.len),
k AS (SELECT len, positive, bin, side, count(*) AS n FROM h GROUP BY ALL),
t AS (SELECT len, positive, bin, 1 - sum(n) OVER (PARTITION BY len, positive ORDER BY bin) / side AS p FROM k),
r AS (SELECT h.vec_id, h.len, h.start, t.p, max(t.p) OVER (PARTITION BY h.vec_id, h.start ORDER BY h.len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h JOIN t ON h.len = t.len AND h.positive = t.positive AND h.bin = t.bin)"""


# A span is a candidate if the spans one position right of it, each one shorter, are significant too and its right neighbour is
# not asked before it; from long to short, the most significant first, it is taken if none of the starts that it needs is closed.
@query(
    f"""WITH RECURSIVE {SPANNED},
low AS (SELECT vec_id, len, start, p FROM r WHERE p < 0.05 AND coalesce(before, 0) < 0.05),
diag AS (SELECT a.vec_id, a.len, a.start, a.p, count(b.start) AS n, min(CASE WHEN b.start = a.start + 1 THEN b.p END) AS beside FROM low a LEFT JOIN low b ON b.vec_id = a.vec_id AND b.start > a.start AND b.start <= a.start + a.len - 4 AND b.len = a.len - (b.start - a.start - 1) GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY len DESC, p, start) AS i FROM diag WHERE n = len - 4 AND (len = 4 OR beside >= p)),
w AS (SELECT vec_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS taken, false AS got, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS len, CAST(0 AS DOUBLE) AS p FROM (SELECT DISTINCT vec_id FROM v)
  UNION ALL SELECT vec_id, i, CASE WHEN free THEN list_append(taken, struct_pack(a := start, b := least(start + len, 63))) ELSE taken END, free, start, len, p
  FROM (SELECT v.vec_id, v.i, w.taken, v.start, v.len, v.p, len(list_filter(w.taken, lambda t: t.a <= v.start + v.len - 4 AND t.b > v.start)) = 0 AS free FROM w JOIN v ON v.vec_id = w.vec_id AND v.i = w.i + 1)),
took AS (SELECT vec_id, greatest(start - 3, 0) AS s, least(start + len + 3, 63) AS e, p FROM w WHERE got)
SELECT row_number() OVER (ORDER BY took.p, took.vec_id, took.s, took.e) - 1 AS seqlet_id, took.vec_id AS example_idx, CAST(took.s AS INT) AS start, CAST(took.e AS INT) AS "end", CAST(y.c - x.c AS DOUBLE) AS attribution, round(took.p, 6) AS p_value
FROM took JOIN u x ON x.vec_id = took.vec_id AND x.i = took.s JOIN u y ON y.vec_id = took.vec_id AND y.i = took.e"""
)
def seqlet_calls(spark, sf_dir):
    """Called, flanked by three positions, numbered.  In units of a millionth, so sums are exact."""
    x = micro_vectors(spark, sf_dir).select("example_idx", F.transform("x", lambda v: v.cast("double")).alias("x"))
    return seqlets.with_ids(seqlets.call_seqlets(x, threshold=0.05, flank=3)).withColumn("p_value", F.round("p_value", 6))


@query(
    f"WITH {CELLS}, t AS (SELECT vec_id, max(list_max(list_transform(v, lambda x: abs(x)))) AS top, sign(round(sum(list_max(v)), 9)) AS s FROM c GROUP BY vec_id) "
    "SELECT vec_id AS example_idx, CAST(p AS INT) AS pos, round(s * v[1] / top, 6) AS a, round(s * v[2] / top, 6) AS c, round(s * v[3] / top, 6) AS g, round(s * v[4] / top, 6) AS t FROM c JOIN t USING (vec_id)"
)
def normalize_sign(spark, sf_dir):
    m = examples(spark, sf_dir).withColumn("m", A.sign_correct(A.normalise(F.col("contrib")), F.col("oh")))
    return m.select("example_idx", F.posexplode(A.transpose(F.col("m"))).alias("pos", "v")).select("example_idx", "pos", *(F.round(F.get("v", F.lit(i)), 6).alias(b) for i, b in enumerate("acgt")))


@query(
    "WITH p AS (SELECT event_id, -log10(abs(value) / max(abs(value)) OVER () + 1e-10) AS x FROM events) "
    "SELECT event_id, round(least(greatest(x, 0.05), max(x) OVER ()), 6) AS sim FROM p"
)
def log_clip_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.abs("value").alias("v"))
    p = e.crossJoin(F.broadcast(e.agg(F.max("v").alias("top")))).select("event_id", A.log_similarity(F.col("v") / F.col("top")).alias("x"))
    return p.crossJoin(F.broadcast(p.agg(F.max("x").alias("gmax")))).select("event_id", F.round(A.clip(F.col("x"), F.col("gmax")), 6).alias("sim"))


TOP = f"t AS (SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS motif_idx FROM embeddings), d AS (SELECT *, {DBD_SQL}[motif_idx % 7 + 1] AS seqlet_dbd FROM t)"


@query(f"WITH {TOP} SELECT vec_id, motif_idx, seqlet_dbd FROM d")
def top_motif_dbd(spark, sf_dir):
    return cluster.top_motif_dbd(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [DBDS[i % 7] for i in range(64)])


@query(f"WITH {TOP}, n AS (SELECT label, seqlet_dbd, count(*) AS n FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, seqlet_dbd) AS r, sum(n) OVER (PARTITION BY label) AS total FROM n) SELECT label, seqlet_dbd AS cluster_dbd, CAST(total AS BIGINT) AS n_seqlets FROM r WHERE r = 1")
def seqlet_dbd(spark, sf_dir):
    """The flagship: similarity rows to a domain per cluster."""
    e = table(spark, sf_dir, "embeddings")
    named = cluster.top_motif_dbd(e, "vec_id", "embedding", [DBDS[i % 7] for i in range(64)], keep=["label"])
    size = named.groupBy("label").agg(F.count("*").alias("n_seqlets"))
    return relational.mode_smallest(named, ["label"], "seqlet_dbd", "cluster_dbd").join(size, "label")


@query("WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM n) SELECT c_nationkey, c_mktsegment AS mode FROM r WHERE r = 1")
def consensus_mode(spark, sf_dir):
    return relational.mode_smallest(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 64, 6) AS mean_contrib FROM embeddings")
def mean_abs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(A.mean_abs(matrix(vector())), 6).alias("mean_contrib"))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def crosstab_long(spark, sf_dir):
    return relational.crosstab(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL")
def crosstab_wide(spark, sf_dir):
    return relational.crosstab_wide(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("WITH m AS (SELECT event_type, count(*) / (SELECT count(DISTINCT user_id) FROM events) AS m FROM events GROUP BY ALL) SELECT event_type, round(m, 6) AS mean_n, CAST(row_number() OVER (ORDER BY m DESC, event_type) - 1 AS INT) AS position FROM m")
def crosstab_colmean_order(spark, sf_dir):
    return relational.column_order(table(spark, sf_dir, "events"), "user_id", "event_type").withColumn("mean_n", F.round("mean_n", 6))


@query("SELECT CAST(user_id AS VARCHAR) AS region_id, event_type AS cluster, count(*) AS n FROM (SELECT DISTINCT user_id, event_id % 50 AS s, event_type FROM events WHERE event_type <> 'click') GROUP BY ALL")
def dedup_filter_unknown(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    obs = e.select(F.col("user_id").alias("example_idx"), (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + 10).alias("end"), F.col("event_type").alias("leiden"), F.when(F.col("event_type") == "click", "nan").otherwise("x").alias("cluster_dbd"))
    return topics.count_table(obs)


KINDS = "CASE p_size % 5 WHEN 0 THEN 'gene is directly annotated' WHEN 1 THEN 'gene is similar to x' WHEN 2 THEN 'gene is orthologous to y' WHEN 3 THEN 'gene is orthologous to y which is similar to x' ELSE 'other' END"
ANNOT = f"a AS (SELECT p_brand AS motif_id, p_type AS gene_name, p_size / 50000.0 AS q, p_partkey % 100 / 100.0 AS i, {KINDS} AS d FROM part), f AS (SELECT DISTINCT motif_id, gene_name, d FROM a WHERE q <= 0.001 AND i >= 0.5)"


def annotation_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("motif_id"), F.col("p_type").alias("gene_name"), (F.col("p_size") / 50000.0).alias("motif_similarity_qvalue"), (F.col("p_partkey") % 100 / 100.0).alias("orthologous_identity"), F.expr(KINDS).alias("description"))


def _names(kind: str, column: str) -> str:
    return f"string_agg(gene_name, ', ' ORDER BY gene_name) FILTER (d = '{kind}') AS {column}"


WIDE = ", ".join(_names(k, c) for k, c in (("gene is directly annotated", "Direct_annot"), ("gene is similar to x", "Motif_similarity_annot"), ("gene is orthologous to y", "Orthology_annot"), ("gene is orthologous to y which is similar to x", "Motif_similarity_and_Orthology_annot")))


@query(f"WITH {ANNOT} SELECT motif_id, {WIDE} FROM f WHERE d <> 'other' GROUP BY motif_id")
def annot_categories(spark, sf_dir):
    return annotations.categorise(annotation_rows(spark, sf_dir), 0.001, 0.5)


@query(f"WITH {ANNOT}, t AS (SELECT DISTINCT p_type AS gene_name, {DBD_SQL}[length(p_type) % 7 + 1] AS dbd FROM part), n AS (SELECT motif_id, dbd, count(*) AS n FROM f JOIN t USING (gene_name) WHERE d <> 'other' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY motif_id ORDER BY n DESC, dbd) AS r FROM n) SELECT motif_id, dbd FROM r WHERE r = 1")
def motif_to_dbd(spark, sf_dir):
    factors = table(spark, sf_dir, "part").select(F.col("p_type").alias("hgnc_symbol")).distinct().withColumn("dbd", F.get(F.array(*map(F.lit, DBDS)), F.length("hgnc_symbol") % 7))
    return annotations.motif_to_dbd(annotations.categorise(annotation_rows(spark, sf_dir), 0.001, 0.5), factors)


@query(
    "WITH w AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t, event_type FROM events), a AS (SELECT event_id, user_id, t AS s, t + 3600 AS e FROM w WHERE event_type = 'click'), b AS (SELECT user_id, t - 1800 AS s, t + 1800 AS e FROM w WHERE event_type <> 'click') "
    "SELECT event_id, EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.s < a.e AND a.s < b.e AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.4 * (a.e - a.s)) AS found FROM a"
)
def interval_overlap_flag(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    a = e.where("event_type = 'click'").select("event_id", "user_id", F.col("t").alias("start"), (F.col("t") + 3600).alias("stop"))
    b = e.where("event_type <> 'click'").select("user_id", (F.col("t") - 1800).alias("start"), (F.col("t") + 1800).alias("stop"))
    return relational.overlap_flag(a, b, "user_id").select("event_id", "found")


@query("SELECT l_orderkey, l_linenumber, o_custkey * 1000 + l_linenumber AS g_start, o_custkey * 1000 + l_linenumber + CAST(l_quantity AS BIGINT) AS g_stop FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def genomic_coords(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("long").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("stop"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("chr1").alias("chrom"), (F.col("o_custkey") * 1000).alias("start"))
    return relational.genomic(s, r, "l_orderkey").select("l_orderkey", "l_linenumber", "g_start", "g_stop")


@query(
    "WITH r AS (SELECT o_orderkey, o_orderstatus AS chrom, o_custkey AS s, o_custkey + 101 + o_orderkey % 7 AS e FROM orders), m AS (SELECT o_orderkey, chrom, s + (e - s) // 2 AS m FROM r), z AS (SELECT o_orderstatus AS chrom, max(o_custkey) AS n FROM orders GROUP BY ALL) "
    "SELECT o_orderkey, m - 250 AS start, m + 251 AS stop FROM m JOIN z USING (chrom) WHERE m - 250 >= 0 AND m + 251 <= n"
)
def resize_region(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("chrom"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + 101 + F.col("o_orderkey") % 7).alias("stop"))
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("chrom")).agg(F.max("o_custkey").alias("chrom_size"))
    return relational.resize(o, 501, sizes).select("o_orderkey", "start", "stop")


@query("WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT c_nationkey, sum(n) OVER (ORDER BY c_nationkey) - n AS lo, sum(n) OVER (ORDER BY c_nationkey) AS hi FROM n) SELECT c_custkey, n_name AS cell_type FROM customer LEFT JOIN r ON c_custkey >= lo AND c_custkey < hi LEFT JOIN nation ON n_nationkey = r.c_nationkey")
def index_ranges(spark, sf_dir):
    sizes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ranges = relational.index_ranges(sizes, "c_nationkey", "n_name", "n")
    return relational.range_lookup(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", ranges, "n_name").select("c_custkey", F.col("n_name").alias("cell_type"))


@query("SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS value_z FROM events")
def zscore_samp(spark, sf_dir):
    return relational.zscore(table(spark, sf_dir, "events").select("event_id", "value"), ["value"]).select("event_id", F.round("value_z", 6).alias("value_z"))


@query("SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value_z FROM events")
def zscore_pop(spark, sf_dir):
    return relational.zscore(table(spark, sf_dir, "events").select("event_id", "value"), ["value"], sample=False).select("event_id", F.round("value_z", 6).alias("value_z"))


@query("SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value_scaled FROM events")
def minmax(spark, sf_dir):
    return relational.minmax(table(spark, sf_dir, "events").select("event_id", "value"), ["value"]).select("event_id", F.round("value_scaled", 6).alias("value_scaled"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in NUMBERS[:2] for b in NUMBERS[2:]))
def corr_matrix(spark, sf_dir):
    return relational.corr_matrix(table(spark, sf_dir, "lineitem"), NUMBERS[:2], NUMBERS[2:]).withColumn("corr", F.round("corr", 6))


PPM = f"{CELLS}, e AS (SELECT label, p, avg(exp(20 * v[1])) AS a, avg(exp(20 * v[2])) AS c, avg(exp(20 * v[3])) AS g, avg(exp(20 * v[4])) AS t FROM c GROUP BY ALL), m AS (SELECT label, p, a / (a + c + g + t) AS a, c / (a + c + g + t) AS c, g / (a + c + g + t) AS g, t / (a + c + g + t) AS t FROM e)"
IC = PPM + ", i AS (SELECT *, " + " + ".join(f"{b} * log2({b} + 1e-3)" for b in "acgt") + " - (" + " + ".join(f"{x} * log2({x}::DOUBLE)" for x in A.BACKGROUND) + ") AS ic FROM m)"


def label_ppm(spark, sf_dir):
    """(label, ppm): normalised mean weights of the vectors of a label, as (16, 4)."""
    rows = examples(spark, sf_dir).select(F.col("label").alias("leiden"), F.transform(A.transpose(F.col("contrib")), lambda r: F.transform(r, lambda x: F.exp(20 * x))).alias("w"))
    return patterns.element_mean(rows, "w").select(F.col("leiden").alias("label"), A.normalise_ppm(F.col("w")).alias("ppm"))


@query(f"WITH {PPM} SELECT label, CAST(p AS INT) AS pos, round(a, 6) AS a, round(c, 6) AS c, round(g, 6) AS g, round(t, 6) AS t FROM m")
def ppm_normalize(spark, sf_dir):
    return label_ppm(spark, sf_dir).select("label", F.posexplode("ppm").alias("pos", "r")).select("label", "pos", *(F.round(F.get("r", F.lit(i)), 6).alias(b) for i, b in enumerate("acgt")))


@query(f"WITH {IC} SELECT label, CAST(p AS INT) AS pos, round(ic, 6) AS ic FROM i")
def info_content(spark, sf_dir):
    return label_ppm(spark, sf_dir).select("label", F.posexplode(A.information_content(F.col("ppm"))).alias("pos", "ic")).withColumn("ic", F.round("ic", 6))


@query(f"WITH {IC}, k AS (SELECT label, p, ic >= 0.4 AS b, lead(ic >= 0.4) OVER (PARTITION BY label ORDER BY p) AS n FROM i), x AS (SELECT label, min(p) FILTER (b <> n) AS s, max(p) FILTER (b <> n) + 1 AS e FROM k GROUP BY ALL) SELECT label, CAST(coalesce(s, 0) AS INT) AS start, CAST(coalesce(e, 0) AS INT) AS stop FROM x")
def ic_trim(spark, sf_dir):
    t = label_ppm(spark, sf_dir).select("label", A.ic_trim(A.information_content(F.col("ppm")), 0.4).alias("t"))
    return t.select("label", F.col("t.start").cast("int").alias("start"), F.col("t.stop").cast("int").alias("stop"))


LETTERS = "['A', 'C', 'G', 'T'][list_position([a, c, g, t], greatest(a, c, g, t))]"


@query(f"WITH {PPM} SELECT label, string_agg({LETTERS}, '' ORDER BY p) AS consensus, string_agg(translate({LETTERS}, 'ACGT', 'TGCA'), '' ORDER BY p DESC) AS reverse_consensus FROM m GROUP BY label")
def consensus_string(spark, sf_dir):
    return label_ppm(spark, sf_dir).select("label", A.consensus(F.col("ppm")).alias("consensus"), A.consensus(A.reverse_complement(F.col("ppm"))).alias("reverse_consensus"))


@query(f"WITH {PPM} SELECT label, CAST(15 - p AS INT) AS pos, round(t, 6) AS a, round(g, 6) AS c, round(c, 6) AS g, round(a, 6) AS t FROM m")
def revcomp(spark, sf_dir):
    return label_ppm(spark, sf_dir).select("label", F.posexplode(A.reverse_complement(F.col("ppm"))).alias("pos", "r")).select("label", "pos", *(F.round(F.get("r", F.lit(i)), 6).alias(b) for i, b in enumerate("acgt")))


def event_hits(spark, sf_dir):
    """Events of a user as hits of a region 500 wide."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seqlet_id"), F.col("user_id").alias("example_idx"), (F.col("event_id") % 480).alias("start"), (F.col("event_id") % 480 + 12).alias("end"), F.col("value").alias("attribution"), F.col("event_type").alias("cluster_dbd"))


@query("WITH h AS (SELECT event_id AS seqlet_id, event_id % 480 - 100 AS s, event_id % 480 - 88 AS e FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND abs(value) >= 10) SELECT seqlet_id, greatest(s, 0) AS start, least(e, 250) AS stop FROM h WHERE e > 0 AND s < 250")
def region_hits_zoom(spark, sf_dir):
    hits = event_hits(spark, sf_dir)
    return plotdata.region_hits(hits, 500, hits.agg(F.min("example_idx")).first()[0], zoom=(100, 350), least=10).select("seqlet_id", "start", F.col("end").alias("stop"))


@query(
    "WITH RECURSIVE h AS (SELECT user_id, event_id, event_id % 480 + 6.0::DOUBLE AS c, event_type AS dbd, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 480, event_id) AS i FROM events WHERE event_type IS NOT NULL), "
    "r AS (SELECT user_id, 0::BIGINT AS i, CAST([] AS STRUCT(dbd VARCHAR, c DOUBLE)[]) AS kept, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS y FROM (SELECT DISTINCT user_id FROM h) "
    "UNION ALL SELECT h.user_id, h.i, CASE WHEN near THEN kept ELSE list_append(kept, struct_pack(dbd := h.dbd, c := h.c)) END, CASE WHEN near THEN NULL ELSE h.event_id END, CASE WHEN len(kept) % 2 = 0 THEN -0.2 ELSE 0.2 END "
    "FROM (SELECT r.*, len(list_filter(r.kept, lambda k: k.dbd = g.dbd AND abs(k.c - g.c) < 25)) > 0 AS near FROM r JOIN h g ON g.user_id = r.user_id AND g.i = r.i + 1) r JOIN h ON h.user_id = r.user_id AND h.i = r.i + 1) "
    "SELECT user_id AS example_idx, event_id AS seqlet_id, y FROM r WHERE event_id IS NOT NULL"
)
def label_dedupe(spark, sf_dir):
    return plotdata.dedupe_labels(event_hits(spark, sf_dir))


PATTERN_ROWS = "g AS (SELECT p_type AS leiden, p_brand AS dbd, avg(p_retailprice) AS mean_ic, count(*) AS n_seqlets FROM part GROUP BY ALL)"


def part_patterns(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("leiden"), F.col("p_brand").alias("dbd")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean_ic"), F.count("*").alias("n_seqlets"))


@query(f"WITH {PATTERN_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY dbd ORDER BY round(mean_ic, 6) DESC, leiden) AS r FROM g) SELECT dbd, leiden FROM r WHERE r = 1")
def representative_pattern(spark, sf_dir):
    return patterns.representatives(part_patterns(spark, sf_dir))


@query(f"WITH {PATTERN_ROWS} SELECT leiden, dbd, n_seqlets FROM g")
def sort_patterns(spark, sf_dir):
    return patterns.sort_patterns(part_patterns(spark, sf_dir), "n_seqlets").select("leiden", "dbd", "n_seqlets")


@query("SELECT l_returnflag, round(100.0 * count(*) FILTER (l_linestatus <> 'O') / count(*), 6) AS percent FROM lineitem GROUP BY l_returnflag")
def share_sorted(spark, sf_dir):
    return relational.share_sorted(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_linestatus") == "O").withColumn("percent", F.round("percent", 6))


TOPIC = f"t AS (SELECT o_custkey % 40 AS cluster, CAST(1 + o_orderkey % 6 AS INT) AS topic, sum(CAST(round(o_totalprice) AS BIGINT)) AS n FROM orders GROUP BY ALL), w AS (SELECT cluster, topic, n / sum(n) OVER (PARTITION BY cluster) AS prob FROM t), d AS (SELECT {DBD_SQL}[cluster % 7 + 1] AS dbd, topic, round(avg(prob), 6) AS prob FROM w GROUP BY ALL)"


def order_topics(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("cluster"), (1 + F.col("o_orderkey") % 6).cast("int").alias("topic")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("n"))
    prob = n.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))).drop("n")
    names = spark.range(40).select(F.col("id").alias("cluster"), F.get(F.array(*map(F.lit, DBDS)), (F.col("id") % 7).cast("int")).alias("dbd"))
    return topics.dbd_topic(prob, names).withColumn("prob", F.round("prob", 6))


@query(f"WITH {TOPIC} SELECT dbd, topic, prob FROM d")
def topic_dbd_mean(spark, sf_dir):
    return order_topics(spark, sf_dir)


@query(f"WITH {TOPIC} SELECT topic, count(*) FILTER (prob > 0.17) AS n_active FROM d GROUP BY topic")
def topic_activity(spark, sf_dir):
    return topics.topic_activity(order_topics(spark, sf_dir), 0.17)


@query(f"WITH {TOPIC}, r AS (SELECT *, row_number() OVER (PARTITION BY dbd ORDER BY prob DESC, topic) AS r FROM d) SELECT dbd, topic FROM r WHERE r = 1")
def topic_argmax(spark, sf_dir):
    return topics.best_topic(order_topics(spark, sf_dir))


@query("SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y FROM embeddings GROUP BY label")
def centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.get(vector(), F.lit(0)).alias("x"), F.get(vector(), F.lit(1)).alias("y"))
    return plotdata.centroids(e, "label").select("label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbor, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor) AS r FROM p) SELECT vec_id, neighbor, round(d, 6) AS distance, CAST(r AS INT) AS rank FROM r WHERE r <= 5"
)
def knn(spark, sf_dir):
    return cluster.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 6))


@query()
def pca(spark, sf_dir):
    return cluster.pca(table(spark, sf_dir, "embeddings").withColumn("v", vector()), "vec_id", "v", 10)


@query()
def leiden(spark, sf_dir):
    return cluster.communities(cluster.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", 1.0)


def motif_set(spark: SparkSession, sf_dir: str) -> list[np.ndarray]:
    """A motif collection made of the vectors: mean weights of up to 400 groups of them, a (4, 6) to (4, 13) matrix each."""
    group, width = F.concat("label", F.lit("."), F.col("vec_id") % 40), 6 + F.col("vec_id") % 8
    rows = examples(spark, sf_dir).withColumnRenamed("example_idx", "vec_id")
    weights = rows.select(group.alias("leiden"), F.transform(F.slice(A.transpose(F.col("contrib")), 1, width.cast("int")), lambda r: F.transform(r, lambda x: F.exp(20 * x))).alias("w"))
    means = patterns.element_mean(weights, "w").select("leiden", A.transpose(A.normalise_ppm(F.col("w"))).alias("ppm"))
    return [np.array(r["ppm"], float) for r in means.orderBy("leiden").collect()]  # a reference set of bounded size


@query()
def motif_similarity(spark, sf_dir):
    found = seqlets.extract_seqlets(examples_wide(spark, sf_dir), 0.1)
    return align.similarity(found, motif_set(spark, sf_dir))


def examples_wide(spark, sf_dir):
    """Examples of 64 positions: the vector under a base that follows from its sign and place."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_idx"), F.col("label").cast("string").alias("leiden"), vector().alias("x"))
    oh = A.indicators(F.transform("x", lambda x, i: ((i + F.floor(F.abs(x) * 50)) % 4).cast("int")), [0, 1, 2, 3])
    weaker = F.transform("x", lambda x: x * 0.9)
    contrib = F.array(weaker, F.col("x"), weaker, F.col("x"))
    return e.select("example_idx", "leiden", contrib.alias("contrib"), oh.alias("oh"))


@query()
def seqlet_patterns(spark, sf_dir):
    wide = examples_wide(spark, sf_dir)
    obs = seqlets.extract_seqlets(wide, 0.1).join(wide.select("example_idx", "leiden"), "example_idx")
    return patterns.create_patterns(obs, wide)[0].select("leiden", "n_seqlets", "mean_ic", A.consensus(F.col("ppm")).alias("consensus"))


def event_counts(spark, sf_dir):
    return relational.crosstab(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("region_id"), F.col("event_type").alias("cluster")), "region_id", "cluster")


@query()
def lda(spark, sf_dir):
    return topics.region_topic(topics.fit_topics(event_counts(spark, sf_dir), [4]), 4)


@query()
def topic_eval(spark, sf_dir):
    return topics.evaluate(topics.fit_topics(event_counts(spark, sf_dir), list(topics.K_VALUES)))


@query()
def tsne(spark, sf_dir):
    """Points of all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return cluster.embed(e, "vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id")


@query("SELECT region_id, cluster, n FROM (SELECT o_orderpriority AS region_id, o_orderstatus AS cluster, count(*) AS n FROM orders GROUP BY ALL)")
def dbd_heatmap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("region_id"), F.col("o_orderstatus").alias("cluster"))
    return plotdata.dbd_heatmap(o, "region_id", "cluster")[0]


@query(
    "WITH s AS (SELECT event_id, user_id AS chrom, event_id % 480 - 10 AS lo, event_id % 480 + 22 AS hi FROM events WHERE event_type = 'click'), b AS (SELECT user_id AS chrom, event_id % 480 AS s, event_id % 480 + 12 AS e, value FROM events WHERE event_type <> 'click'), "
    "m AS (SELECT s.event_id, sum(value * (least(hi, e) - greatest(greatest(lo, 0), b.s))) / sum(least(hi, e) - greatest(greatest(lo, 0), b.s)) AS signal FROM s JOIN b ON s.chrom = b.chrom AND least(hi, e) > greatest(greatest(lo, 0), b.s) GROUP BY ALL) SELECT s.event_id, round(signal + 1e-7, 4) AS signal FROM s LEFT JOIN m USING (event_id)"
)
def signal_mean(spark, sf_dir):
    h = event_hits(spark, sf_dir).withColumnsRenamed({"example_idx": "chrom", "end": "stop", "attribution": "value"})
    spans = h.where("cluster_dbd = 'click'").select("seqlet_id", "chrom", "start", "stop")
    signal = h.where("cluster_dbd <> 'click'").select("chrom", "start", "stop", "value")
    return relational.signal_mean(spans, signal, 10, 100).select(F.col("seqlet_id").alias("event_id"), F.round(F.col("signal") + 1e-7, 4).alias("signal"))
