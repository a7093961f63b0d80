"""More registered queries, one for each operator that ``queries`` has none for, with their SQL.

Readers and writers are run over files made of the given tables: what is read back must be what the tables hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import align, annotations, cluster, dataset, patterns, relational, seqlets, topics
from tessera.plans import plotdata
from tessera.plans.queries import ANNOT, CELLS, DBD_SQL, DBDS, IC, LETTERS, PATTERN_ROWS, PPM, SPANNED, TOPIC, WIDE, annotation_rows, event_hits, examples, label_ppm, matrix, micro, micro_vectors, order_topics, part_patterns, query, table, vector
from tessera.shared import shared_dir
from tessera.sources import readers


in_order = relational.in_order


def per_base(m, *keys) -> list:
    """Columns pos, a, c, g, t of an (L, 4) matrix."""
    return [*keys, F.posexplode(m).alias("pos", "_r")]


def spell(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "pos", *(F.round(F.get("_r", F.lit(i)), 6).alias(b) for i, b in enumerate("acgt")))


# ---------------------------------------------------------------- sources and sinks

COUNTED = "k AS (SELECT vec_id, label, p, CAST(floor(abs(v[1]) * 1000) AS INT) + 1 AS a, CAST(floor(abs(v[2]) * 1000) AS INT) + 1 AS c, CAST(floor(abs(v[3]) * 1000) AS INT) + 1 AS g, CAST(floor(abs(v[4]) * 1000) AS INT) + 1 AS t FROM c)"


@query(
    f"WITH {CELLS}, {COUNTED}, n AS (SELECT DISTINCT vec_id, 'm' || (vec_id % 300) AS motif_name, 'metacluster_' || label AS cluster_name FROM k), w AS (SELECT *, row_number() OVER (PARTITION BY motif_name ORDER BY cluster_name DESC, vec_id DESC) AS r FROM n) "
    "SELECT motif_name, cluster_name, CAST(p AS INT) AS pos, round(a / (a + c + g + t), 6) AS a, round(c / (a + c + g + t), 6) AS c, round(g / (a + c + g + t), 6) AS g, round(t / (a + c + g + t), 6) AS t FROM w JOIN k USING (vec_id) WHERE r = 1"
)
def motif_files(spark, sf_dir):
    """Counts as motif files; of motifs with one name the last stays."""
    m = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id") % 300).alias("motif_name"), F.concat(F.lit("metacluster_"), "label").alias("cluster_name"), F.col("vec_id").alias("at"), F.transform(matrix(vector()), lambda r: F.transform(r, lambda x: F.floor(F.abs(x) * 1000) + 1)).alias("ppm"))
    folder = shared_dir(spark, "motifs")
    readers.write_motifs(m, folder)
    return spell(readers.read_motifs(spark, folder).select(*per_base(A.transpose(F.col("ppm")), "motif_name", "cluster_name")), "motif_name", "cluster_name")


@query("SELECT DISTINCT 'm' || (vec_id % 300) AS motif_name FROM embeddings WHERE vec_id % 300 IN (1, 7, 299)")
def motif_name_filter(spark, sf_dir):
    """Names are filtered after the files are read; unknown names are ignored."""
    m = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id") % 300).alias("motif_name"), F.concat(F.lit("f"), "label").alias("cluster_name"), F.col("vec_id").alias("at"), F.array(*(F.array(F.lit(1), F.lit(2)) for _ in range(4))).alias("ppm"))
    folder = shared_dir(spark, "motifs")
    readers.write_motifs(m, folder)
    return readers.read_motifs(spark, folder, ["m1", "m7", "m299", "unknown"]).select("motif_name")


KINDS_SQL = ANNOT.split(", f AS")[0]


@query(f"WITH {KINDS_SQL} SELECT motif_id, gene_name, CAST(q AS DOUBLE) AS motif_similarity_qvalue, CAST(i AS DOUBLE) AS orthologous_identity, d AS description FROM a")
def annotation_file(spark, sf_dir):
    """Five columns of a wider annotation table."""
    rows = annotation_rows(spark, sf_dir).select(F.col("motif_id").alias("#motif_id"), F.lit("x").alias("motif_name"), "gene_name", "motif_similarity_qvalue", F.lit(None).cast("string").alias("similar_motif_id"), "orthologous_identity", "description")
    path = shared_dir(spark, "annotations")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_annotations(spark, path)


@query(f"SELECT DISTINCT p_type AS hgnc_symbol, CASE WHEN length(p_type) % 8 = 7 THEN NULL ELSE {DBD_SQL}[length(p_type) % 8 + 1] END AS dbd FROM part")
def human_tf_file(spark, sf_dir):
    """The text "nan" is no domain."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("HGNC symbol"), F.length("p_type").alias("n")).distinct()
    rows = rows.select("HGNC symbol", F.lit("other, \"quoted\"").alias("Name"), F.get(F.array(*map(F.lit, [*DBDS, "nan"])), F.col("n") % 8).alias("DBD"))
    path = shared_dir(spark, "human-tf")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_human_tf(spark, path)


@query("SELECT 'chr' || user_id AS chrom, event_id % 480 AS start, event_id % 480 + 12 AS stop, count(*) AS n FROM events GROUP BY ALL")
def bed_files(spark, sf_dir):
    """S6, S7."""
    hits = event_hits(spark, sf_dir).select(F.concat(F.lit("chr"), "example_idx").alias("chrom"), "start", F.col("end").alias("stop"), F.lit("+").alias("strand"))
    path = shared_dir(spark, "bed")
    readers.write_bed(hits, path, ["chrom", "start", "stop", "strand"])
    return readers.read_bed(spark, path).groupBy("chrom", "start", "stop").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'chr' || user_id AS chrom, event_id % 480 AS start, rank() OVER (ORDER BY 'chr' || user_id, event_id % 480) - 1 AS place FROM events")
def bed_order(spark, sf_dir):
    """Lines in the order that they stand in the files: a place of the file is the number of lines before it."""
    hits = event_hits(spark, sf_dir).select(F.concat(F.lit("chr"), "example_idx").alias("chrom"), "start", F.col("end").alias("stop"), F.lit("+").alias("strand"))
    path = shared_dir(spark, "bed")
    readers.write_bed(hits, path, ["chrom", "start", "stop", "strand"])
    lines = spark.read.text(path).select("value", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    parts = F.split("value", "\t")
    placed = in_order(lines.orderBy("file_name", "file_block_start", "at").select(parts[0].alias("chrom"), parts[1].cast("long").alias("start")))
    return placed.groupBy("chrom", "start").agg(F.min("position").alias("place"))


@query("SELECT vec_id AS seqlet_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, 'motif_' || (list_position(embedding, list_max(embedding)) - 1) AS motif_name FROM embeddings")
def container_files(spark, sf_dir):
    """A container is made, saved, loaded, and joined with its motifs."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seqlet_id"), "label", matrix(vector()).alias("m"), vector().alias("sim"))
    made = dataset.create(e.select("seqlet_id", "label"), e.select("seqlet_id", "sim"), 64, matrices=e.select("seqlet_id", F.col("m").alias("seqlet_matrix")))
    path = shared_dir(spark, "container")
    made.save(path)
    back = dataset.SeqletDataset.load(spark, path)
    best = back.similarity.select("seqlet_id", A.first_argmax(F.col("sim")).alias("motif_idx"))
    return back.obs.join(best, "seqlet_id").join(back.var, "motif_idx").select("seqlet_id", "label", F.round(A.total(F.flatten("seqlet_matrix")), 6).alias("total"), "motif_name")


REGISTRY = "['flybase v8', 'drosophila_melanogaster v9', 'homo_sapiens v9', 'mgi v9', 'gallus_gallus v10nr_clust', 'flybase v10nr_clust', 'hgnc v10nr_clust', 'mus_musculus v10nr_clust']"
SHORT = "replace(replace(replace(replace(split_part(k, ' ', 1), 'drosophila_melanogaster', 'flybase'), 'homo_sapiens', 'hgnc'), 'gallus_gallus', 'chicken'), 'mus_musculus', 'mgi')"


@query(f"WITH p AS (SELECT p_partkey, {REGISTRY}[p_partkey % 8 + 1] AS k FROM part) SELECT p_partkey, 'x/motifs-' || split_part(k, ' ', 2) || '-nr.' || {SHORT} || '-m0.001-o0.0.tbl' AS path, CASE WHEN split_part(k, ' ', 2) = 'v9' THEN 'y/motifs-v9-nr.' || {SHORT} || '-m0.001-o0.0.tbl' END AS usual FROM p")
def annotation_registry(spark, sf_dir):
    """The files of species (short or long names) and versions that rows of a table name; v9 is the usual version."""
    k = F.get(F.array(*map(F.lit, [x.strip("' ") for x in REGISTRY.strip("[]").split(",")])), (F.col("p_partkey") % 8).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split_part(k, F.lit(" "), F.lit(1)).alias("species"), F.split_part(k, F.lit(" "), F.lit(2)).alias("version"))
    usual = readers.annotation_paths(rows.where("version = 'v9'").select("p_partkey", "species"), "species", folder="y").select("p_partkey", F.col("path").alias("usual"))
    return readers.annotation_paths(rows, "species", "version", "x").join(usual, "p_partkey", "left").select("p_partkey", "path", "usual")


SEQUENCE = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"SELECT p_partkey, rpad(repeat('N', CAST(greatest(5 - p_partkey % 40, 0) AS INT)) || substring({SEQUENCE}, greatest(p_partkey % 40 - 5, 0) + 1, CAST(least(12, 12 + p_partkey % 40 - 5) AS INT)), 12, 'N') AS bases FROM part")
def fasta_one_hot(spark, sf_dir):
    """Regions of sequences in a FASTA file; positions outside have no base."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("c"), "p_partkey").alias("chrom"), (F.col("p_partkey") % 40 - 5).alias("start"))
    text = F.concat(F.lit(">"), F.col("chrom"), F.lit(" a part\n"), F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"))
    path = shared_dir(spark, "fasta")
    p.select(text.alias("value")).write.text(path)
    got = readers.fetch_one_hot(p.withColumn("stop", F.col("start") + 12), readers.read_fasta(spark, path))
    return got.select("p_partkey", A.consensus(A.transpose(F.col("oh")), instance=True).alias("bases"))


@query(
    "WITH p AS (SELECT p_partkey, 'c' || (p_partkey % 7) AS chrom, p_partkey // 7 AS at FROM part WHERE p_partkey % 7 < 6), "
    "s AS (SELECT chrom, string_agg(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY p_partkey) AS bases FROM p GROUP BY chrom), "
    "r AS (SELECT p_partkey, 'c' || (p_partkey % 7) AS chrom, p_partkey * 3 - 20 AS start, p_partkey * 3 - 20 + 40 + p_partkey % 60 AS stop FROM part) "
    "SELECT p_partkey, rpad(repeat('N', CAST(least(greatest(-start, 0), stop - start) AS INT)) || coalesce(substring(bases, greatest(start, 0) + 1, CAST(greatest(stop - greatest(start, 0), 0) AS INT)), ''), CAST(stop - start AS INT), 'N') AS bases FROM r LEFT JOIN s USING (chrom)"
)
def fasta_regions(spark, sf_dir):
    """Long records, read by ranges of bytes and cut to chunks that regions lie across; regions off their record are N."""
    from tessera.sources import sequences

    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("c"))
    lines = p.where("c < 6").select("c", "p_partkey", F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("value"))
    heads = p.where("c < 6").select("c").distinct().select("c", F.lit(-1).cast("long").alias("p_partkey"), F.concat(F.lit(">c"), "c", F.lit(" of parts")).alias("value"))
    path = shared_dir(spark, "genome")
    # A file per record, its lines in order.
    lines.withColumn("p_partkey", F.col("p_partkey").cast("long")).unionByName(heads).repartition("c").sortWithinPartitions("c", "p_partkey").select("value").write.text(path)
    chunks = sequences.read_fasta(spark, path, width=64, part_bytes=4096)
    at = F.col("p_partkey") * 3 - 20
    regions = p.select("p_partkey", F.concat(F.lit("c"), "c").alias("chrom"), at.alias("start"), (at + 40 + F.col("p_partkey") % 60).alias("stop"))
    return sequences.fetch(regions, chunks, width=64).select("p_partkey", F.col("sequence").alias("bases"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, count(*) OVER () AS n_rows FROM embeddings")
def array_files(spark, sf_dir):
    """Vectors as arrays in npz files, read by ranges of rows; each row has a number of its own through all files."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label"), "label").alias("name"), F.concat(F.array(F.col("vec_id").cast("double")), vector()).alias("x"))
    path = shared_dir(spark, "arrays")
    readers.write_npz(rows, path, "name")
    back = readers.read_npz(spark, path, part_bytes=16 << 10)
    numbered = back.crossJoin(F.broadcast(back.agg(F.count_distinct("example_idx").alias("n_rows"))))
    return numbered.select(F.get("contrib", F.lit(0)).cast("long").alias("vec_id"), F.round(A.total(F.slice("contrib", 2, 64)), 6).alias("total"), "n_rows")


@query("WITH n AS (SELECT 'T' || label AS cell_type, 'label' || label || '.npz' AS f, count(*) AS n FROM embeddings GROUP BY ALL), r AS (SELECT cell_type, sum(n) OVER (ORDER BY f) AS hi, n FROM n) SELECT replace(cell_type, 'T', '') AS cell_type, CAST(hi - n AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM r")
def cell_type_files(spark, sf_dir):
    """Which rows of a folder of arrays are of which cell type, from the files' names and headers."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label"), "label").alias("name"), vector().alias("x"))
    path = shared_dir(spark, "arrays")
    readers.write_npz(rows, path, "name")
    return readers.cell_type_mapping(spark, path, "label{cell_type}.npz")


@query(
    "WITH s AS (SELECT event_id, user_id AS chrom, event_id % 480 - 10 AS lo, event_id % 480 + 22 AS hi FROM events WHERE event_type = 'click'), b AS (SELECT user_id AS chrom, event_id % 480 AS s, event_id % 480 + 12 AS e, CAST(value AS FLOAT)::DOUBLE AS value FROM events WHERE event_type <> 'click'), "
    "m AS (SELECT s.event_id, sum(value * (least(hi, e) - greatest(greatest(lo, 0), b.s))) / sum(least(hi, e) - greatest(greatest(lo, 0), b.s)) AS signal FROM s JOIN b ON s.chrom = b.chrom AND least(hi, e) > greatest(greatest(lo, 0), b.s) GROUP BY ALL) SELECT s.event_id, round(signal + 1e-7, 4) AS signal FROM s LEFT JOIN m USING (event_id)"
)
def signal_files(spark, sf_dir):
    """As signal_mean, with the signal in bigWig files."""
    h = event_hits(spark, sf_dir).select("seqlet_id", F.concat(F.lit("user"), "example_idx").alias("chrom"), "start", F.col("end").alias("stop"), F.col("attribution").alias("value"), "cluster_dbd")
    path = shared_dir(spark, "signal")
    readers.write_signal(h.where("cluster_dbd <> 'click'"), path)
    spans = h.where("cluster_dbd = 'click'").select("seqlet_id", "chrom", "start", "stop")
    return relational.signal_mean(spans, readers.read_signal(spark, path), 10, 100).select(F.col("seqlet_id").alias("event_id"), F.round(F.col("signal") + 1e-7, 4).alias("signal"))


ONE_HOT = f"{CELLS}, o AS (SELECT vec_id, string_agg(['A', 'C', 'G', 'T'][list_position(v, list_max(v))], '' ORDER BY p) AS bases FROM c GROUP BY vec_id)"


def cut_places(spark, sf_dir) -> DataFrame:
    """A made-up seqlet of seven positions for each example."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seqlet_id"), F.col("vec_id").alias("example_idx"), (F.col("vec_id") % 9).cast("int").alias("start"), (F.col("vec_id") % 9 + 7).cast("int").alias("end"))


@query(f"WITH {ONE_HOT} SELECT vec_id AS example_idx, CASE WHEN vec_id % 2 = 1 THEN reverse(translate(substring(bases, vec_id % 9 + 1, 7), 'ACGT', 'TGCA')) ELSE substring(bases, vec_id % 9 + 1, 7) END AS bases FROM o")
def stored_instances(spark, sf_dir):
    """Instances, reversed for odd examples, that equal their region."""
    e = examples(spark, sf_dir)
    here = A.transpose(A.slice_columns(F.col("oh"), F.col("start"), F.col("end")))
    odd = F.col("example_idx") % 2 == 1
    s = cut_places(spark, sf_dir).join(e, "example_idx").select("example_idx", "start", "end", odd.alias("is_revcomp"), F.when(odd, A.reverse_complement(here)).otherwise(here).alias("instance"))
    return readers.read_modisco(s, e).select("example_idx", A.consensus(F.col("instance"), instance=True).alias("bases"))


# ---------------------------------------------------------------- projections and filters

@query(f"WITH {CELLS} SELECT vec_id AS example_idx, CAST(p - vec_id % 9 AS INT) AS pos, round(v[1], 6) AS a, round(v[2], 6) AS c, round(v[3], 6) AS g, round(v[4], 6) AS t FROM c WHERE p >= vec_id % 9 AND p < vec_id % 9 + 7")
def seqlet_slices(spark, sf_dir):
    """The arrays of a seqlet's example, and its slice."""
    s = seqlets.with_example_arrays(cut_places(spark, sf_dir), examples(spark, sf_dir))
    return spell(s.select(*per_base(A.transpose(A.slice_columns(F.col("example_contrib"), F.col("start"), F.col("end"))), "example_idx")), "example_idx")


@query(f"WITH {CELLS} SELECT vec_id AS example_idx, CAST(p - 5 AS INT) AS pos, round(v[1], 6) AS a, round(v[2], 6) AS c, round(v[3], 6) AS g, round(v[4], 6) AS t FROM c WHERE p >= 5 AND p < 11")
def centre_crops(spark, sf_dir):
    """P16."""
    return spell(examples(spark, sf_dir).select(*per_base(A.transpose(A.center_crop(F.col("contrib"), 6)), "example_idx")), "example_idx")


@query(
    f"WITH {CELLS}, s AS (SELECT * FROM c WHERE p >= vec_id % 9 AND p < vec_id % 9 + 7), t AS (SELECT vec_id, max(list_max(list_transform(v, lambda x: abs(x)))) AS top, sign(round(sum(list_max(v)), 9)) AS s FROM s GROUP BY vec_id) "
    "SELECT vec_id AS seqlet_id, CAST(p - vec_id % 9 AS INT) AS pos, round(t.s * v[1] / top, 6) AS a, round(t.s * v[2] / top, 6) AS c, round(t.s * v[3] / top, 6) AS g, round(t.s * v[4] / top, 6) AS t FROM s JOIN t USING (vec_id)"
)
def cut_matrices(spark, sf_dir):
    """The matrices of given seqlets."""
    return spell(seqlets.cut_matrices(cut_places(spark, sf_dir), examples(spark, sf_dir)).select(*per_base(A.transpose(F.col("seqlet_matrix")), "seqlet_id")), "seqlet_id")


@query("SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'nan' AND event_type = 'click'")
def noise_filter(spark, sf_dir):
    """P13."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return relational.without_noise(relational.without_noise(e, "event_type"), "event_type", "click")


@query("SELECT event_id, event_id % 2000 AS relative FROM events")
def relative_index(spark, sf_dir):
    """P17."""
    return relational.relative_index(table(spark, sf_dir, "events").select("event_id"), "event_id", 2000)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END || '.' || substring(o_orderpriority, 1, 1) AS o_orderstatus FROM orders")
def renamed_labels(spark, sf_dir):
    """P19."""
    return relational.relabel(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": "final", "O": "open"}, F.substring("o_orderpriority", 1, 1)).select("o_orderkey", "o_orderstatus")


@query("SELECT round(value, 6) AS x, event_id AS leiden, CASE event_type WHEN 'click' THEN 'Unknown' WHEN 'view' THEN 'Unknown' ELSE event_type END AS color FROM events")
def tsne_points(spark, sf_dir):
    """V1, P18: "nan" and null are Unknown."""
    kind = F.when(F.col("event_type") == "click", "nan").when(F.col("event_type") != "view", F.col("event_type"))
    e = table(spark, sf_dir, "events").select(F.round("value", 6).alias("x"), F.lit(0.0).alias("y"), F.col("event_id").alias("leiden"), kind.alias("cluster_dbd"))
    return plotdata.tsne_points(e).select("x", "leiden", "color")


# ---------------------------------------------------------------- joins

TFS = f"t AS (SELECT DISTINCT p_type AS gene_name, {DBD_SQL}[length(p_type) % 7 + 1] AS dbd FROM part), n AS (SELECT motif_id, dbd, count(*) AS n FROM f JOIN t USING (gene_name) WHERE d <> 'other' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY motif_id ORDER BY n DESC, dbd) AS r FROM n)"


@query(f"WITH {ANNOT}, {TFS}, w AS (SELECT motif_id, {WIDE} FROM f WHERE d <> 'other' GROUP BY motif_id), m AS (SELECT DISTINCT p_name AS motif_name, p_brand AS cluster_name FROM part) SELECT motif_name, cluster_name, Direct_annot, Orthology_annot, dbd FROM m LEFT JOIN w ON w.motif_id = cluster_name LEFT JOIN (SELECT motif_id, dbd FROM r WHERE r = 1) x ON x.motif_id = cluster_name")
def motif_annotations(spark, sf_dir):
    """By the name of the motif's file; motifs that nothing is known of stay."""
    known = annotations.categorise(annotation_rows(spark, sf_dir), 0.001, 0.5)
    factors = table(spark, sf_dir, "part").select(F.col("p_type").alias("hgnc_symbol")).distinct().withColumn("dbd", F.get(F.array(*map(F.lit, DBDS)), F.length("hgnc_symbol") % 7))
    motifs = table(spark, sf_dir, "part").select(F.col("p_name").alias("motif_name"), F.col("p_brand").alias("cluster_name")).distinct()
    return annotations.attach(motifs, known, annotations.motif_to_dbd(known, factors), "cluster").select("motif_name", "cluster_name", "Direct_annot", "Orthology_annot", "dbd")


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM n) SELECT event_id, r.event_type AS cluster_dbd FROM events LEFT JOIN r ON events.user_id = r.user_id AND r = 1")
def cluster_dbd(spark, sf_dir):
    """The most frequent domain comes back to every seqlet of its cluster."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("leiden"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("seqlet_dbd"))
    return cluster.cluster_dbd(e).select("event_id", "cluster_dbd")


@query(f"WITH {CELLS}, o AS (SELECT vec_id, string_agg(CAST(list_position(v, list_max(v)) AS VARCHAR), '' ORDER BY p) AS k FROM c WHERE p < 3 GROUP BY vec_id), x AS (SELECT k, max(vec_id) FILTER (vec_id % 3 = 0) AS last FROM o GROUP BY k) SELECT vec_id AS example_idx, CASE WHEN last IS NULL THEN NULL ELSE 'region ' || last END AS region_name FROM o JOIN x USING (k)")
def sequence_regions(spark, sf_dir):
    """By encoded sequence; of equal ones the last."""
    e = examples(spark, sf_dir).select("example_idx", A.slice_columns(F.col("oh"), F.lit(0), F.lit(3)).alias("oh"))
    right = e.where("example_idx % 3 = 0").withColumn("region_name", F.concat(F.lit("region "), "example_idx")).withColumnRenamed("example_idx", "at")
    return relational.sequence_join(e, right, "at", "region_name").select("example_idx", "region_name")


@query("SELECT c_custkey, c_acctbal, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey")
def topics_beside_predictions(spark, sf_dir):
    """J16."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return relational.beside(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), n, "c_custkey")


@query("SELECT o_custkey AS region_id, min(split_part(o_orderpriority, '-', 1)) AS label FROM orders GROUP BY ALL")
def region_labels(spark, sf_dir):
    """J17."""
    return relational.region_label(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "region_id"), "region_id", "o_orderpriority", "-")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events WHERE event_type <> 'click' GROUP BY ALL")
def first_rows(spark, sf_dir):
    """J18, A15, A28."""
    e = table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_type") != "click", F.col("event_type")))
    return relational.first_by(e, "user_id", "event_type", "event_id")


@query("WITH r AS (SELECT DISTINCT c_nationkey AS region_id FROM orders JOIN customer ON c_custkey = o_custkey) SELECT region_id, row_number() OVER (ORDER BY region_id) - 1 AS position FROM r")
def example_regions(spark, sf_dir):
    """J19, with the order of the result."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("region_id"))
    return in_order(relational.region_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), names, "c_custkey", "region_id"))


# ---------------------------------------------------------------- aggregations and order

@query(f"WITH {CELLS}, k AS (SELECT vec_id, p, CASE WHEN p % 3 = 0 THEN [0.0, 0.0, 0.0, 0.0] ELSE list_transform(v, lambda x: abs(x)) END AS v FROM c) SELECT vec_id AS example_idx, CAST(p AS INT) AS pos, " + ", ".join(f"round(CASE WHEN list_sum(v) = 0 THEN 0.25 ELSE v[{i + 1}] / list_sum(v) END, 6) AS {b}" for i, b in enumerate("acgt")) + " FROM k")
def ppm_empty_rows(spark, sf_dir):
    """An all-zero row becomes uniform."""
    rows = F.transform(A.transpose(F.col("contrib")), lambda r, i: F.transform(r, lambda x: F.when(i % 3 == 0, 0.0).otherwise(F.abs(x))))
    return spell(examples(spark, sf_dir).select(*per_base(A.normalise_ppm(rows), "example_idx")), "example_idx")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE greatest(o_totalprice, o_custkey * 100) > 200000")
def max_over_columns(spark, sf_dir):
    """A23."""
    o = table(spark, sf_dir, "orders").withColumn("other", (F.col("o_custkey") * 100).cast("double"))
    return relational.max_above(o, ["o_totalprice", "other"], 200000).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 6) AS mean FROM lineitem")
def row_means(spark, sf_dir):
    """A29."""
    return relational.row_mean(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", F.round("mean", 6).alias("mean"))


@query("SELECT event_type, user_id % 2 = 0 AS even, count(CASE WHEN value > 0 THEN value END) AS n FROM events GROUP BY ALL")
def split_counts(spark, sf_dir):
    """A25."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 2 == 0).alias("even"), F.when(F.col("value") > 0, F.col("value")).alias("v"))
    return relational.split_counts(e, ["event_type", "even"], "v")


@query("WITH f AS (SELECT event_type, arg_min(event_id, event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM events GROUP BY ALL), e AS (SELECT event_type, min(event_id % 480) - 10 AS low, max(event_id % 480 + 12) + 10 AS high FROM events GROUP BY ALL) SELECT event_type, event_id, user_id, low, high FROM f JOIN e USING (event_type)")
def class_extents(spark, sf_dir):
    """The first row of each class, and the stretch that it is drawn over."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    spans = e.select("event_type", (F.col("event_id") % 480).alias("start"), (F.col("event_id") % 480 + 12).alias("stop"))
    return relational.first_per_class(e, "event_type", "event_id").join(relational.extent(spans, "event_type"), "event_type")


@query(
    "WITH p AS (SELECT event_id, user_id AS example_idx, event_id % 480 AS start, event_id % 480 + 12 AS stop, abs(value) AS p_value FROM events) "
    'SELECT row_number() OVER (ORDER BY p_value, example_idx, start, stop) - 1 AS seqlet_id, example_idx, start, stop AS "end", p_value, count(*) OVER (PARTITION BY p_value, example_idx, start, stop) AS same FROM p'
)
def numbered_seqlets(spark, sf_dir):
    """Numbers by ascending p."""
    from pyspark.sql import Window

    h = event_hits(spark, sf_dir).select("example_idx", "start", "end", F.abs("attribution").alias("p_value"))
    same = F.count("*").over(Window.partitionBy("p_value", "example_idx", "start", "end"))
    return seqlets.with_ids(h).withColumn("same", same)


@query("SELECT event_id AS seqlet_id, dense_rank() OVER (ORDER BY event_id % 480) AS place FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def hits_by_start(spark, sf_dir):
    """O2: the order of a region's hits, as ranks of their starts."""
    hits = event_hits(spark, sf_dir)
    ordered = in_order(plotdata.region_hits(hits, 500, hits.agg(F.min("example_idx")).first()[0]))
    step = ordered.groupBy("start").agg(F.min("position").alias("at"), F.max("position").alias("upto"), F.count("*").alias("n")).where("upto - at + 1 = n")
    from pyspark.sql import Window

    places = step.select("start", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))
    return ordered.join(places, "start").select("seqlet_id", "place")


@query(f"WITH {PATTERN_ROWS}, k AS (SELECT leiden, dbd, n_seqlets, round(mean_ic, 6) AS ic FROM g) SELECT leiden, dbd, row_number() OVER (ORDER BY ic DESC, leiden, dbd) - 1 AS by_ic, row_number() OVER (ORDER BY n_seqlets DESC, leiden, dbd) - 1 AS by_n, row_number() OVER (ORDER BY leiden, dbd) - 1 AS by_id FROM k")
def pattern_order(spark, sf_dir):
    """All three orders, as places.  Names are made unique first, as clusters' are."""
    p = part_patterns(spark, sf_dir).withColumn("leiden", F.concat_ws("|", "leiden", "dbd"))
    out = p.select("leiden", "dbd")
    for by, name in (("ic", "by_ic"), ("n_seqlets", "by_n"), ("cluster_id", "by_id")):
        out = out.join(in_order(patterns.sort_patterns(p, by)).select("leiden", F.col("position").alias(name)), "leiden")
    return out.withColumn("leiden", F.split_part("leiden", F.lit("|"), F.lit(1)))


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS position FROM events GROUP BY event_type")
def categories_by_count(spark, sf_dir):
    """O6."""
    return in_order(relational.by_count(table(spark, sf_dir, "events"), "event_type"))


@query(
    "WITH x AS (SELECT vec_id AS seqlet_id, unnest(range(64)) AS motif_idx, unnest(embedding) AS s FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY seqlet_id ORDER BY s DESC, motif_idx) AS r FROM x) "
    "SELECT seqlet_id, CAST(motif_idx AS INT) AS motif_idx, round(CAST(s AS DOUBLE), 6) AS sim, CAST(r - 1 AS INT) AS rank FROM r WHERE r <= 3"
)
def nearest_motifs(spark, sf_dir):
    """O9."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seqlet_id"), vector().alias("sim"))
    return align.nearest(e, 3).select("seqlet_id", F.posexplode("nearest").alias("rank", "n")).select("seqlet_id", F.col("n.motif_idx").cast("int").alias("motif_idx"), F.round("n.sim", 6).alias("sim"), "rank")


@query(f"WITH {SPANNED} SELECT vec_id AS example_idx, CAST(len AS INT) AS len, CAST(start AS INT) AS start, round(CASE WHEN before >= 0.05 THEN 0.05 ELSE p END, 6) AS p FROM r")
def span_p_values(spark, sf_dir):
    """P of every span, capped where a shorter one failed.  In units of a millionth, so sums are exact."""
    x = micro_vectors(spark, sf_dir).select("example_idx", F.transform("x", lambda v: v.cast("double")).alias("x"))
    return seqlets.span_p_values(x, 0.05).withColumn("p", F.round("p", 6))


# ---------------------------------------------------------------- functions

@query(
    f"WITH {IC}, s AS (SELECT label, round(avg(ic), 2) AS ic, string_agg({LETTERS}, '' ORDER BY p) AS bases FROM (SELECT label, p, ic, a, c, g, t FROM i) GROUP BY label), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) "
    "SELECT label, 'Pattern(cluster ' || label || ', ' || n || ' seqlets, ' || bases || ', mean IC ' || printf('%.2f', ic) || ')' AS text FROM s JOIN n USING (label)"
)
def pattern_text(spark, sf_dir):
    """F3."""
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    p = label_ppm(spark, sf_dir).withColumn("ic", A.information_content(F.col("ppm"))).join(sizes, "label")
    return p.select("label", A.describe(F.col("label").cast("string"), F.col("n"), A.consensus(F.col("ppm")), F.col("ic")).alias("text"))


def label_patterns(spark, sf_dir) -> DataFrame:
    """A pattern per label; three labels to a domain."""
    p = label_ppm(spark, sf_dir).withColumn("ic", A.information_content(F.col("ppm")))
    return p.select(F.col("label").cast("string").alias("leiden"), F.concat(F.lit("d"), (F.col("label") / 3).cast("int")).alias("dbd"), "ppm", "ic", F.round(A.total(F.col("ic")) / F.size("ic"), 9).alias("mean_ic"), F.lit(1).cast("long").alias("n_seqlets"))


TRIM = f"{IC}, z AS (SELECT label, p, ic >= 0.4 AS b, lead(ic >= 0.4) OVER (PARTITION BY label ORDER BY p) AS n FROM i), x AS (SELECT label, coalesce(min(p) FILTER (b <> n), 0) AS s, coalesce(max(p) FILTER (b <> n) + 1, 0) AS e FROM z GROUP BY ALL), y AS (SELECT label, CASE WHEN s = e THEN 0 ELSE s END AS s, CASE WHEN s = e THEN 16 ELSE e END AS e FROM x)"
HEIGHTS = "CAST(i.p - {t}.s AS INT) AS pos, round(a * ic, 6) AS a, round(c * ic, 6) AS c, round(g * ic, 6) AS g, round(t * ic, 6) AS t FROM i JOIN {t} ON i.label = {t}.label AND i.p >= {t}.s AND i.p < {t}.e"


@query(f"WITH {TRIM} SELECT CAST(i.label AS VARCHAR) AS leiden, {HEIGHTS.format(t='x')}")
def logos(spark, sf_dir):
    """trimmed heights."""
    return spell(plotdata.logo(label_patterns(spark, sf_dir), 0.4).select(*per_base(F.col("heights"), "leiden")), "leiden")


@query(f"WITH {TRIM}, q AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS cx, avg(CAST(embedding[2] AS DOUBLE)) AS cy FROM embeddings GROUP BY label), h AS (SELECT label, s, e FROM y) SELECT CAST(i.label AS VARCHAR) AS leiden, round(cx, 6) AS x, round(cy, 6) AS y, 'd' || (i.label // 3) AS color, {HEIGHTS.format(t='h')} JOIN q ON q.label = i.label")
def tsne_logos(spark, sf_dir):
    """V2: centroid, colour and logo of each cluster; an unknown colour falls back to the cluster, and an empty trim to all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("leiden"), F.get(vector(), F.lit(0)).alias("x"), F.get(vector(), F.lit(1)).alias("y"), F.concat(F.lit("d"), (F.col("label") / 3).cast("int")).alias("cluster_dbd"))
    made = plotdata.tsne_logos(e, label_patterns(spark, sf_dir), least_ic=0.4)
    return spell(made.select(*per_base(F.col("heights"), "leiden", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "color")), "leiden", "x", "y", "color")


REPRESENTS = "o AS (SELECT label, 'd' || (label // 3) AS dbd, round(avg(ic), 9) AS mean_ic FROM i GROUP BY label), b AS (SELECT *, row_number() OVER (PARTITION BY dbd ORDER BY mean_ic DESC, CAST(label AS VARCHAR)) AS r FROM o)"


@query(f"WITH {IC}, {REPRESENTS} SELECT dbd, CAST(label AS VARCHAR) AS leiden, row_number() OVER (ORDER BY dbd) - 1 AS position, CAST(ceil(count(*) OVER () / ceil(sqrt(count(*) OVER ()))) AS INT) AS n_rows, CAST(ceil(sqrt(count(*) OVER ())) AS INT) AS n_columns FROM b WHERE r = 1")
def dbd_logos(spark, sf_dir):
    """One pattern per domain in order of its name, and the grid."""
    made, (n_rows, n_columns) = plotdata.dbd_logos(label_patterns(spark, sf_dir))
    return in_order(made.select("dbd", "leiden")).withColumns({"n_rows": F.lit(n_rows), "n_columns": F.lit(n_columns)})


@query(f"WITH {IC}, {REPRESENTS} SELECT CAST(label AS VARCHAR) AS leiden, row_number() OVER (ORDER BY mean_ic DESC, CAST(label AS VARCHAR)) - 1 AS position FROM b WHERE dbd = 'd1'")
def dbd_cluster_logos(spark, sf_dir):
    """V8: the patterns of one domain by information content."""
    return in_order(plotdata.dbd_cluster_logos(label_patterns(spark, sf_dir), "d1").select("leiden"))


@query(f"WITH {CELLS}, z AS (SELECT c.*, vec_id = (SELECT min(vec_id) FROM embeddings) AS mine FROM c) SELECT CAST(p - 2 AS INT) AS position, " + ", ".join(f"round(CASE WHEN list_position(v, list_max(v)) = {i + 1} THEN v[{i + 1}] ELSE 0 END, 6) AS {b}" for i, b in enumerate("ACGT")) + " FROM z WHERE mine AND p >= 2 AND p < 12")
def region_contributions(spark, sf_dir):
    """V3: the logo matrix of a region inside the zoom window."""
    e = examples(spark, sf_dir)
    first = e.agg(F.min("example_idx")).first()[0]
    hits = cut_places(spark, sf_dir).withColumns({"attribution": F.lit(1.0), "cluster_dbd": F.lit("Ets")})
    cells, *_ = plotdata.region_contributions(e, hits, first, zoom=(2, 12))
    return cells.select("position", *(F.round(b, 6).alias(b) for b in A.BASES))


@query(
    "WITH h AS (SELECT event_id AS seqlet_id, event_id % 480 - 40 AS s, event_id % 480 - 28 AS e, value, CASE WHEN event_id % 3 > 0 THEN event_type END AS dbd FROM events WHERE user_id = (SELECT min(user_id) FROM events)) "
    "SELECT seqlet_id, greatest(s, 0) AS start, least(e, 300) AS stop, coalesce(dbd, 'none') AS dbd FROM h WHERE e > 0 AND s < 300 AND abs(value) >= 20"
)
def region_boxes(spark, sf_dir):
    """The stretches drawn under a region's logo, those without a domain too."""
    hits = event_hits(spark, sf_dir).withColumn("cluster_dbd", F.when(F.col("seqlet_id") % 3 > 0, F.col("cluster_dbd")))
    first = hits.agg(F.min("example_idx")).first()[0]
    flat = F.array(*(F.array_repeat(F.lit(1.0), 480) for _ in range(4)))
    e = hits.select("example_idx").distinct().select("example_idx", flat.alias("contrib"), flat.alias("oh"))
    _, shown, _ = plotdata.region_contributions(e, hits, first, zoom=(40, 340), least=20, show_unannotated=True)
    return shown.select("seqlet_id", "start", F.col("end").alias("stop"), F.coalesce("cluster_dbd", F.lit("none")).alias("dbd"))


@query(
    "WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings), l AS (SELECT vec_id, string_agg(['A', 'C', 'G', 'T'][CAST((i + floor(abs(CAST(v AS DOUBLE)) * 50)) % 4 AS INT) + 1], '' ORDER BY i) AS bases, sum(CAST(v AS DOUBLE) * CASE WHEN (i + floor(abs(CAST(v AS DOUBLE)) * 50)) % 2 = 1 THEN 1 ELSE 0.9 END) FILTER (i >= 3 AND i < 28) AS total FROM x GROUP BY vec_id) "
    "SELECT vec_id AS example_idx, 'Pattern(cluster ' || vec_id || ', 1 seqlets, ' || bases[1:20] || '..., mean IC 2.00)' AS pattern, 'Seqlet(3-28' || CASE WHEN vec_id % 2 = 1 THEN '(-)' ELSE '(+)' END || ', mean contrib ' || printf('%.3f', round(total / 25, 3) + 0.0) || ')' AS seqlet FROM l"
)
def long_texts(spark, sf_dir):
    """patterns longer than twenty letters are cut; a seqlet in one line."""
    from tessera.plans.queries import examples_wide

    e = examples_wide(spark, sf_dir)
    text = A.consensus(A.transpose(F.col("oh")), instance=True)
    part = A.slice_columns(A.product(F.col("contrib"), F.col("oh")), F.lit(3), F.lit(28))
    line = A.seqlet_label(F.lit(3), F.lit(28), F.col("example_idx") % 2 == 1, part)
    return e.select("example_idx", A.describe(F.col("example_idx").cast("string"), F.lit(1), text, F.array(F.lit(2.0))).alias("pattern"), F.replace(line, F.lit("contrib -0.000"), F.lit("contrib 0.000")).alias("seqlet"))


@query(
    f"WITH {TOPIC}, n AS (SELECT topic, count(*) FILTER (prob > 0.17) AS n_active FROM d GROUP BY topic), a AS (SELECT topic, n_active, row_number() OVER (ORDER BY n_active DESC, topic) - 1 AS topic_at FROM n), "
    "b AS (SELECT dbd, topic, row_number() OVER (PARTITION BY dbd ORDER BY prob DESC, topic) AS r FROM d) SELECT d.dbd, d.topic, round(d.prob, 6) AS prob, a.n_active, CAST(a.topic_at AS INT) AS topic_at, CAST(x.topic_at AS INT) AS best_at FROM d JOIN a ON a.topic = d.topic JOIN b ON b.dbd = d.dbd AND b.r = 1 JOIN a x ON x.topic = b.topic"
)
def dbd_topic_heatmap(spark, sf_dir):
    """V5, O3: domain by topic with the places of both."""
    t = order_topics(spark, sf_dir).select("dbd", "topic", "prob").withColumn("cluster", F.col("dbd"))
    obs = t.select(F.col("dbd").alias("leiden"), F.col("dbd").alias("cluster_dbd"), F.lit(0).alias("seqlet_id")).distinct()
    return plotdata.dbd_topic_heatmap(t.select("cluster", "topic", "prob"), obs, 0.17).select("dbd", "topic", F.round("prob", 6).alias("prob"), "n_active", "topic_at", "best_at")


@query("WITH t AS (SELECT o_custkey % 40 AS c, 1 + o_orderkey % 6 AS k, count(*) AS n FROM orders GROUP BY ALL) SELECT CAST(c AS VARCHAR) AS cluster, " + ", ".join(f"CAST(max(n) FILTER (k = {k}) AS DOUBLE) AS Topic_{k}" for k in range(1, 7)) + " FROM t GROUP BY c")
def topic_clusters(spark, sf_dir):
    """The matrix of clusters by topic."""
    n = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).cast("string").alias("row"), (1 + F.col("o_orderkey") % 6).cast("int").alias("topic")).agg(F.count("*").cast("double").alias("prob"))
    fits = n.withColumns({"k": F.lit(6), "kind": F.lit("cluster")}).unionByName(n.withColumns({"k": F.lit(7), "kind": F.lit("region")}))
    return topics.wide(topics.cluster_topic(fits, 6), "cluster", 6)


@query("WITH t AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS region_id, 1 + o_orderkey % 3 AS topic, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL), s AS (SELECT region_id, topic, (v - min(v) OVER (PARTITION BY topic)) / nullif(max(v) OVER (PARTITION BY topic) - min(v) OVER (PARTITION BY topic), 0) AS s, v FROM t) SELECT region_id, CAST(topic AS INT) AS topic, round(coalesce(s, v), 6) AS value, row_number() OVER (ORDER BY topic, coalesce(s, v), region_id) - 1 AS position FROM s")
def topic_points(spark, sf_dir):
    """Scaled topic values of the points of regions, in order of intensity (where the points lie is checked in
    tests only)."""
    n = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).cast("string").alias("region_id"), (1 + F.col("o_orderkey") % 3).cast("int").alias("topic")).agg(F.count("*").cast("double").alias("prob"))
    return in_order(plotdata.region_topic_tsne(topics.wide(n, "region_id", 3), 3).select("region_id", "topic", F.round("value", 6).alias("value")))


# A window of twelve over a seqlet of seven, at both edges and inside.
ALIGN = "w AS (SELECT vec_id, vec_id % 9 AS s, vec_id % 9 + 7 AS e, vec_id % 5 - 2 AS o, vec_id % 2 = 1 AS r FROM embeddings), l AS (SELECT *, CASE WHEN r THEN e - o - 12 ELSE s + o END AS low FROM w), b AS (SELECT *, low >= 0 AND low + 12 <= 16 AS inside FROM l)"


@query(
    f"WITH {CELLS}, {ALIGN}, x AS (SELECT vec_id, unnest(range(12)) AS k FROM b), y AS (SELECT b.*, x.k, CASE WHEN inside THEN low + k WHEN k < 7 THEN s + k END AS p FROM x JOIN b USING (vec_id)), z AS (SELECT y.vec_id, y.r, y.k, coalesce(c.v, [0.0, 0.0, 0.0, 0.0]) AS v, CASE WHEN c.v IS NULL THEN 0 ELSE list_position(c.v, list_max(c.v)) END AS hot FROM y LEFT JOIN c ON c.vec_id = y.vec_id AND c.p = y.p), "
    "t AS (SELECT vec_id, CASE WHEN r THEN 11 - k ELSE k END AS k, CASE WHEN r THEN list_reverse(v) ELSE v END AS v, CASE WHEN hot = 0 THEN 0 WHEN r THEN 5 - hot ELSE hot END AS hot FROM z) "
    "SELECT vec_id AS seqlet_id, CAST(k AS INT) AS pos, round(v[1], 6) AS a, round(v[2], 6) AS c, round(v[3], 6) AS g, round(v[4], 6) AS t, round(CASE WHEN hot = 0 THEN 0 ELSE v[hot] END, 6) AS masked, CASE WHEN hot = 0 THEN 'N' ELSE ['A', 'C', 'G', 'T'][hot] END AS base FROM t"
)
def pattern_spans(spark, sf_dir):
    """Instances under a window, turned on the reverse strand; outside the example, unaligned."""
    i = F.col("seqlet_id")
    rows = cut_places(spark, sf_dir).withColumns({"offset": (i % 5 - 2).cast("int"), "is_revcomp": i % 2 == 1, "longest": F.lit(12)}).join(examples(spark, sf_dir).drop("label"), "example_idx")
    made = patterns.aligned_instances(rows)
    cells = made.select("seqlet_id", F.posexplode(F.arrays_zip("hypothetical", "contrib", "seq_instance")).alias("pos", "z"))
    cells = cells.select("seqlet_id", "pos", F.col("z.hypothetical").alias("_r"), A.total(F.col("z.contrib")).alias("m"), A.consensus(F.array("z.seq_instance"), instance=True).alias("base"))
    return spell(cells.withColumn("m", F.round("m", 6)), "seqlet_id", "m", "base").withColumnRenamed("m", "masked")


@query("SELECT n_nationkey, n_name AS cell_type FROM nation")
def file_names(spark, sf_dir):
    """The cell type in a file's name."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", readers.cell_type_of(F.concat(F.lit("data/x/"), "n_name", F.lit("_peaks.npz")), "{cell_type}_peaks.npz").alias("cell_type"))


@query("SELECT event_id, CAST(sign(value) AS DOUBLE) AS s, abs(value) AS a, round(log10(abs(value) + 1), 6) AS l, CAST(floor(value) AS BIGINT) AS f, round(ln(abs(value) + 1), 6) AS e, round(lgamma(abs(value) + 1), 4) AS g FROM events")
def scalars(spark, sf_dir):
    """F15."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.signum(v).alias("s"), F.abs(v).alias("a"), F.round(F.log10(F.abs(v) + 1), 6).alias("l"), F.floor(v).alias("f"), F.round(F.log(F.abs(v) + 1), 6).alias("e"), F.round(topics.log_gamma(F.abs(v) + 1), 4).alias("g"))


@query("SELECT vec_id, CAST(k AS INT) AS k, round((CAST(embedding[k + 1] AS DOUBLE) + CAST(embedding[k + 5] AS DOUBLE)) / 2, 6) AS v FROM embeddings, (SELECT unnest(range(4)) AS k)")
def mean_colours(spark, sf_dir):
    """F16."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(A.mean_colour(F.slice(vector(), 1, 4), F.slice(vector(), 5, 4))).alias("k", "v")).withColumn("v", F.round("v", 6))


@query(f"WITH {CELLS} SELECT vec_id, string_agg(CASE list_position(v, list_max(v)) WHEN 1 THEN '1,0,0,0' WHEN 2 THEN '0,1,0,0' WHEN 3 THEN '0,0,1,0' ELSE '0,0,0,1' END, '' ORDER BY p) AS print FROM c GROUP BY vec_id")
def sequence_prints(spark, sf_dir):
    """F13."""
    return examples(spark, sf_dir).select(F.col("example_idx").alias("vec_id"), A.fingerprint(F.col("oh")).alias("print"))


@query("SELECT doc_id AS id, 'documents' AS source FROM documents UNION ALL SELECT page_id, 'pages' FROM pages")
def joined_tables(spark, sf_dir):
    """Examples of several files, one after another."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("source"))
    return d.unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id")))
