"""The registered queries of the grouping operators and their SQL twins.

The driver's tables hold no images, so the operators run on stand-ins that Spark
and DuckDB both can define: vectors from ``embeddings``, colour bins folded from
them, hashes of ``documents`` whose whole text is folded into a 9 x 8 grid, and
``lineitem`` rows as pixels of their order. All are whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import hashes, paths, vectors
from kinfold.operators import linkage, naming, pairs
from kinfold.operators.components import connected_components
from kinfold.operators.storage import written
from kinfold.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Cut of the average-link query, chosen for these vectors.
CUT = 0.6


def query(sql: str | None = None):
    """Register a function as q_<name>, with its SQL if it has any."""

    def add(function):
        name = f"q_{function.__name__}"
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def r6(column: Column) -> Column:
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_path, vec_id, label, embedding, and v in unit length."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", "embedding", F.format_string("%02d/%08d.png", "label", "vec_id").alias("rel_path"), vectors.unit(F.col("embedding")).alias("v"))


CONTENT = """content AS (SELECT vec_id, label, embedding, printf('%02d/%08d.png', label, vec_id) AS rel_path,
  list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"""


def colour(v: str = "embedding") -> Column:
    """32 colour bins folded from 64 components."""
    e = F.col(v).cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: (F.abs(F.get(e, k)) + F.abs(F.get(e, k + 32))))


COLOUR = "list_transform(range(1, 33), lambda k: abs(embedding[k]::DOUBLE) + abs(embedding[k + 32]::DOUBLE))"


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dhash, aspect_ratio, thumb (64 bytes) of all documents: the code points
    of a whole text, summed over every 72nd place, are the cells of a 9 x 8 grid."""
    each = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "")).alias("at", "char"))
    sums = each.groupBy("doc_id", "n_chars", (F.col("at") % 72).alias("k")).agg(F.sum(F.ascii("char")).alias("total"))
    held = sums.groupBy("doc_id", "n_chars").agg(F.map_from_entries(F.collect_list(F.struct("k", "total"))).alias("held"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long")))
    folded = held.select("doc_id", F.col("n_chars").cast("double").alias("aspect_ratio"), cells.alias("cells"))
    return written(folded.select("doc_id", "aspect_ratio", hashes.grid_dhash(F.col("cells")).alias("dhash"), F.transform(F.slice("cells", 1, 64), lambda c: c % 256).alias("thumb")), "grids")


GRIDS = """grids AS (SELECT doc_id, n_chars::DOUBLE AS aspect_ratio, list_transform(cells[1:64], lambda c: c % 256) AS thumb,
  list_sum(list_transform(range(0, 64), lambda i: CASE WHEN cells[(i // 8) * 9 + i % 8 + 1] > cells[(i // 8) * 9 + i % 8 + 2] THEN (1::UBIGINT << (63 - i)::UBIGINT)::HUGEINT ELSE 0 END))::UBIGINT AS dhash
  FROM (SELECT doc_id, any_value(n_chars) AS n_chars, list(total ORDER BY k) AS cells FROM (SELECT doc_id, any_value(n_chars) AS n_chars, k, coalesce(sum(unicode(codes[i])) FILTER (i % 72 = (k + 1) % 72), 0)::BIGINT AS total
    FROM (SELECT doc_id, n_chars, regexp_extract_all(coalesce(text, ''), '(?s).') AS codes FROM documents) d, unnest(range(0, 72)) AS t(k), unnest(CASE WHEN len(codes) > 0 THEN range(k + 1, len(codes) + 1, 72) ELSE [] END || CASE WHEN len(codes) <= k THEN [NULL] ELSE [] END) AS u(i) GROUP BY doc_id, k) GROUP BY doc_id))"""
NEAR = "near AS (SELECT a.doc_id AS src, b.doc_id AS dst, bit_count(xor(a.dhash, b.dhash))::INT AS distance, a.aspect_ratio AS src_r, b.aspect_ratio AS dst_r, a.thumb AS src_t, b.thumb AS dst_t FROM grids a JOIN grids b ON a.doc_id < b.doc_id AND bit_count(xor(a.dhash, b.dhash)) <= 4)"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and a relative path from each URL, with every seventh suffixed."""
    rows = table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^[a-z]+://", "")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".txt", "", ".png", ".tiff", ".webp", ".gif")]), (F.col("page_id") % 7 + 1).cast("int"))
    return rows.select("page_id", F.concat(path, ending).alias("path"))


PAGES = "pp AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || (['.JPG', '.txt', '', '.png', '.tiff', '.webp', '.gif'])[(page_id % 7 + 1)::INT] AS path FROM pages)"
SUFFIX = r"regexp_extract(regexp_extract(path, '([^/]*)/*$', 1), '^.+(\.[^.]+)$', 1)"
KNOWN = "('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tif', '.tiff')"


@query(f"WITH {PAGES} SELECT page_id, {SUFFIX} AS suffix FROM pp")
def suffix(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", paths.suffix(F.col("path")).alias("suffix"))


@query(f"WITH {PAGES} SELECT page_id, path FROM pp WHERE lower({SUFFIX}) IN {KNOWN}")
def ext_filter(spark, sf_dir):
    return page_paths(spark, sf_dir).where(paths.is_supported(paths.suffix(F.col("path"))))


@query(f"WITH {PAGES} SELECT path AS rel_path, 'unsupported extension: ' || CASE WHEN {SUFFIX} = '' THEN '(none)' ELSE {SUFFIX} END AS reason FROM pp WHERE lower({SUFFIX}) NOT IN {KNOWN}")
def skip_reason(spark, sf_dir):
    ext = paths.suffix(F.col("path"))
    return page_paths(spark, sf_dir).where(~paths.is_supported(ext)).select(F.col("path").alias("rel_path"), paths.skip_reason(ext).alias("reason"))


_MESSY = "concat(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/', chr(92)), '/./', 'x//y', chr(92))"


def messy(spark, sf_dir):
    start = F.element_at(F.array(*[F.lit(x) for x in ("", "c:", "/", "../")]), (F.col("page_id") % 4 + 1).cast("int"))
    flat = F.translate(F.regexp_replace("url", "^[a-z]+://", ""), "/", "\\")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(start, flat, F.lit("/./x//y\\")).alias("path"))


def twice(spark, sf_dir):
    """The messy paths, every third in another spelling as well."""
    rows = messy(spark, sf_dir)
    return rows.unionByName(rows.where("page_id % 3 = 0").select("page_id", F.concat(F.regexp_replace("path", r"\\", "/"), F.lit("./")).alias("path")))


MESSY = "m AS (SELECT page_id, (['', 'c:', '/', '../'])[(page_id % 4 + 1)::INT] || replace(regexp_replace(url, '^[a-z]+://', ''), '/', chr(92)) || '/./x//y' || chr(92) AS path FROM pages)"
PARTS = "list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda p: p NOT IN ('', '.'))"


@query(f"WITH {MESSY} SELECT page_id, array_to_string({PARTS}, '/') AS path, NOT regexp_matches(replace(path, chr(92), '/'), '^.:|^/') AND len({PARTS}) > 0 AND NOT list_contains({PARTS}, '..') AS relative FROM m")
def path_normalize(spark, sf_dir):
    return messy(spark, sf_dir).select("page_id", paths.normalized_path(F.col("path")).alias("path"), paths.is_relative(F.col("path")).alias("relative"))


@query(f"WITH {MESSY}, t AS (SELECT path FROM m UNION ALL SELECT replace(path, chr(92), '/') || './' FROM m WHERE page_id % 3 = 0) SELECT array_to_string({PARTS}, '/') AS path, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1")
def path_unique(spark, sf_dir):
    return twice(spark, sf_dir).groupBy(paths.normalized_path(F.col("path")).alias("path")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def l2_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(vectors.l2_norm(F.col("embedding"))).alias("norm"))


@query("SELECT vec_id, len(embedding) > 0 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings")
def vector_usable(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.is_usable(F.col("embedding")).alias("usable"))


def flat(rows: DataFrame, column: Column) -> DataFrame:
    return rows.select("vec_id", F.posexplode(column).alias("k", "x")).select("vec_id", "k", r6(F.col("x")).alias("x"))


def flat_sql(vector: str, ctes: str = CONTENT) -> str:
    return f"WITH {ctes}, w AS (SELECT vec_id, {vector} AS f FROM content) SELECT vec_id, k::INT AS k, round(f[k + 1], 6) + 0.0 AS x FROM w, unnest(range(0, len(f))) AS t(k)"


@query(flat_sql("v"))
def normalize(spark, sf_dir):
    return flat(content(spark, sf_dir), F.col("v"))


def _fused(alpha):
    def run(spark, sf_dir):
        return flat(content(spark, sf_dir), vectors.fused(F.col("embedding"), colour(), alpha))

    return run


def _fused_sql(alpha):
    return f"""WITH {CONTENT}, c AS (SELECT vec_id, list_transform(v, lambda x: x::FLOAT) AS v, {COLOUR} AS c FROM content), n AS (SELECT vec_id, v, c, sqrt(list_dot_product(c, c)) AS n FROM c),
      w AS (SELECT vec_id, list_concat(list_transform(v, lambda x: (x * sqrt({alpha})::FLOAT)::FLOAT::DOUBLE), list_transform(c, lambda x: ((x / n)::FLOAT * sqrt(1.0 - {alpha})::FLOAT)::FLOAT::DOUBLE)) AS f FROM n),
      u AS (SELECT vec_id, f, sqrt(list_dot_product(f, f)) AS n FROM w)
      SELECT vec_id, k::INT AS k, round((f[k + 1] / n)::FLOAT::DOUBLE, 6) + 0.0 AS x FROM u, unnest(range(0, 96)) AS t(k)"""


for _name, _alpha in (("default", 0.8), ("alpha0", 0.0), ("alpha1", 1.0)):
    QUERIES[f"q_fuse_{_name}"] = _fused(_alpha)
    ORACLE_SQL[f"q_fuse_{_name}"] = _fused_sql(_alpha)


@query(f"WITH {CONTENT}, ref AS (SELECT label, v FROM content WHERE (label, vec_id) IN (SELECT (label, min(vec_id)) FROM embeddings GROUP BY label)) SELECT vec_id, round(greatest(0, least(2, 1 - list_dot_product(content.v, ref.v))), 6) + 0.0 AS distance FROM content JOIN ref USING (label)")
def cosine_to_ref(spark, sf_dir):
    rows = content(spark, sf_dir)
    ref = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("ref"))
    return rows.join(ref, "label").select("vec_id", r6(vectors.cosine_distance(F.col("v"), F.col("ref"))).alias("distance"))


EDGES = f"WITH {CONTENT} SELECT a.rel_path AS src, b.rel_path AS dst, round(greatest(0, least(2, 1 - list_dot_product(a.v, b.v))), 6) + 0.0 AS distance FROM content a JOIN content b ON a.rel_path < b.rel_path"


def _edges(spark, sf_dir, cut):
    found = pairs.cosine_edges(content(spark, sf_dir).select(F.col("rel_path").alias("key"), "v"), cut)
    return found.select("src", "dst", r6(F.col("distance")).alias("distance"))


@query(EDGES + " AND greatest(0, least(2, 1 - list_dot_product(a.v, b.v))) < 0.9")
def cosine_pairs(spark, sf_dir):
    return _edges(spark, sf_dir, 0.9)


@query(EDGES + f" AND greatest(0, least(2, 1 - list_dot_product(a.v, b.v))) < {CUT}")
def cosine_threshold_edges(spark, sf_dir):
    return _edges(spark, sf_dir, CUT)


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") * 37 % 256).alias("g"), (F.col("l_quantity").cast("int") * 5 % 256).cast("long").alias("b"))


PIXELS = "px AS (SELECT l_orderkey AS image, l_partkey % 256 AS r, l_suppkey * 37 % 256 AS g, (l_quantity::INT * 5 % 256)::BIGINT AS b FROM lineitem)"
_BINS = (("r", 16, 16), ("g", 32, 8), ("b", 32, 8))
_BIN_COLS = [(c, w, k, f"{c}{k}") for c, w, n in _BINS for k in range(n)]


@query(f"WITH {PIXELS} SELECT image, r // 16 AS h, g // 32 AS s, b // 32 AS v, count(*) AS n FROM px GROUP BY ALL")
def hsv_bins(spark, sf_dir):
    bins = [F.floor(F.col(c) / w).cast("long").alias(n) for (c, w, _), n in zip(_BINS, "hsv", strict=True)]
    return _pixels(spark, sf_dir).groupBy("image", *bins).agg(F.count("*").alias("n"))


@query(f"WITH {PIXELS}, b AS (SELECT image, {', '.join(f'count_if({c} // {w} = {k}) / count(*) AS {n}' for c, w, k, n in _BIN_COLS)} FROM px GROUP BY image) SELECT image, {', '.join(f'round({n} / sqrt({"+".join(f"{m}*{m}" for *_, m in _BIN_COLS)}), 6) AS {n}' for *_, n in _BIN_COLS)} FROM b")
def hsv_histogram(spark, sf_dir):
    shares = [(F.count_if(F.floor(F.col(c) / w) == k) / F.count("*")).alias(n) for c, w, k, n in _BIN_COLS]
    bins = _pixels(spark, sf_dir).groupBy("image").agg(*shares)
    norm = vectors.l2_norm(F.array(*[n for *_, n in _BIN_COLS]))
    return bins.withColumn("norm", norm).select("image", *[r6(F.col(n) / F.col("norm")).alias(n) for *_, n in _BIN_COLS])


@query(f"WITH {GRIDS} SELECT doc_id, (dhash >> 32)::BIGINT AS high, (dhash & 4294967295)::BIGINT AS low FROM grids")
def dhash(spark, sf_dir):
    return grids(spark, sf_dir).select("doc_id", F.shiftrightunsigned("dhash", 32).alias("high"), F.col("dhash").bitwiseAND(F.lit(4294967295)).alias("low"))


def near(spark, sf_dir):
    return pairs.hamming_pairs(grids(spark, sf_dir), "doc_id", "dhash", ("aspect_ratio", "thumb"))


@query(f"WITH {GRIDS}, {NEAR} SELECT src, dst, distance FROM near")
def hamming_banded(spark, sf_dir):
    return near(spark, sf_dir).select("src", "dst", "distance")


@query(f"WITH {GRIDS}, {NEAR} SELECT distance, count(*) AS n FROM near GROUP BY distance")
def hamming_pairs(spark, sf_dir):
    return near(spark, sf_dir).groupBy("distance").agg(F.count("*").alias("n"))


ALIKE = "greatest(src_r, dst_r) / least(src_r, dst_r) <= 1.05"
MAE = "list_sum(list_transform(range(1, 65), lambda k: abs(src_t[k] - dst_t[k]) / 255.0)) / 64"


@query(f"WITH {GRIDS}, {NEAR} SELECT src, dst, round(greatest(src_r, dst_r) / least(src_r, dst_r), 6) AS ratio FROM near WHERE {ALIKE}")
def aspect_pairs(spark, sf_dir):
    a, b = F.col("src_aspect_ratio"), F.col("dst_aspect_ratio")
    return near(spark, sf_dir).where(pairs.alike_aspect(a, b)).select("src", "dst", r6(F.greatest(a, b) / F.least(a, b)).alias("ratio"))


@query(f"WITH {GRIDS}, {NEAR} SELECT src, dst, round({MAE}, 6) AS error FROM near")
def mae_pairs(spark, sf_dir):
    return near(spark, sf_dir).select("src", "dst", r6(pairs.mean_error(F.col("src_thumb"), F.col("dst_thumb")) / 255.0).alias("error"))


def _dup_edges(spark, sf_dir, rows=None):
    rows = grids(spark, sf_dir) if rows is None else rows
    binary = F.unhex(F.array_join(F.transform("thumb", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return pairs.duplicate_edges(rows.select(F.format_string("%08d", "doc_id").alias("rel_path"), "dhash", "aspect_ratio", binary.alias("thumb")))


DUP = f"dup AS (SELECT printf('%08d', src) AS src, printf('%08d', dst) AS dst FROM near WHERE {ALIKE} AND {MAE} <= 0.08)"


@query(f"WITH {GRIDS}, {NEAR}, {DUP} SELECT src, dst FROM dup")
def dup_edges(spark, sf_dir):
    return _dup_edges(spark, sf_dir)


@query(f"""WITH RECURSIVE {GRIDS}, {NEAR}, {DUP}, both_ways AS (SELECT src, dst FROM dup UNION SELECT dst, src FROM dup),
  reach(node, other) AS (SELECT src, dst FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.other = b.src)
  SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node""")
def components(spark, sf_dir):
    return connected_components(_dup_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {GRIDS}, {NEAR}, {DUP}, both_ways AS (SELECT src, dst FROM dup UNION SELECT dst, src FROM dup),
  reach(node, other) AS (SELECT src, dst FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.other = b.src),
  parts AS (SELECT node, least(node, min(other)) AS part FROM reach GROUP BY node),
  held AS (SELECT part, list(node ORDER BY node) AS nodes FROM parts GROUP BY part),
  ends AS (SELECT part, list([list_position(nodes, src), list_position(nodes, dst)] ORDER BY src, dst) AS edges FROM dup JOIN parts ON node = src JOIN held USING (part) GROUP BY part),
  step(part, n, own) AS (SELECT part, 1, range(1, len(nodes) + 1) FROM held
    UNION ALL SELECT part, n + 1, CASE WHEN a <> b AND len(list_filter(edges, lambda e: (own[e[1]] = a AND own[e[2]] = b) OR (own[e[1]] = b AND own[e[2]] = a))) = len(list_filter(own, lambda o: o = a)) * len(list_filter(own, lambda o: o = b))
      THEN list_transform(own, lambda o: CASE WHEN o = greatest(a, b) THEN least(a, b) ELSE o END) ELSE own END
    FROM (SELECT part, n, own, edges, own[edges[n][1]] AS a, own[edges[n][2]] AS b FROM step JOIN ends USING (part) WHERE n <= len(edges))),
  last AS (SELECT part, nodes, own FROM step JOIN ends USING (part) JOIN held USING (part) WHERE n = len(edges) + 1),
  grouped AS (SELECT nodes[k] AS rel_path, nodes[own[k]] AS dup_group FROM last, unnest(range(1, len(nodes) + 1)) AS t(k))
  SELECT printf('%08d', doc_id) AS rel_path, coalesce(dup_group, printf('%08d', doc_id)) AS dup_group FROM grids LEFT JOIN grouped ON rel_path = printf('%08d', doc_id)""")
def complete_link(spark, sf_dir):
    rows = grids(spark, sf_dir)
    return linkage.complete_link(rows.select(F.format_string("%08d", "doc_id").alias("rel_path")), _dup_edges(spark, sf_dir, rows))


MEANS = f"""{CONTENT}, m AS (SELECT label, k, avg(v[k]) AS m FROM content, unnest(range(1, 65)) AS t(k) GROUP BY label, k),
  reps AS (SELECT label, list(m ORDER BY k) AS mean, sqrt(sum(m * m)) AS norm FROM m GROUP BY label)"""


@query(f"WITH {MEANS} SELECT label, k::INT - 1 AS k, round(mean[k] / norm, 6) + 0.0 AS x FROM reps, unnest(range(1, 65)) AS t(k)")
def representatives(spark, sf_dir):
    rows = content(spark, sf_dir).select("label", "v")
    found = linkage.representatives(rows, "label", "v")
    return found.select("label", F.posexplode("v").alias("k", "x")).select("label", "k", r6(F.col("x")).alias("x"))


def _upgma(spark, sf_dir, cut):
    rows = content(spark, sf_dir).select(F.col("rel_path").alias("dup_group"), "v")
    return linkage.average_link_clusters(rows, cut).withColumnRenamed("dup_group", "rel_path")


UPGMA = f"""{CONTENT}, far AS (SELECT a.rel_path AS x, b.rel_path AS y, greatest(0, least(2, 1 - list_dot_product(a.v, b.v))) AS d FROM content a JOIN content b ON a.rel_path <> b.rel_path),
  close AS (SELECT x, y FROM far WHERE d < {CUT}),
  reach(node, other) AS (SELECT x, y FROM close UNION SELECT r.node, c.y FROM reach r JOIN close c ON r.other = c.x),
  parts AS (SELECT node, least(node, min(other)) AS part FROM reach GROUP BY node),
  held AS (SELECT part, list(node ORDER BY node) AS nodes FROM parts GROUP BY part),
  pairs AS (SELECT p.part, list({{'i': list_position(nodes, x), 'j': list_position(nodes, y), 'd': d}}) AS ds FROM far JOIN parts p ON p.node = x JOIN parts q ON q.node = y AND q.part = p.part JOIN held h ON h.part = p.part WHERE x < y GROUP BY p.part),
  step(part, own, open) AS (SELECT part, range(1, len(nodes) + 1), true FROM held
    UNION ALL SELECT part, CASE WHEN best[1] < {CUT} THEN list_transform(own, lambda o: CASE WHEN o = best[3] THEN best[2]::BIGINT ELSE o END) ELSE own END, best[1] < {CUT}
    FROM (SELECT part, own, (SELECT min([m, a, b]) FROM (SELECT avg(e.d) AS m, least(own[e.i], own[e.j])::DOUBLE AS a, greatest(own[e.i], own[e.j])::DOUBLE AS b FROM (SELECT unnest(ds) AS e) WHERE own[e.i] <> own[e.j] GROUP BY 2, 3)) AS best FROM step JOIN pairs USING (part) WHERE open) WHERE best IS NOT NULL),
  last AS (SELECT part, arg_min(own, list_sum(own)) AS own FROM step GROUP BY part),
  clusters AS (SELECT nodes[k] AS rel_path, nodes[own[k]] AS cluster_key FROM last JOIN held USING (part), unnest(range(1, len(nodes) + 1)) AS t(k))"""


@query(f"WITH RECURSIVE {UPGMA} SELECT rel_path, coalesce(clusters.cluster_key, rel_path) AS cluster_key FROM content LEFT JOIN clusters USING (rel_path)")
def upgma(spark, sf_dir):
    return _upgma(spark, sf_dir, CUT)


@query(f"WITH {CONTENT} SELECT rel_path, rel_path AS cluster_key FROM content")
def upgma_zero(spark, sf_dir):
    return _upgma(spark, sf_dir, 0.0)


@query(f"WITH {CONTENT} SELECT rel_path, min(rel_path) OVER () AS cluster_key FROM content")
def upgma_all(spark, sf_dir):
    return _upgma(spark, sf_dir, 2.5)


PLAN = f"""{MEANS}, d AS (SELECT rel_path, label, greatest(0, least(2, 1 - list_dot_product(v, mean) / norm)) AS distance FROM content JOIN reps USING (label)),
  c AS (SELECT label, count(*) AS members, min(rel_path) AS first, row_number() OVER (ORDER BY count(*) DESC, min(rel_path)) AS cluster FROM content GROUP BY label),
  p AS (SELECT rel_path, cluster::INT AS cluster, row_number() OVER (PARTITION BY cluster ORDER BY distance, rel_path)::INT AS index, distance FROM d JOIN c USING (label))"""


def by_label(spark, sf_dir):
    return content(spark, sf_dir).select("rel_path", "v", F.col("label").alias("cluster_key"))


@query(f"WITH {PLAN} SELECT rel_path, round(distance, 6) + 0.0 AS distance FROM d")
def centroid_distance(spark, sf_dir):
    rows = by_label(spark, sf_dir)
    return rows.join(naming.references(rows), "cluster_key").select("rel_path", r6(vectors.cosine_distance(F.col("v"), F.col("ref"))).alias("distance"))


def opposites(spark, sf_dir):
    """Pairs of each vector and its negative: clusters whose mean is zero."""
    rows = content(spark, sf_dir)
    both = rows.select("rel_path", "v").unionByName(rows.select(F.concat("rel_path", F.lit("~")).alias("rel_path"), F.transform("v", lambda x: -x).alias("v")))
    return both.withColumn("cluster_key", F.regexp_replace("rel_path", "~", ""))


@query(f"WITH {CONTENT} SELECT rel_path AS cluster_key, k::INT - 1 AS k, round(v[k], 6) + 0.0 AS x FROM content, unnest(range(1, 65)) AS t(k)")
def medoid(spark, sf_dir):
    found = naming.references(opposites(spark, sf_dir))
    return found.select("cluster_key", F.posexplode("ref").alias("k", "x")).select("cluster_key", "k", r6(F.col("x")).alias("x"))


@query(f"WITH {PLAN} SELECT label AS cluster_key, members, cluster::INT AS cluster FROM c")
def cluster_rank(spark, sf_dir):
    return naming.cluster_numbers(by_label(spark, sf_dir))


@query(f"WITH {PLAN} SELECT rel_path, cluster, index FROM p")
def member_rank(spark, sf_dir):
    return naming.named_plan(by_label(spark, sf_dir)).select("rel_path", "cluster", "index")


@query("SELECT o_orderkey, printf('%04d-%08d.png', (o_orderkey % 9999 + 1)::INT, o_custkey) AS output_name FROM orders")
def output_name(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", naming.output_name((F.col("o_orderkey") % 9999 + 1).cast("int"), F.col("o_custkey")).alias("output_name"))


@query(f"WITH {PLAN} SELECT rel_path, cluster, index, printf('%04d-%08d.png', cluster, index) AS output_name, round(distance, 6) + 0.0 AS distance_to_centroid FROM p")
def plan(spark, sf_dir):
    return naming.named_plan(by_label(spark, sf_dir)).withColumn("distance_to_centroid", r6(F.col("distance_to_centroid")))


@query()
def plan_grouping(spark, sf_dir):
    """Group all vectors by average linkage and rank members: the flagship. The vectors
    stand for no files, so clusters beyond what the names of files hold are listed too."""
    rows = content(spark, sf_dir)
    clusters = written(linkage.average_link_clusters(rows.select(F.col("rel_path").alias("dup_group"), "v"), CUT), "clustered")
    keyed = rows.select("rel_path", "v").join(clusters.withColumnRenamed("dup_group", "rel_path"), "rel_path")
    return naming.named_plan(keyed, bounded=False).withColumn("distance_to_centroid", r6(F.col("distance_to_centroid")))


@query(f"""WITH RECURSIVE {UPGMA}, keyed AS (SELECT rel_path, v, coalesce(clusters.cluster_key, rel_path) AS cluster_key FROM content LEFT JOIN clusters USING (rel_path)),
  m AS (SELECT cluster_key, k, avg(v[k]) AS m FROM keyed, unnest(range(1, 65)) AS t(k) GROUP BY cluster_key, k), reps AS (SELECT cluster_key, list(m ORDER BY k) AS mean, sqrt(sum(m * m)) AS norm FROM m GROUP BY cluster_key),
  d AS (SELECT rel_path, cluster_key, greatest(0, least(2, 1 - list_dot_product(v, mean) / norm)) AS distance FROM keyed JOIN reps USING (cluster_key)),
  c AS (SELECT cluster_key, row_number() OVER (ORDER BY count(*) DESC, min(rel_path)) AS cluster FROM keyed GROUP BY cluster_key),
  c2 AS (SELECT * FROM c)
  SELECT rel_path, cluster::INT AS cluster, round(distance, 6) + 0.0 AS distance_to_centroid FROM d JOIN c2 USING (cluster_key)""")
def plan_clusters(spark, sf_dir):
    """The flagship's clusters and distances; members of pairs are equally far but for
    rounding, so that SQL cannot state their order."""
    return plan_grouping(spark, sf_dir).select("rel_path", "cluster", "distance_to_centroid")


def _skipped(spark, sf_dir):
    return QUERIES["q_skip_reason"](spark, sf_dir)


SKIPPED = f"skipped AS (SELECT path AS rel_path, 'unsupported extension: ' || CASE WHEN {SUFFIX} = '' THEN '(none)' ELSE {SUFFIX} END AS reason FROM pp WHERE lower({SUFFIX}) NOT IN {KNOWN})"


@query(f"""WITH {PLAN}, {PAGES}, {SKIPPED}, u AS (SELECT 0 AS part, '' AS cluster, '' AS index, '' AS output_name, rel_path AS source_path, reason AS skipped_reason FROM skipped
  UNION ALL SELECT 1, cluster::VARCHAR, index::VARCHAR, printf('%04d-%08d.png', cluster, index), rel_path, '' FROM p)
  SELECT part, cluster, index, output_name, source_path, skipped_reason FROM u""")
def manifest_union(spark, sf_dir):
    from kinfold.sources.sink import manifest_rows

    return manifest_rows(naming.named_plan(by_label(spark, sf_dir)), _skipped(spark, sf_dir)).drop("distance_to_centroid", "sort_cluster", "sort_index")


@query(f"WITH {PLAN}, {PAGES}, {SKIPPED} SELECT (SELECT count(*) FROM p) AS images, (SELECT count(DISTINCT cluster) FROM p) AS clusters, (SELECT count(*) FROM skipped) AS skipped")
def summary(spark, sf_dir):
    named = naming.named_plan(by_label(spark, sf_dir)).agg(F.count("*").alias("images"), F.count_distinct("cluster").alias("clusters"))
    return named.join(_skipped(spark, sf_dir).agg(F.count("*").alias("skipped")))


@query(f"WITH {PLAN} SELECT printf('%04d-%08d.png', cluster, index) AS output_name FROM p WHERE printf('%04d-%08d.png', cluster, index) IN (SELECT printf('%04d-%08d.png', (o_orderkey % 20 + 1)::INT, o_custkey) FROM orders)")
def name_collision(spark, sf_dir):
    """Planned names that a destination (named after orders) holds already."""
    existing = table(spark, sf_dir, "orders").select(naming.output_name((F.col("o_orderkey") % 20 + 1).cast("int"), F.col("o_custkey")).alias("output_name"))
    return naming.named_plan(by_label(spark, sf_dir)).join(existing, "output_name", "left_semi").select("output_name")


@query(f"WITH {CONTENT} SELECT rel_path, ((row_number() OVER (PARTITION BY label ORDER BY rel_path) - 1) // 8)::INT AS batch FROM content")
def batch_number(spark, sf_dir):
    from pyspark.sql.window import Window as W

    number = F.row_number().over(W.partitionBy("label").orderBy("rel_path"))
    return content(spark, sf_dir).select("rel_path", F.floor((number - 1) / 8).cast("int").alias("batch"))


@query(f"WITH {PLAN} SELECT rel_path, embedding IS NOT NULL AS found, cluster FROM p JOIN content USING (rel_path)")
def plan_sources(spark, sf_dir):
    """Plan rows looked up in their sources."""
    source = content(spark, sf_dir).select("rel_path", F.col("embedding").isNotNull().alias("found"))
    return naming.named_plan(by_label(spark, sf_dir)).join(source, "rel_path").select("rel_path", "found", "cluster")
