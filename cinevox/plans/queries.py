"""One query for each operator of the movie library, over views of the driver's tables, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import argmax, softmax, stem, uniform
from ..operators import augment, detect, jobs, matching, network, points, regions, resample, sampling, spacing
from ..operators.config import Config
from ..sources import views
from ..sources.views import VIEWS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SMALL = Config(half_size=(4, 4), nframes=(5, 5), ncat=3)
POINT_MOVIE = "SELECT DISTINCT movie_id, 30 AS n_frames, 150 AS h, 97 AS w FROM points"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(VIEWS[n] for n in names)


def md5_uniform(*parts: str) -> str:
    """DuckDB form of ``functions.scalar.uniform``."""
    return f"(CAST(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.voxels(views.frames(spark, sf_dir))


def _point_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {"n_frames": 30, "h": 150, "w": 97}
    return views.points(spark, sf_dir).select("movie_id").distinct().select("movie_id", *[F.lit(v).alias(k) for k, v in sizes.items()])


# --- grids and windows

@query(f"""{with_views("mosaic")},
movies AS (SELECT movie_id, max(t) + 1 AS n_frames FROM mosaic GROUP BY movie_id),
models AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 1)) m(model_id, shift_t, shift_xy)),
sizes AS (SELECT *, CAST(greatest(0, ceil((n_frames - shift_t) / 2.0)) AS BIGINT) AS nz, CAST(greatest(0, ceil((7 - shift_xy) / 3.0)) AS BIGINT) AS n FROM movies, models)
SELECT movie_id, model_id, (k * n + j) * n + i AS win_id, CAST(5 + shift_t + 2 * k AS INT) AS t, CAST(4 + shift_xy + 3 * j AS INT) AS y, CAST(4 + shift_xy + 3 * i AS INT) AS x
FROM sizes, range(0, 1000) a(k), range(0, 10) b(j), range(0, 10) c(i) WHERE k < nz AND j < n AND i < n""")
def tiling_grid(spark, sf_dir):
    return detect.centres(views.movies(views.mosaic(spark, sf_dir)), SMALL, n_models=3, dxy=3, dz=2)


@query(f"""{with_views("voxels")},
lasts AS (SELECT movie_id, max(t) AS last FROM voxels GROUP BY movie_id)
SELECT v.movie_id, CAST(u AS INT) AS t, y, x, v FROM lasts l, range(0, 1000) r(u), voxels v
WHERE u <= last + 10 AND v.movie_id = l.movie_id AND v.t = greatest(0, least(last, u - 5))""")
def pad_time(spark, sf_dir):
    return detect.pad_time(_voxels(spark, sf_dir), 5, 5)


_WINDOWS = f"""{with_views("mosaic")},
movies AS (SELECT movie_id, max(t) + 1 AS n_frames FROM mosaic GROUP BY movie_id),
padded AS (SELECT m.movie_id, CAST(u AS INT) AS u, y, x, v FROM movies m, range(0, 2000) r(u), mosaic v
           WHERE u < n_frames + 10 AND v.movie_id = m.movie_id AND v.t = greatest(0, least(n_frames - 1, u - 5))),
sizes AS (SELECT movie_id, n_frames, model_id, CAST(ceil((n_frames - model_id) / 2.0) AS BIGINT) AS nz, CAST(ceil((7 - model_id) / 2.0) AS BIGINT) AS n FROM movies, (VALUES (0), (1)) k(model_id)),
centres AS (SELECT movie_id, model_id, (k * n + j) * n + i AS win_id, 5 + model_id + 2 * k AS ct, 4 + model_id + 2 * j AS cy, 4 + model_id + 2 * i AS cx
            FROM sizes, range(0, 1000) a(k), range(0, 10) b(j), range(0, 10) c(i) WHERE k < nz AND j < n AND i < n),
cubes AS (SELECT c.*, p.u, p.y, p.x, p.v, min(v) OVER w AS low, max(v) OVER w AS high
          FROM centres c JOIN padded p ON p.movie_id = c.movie_id AND p.u BETWEEN ct - 5 AND ct + 4 AND p.y BETWEEN cy - 4 AND cy + 4 AND p.x BETWEEN cx - 4 AND cx + 4
          WINDOW w AS (PARTITION BY c.movie_id, model_id, win_id)),
scaled AS (SELECT *, CAST(floor((v - low)::DOUBLE / CASE WHEN high > low THEN high - low ELSE 1 END * 255) AS BIGINT) AS s FROM cubes)"""


@query(f"""{_WINDOWS}
SELECT movie_id, model_id, win_id, CAST(min(low) AS INT) AS low, CAST(max(high) AS INT) AS high, CAST(sum(s) AS BIGINT) AS total, count(*) AS n FROM scaled GROUP BY movie_id, model_id, win_id""")
def window_minmax(spark, sf_dir):
    found = detect.window_ranges(views.mosaic(spark, sf_dir), SMALL, n_models=2, dxy=2, dz=2)
    shape = SMALL.window_shape
    return found.select("movie_id", "model_id", "win_id", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), "total", F.lit(shape[0] * shape[1] * shape[2]).cast("bigint").alias("n"))


@query(f"""{with_views("voxels")},
ranges AS (SELECT *, min(v) OVER a AS low, max(v) OVER a AS high, min(v) OVER b AS low_b, max(v) OVER b AS high_b FROM voxels WINDOW a AS (PARTITION BY movie_id, t), b AS (PARTITION BY movie_id, t // 4))
SELECT movie_id, t, round(sum((v - low)::DOUBLE / greatest((high - low)::DOUBLE, 1e-12)), 6) AS by_sample, round(sum((v - low_b)::DOUBLE / greatest((high_b - low_b)::DOUBLE, 1e-12)), 6) AS by_batch FROM ranges GROUP BY movie_id, t""")
def batch_minmax(spark, sf_dir):
    v = _voxels(spark, sf_dir).withColumn("batch", F.floor(F.col("t") / 4))
    one = detect.minmax(v, ["movie_id", "t"], 1.0, False, 1e-12).withColumnRenamed("s", "one")
    both = detect.minmax(one, ["movie_id", "batch"], 1.0, False, 1e-12)
    return both.groupBy("movie_id", "t").agg(F.round(F.sum("one"), 6).alias("by_sample"), F.round(F.sum("s"), 6).alias("by_batch"))


@query(f"""{with_views("hits")},
splat AS (SELECT h.t + dt AS t, h.y + dy AS y, h.x + dx AS x, weight FROM hits h, range(-1, 2) a(dt), range(-1, 2) b(dy), range(-1, 2) c(dx))
SELECT CAST(t AS INT) AS t, CAST(y AS INT) AS y, CAST(x AS INT) AS x, sum(weight) AS total, count(*) AS n, CAST(floor(sum(weight) / count(*)) AS INT) AS mean FROM splat GROUP BY t, y, x""")
def splat_lineitem(spark, sf_dir):
    hits = views.hits(spark, sf_dir).select(F.lit(0).alias("movie_id"), F.lit(1).alias("cat"), "*")
    sums = detect.splat(hits, SMALL, "weight")
    return sums.select("t", "y", "x", "total", "n", F.floor(F.col("total") / F.col("n")).cast("int").alias("mean"))


_PROBAMAP = f"""{_WINDOWS},
scores AS (SELECT movie_id, model_id, win_id, ct, cy, cx, CAST(coalesce(sum(s) FILTER (u < ct), 0) AS BIGINT) AS b, CAST(coalesce(sum(s) FILTER (u >= ct), 0) AS BIGINT) AS a FROM scaled GROUP BY ALL),
probs AS (SELECT movie_id, ct, cy, cx, (4096 * b // (a + b + 1)) / 4096.0::DOUBLE AS p1, (4096 * a // (a + b + 1)) / 4096.0::DOUBLE AS p2 FROM scores),
splats AS (SELECT movie_id, ct + dt - 5 AS t, cy + dy AS y, cx + dx AS x, sum(p1) AS s1, sum(p2) AS s2, count(*) AS n FROM probs, range(-1, 2) q(dt), range(-1, 2) r(dy), range(-1, 2) s(dx) GROUP BY ALL),
maps AS (SELECT g.movie_id, g.t, g.y, g.x, CAST(coalesce(floor(s1 / n * 255), 0) AS INT) AS q1, CAST(coalesce(floor(s2 / n * 255), 0) AS INT) AS q2 FROM mosaic g LEFT JOIN splats s USING (movie_id, t, y, x)),
probamap AS (SELECT movie_id, 1 AS cat, t, y, x, q1 AS p8 FROM maps UNION ALL SELECT movie_id, 2, t, y, x, q2 FROM maps)"""


def _probamap(spark, sf_dir):
    return detect.detect(views.mosaic(spark, sf_dir), SMALL, [detect.before_after] * 2, 2, dxy=2, dz=2)


@query(f"{_PROBAMAP}\nSELECT movie_id, cat, t, y, x, p8 FROM probamap")
def probamap_detect(spark, sf_dir):
    return _probamap(spark, sf_dir)


# --- morphology and regions

_LIT = f"""{with_views("voxels")},
lit AS (SELECT movie_id, t, y, x, v, CAST(v > 1100 AS INT) AS b FROM voxels)"""
ONE = ["movie_id"]


def _lit(spark, sf_dir):
    return regions.threshold(_voxels(spark, sf_dir), 1100, "v")


@query(f"""{_LIT},
h AS (SELECT *, least(b, coalesce(lag(b) OVER (PARTITION BY movie_id, t, y ORDER BY x), b)) AS hb FROM lit)
SELECT movie_id, t, y, x, v, least(hb, coalesce(lag(hb) OVER (PARTITION BY movie_id, t, x ORDER BY y), hb)) AS b FROM h""")
def threshold_erode(spark, sf_dir):
    return regions.erode(_lit(spark, sf_dir), keys=ONE)


@query(f"""{_LIT},
a AS (SELECT *, max(b) OVER (PARTITION BY movie_id, y, x ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS b1 FROM lit),
c AS (SELECT *, max(b1) OVER (PARTITION BY movie_id, t, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b2 FROM a)
SELECT movie_id, t, y, x, v, max(b2) OVER (PARTITION BY movie_id, t, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b FROM c""")
def dilate_box(spark, sf_dir):
    return regions.dilate(_lit(spark, sf_dir), 4, 3, keys=ONE)


@query(f"""{_LIT}
SELECT a.movie_id, a.t, a.y, a.x, min((a.t - z.t) * (a.t - z.t) + (a.y - z.y) * (a.y - z.y) + (a.x - z.x) * (a.x - z.x)) AS d2
FROM lit a JOIN lit z ON a.movie_id = z.movie_id AND a.b = 1 AND z.b = 0 GROUP BY a.movie_id, a.t, a.y, a.x""")
def edt_distance(spark, sf_dir):
    return regions.edt(_lit(spark, sf_dir), ONE)


@query(f"""{with_views("voxels")}
SELECT movie_id, t, y, x, v FROM voxels a WHERE NOT EXISTS (SELECT 1 FROM voxels b WHERE b.movie_id = a.movie_id AND b.t BETWEEN a.t - 1 AND a.t + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1
  AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (b.t, b.y, b.x) <> (a.t, a.y, a.x) AND b.v >= a.v)""")
def local_maxima_strict(spark, sf_dir):
    return regions.strict_maxima(_voxels(spark, sf_dir), "v", ONE)


@query(f"""WITH RECURSIVE {VIEWS["voxels"]},
steps AS MATERIALIZED (SELECT movie_id, t, y, x, v // 40 AS v FROM voxels),
near AS MATERIALIZED (SELECT a.movie_id, a.t, a.y, a.x, a.v, b.t AS t1, b.y AS y1, b.x AS x1, b.v AS v1
  FROM steps a JOIN (SELECT *, unnest([-1, 0, 1]) AS d FROM steps) b ON a.movie_id = b.movie_id AND a.t = b.t + b.d AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
equal AS MATERIALIZED (SELECT movie_id, t, y, x, t1, y1, x1 FROM near WHERE v = v1),
lower AS (SELECT DISTINCT movie_id, t, y, x FROM near WHERE v1 > v UNION SELECT e.movie_id, t1, y1, x1 FROM lower l JOIN equal e USING (movie_id, t, y, x))
SELECT movie_id, t, y, x, CAST(v AS INT) AS v FROM steps ANTI JOIN lower USING (movie_id, t, y, x)""")
def plateau_maxima(spark, sf_dir):
    return regions.maxima(_voxels(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 40).cast("int")), "v", ONE)


_LABELS = f"""WITH RECURSIVE {VIEWS["voxels"]},
fg AS MATERIALIZED (SELECT movie_id, t, y, x, v, t * 64 + y * 8 + x AS id FROM voxels WHERE v > 1100),
e AS MATERIALIZED (SELECT a.movie_id, a.id AS a, b.id AS b FROM fg a JOIN fg b ON a.movie_id = b.movie_id AND abs(a.t - b.t) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
r AS (SELECT movie_id, id, id AS root FROM fg UNION SELECT r.movie_id, e.b, r.root FROM r JOIN e ON e.movie_id = r.movie_id AND e.a = r.id WHERE r.root < e.b),
roots AS MATERIALIZED (SELECT movie_id, id, min(root) AS root FROM r GROUP BY movie_id, id),
labelled AS MATERIALIZED (SELECT movie_id, t, y, x, v, dense_rank() OVER (PARTITION BY movie_id ORDER BY root) AS label FROM fg JOIN roots USING (movie_id, id))"""


def _labelled(spark, sf_dir):
    return regions.label(_voxels(spark, sf_dir).where("v > 1100"), ONE)


@query(f"{_LABELS}\nSELECT movie_id, t, y, x, v, CAST(label AS INT) AS label FROM labelled")
def components(spark, sf_dir):
    return _labelled(spark, sf_dir)


_STATS = f"""{_LABELS},
stats AS (SELECT movie_id, label, count(*)::DOUBLE AS volume, avg(v) AS proba, avg(t) AS t, avg(y) AS y, avg(x) AS x FROM labelled GROUP BY movie_id, label)"""


@query(f"{_STATS}\nSELECT movie_id, CAST(label AS INT) AS label, volume, round(proba, 6) AS proba, round(t, 6) AS t, round(y, 6) AS y, round(x, 6) AS x FROM stats")
def region_stats(spark, sf_dir):
    stats = regions.region_stats(_labelled(spark, sf_dir), "v", ONE)
    return stats.select("movie_id", "label", "volume", *[F.round(c, 6).alias(c) for c in ("proba", "t", "y", "x")])


@query(f"""{_STATS}
SELECT movie_id, 1 AS cat, CAST(floor(t * (60 / 50.0::DOUBLE)) AS INT) AS t, CAST(floor(y * (20 / 8.0::DOUBLE)) AS INT) AS y, CAST(floor(x * (20 / 8.0::DOUBLE)) AS INT) AS x, volume, round(proba, 6) AS proba
FROM stats WHERE volume > 1 AND proba > 1150""")
def event_list(spark, sf_dir):
    stats = regions.region_stats(_labelled(spark, sf_dir), "v", ONE).withColumn("cat", F.lit(1))
    sizes = stats.select("movie_id").distinct().select("movie_id", *[F.lit(v).alias(k) for k, v in {"n_frames": 60, "h": 20, "map_frames": 50, "map_h": 8}.items()])
    return regions.events(stats, sizes, 1, 1150).withColumn("proba", F.round("proba", 6))


@query(f"""{_STATS}
SELECT g.movie_id, g.t, g.y, g.x, CAST(coalesce(floor(s.proba), 0) AS INT) AS p8 FROM voxels g LEFT JOIN labelled l USING (movie_id, t, y, x)
LEFT JOIN stats s ON s.movie_id = l.movie_id AND s.label = l.label AND s.volume > 1 AND s.proba > 1150""")
def cleaned_map(spark, sf_dir):
    v = _voxels(spark, sf_dir)
    labelled = regions.label(v.where("v > 1100"), ONE).withColumn("p8", F.col("v"))
    return regions.cleaned(labelled, v, 1, 1150, ONE)


@query()
def watershed_events(spark, sf_dir):
    return regions.watershed_events(_probamap(spark, sf_dir), None, 0, 0, dt=3, dxy=5)


# --- matching and scores

_SIDES = f"""{with_views("points")},
det AS (SELECT * FROM points WHERE roi_idx % 2 = 0), truth AS (SELECT * FROM points WHERE roi_idx % 2 = 1),
near AS (SELECT d.movie_id, d.roi_idx AS d, g.roi_idx AS g, sqrt((d.y - g.y) * (d.y - g.y) + (d.x - g.x) * (d.x - g.x))::DOUBLE + abs(d.t - g.t) AS mix
         FROM det d JOIN truth g ON d.movie_id = g.movie_id AND abs(d.t - g.t) <= 1 AND sqrt((d.y - g.y) * (d.y - g.y) + (d.x - g.x) * (d.x - g.x)) <= 6)"""
_GREEDY = _SIDES.replace("WITH ", "WITH RECURSIVE ", 1) + """,
choices AS MATERIALIZED (SELECT movie_id, d, list(g ORDER BY mix, g) AS ids, row_number() OVER (PARTITION BY movie_id ORDER BY d) AS k FROM near GROUP BY movie_id, d),
fold AS (SELECT DISTINCT movie_id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS d, NULL::BIGINT AS m FROM choices
  UNION ALL SELECT movie_id, k, CASE WHEN m IS NULL THEN taken ELSE list_append(taken, m) END, d, m FROM (
    SELECT c.movie_id, c.k, f.taken, c.d, list_filter(c.ids, lambda i: NOT list_contains(f.taken, i))[1] AS m FROM fold f JOIN choices c ON c.movie_id = f.movie_id AND c.k = f.k + 1)),
matched AS (SELECT d.movie_id, d.roi_idx, d.t, d.y, d.x, f.m AS match FROM det d LEFT JOIN fold f ON f.movie_id = d.movie_id AND f.d = d.roi_idx)"""


def _sides(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return p.where("roi_idx % 2 = 0"), p.where("roi_idx % 2 = 1")


@query(f"""{_GREEDY},
hit AS (SELECT movie_id, count(match) AS tp, count(*) - count(match) AS fp FROM matched GROUP BY movie_id),
missed AS (SELECT movie_id, count(*) AS fn FROM truth WHERE roi_idx NOT IN (SELECT g FROM near) GROUP BY movie_id)
SELECT movie_id, tp, fp, coalesce(fn, 0) AS fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + coalesce(fn, 0))::DOUBLE AS recall FROM hit LEFT JOIN missed USING (movie_id)""")
def match_greedy(spark, sf_dir):
    return matching.compare(*_sides(spark, sf_dir), dxy=6, dt=1)


@query(f"{_GREEDY}\nSELECT movie_id, roi_idx, t, y, x FROM matched WHERE match IS NULL")
def false_positives(spark, sf_dir):
    return matching.false_positives(*_sides(spark, sf_dir), dxy=6, dt=1).select("movie_id", *matching.POINT)


@query(f"{_SIDES}\nSELECT movie_id, roi_idx, t, y, x FROM truth WHERE roi_idx NOT IN (SELECT g FROM near)")
def false_negatives(spark, sf_dir):
    return matching.false_negatives(*_sides(spark, sf_dir), dxy=6, dt=1).select("movie_id", *matching.POINT)


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


@query("""WITH c AS (SELECT quality, count(*) AS k, sum(CAST(quality = toxic AS DOUBLE)) AS r FROM labels GROUP BY quality)
SELECT CAST(sum(k) AS BIGINT) AS n, sum(r) / sum(k) AS accuracy, avg(r / k) AS balanced_accuracy FROM c""")
def window_scores(spark, sf_dir):
    return matching.window_scores(_labels(spark, sf_dir))


@query("""WITH c AS (SELECT quality AS c FROM labels UNION SELECT toxic FROM labels)
SELECT a.c AS y_true, b.c AS y_pred, (SELECT count(*) FROM labels WHERE quality = a.c AND toxic = b.c) AS n FROM c a, c b""")
def confusion(spark, sf_dir):
    return matching.confusion(_labels(spark, sf_dir))


@query("""SELECT l_linenumber AS epoch, sum(l_quantity * l_extendedprice) / greatest(sum(l_quantity), 1) AS loss, sum(l_quantity - l_linenumber) / greatest(sum(l_quantity), 1) AS accuracy
FROM (SELECT l_linenumber, l_quantity, floor(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY l_linenumber""")
def epoch_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_quantity").alias("size"), F.floor("l_extendedprice").cast("double").alias("loss"), (F.col("l_quantity") - F.col("l_linenumber")).alias("correct"))
    return matching.epoch_metrics(rows)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: CAST(v AS DOUBLE)) AS z FROM embeddings),
o AS (SELECT vec_id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS w FROM e)
SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INT) AS best, list_transform(w, lambda v: round(v / list_sum(w), 9)) AS p FROM o""")
def softmax_argmax(spark, sf_dir):
    z = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z")).select("vec_id", argmax(F.col("z")).alias("best"), F.transform(softmax(F.col("z")), lambda v: F.round(v, 9)).alias("p"))


# --- points

@query(f"""{with_views("points")}
SELECT DISTINCT movie_id, CAST(greatest(0, least(29, round_even(t + 0.5, 0))) AS INT) AS t, CAST(greatest(0, least(149, round_even(y / 4.0::DOUBLE, 0))) AS INT) AS y, CAST(greatest(0, least(96, round_even(x * 1.5, 0))) AS INT) AS x FROM points""")
def clean_points(spark, sf_dir):
    p = views.points(spark, sf_dir).select("movie_id", (F.col("t") + 0.5).cast("double").alias("t"), (F.col("y") / 4).alias("y"), (F.col("x") * 1.5).cast("double").alias("x"))
    return points.clean(p, _point_movies(spark, sf_dir))


@query(f"{with_views('points')}\nSELECT movie_id, roi_idx, 29 - t AS t, y, x FROM points")
def reverse_points(spark, sf_dir):
    return points.reverse(views.points(spark, sf_dir), _point_movies(spark, sf_dir))


@query(f"{with_views('voxels')}\nSELECT movie_id, (SELECT max(t) FROM voxels m WHERE m.movie_id = v.movie_id) - t AS t, y, x, v FROM voxels v")
def reverse_movie(spark, sf_dir):
    return views.voxels(points.reverse_frames(views.frames(spark, sf_dir)))


@query(f"""{with_views("points")}
SELECT movie_id, roi_idx, CAST(greatest(0, least(59, round_even(t * 59 / 29.0::DOUBLE, 0))) AS INT) AS t, CAST(greatest(0, least(74, round_even(y * 74 / 149.0::DOUBLE, 0))) AS INT) AS y, 0 AS x FROM points""")
def prepare_points(spark, sf_dir):
    sizes = _point_movies(spark, sf_dir).select("movie_id", "n_frames", "h", F.lit(1).alias("w"), F.lit(60).alias("new_frames"), F.lit(75).alias("new_h"), F.lit(9).alias("new_w"))
    return points.prepare(views.points(spark, sf_dir), sizes)


@query(f"""{with_views("points")}
SELECT movie_id, roi_idx, printf('%04d-%04d-%04d', t + 1, y, x) AS name, t + 1 AS position, CASE roi_idx % 5 WHEN 1 THEN 'red' WHEN 2 THEN 'blue' WHEN 3 THEN 'green' WHEN 4 THEN 'yellow' ELSE 'white' END AS colour FROM points""")
def roi_names(spark, sf_dir):
    return points.named(views.points(spark, sf_dir).withColumn("cat", (F.col("roi_idx") % 5).cast("int"))).select("movie_id", "roi_idx", "name", "position", "colour")


@query("""WITH m AS (SELECT n_nationkey AS movie_id, 10 + n_nationkey * 1.5::DOUBLE AS cell_diameter, 2.0::DOUBLE + n_nationkey % 7 AS extrusion_duration FROM nation)
SELECT *, CASE WHEN abs(25.0::DOUBLE - cell_diameter) > 25.0::DOUBLE * 0.3::DOUBLE THEN 25.0::DOUBLE / cell_diameter ELSE 1 END AS ratio_xy,
       CASE WHEN abs(4.5::DOUBLE - extrusion_duration) > 4.5::DOUBLE * 0.3::DOUBLE THEN 4.5::DOUBLE / extrusion_duration ELSE 1 END AS ratio_t FROM m""")
def scale_factors(spark, sf_dir):
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("movie_id"), (10 + F.col("n_nationkey") * 1.5).cast("double").alias("cell_diameter"), (F.lit(2.0) + F.col("n_nationkey") % 7).cast("double").alias("extrusion_duration"))
    return points.scale_factors(m, 25.0, 4.5)


@query("""WITH files AS (SELECT n_name AS name, '_' || lower(r_name) AS suffix FROM nation JOIN region ON n_regionkey = r_regionkey),
classes AS (SELECT '_' || lower(r_name) AS suffix, CAST(r_regionkey AS INT) AS cat FROM region WHERE r_regionkey < 3)
SELECT suffix, name, cat FROM files JOIN classes USING (suffix)""")
def class_suffix_join(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("_"), F.lower("r_name")).alias("suffix"))
    files = table(spark, sf_dir, "nation").join(region, "n_regionkey").select("suffix", F.col("n_name").alias("name"))
    return points.with_class(files, region.where("n_regionkey < 3").select("suffix", F.col("n_regionkey").cast("int").alias("cat")))


@query("""SELECT n_name AS name, '_' || lower(r_name) AS suffix FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) NOT IN ('asia', 'europe')""")
def dropped_files(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("_"), F.lower("r_name")).alias("suffix"))
    files = table(spark, sf_dir, "nation").join(region, "n_regionkey").select(F.col("n_name").alias("name"), "suffix")
    return points.remap(files, {"_asia": "_late_asia", "_europe": "_nothing"})[1]


@query(f"""{with_views("points")}, by_file AS (SELECT movie_id, '_' || CAST(roi_idx % 3 AS VARCHAR) AS suffix, count(*) AS n FROM points GROUP BY ALL)
SELECT movie_id, '{{' || string_agg('"' || suffix || '":' || n, ',' ORDER BY suffix) || '}}' AS rois FROM by_file GROUP BY movie_id""")
def roi_counts(spark, sf_dir):
    p = views.points(spark, sf_dir).withColumn("suffix", F.concat(F.lit("_"), (F.col("roi_idx") % 3).cast("string")))
    return points.counts_by_file(p).select("movie_id", F.to_json("rois").alias("rois"))


# --- resampling

def _zoom_sql(order: int, n_in: int, n_out: int) -> str:
    near = f"SELECT o, i, 1 - abs(spot - i) AS w FROM places, range({n_in}) r(i) WHERE abs(spot - i) < 1" if order else "SELECT o, CAST(floor(spot + 0.5) AS INT) AS i, 1.0::DOUBLE AS w FROM places"
    return f"""{with_views("voxels")}, places AS (SELECT CAST(o AS INT) AS o, o * {n_in - 1}::DOUBLE / {n_out - 1} AS spot FROM range({n_out}) r(o)), wt AS ({near}),
a AS (SELECT movie_id, t, o AS y, x, sum(v * w) AS v FROM voxels JOIN wt ON y = i GROUP BY ALL)
SELECT movie_id, t, y, o AS x, round(sum(v * w), 6) AS v FROM a JOIN wt ON x = i GROUP BY movie_id, t, y, o"""


def _zoom(spark, sf_dir, order, n):
    w = resample.weights(spark, 8, n, order)
    out = resample.resize_axis(resample.resize_axis(_voxels(spark, sf_dir), "y", w), "x", w)
    return out.select("movie_id", "t", "y", "x", F.round("v", 6).alias("v"))


@query(_zoom_sql(0, 8, 13))
def zoom_nearest(spark, sf_dir):
    return _zoom(spark, sf_dir, 0, 13)


@query(_zoom_sql(1, 8, 5))
def zoom_linear(spark, sf_dir):
    return _zoom(spark, sf_dir, 1, 5)


@query()
def zoom_cubic(spark, sf_dir):
    return views.voxels(resample.resize(views.frames(spark, sf_dir), 12, 10, 3)).withColumn("v", F.round("v", 6))


# --- sampling

_SAMPLING = f"""{with_views("points")},
high AS (SELECT movie_id, greatest(150, max(y) + 1) AS h FROM points GROUP BY movie_id),
roi AS (SELECT movie_id, CASE WHEN roi_idx % 5 = 0 THEN 2 ELSE 1 END AS cat, roi_idx, t, y, x, h FROM points JOIN high USING (movie_id)),
counts AS (SELECT movie_id, cat, count(*) AS n FROM roi GROUP BY ALL),
balance AS (SELECT *, max(n) OVER (PARTITION BY movie_id) AS nmax FROM counts),
quotas AS (SELECT *, CAST(ceil((CASE WHEN n < 0.75::DOUBLE * nmax THEN 0.85::DOUBLE * nmax ELSE n END) * 2) AS BIGINT) AS quota FROM balance)"""


def _rois(spark, sf_dir):
    return views.points(spark, sf_dir).select("movie_id", F.when(F.col("roi_idx") % 5 == 0, 2).otherwise(1).alias("cat"), "roi_idx", "t", "y", "x")


def _roi_movies(spark, sf_dir):
    """The movies of the points, as high as their points reach."""
    high = views.points(spark, sf_dir).groupBy("movie_id").agg(F.greatest(F.lit(150), F.max("y") + 1).alias("h"))
    return high.select("movie_id", F.lit(30).alias("n_frames"), "h", F.lit(97).alias("w"))


@query(f"{_SAMPLING}\nSELECT movie_id, cat, n, nmax, quota FROM quotas")
def class_balance(spark, sf_dir):
    return sampling.balance(_rois(spark, sf_dir), 2)


def _jitter_sql(*key: str) -> str:
    reach = {"t": "2.0", "y": "0.8", "x": "0.8"}
    return ", ".join(f"CAST(floor({c} + ({md5_uniform(*key, repr(c))} * 2 - 1) * {r}::DOUBLE) AS INT) AS {c}" for c, r in reach.items())


_FITS = "x - 4 >= 0 AND x + 5 <= 97 AND y - 4 >= 0 AND y + 5 <= h AND t - 5 >= 0 AND t + 5 <= 30"
_SPLIT = f"CASE WHEN {md5_uniform(chr(39) + '0' + chr(39), chr(39) + 'split' + chr(39), 'movie_id', 'cat', 'roi_idx')} < 0.1 THEN 'val' ELSE 'train' END"


def _samples_sql(rep: int) -> str:
    return f"""sides{rep} AS (SELECT *, {_SPLIT} AS split, row_number() OVER (PARTITION BY movie_id, cat ORDER BY roi_idx) - 1 AS place FROM roi),
own{rep} AS (SELECT movie_id, roi_idx AS seq, {_jitter_sql("'0'", f"'{rep}'", "movie_id", "cat", "roi_idx")}, cat, false AS noisy, split, h FROM sides{rep}),
tries{rep} AS (SELECT q.movie_id, q.cat, k, quota, CAST(floor({md5_uniform("'0'", f"'{rep}'", "'pick'", "q.movie_id", "q.cat", "k")} * n) AS BIGINT) AS place
  FROM quotas q, LATERAL (SELECT unnest(range(1, quota * 40 + 1)) AS k)),
placed{rep} AS (SELECT movie_id, cat, k, quota, split, h, {_jitter_sql("'0'", f"'{rep}'", "'copy'", "movie_id", "cat", "k")} FROM tries{rep} JOIN sides{rep} USING (movie_id, cat, place)),
copies{rep} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_id, cat ORDER BY k) AS turn FROM placed{rep} WHERE {_FITS}) WHERE turn <= quota),
samples{rep} AS (SELECT movie_id, {rep} AS rep, seq, t, y, x, cat, noisy, split FROM own{rep} WHERE {_FITS}
  UNION ALL SELECT movie_id, {rep}, k + 1000000000, t, y, x, cat, true, split FROM copies{rep})"""


@query(f"{_SAMPLING},\n{_samples_sql(0)}\nSELECT * FROM samples0")
def sample_rois(spark, sf_dir):
    return sampling.sample_points(_rois(spark, sf_dir), _roi_movies(spark, sf_dir), SMALL, 2)


_PICKED = _SAMPLING.replace("CASE WHEN roi_idx % 5 = 0 THEN 2 ELSE 1 END", "0")


@query(f"{_PICKED},\n{_samples_sql(0)}\nSELECT * FROM samples0")
def sample_negatives(spark, sf_dir):
    """Every point taken as a hand-picked place with nothing."""
    return sampling.sample_negatives(_rois(spark, sf_dir), _roi_movies(spark, sf_dir), SMALL, 2, 2)


@query(f"""{_SAMPLING},\n{_samples_sql(0)}
SELECT movie_id, cat, t, y, x FROM samples0 WHERE split = 'train' INTERSECT SELECT movie_id, cat, t, y, x FROM samples0 WHERE split = 'val'""")
def split_overlap(spark, sf_dir):
    return jobs.split_overlap(sampling.sample_points(_rois(spark, sf_dir), _roi_movies(spark, sf_dir), SMALL, 2))


_Q = lambda *w: md5_uniform("'0'", "'0'", *w)


_NOTHING = f"""most AS (SELECT movie_id, CAST(ceil(max(n) * 1.2::DOUBLE * 2) AS BIGINT) AS quota, h FROM counts JOIN high USING (movie_id) GROUP BY movie_id, h),
taken AS (SELECT DISTINCT movie_id, CAST(t + dt AS BIGINT) AS t, CAST(y + dy AS BIGINT) AS y, CAST(x + dx AS BIGINT) AS x FROM (SELECT DISTINCT movie_id, t, y, x FROM roi), range(-5, 6) a(dt), range(-5, 5) b(dy), range(-4, 4) c(dx)),
places AS (SELECT movie_id, t, y, x FROM most, range(5, 26) a(t), LATERAL (SELECT unnest(range(4, h - 4)) AS y), range(4, 93) c(x)),
free AS (SELECT movie_id, t, y, x, row_number() OVER (PARTITION BY movie_id ORDER BY (t - 5) // 4, (y - 4) // 16, (x - 4) // 16, t, y, x) - 1 AS number, count(*) OVER (PARTITION BY movie_id) AS free
  FROM places ANTI JOIN taken USING (movie_id, t, y, x)),
draws AS (SELECT movie_id, k, CAST(least(floor(({_Q("'nothing'", "movie_id", "k")} + {_Q("'finer'", "movie_id", "k")} / 4294967296.0::DOUBLE) * free), free - 1) AS BIGINT) AS number
  FROM most JOIN (SELECT movie_id, max(free) AS free FROM free GROUP BY movie_id) USING (movie_id), LATERAL (SELECT unnest(range(1, quota + 1)) AS k)),
nothing AS (SELECT movie_id, 0 AS rep, k + 2000000000 AS seq, CAST(t AS INT) AS t, CAST(y AS INT) AS y, CAST(x AS INT) AS x, 0 AS cat, {_Q("'noise'", "movie_id", "k")} < 0.5 AS noisy,
  CASE WHEN {_Q("'side'", "movie_id", "k")} < 0.1 THEN 'val' ELSE 'train' END AS split
FROM draws JOIN free USING (movie_id, number))"""


@query(f"{_SAMPLING},\n{_NOTHING}\nSELECT * FROM nothing")
def sample_nothing(spark, sf_dir):
    return sampling.sample_nothing(_rois(spark, sf_dir), _roi_movies(spark, sf_dir), SMALL, 2)


@query(f"{_SAMPLING},\n{_samples_sql(0)},\n{_NOTHING}\nSELECT * FROM samples0 UNION ALL SELECT * FROM nothing")
def sample_all(spark, sf_dir):
    return jobs.sample_all(_rois(spark, sf_dir), None, _roi_movies(spark, sf_dir), SMALL, naug=2, val_ratio=0.1)


@query(f"""{with_views("mosaic")},
samples AS (SELECT DISTINCT movie_id, t, CAST(4 + t % 8 AS INT) AS y, CAST(4 + t * 3 % 8 AS INT) AS x FROM mosaic),
cubes AS (SELECT s.movie_id, s.t, s.y, s.x, v, min(v) OVER w AS low, max(v) OVER w AS high, count(*) OVER w AS n
  FROM samples s JOIN mosaic m ON m.movie_id = s.movie_id AND m.t BETWEEN s.t - 5 AND s.t + 4 AND m.y BETWEEN s.y - 4 AND s.y + 4 AND m.x BETWEEN s.x - 4 AND s.x + 4
  WINDOW w AS (PARTITION BY s.movie_id, s.t)),
whole AS (SELECT *, floor((v - low)::DOUBLE / CASE WHEN high > low THEN high - low ELSE 1 END * 255) AS s FROM cubes WHERE n = 810)
SELECT movie_id, t, y, x, count(*) AS n, round(sum(s / 255), 4) AS total, round(max(s / 255), 6) AS high FROM whole GROUP BY movie_id, t, y, x""")
def training_windows(spark, sf_dir):
    """A window around one place of every frame of the mosaic."""
    images = views.mosaic(spark, sf_dir)
    samples = images.select("movie_id", "t", (4 + F.col("t") % 8).cast("int").alias("y"), (4 + F.col("t") * 3 % 8).cast("int").alias("x"))
    cube = jobs.sample_windows(samples, images, SMALL).withColumn("total", F.aggregate("cube", F.lit(0.0), lambda s, v: s + v))
    return cube.select("movie_id", "t", "y", "x", F.size("cube").cast("bigint").alias("n"), F.round("total", 4).alias("total"), F.round(F.array_max("cube"), 6).alias("high"))


@query(f"""{with_views("voxels")},
shapes AS (SELECT movie_id, max(t) + 1 AS n, max(y) + 1 AS h, max(x) + 1 AS w, 10.0::DOUBLE + 4 * movie_id AS diameter, 1.5::DOUBLE + movie_id AS duration FROM voxels GROUP BY movie_id),
ratios AS (SELECT *, CASE WHEN abs(diameter - 25) > 25 * 0.3::DOUBLE THEN 25 / diameter ELSE 1 END AS rxy, CASE WHEN abs(duration - 4.5) > 4.5 * 0.3::DOUBLE THEN 4.5 / duration ELSE 1 END AS rt FROM shapes),
bright AS (SELECT movie_id, count(*) AS n_points FROM voxels WHERE v > 1350 GROUP BY movie_id)
SELECT movie_id, round(rxy, 9) AS ratio_xy, round(rt, 9) AS ratio_t, CAST(n AS INT) AS n_in, CAST(round_even(n * rt, 0) AS INT) AS n_out, CAST(round_even(h * rxy, 0) AS INT) AS h_out, CAST(round_even(w * rxy, 0) AS INT) AS w_out, n_points
FROM ratios LEFT JOIN bright USING (movie_id)""")
def prepare_summary(spark, sf_dir):
    """What preparing the movies at the model's scale changes; bright voxels are the points of one class."""
    frames = views.frames(spark, sf_dir)
    spots = views.voxels(frames).where("v > 1350").withColumn("file", F.concat(F.col("movie_id").cast("string"), F.lit("_cell_death.zip"))).withColumn("roi_idx", F.monotonically_increasing_id())
    scales = frames.select("movie_id").distinct().select("movie_id", (10.0 + 4 * F.col("movie_id")).alias("cell_diameter"), (1.5 + F.col("movie_id")).cast("double").alias("extrusion_duration"))
    _, _, summary = jobs.prepare(frames, spots, scales, Config())
    own = F.map_values("rois")[0]
    return summary.select("movie_id", F.round("ratio_xy", 9).alias("ratio_xy"), F.round("ratio_t", 9).alias("ratio_t"), F.col("shape_in")[0].alias("n_in"), *[F.col("shape_out")[i].alias(f"{c}_out") for i, c in enumerate("nhw")], own.alias("n_points"))


@query(f"""{_SAMPLING}, sides AS (SELECT movie_id, cat, {_SPLIT} AS split FROM roi)
SELECT movie_id, cat, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'train') AS train FROM sides GROUP BY movie_id, cat""")
def split_leakage(spark, sf_dir):
    sides = sampling.split(_rois(spark, sf_dir), 0.1, 0)
    return sides.groupBy("movie_id", "cat").agg(F.count(F.when(F.col("split") == "val", 1)).alias("val"), F.count(F.when(F.col("split") == "train", 1)).alias("train"))


@query(f"""{_SAMPLING},\n{_samples_sql(0)},\n{_samples_sql(1)}
SELECT movie_id, rep, seq, t, y, x, cat, noisy, split FROM samples0 UNION ALL SELECT movie_id, rep, seq, t, y, x, cat, noisy, split FROM samples1 WHERE movie_id = 'click' AND split = 'train'""")
def oversample(spark, sf_dir):
    rois, movies = _rois(spark, sf_dir), _roi_movies(spark, sf_dir)
    reps = sampling.repetitions(movies, {"click": 2})
    out = None
    for rep in (0, 1):
        own = movies.join(reps.where(F.col("rep") == rep).select("movie_id"), "movie_id", "left_semi")
        one = sampling.sample_points(rois.join(own.select("movie_id"), "movie_id", "left_semi"), own, SMALL, 2, rep=rep)
        out = one if out is None else out.unionByName(one)
    return sampling.oversampled(out)


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, {md5_uniform("'0'", "'3'", "l_orderkey", "l_linenumber")} AS u FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
r AS (SELECT *, row_number() OVER (ORDER BY u, l_orderkey, l_linenumber) - 1 AS place, count(*) OVER () AS total FROM s)
SELECT l_orderkey, l_linenumber, place // 50 AS batch FROM r WHERE place // 50 < total // 50""")
def minibatches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return sampling.minibatches(rows, 50, 3, keys=("l_orderkey", "l_linenumber"))


def _windows(spark, sf_dir):
    return _voxels(spark, sf_dir).select((F.col("movie_id").cast("bigint") * 1000 + F.col("t")).alias("win_id"), F.lit(0).alias("t"), "y", "x", "v")


_WIN = f"{with_views('voxels')}, win AS (SELECT CAST(movie_id AS BIGINT) * 1000 + t AS win_id, 0 AS t, y, x, v FROM voxels)"


@query(f"""{_WIN}
SELECT win_id, t, CAST(CASE WHEN {md5_uniform("'0'", "'flip'", "'y'", "win_id")} < 0.3 THEN 7 - y ELSE y END AS INT) AS y, CAST(CASE WHEN {md5_uniform("'0'", "'flip'", "'x'", "win_id")} < 0.3 THEN 7 - x ELSE x END AS INT) AS x, v FROM win""")
def flip_augment(spark, sf_dir):
    return sampling.flips(_windows(spark, sf_dir), 8, 8)


def _square_sql(mode: str, value: str) -> str:
    draw = lambda what: md5_uniform("'0'", repr(mode), repr(what), "win_id")
    return f"""{_WIN}, s AS (SELECT *, CAST(floor({draw("side")} * 6) + 1 AS INT) AS side FROM win),
p AS (SELECT *, floor({draw("y")} * (7 - side)) AS y0, floor({draw("x")} * (7 - side)) AS x0 FROM s)
SELECT win_id, t, y, x, CASE WHEN {draw("gate")} < 0.15 AND y BETWEEN y0 AND y0 + side - 1 AND x BETWEEN x0 AND x0 + side - 1 THEN {value} ELSE v END AS v FROM p"""


@query(_square_sql("zero", "0"))
def square_augment(spark, sf_dir):
    return sampling.squares(_windows(spark, sf_dir), 8, 8)


@query(_square_sql("add", "v + 1"))
def square_raised(spark, sf_dir):
    return sampling.squares(_windows(spark, sf_dir), 8, 8, mode="add")


@query()
def noise_augment(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    windows = f.select((F.col("movie_id").cast("bigint") * 1000 + F.col("t")).alias("win_id"), F.lit(1).alias("n"), "h", "w", (F.col("t") % 2 == 0).alias("noisy"), F.col("pixels").cast("array<double>").alias("cube"))
    return augment.noise(windows).select("win_id", "noisy", F.transform("cube", lambda v: F.round(v, 6)).alias("cube"))


# --- size estimate

@query(f"""{with_views("mosaic")}, z AS (SELECT movie_id, t, y, x, CASE WHEN v < 900 THEN 0 ELSE v END AS v FROM mosaic)
SELECT movie_id, t, CAST(y // 4 AS INT) AS ty, CAST(x // 4 AS INT) AS tx, avg(CAST(v <> 0 AS INT)) AS share, avg(CAST(v <> 0 AS INT)) >= 0.9 AS valid FROM z GROUP BY movie_id, t, y // 4, x // 4""")
def tile_validity(spark, sf_dir):
    v = views.voxels(views.mosaic(spark, sf_dir)).withColumn("v", F.when(F.col("v") < 900, 0).otherwise(F.col("v")))
    return spacing.tile_validity(v, 4)


@query("""WITH e AS (SELECT event_type AS movie_id, CAST(event_id % 30 AS INT) AS t, floor(value) + 10 AS s FROM events),
v AS (SELECT movie_id, t, CASE WHEN s::BIGINT % 4 = 0 THEN NULL ELSE s END AS spacing FROM e)
SELECT movie_id, median(spacing) AS spacing, quantile_cont(spacing, 0.25) AS q25, quantile_cont(spacing, 0.75) AS q75, median(spacing) FILTER (t >= 27) / median(spacing) FILTER (t < 13) AS trend,
  count(spacing) AS n_tiles, count(*) AS n_valid, 40 AS n_frames, CASE WHEN count(spacing) < 10 OR count(spacing) < 0.4::DOUBLE * count(*) THEN 'few tiles' WHEN median(spacing) < 8 THEN 'pixel noise' ELSE 'ok' END AS status
FROM v GROUP BY movie_id""")
def spacing_summary(spark, sf_dir):
    """40 sampled frames a movie, of which the last ten are blank and have no tile."""
    s = F.floor("value") + 10
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("movie_id"), (F.col("event_id") % 30).cast("int").alias("t"), F.when(s % 4 != 0, s).cast("double").alias("spacing"))
    frames = e.select("movie_id").distinct().select("movie_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("t"))
    return spacing.spacing_summary(e, frames)


@query(f"""{with_views("mosaic")}, r AS (SELECT movie_id, t, v, CAST(round_even(sqrt((y - 8) * (y - 8) + (x - 8) * (x - 8)), 0) AS INT) AS r FROM mosaic)
SELECT movie_id, t, r, round(avg(v), 6) AS mean FROM r WHERE r <= 7 GROUP BY movie_id, t, r""")
def radial_profile(spark, sf_dir):
    return spacing.radial_mean(views.voxels(views.mosaic(spark, sf_dir)), 8, 8, 7).withColumn("mean", F.round("mean", 6))


@query("""WITH m AS (SELECT p_partkey AS movie_id, p_partkey % 40 + 1 AS n_frames FROM part)
SELECT DISTINCT movie_id, CAST(CASE WHEN least(12, n_frames) = 1 THEN 0 ELSE i * (n_frames - 1) // greatest(1, least(12, n_frames) - 1) END AS INT) AS t FROM m, range(0, 12) r(i) WHERE i < least(12, n_frames)""")
def frame_picks(spark, sf_dir):
    return spacing.frame_picks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id"), (F.col("p_partkey") % 40 + 1).cast("int").alias("n_frames")))


_FILES = """WITH files AS (SELECT DISTINCT p_type || '_' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.bak.zip' ELSE '.tif' END AS name FROM part),
movie AS (SELECT min(p_type) AS stem FROM part)"""


@query(f"""{_FILES} SELECT name, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM files, movie
WHERE starts_with(name, movie.stem || '_') AND ends_with(name, '.zip') AND NOT ends_with(name, '.bak.zip')""")
def roi_files(spark, sf_dir):
    """Point archives of one movie among files named by the parts."""
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, ".zip").when(F.col("p_partkey") % 3 == 1, ".bak.zip").otherwise(".tif")
    movie = part.agg(F.min("p_type").alias("movie"))
    named = part.select(F.concat("p_type", F.lit("_"), "p_brand", kind).alias("name")).distinct().join(F.broadcast(movie))  # one row
    return points.point_files(named, F.col("movie")).select("name", stem(F.col("name")).alias("stem"))


@query("""WITH e AS (SELECT s_suppkey AS movie_id, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS spacing, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 20)::DOUBLE / 10 END AS trend,
  CASE WHEN s_suppkey % 3 > 0 THEN 'ok' ELSE 'few tiles' END AS status FROM supplier WHERE s_suppkey % 11 > 0),
m AS (SELECT s_suppkey AS movie_id, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey::DOUBLE END AS cell_diameter FROM supplier)
SELECT movie_id, coalesce(cell_diameter, spacing) AS cell_diameter, coalesce(cell_diameter IS NULL AND (trend < 0.7::DOUBLE OR trend > 1 / 0.7::DOUBLE), false) AS warn,
  CASE WHEN cell_diameter IS NULL THEN coalesce(status, 'no estimate') ELSE 'given' END AS status FROM m LEFT JOIN e USING (movie_id)""")
def diameters(spark, sf_dir):
    """Suppliers as movies: some with a diameter given, some without an estimate."""
    key, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    estimates = s.where(key % 11 > 0).select(
        key.alias("movie_id"), F.when(key % 3 > 0, F.col("s_acctbal")).alias("spacing"), F.when(key % 7 > 0, (key % 20).cast("double") / 10).alias("trend"), F.when(key % 3 > 0, "ok").otherwise("few tiles").alias("status"))
    return points.resolve_diameter(s.select(key.alias("movie_id"), F.when(key % 5 == 0, F.col("s_nationkey").cast("double")).alias("cell_diameter")), estimates)


@query(f"""{with_views("voxels")} SELECT movie_id, round(quantile_cont(v, 0.01), 6) AS low, round(quantile_cont(v, 0.998), 6) AS high FROM voxels v
WHERE t % greatest(1, (SELECT max(t) + 1 FROM voxels m WHERE m.movie_id = v.movie_id) // 10) = 0 GROUP BY movie_id""")
def contrast_limits(spark, sf_dir):
    limits = spacing.contrast_limits(_voxels(spark, sf_dir))
    return limits.select("movie_id", *[F.round(c, 6).alias(c) for c in ("low", "high")])


@query()
def spacing_fft(spark, sf_dir):
    return spacing.tile_spacings(views.mosaic(spark, sf_dir), 16, 3.0).withColumn("spacing", F.round("spacing", 6))


@query()
def net_forward(spark, sf_dir):
    """Every 8 by 8 frame with the nine before it, through a network of random weights."""
    config = Config(half_size=(4, 4), nframes=(5, 5), ncat=3)
    f = resample.resize(views.frames(spark, sf_dir), 9, 9, 1)
    order = Window.partitionBy("movie_id").orderBy("t").rowsBetween(-9, 0)
    cubes = f.withColumn("ten", F.collect_list("pixels").over(order)).where(F.size("ten") == 10).select((F.col("movie_id").cast("bigint") * 1000 + F.col("t")).alias("win_id"), F.transform(F.flatten("ten"), lambda v: F.floor(v / 8)).cast("array<double>").alias("cube"))
    return network.predict(cubes, network.init(3, 4), config).select("win_id", F.transform("probabilities", lambda p: F.round(p, 5)).alias("probabilities"))
