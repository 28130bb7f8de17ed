"""The registered queries of the engine: each with the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import transform as X
from .operators import layout as L
from .operators import multiscale as M
from .operators import pixels as P
from .operators import statistics as S
from .plans.spec import MODES, Calibration, Options

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The pixel relations in SQL.
PX = {
    "events": "SELECT event_id AS i, CAST(round(value * 100) AS BIGINT) AS v, event_id % 25 AS x, (event_id // 25) % 4 AS y, (event_id // 100) % 5 AS z, (event_id // 500) % 2 AS c, event_id // 1000 AS t FROM events",
    "orders": "SELECT o_orderkey AS i, CAST(round(o_totalprice * 100) AS BIGINT) % 65536 AS v, o_orderkey % 15 AS x, (o_orderkey // 15) % 5 AS y, (o_orderkey // 75) % 5 AS z, (o_orderkey // 375) % 2 AS c, o_orderkey // 750 AS t FROM orders",
    "embed": "SELECT vec_id * 64 + p - 1 AS i, CAST(round((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT) AS v, p - 1 AS x, vec_id AS y FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings)",
}
READ = {"events": P.px_events, "orders": P.px_orders, "embed": P.px_embed}
c, lit = F.col, F.lit


def register(name: str, sql: str | None = None, px: str = "events"):
    """Registers a query on a pixel relation; in ``sql`` that relation is ``px``."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(READ[px](spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH px AS ({PX[px]}) {sql}"
        return f

    return add


def register_table(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _columns(name: str, px: str, columns: dict[str, tuple], keep: tuple[str, ...] = ("i",)) -> None:
    """A projection: for each new column what makes its expression, and its SQL."""
    sql = ", ".join([*keep, *(f"{s} AS {n}" for n, (_, s) in columns.items())])
    register(name, f"SELECT {sql} FROM px", px)(lambda v: v.select(*keep, *(e().alias(n) for n, (e, _) in columns.items())))


# --- scalar functions -------------------------------------------------------------------------------------------
_columns("fn1_sqrt_symbol", "orders", {"q": (lambda: X.q_symbol(c("v")), "CAST(floor(sqrt(v)) AS BIGINT)")})
_columns("fn2_remainder", "orders", {"r": (lambda: X.remainder(c("v")), "v - CAST(floor(sqrt(v)) AS BIGINT) * CAST(floor(sqrt(v)) AS BIGINT)")})
_columns("fn3_rebuild", "orders", {"back": (lambda: X.rebuild(X.q_symbol(c("v")), X.remainder(c("v"))), "v")})
_CALS = {"a": Calibration(100.0, 0.46, 2.0), "b": Calibration(0.0, 1.0, 4.0), "d": Calibration(0.5, 0.25, 1.5)}
_columns("fn4_quantize", "events", {k: (lambda m=m: X.quantize(c("v"), m), f"CAST(round(2 * sqrt(greatest((v - {m.offset}::DOUBLE) * {m.gain}::DOUBLE, 0)) / {m.step}::DOUBLE) AS BIGINT)") for k, m in _CALS.items()})
_columns("fn5_reconstruct", "events", {
    k: (lambda m=m: X.reconstruct(X.quantize(c("v"), m), m), f"CAST(least(greatest(round({m.offset}::DOUBLE + 0.25::DOUBLE * (round(2 * sqrt(greatest((v - {m.offset}::DOUBLE) * {m.gain}::DOUBLE, 0)) / {m.step}::DOUBLE) * {m.step}::DOUBLE) * (round(2 * sqrt(greatest((v - {m.offset}::DOUBLE) * {m.gain}::DOUBLE, 0)) / {m.step}::DOUBLE) * {m.step}::DOUBLE) / {m.gain}::DOUBLE), 0), 65535) AS BIGINT)") for k, m in _CALS.items()
})


@register("fn6_quantize_guard", "SELECT t, c, CAST(max(v) AS BIGINT) AS v_max, CAST(round(2 * sqrt(max(v)) / 4::DOUBLE) AS BIGINT) AS q_max, round(2 * sqrt(max(v)) / 4::DOUBLE) <= 255 AS fits FROM px GROUP BY t, c", "orders")
def _fn6(v: DataFrame) -> DataFrame:
    # quantisation is monotonic, so the greatest value decides
    q = X.quantize(c("v_max"), Calibration(0.0, 1.0, 4.0))
    return v.groupBy("t", "c").agg(F.max("v").alias("v_max")).select("t", "c", "v_max", q.alias("q_max"), (q <= 255).alias("fits"))


_columns("fn7_saturate", "events", {"v8": (lambda: X.saturate8(c("v")), "least(v, 255)")})


@register_table("fn8_reciprocal_gain", "SELECT l_orderkey, l_linenumber, l_quantity, 1 / l_quantity AS reciprocal FROM lineitem WHERE l_quantity > 0")
def _fn8(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_linenumber", "l_quantity", (1 / c("l_quantity")).alias("reciprocal"))


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


register("fn10_dims", "SELECT count(*) AS voxels, 2 * count(*) AS raw_bytes, (max(x) + 1) * (max(y) + 1) AS plane, (max(x) + 1) * (max(y) + 1) * (max(z) + 1) AS volume, (max(x) + 1) * (max(y) + 1) * (max(z) + 1) * (max(c) + 1) * (max(t) + 1) = count(*) AS dense FROM px")(
    lambda v: v.agg(F.count(lit(1)).alias("voxels"), *[(F.max(a) + 1).alias(a) for a in "xyzct"]).select("voxels", (2 * c("voxels")).alias("raw_bytes"), F.expr("x * y").alias("plane"), F.expr("x * y * z").alias("volume"), F.expr("x * y * z * c * t = voxels").alias("dense"))
)
def _n3() -> tuple:
    return c("v") % 7, F.expr("v div 7 % 7"), F.expr("v div 49 % 7")



_S3 = ("(v % 7)", "(v // 7 % 7)", "(v // 49 % 7)")
_MED = "greatest(least({0}, {1}), least(greatest({0}, {1}), {2}))".format(*_S3)
_ORD = "CASE WHEN {0} < {1} THEN 0 WHEN {0} = {1} THEN 1 ELSE 2 END"
_DIF = "CASE WHEN {0} = 0 THEN 0 WHEN {0} = 1 THEN 1 WHEN {0} > 1 THEN 2 WHEN {0} = -1 THEN 3 ELSE 4 END"
_columns("fn11_neighbour_classes", "orders", {"median": (lambda: X.median3(*_n3()), _MED), "ord": (lambda: X.order3(*_n3()[:2]), _ORD.format(*_S3)), "dif": (lambda: X.difference5(_n3()[0] - _n3()[1]), _DIF.format(f"({_S3[0]} - {_S3[1]})"))})


def compact_sql(mode: str, l: str, u: str, p: str) -> str:
    med = f"greatest(least({l}, {u}), least(greatest({l}, {u}), {p}))"
    return {
        "mean": f"({l} + {u} + {p})",
        "meansigns": f"(({l} + {u} + {p}) * 3 + {_ORD.format(l, u)})",
        "signs": f"(({med} * 3 + {_ORD.format(l, u)}) * 3 + {_ORD.format(p, med)})",
        "signed3": f"(({med} * 5 + {_DIF.format(f'({l} - {u})')}) * 5 + {_DIF.format(f'({p} - {med})')})",
    }[mode]


_columns("fn12_compact_contexts", "orders", {m: (lambda m=m: X.compact_context(*_n3(), m), compact_sql(m, *_S3)) for m in MODES})
register("fn13_context_counts", "SELECT t, c, " + ", ".join(f"{k} * a + a + 1 AS n_{m}" for m, (_, k) in MODES.items()) + " FROM (SELECT t, c, CAST(floor(sqrt(max(v))) AS BIGINT) + 1 AS a FROM px GROUP BY t, c)", "orders")(
    lambda v: v.groupBy("t", "c").agg((F.max(X.q_symbol(c("v"))) + 1).alias("a")).select("t", "c", *[(k * c("a") + c("a") + 1).alias(f"n_{m}") for m, (_, k) in MODES.items()])
)
register("fn14_throughput", "SELECT t, (count(*) * 2)::DOUBLE / 1048576 AS mib, (count(*) * 2)::DOUBLE / 1e9::DOUBLE / (max(c) + 1) AS gb_s FROM px GROUP BY t")(
    lambda v: v.groupBy("t").agg((F.count(lit(1)) * 2).cast("double").alias("b"), (F.max("c") + 1).alias("s")).select("t", (c("b") / 1048576).alias("mib"), (c("b") / lit(1e9) / c("s")).alias("gb_s"))
)
_UNITS = ["nm", " Micron ", "MM", "inches", "metres"]
_columns("fn15_micrometres", "events", {"um": (lambda: T.micrometres(c("v").cast("double"), F.element_at(F.array(*map(lit, _UNITS)), (c("i") % 5 + 1).cast("int"))), "CASE i % 5 WHEN 0 THEN v * 0.001::DOUBLE WHEN 1 THEN v * 1.0::DOUBLE WHEN 2 THEN v * 1000.0::DOUBLE WHEN 4 THEN v * 1000000.0::DOUBLE END")})
_columns("fn16_pixel_size", "events", {"um": (lambda: T.pixel_size(c("v"), c("i") % 10, c("i") % 4), "CASE WHEN v > 0 AND i % 10 > 0 THEN CASE i % 4 WHEN 2 THEN 25400.0::DOUBLE WHEN 3 THEN 10000.0::DOUBLE END * (i % 10) / v END")})
register("fn17_level_scale", "SELECT DISTINCT y AS level, 0.5::DOUBLE * 25 / greatest(25 // (1 + y), 1) AS sx FROM px")(
    lambda v: v.select(c("y").alias("level"), (lit(0.5) * 25 / F.greatest(F.expr("25 div (1 + y)"), lit(1))).alias("sx")).distinct()
)

# --- contexts and models ----------------------------------------------------------------------------------------
_NEAR = """
, q AS (SELECT *, CAST(floor(sqrt(v)) AS BIGINT) AS q FROM px),
n AS (SELECT *, max(q) OVER (PARTITION BY t, c) + 1 AS a, z % 4 AS lz,
  coalesce(lag(q, 1) OVER w, 0) AS l, coalesce(lag(q, {x}) OVER w, 0) AS u, coalesce(lag(q, {xy}) OVER w, 0) AS p
  FROM q WINDOW w AS (PARTITION BY t, c, z // 4 ORDER BY i)),
k AS (SELECT *, {case} AS ctx FROM n)
"""


def _context_sql(mode: str, g: P.Geometry) -> str:
    base = MODES[mode][1]
    edge = "y = 0" if mode.startswith("mean") else "y = 0 OR lz = 0"
    back = "(CASE WHEN lz = 0 THEN (l + u) // 2 ELSE p END)"
    case = f"CASE WHEN x = 0 THEN {base} * a + a WHEN {edge} THEN {base} * a + l ELSE {compact_sql(mode, 'l', 'u', back)} END"
    return _NEAR.format(x=g.x, xy=g.x * g.y, case=case)


for _mode in MODES:
    register(f"wn1_context_{_mode}", _context_sql(_mode, P.EVENTS) + " SELECT i, q, ctx FROM k")(lambda v, m=_mode: P.contexts(v, P.EVENTS, Options(mode=m)).select("i", "q", "ctx"))
    register(f"q_context_histogram_{_mode}", _context_sql(_mode, P.EVENTS) + " SELECT t, c, ctx, q, count(*) AS cnt FROM k GROUP BY t, c, ctx, q")(
        lambda v, m=_mode: P.contexts(v, P.EVENTS, Options(mode=m)).groupBy("t", "c", "ctx", "q").agg(F.count(lit(1)).alias("cnt"))
    )
register("ag1_r_histogram", "SELECT t, c, q, v - q * q AS r, count(*) AS cnt FROM (SELECT *, CAST(floor(sqrt(v)) AS BIGINT) AS q FROM px) GROUP BY ALL", "orders")(
    lambda v: v.select("t", "c", X.q_symbol(c("v")).alias("q"), X.remainder(c("v")).alias("r")).groupBy("t", "c", "q", "r").agg(F.count(lit(1)).alias("cnt"))
)
register("ag2_lossy_histogram", "SELECT t, c, CAST(round(2 * sqrt(greatest((v - 100::DOUBLE) * 0.46::DOUBLE, 0)) / 2::DOUBLE) AS BIGINT) AS q, count(*) AS cnt FROM px GROUP BY ALL")(
    lambda v: v.select("t", "c", X.quantize(c("v"), _CALS["a"]).alias("q")).groupBy("t", "c", "q").agg(F.count(lit(1)).alias("cnt"))
)
register("ag3_alphabet", "SELECT t, c, CAST(floor(sqrt(max(v))) AS BIGINT) AS q_max, 2 * CAST(floor(sqrt(max(v))) AS BIGINT) AS r_max FROM px GROUP BY t, c", "orders")(
    lambda v: v.groupBy("t", "c").agg(F.max(X.q_symbol(c("v"))).alias("q_max")).select("t", "c", "q_max", (2 * c("q_max")).alias("r_max"))
)
# frequencies: floors with at least 1, then the largest remainders; the rows here have no surplus but where checked in tests
_FREQ = """
, h AS (SELECT t, c, CAST(floor(sqrt(v)) AS BIGINT) // 8 AS q, count(*) AS cnt FROM px GROUP BY ALL),
f AS (SELECT *, sum(cnt) OVER w AS s, count(*) OVER w AS k, greatest(cnt * 1024 // sum(cnt) OVER w, 1) AS f, cnt * 1024 % sum(cnt) OVER w AS rem FROM h WINDOW w AS (PARTITION BY t, c)),
g AS (SELECT *, 1024 - sum(f) OVER (PARTITION BY t, c) AS gap, row_number() OVER (PARTITION BY t, c ORDER BY rem DESC, q) - 1 AS place FROM f),
m AS (SELECT t, c, q, cnt, CAST(f + CASE WHEN gap > 0 THEN gap // k + CASE WHEN place < gap % k THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS freq, gap FROM g)
"""
_MODEL = lambda v: S.normalize_counts(v.select("t", "c", F.expr("cast(floor(sqrt(v)) as bigint) div 8").alias("q")).groupBy("t", "c", "q").agg(F.count(lit(1)).alias("cnt")), ["t", "c"], "q", "cnt", 10)
register("md2_model", _FREQ + "SELECT t, c, q, cnt, freq, CAST(sum(freq) OVER (PARTITION BY t, c ORDER BY q) - freq AS BIGINT) AS cum FROM m", "orders")(_MODEL)
register("wn4_cumulative", _FREQ + "SELECT t, c, q, CAST(sum(freq) OVER (PARTITION BY t, c ORDER BY q) - freq AS BIGINT) AS cum FROM m", "orders")(lambda v: _MODEL(v).select("t", "c", "q", "cum"))
register("so3_largest_remainders", _FREQ + "SELECT t, c, q FROM g WHERE place < gap", "orders")(
    lambda v: v.select("t", "c", F.expr("cast(floor(sqrt(v)) as bigint) div 8").alias("q")).groupBy("t", "c", "q").agg(F.count(lit(1)).alias("n")).withColumn("s", F.sum("n").over(Window.partitionBy("t", "c"))).withColumn("f", F.expr("greatest(n * 1024 div s, 1)")).withColumn("gap", 1024 - F.sum("f").over(Window.partitionBy("t", "c"))).withColumn("place", F.row_number().over(Window.partitionBy("t", "c").orderBy(F.expr("n * 1024 % s").desc(), "q")) - 1).where("place < gap").select("t", "c", "q")
)
register("wn7_deltas", "SELECT t, c, q, q - coalesce(lag(q) OVER (PARTITION BY t, c ORDER BY q), 0) AS delta FROM (SELECT DISTINCT t, c, CAST(floor(sqrt(v)) AS BIGINT) AS q FROM px)", "orders")(
    lambda v: v.select("t", "c", X.q_symbol(c("v")).alias("q")).distinct().withColumn("delta", c("q") - F.coalesce(F.lag("q").over(Window.partitionBy("t", "c").orderBy("q")), lit(0)))
)
register("so4_active_symbols", "SELECT t, c, string_agg(q, ',' ORDER BY q) AS symbols FROM (SELECT DISTINCT t, c, CAST(floor(sqrt(v)) AS BIGINT) AS q FROM px) GROUP BY t, c")(
    lambda v: v.groupBy("t", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_set(X.q_symbol(c("v")))), lambda x: x.cast("string")), ",").alias("symbols"))
)
register("wn3_lanes", "SELECT i, (i - min(i) OVER (PARTITION BY t, c, z // 4)) % 4 AS lane FROM px")(lambda v: v.select("i", ((c("i") - F.min("i").over(Window.partitionBy("t", "c", F.expr("z div 4")))) % 4).alias("lane")))
# --- block plans and statistics ---------------------------------------------------------------------------------
_BLOCKS = ", b AS (SELECT t, c, z // 4 AS b, count(DISTINCT z) AS depth, CAST(sum(CASE WHEN v % 3 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS coded FROM px GROUP BY t, c, z // 4)"


def _blocks(v: DataFrame) -> DataFrame:
    return v.groupBy("t", "c", F.expr("z div 4").alias("b")).agg(F.countDistinct("z").alias("depth"), F.sum(F.when(c("v") % 3 == 0, 3).otherwise(1)).alias("coded"))


register("ag4_raw_plan", _BLOCKS + ", s AS (SELECT *, 20 + depth * 100 * 2 AS stored, 52 + coded AS record FROM b) SELECT t, c, b, stored, record, record >= stored OR sum(CASE WHEN record >= stored THEN stored ELSE record END) OVER w + 60 >= sum(stored) OVER w AS raw FROM s WINDOW w AS (PARTITION BY t, c)")(
    lambda v: S.raw_plan(_blocks(v).withColumn("model_bytes", lit(60)), 100, 2).select("t", "c", "b", "stored", "record", "raw")
)
register("ag5_stats", _BLOCKS + " SELECT t, CAST(sum(depth) * 200 AS BIGINT) AS raw_bytes, CAST(sum(coded) AS BIGINT) AS coded_bytes, count(*) AS blocks, count(DISTINCT c) AS volumes, max(coded) AS most FROM b GROUP BY t")(
    lambda v: _blocks(v).groupBy("t").agg((F.sum("depth") * 200).alias("raw_bytes"), F.sum("coded").alias("coded_bytes"), F.count(lit(1)).alias("blocks"), F.countDistinct("c").alias("volumes"), F.max("coded").alias("most"))
)
_REC = "CAST(least(greatest(round(100::DOUBLE + 0.25::DOUBLE * (round(2 * sqrt(greatest((v - 100::DOUBLE) * 0.46::DOUBLE, 0)) / 2::DOUBLE) * 2::DOUBLE) * (round(2 * sqrt(greatest((v - 100::DOUBLE) * 0.46::DOUBLE, 0)) / 2::DOUBLE) * 2::DOUBLE) / 0.46::DOUBLE), 0), 65535) AS BIGINT)"
register("ag6_errors", f"SELECT t, c, count(*) AS n, sqrt(CAST(sum(d * d) AS BIGINT) / count(*)) AS rmse, CAST(sum(abs(d)) AS BIGINT) / count(*) AS mae, max(abs(d)) AS max_abs, sqrt(CAST(sum(d * d) AS BIGINT) / count(*)) * 0.46::DOUBLE AS rmse_electrons FROM (SELECT t, c, v - {_REC} AS d FROM px) GROUP BY t, c")(
    lambda v: S.errors(v.select("t", "c", c("v").alias("a"), X.reconstruct(X.quantize(c("v"), _CALS["a"]), _CALS["a"]).alias("b")), 0.46, ["t", "c"])
)
register("ag7_median", "SELECT t, c, median(v) AS median FROM px GROUP BY t, c")(lambda v: v.groupBy("t", "c").agg(F.median("v").alias("median")))
_W = "(CASE WHEN y = {ny} - 1 THEN {wy} ELSE 1 END * CASE WHEN x = {nx} - 1 THEN {wx} ELSE 1 END)"
register("ag8_mean_pyramid", f"SELECT t, c, z, y // 2 AS y, x // 2 AS x, CAST((sum(v * {_W.format(ny=4, wy=1, nx=25, wx=2)}) + 2) // 4 AS BIGINT) AS v FROM px GROUP BY t, c, z, y // 2, x // 2")(lambda v: S.mean_level(v, {"y": 4, "x": 25}, {"y": 2, "x": 2}))
register("ag9_box_mean", f"SELECT t, c, z // 2 AS z, y // 2 AS y, x // 4 AS x, CAST((sum(v * {_W.format(ny=5, wy=2, nx=15, wx=2)} * CASE WHEN z = 4 THEN 2 ELSE 1 END) + 8) // 16 AS BIGINT) AS v FROM px GROUP BY t, c, z // 2, y // 2, x // 4", "orders")(lambda v: S.mean_level(v, {"z": 5, "y": 5, "x": 15}, {"z": 2, "y": 2, "x": 4}))
register("ag10_bounds", "SELECT " + ", ".join(f"min({a}) AS {a}_min, max({a}) AS {a}_max" for a in "tczyx") + " FROM px")(lambda v: v.agg(*[f(a).alias(f"{a}_{n}") for a in "tczyx" for n, f in (("min", F.min), ("max", F.max))]))
register("ag11_uniform", "SELECT count(DISTINCT n) = 1 AS same_size, count(*) AS pages FROM (SELECT t, c, z, count(*) AS n FROM px GROUP BY ALL)")(lambda v: v.groupBy("t", "c", "z").agg(F.count(lit(1)).alias("n")).agg((F.countDistinct("n") == 1).alias("same_size"), F.count(lit(1)).alias("pages")))
register("ag13_complete_levels", "SELECT y AS path, 4 AS w, 2 AS h FROM px WHERE v % 11 > 0 GROUP BY y HAVING count(DISTINCT t * 10 + c * 5 + z) = (SELECT count(DISTINCT t * 10 + c * 5 + z) FROM px)")(
    lambda v: L.complete_levels(v.where("v % 11 > 0").select(c("y").alias("path"), F.expr("t * 10 + c * 5 + z").alias("plane"), lit(4).alias("w"), lit(2).alias("h")), v.select("t", "c", "z").distinct().count())
)
# the checksum byte by byte: its table by the rule of the polynomial, then one step for each byte of a plane
_CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS s)"
_CRC_BYTES = "p AS (SELECT t, c, z, list(b ORDER BY y, x, k) AS bs FROM (SELECT t, c, z, y, x, 0 AS k, v % 256 AS b FROM px UNION ALL SELECT t, c, z, y, x, 1, v // 256 FROM px) GROUP BY t, c, z)"
register("ag14_plane_crc", f", {_CRC_TABLE}, {_CRC_BYTES} SELECT t, c, z, CAST(xor(list_reduce(list_concat([4294967295], bs), lambda a, b: xor(a >> 8, s[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS crc FROM p, tab")(
    # two bytes a pixel, whatever lies above them
    lambda v: P.planes(v.withColumn("v", c("v").bitwiseAND(65535))).select("t", "c", "z", F.crc32("pixels").alias("crc"))
)
register("ag12_resident_peak", ", u AS (SELECT t, c, z, min(i // 100) AS a, max(i // 100 + v % 3) AS b, 200 AS n FROM px GROUP BY t, c, z), e AS (SELECT t, a AS p, 0 AS k, n AS d FROM u UNION ALL SELECT t, b, 1, -n FROM u) SELECT t, CAST(max(s) AS BIGINT) AS peak FROM (SELECT t, sum(d) OVER (PARTITION BY t ORDER BY p, k, d DESC ROWS UNBOUNDED PRECEDING) AS s FROM e) GROUP BY t")(
    lambda v: S.resident_peak(v.groupBy("t", "c", "z").agg(F.min(F.expr("i div 100")).alias("first"), F.max(F.expr("i div 100 + v % 3")).alias("last"), lit(200).alias("bytes")), ["t"])
)
# --- reads and joins --------------------------------------------------------------------------------------------
register("sc6_read_plane", "SELECT i, v FROM px WHERE t = 0 AND c = 1 AND z = 3")(lambda v: v.where("t = 0 and c = 1 and z = 3").select("i", "v"))
_REQ = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, 0 AS t, n_nationkey % 2 AS c, n_nationkey * 3 % 5 AS z FROM nation"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    # 25 requests, some of them twice
    return _read(spark, d, "nation").select(c("n_nationkey").cast("long").alias("ord"), lit(0).cast("long").alias("t"), (c("n_nationkey") % 2).cast("long").alias("c"), (c("n_nationkey") * 3 % 5).cast("long").alias("z"))


@register_table("sc7_read_planes", f"WITH px AS ({PX['events']}), r AS ({_REQ}) SELECT ord, y, x, v FROM r JOIN px ON r.t = px.t AND r.c = px.c AND r.z = px.z")
def _sc7(spark: SparkSession, d: str) -> DataFrame:
    return P.read_planes(P.px_events(spark, d), _requests(spark, d), 2).select("ord", "y", "x", "v")


# where each row stands: all rows of earlier requests, then y and x (a frame's planes have 100 rows)
QUERIES["so2_request_order"] = lambda spark, d: (lambda rows: rows.join(rows.groupBy("ord").agg(F.count(lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), lit(0))), "ord").select("ord", "y", "x", "v", (c("before") + c("y") * 25 + c("x")).alias("at")))(_sc7(spark, d))
ORACLES["so2_request_order"] = f"WITH px AS ({PX['events']}), r AS ({_REQ}) SELECT ord, y, x, v, row_number() OVER (ORDER BY ord, y, x) - 1 AS at FROM r JOIN px ON r.t = px.t AND r.c = px.c AND r.z = px.z"
QUERIES["jn1_request_units"] = lambda spark, d: _requests(spark, d).join(P.px_events(spark, d).select("t", "c", F.expr("z div 2").alias("unit")).distinct(), ["t", "c"]).where("unit = z div 2").select("ord", "t", "c", "unit")
ORACLES["jn1_request_units"] = f"WITH r AS ({_REQ}) SELECT ord, t, c, z // 2 AS unit FROM r"
_UNITS_SQL = "u AS (SELECT t, c, z // 2 * 2 AS z0, count(DISTINCT z) AS depth FROM px GROUP BY t, c, z // 2 * 2)"
register("jn2_chunk_of_plane", f", {_UNITS_SQL} SELECT DISTINCT px.t, px.c, px.z, u.z0, u.depth FROM px JOIN u ON px.t = u.t AND px.c = u.c AND u.z0 <= px.z AND px.z < u.z0 + u.depth")(
    lambda v: v.select("t", "c", "z").distinct().withColumn("unit", F.expr("z div 2")).join(v.groupBy("t", "c", F.expr("z div 2").alias("unit")).agg(F.countDistinct("z").alias("depth")), ["t", "c", "unit"]).select("t", "c", "z", (c("unit") * 2).alias("z0"), "depth")
)
register("jn3_unit_dispatch", "SELECT DISTINCT t, c, z, 0 AS single, t * 2 + c AS volume, (t * 2 + c) * 3 + z // 2 AS chunk FROM px")(
    lambda v: v.select("t", "c", "z", lit(0).alias("single"), (c("t") * 2 + c("c")).alias("volume"), ((c("t") * 2 + c("c")) * 3 + L.unit_of("stream", c("z"), 2)).alias("chunk")).distinct()
)
register("jn4_symbol_lookup", "SELECT v, count(*) AS n, CAST(floor(sqrt(v)) AS BIGINT) AS q FROM px GROUP BY v", "orders")(lambda v: v.groupBy("v").agg(F.count(lit(1)).alias("n")).withColumn("q", X.q_symbol(c("v"))))
register("jn6_neighbours", "SELECT a.i, l.v AS left_v, u.v AS up_v, p.v AS back_v FROM px a LEFT JOIN px l ON l.i = a.i - 1 AND a.x > 0 LEFT JOIN px u ON u.i = a.i - 25 AND a.y > 0 LEFT JOIN px p ON p.i = a.i - 100 AND a.z > 0")(
    # within a plane for two of them, along z for the third: no window holds more than a plane
    lambda v: v.select("*", *[F.when(c(a) > 0, F.lag("v", k).over(Window.partitionBy("t", "c", "z").orderBy("i"))).alias(n) for n, a, k in (("left_v", "x", 1), ("up_v", "y", 25))]).select(
        "i", "left_v", "up_v", F.lag("v").over(Window.partitionBy("t", "c", "y", "x").orderBy("z")).alias("back_v")
    )
)
register("jn7_missing_planes", "SELECT g.range AS page FROM range((SELECT max(i) // 100 + 3 FROM px)) g WHERE g.range NOT IN (SELECT i // 100 FROM px WHERE v % 97 > 0 GROUP BY 1 HAVING count(*) > 97)")(
    lambda v: v.sparkSession.range(v.agg(F.max(F.expr("i div 100 + 3"))).first()[0]).select(c("id").alias("page")).join(v.where("v % 97 > 0").groupBy(F.expr("i div 100").alias("page")).count().where("count > 97"), "page", "left_anti")
)
register("jn8_declared", "SELECT i, v FROM px WHERE z IN (SELECT z FROM px WHERE v > 50000 OR z = 2)")(lambda v: v.join(v.where("v > 50000 or z = 2").select("z").distinct(), "z", "left_semi").select("i", "v"))
register("jn9_levels", f"SELECT 0 AS level, t, c, z, y, x, v FROM px UNION ALL SELECT 1, t, c, z, y // 2, x // 2, CAST((sum(v * {_W.format(ny=4, wy=1, nx=25, wx=2)}) + 2) // 4 AS BIGINT) FROM px GROUP BY t, c, z, y // 2, x // 2")(
    lambda v: v.select(lit(0).alias("level"), "t", "c", "z", "y", "x", "v").unionByName(S.mean_level(v, {"y": 4, "x": 25}, {"y": 2, "x": 2}).withColumn("level", lit(1)))
)
register("jn10_duplicates", "SELECT v, count(*) AS n FROM px GROUP BY v HAVING count(*) > 1")(lambda v: v.groupBy("v").agg(F.count(lit(1)).alias("n")).where("n > 1"))
register("sc10_hyperslab", "SELECT c, (4 - z) // 2 AS z, y - 1 AS y, (x - 3) // 4 AS x, v FROM px WHERE t = 0 AND z IN (4, 2, 0) AND y IN (1, 2) AND x >= 3 AND x < 23 AND (x - 3) % 4 = 0")(
    lambda v: P.hyperslab(v, t=0, z=slice(None, None, -2), y=slice(1, 3), x=slice(3, 23, 4)).select("c", "z", "y", "x", "v")
)
register("sc11_crop", "SELECT y - 1 AS y, x - 5 AS x, v FROM px WHERE t = 0 AND c = 1 AND z = 2 AND y >= 1 AND x BETWEEN 5 AND 19")(lambda v: P.hyperslab(v, t=0, c=1, z=2, y=slice(1, None), x=slice(5, 20)).select("y", "x", "v"))
register("sc19_contiguous_offsets", "SELECT DISTINCT i // 100 AS page, 8 + i // 100 * 200 AS off FROM px")(lambda v: v.select(F.expr("i div 100").alias("page")).distinct().withColumn("off", 8 + c("page") * 200))
register("sc20_samples", "SELECT DISTINCT i // 100 AS logical, i // 100 // 2 AS ifd, i // 100 % 2 AS sample FROM px")(lambda v: v.select(F.expr("i div 100").alias("logical")).distinct().select("logical", F.expr("logical div 2").alias("ifd"), (c("logical") % 2).alias("sample")))
register("sc21_raw_runs", ", s AS (SELECT t, i % 1000 // 25 AS strip, CAST(sum(CASE WHEN v % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) % 4 AS hole FROM px GROUP BY t, i % 1000 // 25), o AS (SELECT t, strip, CAST(strip * 50 + sum(CASE WHEN hole = 0 THEN 16 ELSE 0 END) OVER (PARTITION BY t ORDER BY strip) AS BIGINT) AS off, 50 AS len FROM s), j AS (SELECT *, CASE WHEN lag(off + len) OVER (PARTITION BY t ORDER BY strip) = off THEN 0 ELSE 1 END AS jump FROM o), r AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY t ORDER BY strip) AS BIGINT) AS run FROM j) SELECT t, run, min(off) AS off, CAST(sum(len) AS BIGINT) AS len, count(*) AS strips FROM r GROUP BY t, run")(
    lambda v: S.coalesced_runs(
        v.groupBy("t", F.expr("i % 1000 div 25").alias("strip")).agg((F.sum(F.when(c("v") % 5 == 0, 1).otherwise(0)) % 4).alias("hole")).withColumn("off", c("strip") * 50 + F.sum(F.when(c("hole") == 0, 16).otherwise(0)).over(Window.partitionBy("t").orderBy("strip"))).withColumn("len", lit(50)), ["t"]
    )
)
register("sc22_tiles", "SELECT t, c, z, y // 3 AS ty, x // 8 AS tx, count(*) AS inside, 24 - count(*) AS padding FROM px GROUP BY ALL")(lambda v: v.groupBy("t", "c", "z", F.expr("y div 3").alias("ty"), F.expr("x div 8").alias("tx")).agg(F.count(lit(1)).alias("inside"), (24 - F.count(lit(1))).alias("padding")))
register_table("sc30_discovery", "WITH RECURSIVE r AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION SELECT n.n_nationkey, r.depth + 1 FROM r JOIN nation n ON n.n_nationkey IN (2 * r.k + 1, 2 * r.k + 2) WHERE r.depth < 5) SELECT DISTINCT k, depth FROM r")(
    lambda spark, d: _tree(spark, d)
)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    _read(spark, d, "nation").createOrReplaceTempView("_links")
    return spark.sql("WITH RECURSIVE r AS (SELECT cast(n_nationkey AS bigint) AS k, 0 AS depth FROM _links WHERE n_nationkey = 0 UNION ALL SELECT cast(n.n_nationkey AS bigint), r.depth + 1 FROM r JOIN _links n ON n.n_nationkey = 2 * r.k + 1 OR n.n_nationkey = 2 * r.k + 2 WHERE r.depth < 5) SELECT DISTINCT k, depth FROM r")


# --- layout -----------------------------------------------------------------------------------------------------
_SZ = {"t": 1 << 20, "c": 2, "z": 5}
_PL = "SELECT DISTINCT t, c, z FROM px"
register("ly1_page_index", f"SELECT t, c, z, (t * 2 + c) * 5 + z AS tcz, (t * 5 + z) * 2 + c AS tzc, (z * 2 + c) * 1048576 + t AS zct FROM ({_PL})")(
    lambda v: v.select("t", "c", "z").distinct().select("t", "c", "z", *[L.page_index(o, _SZ, t=c("t"), c=c("c"), z=c("z")).alias(o.lower()) for o in ("TCZ", "TZC", "ZCT")])
)
register("ly2_page_coordinates", f"SELECT (t * 5 + z) * 2 + c AS page, t, c, z FROM ({_PL})")(lambda v: v.select(F.expr("i div 100").alias("page")).distinct().select("page", *[e.alias(a) for a, e in L.page_coordinates("page", "TZC", _SZ).items()]))
register("ly3_reorder", "SELECT ((t * 2 + c) * 5 + z) * 100 + y * 25 + x AS i, v FROM (SELECT v, x, y, i // 100 % 2 AS c, i // 200 % 5 AS z, t FROM px)")(
    lambda v: v.withColumn("page", F.expr("i div 100")).withColumns(L.page_coordinates("page", "TZC", _SZ)).select(P.linear_index(P.EVENTS, c("t"), c("c"), c("z"), c("y"), c("x")).alias("i"), "v")
)
register("ly5_resolve", f"SELECT t, count(*) AS pages, 2 AS c, count(*) // 2 AS z FROM ({_PL}) GROUP BY t")(lambda v: v.select("t", "c", "z").distinct().groupBy("t").agg(F.count(lit(1)).alias("pages")).select("t", "pages", F.coalesce(lit(None).cast("int"), lit(2)).alias("c"), F.expr("pages div 2").alias("z")))
register("ly6_samples_to_channels", f"SELECT ((t * 2 + c) * 5 + z) // 3 AS z_out, ((t * 2 + c) * 5 + z) % 3 AS c_out FROM ({_PL})")(lambda v: v.select(F.expr("i div 100").alias("p")).distinct().select(F.expr("p div 3").alias("z_out"), (c("p") % 3).alias("c_out")))
register("ly7_layout_choice", f"SELECT t, c, z, coalesce(CASE WHEN z = 0 THEN 'ome' END, CASE WHEN c = 0 THEN 'imagej' END, 'plain') AS layout FROM ({_PL})")(lambda v: v.select("t", "c", "z").distinct().withColumn("layout", F.coalesce(F.when(c("z") == 0, "ome"), F.when(c("c") == 0, "imagej"), lit("plain"))))
register("ly8_fastest_first", f"SELECT t, c, z, z + 5 * (c + 2 * t) AS zct, c + 2 * (z + 5 * t) AS czt FROM ({_PL})")(lambda v: v.select("t", "c", "z").distinct().select("t", "c", "z", *[L.page_index(o[::-1], _SZ, t=c("t"), c=c("c"), z=c("z")).alias(o.lower()) for o in ("ZCT", "CZT")]))
_TD = "SELECT CAST(n_nationkey * 4 AS BIGINT) AS ifd, CAST(n_nationkey * 4 // 10 AS BIGINT) AS ft, CAST(n_nationkey * 4 // 5 % 2 AS BIGINT) AS fc, CAST(n_nationkey * 4 % 5 AS BIGINT) AS fz FROM nation"


def _tiff_data(spark: SparkSession, d: str) -> DataFrame:
    n = c("n_nationkey").cast("long") * 4
    rows = _read(spark, d, "nation").select(n.alias("ifd"), n.alias("n"))
    rows = rows.select("ifd", F.expr("n div 10").alias("first_t"), F.expr("n div 5 % 2").alias("first_c"), F.expr("n % 5").alias("first_z"), lit(4).alias("plane_count"))
    return L.expand_tiff_data(rows, "ZCT", {"z": 5, "c": 2, "t": 10})


register_table("ly9_tiff_data", f"SELECT ifd + k AS ifd, (lin // 10) % 10 AS t, (lin // 5) % 2 AS c, lin % 5 AS z FROM (SELECT ifd, CAST(k AS BIGINT) AS k, fz + 5 * (fc + 2 * ft) + CAST(k AS BIGINT) AS lin FROM ({_TD}), range(4) g(k))")(_tiff_data)
QUERIES["ly9_coverage_problems"] = lambda spark, d: L.check_coverage(_tiff_data(spark, d), 104)
ORACLES["ly9_coverage_problems"] = "SELECT 'missing ifd' AS problem, CAST(100 + range AS BIGINT) AS n FROM range(4)"
QUERIES["ly9_rebase"] = lambda spark, d: L.rebase(_tiff_data(spark, d).where("ifd >= 30"))
ORACLES["ly9_rebase"] = f"WITH p AS (SELECT ifd + k AS ifd, (lin // 10) % 10 AS t, (lin // 5) % 2 AS c, lin % 5 AS z FROM (SELECT ifd, CAST(k AS BIGINT) AS k, fz + 5 * (fc + 2 * ft) + CAST(k AS BIGINT) AS lin FROM ({_TD}), range(4) g(k)) WHERE ifd + k >= 30) SELECT ifd, t - (SELECT min(t) FROM p) AS t, c - (SELECT min(c) FROM p) AS c, z - (SELECT min(z) FROM p) AS z FROM p"
register_table("ly10_local_file", "SELECT n_nationkey AS k, CASE WHEN n_regionkey > 0 THEN lower(trim(n_name)) = lower('china') ELSE coalesce(n_name = 'ALGERIA', TRUE) END AS local FROM nation")(
    lambda spark, d: _read(spark, d, "nation").select(c("n_nationkey").alias("k"), L.is_local(F.when(c("n_regionkey") > 0, F.concat(lit(" "), c("n_name"))), lit("China "), c("n_name"), "ALGERIA").alias("local"))
)
register("ly11_transpose", "SELECT (((x * 5 + z) * (SELECT max(t) + 1 FROM px) + t) * 2 + c) * 4 + y AS j, v FROM px")(
    lambda v: v.join(F.broadcast(v.agg((F.max("t") + 1).alias("nt")))).select(((((c("x") * 5 + c("z")) * c("nt") + c("t")) * 2 + c("c")) * 4 + c("y")).alias("j"), "v")
)
register_table("ly13_axes", "SELECT n_nationkey AS k, CASE WHEN regexp_matches(upper(a), '^[QI]YX$') THEN 'ZYX' ELSE upper(a) END AS axes FROM (SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'qyx' WHEN 1 THEN 'tczyx' WHEN 2 THEN 'IYX' WHEN 3 THEN 'yx' ELSE 'zyx' END AS a FROM nation)")(
    lambda spark, d: _read(spark, d, "nation").select(c("n_nationkey").alias("k"), T.canonical_axes(F.element_at(F.array(*map(lit, ("qyx", "tczyx", "IYX", "yx", "zyx"))), (c("n_regionkey") + 1).cast("int"))).alias("axes"))
)
register("ly14_full_axes", "SELECT max(z) + 1 AS z, 1 AS t, max(y) + 1 AS y, 1 AS c, max(x) + 1 AS x FROM px WHERE t = 0 AND c = 0")(lambda v: P.hyperslab(v, t=0, c=0).agg(*[(F.max(a) + 1).alias(a) for a in "zyx"]).select("*", lit(1).alias("t"), lit(1).alias("c")))
register("ly15_slices", f"SELECT (t * 5 + z) * 2 + c AS slice, c, z, t FROM ({_PL})")(lambda v: v.select(F.expr("i div 100").alias("slice")).distinct().select("slice", *[e.alias(a) for a, e in L.page_coordinates("slice", "TZC", _SZ).items()]))
register("ly16_first_axis", "SELECT CASE WHEN max(t) > 0 THEN 'tczyx' WHEN max(c) > 0 THEN 'czyx' WHEN max(z) > 0 THEN 'zyx' ELSE 'yx' END AS axes FROM px")(lambda v: v.agg(F.when(F.max("t") > 0, "tczyx").when(F.max("c") > 0, "czyx").when(F.max("z") > 0, "zyx").otherwise("yx").alias("axes")))
register_table("ly17_valid_layout", "SELECT n_nationkey AS k, CASE n_regionkey WHEN 0 THEN 'tczyx' WHEN 2 THEN 'yx' END AS layout FROM nation")(
    lambda spark, d: _read(spark, d, "nation").select(c("n_nationkey").alias("k"), T.valid_layout(F.element_at(F.array(*map(lit, (" TCZYX", "tzx", "yx", "yyx", "zyxq"))), (c("n_regionkey") + 1).cast("int")), F.element_at(F.array(*map(lit, (5, 3, 2, 3, 4))), (c("n_regionkey") + 1).cast("int"))).alias("layout"))
)
register("ly18_export_order", f"SELECT (t * 2 + c) * 5 + z AS tcz, (t * 5 + z) * 2 + c AS page FROM ({_PL})")(lambda v: v.select("t", "c", "z").distinct().select(L.page_index("TCZ", _SZ, t=c("t"), c=c("c"), z=c("z")).alias("tcz"), L.page_index("TZC", _SZ, t=c("t"), c=c("c"), z=c("z")).alias("page")))
register("ly19_chunk_grid", "SELECT t, c, z // 2 AS chunk_z, y // 3 AS chunk_y, x // 8 AS chunk_x, count(*) AS n FROM px GROUP BY ALL")(lambda v: L.chunk_grid(v, {}, {"z": 2, "y": 3, "x": 8}).groupBy("t", "c", "chunk_z", "chunk_y", "chunk_x").agg(F.count(lit(1)).alias("n")))
register("ly20_block_specs", ", n AS (SELECT t, c, max(z) + 1 AS nz FROM px GROUP BY t, c) SELECT t, c, nz, b * 4 AS z0, least(4, nz - b * 4) AS depth FROM n, LATERAL (SELECT unnest(generate_series(0, (nz - 1) // 4)) AS b)")(lambda v: L.block_specs(v.groupBy("t", "c").agg((F.max("z") + 1).alias("nz")), 4))
register("ly23_stream_depth", "SELECT t, CASE WHEN d > 4 THEN d // 4 * 4 ELSE d END AS depth FROM (SELECT t, greatest(1, least(max(z) + 1, (3000 + 400 * t) // 4 // 200)) AS d FROM px GROUP BY t)")(
    lambda v: v.groupBy("t").agg(F.greatest(lit(1), F.least(F.max("z") + 1, F.expr("(3000 + 400 * t) div 4 div 200"))).alias("d")).select("t", F.expr("case when d > 4 then d div 4 * 4 else d end").alias("depth"))
)
# --- order, offsets, completeness -------------------------------------------------------------------------------
# the place of each voxel in T, C, Z, Y, X order: those of earlier volumes, then its place within its own
register("so1_canonical_order", "SELECT i, t, c, z, y, x, v, row_number() OVER (ORDER BY t, c, z, y, x) - 1 AS at FROM px")(
    lambda v: v.withColumn("own", F.row_number().over(Window.partitionBy("t", "c", "z").orderBy("y", "x")) - 1).join(
        v.groupBy("t", "c", "z").agg(F.count(lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("t", "c", "z").rowsBetween(Window.unboundedPreceding, -1)), lit(0))), ["t", "c", "z"]
    ).select("i", "t", "c", "z", "y", "x", "v", (c("before") + c("own")).alias("at"))
)
register("so5_output_guard", "SELECT t, count(*) * 2 AS bytes, count(*) * 2 <= 1 << 30 AS allowed FROM px GROUP BY t")(lambda v: v.groupBy("t").agg((F.count(lit(1)) * 2).alias("bytes")).withColumn("allowed", c("bytes") <= 1 << 30))
register("so6_first_match", "SELECT min(i) AS i FROM px WHERE v > 1000")(lambda v: v.where("v > 1000").orderBy("i").limit(1).select("i"))
register("wn5_record_offsets", ", r AS (SELECT t, (c * 5 + z) AS seq, CAST(sum(v % 7) AS BIGINT) AS len FROM px GROUP BY t, c, z) SELECT t, seq, len, CAST(40 + coalesce(sum(len + 24) OVER (PARTITION BY t ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 24 AS BIGINT) AS off FROM r")(
    lambda v: L.record_offsets(v.groupBy("t", (c("c") * 5 + c("z")).alias("seq")).agg(F.sum(c("v") % 7).alias("len")), ["t"], 40, 24).select("t", "seq", "len", "off")
)
ORACLES["wn6_resident_plan"], QUERIES["wn6_resident_plan"] = ORACLES["ag12_resident_peak"], QUERIES["ag12_resident_peak"]
register("wn8_order_check", f"SELECT t, c, z, (t * 5 + z) * 2 + c AS seq, (t * 2 + c) * 5 + z AS expected FROM ({_PL}) WHERE (t * 5 + z) * 2 + c <> (t * 2 + c) * 5 + z")(
    lambda v: L.check_canonical(v.select("t", "c", "z").distinct().withColumn("seq", F.expr("(t * 5 + z) * 2 + c")), {"c": 2, "z": 5})
)
register("sx6_completeness", "SELECT count(DISTINCT (t * 2 + c) * 5 + z) AS planes, (max(t) + 1) * 10 AS declared, count(DISTINCT (t * 2 + c) * 5 + z) = (max(t) + 1) * 10 AS complete FROM px")(
    lambda v: v.agg(F.countDistinct(F.expr("(t * 2 + c) * 5 + z")).alias("planes"), ((F.max("t") + 1) * 10).alias("declared")).withColumn("complete", c("planes") == c("declared"))
)
# --- pyramids and chunks ----------------------------------------------------------------------------------------
_L1 = "l1 AS (SELECT t, c, z, y // 2 AS y, x // 2 AS x, CAST((sum(v * (CASE WHEN x = 24 THEN 2 ELSE 1 END)) + 2) // 4 AS BIGINT) AS v FROM px GROUP BY t, c, z, y // 2, x // 2)"
register("rs1_two_levels", f", {_L1} SELECT t, c, z, y // 2 AS y, x // 2 AS x, CAST((sum(v * (CASE WHEN x = 12 THEN 2 ELSE 1 END)) + 2) // 4 AS BIGINT) AS v FROM l1 GROUP BY t, c, z, y // 2, x // 2")(lambda v: S.mean_level(S.mean_level(v, {"y": 4, "x": 25}, {"y": 2, "x": 2}), {"y": 2, "x": 13}, {"y": 2, "x": 2}))
register("rs5_lossy_pyramid", f"SELECT t, c, z, y // 2 AS y, x // 2 AS x, CAST((sum({_REC} * {_W.format(ny=4, wy=1, nx=25, wx=2)}) + 2) // 4 AS BIGINT) AS v FROM px GROUP BY t, c, z, y // 2, x // 2")(
    lambda v: S.mean_level(v.withColumn("v", X.reconstruct(X.quantize(c("v"), _CALS["a"]), _CALS["a"])), {"y": 4, "x": 25}, {"y": 2, "x": 2})
)
def _regridded(df: DataFrame, chunks: dict[str, int], *keep: str) -> DataFrame:
    return M.rechunk(df, chunks, keep).withColumn("values", F.array_join(c("values").cast("array<string>"), ","))


register("rs6_rechunk", "SELECT t, c, z // 3 AS chunk_z, y // 3 AS chunk_y, x // 10 AS chunk_x, string_agg(CAST(v AS VARCHAR), ',' ORDER BY z, y, x) AS \"values\" FROM px GROUP BY ALL")(lambda v: _regridded(v, {"z": 3, "y": 3, "x": 10}, "t", "c"))
# labels stay as they are, images are quantised, and all move to another grid
_LABEL = "CASE WHEN c = 1 THEN v ELSE CAST(least(greatest(round(0::DOUBLE + 0.25::DOUBLE * (round(2 * sqrt(v::DOUBLE) / 4::DOUBLE) * 4::DOUBLE) * (round(2 * sqrt(v::DOUBLE) / 4::DOUBLE) * 4::DOUBLE)), 0), 65535) AS BIGINT) END"
register("sk17_repack", f"SELECT t, c, y // 2 AS chunk_y, x // 4 AS chunk_x, string_agg(CAST({_LABEL} AS VARCHAR), ',' ORDER BY y, x, z) AS \"values\" FROM px GROUP BY ALL", "orders")(
    lambda v: _regridded(M.repack(v.withColumn("is_label", c("c") == 1), _CALS["b"]), {"y": 2, "x": 4, "z": 5}, "t", "c").drop("chunk_z")
)
register("rs7_region_update", "SELECT i, CASE WHEN y BETWEEN 1 AND 2 AND x < 10 AND z = 1 THEN 65535 ELSE v END AS v FROM px")(
    lambda v: (lambda patch: v.join(patch, "i", "left_anti").select("i", "v").unionByName(patch.withColumn("v", lit(65535).cast("long"))))(v.where("y between 1 and 2 and x < 10 and z = 1").select("i"))
)
register("rs8_append", ", n AS (SELECT max(t) + 1 AS nt FROM px) SELECT CAST(range AS BIGINT) AS i, coalesce(v, 0) AS v FROM range((SELECT (nt + 1) * 1000 FROM n)) LEFT JOIN px ON px.i = range")(
    lambda v: v.sparkSession.range((v.agg(F.max("t")).first()[0] + 2) * 1000).select(c("id").alias("i")).join(v.select("i", "v"), "i", "left").select("i", F.coalesce("v", lit(0)).alias("v"))
)
register("rs10_select_level", f", {_L1} SELECT y, x, v FROM l1 WHERE t = 0 AND c = 0 AND z = 0")(lambda v: S.mean_level(v, {"y": 4, "x": 25}, {"y": 2, "x": 2}).where("t = 0 and c = 0 and z = 0").select("y", "x", "v"))
# the whole level, all planes of all frames
register("rs10_whole_level", f", {_L1} SELECT t, c, z, y, x, v FROM l1")(lambda v: S.mean_level(v, {"y": 4, "x": 25}, {"y": 2, "x": 2}).select("t", "c", "z", "y", "x", "v"))
# --- text -------------------------------------------------------------------------------------------------------
def _desc() -> Column:
    return F.concat(lit("ImageJ=1.5\nIMAGES = "), c("n").cast("string"), lit("\nchannels=2\nframes=x\nFrames=1\nloop=false"))
QUERIES["st1_imagej_value"] = lambda spark, d: spark.range(50).select(c("id").alias("n")).select("n", *[T.imagej_value(_desc(), k).alias(k) for k in ("images", "channels", "frames", "slices")])
ORACLES["st1_imagej_value"] = "SELECT CAST(range AS BIGINT) AS n, CAST(range AS BIGINT) AS images, CAST(2 AS BIGINT) AS channels, CAST(1 AS BIGINT) AS frames, CAST(NULL AS BIGINT) AS slices FROM range(50)"
QUERIES["st2_imagej_layout"] = lambda spark, d: spark.range(50).select(c("id").alias("n")).select("n", *[e.alias(a) for a, e in T.imagej_layout(_desc(), c("n")).items()])
ORACLES["st2_imagej_layout"] = "SELECT n, CASE WHEN n % 2 = 0 THEN 1 END AS t, CASE WHEN n % 2 = 0 THEN 2 END AS c, CASE WHEN n % 2 = 0 THEN n // 2 END AS z FROM (SELECT CAST(range AS BIGINT) AS n FROM range(50))"
QUERIES["st3_ome_order"] = lambda spark, d: spark.createDataFrame([(o, L.ome_order(o)) for o in ("TCZ", "TZC", "CTZ", "CZT", "ZTC", "ZCT")], "page_order string, ome string")
ORACLES["st3_ome_order"] = "SELECT o AS page_order, 'XY' || reverse(o) AS ome FROM (VALUES ('TCZ'), ('TZC'), ('CTZ'), ('CZT'), ('ZTC'), ('ZCT')) v(o)"
register("st4_descriptions", "SELECT t, 'ImageJ=' || chr(10) || 'images=10' || chr(10) || 'channels=2' || chr(10) || 'slices=5' || chr(10) || 'frames=1' || chr(10) || 'hyperstack=true' || chr(10) AS imagej, '<Pixels DimensionOrder=\"XYZCT\" Type=\"uint16\" SizeX=\"25\" SizeY=\"4\" SizeZ=\"5\" SizeC=\"2\" SizeT=\"1\"/>' AS ome FROM px GROUP BY t")(
    lambda v: v.groupBy("t").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "xyzc"]).select("t", T.imagej_description(lit(1), c("nc"), c("nz")).alias("imagej"), T.ome_pixels("XYZCT", c("nx"), c("ny"), c("nz"), c("nc"), lit(1)).alias("ome"))
)
register("st7_layout_json", "SELECT t, '{\"shape\":[2,5,4,25],\"axes\":\"czyx\",\"dtype\":\"<u2\"}' AS layout FROM px GROUP BY t")(
    lambda v: v.groupBy("t").agg(*[(F.max(a) + 1).alias(a) for a in "czyx"]).select("t", T.layout_json([c(a) for a in "czyx"], "czyx", "<u2").alias("layout"))
)
def _multiscales(v: DataFrame) -> str:
    """The description of a pyramid of the pixels."""
    _, told = M.level_table(v.select("t", "c", "z", "y", "x", "v"), {"z": 5, "y": 4, "x": 25}, 4, {"z": 2, "y": 0.25, "x": 0.5}, {"y": 3})
    return M.describe(told, "zyx", "pixels", {"x": "micrometer"})


_ENTRY = "STRUCT<datasets: ARRAY<STRUCT<path: STRING, coordinateTransformations: ARRAY<STRUCT<type: STRING, scale: ARRAY<DOUBLE>, translation: ARRAY<DOUBLE>>>>>>"
_HALF = "least(level, 2)"  # four rows are halved twice, twenty-five columns thrice


@register("st8_multiscales", f"SELECT CAST(level AS VARCHAR) AS path, 2.0::DOUBLE AS scale_z, 0.25::DOUBLE * (1 << {_HALF}) AS scale_y, 0.5::DOUBLE * (1 << level) AS scale_x, 3 + 0.125::DOUBLE * ((1 << {_HALF}) - 1) AS translation_y, 0.25::DOUBLE * ((1 << level) - 1) AS translation_x FROM (SELECT CAST(range AS INTEGER) AS level FROM range(4))")
def _st8(v: DataFrame) -> DataFrame:
    rows = v.sparkSession.createDataFrame([(_multiscales(v),)], "text string").select(F.explode(F.from_json("text", _ENTRY)["datasets"]).alias("e"))
    steps = c("e")["coordinateTransformations"]
    return rows.select(c("e")["path"].alias("path"), *[steps[0]["scale"][i].alias(f"scale_{a}") for i, a in enumerate("zyx")], *[steps[1]["translation"][i].alias(f"translation_{a}") for i, a in ((1, "y"), (2, "x"))])


register("st9_declared_paths", "SELECT CAST(range AS VARCHAR) AS path FROM range(4)")(lambda v: v.sparkSession.createDataFrame([(p,) for p in M.declared_paths(_multiscales(v))], "path string"))
register_table("st10_output_names", "SELECT n_nationkey AS k, n_name || '.out' AS enc, n_name || CASE WHEN n_regionkey = 0 THEN '.tif' ELSE '.x.tif' END AS dec FROM nation")(
    lambda spark, d: _read(spark, d, "nation").select(c("n_nationkey").alias("k"), T.output_name(F.concat("n_name", lit(".tif")), "out").alias("enc"), T.output_name(F.concat("n_name", F.when(c("n_regionkey") == 0, ".tif.out").otherwise(".x.out")), "tif").alias("dec"))
)
register_table("st11_dataset_names", "SELECT n_nationkey AS k, CASE n_regionkey WHEN 0 THEN '/data' WHEN 1 THEN '/a/b' WHEN 2 THEN '/x' END AS name FROM nation")(
    lambda spark, d: _read(spark, d, "nation").select(c("n_nationkey").alias("k"), T.dataset_name(F.element_at(F.array(*map(lit, ("  ", "a/b ", "/x", "a//b", "/a/../b"))), (c("n_regionkey") + 1).cast("int"))).alias("name"))
)
register_table("st12_properties", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN CAST(n_nationkey AS BIGINT) END AS as_long, CASE WHEN n_regionkey = 1 THEN n_nationkey + 0.5::DOUBLE END AS as_double, CASE WHEN n_regionkey > 1 THEN n_name END AS as_text FROM nation")(
    lambda spark, d: _read(spark, d, "nation").withColumn("p", F.when(c("n_regionkey") == 0, F.concat(lit("I"), c("n_nationkey").cast("string"))).when(c("n_regionkey") == 1, F.concat(lit("D"), c("n_nationkey").cast("string"), lit(".5"))).otherwise(F.concat(lit("T"), "n_name"))).select(c("n_nationkey").alias("k"), *[e.alias(n) for n, e in T.property_value(c("p")).items() if n != "kind"])
)
register("px_embed_u8", "SELECT i, y, x, v, least(v, 255) AS v8 FROM px", "embed")(lambda v: v.select("i", "y", "x", "v", X.saturate8(c("v")).alias("v8")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_context_histogram_mean"](spark, sf_dir)


# --- the codec as jobs: what comes back must be what went in ----------------------------------------------------
def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    import re
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/stack-{uuid.uuid4().hex}"


def _chunks(v: DataFrame, g: P.Geometry, depth: int, cal: Calibration | None = None) -> DataFrame:
    from .plans import jobs

    return jobs.encode_chunks(P.planes(v), g.x, g.y, depth, Options(block_depth=2), cal)


def _decoded(chunks: DataFrame, g: P.Geometry) -> DataFrame:
    from .plans import jobs

    return jobs.voxels_of(jobs.decode_chunks(chunks), g.x)


_ALL = "SELECT t, c, z, y, x, v FROM px"
register("ec1_ec4_roundtrip", _ALL)(lambda v: _decoded(_chunks(v, P.EVENTS, 5), P.EVENTS))
register("ec8_chunked_roundtrip", _ALL, "orders")(lambda v: _decoded(_chunks(v, P.ORDERS, 2), P.ORDERS))
register("ec2_lossy_roundtrip", f"SELECT t, c, z, y, x, {_REC} AS v FROM px")(lambda v: _decoded(_chunks(v, P.EVENTS, 5, _CALS["a"]), P.EVENTS))
# what the statistics must satisfy: the parts fill the stream but for framing, and raw blocks are the incompressible ones
_QA = "round(2 * sqrt(greatest((v - 100::DOUBLE) * 0.46::DOUBLE, 0)) / 2::DOUBLE)"
_STATS = "SELECT t, c, 0 AS z0, 5 AS depth, 1000 AS raw_bytes, 3 AS blocks, {q} AS q_max, TRUE AS adds_up FROM px GROUP BY t, c"


def _stats(v: DataFrame, cal: Calibration | None) -> DataFrame:
    rows = _chunks(v, P.EVENTS, 5, cal)
    parts = c("q_bytes") + c("r_bytes") + c("model_bytes")
    return rows.select(*[c(n).cast("long").alias(n) for n in ("t", "c", "z0", "depth", "raw_bytes", "blocks", "q_max")], ((c("total_bytes") == F.octet_length("payload")) & (parts < c("total_bytes")) & (c("raw_blocks") <= c("blocks"))).alias("adds_up"))


register("sk1_encode_stats", _STATS.format(q="CAST(max(floor(sqrt(v))) AS BIGINT)"))(lambda v: _stats(v, None))
register("sk2_lossy_stats", _STATS.format(q=f"CAST(max({_QA}) AS BIGINT)"))(lambda v: _stats(v, _CALS["a"]))


@register("sc28_headers", "SELECT t, c, 'RDL1' AS magic, CAST(25 AS BIGINT) AS nx, CAST(4 AS BIGINT) AS ny, CAST(count(DISTINCT z) AS BIGINT) AS nz, CAST(2 AS BIGINT) AS block_depth FROM px GROUP BY t, c, z // 3")
def _sc28(v: DataFrame) -> DataFrame:
    from .plans import jobs

    return _chunks(v, P.EVENTS, 3).select("t", "c", *[e.alias(n) for n, e in jobs.header_fields().items()])


def _written(spark: SparkSession, v: DataFrame, path: str) -> None:
    from .sources import stack

    stack.register(spark)
    t = v.agg(F.max("t")).first()[0] + 1
    _chunks(v, P.EVENTS, 2).write.format("voxelstack").mode("append").options(x=25, y=4, z=5, c=2, t=t, chunkDepth=2).save(path)


@register("sc12_write_and_read", "SELECT t, c, z, y, x, v FROM px WHERE c = 1 AND z >= 3")
def _sc12(v: DataFrame) -> DataFrame:
    from .plans import jobs

    if v.isEmpty():  # a stack has one frame at least
        return v.select(*[c(n).cast("long").alias(n) for n in ("t", "c", "z", "y", "x", "v")])
    spark, path = v.sparkSession, _folder(v.sparkSession)
    _written(spark, v, path)
    return jobs.voxels_of(spark.read.format("voxelstack").load(path).where("c = 1 and z >= 3"), 25)


@register("sc1_unit_index", "SELECT 'stream' AS kind, t, c, z // 2 * 2 AS z0, count(DISTINCT z) AS depth FROM px GROUP BY t, c, z // 2 * 2")
def _sc1(v: DataFrame) -> DataFrame:
    from .sources import stack

    path = _folder(v.sparkSession)
    _written(v.sparkSession, v, path)
    return stack.unit_index(v.sparkSession, path).select("kind", *[c(n).cast("long").alias(n) for n in ("t", "c", "z0", "depth")])


def _frames(v: DataFrame) -> tuple[DataFrame, str]:
    """All frames as files, written and read by the executors: what was written, and where."""
    from .sources import tiff

    path = _folder(v.sparkSession)
    return tiff.write_frames(P.planes(v), path, 25, 4, 10), path


@register("sc17_tiff_planes", "SELECT t, (c * 5 + z) AS page, y, x, v FROM px")
def _sc17(v: DataFrame) -> DataFrame:
    from .plans import jobs
    from .sources import stack

    stack.register(v.sparkSession)
    written, path = _frames(v)
    written.collect()  # a name for each frame
    pages = v.sparkSession.read.format("tiffplanes").load(path).select(F.expr("cast(substring(file, 7, 8) as int)").alias("t"), lit(0).alias("c"), c("page").alias("z"), "pixels", "high")
    return jobs.voxels_of(pages, 25).select("t", c("z").alias("page"), "y", "x", "v")


@register("sk18_convert", "SELECT t, c, z, y, x, v FROM px")
def _sk18(v: DataFrame) -> DataFrame:
    """Files of pages become coded chunks of volumes."""
    from .plans import jobs
    from .sources import stack

    stack.register(v.sparkSession)
    written, path = _frames(v)
    written.collect()  # a name for each frame
    pages = v.sparkSession.read.format("tiffplanes").load(path).select(F.expr("cast(substring(file, 7, 8) as int)").alias("t"), F.expr("page div 5").alias("c"), F.expr("page % 5").alias("z"), "pixels", "high")
    return jobs.voxels_of(jobs.decode_chunks(jobs.encode_chunks(pages, 25, 4, 3)), 25)


# half of the rows are compared with a width that their payload does not have
@register("sc2_payload_check", "SELECT t, c, z // 2 * 2 AS z0, c = 0 AS fits FROM px GROUP BY t, c, z // 2")
def _sc2(v: DataFrame) -> DataFrame:
    from .plans import jobs

    rows = _chunks(v, P.EVENTS, 2).withColumn("w", lit(25) + c("c")).withColumn("h", lit(4))
    return jobs.check_payloads(rows, "w", "h", lossy=False).select(c("t").cast("long").alias("t"), c("c").cast("long").alias("c"), c("z0").cast("long").alias("z0"), "fits")


@register("sc5_file_info", "SELECT CAST(max(t) + 1 AS INTEGER) AS t, 2 AS c, 5 AS z, 4 AS y, 25 AS x, 'stream' AS kind, 6 AS flags FROM px")
def _sc5(v: DataFrame) -> DataFrame:
    from .sources import stack

    path = _folder(v.sparkSession)
    _written(v.sparkSession, v, path)
    return stack.file_info(v.sparkSession, path)


register("sk8_export", "SELECT 'frame-' || lpad(CAST(t AS VARCHAR), 8, '0') || '.tif' AS file, CAST(count(DISTINCT c * 5 + z) AS INTEGER) AS pages FROM px GROUP BY t")(lambda v: _frames(v)[0])


@register("mt3_metadata", "SELECT t, c, 'note ' || t AS note, CAST(5 AS BIGINT) AS z FROM px GROUP BY t, c")
def _mt3(v: DataFrame) -> DataFrame:
    from .functions import sql

    sql.register(v.sparkSession)
    rows = _chunks(v, P.EVENTS, 5).withColumn("noted", F.expr("set_metadata(payload, cast(concat('note ', t) as binary))"))
    return rows.select(c("t").cast("long").alias("t"), c("c").cast("long").alias("c"), F.expr("cast(get_metadata(noted) as string)").alias("note"), F.expr("container_shape(noted).z").alias("z"))
