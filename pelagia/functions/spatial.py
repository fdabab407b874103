"""PostGIS-named spatial functions.

Geometry columns are WKB (WKT strings work too), boxes are structs. Functions over JTS run in the JVM: their Java
source is generated from spatial_spec, compiled once a session inside the driver's JVM by Janino (the compiler that Spark
itself uses for generated code) against whatever JTS that JVM has loaded, and registered under their SQL names; no JDK is
needed, and the jar reaches the executors through ADD JAR. What needs no topology (points, boxes, planar and spherical distance) also
exists as Column expressions, which stay inside code generation and can prune Parquet row groups.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import zipfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.functions.spatial_spec import HELPERS, SPEC

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
_RESULTS = {
    "geom": T.BinaryType(), "binary": T.BinaryType(), "box": BOX, "geoms": T.ArrayType(T.BinaryType()), "bool": T.BooleanType(),
    "double": T.DoubleType(), "int": T.IntegerType(), "string": T.StringType(), "strings": T.ArrayType(T.StringType()),
}
_CLASS = "PelagiaSpatial"


def signatures() -> dict[str, tuple[str, str, str]]:
    """name -> (result, arguments, expression)."""
    out = {}
    for line in SPEC.strip().splitlines():
        name, result, args, expr = line.split(" | ", 3)
        out[name] = (result, args, expr)
    return out


def java_source() -> str:
    imports = (
        "org.locationtech.jts.geom.*", "org.locationtech.jts.geom.prep.*", "org.locationtech.jts.geom.util.*", "org.locationtech.jts.io.*",
        "org.locationtech.jts.algorithm.Orientation", "org.locationtech.jts.operation.overlayng.*", "org.locationtech.jts.operation.valid.*",
        "org.locationtech.jts.triangulate.*", "org.locationtech.jts.linearref.LengthIndexedLine", "org.apache.spark.sql.api.java.*",
        "org.apache.spark.sql.Row", "org.apache.spark.sql.RowFactory", "com.fasterxml.jackson.databind.*", "java.util.*",
    )
    out = [f"import {i};" for i in imports] + [f"public class {_CLASS} {{", HELPERS]
    for name, (result, args, expr) in signatures().items():
        n = len(args)
        params = ", ".join(f"Object a{i}" for i in range(n))
        seen = dict.fromkeys("GDIS", 0)
        body = []
        for i, a in enumerate(args):
            k = seen[a]
            seen[a] += 1
            if a == "G":
                body.append(f"Geometry g{k} = geom(a{i}); if (g{k} == null) return null;")
            elif a == "S":
                body.append(f"if (a{i} == null) return null; String s{k} = (String) a{i};")
            else:
                kind, var, get = ("double", "d", "doubleValue") if a == "D" else ("int", "i", "intValue")
                body.append(f"if (a{i} == null) return null; {kind} {var}{k} = ((Number) a{i}).{get}();")
        geom = f"as(g0, (Geometry) ({expr}))" if seen["G"] and name not in ("st_geomfromewkb", "st_setsrid") else f"(Geometry) ({expr})"
        value = {"geom": f"wkb({geom})", "box": f"box({expr})"}.get(result, f"v({expr})")
        caught = "".join(
            f" catch ({e} e) {{ return null; }}"
            for e in ("IllegalArgumentException", "TopologyException", *(["ParseException"] if seen["G"] else []), *(["com.fasterxml.jackson.core.JsonProcessingException"] if "Geojson" in expr else []))
        )
        out.append(f"  public static class {name} implements UDF{n} {{ public Object call({params}) {{ try {{ {' '.join(body)} return {value}; }}{caught} }} }}")
    return "\n".join([*out, "}"])


def build_jar(spark: SparkSession) -> str:
    """The compiled functions, in a fresh folder of this process; the driver serves it to the executors."""
    jvm = spark.sparkContext._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    for needed in ("org.locationtech.jts.geom.Geometry", "org.codehaus.janino.SimpleCompiler", "com.fasterxml.jackson.databind.ObjectMapper"):
        try:
            loader.loadClass(needed)
        except Py4JJavaError:
            raise RuntimeError(f"spatial functions need {needed} on the driver's class path") from None
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(loader)
    compiler.cook(java_source())
    path = os.path.join(tempfile.mkdtemp(prefix="pelagia-spatial-"), "spatial.jar")
    with zipfile.ZipFile(path, "w") as z:
        codes = compiler.getBytecodes()
        for name in sorted(codes.keySet()):
            z.writestr(f"{name}.class", bytes(codes[name]))
    return path


def register(spark: SparkSession) -> None:
    """Registers all functions in the session under their (case-insensitive) SQL names."""
    if getattr(spark, "_pelagia_spatial", False):
        return
    spark.sql(f"ADD JAR '{build_jar(spark)}'")
    loader = spark._jsparkSession.sharedState().jarClassLoader()
    kinds = {r: spark._jsparkSession.parseDataType(t.json()) for r, t in _RESULTS.items()}
    for name, (result, _, _) in signatures().items():
        udf = loader.loadClass(f"{_CLASS}${name}").getDeclaredConstructor(spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Class, 0)).newInstance(
            spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, 0)
        )
        spark._jsparkSession.udf().register(name, udf, kinds[result])
    spark._pelagia_spatial = True


# ------------------------------------------------------------------ expressions without topology
def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


#: Mean earth radius in metres.
RADIUS = 6371008.771415059


def distance_sphere(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    p, q = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((q - p) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(u * u + F.cos(p) * F.cos(q) * v * v)))


def extent(x: Column, y: Column) -> Column:
    """ST_Extent of points as an aggregate: four partial minima and maxima."""
    return F.struct(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def extent_of(df: DataFrame, geom: str, by: Sequence[str] = ()) -> DataFrame:
    """ST_Extent of geometries: boxes in the JVM, then plain minima and maxima."""
    register(df.sparkSession)
    b = df.withColumn("__b", F.call_function("st_envelope", F.col(geom)))
    box = F.struct(*[getattr(F, f)(f"__b.{n}").alias(n) for f, n in (("min", "xmin"), ("min", "ymin"), ("max", "xmax"), ("max", "ymax"))])
    return b.groupBy(*by).agg(box.alias("extent"))


def collect_of(df: DataFrame, geom: str, by: Sequence[str] = ()) -> DataFrame:
    """ST_Collect: one GEOMETRYCOLLECTION a group; a group is one value, so it must fit in memory."""
    register(df.sparkSession)
    text = F.concat(F.lit("GEOMETRYCOLLECTION ("), F.concat_ws(", ", F.sort_array(F.collect_list(F.call_function("st_astext", F.col(geom))))), F.lit(")"))
    return df.groupBy(*by).agg(F.call_function("st_geomfromtext", text).alias("geom"))


def union_of(df: DataFrame, geom: str, by: Sequence[str] = (), fan: int = 64) -> DataFrame:
    """ST_MemUnion: partial unions over `fan` salted parts first, then one over the parts."""
    register(df.sparkSession)
    union = lambda c: F.call_function("st_unionall", F.call_function("st_geomfromtext", F.concat(F.lit("GEOMETRYCOLLECTION ("), F.concat_ws(", ", F.collect_list(F.call_function("st_astext", c))), F.lit(")"))))
    part = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(geom)), F.lit(fan))).groupBy(*by, "__salt").agg(union(F.col(geom)).alias("geom"))
    return part.groupBy(*by).agg(union(F.col("geom")).alias("geom"))


def rings_of(shape: str) -> list[list[np.ndarray]]:
    """Polygons (shell and holes, arrays of points) of GeoJSON or WKT text."""
    if shape.lstrip().startswith("{"):
        g = json.loads(shape)
        while g.get("type") in ("Feature", "FeatureCollection"):
            g = g["geometry"] if g["type"] == "Feature" else {"type": "GeometryCollection", "geometries": [f["geometry"] for f in g["features"]]}
        if g["type"] == "GeometryCollection":
            return [p for x in g["geometries"] for p in rings_of(json.dumps(x))]
        c = {"Polygon": [g["coordinates"]], "MultiPolygon": g["coordinates"]}.get(g["type"], [])
        return [[np.array(r, float)[:, :2] for r in p] for p in c]
    head, _, body = shape.strip().partition("(")
    if head.strip().upper().split()[0] not in ("POLYGON", "MULTIPOLYGON"):
        return []
    text = ("[" + body[:-1] + "]").replace("(", "[").replace(")", "]")
    import re

    text = re.sub(r"([-+\d.eE]+(?:\s+[-+\d.eE]+)+)", lambda m: "[" + ",".join(m[1].split()) + "]", text)
    c = json.loads(text)
    return [[np.array(r, float)[:, :2] for r in p] for p in ([c] if head.strip().upper().startswith("POLYGON") else c)]


def _inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strictly inside, and on the boundary."""
    odd, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    a, b = ring, np.roll(ring, -1, axis=0)
    for (x1, y1), (x2, y2) in zip(a.tolist(), b.tolist()):
        if x1 == x2 and y1 == y2:
            continue
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        edge |= (cross == 0) & (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2))
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd & ~edge, edge


def within_polygon(shape: str, lon: Column, lat: Column) -> Column:
    """st_within_point of a constant shape: boundary excluded, null coordinates false.

    The bounding box comes first as a plain range test, which reaches the scan; an axis-parallel rectangle needs no
    more, any other polygon is tested in Arrow batches."""
    polygons = rings_of(shape)
    if not polygons:
        return F.lit(False)
    points = np.concatenate([p[0] for p in polygons])
    (x1, y1), (x2, y2) = points.min(0), points.max(0)
    lon, lat = lon.cast("double"), lat.cast("double")
    known = lon.isNotNull() & lat.isNotNull()
    box = (lon > F.lit(float(x1))) & (lon < F.lit(float(x2))) & (lat > F.lit(float(y1))) & (lat < F.lit(float(y2)))
    shell = polygons[0][0]
    corners = {(float(a), float(b)) for a, b in shell}
    if len(polygons) == 1 and len(polygons[0]) == 1 and corners == {(float(a), float(b)) for a in (x1, x2) for b in (y1, y2)} and len(shell) == 5:
        return F.coalesce(known & box, F.lit(False))

    @F.pandas_udf("boolean")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        xs, ys = x.to_numpy(float, na_value=math.nan), y.to_numpy(float, na_value=math.nan)
        out = np.zeros(len(xs), bool)
        for shell, *holes in polygons:
            got, _ = _inside(xs, ys, shell)
            for h in holes:
                got &= ~np.logical_or(*_inside(xs, ys, h))
            out |= got
        return pd.Series(out)

    return F.coalesce(known & box & exact(lon, lat), F.lit(False))


def box_filter(df: DataFrame, geom: str, bbox: str, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Rows whose geometry meets a box: the covering column's fields first (row groups are pruned), then the exact test."""
    register(df.sparkSession)
    near = (F.col(f"{bbox}.xmin") <= x2) & (F.col(f"{bbox}.xmax") >= x1) & (F.col(f"{bbox}.ymin") <= y2) & (F.col(f"{bbox}.ymax") >= y1)
    window = f"POLYGON (({x1} {y1}, {x2} {y1}, {x2} {y2}, {x1} {y2}, {x1} {y1}))"
    return df.filter(near).filter(F.call_function("st_intersects", F.col(geom), F.lit(window)))


# ------------------------------------------------------------------ clustering
def _distinct_points(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, x, y and the number n of rows at each distinct point."""
    pts = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pts.groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n"))


def _least_hash(seed: int) -> Column:
    """The point that the search for centres starts from: of least hash, whatever the order of the rows."""
    return F.min_by(F.struct("x", "y"), F.struct(F.xxhash64("x", "y", F.lit(seed)), "x", "y"))


def _mean(c: str) -> Column:
    return F.sum(F.col(c) * F.col("n")) / F.sum("n")


def cluster_kmeans(df: DataFrame, x: str, y: str, k: int, out: str = "cluster", rounds: int = 50, seed: int = 42) -> DataFrame:
    """Lloyd's algorithm on points. Only the k centres live on the driver; each round is one aggregation over the distinct
    points and their counts, whose assignment is a Column expression. Starts from a farthest-point choice over all points,
    so there are k centres where there are k distinct points."""
    from pelagia.operators.graph import cut

    pts = cut(_distinct_points(df, [], x, y))
    first = pts.agg(_least_hash(seed).alias("p")).first()["p"]
    if first is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    centres = [np.array(first, float)]
    while len(centres) < k:
        d = [(F.col("x") - float(a)) * (F.col("x") - float(a)) + (F.col("y") - float(b)) * (F.col("y") - float(b)) for a, b in centres]
        far = pts.agg(F.max(F.struct((F.least(*d) if len(d) > 1 else d[0]).alias("d"), "x", "y")).alias("f")).first()["f"]
        if not far["d"] > 0:
            break
        centres.append(np.array((far["x"], far["y"]), float))

    def nearest(cs: Sequence[np.ndarray], x: str, y: str) -> Column:
        d = [F.struct(((F.col(x) - float(a)) * (F.col(x) - float(a)) + (F.col(y) - float(b)) * (F.col(y) - float(b))).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(cs)]
        return (F.least(*d) if len(d) > 1 else d[0])["i"]

    for _ in range(rounds):
        got = {r["c"]: (r["a"], r["b"]) for r in pts.groupBy(nearest(centres, "x", "y").alias("c")).agg(_mean("x").alias("a"), _mean("y").alias("b")).collect()}
        new = [np.array(got.get(i, c), float) for i, c in enumerate(centres)]
        moved = max(float(np.abs(a - b).max()) for a, b in zip(new, centres))
        centres = new
        if moved < 1e-9:
            break
    return df.withColumn(out, F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), nearest(centres, x, y)))


def _kmeans_by(df: DataFrame, by: str, x: str, y: str, k: int, out: str, rounds: int = 50, seed: int = 42) -> DataFrame:
    """cluster_kmeans() within each value of a (never null) column. Centres are a table of one row for each value, joined
    to the points in every round; only whether any of them moved comes to the driver."""
    from pelagia.operators.graph import cut

    pts = cut(_distinct_points(df, [by], x, y))

    def nearest(x: str, y: str) -> Column:
        far = lambda c, i: F.struct(((F.col(x) - c["x"]) * (F.col(x) - c["x"]) + (F.col(y) - c["y"]) * (F.col(y) - c["y"])).alias("d"), i.alias("i"))
        return F.array_min(F.transform("__centres", far))

    centres = cut(pts.groupBy(by).agg(F.array(_least_hash(seed)).alias("__centres")))
    for most in range(2, k + 1):
        far = pts.join(centres, by).groupBy(by).agg(F.max(F.struct(nearest("x", "y")["d"].alias("d"), F.struct("x", "y").alias("p"))).alias("f"))
        grown = F.when(F.col("f.d") > 0, F.concat("__centres", F.array("f.p"))).otherwise(F.col("__centres"))
        centres = cut(centres.join(far, by).select(by, grown.alias("__centres")))
        if (centres.agg(F.max(F.size("__centres"))).first()[0] or 0) < most:  # no value has more distinct points
            break
    for _ in range(rounds):
        mean = pts.join(centres, by).groupBy(by, nearest("x", "y")["i"].alias("i")).agg(F.struct(_mean("x").alias("x"), _mean("y").alias("y")).alias("c"))
        means = mean.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
        moved = lambda c, i: F.coalesce(F.col("m")[i], c)
        new = cut(centres.join(means, by).select(by, F.transform("__centres", moved).alias("__centres"), F.col("__centres").alias("__old")))
        gap = F.array_max(F.zip_with("__centres", "__old", lambda a, b: F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]))))
        still = new.agg(F.max(gap)).first()[0]
        centres = new.drop("__old")
        if still is None or still < 1e-9:
            break
    known = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col("__centres").isNotNull()
    return df.join(centres, by, "left").withColumn(out, F.when(known, nearest(x, y)["i"]).cast("int")).drop("__centres")


def cluster_over(df: DataFrame, function: str, args: Sequence[float], parts: int, out: str) -> DataFrame:
    """df (with __geom and __part0..) and the cluster of each row's centroid within its partition; null: noise, no geometry."""
    from pelagia.operators.graph import cut

    register(df.sparkSession)
    kept = [c for c in df.columns if c != "__geom" and c not in {f"__part{i}" for i in range(parts)}]
    centre = F.call_function("st_centroid", F.col("__geom"))
    by = F.to_json(F.struct(*[F.col(f"__part{i}") for i in range(parts)])) if parts else F.lit("")
    pts = df.withColumn("__x", F.call_function("st_x", centre)).withColumn("__y", F.call_function("st_y", centre)).withColumn("__by", by)
    if function == "st_clusterkmeans":
        (k,) = args
        got = _kmeans_by(pts, "__by", "__x", "__y", int(k), out) if parts else cluster_kmeans(pts, "__x", "__y", int(k), out)
    else:
        eps, least = args
        pts = cut(pts.withColumn("__row", F.monotonically_increasing_id()))
        got = cluster_dbscan(pts, "__row", "__x", "__y", float(eps), int(least), out, ["__by"])
    return got.select(*[F.col(f"`{c}`") for c in kept], out)


#: How often a cell's boxes are cut into 16 before single places decide whether two cells are linked.
_BOX_LEVELS = 4


def _dbscan_links(core: DataFrame, cell: list[str], side: float, reach: float) -> DataFrame:
    """u, v: nodes of core places (whose `node` stands for a cell) that hold two places within the distance; none is left out but those that others connect.

    Cells are compared by the bounding boxes of their parts: boxes all of whose places are near link, boxes that are too far apart don't, and
    what is left between nodes that are not linked yet is cut into smaller boxes, at last into single places, whose boxes always decide."""
    from pelagia.operators.graph import connected, cut

    def boxes(level: int) -> DataFrame:
        index = [F.floor(F.col(c) / F.lit(side / 4**level)).cast("long") for c in "xy"]
        parts = [index[0].alias("i"), index[1].alias("j"), *([F.col("x").alias("px"), F.col("y").alias("py")] if level > _BOX_LEVELS else [])]
        up = [F.floor(F.col(c) / F.lit(side / 4 ** (level - 1))).cast("long").alias(n) for c, n in (("x", "ui"), ("y", "uj"))]
        got = core.groupBy(*cell, "node", *parts, *up).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        return got.select(*cell, "node", F.struct("i", "j").alias("box"), F.struct("ui", "uj").alias("up"), "x0", "x1", "y0", "y1")

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])

    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    gap = [F.greatest(F.lit(0.0), b(f"{c}0") - a(f"{c}1"), a(f"{c}0") - b(f"{c}1")) for c in "xy"]
    far = [F.greatest(b(f"{c}1") - a(f"{c}0"), a(f"{c}1") - b(f"{c}0")) for c in "xy"]

    def judged(met: DataFrame) -> DataFrame:
        met = met.filter(gap[0] * gap[0] + gap[1] * gap[1] <= reach)
        return cut(met.select(a("node").alias("u"), b("node").alias("v"), a("box").alias("a_box"), b("box").alias("b_box"), (far[0] * far[0] + far[1] * far[1] <= reach).alias("sure")).distinct())

    first = boxes(1)
    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) >= (0, 0)]
    near = F.explode(F.array(*[F.struct((F.col("a_cx") + i).alias("cx"), (F.col("a_cy") + j).alias("cy"), F.lit(i == j == 0).alias("own")) for i, j in ahead]))
    meet = [a(c) == b(c) for c in cell[:-2]] + [F.col("to.cx") == b("cx"), F.col("to.cy") == b("cy"), ~F.col("to.own") | (a("node") < b("node"))]
    seen = judged(tagged(first, "a").withColumn("to", near).join(tagged(first, "b"), meet))
    links = cut(seen.filter("sure").select("u", "v").distinct())
    for level in range(2, _BOX_LEVELS + 2):
        left = seen.filter("NOT sure").join(links, ["u", "v"], "left_anti")
        if left.isEmpty():
            break
        if level == 2:  # most have linked by now
            known = connected(links)
            for end in "uv":
                left = left.join(known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
            left = left.filter(F.coalesce("u_in", "u") != F.coalesce("v_in", "v"))
        left = left.select(F.col("u").alias("a_node"), F.col("v").alias("b_node"), F.col("a_box").alias("a_up"), F.col("b_box").alias("b_up"))
        parts = boxes(level).drop(*cell)
        seen = judged(left.join(tagged(parts, "a"), ["a_node", "a_up"]).join(tagged(parts, "b"), ["b_node", "b_up"]))
        links = cut(links.union(seen.filter("sure").select("u", "v")).distinct())
    return links


def cluster_dbscan(df: DataFrame, key: str, x: str, y: str, eps: float, least: int, out: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """DBSCAN of points: core points (at least `least` neighbours within eps and with equal `by` columns, themselves included) within eps
    share a cluster; a border point joins the near cluster of smallest core key; noise, null and infinite coordinates give null. Clusters are
    numbered from 0 by their smallest core key, within `by`.

    No pairs of rows: copies are one place with a count, and cells are so small that the places of one are neighbours. So a cell of `least` rows
    is all core and one node; only places of thinner cells (fewer than `least` each) look at each place of the 25 cells around."""
    from pyspark.sql import Window

    from pelagia.operators.graph import connected, cut

    side, reach = abs(eps) / 1.4143 or 1.0, eps * eps
    part = [f"__p{i}" for i in range(len(by))]
    cell = [*part, "cx", "cy"]
    at = {"x": F.col(f"`{x}`").cast("double"), "y": F.col(f"`{y}`").cast("double")}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, part)], F.col(f"`{key}`").alias("k"), *[v.alias(c) for c, v in at.items()])
    for c in part:
        rows = rows.filter(F.col(c).isNotNull())
    rows = rows.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    places = rows.groupBy(*part, "x", "y").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    places = cut(places.withColumn("cx", F.floor(F.col("x") / F.lit(side)).cast("long")).withColumn("cy", F.floor(F.col("y") / F.lit(side)).cast("long")))
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    tight = wide * wide + high * high <= reach  # always, but where coordinates are too large for eps, or eps is 0
    cells = places.groupBy(*cell).agg((tight & (F.sum("n") >= least)).alias("dense"))
    dense, thin = (places.join(cells.filter(how).select(*cell), cell, "left_semi") for how in ("dense", "NOT dense"))

    def around(these: DataFrame, others: DataFrame) -> DataFrame:
        """a: each of these places, with the columns of each of the others within eps."""
        near = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in range(-2, 3) for j in range(-2, 3)]))
        to = these.select(F.struct(*these.columns).alias("a"), near.alias("to")).select("a", *[F.col(f"a.{c}").alias(c) for c in part], "to.cx", "to.cy")
        dx, dy = F.col("a.x") - F.col("x"), F.col("a.y") - F.col("y")
        return to.join(others, cell).filter(dx * dx + dy * dy <= reach)

    counted = around(thin, places).groupBy("a").agg(F.sum("n").alias("m")).filter(F.col("m") >= least).select("a.*")
    core = dense.unionByName(counted)
    nodes = core.groupBy(*cell).agg(F.min("k").alias("node"), tight.alias("tight"))
    core = cut(core.join(nodes, cell).withColumn("node", F.when(F.col("tight"), F.col("node")).otherwise(F.col("k"))).drop("tight"))
    links = _dbscan_links(core, cell, side, reach)
    label = connected(links.union(core.select(F.col("node").alias("u"), F.col("node").alias("v")))).select("node", "component")
    core = core.join(label, "node")
    border = around(thin.join(core.select(*part, "x", "y"), [*part, "x", "y"], "left_anti"), core.select(*cell, "x", "y", "component"))
    border = border.groupBy("a").agg(F.min("component").alias("component")).select(*[F.col(f"a.{c}") for c in (*part, "x", "y")], "component")
    numbers = core.select(*part, "component").distinct().withColumn(out, (F.row_number().over(Window.partitionBy(*part).orderBy("component")) - 1).cast("int"))
    found = core.select(*part, "x", "y", "component").unionByName(border).join(numbers, [*part, "component"])
    found = found.select(*part, F.col("x").alias("__px"), F.col("y").alias("__py"), out)
    same = [F.col(f"`{c}`") == F.col(n) for c, n in zip(by, part)] + [at["x"] == F.col("__px"), at["y"] == F.col("__py")]
    return df.join(found, same, "left").select(key, *[F.col(f"`{c}`") for c in df.columns if c != key], out)
