"""PostGIS-named functions as Java expressions over JTS geometries, and a few text functions that Spark lacks.

Each line: name | result | arguments | expression. Arguments: G geometry (WKT string, WKB or a box), D double, I integer,
S string. A null argument, or one that is no geometry or has no answer (an IllegalArgumentException or a topology error),
makes the result null; any other exception fails the query. Results: geom (WKB, extended by the SRID if it has one), box,
geoms (list), bool, double, int, string, binary. In the expression g0, g1, .. d0, .. i0, .. s0, .. number the arguments of a
kind. The Java is what Janino compiles, so there are no lambdas and no type arguments.
"""

SPEC = r"""
st_x | double | G | g0 instanceof Point && !g0.isEmpty() ? (Double) ((Point) g0).getX() : null
st_y | double | G | g0 instanceof Point && !g0.isEmpty() ? (Double) ((Point) g0).getY() : null
st_z | double | G | g0 instanceof Point ? number(g0.getCoordinate().getZ()) : null
st_m | double | G | g0 instanceof Point ? number(g0.getCoordinate().getM()) : null
st_srid | int | G | g0.getSRID()
st_geometrytype | string | G | "ST_" + g0.getGeometryType()
st_dimension | int | G | g0.getDimension()
st_coorddim | int | G | hasZ(g0) ? 3 : 2
st_npoints | int | G | g0.getNumPoints()
st_numpoints | int | G | g0 instanceof LineString ? (Integer) g0.getNumPoints() : null
st_numgeometries | int | G | g0.getNumGeometries()
st_numinteriorrings | int | G | g0 instanceof Polygon ? (Integer) ((Polygon) g0).getNumInteriorRing() : null
st_isempty | bool | G | g0.isEmpty()
st_isclosed | bool | G | g0 instanceof LineString ? (Boolean) ((LineString) g0).isClosed() : g0 instanceof MultiLineString ? (Boolean) ((MultiLineString) g0).isClosed() : (Boolean) true
st_isring | bool | G | g0 instanceof LineString ? (Boolean) ((LineString) g0).isRing() : null
st_issimple | bool | G | g0.isSimple()
st_startpoint | geom | G | g0 instanceof LineString && !g0.isEmpty() ? ((LineString) g0).getStartPoint() : null
st_endpoint | geom | G | g0 instanceof LineString && !g0.isEmpty() ? ((LineString) g0).getEndPoint() : null
st_pointn | geom | GI | g0 instanceof LineString && i0 >= 1 && i0 <= g0.getNumPoints() ? ((LineString) g0).getPointN(i0 - 1) : null
st_exteriorring | geom | G | g0 instanceof Polygon ? F.createLineString(((Polygon) g0).getExteriorRing().getCoordinateSequence()) : null
st_interiorringn | geom | GI | g0 instanceof Polygon && i0 >= 1 && i0 <= ((Polygon) g0).getNumInteriorRing() ? F.createLineString(((Polygon) g0).getInteriorRingN(i0 - 1).getCoordinateSequence()) : null
st_geometryn | geom | GI | i0 >= 1 && i0 <= g0.getNumGeometries() ? g0.getGeometryN(i0 - 1) : null
st_point | geom | DD | F.createPoint(new Coordinate(d0, d1))
st_point_z | geom | DDD | F.createPoint(new Coordinate(d0, d1, d2))
st_makepoint | geom | DD | F.createPoint(new Coordinate(d0, d1))
st_pointz | geom | DDD | F.createPoint(new Coordinate(d0, d1, d2))
st_makeline | geom | GG | F.createLineString(concat(g0, g1))
st_makepolygon | geom | G | F.createPolygon(g0.getCoordinates())
st_makeenvelope | geom | DDDD | F.toGeometry(new Envelope(d0, d2, d1, d3))
st_makebox2d | box | DDDD | new Envelope(d0, d2, d1, d3)
st_astext | string | G | new WKTWriter(hasZ(g0) ? 3 : 2).write(g0)
st_asbinary | binary | G | new WKBWriter(hasZ(g0) ? 3 : 2).write(g0)
st_asewkb | binary | G | new WKBWriter(hasZ(g0) ? 3 : 2, true).write(g0)
st_asgeojson | string | G | geojson(g0)
st_geomfromtext | geom | G | g0
st_geomfromwkb | geom | G | g0
st_geomfromewkb | geom | G | srid(g0, 0)
st_geomfromgeojson | geom | S | fromGeojson(s0)
st_geohash | string | G | geohash(g0, 20)
st_geohash_n | string | GI | geohash(g0, i0)
st_pointfromgeohash | geom | S | fromGeohash(s0)
st_intersects | bool | GG | meets(g0, g1)
st_disjoint | bool | GG | !meets(g0, g1)
st_contains | bool | GG | holds(g0, g1)
st_containsproperly | bool | GG | holdsProperly(g0, g1)
st_within | bool | GG | holds(g1, g0)
st_covers | bool | GG | covers(g0, g1)
st_coveredby | bool | GG | covers(g1, g0)
st_touches | bool | GG | g0.touches(g1)
st_crosses | bool | GG | g0.crosses(g1)
st_overlaps | bool | GG | g0.overlaps(g1)
st_equals | bool | GG | g0.equalsTopo(g1)
st_relate | string | GG | g0.relate(g1).toString()
st_relate_matches | bool | GGS | g0.relate(g1, s0)
st_dwithin | bool | GGD | g0.isWithinDistance(g1, d0)
st_dfullywithin | bool | GGD | farthest(g0, g1) <= d0
st_bboxintersects | bool | GG | g0.getEnvelopeInternal().intersects(g1.getEnvelopeInternal())
st_area | double | G | g0.getArea()
st_length | double | G | lineal(g0)
st_perimeter | double | G | areal(g0) ? g0.getBoundary().getLength() : 0.0
st_distance | double | GG | g0.distance(g1)
st_maxdistance | double | GG | farthest(g0, g1)
st_hausdorffdistance | double | GG | org.locationtech.jts.algorithm.distance.DiscreteHausdorffDistance.distance(g0, g1)
st_frechetdistance | double | GG | org.locationtech.jts.algorithm.distance.DiscreteFrechetDistance.distance(g0, g1)
st_distancesphere | double | GG | sphere(g0.getCoordinate(), g1.getCoordinate())
st_distancespheroid | double | GG | inverse(g0.getCoordinate(), g1.getCoordinate())[0]
st_closestpoint | geom | GG | F.createPoint(org.locationtech.jts.operation.distance.DistanceOp.nearestPoints(g0, g1)[0])
st_shortestline | geom | GG | F.createLineString(org.locationtech.jts.operation.distance.DistanceOp.nearestPoints(g0, g1))
st_linelocatepoint | double | GG | new LengthIndexedLine(g0).project(g1.getCoordinate()) / g0.getLength()
st_lineinterpolatepoint | geom | GD | d0 >= 0 && d0 <= 1 ? F.createPoint(new LengthIndexedLine(g0).extractPoint(d0 * g0.getLength())) : null
st_union | geom | GG | areal(g0) && areal(g1) ? overlay(g0, g1, OverlayNG.UNION) : null
st_intersection | geom | GG | areal(g0) && areal(g1) ? overlay(g0, g1, OverlayNG.INTERSECTION) : null
st_difference | geom | GG | areal(g0) && areal(g1) ? overlay(g0, g1, OverlayNG.DIFFERENCE) : null
st_symdifference | geom | GG | areal(g0) && areal(g1) ? overlay(g0, g1, OverlayNG.SYMDIFFERENCE) : null
st_buffer | geom | GD | g0.buffer(d0)
st_convexhull | geom | G | g0.convexHull()
st_concavehull | geom | GD | org.locationtech.jts.algorithm.hull.ConcaveHull.concaveHullByLengthRatio(g0, d0)
st_orientedenvelope | geom | G | org.locationtech.jts.algorithm.MinimumDiameter.getMinimumRectangle(g0)
st_boundary | geom | G | g0.getClass() == GeometryCollection.class ? F.createGeometryCollection() : g0.getBoundary()
st_centroid | geom | G | g0.getCentroid()
st_pointonsurface | geom | G | g0.getInteriorPoint()
st_simplify | geom | GD | org.locationtech.jts.simplify.DouglasPeuckerSimplifier.simplify(g0, d0)
st_simplifyvw | geom | GD | org.locationtech.jts.simplify.VWSimplifier.simplify(g0, Math.sqrt(d0))
st_segmentize | geom | GD | d0 > 0 ? org.locationtech.jts.densify.Densifier.densify(g0, d0) : null
st_removerepeatedpoints | geom | G | withoutRepeats(g0)
st_reverse | geom | G | g0.reverse()
st_forcepolygonccw | geom | G | wind(g0, true)
st_forcepolygoncw | geom | G | wind(g0, false)
st_force2d | geom | G | flat(g0)
st_force3d | geom | G | raised(g0)
st_flipcoordinates | geom | G | flipped(g0)
st_setsrid | geom | GI | srid(g0, i0)
st_isvalid | bool | G | g0.isValid()
st_isvalidreason | string | G | reason(g0)
st_makevalid | geom | G | areal(g0) ? org.locationtech.jts.geom.util.GeometryFixer.fix(g0) : null
st_translate | geom | GDD | AffineTransformation.translationInstance(d0, d1).transform(g0)
st_scale | geom | GDD | AffineTransformation.scaleInstance(d0, d1).transform(g0)
st_rotate | geom | GD | AffineTransformation.rotationInstance(d0).transform(g0)
st_affine | geom | GDDDDDD | new AffineTransformation(d0, d1, d4, d2, d3, d5).transform(g0)
st_envelope | box | G | g0.getEnvelopeInternal()
st_expand | box | GD | grow(g0.getEnvelopeInternal(), d0)
st_xmin | double | G | g0.isEmpty() ? null : (Double) g0.getEnvelopeInternal().getMinX()
st_ymin | double | G | g0.isEmpty() ? null : (Double) g0.getEnvelopeInternal().getMinY()
st_xmax | double | G | g0.isEmpty() ? null : (Double) g0.getEnvelopeInternal().getMaxX()
st_ymax | double | G | g0.isEmpty() ? null : (Double) g0.getEnvelopeInternal().getMaxY()
st_zmin | double | G | height(g0, false)
st_zmax | double | G | height(g0, true)
st_delaunaytriangles | geom | G | delaunay(g0)
st_voronoipolygons | geom | G | voronoi(g0)
st_voronoilines | geom | G | org.locationtech.jts.operation.union.UnaryUnionOp.union(lines(voronoi(g0)))
st_chaikinsmoothing | geom | GI | i0 <= 8 ? smooth(g0, i0) : null
st_azimuth | double | GG | inverse(g0.getCoordinate(), g1.getCoordinate())[1]
st_project | geom | GDD | F.createPoint(direct(g0.getCoordinate(), d0, d1))
st_multi | geom | G | multi(g0)
st_points | geom | G | F.createMultiPointFromCoords(g0.getCoordinates())
st_snaptogrid | geom | GD | d0 > 0 ? snapped(g0, d0) : g0
st_addpoint | geom | GG | insert(g0, g1, -1)
st_addpoint_at | geom | GGI | insert(g0, g1, i0)
st_removepoint | geom | GI | removeAt(g0, i0)
st_setpoint | geom | GIG | setAt(g0, i0, g1)
st_dump | geoms | G | parts(g0)
st_transform | geom | GI | transform(g0, g0.getSRID() == 0 ? 4326 : g0.getSRID(), i0)
st_transform_between | geom | GII | transform(g0, i0, i1)
st_unionall | geom | G | org.locationtech.jts.operation.union.UnaryUnionOp.union(g0)
st_geojson_as_wkt | string | S | new WKTWriter().write(fromGeojson(s0))
regexp_count_of | int | SSI | count(s0, s1, i0)
regexp_instr_of | int | SSIII | place(s0, s1, i0, i1, i2)
regexp_match_of | strings | SS | groups(s0, s1)
chr_of | string | I | new String(Character.toChars(i0))
"""

#: Names that depend on the number of arguments.
BY_ARITY = {
    ("st_point", 3): "st_point_z", ("st_makepoint", 3): "st_pointz", ("st_geohash", 2): "st_geohash_n", ("st_relate", 3): "st_relate_matches",
    ("st_addpoint", 3): "st_addpoint_at", ("st_transform", 3): "st_transform_between",
}

HELPERS = r"""
  static final GeometryFactory F = new GeometryFactory();

  /** The last arguments that were read in this thread: constants of a query are read once, and prepared when they come again. */
  static class Seen { Object key; Geometry geometry; PreparedGeometry prepared; int hits; }
  static final ThreadLocal SEEN = new ThreadLocal();
  static Seen[] seen() {
    Seen[] s = (Seen[]) SEEN.get();
    if (s == null) { s = new Seen[4]; SEEN.set(s); }
    return s;
  }
  static boolean same(Object a, Object b) {
    return a instanceof byte[] ? b instanceof byte[] && Arrays.equals((byte[]) a, (byte[]) b) : a.equals(b);
  }
  static Geometry geom(Object a) throws ParseException {
    if (a == null) return null;
    if (a instanceof Row) {
      Row r = (Row) a;
      return F.toGeometry(new Envelope(r.getDouble(0), r.getDouble(2), r.getDouble(1), r.getDouble(3)));
    }
    if (!(a instanceof String) && !(a instanceof byte[])) throw new IllegalArgumentException("no geometry");
    Seen[] s = seen();
    for (int i = 0; i < s.length; i++) {
      if (s[i] != null && same(s[i].key, a)) {
        Seen hit = s[i];
        hit.hits++;
        if (i > 0) { s[i] = s[i - 1]; s[i - 1] = hit; }
        return hit.geometry;
      }
    }
    Seen fresh = new Seen();
    fresh.key = a;
    fresh.geometry = a instanceof String ? new WKTReader().read((String) a) : new WKBReader().read((byte[]) a);
    s[s.length - 1] = fresh;
    return fresh.geometry;
  }
  /** A prepared form of a geometry that came several times, else null. */
  static PreparedGeometry ready(Geometry g) {
    Seen[] s = seen();
    for (int i = 0; i < s.length; i++) {
      if (s[i] != null && s[i].geometry == g && s[i].hits > 2) {
        if (s[i].prepared == null) s[i].prepared = PreparedGeometryFactory.prepare(g);
        return s[i].prepared;
      }
    }
    return null;
  }
  static boolean meets(Geometry a, Geometry b) {
    if (!a.getEnvelopeInternal().intersects(b.getEnvelopeInternal())) return false;
    PreparedGeometry p = ready(a);
    if (p != null) return p.intersects(b);
    p = ready(b);
    return p != null ? p.intersects(a) : a.intersects(b);
  }
  static boolean holds(Geometry a, Geometry b) {
    if (!a.getEnvelopeInternal().covers(b.getEnvelopeInternal())) return false;
    PreparedGeometry p = ready(a);
    return p != null ? p.contains(b) : a.contains(b);
  }
  static boolean holdsProperly(Geometry a, Geometry b) {
    if (!a.getEnvelopeInternal().covers(b.getEnvelopeInternal())) return false;
    PreparedGeometry p = ready(a);
    return p != null ? p.containsProperly(b) : a.relate(b, "T**FF*FF*");
  }
  static boolean covers(Geometry a, Geometry b) {
    if (!a.getEnvelopeInternal().covers(b.getEnvelopeInternal())) return false;
    PreparedGeometry p = ready(a);
    return p != null ? p.covers(b) : a.covers(b);
  }
  static Geometry srid(Geometry g, int srid) { Geometry c = g.copy(); c.setSRID(srid); return c; }
  /** What is computed from a geometry is in its reference system. */
  static Geometry as(Geometry first, Geometry g) { return g == null || g.getSRID() != 0 || first.getSRID() == 0 ? g : srid(g, first.getSRID()); }
  static Object v(double x) { return Double.valueOf(x); }
  static Object v(int x) { return Integer.valueOf(x); }
  static Object v(boolean x) { return Boolean.valueOf(x); }
  static Object v(Object x) { return x; }
  static final ThreadLocal PATTERN = new ThreadLocal();
  static java.util.regex.Matcher matcher(String s, String p) {
    java.util.regex.Pattern c = (java.util.regex.Pattern) PATTERN.get();
    if (c == null || !c.pattern().equals(p)) { c = java.util.regex.Pattern.compile(p); PATTERN.set(c); }
    return c.matcher(s);
  }
  /** Characters are code points, the first is 1. */
  static int unit(String s, int at) {
    if (at < 1) throw new IllegalArgumentException("positions start from 1");
    return at > s.codePointCount(0, s.length()) ? s.length() : s.offsetByCodePoints(0, at - 1);
  }
  static int count(String s, String p, int from) {
    java.util.regex.Matcher m = matcher(s, p);
    int n = 0;
    if (m.find(unit(s, from))) do n++; while (m.find());
    return n;
  }
  static int place(String s, String p, int from, int nth, int group) {
    java.util.regex.Matcher m = matcher(s, p);
    boolean found = m.find(unit(s, from));
    for (int k = 1; k < nth && found; k++) found = m.find();
    if (!found || group > m.groupCount() || m.start(group) < 0) return 0;
    return s.codePointCount(0, m.start(group)) + 1;
  }
  static List groups(String s, String p) {
    java.util.regex.Matcher m = matcher(s, p);
    if (!m.find()) return null;
    List out = new ArrayList();
    if (m.groupCount() == 0) out.add(m.group());
    for (int i = 1; i <= m.groupCount(); i++) out.add(m.group(i));
    return out;
  }
  static Double number(double x) { return Double.isNaN(x) ? null : (Double) x; }
  static boolean hasZ(Geometry g) { Coordinate c = g.getCoordinate(); return c != null && !Double.isNaN(c.getZ()); }
  static boolean areal(Geometry g) { return g instanceof Polygon || g instanceof MultiPolygon; }
  static double lineal(Geometry g) { return g instanceof LineString || g instanceof MultiLineString ? g.getLength() : 0.0; }
  static byte[] wkb(Geometry g) { return g == null ? null : new WKBWriter(hasZ(g) ? 3 : 2, g.getSRID() != 0).write(g); }
  static Row box(Envelope e) { return e.isNull() ? null : RowFactory.create(e.getMinX(), e.getMinY(), e.getMaxX(), e.getMaxY()); }
  static Envelope grow(Envelope e, double d) { Envelope c = new Envelope(e); c.expandBy(d); return c; }
  static Coordinate[] concat(Geometry a, Geometry b) {
    Coordinate[] p = a.getCoordinates(), q = b.getCoordinates(), all = new Coordinate[p.length + q.length];
    System.arraycopy(p, 0, all, 0, p.length);
    System.arraycopy(q, 0, all, p.length, q.length);
    return all;
  }
  static Geometry overlay(Geometry a, Geometry b, int op) { return OverlayNGRobust.overlay(a, b, op); }
  static double farthest(Geometry a, Geometry b) {
    double most = 0;
    Coordinate[] p = a.getCoordinates(), q = b.getCoordinates();
    for (int i = 0; i < p.length; i++) for (int j = 0; j < q.length; j++) most = Math.max(most, p[i].distance(q[j]));
    return most;
  }
  static Geometry edit(Geometry g, GeometryEditor.CoordinateOperation op) { return new GeometryEditor(F).edit(g, op); }
  static abstract class Each extends GeometryEditor.CoordinateOperation {
    public abstract Coordinate of(Coordinate c);
    public Coordinate[] edit(Coordinate[] c, Geometry part) {
      Coordinate[] out = new Coordinate[c.length];
      for (int i = 0; i < c.length; i++) out[i] = of(c[i]);
      return out;
    }
  }
  static class Flat extends Each { public Coordinate of(Coordinate c) { return new Coordinate(c.x, c.y); } }
  static class Raised extends Each { public Coordinate of(Coordinate c) { return new Coordinate(c.x, c.y, Double.isNaN(c.getZ()) ? 0 : c.getZ()); } }
  static class Flipped extends Each { public Coordinate of(Coordinate c) { return new Coordinate(c.y, c.x, c.getZ()); } }
  static class Snapped extends Each {
    final double size;
    Snapped(double size) { this.size = size; }
    public Coordinate of(Coordinate c) { return new Coordinate(Math.rint(c.x / size) * size, Math.rint(c.y / size) * size, c.getZ()); }
  }
  static class Projected extends Each {
    final int from, to;
    Projected(int from, int to) { this.from = from; this.to = to; }
    public Coordinate of(Coordinate c) { return project(unproject(c, from), to); }
  }
  static class Distinct extends GeometryEditor.CoordinateOperation {
    public Coordinate[] edit(Coordinate[] c, Geometry part) { return CoordinateArrays.removeRepeatedPoints(c); }
  }
  static class Smooth extends GeometryEditor.CoordinateOperation {
    final int rounds;
    Smooth(int rounds) { this.rounds = rounds; }
    public Coordinate[] edit(Coordinate[] c, Geometry part) { return chaikin(c, rounds); }
  }
  static Geometry flat(Geometry g) { return edit(g, new Flat()); }
  static Geometry raised(Geometry g) { return edit(g, new Raised()); }
  static Geometry flipped(Geometry g) { return edit(g, new Flipped()); }
  static Geometry snapped(Geometry g, double size) { return edit(g, new Snapped(size)); }
  static Geometry withoutRepeats(Geometry g) { return edit(g, new Distinct()); }
  static Geometry smooth(Geometry g, int rounds) { return edit(g, new Smooth(rounds)); }
  static Double height(Geometry g, boolean most) {
    Coordinate[] c = g.getCoordinates();
    double best = Double.NaN;
    for (int i = 0; i < c.length; i++) {
      double z = c[i].getZ();
      if (!Double.isNaN(z) && (Double.isNaN(best) || (most ? z > best : z < best))) best = z;
    }
    return number(best);
  }
  static Geometry wind(Geometry g, boolean ccw) {
    if (g instanceof Polygon) {
      Polygon p = (Polygon) g;
      LinearRing shell = turn(p.getExteriorRing(), ccw);
      LinearRing[] holes = new LinearRing[p.getNumInteriorRing()];
      for (int i = 0; i < holes.length; i++) holes[i] = turn(p.getInteriorRingN(i), !ccw);
      return F.createPolygon(shell, holes);
    }
    if (g instanceof GeometryCollection) {
      Geometry[] parts = new Geometry[g.getNumGeometries()];
      for (int i = 0; i < parts.length; i++) parts[i] = wind(g.getGeometryN(i), ccw);
      return F.buildGeometry(Arrays.asList(parts));
    }
    return g;
  }
  static LinearRing turn(LinearRing r, boolean ccw) { return Orientation.isCCW(r.getCoordinateSequence()) == ccw ? r : r.reverse(); }
  static String reason(Geometry g) {
    TopologyValidationError e = new IsValidOp(g).getValidationError();
    return e == null ? "Valid Geometry" : e.getMessage() + "[" + num(e.getCoordinate().x) + " " + num(e.getCoordinate().y) + "]";
  }
  static String num(double x) { return x == Math.rint(x) && Math.abs(x) < 1e15 ? String.valueOf((long) x) : String.valueOf(x); }
  static Geometry delaunay(Geometry g) { DelaunayTriangulationBuilder b = new DelaunayTriangulationBuilder(); b.setSites(g); return b.getTriangles(F); }
  static Geometry voronoi(Geometry g) {
    VoronoiDiagramBuilder b = new VoronoiDiagramBuilder();
    b.setSites(g);
    Envelope e = g.getEnvelopeInternal();
    b.setClipEnvelope(grow(e, 0.5 * Math.max(e.getWidth(), e.getHeight())));
    return b.getDiagram(F);
  }
  static Geometry lines(Geometry g) {
    List out = new ArrayList();
    for (int i = 0; i < g.getNumGeometries(); i++) out.add(g.getGeometryN(i).getBoundary());
    return F.buildGeometry(out);
  }
  static Coordinate[] chaikin(Coordinate[] c, int rounds) {
    for (int k = 0; k < rounds && c.length > 2; k++) {
      boolean ring = c[0].equals2D(c[c.length - 1]);
      List out = new ArrayList();
      if (!ring) out.add(c[0]);
      for (int i = 0; i + 1 < c.length; i++) {
        out.add(new Coordinate(0.75 * c[i].x + 0.25 * c[i + 1].x, 0.75 * c[i].y + 0.25 * c[i + 1].y));
        out.add(new Coordinate(0.25 * c[i].x + 0.75 * c[i + 1].x, 0.25 * c[i].y + 0.75 * c[i + 1].y));
      }
      out.add(ring ? ((Coordinate) out.get(0)).copy() : c[c.length - 1]);
      c = (Coordinate[]) out.toArray(new Coordinate[0]);
    }
    return c;
  }
  static Geometry multi(Geometry g) {
    if (g instanceof Point) return F.createMultiPoint(new Point[] {(Point) g});
    if (g instanceof LineString) return F.createMultiLineString(new LineString[] {(LineString) g});
    if (g instanceof Polygon) return F.createMultiPolygon(new Polygon[] {(Polygon) g});
    return g;
  }
  static Geometry insert(Geometry g, Geometry p, int at) {
    if (!(g instanceof LineString) || at > g.getNumPoints()) return null;
    List c = new ArrayList(Arrays.asList(g.getCoordinates()));
    c.add(at < 0 ? c.size() : at, p.getCoordinate());
    return F.createLineString((Coordinate[]) c.toArray(new Coordinate[0]));
  }
  static Geometry removeAt(Geometry g, int at) {
    if (!(g instanceof LineString) || at < 0 || at >= g.getNumPoints() || g.getNumPoints() < 3) return null;
    List c = new ArrayList(Arrays.asList(g.getCoordinates()));
    c.remove(at);
    return F.createLineString((Coordinate[]) c.toArray(new Coordinate[0]));
  }
  static Geometry setAt(Geometry g, int at, Geometry p) {
    if (!(g instanceof LineString)) return null;
    Coordinate[] c = g.copy().getCoordinates();
    int i = at < 0 ? c.length + at : at;
    if (i < 0 || i >= c.length) return null;
    c[i] = p.getCoordinate();
    return F.createLineString(c);
  }
  static List parts(Geometry g) {
    List out = new ArrayList();
    for (int i = 0; i < g.getNumGeometries(); i++) {
      Geometry p = g.getGeometryN(i);
      if (p instanceof GeometryCollection && p != g) out.addAll(parts(p)); else out.add(wkb(p));
    }
    return out;
  }
  static String pair(Coordinate c) { return "[" + num(c.x) + "," + num(c.y) + (Double.isNaN(c.getZ()) ? "" : "," + num(c.getZ())) + "]"; }
  static String pairs(Coordinate[] c) { StringBuilder b = new StringBuilder("["); for (int i = 0; i < c.length; i++) b.append(i > 0 ? "," : "").append(pair(c[i])); return b.append("]").toString(); }
  static String body(Geometry g) {
    if (g instanceof Point) return g.isEmpty() ? "[]" : pair(g.getCoordinate());
    if (g instanceof LineString) return pairs(g.getCoordinates());
    StringBuilder b = new StringBuilder("[");
    if (g instanceof Polygon) {
      Polygon p = (Polygon) g;
      if (!p.isEmpty()) b.append(pairs(p.getExteriorRing().getCoordinates()));
      for (int i = 0; i < p.getNumInteriorRing(); i++) b.append(",").append(pairs(p.getInteriorRingN(i).getCoordinates()));
    } else for (int i = 0; i < g.getNumGeometries(); i++) b.append(i > 0 ? "," : "").append(body(g.getGeometryN(i)));
    return b.append("]").toString();
  }
  static String geojson(Geometry g) {
    if (g.getClass() == GeometryCollection.class) {
      StringBuilder b = new StringBuilder("{\"type\":\"GeometryCollection\",\"geometries\":[");
      for (int i = 0; i < g.getNumGeometries(); i++) b.append(i > 0 ? "," : "").append(geojson(g.getGeometryN(i)));
      return b.append("]}").toString();
    }
    return "{\"type\":\"" + g.getGeometryType() + "\",\"coordinates\":" + body(g) + "}";
  }
  static Geometry fromGeojson(String s) throws com.fasterxml.jackson.core.JsonProcessingException { return fromNode(new ObjectMapper().readTree(s)); }
  static Geometry fromNode(JsonNode n) {
    String t = ((JsonNode) n.get("type")).asText();
    if (t.equals("Feature")) return fromNode(((JsonNode) n.get("geometry")));
    List all = new ArrayList();
    if (t.equals("FeatureCollection") || t.equals("GeometryCollection")) {
      JsonNode parts = ((JsonNode) n.get(t.startsWith("F") ? "features" : "geometries"));
      for (int i = 0; i < parts.size(); i++) all.add(fromNode(((JsonNode) parts.get(i))));
      return F.createGeometryCollection((Geometry[]) all.toArray(new Geometry[0]));
    }
    JsonNode c = ((JsonNode) n.get("coordinates"));
    if (t.equals("Point")) return F.createPoint(at(c));
    if (t.equals("LineString")) return F.createLineString(list(c));
    if (t.equals("Polygon")) return polygon(c);
    if (t.equals("MultiPoint")) return F.createMultiPointFromCoords(list(c));
    if (t.equals("MultiLineString")) {
      LineString[] l = new LineString[c.size()];
      for (int i = 0; i < l.length; i++) l[i] = F.createLineString(list(((JsonNode) c.get(i))));
      return F.createMultiLineString(l);
    }
    if (t.equals("MultiPolygon")) {
      Polygon[] l = new Polygon[c.size()];
      for (int i = 0; i < l.length; i++) l[i] = polygon(((JsonNode) c.get(i)));
      return F.createMultiPolygon(l);
    }
    throw new IllegalArgumentException(t);
  }
  static Coordinate at(JsonNode n) { return n.size() > 2 ? new Coordinate(((JsonNode) n.get(0)).asDouble(), ((JsonNode) n.get(1)).asDouble(), ((JsonNode) n.get(2)).asDouble()) : new Coordinate(((JsonNode) n.get(0)).asDouble(), ((JsonNode) n.get(1)).asDouble()); }
  static Coordinate[] list(JsonNode n) { Coordinate[] c = new Coordinate[n.size()]; for (int i = 0; i < c.length; i++) c[i] = at(((JsonNode) n.get(i))); return c; }
  static Polygon polygon(JsonNode n) {
    LinearRing[] holes = new LinearRing[Math.max(0, n.size() - 1)];
    for (int i = 1; i < n.size(); i++) holes[i - 1] = F.createLinearRing(list(((JsonNode) n.get(i))));
    return F.createPolygon(F.createLinearRing(list(((JsonNode) n.get(0)))), holes);
  }
  static final String B32 = "0123456789bcdefghjkmnpqrstuvwxyz";
  static String geohash(Geometry g, int n) {
    Coordinate c = g.getCentroid().getCoordinate();
    double[] lat = {-90, 90}, lon = {-180, 180};
    StringBuilder out = new StringBuilder();
    boolean even = true;
    int bit = 0, ch = 0;
    while (out.length() < n) {
      double[] r = even ? lon : lat;
      double mid = (r[0] + r[1]) / 2, v = even ? c.x : c.y;
      ch = ch * 2 + (v >= mid ? 1 : 0);
      r[v >= mid ? 0 : 1] = mid;
      even = !even;
      if (++bit == 5) { out.append(B32.charAt(ch)); bit = 0; ch = 0; }
    }
    return out.toString();
  }
  static Geometry fromGeohash(String s) {
    double[] lat = {-90, 90}, lon = {-180, 180};
    boolean even = true;
    String low = s.toLowerCase();
    for (int j = 0; j < low.length(); j++) {
      int v = B32.indexOf(low.charAt(j));
      if (v < 0) return null;
      for (int b = 4; b >= 0; b--) {
        double[] r = even ? lon : lat;
        r[(v >> b & 1) == 1 ? 0 : 1] = (r[0] + r[1]) / 2;
        even = !even;
      }
    }
    return F.createPoint(new Coordinate((lon[0] + lon[1]) / 2, (lat[0] + lat[1]) / 2));
  }
  static double sphere(Coordinate a, Coordinate b) {
    double p = Math.toRadians(a.y), q = Math.toRadians(b.y), u = Math.sin((q - p) / 2), v = Math.sin(Math.toRadians(b.x - a.x) / 2);
    return 2 * 6371008.771415059 * Math.asin(Math.min(1, Math.sqrt(u * u + Math.cos(p) * Math.cos(q) * v * v)));
  }
  static final double A = 6378137, FL = 1 / 298.257223563, B = A * (1 - FL);
  /** Vincenty: metres and azimuth (radians from north). */
  static double[] inverse(Coordinate a, Coordinate b) {
    if (a.equals2D(b)) return new double[] {0, 0};
    double L = Math.toRadians(b.x - a.x), u1 = Math.atan((1 - FL) * Math.tan(Math.toRadians(a.y))), u2 = Math.atan((1 - FL) * Math.tan(Math.toRadians(b.y)));
    double s1 = Math.sin(u1), c1 = Math.cos(u1), s2 = Math.sin(u2), c2 = Math.cos(u2), lam = L, before, ss = 0, cs = 0, sig = 0, c2a = 0, c2m = 0;
    int k = 0;
    do {
      double sl = Math.sin(lam), cl = Math.cos(lam);
      ss = Math.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl);
      cs = s1 * s2 + c1 * c2 * cl;
      sig = Math.atan2(ss, cs);
      double sa = c1 * c2 * sl / ss;
      c2a = 1 - sa * sa;
      c2m = c2a == 0 ? 0 : cs - 2 * s1 * s2 / c2a;
      double C = FL / 16 * c2a * (4 + FL * (4 - 3 * c2a));
      before = lam;
      lam = L + (1 - C) * FL * sa * (sig + C * ss * (c2m + C * cs * (-1 + 2 * c2m * c2m)));
    } while (Math.abs(lam - before) > 1e-12 && ++k < 200);
    double uu = c2a * (A * A - B * B) / (B * B), AA = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))), BB = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)));
    double ds = BB * ss * (c2m + BB / 4 * (cs * (-1 + 2 * c2m * c2m) - BB / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)));
    double az = Math.atan2(c2 * Math.sin(lam), c1 * s2 - s1 * c2 * Math.cos(lam));
    return new double[] {B * AA * (sig - ds), az < 0 ? az + 2 * Math.PI : az};
  }
  static Coordinate direct(Coordinate p, double dist, double az) {
    double t1 = (1 - FL) * Math.tan(Math.toRadians(p.y)), c1 = 1 / Math.sqrt(1 + t1 * t1), s1 = t1 * c1, sa0 = Math.sin(az), ca0 = Math.cos(az);
    double sig1 = Math.atan2(t1, ca0), sa = c1 * sa0, c2a = 1 - sa * sa, uu = c2a * (A * A - B * B) / (B * B);
    double AA = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))), BB = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)));
    double sig = dist / (B * AA), before, c2m, ss, cs;
    int k = 0;
    do {
      c2m = Math.cos(2 * sig1 + sig); ss = Math.sin(sig); cs = Math.cos(sig);
      double ds = BB * ss * (c2m + BB / 4 * (cs * (-1 + 2 * c2m * c2m) - BB / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)));
      before = sig;
      sig = dist / (B * AA) + ds;
    } while (Math.abs(sig - before) > 1e-12 && ++k < 200);
    double x = s1 * ss - c1 * cs * ca0, lat = Math.atan2(s1 * cs + c1 * ss * ca0, (1 - FL) * Math.hypot(sa, x));
    double lam = Math.atan2(ss * sa0, c1 * cs - s1 * ss * ca0), C = FL / 16 * c2a * (4 + FL * (4 - 3 * c2a));
    double L = lam - (1 - C) * FL * sa * (sig + C * ss * (c2m + C * cs * (-1 + 2 * c2m * c2m)));
    return new Coordinate(p.x + Math.toDegrees(L), Math.toDegrees(lat));
  }
  static Geometry transform(Geometry g, int from, int to) {
    if (from == to) return srid(g, to);
    return srid(edit(g, new Projected(from, to)), to);
  }
  static Coordinate unproject(Coordinate c, int srid) {
    if (srid == 4326) return c;
    if (srid == 3857) return new Coordinate(Math.toDegrees(c.x / A), Math.toDegrees(2 * Math.atan(Math.exp(c.y / A)) - Math.PI / 2));
    double[] s = utm(srid);
    double e2 = FL * (2 - FL), ep = e2 / (1 - e2), m = (c.y - s[1]) / 0.9996, mu = m / (A * (1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256)), e1 = (1 - Math.sqrt(1 - e2)) / (1 + Math.sqrt(1 - e2));
    double p = mu + (1.5 * e1 - 27 * Math.pow(e1, 3) / 32) * Math.sin(2 * mu) + (21 * e1 * e1 / 16 - 55 * Math.pow(e1, 4) / 32) * Math.sin(4 * mu) + 151 * Math.pow(e1, 3) / 96 * Math.sin(6 * mu) + 1097 * Math.pow(e1, 4) / 512 * Math.sin(8 * mu);
    double sn = Math.sin(p), C = ep * Math.cos(p) * Math.cos(p), T = Math.tan(p) * Math.tan(p), N = A / Math.sqrt(1 - e2 * sn * sn), R = A * (1 - e2) / Math.pow(1 - e2 * sn * sn, 1.5), D = (c.x - 500000) / (N * 0.9996);
    double lat = p - N * Math.tan(p) / R * (D * D / 2 - (5 + 3 * T + 10 * C - 4 * C * C - 9 * ep) * Math.pow(D, 4) / 24 + (61 + 90 * T + 298 * C + 45 * T * T - 252 * ep - 3 * C * C) * Math.pow(D, 6) / 720);
    double lon = (D - (1 + 2 * T + C) * Math.pow(D, 3) / 6 + (5 - 2 * C + 28 * T - 3 * C * C + 8 * ep + 24 * T * T) * Math.pow(D, 5) / 120) / Math.cos(p);
    return new Coordinate(s[0] + Math.toDegrees(lon), Math.toDegrees(lat));
  }
  static Coordinate project(Coordinate c, int srid) {
    if (srid == 4326) return c;
    if (srid == 3857) return new Coordinate(A * Math.toRadians(c.x), A * Math.log(Math.tan(Math.PI / 4 + Math.toRadians(c.y) / 2)));
    double[] s = utm(srid);
    double e2 = FL * (2 - FL), ep = e2 / (1 - e2), p = Math.toRadians(c.y), sn = Math.sin(p), cp = Math.cos(p), N = A / Math.sqrt(1 - e2 * sn * sn), T = Math.tan(p) * Math.tan(p), C = ep * cp * cp, a = cp * Math.toRadians(c.x - s[0]);
    double M = A * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * p - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * Math.sin(2 * p) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * Math.sin(4 * p) - 35 * e2 * e2 * e2 / 3072 * Math.sin(6 * p));
    double x = 0.9996 * N * (a + (1 - T + C) * Math.pow(a, 3) / 6 + (5 - 18 * T + T * T + 72 * C - 58 * ep) * Math.pow(a, 5) / 120) + 500000;
    double y = 0.9996 * (M + N * Math.tan(p) * (a * a / 2 + (5 - T + 9 * C + 4 * C * C) * Math.pow(a, 4) / 24 + (61 - 58 * T + T * T + 600 * C - 330 * ep) * Math.pow(a, 6) / 720)) + s[1];
    return new Coordinate(x, y);
  }
  static double[] utm(int srid) {
    int z = srid % 100;
    if ((srid / 100 != 326 && srid / 100 != 327) || z < 1 || z > 60) throw new IllegalArgumentException("SRID " + srid);
    return new double[] {z * 6 - 183, srid / 100 == 327 ? 1e7 : 0};
  }
"""
