"""Points in polygons through a grid that refines itself where borders have much detail.

Cells are squares whose sides halve from level to level. Each polygon is cut to the cells it touches: what a cell holds are
the edges that come near it and what is east of them, of which only the ends of chains count: an edge there lies east of a
point if the point is between its ends in height, and what two edges share falls out. A cell that no edge comes near is inside
or outside as a whole, so it needs no test, or isn't there. Beyond the first cells, only those with points in them are cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.shared import checkpoint

#: First and last level (a cell of level n has sides of 512 / 2^n degrees: 16 and 1/32), and edges of a polygon in a cell
#: above which it is quartered.
FIRST, LAST, MOST_EDGES = 5, 14, 64
#: Degrees of the square of all cells and where it begins; what tests of cells allow for rounding.
SIDE, LOW, SLACK = 512.0, -256.0, 1e-6
#: Cells with points in them that may be broadcast.
BROADCAST_ROWS = 1_000_000


def crosses(lng: Column, lat: Column, e: Column) -> Column:
    """Whether an edge crosses the line from a point eastwards."""
    x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
    return ((y1 > lat) != (y2 > lat)) & (lng < (x2 - x1) * (lat - y1) / F.when(y2 != y1, y2 - y1) + x1)


def touches(lng: Column, lat: Column, e: Column) -> Column:
    """Whether a point is on an edge."""
    x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
    flat = (x2 - x1) * (lat - y1) == (y2 - y1) * (lng - x1)
    return flat & lng.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))


def inside(lng: Column, lat: Column, edges: Column, base: Column | int = 0, ends: Column | None = None) -> Column:
    """Whether a point is in a polygon: an odd number of edges lies east of it, ``base`` and what begins or stops at the heights
    ``ends`` above it besides ``edges``. On an edge is inside."""
    base = F.lit(base) if isinstance(base, int) else base
    base = base if ends is None else base + F.size(F.filter(ends, lambda y: y > lat))
    odd = (F.size(F.filter(edges, lambda e: crosses(lng, lat, e))) + base) % 2 == 1
    return odd | F.exists(edges, lambda e: touches(lng, lat, e))


def edges_of(rings: Column) -> Column:
    """The edges of a polygon's rings, as (x1, y1, x2, y2)."""
    edge = lambda a, b: F.struct(a["lng"].alias("x1"), a["lat"].alias("y1"), b["lng"].alias("x2"), b["lat"].alias("y2"))
    pairs = lambda ring: F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), edge)
    return F.flatten(F.transform(rings, pairs))


def _side(level: Column) -> Column:
    return F.lit(SIDE) / F.pow(F.lit(2.0), level)


def _number(x: Column, level: Column) -> Column:
    return F.floor((x - LOW) / _side(level)).cast("int")


def _box() -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of the cell of a row."""
    w, s = F.col("cell_x") * _side(F.col("level")) + LOW, F.col("cell_y") * _side(F.col("level")) + LOW
    return w, s, w + _side(F.col("level")), s + _side(F.col("level"))


def _near(edges: Column) -> Column:
    """Edges at the height of the row's cell that don't lie west of it."""
    w, s, _, n = _box()
    return F.filter(edges, lambda e: (F.least(e["y1"], e["y2"]) <= n + SLACK) & (F.greatest(e["y1"], e["y2"]) >= s - SLACK) & (F.greatest(e["x1"], e["x2"]) >= w - SLACK))


def _east(e: Column) -> Column:
    return F.least(e["x1"], e["x2"]) > _box()[2] + SLACK


def _once(at: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns``, but Spark can't put the expressions where the columns are read, within functions of each edge even."""
    held = at.withColumn("once", F.explode(F.array(F.struct(*[x.alias(k) for k, x in columns.items()]))))
    return held.select(*[c for c in at.columns if c not in columns], *[F.col("once").getField(k).alias(k) for k in columns])


def _parted(at: DataFrame) -> DataFrame:
    """Rows of cells with only the edges near them: of those east of all points, the ends of chains join ``ends``, and of these
    the ones above all points ``base``."""
    _, s, _, n = _box()
    at = _once(at, edges=_near(F.col("edges")))
    at = _once(at, east=F.filter("edges", _east), edges=F.filter("edges", lambda e: ~_east(e)))
    before, after = (lambda i, d=d: F.get("east", i + d) for d in (-1, 1))
    first = F.transform(F.filter("east", lambda e, i: F.coalesce(before(i)["y2"] != e["y1"], F.lit(True))), lambda e: e["y1"])
    last = F.transform(F.filter("east", lambda e, i: F.coalesce(after(i)["y1"] != e["y2"], F.lit(True))), lambda e: e["y2"])
    at = _once(at, ends=F.concat("ends", first, last)).drop("east")
    over, among = lambda y: y > n + SLACK, lambda y: (y >= s - SLACK) & (y <= n + SLACK)
    return _once(at, base=(F.col("base") + F.size(F.filter("ends", over))) % 2, ends=F.filter("ends", among))


def _quartered(at: DataFrame) -> DataFrame:
    quarter = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 1) for y in (0, 1)]))
    return at.withColumn("q", quarter).select("ord", "name", "key", "edges", "ends", "base", (F.col("level") + 1).alias("level"), (F.col("cell_x") * 2 + F.col("q.x")).alias("cell_x"), (F.col("cell_y") * 2 + F.col("q.y")).alias("cell_y"))


def cut(shapes: DataFrame, most: int = MOST_EDGES, taken: Callable[[], DataFrame] | None = None) -> tuple[DataFrame, list[int]]:
    """(pieces, levels): ord, name, key, cell (level and place as one number), base, ends, edges of each cell of each polygon of
    ``shapes`` (ord, name, key, rings); and the levels that there are. A cell is quartered as long as more than ``most``
    edges of the polygon come near it, down to level ``LAST``. ``taken`` gives the cells of that level (cell_x, cell_y) that
    are asked for; it is called if any cell is quartered, and then what has none of them is left out."""
    rows = shapes.select("ord", "name", "key", F.explode("rings").alias("polygon")).select("ord", "name", "key", edges_of(F.col("polygon")).alias("edges")).filter("size(edges) > 0")
    w, s, e, n = _box()
    whole = inside((w + e) / 2, (s + n) / 2, F.col("edges"), F.col("base"), F.col("ends"))
    at = rows.withColumns({"ends": F.array().cast("array<double>"), "base": F.lit(0), "level": F.lit(0), "cell_x": F.lit(0), "cell_y": F.lit(0)})
    at = _parted(at)
    for _ in range(FIRST):
        at = _parted(_quartered(at)).filter((F.size("edges") > 0) | whole)
    at = at.repartition("ord", "cell_x", "cell_y")
    done, levels, asked = [], [], None
    while True:
        levels.append(FIRST + len(levels))
        at = checkpoint(at.filter((F.size("edges") > 0) | whole))
        open_ = at.filter((F.size("edges") > most) & (F.col("level") < LAST))
        if levels[-1] == LAST or open_.isEmpty():
            done.append(at)
            break
        done.append(at.filter(F.size("edges") <= most))
        quarters = _quartered(open_)
        if taken:
            if asked is None:
                asked = checkpoint(taken())
                few = asked.count() <= BROADCAST_ROWS
            up = LAST - levels[-1] - 1
            own = asked.select(F.shiftright("cell_x", up).alias("cell_x"), F.shiftright("cell_y", up).alias("cell_y")).distinct()
            quarters = quarters.join(F.broadcast(own) if few else own, ["cell_x", "cell_y"], "left_semi")
        at = _parted(quarters)
    pieces = done[0]
    for more in done[1:]:
        pieces = pieces.unionByName(more)
    plain = F.size("edges") == 0
    pieces = pieces.select(
        "ord", "name", "key", _key(F.col("level"), F.col("cell_x"), F.col("cell_y")).alias("cell"),
        F.when(plain, 1).otherwise(F.col("base")).alias("base"), F.when(plain, F.array().cast("array<double>")).otherwise(F.col("ends")).alias("ends"), "edges",
    )
    return pieces, levels


def _key(level: Column, x: Column, y: Column) -> Column:
    return (level.cast("long") * (1 << 20) + x) * (1 << 20) + y


def first_at(rows: DataFrame, shapes: DataFrame, lng: Column, lat: Column, name: str, most: int = MOST_EDGES) -> DataFrame:
    """``rows`` with column ``name`` (name, key; null if none): the first shape by ord that has the row's point.

    What a cell holds of all shapes is one row, which is joined by the cell once for each level that shapes were cut to, so
    every row stays one row, whatever it holds, and a crowded cell can be split. Points beyond all cells, or not numbers,
    are in no shape.
    """
    at = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), lng.alias("x"), lat.alias("y"))
    x, y = F.col("x"), F.col("y")
    fits = x.between(LOW, LOW + SIDE - 1) & y.between(LOW, LOW + SIDE - 1)

    def taken() -> DataFrame:
        nonlocal at
        at = checkpoint(at)  # the points that are looked up are then those that cells were cut for
        return at.filter(fits).select(_number(x, F.lit(LAST)).alias("cell_x"), _number(y, F.lit(LAST)).alias("cell_y")).distinct()

    pieces, levels = cut(shapes, most, taken)
    held = checkpoint(pieces.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("ord", F.struct("name", "key").alias("shape"), "base", "ends", "edges"))).alias("pieces")))
    hits = []
    for n in levels:
        own = held.filter(F.shiftright("cell", 40) == n).select(F.col("cell").bitwiseXOR(F.lit(0).cast("long")).alias(f"cell{n}"), F.col("pieces").alias(f"pieces{n}"))
        at = at.withColumn("at_cell", F.when(fits, _key(F.lit(n), _number(x, F.lit(n)), _number(y, F.lit(n))))).join(own, F.col("at_cell") == F.col(f"cell{n}"), "left").drop("at_cell", f"cell{n}")
        hits.append(F.get(F.transform(F.filter(f"pieces{n}", lambda p: inside(x, y, p["edges"], p["base"], p["ends"])), lambda p: F.struct(p["ord"], p["shape"])), F.lit(0)))
    best = hits[0] if len(hits) == 1 else F.array_min(F.filter(F.array(*hits), lambda h: h.isNotNull()))
    return at.select(*[F.col("row").getField(c).alias(c) for c in rows.columns if c != name], best["shape"].alias(name))
