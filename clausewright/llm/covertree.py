"""Embedding near-dedup: all pairs of vectors of one label within a cosine threshold, by cover trees.

On unit vectors a cosine of t or more is a distance of sqrt(2 - 2 t) or less. Equal vectors of
a label are one point with a weight. The points of a label are split around sampled
centres until no cell holds more than ``BLOCK`` of them; of every cell a task builds a
cover tree: nested levels, each centre of a level is one on all levels below it, nodes of a level have at most half the
radius of the level above, and every node knows its covering radius, the largest distance to a point under it.

Two cells are compared by their roots first, in Spark: if the distance of the centres less
both covering radii is over the threshold, no pair of theirs links; if the distance plus both radii is under
it, all pairs do, which is counted without making them. The rest goes, one pair of trees a group, to a dual
traversal with the same two bounds, level by level; what is still open at the bottom is decided by the cosine
itself in double precision. The bounds keep a margin of ``SLACK``, far more than rounding, so the result is exact.

A tree pair returns a row per point that links: how many vectors, and one point
of the connected ones. Sums and components of these follow in Spark. A task holds two cells. In data
without structure (high dimension, no near points) few pairs of cells are pruned and the work is that of comparing all
pairs of a label, in blocks; clusters tighter than the threshold are counted by node.

Defined cases: vectors that are null, empty, all zero or hold null or infinite or NaN components, and
rows without a label, link with nothing and are their own component; so are vectors of other lengths to each
other; ids may repeat (each row is a vector) or be null (before all others) or of any type, by rank; a
component's id is its first; an empty table gives no rows; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import io
import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, written
from .session import named, ranked, uniform

THRESHOLD = 0.93
#: Points of a cell at most, and centres that a cell is split around at most, in at most so many rounds.
BLOCK, CENTRES, ROUNDS = 2048, 16, 24
#: Bounds keep this far from the threshold's distance.
SLACK = 1e-6
#: Radius of the last level above single points.
LEAST = 2.0**-7
#: What a tree holds by level.
LISTS = ("centre", "radius", "up", "level")


# -- one tree


class Tree:
    """A cover tree over rows of vectors. level[k]: the node of each point on level k; the last level has a node for each point.

    nodes[k] has the centre (a point) and covering radius of each node, up[k] its parent on the level above.
    """

    def __init__(self, vectors: np.ndarray, built: bool = True):
        self.vectors = vectors
        # an exact power of two per row, so that squares neither overflow nor vanish
        self.rows = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.rows, self.rows))
        self.unit = self.rows / self.norm[:, None]
        if built:
            self._build(len(vectors))

    def _build(self, n: int) -> None:
        far = np.sqrt(np.maximum(2 - 2 * (self.unit @ self.unit.T), 0))
        np.fill_diagonal(far, 0)
        of = np.zeros(n, np.int64)
        self.centre, self.radius, self.up = [np.zeros(1, np.int64)], [far[0].max(keepdims=True)], [np.zeros(1, np.int64)]
        self.level = [of]
        r = 1.0
        while r >= LEAST and len(self.centre[-1]) < n:
            of = self._refine(far, of, r)
            r /= 2
        self._close(far, np.arange(n), np.arange(n))

    def dump(self, **more: np.ndarray) -> bytes:
        """The tree as bytes, with further arrays."""
        levels = {f"{name}{k}": x for name in LISTS for k, x in enumerate(getattr(self, name))}
        np.savez(out := io.BytesIO(), vectors=self.vectors, **levels, **more)
        return out.getvalue()

    @classmethod
    def load(cls, body: bytes) -> tuple[Tree, np.lib.npyio.NpzFile]:
        kept = np.load(io.BytesIO(body))
        tree = cls(kept["vectors"], built=False)
        depth = sum(name.startswith("level") for name in kept.files)
        for name in LISTS:
            setattr(tree, name, [kept[f"{name}{k}"] for k in range(depth)])
        return tree, kept

    def _refine(self, far: np.ndarray, of: np.ndarray, r: float) -> np.ndarray:
        """The next level: each node is covered by balls of radius r, the first around its own centre."""
        centre, below = self.centre[-1], np.empty(len(of), np.int64)
        found: list[int] = []
        order = np.argsort(of, kind="stable")
        for node, points in enumerate(np.split(order, np.flatnonzero(np.diff(of[order])) + 1)):
            c = centre[node]
            while len(points):
                near = far[c, points] <= r
                below[points[near]] = len(found)
                found.append(c)
                points = points[~near]
                c = points[0] if len(points) else c
        self._close(far, np.array(found), below)
        return below

    def _close(self, far: np.ndarray, centre: np.ndarray, of: np.ndarray) -> None:
        radius = np.zeros(len(centre))
        np.maximum.at(radius, of, far[centre[of], np.arange(len(of))])
        up = np.zeros(len(centre), np.int64)
        up[of] = self.level[-1]
        self.centre.append(centre)
        self.radius.append(radius)
        self.up.append(up)
        self.level.append(of)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node connected to each of n nodes."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def traverse(a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight by point of a and of b, and the least connected point (those of b follow those of a)."""
    limit = math.sqrt(max(2 - 2 * threshold, 0))
    n_a, n_b = len(a.rows), len(b.rows)
    sum_a, sum_b, root = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64), np.arange(n_a + n_b)
    depth = max(len(a.level), len(b.level))
    open_ = np.ones((1, 1), bool)
    for k in range(depth):
        # a tree that ends earlier stays on its last level
        ka, kb = min(k, len(a.level) - 1), min(k, len(b.level) - 1)
        if k:
            up_a = a.up[ka] if k == ka else np.arange(len(a.centre[ka]))
            up_b = b.up[kb] if k == kb else np.arange(len(b.centre[kb]))
            open_ = open_[up_a][:, up_b]
        i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(i):
            break
        held = open_[np.ix_(i, j)]
        ca, cb = a.centre[ka][i], b.centre[kb][j]
        if k == depth - 1:
            sure = held & (a.rows[ca] @ b.rows[cb].T / (a.norm[ca][:, None] * b.norm[cb]) >= threshold)
        else:
            far = np.sqrt(np.maximum(2 - 2 * (a.unit[ca] @ b.unit[cb].T), 0))
            reach = a.radius[ka][i][:, None] + b.radius[kb][j]
            sure = held & (far + reach < limit - SLACK)
            open_ = np.zeros_like(open_)
            open_[np.ix_(i, j)] = held & ~sure & (far - reach <= limit + SLACK)
        x, y = np.nonzero(sure)
        if len(x):
            of_a, of_b = a.level[ka], b.level[kb]
            mass_a, mass_b = np.bincount(of_a, weights=weight_a, minlength=len(a.centre[ka])), np.bincount(of_b, weights=weight_b, minlength=len(b.centre[kb]))
            add_a, add_b = np.zeros(len(a.centre[ka])), np.zeros(len(b.centre[kb]))
            add_a[i], add_b[j] = sure @ mass_b[j], sure.T @ mass_a[i]
            sum_a += add_a[of_a].astype(np.int64)
            sum_b += add_b[of_b].astype(np.int64)
            # all points under two such nodes are connected through each other
            in_a, in_b = np.flatnonzero(add_a[of_a] > 0), np.flatnonzero(add_b[of_b] > 0)
            u = np.concatenate([ca[x], a.centre[ka][of_a[in_a]], n_a + b.centre[kb][of_b[in_b]]])
            v = np.concatenate([n_a + cb[y], in_a, n_a + in_b])
            root = forest(n_a + n_b, np.concatenate([np.arange(n_a + n_b), u]), np.concatenate([root, v]))
    return sum_a, sum_b, root


# -- cells


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)


def _matrix(column) -> np.ndarray:
    """Rows of equal length from a column of lists of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def points(rows: DataFrame) -> DataFrame:
    """(point, grp, v, weight): the distinct vectors of rows (grp, v), numbered and written."""
    return written(rows.groupBy("grp", "v").agg(F.count("*").alias("weight")).withColumn("point", F.monotonically_increasing_id()))


def cells(pts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``pts`` with a cell: of one group, near each other, at most ``block`` points."""
    done, rest = None, pts.withColumns({"cell": F.col("grp"), "u": F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.sqrt(_dot(F.col("v"), F.col("v")))), F.lit(0.0)))})
    for k in range(ROUNDS + 1):
        sizes = written(rest.groupBy("cell").agg(F.count("*").alias("size")))
        big = sizes.where(F.col("size") > block)
        small = rest.join(sizes.where(F.col("size") <= block).hint("merge"), "cell", "left_semi").select("point", "grp", "v", "weight", "cell")
        done = small if done is None else done.unionByName(small)
        if not big.limit(1).count():
            break
        held = rest.join(big.hint("merge"), "cell")
        if k == ROUNDS:  # cells that no centre splits are dealt out by number
            part = (F.xxhash64("point") % F.ceil(2 * F.col("size") / block)).cast("string")
            return done.unionByName(held.select("point", "grp", "v", "weight", F.concat_ws("/", "cell", part).alias("cell")))
        want = F.least(F.lit(CENTRES / 1.0), F.ceil(2 * F.col("size") / block))
        picked = held.where(uniform("point", seed=k) < (want + 2) / F.col("size"))
        centres = written(picked.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("point", "u"))).alias("c")))
        near = F.array_max(F.transform("c", lambda c, i: F.struct(_dot(c["u"], F.col("u")).alias("at"), (-i).alias("i"))))
        rest = written(held.join(centres.hint("merge"), "cell", "left").select("point", "grp", "v", "weight", "u", F.concat_ws("/", "cell", F.coalesce(-near["i"], F.lit(0)).cast("string")).alias("cell")))
    return done


TREES = "cell string, grp string, n long, weight long, centre_point long, centre array<double>, radius double, body binary"


def trees(placed: DataFrame) -> DataFrame:
    """One row per cell: the root of its tree, and its points, weights and vectors as bytes."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("point")
        v = _matrix(table["v"])
        point, weight = table["point"].to_numpy(), table["weight"].to_numpy()
        t = Tree(v)
        return pa.table(
            {
                "cell": table["cell"][:1], "grp": table["grp"][:1], "n": [len(v)], "weight": [int(weight.sum())], "centre_point": [int(point[0])],
                "centre": pa.array([t.unit[0]], pa.list_(pa.float64())), "radius": [float(t.radius[0][0])], "body": pa.array([t.dump(point=point, weight=weight)], pa.binary()),
            }
        )

    return placed.select("cell", "grp", "point", "weight", "v").groupBy("cell").applyInArrow(build, TREES)


LINKED = "point long, n long, peer long"


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """One pair of cells: a row for each of both, or one for a cell with itself."""
        (a, of_a), *_, (b, of_b) = [Tree.load(x) for x in table.sort_by("cell")["body"].to_pylist()] * 2
        p, q = of_a["point"], of_b["point"]
        sum_a, sum_b, root = traverse(a, b, of_a["weight"], of_b["weight"], threshold)
        every = np.concatenate([p, q])
        if len(table) == 1:  # both sides are the same points
            root, every, sums = forest(len(p), np.concatenate([np.arange(len(p)), root[len(p) :] % len(p)]), np.concatenate([root[: len(p)] % len(p), np.arange(len(p))])), p, sum_a - 1
        else:
            sums = np.concatenate([sum_a, sum_b])
        some = sums > 0
        return pa.table({"point": every[some], "n": sums[some], "peer": every[root[some]]})

    return run


def linked(placed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(point, n, peer): parts of each point's linked weight, itself left out once per copy, and a point that it is connected to."""
    limit = math.sqrt(max(2 - 2 * threshold, 0))
    built = written(trees(placed))
    roots = built.drop("body")
    a, b = (roots.select(*[F.col(c).alias(f"{c}_{side}") for c in roots.columns]) for side in "ab")
    met = a.join(b.hint("merge"), (F.col("grp_a") == F.col("grp_b")) & (F.col("cell_a") <= F.col("cell_b")))
    far = F.sqrt(F.greatest(2 - 2 * _dot(F.col("centre_a"), F.col("centre_b")), F.lit(0.0)))
    reach = F.col("radius_a") + F.col("radius_b")
    own = F.col("cell_a") == F.col("cell_b")
    bounds = met.withColumns({"sure": ~own & (far + reach < limit - SLACK), "open": own | (far - reach <= limit + SLACK)})
    bounds = written(bounds.where("open").select("cell_a", "cell_b", "weight_a", "weight_b", "centre_point_a", "centre_point_b", "sure"))
    # pairs of cells that link as a whole: their weights, and the centres connect all points
    sure = bounds.where("sure")
    side = lambda x, y: sure.select(F.col(f"cell_{x}").alias("cell"), F.col(f"weight_{y}").alias("w"), F.col(f"centre_point_{y}").alias("peer"))
    whole = side("a", "b").unionByName(side("b", "a")).groupBy("cell").agg(F.sum("w").alias("n"), F.min("peer").alias("peer"))
    by_cell = placed.select("point", "cell").join(whole.hint("merge"), "cell").select("point", "n", "peer")
    centres = sure.select(F.col("centre_point_a").alias("point"), F.lit(0).cast("long").alias("n"), F.col("centre_point_b").alias("peer"))
    # the other pairs, each a group of its own
    left = bounds.where("NOT sure").select("cell_a", "cell_b")
    sides = left.select("cell_a", "cell_b", F.explode(F.array_distinct(F.array("cell_a", "cell_b"))).alias("cell"))
    loaded = sides.join(built.select("cell", "body").hint("merge"), "cell")
    found = loaded.groupBy("cell_a", "cell_b").applyInArrow(_compare(threshold), LINKED)
    return written(found.unionByName(by_cell).unionByName(centres))


def usable(v: Column) -> Column:
    """A vector of finite numbers with a length."""
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    n_links: other vectors linked directly; component_id: the first id reachable by links; kept: whether the id is that one.
    """
    rows = ranked(named(vectors, vec_id=id_col, v=vector_col, label=label_col), "vec_id", "rank")
    # zero has one sign
    v = F.transform(F.col("v").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = rows.select("vec_id", "rank", v.alias("v"), F.col("label").isNotNull().alias("has_label"), F.concat_ws("|", F.col("label").cast("string"), F.size("v").cast("string")).alias("grp"))
    rows = rows.withColumn("usable", F.col("has_label") & usable(F.col("v")))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("grp", "v")))
    able = rows.where("usable")
    pts = points(able.select("grp", "v"))
    placed = written(cells(pts, block))
    parts = linked(placed, threshold)
    sums = parts.groupBy("point").agg(F.sum("n").alias("n"))
    labels = components(parts.select(F.col("point").alias("u"), F.col("peer").alias("v")))
    node = pts.join(sums.hint("merge"), "point", "left").join(labels.withColumnRenamed("node", "point").hint("merge"), "point", "left")
    node = node.select(F.xxhash64("grp", "v").alias("h"), "grp", "v", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("label", "point").alias("label"))
    member = written(able.select("row", "rank", "vec_id", "h", "grp", "v").join(node.hint("merge"), ["h", "grp", "v"]).select("row", "rank", "vec_id", "n", "label"))
    first = member.groupBy("label").agg(F.min(F.struct("rank", "vec_id")).alias("first"))
    known = member.join(first.hint("merge"), "label").select("row", F.col("n").alias("n_links"), F.col("first.vec_id").alias("known_id"))
    out = rows.select("row", "vec_id").join(known.hint("merge"), "row", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("known_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
