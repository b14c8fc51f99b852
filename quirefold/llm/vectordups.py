"""Near-duplicate embeddings: int8 tile products with error bounds, exact recomputation of what may reach the threshold.

Vectors are compared where labels are equal. Equal vectors of a label become one node with a number of copies. A label's nodes are dealt to blocks by hash,
and each pair of blocks is a tile, one task's work: the nodes' unit vectors are quantised to int8 with a unit of their own, all products of the tile
are taken on the int8 values, and each vector's quantisation error bounds how far a product may be off. Pairs that the bounds rule out are dropped, pairs that they
prove are links, and only what lies between is computed again in double precision. A tile hands on a row for each node with links: how many, and one node that it hangs together with.
Pairs themselves are never emitted, so a group of n near copies costs rows in proportion to n in each tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quirefold.llm.ann import units
from quirefold.llm.common import connected_components, materialise

THRESHOLD = 0.98
#: Nodes of one block; a tile holds two blocks.
BLOCK = 8192
#: Rows of a tile whose products are taken at a time, and pairs that are computed again at a time.
STRIP, PAIRS = 256, 1 << 16
#: Components whose int8 products add up exactly in single precision: 127 * 127 * 1024 < 2**24.
EXACT = 1024
#: More than what rounding to single precision adds to a product.
ROUNDING = 1e-5
#: Groups of a label and a length up to this many are broadcast; a longer list is joined by a shuffle.
BROADCAST_GROUPS = 10_000


def linkable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their units, and bounds on the length of what they leave of the unit vectors ``u``."""
    unit = np.abs(u).max(axis=1) / 127
    q = np.rint(u / unit[:, None])
    left = np.linalg.norm(u - q * unit[:, None], axis=1)
    return q.astype(np.int8), unit, left * (1 + 1e-9) + 1e-12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of int8 rows, exact: single precision holds whole numbers below 2**24."""
    out = a[:, :EXACT].astype(np.float32) @ b[:, :EXACT].astype(np.float32).T
    for at in range(EXACT, a.shape[1], EXACT):
        out = out.astype(np.float64) + a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


def hung_together(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (of each node a smaller or equal one of its tree) after joining the trees of a and b."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != (up := root[root])).any():
            root = up


def tile_links(threshold: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """Links within a block, or between two: for each node that has some, how many rows it links to and a node of the same component."""

    def links(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, node, copies = (t[c].to_numpy() for c in ("side", "node", "copies"))
        flat = pa.concat_arrays(t["vec"].chunks).flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(side, kind="stable")
        u = units(flat.astype(np.float64).reshape(len(side), -1)[order])
        node, copies, first = node[order], copies[order], int((side == 0).sum())
        q, unit, left = quantised(u)
        own = first == len(side)
        count, root = np.zeros(len(node)), np.arange(len(node))
        for at in range(0, first, STRIP):
            rows = slice(at, min(at + STRIP, first))
            cols = slice(at if own else first, len(node))
            near = products(q[rows], q[cols]) * unit[rows, None].astype(np.float32) * unit[None, cols].astype(np.float32)
            # |x.y - near| <= e_x + e_y + e_x e_y, for unit vectors with what quantising leaves of them no longer than e.
            a_off, b_off = left[rows].astype(np.float32) + np.float32(ROUNDING), (left[cols] * (1 + left[rows].max())).astype(np.float32)
            i, j = np.nonzero(near >= (np.float32(threshold) - a_off)[:, None] - b_off[None, :])
            sure = near[i, j] - a_off[i] - b_off[j] >= threshold
            i, j = i + at, j + cols.start
            if own:
                once = i < j
                i, j, sure = i[once], j[once], sure[once]
            for k in range(0, len(again := np.flatnonzero(~sure)), PAIRS):
                part = again[k : k + PAIRS]
                sure[part] = np.einsum("ij,ij->i", u[i[part]], u[j[part]]) >= threshold
            i, j = i[sure], j[sure]
            count += np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            root = hung_together(root, i, j)
        some = count > 0
        return pa.table({"node": node[some], "other": node[root[some]], "links": count[some].astype(np.int64)})

    return links


def tiles(nodes: DataFrame, block: int) -> DataFrame:
    """Each node once for every tile of its group (label and length): label, dim, i, j, side, node, copies, vec."""
    groups = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    groups = groups.select(F.col("label").alias("l"), F.col("dim").alias("d"), "blocks")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    dealt = nodes.join(groups, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = (F.col("own") > F.col("with")).cast("int")
    return dealt.select("label", "dim", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"), "node", "copies", "vec")


def near_duplicate_vectors(table: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of ``table``: vec_id, n_links, component_id, kept.

    Rows link where labels are equal and not null, vectors are equally long, and their cosine is ``threshold`` (above 0) or more. n_links counts the other rows that a row links to; component_id is
    the smallest vec_id that links lead to, its own included; kept is whether they are the same. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing, nor do rows without a label: n_links is 0 and component_id their own vec_id. Rows that repeat a vector link to one another, those that repeat a
    vec_id alone do not. A row without vec_id takes part, but no component is named after it: component_id is null where no row of it has an id, and then
    all its rows are kept. Other columns are ignored. An empty table gives no rows.

    Work grows with the square of a label's different vectors: every pair is in one tile, as int8 products, and a block of vectors is sent to as many tasks as the label has blocks.
    """
    kind = table.schema[vector_col].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    fine = linkable(F.col(vector_col)) & F.col(label_col).isNotNull()
    # 0 is added so that -0 and 0 are one value.
    vec = F.when(fine, F.transform(vector_col, lambda x: (x.cast(number) + F.lit(0.0).cast(number)).cast(number)))
    rows = materialise(table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec")), "vectors")
    part = rows.where("vec IS NOT NULL")
    equal = part.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # Written, so a node's number is fixed.
    nodes = materialise(equal.select("label", "vec", F.size("vec").alias("dim"), "least", "copies", F.monotonically_increasing_id().alias("node")), "nodes")
    found = tiles(nodes, block).groupBy("label", "dim", "i", "j").applyInArrow(tile_links(threshold), "node long, other long, links long")
    found = materialise(found, "links")
    links = found.groupBy(F.col("node").alias("n")).agg(F.sum("links").alias("links"))
    grouped = connected_components(found.select("node", "other")).select(F.col("node").alias("c"), "component")
    each = nodes.join(links, F.col("node") == F.col("n"), "left").join(grouped, F.col("node") == F.col("c"), "left").withColumn("component", F.coalesce("component", "node"))
    named = each.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id"))
    each = each.join(named, F.col("component") == F.col("of")).select(F.col("label").alias("l"), F.col("vec").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = part.join(each, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v"))).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
