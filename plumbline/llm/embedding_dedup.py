"""Near-duplicate embeddings by counting collisions on one-dimensional projections.

Unit vectors are projected on many random directions. Two vectors collide on a direction
if one lies in the window around the other. A pair with enough collisions is verified by
its cosine; window and count are set so that a pair exactly at the threshold passes with
the wanted recall (closer pairs more often).

At most ``groups - 1`` directions may fail, and the directions are dealt into so many
groups, so a pair that passes collides on every direction of at least one group. In each
group vectors are sorted by the first direction and cut into tiles; only tiles within one
window of each other are compared. A pair belongs to the first group in which it collides
everywhere, and in it to one pair of tiles, so links can be counted and added up without
ever being listed. Tiles return link counts and a spanning forest, in proportion to their
vectors, however dense they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.args import named_column
from plumbline.llm.common import connected_components, ship_package, written
from plumbline.llm.simhash_dedup import _merge as merge_labels

_SEED = 20240
_QUICK = 8
_STEPS = 250.0


def calibrated_window(threshold: float, projections: int, misses: int, recall: float) -> float:
    """Half width at which a pair at the threshold fails on more than ``misses`` directions
    with probability 1 - recall. The difference of two unit vectors' projections is normal
    with their distance as deviation."""
    distance = math.sqrt(2 - 2 * threshold)

    def lost(width: float) -> float:
        miss = math.erfc(width / distance / math.sqrt(2))
        kept = sum(
            math.comb(projections, k) * miss**k * (1 - miss) ** (projections - k)
            for k in range(misses + 1)
        )
        return 1 - kept

    low, high = 0.0, 10 * distance + 1e-6
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if lost(middle) > 1 - recall else (low, middle)
    return high


def _directions(size: int, projections: int) -> np.ndarray:
    return np.random.default_rng(_SEED + size).standard_normal((size, projections))


def _units(raw: list[bytes]) -> np.ndarray:
    vectors = np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), -1).astype(float)
    # Scaled by the largest component first, so that tiny and huge vectors keep their length.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class _Tile:
    def __init__(self, raw: list[bytes], weights: np.ndarray, first: int, directions: np.ndarray):
        units = _units(raw)
        places = units @ directions
        self.order = np.argsort(places[:, first], kind="stable")
        self.units, self.places = units[self.order], places[self.order]
        self.weights = weights[self.order]
        self.lead = self.places[:, first]
        # Steps of a byte that wraps around: a superset of the windows, checked later.
        quick = self.places[:, first : first + _QUICK]
        self.steps = np.ascontiguousarray(np.floor(quick * (_STEPS / 16)).astype(np.int64).astype(np.uint8).T)


def tile_links(
    left: _Tile, right: _Tile | None, group: int, groups: int, window: float, least: int,
    threshold: float, rows_at_once: int = 256,
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of every vector of left and right, and component labels (least row)."""
    other = left if right is None else right
    offset = 0 if right is None else left.lead.size
    size = offset + other.lead.size
    links, labels = np.zeros(size), np.arange(size)
    reach = int(math.ceil(window * _STEPS / 16)) + 1
    for a in range(0, left.lead.size, rows_at_once):
        b = min(a + rows_at_once, left.lead.size)
        low = np.searchsorted(other.lead, left.lead[a] - window, "left")
        high = np.searchsorted(other.lead, left.lead[b - 1] + window, "right")
        if right is None:
            low = max(low, a)
        if low >= high:
            continue
        near = np.ones((b - a, high - low), bool)
        if 2 * reach < 256:
            for mine, theirs in zip(left.steps, other.steps):
                gap = mine[a:b, None] - theirs[None, low:high] + np.uint8(reach)
                near &= gap <= np.uint8(2 * reach)
        i, j = np.nonzero(near)
        i, j = i + a, j + low
        if right is None:
            i, j = i[i < j], j[i < j]
        for start in range(0, i.size, 1 << 16):
            x, y = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
            hits = np.abs(left.places[x] - other.places[y]) <= window
            whole = hits.reshape(x.size, groups, -1).all(axis=2)
            mine = (hits.sum(axis=1) >= least) & whole[:, group] & ~whole[:, :group].any(axis=1)
            x, y = x[mine], y[mine]
            linked = np.einsum("ij,ij->i", left.units[x], other.units[y]) >= threshold
            x, y = x[linked], y[linked]
            links[:] += np.bincount(x, other.weights[y], size)
            links[:] += np.bincount(y + offset, left.weights[x], size)
            labels = merge_labels(labels, x, y + offset)
    return links, labels


def embedding_components(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    projections: int = 48,
    groups: int = 3,
    recall: float = 0.9999,
    tile_rows: int = 8192,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors of the same number of components are linked if their cosine, in double
    precision, is at least ``threshold``; every linked pair is verified, and a pair at the
    threshold is found with probability ``recall``. n_links counts the other rows linked
    directly, component_id is the least id reachable, and kept tells whether it is the
    row's own. Null, empty and zero vectors and those with null or non-finite components
    link with nothing. Equal vectors are one while links are looked for, so copies cost
    nothing; repeated rows stay rows. Null ids take part and name no component unless it
    has no other. An empty table gives no rows; other columns are not read. Runs jobs.

    The count passes with at most ``groups - 1`` of the projections missed. Tiles are
    compared pair by pair where their ranges are within a window of each other, so work
    grows with the square of the number of different vectors, by a small constant.
    """
    if projections % groups or projections // groups < _QUICK:
        raise ValueError(f"projections must be a multiple of groups, at least {_QUICK} in each")
    ship_package(vectors.sparkSession)
    per_group, least = projections // groups, projections - groups + 1
    window = calibrated_window(threshold, projections, groups - 1, recall)
    rows = vectors.select(
        named_column(id_col).alias("id"), named_column(vector_col).cast("array<float>").alias("vector")
    )
    rows = rows.withColumn(
        "valid",
        F.coalesce(
            F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vector", lambda x: x != 0),
            F.lit(False),
        ),
    )
    valid = rows.filter("valid").select("id", "vector")
    different = valid.groupBy("vector").agg(
        F.min("id").alias("least_id"), F.count(F.lit(1)).alias("rows")
    )
    leads = [f"lead_{g}" for g in range(groups)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            raw = [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            lead = np.zeros((len(raw), groups))
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                directions = _directions(int(size), projections)[:, ::per_group]
                lead[some] = _units([raw[r] for r in some]) @ directions
            yield pa.RecordBatch.from_arrays(
                [lists, batch.column("least_id"), batch.column("rows"), pa.array(raw, pa.binary()),
                 *[pa.array(lead[:, g]) for g in range(groups)]],
                ["vector", "least_id", "rows", "raw", *leads],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    lead_schema = ", ".join(f"{name} double" for name in leads)
    placed = written(
        different.mapInArrow(
            project,
            f"vector array<float>, least_id {id_type}, rows bigint, raw binary, {lead_schema}",
        ).withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    count = placed.count()
    tiles = max(1, -(-count // tile_rows))
    cuts = [n / tiles for n in range(1, tiles)]
    bounds = placed.approxQuantile(leads, cuts, 0.1 / tiles) if count and cuts else [[]] * groups
    copies = None
    for g in range(groups):
        inner = np.array(bounds[g])
        lower, upper = np.append(-np.inf, inner), np.append(inner, np.inf)
        # Tile n has leads in (lower[n], upper[n]]; partners are the tiles within a window.
        first = [int(np.searchsorted(upper, x - window, "left")) for x in lower]
        last = [int(np.searchsorted(lower, x + window, "right")) - 1 for x in upper]
        tile = F.size(F.filter(F.array(*map(F.lit, inner.tolist())).cast("array<double>"),
                               lambda x: x < F.col(leads[g])))
        near = F.sequence(
            F.get(F.array(*map(F.lit, first)), "tile"), F.get(F.array(*map(F.lit, last)), "tile")
        )
        some = placed.select("node", "raw", "rows", tile.alias("tile")).select(
            F.octet_length("raw").alias("bytes"), F.lit(g).alias("group"), "tile",
            F.explode(near).alias("with"), "node", "raw", "rows",
        )
        copies = some if copies is None else copies.unionByName(some)
    keyed = copies.select(
        "bytes", "group", F.least("tile", "with").alias("first"),
        F.greatest("tile", "with").alias("second"), (F.col("tile") > F.col("with")).alias("is_second"),
        "node", "raw", "rows",
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["group"].iloc[0])
        directions = _directions(int(pdf["bytes"].iloc[0]) // 4, projections)
        second = pdf["is_second"].to_numpy(bool)

        def tile(some: pd.DataFrame) -> _Tile:
            return _Tile(
                some["raw"].tolist(), some["rows"].to_numpy(float), group * per_group, directions
            )

        sides = [pdf[~second]] if pdf["first"].iloc[0] == pdf["second"].iloc[0] else [
            pdf[~second], pdf[second]
        ]
        if any(side.empty for side in sides):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        made = [tile(side) for side in sides]
        links, labels = tile_links(
            made[0], made[1] if len(made) > 1 else None, group, groups, window, least, threshold
        )
        nodes = np.concatenate([s["node"].to_numpy()[t.order] for s, t in zip(sides, made)])
        linked = np.flatnonzero(links > 0)
        return pd.DataFrame({
            "node": nodes[linked], "links": links[linked].astype(np.int64),
            "root": nodes[labels[linked]],
        })

    found = written(
        keyed.groupBy("bytes", "group", "first", "second").applyInPandas(
            compare, "node bigint, links bigint, root bigint"
        ),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = placed.select("node", "vector", "least_id", "rows").join(links, "node", "left").join(
        roots, "node", "left"
    )
    least_ids = (
        named.filter("component is not null").groupBy("component")
        .agg(F.min("least_id").alias("component_id"))
    )
    named = named.join(least_ids, "component", "left").select(
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"),
        F.coalesce("component_id", "least_id").alias("component_id"),
    )
    alone = rows.filter(~F.col("valid")).select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    return (
        valid.join(named, "vector").select("id", "n_links", "component_id").unionByName(alone)
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )
