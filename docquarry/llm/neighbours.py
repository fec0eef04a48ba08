"""Operator 7: near-duplicate vectors by NN-descent.

Equal vectors become one node that counts its copies. Each node keeps a list of its nearest neighbours so far. Lists start from blocks of
nodes that fall on the same sides of random planes; then each round joins neighbours of neighbours: all nodes near one pivot meet in
a block of bounded size, are compared there, and keep the best. A popular pivot has several blocks. A list whose last neighbour is still within the
threshold is saturated: such lists are doubled and refined by further rounds among their nodes, up to `most` neighbours. The edges of the
lists that pass the threshold in double precision are the links.

Nodes whose lists are saturated even then lie in dense groups. A link of theirs to any other node stands in that node's list, which is not
saturated; links of two such nodes are counted by tiles of dense nodes, pairs of tiles being skipped where their centres are further apart than
radii and threshold allow. Of a pair of tiles only counts and a star for each group leave a task.

Recall is audited: nodes drawn by hash from each class of degree are compared with all nodes of their label. While links of a class are found to less than
`goal`, further planes and rounds refine the lists, and after `tries` of that tiles of all nodes are compared, which misses nothing.

Defined cases: a vector that is null, empty, zero or holds null or non-finite numbers, or has a null label, links with nothing, as do
vectors of different lengths; equal vectors link with each other; vectors are scaled by their largest component before their norm is taken, so very large
and very small ones compare as any other; repeated ids are separate vectors, and a null vec_id gives no component id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_stars
from .shared import trimming, written

#: Lists compare in single precision; edges this close to the threshold are kept for the double-precision test.
MARGIN = 1e-5
#: Lower ends of the classes of degree that are audited.
CLASSES = (0, 1, 10, 80)


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    size: int = 10  # of a list
    most: int = 80  # neighbours of a doubled list
    block: int = 64  # nodes compared at once, or four lists
    tables: int = 8  # sets of random planes, each time
    rounds: int = 2  # joins of neighbours' neighbours, each time
    audited: int = 100  # nodes of a class of degree
    goal: float = 0.995  # share of an audited class's links that must be found
    tries: int = 2  # refinements before all tiles are compared
    tile: int = 512  # nodes of a tile, about
    seed: int = 0


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def by_width(e: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of the lists."""
    size = np.diff(e.offsets.to_numpy())
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        yield own, e.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, kind, e, copies, least, v): distinct usable vectors; kind is label and length, v the unit vector in single precision, as bytes."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    usable = vectors.where(F.col("label").isNotNull() & e.isNotNull()).where(F.size(e) > 0).where(finite)
    kinds = usable.select(F.concat_ws(":", F.col("label").cast("string"), F.size(e)).alias("kind"), e.cast("array<double>").alias("e"), F.col("vec_id").cast("long").alias("vec_id"))
    grouped = kinds.groupBy("kind", "e").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.empty(batch.num_rows, object)
            for own, v in by_width(batch.column("e")):
                packed[own] = [x.tobytes() for x in unit(v).astype(np.float32)]
            yield pa.record_batch([*batch.columns, pa.array(packed, pa.binary())], [*batch.schema.names, "v"])

    numbered = grouped.select(F.monotonically_increasing_id().alias("node"), "kind", "e", "copies", "least")
    return written(numbered.mapInArrow(run, "node long, kind string, e array<double>, copies long, least long, v binary"))


def packed_vectors(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(where each begins, all numbers) of packed vectors that lie one after another."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return (at - at[0]) // 4, np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float32)


def members(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The node numbers and vectors of each list of (node, v)."""
    at = column.offsets.to_numpy()
    inner = column.values
    ids, (ends, flat) = inner.field("node").to_numpy(), packed_vectors(inner.field("v"))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield ids[a:b], flat[ends[a] : ends[b]].reshape(b - a, -1)


def planes_codes(nodes: DataFrame, settings: Settings, bits: int = 30) -> DataFrame:
    """(node, kind, table, code): the sides of `bits` random planes on which a node lies, for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = packed_vectors(batch.column("v"))
            size = np.diff(ends)
            code = np.zeros((batch.num_rows, settings.tables), np.int64)
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                v = flat[ends[own][:, None] + np.arange(d)]
                planes = np.random.default_rng([settings.seed, d]).standard_normal((settings.tables * bits, d), np.float32)
                sides = (v @ planes.T > 0).reshape(len(own), settings.tables, bits)
                code[own] = (sides << np.arange(bits - 1, -1, -1)).sum(axis=2)
            part = batch.select(["node", "kind", "n"]).take(pa.array(np.repeat(np.arange(batch.num_rows), settings.tables)))
            yield pa.record_batch([*part.columns, pa.array(np.tile(np.arange(settings.tables), batch.num_rows)), pa.array(code.reshape(-1))], ["node", "kind", "n", "table", "code"])

    sized = nodes.select("node", "kind", "v").join(nodes.groupBy("kind").agg(F.count("*").alias("n")), "kind")  # AQE splits a kind with many nodes
    coded = sized.select("node", "kind", "v", "n").mapInArrow(run, "node long, kind string, n long, table long, code long")
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (settings.block / 2)))).cast("int")
    return coded.withColumn("code", F.call_function("shiftright", F.col("code"), (F.lit(bits) - F.least(depth, F.lit(bits))).cast("int"))).drop("n")


def in_blocks(rows: DataFrame, keys: list[str], nodes: DataFrame, settings: Settings) -> DataFrame:
    """(block: list of (node, v)): rows (keys, node) grouped by keys; larger groups are dealt by hash into blocks of bounded size."""
    rows = written(rows)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    parts = F.ceil(F.col("n") / max(settings.block, 4 * settings.size))
    dealt = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(F.lit(settings.seed), "node", *keys), parts))
    laid = dealt.select("node", *keys, "part").join(nodes.select("node", "v"), "node")
    return laid.groupBy(*keys, "part").agg(F.collect_list(F.struct("node", "v")).alias("block")).select("block")


def compare(blocks: DataFrame, settings: Settings) -> DataFrame:
    """(node, near: list of (sim, other)): the nearest others of each node in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for ids, v in members(batch.column(0)):
                ids, first = np.unique(ids, return_index=True)
                k = min(settings.size, len(ids) - 1)
                if k < 1:
                    continue
                sim = v[first] @ v[first].T
                np.fill_diagonal(sim, -2)
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                for column, value in zip(out, (ids, np.full(len(ids), k), np.take_along_axis(sim, best, axis=1).reshape(-1), ids[best].reshape(-1)), strict=True):
                    column.append(value)
            if out[0]:
                ids, ks, sims, others = map(np.concatenate, out)
                near = pa.StructArray.from_arrays([pa.array(sims, pa.float32()), pa.array(others)], ["sim", "other"])
                yield pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ks)), pa.int32()), near)], ["node", "near"])

    return blocks.mapInArrow(trimming(run), "node long, near array<struct<sim: float, other: long>>")


def best_lists(found: DataFrame, settings: Settings) -> DataFrame:
    """(node, near): the best of all that was found for a node, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(near.offsets.to_numpy()))
            flat = near.flatten()
            sim, other = flat.field("sim").to_numpy(), flat.field("other").to_numpy()
            order = np.lexsort((-sim, other, row))  # of one neighbour found again and again the first
            row, sim, other = row[order], sim[order], other[order]
            new = np.append(True, (row[1:] != row[:-1]) | (other[1:] != other[:-1]))[: len(row)]
            row, sim, other = row[new], sim[new], other[new]
            order = np.lexsort((other, -sim, row))
            row, sim, other = row[order], sim[order], other[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < settings.size
            ends = np.searchsorted(row[kept], np.arange(batch.num_rows + 1)).astype(np.int32)
            best = pa.StructArray.from_arrays([pa.array(sim[kept]), pa.array(other[kept])], ["sim", "other"])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), best)], ["node", "near"])

    gathered = found.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near"))
    return gathered.mapInArrow(trimming(run), "node long, near array<struct<sim: float, other: long>>")


def refined(nodes: DataFrame, lists: DataFrame, settings: Settings) -> DataFrame:
    """The lists after rounds that join neighbours of neighbours."""
    for k in range(settings.rounds):
        flat = lists.select("node", F.explode("near.other").alias("other"))
        both = flat.unionByName(flat.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
        around = both.withColumnsRenamed({"node": "pivot", "other": "node"})
        found = compare(in_blocks(around, ["pivot"], nodes, replace(settings, seed=settings.seed + k)), settings)
        lists = written(best_lists(found.unionByName(lists), settings))
    return lists


def descend(nodes: DataFrame, known: DataFrame | None, settings: Settings) -> DataFrame:
    """Lists from fresh planes (and known ones), after the rounds."""
    found = compare(in_blocks(planes_codes(nodes, settings), ["kind", "table", "code"], nodes, settings), settings)
    return refined(nodes, written(best_lists(found if known is None else found.unionByName(known), settings)), settings)


def saturated(lists: DataFrame, settings: Settings) -> DataFrame:
    return lists.where(F.size("near") >= settings.size).where(F.element_at("near", -1)["sim"] >= settings.threshold - MARGIN)


def enlarged(nodes: DataFrame, lists: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(lists, those of dense nodes): saturated lists are doubled until they hold a neighbour beyond the threshold, or `most`."""
    settled = None
    while True:
        full = written(saturated(lists, settings))
        done = lists.join(full.select("node"), "node", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if 2 * settings.size > settings.most or full.isEmpty():
            return settled.unionByName(full), full
        settings = replace(settings, size=2 * settings.size, seed=settings.seed + 100)
        # lists of others take part in the rounds as they are found from the full ones, but only the full ones are kept
        lists = written(refined(nodes, full, settings).join(full.select("node"), "node", "left_semi"))


def exact_edges(nodes: DataFrame, lists: DataFrame, settings: Settings) -> DataFrame:
    """(a, b), a < b: edges of the lists that are links in double precision."""
    flat = lists.select("node", F.explode("near").alias("x")).where(F.col("x.sim") >= settings.threshold - MARGIN)
    edges = flat.select(F.least("node", "x.other").alias("a"), F.greatest("node", "x.other").alias("b")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for (own, u), (_, v) in zip(by_width(batch.column(2)), by_width(batch.column(3)), strict=True):
                keep[own] = (unit(u) * unit(v)).sum(axis=1) >= settings.threshold
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    ends = lambda x: nodes.select(F.col("node").alias(x), F.col("e").alias(f"e_{x}"))
    return written(edges.join(ends("a"), "a").join(ends("b"), "b").select("a", "b", "e_a", "e_b").mapInArrow(run, "a long, b long"))


def apart(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the angle between the centres of unit vectors a and b rules out a link of the two."""
    centres = [x.mean(axis=0) for x in (a, b)]
    if not all(np.linalg.norm(c) > 1e-9 for c in centres):
        return False
    centres = [c / np.linalg.norm(c) for c in centres]
    angle = lambda x: float(np.arccos(np.clip(x, -1, 1)))
    return angle(centres[0] @ centres[1]) > angle((a @ centres[0]).min()) + angle((b @ centres[1]).min()) + angle(threshold) + 1e-6


def tiled(placed: DataFrame, settings: Settings) -> DataFrame:
    """(node, n: links of the node, counted with copies, or 0; other: a node of its group, or null), all links of two of the placed nodes (node, kind,
    group, e, copies) of a kind. Nodes of a group share tiles; a grid of lanes that follows the number of tiles spreads their pairs over tasks."""
    sizes = placed.groupBy("kind", "group").agg(F.ceil(F.count("*") / settings.tile).alias("parts"))
    dealt = placed.join(sizes, ["kind", "group"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    tiles = dealt.groupBy("kind", "group", "part").agg(F.collect_list("node").alias("own"), F.flatten(F.collect_list("e")).alias("e"), F.collect_list("copies").alias("copies"))
    tiles = written(tiles.withColumn("tile", F.monotonically_increasing_id()))
    grids = tiles.groupBy("kind").agg(F.ceil(F.count("*") / 8).alias("grid"))
    laned = tiles.join(grids, "kind").withColumn("lane", F.pmod(F.xxhash64("tile"), F.col("grid")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid") - 1))
    side = lambda x, mine, other: laned.select("kind", F.col("lane").alias(mine), every.alias(other), F.struct("tile", "own", "e", "copies").alias(x))
    pairs = side("a", "row", "column").join(side("b", "column", "row"), ["kind", "row", "column"]).where("a.tile <= b.tile").select("a", "b")

    def sides(column: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        for x in range(len(column)):
            tile, own, e, copies = (column.field(k)[x] for k in range(4))
            own = own.values.to_numpy()
            yield own, unit(e.values.to_numpy(zero_copy_only=False).reshape(len(own), -1)), copies.values.to_numpy(), tile.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (a, va, ca, ta), (b, vb, cb, tb) in zip(sides(batch.column(0)), sides(batch.column(1)), strict=True):
                same = ta == tb
                if not same and apart(va, vb, settings.threshold):
                    continue
                near = va @ vb.T >= settings.threshold
                if same:
                    np.fill_diagonal(near, False)
                u, v = np.nonzero(np.triu(near) if same else near)
                if not len(u):
                    continue
                both = a if same else np.concatenate([a, b])
                u, v = local_stars(len(both), u, v if same else v + len(a))
                counts = near @ cb if same else np.concatenate([near @ cb, near.T @ ca])
                for node, n, other in ((both, counts, None), (both[u], np.zeros(len(u), np.int64), both[v])):
                    yield pa.record_batch([pa.array(node), pa.array(n.astype(np.int64)), pa.nulls(len(node), pa.int64()) if other is None else pa.array(other)], ["node", "n", "other"])

    return written(pairs.mapInArrow(trimming(run), "node long, n long, other long"))


def from_tiles(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges a, b; node and n_links) of `tiled`."""
    return found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n_links"))


def graph_links(nodes: DataFrame, lists: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(node, component) of linked nodes and (node, n_links), links to copies of other nodes counted each, from the lists."""
    every, full = enlarged(nodes, lists, settings)
    edges = exact_edges(nodes, every, settings)
    component = written(connected_components(edges))
    copies = lambda ones: ones.unionByName(ones.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("n_links"))
    if full.isEmpty():
        return component, written(copies(edges))
    dense = full.select("node")
    of_two = edges.join(dense.withColumnRenamed("node", "a"), "a", "left_semi").join(dense.withColumnRenamed("node", "b"), "b", "left_semi")
    placed = nodes.join(dense, "node", "left_semi").join(component.select("node", F.col("component").alias("group")), "node", "left").withColumn("group", F.coalesce("group", F.lit(-1)))
    tile_edges, tile_counts = from_tiles(tiled(placed, settings))
    counted = copies(edges.join(of_two, ["a", "b"], "left_anti")).unionByName(tile_counts).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return written(connected_components(edges.unionByName(tile_edges))), written(counted)


def recall_by_degree(nodes: DataFrame, counted: DataFrame, settings: Settings) -> dict[int, tuple[int, int]]:
    """For each class of degree: links found of nodes drawn by hash, and their links among all nodes of their kind."""
    spark = nodes.sparkSession
    n = F.coalesce("n_links", F.lit(0))
    known = nodes.select("node", "kind", "e").join(counted, "node", "left").withColumn("n_links", n)
    rows = []
    for low, high in zip(CLASSES, [*CLASSES[1:], None], strict=True):
        own = known.where((F.col("n_links") >= low) & (F.lit(True) if high is None else F.col("n_links") < high))
        rows += own.orderBy(F.xxhash64(F.lit(settings.seed), "node"), "node").limit(settings.audited).collect()
    if not rows:
        return {}
    by_kind: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        by_kind.setdefault(r["kind"], []).append(k)
    drawn = {kind: (np.array(own), np.array([rows[k]["node"] for k in own]), unit(np.array([rows[k]["e"] for k in own]))) for kind, own in by_kind.items()}
    sent = spark.sparkContext.broadcast(drawn)  # `audited` vectors of each class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(len(x[0]) for x in sent.value.values()), np.int64)
        for batch in batches:
            kinds, ids, copies = np.array(batch.column(1).to_pylist()), batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for kind in set(kinds.tolist()) & sent.value.keys():
                own = np.flatnonzero(kinds == kind)
                at, drawn_ids, v = sent.value[kind]
                e = batch.column(2).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                near = (v @ unit(e).T >= settings.threshold) & (drawn_ids[:, None] != ids[own])
                total[at] += near @ copies[own]
        yield pa.record_batch([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["k", "n"])

    there = dict(nodes.select("node", "kind", "e", "copies").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect())
    out: dict[int, tuple[int, int]] = {}
    for k, r in enumerate(rows):
        low = max(c for c in CLASSES if c <= r["n_links"])
        found, true = out.get(low, (0, 0))
        out[low] = found + r["n_links"], true + max(there.get(k, 0), r["n_links"])
    return out


def all_links(nodes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """As graph_links, from tiles of all nodes."""
    edges, counted = from_tiles(tiled(nodes.select("node", "kind", F.lit(0).alias("group"), "e", "copies"), settings))
    return written(connected_components(edges)), counted


def audited_links(nodes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, list[dict[int, tuple[int, int]]]]:
    """(components, counts of links, the audits): lists are refined until each class of degree has its recall; if that fails, all tiles are compared."""
    audits: list[dict[int, tuple[int, int]]] = []
    lists = None
    for k in range(settings.tries + 1):
        own = replace(settings, seed=settings.seed + 1000 * k)
        lists = descend(nodes, lists, own)
        group, counted = graph_links(nodes, lists, own)
        audits.append(recall_by_degree(nodes, counted, own))
        if all(found >= settings.goal * there for found, there in audits[-1].values()):
            return group, counted, audits
    return *all_links(nodes, settings), audits


def near_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, label, embedding)."""
    nodes = nodes_of(vectors)
    group, counted, _ = audited_links(nodes, settings)
    rooted = nodes.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "component").join(counted, "node", "left")
    known = known.select("kind", "e", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    e = F.col("embedding")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.concat_ws(":", F.col("label").cast("string"), F.size(e)).alias("kind"), e.cast("array<double>").alias("e"), F.col("label").isNotNull().alias("labelled"))
    joined = own.where("labelled").join(known, ["kind", "e"], "left").unionByName(own.where("NOT labelled"), allowMissingColumns=True)
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
