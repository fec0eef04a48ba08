"""Operator 3: SimHash near-duplicates by tiled exact comparison.

Each document gets a 64-bit fingerprint: the majority of each bit over the XXH64 hashes of its word shingles. Distinct fingerprints
are laid into tiles by the population counts of their four 16-bit words. Two fingerprints differ in at least as many bits as these
counts differ in sum, so only tiles whose counts differ by at most the radius are paired; all others are skipped unseen. In a pair,
numpy compares all fingerprints by exclusive-or and bit counts, and hands on at most a star for each group it finds, not all its links.
A crowded cell of equal counts is split into several tiles by hash, and all pairs of these tiles are compared, by many tasks.

`without_near_copies` takes such fingerprints, of 512 bits and of distinct shingles, as a filter with a wide radius. Counts rarely differ
by so much, so there the cells are those of set sizes (texts of too different sizes can't be alike), tiles hold neighbouring population
counts, and pairs of tiles whose counts differ beyond the radius are skipped. Its stars make candidate groups; inside each, candidate
pairs that aren't connected yet are confirmed by the exact Jaccard likeness of the whole texts, again by pairs of tiles.

Defined cases: a null text is the empty text; texts without a word have the fingerprint zero and are linked like any others; equal
texts share a fingerprint; a row without doc_id joins a component but gives it no id; repeated rows are each returned; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, local_stars
from .encode import in_slices
from .likeness import SLICE, node_of, sets_of, shingle_set
from .shared import trimming, written

#: Fingerprints in a tile, about; rows of a tile compared at once.
TILE, STRIP = 2048, 256
#: Tiles of a cell that a key of the join of tiles holds at most.
LANE = 16
#: Bytes of the sets in a tile of a candidate group, about.
TILE_BYTES = 4_000_000
#: Bits of a word and of its count in a cell number.
WORD, FIELD = 16, 5


def fingerprints(texts: list[str | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    count = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
        if words:
            joined, ends = b" ".join(words), [*accumulate([len(w) + 1 for w in words])]
            starts = [0, *ends]
            own = [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:], strict=False)]
            count[k] = len(own)
            hashes += own
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        first = (np.cumsum(count) - count)[full]
        out[full] = majority(np.array(hashes, np.uint64), first, count[full])
    return out


def majority(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each run of hashes, which begins at first and has count (over 0) of them, the bits that are set in over half."""
    # bytes of ones and zeros, summed eight at a time; at most 255 rows at once, so that no byte overflows
    ones = np.unpackbits(hashes.view(np.uint8)).view(np.uint64).reshape(-1, 8)
    runs = -(-count // 255)
    base = np.cumsum(runs) - runs
    inner = np.arange(int(runs.sum())) - np.repeat(base, runs)
    sums = np.add.reduceat(ones, np.repeat(first, runs) + 255 * inner, axis=0).view(np.uint8).astype(np.int64)
    total = np.add.reduceat(sums, base, axis=0)
    return np.packbits(2 * total > count[:, None], axis=1).view(np.uint64)[:, 0]


def with_fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id long, print long): the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_slices(texts, 2_000_000):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(fingerprints(texts[a:b], shingle, seed).view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimming(run), "doc_id long, print long")


def links_of_pair(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the linked fingerprints of two tiles (or of one, if same)."""
    both, us, vs, held = (a if same else np.concatenate([a, b])), [], [], 0
    shift = 0 if same else len(a)
    for s in range(0, len(a), STRIP):
        near = np.bitwise_count(a[s : s + STRIP, None] ^ b[None, :]) <= radius
        u, v = np.nonzero(near)
        u, v = u + s, v + shift
        if same:
            u, v = u[v > u], v[v > u]
        us.append(u)
        vs.append(v)
        held += len(u)
        if held > 4 * len(both):
            u, v = local_stars(len(both), np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)
    if not held:
        return both[:0], both[:0]
    u, v = local_stars(len(both), np.concatenate(us), np.concatenate(vs))
    return both[u], both[v]


def near_offsets(radius: int) -> list[int]:
    """Sums to a cell number that lead to each cell whose counts differ by at most radius in sum; one of each two directions."""
    steps = [x for x in product(range(-radius, radius + 1), repeat=64 // WORD) if sum(map(abs, x)) <= radius and x >= (0,) * len(x)]
    return [sum(d << FIELD * k for k, d in enumerate(x)) for x in steps]


def pairs_of_tiles(tiles: DataFrame, sizes: DataFrame, steps: list[int]) -> DataFrame:
    """(own_a, own_b, same): each tile (cell, part, own) with each tile of the cells that the steps lead to. sizes: (cell, parts). Tiles of a
    crowded cell meet others under several keys, at most LANE of them under one."""
    to = F.explode(F.array(*[F.lit(x).cast("long") for x in steps]))
    left = tiles.select("cell", F.col("part").alias("part_a"), F.col("own").alias("own_a"), to.alias("step")).withColumn("cell_b", F.col("cell") + F.col("step")).drop("cell")
    lanes = sizes.select(F.col("cell").alias("cell_b"), F.ceil(F.col("parts") / LANE).cast("long").alias("lanes"))
    left = left.join(lanes, "cell_b").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)))
    right = tiles.select(F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), F.col("own").alias("own_b"), F.expr(f"part div {LANE}").alias("lane"))
    met = left.join(right, ["cell_b", "lane"]).where("step <> 0 or part_a <= part_b")
    return met.select("own_a", "own_b", F.expr("step = 0 and part_a = part_b").alias("same"))


def linked_prints(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a long, b long) that connect distinct fingerprints (print long) exactly as all links within radius do."""
    count = lambda k: F.bit_count(F.shiftrightunsigned("print", WORD * k).bitwiseAND((1 << WORD) - 1)).cast("long")
    cell = sum((F.shiftleft(count(k), FIELD * k) for k in range(1, 64 // WORD)), count(0))
    placed = prints.select("print", cell.alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))  # at most 17 ** 4 rows, whatever the input
    part = F.pmod(F.xxhash64("print"), F.col("parts"))
    tiles = placed.join(F.broadcast(sizes), "cell").groupBy("cell", part.alias("part")).agg(F.collect_list("print").alias("own"))
    pairs = pairs_of_tiles(written(tiles), F.broadcast(sizes), near_offsets(radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for k in (0, 1):
                column = batch.column(k)
                at = column.offsets.to_numpy()
                values = column.values.to_numpy().view(np.uint64)
                sides.append([values[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            found = [links_of_pair(a, b, same, radius) for a, b, same in zip(*sides, batch.column(2).to_pylist(), strict=True)]
            if found := [x for x in found if len(x[0])]:
                yield pa.record_batch([pa.array(np.concatenate([x[k] for x in found]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint of 16 hex digits, component_id: the smallest doc_id reachable by links)."""
    own = written(with_fingerprints(docs, shingle))
    prints = written(own.groupBy("print").agg(F.min("doc_id").alias("least")))
    groups = connected_components(linked_prints(prints, radius))
    rooted = prints.join(groups.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = rooted.select("print", "component").join(least, "component").select("print", "component_id")
    return own.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class NearCopies:
    """Texts are near copies if their sets of word shingles have a Jaccard likeness of `likeness` (a fraction) or more. Radii of the filter: bits
    in which the first 64 bits, and all 512, may differ. Sets at the likeness of 4/5 differ in about 9.7 and 77.6 of them, with
    deviations of 2.9 and 8.1, so the radii find about 995 of 1000 pairs at the very threshold, and nearly all beyond it. Of very small
    sets each shingle moves more bits: there the radii are wider."""

    shingle: int = 5
    likeness: tuple[int, int] = (4, 5)
    radius: int = 17
    wide_radius: int = 100
    small: int = 8  # shingles; below, radii grow by the next two numbers
    more: int = 6
    wide_more: int = 50
    steps: int = 4  # cells of set sizes for one likeness


PRINT = [f"w{k}" for k in range(8)]


def with_set_prints(docs: DataFrame, settings: NearCopies) -> DataFrame:
    """(doc_id, digest: hash of the text, node, n: shingles, 512 bits in eight columns) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in in_slices(texts, SLICE):
                sets = [shingle_set(t, settings.shingle) for t in texts[a:b]]
                n = np.array([len(s) for s in sets], np.int64)
                words = np.zeros((len(PRINT), len(sets)), np.uint64)
                if len(full := np.flatnonzero(n)):
                    h = np.concatenate(sets)
                    for k in range(len(PRINT)):
                        words[k, full] = majority(h, (np.cumsum(n) - n)[full], n[full])
                        with np.errstate(over="ignore"):  # the next hash of each shingle
                            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                            h ^= h >> np.uint64(31)
                columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array(n), *[pa.array(x.view(np.int64)) for x in words]]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], ["doc_id", "digest", "node", "n", *PRINT])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return asked.mapInArrow(trimming(run), "doc_id long, digest long, node long, n long, " + ", ".join(f"{w} long" for w in PRINT))


@dataclass
class Tile:
    """Nodes with their set sizes and fingerprints."""

    node: np.ndarray
    n: np.ndarray
    words: list[np.ndarray]

    def near(self, other: Tile, same: bool, settings: NearCopies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in both tiles of pairs within the radii and of sizes that may be alike, and the bits in which they differ."""
        small = min(self.n.min(), other.n.min()) < settings.small
        radius = settings.radius + settings.more * small
        ones = [np.bitwise_count(x.words[0]).astype(np.int64) for x in (self, other)]
        none = np.zeros(0, np.int64)
        if ones[0].min() - ones[1].max() > radius or ones[1].min() - ones[0].max() > radius:
            return none, none, none
        top, bottom = settings.likeness
        found = []
        for s in range(0, len(self.n), STRIP):
            u, v = np.nonzero(np.bitwise_count(self.words[0][s : s + STRIP, None] ^ other.words[0][None, :]) <= radius)
            u += s
            least = np.minimum(self.n[u], other.n[v])
            apart = sum(np.bitwise_count(x[u] ^ y[v]).astype(np.int64) for x, y in zip(self.words, other.words, strict=True))
            kept = (apart <= settings.wide_radius + settings.wide_more * (least < settings.small)) & (bottom * least >= top * np.maximum(self.n[u], other.n[v]))
            if same:
                kept &= v > u
            found.append((u[kept], v[kept], apart[kept]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def read_tiles(column: pa.Array) -> Iterator[tuple[Tile, list[np.ndarray] | None]]:
    """Tiles of list<struct<node, n, words[, own]>>, with the sets of their nodes if there are any."""
    inner, at = column.values, column.offsets.to_numpy().tolist()
    field = lambda c: inner.field(c).to_numpy()
    node, n, words = field("node"), field("n"), [field(w).view(np.uint64) for w in PRINT]
    own = inner.field("own") if inner.type.get_field_index("own") >= 0 else None
    for x, y in zip(at[:-1], at[1:], strict=True):
        sets = None if own is None else [np.frombuffer(own[k].as_buffer(), np.uint64) for k in range(x, y)]
        yield Tile(node[x:y], n[x:y], [w[x:y] for w in words]), sets


def candidate_stars(nodes: DataFrame, settings: NearCopies) -> DataFrame:
    """Edges (a, b) that connect nodes (node, n, prints) exactly as all pairs within the radii do. A cell is a range of set sizes; its tiles follow
    population counts."""
    top, bottom = settings.likeness
    width = math.log(bottom / top) / settings.steps * (1 + 1e-9)
    placed = nodes.where("n > 0").select("node", "n", *PRINT, F.floor(F.log("n") / width).cast("long").alias("cell"), F.bit_count(PRINT[0]).alias("ones"))
    counts = placed.groupBy("cell", "ones").agg(F.count("*").alias("held"))  # at most 65 rows a cell, some hundred cells
    counts = counts.withColumn("before", F.sum("held").over(Window.partitionBy("cell").orderBy("ones")) - F.col("held"))
    dealt = placed.join(F.broadcast(counts), ["cell", "ones"]).withColumn("part", F.expr(f"(before + pmod(xxhash64(node), held)) div {TILE}"))
    tiles = written(dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("node", "n", *PRINT)).alias("own")))
    sizes = counts.groupBy("cell").agg(F.expr(f"(sum(held) - 1) div {TILE} + 1").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (a, _), (b, _), same in zip(read_tiles(batch.column(0)), read_tiles(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                u, v, _ = a.near(b, same, settings)
                if len(u):
                    both = a.node if same else np.concatenate([a.node, b.node])
                    u, v = local_stars(len(both), u, v if same else v + len(a.node))
                    yield pa.record_batch([pa.array(both[u]), pa.array(both[v])], ["a", "b"])

    return pairs_of_tiles(tiles, F.broadcast(sizes), [*range(settings.steps + 1)]).mapInArrow(run, "a long, b long")


def confirmed_links(groups: DataFrame, nodes: DataFrame, docs: DataFrame, settings: NearCopies) -> DataFrame:
    """Edges (a, b) that connect nodes exactly as all candidate pairs with the asked likeness do. groups: (node, component) of candidates."""
    top, bottom = settings.likeness
    sets = sets_of(groups, nodes, docs, settings.shingle)
    placed = sets.join(groups, "node").join(nodes.select("node", "n", *PRINT), "node").withColumnRenamed("component", "cell")
    sizes = written(placed.groupBy("cell").agg(F.sum("n").alias("all")).select("cell", F.expr(f"(all * 8 - 1) div {TILE_BYTES} + 1").alias("parts")))
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    tiles = written(dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("node", "n", *PRINT, "own")).alias("own")))

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.concatenate([x, y])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return bottom * shared >= top * (len(both) - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (a, x), (b, y), same in zip(read_tiles(batch.column(0)), read_tiles(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                u, v, apart = a.near(b, same, settings)
                root = list(range(len(a.node) + (0 if same else len(b.node))))

                def find(k: int) -> int:
                    while root[k] != k:
                        root[k] = root[root[k]]
                        k = root[k]
                    return k

                links: list[tuple[int, int]] = []
                for k in np.argsort(apart, kind="stable").tolist():  # the likeliest first: more pairs are connected by then
                    i, j = int(u[k]), int(v[k])
                    r, t = find(i), find(j if same else j + len(a.node))
                    if r != t and alike(x[i], y[j]):
                        root[r] = t
                        links.append((int(a.node[i]), int(b.node[j])))
                if links:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return pairs_of_tiles(tiles, sizes, [0]).mapInArrow(trimming(run), "a long, b long")


def near_copy_groups(docs: DataFrame, settings: NearCopies = NearCopies()) -> DataFrame:
    """(doc_id, digest, component): the rows of docs with the group of near copies that each is in."""
    own = written(with_set_prints(docs, settings))
    nodes = written(own.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", *PRINT)]))
    candidates = written(connected_components(candidate_stars(nodes, settings)))
    groups = connected_components(confirmed_links(candidates, nodes, docs, settings))
    return own.select("doc_id", "digest", "node").join(groups, "node", "left").select("doc_id", "digest", F.coalesce("component", "node").alias("component"))


def without_near_copies(docs: DataFrame, settings: NearCopies = NearCopies()) -> DataFrame:
    """The rows of docs, one of each group of near copies: the one with the smallest doc_id (of texts with that id, the one with the least
    hash; a row without doc_id only where no row has one). Rows with one doc_id and unlike texts are different documents: each
    stays, if no near copy has a smaller id."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    kept = near_copy_groups(docs, settings).groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.digest").alias("__kept"))
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__own"), F.xxhash64("text").alias("__digest"))
    met = rows.join(kept, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept")), "left_semi")
    return met.dropDuplicates(["__own", "__digest"]).select("__row.*")
