"""Sets of word shingles, by whose exact Jaccard likeness operator 3 confirms candidates.

Words are split at ASCII white space, and only A-Z change case; a text shorter than a shingle is one shingle; texts without a word, null
ones too, have the empty set. A shingle is its XXH64 hash; a node is the XXH64 hash of all hashes of a set, so texts with equal sets are
one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import in_slices
from .shared import trimming, written

#: Characters, or bytes of sets, held at once.
SLICE = 2_000_000
SEED = 42


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct unsigned 64-bit hashes of a text's shingles of words, sorted."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), [*accumulate([len(w) + 1 for w in words])]
    return np.unique(np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :] or ends[-1:], strict=False)], np.uint64))


def node_of(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def sets_of(named: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, own: the set's sorted hashes as bytes) of the named nodes and maybe some more. Texts come by the nodes' least doc_id (nodes: node,
    least), or have none."""
    ids = nodes.join(named, "node", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = keyed.join(ids, "doc_id", "left_semi").select("text").unionByName(keyed.where("doc_id is null").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, b in in_slices(own, SLICE):
                found = {node_of(s): s for s in (shingle_set(t, shingle) for t in own[a:b])}
                yield pa.record_batch([pa.array([*found], pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["node", "own"])

    return written(texts.mapInArrow(trimming(run), "node long, own binary").dropDuplicates(["node"]))
