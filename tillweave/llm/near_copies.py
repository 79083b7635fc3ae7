"""Near copies by the Jaccard similarity of their distinct word shingles.

MinHash bands over the distinct shingles propose, and so do SimHash fingerprints by the general pigeonhole of ``simhash``:
texts that either brings together fall in one loose group. What bands connect is named first, by at most one link for each
band and text, and fingerprints link different names only, so that links grow with the texts and not with the buckets that
a large group's members share. Inside a group the similarity of whole shingle sets decides
every link, by a search over members not yet reached, so no pair list is made. A group beyond ``CHUNK`` members is dealt
to tasks as pairs of chunks. Labels are formed from the verified links.

Sets are as large as the texts, so no table holds them: a text leaves its set's digest, fingerprint and bands, and only
the members of loose groups are fetched again, compressed, and made to sets where they are compared.

Shingles stand for themselves as 64-bit hashes. At a Jaccard similarity of 0.8 two sets are at an angle of 0.476, so
fingerprints of 256 bits differ in 39 bits on average, with a deviation of 6: three deviations more are allowed. The
pigeonhole part is the first 64 bits, where one pair in twenty differs in more than 14. Of the pairs at 0.8, 26 in a
million share no band (at 0.85, 4 in ten million); a pair is lost only if neither brings it together, and no pair below
the bound is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.llm.common import map_batches, materialize
from tillweave.llm.simhash import components, fingerprint, link_fingerprints, shingle_hashes

#: Bands of a text, and minima in a band.
BANDS, ROWS = 20, 4
#: 64-bit words of a fingerprint; bits in which the first word, and all words, of a proposed pair may differ.
WORDS, FIRST_BITS, ALL_BITS = 4, 14, 57
#: Members of one loose group that one task compares.
CHUNK = 1024
_DRAW = np.random.default_rng(11)
_ODD = _DRAW.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 2**63, BANDS * ROWS, np.uint64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(shingle_hashes(text, width))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit value of each band; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    low = np.empty(BANDS * ROWS, np.uint64)
    for k in range(BANDS * ROWS):
        mixed = (shingles ^ _ADD[k]) * _ODD[k]
        mixed ^= mixed >> np.uint64(32)
        low[k] = (mixed * _ODD[k]).min()
    raw = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(raw)], np.uint64).view(np.int64)


def _sketch(width: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, prints, sizes, found = [], [], [], []
        for text in batch.column(2):
            shingles = shingle_set(text.as_py(), width)
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            prints.append(fingerprint(shingles, WORDS).astype(">u8").tobytes())
            sizes.append(len(shingles))
            found.append(bands(shingles))
        arrays = [
            batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(prints, pa.binary()),
            pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["id", "slot", "key", "print", "size", "bands"])

    return work


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Compress the last column, a text."""
    pack = zstandard.ZstdCompressor(level=3).compress
    made = [None if (body := text.as_py()) is None else pack(body) for text in batch.column(batch.num_columns - 1)]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], batch.schema.names)


def links_of(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity reaches the bound."""
    sizes = np.array([len(s) for s in sets], np.int64)
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
    left = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        a = todo.pop()
        low, high = np.minimum(sizes[left], sizes[a]), np.maximum(sizes[left], sizes[a])
        maybe = left[low >= similarity * high]  # no two sets of other sizes can reach the bound
        if not len(maybe):
            continue
        own = numbers[starts[a] : starts[a] + sizes[a]]
        marked[own] = 1
        size = sizes[maybe]
        at = np.cumsum(size) - size
        index = np.repeat(starts[maybe] - at, size) + np.arange(int(size.sum()))
        shared = np.add.reduceat(marked[numbers[index]], at)
        marked[own] = 0
        near = maybe[shared >= similarity * (size + sizes[a] - shared) - 1e-9]
        if len(near):
            found = near.tolist()
            out += [(a, b) for b in found]
            todo += found
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _verify(width: int, similarity: float):
    """Rows (label, i, j, key, packed text) sorted by (label, i, j) to links (a, b); a group may go on in the next
    batch. Rows of one key are one set, and a text whose set has another key is not meant."""

    def links(texts: dict[bytes, bytes]) -> pa.RecordBatch | None:
        unpack = zstandard.ZstdDecompressor().decompress
        sets = {key: shingle_set(unpack(text), width) for key, text in texts.items()} if len(texts) > 1 else {}
        keys = [key for key, shingles in sets.items() if xxhash.xxh3_128_digest(shingles.tobytes()) == key]
        if len(keys) < 2:
            return None
        found = links_of([sets[key] for key in keys], similarity)
        columns = [pa.array([keys[x] for x, _ in found], pa.binary()), pa.array([keys[y] for _, y in found], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, texts = None, {}
        for batch in batches:
            for label, i, j, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, i, j) != mark:
                    out = links(texts)
                    if out is not None:
                        yield out
                    mark, texts = (label, i, j), {}
                texts.setdefault(key, text)
        out = links(texts)
        if out is not None:
            yield out

    return run


def near_copy_groups(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(id, component_id): one row per input row.

    Two texts link if the Jaccard similarity of their distinct ``width``-word shingles is at least ``similarity``;
    ``component_id`` is the smallest id reachable over links, the own one included. Null and empty texts and texts of
    white space have no shingles and are equal to each other. A text of fewer words than ``width`` is one shingle. Rows
    that repeat an id are all returned. A row without id takes part, but can't name a group. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("slot", F.xxhash64("text")).select("id", "slot", "text")
    columns = f"id {kind}, slot bigint, key binary, print binary, size int, bands array<bigint>"
    marked = map_batches(rows, lambda: _sketch(width), columns)
    marked = materialize(marked, "near-sketches")
    # Texts of one shingle set meet here, by partial aggregation; links are made between distinct sets only.
    sketch = [F.max(c).alias(c) for c in ("print", "size", "bands")]
    nodes = marked.groupBy("key").agg(F.min("id").alias("low_id"), *sketch, F.min(F.struct("slot", "id")).alias("at"))
    nodes = materialize(nodes, "near-nodes")
    filed = nodes.select("key", F.explode("bands").alias("band"))
    first = filed.groupBy("band").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the join is of two plain shuffles and a hot band can be split.
    first = materialize(first.select("band", "a"), "near-bands")
    banded = filed.join(first, "band").where(F.col("a") != F.col("key")).select("a", F.col("key").alias("b"))
    banded = components(banded, "near-banded").select(F.col("node").alias("key"), F.col("label").alias("name"))
    nodes = nodes.drop("bands").join(banded, "key", "left").withColumn("name", F.coalesce("name", "key"))
    nodes = materialize(nodes, "near-named")
    # Fingerprints are filed with the name of what bands connect behind them, so that they link different names only.
    prints = nodes.select(F.concat("print", "name").alias("key"), "size").distinct()
    alike = components(link_fingerprints(prints, FIRST_BITS, ALL_BITS, similarity, WORDS), "near-loose")
    alike = alike.withColumnRenamed("node", "name")
    loose = nodes.select(F.col("key").alias("node"), "name").join(alike, "name", "left")
    loose = materialize(loose.select("node", F.coalesce("label", "name").alias("label")), "near-placed")
    sizes = loose.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.select("label", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "near-sizes")
    placed = loose.join(sizes, "label")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks").cast("bigint")).cast("int"))
    wanted = placed.withColumnRenamed("node", "key").join(nodes.select("key", "at"), "key")
    wanted = wanted.select("key", "label", "chunks", "chunk", F.col("at.slot").alias("slot"), F.col("at.id").alias("at_id"))
    wanted = materialize(wanted, "near-wanted")
    # One text of each set in a loose group is fetched; the join is of shuffles at every size.
    packed = map_batches(rows, lambda: _packed, f"id {kind}, slot bigint, text binary").withColumnRenamed("slot", "text_slot")
    same = (F.col("text_slot") == F.col("slot")) & F.col("id").eqNullSafe(F.col("at_id"))
    texts = packed.join(wanted.hint("merge"), same).select("label", "chunks", "chunk", "key", "text")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "label", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "key", "text"
    )
    grouped = dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    links = grouped.mapInArrow(_verify(width, similarity), "a binary, b binary").distinct()
    labels = components(links, "near-labels")
    named = nodes.select("key", "low_id").join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("label", F.coalesce("label", "key"))
    lowest = named.groupBy("label").agg(F.min("low_id").alias("component_id"))
    groups = materialize(named.join(lowest, "label").select("key", "component_id"), "near-groups")
    return marked.select("id", "key").join(groups, "key", "left").select(F.col("id").alias(id_col), "component_id")


def one_per_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The documents that name their group: of near copies the one with the smallest id stays.

    Rows that repeat an id are one document and stay or go together. Rows without id go if their group has a
    row with id, and stay otherwise. All columns stay as they are.
    """
    groups = near_copy_groups(docs, id_col, text_col, width, similarity)
    own = "kept_id"
    while own in docs.columns:  # a name that the documents don't use
        own += "_"
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(own)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
