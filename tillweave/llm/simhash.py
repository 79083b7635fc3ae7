"""SimHash near-dedup with the general pigeonhole principle.

Fingerprints are cut into partitions of correlated bits. With a threshold t_i per partition and
sum(t_i + 1) = max_bits + 1, two fingerprints that differ in at most max_bits bits differ in at most
t_i bits of some partition i: otherwise they would differ in max_bits + 1. Thresholds are unequal and
come from dynamic programming over estimated candidate counts; -1 leaves a partition out. Every
fingerprint is filed under its value of each partition and probes the values within t_i bits; candidates
in one bucket are verified on the whole fingerprint.

No pair list is made: in a bucket a search over unvisited members gives a spanning forest, which is all
that connectivity needs, as links from the smallest name of each tree, which buckets of the same members
share. Members of one name count as connected. A bucket beyond ``CHUNK`` members is dealt to tasks as pairs of chunks, so all its
pairs are still compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.llm.common import hash_order_sample, map_batches, materialize

_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())

#: Distinct fingerprints drawn for the estimates of correlation and candidate counts.
SAMPLE_ROWS = 4000
#: Members of one bucket that one task compares.
CHUNK = 4096
#: Cost of one probe row, shuffled and sorted, against one candidate pair, compared in numpy.
PROBE_COST = 2000.0
#: One in so many fingerprints is taken to tell which buckets are large.
BUCKET_SAMPLE = 16
#: Odd multiples of this turn one 64-bit hash into further ones.
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle, repeats included; fewer words: the whole sequence."""
    words = (text or b"").translate(_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(body, 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(body[s:e], 42) for s, e in zip(starts, ends[width - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` x 64 bits; a bit is 1 if it is set in over half of the hashes. No hashes: zero."""
    out = np.zeros(words, np.uint64)
    for k in range(words):
        mixed = hashes
        if k:
            mixed = hashes * np.uint64(_GOLDEN * (2 * k + 1) % 2**64)
            mixed = mixed ^ (mixed >> np.uint64(29))
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            mixed = mixed ^ (mixed >> np.uint64(32))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 65536):
            part = np.ascontiguousarray(mixed[at : at + 65536]).view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = (2 * counts > len(hashes)).astype(np.uint8)
        out[k] = np.packbits(bits, bitorder="little").view(np.uint64)[0]
    return out


def _sketch(width: int, words: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes = [], []
        for text in batch.column(1):
            hashes = shingle_hashes(text.as_py(), width)
            keys.append(fingerprint(hashes, words).astype(">u8").tobytes())
            sizes.append(len(hashes))
        arrays = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["id", "key", "size"])

    return work


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, words: int) -> DataFrame:
    """(id, key, size): fingerprint as big-endian bytes and number of shingles of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(rows, lambda: _sketch(width, words), f"id {kind}, key binary, size int")


# Partitions and thresholds


@dataclass(frozen=True)
class Layout:
    """Bit positions (0 is the lowest) of each partition and its threshold; -1: not used."""

    parts: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]

    def used(self) -> list[tuple[int, tuple[int, ...], int]]:
        return [(i, bits, t) for i, (bits, t) in enumerate(zip(self.parts, self.limits)) if t >= 0]


def correlated_parts(bits: np.ndarray, count: int) -> tuple[tuple[int, ...], ...]:
    """Group the 64 columns of a 0/1 matrix into ``count`` parts of near-equal width, most correlated together."""
    if len(bits) > 1:
        centred = bits - bits.mean(0)
        spread = centred.std(0)
        corr = np.abs(centred.T @ centred / len(bits)) / np.maximum(np.outer(spread, spread), 1e-9)
    else:
        corr = np.zeros((64, 64))
    left, parts = set(range(64)), []
    for k in range(count):
        width = 64 // count + (k < 64 % count)
        start = max(left, key=lambda b: (sum(corr[b, o] for o in left) if len(left) > 1 else 0, -b))
        part = [start]
        left.discard(start)
        while len(part) < width:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.discard(best)
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def extract(values: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The given bits of each value, packed in order."""
    out = np.zeros(len(values), np.uint64)
    for to, at in enumerate(bits):
        out |= ((values >> np.uint64(at)) & np.uint64(1)) << np.uint64(to)
    return out


def _costs(sample: np.ndarray, part: tuple[int, ...], max_bits: int, rows: int, share: float) -> list[float]:
    """Estimated cost per fingerprint of threshold -1, 0, 1, ... of one partition.

    Candidates are ``rows`` times the share of sample pairs that close in this partition, but no less than
    for even values: a small sample can't see rare meetings.
    """
    values = extract(sample[:2000], part)
    half = len(values) // 2
    costs, probes = [0.0], 0
    apart = np.bitwise_count(values[:half, None] ^ values[None, half:]) if half else np.empty((0, 0))
    for t in range(min(max_bits, len(part)) + 1):
        probes += comb(len(part), t)
        even = probes / 2.0 ** len(part)
        seen = float((apart <= t).mean()) if apart.size else 0.0
        costs.append(PROBE_COST * (1 + probes) / 2 + rows * share * max(even, seen))
    return costs


def allocate(sample: np.ndarray, max_bits: int, rows: int, share: float = 1.0) -> Layout:
    """The partitions and thresholds of least estimated cost.

    ``share`` is the share of rows left after the key's other parts (size classes). For each number of
    partitions, dynamic programming gives thresholds with sum(t_i + 1) = max_bits + 1.
    """
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    best: tuple[float, Layout] | None = None
    for count in range(1, min(max_bits + 2, 12) + 1):
        if 64 // count > 32:
            continue  # a packed partition value must fit beside the other parts of the bucket key
        parts = correlated_parts(bits, count)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for part in parts:
            costs = _costs(sample, part, max_bits, rows, share)
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (cost, limits) in table.items():
                for units, extra in enumerate(costs):
                    to = spent + units
                    if to <= max_bits + 1 and (to not in step or cost + extra < step[to][0]):
                        step[to] = (cost + extra, (*limits, units - 1))
            table = step
        if max_bits + 1 in table and (best is None or table[max_bits + 1][0] < best[0]):
            best = (table[max_bits + 1][0], Layout(parts, table[max_bits + 1][1]))
    assert best is not None
    return best[1]


# Buckets


def _masks(width: int, limit: int) -> np.ndarray:
    """All masks of up to ``limit`` set bits; the empty one first."""
    out = [0]
    for n in range(1, limit + 1):
        out += [sum(1 << b for b in chosen) for chosen in combinations(range(width), n)]
    return np.array(out, np.uint64)


def _size_class(sizes: np.ndarray, ratio: float) -> np.ndarray:
    """Classes such that sizes within the ratio fall in the same or in neighbouring classes."""
    return np.floor(np.log(np.maximum(sizes, 1)) / -np.log(ratio)).astype(np.int64) + 1


def _probe(layout: Layout, size_ratio: float | None):
    """Batch of (key, size) to rows (bucket, probe, key, size).

    Of two values that differ by a mask, only the one with the mask's highest bit set probes the other, and
    only the smaller size class probes the larger one. Both halve the rows and lose no pair.
    """
    plans = [(i, bits, _masks(len(bits), t)) for i, bits, t in layout.used()]
    tops = [np.array([0, *(1 << (int(m).bit_length() - 1) for m in masks[1:])], np.uint64) for _, _, masks in plans]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(0)
        first = np.array([int.from_bytes(k.as_py()[:8], "big") for k in keys], np.uint64)
        sizes = batch.column(1).to_numpy(zero_copy_only=False)
        kinds = [(np.zeros(len(sizes), np.int64), 0)]
        if size_ratio is not None:
            own = _size_class(sizes, size_ratio)
            kinds = [(own, 0), (own + 1, 1)]
        rows, buckets, probes = [], [], []
        for (i, bits, masks), top in zip(plans, tops):
            values = extract(first, bits)
            near = values[:, None] ^ masks[None, :]
            emits = (values[:, None] & top[None, :]) == top[None, :]
            for cls, shifted in kinds:
                # A neighbouring class is probed with every mask, as the other side never probes back.
                row, col = np.nonzero(np.ones_like(emits) if shifted else emits)
                head = (np.uint64(i) << np.uint64(58)) | (cls[row].astype(np.uint64) << np.uint64(34))
                buckets.append(head ^ near[row, col])
                probes.append((col > 0) | bool(shifted))
                rows.append(row)
        at = pa.array(np.concatenate(rows))
        columns = [
            pa.array(np.concatenate(buckets).view(np.int64)),
            pa.array(np.concatenate(probes)),
            keys.take(at),
            batch.column(1).take(at),
        ]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "probe", "key", "size"])

    return work


def _linked(keys: np.ndarray, sizes: np.ndarray, a: int, others: np.ndarray, rule: tuple) -> np.ndarray:
    """Which of the others are within the rule of member a."""
    max_bits, total_bits, size_ratio, words = rule
    apart = np.bitwise_count(keys[others, :words] ^ keys[a, :words])
    ok = apart[:, 0] <= max_bits
    if total_bits is not None:
        ok &= apart.sum(1, dtype=np.int64) <= total_bits
    if size_ratio is not None:
        low, high = np.minimum(sizes[others], sizes[a]), np.maximum(sizes[others], sizes[a])
        ok &= low >= size_ratio * high
    return ok


def spanning_links(keys: np.ndarray, sizes: np.ndarray, probe: np.ndarray, rule: tuple, names: np.ndarray) -> list[list[int]]:
    """The components of the links between members, where two probes are not compared; single members are left out.

    ``names`` number the members; those of one name are connected beforehand, so a component has at least two names. First
    all pairs are compared on their first 64 bits, in blocks; most members differ from all others there. The rest are
    searched member by member, each against those not yet visited.
    """
    if (names == names[0]).all():
        return []
    filed = np.nonzero(~probe)[0]
    first, near = np.ascontiguousarray(keys[:, 0]), np.zeros(len(keys), bool)
    for a in range(0, len(filed), 256):
        part = filed[a : a + 256]
        close = (np.bitwise_count(first[part, None] ^ first[None, :]) <= rule[0]) & (names[part, None] != names[None, :])
        near[part] |= close.any(1)
        near |= close.any(0)
    filed, probing = filed[near[filed]], np.nonzero(probe & near)[0]
    out: list[list[int]] = []
    while len(filed):
        todo, tree, found = [], [], filed[:1]
        while True:
            # All members of the names found are reached.
            reached, at = np.unique(names[found], return_index=True)
            tree += found[at].tolist()
            own, other = np.isin(names[filed], reached), np.isin(names[probing], reached)
            todo += [*filed[own].tolist(), *probing[other].tolist()]
            filed, probing, found = filed[~own], probing[~other], found[:0]
            while todo and (len(filed) or len(probing)) and not len(found):
                a = todo.pop()
                found = filed[_linked(keys, sizes, a, filed, rule)]
                if not probe[a]:
                    found = np.concatenate([found, probing[_linked(keys, sizes, a, probing, rule)]])
            if not len(found):
                break
        if len(tree) > 1:
            out.append(tree)
    return out


def _verify(rule: tuple):
    """Rows sorted by (bucket, i, j) to links (a, b); a group may go on in the next batch."""

    def links(group: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        raw = group.column("key").to_pylist()
        # The bytes behind the words that are bits name a member; without any, the whole key does.
        cut = 8 * rule[3] if rule[3] else 0
        bits, called = ([key[:cut] for key in raw], [key[cut:] for key in raw]) if cut else (raw, raw)
        keys = np.frombuffer(b"".join(bits), ">u8").astype(np.uint64).reshape(len(raw), -1)
        sizes = group.column("size").to_numpy()
        probe = group.column("probe").to_numpy()
        number: dict[bytes, int] = {}
        names = np.array([number.setdefault(name, len(number)) for name in called])
        for tree in spanning_links(keys, sizes, probe, rule, names):
            low, *others = sorted(called[x] for x in tree)
            yield from ((low, other) for other in others)

    def emit(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        arrays = [pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows < 2:
                continue
            marks = np.stack([rest.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = np.nonzero((marks[1:] != marks[:-1]).any(1))[0] + 1
            if not len(cuts):
                continue
            found: list[tuple[bytes, bytes]] = []
            done = rest.slice(0, int(cuts[-1])).combine_chunks()
            for start, end in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                if end - start > 1:
                    found += links(done.slice(start, end - start))
            rest = rest.slice(int(cuts[-1])).combine_chunks()
            if found:
                yield emit(found)
        if rest is not None and rest.num_rows > 1:
            found = list(links(rest.combine_chunks()))
            if found:
                yield emit(found)

    return run


def link_fingerprints(
    nodes: DataFrame, max_bits: int, total_bits: int | None = None, size_ratio: float | None = None, words: int | None = None
) -> DataFrame:
    """(a, b): links that connect what the rule connects.

    ``nodes`` has distinct (key, size). Two of them link if the first 64 bits of their keys differ in at most
    ``max_bits`` bits and, where given, all bits in at most ``total_bits`` and the smaller size is at least
    ``size_ratio`` of the larger one. With ``words`` only that many 64-bit words of a key are bits, and those behind them
    are its name: links are between names, and keys of one name count as connected. Links are a spanning forest per
    bucket, not all pairs, and go from the smallest name of each of its trees to the others.
    """
    rows = nodes.count()
    sample = hash_order_sample(nodes.select("key"), F.col("key"), SAMPLE_ROWS, rows).collect()
    drawn = np.array([int.from_bytes(r[0][:8], "big") for r in sample], np.uint64)
    layout = allocate(drawn, max_bits, max(rows, 1), 1.0 if size_ratio is None else 0.15)

    def probes(some_nodes: DataFrame) -> DataFrame:
        columns = "bucket bigint, probe boolean, key binary, size int"
        return map_batches(some_nodes.select("key", "size"), lambda: _probe(layout, size_ratio), columns)

    spread = probes(nodes)
    # Large buckets are dealt as pairs of chunks. A sample tells which they are: an estimate that is off
    # changes what a task holds, not what is compared.
    some = F.pmod(F.xxhash64("key"), F.lit(BUCKET_SAMPLE)) == 0
    seen = probes(nodes.where(some)).groupBy("bucket").agg((F.count(F.lit(1)) * BUCKET_SAMPLE).alias("members"))
    large = seen.where(F.col("members") > CHUNK).select("bucket", F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"))
    placed = spread.join(materialize(large, "large-buckets"), "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("key", "probe"), F.col("chunks").cast("bigint")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "probe", "key", "size"
    )
    grouped = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    rule = (max_bits, total_bits, size_ratio, words)
    return grouped.mapInArrow(_verify(rule), "a binary, b binary").distinct()


def components(links: DataFrame, purpose: str = "labels") -> DataFrame:
    """(node, label): every linked node with the smallest node it reaches.

    Each round takes the smallest label among neighbours and then the label of that label, so paths halve
    their length. Rounds are written to the shared folder; they end when no label changes.
    """
    both = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        f"{purpose}-links",
    )
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("label")
    )
    labels = materialize(labels, purpose)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("before"), F.least("label", "seen").alias("label")
        )
        lower = materialize(lower, purpose)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = lower.join(jump, "label").select(
            "node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("before")).alias("moved")
        )
        after = materialize(after, purpose)
        labels = after.select("node", "label")
        if not after.where("moved").limit(1).count():
            return labels


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    max_bits: int = 3,
    words: int = 1,
    total_bits: int | None = None,
    size_ratio: float | None = None,
) -> DataFrame:
    """(id, fingerprint, component_id): one row per input row.

    ``fingerprint`` is the key in hexadecimal, ``component_id`` the smallest id reachable over links, the own
    one included. Null and empty texts and texts of white space have fingerprint zero and link like any
    other. A text of fewer words than ``width`` is one shingle. Rows that repeat an id are all returned. A row
    without id takes part, but can't name a group: ``component_id`` is null where no member has an id. An
    empty table gives no rows. Other columns are not read.
    """
    marked = materialize(sketches(docs, id_col, text_col, width, words), "sketches")
    if size_ratio is None:
        marked = marked.withColumn("size", F.lit(0))
    # Copies meet here, by partial aggregation; links are made between distinct fingerprints only.
    nodes = materialize(marked.groupBy("key", "size").agg(F.min("id").alias("low_id")), "nodes")
    # Equal keys of unequal size differ in no bit: they are one node id, which the size rule must not part.
    labels = components(link_fingerprints(nodes, max_bits, total_bits, size_ratio))
    named = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "size", "low_id", F.coalesce("label", "key").alias("label")
    )
    lowest = named.groupBy("label").agg(F.min("low_id").alias("component_id"))
    groups = named.join(lowest, "label").groupBy("key").agg(F.min("component_id").alias("component_id"))
    # Written, so that the join is of two plain shuffles and a hot fingerprint can be split.
    out = marked.join(materialize(groups, "groups"), "key", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("key")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that name their group: of near copies the one with the smallest id stays.

    Rows that repeat an id are one document and stay or go together. Rows without id go if their group has a
    row with id, and stay otherwise. All columns stay as they are.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, **options)
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("kept_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("kept_id")), "left_semi")
