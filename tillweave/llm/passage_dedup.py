"""Removal of long passages that occur more than once, by prefix-free parsing and suffix arrays.

A rolling hash of ``GRAM`` bytes runs over every text. Of each passage of ``length`` bytes, the place in its first
``length - HEAD + 1`` bytes with the least hash is its trigger, so a trigger depends on the passage alone and equal
passages have equal triggers at equal distances. The passages of one trigger are neighbours; the bytes that they cover
are a phrase. The phrases of a text overlap by less than a passage, and the list of them is its parse.

1. Triggers whose next ``HEAD`` bytes occur once can't lie in a repeated passage. Counting these heads, and joining
   the count back, leaves the parse: the triggers that may, with their place and the name of their phrase.
2. Distinct names with a count are the dictionary. Phrases of one name are equal, so the bytes of a phrase are fetched
   once, and only where its head has other phrases too.
3. Phrases with the same head are put in two orders: the suffixes before the trigger, compared backwards, and what
   follows the head, compared forwards. These are the suffix arrays of the phrase ends and of what the parse goes on
   with; with the lengths that neighbours share they give, for every distance of a passage's start from its trigger,
   the rank of its two sides among all. Two passages are equal if both ranks are: the two arrays combined.
   Heads with many distinct phrases are dealt on by longer and longer shared text, down to whole passages, which are
   only counted; no head is gathered beyond ``CHUNK`` phrases.
4. The repeated passages of a phrase cover one stretch of it. Stretches go back to the texts by name and are cut out.

Bytes are compared as they are; hashes only choose triggers and propose, or name phrases (128 bits)
and texts (96 bits). Texts are compressed where they are shuffled.
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

#: Bytes of a passage.
LENGTH = 200
#: Bytes of the rolling hash.
GRAM = 16
#: Bytes from a trigger on that all its passages hold. Longer ones are rarer by chance, but need more triggers.
HEAD = 32
#: Distinct phrases with one head that one task compares, and phrases that it holds.
CHUNK = 20_000
HELD = 30_000
_DRAW = np.random.default_rng(13)
_BYTES = _DRAW.integers(0, 2**63, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def triggers(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): each trigger with its first and last passage start, in order; together they are all
    starts. Of equal hashes the first place is taken."""
    n, window = len(text), length - HEAD + 1
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none
    hashes, size, power = _BYTES[np.frombuffer(text, np.uint8)], 1, _STEP
    while size < GRAM:
        hashes = hashes[:-size] * np.uint64(power) + hashes[size:]
        size, power = 2 * size, power * power % 2**64
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(_STEP)
    least = hashes[: n - HEAD + 1] & _HIGH
    least |= np.arange(len(least), dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    at = (least & _LOW).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cuts])
    return at[first], first, np.append(cuts, len(at)) - 1


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _heads(length: int):
    """(text) to the heads of its triggers."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, heads = xxhash.xxh3_64_intdigest, []
        for text in batch.column(0):
            body = text.as_py() or b""
            heads += [digest(body[p : p + HEAD]) for p in triggers(body, length)[0].tolist()]
        return pa.RecordBatch.from_arrays([_longs(heads)], ["head"])

    return work


def _parse(length: int):
    """(text, slot, check) to a row per trigger: head and name of its phrase, the text's slot and check, the place,
    and the least and greatest distance of its passage starts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, heads, names, rows, places = xxhash.xxh3_64_intdigest, [], [], [], []
        for row, text in enumerate(batch.column(0)):
            body = text.as_py() or b""
            found = triggers(body, length)
            if len(found[0]):
                for t, lo, hi in zip(*(c.tolist() for c in found)):
                    heads.append(digest(body[t : t + HEAD]))
                    names.append(digest(body[lo : hi + length], t - lo))
                places.append(np.stack([found[0], found[0] - found[2], found[0] - found[1]]))
                rows.append(np.full(len(found[0]), row))
        take = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
        spots = np.concatenate(places, 1) if places else np.empty((3, 0), np.int64)
        columns = [_longs(heads), _longs(names), batch.column(1).take(take), batch.column(2).take(take)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int32()) for c in spots)], ["head", "name", "slot", "check", "place", "near", "far"])

    return work


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Compress the last column, a text."""
    pack = zstandard.ZstdCompressor(level=3).compress
    made = [None if (body := text.as_py()) is None else pack(body) for text in batch.column(batch.num_columns - 1)]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], batch.schema.names)


def _phrases(length: int):
    """(packed text, wanted places) to their phrases."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack, rows = zstandard.ZstdDecompressor().decompress, []
        for text, wanted in zip(batch.column(0), batch.column(1)):
            body = unpack(text.as_py())
            for w in wanted.as_py():
                start = w["place"] - w["far"]
                rows.append((w["head"], w["name"], w["near"], w["far"], body[start : w["place"] - w["near"] + length]))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["head", "name", "near", "far", "phrase"])

    return work


def _suffix_order(groups: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``sides`` inside their groups, and the bytes each shares with the row before it; -1 where
    the group changes."""
    width = sides.shape[1] + 4
    keyed = np.empty((len(sides), width), np.uint8)
    keyed[:, :4] = groups.astype(">u4").view(np.uint8).reshape(-1, 4)
    keyed[:, 4:] = sides
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width}").ravel(), kind="stable")
    ranked = keyed[order]
    differs = ranked[1:] != ranked[:-1]
    shared = np.where(differs.any(1), differs.argmax(1), width) - 4
    return order, np.concatenate([[-1], np.where(shared < 0, -1, shared)])


def repeated_in(heads: np.ndarray, phrases: list[bytes], near: np.ndarray, far: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) per phrase: the least and greatest distance from its trigger at which a passage starts that another
    of the phrases with the same head also holds; high is -1 if there is none."""
    side = length - HEAD
    m = len(phrases)
    flat = np.frombuffer(b"".join(phrases) + b"\0", np.uint8)
    sizes = np.array([len(p) for p in phrases], np.int64)
    base = np.cumsum(sizes) - sizes
    steps = np.arange(side)
    before = far[:, None] - 1 - steps
    after = far[:, None] + HEAD + steps
    left = np.where(before >= 0, flat[np.where(before >= 0, base[:, None] + before, 0)], 0).astype(np.uint8)
    inside = after < sizes[:, None]
    right = np.where(inside, flat[np.where(inside, base[:, None] + after, 0)], 0).astype(np.uint8)
    groups = np.unique(heads, return_inverse=True)[1]
    left_order, left_shared = _suffix_order(groups, left)
    right_order, right_shared = _suffix_order(groups, right)
    low, high = np.full(m, length), np.full(m, -1)
    left_rank, right_rank = np.empty(m, np.int64), np.empty(m, np.int64)
    for distance in range(int(near.min(initial=0)), int(far.max(initial=-1)) + 1):
        held = np.flatnonzero((near <= distance) & (distance <= far))
        if len(held) < 2:
            continue
        left_rank[left_order] = np.cumsum(left_shared < distance)
        right_rank[right_order] = np.cumsum(right_shared < side - distance)
        both = left_rank[held] * (m + 1) + right_rank[held]
        order = np.argsort(both, kind="stable")
        same = np.diff(both[order]) == 0
        twice = held[order[np.append(same, False) | np.insert(same, 0, False)]]
        low[twice] = np.minimum(low[twice], distance)
        high[twice] = distance
    return low, high


def _solve(length: int):
    """Phrases sorted by group to (head, name, low, high); a group may go on in the next batch."""

    def solved(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        groups, heads, names, near, far, phrases = zip(*rows)
        low, high = repeated_in(np.array(groups), list(phrases), np.array(near), np.array(far), length)
        hit = np.flatnonzero(high >= 0)
        columns = [pa.array(np.array(heads)[hit], pa.int64()), pa.array(np.array(names)[hit], pa.int64())]
        columns += [pa.array(low[hit], pa.int32()), pa.array(high[hit], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["head", "name", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # whole groups
        last: list[tuple] = []  # the group that may go on
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last and row[0] != last[0][0]:
                    if len(last) > 1:
                        done += last
                    last = []
                    if len(done) >= HELD:
                        out = solved(done)
                        if out is not None:
                            yield out
                        done = []
                last.append(row)
        out = solved(done + last)
        if out is not None:
            yield out

    return run


def _narrower(crowded: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of crowded groups, dealt on: (phrases in smaller groups, passages found repeated).

    The distances ``least`` to ``most`` are halved. All passages of a half share more text around the trigger than
    before, and a digest of it is the new group. A half of one distance shares the whole passage, which needs counting
    only.
    """
    middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
    halves = F.array(F.struct(F.col("least").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("most").alias("b")))
    split = crowded.withColumn("half", F.explode(F.filter(halves, lambda h: h["a"] <= h["b"])))
    split = split.where((F.col("near") <= F.col("half.b")) & (F.col("far") >= F.col("half.a")))
    shared = F.substring("phrase", F.col("far") - F.col("half.a") + 1, F.col("half.a") + F.lit(length) - F.col("half.b"))
    split = split.select(
        F.xxhash64("group", "half.a", shared).alias("group"), "head", "name", "near", "far", "phrase",
        F.col("half.a").alias("least"), F.col("half.b").alias("most"), F.when(F.col("half.a") == F.col("half.b"), F.md5(shared)).alias("passage"),
    )
    whole = split.where(F.col("passage").isNotNull())
    counted = whole.groupBy("least", "passage").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("least", "passage")
    counted = materialize(counted, "passages-whole")
    found = whole.join(counted, ["least", "passage"]).select("head", "name", F.col("least").alias("low"), F.col("least").alias("high"))
    return split.where(F.col("passage").isNull()).drop("passage"), found


def compared(phrases: DataFrame, length: int) -> DataFrame:
    """(head, name, low, high) of the distinct phrases (head, name, near, far, phrase) that hold a passage of another
    one: the least and greatest distance of such passages from the trigger, in one or more rows."""
    columns = ["group", "head", "name", "near", "far", "phrase"]
    open_rows = phrases.withColumns({"group": F.col("head"), "least": F.lit(0), "most": F.lit(length - HEAD)})
    found = None
    while True:
        sizes = open_rows.groupBy("group").agg(F.count(F.lit(1)).alias("m"))
        large = materialize(sizes.where(F.col("m") > CHUNK).select("group"), "passages-crowded-groups")
        crowded = not large.isEmpty()
        ready = open_rows.join(large, "group", "left_anti") if crowded else open_rows
        dealt = ready.select(*columns).repartition("group").sortWithinPartitions("group")
        solved = dealt.mapInArrow(_solve(length), "head bigint, name bigint, low int, high int")
        found = solved if found is None else found.unionByName(solved)
        if not crowded:
            return found
        open_rows, whole = _narrower(open_rows.join(large, "group"), length)
        open_rows = materialize(open_rows, "passages-crowded")
        found = found.unionByName(whole)


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, packed text, spans) to (id, n_bytes, n_removed, n_spans, kept)."""
    unpack = zstandard.ZstdDecompressor().decompress
    sizes, removed, runs, kept = [], [], [], []
    for text, spans in zip(batch.column(1), batch.column(2)):
        raw, merged = text.as_py(), []
        body = unpack(raw) if raw else b""
        for span in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
            if merged and span[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], span[1])
            else:
                merged.append(list(span))
        ends = [0, *(e for _, e in merged)]
        parts = [body[a:b] for a, b in zip(ends, [*(s for s, _ in merged), len(body)])]
        kept.append(b"".join(parts) if merged else body)
        sizes.append(len(body))
        removed.append(len(body) - len(kept[-1]))
        runs.append(len(merged))
    columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): one row per input row.

    Removes each byte of a text that a passage of ``length`` bytes covers which starts at another place too, of the
    same or another text, overlaps included. ``kept`` is binary, as a cut may fall inside a character; ``n_spans``
    counts maximal removed stretches. Texts are UTF-8; a null one is empty, and those shorter than a passage stay
    whole. Texts of any length are read whole. Repeated rows, with or without an id, are texts of their own and lose
    all that they share. An empty table gives no rows. Other columns are not read.
    """
    if length <= HEAD:
        raise ValueError(f"a passage needs more than {HEAD} bytes")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.withColumns({"slot": F.xxhash64("text"), "check": F.hash("text")})
    heads = map_batches(rows.select("text"), lambda: _heads(length), "head bigint")
    # Written, so that the joins back are of two plain shuffles, which adaptive execution can split where a key is hot.
    shared = materialize(heads.groupBy("head").count().where("count > 1").select("head"), "passages-shared")
    shape = "head bigint, name bigint, slot bigint, check int, place int, near int, far int"
    parse = map_batches(rows.select("text", "slot", "check"), lambda: _parse(length), shape)
    parse = materialize(parse.join(shared.hint("merge"), "head"), "passages-parse")
    first = F.min(F.struct("slot", "check", "place")).alias("at")
    dictionary = parse.groupBy("head", "name", "near", "far").agg(F.count(F.lit(1)).alias("n"), first)
    dictionary = materialize(dictionary, "passages-dictionary")
    # Bytes are needed where phrases differ after equal heads, once for each of them.
    mixed = dictionary.groupBy("head").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("head")
    wanted = dictionary.join(mixed.hint("merge"), "head").groupBy("at.slot", "at.check")
    wanted = wanted.agg(F.collect_list(F.struct("head", "name", "at.place", "near", "far")).alias("wanted"))
    wanted = materialize(wanted, "passages-wanted")
    packed = map_batches(rows.select("id", "slot", "check", "text"), lambda: _packed, f"id {kind}, slot bigint, check int, text binary")
    fetched = packed.drop("id").join(wanted.hint("merge"), ["slot", "check"])
    phrases = map_batches(fetched.select("text", "wanted"), lambda: _phrases(length), "head bigint, name bigint, near int, far int, phrase binary")
    # Rows with the text of a wanted one give the same phrases again.
    phrases = materialize(phrases.dropDuplicates(["head", "name"]), "passages-phrases")
    # A phrase that occurs twice has no passage that occurs once.
    twice = dictionary.where("n > 1").select("head", "name", F.col("near").alias("low"), F.col("far").alias("high"))
    stretches = twice.unionByName(compared(phrases, length)).groupBy("head", "name")
    stretches = materialize(stretches.agg(F.min("low").alias("low"), F.max("high").alias("high")), "passages-stretches")
    spans = parse.join(stretches.hint("merge"), ["head", "name"]).groupBy("slot", "check")
    spans = spans.agg(
        F.collect_set(F.struct((F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end"))).alias("spans")
    )
    spans = materialize(spans, "passages-spans")
    joined = packed.join(spans.hint("merge"), ["slot", "check"], "left").select("id", "text", "spans")
    out = map_batches(joined, lambda: _cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id_col)
