"""Periodic runs of words, found tile by tile per period octave, and texts with the repeats taken out.

A run of period q is a stretch whose words recur q words later; its shift interval is the stretch of positions i with
word i = word i + q. An octave holds the periods from u up to 2u - 1 and has a boundary every ``step`` words, where
step is u, and ``BLOCK`` at least. The shift interval of a run that counts holds a whole block between two boundaries,
so only the boundaries whose block recurs at a distance of the octave can lie in a run; block digests tell them, and
equal blocks have equal digests. The words around such boundaries are the tiles of the octave: they overlap, leave
their document as rows of their own and are dealt to tasks, so that a long document is solved by many.

In a tile two Z-functions at each boundary, over the words after it and, backwards, over those before it, give the
part of the shift interval that the tile can see, exactly and for all periods of the octave. Parts of one interval
overlap from tile to tile; they are shuffled by document and period and stitched there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.llm.common import map_batches, materialize

#: Words a run needs, and periods it needs.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Least distance of two boundaries. A shift interval of 15 words holds a whole block of 8, and none that counts is shorter.
BLOCK = 8
#: Words that one row of tiles holds, unless a single tile has more.
ROW_WORDS = 8192
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SHIFT = np.uint64(29)
RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, counted from 0 inside the text."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))


def _doubled(digests: np.ndarray, size: int) -> np.ndarray:
    """Digests of stretches of 2 x size words from those of size words."""
    mixed = digests[:-size] * _MULTIPLIERS[0] + digests[size:] * _MULTIPLIERS[1]
    return mixed ^ (mixed >> _SHIFT)


def boundaries(numbers: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(u, step, boundaries) of each octave that has boundaries whose block recurs at one of its periods."""
    n = len(numbers)
    if n < MIN_WORDS:
        return
    digests, size = numbers.astype(np.uint64) + np.uint64(1), 1
    while size < BLOCK:
        digests, size = _doubled(digests, size), 2 * size
    starts = np.arange(0, len(digests), BLOCK)
    u = 1
    while u < BLOCK:
        hit = np.zeros(len(starts), bool)
        for q in range(u, min(2 * u - 1, n // MIN_PERIODS) + 1):
            inside = int(np.searchsorted(starts, len(digests) - q))
            hit[:inside] |= digests[starts[:inside]] == digests[starts[:inside] + q]
        if hit.any():
            yield u, BLOCK, starts[hit]
        u *= 2
    while MIN_PERIODS * u <= n:
        # A position of one block is compared with the start of the block before it.
        before = np.repeat(digests[::u], u)[: len(digests) - u]
        at = np.flatnonzero(before == digests[u:])
        if len(at):
            yield u, u, np.unique(at // u) * u
        digests, u = _doubled(digests, u), 2 * u


def _with_tiles(wanted: bool):
    """Keep the rows (id, key, text) whose text has a boundary in a tile, or those without any."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [any(boundaries(word_numbers((t.as_py() or b"").split()))) is wanted for t in batch.column(2)]
        return batch.filter(pa.array(found, pa.bool_()))

    return work


def _tiles(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, key, text) to rows of tiles: octave, first and last boundary, place of the first word, words."""
    rows, octaves, firsts, lasts, lows, words = [], [], [], [], [], []
    for row, text in enumerate(batch.column(2)):
        numbers = word_numbers((text.as_py() or b"").split())
        for u, step, found in boundaries(numbers):
            most = max(1, ROW_WORDS // step)
            cut = np.flatnonzero(np.diff(found) != step) + 1
            for stretch in np.split(found, cut):
                for at in range(0, len(stretch), most):
                    first, last = int(stretch[at]), int(stretch[min(at + most, len(stretch)) - 1])
                    low = max(0, first - step)
                    rows.append(row)
                    octaves.append(u)
                    firsts.append(first)
                    lasts.append(last)
                    lows.append(low)
                    words.append(numbers[low : last + 2 * step + 2 * u].tobytes())
    take = pa.array(rows, pa.int32())
    columns = [batch.column(0).take(take), batch.column(1).take(take)]
    columns += [pa.array(c, pa.int64()) for c in (octaves, firsts, lasts, lows)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.binary())], ["id", "key", "octave", "first", "last", "low", "words"])


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place below ``upto`` the length of the longest prefix of s that starts there."""
    n = len(s)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def solve_tile(words: list[int], at: int, u: int, step: int) -> list[tuple[int, int, int]]:
    """(period, before, after) of the octave's shift intervals that hold the block at ``at``: places matched on both
    sides of it, up to ``step`` before and ``2 step`` after."""
    ahead = words[at : at + 2 * step + 2 * u]
    reach = min(2 * u, len(ahead))
    z = z_function(ahead, reach)
    found = [q for q in range(u, reach) if z[q] >= step]
    if not found:
        return []
    before = words[max(0, at - step) : at][::-1]
    around = words[max(0, at - step) : at + reach][::-1]
    back = z_function([*before, -1, *around], len(before) + 1 + reach)
    return [(q, back[len(before) + 1 + reach - q], min(z[q], 2 * step)) for q in found]


def _solve(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of tiles to fragments (id, key, period, start, end) of shift intervals, merged inside a row."""
    rows, periods, starts, ends = [], [], [], []
    places = zip(*(batch.column(k).to_pylist() for k in range(2, 7)))
    for row, (u, first, last, low, raw) in enumerate(places):
        step, words = max(u, BLOCK), np.frombuffer(raw, np.uint32).tolist()
        current: dict[int, list[int]] = {}
        closed: list[tuple[int, int, int]] = []
        for b in range(first, last + 1, step):
            for q, before, after in solve_tile(words, b - low, u, step):
                known = current.get(q)
                if known is not None and b - before <= known[1]:
                    known[1] = b + after
                else:
                    if known is not None:
                        closed.append((q, *known))
                    current[q] = [b - before, b + after]
        closed += [(q, *known) for q, known in current.items()]
        for q, start, end in closed:
            # One that ends inside the row is whole; others may go on in the next row.
            if start <= first - step or end >= last + 2 * step or end - start + q >= max(MIN_WORDS, MIN_PERIODS * q):
                rows.append(row)
                periods.append(q)
                starts.append(start)
                ends.append(end)
    take = pa.array(rows, pa.int32())
    columns = [batch.column(0).take(take), batch.column(1).take(take)]
    columns += [pa.array(c, pa.int64()) for c in (periods, starts, ends)]
    return pa.RecordBatch.from_arrays(columns, ["id", "key", "period", "start", "end"])


def stitched(fragments: DataFrame) -> DataFrame:
    """(id, key, period, start, length) of the runs, from the fragments of their shift intervals.

    Fragments of a document and period that overlap or touch are one interval. A stretch with period q and three
    periods has a smaller one only if that divides q, and is then the same stretch: the smallest stays.
    """
    ordered = Window.partitionBy("id", "key", "period").orderBy("start", "end")
    so_far = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("opens", F.when(so_far >= F.col("start"), 0).otherwise(1))
    whole = (
        marked.withColumn("part", F.sum("opens").over(ordered))
        .groupBy("id", "key", "period", "part")
        .agg(F.min("start").alias("start"), (F.max("end") - F.min("start") + F.col("period")).alias("length"))
    )
    counts = whole.where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_PERIODS * F.col("period")))
    return counts.groupBy("id", "key", "start", "length").agg(F.min("period").alias("period"))


def _collapse(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, text, runs) to (id, n_words, runs, text of the kept words)."""
    sizes, kept = [], []
    for text, runs in zip(batch.column(1), batch.column(2)):
        words, found = (text.as_py() or b"").split(), runs.as_py()
        sizes.append(len(words))
        if found:
            change = np.zeros(len(words) + 1, np.int64)
            for run in found:
                change[run["start"] + run["period"]] += 1
                change[run["start"] + run["length"]] -= 1
            covered = np.cumsum(change[:-1]) > 0
            words = [w for w, gone in zip(words, covered.tolist()) if not gone]
        kept.append(b" ".join(words))
    columns = [batch.column(0), pa.array(sizes, pa.int64()), batch.column(2), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed_text): one row per input row.

    ``runs`` lists every stretch of at least ``MIN_WORDS`` words and ``MIN_PERIODS`` of its smallest period that can't
    be made longer, as (start, period, length) in words, by start, then period; empty if there is none. Of each run the
    first period stays, and ``collapsed_text`` joins the kept words by single blanks. Words are split at blank, tab, line
    feed, vertical tab, form feed and carriage return. Null and empty texts have no word, no run and an empty result.
    Texts of any length are read whole. Rows that repeat an id, and rows without one, each have the runs of their own
    text. An empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(body, F.lit(b"")))).alias("key"), body.alias("text"))
    shape = f"id {kind}, key binary, text binary"
    # Only texts with tiles are shuffled: they are written, and their runs meet this table. The others, told by the
    # same function, pass in a second reading.
    tiled = materialize(map_batches(rows, lambda: _with_tiles(True), shape), "periodic-texts")
    plain = map_batches(rows, lambda: _with_tiles(False), shape).select("id", "text", F.lit(None).cast(RUNS).alias("runs"))
    tiles = map_batches(tiled, lambda: _tiles, f"id {kind}, key binary, octave bigint, first bigint, last bigint, low bigint, words binary")
    dealt = tiles.repartition("key", "octave", "first")
    fragments = map_batches(dealt, lambda: _solve, f"id {kind}, key binary, period bigint, start bigint, end bigint")
    runs = stitched(fragments).groupBy("id", "key")
    runs = runs.agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = materialize(runs.select(F.col("id").alias("run_id"), F.col("key").alias("run_key"), "runs"), "periodic-runs")
    same = (F.col("key") == F.col("run_key")) & F.col("id").eqNullSafe(F.col("run_id"))
    joined = tiled.join(runs, same, "left").select("id", "text", "runs").unionByName(plain)
    out = map_batches(joined, lambda: _collapse, f"id {kind}, n_words bigint, runs {RUNS}, collapsed binary")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("runs", F.array().cast(RUNS)).alias("runs"),
        F.col("collapsed").cast("string").alias("collapsed_text"),
    )


def strongest(runs: Column | str) -> Column:
    """The run with the greatest exact ratio of length to period, the first of equal ones; null if there is none."""
    none = F.lit(None).cast(RUNS[len("array<") : -1])
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, none, lambda best, run: F.when(best.isNull() | more(best, run), run).otherwise(best))
