"""Benchmark decontamination: BM25 over test items, asked with every training passage.

Items are cut into chunks of at most ``CHUNK`` words, which are the documents of an inverted index; passages are
windows of ``PASSAGE`` words, every ``STRIDE`` words, so that a chunk lies whole inside one of them. A chunk's impacts
are divided by the score the chunk has with itself, so the threshold is a share of that.

Retrieval finds every chunk at or over the threshold. Terms are set apart, most frequent first, as long as no chunk can reach
the threshold with them alone (as in MaxScore); postings of the other terms carry the largest impact per block of
chunks. A passage sums block maxima of its terms; only blocks whose sum, with what the common terms can
add, reaches the threshold are scored exactly. Found pairs are then verified on the words themselves: question and
answer must both be there. A chunk that holds too little of one of them is verified with the item's whole question or
answer, looked for as far before or after the passage as the item reaches.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tillweave.llm.common import map_batches

CHUNK, PASSAGE, STRIDE = 64, 80, 16
BLOCK = 16
K1, B = 1.2, 0.75
#: Share of a chunk's own score that a passage must reach.
THRESHOLD = 0.6
#: Words of a shingle, and the shares of a chunk's question and answer shingles that a passage must hold.
SHINGLE, QUESTION_SHARE, ANSWER_SHARE = 5, 0.5, 0.5
#: In parts of fewer words one changed word spoils more than half of the shingles. They are also held if this share of
#: their words stands in order within twice their length.
SHORT_PART, SHORT_SHARE = 14, 0.6
#: Items of one index; more are asked in several indexes with the same global statistics.
SHARD_ITEMS = 50_000

_EDGES = string.whitespace + string.punctuation + "“”‘’«»¿¡…"


def bare(word: str) -> str:
    return word.strip(_EDGES).lower()


def words_of(text: str | None) -> list[str]:
    return [w for w in map(bare, (text or "").split()) if w]


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer, which is the last sentence; one sentence alone is all question."""
    body = (text or "").strip()
    cut = max(body.rfind(". ", 0, len(body) - 1), body.rfind("? ", 0, len(body) - 1), body.rfind("\n"))
    return (words_of(body[: cut + 1]), words_of(body[cut + 1 :])) if cut > 0 else (words_of(body), [])


@dataclass(frozen=True)
class Proof:
    """What verifies a chunk: words of question and answer, and how far the item reaches before and after the chunk."""

    question: list[str]
    answer: list[str]
    before: int
    after: int


def cut_item(text: str | None) -> list[tuple[list[str], Proof]]:
    """Chunks of an item: words, and what verifies them."""
    question, answer = split_item(text)
    words = question + answer
    count = -(-len(words) // CHUNK)
    edges = [round(k * len(words) / count) for k in range(count + 1)] if count else []
    chunks = []
    for a, b in zip(edges, edges[1:]):
        cut = min(b, max(a, len(question)))
        parts = [own if len(own) >= min(SHORT_PART, len(whole)) else whole for own, whole in ((words[a:cut], question), (words[cut:b], answer))]
        chunks.append((words[a:b], Proof(*parts, a, len(words) - b)))
    return chunks


@dataclass
class Index:
    """Chunks with normalised impacts, and block postings of the terms that are not common."""

    items: list
    chunk_item: np.ndarray
    proofs: list[Proof]
    vocabulary: dict[str, int]
    essential: np.ndarray
    starts: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    common_max: np.ndarray
    block_terms: list[np.ndarray]
    block_weights: list[np.ndarray]
    cache: dict[str, int] = field(default_factory=dict)


def build_index(items: list[tuple], frequency: dict[str, int], chunks: int, mean_words: float) -> Index | None:
    """Index of (item id, text) with the statistics of all chunks: frequency per term, number, mean length."""
    chunk_item, chunk_words, proofs = [], [], []
    for item, text in items:
        for words, proof in cut_item(text):
            chunk_item.append(item)
            chunk_words.append(words)
            proofs.append(proof)
    if not chunk_words:
        return None
    vocabulary = {w: i for i, w in enumerate(sorted({w for words in chunk_words for w in words}))}
    df = np.array([frequency[w] for w in vocabulary], np.float64)
    idf = np.log(1 + (chunks - df + 0.5) / (df + 0.5))
    rows, cols, weights = [], [], []
    for c, words in enumerate(chunk_words):
        counts = Counter(words)
        terms = np.array([vocabulary[w] for w in counts])
        tf = np.array(list(counts.values()), np.float64)
        impact = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
        rows.append(terms)
        cols.append(np.full(len(terms), c))
        weights.append(impact / impact.sum())
    row, col, weight = map(np.concatenate, (rows, cols, weights))
    # Common terms: most frequent first, while no chunk reaches the threshold with them alone.
    reached = np.zeros(len(chunk_words))
    essential = np.ones(len(vocabulary), bool)
    by_term = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[by_term], np.arange(len(vocabulary) + 1))
    for t in np.argsort(-df, kind="stable"):
        at = by_term[ends[t] : ends[t + 1]]
        reached[col[at]] += weight[at]
        if reached[col[at]].max(initial=0.0) >= 0.75 * THRESHOLD:
            reached[col[at]] -= weight[at]
        else:
            essential[t] = False
    count = -(-len(chunk_words) // BLOCK)
    common_max = np.array([reached[b * BLOCK : (b + 1) * BLOCK].max() for b in range(count)])
    keep = essential[row]
    key = row[keep] * count + col[keep] // BLOCK
    pairs, where = np.unique(key, return_inverse=True)
    maxima = np.zeros(len(pairs))
    np.maximum.at(maxima, where, weight[keep])
    starts = np.searchsorted(pairs // count, np.arange(len(vocabulary) + 1))
    block_terms, block_weights = [], []
    by_block = np.argsort(col // BLOCK, kind="stable")
    edges = np.searchsorted(col[by_block] // BLOCK, np.arange(count + 1))
    for b in range(count):
        inside = by_block[edges[b] : edges[b + 1]]
        terms = np.unique(row[inside])
        dense = np.zeros((len(terms), BLOCK))
        dense[np.searchsorted(terms, row[inside]), col[inside] % BLOCK] = weight[inside]
        block_terms.append(terms)
        block_weights.append(dense)
    return Index(
        [i for i, _ in items], np.array(chunk_item, dtype=object), proofs, vocabulary, essential,
        starts, pairs % count, maxima, common_max, block_terms, block_weights,
    )


class _Ids(dict):
    """Term number of a raw word; -1: not in the index, -2: no word at all."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        word = bare(raw)
        found = self.vocabulary.get(word, -1) if word else -2
        if len(self) > 300_000:  # only a cache: bounded, and made anew
            self.clear()
        self[raw] = found
        return found


def retrieve(texts: list[str], index: Index, ids: _Ids) -> list[tuple[int, int, float, int]]:
    """(text, chunk, score, first word of the passage) for all passages at or over the threshold.

    Texts are laid end to end with gaps of a passage, so that one pass serves a batch.
    """
    parts, offsets, at = [], [], 0
    for text in texts:
        words = text.split()
        own = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        own = own[own > -2]
        offsets.append(at)
        parts.append(own)
        gap = PASSAGE + (-(len(own) + PASSAGE)) % STRIDE
        parts.append(np.full(gap, -1))
        at += len(own) + gap
    line = np.concatenate(parts)
    starts_of = np.array(offsets)
    spots = np.nonzero(line >= 0)[0]
    spots = spots[index.essential[line[spots]]]
    if not len(spots):
        return []
    terms = line[spots]
    order = np.argsort(terms, kind="stable")
    before = np.full(len(spots), -1)
    same = terms[order][1:] == terms[order][:-1]
    before[order[1:][same]] = spots[order[:-1][same]]
    lengths = index.starts[terms + 1] - index.starts[terms]
    count = len(index.common_max)
    keys, sums = [], []
    for k in range(PASSAGE // STRIDE):
        start = (spots // STRIDE - k) * STRIDE
        ok = (start >= 0) & (before < start) & (spots < start + PASSAGE)
        n = lengths[ok]
        total = int(n.sum())
        if not total:
            continue
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        posting = np.repeat(index.starts[terms[ok]], n) + within
        keys.append(np.repeat(start[ok] // STRIDE, n) * count + index.blocks[posting])
        sums.append(index.maxima[posting])
    if not keys:
        return []
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    bound = np.bincount(where, np.concatenate(sums)) + index.common_max[key % count]
    out = []
    for hit in key[bound >= THRESHOLD - 1e-9].tolist():
        start, block = hit // count * STRIDE, hit % count
        passage = line[start : start + PASSAGE]
        known = np.intersect1d(passage[passage >= 0], index.block_terms[block])
        score = index.block_weights[block][np.searchsorted(index.block_terms[block], known)].sum(0)
        for c in np.nonzero(score >= THRESHOLD - 1e-9)[0].tolist():
            text = int(np.searchsorted(starts_of, start, side="right")) - 1
            # A window may begin in the gap before its text.
            if text + 1 < len(starts_of) and start + PASSAGE > starts_of[text + 1] and not (line[start : starts_of[text + 1]] >= 0).any():
                text += 1
            out.append((text, block * BLOCK + c, float(score[c]), max(0, start - int(starts_of[text]))))
    return out


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def in_order(region: list[str], part: list[str]) -> float:
    """Largest share of the part's words that stand in its order within any stretch of twice its length."""
    best, known, n = 0, set(part), len(part)
    for i, word in enumerate(region):
        if word not in known:
            continue
        stretch = [w for w in region[i : i + 2 * n] if w in known]
        there = set(stretch)
        if min(len(stretch), sum(w in there for w in part)) <= best:  # not even in any order
            continue
        longest = [0] * (n + 1)  # common subsequence of the stretch so far and the part up to each word
        for w in stretch:
            left = 0
            for j in range(n):
                left, longest[j + 1] = longest[j + 1], left + 1 if part[j] == w else max(longest[j], longest[j + 1])
        best = max(best, longest[n])
    return best / n


def held(region: list[str], part: list[str], least: float) -> tuple[float, bool]:
    """Share of the part's shingles that the region has, and whether that is enough.

    A part of fewer than ``SHORT_PART`` words may have its words in order instead. A part without words is held.
    """
    if not part:
        return 1.0, True
    n = min(SHINGLE, len(part))
    wanted = _shingles(part)
    share = len(wanted & {tuple(region[i : i + n]) for i in range(len(region) - n + 1)}) / len(wanted)
    if share < least and len(part) < SHORT_PART:
        share = in_order(region, part)
        return share, share >= SHORT_SHARE
    return share, share >= least


def overlap(words: list[str], start: int, proof: Proof) -> tuple[float, float] | None:
    """Shares of question and answer that the text holds around a passage; None if one of them is too low."""
    begin, end = start - STRIDE, start + PASSAGE + STRIDE
    region = words[max(0, begin - proof.before) : end + proof.after]
    question, asked = held(region, proof.question, QUESTION_SHARE)
    if not asked:
        return None
    answer, answered = held(region, proof.answer, ANSWER_SHARE)
    return (question, answer) if answered else None


def leaks_in(texts: list[str], index: Index, ids: _Ids) -> Iterator[tuple[int, object, float, int, float, float]]:
    """(text, item, score, first word, question share, answer share): the best verified passage of each text and item."""
    words: dict[int, list[str]] = {}
    best: dict[tuple[int, object], tuple] = {}
    for text, chunk, score, start in retrieve(texts, index, ids):
        if text not in words:
            words[text] = words_of(texts[text])
        shares = overlap(words[text], start, index.proofs[chunk])
        if shares is not None:
            found = (score, -start, *shares)
            key = (text, index.chunk_item[chunk])
            if key not in best or found > best[key]:
                best[key] = found
    for (text, item), (score, start, question, answer) in best.items():
        yield text, item, score, -start, question, answer


def _item_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Batch of item texts to rows (term, words of the chunk); an extra null term counts the chunk."""
    terms, sizes = [], []
    for text in batch.column(0):
        for words, _ in cut_item(text.as_py()):
            found = [None, *set(words)]
            terms.extend(found)
            sizes.extend([len(words)] * len(found))
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(sizes, pa.int64())], ["term", "size"])


def indexes(items: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """One index after the other for each ``SHARD_ITEMS`` items, with statistics of all items.

    Items without id or words can't be found. Rows that repeat an id add chunks to the item.
    """
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    terms = map_batches(rows.select("text"), lambda: _item_terms, "term string, size bigint")
    totals = terms.where(F.col("term").isNull()).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    if not totals["n"]:
        return
    counts = terms.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    shards = -(-rows.count() // SHARD_ITEMS)
    for shard in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        own = map_batches(part.select("text"), lambda: _item_terms, "term string, size bigint").select("term").distinct()
        frequency = {r["term"]: r["n"] for r in counts.join(own, "term").collect()}
        listed = [(r["item"], r["text"]) for r in part.orderBy("item", "text").collect()]
        built = build_index(listed, frequency, totals["n"], totals["mean"])
        if built is not None:
            yield built


_PAIR_KINDS = (("score", pa.float64()), ("first_word", pa.int64()), ("question_share", pa.float64()), ("answer_share", pa.float64()))


def _pairs(shared, item_type: pa.DataType):
    index = shared.value
    ids = _Ids(index.vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = list(leaks_in([t.as_py() or "" for t in batch.column(1)], index, ids))
        if not found:
            return None
        columns = list(zip(*found))
        arrays = [batch.column(0).take(pa.array(columns[0], pa.int32())), pa.array(columns[1], item_type)]
        arrays += [pa.array(c, k) for c, (_, k) in zip(columns[2:], _PAIR_KINDS)]
        return pa.RecordBatch.from_arrays(arrays, ["id", "item", *(n for n, _ in _PAIR_KINDS)])

    return work


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, item, score, first_word, question_share, answer_share): one row per document and item it holds.

    ``score`` is the BM25 score of the best verified passage as a share of the chunk's own score. Null and empty texts hold
    nothing; a repeated document row gives its rows again. Empty tables give no rows. Other columns are not read. Texts are
    read whole, at any length. Ids of either table may be of any plain type; items without id are not searched for.
    Among equal scores the first passage counts.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_col].dataType)
    schema = f"id {kind}, item {item_kind}, score double, first_word bigint, question_share double, answer_share double"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for index in indexes(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)  # at most SHARD_ITEMS items
        out = out.unionByName(map_batches(rows, lambda shared=shared: _pairs(shared, item_type), schema))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), *[n for n, _ in _PAIR_KINDS])


def documents_without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no test item, with all their columns; rows are dropped where they are read.

    Null and empty texts stay, repeated rows stay or go together, and whole texts are read at any length. With no items
    all documents stay. Columns may have any names, since they are numbered on the way.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields)]
    place = docs.columns.index(text_col)
    out = docs.toDF(*names)
    for index in indexes(items, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            index = shared.value
            ids = _Ids(index.vocabulary)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = [t.as_py() or "" for t in batch.column(place).cast(pa.string())]
                leaking = {row for row, *_ in leaks_in(texts, index, ids)}
                return batch.filter(pa.array([i not in leaking for i in range(batch.num_rows)]))

            return work

        out = map_batches(out, make, ", ".join(kinds))
    return out.toDF(*docs.columns)
