"""Language identification by a byte convolutional network trained here in numpy.

Texts are cut into fixed-length byte windows. Filters of several widths run over the bytes, the largest response
of each filter in a window is kept, and a softmax layer gives languages. A document's logits are the mean
over its windows, weighted by their letters, so whole texts count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.llm.common import crc_share, map_batches, seeded

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Documents per language, and windows of one of them, that training sees at most.
TRAIN_DOCS = 500
TRAIN_WINDOWS = 6
EPOCHS = 8
UNKNOWN = "und"
#: A text goes as one in no language if the network is this sure of it.
REJECT_SCORE = 0.98

_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: Bytes that count as letters for the weight of a window: ASCII letters and all of multi-byte characters.
_LETTERS = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])


@dataclass
class Network:
    """Filter weights by width, offset, byte and filter; then biases, output weights and languages."""

    taps: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    langs: list[str]


def windows_of(text: bytes) -> np.ndarray:
    """The flat bytes of a text, padded with zeros to whole windows with room for the widest filter."""
    spare = max(WIDTHS) - 1
    count = max(1, -(-(len(text) + spare) // WINDOW))
    flat = np.zeros(count * WINDOW, np.uint8)
    flat[: len(text)] = np.frombuffer(text.translate(_TO_LOWER), np.uint8)
    return flat


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 11) -> Network:
    """Fit by Adam on windows of WINDOW + spare bytes each; the gradient reaches only the largest responses."""
    rng = seeded(seed)
    n, classes, total = len(windows), len(langs), FILTERS * len(WIDTHS)
    taps = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(total, np.float32)
    out = rng.normal(0, 0.3, (total, classes)).astype(np.float32)
    out_bias = np.zeros(classes, np.float32)
    weights = [*taps, bias, out, out_bias]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            chosen = order[at : at + 128]
            x, y = windows[chosen], labels[chosen]
            rows = np.arange(len(x))
            peaks, spots = [], []
            for tap in taps:
                response = sum(tap[j][x[:, j : j + WINDOW]] for j in range(len(tap)))
                spot = response.argmax(1)
                spots.append(spot)
                peaks.append(np.take_along_axis(response, spot[:, None, :], 1)[:, 0])
            before = np.concatenate(peaks, 1) + bias
            hidden = np.maximum(before, 0)
            logits = hidden @ out + out_bias
            shift = np.exp(logits - logits.max(1, keepdims=True))
            wrong = shift / shift.sum(1, keepdims=True)
            wrong[rows, y] -= 1
            wrong /= len(x)
            back = (wrong @ out.T) * (before > 0)
            grads = [np.zeros_like(t) for t in taps]
            for k, (grad, spot) in enumerate(zip(grads, spots)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(grad)):
                    seen = np.take_along_axis(x, spot + j, 1)
                    np.add.at(grad[j], (seen, np.arange(FILTERS)[None, :]), part)
            grads += [back.sum(0), hidden.T @ wrong + 1e-4 * out, wrong.sum(0)]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w -= 0.02 / (1 + epoch) ** 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Network(taps, bias, out, out_bias, langs)


class Predictor:
    """The network with its taps summed to tables over byte pairs, so that a position takes few look-ups."""

    def __init__(self, net: Network) -> None:
        self.net = net
        two, three, four = net.taps
        pair = [(t[0][:, None, :] + t[1][None, :, :]).reshape(65536, FILTERS) for t in (two, three, four)]
        self.lead = np.ascontiguousarray(np.concatenate(pair, 1))
        self.third = np.ascontiguousarray(three[2])
        self.tail = np.ascontiguousarray((four[2][:, None, :] + four[3][None, :, :]).reshape(65536, FILTERS))

    def logits(self, flat: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """Logits of each window of a flat run of whole windows; past the end of its text a filter sees zeros."""
        out = np.empty((len(flat) // WINDOW, self.lead.shape[1]), np.float32)
        ends = np.array([len(flat)]) if ends is None else ends
        after = []
        for ahead in range(1, max(WIDTHS)):
            moved = np.roll(flat, -ahead)
            for back in range(1, ahead + 1):
                moved[ends - back] = 0
            after.append(moved)
        pairs = (flat.astype(np.int32) << 8) | after[0]
        tails = (after[1].astype(np.int32) << 8) | after[2]
        for at in range(0, len(flat), 64 * WINDOW):
            here = slice(at, at + 64 * WINDOW)
            response = self.lead.take(pairs[here], 0)
            response[:, FILTERS : 2 * FILTERS] += self.third.take(after[1][here], 0)
            response[:, 2 * FILTERS :] += self.tail.take(tails[here], 0)
            first, count = at // WINDOW, len(response) // WINDOW
            response.reshape(-1, WINDOW, response.shape[1]).max(1, out=out[first : first + count])
        hidden = np.maximum(out + self.net.bias, 0)
        return hidden @ self.net.out + self.net.out_bias

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        flats = [windows_of(t) for t in texts]
        flat = np.concatenate(flats)
        ends = np.cumsum([len(f) for f in flats])
        logits = self.logits(flat, ends)
        weight = _LETTERS[flat].reshape(-1, WINDOW).sum(1).astype(np.float64)
        starts = np.concatenate([[0], ends[:-1]]) // WINDOW
        sums = np.add.reduceat(logits.astype(np.float64) * weight[:, None], starts, 0)
        mean = sums / np.maximum(np.add.reduceat(weight, starts), 1)[:, None]
        shift = np.exp(mean - mean.max(1, keepdims=True))
        share = shift / shift.sum(1, keepdims=True)
        best = share.argmax(1)
        # Rounded, as sums of other texts' neighbours may differ in the last bits.
        return [(self.net.langs[b], round(float(share[i, b]), 6)) for i, b in enumerate(best)]


def _training_windows(per_doc: int):
    """Batch of (lang, text) to rows (lang, window): evenly spaced windows, with bytes ahead for the filters."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, out = [], []
        for lang, text in zip(*batch.columns):
            flat = windows_of(text.as_py() or b"")
            count = len(flat) // WINDOW
            flat = np.concatenate([flat, np.zeros(max(WIDTHS), np.uint8)])
            for k in sorted({round(x) for x in np.linspace(0, count - 1, min(per_doc, count))}):
                langs.append(lang.as_py())
                out.append(flat[k * WINDOW : (k + 1) * WINDOW + max(WIDTHS) - 1].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    return work


def no_language(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows in no language at hand, made from others: the bytes of the words in any order, made-up words, and
    letters of any script."""
    out = windows.copy()
    third = len(out) // 3
    for row in out[:third]:
        inside = np.flatnonzero(row > 32)
        row[inside] = rng.permutation(row[inside])
    words = out[third : 2 * third]
    made = rng.integers(97, 123, words.shape).astype(np.uint8)
    words[:] = np.where(rng.random(words.shape) < 0.15, 32, made) * (words > 0)
    for row in out[2 * third :]:
        size = int((row > 0).sum())
        block = 2 ** int(rng.integers(4, 11))
        low = int(rng.integers(0x370, 0xD000))
        letters = "".join(map(chr, rng.integers(low, min(low + block, 0xD7FF), size))).encode()[:size]
        row[:] = 0
        row[: len(letters)] = np.frombuffer(letters, np.uint8)
    return out


def fit(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", reject: bool = False
) -> Network | None:
    """Train on at most TRAIN_DOCS documents a language, those with the smallest id hash; None without labels.

    The number of languages is the number of distinct labels. One more round of short windows is added, so that
    short texts are known too. With ``reject`` the network learns ``und`` as well, from windows in no language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
        F.xxhash64(F.col(id_col)).alias("h"),
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    # A threshold on the hash leaves about TRAIN_DOCS of each language; the ordered limit makes it a bound.
    top = {k: min(2**63 - 1, -(2**63) + int(TRAIN_DOCS / counts[k] * 2**64)) for k in langs}
    limits = [x for k in langs for x in (F.lit(k), F.lit(top[k]))]
    drawn = rows.where(F.col("h") <= F.create_map(*limits)[F.col("lang")])
    drawn = drawn.orderBy("h", "lang").limit(2 * TRAIN_DOCS * len(langs)).select("lang", "text")
    got = map_batches(drawn, lambda: _training_windows(TRAIN_WINDOWS), "lang string, window binary").collect()
    windows = np.frombuffer(b"".join(r["window"] for r in got), np.uint8).reshape(len(got), -1)
    labels = np.array([langs.index(r["lang"]) for r in got])
    rng = seeded(5)
    if reject:
        other = no_language(windows[rng.permutation(len(windows))[: max(3, len(windows) // 2)]], rng)
        windows, labels = np.concatenate([windows, other]), np.concatenate([labels, np.full(len(other), len(langs))])
        langs = [*langs, UNKNOWN]
    short = windows.copy()
    keep = rng.integers(12, 160, len(short))
    short[np.arange(short.shape[1])[None, :] >= keep[:, None]] = 0
    return train(np.concatenate([windows, short]), np.concatenate([labels, labels]), langs)


def _predict(net: Network | None):
    predictor = Predictor(net) if net is not None else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if predictor else []
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = 0
        while at < len(known):
            group, size = [], 0
            while at < len(known) and (not group or size < 1 << 21):
                group.append(known[at])
                size += len(texts[known[at]])
                at += 1
            for i, (lang, score) in zip(group, predictor.predict([texts[i].encode() for i in group])):
                langs[i], scores[i] = lang, score
        made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "lang_pred", "score"])

    return work


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held_part: int = 2
) -> DataFrame:
    """(id, held_out, lang_pred, score): one row per input row.

    The network learns from rows whose crc32 of the id modulo ``parts`` is not ``held_part`` and whose text and
    language are not null. ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter (as
    Unicode counts letters), and for all rows where nothing is labelled. Ties go to the first language by name.
    Null ids fall in part 0. Repeated rows get equal results; an empty table gives no rows.
    """
    held = crc_share(F.col(id_col), parts) == held_part
    net = fit(docs.where(~held), lang_col, text_col, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(rows, lambda: _predict(net), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def documents_in_a_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents in one of the labelled languages, as the network sees it; those that it is sure to be in none go.

    For this the network learns one more answer, from windows that are in no language: mixed-up bytes, made-up words,
    letters of any script. Texts that are null or have no letter, as Unicode counts letters, go too. Very long texts are
    read whole. Rows that repeat an id or a text are judged alike, also without an id. Where nothing is labelled, only
    texts without a letter go. An empty table gives no rows. All columns stay as they are, whatever their names.
    """
    held = crc_share(F.col(id_col), 4) == 2
    net = fit(docs.where(~held), lang_col, text_col, id_col, reject=True)
    if net is None:  # nothing to learn from
        return docs.where(F.col(text_col).rlike(r"\p{IsAlphabetic}"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields)]
    rows = docs.toDF(*names)
    rows = rows.select(*names, F.col(names[docs.columns.index(text_col)]).cast("string").alias("text"))
    out = map_batches(rows, lambda: _predict(net), ", ".join([*kinds, "lang_pred string", "score double"]))
    none = (F.col("lang_pred") == UNKNOWN) & ((F.col("score") == 0) | (F.col("score") >= REJECT_SCORE))
    return out.where(~none).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
