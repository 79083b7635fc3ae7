"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are tagged as begin, inside or outside of a secret from their shape, their neighbours and features of
the file, decoded by Viterbi. The field is trained here: the fixed patterns label all documents; a bounded sample
of those with a span, whose secrets are also replaced by made-up ones of other alphabets, and one of those without
are learned from.

One constraint is part of the field: "inside" needs a token that touches the one before, so a secret lies in one
white-space word. Any token may begin one. All tokens of a batch are scored at once; a line is decoded unless the
learned weights prove that all "outside" is its best path: every word's best gain over "outside" is below zero.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.llm.common import hash_order_sample, map_batches, materialize, seeded

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so short ones need no look
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: Documents with a base span, and as many without, that training sees at most, drawn by hash out of all data; lines of
#: one of them; characters of a line.
TRAIN_DOCS = 8000
TRAIN_LINES = 4
TRAIN_CHARS = 160
TRAIN_TOKENS = 32
#: Lines with and without secrets in training at most.
TRAIN_SECRETS, TRAIN_PLAIN = 700, 1000
ITERATIONS = 100
#: Tokens scored at once, about; single lines are not cut.
BLOCK_TOKENS = 200_000
#: Room for the rounding of sums taken in another order; more lines are decoded, none is lost.
_SLACK = 1e-6
_NEVER = -1e9

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Words that often stand before a secret.
KEYWORDS = frozenset(
    "password passwd pwd pass passphrase secret token key apikey api_key auth authorization bearer credential credentials "
    "private access signature sas hmac salt".split()
)
_KEYWORD_LIST = sorted(KEYWORDS)
SHAPES = (
    "edge", "lower", "capital", "upper", "upper_long", "number", "number_long", "mixed", "mixed_mid", "mixed_long",
    "hex_mid", "hex_long", "foreign", "keyword", "equals", "colon", "quote", "dash", "symbol",
)
_SHAPE = {name: i for i, name in enumerate(SHAPES)}
_SYMBOLS = {"=": "equals", ":": "colon", '"': "quote", "'": "quote", "-": "dash", "_": "dash", ".": "dash", "/": "dash", "+": "dash"}
LENGTHS, NEAR, GLUE, FILES = 7, 4, 2, 3
_BASES = np.cumsum([0, len(SHAPES), LENGTHS, len(SHAPES), len(SHAPES), len(SHAPES), NEAR, GLUE, FILES]).tolist()
B, I, O = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, each kind leftmost and without overlap; whole matches, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The characters of the base spans that are the secret itself."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    return out + [m.span() for m in HEX.finditer(text)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# Features


def shape(token: str) -> int:
    low = token.lower()
    if low in KEYWORDS:
        return _SHAPE["keyword"]
    if len(token) == 1 and not token.isalnum():
        return _SHAPE[_SYMBOLS.get(token, "symbol")]
    n = len(token)
    if not token.isascii():
        return _SHAPE["foreign"]
    if token.isdigit():
        return _SHAPE["number_long" if n >= 9 else "number"]
    if token.isalpha():
        if token.islower():
            return _SHAPE["lower"]
        if token.isupper():
            return _SHAPE["upper_long" if n >= 16 else "upper"]
        if token[0].isupper() and token[1:].islower():
            return _SHAPE["capital"]
        return _SHAPE["mixed_long" if n >= 20 else "mixed_mid" if n >= 10 else "mixed"]
    if n >= 12 and not low.strip("0123456789abcdef"):
        return _SHAPE["hex_long" if n >= 24 else "hex_mid"]
    return _SHAPE["mixed_long" if n >= 20 else "mixed_mid" if n >= 10 else "mixed"]


def _length(token: str) -> int:
    n = len(token)
    return 0 if n < 2 else 1 if n < 6 else 2 if n < 10 else 3 if n < 16 else 4 if n < 24 else 5 if n < 48 else 6


def file_class(text: str) -> int:
    """How much a text looks like code or settings."""
    marks = text.count("=") + text.count(";") + text.count("{")
    share = 1000 * marks / max(1, len(text))
    return 0 if share < 1 else 1 if share < 8 else 2


def encode(line: str, file: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Token spans of a line, per token one feature index of each group, and what the constraint adds per tag."""
    spans, shapes, rows, bars = [], [], [], []
    for m in TOKEN.finditer(line):
        spans.append(m.span())
        shapes.append(shape(m[0]))
    edge, key = _SHAPE["edge"], _SHAPE["keyword"]
    since = 99
    for i, (s, e) in enumerate(spans):
        near = 0 if since <= 2 else 1 if since <= 4 else 2 if since <= 7 else 3
        glued = int(i > 0 and spans[i - 1][1] == s)
        values = (
            shapes[i], _length(line[s:e]), shapes[i - 1] if i else edge, shapes[i - 2] if i > 1 else edge,
            shapes[i + 1] if i + 1 < len(spans) else edge, near, glued, file,
        )
        rows.append([b + v for b, v in zip(_BASES, values)])
        bars.append((0.0, 0.0 if glued else _NEVER, 0.0))
        since = 1 if shapes[i] == key else since + 1
    return spans, np.array(rows, np.int64).reshape(len(rows), 8), np.array(bars).reshape(len(rows), 3)


@dataclass
class Field:
    """Weights: features x tags, tags x tags; "inside" never follows "outside"."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, rows: np.ndarray, bars: np.ndarray) -> list[int]:
        """The best tag path; of equal ones the first tag in the order begin, inside, outside."""
        scores = (self.emit[rows].sum(1) + bars).tolist()
        move = self.move.T.tolist()
        best = [scores[0][B], _NEVER, scores[0][O]]
        back = []
        for row in scores[1:]:
            b, i, o = best
            best, came = [], []
            for (from_b, from_i, from_o), score in zip(move, row):
                x, y, z = b + from_b, i + from_i, o + from_o
                top, at = (x, B) if x >= y else (y, I)
                if z > top:
                    top, at = z, O
                best.append(top + score)
                came.append(at)
            back.append(came)
        path = [best.index(max(best))]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def train(lines: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Field:
    """Maximum likelihood by Adam, with forward-backward sums over padded lines; a little weight decay."""
    width = max(len(tags) for _, _, tags in lines)
    n, groups = len(lines), 8
    pad = _BASES[-1]
    x = np.full((n, width, groups), pad, np.int64)
    y = np.full((n, width), O)
    mask = np.zeros((n, width), bool)
    bars = np.zeros((n, width, 3))
    for i, (rows, bar, tags) in enumerate(lines):
        bars[i, : len(tags)] = bar
        bars[i, 0, I] = _NEVER
        x[i, : len(tags)], y[i, : len(tags)], mask[i, : len(tags)] = rows, tags, True
    emit, move = np.zeros((pad + 1, 3)), np.zeros((3, 3))
    move[O, I] = _NEVER
    state = [np.zeros(w.shape) for w in (emit, move, emit, move)]
    for step in range(1, ITERATIONS + 1):
        scores = emit[x].sum(2) + bars
        forward, backward = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        forward[:, 0] = scores[:, 0]
        for t in range(1, width):
            nxt = _log_sum(forward[:, t - 1, :, None] + move[None], 1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], nxt, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            nxt = _log_sum(move[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], nxt, 0.0)
        total = _log_sum(forward[:, -1], 1)
        chance = np.exp(np.minimum(forward + backward - total[:, None, None], 0.0)) * mask[:, :, None]
        wanted = np.eye(3)[y] * mask[:, :, None]
        g_emit = np.zeros_like(emit)
        diff = chance - wanted
        for g in range(groups):
            for tag in range(3):
                g_emit[:, tag] += np.bincount(x[:, :, g].ravel(), diff[:, :, tag].ravel(), pad + 1)
        both = mask[:, 1:]
        joint = forward[:, :-1, :, None] + move[None, None] + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        g_move = (np.exp(np.minimum(joint, 0.0)) * both[:, :, None, None]).sum((0, 1))
        np.add.at(g_move, (y[:, :-1][both], y[:, 1:][both]), -1.0)
        grads = [g_emit / n + 2e-4 * emit, g_move / n + 2e-4 * move]
        for k, (w, g) in enumerate(zip((emit, move), grads)):
            m, v = state[k], state[k + 2]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        emit[pad], move[O, I] = 0, _NEVER
    return Field(emit[:pad], move)


# Training lines


def _cut_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Batch of texts to training lines (line, starts, ends, file): lines with secrets, and some without."""
    out: list[tuple] = []
    for text in batch.column(0):
        body = text.as_py() or ""
        file, parts, at, kept, plain = file_class(body), secret_parts(body), 0, 0, 0
        for line in body.split("\n"):
            inside = [(s - at, e - at) for s, e in parts if s >= at and e <= at + len(line)]
            if inside and kept < TRAIN_LINES:
                low = max(0, inside[0][0] - TRAIN_CHARS // 2)
                piece = line[low : low + TRAIN_CHARS]
                fit = [(s - low, e - low) for s, e in inside if e - low <= len(piece)]
                if fit:
                    out.append((piece, [s for s, _ in fit], [e for _, e in fit], file))
                    kept += 1
            elif not inside and plain < TRAIN_LINES and line and (plain == 0 or any(map(str.isdigit, line))):
                low = max(0, next((i for i, c in enumerate(line) if c.isdigit()), 0) - TRAIN_CHARS // 2)
                out.append((line[low : low + TRAIN_CHARS], [], [], file))
                plain += 1
            at += len(line) + 1
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
    columns = list(zip(*out)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["line", "starts", "ends", "file"])


_ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
    "0123456789abcdefghijklmnopqrstuvwxyz-",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "abcdefghijklmnopqrstuvwxyz---",
    "abcdefghijklmnopqrstuvwxyzäöüßéèñçøåABCDEFGHIJKLMNOPQRSTUVWXYZ",
)


def _example(line: str, parts: list[tuple[int, int]], file: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    spans, rows, bars = encode(line, file)
    if not spans:
        return None
    tags = np.full(len(spans), O)
    for s, e in sorted(parts):
        last = None
        for i, (a, b) in enumerate(spans):
            if a >= s and b <= e:
                if last is None:
                    tags[i], last = B, i
                elif last == i - 1 and bars[i, I] == 0:
                    tags[i], last = I, i
    if len(tags) > TRAIN_TOKENS:
        at = max(0, int((tags == B).argmax()) - TRAIN_TOKENS // 2)
        rows, bars, tags = (a[at : at + TRAIN_TOKENS] for a in (rows, bars, tags))
    return rows, bars, tags


def _mark(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Batch of (h, text) to (h, labelled): whether the text holds a base span."""
    found = pa.array([bool(base_spans(t.as_py())) for t in batch.column(1)], pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column(0), found], ["h", "labelled"])


def drawn_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text): at most TRAIN_DOCS texts with a base span and as many without; equal rows count once."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("h"), "text")
    marks = map_batches(rows, lambda: _mark, "h bigint, labelled boolean").distinct()
    marks = materialize(marks, "secret-marks")
    sizes = {r["labelled"]: r["count"] for r in marks.groupBy("labelled").count().collect()}
    parts = [
        hash_order_sample(marks.where(F.col("labelled") == kind).select("h"), F.col("h"), TRAIN_DOCS, sizes.get(kind, 0))
        for kind in (True, False)
    ]
    drawn = materialize(parts[0].unionByName(parts[1]).distinct(), "secret-sample")
    # At most twice TRAIN_DOCS short rows, so they can go to every task; equal rows meet by partial aggregation.
    return rows.join(F.broadcast(drawn), "h").groupBy("h").agg(F.max("text").alias("text")).select("text")


def fit(docs: DataFrame, id_col: str, text_col: str) -> Field | None:
    """Train on the drawn documents; None where the fixed patterns find nothing in any document."""
    drawn = drawn_texts(docs, id_col, text_col)
    schema = "line string, starts array<int>, ends array<int>, file int"
    got = map_batches(drawn, lambda: _cut_lines, schema).collect()
    got.sort(key=lambda r: (r["line"], r["file"]))
    rng = seeded(3)
    got = [got[i] for i in rng.permutation(len(got))]
    held = [r for r in got if r["starts"]][:TRAIN_SECRETS] + [r for r in got if not r["starts"]][:TRAIN_PLAIN]
    examples, plain = [], []
    for r in held:
        parts = list(zip(r["starts"], r["ends"]))
        made = _example(r["line"], parts, r["file"])
        if made is None:
            continue
        if not parts:
            plain.append(made)
            continue
        examples.append(made)
        s, e = parts[0]
        for k, alphabet in enumerate(_ALPHABETS):  # another secret, in the same place or after another keyword
            size = int(rng.integers(8, 36))
            fake = "".join(rng.choice(list(alphabet), size))
            left = r["line"][:s]
            if k % 2:
                quote = str(rng.choice(["", '"', "'"]))
                left = left[: left.rfind(" ", 0, max(0, s - 12)) + 1] + str(rng.choice(_KEYWORD_LIST))
                left += str(rng.choice([" = ", "=", ": ", " "])) + quote
            made = _example(left + fake + r["line"][e:], [(len(left), len(left) + size)], r["file"])
            if made is not None:
                examples.append(made)
    if not examples:
        return None
    # Few secrets would drown in plain lines; both sides are bounded.
    some = rng.permutation(len(examples))[:TRAIN_SECRETS]
    rest = rng.permutation(len(plain))[:TRAIN_PLAIN]
    return train([examples[i] for i in some] + [plain[i] for i in rest])


# Scan


class _Words(dict):
    """Number of a white-space word, given when first seen; shape and length class of the tokens of all words."""

    def __init__(self) -> None:
        super().__init__()
        self.codes: list[int] = []
        self.starts = [0]

    def __missing__(self, word: str) -> int:
        self.codes += [shape(m[0]) * LENGTHS + _length(m[0]) for m in TOKEN.finditer(word)]
        self.starts.append(len(self.codes))
        self[word] = number = len(self.starts) - 2
        return number


class Scanner:
    """Decodes the lines of texts for which all "outside" is not proven to be the best path."""

    def __init__(self, field: Field) -> None:
        self.field, self.words = field, _Words()
        gain = field.emit[:, :2] - field.emit[:, 2:]
        part = [gain[x:y] for x, y in zip(_BASES, _BASES[1:])]
        self.own = (part[0][:, None] + part[1][None]).reshape(-1, 2)
        self.before = (part[2][:, None] + part[3][None]).reshape(-1, 2)
        self.after = (part[4][:, None, None, None] + part[5][:, None, None] + part[6][:, None] + part[7]).reshape(-1, 2)
        # Moves against staying outside: into a tag at most, and out of a secret at most; a line's ends have none.
        move = field.move - field.move[O, O]
        self.into = np.array([max(0.0, move[:, B].max()), max(move[B, I], move[I, I])])
        self.leave = max(0.0, move[B, O], move[I, O])

    def open_lines(self, words: list[int], sizes: list[int], files: list[int]) -> np.ndarray:
        """Which of the lines need decoding; ``words`` in a row, words of each line, file class of each line."""
        out = np.zeros(len(sizes), bool)
        if not words:
            return out
        number = np.array(words, np.int64)
        starts = np.array(self.words.starts, np.int64)
        codes = np.array(self.words.codes, np.int64)
        long = starts[number + 1] - starts[number]
        word_at = np.cumsum(long) - long
        total = int(long.sum())
        index = np.arange(total)
        code = codes[np.repeat(starts[number] - word_at, long) + index]
        shapes = code // LENGTHS
        line_of_word = np.repeat(np.arange(len(sizes)), sizes)
        line = np.repeat(line_of_word, long)
        first = np.searchsorted(line, line)
        edge = _SHAPE["edge"]
        one, two, nxt = (np.full(total, edge) for _ in range(3))
        one[1:], two[2:], nxt[:-1] = shapes[:-1], shapes[:-2], shapes[1:]
        one[index == first] = edge
        two[index - first < 2] = edge
        nxt[:-1][line[1:] != line[:-1]] = edge
        key = np.maximum.accumulate(np.where(shapes == _SHAPE["keyword"], index, -99))
        last = np.full(total, -99)
        last[1:] = key[:-1]
        since = np.where(last >= first, index - last, 99)
        near = np.searchsorted([2, 4, 7], since)
        glued = np.ones(total, np.int64)
        glued[word_at] = 0
        after = ((nxt * NEAR + near) * GLUE + glued) * FILES + np.array(files, np.int64)[line]
        gain = self.own[code] + self.before[one * len(SHAPES) + two] + self.after[after] + self.into
        # A secret is one "begin" and then "inside" tokens of one word: no path through a word gains more than this.
        inside = np.where(glued == 1, np.maximum(gain[:, I], 0.0), 0.0)
        most = np.maximum.reduceat(gain[:, B], word_at) + np.add.reduceat(inside, word_at) + self.leave
        out[line_of_word[most > -_SLACK]] = True
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Per text the spans that the field tags, in code points."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        words: list[int] = []
        sizes: list[int] = []
        files: list[int] = []
        lines: list[tuple[int, int, str]] = []

        def flush() -> None:
            for k in np.nonzero(self.open_lines(words, sizes, files))[0].tolist():
                doc, at, line = lines[k]
                found[doc] += [(at + s, at + e) for s, e in line_spans(line, self.field, files[k])]
            for held in (words, sizes, files, lines):
                held.clear()
            if len(self.words) > 200_000:  # only a cache: bounded, and made anew
                self.words = _Words()

        for doc, text in enumerate(texts):
            at, file = 0, file_class(text)
            for line in text.split("\n"):
                parts = line.split()
                if parts:
                    words.extend(map(self.words.__getitem__, parts))
                    sizes.append(len(parts))
                    files.append(file)
                    lines.append((doc, at, line))
                    if len(words) >= BLOCK_TOKENS:
                        flush()
                at += len(line) + 1
        flush()
        return found


def line_spans(line: str, field: Field, file: int) -> list[tuple[int, int]]:
    """Spans that the field tags in one line, decoded whole."""
    out: list[tuple[int, int]] = []
    spans, rows, bars = encode(line, file)
    if not spans:
        return out
    tags = field.decode(rows, bars)
    i = 0
    while i < len(tags):
        if tags[i] == B:
            j = i + 1
            while j < len(tags) and tags[j] == I and spans[j - 1][1] == spans[j][0]:
                j += 1
            out.append((spans[i][0], spans[j - 1][1]))
            i = j
        else:
            i += 1
    return out


def _scan(field: Field | None):
    scanner = Scanner(field) if field is not None else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, spans = [[], [], []], [], []
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tagged = scanner.spans(texts) if scanner is not None else [[] for _ in texts]
        for body, more in zip(texts, tagged):
            base = base_spans(body)
            every = base
            if more:
                added = [(s, 3, e) for s, e in more if not any(s < y and x < e for x, _, y in base)]
                every = sorted(base + added)
            for k in range(3):
                counts[k].append(sum(kind == k for _, kind, _ in base))
            hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return work


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans): one row per input row.

    ``spans`` lists kind:start:end of the fixed patterns and, as ``crf``, what the field adds outside of them,
    by start and then kind. A null or empty text has no spans. Where no document has a base span,
    only the fixed patterns are listed, which then find nothing. Repeated rows get equal results; an empty table gives no rows. Other
    columns are not read.
    """
    field = fit(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_batches(rows, lambda: _scan(field), schema).withColumnRenamed("id", id_col)
