"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

A bounded sample of labelled rows is cut by a hash of the id into three folds: one gives the learned part of the
lexicon, one the trees, one the calibration. Every document is then scored whole, in the tasks.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.llm.common import crc_share, hash_order_sample, map_batches, materialize

#: Labelled rows that training sees at most, those with the smallest id hash.
TRAIN_ROWS = 20_000
#: Words the learned lexicon holds at most; toxic documents a word needs; log-odds it needs.
LEXICON_WORDS = 400
LEXICON_DOCS = 4
LEXICON_ODDS = 1.5
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
#: Tokens between a lexicon word and a second-person word that count as near.
NEAR = 6

# Common insults, and second-person words of the languages at hand.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers clown scum trash garbage pathetic worthless disgusting "
    "ugly hate kill die shut freak jerk creep liar fool fools pig rat vermin filth imbecile cretin".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur youre you're du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros su".split()
)
#: Characters that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "-": "", ".": "", "_": ""})

FEATURES = (
    "insult_rate", "insults", "learned_rate", "learned_hits", "learned_weight", "learned_top", "distinct_hits", "hidden_rate",
    "near_second_person", "second_person_rate", "capital_rate", "shout_rate", "exclaim_rate", "question_rate", "punct_run_rate",
    "mixed_rate", "stretched_rate", "log_words", "mean_word",
)

_EDGES = string.whitespace + string.punctuation + "“”‘’«»¿¡…"
_RUN = re.compile(r"[!?#$*&]{2,}")
_STRETCH = re.compile(r"(\w)\1{2,}")


def bare(token: str) -> str:
    """A token in lower case, without punctuation at its ends."""
    return token.strip(_EDGES).lower()


class _Tokens(dict):
    """Facts per raw token, made when first seen: learned weight, insult, second person, hidden, mixed, shout, stretched."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple:
        word = bare(token)
        weight, insult, hidden = self.lexicon.get(word, 0.0), word in INSULTS, False
        mixed = len(word) > 2 and not word.isalpha() and any(map(str.isalpha, word))
        if not weight and not insult and mixed:
            plain = word.translate(LOOKALIKES)
            if plain != word and (plain in self.lexicon or plain in INSULTS):
                weight, insult, hidden = self.lexicon.get(plain, 0.0), plain in INSULTS, True
        shout = len(word) > 2 and token.isupper()
        fact = (weight, insult, word in SECOND_PERSON, hidden, mixed, shout, bool(_STRETCH.search(word)))
        if len(self) > 300_000:  # only a cache: bounded, and made anew
            self.clear()
        self[token] = fact
        return fact


def features(text: str, tokens: _Tokens) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    chars = max(1, len(text))
    facts = list(map(tokens.__getitem__, words))
    hits = [(i, f) for i, f in enumerate(facts) if f[0] or f[1]]
    second = [i for i, f in enumerate(facts) if f[2]]
    near = 0
    if hits and second:
        at = np.array(second)
        for i, _ in hits:
            k = np.searchsorted(at, i)
            near += any(0 <= j < len(at) and abs(int(at[j]) - i) <= NEAR for j in (k - 1, k))
    weights = [f[0] for _, f in hits if f[0]]
    insults = sum(f[1] for _, f in hits)
    capitals = sum(map(str.isupper, text))
    return [
        insults / n, min(insults, 50), len(weights) / n, min(len(weights), 50), sum(weights) / n, max(weights, default=0.0),
        min(50, len({bare(words[i]) for i, _ in hits})), sum(f[3] for _, f in hits) / n,
        near / n, len(second) / n, capitals / chars, sum(f[5] for f in facts) / n,
        text.count("!") / chars, text.count("?") / chars, len(_RUN.findall(text)) / n,
        sum(f[4] for f in facts) / n, sum(f[6] for f in facts) / n, float(np.log1p(len(words))), chars / n,
    ]


# Trees


@dataclass
class Trees:
    """Complete trees of one depth as arrays: feature and cut of each inner node, value of each leaf."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting on quantile histograms."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)
    share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    margin = np.full(n, np.log(share / (1 - share)))
    trees: list[tuple] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        inner = 2**DEPTH - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            local = node - first
            best = np.full(wide, 1e-6)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                slots = local * (BINS + 1) + binned[:, k]
                g = np.bincount(slots, grad, wide * (BINS + 1)).reshape(wide, -1).cumsum(1)
                h = np.bincount(slots, hess, wide * (BINS + 1)).reshape(wide, -1).cumsum(1)
                gl, hl, ga, ha = g[:, : len(e)], h[:, : len(e)], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(hl < 2) | (ha - hl < 2)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(wide), top]
                better = value > best
                best[better] = value[better]
                feature[first : first + wide][better] = k
                cut[first : first + wide][better] = e[top[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf_at = node - inner
        leaf = RATE * np.bincount(leaf_at, grad, inner + 1) / (np.bincount(leaf_at, hess, inner + 1) + 1)
        margin += leaf[leaf_at]
        trees.append((feature, cut, leaf))
    return Trees(float(np.log(share / (1 - share))), *(np.stack(c) for c in zip(*trees)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the non-decreasing shares of label 1 at them, for interpolation."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, rows, lowest and highest margin
    for m, label in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([label, 1, m, m])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at, share = [], []
    for total, rows, low, high in blocks:
        # One half-row of each label keeps small end blocks off 0 and 1.
        value = (total + 0.5) / (rows + 1)
        at += [low, high]
        share += [value, value]
    return np.array(at), np.maximum.accumulate(np.array(share))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    at: np.ndarray
    share: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), self.at, self.share), 0.0, 1.0)


# Spark jobs


def _words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Batch of (text, toxic) to rows (word, toxic), words distinct inside a text."""
    words, toxic = [], []
    for text, label in zip(*batch.columns):
        found = set(map(bare, (text.as_py() or "").split())) - {""}
        words.extend(found)
        toxic.extend([label.as_py()] * len(found))
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words with their log-odds of toxic against other documents, from rows (text, toxic)."""
    sizes = rows.groupBy("toxic").count().collect()
    toxic = sum(r["count"] for r in sizes if r["toxic"] == 1)
    clean = sum(r["count"] for r in sizes if r["toxic"] != 1)
    counts = map_batches(rows, lambda: _words, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("all")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("all") - F.col("t") + 0.5) / (clean + 1))
    found = counts.where(F.col("t") >= LEXICON_DOCS).select("word", "t", odds.alias("odds")).where(F.col("odds") >= LEXICON_ODDS)
    top = found.orderBy(F.desc(F.col("t") * F.col("odds")), "word").limit(LEXICON_WORDS).collect()
    return {r["word"]: float(r["odds"]) for r in top}


def _feature_rows(lexicon: dict[str, float]):
    tokens = _Tokens(lexicon)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(t.as_py() or "", tokens) for t in batch.column(0)]
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(made, pa.list_(pa.float64()))], ["fold", "toxic", "x"])

    return work


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Train on at most TRAIN_ROWS labelled rows; None if both labels aren't there.

    Repeated label rows count once, toxic if any says so. Null labels and labels without document are not used.
    """
    clean = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    clean = clean.groupBy(F.col(id_col).alias("label_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    drawn = materialize(hash_order_sample(clean, F.col("label_id"), TRAIN_ROWS, clean.count()), "toxicity-labels")
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text"))
    # The drawn labels are at most TRAIN_ROWS short rows, so they can go to every task.
    rows = texts.join(F.broadcast(drawn), "label_id").withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "label_id"), F.lit(20)).cast("int"))
    # Rows that repeat an id meet by partial aggregation: one text a label.
    rows = rows.groupBy("label_id", "toxic", "fold").agg(F.max("text").alias("text"))
    rows = materialize(rows, "toxicity-sample")
    lexicon = learn_lexicon(rows.where(F.col("fold") < 9).select("text", "toxic"))
    made = map_batches(
        rows.where(F.col("fold") >= 9).select("text", "fold", "toxic"), lambda: _feature_rows(lexicon), "fold int, toxic int, x array<double>"
    ).collect()
    made.sort(key=lambda r: (r["fold"], r["x"], r["toxic"]))
    x = np.array([r["x"] for r in made]).reshape(len(made), len(FEATURES))
    y = np.array([r["toxic"] for r in made], np.float64)
    trees_part = np.array([r["fold"] < 16 for r in made], bool)
    if not (len(set(y[trees_part])) == 2 and len(set(y[~trees_part])) == 2):
        return None
    trees = boost(x[trees_part], y[trees_part])
    return Model(lexicon, trees, *isotonic(trees.margin(x[~trees_part]), y[~trees_part]))


def _score(model: Model | None):
    tokens = _Tokens(model.lexicon) if model else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None:
            score = np.zeros(batch.num_rows)
        else:
            score = model.score(np.array([features(t.as_py() or "", tokens) for t in batch.column(2)]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["id", "held_out", "score"])

    return work


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    parts: int = 3,
    held_part: int = 1,
) -> DataFrame:
    """(id, held_out, score, predicted): one row per input row.

    Labels are learned only from rows whose crc32 of the id modulo ``parts`` is not ``held_part``; label, language,
    source and id are no inputs of a score. Null and empty texts are scored as texts without words. Without labels of
    both kinds all scores are 0. Repeated texts get equal scores; null ids fall in part 0; an empty table gives no rows.
    """
    model = fit(docs, labels.where(crc_share(F.col(id_col), parts) != held_part), id_col, text_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        (crc_share(F.col(id_col), parts) == held_part).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    out = map_batches(rows, lambda: _score(model), f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
