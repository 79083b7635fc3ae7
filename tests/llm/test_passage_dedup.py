"""Repeated passages against a table of all of them."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from tillweave.llm import passage_dedup
from tillweave.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(texts, length=200):
    """(bytes, removed, stretches, kept) of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        out.append((len(t), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), np.frombuffer(t, np.uint8)[~mask].tobytes()))
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)

    def prose(n, letters="abcdefgh é"):
        return "".join(draw.choice(letters) for _ in range(n))

    shared = [prose(n) for n in (150, 199, 200, 201, 260, 500)]
    out = []
    for _ in range(60):
        parts = [prose(draw.choice([0, 1, 30, 250, 700]))]
        for _ in range(draw.randint(0, 3)):
            whole = draw.choice(shared)
            at = draw.choice([0, 0, 40])
            parts += [whole[at : at + draw.choice([150, 220, 600])], prose(draw.choice([0, 5, 120]))]
        out.append("".join(parts))
    near = prose(900)
    for _ in range(12):
        at = draw.randrange(900)
        out.append(near[:at] + "Z" + near[at + 1 :])
    out += [prose(400)] * 2 + ["a" * 700, "ab" * 300, "a" * 199, "a" * 200, "b" * 200, "", None, shared[2], "é" * 150, prose(600, "ab")]
    return out


@pytest.mark.parametrize("chunk, held", [(20_000, 30_000), (3, 2)])
def test_equals_a_table_of_all_passages(spark, monkeypatch, texts, chunk, held):
    monkeypatch.setattr(passage_dedup, "CHUNK", chunk)  # 3: crowded heads are dealt on, down to whole passages
    monkeypatch.setattr(passage_dedup, "HELD", held)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in passage_dedup.drop_repeated_passages(docs).collect()}
    want = brute([(t or "").encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[2] for w in want) > 60 and max(w[2] for w in want) > 1


def test_triggers_follow_from_the_passage_alone():
    draw = random.Random(2)
    body = bytes(draw.choice(b"abc") for _ in range(3000))
    place, first, last = passage_dedup.triggers(body)
    assert first[0] == 0 and last[-1] == len(body) - 200 and (first[1:] == last[:-1] + 1).all()
    for i in range(0, len(body) - 200, 37):
        at = place[np.searchsorted(last, i)]
        alone = passage_dedup.triggers(body[i : i + 200])[0]
        assert alone.tolist() == [at - i] and 0 <= at - i <= 200 - passage_dedup.HEAD
    assert all(len(c) == 0 for c in passage_dedup.triggers(body[:199]))


def test_query_equals_brute_force(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY 1").fetchall()
    want = brute([t.encode() for _, t in rows])
    got = {r["doc_id"]: r for r in QUERIES["op13_passage_dedup"](spark, SMALL).collect()}
    assert len(got) == len(rows) and sum(w[1] for w in want) > 0
    for (i, _), (size, removed, spans, kept) in zip(rows, want):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, removed, spans, hashlib.sha256(kept).hexdigest())


def test_repeated_rows_nulls_and_clashing_names(spark):
    draw = random.Random(4)
    one, two = ("".join(draw.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    rows = [(1, one), (1, one), (2, "x" + two), (None, two), (None, None), (3, ""), (1, "short")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    docs = docs.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(["id", "slot", "check", "head", "name", "place", "phrase", "spans", "group", "kept"])])
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in passage_dedup.drop_repeated_passages(docs).collect())
    want = [("1", 5, 0, 0, b"short"), ("1", 300, 300, 1, b""), ("1", 300, 300, 1, b""), ("2", 301, 300, 1, b"x"), ("3", 0, 0, 0, b"")]
    assert got == [*want, ("None", 0, 0, 0, b""), ("None", 300, 300, 1, b"")]
    assert passage_dedup.drop_repeated_passages(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="needs more"):
        passage_dedup.drop_repeated_passages(docs, length=20)
