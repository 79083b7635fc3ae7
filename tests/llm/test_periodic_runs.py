"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import pytest

from tillweave.llm import periodic_runs
from tillweave.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(words):
    n, runs = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                runs.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, q, length) for (start, length), q in runs.items())


def kept(words, runs):
    gone = {i for start, q, length in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    out = []
    for _ in range(60):
        letters, size, words = draw.choice([1, 2, 3, 30]), draw.choice([10, 60, 300, 600]), []
        while len(words) < size:
            base = [chr(97 + draw.randrange(letters)) for _ in range(draw.randint(1, 40))]
            words += (base * draw.randint(1, 9))[: draw.randint(1, 9 * len(base))]
        out.append(draw.choice([" ", "\n", "\t\x0b "]).join(words))
    return [*out, "a " * 2500, "a b " * 700 + "c " * 500, None, "", " \n", "b " * 23, "b " * 24, "x y z " * 8, "x y z " * 7]


@pytest.mark.parametrize("row_words", [8, 8192])
def test_runs_equal_a_scan_of_all_periods(spark, monkeypatch, texts, row_words):
    monkeypatch.setattr(periodic_runs, "ROW_WORDS", row_words)  # 8: every tile is a row of its own
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = (text or "").split()
        want = brute(words)
        assert [tuple(r) for r in got[i]["runs"]] == want, i
        assert got[i]["n_words"] == len(words) and got[i]["collapsed_text"] == kept(words, want)


def test_z_function():
    draw = random.Random(3)
    for _ in range(50):
        s = [draw.randrange(2) for _ in range(30)]
        z = periodic_runs.z_function(s, 20)
        assert z[1:] == [next((k for k in range(31 - i) if i + k == 30 or s[k] != s[i + k])) for i in range(1, 20)]


def test_repeated_rows_nulls_and_clashing_names(spark):
    run = "p q " * 20
    rows = [(1, run), (1, run), (1, "q " * 30), (None, run), (None, None), (2, "plain text")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS key", "2 AS runs", "3 AS id", "4 AS period", "5 AS start")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in periodic_runs.periodic_runs(docs).collect())
    two = [(0, 2, 40)]
    assert got == [(0, 0, [], ""), (0, 40, two, "p q"), (1, 30, [(0, 1, 30)], "q"), (1, 40, two, "p q"), (1, 40, two, "p q"), (2, 2, [], "plain text")]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    rows = QUERIES["op11_periodic_runs"](spark, SMALL).collect()
    assert len(rows) == len(texts) and any(r["n_runs"] > 1 for r in rows)
    for r in rows:
        words, mark = texts[r["doc_id"]].split(), zlib.crc32(str(r["doc_id"]).encode())
        if mark % 10 == 0 and words:
            a, g = mark // 10 % len(words), mark // 10
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        runs = brute(words)
        lines = "".join(f"{start},{length},{q}\n" for start, q, length in runs)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[2], x[1]), x[0], x[1]), default=(None,) * 3)
        assert (r["start"], r["period"], r["length"]) == best
        assert r["exponent_milli"] == (1000 * best[2] // best[1] if runs else None)


def test_strongest_is_exact_and_takes_the_first_of_ties(spark):
    runs = [(0, 10**9, 3 * 10**9 + 1), (5, 10**9 - 1, 3 * 10**9 - 2), (7, 2, 6), (9, 4, 24), (11, 5, 30)]
    df = spark.createDataFrame([(runs[:3],), (runs,)], f"runs {periodic_runs.RUNS}")
    got = [r["best"]["start"] for r in df.select(periodic_runs.strongest("runs").alias("best")).collect()]
    assert got == [5, 9]
