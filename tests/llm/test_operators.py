"""The operators against brute-force versions, public tokenizers and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tillweave.llm import decontam, langid, mixing, search, secrets, simhash, token_counts, toxicity, warc
from tillweave.llm.queries import ORACLES, QUERIES

SMALL, MEDIUM, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def rows_of(folder, name, columns="*"):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{folder}/{name}.parquet' ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = sorted(repr(tuple(dict(zip(names, r))[c] for c in sorted(names))) for r in cursor.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect()) == want


# 1


def test_token_counts_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.load_pieces()
    tok = Tokenizer(models.Unigram(pieces, 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    draw = random.Random(1)
    odd = "abc ▁\n\té日本 <s><0x0A>  the ing 😀́"
    texts = ["".join(draw.choice(odd) for _ in range(draw.randint(0, 60))) for _ in range(500)]
    texts += [t for _, t in rows_of(SMALL, "documents", "doc_id, text")] + ["x" * 5000, " " * 50]
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(token_counts.count_tokens(docs, pieces).collect())
    assert [got[i] for i in range(len(texts))] == want


def test_token_counts_ties_and_unknown_runs():
    # "ab" and "a"+"b" score alike: the longer piece, which starts first, stays.
    count = token_counts.Counter([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0)])
    assert count.text("ab") == 2
    assert count.text("a??b") == 4  # a run of unknown characters is one piece where bytes aren't known


# 2


def test_raked_shares_meet_their_targets(spark):
    draw = random.Random(2)
    cells = [(s, l, t, draw.randint(1, 900)) for s in "abc" for l in "xy" for t in "pq"] + [("a", "x", "r", 0)]
    targets = {"source": {"a": 1.0, "b": 1.0, "c": 2.0}, "lang": {"x": 0.3, "y": 0.7}}
    df = spark.createDataFrame(cells, "source string, lang string, topic string, base long")
    got = mixing.cell_weights(df, targets).collect()
    assert all(r["converged"] for r in got) and max(r["probability"] for r in got) <= 1 + 1e-12
    total = sum(r["base"] for r in got)
    for dim, wanted in targets.items():
        sums = defaultdict(float)
        for r in got:
            sums[r[dim]] += r["weight"]
        for name, share in wanted.items():
            assert sums[name] / total == pytest.approx(share / sum(wanted.values()), abs=1e-8)
    # Expected tokens of the sample have the same shares.
    kept = defaultdict(float)
    for r in got:
        kept[r["lang"]] += r["base"] * r["probability"]
    assert kept["x"] / sum(kept.values()) == pytest.approx(0.3, abs=1e-6)
    assert [r["probability"] for r in got if r["base"] == 0] == [1.0]


def test_targets_that_contradict_empty_cells_are_reported(spark):
    df = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], "source string, lang string, topic string, base long")
    got = mixing.cell_weights(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}).collect()
    assert not any(r["converged"] for r in got)


# 3


def brute_search(docs, k):
    counts = [Counter(w for w in map(search.bare, (t or "").split()) if w) for _, t in docs]
    df = Counter(w for c in counts for w in c)
    n, lengths = len(docs), [sum(c.values()) for c in counts]
    mean = sum(lengths) / n
    out = {}
    for at, (query, _) in enumerate(docs):
        if query % 20:
            continue
        found = []
        for other, (doc, _) in enumerate(docs):
            shared = [w for w in sorted(counts[at]) if w in counts[other]]
            if doc != query and shared:
                score = 0.0
                for w in shared:
                    tf = counts[other][w]
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[other] / mean))
                found.append((-round(score, 6), doc))
        out[query] = [(d, -s) for s, d in sorted(found)[:k]]
    return out


def test_search_equals_brute_force(spark):
    docs = rows_of(SMALL, "documents", "doc_id, text")
    got = defaultdict(list)
    for r in QUERIES["op3_top_k_search"](spark, SMALL).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    assert dict(got) == {q: v for q, v in brute_search(docs, 10).items() if v}


def test_shard_pruning_is_exact():
    draw = np.random.default_rng(4)
    rows = [(i, Counter(f"w{int(x)}" for x in draw.zipf(1.3, 30) if x < 300)) for i in range(300)]
    row = search._pack(rows).to_pylist()[0]
    shard = search.Shard(row, 25.0)
    plain = search.Shard(row, 25.0)
    number = {t: i for i, t in enumerate(shard.vocabulary.to_pylist())}
    for q in range(0, 300, 7):
        own = np.array(sorted(number[t] for t in rows[q][1]))
        idf = draw.random(len(own)) + 0.01
        all_ids, all_scores = plain.top(own, idf, 300, q, 0.0)
        ids, scores = shard.top(own, idf, 5, q, float(all_scores[4]))
        assert ids.tolist() == all_ids[:5].tolist() and scores.tolist() == all_scores[:5].tolist()


@pytest.mark.parametrize("light", [0.0, 0.05, 0.4])
def test_lists_read_as_a_matrix_change_no_result(monkeypatch, light):
    monkeypatch.setattr(search, "LIGHT", light)
    draw = np.random.default_rng(5)
    rows = [(i, Counter(f"w{int(x)}" for x in draw.zipf(1.3, 40) if x < 300)) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(60)] + [(500, Counter()), (501, Counter({"alone": 1}))]  # ties, no words
    row = search._pack(rows).to_pylist()[0]
    shards = []
    for heavy in (0, 3, 40, 1024):
        monkeypatch.setattr(search, "HEAVY", heavy)
        shards.append(search.Shard(row, 25.0))
    assert [len(s.matrix) for s in shards[:3]] == [0, 3, 40] and len(shards[3].matrix) == len(shards[3].vocabulary)
    number = {t: i for i, t in enumerate(shards[0].vocabulary.to_pylist())}
    asked = []
    for _, counts in rows[::3]:
        own = np.array(sorted(number[t] for t in counts), np.int64)
        asked.append((own, draw.random(len(own)) + 0.01))
    for shard in shards:
        sums = shard.heavy_sums(asked)
        for (query, _), (own, idf), heavy, (all_own, all_idf) in zip(rows[::3], asked, sums, asked):
            full = np.zeros(len(rows))
            for d in range(len(rows)):
                at = slice(shard.starts[d], shard.starts[d + 1])
                full[d] = sum(i * w for t, i in zip(shard.terms[at], shard.impacts[at]) for w in all_idf[all_own == t])
            full[shard.ids == query] = 0.0
            best = [d for d in sorted(range(len(rows)), key=lambda d: (-round(full[d], 9), shard.ids[d])) if full[d] > 0][:10]
            ids, scores = shard.top(own, idf, 10, query, 0.0, heavy)
            assert np.allclose(scores, full[best], rtol=1e-12) and set(ids.tolist()) <= set(shard.ids[np.round(full, 9) >= np.round(full[best[-1]], 9)].tolist() if best else [])
            floor = float(scores[-1]) if len(scores) == 10 else 0.0
            again = shard.top(own, idf, 10, query, floor, heavy)
            assert again[0].tolist() == ids.tolist() and again[1].tolist() == scores.tolist()


def test_blocks_out_of_reach_are_not_read(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 32)
    draw = np.random.default_rng(6)
    rows = [(i, Counter(f"{'ab'[i % 2]}{int(x)}" for x in draw.zipf(1.3, 30) if x < 200)) for i in range(512)]
    shard = search.Shard(search._pack(rows).to_pylist()[0], 25.0)
    number = {t: i for i, t in enumerate(shard.vocabulary.to_pylist())}
    read, products = [], search.Shard._products
    monkeypatch.setattr(search.Shard, "_products", lambda self, asked, edges: read.append(len(asked)) or products(self, asked, edges))
    asked = [np.array(sorted(number[t] for t in counts), np.int64) for _, counts in rows[::5]]
    sizes, ids = np.array([len(own) for own in asked]), np.array([i for i, _ in rows[::5]])
    idf = draw.random(len(number)) + 0.01
    terms = np.concatenate(asked)
    first = {q: (a.tolist(), b.tolist()) for q, a, b in shard.best(terms, idf[terms], sizes, 5, ids, np.zeros(len(ids)))}
    # Half of the documents share no word with a query; blocks hold either half, but for some at the edges of kinds.
    assert read[0] < 0.7 * len(ids) * shard.blocks
    for q, own in enumerate(asked):
        full = {}
        for d in range(len(rows)):
            at = slice(shard.starts[d], shard.starts[d + 1])
            full[int(shard.ids[d])] = sum(i * idf[t] for t, i in zip(shard.terms[at], shard.impacts[at]) if t in own)
        full.pop(int(ids[q]))
        best = sorted((d for d in full if full[d] > 0), key=lambda d: (-round(full[d], 9), d))[:5]
        assert first[q][0] == best and np.allclose(first[q][1], [full[d] for d in best], rtol=1e-12)
    floors = np.array([first[q][1][-1] if len(first[q][1]) == 5 else 0.0 for q in range(len(ids))])
    again = {q: (a.tolist(), b.tolist()) for q, a, b in shard.best(terms, idf[terms], sizes, 5, ids, floors)}
    assert again == first and read[1] <= read[0]


def test_parts_of_blocks_out_of_reach_are_not_multiplied(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 128)
    monkeypatch.setattr(search, "PART", 16)
    monkeypatch.setattr(search, "HEAVY", 40)
    draw = np.random.default_rng(8)
    rows = [(i, Counter(f"w{int(x)}" for x in draw.zipf(1.3, 2 ** (1 + i % 7)) if x < 200)) for i in range(500)]
    shard = search.Shard(search._pack(rows).to_pylist()[0], 25.0)
    number = {t: i for i, t in enumerate(shard.vocabulary.to_pylist())}
    read, products = [], search.Shard._products
    monkeypatch.setattr(search.Shard, "_products", lambda self, rows, edges: read.append(len(rows)) or products(self, rows, edges))
    asked = [np.array(sorted(number[t] for t in counts), np.int64) for _, counts in rows[::5]]
    sizes, ids = np.array([len(own) for own in asked]), np.array([i for i, _ in rows[::5]])
    idf, terms = draw.random(len(number)) + 0.01, np.concatenate(asked)
    full = np.zeros((len(ids), len(rows)))
    for d in range(len(rows)):
        at = slice(shard.starts[d], shard.starts[d + 1])
        for q, own in enumerate(asked):
            full[q, shard.ids[d]] = sum(i * idf[t] for t, i in zip(shard.terms[at], shard.impacts[at]) if t in own)
    full[np.arange(len(ids)), ids] = 0.0
    floors = np.sort(full, axis=1)[:, -5]
    found = {q: (a.tolist(), b.tolist()) for q, a, b in shard.best(terms, idf[terms], sizes, 5, ids, floors)}
    for q in range(len(ids)):
        best = sorted(range(len(rows)), key=lambda d: (-round(full[q, d], 9), d))[:5]
        best = [d for d in best if full[q, d] > 0]
        assert found.get(q, ([], []))[0] == best and np.allclose(found.get(q, ([], []))[1], full[q, best], rtol=1e-12)
    # Short documents, which are in parts of their own, are out of the longer queries' reach.
    assert read[0] < 0.7 * len(ids) * shard.blocks * (search.BLOCK // search.PART)


def test_rows_of_shards_grow_less_than_shards(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 2)
    rows = [(i, f"same w{i * 7919 % 97} v{i * 104729 % 89} x{i % 5}") for i in range(960)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8, "doc_id")
    shards = search.build_shards(docs, "doc_id", "text")
    rounds = [{bytes(r["ids"]) for r in some.collect()} for some in search._rounds(shards, shards.count())]
    assert len(rounds) == 5 and sum(map(len, rounds)) == len(set().union(*rounds)) == shards.count() and len(rounds[0]) < 20
    made, merged = [], search._merged
    monkeypatch.setattr(search, "_merged", lambda found, k: made.append(found.count()) or merged(found, k))
    got = defaultdict(list)
    for r in search.top_k(docs, docs.where("doc_id < 20"), 2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 6)))
    texts = [[i, t] for i, t in rows]
    for query in range(0, 20):
        want = brute_search([[0 if i == query else i * 20 + 1, t] for i, t in texts], 2)[0]
        assert got[query] == [((d - 1) // 20, s) for d, s in want]
    # Each of 480 shards would give 20 queries two rows without floors.
    assert sum(made) < 480 * 20 * 2 / 8


def test_bare_words_by_batch_are_those_one_by_one():
    raw = ["The", "(the)", "İstanbul", "“ΟΔΟΣ”", "straße!", "...", "…", "", "a\x1fb", "É,", "é", "ABC_", "don't", "ǅ", "ﬁ"]
    codes, names = search._bare_codes(pa.array(raw, pa.string()))
    assert [names[c].as_py() if c >= 0 else "" for c in codes.tolist()] == [search.bare(w) for w in raw]
    assert len(set(names.to_pylist())) == len(names)


def test_shards_hold_the_words_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 3)
    texts = ["A\u00a0b\x1cB, ...\u2003c\x85d", None, "  ", "The the THE end.", "b\u3000\u200bc \x0b\x0c a", "(new) “words” new"]
    shards = search.build_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), "doc_id", "text").collect()
    held = {}
    for r in shards:
        shard = search.Shard(r.asDict(), 3.0)
        tfs, words = np.frombuffer(r["tfs"], np.int32), shard.vocabulary.to_pylist()
        for d, i in enumerate(shard.ids.tolist()):
            at = slice(shard.starts[d], shard.starts[d + 1])
            held[i] = {words[t]: int(n) for t, n in zip(shard.terms[at], tfs[at])}
        assert r["frequencies"] == np.array([sum(w in held[i] for i in shard.ids.tolist()) for w in words], np.int64).tobytes()
    assert len(shards) == 2 and held == {i: dict(search.term_counts(t, search._Bare())) for i, t in enumerate(texts)}


# 4


def test_arc_versions_lengths_and_odd_lines():
    one = warc.arc_file_head(1, "a.arc") + warc.arc_record(1, "http://h/a b", "1.2.3.4", "20010203040506", "text/html", "200", 0, "a.arc", b"x\n\ny")
    two = warc.arc_file_head(2, "b.arc") + warc.arc_record(2, "http://h/c", "1.2.3.4", "200102030405", "text/plain", "404", 9, "b.arc", b"")
    (r,) = warc.parse_arc(one + b"\n")
    assert (r["url"], r["ip"], r["date"], r["mime"], r["body"]) == ("http://h/a b", "1.2.3.4", "20010203040506", "text/html", b"x\n\ny")
    (r,) = warc.parse_arc(two)
    assert (r["url"], r["mime"], r["body"]) == ("http://h/c", "text/plain", b"")
    mixed = warc.arc_file_head(1, "c.arc") + b"no header here\n" + one[len(warc.arc_file_head(1, "a.arc")) :] + b"http://cut 1.1.1.1 20010101 text/html 999\nshort"
    assert [x["body"] for x in warc.parse_arc(mixed)] == [b"x\n\ny"]
    assert warc.iso_time("200102030405") == "2001-02-03T04:05:00Z" and warc.iso_time("x") == "1970-01-01T00:00:00Z"
    assert warc.unpacked(warc.packed(one) + warc.packed(two) + b"\n") == one + two


def test_warc_blocks_may_hold_separators():
    body = b"WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\xff\x00"
    data = warc.warc_record([("WARC-Type", "resource")], body) + warc.warc_record([("WARC-Type", "response")], b"") + b"\n"
    assert [(h["warc-type"], b) for h, b in warc.parse_warc(data)] == [("resource", body), ("response", b"")]


def test_pages_with_equal_payloads(spark):
    pages = [(5, "u", "same"), (3, None, "same"), (9, "x y", "same"), (7, "v", None), (8, "w", ""), (None, "z", "same"), (3, None, "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(warc.pages_through_archives(df).select("page_id", "payload_bytes", "record_type", "refers_to").collect(), key=str)
    want = [(None, 4, "revisit", 3), (3, 4, "response", None), (3, 4, "response", None), (5, 4, "revisit", 3), (9, 4, "revisit", 3)]
    want += [(7, 0, "response", None), (8, 0, "revisit", 7)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    small = warc.pages_through_archives(df, min_bytes=1).where("payload_bytes = 0")
    assert {r["record_type"] for r in small.collect()} == {"response"}


# 5


def test_toxicity_on_held_out_documents(spark):
    labels = dict(rows_of(LARGE, "labels", "doc_id, toxic"))
    english = {i for i, lang in rows_of(LARGE, "documents", "doc_id, lang") if lang == "en"}
    rows = QUERIES["op5_toxicity"](spark, LARGE).collect()
    assert len(rows) == len(rows_of(LARGE, "documents", "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]], r["doc_id"] in english) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hits = sum(p and y for p, y, _ in held)
    assert hits / max(1, sum(p for p, _, _ in held)) > 0.95
    assert sum(p for p, y, e in held if y and e) / sum(y for _, y, e in held if e) > 0.85


def test_boosting_and_calibration():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 2] < 0.5)).astype(float)
    trees = toxicity.boost(x[:2000], y[:2000])
    at, share = toxicity.isotonic(trees.margin(x[2000:2500]), y[2000:2500])
    assert (np.diff(share) >= 0).all() and (np.diff(at) >= 0).all()
    score = np.interp(trees.margin(x[2500:]), at, share)
    assert ((score > 0.5) == y[2500:]).mean() > 0.98


def test_capitals_count_alike_at_every_length():
    for word in ("Ärger und École ", "Жизнь Москва ", "HELLO There "):
        rates = [toxicity.features(word * n, toxicity._Tokens({}))[toxicity.FEATURES.index("capital_rate")] for n in (3, 300)]
        assert rates[0] == rates[1] == sum(map(str.isupper, word)) / len(word) > 0


def test_hidden_insults_count():
    tokens = toxicity._Tokens({})
    plain, hidden = (toxicity.features(t, tokens) for t in ("you are an idiot", "you are an 1d10t!!"))
    name = toxicity.FEATURES.index
    assert plain[name("insults")] == hidden[name("insults")] == 1
    assert hidden[name("hidden_rate")] > 0 == plain[name("hidden_rate")]
    assert plain[name("near_second_person")] > 0
    assert len(toxicity.features("", tokens)) == len(toxicity.FEATURES)


# 6


def small_index(items):
    chunks = [w for _, t in items for w, _ in decontam.cut_item(t)]
    frequency = Counter(w for c in chunks for w in set(c))
    return decontam.build_index(items, frequency, len(chunks), sum(map(len, chunks)) / len(chunks))


def test_retrieval_equals_brute_force():
    items = rows_of(SMALL, "benchmark")
    index = small_index(items)
    texts = [t for _, t in rows_of(SMALL, "documents", "doc_id, text")]
    got = {(t, c, round(s, 9)) for t, c, s, _ in decontam.retrieve(texts, index, decontam._Ids(index.vocabulary))}
    want = set()
    for row, text in enumerate(texts):
        words = decontam.words_of(text)
        for start in range(0, max(1, len(words)), decontam.STRIDE):
            held = {index.vocabulary[w] for w in words[start : start + decontam.PASSAGE] if w in index.vocabulary}
            for b, (terms, weights) in enumerate(zip(index.block_terms, index.block_weights)):
                score = weights[[i for i, t in enumerate(terms) if t in held]].sum(0)
                want |= {(row, b * decontam.BLOCK + c, round(float(score[c]), 9)) for c in np.nonzero(score >= decontam.THRESHOLD)[0]}
    # Windows may begin in the gap before a text, which adds passages of its first words.
    assert want <= got and {(t, c) for t, c, _ in got} - {(t, c) for t, c, _ in want} == set()


def test_leaks_are_found_and_clean_documents_are_not(spark):
    items = rows_of(LARGE, "benchmark")
    docs = rows_of(LARGE, "documents", "doc_id, text")
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_benchmark_decontamination"](spark, LARGE).collect()}
    want = {(i, j) for i, t in docs for j, x in items if x in t}
    assert want <= got
    texts, bodies = dict(docs), dict(items)
    for i, j in got - want:  # the rest holds half of the item's word runs at least
        words = decontam.words_of(bodies[j])
        runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        own = decontam.words_of(texts[i])
        assert len(runs & {tuple(own[k : k + 5]) for k in range(len(own) - 4)}) >= 0.4 * len(runs)


def test_a_changed_word_hides_no_item(spark):
    """One changed word in a short answer, in a short question, in both parts of a long item; a question alone is no leak."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    short, brief, long = (words(40), words(4)), (words(5), words(30)), (words(150), words(12))
    items = [(i, " ".join(q) + "? " + " ".join(a) + ".") for i, (q, a) in enumerate((short, brief, long), 1)]

    def changed(part, at):
        return [*part[:at], "other", *part[at + 1 :]]

    texts = {
        1: [*short[0], *changed(short[1], 2)],
        2: [*changed(brief[0], 2), *brief[1]],
        3: [*changed(long[0], 75), *changed(long[1], 6)],
        4: [*short[0], *words(60)],
        5: [*words(60), *brief[1]],
        6: [*long[0][:60], *words(200)],
        7: [*long[0], *words(200)],
        8: words(200),
    }
    body = [(i, " ".join([*words(300), *t, *words(300)])) for i, t in texts.items()]
    docs = spark.createDataFrame([*body, *body[:1]], "doc_id long, text string")
    for kind in ("smallint", "decimal(12,0)", "string"):
        table = spark.createDataFrame(items, "item_id int, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
        got = sorted((r["doc_id"], int(r["item_id"])) for r in decontam.find_leaks(docs, table).collect())
        assert got == [(1, 1), (1, 1), (2, 2), (3, 3)]
    assert sorted(r["doc_id"] for r in decontam.documents_without_leaks(docs, table).collect()) == [4, 5, 6, 7, 8]


@pytest.mark.parametrize("seed", range(4))
def test_words_in_order_equal_brute_force(seed):
    draw = random.Random(seed)
    part, region = [[draw.choice("abcdef") for _ in range(n)] for n in (5, 30)]
    best = 0
    for i in range(len(region)):
        stretch = region[i : i + 10]
        for bits in range(32):
            rest = iter(stretch)
            chosen = [w for k, w in enumerate(part) if bits >> k & 1]
            if all(w in rest for w in chosen):
                best = max(best, len(chosen))
    assert decontam.in_order(region, part) == best / 5


def test_long_items_are_cut_and_found(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    long = " ".join(word() for _ in range(1000)) + "."
    items = spark.createDataFrame([(1, long), (2, None), (3, ""), (None, long)], "item_id long, text string")
    text = " ".join(word() for _ in range(300)) + " " + long[700:1400] + " " + " ".join(word() for _ in range(300))
    docs = spark.createDataFrame([(1, text), (2, " ".join(word() for _ in range(500))), (3, None), (4, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()] == [(1, 1)]
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0


# 7

PATTERNS = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute_spans(text):
    out = []
    for k, (kind, rx) in enumerate(PATTERNS.items()):
        for m in rx.finditer(text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(5)
    parts = ["password", "Token", "API_KEY", "apikey", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "deadbeef01234567", "ab", "é", "\n", "ſecret=abcdefgh", "Key"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert secrets.base_spans(text) == brute_spans(text)
    for _, text in rows_of(MEDIUM, "documents", "doc_id, text"):
        assert secrets.base_spans(text) == brute_spans(text)


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(6)
    field = secrets.Field(draw.normal(size=(secrets._BASES[-1], 3)), draw.normal(size=(3, 3)))
    field.move[secrets.O, secrets.I] = secrets._NEVER
    from itertools import product

    for line in ('key = "a1b2c3d4e5"', "x-y9z8w7v6u5 q", "token a1b2c3-d4e5f6 z"):
        _, rows, bars = secrets.encode(line, 1)
        scores = field.emit[rows].sum(1) + bars
        scores[0, secrets.I] = secrets._NEVER
        value = lambda p: sum(scores[i, t] for i, t in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
        best = max(product(range(3), repeat=len(rows)), key=value)
        assert value(field.decode(rows, bars)) == pytest.approx(value(best))


def test_skipped_lines_have_no_tags():
    draw = np.random.default_rng(5)
    words = ["pwd", "=", "CorrectHorse", "the", "x-1", "Schlüssel", "sk-live-Ab3x", "+aGVs/bG8=", "a.b.c", "key:", "12", "A", "z" * 30]
    texts = ["\n".join(" ".join(draw.choice(words, draw.integers(0, 9))) for _ in range(20)) for _ in range(20)]
    for shift in (0.0, 2.0, 4.0, 8.0):  # from lines that hold many tags to lines that hold none
        field = secrets.Field(draw.normal(size=(secrets._BASES[-1], 3)), draw.normal(size=(3, 3)))
        field.move[secrets.O, secrets.I] = secrets._NEVER
        field.emit[:, secrets.O] += shift / 8
        for text, got in zip(texts, secrets.Scanner(field).spans(texts)):
            want, at = [], 0
            for line in text.split("\n"):
                want += [(at + s, at + e) for s, e in secrets.line_spans(line, field, secrets.file_class(text))]
                at += len(line) + 1
            assert got == want


def test_secrets_of_letters_phrases_and_short_heads_are_found(spark):
    field = secrets.fit(spark.read.parquet(f"{LARGE}/documents.parquet"), "doc_id", "text")
    for left, secret in [
        ("pwd = ", "CorrectHorse"),
        ("passphrase = '", "purple-monkey-dishwasher"),
        ("credential = '", "Schlüsselbund"),
        ("auth = ", "sk-live-Ab3xQ9ZtLm27"),
    ]:
        assert secrets.Scanner(field).spans([left + secret]) == [[(len(left), len(left) + len(secret))]]
    assert secrets.Scanner(field).spans(["the key to success is work", "the password is wrong"]) == [[], []]


def test_rare_secrets_are_drawn_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(secrets, "TRAIN_DOCS", 20)
    rows = [(i, f"plain words of number {i}" if i % 1000 else f'password = "Ab3dE{i}xYz"') for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r["text"] for r in secrets.drawn_texts(docs, "doc_id", "text").collect()]
    assert len(texts) == 23 and sum("password" in t for t in texts) == 3
    assert secrets.fit(docs, "doc_id", "text") is not None


def test_added_spans_never_touch_base_ones(spark):
    texts = dict(rows_of(MEDIUM, "documents", "doc_id, text"))
    for r in QUERIES["op7_secret_scan"](spark, MEDIUM).collect():
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        base = [(s, e) for k, s, e in spans if k != "crf"]
        assert secrets.joined(brute_spans(texts[r["doc_id"]])) == ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k != "crf")
        assert not any(k == "crf" and s < y and x < e for k, s, e in spans for x, y in base)
        assert r["n_assign"] == sum(k == "assign" for k, _, _ in spans)


# 8


def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, limit):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= limit:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_simhash_groups_equal_brute_force(spark):
    docs = rows_of(SMALL, "documents", "doc_id, text") + [(100000, None), (100001, ""), (100002, " \t"), (100003, "One two"), (100004, "one TWO ")]
    prints = {i: brute_fingerprint(t) for i, t in docs}
    groups = brute_components(prints, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicate_groups(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


@pytest.mark.parametrize("limit", [0, 1, 3, 6])
def test_thresholds_miss_no_pair(limit):
    draw = np.random.default_rng(limit)
    sample = draw.integers(0, 2**64, 300, dtype=np.uint64)
    layout = simhash.allocate(sample, limit, 10**9)
    assert sum(t + 1 for t in layout.limits) == limit + 1
    assert sorted(b for part in layout.parts for b in part) == list(range(64))
    for _ in range(300):
        a = int(draw.integers(0, 2**64, dtype=np.uint64))
        flips = draw.choice(64, limit, replace=False)
        b = a ^ sum(1 << int(f) for f in flips)
        pair = np.array([a, b], np.uint64)
        apart = [bin(int(np.bitwise_xor(*simhash.extract(pair, part)))).count("1") for part in layout.parts]
        assert any(d <= t for d, t in zip(apart, layout.limits))


def test_dense_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 40)  # the driver deals the chunks
    draw = np.random.default_rng(8)
    centre = int(draw.integers(0, 2**64, dtype=np.uint64))
    values = {centre ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(1, 4), replace=False)) for _ in range(400)}
    values |= {int(x) for x in draw.integers(0, 2**64, 100, dtype=np.uint64)}
    values = sorted(values)
    nodes = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")), 0) for v in values], "key binary, size int")
    labels = {bytes(r[0]): bytes(r[1]) for r in simhash.components(simhash.link_fingerprints(nodes, 3)).collect()}
    want = brute_components({v: v for v in values}, 3)
    for v in values:
        label = labels.get(v.to_bytes(8, "big"), v.to_bytes(8, "big"))
        assert int.from_bytes(label, "big") == want[v]


@pytest.mark.parametrize("chunk", [40, 4096])
def test_fingerprints_of_one_name_are_connected_and_names_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    draw = np.random.default_rng(chunk)
    centres = [int(c) for c in draw.integers(0, 2**64, 12, dtype=np.uint64)]
    values = [centres[i % 12] ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 4), replace=False)) for i in range(400)]
    names = [int(draw.integers(0, 200)) if draw.random() < 0.1 else i + 1000 for i in range(400)]  # some names join centres
    rows = sorted({(bytes(v.to_bytes(8, "big") + n.to_bytes(2, "big")), 0) for v, n in zip(values, names)})
    nodes = spark.createDataFrame([(bytearray(k), s) for k, s in rows], "key binary, size int")
    links = simhash.link_fingerprints(nodes, 3, words=1)
    got = {bytes(r[0]): bytes(r[1]) for r in simhash.components(links).collect()}
    low = {n: n for n in names}
    while True:
        before = dict(low)
        for a, x in zip(values, names):
            for b, y in zip(values, names):
                if bin(a ^ b).count("1") <= 3:
                    low[x] = low[y] = min(low[x], low[y])
        if low == before:
            break
    for n in names:
        assert int.from_bytes(got.get(n.to_bytes(2, "big"), n.to_bytes(2, "big")), "big") == low[n]


def test_long_chains_are_one_component(spark):
    n = 300
    links = [(i.to_bytes(8, "big"), (i + 1).to_bytes(8, "big")) for i in range(n)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in links], "a binary, b binary")
    labels = simhash.components(df).collect()
    assert len(labels) == n + 1 and {bytes(r[1]) for r in labels} == {(0).to_bytes(8, "big")}


# 10


def test_language_on_held_out_documents(spark):
    lang = dict(rows_of(MEDIUM, "documents", "doc_id, lang"))
    rows = QUERIES["op10_language_id"](spark, MEDIUM).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.97


def test_convolution_equals_the_plain_sum():
    draw = np.random.default_rng(9)
    f = langid.FILTERS
    taps = [draw.normal(size=(w, 256, f)).astype(np.float32) for w in langid.WIDTHS]
    net = langid.Network(taps, draw.normal(size=3 * f), draw.normal(size=(3 * f, 2)), draw.normal(size=2), ["a", "b"])
    flat = langid.windows_of(("Größe of THE text " * 40).encode())
    ahead = np.concatenate([flat, np.zeros(8, np.uint8)])
    hidden = []
    for k in range(len(flat) // langid.WINDOW):
        peaks = []
        for tap in taps:
            places = [sum(tap[j][ahead[t + j]] for j in range(len(tap))) for t in range(k * langid.WINDOW, (k + 1) * langid.WINDOW)]
            peaks.append(np.max(places, 0))
        hidden.append(np.maximum(np.concatenate(peaks) + net.bias, 0))
    assert np.allclose(langid.Predictor(net).logits(flat), np.array(hidden) @ net.out + net.out_bias, atol=1e-3)
