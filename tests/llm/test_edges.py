"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage."""

import pytest

import corpus_pipeline
from tillweave.llm import decontam, langid, line_dedup, mixing, near_copies, search, secrets, simhash, token_counts, toxicity, warc
from tillweave.llm.queries import QUERIES

LONG = ("the and of to in word " * 40 + "\n") * 250  # 220,000 characters
ONE_LINE = "x1y2 " * 40_000
SHARED = "A line that three documents share, word for word."
ROWS = [
    (1, LONG, "en", "a", 10),
    (2, ONE_LINE, "en", None, None),
    (3, "", "en", "a", 0),
    (4, None, "en", "a", None),
    (5, SHARED + "\nthe first of them", "en", "b", 5),
    (6, SHARED + "\nthe second of them", None, "b", 5),
    (7, SHARED.upper() + "  \nthe third of them", "en", "b", 5),
    (8, "der die das und ist nicht ein eine mit von", "de", "c", 3),
    (8, "der die das und ist nicht ein eine mit von", "de", "c", 3),
    (9, "12 34 !!", "de", "c", 3),
    (None, "the and of to in some text here", "en", "c", 3),
    (None, None, None, None, None),
]
CLASHES = ["kept_id", "slot", "text_slot", "id", "key", "hash", "hashes", "row_id", "lost_id", "tokens", "kept", "weight", "c0", "size", "component_id", "score"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(ROWS, schema)
    for i, name in enumerate(CLASHES):
        df = df.selectExpr("*", f"{i} AS {name}")
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (2, 1), (5, None), (99, 1), (None, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a test item. with an answer"), (2, None), (3, "")], "item_id long, text string")


def run(name, docs, labels, items):
    return {
        "tokens": lambda: token_counts.count_tokens(docs, token_counts.load_pieces()),
        "mixing": lambda: mixing.mixing_plan(docs),
        "search": lambda: search.top_k(docs, docs.where("doc_id % 2 = 0"), 3),
        "toxicity": lambda: toxicity.score_documents(docs, labels),
        "leaks": lambda: decontam.find_leaks(docs, items),
        "secrets": lambda: secrets.scan_secrets(docs),
        "simhash": lambda: simhash.near_duplicate_groups(docs),
        "lines": lambda: line_dedup.dedup_lines(docs),
        "language": lambda: langid.identify(docs),
        "pages": lambda: warc.pages_through_archives(docs, "doc_id", "source", "text"),
    }[name]()


PER_ROW = ["tokens", "mixing", "toxicity", "secrets", "simhash", "lines", "language", "pages"]


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_input_row(docs, labels, items, name):
    rows = run(name, docs, labels, items).collect()
    assert len(rows) == len(ROWS)
    same = [tuple(r) for r in rows if r[0] == 8]
    assert len(same) == 2
    if name != "pages":
        assert same[0] == same[1]


@pytest.mark.parametrize("name", [*PER_ROW, "search", "leaks"])
def test_empty_table(docs, labels, items, name):
    assert run(name, docs.limit(0), labels.limit(0), items).count() == 0


def test_defined_values(docs, labels, items):
    tokens = {r[0]: r[1] for r in run("tokens", docs, labels, items).collect()}
    assert tokens[3] == tokens[4] == 0 and tokens[1] > 50_000
    lines = {r[0]: r for r in run("lines", docs, labels, items).collect()}
    assert (lines[3][1], lines[4][1], lines[1][1]) == (1, 1, 251)
    assert [lines[i][2] for i in (5, 6, 7)] == [1, 1, 0]
    assert lines[5][3] == "the first of them" and lines[7][3] == SHARED.upper() + "  \nthe third of them"
    language = {r[0]: r for r in run("language", docs, labels, items).collect()}
    assert [language[i][2] for i in (3, 4, 9)] == ["und"] * 3 and language[3][3] == 0.0
    groups = {r[0]: r for r in run("simhash", docs, labels, items).collect()}
    assert groups[3][1] == groups[4][1] == "0" * 16 and groups[4][2] == 3
    assert run("leaks", docs, labels, items).count() == 0
    assert {r[0] for r in run("search", docs, labels, items).collect()} <= {2, 4, 6, 8}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_columns(spark, docs, name, stage):
    folder = "/root/testdata/sf0.001"
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got = [r["doc_id"] for r in out.collect()]
    assert stage(spark, docs.limit(0), folder).count() == 0
    if name == "language_id":
        assert sorted(map(str, got)) == sorted(map(str, [1, 2, 5, 6, 7, 8, 8, None]))
    if name == "line_dedup":
        assert len(got) == len(ROWS)
    if name == "decontamination":
        assert len(got) == len(ROWS)
    if name == "near_dedup":
        assert got.count(8) == 2 and 4 not in got and 3 in got


def test_language_stage_rejects_by_the_network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = __import__("random").Random(1)
    junk = [" ".join("".join(draw.choice("bcdfghjklmnpqrstvwxzaeiouy") for _ in range(draw.randint(3, 9))) for _ in range(60)) for _ in range(20)]
    junk += ["".join(chr(draw.randrange(0x4E00, 0x5E00)) for _ in range(80)) for _ in range(20)] + ["日本語のテキスト", "zzzzqqq xkcd"]
    made = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    both = docs.unionByName(made, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both, "").select("doc_id").collect()}
    known = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(known - kept) <= 2  # of 1,000
    assert len([i for i in kept if i >= 10**6]) <= 2  # letters all of them, so only the network can tell


def test_line_stage_rewrites_texts(spark, docs):
    out = {r["doc_id"]: r for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect() if r["doc_id"]}
    assert out[5]["text"] == "the first of them" and out[5]["n_chars"] == 17
    assert out[4]["text"] is None and out[4]["n_chars"] is None and out[3]["text"] == ""


def test_near_copies_go_and_clean_documents_stay(spark):
    import random

    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    rows, kept = [], set()
    for g in range(40):
        words = [word() for _ in range(300)]
        rows.append((10 * g, " ".join(words)))
        kept.add(10 * g)
        for c in range(1, 4):  # one to three words changed: similarity 0.9 or more
            changed = list(words)
            for _ in range(c):
                changed[draw.randrange(300)] = word()
            rows.append((10 * g + c, " ".join(changed)))
        half = words[:150] + [word() for _ in range(150)]  # similarity 1/3
        rows.append((10 * g + 9, " ".join(half)))
        kept.add(10 * g + 9)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'a' AS source", "0L AS n_chars")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept <= got and len(got - kept) <= 2


def test_near_copies_are_those_of_similarity_on_sets(spark, monkeypatch):
    import random

    monkeypatch.setattr(near_copies, "CHUNK", 8)
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(30):
        words = [word() for _ in range(150)]
        texts += [" ".join(words), " ".join(words + words)]  # twice over: four new shingles
        for c in range(1, 8):  # similarities on both sides of 0.8
            changed = list(words)
            for at in draw.sample(range(150), c):
                changed[at] = word()
            texts.append(" ".join(changed))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    low = list(range(len(texts)))
    pairs = [(a, b) for a in low for b in low[a + 1 : a + 9] if a // 9 == b // 9 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while True:
        before = list(low)
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got == set(low) and 30 < len(got) < 200


def test_fingerprints_propose_near_copies_that_share_no_band(spark):
    import random

    rows = []
    # The pairs of 240,000 such ones, each at exactly 0.8, that no MinHash band brings together.
    for seed in (24998, 29423, 29486, 60803, 76857, 86504, 139219, 155046, 157467):
        draw = random.Random(seed)
        words = [f"{draw.randrange(10**6):06d}" for _ in range(14)]
        one, other = " ".join(words[:13]), " ".join(words[:12] + words[13:])
        found = [set(near_copies.bands(near_copies.shingle_set(t.encode(), 5)).tolist()) for t in (one, other)]
        assert not found[0] & found[1]
        rows += [(2 * seed, one), (2 * seed + 1, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {i for i, _ in rows if i % 2 == 0}


def test_links_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    import random

    linked, proposed = [], []
    join, propose = near_copies.components, near_copies.link_fingerprints

    def joined(links, purpose):
        if purpose != "near-labels":  # before texts are compared
            linked.append(links.distinct().count())
        return join(links, purpose)

    def alike(*given):
        links = propose(*given)
        proposed.append(links.count())
        return links

    monkeypatch.setattr(near_copies, "components", joined)
    monkeypatch.setattr(near_copies, "link_fingerprints", alike)
    for n in (100, 400):
        draw = random.Random(3)
        words = [f"{draw.randrange(10**6):06d}" for _ in range(300)]
        texts = []
        for _ in range(n):
            changed = list(words)
            for at in draw.sample(range(300), 3):
                changed[at] = f"{draw.randrange(10**6):06d}"
            texts.append(" ".join(changed))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        linked.clear()
        proposed.clear()
        assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").select("doc_id").collect()] == [0]
        # Bands connect them with a link for each band and text at most, so fingerprints have nothing to add.
        assert sum(linked) <= near_copies.BANDS * n and sum(proposed) == 0


def test_contradicting_targets_do_not_pass_the_mixing_stage(spark):
    rows = [(i, "word " * (1 + i % 7), *(("en", "a") if i % 3 else ("de", "b"))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = mixing.mixing_plan(docs, targets={"source": {"a": 1, "b": 1}, "lang": {"en": 9, "de": 1}}).first()
    assert not plan["converged"] and plan["marginal_error"] > 0.1
    with pytest.raises(ValueError, match="contradict"):
        mixing.sample_to_targets(docs, targets={"source": {"a": 1, "b": 1}, "lang": {"en": 9, "de": 1}})


def test_flattened_defaults_that_contradict_come_from_one_cell_table(spark, tmp_path):
    # Each source has one language, but two share a language: flattened source and language shares differ.
    cells = [("a", "en", "prose", 900), ("b", "en", "prose", 50), ("c", "de", "prose", 50)]
    got = mixing.consistent_weights(spark.createDataFrame(cells, "source string, lang string, topic string, base long")).collect()
    assert all(r["converged"] for r in got)
    total = sum(base**0.9 for *_, base in cells)
    for r in got:
        assert r["weight"] == pytest.approx(1000 * r["base"] ** 0.9 / total)
    rows = [(i, "word " * 20, "de" if i % 20 == 1 else "en", "abc"[(i % 20 == 1) * 2 + (i % 20 == 0)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert not mixing.mixing_plan(docs).first()["converged"]
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    with pytest.warns(RuntimeWarning, match="targets are not met"):
        QUERIES["op2_source_mixing"](spark, folder)
    kept = mixing.sample_to_targets(docs).groupBy("source").count().collect()
    assert {r["source"] for r in kept} == {"a", "b", "c"} and {r["source"]: r["count"] for r in kept}["b"] == 20


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < out.count() <= 200
