"""Operators on training text: brute force on the small tables, and every edge case on a small fixture."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def edge_rows():
    texts = [None, "", " \n\t ", "one", "two words", LONG, LONG, "same text here " * 12, "same text here " * 12, f"start a {PASSAGE} end", f"other begin {PASSAGE} fin", "é" * 60, "é" * 60, "the line\nthe line\n\nthe line", "<|endoftext|> x", "Σίσυφος İ 日本 🎉", "Released under the MIT Licence.\nmore"]
    rows = [Row(doc_id=i, text=t, lang=None, source="s", n_chars=None if t is None else len(t), score="x", label=1, key="k", rank=0, spans=3, kept="y", component_id=-1, shard=9) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[3].__class__(**{**rows[4].asDict(), "doc_id": None}), rows[5].__class__(**{**rows[0].asDict(), "doc_id": None})]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label int, key string, rank int, spans int, kept string, component_id int, shard int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1, 16)] + [(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def texts_of(edge):
    return [(r.doc_id, r.text) for r in edge.collect()]


# -- sharding ---------------------------------------------------------------------------------


def test_sharding_is_even_gapless_and_whole(docs, plain, edge, nothing):
    from driftlens.llm import sharding

    for df, n in ((docs, len(plain)), (edge, len(edge_rows()))):
        rows = sharding.assign(df).collect()
        assert len(rows) == n
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        counts = [len(by.get(s, [])) for s in range(40)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = dict(plain)
    for r in sharding.assign(docs).collect():
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert sharding.assign(nothing).count() == 0


def test_sharding_sweep_moves_overflow_clockwise():
    from driftlens.llm import sharding

    counts = {0: 900, 5000: 100}
    placed = sharding.sweep(counts, 4, 8)
    assert sum(hi - lo for _, lo, hi, _, _ in placed) == 1000
    per = collections.Counter()
    for _, lo, hi, shard, _ in placed:
        per[shard] += hi - lo
    assert set(per.values()) == {250}


# -- trained scorers ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_scorers_give_every_row_a_probability(edge, nothing, labels, name):
    from driftlens.llm import quality, toxicity

    op = {"quality": quality.classify, "toxicity": toxicity.classify}[name]
    rows = op(edge, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (7, 8)}) == 1
    assert op(nothing, labels).count() == 0
    assert op(edge, labels.where("false")).count() == len(edge_rows())


def test_quality_and_toxicity_on_held_out_rows(spark, docs):
    from driftlens.llm import quality, toxicity

    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for op, label in ((quality.classify, "quality"), (toxicity.classify, "toxic")):
        got = op(big, lab).join(lab, "doc_id").where("held_out").select("score", label).collect()
        good = [r.score for r in got if r[1] == 1]
        bad = [r.score for r in got if r[1] == 0]
        auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
        assert auc > 0.85, (label, auc)


def test_maximal_segments_against_definition():
    from driftlens.llm.toxicity import maximal_segments

    assert maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    assert maximal_segments([]) == [] and maximal_segments([-1, -2]) == []


def brute_segments(scores, shift=0):
    """Ruzzo and Tompa's definition: the best segment, then the same to its left and to its right."""
    best = max(((sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, i, j = best
    return brute_segments(scores[:i], shift) + [(i + shift, j + shift, best[0])] + brute_segments(scores[j:], shift + j)


def test_maximal_segments_against_brute_force():
    from driftlens.llm.toxicity import maximal_segments

    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9, 17, 30):
        for _ in range(40):
            scores = rng.normal(-0.2, 1, n).tolist()
            got, want = maximal_segments(scores), brute_segments(scores)
            assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_maximal_segments_take_linear_time():
    import time

    from driftlens.llm.toxicity import maximal_segments

    def took(n, scores):
        began = time.perf_counter()
        maximal_segments(scores * n)
        return time.perf_counter() - began

    for scores in ([1.0, -2.0], [1.0, -0.5], [2.0, -1.0, 0.5, -1.5]):
        took(1000, scores)
        assert took(64_000, scores) < 100 * max(min(took(4_000, scores) for _ in range(3)), 1e-3)  # quadratic time would give 256


def test_gumbel_scale_recovers_the_planted_k():
    from driftlens.llm.toxicity import gumbel_scale

    rng = np.random.default_rng(5)
    length = rng.integers(50, 500, 40_000)
    best = (np.log(0.3 * length) - np.log(-np.log(rng.uniform(size=len(length))))) / 1.5
    assert 0.25 < gumbel_scale(best, length, 1.5) < 0.35 and gumbel_scale(np.zeros(5), length[:5], 1.0) == 1.0


def test_toxic_passages_name_the_planted_bytes(spark):
    from driftlens.llm import toxicity

    rng = np.random.default_rng(0)
    calm = ["table", "garden", "river", "window", "paper", "morning", "letter", "bridge"]
    foul = ["scumbagz", "vermino", "wretchyx"]
    rows, marks = [], {}
    for i in range(600):
        words = rng.choice(calm, 40).tolist()
        toxic = int(i % 4 == 0)
        if toxic:
            words[10:13] = rng.choice(foul, 3).tolist()
            start = len(" ".join(words[:10])) + 1
            marks[i] = (start, start + len(" ".join(words[10:13])))
        else:
            words[5:8] = ["sunshine"] * 3
        rows.append((i, " ".join(words), toxic))
    rows += [(1000, None, 0), (1001, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    assert (model.odds > 0).any() and (model.odds < 0).any()
    got = {r.doc_id: (r.start, r.end) for r in toxicity.toxic_passages(df, model).collect()}
    assert got == marks
    with pytest.warns(UserWarning, match="tokens are significant"):
        assert len(toxicity.train(df, df.select("doc_id", "toxic"), vocabulary=5).keys) == 5


def test_quality_weights_solve_the_normal_equations(spark, docs):
    from driftlens.llm import quality
    from driftlens.llm._labels import labelled_sample

    lab = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, lab, dimensions=32)
    rows = [r for r in labelled_sample(docs, lab, "quality", 20_000).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(5))).collect()]
    stats = []
    for r in rows:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        stats.append(quality.statistics(data, np.array([0, len(data)]))[0])
    x, part, y = np.array(stats), np.array([r.part for r in rows]), np.array([r.label for r in rows])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))
    z = model.features(x[part != 0])
    n = len(z)
    penalty = np.diag([max(1e-3 * n, 1e-6)] * 32 + [1e-9])
    assert np.allclose((z.T @ z + penalty) @ model.weights, z.T @ y[part != 0])


def test_rules_fit_equals_one_on_the_whole_sample(spark, docs):
    from driftlens.llm import quality_rules as rules

    lab = spark.read.parquet(f"{SF}/labels.parquet")
    one, many = rules.train(docs, lab, parts=1), rules.train(docs, lab, parts=5)
    assert np.allclose(one.weights, many.weights, atol=1e-5 * np.abs(one.weights).max()) and np.isclose(one.slope, many.slope, rtol=1e-3)
    # the loss and its gradient against dense arithmetic
    data = np.frombuffer(b"a b c a bb c dd a", np.uint8)
    offsets = np.array([0, 5, len(data)])
    slots, shares = rules._frequencies(data, offsets)
    batch = rules.pa.RecordBatch.from_arrays([slots, shares, rules.pa.array([1.0, 0.0])], names=["slots", "shares", "label"])
    dense = np.zeros((2, 3 * rules.WIDTH))
    for i, (s, v) in enumerate(zip(slots.to_pylist(), shares.to_pylist())):
        dense[i, s] = v
    assert np.allclose(dense.reshape(2, 3, -1).sum(axis=2), 1)
    rng, scale = np.random.default_rng(0), np.full(3 * rules.WIDTH, 0.5)
    x = rng.normal(size=3 * rules.WIDTH + 1)
    out = rules.logistic_loss(rules._Rows(batch), x, scale, np.array([1.0, 1.0]))
    margin = dense / scale @ x[:-1] + x[-1]
    p, y = 1 / (1 + np.exp(-margin)), np.array([1.0, 0.0])
    assert np.isclose(out[0], -0.5 * (np.log(p[0]) + np.log(1 - p[1]))) and np.allclose(out[1:], np.append((0.5 * (p - y)) @ dense / scale, (0.5 * (p - y)).sum()))


def test_isotonic_is_monotone():
    from driftlens.llm.quality import isotonic

    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    knots, levels = isotonic(x, (x + rng.normal(size=300) > 0).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all()


# -- quality rules -----------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + j for v in windows.values() if len(v) > 1 for i in v for j in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_count_exactly(docs, plain, edge, nothing, labels):
    from driftlens.llm import quality_rules

    lab = docs.sparkSession.read.parquet(f"{SF}/labels.parquet")
    for df, source, marks in ((docs, dict(plain), lab), (edge, None, labels)):
        rows = quality_rules.apply_rules(df, marks).collect()
        if source is not None:
            for r in rows:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(source[r.doc_id])
        else:
            assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted(brute_counts(t) for _, t in texts_of(df))
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(nothing, labels).count() == 0
    assert quality_rules.keep_good(edge, labels.where("false")).columns == edge.columns


# -- tokens ------------------------------------------------------------------------------------


def reference_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe_equals_the_library(docs, plain, edge, nothing):
    from driftlens.llm import bpe

    path, library = reference_tokenizer("byte_bpe_50k.json")
    for df in (docs.where("doc_id < 60"), edge):
        want = collections.Counter()
        for i, t in texts_of(df):
            ids = library.encode(t or "", add_special_tokens=False).ids
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert collections.Counter(map(tuple, bpe.round_trip(df, path).collect())) == want
    assert bpe.encode_documents(edge, path).where(F.size("ids") > 0).count() > 5
    assert bpe.round_trip(nothing, path).count() == 0


def test_packing_is_whole_and_tight(docs, edge, nothing):
    from driftlens.llm import packing

    path, library = reference_tokenizer("word_bpe_49k.json")
    for df in (docs, edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts_of(df)}
        rows = packing.pack(df, path).collect()
        seen = collections.defaultdict(list)
        where = collections.defaultdict(list)
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
            seen[r.doc_id].append((r.start, r.length))
            where[r.sequence_id].append((r.offset, r.length))
        for parts, size in ((seen, {i: len(x) for i, x in ids.items()}), (where, None)):
            for k, spans in parts.items():
                at = 0
                for start, length in sorted(spans):
                    assert start == at and length > 0
                    at += length
                assert at == size[k] if size else at <= 2048
        assert set(seen) == set(ids)
        assert len(where) <= sum(map(len, ids.values())) / 2048 * 1.02 + 2
    assert packing.pack(nothing, path).count() == 0
    assert packing.pack(edge, path).select("doc_id").where("doc_id IS NULL").count() > 0


# -- licences ----------------------------------------------------------------------------------


def test_license_scan_equals_sql_and_finds_variants(docs, edge, nothing):
    from driftlens.llm import licenses

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = licenses.scan(docs)
    want = con.sql(licenses.scan_sql())
    order = [want.columns.index(c) for c in rows.columns]
    assert sorted(map(tuple, rows.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
    found = {r.doc_id: r for r in licenses.scan(edge.where("doc_id IS NOT NULL")).collect()}
    assert found[16].licenses == "MIT" and found[0].n_matches == 0 and found[5].n_matches == 0
    assert licenses.scan(edge).count() == len(edge_rows()) and licenses.scan(nothing).count() == 0


def test_license_scan_keeps_long_units_of_few_bigrams(spark):
    from driftlens.llm import licenses

    documents = [(0, "Licensed under the MIT License. " * 500), (1, "Licensed under the MIT License.\n" * 500), (2, LONG + " licensed under the MIT license")]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", documents)
    rows = licenses.scan(spark.createDataFrame(documents, "doc_id long, text string"))
    want = con.sql(licenses.scan_sql())
    order = [want.columns.index(c) for c in rows.columns]
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted(tuple(r[i] for i in order) for r in want.fetchall())
    assert [(r[1], r[2]) for r in got] == [(1, "MIT"), (2, "MIT"), (0, "")]


def notices_of(text, templates, threshold=0.85):
    """Every window of every template by definition, then the best that do not overlap."""
    from driftlens.llm import licenses

    words = licenses.normal_words(text or "")
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    found = []
    for i, (name, body) in enumerate(templates):
        own = set(licenses.bigrams(licenses.normal_words(body)))
        most = int(len(own) * (2 - threshold) / threshold + 1e-9)
        for a in range(len(grams)):
            for b in range(a, min(len(grams), a + most)):
                if grams[a] in own and grams[b] in own:
                    held = set(grams[a : b + 1])
                    if (dice := 2 * len(held & own) / (len(held) + len(own))) >= threshold:
                        found.append((dice, len(own), -i, -a, b, name))
    kept = []
    for c in sorted(found, reverse=True):
        if all(-k[3] > c[4] or -c[3] > k[4] for k in kept):
            kept.append(c)
    return len(kept), ",".join(sorted({k[5] for k in kept})), round(max((k[0] for k in kept), default=0.0), 6)


def test_license_notices_inside_units_against_brute_force(spark, docs, plain, edge, nothing):
    from driftlens.llm import licenses, notices

    bodies = [t for _, t in notices.NOTICES]
    texts = [
        "Foo is licensed under the MIT License.",
        "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0. See LICENSE for details.",
        "Some words. " + licenses.TEMPLATES[3][1].replace("obtaining", "or body obtaining") + " More words.",
        "Foo. " + bodies[len(licenses.TEMPLATES) + 1].replace("the copyright holder", "Foo Inc") + " Bar.",
        "# " + notices._gnu("", "3").replace(" the ", "\n#  the ") + " You should have received a copy.",
        "Licensed under the MIT License. Licensed under the MIT License. This work is licensed under the GNU General Public License, version 3.",
        "nothing of the kind is licensed here, without conditions", None, "", "license", "MIT License " * 400,
        *bodies,
    ]
    got = {r.doc_id: (r.n_notices, r.licenses, r.best_dice) for r in notices.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [notices_of(t, notices.NOTICES) for t in texts]
    assert [got[i][1] for i in range(7)] == ["MIT", "Apache-2.0", "MIT", "BSD-3-Clause", "GPL-3.0", "GPL-3.0,MIT", ""]
    assert got[5][0] == 3 and all(got[11 + i][1] == name for i, (name, _) in enumerate(notices.NOTICES))
    assert {(r.doc_id, r.n_notices, r.licenses, r.best_dice) for r in notices.find(docs).collect()} == {(i, *notices_of(t, notices.NOTICES)) for i, t in plain}
    assert notices.find(edge).count() == len(edge_rows()) and notices.find(nothing).count() == 0


# -- n-gram join -------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_copies():
    rng = np.random.default_rng(5)
    base = [f"word{i}" for i in rng.integers(0, 5000, 150)]
    out = []
    for i in range(120):
        w = list(base)
        for at in rng.integers(0, 150, i % 5):
            w[at] = f"edit{rng.integers(0, 40)}"
        out.append((i, " ".join(w)))
    return out


def test_ngram_join_against_brute_force(spark, docs, plain, edge, nothing):
    from driftlens.llm import ngram_join

    copies = near_copies()
    cases = [(docs, plain, 3, 90), (spark.createDataFrame(copies, "doc_id long, text string"), copies, 3, 90), (spark.createDataFrame(copies, "doc_id long, text string"), copies, 5, 80)]
    for df, rows, size, percent in cases:
        want = brute_components(rows, size, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, size, percent).collect()}
        assert got == want
    rows = ngram_join.near_duplicates(edge, 3, 90).collect()
    assert len(rows) == len(edge_rows())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[6].component_id == 5 and by[8].component_id == 7 and by[0].component_id == 0 and by[3].n_shingles == 1
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert ngram_join.near_duplicates(nothing).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 6").count() == 0


def test_ngram_join_compares_every_text_of_a_repeated_id(spark):
    from driftlens.llm import ngram_join

    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcd"]
    rows = [(1, texts[0]), (2, texts[1]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[2]), (7, texts[3] + " end"), (8, None), (8, texts[3]), (None, texts[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df, 3, 90).collect())
    assert got == collections.Counter([(1, 1), (2, 2), (5, 1), (5, 2), (5, 5), (5, 5), (6, 5), (7, 5), (8, 8), (8, 5), (None, None)])
    kept = ngram_join.keep_one(df, 3, 90)
    want = collections.Counter([(1, texts[0]), (2, texts[1]), (5, texts[2]), (5, texts[3]), (8, None), (None, texts[0])])
    assert kept.columns == df.columns and collections.Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_ngram_join_blocks_of_hot_keys(spark, monkeypatch):
    """Small blocks, and every key hot: connected members and the others still all meet."""
    from driftlens.llm import ngram_join

    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # one chain of near copies, two clusters, and texts that only share their rarest words
        w = list(base)
        for at in rng.integers(0, 60, 0 if i % 3 else 1 + i % 4):
            w[at] = f"e{rng.integers(0, 6)}"
        rows.append((i, " ".join(w if i < 110 else ["rare", "pair", "here", *(f"x{i % 7}y{k}" for k in range(i % 9 + 25))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent, group, hot in ((3, 90, 8, 1 << 40), (3, 60, 8, 1 << 40), (3, 90, 8, 0), (5, 80, 3, 20)):
        monkeypatch.setattr(ngram_join, "GROUP", group)
        monkeypatch.setattr(ngram_join, "HOT", hot)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, size, percent).collect()}
        assert got == brute_components(rows, size, percent)


def test_ngram_join_in_parts(spark, docs, plain, monkeypatch):
    """Meetings and units of blocks dealt over many tables: every pair is still compared."""
    from driftlens.llm import ngram_join

    monkeypatch.setattr(ngram_join, "POST_PARTS", 4)
    monkeypatch.setattr(ngram_join, "LEAST_POSTS", 0)
    monkeypatch.setattr(ngram_join, "LEAST_ROOM", 1)
    monkeypatch.setattr(ngram_join, "SET_SHARE", 40)
    monkeypatch.setattr(ngram_join, "GROUP", 16)
    parts, write = {}, ngram_join.materialize_parts

    def counted(tables, tag):
        parts[tag] = max(len(tables), parts.get(tag, 0))
        return write(tables, tag)

    monkeypatch.setattr(ngram_join, "materialize_parts", counted)
    copies = near_copies()
    for df, rows, size, percent in ((docs, plain, 3, 90), (spark.createDataFrame(copies, "doc_id long, text string"), copies, 5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, size, percent).collect()}
        assert got == brute_components(rows, size, percent)
    assert min(parts.values()) > 1 and set(parts) == {"meetings", "candidates", "links"}


def test_near_copies_keep_little_on_disk(spark, monkeypatch):
    """No table written on the way to the near copies shuffles more than 1.28 times the input's files (1.37 before the parts, 1.18 with them)."""
    import contextlib
    import glob
    import os

    from driftlens.llm import _store, ngram_join

    monkeypatch.setattr(ngram_join, "LEAST_POSTS", 0, raising=False)
    monkeypatch.setattr(ngram_join, "LEAST_ROOM", 1, raising=False)
    most, inside, jvm = [0], _store._shuffles_end_with_the_job, spark.sparkContext._jsc.sc()

    def shuffled():
        jvm.listenerBus().waitUntilEmpty(30_000)
        found = jvm.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    @contextlib.contextmanager
    def watched(session):
        before = shuffled()
        with inside(session):
            yield
        most[0] = max(most[0], shuffled() - before)

    monkeypatch.setattr(_store, "_shuffles_end_with_the_job", watched)
    path = "/root/testdata/sf0.01/documents.parquet"
    files = sum(map(os.path.getsize, glob.glob(f"{path}/*.parquet") or [path]))
    assert ngram_join.keep_one(spark.read.parquet(path)).count() > 0
    assert most[0] < 1.28 * files, most[0] / files


def test_near_copies_write_few_files(spark, monkeypatch):
    """Each file costs an executor processes on a local store: tables of few rows take few files."""
    import glob

    from driftlens.llm import ngram_join

    files, write, write_parts = {}, ngram_join.materialize, ngram_join.materialize_parts

    def counted(table, tag):
        return seen(write(table, tag), tag, 1)

    def counted_parts(tables, tag):
        return seen(write_parts(tables, tag), tag, len(tables))

    def seen(found, tag, parts):
        path = found[1].removeprefix("file:")
        files[tag] = max(files.get(tag, 0), len(glob.glob(f"{path}/*.parquet")) / parts)
        return found

    monkeypatch.setattr(ngram_join, "materialize", counted)
    monkeypatch.setattr(ngram_join, "materialize_parts", counted_parts)
    copies = near_copies()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), 5, 80).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_components(copies, 5, 80)
    assert {t: n for t, n in files.items() if t in ("links", "candidates", "sizes") and n > 2} == {}


@pytest.mark.parametrize("most", [1 << 26, 1 << 16])
def test_likely_passes_every_wanted_id_and_few_others(spark, monkeypatch, most):
    from driftlens.llm import ngram_join

    monkeypatch.setattr(ngram_join, "MOST_BITS", most)
    ids = spark.range(40_000).select((F.col("id") * 977 - 5_000_000).alias("doc_id"))
    wanted = ids.where("pmod(doc_id, 10) = 3")
    passed = ids.where(ngram_join._likely(wanted)(F.col("doc_id")))
    assert wanted.join(passed, "doc_id", "left_anti").count() == 0
    assert passed.count() < wanted.count() * (1.7 if most > 1 << 16 else 1.9)
    assert ids.where(ngram_join._likely(wanted.where("false"))(F.col("doc_id"))).count() == 0
    rows = ids.select("doc_id", F.lit("x").alias("text"))
    rows = rows.unionByName(rows.where("pmod(doc_id, 20) = 3")).unionByName(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in ngram_join._chosen(rows, wanted).collect()) == sorted(r.doc_id for r in wanted.collect())


# -- nearest neighbours ------------------------------------------------------------------------


def test_neighbours_recall_ties_and_unusable_vectors(spark):
    from driftlens.llm import ann

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = ann.unit(np.array([r.embedding for r in rows], float))
    got = collections.defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        best = np.lexsort((ids, -s))[:5]
        hits += len(set(ids[best]) & {v for v, _ in got[q]})
    assert hits / (5 * len(got)) >= 0.9
    small = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0])]
    out = ann.search(spark.createDataFrame([(i, v, 1.0, 2) for i, v in small], "vec_id long, embedding array<float>, score double, rank int")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(out)] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_do_not_hang_on_one_row_of_another_width(spark, monkeypatch):
    from driftlens.llm import ann

    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    want = {(r.query_id, r.rank): r.vec_id for r in ann.search(table).collect()}
    first = table.orderBy(F.xxhash64("vec_id"), "vec_id").first().vec_id
    odd = table.withColumn("embedding", F.when(F.col("vec_id") == first, F.slice("embedding", 1, 2)).otherwise(F.col("embedding")))
    got = {(r.query_id, r.rank): r.vec_id for r in ann.search(odd).collect()}
    assert len(want) - 5 <= len(got) <= len(want) and first not in got.values()
    # many blocks give the same answers as one, as long as every block is searched whole
    monkeypatch.setattr(ann, "BLOCK_ROWS", 60)
    assert {(r.query_id, r.rank): r.vec_id for r in ann.search(table).collect()} == {(r.query_id, r.rank): r.vec_id for r in brute_neighbours(table)}


def brute_neighbours(table):
    from driftlens.llm import ann

    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), ann.unit(np.array([r.embedding for r in rows], float))
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        out += [Row(query_id=ids[q], rank=k + 1, vec_id=ids[j]) for k, j in enumerate(np.lexsort((ids, -s))[:5])]
    return out


def test_labelled_sample_is_bounded_and_counts_a_document_once(spark):
    from driftlens.llm._labels import labelled_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), *[(3, "c")] * 500], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "doc_id long, quality int")
    got = {r.doc_id: r.text for r in labelled_sample(docs, lab, "quality", 9).collect()}
    assert got == {i: t for i, t in {1: "a", 2: None, 3: "c"}.items() if zlib.crc32(str(i).encode()) % 5} and labelled_sample(docs, lab, "quality", 1).count() <= 1


# -- suffix-array dedup ------------------------------------------------------------------------


def brute_dedup(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            w = b[k : k + span]
            if i is not None and first.get(w, i) >= i:
                first[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if i is not None and first[b[k : k + span]] < i:
                gone[k : k + span] = b"\1" * span
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_neighbours_recall_where_the_share_governs(monkeypatch):
    import pyarrow.parquet as pq

    from driftlens.llm import ann

    monkeypatch.setattr(ann, "LEAST", 0)
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, raw = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    units = ann.unit(raw)
    order = np.random.default_rng(1).permutation(len(ids))
    pivots = units[order[: ann.PIVOTS]]
    block, queries = ann.Block(ids, raw, pivots, ann.PREFIX), order[-300:]
    ranks, caught = ann.permutations(raw[queries], pivots, ann.PREFIX), 0
    for rank, q in zip(ranks, queries, strict=True):
        best = [j for j in np.lexsort((ids, -(units @ units[q]))) if j != q][:5]
        caught += len(set(ids[best]) & set(block.nearest(units[q], ids[q], rank, 5)[0]))
    assert caught >= 0.95 * 5 * len(queries)


def test_suffix_dedup_against_brute_force(spark, docs, plain, edge, nothing, monkeypatch):
    from driftlens.llm import suffix_dedup

    copies = near_copies()
    repeats = [(i, "ab" * 40 + "x" * i + "ab" * 40 + PASSAGE[: 60 + i]) for i in range(30)]
    for df, rows in ((docs, plain), (edge, texts_of(edge)), *((spark.createDataFrame(r, "doc_id long, text string"), r) for r in (copies, repeats))):
        assert collections.Counter(map(tuple, suffix_dedup.report(df).collect())) == collections.Counter(brute_dedup(rows))
    assert suffix_dedup.report(nothing).count() == 0
    out = suffix_dedup.deduplicate(edge)
    assert out.columns == edge.columns and out.where("doc_id = 6").count() == 0 and out.where("text IS NULL").count() == 2


def test_crowded_anchors_take_the_window_path(spark):
    from driftlens.llm import suffix_dedup

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 6)) + f" {PASSAGE} " + " ".join(f"v{x}" for x in rng.integers(0, 10**6, 6))) for i in range(150)]
    got = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_dedup(rows))


def test_a_string_at_many_places_travels_once(spark):
    from driftlens.llm import suffix_dedup

    rng = np.random.default_rng(4)
    apart = [f"{PASSAGE[:90]} s{x} " for x in range(40)]
    rows = []
    for i in range(130):
        own = " ".join(f"u{x}" for x in rng.integers(0, 10**6, 5))
        rows.append((i, own + "Is onhe. " * int(rng.integers(0, 60)) + own + "".join(rng.permutation(apart)[: i % 4]) + "z" * int(rng.integers(0, 200) * (i % 7 == 0))))
    rows += [(500, rows[3][1] * 3), (500, rows[3][1] * 3), (None, rows[5][1]), (501, "Is onhe. " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        got = suffix_dedup.report(df.repartition(parts)).collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(brute_dedup(rows))
    few = spark.createDataFrame([r for r in rows if r[0] in (3, 7, 10, 500, 501)], "doc_id long, text string")
    shared = suffix_dedup._shared(suffix_dedup._anchor_rows(few), 2).where("doc IS NOT NULL").groupBy("doc").agg(F.collect_list("gram").alias("grams"))
    sent = suffix_dedup._context_rows(few.join(shared, few.doc_id == shared.doc).select("doc_id", "text", "grams").coalesce(1), spark.sparkContext.broadcast(np.zeros(0, np.uint64)))
    assert sent.where("key IS NOT NULL").groupBy("key", "doc", "size", "bytes").count().where("count > 1").count() == 0
    assert sent.where("length(more) > 0").count() > 0


# -- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_run(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near copies", "repeated passages", "packing"]
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, SF)
        assert out.columns == docs.columns and 0 < out.count() <= stage.count()
        stage = spark.createDataFrame(out.collect(), docs.schema)
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert sum(q == 1 and i not in kept for i, q in lab.items()) <= 0.05 * len(lab)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_stages_against_brute_force_and_verdicts(spark, docs, plain):
    import corpus_pipeline
    from driftlens.llm import quality, quality_rules

    stages, lab = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/labels.parquet")
    whole = collections.Counter(map(tuple, docs.select("doc_id", "text").collect()))

    def rows(name):
        return collections.Counter((r.doc_id, r.text) for r in stages[name](spark, docs, SF).collect())

    good = {r.doc_id for r in quality.classify(docs, lab).where("predicted = 1").collect()}
    assert rows("quality classifier") == collections.Counter({k: n for k, n in whole.items() if k[0] in good})
    passed = {r.doc_id for r in quality_rules.apply_rules(docs, lab).where("kept").collect()}
    assert rows("quality rules") == collections.Counter({k: n for k, n in whole.items() if k[0] in passed})
    groups = brute_components(plain, 5, 80)
    assert rows("near copies") == collections.Counter({k: n for k, n in whole.items() if groups[k[0]][1] == k[0]})
    want = sorted((i, digest) for i, size, gone, _, digest in brute_dedup(plain) if not gone or gone < size)
    assert sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows("repeated passages").elements()) == want


def test_pipeline_run_packs_what_the_stages_keep(spark, docs):
    import corpus_pipeline
    from driftlens.llm import quality, quality_rules

    lab = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.classify(docs, lab).where("predicted = 1").select("doc_id")
    first = spark.createDataFrame(docs.join(good, "doc_id", "left_semi").collect(), docs.schema)
    passed = {r.doc_id for r in quality_rules.apply_rules(first, lab).where("kept").collect()}
    second = [r for r in first.select(*docs.columns).collect() if r.doc_id in passed]
    groups = brute_components([(r.doc_id, r.text) for r in second], 5, 80)
    third = [r for r in second if groups[r.doc_id][1] == r.doc_id]
    cut = dict(corpus_pipeline.STAGES)["repeated passages"](spark, spark.createDataFrame(third, docs.schema), SF).collect()
    want = sorted((i, digest) for i, size, gone, _, digest in brute_dedup([(r.doc_id, r.text) for r in third]) if not gone or gone < size)
    assert sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut) == want
    _, library = reference_tokenizer("word_bpe_49k.json")
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in cut}
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
    assert set(pieces) == set(ids)
    for i, spans in pieces.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[i])
