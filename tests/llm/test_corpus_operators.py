"""Operators on pairs and the pipeline, against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from shelfweek.llm import decontaminate, simhash
from shelfweek.llm.components import components
from shelfweek.llm.licenses import words_of


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400, 400 + i) for i in range(1, 200)] + [(i, i + 1) for i in range(700, 760)]
    frame = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")
    want = roots({n for p in links for n in p}, links)
    got = {r.node: r.root for r in components(frame, "a", "b").collect()}
    assert got == {n: want[n] for n in got} and {n for n in want if want[n] != n} <= set(got)
    assert components(frame.limit(0), "a", "b").count() == 0


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint_links(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 1 << 63, (1 << 64) - 1, 3, 3 << 62}
    for p in list(prints):
        for _ in range(4):
            for _ in range(rng.choice((1, 2, 2, 3))):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    own = [signed(p) for p in prints]
    near = [(a, b) for i, a in enumerate(own) for b in own[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in own], "fp long")).collect()
    assert {(r.a, r.b) for r in links} <= {(a, b) for a, b in [*near, *((b, a) for a, b in near)]} | {(r.a, r.b) for r in links}
    assert roots(own, [(r.a, r.b) for r in links]) == roots(own, near)


def test_simhash_edges(edge_docs, no_docs):
    got = simhash.simhash_components(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[2].fp == by[3].fp == by[4].fp == 0 and by[3].component_id == 2
    assert by[6].component_id == 5 and by[None].component_id is None
    assert simhash.simhash_components(no_docs).count() == 0


def test_first_of_each(spark, edge_docs, no_docs):
    """One row of each component that brute force finds, whatever becomes of nulls and repeated ids."""
    import xxhash

    def print_of(text):
        words = (text or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rng = random.Random(2)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
        texts += [base, base, [w.upper() for w in base]]
        for _ in range(5):
            t = list(base)
            t[rng.randrange(len(t))] = f"x{rng.randrange(99)}"
            texts.append(t)
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    prints = [print_of(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = roots(range(len(texts)), near)
    assert 25 < len(set(want.values())) < len(texts) - 50
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in simhash.simhash_components(frame).collect()} == want
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.with_fingerprints(frame).collect()} == dict(enumerate(prints))
    assert sorted(r.doc_id for r in simhash.first_of_each(frame).collect()) == sorted(set(want.values()))
    kept = simhash.first_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 5, 7, 8, 9]
    assert simhash.first_of_each(no_docs).count() == 0
    rows = [(7, texts[0], "b"), (7, texts[0], "a"), (None, texts[0], "a"), (7, "another text", "c"), (None, "no id here", "z"), (None, "no id here", "y"), (9, None, "n"), (8, "", "n")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = {(r.doc_id, r.text, r.root) for r in simhash.first_of_each(odd).collect()}
    assert kept == {(7, texts[0], "a"), (7, "another text", "c"), (None, "no id here", "y"), (8, "", "n")}


# ---- decontamination ----


def test_wand_finds_what_full_scores_find():
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 40))) + ". " + word() + ".") for i in range(150)]
    frequency = Counter(w for _, t in items for w in set(words_of(t)))
    index = decontaminate.Index(items, len(items), frequency)
    for _ in range(200):
        terms = {word().encode() for _ in range(60)} | set(rng.choice(index.sides)[0])
        full = Counter()
        for t in terms:
            for n, v in index.postings.get(t, ()):
                full[n] += v
        want = {n for n, v in full.items() if v >= 0.4}
        assert {n for n, _ in index.search(terms, 0.4)} == want
        grouped = {n for g in range(index.groups.shape[1]) for n, _ in index.search(terms, 0.4, g)}
        assert {n for n in want if full[n] > 0.401} <= grouped <= want | {n for n, v in full.items() if v > 0.399}


def test_leaks(spark, small, edge_docs, no_docs):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(small, items).collect()}
    runs = {r.item_id: decontaminate.runs(words_of(r.text)) for r in items.collect()}
    want = set()
    for r in small.select("doc_id", "text").collect():
        own = decontaminate.runs(words_of(r.text))
        want |= {(r.doc_id, i) for i, s in runs.items() if s and len(s & own) >= 0.8 * len(s)}
    assert got == want and want
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "A row without an id.", 0), (4, "one two three four five six", 9)], "item_id long, text string, part int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(edge_docs, odd).collect()} == {(7, 4)}
    assert decontaminate.without_leaks(edge_docs, odd).columns == edge_docs.columns
    assert decontaminate.without_leaks(edge_docs, odd).filter("doc_id = 7").count() == 0
    assert decontaminate.contaminated(no_docs, odd).count() == 0
    assert decontaminate.without_leaks(edge_docs, odd.limit(0)).count() == edge_docs.count()
    leak = "one two three four five six"
    rows = spark.createDataFrame([(None, leak), (None, "a clean text"), (3, leak), (3, "another clean text")], "doc_id long, text string")
    assert sorted(r.text for r in decontaminate.without_leaks(rows, odd).collect()) == ["a clean text", "another clean text"]


def test_models_travel_by_value(tmp_path):
    """A worker that lacks this package can unpack and use the broadcast models."""
    import subprocess
    import sys

    import numpy as np
    from pyspark import cloudpickle

    from shelfweek.llm import quality_model, toxicity

    index = decontaminate.Index([(4, "one two three four five six")], 1, {w: 1 for w in b"one two three four five six".split()})
    toxic = toxicity.ToxicModel(toxicity.Spelling.fit(["bad", "good"], np.array([3.0, 0.0]), np.array([0.0, 3.0])), toxicity.fit_logistic(np.zeros((0, 3)), np.zeros(0)))
    quality = quality_model.QualityModel(np.full(2, 0.5), np.full((7, 2, 3), 1 / 3), np.zeros((1 << quality_model.BITS) + 1, dtype=np.float32))
    use = lambda: (
        list(index.leaks(decontaminate.words_of("x one two three four five six y"))), len(toxic.scores(toxicity.Scorer(toxic.spelling), ["bad good", None])),
        float(quality.score("a few plain words stand here", {})),
    )
    (tmp_path / "m.pkl").write_bytes(cloudpickle.dumps(use))
    code = "import pickle; print(pickle.load(open('m.pkl', 'rb'))())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "([0], 2, 0.5)", out.stderr


def test_leaks_with_a_changed_answer(spark):
    """One word of the last sentence changed or cut, and copies that hold 0.4 to 0.5 of their item's score."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**7)}"
    common = " ".join(word() for _ in range(14))
    filler = " ".join(word() for _ in range(120))
    items, docs = [], []
    for i in range(20):
        body = " ".join(word() for _ in range(24))
        last = [word() for _ in range(1 + i % 4)]
        items.append((i, f"{body}. {' '.join(last)}."))
        docs += [(10 * i, f"{filler} {body}. {' '.join(['changed', *last[1:]])}. {filler}"), (10 * i + 1, f"{filler} {body}. {filler}")]
        docs.append((10 * i + 2, f"{filler} {' '.join(body.split()[:8])}. {filler}"))
    for i in range(100, 120):
        rare = [word() for _ in range(5)]
        items.append((i, f"{common} {' '.join(rare)}"))
        docs.append((10 * i, f"{filler} {common} {' '.join(rare[:2])} {filler}"))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(10 * i + k, i) for i in range(20) for k in (0, 1)} | {(10 * i, i) for i in range(100, 120)}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


# ---- pipeline ----


def test_pipeline(spark, edge_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    sizes = [docs.count()]
    from shelfweek.session import materialise

    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), f"test_{name}")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == names
            left = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert not [i for i in left if i in labels and labels[i].quality == 0]
    assert sizes[:5] == sorted(sizes[:5], reverse=True) and sizes[4] > 500
    assert {r.doc_id for r in docs.select("doc_id").collect()} == left


@pytest.mark.parametrize("frame", ["edge_docs", "no_docs"])
def test_pipeline_edges(spark, frame, request):
    docs = request.getfixturevalue(frame)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert name == "packing" or out.columns == docs.columns
        out.count()
