"""Importance resampling, best-fit packing and the divergence audit against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfweek.llm import best_fit, divergence, importance
from shelfweek.llm.tokens import ByteTokenizer, WordTokenizer

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AWKWARD = ["", " \n\t ", "a" * 3000, "don't STOP", "x<|endoftext|> y", "é÷×ß ﬁ ² Ⅷ", "\0\x1c zero", "中文 😀 é", "1234 !?'s", "  nbsp"]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resampled(docs, target):
    held = [(i, *features(t)) for i, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for fs in texts for f in fs) for texts in ([h[2] for h in held], [features(x)[1] for x in target]))
    n_s, n_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t)))
    rows = []
    for i, n, fs in held:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n >= 20, i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    rows.sort(key=lambda r: (not r[0], -r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    drawn = sum(r[0] for r in rows) * 5 // 100
    return Counter((*r[1:], k + 1 if r[0] and k < drawn else None) for k, r in enumerate(rows))


def test_resample_edges(spark, edge_docs, no_docs):
    extra = [(100 + k, " ".join(["w" * 300, "W", "é", "zz"] * (k + 3))) for k in range(30)]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    target = ["one two three", None, "w é ZZ " + "w" * 300]
    out = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(tuple(r) for r in out.collect()) == resampled([tuple(r) for r in docs.collect()], target)
    assert importance.resample(no_docs, no_docs).count() == 0
    clash = edge_docs.withColumn("score", edge_docs.doc_id).withColumn("open", edge_docs.text)
    assert importance.resample(clash, no_docs).count() == edge_docs.count()


def test_resample_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in importance.op11_importance(spark, sf).collect()) == resampled([tuple(r) for r in docs], target)


def test_crc_tables_do_not_depend_on_the_head():
    words = [b"alpha", b"b", b"x" * 400, b"alpha", b"b", b"gamma"]
    different = list(dict.fromkeys(words))
    import pyarrow as pa

    ids = np.array([different.index(w) for w in words])
    crcs = np.array([zlib.crc32(b"alpha"), zlib.crc32(b"b")], dtype=np.uint32)
    pair = np.array([zlib.crc32(b"alpha b")], dtype=np.uint32)
    full = importance.Buckets([b"alpha", b"b"], crcs, np.array([1]), pair)
    none = importance.Buckets([], crcs[:0], np.array([], dtype=np.int64), pair[:0])
    want = [[zlib.crc32(b" ".join(words[i : i + k])) % 10000 for i in range(len(words) - k + 1)] for k in (1, 2, 3)]
    for known in (full, none):
        assert [b.tolist() for b in known.of(pa.array(different, pa.binary()), ids)] == want


def test_tokenizers_give_the_library_ids(small):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [r.text for r in small.limit(300).collect()] + AWKWARD
    for name, kind in (("byte_bpe_50k.json", ByteTokenizer), ("word_bpe_49k.json", WordTokenizer)):
        path = public_tokenizers.path(name)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        words = kind(path)
        assert words.fast
        got = words.encode(texts) if kind is WordTokenizer else [words.encode(t) for t in texts]
        assert [g.tolist() for g in got] == want


@pytest.mark.parametrize("window", [16, 2048])
def test_best_fit_round_trip(spark, edge_docs, no_docs, window):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = best_fit.pack(edge_docs, path, window).toPandas()
    model = Tokenizer.from_file(path)
    whole = Counter()
    for row in edge_docs.collect():
        ids = np.array(model.encode(row.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        cuts = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            whole[row.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    rows = out[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(out.notna(), None)
    assert Counter(tuple(None if v is None or v != v else int(v) for v in r) for r in rows.itertuples(index=False)) == whole
    placed = out.sort_values(["sequence_id", "offset"])
    ends = placed.groupby("sequence_id")["length"]
    assert (ends.cumsum() - placed["length"] == placed["offset"]).all()
    assert ends.sum().max() <= window
    assert sorted(out["sequence_id"].unique()) == list(range(out["sequence_id"].max() + 1))
    assert best_fit.pack(no_docs, path, window).count() == 0


def test_configurations_are_near_the_lower_bound():
    rng = np.random.default_rng(3)
    counts = np.zeros(257, dtype=np.int64)
    counts[1:] = rng.geometric(0.001, 256)
    counts[200] = 50_000  # a third of all pieces
    made, left = best_fit.configurations(counts, 256)
    assert sum(n for _, n in made) > 0 and left.min() >= 0
    covered = left.copy()
    for content, n in made:
        assert sum(length * k for length, k in content.items()) <= 256
        for length, k in content.items():
            covered[length] += n * k
    assert (covered == counts).all()
    groups = best_fit.fill_best_fit(made, left, 256)
    # lengths from 200 take a sequence each, where only lengths up to 56 fit beside them
    tokens = np.arange(257) * counts
    beside = int(((256 - np.arange(200, 257)) * counts[200:]).sum())
    bound = int(counts[200:].sum()) + -(-(int(tokens[57:200].sum()) + max(0, int(tokens[:57].sum()) - beside)) // 256)
    assert sum(n for _, n in groups) <= bound * 1.02


def test_knapsack_against_all_fillings():
    rng = np.random.default_rng(5)
    for _ in range(20):
        value = np.full(13, -np.inf)
        lengths = rng.choice(np.arange(1, 13), 4, replace=False)
        value[lengths] = rng.random(4) * lengths
        best, _ = best_fit.best_fills(value, 12)
        copies = [range(12 // int(l) + 1) for l in lengths]
        want = max(sum(n * value[l] for n, l in zip(c, lengths)) for c in itertools.product(*copies) if np.dot(c, lengths) <= 12)
        assert best[12] == pytest.approx(want)


def audited(rows, min_docs, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(count):
            below = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // below for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda v: (-v[0], v[1].encode()))[:top])):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return Counter(out)


def test_divergence_small(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = ["Ab", "cd", "éf", "gh", "中", "ij", "kl9mn", "x_y"]
    rows = [
        (f"l{k % 2}" if k % 11 else None, f"s{min(int(rng.geometric(0.4)), 5)}" if k % 13 else None,
         " ".join(rng.choice(words, int(rng.integers(0, 9)))) if k % 7 else None)
        for k in range(300)
    ]
    rows += [("lonely", "only", "Ab"), ("empty", "a", None), ("empty", "b", "123")] + [("l0", "s1", "ab ab cd")] * 40
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, place int, term string")
    want = audited(rows, 3, 4)
    got = divergence.divergence(docs.repartition(3), 3, 4)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert Counter(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(divergence, "HELD_WORDS", 5)  # many slices, trees and hand-overs
    monkeypatch.setattr(divergence, "TREE_CELLS", 4)
    monkeypatch.setattr(divergence, "HELD", 1)
    assert Counter(tuple(r) for r in divergence.divergence(docs, 3, 4).collect()) == want


def test_divergence_edges(edge_docs, no_docs):
    assert divergence.divergence(no_docs).count() == 0
    rows = [(r.lang, r.source, r.text) for r in edge_docs.collect()]
    assert Counter(tuple(r) for r in divergence.divergence(edge_docs, 1).collect()) == audited(rows, 1, 50)


def test_tree_counts_each_combination_once():
    """Terms that share a path add to one node: their corrections equal those of the terms one by one."""
    paths = [[(1, 3), (2, 4)], [(1, 3), (2, 4), (3, 9)], [(1, 3), (3, 2)], [(2, 4)]]
    times = np.array([5, 1, 2, 7])
    size = np.array([len(p) for p in paths])
    flat = [c for p in paths for c in p]
    place, n = (np.array(v) for v in zip(*flat))
    cells = {"place": place, "n": n, "p": 10 * place + n, "base": 7 * place}
    start = np.cumsum(size) - size
    got = divergence.corrections(np.zeros(4, dtype=np.int64), start, size, times, cells).groupby(["a", "b"])["fix"].sum().to_dict()
    want = Counter()
    for path, k in zip(paths, times.tolist()):
        for (a, na), (b, nb) in itertools.combinations(path, 2):
            pa, pb, za, zb = 10 * a + na, 10 * b + nb, 7 * a, 7 * b
            want[a, b] += k * (abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb))
    assert got == dict(want)
    nodes = list(divergence._nodes(np.zeros(4, dtype=np.int64), start, size, times, cells))
    assert sum(len(rows) for _, rows, _ in nodes) == 5  # 9 elements in 5 nodes
