"""Operators that judge single texts, against brute force, DuckDB and hand-made cases."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from shelfweek.llm import html_text, licenses, masked_lm, packing, quality_model, quality_rules, toxicity, url_filter

SPACE = r"[^\x20\x09-\x0D]+"


def columns_stay(out, docs, added):
    assert out.columns == [*(c for c in docs.columns if c != added), added]


# ---- quality rules ----


def brute_quality(text):
    words = re.findall(SPACE, text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = pd.Series(windows).value_counts() if windows else {}
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(edge_docs, small):
    for docs in (edge_docs, small.limit(150)):
        out = quality_rules.quality(docs)
        columns_stay(out, docs, "quality")
        for r in out.collect():
            q = r.quality
            assert brute_quality(r.text) == (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words)
            assert not (q.kept and q.base_failed)


def test_quality_lines(spark, no_docs):
    good = "The quick brown fox walked over the long hill and came back home again after noon. " * 6
    rows = [
        (1, good.strip()), (2, "\n".join(["Home | News | Sport | About | Contact"] * 2 + [good])), (3, "a | b | c | d\n" * 40),
        (4, "\n".join(f"WORD{i}!! LOUD{i}!! MORE{i}!!" for i in range(40))), (5, good + "\nAll rights reserved."),
    ]
    out = {r.doc_id: r.quality for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].clean_text.count("|") for i in (1, 2)] == [0, 0]
    assert out[2].clean_text == good and "reserved" not in out[5].clean_text
    assert not out[3].kept and not out[4].kept
    assert quality_rules.quality(no_docs).count() == 0


def test_quality_filter_stays_above(edge_docs):
    assert quality_rules.quality(edge_docs).filter("quality.kept").select("doc_id").count() == 2


# ---- urls ----

PAGES = [
    (1, "http://a.org/x", '<link rel="canonical" href="http://b.example.com/en/1">'),
    (2, "http://c.org/y#f", '<META http-equiv=refresh content="0; URL=/z">'),
    (3, "https://c.org/z", '<link href="//q.net/es/9" rel=canonical>'),
    (4, "http://q.net/es/9", None), (5, None, None), (6, "foo", "x"), (7, "http://a.org/x#t", ""),
    (8, "http://d.org/p", "<link rel=canonical href='http://c.org/y'>"), (8, "http://d.org/p", None),
    (10, "HTTP://WWW.Example.com/en/?q", ""), (11, "http://X.com", ""), (12, "ftp://net/fr/", ""),
    (13, "http://e.org/1", '<link rel=canonical href="http://m.com/">'), (14, "http://e.org/2", '<link rel=canonical href="http://e.org/1"><meta http-equiv="refresh" content="1;url=http://y.net/fr/">'),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "h") for p in PAGES], "page_id long, url string, html string, host string")


def test_url_rules_and_aliases(spark, pages):
    out = url_filter.judge(pages)
    columns_stay(out, pages, "judged")
    got = sorted(((r.page_id, *r.judged) for r in out.collect()), key=str)
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype(object))
    con.execute("CREATE VIEW pages AS SELECT page_id::BIGINT page_id, url::VARCHAR url, html::VARCHAR html FROM frame")
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.OP5_SQL})").fetchall(), key=str)
    assert got == want
    said = {g[0]: g[4] for g in got}
    assert [said[i] for i in (1, 2, 3, 4, 5, 7, 8, 13, 14)] == ["block"] * 4 + ["allow", "block", "block", "allow", "allow"]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_hub(spark):
    links = spark.createDataFrame([(f"a{i}.org/", "hub.org/") for i in range(500)] + [("hub.org/", "x.net/es/")], "a string, b string")
    pages = spark.createDataFrame([(i, f"http://a{i}.org/", None) for i in range(500)], "page_id long, url string, html string")
    assert {r.judged.verdict for r in url_filter.judge(pages, links=links).collect()} == {"block"}


# ---- html ----


def test_html_cases(spark):
    cases = {
        None: "", "": "", "plain &amp; text": "plain & text",
        "<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>One\n two<b> three</b><br><p>Four &lt;5&gt;</article>"
        "<div class='comments'><p>I disagree with all of this, dear author.</p></div><footer>&copy; me</footer>": "Head\nOne two three\nFour <5>",
        "<body><div id=sidebar>Links</div><div><p>Long text, with words in it, here.</p><p>And some more of it.</p></div><form>Search<input></form>"
        '<script>var t="</p>"; if (a<b) {}</script><!-- <p>no</p> --><div class="ad">Buy</div>': "Long text, with words in it, here.\nAnd some more of it.",
        "<p>cut off in <b>the middle &am": "cut off in the middle &am",
    }
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "page_id long, html string")
    out = html_text.main_text(rows)
    columns_stay(out, rows, "main_text")
    assert {r.html: r.main_text for r in out.collect()} == cases
    assert html_text.main_text(rows.limit(0)).count() == 0


def test_html_of_the_tables(spark):
    """The pages' article paragraphs, taken from the markup by plain patterns."""
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.main_text(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert r.main_text == "\n".join(b for b in blocks if b)


# ---- licences ----


def test_licenses(spark, edge_docs, no_docs):
    docs = edge_docs.unionByName(spark.createDataFrame([
        (20, "Released UNDER the-MIT/License. Licensed under CC BY-NC 4.0, cc by nc by nc."), (21, "Apache License, Version 2.0; under the mit license under the mit license"),
        (22, "This work is licensed under the GNU General Public License, version 3."), (23, "general public license of mit"),
    ], "doc_id long, text string"), allowMissingColumns=True)
    out = licenses.scan(docs)
    columns_stay(out, docs, "licence")
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for r in out.collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = sorted((label, i) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert r.licence.n_words == len(words)
        assert sorted((m.label, m.start) for m in r.licence.matches if m.exact) == want
        labels = {m.label for m in r.licence.matches}
        assert ("gpl-3" in labels) == (r.doc_id == 22) and ("all-rights-reserved" in labels) == (r.doc_id == 1)
    assert licenses.scan(no_docs).count() == 0


# ---- toxicity ----


def test_toxicity_held_out(spark, small, edge_docs, no_docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(small, labels.filter(~toxicity.held_out(labels.doc_id)))
    scored = toxicity.with_toxicity(small, model).join(labels, "doc_id").filter(toxicity.held_out(labels.doc_id)).toPandas()
    hit = scored["toxicity"] >= toxicity.THRESHOLD
    assert (hit & (scored["toxic"] == 1)).sum() >= 0.6 * scored["toxic"].sum()
    assert (hit & (scored["toxic"] == 0)).sum() <= 0.02 * len(scored)
    edge = toxicity.with_toxicity(edge_docs, model)
    columns_stay(edge, edge_docs, "toxicity")
    got = [(r.text, r.toxicity) for r in edge.collect()]
    assert all(0 <= s <= 1 for _, s in got) and len({s for t, s in got if not (t or "").strip()}) == 1
    assert toxicity.with_toxicity(no_docs, toxicity.fit(no_docs, labels.limit(0))).count() == 0
    assert toxicity.with_toxicity(edge_docs, toxicity.fit(edge_docs, labels.limit(0))).count() == edge_docs.count()


def test_kneser_ney_sums_to_one():
    """The ratios come from two distributions over the next character: each sums to one over all that were seen."""
    words = ["abcabc", "abd", "abca", "zzz"]
    t, o = np.array([3.0, 0, 2, 1]), np.array([1.0, 4, 0, 2])
    model = toxicity.Spelling.fit(words, t, o)
    ratio = model.of(["abd", "abca", "never"])
    assert ratio[0] < 0 < ratio[1] and np.isfinite(ratio).all()
    assert not toxicity.Spelling.fit([], t[:0], o[:0]).of(["a"]).any()


# ---- packing ----


@pytest.mark.parametrize("window", [64, 2048])
def test_packing_round_trip(edge_docs, small, no_docs, window):
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    for docs in (edge_docs, small.limit(120)):
        ids = {}
        for r in docs.collect():
            ids[r.doc_id] = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out = packing.pack(docs, path, window).toPandas()
        copies = docs.toPandas()["doc_id"].value_counts(dropna=False)
        for key, part in out.groupby("doc_id", dropna=False):
            own = ids[None if pd.isna(key) else key]
            assert part["length"].sum() == len(own) * copies[key if not pd.isna(key) else np.nan]
            for r in part.itertuples():
                assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(own)
        assert out["doc_id"].nunique(dropna=False) == len(ids)
        for _, part in out.sort_values("offset").groupby("sequence_id"):
            assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= window
    assert packing.pack(no_docs, path).count() == 0


def test_best_cuts_against_all_chains():
    rng = np.random.default_rng(0)
    for _ in range(60):
        cuts = [0, *np.cumsum(rng.integers(1, 9, size=9)).tolist()]
        penalties = [0, *rng.integers(0, 5, size=9).tolist()]
        price = lambda i, j: (0 if cuts[j] - cuts[i] in (16, 8, 4) else 16 - cuts[j] + cuts[i]) + penalties[j] + packing.SEQUENCE_COST
        best = [0.0] * 10
        for j in range(1, 10):
            best[j] = min(best[i] + price(i, j) for i in range(j) if cuts[j] - cuts[i] <= 16)
        chain = packing.best_cuts(cuts, penalties, 16)
        assert chain[0] == 0 and chain[-1] == 9
        assert sum(price(i, j) for i, j in zip(chain, chain[1:])) == best[9]


# ---- quality model ----


def test_weak_labels(spark, small, edge_docs, no_docs):
    model = quality_model.fit(small)
    out = quality_model.with_quality(small, model).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    score = out["quality_model"].map(lambda q: q["score"])
    good = out["quality_y"] if "quality_y" in out else out["quality"]
    assert ((score >= 0.5) & (good == 1)).sum() >= 0.95 * (good == 1).sum()
    assert ((score < 0.5) & (good == 0)).sum() >= 0.5 * (good == 0).sum()
    edge = quality_model.with_quality(edge_docs, model)
    columns_stay(edge, edge_docs, "quality_model")
    assert edge.filter("quality_model.score BETWEEN 0 AND 1 AND size(quality_model.votes) = 7").count() == edge_docs.count()
    assert quality_model.with_quality(no_docs, quality_model.fit(no_docs)).count() == 0


# ---- masked language model ----


def test_masked_chances_sum_to_one():
    net = masked_lm.Network()
    ids = np.array([masked_lm.SIZE] * 2 + [3, 5, 9] + [masked_lm.SIZE] * 2)
    total = 0.0
    for word in range(masked_lm.SIZE):
        trial = ids.copy()
        trial[3] = word
        total += np.exp(net.log_chances(trial, np.array([3]))[0])
    assert abs(total - 1) < 1e-3


def test_masked_lm_learns(spark, small, edge_docs, no_docs):
    frequent = masked_lm.frequent_words(small)
    net = masked_lm.train(small, frequent)
    mean = lambda n: masked_lm.with_scores(small, n, frequent).selectExpr("sum(lm.log_likelihood) / sum(lm.n_words)").first()[0]
    assert mean(net) > mean(masked_lm.Network()) + 0.1
    edge = masked_lm.with_scores(edge_docs, net, frequent)
    columns_stay(edge, edge_docs, "lm")
    for r in edge.collect():
        words = licenses.words_of(r.text)
        assert r.lm.n_words == len(words) and (r.lm.score is None) == (not words)
        if words:
            assert abs(r.lm.score * len(words) - r.lm.log_likelihood) < 1e-6 * abs(r.lm.log_likelihood)
    assert masked_lm.with_scores(no_docs, masked_lm.train(no_docs, []), []).count() == 0


@pytest.mark.parametrize("known", [None, 3, 0])
def test_masked_words_of_a_shared_id_differ(spark, monkeypatch, known):
    """Likelihoods against a plain count; with few or no words held by tasks all others take the join."""
    if known is not None:
        monkeypatch.setattr(masked_lm, "KNOWN", known)
    texts = ["one amber and one ember", "a december ember, Ünïcode", "a timber is one ember", None, "", "a a a b ümber", "a timber is one ember"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frequent, net = ["a", "one"], masked_lm.Network()
    counted = Counter(w for t in texts for w in licenses.words_of(t))
    ids_of = masked_lm.Ids(frequent)
    id_of = {w: int(ids_of.of([w])[0][0]) for w in counted}
    assert id_of[b"amber"] == id_of[b"ember"] == id_of[b"timber"] and id_of[b"a"] == 0
    whole = Counter()
    for w, n in counted.items():
        whole[id_of[w]] += n
    extra = spark.createDataFrame([(9, "one lumber of a kind")], docs.schema)  # words that were not counted
    counts = masked_lm.word_counts(docs)
    scored = masked_lm.with_scores(docs.union(extra), net, frequent, counts=counts, keep=["doc_id"])
    assert scored.columns == ["doc_id", "lm"]
    got = {r.doc_id: r.lm for r in scored.collect()}
    for k, t in [*enumerate(texts), (9, "one lumber of a kind")]:
        words = licenses.words_of(t)
        ids, places, _, _ = ids_of.stream([words])
        want = float(net.log_chances(ids, places).sum()) if words else 0.0
        for w, i in zip(words, ids[places]):
            want += 0 if w.decode() in frequent else np.log(max(counted[w], 1) / (whole[int(i)] + 1))
        assert got[k].n_words == len(words) and abs(got[k].log_likelihood - want) < 1e-4
    assert got[2] == got[6]
    one = spark.createDataFrame([(1, "amber"), (2, "ember")], docs.schema)
    apart = {r.doc_id: r.lm.log_likelihood for r in masked_lm.with_scores(one, net, frequent, counts=counts).collect()}
    assert counted[b"ember"] == 4 and abs(apart[2] - apart[1] - np.log(4)) < 1e-5
