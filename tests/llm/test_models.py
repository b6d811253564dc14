"""Quality classifier, language model and main-text extraction."""

import html
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import lm_scoring as lm
from tessella.llm import quality as q
from tessella.llm.html_text import difference, main_text, page_lines, shared_lines

# ---------------------------------------------------------------- quality


def made(seed, n):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(["the", "of", "and"]) if r.random() < 0.4 else "".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(r.randint(30, 200))]
        bad = r.random() < 0.25
        t = " ".join(x + r.choice(["***", "%%%", "&&&"]) for x in w) if bad and i % 2 else " ".join(w[:4] * 30) if bad else " ".join(w)
        docs.append((i, t))
        if r.random() < 0.6:
            labels.append((i, int(not bad)))
    return docs, labels


@pytest.fixture(scope="module")
def classified(spark):
    docs, labels = made(5, 900)
    d = spark.createDataFrame([*docs, (2000, None), (2001, ""), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (5000, 1)], "doc_id long, quality int")
    return d, lab, dict(labels)


def test_held_out(classified):
    d, lab, labels = classified
    m = q.train(d, lab, q.fold() != 0)
    got = {r.doc_id: r.score for r in q.classify(d, m).collect()}
    held = {i: v for i, v in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(got[i] >= 0.3) == bool(v) for i, v in held.items()]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == d.count()
    assert got == {r.doc_id: r.score for r in q.classify(d.repartition(5), q.train(d.repartition(7), lab, q.fold() != 0)).collect()}


def test_moments_and_histograms_by_hand(classified):
    """Sums over all rows, by loops; the risk from moments is the risk over rows, and its gradient that of differences."""
    d, lab, labels = classified
    rows = d.select(F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 3 == 0).alias("trusted"), (F.col("doc_id") % 2 == 0).alias("half")).where("trusted is not null").limit(40).cache()
    m = q.moments(rows.repartition(3))
    x = {r: np.concatenate([[1], q.matrix([r.text.encode()])[0]]) for r in rows.collect()}
    for good in (0, 1):
        for h in (0, 1):
            assert (m[good, h] == sum(np.outer(v, v) for r, v in x.items() if r.half == h and (r.trusted or not good))).all()
    w = np.random.default_rng(1).standard_normal(q.WIDTH + 1) / 2000
    hist = q.histograms(rows.repartition(4), (w, -w))
    want = np.zeros_like(hist)
    for r, v in x.items():
        g = sum(int(round(a * q.WEIGHT)) * int(b) for a, b in zip(-w if not r.half else w, v, strict=True)) / q.WEIGHT
        for kind in {0, int(r.trusted)}:
            want[kind, min(q.BINS - 1, max(0, int((g + q.REACH) * q.BINS / (2 * q.REACH))))] += 1
    assert (hist == want).all()
    u, p = m.sum(axis=1)
    loss = lambda g, sign: (g - sign) ** 2 / 4
    mean = lambda of, sign: np.mean([loss(w @ v, sign) for r, v in x.items() if r.trusted or of == "u"])
    up, down = q.risk(w, p / p[0, 0], u / u[0, 0], 0.7)
    assert abs(up - 0.7 * mean("p", 1)) < 1e-9 and abs(down - (mean("u", -1) - 0.7 * mean("p", -1))) < 1e-9


def test_fit_reaches_the_least_risk():
    """Where the estimate stays above 0 the fit is the closed-form least of the penalised risk."""
    r = np.random.default_rng(2)
    p, u = r.standard_normal((300, 6)) + 0.4, r.standard_normal((500, 6))
    a, b = q.second_moments(p), q.second_moments(u)
    w = q.fit(a, b, 0.3, penalty=0.0, steps=4000)
    assert np.allclose((b / 500) @ w, 2 * 0.3 * a[0] / 300 - b[0] / 500, atol=1e-5) and q.risk(w, a / 300, b / 500, 0.3)[1] > 0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_of_a_known_mixture(share):
    r = np.random.default_rng(4)
    hist = lambda g: np.bincount(np.clip(((g + q.REACH) * q.BINS / (2 * q.REACH)).astype(int), 0, q.BINS - 1), minlength=q.BINS)
    n = 20_000
    u = np.concatenate([r.normal(0.8, 0.3, int(n * share)), r.normal(-0.6, 0.3, n - int(n * share))])
    assert abs(q.class_prior(hist(r.normal(0.8, 0.3, 5000)), hist(u)) - share) < 0.04


def test_bounded_trusted_rows(classified):
    d, lab, _ = classified
    many = lab.sparkSession.range(5000).select(F.col("id").alias("doc_id"))
    assert 60 < q._sampled(many, 100).count() < 140 and q._sampled(many, 5000).count() == 5000
    assert "weights" in q.train(d, lab, q.fold() != 0, trusted_rows=100)


def test_keep_good_passes_columns_through(classified):
    d, lab, _ = classified
    wide = d.withColumn("score", F.lit("mine")).withColumn("tags", F.array(F.lit("a")))
    out = q.keep_good(wide, lab, q.fold() != 0)
    assert out.columns == wide.columns and {r.score for r in out.collect()} == {"mine"} and 0 < out.count() < wide.count()


def test_score_column_gives_way(classified):
    d, lab, _ = classified
    wide = d.withColumn("Score", F.lit("old")).withColumn("trusted", F.lit(1)).withColumn("half", F.lit(2)).withColumn("_score", F.lit(3)).limit(30)
    m = q.train(d, lab, q.fold() != 0)
    out = q.classify(wide, m)
    assert out.columns == ["doc_id", "text", "trusted", "half", "_score", "score"] and dict(out.dtypes)["score"] == "double"
    assert q.keep_good(wide, lab, q.fold() != 0).columns == wide.columns


def test_long_and_tied_texts(spark, classified):
    d, lab, _ = classified
    m = q.train(d, lab, q.fold() != 0)
    long = "word and " * 500_000 + "x" * 3_000_000
    e = spark.createDataFrame([(1, long), (2, long), (3, ""), (4, None), (5, " "), (6, "a"), (7, "ab")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in q.classify(e, m).collect()}
    assert len(got) == 7 and got[1] == got[2] and got[3] == got[4] and all(0 <= x <= 1 for x in got.values())


def test_risk_is_not_negative():
    """Where positives leak into the unlabelled rows the estimate of the negatives' loss would go far below 0."""
    r = np.random.default_rng(0)
    p, u = r.standard_normal((200, 30)) + 1, np.concatenate([r.standard_normal((150, 30)) + 1, r.standard_normal((50, 30)) - 1])
    w = q.fit(q.second_moments(p), q.second_moments(u), 0.75)
    g = w[0] + u @ w[1:]
    assert g[:150].mean() > 0.4 and g[150:].mean() < -0.2


def test_without_positives(spark, empty):
    lab = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert {r.score for r in q.classify(d, q.train(d, lab, q.fold() != 9)).collect()} == {0.5}
    assert {r.score for r in q.classify(d, q.train(d, lab, q.fold() != 9, prior=0.25)).collect()} == {0.25}
    assert q.train(empty, lab, q.fold() != 9) == {"constant": 0.5} and q.classify(empty, {"constant": 0.5}).count() == 0


# ---------------------------------------------------------------- language model


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


def test_base_and_counts(docs, rows, monkeypatch):
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    tokens = {(i, t): [*(t or "").encode().lower().split(), b" "] for i, t, *_ in rows}
    c = Counter(x for i, t, *_ in rows if not held(i) for x in tokens[i, t])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w := tokens[i, t]), sum(x in c for x in w), n, round(sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)) for i, t, *_ in rows)
    scores = []
    for known in (100_000, 20):  # with 20, nearly all words' counts come from the join
        monkeypatch.setattr(lm, "KNOWN", known)
        got = lm.score_documents(docs, out).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 for r in got)
        scores.append(sorted((str(r.doc_id), round(r.score, 3)) for r in got))
    monkeypatch.undo()
    again = lm.score_documents(docs.repartition(5), out).collect()
    assert sorted((str(r.doc_id), round(r.score, 3)) for r in again) == scores[0]


def test_score_token_by_token(docs, rows, crowded, monkeypatch):
    """Every document's score by a loop over its tokens, each normalised by a sum over all classes; counts by loops too."""
    monkeypatch.setattr(lm, "KNOWN", 60)
    monkeypatch.setattr(lm, "OWN_LEAST", 40)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    m, _, _ = lm.learn(docs.select("doc_id", out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text")))
    own = {w: i for i, w in enumerate(m["own"])}
    c = Counter(x for i, t, *_ in rows if not held(i) for x in [*(t or "").encode().lower().split(), b" "])
    cls = lambda w: own.get(w, len(own) + lm.shape(w))
    mass, kinds = Counter(), Counter()
    for w, n in c.items():
        mass[cls(w)] += n
        kinds[cls(w)] += 1
    assert len(own) == 40 and m["total"] == sum(c.values())

    def chance(w, c1, c2):
        s = [float((m["r1"][c1] + m["r2"][c2]) @ m["q"][k] + m["bias"][k]) for k in range(len(m["q"]))]
        top = max(s)
        of_class = s[cls(w)] - top - np.log(sum(np.exp(x - top) for x in s))
        if w in own:
            return of_class / np.log(10)
        k = cls(w)
        return of_class / np.log(10) + (log10((c[w] - m["gap"]) / mass[k]) if w in c else log10(m["gap"] * kinds[k] / mass[k]) if kinds[k] else 0.0)

    def score(t):
        before, total = (0, 0), 0.0
        for w in [*(t or "").encode().lower().split(), b" "]:
            total += chance(w, *before)
            before = (cls(w), before[0])
        return total

    few = [x for x in rows if len(x[1] or "") < 1000]
    for d in (docs, crowded):
        got = sorted((str(r.doc_id), round(r.score, 2)) for r in lm.score_documents(d, out).collect() if r.n_tokens < 1000)
        assert np.allclose([x for _, x in got], [x for _, x in sorted((str(i), round(score(t), 2)) for i, t, *_ in few)], atol=0.02)


def test_pair_counts_by_hand(spark):
    r = random.Random(3)
    texts = [[r.randrange(9) for _ in range(r.randrange(1, 12))] for _ in range(60)]
    d = spark.createDataFrame([(np.array(x, np.uint16).tobytes(), i % 4 == 0) for i, x in enumerate(texts)], "ids binary, check boolean").repartition(5)
    want = np.zeros((2, 2, 9, 9))
    for i, x in enumerate(texts):
        for j, a in enumerate(x):
            want[int(i % 4 == 0), 0, x[j - 1] if j > 0 else 0, a] += 1
            want[int(i % 4 == 0), 1, x[j - 2] if j > 1 else 0, a] += 1
    assert (lm.pair_counts(d, 9) == want).all()


def test_vectors_grow_with_the_corpus():
    assert [lm.own_words(n) for n in (0, 10_000, 300_000)] == [768] * 3 and lm.own_words(64 * 300_000) == 2 * 768 < lm.own_words(10**12)


def test_hot_words_of_unlearnt_rows(spark):
    """A word that training lacks may fill the rows that are not learnt from: it is sent once for many of them."""
    d = spark.createDataFrame([(i, "common words here" if i % 3 else "strange " * 50) for i in range(3000)], "doc_id long, text string").repartition(2)
    got = lm.score_documents(d, F.col("doc_id") % 3 == 0).collect()
    assert {(r.n_tokens, r.n_known) for r in got if r.held_out} == {(51, 1)} and len({round(r.score, 6) for r in got if r.held_out}) == 1


def test_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    k = 300
    n = r.poisson(3.0, (2, 2, k, k)) * (r.random((2, 2, k, k)) < 0.02)
    a1, a2, z = lm.log_tables(lm.train(n.astype(np.float32)))
    for c1, c2 in ((0, 0), (5, 200), (299, 17)):
        assert abs(np.exp(a1[c1] + a2[c2] - z[c1, c2]).sum() - 1) < 1e-3


def test_nce_learns_pairs():
    k = 40
    n = np.full((2, k, k), 0.2, np.float32)
    n[0, np.arange(k), (np.arange(k) + 1) % k] = 50
    n[1, np.arange(k), (np.arange(k) + 2) % k] = 50
    r, s = lm.train_nce(n, width=24)
    p = n[0].sum(axis=0) / n[0].sum()
    for lag in (0, 1):
        e = np.exp(r[lag] @ s.T) * p
        e /= e.sum(axis=1, keepdims=True)
        assert e[np.arange(k), (np.arange(k) + 1 + lag) % k].mean() > 0.6


def test_model_beats_unigrams(spark):
    r = random.Random(1)
    lang = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    d = spark.createDataFrame([(i, " ".join(r.choice(lang[i % 2]) for _ in range(60))) for i in range(400)], "doc_id long, text string")
    got = lm.score_documents(d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).where("held_out").collect()
    assert sum(x.score for x in got) > 0.9 * sum(x.base_score for x in got)


def test_lm_empty(spark, empty):
    assert lm.score_documents(empty, F.lit(False)).count() == 0
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score_documents(d, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.base_score) < 1e-9


# ---------------------------------------------------------------- pages


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common_subsequence():
    for seed in range(400):
        r = random.Random(seed)
        a, b = ([r.choice("abcdef") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = [a[i] for i in sorted(shared_lines(a, b))]
        rest = iter(b)
        assert len(got) == longest(a, b) and all(x in rest for x in got)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("<p>a<b>x</p>", ["ax"]),
        ('<div class="cookie-notice">no</div><main><p>t &amp; u<br>v</p><div id=comments><p>c</p></div></main>', ["t & u v"]),
        ("a < b <p", ["a < b"]),
        ("<nav>x<p>y", []),
        ("<header>site</header><article><header><h1>T</h1></header><p>x<aside>q</aside>z</article>", ["T", "x", "z"]),
        ("<p title='a\">x</p>y", ["x", "y"]),
        ("<p>it<p title=it's>x</p>", ["it", "x"]),
        ('<script>var t="</p>";</script><style>p{}</style><!-- <p>no</p> --><ul><li>one<li>two</ul>', ["one", "two"]),
        ('<div class="adBox">buy</div><div class="shadow">keep</div><p hidden>h</p><form><p>f</p></form>', ["keep"]),
        ('<div id="share-of-market"><p>a</p></div><div class="related-work"><p>b</p></div><div class="comment-free">c</div>', ["a", "b", "c"]),
        ('<div class="wide ad-slot">x</div><section id="user-comments">y</section><div class="pageHeader">z</div><p>a <span class="ad">buy</span> b</p>', ["a", "b"]),
        ("<p>a&nbsp;b &#233;&eacute; \t\n c</p>&copy", ["a b éé c", "©"]),
    ],
)
def test_lines(page, want):
    assert [x[0] for x in page_lines(page) if not x[3]] == want


def test_frame_is_deleted():
    frame = lambda text: [(x, False, True) for x in ("Site name", "Home", text, "Imprint")]
    pages = [("/a/1", frame("first text of its own")), ("/a/2", frame("second text, another")), ("/a/2b", frame("second text, another"))]
    drops = difference(pages)
    assert [[x[0] for i, x in enumerate(lines) if i not in d] for (_, lines), d in zip(pages, drops, strict=True)] == [["first text of its own"], ["second text, another"], ["second text, another"]]
    article = [("shared paragraph", True, True), ("Share", True, False), ("my own words, and many more of them", True, True)]
    assert difference([("/1", article), ("/2", [*article[:2], ("other words entirely, also more of them", True, True)])])[0] == {1}


def test_main_text(spark):
    page = lambda body: f"<html><body><div>Top bar</div>{body}<div>Bottom bar</div></body></html>"
    rows = [(i, f"https://Host.example/{i % 9}/{i}?q=1", page(f"<div>text of page {i} with words</div>"), 1) for i in range(60)]
    rows += [(100, None, "<p>alone</p>", 1), (101, "not a url", None, 1), (102, "http://other.example/x", page("<article><h1>A</h1><p>b</p></article>"), 1), (102, "http://other.example/x", page("<article><h1>A</h1><p>b</p></article>"), 1)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host int").withColumn("lines", F.lit(0)).repartition(4)
    for chunk in (400, 10):
        got = sorted((r.page_id, r.text) for r in main_text(d, chunk_pages=chunk).collect())
        assert got == [*[(i, f"text of page {i} with words") for i in range(60)], (100, "alone"), (101, ""), (102, "A\nb"), (102, "A\nb")]
    assert main_text(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 5, 30])
def test_heavy_frame_is_deleted(n):
    """A frame that outweighs the text is deleted; near copies of one text, few or many, keep it."""
    frame = lambda *text: [("menu " * 60, False, False), *((x, False, False) for x in text), ("footer " * 30, False, False)]
    pages = [(f"/{i:02d}", frame(f"text {i} " * 20)) for i in range(n)]
    assert difference(pages) == [{0, 2}] * n
    copies = [(f"/00/{i}", frame("one long text " * 60, f"seen {i} times")) for i in range(2 if n == 3 else n // 5 * 2)]
    assert difference(sorted(pages + copies))[1 : 1 + len(copies)] == [{0, 3}] * len(copies)
    assert difference(copies) == [set()] * len(copies)


def test_heavy_frame_of_a_large_host(spark):
    page = lambda *text: "<div>" + "menu " * 60 + "</div>" + "".join(f"<div>{x}</div>" for x in text) + "<div>" + "footer " * 30 + "</div>"
    rows = [(i, f"http://big.example/{i:03d}", page((f"text {i} " * 20).strip())) for i in range(100)]
    rows += [(1000 + i, f"http://big.example/050/{i:02d}", page(("one long text " * 60).strip(), f"seen {i} times")) for i in range(30)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = [(i, (f"text {i} " * 20).strip()) for i in range(100)] + [(1000 + i, ("one long text " * 60).strip() + f"\nseen {i} times") for i in range(30)]
    for chunk in (400, 7):
        assert sorted((r.page_id, r.text) for r in main_text(d, chunk_pages=chunk).collect()) == want


def test_large_host_as_small(spark):
    """Sections of 4 pages with a menu of their own, in a host cut into ranges, among copies: every page's text is that of the host compared whole."""
    page = lambda s, body: f"<div>Top bar</div><div>menu of section {s}</div><div>{body}</div><div>Bottom bar</div>"
    rows = [(4 * s + k, f"http://big.example/{s:03d}/{k}", page(s, f"words of page {k} in part {s} and quite some more of them")) for s in range(60) for k in range(4)]
    rows += [(1000 + i, f"http://big.example/030/1?copy={i:02d}", page(30, "one text under many addresses, longer than its frame is")) for i in range(40)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    whole, cut = (sorted((r.page_id, r.text) for r in main_text(d, chunk_pages=n).collect()) for n in (400, 7))
    assert cut == whole and whole[:240] == [(4 * s + k, f"words of page {k} in part {s} and quite some more of them") for s in range(60) for k in range(4)]


@pytest.mark.parametrize("n", [4, 1000])
def test_differencing_alone(spark, n):
    """No element or name tells the frame, which is longer than the texts: the pairs of pages do. Menus that change with the section go with it."""
    frame = "".join(f"<div class=x{i}>entry {i} of a long list of things to see</div>" for i in range(12 if n < 20 else 60))
    page = lambda i: f"{frame}<div>section {i // 40} of the site</div><div>text {i}, which is short but no stub of a page</div><div>more of it: {i * i}</div><div>the end of every page</div>"
    d = spark.createDataFrame([(i, f"http://host.example/{i // 40:02d}/{i:04d}", page(i)) for i in range(n)], "page_id long, url string, html string").repartition(4)
    assert sorted((r.page_id, r.text) for r in main_text(d).collect()) == [(i, f"text {i}, which is short but no stub of a page\nmore of it: {i * i}") for i in range(n)]


def test_frame_inside_articles():
    """A paragraph of an article goes where most contents of the host have it; what a few quote stays."""
    pages = [(f"/{i:02d}", [("subscribe to our letter", True, True), *([("a quotation", True, True)] if i < 4 else []), (f"text {i} of its own", True, True)]) for i in range(12)]
    assert difference(pages) == [{0}] * 12


def test_long_and_odd_markup(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    long = "<p>" + "word " * 400_000 + "</p>" + "<p>x" * 50_000
    odd = "<" * 20_000 + "<p a='" + "x" * 50_000 + "<!--" + "<p>y"
    rows = [(1, "http://a.example/1", deep), (2, "http://a.example/2", long), (3, "http://a.example/3", odd), (4, "http://a.example/4", None), (None, None, ""), (5, "http://a.example/1", deep)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[5] == "deep" and len(got[2]) == 5 * 400_000 - 1 + 2 * 50_000 and got[4] == got[None] == "" and len(got) == 6


def test_articles_of_the_test_pages(spark):
    """On the given pages the article element is the text; an independent reading of it agrees."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)(</article>|$)", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div)[^>]*>", re.sub("</?b>", "", inner))]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)
