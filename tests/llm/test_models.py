"""Quality, language, personal data and page text: held-out accuracy, brute force, odd inputs."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import html_text, lang_id, pii, quality
from weftgraph.llm.queries import QUERIES


def fold(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_quality_held_out(spark, tables):
    got = {r.doc_id: r for r in QUERIES["op3_bradley_terry_quality"](spark, tables).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert all(r.held_out == (fold(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    assert np.mean([a == b for a, b in held]) >= 0.9


def test_ranking_order_and_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 17))
    y = (x[:, 3] - x[:, 5] > -0.6).astype(int)
    m = quality.fit(x.tolist(), y.tolist(), pairs=20_000)
    s = m.score(x)
    assert s[y == 1].mean() > s[y == 0].mean() and ((s >= quality.CUT) == y).mean() > 0.95
    assert m.score([]).shape == (0,)
    assert quality.fit([], []).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.fit(x[:3].tolist(), [1, 1, 1]).score(x[:2]).tolist() == [1.0, 1.0]


def test_quality_odd(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1), (4, 1), (9, 0), (10, 0), (12, 0), (12, 1), (11, None), (None, 1), (17, 1)], "doc_id long, quality int")
    model = quality.learn(odd, labels)
    got = quality.score_report(odd, model)
    assert got.count() == len(odd_rows) and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.keep_good(odd, model).schema == odd.schema
    empty = quality.learn(none, labels.limit(0))
    assert quality.score_report(none, empty).count() == 0 and {r.score for r in quality.score_report(odd, empty).collect()} == {0.5}


def test_language_held_out(spark, tables):
    got = {r.doc_id: r for r in QUERIES["op9_chain_language"](spark, tables).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    held = [(r.lang_pred, docs[i].lang) for i, r in got.items() if r.held_out]
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_long_words_and_whole_texts(spark):
    """Words and texts of any length are read whole, in the fit as well."""
    long = "ab" * 60_000
    rows = [(i, f"{'schön über ' * 700}nicht {long if i == 1 else ''}" if i % 2 else "thing with other " * 900, "bb" if i % 2 else "aa") for i in range(1, 21)]
    model = lang_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "nicht" in model.lexicon
    texts = [(1, long), (2, f"über {long} schön"), (3, "thing " * 30_000 + "x" * 3000)]
    got = {r.doc_id: r for r in lang_id.language_report(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got[3].lang_pred == "aa" and got[2].lang_pred in ("aa", "bb") and all(0 < r.score <= 1 for r in got.values())


def test_samples_of_any_share(spark):
    from weftgraph.llm.common import sampled

    ids = spark.range(300_000)
    assert ids.filter(sampled(F.col("id"), 1.0, 1)).count() == 300_000
    assert 2_500 < ids.filter(sampled(F.col("id"), 0.01, 1)).count() < 3_500
    for share in (1e-9, 1e-18, 1e-30):  # never nothing at all, however large the table
        assert sampled(F.col("id"), share, 1)._jc.toString().rsplit("<", 1)[1].strip(" )") not in ("0", "")


def test_forward_backward_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    lengths = np.array([4, 3, 1])
    p = rng.random((4, 3, 3)).astype(np.float64) + 0.1
    a, start = rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    gamma, counts = lang_id.forward_backward(p, a, start, lengths, pairs=True)
    want_counts = np.zeros((3, 3))
    for k, n in enumerate(lengths):
        total, post, moves = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in product(range(3), repeat=int(n)):
            w = start[y[0]] * np.prod([p[t, k, y[t]] for t in range(n)]) * np.prod([a[y[t - 1], y[t]] for t in range(1, n)])
            total += w
            for t in range(n):
                post[t, y[t]] += w
            for t in range(1, n):
                moves[y[t - 1], y[t]] += w
        assert np.allclose(gamma[:n, k], post / total)
        want_counts += moves / total
    assert np.allclose(counts, want_counts)
    weights = rng.random((4, 3))
    total = lang_id.forward_backward(p, a, start, lengths, weights)
    assert np.allclose(total, [(gamma[:n, k] * weights[:n, k, None]).sum(0) for k, n in enumerate(lengths)])


def test_language_of_mixed_and_odd_texts(spark, odd, odd_rows, none):
    rng = random.Random(1)
    vocabulary = {"aa": ["tion", "thing", "with", "other"], "bb": ["schön", "über", "keit", "nicht"]}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) + rng.choice(["", "en", "s"]) for _ in range(30)), x) for i, x in enumerate(["aa", "bb"] * 60)]
    model = lang_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [(1, "tion thing with other other thing " * 4 + "schön über nicht"), (2, "123 ²³ !!"), (3, None), (4, ""), (5, "NICHT KEIT ÜBER SCHÖN")]
    got = {r.doc_id: r for r in lang_id.language_report(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    assert got[1].lang_pred == "aa" and got[1].score < 0.98 and got[5].lang_pred == "bb"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4))
    assert lang_id.language_report(odd, model).count() == len(odd_rows) and lang_id.language_report(none, model).count() == 0
    nothing = lang_id.learn(none)
    assert {r.lang_pred for r in lang_id.language_report(odd, nothing).collect()} == {"und"}
    assert lang_id.learn(odd).langs


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_by_pattern():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("aB1@.+- ()29.x@4%_é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in ("0001.2.3.4 000256.1.1.1 0255.0000.1.1", "9" * 30 + ".1.1.1", "4111-1111 1111-1111", "a@b@c.d@e.f.g"):
        assert pii.base_spans(t) == brute_spans(t), t


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_segments_held_out(field):
    draw = np.random.default_rng(77)
    right = told = found = 0
    for _ in range(150):
        text, spans = pii.example(draw)
        got = {s for a, b in pii.windows(text) for s in field.decode(pii.window(text, a, b))}
        right, told, found = right + len(got & set(spans)), told + len(spans), found + len(got)
    assert right >= 0.9 * told and right >= 0.9 * found


def test_decoding_by_enumeration(field):
    """The dynamic programme's segmentation scores as well as any."""

    def value(w, spans):
        place = {s: k for k, s in enumerate(w.spans)}
        score = w.x @ field.weights.T
        at, before, total = 0, 0, 0.0
        for i, y, j in [*spans, (len(w.tokens), None, None)]:
            for _ in range(at, i):
                total, before = total + field.moves[before, 0], 0
            if y is not None:
                total, at, before = total + field.moves[before, y + 1] + score[place[i, j], y], j, y + 1
        return total

    def every(w, at=0):
        yield []
        for i, j in w.spans:
            if i >= at:
                for y in range(len(pii.KINDS)):
                    for rest in every(w, j):
                        yield [(i, y, j), *rest]

    for text in ("call 555-0199 now", "at 10.0.0.7 x", "key: ab12cd34ef56ab78"):
        w = pii.window(text, 0, len(text))
        starts, ends = {a: k for k, (a, _) in enumerate(w.tokens)}, {b: k + 1 for k, (_, b) in enumerate(w.tokens)}
        got = [(starts[a], y, ends[b]) for a, y, b in field.decode(w)]
        assert abs(value(w, got) - max(value(w, s) for s in every(w))) < 1e-9


def test_gradient_is_of_the_likelihood(field):
    draw = np.random.default_rng(8)
    text, spans = pii.example(draw)
    w = pii.window(text, 0, len(text))
    starts, ends = {a: k for k, (a, _) in enumerate(w.tokens)}, {b: k + 1 for k, (_, b) in enumerate(w.tokens)}
    truth = [(starts[a], y, ends[b]) for a, y, b in spans]
    small = pii.Field(field.weights * 0.05, field.moves * 0.05)
    dw, dm = small.gradient(w, truth)
    assert abs(dm.sum()) < 1e-6 or np.isfinite(dm).all()
    step = 1e-3
    better = pii.Field(small.weights + step * dw, small.moves + step * dm)
    dw2, dm2 = better.gradient(w, truth)
    assert (dw2**2).sum() + (dm2**2).sum() < (dw**2).sum() + (dm**2).sum()


def test_span_report(odd, odd_rows, none, field):
    import hashlib

    got = pii.span_report(odd, field).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    text = next(r[1] for r in odd_rows if r[0] == 16)
    base = brute_spans(text)
    assert (by[16].n_email, by[16].n_ip, by[16].n_card, by[16].n_phone) == (1, 1, 1, 1)
    assert by[16].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
    assert set(pii.joined(base).split(",")) <= set(by[16].spans.split(","))
    assert by[5].spans == "" and by[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.span_report(none, field).count() == 0


def test_long_stretches_go_in_steps(field, monkeypatch):
    text = " ".join(f"call +1 (555) 0{k % 10}3-4567 or token = {k:03d}9b8c45435718dcc700c184a7 of {k}" for k in range(200))
    whole = pii.all_spans(text, field)
    monkeypatch.setattr(pii, "STEP", 100_000)
    assert pii.all_spans(text, field) == whole and len(whole[1]) >= 400
    spans = whole[0]
    for s in range(0, 600, 7):
        assert pii.overlaps(spans, s, s + 9) == any(a < s + 9 and b > s for a, _, b in spans)


def test_hostile_texts_in_linear_time(field):
    import time

    for text in ("9" * 1_000_000, "1." * 20_000, "a@" * 30_000, "ab1-" * 100_000, "+1 " * 40_000, "x" * 1_000_000 + "1", "password=" * 20_000):
        began = time.thread_time()
        pii.all_spans(text, field)
        assert time.thread_time() - began < 20, text[:20]


def test_harder_spans(field):
    def found(text):
        return [(pii.KINDS[y], text[a:b]) for a, y, b in pii.all_spans(text, field)[1]]

    key = "abcDEFgh+/" * 17 + "12345678=="
    assert found(f'key = "{key}"') == [("secret", key)]
    assert found('my password = "hunterlongpasswordabcdef" ok') == [("secret", "hunterlongpasswordabcdef")]
    assert found("write to john.doe at example dot com today") == [("email", "john.doe at example dot com")]
    assert found("the ssn 123-45-6789 is") == [("ssn", "123-45-6789")]
    assert found("key sk-4eC39HqLyjWDarjtT1zdp7dc end") == [("secret", "sk-4eC39HqLyjWDarjtT1zdp7dc")]
    assert found("key deadbeef-1234-4abc-9def-0123456789ab") == [("secret", "deadbeef-1234-4abc-9def-0123456789ab")]
    assert found("covid-19 and B2B of 2024-10-12 v1.2.3, the secret garden is key to success") == []


def test_recall_on_documents(spark, more_tables):
    """Every token that a document announces is among the added spans, and documents without digits get none."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{more_tables}/documents.parquet").collect()}
    told = 0
    for r in QUERIES["op1_semi_markov_pii"](spark, more_tables).collect():
        spans = set(filter(None, r.spans.split(",")))
        planted = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer('token = "([0-9a-f]{40})"', texts[r.doc_id])}
        told += len(planted)
        assert planted <= spans and r.n_secret == sum(s.startswith("secret:") for s in spans) and r.n_spans == len(spans)
        assert spans or not planted
        assert not spans or re.search("[0-9@]", texts[r.doc_id])
    assert told


def test_secrets_are_added(field):
    text = 'Some words token = "9b8c45435718dcc700c184a7e303cdc64c6a8f7f" and on version 1.2.3 of 2024-10-12.'
    base, spans = pii.all_spans(text, field)
    assert base == [] and [(pii.KINDS[y], text[a:b]) for a, y, b in spans] == [("secret", "9b8c45435718dcc700c184a7e303cdc64c6a8f7f")]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One <b>bold
 text</b> here.<br>Next<p>Two &lt;b&gt; &#233;&nbsp;x</p><div class="ad">Buy</div><ul><li>i<li>ii</ul><script>if (a < b) { "</p>" }</script><!-- c --><div id="comments"><p>First!</p></div><form><p>Mail</p></form></article>
<aside>side</aside><footer>foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE, frozenset()) == "Head & tail\nOne bold text here. Next\nTwo <b> é x\ni\nii"
    held = '<div class="page has-sidebar"><div class="sidebar"><article><p>teaser</p></article></div><article class="post"><header><h2>T</h2></header><p>a</p><p style="display: none">b</p></article><article class="comment"><p>c</p></article></div>'
    assert html_text.main_text(held, frozenset()) == "T\na"
    assert html_text.main_text('<div id="notice-board"><article><p>in</p></article></div>', frozenset()) == "in"
    assert html_text.main_text("<body><main><p>m</p></main><p>n</p></body>", frozenset()) == "m"
    for cut in range(0, len(PAGE), 7):  # cut off anywhere
        html_text.main_text(PAGE[:cut], frozenset())
    for odd in ("", "<", "<p", "<p>a", "a < b > c", '<a href="', "</p></div>", "<!--", "<b><i>x</b>y</i>", "<p>" * 3000 + "deep", "<div>" * 5000 + "deep"):
        html_text.main_text(odd, frozenset())
    assert html_text.main_text("<div>" * 5000 + "deep", frozenset()) == "deep"


def test_template_goes_and_articles_stay(spark):
    menu = '<div class="box"><p>Everywhere the same</p></div>'
    rows = [(i, f"http://h.org/{i}", f"<body>{menu}<p>Own text {i}</p></body>") for i in range(20)]
    rows += [(100 + i, f"https://other.org/{i}", f"<body>{menu}<p>Own text {i}</p></body>") for i in range(3)]
    rows += [(200 + i, "http://news.org/x", "<body><article><p>Printed again</p></article></body>") for i in range(10)]
    rows += [(300, None, None), (301, "x", ""), (302, "http://h.org/z", None), (None, None, PAGE)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.text_report(df).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Own text 3" and got[101].text == "Everywhere the same\nOwn text 1"
    assert got[205].text == "Printed again" and got[300].text == "" and got[302].n_chars == 0
    assert got[None].n_chars == len(got[None].text) > 0
    assert html_text.text_report(df.filter(F.lit(False))).count() == 0


def test_recurring_subtrees_by_brute_force(spark, more_tables):
    """Spark's counts give the templates that a plain count of every page's hashes gives."""
    from collections import Counter, defaultdict

    pages = spark.read.parquet(f"{more_tables}/pages.parquet")
    rows = pages.select(html_text.host_of(F.col("url")).alias("host"), "html").collect()
    seen, held = defaultdict(set), Counter()
    for k, r in enumerate(rows):
        for kind, unit, found in html_text.template_candidates(r.html or ""):
            for h, share in [*found.items(), (None, 0.0)]:
                key = k if unit is None else ("unit", unit)
                held[r.host, h] += share if key not in seen[r.host, kind, h] else 0
                seen[r.host, kind, h].add(key)
    want = {host: set() for (host, kind, h), x in seen.items() if kind == html_text.FRAME and h is None and len(x) >= html_text.MIN_PAGES}
    for (host, kind, h), x in seen.items():
        n, every = len(x), len(seen[host, kind, None])
        enough = n >= max(2, html_text.SLOT_SHARE * every) if kind == html_text.SLOT else n >= max(html_text.MIN_PAGES, html_text.SHARE * every)
        if h is not None and host in want and enough and not (kind == html_text.FRAME and held[host, h] > html_text.FRAME_TEXT * n):
            want[host].add(h)
    got = {r.host: set(r.template) for r in html_text.site_templates(pages).collect()}
    assert got == want and any(want.values())


def test_templates_make_the_text(spark, more_tables, monkeypatch):
    """Without its host's template the text of most pages differs; names of classes are not needed where a host can be counted."""
    pages = spark.read.parquet(f"{more_tables}/pages.parquet").withColumn("host", html_text.host_of(F.col("url")))
    known = {r.host: frozenset(r.template) for r in html_text.site_templates(pages).collect()}
    judged = [r for r in pages.collect() if r.host in known]
    texts = [html_text.main_text(r.html, known[r.host], True) for r in judged]
    off = [html_text.main_text(r.html, frozenset(), True) for r in judged]
    assert len(judged) > 50 and sum(a != b for a, b in zip(texts, off, strict=True)) > 0.9 * len(judged)
    monkeypatch.setattr(html_text, "MARKS", frozenset())
    assert [html_text.main_text(r.html, known[r.host], True) for r in judged] == texts


def test_salted_templates(spark, tables, monkeypatch):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    want = sorted(map(repr, html_text.text_report(pages).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", -1)
    assert sorted(map(repr, html_text.text_report(pages).collect())) == want


def test_frames_and_slots(spark):
    """Boxes whose words change go by their frame, marked elements inside articles by their slot, content by neither."""
    def page(i, host):
        body = f"<article><p>Own text {i}</p><div class='comments'><p>{'Yes ' * i}</p></div></article>" if host == "a" else f"<div class='text'><p>Long own text of the page number {i}, which goes on</p></div>"
        return (i, f"http://{host}.org/{i}", f"<body><div class='box{i}'>Word {i}</div><div class='top'><ul><li><a>x{i}</a></li><li><a>y</a></li></ul></div>{body}<section class='end'>{i} by us</section></body>")

    rows = [page(i, h) for h in "ab" for i in range(1, 9)] + [(100 + i, "http://c.org/", "<body><div>Alike</div><p>On every page</p></body>") for i in range(9)]
    got = [r.text for r in html_text.text_report(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("url", "page_id").collect()]
    assert got == [f"Own text {i}" for i in range(1, 9)] + [f"Long own text of the page number {i}, which goes on" for i in range(1, 9)] + ["Alike\nOn every page"] * 9


def test_hostile_markup_in_linear_time():
    import time

    for text in ("<a " * 1_000_000, "<b>" * 100_000 + "</i>" * 100_000, "<ul>" + "<b>" * 50_000 + "<li></li>" * 50_000, "<b>" * 50_000 + "<div></div>" * 50_000, '<a ">" ' * 100_000, "<a '" * 200_000 + ">", "<p>" * 100_000, "<!-- " * 200_000):
        began = time.thread_time()
        html_text.main_text(text, frozenset({1}), True)
        html_text.template_candidates(text)
        assert time.thread_time() - began < 20, text[:20]


def test_pages_of_the_tables(spark, tables):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    for r in QUERIES["op8_site_template_text"](spark, tables).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", body))
        assert r.text == "\n".join(b for b in blocks if b)
