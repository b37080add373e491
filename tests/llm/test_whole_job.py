"""Operators that once did less than their whole job."""

from pyspark.sql import functions as F

from weftgraph.llm import html_text, lang_id
from weftgraph.llm.common import fold


def test_wrapped_articles_stay_on_every_copy(spark):
    """What holds an article or main is no template, however often the page is printed."""
    menu = '<div class="box"><p>Everywhere</p></div>'
    rows = [(i, f"http://{tag}.org/{i}", f'<body>{menu}<div class="wrap"><div><{tag}><h1>Head</h1><p>Printed again</p></{tag}></div></div></body>') for tag in ("article", "main") for i in range(10)]
    got = html_text.text_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["Head\nPrinted again"] * 20


def test_recurring_blocks_go_from_articles(spark):
    """A notice inside different articles is template; articles printed again, whole or with a new date, stay whole."""
    notice = '<div class="box"><p>Read us daily</p></div>'
    rows = [(i, f"http://a.org/{i}", f"<body><article><h1>Head {i}</h1>{notice}<p>Own text number {i}</p></article></body>") for i in range(8)]
    rows += [(100 + i, f"http://b.org/{i}", f"<body><main><p>Own text number {i}</p>{notice}</main></body>") for i in range(8)]
    rows += [(200 + i, f"http://c.org/{i}", f"<body><article>{notice}<p>Printed again</p></article></body>") for i in range(8)]
    rows += [(300 + i, f"http://d.org/{i}", f"<body><article><p>Day {i}</p><p>Printed with a new date on every page</p></article></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.text_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"Head {i}\nOwn text number {i}" and got[100 + i] == f"Own text number {i}"
        assert got[200 + i] == "Read us daily\nPrinted again" and got[300 + i] == f"Day {i}\nPrinted with a new date on every page"


def test_language_sample_is_of_labelled_rows(spark, monkeypatch):
    """Rows without a label take nothing from the sample, and a rare language is in it."""
    rows = [(i, f"words of number {i}", "en" if i < 1000 else "ga" if i < 1010 else None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.filter((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull()).groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in known.collect()}
    monkeypatch.setattr(lang_id, "fit", lambda samples: [x for x, _ in samples])
    got = lang_id.learn(docs, sample=200)
    assert got.count("ga") == counts["ga"] > 0 and 150 < got.count("en") < 250 < counts["en"]
    assert lang_id.learn(docs.filter("lang IS NULL")) == []
