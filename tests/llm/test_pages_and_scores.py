import collections
import math
import zlib

import numpy as np
import pytest

from tillstats.llm import toxicity, url_filter
from tillstats.llm.html_extract import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar page">
<header><h1>The Site</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, you know, and more, much more, of them, all day long.</p></div>
<div class="layout"><div class="content"><h1>Title &eacute; &amp; more</h1>
<p>First, <b>bold</b> paragraph   with
a <a href="x">link</a>, long enough to count.<p>Short.</p>loose<br>text
<div class="ad">Buy, now, cheap, things, here.</div><ul><li>one<li>two &lt;b&gt;</ul><blockquote>Quoted, as it were.</blockquote>
<form><p>Name, please, and address, and more, and everything else, thanks.</p></form></div>
<aside>Side, bar, text, which, has, commas</aside>
<section id="comments"><p>Nice, article, I, like, it, very, much, with, commas, more, than, any.</p></section></div>
<footer>&copy; 2024</footer><script>var a = "<p>x</p>";</script></body></html>"""


def test_article_alone():
    assert extract(PAGE).split("\n") == ["Title é & more", "First, bold paragraph with a link, long enough to count.", "Short.", "loose text", "one", "two <b>", "Quoted, as it were."]


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<script>x</script>", ""), ("plain, text", "plain, text"), ("<p>cut off<p", "cut off"),
    ("<article><h1>H</h1><p><b>H<br><p>Text.</article><footer>f</footer>", "H\nH\nText."), ("<p>a &notareference; &#233;&#x41;</p>", "a ¬areference; éA"),
    ("<article><header><h1>In</h1></header><p>Body, text.</p><div class='comments'><p>No, no, no.</p></div></article>", "In\nBody, text."), ("1 < 2 and <3", "1 < 2 and <3"),
])
def test_pages(html, text):
    assert extract(html) == text


def test_deep_page():
    assert extract("<div>" * 5_000 + "<p>deep, text</p>") == "deep, text"


def test_main_text(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    rows = main_text(df).orderBy("page_id").collect()
    assert [r["n_chars"] for r in rows] == [len(extract(PAGE))] * 2 + [0] and rows[2]["text"] == ""
    assert main_text(df.limit(0)).count() == 0


URLS = [
    ("http://Shop.Example.NET/en/1?q=/de/", "shop.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/de/1#x", "example.net", "/de/1", "net/", "block"),
    ("x://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://a.org/fr/2", "a.org", "/fr/2", "org/fr/", "allow"),
    ("http://a.org", "a.org", "", None, None),
    ("http://net", "net", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in url_filter.judge(df).collect():
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict in (None, r["verdict"])
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df.where("page_id >= 5")).collect()} == {"allow"}


def test_language_models_tell_apart(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(900):
        bad = i % 2
        word = "".join(r.choice(list("xqz0" if bad else "aeilmn"), 8))
        host = ("spam.net" if bad else "good.example.net") if i % 3 else "other.info"
        rows.append((i, f"http://{host}/en/{word}", bad))
    found = {x["page_id"]: x for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int")).collect()}
    free = [(found[i]["verdict"] == "block") == bool(bad) for i, _, bad in rows if found[i]["rule"] is None]
    assert len(free) == 300 and np.mean(free) > 0.95


def test_whole_url_is_scored(spark):
    """Query, fragment and URLs without a scheme count; host and path are the same here or empty."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(900):
        bad = i % 2
        word = "".join(r.choice(list("xqz0" if bad else "aeilmn"), 8))
        host = ("spam.net" if bad else "good.example.net") if i % 3 else "other.info"
        rows.append((i, f"http://{host}/en/page{'?#'[i % 4 // 2]}{word}" if i % 3 or i % 5 else f"{word}{word}", bad))
    found = {x["page_id"]: x for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int")).collect()}
    free = [(i, (found[i]["verdict"] == "block") == bool(bad)) for i, _, bad in rows if found[i]["rule"] is None]
    bare = [right for i, right in free if i % 15 == 0]
    assert len(free) == 300 and len(bare) == 60 and np.mean([x for _, x in free]) > 0.95 and np.mean(bare) > 0.95


def test_scores_rest_on_exact_counts(spark):
    """However many n-grams there are, none shares a count: scores are those of dictionaries."""
    r = np.random.default_rng(2)
    rows = [("".join(r.choice(list("0123456789abcdefghijklmnopqrstuv"), 24)), "block" if i % 2 else "allow") for i in range(800)]
    df = spark.createDataFrame(rows, "text string, verdict string")
    counts = {"allow": collections.Counter(), "block": collections.Counter()}

    def contexts(text, at):
        padded = ["start"] * url_filter.ORDER + [*text, "end"]
        place = at + url_filter.ORDER
        return [(tuple(padded[place - k : place]), padded[place]) for k in range(url_filter.ORDER + 1)]

    for text, verdict in rows:
        for at in range(len(text) + 1):
            for before, symbol in contexts(text, at):
                counts[verdict].update([before, (before, symbol, "next")])

    def likelihood(text, seen):
        total = 0.0
        for at in range(len(text) + 1):
            p = 1 / 257
            for before, symbol in contexts(text, at):
                p = (seen[before, symbol, "next"] + url_filter.STRENGTH * p) / (seen[before] + url_filter.STRENGTH)
            total += math.log(p)
        return total

    scored = url_filter._scored(df.limit(60), url_filter.train(df)).collect()
    for x in scored:
        expected = (likelihood(x["text"], counts["block"]) - likelihood(x["text"], counts["allow"])) / len(x["text"])
        assert x["score"] == pytest.approx(expected, abs=1e-9)


def test_isotonic():
    fitted = url_filter.isotonic(np.arange(6), np.array([0.0, 1.0, 0.0, 1.0, 1.0, 0.5]), np.ones(6))
    assert (np.diff(fitted) >= 0).all() and fitted.sum() == pytest.approx(3.5)


def labelled(n=1_600):
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abdeglnorst"), 5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text, toxic = list(r.choice(words, 40)), int(i % 7 == 0)
        if toxic:
            text.insert(int(r.integers(40)), r.choice(["idiot", "zorfle", "zorflen", "gribbo"]))
        docs.append((i, " ".join(text), "x", 0.5))
        labels.append((i, 1, toxic))
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled()
    d = spark.createDataFrame([*docs, (5_000, None, "x", 0.5), (5_001, "", "x", 0.5), (0, docs[0][1], "x", 0.5)], "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (9_999, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.scores(d, lab).collect()
    assert len(rows) == len(docs) + 3
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98 and sum(truth[r["doc_id"]] for r in held) > 20
    blank = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] >= 5_000}
    assert blank[5_000] == blank[5_001] < 0.3
    # held-out labels are never read
    other = lab.withColumn("toxic", toxicity.F.when(toxicity.fold(toxicity.F.col("doc_id")) == 2, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert sorted(toxicity.scores(d, other).collect()) == sorted(rows)
    kept = toxicity.keep_clean(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(1 - r["predicted"] for r in rows)


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "you idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.scores(d, none).collect()] == [0.0]
    assert toxicity.scores(d.limit(0), none).count() == 0 and toxicity.keep_clean(d, none).count() == 1


def test_features_stay_finite():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "zorf+": 3.0})
    for text in (None, "", "!!!", "YOU 1d10t!!!", "i.d.i.o.t soooo " * 1_000, "\0\n"):
        x = toxicity.features(text, lexicon)
        assert len(x) == len(toxicity.FEATURES) and np.isfinite(x).all()
    hidden = dict(zip(toxicity.FEATURES, toxicity.features("you 1d10t", lexicon), strict=True))
    assert hidden["uncovered"] > 0
