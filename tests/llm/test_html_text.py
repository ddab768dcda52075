import pytest

from tablegrist.llm import html_text as X
from tablegrist.llm.dom import blocks, read_page

PARAGRAPHS = [f"Sentence {i} about the weather, which was fine. It went on for a while and ended number {i}." for i in range(60)]
SCHEMA = "page_id long, url string, html string, text string"


@pytest.fixture(scope="module")
def model():
    return X.fitted(PARAGRAPHS)


def page(core, before="", after=""):
    return f"<html><head><title>T</title><script>x('</p>')</script></head><body>{before}{core}{after}</body></html>"


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


@pytest.mark.parametrize("start", ["article", 'div class="content"', "main"])
def test_main_part_is_found(model, start):
    body = f"<h1>Title</h1><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}"
    html = page(
        f"<{start}>{body}</{start.split()[0]}>", NAV + '<div class="ad">Buy this now.</div>',
        f'<div class="comments"><div class="comment"><p>{PARAGRAPHS[2]}</p></div></div><footer>&copy; me</footer>',
    )
    assert model.texts([html]) == ["\n".join(["Title", *PARAGRAPHS[:2]])]


def test_parts_inside_the_article_are_cut(model):
    html = page(f'<article><p>{PARAGRAPHS[0]}</p><form><label>Mail</label><input></form><p>{PARAGRAPHS[1]}</p></article>', NAV)
    assert model.texts([html]) == ["\n".join(PARAGRAPHS[:2])]


def test_labels_of_parents_and_children_agree(model):
    p = read_page(page(f"<article><p>{PARAGRAPHS[0]}</p></article>", NAV))
    main = X.decoded(p, model.trees.log_odds(X.features(p, model.odds)))
    state = {i: bool(m) for i, m in enumerate(main)}
    for i in range(1, len(p.tag)):
        if not state[i]:
            # What is cut below a main element holds no main text again.
            assert not any(state[k] for k in range(i, p.end[i])) or not state[p.parent[i]]


def test_markup_is_read_as_browsers_do():
    p = read_page('<p>a &amp; b&nbsp;c<p><b>d<br>e<div>f</div>g<!-- h --><script>"<p>"</script><ul><li>i<li>j</ul><a b="x>y">k</a> < l')
    assert blocks(p, [t != "script" for t in p.tag]) == ["a & b c", "d e", "f", "g", "i", "j", "k < l"]


def test_broken_markup_ends():
    for html in ("<", "<a", "<a href='", "</p>", "<!--", "<p " + "a='b' " * 2000, "<div>" * 3000, "x" * 100_000 + '<p "' * 300):
        read_page(html)


def test_odd_rows(spark, model):
    rows = [(1, None, None, "old"), (2, "u", "", None), (None, None, page(f"<article><p>{PARAGRAPHS[0]}</p></article>"), None)]
    rows += [rows[2]]
    out = X.with_main_text(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert sorted(r.text for r in out) == ["", "", PARAGRAPHS[0], PARAGRAPHS[0]]
    assert X.with_main_text(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_fit_on_table(spark):
    rows = [(i, "u", page(f"<article><p>{p}</p></article>", NAV), None) for i, p in enumerate(PARAGRAPHS)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = X.with_main_text(df, X.fit(df)).collect()
    assert {r.page_id: r.text for r in out} == dict(enumerate(PARAGRAPHS))
    X.fit(df.limit(0))


def test_text_outside_elements_is_main(model):
    a, b, c = PARAGRAPHS[:3]
    assert model.texts([a, f"{a} <p>{b}</p> {c}", f"<title>T</title>{a}<br>{b}", f"{a}<nav><ul><li><a href='/'>Home</a></li></ul></nav>"]) == [
        a, "\n".join([a, b, c]), f"{a} {b}", a,
    ]


def test_one_html_and_one_body_are_open():
    for html in ("a <p>b</p> c", "<p>a</p><body class=x>b</body> c", "<head><title>t</title><p>a</html>b", "<html><html><body><body>a"):
        assert [t for t in read_page(html).tag if t in ("html", "body")] == ["html", "body"]


@pytest.mark.parametrize(("html", "want"), [
    ("<article><h1>Title of it</h1><p>A first line of the report that was asked for. See <a href=x>the full report</a> for <em>details</em> and "
     "<code>x=1</code>.</p></article>",
     "Title of it\nA first line of the report that was asked for. See the full report for details and x=1."),
    ("<article><p>Some links that belong to the text of this page:</p><ul><li><a href=1>First thing to read</a></li><li><a href=2>Second thing</a></li></ul>"
     "<p>And a last paragraph, which closes the article.</p></article>",
     "Some links that belong to the text of this page:\nFirst thing to read\nSecond thing\nAnd a last paragraph, which closes the article."),
    ("<article><p>The table shows what was found in the last years.</p><table><tr><th>Year</th><th>Found</th></tr><tr><td>2001</td><td>17</td></tr></table></article>",
     "The table shows what was found in the last years.\nYear\nFound\n2001\n17"),
    ("<article><p>A picture of the town, taken in winter.</p><figure><img src=x><figcaption>The town in winter.</figcaption></figure></article>",
     "A picture of the town, taken in winter.\nThe town in winter."),
    ("<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><header><h1>Real headline</h1></header><p>The text below the headline, of some length.</p></article></body>",
     "Real headline\nThe text below the headline, of some length."),
    ("<body><header class=site-header><h1>Site</h1></header><article><p>A short article.</p></article><footer>&copy; 2024 Site</footer></body>", "A short article."),
    ("Just plain text & more", "Just plain text & more"),
    ("Intro <p>para</p> more text", "Intro\npara\nmore text"),
])
def test_main_text_is_whole(model, html, want):
    assert model.texts([html]) == [want]


@pytest.mark.parametrize("piece", ["<div>", "<div></x>", "<a ", "<p>", "</p>", "<li>", "<script></script ", "<b ", '<a "', "<table><td>", "<!--", "<td></div>"])
def test_broken_pages_are_read_in_proportion(piece):
    import time

    took = []
    for size in (1 << 17, 1 << 20):
        html = piece * (size // len(piece))
        began = time.process_time()
        read_page(html)
        took.append(time.process_time() - began)
    assert took[1] < 15 and took[1] < 40 * max(took[0], 0.02)
