import html.parser
import time

import pytest

from quantloom.llm import queries, tag_paths

SF = "/root/testdata/sf0.001"
LONG = "This is a long sentence, with several commas, that any reader would take for prose. "


class Article(html.parser.HTMLParser):
    """All text within <article>, by another parser; block tags part words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.out = False, []

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        self.out.append("" if tag == "b" else " ")

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        self.out.append("" if tag == "b" else " ")

    def handle_data(self, data):
        self.out.append(data if self.on else "")


def test_every_page_against_another_parser(spark):
    got = {r.page_id: r for r in queries.op13_tag_paths(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages) > 0
    for p in pages:
        a = Article()
        a.feed(p.html), a.close()
        want = " ".join("".join(a.out).split())
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


MENU = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News, sport</a></ul></nav>"
FOOT = "<footer>&copy; 2020 Some publisher. All rights reserved, really.</footer>"
CASES = {
    "divs only": (
        f"<body class='has-sidebar'><div id=header><a href=/>Site</a></div><div class=menu><a href=/x>One</a> <a href=/y>Two</a></div><h1>A title</h1><div class=content><p>{LONG}<p>Yes.<p>{LONG}</div>"
        f"<div class='sidebar'><p>{LONG}</p></div><div id=comments><p>{LONG * 9}</p></div><div class=footer>About us, and so on.</div>",
        f"A title {LONG}Yes. {LONG}",
    ),
    "parts of an article": (
        f"{MENU}<header class=masthead><h1>Paper</h1></header><article><header><h1>Title</h1></header><p>One &amp; two&nbsp;three.</p><h2>Part</h2><ul><li>First<li>Second, {LONG}</ul>"
        f"<table><tr><td>a<td>b<tr><td>{LONG}</table><aside>Read also: this, that.</aside><figure><img src=x><figcaption>A figure.</figcaption></figure><form>Mail: <input><button>Go</button></form>"
        f"<div class='share social'>Tell others.</div><blockquote>{LONG}</blockquote></article><section class=comments><article class=comment><p>{LONG * 20}</p></article></section>{FOOT}",
        f"Title One & two three. Part First Second, {LONG}a b {LONG}A figure. {LONG}",
    ),
    "notices": (
        f"<div class='cookie-notice'><p>{LONG}</p></div><main><div role=alert>Note, note.</div><h1>T</h1><p>{LONG}</p><div class=advert><p>{LONG}</p></div><p>End of i<b>t</b>.</p></main><div hidden><p>{LONG}</p></div>",
        f"T {LONG}End of it.",
    ),
    "broken markup": (
        f"<!-- a > b --><title>x</title><body><div><p><b>{LONG}<br><p>Two<i>s</b> are</i> here<br/>now.</div></p><p>3 < 4 & so on &lt;b&gt; &#233;&eacute; &copy2</p><script>if (a</b) '</p>'</script><style>p{{}}</style><p>{LONG}<!-- cut <p>off",
        f"{LONG}Twos are here now. 3 < 4 & so on <b> éé ©2 {LONG}",
    ),
    "cut in a tag": (f"<article><p>{LONG}</p><p>Last. <a href='x", f"{LONG}Last."),
    "only hints": (f"<div class=widget><p>{LONG}</p></div>", LONG),
    "no markup": (" plain\n text ", "plain text"),
    "no marks": ("<article><h1>Short</h1><p>words only</p></article><nav>x</nav>", "Short words only"),
    "nothing": ("<nav>x</nav><script>y</script>", ""),
    "upper case": (f"<BODY><NAV>x</NAV><ARTICLE><P>{LONG}</P></ARTICLE><SCRIPT>z</Script></BODY>", LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    page, want = CASES[name]
    assert " ".join(tag_paths.main_blocks(page)) == " ".join(want.split())


def test_odd_rows(spark):
    """Nulls, empty and long pages, repeated rows, clashing names, an empty table."""
    rows = [(None, None, None), (1, "u", ""), (2, "u", "<p>" + LONG * 20_000), (3, "v", "<p>x."), (3, "v", "<p>x.")]
    df = spark.createDataFrame([(*r, "old", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = tag_paths.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), len(r.text), r.n_chars) for r in got.collect()) == sorted([("None", 0, 0), ("1", 0, 0), ("2", len(LONG) * 20_000 - 1, len(LONG) * 20_000 - 1), ("3", 2, 2), ("3", 2, 2)])
    assert tag_paths.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<a<a" * 100_000, "<div>" * 50_000 + "</x>" * 50_000, "<p>" * 100_000, "<a x=\"" * 100_000, "<!--" * 100_000, "<table>" * 20_000 + "<td>x" * 20_000, "<script>" * 50_000, "<b>" * 50_000 + "</p>" * 50_000])
def test_time_is_linear(page):
    start = time.perf_counter()
    tag_paths.main_blocks(page)
    assert time.perf_counter() - start < 10
