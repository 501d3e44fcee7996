from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import html as H

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this now, it is very good and you need it, really you do.</div>
<div id="cookieNotice" role="dialog">We use cookies &amp; more.<form><input name=q><button>OK</button></form></div>
<article><header><h1>Head &amp; tail</h1></header><p><b>First&nbsp;part<br>of   it.<br><p>Short.<p>a &lt; b &copy; &#233; &amp</p>
<div class="comments"><p>I do not agree with any of this, not at all, never.</p></div></article>
<aside>See also</aside><footer>&copy; 2020 &middot; us</footer></body></html>"""


def test_article():
    assert H.main_text(PAGE) == "Head & tail\n\nFirst part of it.\n\nShort.\n\na < b © é &"


def test_without_article():
    body = "This is a sentence of the main text that goes on for a while, so there is much of it. " * 2
    page = f"<body><div class='menu'><a href=x>Home</a> <a href=y>More</a></div><div><a href=z>Only a link</a></div><h2>Head</h2><p>{body}</p><p>Short one.</p><p>{body}</p><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul><p>.</p></body>"
    assert H.main_text(page) == f"Head\n\n{body.strip()}\n\nShort one.\n\n{body.strip()}"


def test_broken_pages():
    assert H.main_text("") == "" and H.main_text("<p") == "" and H.main_text("plain") == "plain"
    assert H.main_text("<article><p>cut off in &am") == "cut off in &am"
    assert H.main_text("<article><p>cut off <b in") == "cut off"
    assert H.main_text("<article><script>x") == ""
    assert H.main_text('<article><p title="a>b">x</p></article>') == "x"


LONG = "This sentence is a part of the article and goes on for quite a while here. " * 2


def said(page):
    return H.main_text(page).split("\n\n") if H.main_text(page) else []


def test_names_of_frames_are_void():
    text = f"<h1 id='related'>Head</h1><p>{LONG}</p><h2 class='notice-title'>More</h2><p>{LONG}</p>"
    wanted = ["Head", LONG.strip(), "More", LONG.strip()]
    junk = "<div class='sidebar'><p>Some words beside the article.</p></div>"
    for page in (
        f"<div class='content with-sidebar'>{text}</div>{junk}",
        f"<article class='post has-sidebar no-comments'>{text}</article>{junk}",
        f"<main class='with-header'>{text}</main>{junk}",
        f"<div class='layout sidebar-right'><div class='body'>{text}</div>{junk}</div>",
        f"<form id='page'><div>{text}</div>{junk}</form>",
        f"<div class='menu'><a href=x>One</a><article>{text}</article></div>{junk}",
    ):
        assert said(page) == wanted, page[:60]


def test_names_of_parts_hold():
    reader = "I do not agree with any of this, and I say so at length. " * 4
    comments = "".join(f"<li class='comment'><article class='comment-body'><p>{reader}</p></article></li>" for _ in range(5))
    for frame in ("article", "div"):
        page = f"<{frame}><h1>Head</h1><p>{LONG}</p></{frame}><ol class='commentlist'>{comments}</ol><div class='related'><article><p>{LONG}</p></article></div>"
        assert said(page)[:2] == ["Head", LONG.strip()] and not any(reader.strip() == t for t in said(page)), frame
    page = f"<article><p>{LONG}</p></article><div class='related'><article><p>Other</p></article></div><div>Outside of it</div>"
    assert said(page) == [LONG.strip()]


def test_links_between_text_stay():
    page = f"<ul><li><a>Home</a></li><li><a>News</a></li></ul><p>{LONG}</p><ul><li><a>a source</a></li></ul><p><a>{LONG}</a></p><p>{LONG}</p><div><a>x</a></div><div><a>y</a></div>"
    assert said(page) == [LONG.strip(), "a source", LONG.strip(), LONG.strip()]
    for frame in ("article", "div"):
        assert said(f"<{frame}><h1><a href=x>Head</a></h1><p>{LONG}</p><p><a>All of it is a link</a></p></{frame}>") == ["Head", LONG.strip(), "All of it is a link"]


def test_omitted_end_tags_end_with_their_element():
    wanted = [LONG.strip(), "Short."]
    assert said(f"<ul><li class='share'>Share</ul><p>{LONG}<p>Short.") == wanted
    assert said(f"<table><tr><td class='sidebar'>Side<tr><td>{LONG}<p>Short.</table>") == wanted
    assert said(f"<div><p class='ad'>Buy<p>{LONG}<p>Short.</div>") == wanted
    assert said(f"<div><span hidden>no <b>no</span><p>{LONG}</p></i></div></div><p>Short.") == wanted


def brute_spans(lengths, window, surge):
    """Every pair of a surge and the dive after it, by all windows."""
    sums = [sum(lengths[k : k + window]) for k in range(len(lengths))] + [0]
    needed = min(surge, max(sums) / 2)
    out = []
    for a in range(len(lengths)):
        for b in range(a, len(lengths)):
            runs = all(sums[a : b + 1]) and not sums[b + 1]
            earlier = [k for k in range(a) if sums[k] > needed and all(sums[k : a + 1])]
            if sums[a] > needed and runs and not earlier:
                own = [k for k in range(a, b + 1) if lengths[k]]
                out.append((own[0], own[-1]))
    return out


def test_densities_decide_between_equal_elements():
    """A page of nothing but divs: short lines about the text go, and so do stretches that never rise."""
    div = lambda *lines: "".join(f"<div>{t}</div>" for t in lines)
    page = div("Home", "News", "Sport", "Contact") + "<div><a>x</a></div>" * 3 + div(LONG, "A short line.", LONG) + "<div><a>y</a></div>" * 3 + div("About", "Terms", "Help")
    read = H.Page(page)
    assert not any(read.skipped()) and said(page) == [LONG.strip(), "A short line.", LONG.strip()]
    assert said(page) != [line.text for line in read.lines]
    # lines without links between are in no stretch of their own: it begins where the sum surges
    page = div(*"abcdefgh", LONG, "tail")
    assert said(page) == ["g", "h", LONG.strip(), "tail"]


def test_nothing_of_an_article_is_dropped():
    links = "".join(f"<div><a href=x>link {k}</a></div>" for k in range(4))
    assert said(f"<article><p>{LONG}</p>{links}<p>Short tail.</p></article>") == [LONG.strip(), *(f"link {k}" for k in range(4)), "Short tail."]
    assert said(f"<div>{LONG}</div><article><p>Tiny.</p></article><div>{LONG}</div>") == ["Tiny."]
    for part in ("<p class='share-price'>{}</p>", "<section id='related-work'>{}</section>", "<section class='binary-search'>{}</section>", "<div class='login_flow'>{}</div>", "<p id='noticeOfTerms'>{}</p>"):
        assert said(f"<article><p>Head.</p>{part.format(LONG)}</article>") == ["Head.", LONG.strip()], part
    for name in ("share-buttons", "related posts", "relatedPosts", "site-nav", "ad", "ad-slot-2", "newsletter_signup", "cookie-banner", "post-comments", "sidebar"):
        assert said(f"<article><p>{LONG}</p><div class='{name}'>Some other words</div></article>") == [LONG.strip()], name


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 30, 90]), max_size=25), st.integers(1, 4), st.integers(1, 120))
def test_stretches_by_brute_force(lengths, window, surge):
    assert H.spans(lengths, window, surge) == brute_spans(lengths, window, surge)


def test_very_long_pages():
    import time

    start = time.time()
    many = "<p>some words of text</p>" * 100_000
    assert len(said(f"<article>{many}</article>")) == 100_000
    assert H.main_text("<div class='menu'>" * 50_000 + f"<p>{LONG}</p>") == LONG.strip()
    assert H.main_text("<b>" * 100_000 + f"<p>{LONG}" + "</i>" * 100_000) == LONG.strip()
    assert H.main_text(f"<p>{'word ' * 400_000}</p>").count("word") == 400_000
    assert time.time() - start < 60


def test_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (2, None, None), (3, "v", ""), (None, "w", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n_chars")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in H.extract_pages(df).collect())
    assert got == [(0, "w", "x", 1), (1, "u", H.main_text(PAGE), len(H.main_text(PAGE))), (2, "", "", 0), (2, "", "", 0), (3, "v", "", 0)]
    assert H.extract_pages(df.limit(0)).count() == 0


def test_pages_give_their_articles(spark, small):
    from cuelight.llm.queries import op7_html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = op7_html(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text and "©" not in r.text and "track(" not in r.text and "<p>" not in r.text and r.n_chars == len(r.text)
