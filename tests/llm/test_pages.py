from shelfwise.llm.html_text import extract, main_text
from tests.llm.conftest import words

ARTICLE = [words(i, n) for i, n in enumerate((8, 60, 3, 1, 120, 2))]


def page(body, before="", after=""):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"
        f"<header class='top'>Site name</header><nav><ul><li><a href='/a'>a long menu entry</a></li><li><a href='/b'>b</a></li></ul></nav><!-- ad -->{before}"
        f"<article>{body}</article>{after}<footer>&copy; site</footer></body></html>"
    )


def test_article_alone_is_kept():
    paragraphs = "".join(f"<p>{t}</p>" for t in ARTICLE[1:])
    beside = (
        f"<div class='ad'>{words(30, 80)}</div><aside>{words(31, 90)}</aside><div id='cookie-notice'>{words(32, 50)}</div>"
        f"<form>Name <input name=n><textarea>{words(33, 40)}</textarea></form><div class='sidebar'><p>{words(34, 70)}<p>{words(35, 50)}</div>"
    )
    comments = f"<section class='comments'><p>{words(36, 90)}</p><div><p>{words(37, 60)}</p></div></section>"
    assert main_text(page(f"<h1>{ARTICLE[0]}</h1>{paragraphs}", beside, comments)) == "\n".join(ARTICLE)


def test_names_on_the_page_and_the_article():
    for tag in ("body class='has-sidebar'", "main id='with-comments'", "article class='post no-share'"):
        assert main_text(f"<{tag}><p>{ARTICLE[1]}</p><div class='sidebar'>{words(39, 60)}</div></{tag.split()[0]}>") == ARTICLE[1]
    assert main_text(f"<article hidden><p>{ARTICLE[1]}</p></article>") == ""


def test_advert_inside_the_article():
    body = f"<p>{ARTICLE[1]}</p><div class=\"ad banner\">{words(40, 30)}</div><p>{ARTICLE[4]}</p>"
    assert main_text(page(body)) == f"{ARTICLE[1]}\n{ARTICLE[4]}"


def test_structure_goes_before_names():
    long, other = f"<p>{ARTICLE[1]}</p>", f"<p>{ARTICLE[4]}</p>"
    advert = f"<div class='ad'><p>{words(41, 30)}</p><p>{words(42, 20)}</p><p>Buy</p><p>now</p></div>"
    # a short closing paragraph behind a long advert
    assert main_text(page(f"{long}{advert}<p>The end.</p>")) == f"{ARTICLE[1]}\nThe end."
    # a paragraph that is a link; a list of links is a menu
    assert main_text(page(f"{long}<p><a href='/s'>The whole study is here</a></p>{other}<ul><li><a href='/a'>more</a></ul>")) == f"{ARTICLE[1]}\nThe whole study is here\n{ARTICLE[4]}"
    for tag in ('section class="related-work"', 'div id="search-results-of-the-study"', "div class='with-sidebar'"):
        assert main_text(page(f"{long}<{tag}>{other}</{tag.split()[0]}>")) == f"{ARTICLE[1]}\n{ARTICLE[4]}"
    for tag in ("div class='related-posts'", "div class='x ad-slot-2'", "section id='post_comments'", "div class='newsletter-signup box'", "div class='side-bar'", "div role=complementary"):
        assert main_text(page(f"{long}<{tag}>{other}</{tag.split()[0]}>")) == ARTICLE[1]
    assert main_text(page(f"{long}<figure><img src=x><figcaption>What it shows</figcaption></figure>")) == f"{ARTICLE[1]}\nWhat it shows"
    assert main_text(page(long, after="<div>\u00a9 2024 the owners of the site</div>")) == ARTICLE[1]
    assert main_text(f"<div>{long}{other}</div><div>&copy; 2024 the owners</div>") == f"{ARTICLE[1]}\n{ARTICLE[4]}"


def test_advert_inside_a_line():
    body = f"{ARTICLE[1]} Before <span class='ad'><span>BUY</span> <b>NOW</b></span> after"
    for whole in (page(f"<p>{body}</p>"), f"<div><p>{body}</p></div>"):
        assert main_text(whole) == f"{ARTICLE[1]} Before after"


def test_articles_that_hold_little():
    # cards beside the text, and no article around it
    cards = "".join(f"<article><a href='/{i}'>{words(60 + i, 4)}</a></article>" for i in range(4))
    assert main_text(f"<div><p>{ARTICLE[4]}</p></div><div>{cards}</div>") == ARTICLE[4]


def test_markup_and_references():
    body = f"<p><b>{ARTICLE[1]}.<br><p>A &amp;&lt;&eacute;&#233; b</b>old  \n <i>i</i>t x<ul><li>one<li>two</ul>"
    assert main_text(page(body)) == f"{ARTICLE[1]}.\nA &<éé bold it x\none\ntwo"


def test_little_text_and_broken_pages():
    assert main_text(None) == main_text("") == main_text("<p> </p><nav>menu</nav>") == ""
    assert main_text("plain text only") == "plain text only"
    assert main_text(page("<p>Few words.</p>")) == "Few words."
    assert main_text(f"<article><p>{ARTICLE[1]}</p><p cla") == ARTICLE[1]
    assert main_text(f"<p>{ARTICLE[1]}</p><!-- never closed <p>x</p>") == ARTICLE[1]
    assert main_text("<p>a < b and c") == "a < b and c"
    long = words(50, 40_000)
    assert main_text(page(f"<p>{long}</p>")) == long


def test_extract(spark):
    rows = [(1, "u", page(f"<p>{ARTICLE[1]}</p>"), "own"), (1, "u", page(f"<p>{ARTICLE[1]}</p>"), "own"), (None, None, None, None), (2, None, "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(extract(df).collect(), key=str)
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == sorted([(1, "u", ARTICLE[1], len(ARTICLE[1]))] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=lambda r: str(r)) or len(got) == 4
    assert sorted(r.n_chars for r in got) == [0, 0, len(ARTICLE[1]), len(ARTICLE[1])]
    assert extract(df.filter("false")).count() == 0


def test_articles_of_the_pages_table(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert main_text(r.html) == "\n".join(b for b in blocks if b)
