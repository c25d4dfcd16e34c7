import html
import random
import re

from cashlens.llm import htmltext
from tests_llm_util import SMALL


def test_whole_table_against_the_marked_article(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = [re.sub("<[^>]*>", "", b.replace("<br>", " ")) for b in re.split("</?(?:p|h1|article)>", article)]
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    found = htmltext.main_text(pages).collect()
    assert {r.page_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found)


def text(page):
    return "\n\n".join(htmltext.main_blocks(page))


def test_parts_beside_the_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body>
    <header><a href=/>Site</a></header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use cookies.<p>More on cookies</p></div>
    <main><article><header><h1>Title &amp; more</h1></header><p class=ad>Buy<p>First&nbsp;<b>bold</b>
    text<br>goes on.<script>var x="<p>no</p>"</script><div class="advert banner">Ad <div>inner</div> ad</div>
    <form><p>Sign up</p></form><p>Shadow of <a href=x>a link</a>.</p><ul><li>One<li>Two</ul><!-- <p>hidden</p> -->
    <p>1 &lt; 2</p><section id="comments"><h2>Comments</h2><p>Reader says hi</p></section></article>
    <aside>Side</aside></main><footer>&copy; Us</footer>"""
    assert text(page) == "Title & more\n\nFirst bold text goes on.\n\nShadow of a link.\n\nOne\n\nTwo\n\n1 < 2"


def test_unmarked_page_by_distribution():
    prose = ["Long enough sentence of the main text that says something, number %d." % k for k in range(6)]
    menu = "".join(f"<div><a href=/{k}>Menu entry number {k}</a></div>" for k in range(12))
    page = f"<body>{menu}" + "".join(f"<div>{p}</div>" for p in prose) + f"{menu}<div>Imprint</div></body>"
    assert text(page) == "\n\n".join(prose)


def test_broken_and_empty_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "just text"), (4, "u", "<p>a<div class=ad><p>b"), (5, "u", "<article>x" + "<p>y &amp z" * 30_000)]
    rows += [(6, "u", "<<<>>> a < b <p"), (7, "u", "<script>never closed"), (7, "u", "<script>never closed"), (None, "u", "<p>n</p>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    found = {r.page_id: r for r in htmltext.main_text(pages).collect()}
    assert len(found) == 8 and found[1].text == found[2].text == "" and found[3].text == "just text"
    assert found[4].text.startswith("a") and found[5].text.count("y & z") == 30_000 and found[None].text == "n"
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_words_inside_other_attributes_hide_nothing():
    for attribute in ('style="overflow: hidden"', 'title="a hidden gem" data-x=1', "alt='see class=ad and hidden'", "data-a=hidden", "data-class=ad", 'title="class=\'ad\'"'):
        assert text(f"<div {attribute}><article><p {attribute}>Text</p></article></div>") == "Text", attribute
        assert text(f"<div {attribute}><p>Some text without an article</p></div>") == "Some text without an article", attribute
    for attribute in ("hidden", 'title="x"hidden', "HIDDEN=''", "class = 'x ad'", "title=a aria-hidden=true", 'style="a" id=ad'):
        assert text(f"<article><p>Text</p><div {attribute}>Beside</div></article>") == "Text", attribute


def test_void_elements_hide_nothing():
    for tag in ('<img class="ad-banner ad" src=x>', '<img alt="x" hidden>', "<input class=share>", "<img class=header />", '<svg class="share"/>', "<wbr class=ad>"):
        assert text(f"<article><p>Text {tag} rest of the sentence</p></article>") == "Text rest of the sentence", tag
        assert text(f"<p>Text {tag} rest of the sentence</p>") == "Text rest of the sentence", tag
    assert text("<article><p>Text</p><hr class=related>after the rule</article>") == "Text\n\nafter the rule"
    assert text("<article><p>Text</p><div class=ad>unclosed<p>after</article>") == "Text\n\nafter"


def test_wrappers_of_the_article_are_not_beside_it():
    names = ["layout has-sidebar", "no-sidebar", "post-share-ready", "left side", "form", "notice", "x sidebar"]
    openings = [f'<div class="{n}">' for n in names] + ["<div id=main-form>", "<form action=/>", "<div role=search>", "<div hidden>", "<header>"]
    for opening in openings:
        close = f"</{opening[1:].split(' ')[0].rstrip('>')}>"
        beside = "<div class='sidebar'>Side <p>text</div><aside>More</aside><form>Sign up</form>"
        for body in ("<article><p>The text.</p></article>", "<main><p>The text.</p></main>"):
            long = "<section>Imprint and other text that is much longer than the article</section>"
            assert text(f"<body>{opening}{beside}{body}{close}{long}") == "The text.", opening
            assert text(f"<body>{opening}{opening}{beside}{body}{close}{close}") == "The text.", opening
        prose = "<p>Most of the page's text stands in one wrapper, with no article.</p>" * 2
        assert text(f"<body>{opening}{beside}{prose}{close}").count("Most of") == 2, opening
        assert text(f"<article>{opening}{beside}{prose}{close}</article>") == text(f"<article>{prose}</article>"), opening


def test_parts_stay_beside_the_article():
    for name in ("sidebar", "site-footer", "cookie-notice", "x ad", "left side", "comment-list", "nav2"):
        assert text(f"<article><p>The text.</p><div class='{name}'>Beside</div></article>") == "The text.", name
    post = "<p>The text of a page that marks nothing itself.</p>"
    for opening in ("<aside>", "<section class=related>", "<section id=comments>"):
        close = f"</{opening[1:].split(' ')[0].rstrip('>')}>"
        assert text(f"<div>{post}</div>{opening}<article>Another</article>{close}") == text(post), opening
        assert text(f"<main><article>{post}</article>{opening}<article>{post * 3}</article>{close}</main>") == text(post), opening


def test_unmarked_pages_with_parts_inside_the_article():
    long = ["Long enough sentence of the main text that says something, number %d." % k for k in range(12)]
    advert = "<div class=ad><p>Buy</p><p>this</p><p>now</p><p>please</p></div>"
    links = "".join(f"<div><a href=/{k}>Read entry number {k}</a></div>" for k in range(4))
    for tag in ("p", "div"):
        block = lambda t: f"<{tag}>{t}</{tag}>"  # noqa: B023, E731
        body = "".join(map(block, long))
        # A short lead, and a short end, next to parts beside the article.
        page = f"<body><div>{block('A lead.')}{advert}{body}{advert}{block('An end.')}</div></body>"
        assert text(page) == "\n\n".join(["A lead.", *long, "An end."]), tag
        # A later and an earlier region after unnamed blocks of links, of less than a fifth of the article.
        late = "One more sentence of the main text, which is long enough to begin a region of its own."
        page = f"<body>{links}<div>{block(late)}{links}{body}{links}{block(late)}</div>{links}<div>Imprint</div></body>"
        assert text(page) == "\n\n".join([late, *long, late]), tag
    page = f"<body><div><p>A lead.</p>{links}{''.join(f'<p>{t}</p>' for t in long)}{links}<p>An end.</p></div>{links}<p>Imprint</p></body>"
    assert text(page) == "\n\n".join(["A lead.", *long, "An end."])


def regions_by_hand(length, surge):
    """Surge and dive by their definition, a window at a time."""
    found, inside = [], False
    for i in range(len(length)):
        window = sum(length[i : i + htmltext.WINDOW])
        if not inside and length[i] > 0 and window >= surge:
            inside = True
            found.append([])
        inside = inside and window > 0
        if inside:
            found[-1].append(i)
    return found


def test_surges_and_dives_against_each_window():
    draw = random.Random(3)
    for _ in range(3_000):
        length = [draw.choice([0, 0, 0, 1, 5, 40, 90]) for _ in range(draw.randrange(14))]
        surge = draw.choice([1, 20, 80])
        assert [list(r) for r in htmltext.text_regions(length, surge)] == regions_by_hand(length, surge), (length, surge)


def test_every_page_goes_through_the_windows(spark, monkeypatch):
    calls = []
    regions = htmltext.text_regions
    monkeypatch.setattr(htmltext, "text_regions", lambda length, surge: calls.append((length, surge)) or regions(length, surge))
    pages = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("html").collect()]
    texts = [htmltext.main_blocks(page) for page in pages]
    assert len(calls) == len(pages) and all(surge == 1 for _, surge in calls)
    assert [len(t) for t in texts] == [len(length) for length, _ in calls]


def test_menus_in_main_have_no_length():
    entries = lambda n: "".join(f"<div><a href=/{k}>Entry {k}</a></div>" for k in range(n))
    prose = "<h1>Title</h1><p>A text.</p><p>More of it.</p>"
    wanted = "Title\n\nA text.\n\nMore of it."
    for menu in (entries(3), entries(9)):
        assert text(f"<main>{menu}{prose}{menu}</main>{menu}") == wanted
        assert text(f"<main>{prose}{menu}<p>An end.</p></main>") == wanted + "\n\nAn end."
        # Lists of links are the article's own, and a main of nothing else is what the page is about.
        assert text(f"<main>{menu}<article>{prose}{menu}</article></main>").count("Entry") == menu.count("Entry")
        assert text(f"<main>{menu}</main>").count("Entry") == menu.count("Entry")
    # Fewer lines than a window are text that links.
    assert text(f"<main>{prose}{entries(2)}</main>") == wanted + "\n\nEntry 0\n\nEntry 1"
    assert text(f"<main>{entries(1)}{prose}</main>") == "Entry 0\n\n" + wanted
