from __future__ import annotations

import html
import random
import re
import time
from collections import Counter

import duckdb

from granary.llm import html_text as H

PAGES = "page_id long, url string, html string"
RULES = H.Rules(stop_words=frozenset("the of and to in is a that it was for on with as by".split()))
PROSE = "The history of the town is a long one, and it was in the old days that most of the houses on the hill were built by hand with stones of the river."


def text(page):
    return H.main_text(page, RULES)


def test_article_without_what_stands_around_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <article><h1>Old  town</h1><p>{PROSE}<p>Short one.</p><div class="ad-box">Buy</div><script>x("<p>no</p>")</script>
    <blockquote>It&#8217;s a&nbsp;quote &amp; more</blockquote><form><input><p>Mail</p></form></article>
    <section id="comments"><p>{PROSE}</p></section><aside><p>{PROSE}</p></aside><footer><p>&copy; Site</p></footer></body></html>"""
    assert text(page).split("\n\n") == ["Old town", PROSE, "Short one.", "It’s a quote & more"]


def test_two_passes_without_an_article_element():
    links = "".join(f'<li><a href="/{i}">a long link text to some page {i}</a></li>' for i in range(5))
    page = f"<body><ul>{links}</ul><div>Menu item</div><h2>Heading</h2><div>{PROSE}</div><div>In between.</div><p>{PROSE}</p><ul>{links}</ul><div>Far away</div></body>"
    assert text(page).split("\n\n") == ["Heading", PROSE, "In between.", PROSE]


def test_broken_markup():
    assert text(f"<article><p>{PROSE}<br>{PROSE}") == f"{PROSE}\n\n{PROSE}"
    assert text(f"<article><p>{PROSE}</p><p>{PROSE} &amp") == f"{PROSE}\n\n{PROSE} &"
    assert text(f"<article><p>{PROSE}</p><di") == PROSE
    assert text(f"<article><p>{PROSE}</p><!-- never closed <p>x</p>") == PROSE
    assert text(f"<article><p>{PROSE}</p><script>never closed") == PROSE
    assert text(f"<article><p>1 < 2 and {PROSE}</p></b></i></article>") == f"1 < 2 and {PROSE}"
    assert text("") == text("   ") == text("<p></p>") == ""


def test_long_pages_are_read_whole():
    page = f"<article>{''.join(f'<p>{i} {PROSE}</p>' for i in range(3000))}</article>"
    assert text(page).count("\n\n") == 2999


def test_pages_of_the_smallest_table(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    got = {r["page_id"]: r["text"] for r in H.extracted(spark.read.parquet(path)).collect()}
    for i, page in duckdb.sql(f"select page_id, html from '{path}'").fetchall():
        article = re.sub("</?b>", "", re.search("<article>(.*)</article>", page, re.S)[1])
        parts = (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in re.split("</?(?:p|h1|br)>", article))
        assert got[i] == "\n\n".join(filter(None, parts))


def test_nulls_empties_repeats_and_other_columns(spark):
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", page), (3, "u", page), (None, "v", page)]
    pages = spark.createDataFrame([(*r, "old", 7) for r in rows], PAGES + ", text string, n_chars int")
    out = H.extracted(pages)
    assert sorted(out.columns) == ["n_chars", "page_id", "text", "url"]
    assert sorted(((r["page_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, ""), (2, ""), (3, PROSE), (3, PROSE), (None, PROSE)], key=str)


def test_empty_table(spark):
    out = H.extracted(spark.createDataFrame([], PAGES))
    assert out.columns == ["page_id", "url", "text"] and out.count() == 0


def test_stop_words_come_from_whole_pages_and_unlearnt_languages_keep_their_text(spark):
    late = f"<html lang=en><body>{'<div>x</div>' * 5000}<p>{PROSE}</p></body></html>"  # the prose begins after 40,000 characters
    other = "Kaupungin historia ulottuu vuosisatojen taakse, mutta talot kukkulalla rakennettiin vanhoina aikoina joen kivistä ja puusta, ennen kuin tie valmistui kaupunkiin."
    rare = f"<body><div>Valikko</div><p>{other}</p></body>"  # no tag, and one page only of its language among untagged ones
    rows = [(i, "u", late) for i in range(4)] + [(10 + i, "u", f"<body><p>{i} {PROSE}</p></body>") for i in range(9)] + [(50, "u", rare)]
    pages = spark.createDataFrame(rows, PAGES)
    words, tags = H.stop_words(pages.where("page_id < 4"))
    assert {"the", "of"} <= words and tags == {"en"}
    got = {r["page_id"]: r["text"] for r in H.extracted(pages).collect()}
    assert other in got[50] and all(PROSE in got[i] for i in range(4))


def test_an_article_element_is_a_feature_and_no_switch():
    teaser = "<article><h3><a href=\"/x\">Another story</a></h3><p>Read more</p></article>"
    assert text(f"<body>{teaser}<div>{PROSE}</div><div>In between.</div><div>{PROSE} {PROSE}</div></body>").split("\n\n") == [PROSE, "In between.", f"{PROSE} {PROSE}"]
    listed = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda"  # long enough, but no stop word
    assert text(f"<main><p>{PROSE}</p><p>{PROSE}</p></main><div>{listed}</div>") == f"{PROSE}\n\n{PROSE}"
    links = "<p><a href=\"/\">a link text that is long enough to be decided by itself</a></p>"
    page = f"<main><p>{PROSE}</p>{links}<p>Read more</p>{links}<p>{PROSE}</p></main>"
    linked = "a link text that is long enough to be decided by itself"
    assert text(page).split("\n\n") == [PROSE, linked, "Read more", linked, PROSE]
    assert text("<article><h1>Hello</h1><p>Short.</p></article><div>Menu</div>") == "Hello\n\nShort."


def test_labels_match_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        found = [H.Block(rng.choice(["x" * 10, PROSE, "nothing here " * 8, "the of and x y z " * 4]), rng.choice(["p", "h2"]), 0, False, rng.choice(["good", "bad", "?", "?"])) for _ in range(rng.randint(0, 9))]
        want = []
        for i, b in enumerate(found):
            decided = [(abs(i - j), x.label == "bad", x.label, j > i) for j, x in enumerate(found) if j != i and x.label != "?"]
            nearest = sorted(min((d for d in decided if d[3] is side), default=(99,)) for side in (False, True))
            decided = [d[2] for d in nearest if len(d) > 1]
            if b.label == "good" or b.label == "?" and decided and decided[0] == "good":
                want.append(i)
        kept = {id(b) for b in H._second_pass(found)}
        assert [i for i, b in enumerate(found) if id(b) in kept] == want


def test_first_pass_by_length_links_and_stop_words():
    block = lambda text, linked=0, tag="p", inside=False: H.first_pass(H.Block(text, tag, linked, inside), RULES)
    assert block(PROSE) == "good" and block(PROSE, len(PROSE)) == "bad" and block("Short.") == "?" and block(PROSE, tag="h2") == "?"
    names = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa"
    assert block(names, 5) == "bad" and block(names) == "?" and block(names, inside=True) == "?"
    assert block(PROSE[:100]) == "?" and block(PROSE[:100], inside=True) == "good"


def test_pages_without_article_elements(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    bare = spark.read.parquet(path).selectExpr("page_id", "regexp_replace(html, '(</?)(article|main)>', '$1div>') AS html")
    got = {r["page_id"]: Counter(filter(None, r["text"].split("\n\n"))) for r in H.extracted(bare).collect()}
    hits = kept = there = 0
    for i, page in duckdb.sql(f"select page_id, html from '{path}'").fetchall():
        article = re.sub("</?b>", "", re.search("<article>(.*)</article>", page, re.S)[1])
        want = Counter(filter(None, (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in re.split("</?(?:p|h1|br)>", article))))
        hits, kept, there = hits + (got[i] & want).total(), kept + got[i].total(), there + want.total()
    assert hits >= 0.98 * kept and hits >= 0.93 * there


def test_time_is_linear_in_broken_pages():
    parts = {"<a ": "", "<b>": "</i>", '<a "': ">", "<!--": "", "<a '>": "", "<html": "", "<": "", '<p class="x': "", "&#" + "9" * 50: "", "<p>&#00000065;": "", "<script ": "</script", "<div>": "</span>", "<p><button><div>": "", "<p><b>": "<div>", '<div class="ad">x': "</div>", "<article><header>": "<h1>x", "<article><li><a href=x>": "</a>"}
    for head, tail in parts.items():
        took = []
        for n in (20_000, 80_000):
            page = head * n + tail * n
            began = time.process_time()
            H.main_text(page, RULES)
            took.append(time.process_time() - began)
        assert took[1] < max(2.0, 10 * took[0]), head
    assert text(f"<article><p>&#{'9' * 9000}; {PROSE} &#{'0' * 9000}65;</p></article>") == f"� {PROSE} A"
    assert text(f"<article><p>{PROSE}</p><script>if (a<b && c='\"') x(\"<p>no</p>\")</script><p>{PROSE}</p></article>") == f"{PROSE}\n\n{PROSE}"


def test_columns_of_any_name_pass_through(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}</p></article>", 7, "old")], PAGES + ", `a.b` int, Text string")
    out = H.extracted(pages)
    assert sorted(out.columns) == ["a.b", "page_id", "text", "url"] and out.first()["text"] == PROSE


#: Class names of wrappers on common sites: of the layout, of what is or isn't there, of a state.
WRAPPERS = """content no-sidebar|has-sidebar|with-nav page|post share-enabled|post header-fixed|article-tags-on|layout no-sidebar|page-with-sidebar
site has-footer|comments-closed|comments-open|no-comments|sidebar-none layout|two-columns sidebar-right-layout|nav-open|menu-closed|sticky-header-active|has-fixed-header
page-template page-template-sidebar-left|content-with-sidebar|post type-post status-publish format-standard hentry category-news tag-social|entry has-related|widget-free
cookies-off|is-logged-in has-toolbar|ad-free|with-ads|content menu-hidden|grid-sidebar-main|col-md-9 sidebar-on|no-promo|subscribe-disabled|social-active|has-banner
with-breadcrumbs|main-navigation-open|has-widget-area|footer-visible|masthead-hidden|page-header-template|theme-newsletter|type-notice|skip-off|has-popup-open""".replace("\n", "|").split("|")


def test_names_of_wrappers_take_nothing_away():
    assert len(WRAPPERS) > 40
    two = f"<p>{PROSE}</p><p>{PROSE} {PROSE}</p>"
    inner = (two, f"<h1>Old town</h1>{two}", f"<article><h1>Old town</h1>{two}</article>", f"<main>{two}</main>", f"<article>{two}</article><div class='sidebar'><p>{PROSE}</p></div>", f"<h1>Old town</h1>{two}<div id=comments><p>{PROSE}</p></div><div class='ad-slot'>{PROSE}</div>")
    for page in inner:
        plain = text(f"<body>{page}</body>")
        assert plain.split("\n\n")[-2:] == [PROSE, f"{PROSE} {PROSE}"]
        for name in [*WRAPPERS, "comments", "sidebar", "widget", "layout-right-sidebar", "menu-container", "header-wrap", "commentsArea"]:
            for put in (f'<div class="{name}">{page}</div>', f'<section id="{name}"><div>{page}</div></section>', f'<div class="{name}"><div class="{name}">{page}</div></div>'):
                assert text(f"<body>{put}</body>") == plain, (name, page)


def test_names_in_the_given_pages_take_nothing_away(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in pages:
        plain = text(page)
        for name in ("layout no-sidebar", "sidebar", "widget-area"):
            assert text(page.replace("<body>", f'<body><div class="{name}">').replace("</body>", "</div></body>")) == plain


def test_names_of_what_stands_outside():
    for name in "ad|ads|ad-slot|adBox|comments|comment-list|commentlist|post-comments|sidebar|left-sidebar|sidebarRight|cookie-banner|cookie_notice|site-footer|page-header|global-header|breadcrumbs|related-posts|share-buttons|newsletter-signup|promo-box|social|widget|nav|main-nav|navbar-default|menu-main|pagination|tags|post__comments".split("|"):
        for put in (f'<div class="{name}"><p>{PROSE}</p></div>', f'<section id="{name}"><p>{PROSE}</p></section>'):
            body = f"<h1>Old town</h1><p>{PROSE} {PROSE}</p>"
            for page in (f"<body>{put}{body}</body>", f"<body>{body}{put}</body>", f"<body><article>{body}{put}</article></body>", f"<main>{body}</main>{put}{put}{put}{put}"):
                assert text(page) == f"Old town\n\n{PROSE} {PROSE}", (name, page)
    assert text(f"<article><h2>A</h2><p>Short text.</p></article><div class=comments><p>{PROSE}</p><p>{PROSE}</p></div>") == "A\n\nShort text."
    assert text(f'<body><div data-x="is hidden" title="class=ad"><p>{PROSE}</p></div></body>') == PROSE
    many = "".join(f'<div class="site-widget widget-text"><p>{i} {PROSE}</p></div>' for i in range(4))
    assert text(f"<body>{many}</body>").count(PROSE) == 4  # every block bears the word


def test_an_articles_links_cells_and_header_stay():
    see = 'See <a href="/r">the whole long report of the committee</a>.'
    plain = "See the whole long report of the committee."
    assert text(f"<article><p>{PROSE}</p><p>{see}</p><p>{PROSE}</p></article>").split("\n\n") == [PROSE, plain, PROSE]
    assert text(f"<article><p>{PROSE}</p><table><tr><td>12 men<td>{see}</table><p>{PROSE}</p></article>").split("\n\n") == [PROSE, "12 men", plain, PROSE]
    assert text(f"<article><header class=entry-header><h1>Old town</h1><p>By A. B.</p></header><p>{PROSE}</p></article>").split("\n\n") == ["Old town", "By A. B.", PROSE]
    assert text(f"<body><header><h1>Site</h1></header><article><p>{PROSE}</p><header><p>Share this</p></header></article></body>") == PROSE
    listed = "".join(f"<li><a href=/{i}>part {i}</a></li>" for i in range(4))
    assert text(f"<article><ul>{listed}</ul><p>{PROSE}</p><ul>{listed}</ul><p>{PROSE}</p></article>") == f"{PROSE}\n\n{PROSE}"
    assert text(f"<article><p>{PROSE}</p><p><a href=/x>Back to the front page of this site</a></p></article>") == PROSE  # at the edge: no text on its other side


def test_a_block_ends_an_open_paragraph():
    assert text(f'<body><p class="promo">Buy<div><p>{PROSE} {PROSE}</p></div></body>') == f"{PROSE} {PROSE}"
    assert text(f"<article><p class=ad><b>Buy<h2>Old town</h2>{PROSE}</article>") == f"Old town\n\n{PROSE}"
    # Not a paragraph beyond a table's cell.
    assert text(f'<article><p>{PROSE}</p><table class="ad"><tr><td><div>{PROSE}</div><p>x<div>{PROSE}</div></td></tr></table></article>') == PROSE


def grown(rng, stop):
    """A page built at random from parts whose place is known, and the blocks of its article."""
    n = [0]

    def words(k):
        n[0] += 1
        return " ".join([f"word{n[0]}", *(rng.choice(stop if rng.random() < 0.45 else ["town", "stone", "river", "Gebäude", "hill", "market"]) for _ in range(k))])

    outside_tags, names = ["nav", "aside", "footer", "form"], ["ad", "sidebar", "comments", "cookie-notice", "related-posts", "share-buttons", "widget", "newsletter-signup", "site-footer"]

    def outside():
        what = "".join(f"<p>{words(rng.randint(4, 40))}</p>" for _ in range(rng.randint(1, 2)))
        if rng.random() < 0.4:
            what = f"<ul>{''.join(f'<li><a href=/x>{words(2)}</a></li>' for _ in range(4))}</ul>"
        tag = rng.choice(outside_tags)
        return f"<{tag}>{what}</{tag}>" if rng.random() < 0.4 else f'<{rng.choice(["div", "section"])} {rng.choice(["class", "id"])}="{rng.choice(names)}">{what}</div></section>'

    article, want = [], []
    for _ in range(rng.randint(4, 9)):
        tag, k = rng.choice([("p", 40), ("p", 60), ("p", 30), ("h2", 3), ("li", 35), ("td", 45), ("blockquote", 50)])
        line = words(k)
        want.append(line)
        shown = line if rng.random() < 0.7 or tag == "h2" else line.replace("town", "<a href=/t>town</a>", 1).replace("stone", "<i>stone</i>", 1)
        article.append(f"<{tag}>{shown}</{tag}>")
        if rng.random() < 0.3:
            article.append(outside())
    title = words(4)
    body = f"<h1>{title}</h1><p>{(first := words(45))}</p>{''.join(article)}<p>{(last := words(50))}</p>"
    wrap = rng.choice(["article", "main", "div", "div"])
    body = f"<{wrap}>{body}</{wrap}>"
    for _ in range(rng.randint(0, 2)):
        body = f'<div class="{rng.choice(WRAPPERS)}">{body}</div>'
    page = "".join(outside() for _ in range(rng.randint(0, 3))) + body + "".join(outside() for _ in range(rng.randint(0, 3)))
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{page}</body></html>", [title, first, *want, last]


def test_precision_and_recall_on_pages_with_renamed_elements_and_varied_classes():
    rng, hits, kept, there, whole = random.Random(8), 0, 0, 0, 0
    for _ in range(400):
        page, want = grown(rng, sorted(RULES.stop_words))
        got = text(page).split("\n\n")
        both = (Counter(got) & Counter(want)).total()
        hits, kept, there, whole = hits + both, kept + len(got), there + len(want), whole + (got == want)
    assert hits >= 0.97 * kept and hits >= 0.97 * there and whole >= 0.8 * 400, (hits, kept, there, whole)
