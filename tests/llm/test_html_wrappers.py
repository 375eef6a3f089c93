import html
import re

from foldline.llm.html_wrappers import Wrapper, blocks, class_level, digest, expression, extract, host_of, infer, main_text, page_facts
from foldline.llm.shared import work_dir

SHOP = "<html><body><div class=top>Shop of all things</div><ul class=list><li><a href=/1>One link</a></li></ul><div class=body><p>{}</p><p>Price: 5</p></div></body></html>"
FORM = "page_id long, url string, html string"


def test_class_words():
    assert [class_level(c) for c in ("ad", "user-comments", "comment-list", "related-posts", "share-buttons")] == [2] * 5
    assert [class_level(c) for c in ("search-result", "related-work", "adblock", "content")] == [1, 1, 0, 0]


def test_expression():
    pages = ["<ul><li>x<li>y</ul><p>t", "<ul><li>x</ul><h2>q</h2><p>t"]
    rows = {}
    for page in pages:
        for _, place, child, _, _, least, most, held, *_ in page_facts("", page):
            if child is not None:
                old = rows.get((place, child), (least, most, 0))
                rows[place, child] = (min(old[0], least), max(old[1], most), old[2] + held)
    assert expression([(*k, *v) for k, v in rows.items()]) == "h2 # /h2 p # /p ul (li # /li)+ /ul"
    assert Wrapper.read("a ((p #:1f,2 /p)+)? (#other)? /a #").slots == {"a/p": ("#", {"1f", "2"}), "a": ("#other", set()), "": ("#", set())}
    deep = [("/".join(["div"] * k), "div", 1, 1, 3) for k in range(3000)]
    assert expression(deep).split().count("/div") == 3000
    assert expression([("", "div", 1, 1, 2), ("div", "#", 1, 1, 1), ("div", "p", 1, 3, 2), ("div/p", "#", 1, 1, 5)]) == "div (#)? (p # /p)+ /div"


def test_odd_markup():
    page = "<title>T</title><nav><a>menu</a><article><h1>A &amp; b</h1><p><b>One.<br><p>Two&nbsp;<i>t</i>hree &lt;x&gt;<script>var a='</p>';</script><!-- no --><aside>ad</aside><div class='user-comments'>c</div><form>f</form></article><footer>f"
    assert extract(page) == "A & b\nOne.\nTwo three <x>"
    assert extract(None) == extract("") == extract("<div class=ad>x</div>") == ""
    assert extract("plain  words") == "plain words" and extract("<p>a<") == "a<"


def test_evidence_within_an_article():
    page = '<article><h1>T</h1><div class="search-result"><p>body text</p></div><p class="related-work">more</p><div class="ad-slot">buy</div></article>'
    assert extract(page) == "T\nbody text\nmore"
    # A teaser in an aside does not make the rest go.
    assert extract("<div class=story><p>The text</p></div><aside><article>A teaser</article></aside>") == "The text"


def test_class_words_of_paragraphs():
    page = '<article><p class="social">About social things.</p><h2 class="related">More</h2><div class="social"><p>share</p></div></article>'
    assert extract(page) == "About social things.\nMore"
    assert extract('<p class="social">share</p><p>text</p>') == "text"


def test_the_expression_decides():
    """Changes of the expression alone change the text."""
    page = "<article><h1>Title</h1><p>One.</p><p>Two.</p></article><div class=box><p>Outside</p></div>"
    two = f"{digest('Two.') & (1 << 64) - 1:x}"
    read = lambda wrapper: extract(page, Wrapper.read(wrapper))
    assert read("") == read("article h1 # /h1 (p # /p)+ /article div.box p #other /p /div.box") == "Title\nOne.\nTwo."
    assert read("article h1 #fixed /h1 (p # /p)+ /article") == "One.\nTwo."
    assert read(f"article (h1 # /h1)? (p #:{two} /p)+ /article (div.box p # /p /div.box)?") == "Title\nOne.\nOutside"
    assert read("article h1 # /h1 (p #links /p)+ /article") == "Title"


def shop(spark, n, text=SHOP):
    return [(k, f"http://shop.example/{k}", text.format(f"Text number {k} of this page")) for k in range(n)]


def test_wrapper_tells_the_template(spark):
    rows = shop(spark, 6) + [(100, None, None), (101, "::bad", ""), (0, "http://shop.example/0", SHOP.format("Text number 0 of this page")), (None, "http://shop.example/x", "<p>One page's own words</p>")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], FORM + ", text long, wrapper string")
    got = [(r.page_id, r.text, r.n_chars) for r in main_text(pages, work_dir(spark, "t")).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    want = {(k, f"Text number {k} of this page") for k in range(6)} | {(100, ""), (101, ""), (None, "One page's own words")}
    assert {(p, t) for p, t, _ in got} == want
    found = infer(pages, work_dir(spark, "t")).where("host = 'shop.example'").first()
    price, top, link = (f"{digest(t) & (1 << 64) - 1:x}" for t in ("Price: 5", "Shop of all things", "One link"))
    assert found.wrapper == f"html body div.body (p #:{price} /p)+ /div.body div.top #:{top} /div.top ul.list li #links:{link} /li /ul.list /body /html"
    # Without the wrapper the same page keeps the template's strings.
    assert extract(rows[0][2], Wrapper()) == "Shop of all things\nOne link\nText number 0 of this page\nPrice: 5"
    assert extract(rows[0][2], Wrapper.read(found.wrapper, found.main)) == "Text number 0 of this page"
    assert main_text(pages.where("page_id < 0"), work_dir(spark, "t")).count() == 0


def test_repeated_rows_are_one_page(spark):
    one = shop(spark, 1)[0]
    pages = spark.createDataFrame([one] * 5, FORM)
    assert {r.text for r in main_text(pages, work_dir(spark, "t")).collect()} == {extract(one[2])} != {""}
    assert infer(pages, work_dir(spark, "t")).first().wrapper == ""


def test_shared_strings_of_articles(spark):
    """A slot of an article that holds the same on all pages goes; a shared string in a slot of text stays."""
    text = "<article><h2>{1}</h2><p>All stories begin so.</p><p>Words {0} of this page, of which there are many.</p><div>Read our newsletter</div></article>"
    rows = [(k, "http://a.example/", text.format(k, "Results" if k % 3 else "Aims")) for k in range(9)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, FORM), work_dir(spark, "t")).collect()}
    assert got == {k: f"{'Results' if k % 3 else 'Aims'}\nAll stories begin so.\nWords {k} of this page, of which there are many." for k in range(9)}
    # Copies of one article with footers of their own are no template.
    rows = [(k, "http://a.example/", f"<article><h1>Title</h1><p>The same words</p></article><div>Page {k}</div>") for k in range(5)]
    assert {r.text for r in main_text(spark.createDataFrame(rows, FORM), work_dir(spark, "t")).collect()} == {"Title\nThe same words"}


def test_most_text_of_a_host(spark):
    """The slot with most of a host's text stays, whatever its class is called; a smaller one of such a class goes."""
    page = "<div class=promo><p>Entry {0}, with a longer text of its own than what comes below</p></div><div class=ad>Buy {0}</div>"
    rows = [(k, "http://a.example/", page.format(k)) for k in range(4)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, FORM), work_dir(spark, "t")).collect()}
    assert got == {k: f"Entry {k}, with a longer text of its own than what comes below" for k in range(4)}


def test_main_element_by_the_host(spark):
    """Text outside articles goes where a host's pages have theirs in articles, and stays where the article is a teaser."""
    news = "<body><div class=x>Weather of day {0}: {0} degrees</div><article><p>Story {0} with a longer text of its own, much longer than the weather</p></article></body>"
    blog = "<body><div class=x>Entry {0} with a longer text of its own, much longer than any teaser here</div><article>Teaser {0}</article></body>"
    rows = [(k, f"http://{h}.example/{k}", t.format(k)) for h, t in (("news", news), ("blog", blog)) for k in range(4)]
    got = {(r.url, r.text) for r in main_text(spark.createDataFrame(rows, FORM), work_dir(spark, "t")).collect()}
    assert ("http://news.example/2", "Story 2 with a longer text of its own, much longer than the weather") in got
    assert ("http://blog.example/2", "Entry 2 with a longer text of its own, much longer than any teaser here\nTeaser 2") in got


def brute_slots(rows):
    """Each host's slots that are on three pages and more, by loops over dicts: (host, place) -> (mark, template strings)."""
    slots, plain, host_chars = {}, {}, {}
    for _, url, page in {(host_of(u), u, p) for _, u, p in rows}:
        bs, _, has_main = blocks(page)
        for b in bs:
            held = slots.setdefault((host_of(url), b.place), {}).setdefault((page, b.text, b.main, b.level, has_main), [0, 0])
            held[0], held[1] = held[0] + len(b.text), held[1] + b.linked
    for (host, _), strings in slots.items():
        total, linked = (sum(v[k] for v in strings.values()) for k in (0, 1))
        host_chars[host] = host_chars.get(host, 0) + total * (2 * linked <= total)
        for (_, _, main, level, has), (chars, link) in strings.items():
            if has and level < 2 and 2 * link <= chars:
                plain.setdefault(host, [0, 0])[main] += chars
    found, same = {}, {}
    for (host, place), strings in slots.items():
        pages = {k[0] for k in strings}
        if len(pages) < 3:
            continue
        times = {}
        for page, text, *_ in strings:
            times.setdefault(text, set()).add(page)
        share = lambda at: 2 * sum(v[0] for k, v in strings.items() if k[at]) > chars  # noqa: B023, E731
        chars, linked = (sum(v[k] for v in strings.values()) for k in (0, 1))
        inside, has, link = share(2), share(4), 2 * linked > chars
        outside, within = plain.get(host, (0, 0))
        score = 1 - round(sum(k[3] * v[0] for k, v in strings.items()) / chars) + (has and within >= outside) * (1 if inside else -1) - link * (1 if inside else 2)
        kept = score > 0 or not has and not link and 2 * chars > host_chars[host]
        fixed = inside and 10 * sum(len(p) for p in times.values() if len(p) >= 3 and 10 * len(p) >= 9 * len(pages)) >= 9 * len(strings)
        literals = {t for t, p in times.items() if not inside and len(p) >= 3 and 2 * len(p) >= len(pages)}
        found[host, place] = kept, fixed, literals
        if kept and inside:
            same.setdefault(host, [0, 0])[fixed] += chars
    return {k: (kept and not (fixed and same[k[0]][1] < same[k[0]][0]), literals) for k, (kept, fixed, literals) in found.items()}, {h: w >= o for h, (o, w) in plain.items()}


def test_against_brute_force(spark):
    """main_text() against loops over all pages."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows += shop(spark, 7) + [(200 + k, f"http://x.example/{k}", f"<div><p>note</p><p>own {k}</p>{'<h2>seldom</h2>' * (k < 3)}</div><table><tr><td><a>link {k}</a></td></tr></table>") for k in range(8)]
    rows += [(300 + k, f"http://y.example/{k}", f"<main><h1>Site</h1><p>start</p><p>own words {k}</p><p class=ad>odd {k}</p></main>" + "<div class=promo>buy</div>" * (k % 2)) for k in range(9)]
    slots, mains = brute_slots(rows)
    assert {("shop.example", "Price: 5"), ("x.example", "note"), ("x.example", "seldom")} <= {(h, t) for (h, _), (_, ts) in slots.items() for t in ts}
    got = {(r.page_id, r.url): r.text for r in main_text(spark.createDataFrame(rows, FORM), work_dir(spark, "t")).collect()}
    for page_id, url, page in rows:
        host, kept = host_of(url), []
        bs, _, has_main = blocks(page)
        for b in bs:
            keeps, literals = slots.get((host, b.place), (1 - b.level + (has_main and mains.get(host, True)) * (1 if b.main else -1) > 0, ()))
            kept += [b.text] * (keeps and b.text not in literals)
        assert got[page_id, url] == "\n".join(kept)
    assert got[201, "http://x.example/1"] == "own 1"
    assert got[301, "http://y.example/1"] == "start\nown words 1\nodd 1"


def test_very_long_page(spark):
    page = "<article>" + "<p>some &amp; words</p>" * 40_000 + "<nav>x</nav>" * 1000 + "</article>"
    got = main_text(spark.createDataFrame([(1, "http://a/", page)], FORM), work_dir(spark, "t")).first()
    assert got.text == "\n".join(["some & words"] * 40_000)


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages, work_dir(spark, "t")).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(x for x in lines if x)
