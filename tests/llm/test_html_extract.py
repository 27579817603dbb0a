import random
import time

import pytest

import varloom.llm.html_extract as he
from varloom.llm.html_extract import align, blocks, extract_pages, number, parse


def text(html):
    return "\n".join(blocks(parse(html), set()))


def test_parse_and_blocks():
    assert text("<p>a&amp;b &lt;x&gt;<b> c\n d</b><p>e<br>f<ul><li>1<li>2</ul>") == "a&b <x> c d\ne f\n1\n2"
    assert text("<div>a<script>if (a<b) '</p>'</script>b<!-- <p>no --><style>p{}</style></div>") == "a b"
    assert text('<p title="a>b">x</p></i></div>y < z & &copy;<p') == "x\ny < z & ©"
    assert text('<div class="ad-box">no</div><div id="site-nav">no</div><form>no</form><p hidden>no</p><p>yes') == "yes"
    assert text("") == "" and text("<<>><") == "<<>><"


def test_alignment_is_a_largest_match():
    a, b = parse("<ul><li>1<li>2<li>3</ul><p>x</p>"), parse("<div></div><ul><li>1<li>2</ul><p>y</p>")
    nodes = number(b)
    met = align(a, b)
    assert sorted(nodes[i].tag for i in met) == ["#root", "li", "li", "p", "ul"] and all(met[i].tag == nodes[i].tag for i in met)


ARTICLE = '<html><body><nav><a href="/">Home {i}</a></nav><div class="ad">buy {i}</div><article><h1>Title {i}</h1><p><b>First {i}.<br><p>Second &eacute; {i}.</p></article><div class="comments"><p>me too {i}</p></div><footer>&copy; {i}</footer>'
PLAIN = '<body><div><p>Welcome to our site</p><p>All rights reserved</p></div><div><div><h2>News {i}</h2><p>It was day {i} of the long story that goes on.</p></div></div><div><p>Contact us</p></div></body>'


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_pages_of_hosts(spark, monkeypatch, limit):
    monkeypatch.setattr(he, "BROADCAST_BYTES", limit)
    rows = [(i, f"http://a.org/{i}", ARTICLE.replace("{i}", str(i))) for i in range(30)] + [(100 + i, f"http://B.net/{i}", PLAIN.replace("{i}", str(i))) for i in range(30)]
    rows += [(200, "http://one.net/", "<p>only <i>page</i></p>"), (201, None, None), (202, "nohost", ""), (203, None, "<p>x</p>"), (None, "http://a.org/q", "<div>odd page</div>"), (0, "http://a.org/0", ARTICLE.replace("{i}", "0"))]
    got = extract_pages(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(30):
        assert by[i].text == f"Title {i}\nFirst {i}.\nSecond é {i}." and by[i].n_chars == len(by[i].text)
        assert by[100 + i].text == f"News {i}\nIt was day {i} of the long story that goes on."
    assert by[200].text == "only page" and by[201].text == by[202].text == "" and by[203].text == "x" and by[None].text == "odd page"
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def pages_of(spark, html, n=12, host="h.org"):
    rows = [(i, f"http://{host}/{i}", html(i)) for i in range(n)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


SAID = "On day {i} the {i} of them went on to the next of {i} places and stayed there for a while."


def test_alignment_decides_where_tags_and_classes_say_nothing(spark):
    html = lambda i: f"<body><div><ul><li>Start<li>World<li>Sport</ul></div><div><p>Our shop has all you need</p></div><div><h2>Day {i}</h2><p>{SAID.format(i=i)}</p><p>Tell your friends of this page.</p><p>More on {i} tomorrow.</p></div><div>Made with care</div>"
    for n in (12, 2):
        assert pages_of(spark, html, n) == {i: f"Day {i}\n{SAID.format(i=i)}\nMore on {i} tomorrow." for i in range(n)}


def test_constant_text_inside_an_article_goes_and_copies_stay(spark):
    body = lambda i, line: f"<body><p>Top</p><article><h1>Day {i}</h1><p>{SAID.format(i=i)}</p><p>{line}</p></article>"
    got = pages_of(spark, lambda i: body(i, "Read us every day."))
    assert got[3] == f"Day 3\n{SAID.format(i=3)}"
    got = pages_of(spark, lambda i: body(max(i, 2), "All of them.") + f"<script>track({i})</script>")  # ten of twelve are copies
    assert got[0].startswith("Day 2\nOn day 2") and got[11].startswith("Day 11\nOn day 11")
    same = "<body><div><p>The only text there is</p></div>"
    assert pages_of(spark, lambda i: same, 3) == dict.fromkeys(range(3), "The only text there is")


@pytest.mark.parametrize("mark", ['class="post has-comments"', 'class="post no-sidebar"', 'class="article related-posts-enabled"', 'class="comments"', 'id=menu'])
def test_class_words_drop_no_article(spark, mark):
    html = lambda i: f"<body><div class=menu>Start World</div><article {mark}><h1>Day {i}</h1><p class=\"ad-hoc\">{SAID.format(i=i)}</p><p class='social-history' title='the hidden truth' data-note=\"x hidden y\">So {i} it was.</p><math><mi>x{i}</mi></math></article><div class='comments'><p>me {i} too</p></div>"
    for n in (12, 1):
        assert pages_of(spark, html, n)[0] == f"Day 0\n{SAID.format(i=0)}\nSo 0 it was.\nx0"


def test_a_class_is_no_sign_against_most_of_the_text(spark):
    html = lambda i: f"<body><div><p>Top of the page</p></div><div class='comments'><h2>Day {i}</h2><p>{SAID.format(i=i)}</p></div><div class='ad'>buy {i}</div>"
    assert pages_of(spark, html)[5] == f"Day 5\n{SAID.format(i=5)}"


def test_depth_and_length_change_nothing(spark):
    deep = lambda i: "<body>" + "<div>" * 300 + f"<nav>deep menu {i}</nav><article><h1>Day {i}</h1><p>{SAID.format(i=i)}</p></article>" + "</div>" * 300 + f"<p>end {i}</p>"
    assert pages_of(spark, deep, 3)[1] == f"Day 1\n{SAID.format(i=1)}"
    many = lambda i: "<body><div>" + "<b>x</b>" * 3 + "".join(f"<p>line {j} of {i}</p>" + "<p>one line <i>of</i> all</p>" * (j % 7 == 0) + "<ul><li>same</ul>" * (j % 11 == i) for j in range(300)) + "</div><div>Foot</div>"
    got = pages_of(spark, many, 4)
    for i in range(4):
        assert all(f"line {j} of {i}" in got[i].split("\n") for j in range(300))
    assert text('<p a="' + "x' > y" * 200 + '">z') == "z" and text("<p " + "a='>' " * 200 + ">z") == "z"


def slow_match(a, b):
    """The size of the largest match by plain recursion over all cells."""
    if a.tag != b.tag:
        return 0
    grid = [[0] * (len(b.els) + 1) for _ in range(len(a.els) + 1)]
    for i, x in enumerate(a.els):
        for j, y in enumerate(b.els):
            grid[i + 1][j + 1] = max(grid[i][j + 1], grid[i + 1][j], grid[i][j] + slow_match(x, y))
    return 1 + grid[-1][-1]


@pytest.mark.parametrize("cells", [4_000_000, 50])
def test_alignment_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(he, "CELLS", cells)
    rng = random.Random(1)

    def tree(depth, most):
        return "".join(f"<{t}>{tree(depth - 1, 6) if rng.random() < 0.6 and depth else ''}</{t}>" for t in rng.choices(("div", "b", "i", "section"), k=rng.randrange(most)))

    for most in [7] * 60 + [60] * 12:
        a, b = parse(tree(2, most)), parse(tree(2, most))
        met = align(a, b)
        nodes = number(b)
        assert len(met) == slow_match(a, b) and all(met[i].tag == nodes[i].tag for i in met)
        places = [(met[i].up, nodes[i].up, met[i].up.els.index(met[i]), nodes[i].up.els.index(nodes[i])) for i in met if i]
        for x, y, p, q in places:
            assert all((p < r) == (q < s) for u, v, r, s in places if u is x and v is y and (p, q) != (r, s))


def test_long_and_deep_pages_are_read_in_linear_time():
    he._deep()
    start = time.time()
    for html in ("<div>" * 20_000, "<p>x" * 20_000, "<a href='" * 5_000, '<a "' * 20_000, "<" * 50_000, "<!--" * 20_000, "&" * 100_000, "<b>" * 20_000 + "</i>" * 1_000):
        tree, other = parse(html), parse(html)
        number(other)
        align(tree, other)
        blocks(tree, set())
    assert time.time() - start < 30


@pytest.mark.parametrize("n", [12, 6, 2])
@pytest.mark.parametrize("tag", ['form id="aspnetForm"', "aside", "dialog open", 'div role="dialog"', 'section role="form"'])
def test_no_form_or_aside_empties_a_page(spark, tag, n):
    """Elements that are noise elsewhere, around the article, inside it, or in place of it."""
    end = tag.split()[0]
    said = lambda i: f"<h2>Day {i}</h2><p>{SAID.format(i=i)}</p><p>More on {i} tomorrow.</p>"
    nav, low = "<nav><a href=/>Start</a></nav>", "<footer>Made with care</footer>"
    whole = {i: f"Day {i}\n{SAID.format(i=i)}\nMore on {i} tomorrow." for i in range(n)}
    assert pages_of(spark, lambda i: f"<body><{tag}>{nav}<article>{said(i)}</article>{low}</{end}>", n) == whole
    assert pages_of(spark, lambda i: f"<body><{tag}>{nav}<div>{said(i)}</div>{low}</{end}>", n) == whole
    inside = pages_of(spark, lambda i: f"<body>{nav}<article><h1>Head {i}</h1><{tag}>{said(i)}</{end}></article>{low}", n)
    assert inside == {i: f"Head {i}\n{t}" for i, t in whole.items()}


def test_forms_and_asides_beside_the_article_still_go(spark):
    form = lambda i: f"<form><label>Your name, reader {i}</label><select><option>{i}</select></form><aside>Also {i}</aside><nav>{'link ' * 40}{i}</nav>"
    got = pages_of(spark, lambda i: f"<body>{form(i)}<article><h2>Day {i}</h2><p>{SAID.format(i=i)}</p></article>", 6)
    assert got == {i: f"Day {i}\n{SAID.format(i=i)}" for i in range(6)}
    one = pages_of(spark, lambda i: "<body><form><label>Name</label><input name=q></form>", 1)
    assert one == {0: ""}
