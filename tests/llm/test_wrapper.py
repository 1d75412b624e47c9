import random
import re

import pytest

from paddyframe.llm import wrapper as X


def text(html, wrapper=None):
    return X.main_text(html, wrapper)


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("   ", ""), ("plain &amp; simple", "plain & simple"),
    ("<body><nav><a href=x>Home</a></nav><p>One<p>Two <b>bold<br>line</b></body>", "One\n\nTwo bold line"),
    ("<div class='side-bar sidebar'>s</div><p>a&nbsp; b &lt;c&gt; &#233;</p><footer>f</footer>", "a b <c> é"),
    ("<article><header><h1>T</h1></header><p>x</p><aside>y</aside><div id=comments><p>z</p></div></article><p>out</p>", "T\n\nx"),
    ("<header><h1>Site</h1></header><main><h2>T</h2><ul><li>a<li>b</ul></main>", "T\n\na\n\nb"),
    ("<p>a<script>if (1<2) '</p>'</script>b<style>p{}</style></p><p>c <!-- no <p> --> d", "ab\n\nc d"),
    ("<form><p>q</p></form><p>1 < 2 and 3 > 2</p><p hidden>h</p>", "1 < 2 and 3 > 2"),
    ("<article><p><b>Open<br><p>Next</p><p>Cut ta", "Open\n\nNext\n\nCut ta"),
    ("<article><p>Cut tag</p><p cla", "Cut tag"),
    ("<div>lead <div>inner</div> tail</div>", "lead\n\ninner\n\ntail"),
    ("<div><a href=1>Link one</a> <a href=2>Link two</a></div><p>Words with <a href=3>one</a> link</p>", "Words with one link"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("<P CLASS=Advert>x</P><P>y</P>", "y"),
])
def test_blocks(html, want):
    assert text(html) == want


def page(i, note="Read our terms before you go on.", extra=""):
    rng = random.Random(i)
    para = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    ps = [para() for _ in range(rng.randint(1, 6))]
    body = "".join(f"<p>{p}</p>" for p in ps)
    return f"<html><body><div class=box><p>{note}</p></div><div class=text><h1>Title {i}</h1>{extra}{body}</div><div class=end><p>{note} Bye.</p></div></body></html>", \
        "\n\n".join([f"Title {i}", *ps])


def test_constant_nodes_are_template():
    made = [page(i) for i in range(12)]
    w = X.induce([h for h, _ in made[:8]])
    assert all(text(h, w) == t for h, t in made)
    # without a wrapper the notes stay: it is the alignment that finds them
    assert text(made[0][0]) != made[0][1]
    # a line that most, not all, pages share is content
    made = [page(i, extra="<p>Shared line</p>" if i % 3 else "") for i in range(12)]
    w = X.induce([h for h, _ in made[:8]])
    assert all(("Shared line" in text(h, w)) == (i % 3 > 0) for i, (h, _) in enumerate(made))


def test_match_is_the_largest_alignment():
    rng = random.Random(0)

    def tree(d):
        n = X.Node(rng.choice("ab"))
        n.kids = [tree(d - 1) for _ in range(rng.randint(0, 3))] if d else []
        return n

    def slow(a, b):
        if a.label != b.label:
            return 0

        def go(i, j):
            if i == len(a.kids) or j == len(b.kids):
                return 0
            return max(go(i + 1, j), go(i, j + 1), go(i + 1, j + 1) + slow(a.kids[i], b.kids[j]))
        return 1 + go(0, 0)
    for _ in range(200):
        a, b = tree(3), tree(3)
        score, pairs = X.match(a, b)
        assert score == slow(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs)


def test_few_or_equal_pages_keep_their_text(spark):
    one, want = page(1)
    rows = [(i, "http://same.example/a", one, 7) for i in range(20)] + [(50, None, one, 7), (51, "x", None, 7), (52, "http://same.example/b", "", 7)]
    got = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string, wrapper int")).collect()}
    assert len(got) == 23 and all(want in got[i] for i in range(20)) and got[51] == got[52] == ""


def test_hosts_have_their_own_wrappers(spark):
    made = {(h, i): page(i, note=f"Note of host {h} for all.") for h in range(3) for i in range(20)}
    rows = [(h * 100 + i, f"https://H{h}.example.org/{i}?x", p) for (h, i), (p, _) in made.items()]
    got = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[h * 100 + i] == t for (h, i), (_, t) in made.items())


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in X.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1]
        want = [" ".join(X.entities.unescape(re.sub(r"<[^>]*(>|$)", " ", p)).split()) for p in re.split(r"<p>|</p>|</h1>", inner)]
        assert r.text.replace("\n\n", "\n") == "\n".join(p for p in want if p)


def test_empty(spark):
    assert X.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_layouts_of_one_host(spark):
    # four layouts; a notice in each, at the same place; a line on four pages of five is no template
    lay = ("<div class=l{k}><div class=box><p>Notice {k} for you.</p></div><div class=text><h1>Title {i}</h1>{body}</div></div>"
           "<div class=end{k}><p>Good bye.</p></div>")
    rows, want = [], {}
    for i in range(120):
        rng = random.Random(i)
        ps = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(rng.randint(1, 5))] + ["Shared line"] * (i % 5 > 0)
        rows.append((i, "http://one.example/x", "<html><body class='post-%d'>" % i + lay.format(k=i % 4, i=i, body="".join(f"<p>{p}</p>" for p in ps))))
        want[i] = "\n\n".join([f"Title {i}", *ps])
    got = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: t for i, t in got.items() if t != want[i]} == {}


@pytest.mark.parametrize("html,want", [
    ("<body class='has-sidebar'><p>One two</p></body>", "One two"),
    ("<html class=no-menu><body class='page no-menu' id=search><p>One</p><div class=sidebar>s</div></body>", "One"),
    ("<main class='content sidebar-right'><p>One</p><div class=sidebar>s</div></main>", "One"),
    ("<article class='post comments-open'><p>One</p><div id=comments><article class=comment><p>c</p></article></div></article>", "One"),
    ("<div class='with-sidebar'><div class=menu>Home</div><article><p>One</p></article></div>", "One"),
    ("<div id='content' class='with-header-ad'><p>One two three</p><div class=ad>Buy</div></div><p>End</p>", "One two three\n\nEnd"),
    ("<section class='search-results-article'><p>One two three</p></section><p>End</p>", "One two three\n\nEnd"),
])
def test_words_remove_no_main_text(html, want):
    assert text(html) == want


def slow_score(a, b):
    """Score by the plain recursion."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + slow_score(x, y))
    return 1 + best[-1][-1]


def wide(labels):
    n = X.Node("r")
    for x in labels:
        k = X.Node(x[0])
        k.kids = [X.Node(c) for c in x[1:]]
        n.kids.append(k)
    return n


@pytest.mark.parametrize("n", [5, 63, 64, 65, 199, 201, 230])
def test_wide_lists_align_at_any_size(n):
    rng = random.Random(n)
    a = [rng.choice(["a", "b", "cx", "cxy", "d", "dz"]) for _ in range(n)]
    x, y = wide(["q", *a]), wide([*a, "q"])
    assert X.match(x, y)[0] == len(X.match(x, y)[1]) == X._size(x) - 1      # a shift by one
    b = [s if rng.random() < .6 else rng.choice(["a", "b", "cx", "dzz"]) for s in a if rng.random() < .9]
    score, pairs = X.match(wide(a), wide(b))
    assert score == slow_score(wide(a), wide(b)) == len(pairs) == len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs})


def test_deep_pages(spark):
    deep = lambda i, n: "<html><body>" + "".join(f"<div class=c{k}>" for k in range(n)) + f"<p>Deep words {i}</p><p>Note</p>"
    pages = [deep(i, 1200) for i in range(6)] + [deep(9, 5000)]
    assert X.main_text(pages[0], X.induce(pages[:6])) == "Deep words 0"
    df = spark.createDataFrame([(i, "http://deep.example/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in X.extract(df).collect()}
    assert got[0] == "Deep words 0" and got[6].startswith("Deep words 9")


def test_trees_survive_being_flat():
    tree, _ = X.parse(page(3)[0])
    again = X._tree(X._flat(X._slim(tree)))
    assert X._flat(again) == X._flat(tree) and X.match(tree, again)[0] == X._size(tree)


STORY = "<p>" + "Some words of the story go here. " * 4 + "</p>"
SAID = "Some words of the story go here. " * 3 + "Some words of the story go here."


@pytest.mark.parametrize("html,want", [
    (f"<body><form id=main><div>{STORY}</div><input></form></body>", SAID),
    (f"<form action=/find><label>Find</label></form>{STORY}", SAID),
    (f"<div style='overflow: hidden'>{STORY}</div>", SAID),
    (f"<div title='a hidden gem' data-role=dialog data-id=ad data-hidden>{STORY}</div>", SAID),
    (f"<div hidden>gone</div><div aria-hidden = 'true'>gone</div><div role=dialog>gone</div>{STORY}", SAID),
    (f"<div>{STORY}</div><article><h3>Other story</h3></article>", SAID + "\n\nOther story"),
])
def test_ordinary_markup(html, want):
    assert text(html) == want
