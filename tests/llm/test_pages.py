import random

from jobscope.llm.site_style_tree import extract

SCHEMA = "page_id long, url string, html string"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


CASES = [
    ("<nav><ul><li><a href='/a'>menu</a></li></ul></nav><article><h1>Head</h1><p>One  two\n three</p></article><footer>foot</footer>", "Head One two three"),
    ("<article><p><b>Bold start.<br><p>next &amp; last&nbsp;x</p></article>", "Bold start. next & last x"),
    ("<script>var t='</p>';x<y</script><article><p>a<b>b</b>c</p><style>p{}</style></article>", "abc"),
    ("<div class='ad'>buy</div><article>text <div class='sidebar'>side</div> more</article>", "text more"),
    ("<article><p>body</p><section id='comments'><p>first!</p></section></article>", "body"),
    ("<article><p>body</p><form>mail <input name=x><button>go</button></form></article><div class=cookie-notice>ok?</div>", "body"),
    ("<p>no article here</p><aside>aside</aside><p>second</p>", "no article here second"),
    ("<main><p>a &lt;b&gt; &#233; &eacute;</p><!-- hidden <p>x</p> --><p>c</p></main>", "a <b> é é c"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one two x y"),
    ("", ""),
    ("<div class='wrap no-sidebar'><main><p>kept</p></main></div>", "kept"),
    ("<div class='sidebar-layout menu'><nav>n</nav><article><p>inside a named wrapper</p></article><p>beside</p></div>", "inside a named wrapper"),
    ("<article><p class='notice'>a paragraph's class is no proof</p><div class='ad'>ad</div><h2 class='banner'>head</h2></article>", "a paragraph's class is no proof head"),
    ("<article><p>seen</p><div hidden><p>unseen</p></div><div hidden=''>unseen</div><div data-hidden='x'>seen too</div></article>", "seen seen too"),
    ("<aside><article><p>teaser</p></article></aside><article><p>story</p></article>", "story"),
    ("<div id='comments'><article class='comment'><p>reply</p></article></div><p>no main article</p>", "no main article"),
    ("<p>free</p><div class='has-menu'>text</div><div class='cookie-notice'>ok?</div>", "free text"),
]


def test_cases(spark):
    rows = [(i, f"http://h{i}.example/x", page(b)) for i, (b, _) in enumerate(CASES)]
    rows += [(100, None, None), (101, "not a url", ""), (None, None, page("<p>free</p>")), (102, "//h/x", "<p>unclosed <b>and & so <"), (0, "http://h0.example/x", page(CASES[0][0]))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA + ", text string, n_chars int")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, CASES[i]
    assert got[100] == "" and got[101] == "" and got[None] == "free" and got[102] == "unclosed and & so <"


def test_classes_of_the_whole_page_say_nothing(spark):
    rows = [(1, "http://a.example/", "<body class='single-post has-sidebar menu'><article><p>one</p></article></body>"), (2, "http://a.example/", "<html class='nav'><body id='login'><p>two</p></body></html>")]
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: "one", 2: "two"}


def test_the_trees_importance_against_brute_force(spark):
    """Content 1 - log_m(c) and the entropy of the parent's styles, by host, computed from the pages' blocks."""
    import math
    from collections import Counter, defaultdict

    from jobscope.llm import site_style_tree as T

    rng = random.Random(4)
    pages = []
    for host in ("a.example", "b.example", "c.example"):
        for i in range({"a.example": 14, "b.example": 7, "c.example": 4}[host]):
            parts = [f"<div class='x{k}'>{rng.choice(['same', 'same', 'other', f'own {i} {k}'])}</div>" for k in range(5) if rng.random() < 0.8]
            pages.append((len(pages), f"http://{host}/{i}", page("".join(parts) + f"<div class='body'>page {host} {i}</div>")))
    df = spark.createDataFrame([(i, hash(u.split("/")[2]) % 1000, h) for i, u, h in pages], "page long, host long, html string").select("host", "page", "html")
    features = df.mapInArrow(T._features, "host long, page long, node long, feature long, block long").distinct()
    got = {(r.page, b) for r in T.low_branches(features).collect() for b in r.without}
    of, styles, blocks = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(Counter)), []
    for i, u, h in pages:
        host, p = u.split("/")[2], T.Page(h)
        parents = set()
        for b in p.judged():
            if t := p.text(b):
                node = p.blocks[b].node
                of[host][node].add((i, t))
                blocks.append((host, i, b, node, t))
                parents.add(node.rpartition("/")[0])
        for node in parents:
            styles[host][node][tuple(p.styles[node])] += 1
    want = set()
    for host, i, b, node, t in blocks:
        m = len({x for x, _ in of[host][node]})
        if m < T.LEAST_PAGES:
            continue
        c = len({x for x, s in of[host][node] if s == t})
        n = styles[host][node.rpartition("/")[0]]
        total = sum(n.values())
        look = -sum(v / total * math.log(v / total) for v in n.values()) / math.log(total) if total > 1 else 1.0
        if (1 - T.GAMMA) * look + T.GAMMA * (1 - math.log(c) / math.log(m)) < T.LEAST_IMPORTANCE:
            want.add((i, b))
    assert got == want and 10 < len(want) < len(blocks)


def test_the_sites_tree_finds_unmarked_boilerplate(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    bodies = [words(30) for _ in range(12)]
    site = [(i, "http://site.example/%d" % i, page(f"<div class='x1'>Home Products About</div><div class='x2'>{b}</div><div class='x3'>All prices in pounds</div>")) for i, b in enumerate(bodies)]
    few = [(100 + i, "http://few.example/%d" % i, page("<div class='x1'>Home Products About</div><div>same</div>")) for i in range(3)]
    copies = [(200 + i, "http://copies.example/%d" % i, page(f"<article><p>{bodies[0]}</p></article>")) for i in range(12)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(site + few + copies, SCHEMA).repartition(4)).collect()}
    assert [got[i] for i in range(12)] == bodies
    assert got[100] == "Home Products About same"
    assert all(got[200 + i] == bodies[0] for i in range(12))


def test_an_empty_table(spark):
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0
