"""HTML extraction (1) and WARC audit (4)."""

import html
import re

import pytest

from gradelens.llm import html_wrapper, queries, warc_merkle

SF = "/root/testdata/sf0.01"


def squeeze(t):
    return " ".join(t.split())


def brute_text(page):
    """The article's blocks of the test pages: a heading and paragraphs, no nested blocks."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", body)
    return "\n".join(x for x in (squeeze(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)))) for p in parts) if x)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_pages_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op1_html_wrapper(spark, f"/root/testdata/{sf}").collect()}
    assert set(got) == set(pages)
    for i, p in pages.items():
        assert got[i].text == brute_text(p.html) and got[i].n_chars == len(got[i].text) and got[i].url == p.url


def site(i, extra=""):
    return (f"<html><head><title>T{i}</title><script>var a='<p>no</p>';</script></head><body><header><a href=/>Home</a></header>"
            f"<div class='top-menu'><a href=/x>Menu</a></div><div id=cookie-notice>We use cookies</div><main><h1>Head {i}</h1>"
            f"<div class=post-body><p>First &amp; best {i}.<p>Second   <b>bold</b>\n<i>text</i> {i}<br>after</p>"
            f"<div>Read more on our site</div><form><input value=x>Sign up</form><aside>Side {i}</aside>"
            f"<ul><li>one {i}<li>two &lt;{i}&gt;</ul>{extra}</div></main><section class='comments'><article><p>I agree {i}</p></article></section>"
            f"<div class=sidebar><p>Other {i}</p></div><footer>&copy; {i}</footer></body></html>")


def expected(i):
    return f"Head {i}\nFirst & best {i}.\nSecond bold text {i} after\none {i}\ntwo <{i}>"


def test_template_nodes_go_and_slots_stay(spark):
    rows = [(i, f"https://a.example/{i}", site(i, "<p>Tail</p>" if i % 3 == 0 else "")) for i in range(24)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # the constant <div> inside the article is template; the tail, on a third of the pages, is its own node of some pages
    for i in range(24):
        assert got[i].split("\nTail")[0] == expected(i), i


def test_few_pages_keep_constant_blocks(spark):
    rows = [(1, "https://b.example/1", site(1)), (2, "https://c.example/1", site(2))]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == expected(1).replace("\none", "\nRead more on our site\none")


def test_equal_pages_are_not_template(spark):
    rows = [(i, "https://d.example/x", site(5)) for i in range(30)]
    got = {r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {expected(5).replace("\none", "\nRead more on our site\none")}


def texts(spark, pages, host="h.example"):
    rows = [(i, f"https://{host}/{i}", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(pages))]


def test_copies_among_other_pages_keep_their_text(spark):
    copy = "<article><h1>Title A</h1><p>First of A.</p><p>Second of A.</p><ul><li>Point of A</li></ul><p>Last of A.</p></article>"
    other = [f"<article><h1>Title {i}</h1><p>Text {i} of this page.</p></article>" for i in range(8)]
    whole = "Title A\nFirst of A.\nSecond of A.\nPoint of A\nLast of A."
    want = [f"Title {i}\nText {i} of this page." for i in range(8)]
    assert texts(spark, [copy] * 12 + other) == [whole] * 12 + want
    # copies with another counter are one page too
    long = [copy.replace("of A", "of A, with many more words than a counter has").replace("</article>", f"<div>{i}</div></article>") for i in range(12)]
    assert texts(spark, long + other) == [whole.replace("of A", "of A, with many more words than a counter has") + f"\n{i}" for i in range(12)] + want


def test_template_of_whole_texts_on_any_layout(spark):
    got = texts(spark, [site(i, "<p>Tail</p>" if i % 3 == 0 else "") for i in range(24)])
    assert got == [expected(i) for i in range(24)]


def test_notice_on_the_rarer_layout_and_odd_page(spark):
    def page(i):
        notice = "" if i % 5 < 3 else "<section class=box><p>Our shop is closed in May.</p></section>"
        return f"<article><h1>Title {i}</h1><p>Story {i} of this page.</p>{notice}<div>{'Odd' if i == 7 else 'Terms apply'}</div></article>"
    assert texts(spark, [page(i) for i in range(40)]) == [f"Title {i}\nStory {i} of this page." + ("\nOdd" if i == 7 else "") for i in range(40)]


def test_template_beside_varying_siblings_of_its_shape(spark):
    def page(i):
        story = "".join(f"<p>Part {j} of {i}.</p>" for j in range(1 + i % 3))
        return f"<article><h1>Title {i}</h1>{story}<p>Write to our editors</p></article>"
    def plain(i):
        return f"<div>Read our terms first</div><div>Story {i} of this page</div>"
    want = [f"Title {i}\n" + "\n".join(f"Part {j} of {i}." for j in range(1 + i % 3)) for i in range(12)]
    assert texts(spark, [page(i) for i in range(12)]) == want
    assert texts(spark, [plain(i) for i in range(12)]) == [f"Story {i} of this page" for i in range(12)]


def test_names_do_not_outrank_the_article():
    def text(page):
        return "\n".join(c[-1] for c in html_wrapper.page_view("https://n.example/", page)[2])
    story = "<h1>Head</h1><p>A story of some length.</p>"
    want = "Head\nA story of some length."
    for page in (f'<main class="with-sidebar">{story}</main>', f'<div class="content no-comments">{story}</div>', f'<article class="post social">{story}</article>',
                 f'<article class="a hidden-xs social">{story}<div class=share>Share</div></article>', f'<div class="post social">{story}</div><div>Terms</div>',
                 f'<div class=widget><main>{story}</main></div><div>Terms</div>', f'<div class="main-menu">Menu</div><div class=main-content>{story}</div>'):
        assert text(page).removesuffix("\nTerms") == want, page
    comments = "<section class=comments-area><article><p>I agree with all of this, at much greater length than the story.</p></article></section>"
    for page in (f"<main>{story}{comments}</main>", f"<div>{story}</div>{comments}", f"<div class=cookie-notice>We use cookies</div><div>{story}</div>",
                 f"<div class=site-header>Site</div><div>{story}</div>", f'<div>{story}</div><div aria-hidden="true">Not shown</div><p style="display:none">Not shown</p>'):
        assert text(page) == want, page


def test_pages_without_an_article_element(spark):
    def page(i):
        return (f"<body><div class=nav><a href=/>Home {i}</a></div><table><tr><td><a href=/1>Link {i}</a><td><p>Story {i} has words.</p><p>More {i}.</p></table>"
                f"<div>All rights reserved</div></body>")
    rows = [(i, "https://e.example/x", page(i)) for i in range(12)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} has words.\nMore {i}." for i in range(12)}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "x", ""), (3, "https://f.example/", "plain &lt;text&gt; &amp and &nbsp; more"), (4, "https://f.example/", "<article><p>a<script>x"),
            (5, "https://f.example/", "<article><p>kept</p><p unfinished"), (6, "https://f.example/", "<article><!-- gone --><p>x &#233; &eacute; &am</article>"),
            (7, "https://g.example/", deep), (8, "https://g.example/", "<article>" + "<p>long words here</p>" * 20000 + "</article>"), (None, "https://f.example/", "<p>null id")]
    df = spark.createDataFrame([(*r, "old", "other") for r in rows], "page_id long, url string, html string, text string, __slots string")
    got = {r.page_id: r for r in html_wrapper.extract(df).collect()}
    want = {1: "", 2: "", 3: "plain <text> & and more", 4: "a", 5: "kept", 6: "x é é &am", 7: "deep", None: "null id"}
    assert {k: got[k].text for k in want} == want
    assert got[8].text == "\n".join(["long words here"] * 20000) and got[8].n_chars == len(got[8].text)
    assert html_wrapper.extract(df.limit(0)).count() == 0


def test_alignment():
    def folded(page):
        root, _ = html_wrapper.parse(page)
        html_wrapper.fold(root)
        return html_wrapper.outline(root)
    a = folded("<div class=x><p>a<p>b</div><ul><li>c</ul>")
    assert a == folded("<div class=x><p>a</div><ul><li>c<li>d</ul>")
    b = folded("<div class=new>n</div><div class=x><p>a</div><ul><li>c</ul>")
    labels, _ = html_wrapper.tree(b)
    assert [html_wrapper.tree(a)[0][j] if j >= 0 else None for j in html_wrapper.align(a, b)] == [x if "new" not in x else None for x in labels]


def letters(i):
    return "".join(chr(97 + i // 26 ** k % 26) for k in range(4))


@pytest.mark.parametrize("page, blocks", [
    ("<div>" * 200_000 + "text", ["text"]), ("<p>a<div>" + "<blockquote>" * 100_000 + "b</x></p>c", ["a", "b", "c"]), ("<ul>" + "<li>x" * 100_000, ["x"] * 100_000),
    ("".join(f"<div class={letters(i)}>t{i}</div>" for i in range(20_000)), [f"t{i}" for i in range(20_000)]), ("</div>" * 100_000 + "<h1>t</h1>", ["t"])])
def test_pages_of_any_depth_and_width(page, blocks):
    import tracemalloc
    tracemalloc.start()
    host, root, content = html_wrapper.page_view("https://a.example/x", page)
    lines = html_wrapper.outline(root)
    labels, children = html_wrapper.tree(lines)
    assert len(html_wrapper.node_paths(labels, children)) == len(labels) == len(html_wrapper.align("0 =\n1 div~", lines))
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [c[-1] for c in content] == blocks and used < 400 << 20


def test_outline_has_the_pages_slots_and_paths():
    import random
    rng = random.Random(2)
    parts = ["<div>", "</div>", "<p>t", "<h1>x</h1>", "<ul>", "<li>a", "</ul>", "<section class=a>", "</section>", "text ", "<table><tr><td>", "<td>", "</table>"]
    for _ in range(150):
        _, root, _ = html_wrapper.page_view("", "".join(rng.choice(parts) for _ in range(rng.randint(1, 60))))
        labels, children = html_wrapper.tree(html_wrapper.outline(root))
        paths, todo = html_wrapper.node_paths(labels, children), [root]
        for n in todo:
            todo.extend(n.children)
            assert labels[n.slot][:-1] == n.label and paths[n.slot] == n.path


def test_large_unlike_trees_match_in_order():
    one = [f"div.{letters(i)}~" for i in range(3000)]
    two = one[1:1000] + ["div.new~"] + one[1000:]
    a, b = ("\n".join(["0 ~", *(f"1 {x}" for x in own)]) for own in (one, two))
    got = html_wrapper.align(a, b)
    assert got == [0, *range(2, 1001), -1, *range(1001, 3001)]


def test_large_trees_are_matched_as_small_ones():
    for n in (3, 3000):      # the moved element was matched, and nothing behind it, from 257 siblings on
        one = [f"div.{letters(i)}~" for i in range(n)]
        a, b = ("\n".join(["0 ~", *(f"1 {x}" for x in own)]) for own in ([*one, "div.z~"], ["div.z~", *one]))
        assert html_wrapper.align(a, b) == [0, -1, *range(1, n + 1)]


def brute_match(reference, lines):
    """Simple tree matching, node by node."""
    (la, ca), (lb, cb) = html_wrapper.tree(reference), html_wrapper.tree(lines)
    memo = {}

    def table(x, y):
        m = [[0] * (len(cb[y]) + 1) for _ in range(len(ca[x]) + 1)]
        for i, p in enumerate(ca[x], 1):
            for j, q in enumerate(cb[y], 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + weight(p, q))
        return m

    def weight(p, q):
        if (p, q) not in memo:
            memo[p, q] = 1 + table(p, q)[-1][-1] if la[p] == lb[q] else 0
        return memo[p, q]

    out, todo = [-1] * len(lb), [(0, 0)] if la[0] == lb[0] else []
    while todo:
        x, y = todo.pop()
        out[y] = x
        m, i, j = table(x, y), len(ca[x]), len(cb[y])
        while i and j:
            w = weight(ca[x][i - 1], cb[y][j - 1])
            if w and m[i][j] == m[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                todo.append((ca[x][i], cb[y][j]))
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


@pytest.mark.parametrize("plain", [html_wrapper.PLAIN, 0])
def test_alignment_against_brute_force_on_trees(monkeypatch, plain):
    import random
    monkeypatch.setattr(html_wrapper, "PLAIN", plain)
    rng = random.Random(5)

    def outline(n, kinds, deep):
        lines, depth = ["0 ~"], 0
        for _ in range(n):
            depth = rng.randint(1, min(depth + 1, deep))
            lines.append(f"{depth} {rng.choice('abcdef'[:kinds])}{rng.choice('~=') if rng.random() < 0.1 else '~'}")
        return "\n".join(lines)
    for k in range(400):
        kinds, deep = rng.randint(1, 6), rng.choice((1, 2, 3, 9))
        a = outline(rng.randint(0, 40), kinds, deep)
        b, lines = outline(rng.randint(0, 40), kinds, deep), a.split("\n")
        if k % 2:       # a without some of its leaves
            leaf = [i > 0 and (i + 1 == len(lines) or lines[i + 1][0] <= x[0]) for i, x in enumerate(lines)]
            b = "\n".join(x for x, end in zip(lines, leaf) if not end or rng.random() > 0.2)
        assert html_wrapper.align(a, b) == brute_match(a, b)


def test_many_layouts_on_one_host_and_clashing_names(spark):
    def page(i):
        return f"<article><h1>Title {i}</h1><div class={letters(i)}><p>Story {i}.</p></div><div>Terms apply</div></article>"
    rows = [(i, f"https://l.example/{i}", page(i), "p", "t") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __places string, __template string")
    got = html_wrapper.extract(df)
    assert set(got.columns) == {"page_id", "url", "text", "n_chars", "__places", "__template"}
    assert all(r.text == f"Title {r.page_id}\nStory {r.page_id}." and r["__places"] == "p" for r in got.collect())


def replica(spark, rows):
    return spark.createDataFrame(rows, "file string, offset long, length long, digest string")


def brute_audit(mine, theirs):
    out = []
    a, b = ({r for r in rows if r[0] is not None and r[1] is not None} for rows in (mine, theirs))
    one, two = {}, {}
    for r in a - b:
        one.setdefault(r[:2], []).append(r[2:])
    for r in b - a:
        two.setdefault(r[:2], []).append(r[2:])
    for k in one.keys() | two.keys():
        for x in one.get(k, [(None, None)]):
            for y in two.get(k, [(None, None)]):
                out.append((*k, *x, *y, "missing" if k not in two else "extra" if k not in one else "changed"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [0, 1, 4])
def test_audit_brute_force(spark, levels):
    mine = [(f"f{f}", o * 7001, 7001, f"d{f}-{o}") for f in range(4) for o in range(300)]
    theirs = [r if (i % 97) else (*r[:3], "flipped") for i, r in enumerate(mine) if i % 211] + [("f9", 0, 5, "new"), ("f1", 3, 1, None)]
    theirs = [r for r in theirs if r[0] != "f3"]
    mine += [(None, 1, 1, "x"), ("f0", None, 1, "x"), ("f0", 0, 7001, "d0-0"), ("f2", 7, None, None)]
    got = warc_merkle.audit(replica(spark, mine), replica(spark, theirs), levels).collect()
    assert sorted(map(tuple, got), key=repr) == brute_audit(mine, theirs)


def test_audit_of_equal_and_empty_replicas(spark):
    rows = [("f", i * 100, 100, str(i)) for i in range(50)]
    same = replica(spark, rows)
    assert warc_merkle.audit(same, replica(spark, rows[::-1]).repartition(3)).count() == 0
    assert warc_merkle.audit(same.limit(0), same.limit(0)).count() == 0
    assert {r.status for r in warc_merkle.audit(same, same.limit(0)).collect()} == {"missing"}


def test_unequal_branches_alone_are_descended(spark):
    rows = [("f", i * (1 << 16), 1, str(i)) for i in range(4096)]
    a = warc_merkle.tree(replica(spark, rows), 2)
    b = warc_merkle.tree(replica(spark, [(*r[:3], "bad") if r[1] == 5 << 16 else r for r in rows]), 2)
    for x, y, n in zip(a, b, (4096, 256, 16, 1)):
        assert x.count() == n and x.exceptAll(y).count() == 1


def test_page_replicas_restore_records(spark):
    mine, _ = queries.replicas(spark, SF)
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    at = 0
    for r in sorted(mine.collect(), key=lambda r: r.page_id):
        body = pages[r.page_id].html.encode()
        assert r.offset == at and r.length > len(body)
        at += r.length
