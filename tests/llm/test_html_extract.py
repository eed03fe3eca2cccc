import time

import numpy as np
from tests_llm_corpus import prose

from gleanery.llm.html_extract import TOKENS, blocks, main_text, suffix_array


def texts(html):
    return [t for _, _, t in blocks(html)]


def test_structure():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><article>x";</script></head><body class="no-sidebar">
    <header><p>Site</p></header><nav><ul><li><a href="/a>b">Menu</a></ul></nav><!-- <p>gone</p> --><div class='ad'>Buy<div>more</div></div>
    <article><header><h1>A &amp; B&nbsp;C</h1></header><p>One  <i>two</i>\nthree<br>four<p><b>Five &lt;x&gt; &#233;
    <aside>side</aside><div class="comments"><p>Nice!</p></div><form><p>Name</form><script>x<y</script><p hidden>no</p><p style="display: none">no</p>
    <p>a < b and c > d</p><ul><li>i<li>j</ul><table><tr><td>k<td>l</table></article><div class="related-posts">r</div><footer>&copy; me</footer></body></html>"""
    assert texts(html) == ["A & B C", "One two three", "four", "Five <x> é", "a < b and c > d", "i", "j", "k", "l"]
    assert texts("<div class=ad>Buy<article><p>Text</p></article>") == ["Text"]
    assert texts("") == [] and texts("plain & text") == ["plain & text"] and texts("<p>x<!-- open") == ["x"]
    assert texts("<p>lead <a href='x'>link</a> tail</p>") == ["lead link tail"]
    assert texts('<main><article class="comment">c</article><p>m</p></main>') == ["m"]
    assert texts("<p>q <a title=\"broken>z</a> w") == ["q z w"]


def test_names_count_as_a_whole():
    long = prose(1, 60)
    for attrs in ('class="content-sidebar-wrap"', 'class="post has-comments"', 'id="related-work"', 'class="sidebar"'):  # the last one holds the whole page
        assert texts(f"<div {attrs}><p>{long}</p></div>") == [long], attrs
    for attrs in ('class="site-footer"', 'class="mainNav x"', 'id="cookie_banner"', "class=related-posts", 'role="navigation"', 'class="sidebar__item"', 'class="reader-comments"', "hidden", 'style="display:none"'):
        assert texts(f"<div><p>{long}</p></div><div {attrs}><p>no</p></div>") == [long], attrs
    assert texts(f'<div class="ad"><article><p>{long}</p></article></div>') == [long]
    assert texts(f'<article><p>{long}</p></article><section id="comments"><article><p>{prose(2, 90)}</p></article></section>') == [long]
    assert texts(f"<aside><article><p>card</p></article></aside><article><p>{long}</p></article>") == [long]
    assert texts(f"<nav><a>menu</a><article><p>{long}</p></article>") == [long]


def test_hostile_pages_take_linear_time():
    for html in ("<div>" * 200_000 + "</p>" * 200_000 + "<p>x</p>", "<a " * 800_000 + "x", '<a ">"' * 300_000 + "x", "<p class='" * 200_000, "<title>" * 300_000 + "x", "<!-" * 800_000, "&#" + "9" * 5_000_000 + ";", "<b class=ad>" * 150_000):
        began = time.process_time()
        blocks(html)
        assert time.process_time() - began < 5, html[:20]


def test_suffix_array():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 3, 300), rng.integers(0, 2, 50), np.zeros(40, np.int64), np.arange(9), np.zeros(0, np.int64), np.tile(rng.integers(0, 9, 70), 4)):
        order, common = suffix_array(x)
        all_ = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert order.tolist() == all_
        for k in range(1, len(x)):
            a, b = x[all_[k - 1] :], x[all_[k] :]
            n = min(len(a), len(b))
            assert common[k] == (n if (a[:n] == b[:n]).all() else int(np.argmin(a[:n] == b[:n])))


def brute(rows):
    """The texts of whole hosts: (host, html) to text, with every string of TOKENS tokens counted in a dictionary."""
    out = []
    for host in {h for h, _ in rows}:
        pages = [(k, blocks(html or "")) for k, (h, html) in enumerate(rows) if h == host]
        main = {k: max(p, key=lambda b: (2 * b[1] <= len(b[2]), len(b[2])))[2] for k, p in pages if p}
        where, total = {}, len(set(main.values()))
        for k, p in pages:
            s = [x for _, _, t in p for x in (None, *t.split(" "))]
            for i in range(len(s) - TOKENS + 1):
                where.setdefault(tuple(s[i : i + TOKENS]), set()).add(main[k])
        several, common = max(3, -(-total // 10)), max(10, -(-total // 2))
        for k, p in pages:
            s = [(x, b) for b, (_, _, t) in enumerate(p) for x in (None, *t.split(" "))]
            n = [len(where[tuple(x for x, _ in s[i : i + TOKENS])]) if i + TOKENS <= len(s) else 0 for i in range(len(s))]
            most = [max(n[max(0, i - TOKENS + 1) : i + 1]) for i in range(len(s))]
            share = lambda b, least: sum(m >= least for m, (x, c) in zip(most, s, strict=True) if c == b and x is not None)  # noqa: E731, B023
            size = [len(t.split(" ")) for _, _, t in p]
            plain = [b for b, (kind, linked, t) in enumerate(p) if kind or 2 * linked <= len(t)]
            all_ = sum(size[b] for b in plain)
            keep = []
            for b in plain:
                if p[b][0]:
                    gone = sum(share(c, common) for c in plain) <= 0.5 * all_ and share(b, common) >= 0.9 * size[b]
                elif sum(share(c, several) for c in plain) > 0.8 * all_:
                    gone = share(b, common) >= 0.5 * size[b]
                else:
                    gone = share(b, several) >= 0.5 * size[b]
                if not gone or p[b][2] == main[k]:
                    keep.append(p[b][2])
            out.append((k, "\n".join(keep)))
    return [t for _, t in sorted(out)]


def test_against_brute_force(spark):
    rng, rows = np.random.default_rng(5), []
    notice = "<p>" + prose(3, 15) + "</p>"
    for k in range(90):
        own = "".join(f"<p>{prose(int(rng.integers(40)) if rng.random() < 0.4 else 1000 + 10 * k + i, int(rng.integers(3, 40)))}</p>" for i in range(int(rng.integers(0, 5))))
        shell = f"<div>{prose(77, 14)}</div>{{}}<ul>" + "".join(f"<li><a>{w}</a></li>" for w in prose(8, 9).split()) + f"</ul><p>{prose(78 + k % 7, 9)}</p>"
        rows.append(("a", shell.format(f"<article>{own}{notice}</article>" if k % 3 == 0 else own)))
    rows += [("b", f"<article><p>{prose(5, 50)}</p><p>{prose(6, 20)}</p></article>")] * 12 + [("c", f"<p>{prose(5, 50)}</p>")] * 2 + [("c", None)]
    want = brute(rows)
    assert want[90:102] == [prose(5, 50) + "\n" + prose(6, 20)] * 12 and want[102:] == [prose(5, 50)] * 2 + [""]
    df = spark.createDataFrame([(k, f"http://{h}.example/{k}", html) for k, (h, html) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    for group in (1000, 40, 20):  # however a host is dealt into groups
        got = [r.text for r in main_text(df, group=group).orderBy("page_id").collect()]
        assert got == want, group
    assert sum(len(t) for t in want[:90]) < 0.8 * sum(len(" ".join(x for _, _, x in blocks(h or ""))) for _, h in rows[:90])


def test_pages(spark):
    menu = "<div><p>" + prose(1, 12) + "</p></div>"
    rows = [(k, f"https://h.example/{k}", f"<body>{menu}<div><p>{prose(100 + k, 30)}</p></div><div><a>{prose(9, 3)}</a></div></body>") for k in range(30)]
    rows += [(100 + k, "https://a.example/x", f"<article><p>{prose(7, 20)}</p></article><div>other</div>") for k in range(4)]
    rows += [(200, "https://a.example/y", None), (201, None, "<p>only &eacute;</p>"), (None, "https://h.example/1", ""), (100, "https://a.example/x", f"<article><p>{prose(7, 20)}</p></article>")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    out = {r.page_id: r for r in main_text(df).collect()}
    assert main_text(df).count() == len(rows)
    assert all(out[k].text == prose(100 + k, 30) for k in range(30))
    assert all(out[100 + k].text == prose(7, 20) for k in range(4))
    assert (out[200].text, out[200].n_chars, out[201].text, out[201].n_chars, out[None].text) == ("", 0, "only é", 6, "")
    assert main_text(df.limit(0)).count() == 0
