from fixtures import prose

from prematch.llm import html_text as H

PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div class="main-menu"><a href=x>Home</a></div><p>One &lt;b&gt; two<br>three
  <b>bold</b> <span class="ad">buy</span> four</p><!-- c --><script>if(a<b){}</script><div id="cookie-notice">We use cookies</div><form><input value="a>b"><p>mail</p></form>
  <div>Text <i>it</i>al</div><section id="comments"><p>first!</p></section><footer>(c)</footer></body>"""


def test_blocks():
    assert [t for z, t in H.blocks(PAGE) if z == "O"] == ["One <b> two three bold", "four", "Text ital"]
    assert H.blocks("<form><div><article><p>a b</p></article></div></form><p>x") == [("M", "a b"), ("O", "x")]
    assert H.blocks('<div class="has-sidebar"><p>keep<div class=ad>no<p>no2</div>yes') == [("O", "keep"), ("J", "no"), ("J", "no2"), ("O", "yes")]
    assert [H.blocks(x) for x in (None, "", "<!-- open", "<script>zz", "  ")] == [[]] * 5
    assert H.blocks("a < b &amp; c <") == [("O", "a < b & c <")]
    assert H.blocks('<article><p>x</p><aside>y</aside><div class="comment">z</div><div>w</div></article>') == [("M", "x"), ("J", "y"), ("J", "z"), ("A", "w")]


def test_names():
    for name, zone in {"share-price": "S", "related-work": "S", "main-menu": "J", "ad-box": "J", "ad_slot_3": "J", "cookieBanner": "J", "nav-primary": "J", "no-sidebar": "O", "shadow": "O", "adapter": "O", "comments-area": "J", "menu-engineering": "S", "download": "O"}.items():
        assert H.blocks(f'<div class="x {name}">t</div>') == [(zone, "t")], name


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, chunk string").repartition(2)


def test_articles(spark):
    copied = "same text in both pages of this very host here"
    rows = [(1, "http://a.example/1", f"<nav>menu</nav><article><h1>T</h1><p>{copied}</p></article><p>outside"), (2, "http://a.example/2", f"<article><p>{copied}</p></article>"), (3, None, None), (4, "nohost", "")]
    got = {r.page_id: r for r in H.extract(frame(spark, rows)).collect()}
    assert got[1].text == f"T\n{copied}\noutside" and got[2].text == copied  # articles copy one another; nothing unique goes without a reason
    assert (got[3].text, got[3].n_chars, got[3].url, got[4].text) == ("", 0, None, "")
    assert got[1].n_chars == len(got[1].text)


def test_repeats_decide(spark):
    """With hints or without, what distinct pages of the host repeat goes and what is unique stays."""
    hint, plain, inside = ("subscribe to all of our letters and never miss one", "this site is run by friends of the old library", "join us on every channel there is and tell your friends")
    rows = []
    for i in range(5):
        price = f'<div class="share-price">the price of a share was {i} and {prose(("price", i), 8)}</div>'
        teaser = f'<div class="related-work">{hint}</div>'
        rows.append((i, f"http://d.example/{i}", f"<p>{plain}</p><article><h2>Head {i}</h2><p>{prose(i, 30)}</p>{price}{teaser}<div>{inside}</div><div>{prose(('own', i), 12)}</div></article><p>{prose(('after', i), 9)}</p>"))
    rows.append((9, "http://alone.example/", rows[0][2]))
    got = {r.page_id: r for r in H.extract(frame(spark, rows)).collect()}
    for i in range(5):
        own = [f"Head {i}", prose(i, 30), f"the price of a share was {i} and {prose(('price', i), 8)}", prose(("own", i), 12), prose(("after", i), 9)]
        assert got[i].text == "\n".join(own) and got[i].n_repeated == 3
    # alone on its host nothing repeats
    assert got[9].n_repeated == 0 and all(x in got[9].text for x in (hint, plain, inside))


def test_repeats_decide_alone_without_any_markup(spark):
    rows, want = [], {}
    for i in range(12):
        top, ad, foot = "Home News Sports Weather Contact Imprint", f"buy one of our fine things number {'ab'[i % 2]} today", "all of this site is under the laws of the land"
        want[i] = "\n".join(prose((k, i), 20 + i) for k in range(3))
        rows.append((i, f"http://e.example/{i}", "".join(f"<div>{x}</div>" for x in (top, ad, *want[i].split("\n"), foot))))
    assert {r.page_id: r.text for r in H.extract(frame(spark, rows)).collect()} == want


def test_boilerplate_without_articles(spark):
    notice = "please read our terms of use before you go on reading here"
    rows = [(i, f"http://b.example/{i}", f"<div>{notice}</div><div>{prose(i, 14)}</div>") for i in range(6)]
    rows += [(10, "http://c.example/1", f"<div>{notice}</div>"), (11, "http://b.example/0", rows[0][2])]
    got = {r.page_id: r.text for r in H.extract(frame(spark, rows)).collect()}
    assert all(got[i] == prose(i, 14) for i in range(6))
    assert got[10] == notice  # alone on its host
    assert got[11] == got[0]  # a copied page keeps its text


def brute(rows):
    """Main texts by comparing every run of DEPTH words with all other pages of the host."""
    found = {i: H.blocks(h) for i, _, h in rows}
    host = {i: u.split("/")[2] for i, u, _ in rows}
    words = {i: [(k, w) for k, (z, t) in enumerate(found[i]) if z != "M" for w in t.encode().split()] for i in found}
    runs = {i: {tuple(w for _, w in words[i][j : j + H.DEPTH]) for j in range(len(words[i]) - H.DEPTH + 1)} for i in found}
    out = {}
    for i in found:
        others = set().union(*[runs[j] for j in found if host[j] == host[i] and found[j] != found[i]])
        hit = [False] * len(words[i])
        for j in range(len(hit) - H.DEPTH + 1):
            if tuple(w for _, w in words[i][j : j + H.DEPTH]) in others:
                hit[j : j + H.DEPTH] = [True] * H.DEPTH
        covered = []
        for k, (z, t) in enumerate(found[i]):
            own = [h for (b, _), h in zip(words[i], hit) if b == k]
            covered.append(z != "M" and bool(own) and sum(own) >= 0.5 * len(own))
        out[i] = ("\n".join(t for (z, t), c in zip(found[i], covered) if z == "M" or z != "J" and not c), sum(covered))
    return out


def test_extract_against_brute_force(spark):
    import random

    rng = random.Random(4)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(30)]
    shapes = ["<p>{}</p>", "<div>{}</div>", "<nav>{}</nav>", '<div class="share-x">{}</div>', "<article><p>{}</p></article>", "<article><div>{}</div></article>", '<i class="ad">{}</i>']
    rows = [(i, f"http://h{i % 3}.example/{i}", "".join(rng.choice(shapes).format(rng.choice(pool)) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, u, h) for i, u, h in rows[:5]]
    want = brute(rows)
    assert any(n for _, n in want.values())
    for rows_broadcast in (H.BROADCAST_ROWS, 0):
        got = {r.page_id: (r.text, r.n_repeated) for r in H.extract(frame(spark, rows), rows_broadcast).collect()}
        assert got == want


def test_large_host_and_long_pages(spark):
    """A host's pages meet whatever their number and length."""
    rows = [(i, "http://big.example/x", f"<div>the one notice that all pages of the big host show</div><div>own words number {i} and {i * 7} make up what page {i} has</div>") for i in range(450)]
    pair = "a notice that only two pages out of all have in common"
    rows += [(1000, "http://big.example/y", f"<div>{pair}</div><div>{prose('long page', 60000)}</div>"), (1001, "http://big.example/z", f"<div>{prose('other', 50)}</div><div>{pair}</div>")]
    got = {r.page_id: r.text for r in H.extract(frame(spark, rows)).collect()}
    assert all(got[i] == f"own words number {i} and {i * 7} make up what page {i} has" for i in range(450))
    assert got[1000] == prose("long page", 60000) and got[1001] == prose("other", 50)


def test_empty(spark):
    assert H.extract(frame(spark, []).limit(0)).count() == 0


def test_runs_of_short_blocks_repeat(spark):
    menu = "".join(f"<div>{x}</div>" for x in ("Start page", "All news", "About us here", "Write to us"))
    rows = [(i, f"http://f.example/{i}", f"{menu}<div>{prose(('short', i), 20)}</div>") for i in range(3)]
    assert {r.page_id: r.text for r in H.extract(frame(spark, rows)).collect()} == {i: prose(("short", i), 20) for i in range(3)}
