import random
import re
from collections import defaultdict

from grovelake.llm import html_extract
from grovelake.llm.html_extract import extract, hashed, main_text, page_rows, parse


def text_of(page):
    root = parse(page)
    hashed(root)
    return main_text(root)


def test_blocks_references_and_white_space():
    assert text_of("<article><h1>A &amp; B</h1><p>x\n\t y&nbsp;z<p>q <b>r</b>s<br>t</article>") == "A & B\nx y z\nq rs t"
    assert text_of("<body><ul><li>1<li>2</ul>tail &lt;i&gt;") == "1\n2\ntail <i>"
    assert text_of("") == text_of("<") == text_of("<!--") == "" or text_of("<") == "<"


def test_chrome_goes():
    page = """<html><head><title>t</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body><header>no</header><nav>no</nav>
    <div class="cookie-notice">no</div><div id="siteAlert">no</div><ins class="adsbygoogle">no</ins><div class="ad">no</div><form><input value="no">no</form><aside>no</aside><main><article><p>yes <a href="x" title="a>b">link</a></p>
    <article class="comment">no</article></article></main><section id="comments">no</section><footer>no</footer></body></html>"""
    assert text_of(page) == "yes link"


def test_broken_markup():
    assert text_of('<article><p title="oops>a</p><p>b</article>') == "a\nb"
    assert text_of("<article><p>a</div></b><p>b") == "a\nb"
    assert len(text_of("<div>" * 5000 + "x" + "<a href='" * 200)) >= 1


def test_template_subtrees_of_a_host_go(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    rows, want = [], {}
    for i in range(40):
        body = [" ".join(word() for _ in range(12)) for _ in range(3)]
        frame = "<div><p>All rights of this site</p></div>" if i < 30 else "<div><p>All rights of this site</p></div>" * (i == 30)
        host = "a.example" if i < 30 else "b.example"
        rows.append((i, f"https://{host}/p{i}", f"<body>{frame}<div>{''.join(f'<p>{b}</p>' for b in body)}</div><div><p>Other line of all</p></div></body>", i))
        kept = (["All rights of this site"] if i == 30 else []) + body
        want[i] = "\n".join(kept)
    rows += [(100, None, None, 0), (101, "no url", "", 0), (None, "https://c.example/x", "<p>c</p>", 0), (None, "https://c.example/x", "<p>c</p>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract(df).collect()
    assert {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 100} == want
    assert sorted(r.text for r in got if r.page_id is None) == ["c", "c"] and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (100, 101)] == ["", ""]
    assert extract(df.limit(0)).count() == 0


def test_template_inside_an_article_goes(spark):
    notices = "<p>Line of the site</p><h2>Head of the site</h2><dl><dd>List of the site</dd></dl><blockquote>Quote of the site</blockquote>"
    rows = [(i, "https://a.example/x", f"<main><p>own {i}</p>{notices}<p>end {i}</p></main>") for i in range(20)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"own {i}\nend {i}" for i in range(20)}


def test_templates_at_every_host_size(spark):
    notice = lambda k: f"<p>Notice number {k} of this large site</p>"
    rows = [(i, "https://big.example/x", f"<main><p>own words {i}</p>{notice(i % 12)}<h2>Intro</h2></main>" if i % 7 == 0 else f"<main><p>own words {i}</p>{notice(i % 12)}</main>") for i in range(240)]
    rows += [(1000 + i, "https://small.example/x", f"<main><p>own words {i}</p>{notice(0)}</main>") for i in range(4)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"own words {i}\nIntro" if i % 7 == 0 else f"own words {i}") for i in range(240))
    assert all(got[1000 + i] == f"own words {i}" for i in range(4))


def test_article_text_is_not_told_by_names():
    page = """<article class="post"><header><h1>Title</h1></header><div class="article-header"><h2 id="related-work">Work</h2></div><h2 id="search-algorithms">Search</h2>
    <section id="social-policy"><p class="notice">Policy</p></section><div class="share">no</div><div id="comments">no</div></article>"""
    assert text_of(page) == "Title\nWork\nSearch\nPolicy"
    assert text_of('<div class="article-header">no</div><p>yes</p>') == "yes"


def site(rng, host, pages, frame):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    for i in range(pages):
        body = [line(rng.randint(5, 30)) for _ in range(rng.randint(1, 4))] + ["A phrase that every site repeats in its texts"] * (i % 5 == 0)
        text = "".join(f"<p>{b}</p>" for b in body)
        menu = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(2, 5)))
        if frame == "plain":
            page = f'<body><div class="a{i}"><ul>{menu}</ul></div><div class="b">{line(4)}</div><div class="c"><h1>{line(3)}</h1>{text}</div><div class="d">{line(5)} of {host}</div></body>'
        else:
            page = f"<body><table><tr><td>{menu}</td><td class='x'>{text}</td></tr></table><span>{host}</span></body>"
        yield f"http://{host}/{i}", page, "\n".join(re.findall("<h1>(.*?)</h1>", page) + body)


def test_frames_with_varying_text_go_by_slots_alone(spark):
    rng = random.Random(7)
    made = [*site(rng, "a.example", 40, "plain"), *site(rng, "b.example", 60, "plain"), *site(rng, "c.example", 30, "table")]
    df = spark.createDataFrame([(i, u, p, i, "z") for i, (u, p, _) in enumerate(made)], "page_id long, url string, html string, hash long, host string")
    got = {r.page_id: r.text for r in extract(df, names=False).collect()}
    assert got == {i: text for i, (_, _, text) in enumerate(made)}


def test_copies_of_a_page_are_no_frame(spark):
    rng = random.Random(8)
    made = [*site(rng, "a.example", 30, "plain")]
    made += [made[3]] * 50
    df = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert all(got[i] == made[3][2] for i in range(30, 80))


def plain_templates(pages, share=0.3, least=10):
    """The rules of templates() with dictionaries."""
    places, hosts = defaultdict(dict), defaultdict(set)
    for host, page in pages:
        for h, parent, slot, alone, chars, plain in page_rows(parse(page)):
            if h == 0:
                hosts[host].add(parent)
            else:
                now = places[host].setdefault(h, [set(), slot, alone, chars, plain])
                now[0].add(parent)
                now[1], now[2], now[3], now[4] = min(now[1], slot), min(now[2], alone), max(now[3], chars), max(now[4], plain)
    everyone = sum(map(len, hosts.values()))
    rare = lambda host, h: 0 if len(places[host][h][0]) >= max(3, share * len(hosts[host])) else len(places[host][h][0])
    out = {}
    for host, found in places.items():
        k = len(hosts[host])
        enough = min(least, max(3, k / 2))
        hashes = set()
        for h, (parents, _, _, chars, _) in found.items():
            n = len(parents)
            if chars and n >= 3 and (n >= least and n >= share * k or chars >= 20 and n >= enough):
                elsewhere = sum(rare(other, h) for other in places if other != host and h in places[other])
                if not rare(host, h) or rare(host, h) * (everyone - k) >= 4 * k * elsewhere:
                    hashes.add(h)
        slots = defaultdict(list)
        for parents, slot, alone, _, plain in found.values():
            slots[slot].append((len(parents), plain if alone and len(parents) < 3 else 0))
        out[host] = hashes, {s: sum(p for _, p in x) / len(x) for s, x in slots.items() if sum(n for n, _ in x) >= enough}
    return out


def test_same_as_plain_counting(spark):
    rng = random.Random(9)
    made = [*site(rng, "a.example", 25, "plain"), *site(rng, "b.example", 12, "table"), *site(rng, "c.example", 4, "plain"), *site(rng, "d.example", 2, "table")]
    made += [made[0]] * 12 + [("http://d.example/x", "<main>" + "<p>long text</p>" * 20_000 + "</main>", "")]
    rng.shuffle(made)
    df = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(made)], "page_id long, url string, html string")
    known = plain_templates([(u.split("/")[2], p) for u, p, _ in made])
    got = {r.page_id: (r.text, r.n_chars) for r in extract(df).collect()}
    for i, (u, p, _) in enumerate(made):
        root = parse(p)
        hashed(root)
        want = main_text(root, frozenset(known[u.split("/")[2]][0]), known[u.split("/")[2]][1])
        assert got[i] == (want, len(want))


def test_templates_too_large_to_broadcast(spark, monkeypatch):
    rng = random.Random(10)
    made = [*site(rng, "a.example", 40, "plain"), *site(rng, "b.example", 20, "table")]
    df = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(made)], "page_id long, url string, html string")
    want = sorted(map(tuple, extract(df).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html_extract, "PART_PAGES", 7)
    assert sorted(map(tuple, extract(df).collect())) == want
