"""WARC archives, HTML extraction and URL filters."""

import base64
import hashlib
import heapq
import random

import pytest
from hypothesis import given, settings, strategies as st

from quernel.llm import htmltext, urlfilter, warc
from quernel.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, refers string, sha string, text long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 5) for i, u, h in rows], PAGES)


# WARC


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


@pytest.mark.parametrize(("rows_per_range", "fan_in"), [(500_000, 256), (4, 256), (7, 2), (500_000, 3)])
def test_archives(spark, monkeypatch, rows_per_range, fan_in):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    monkeypatch.setattr(warc, "RANGE_ROWS", rows_per_range)
    monkeypatch.setattr(warc, "STRIDE", 2)
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randint(0, 3)}.com/p{rng.randint(0, 5)}?q=\n", rng.choice(["<p>same</p>", "", None, f"<p>é {i}</p>", "x\r\n\r\ny" * 50])) for i in range(60)]
    rows += [(59, "http://again", rows[59][2]), (None, None, "<p>lost</p>"), (None, "u", "<p>lost</p>"), (7, "no scheme", "long " * 50_000)]
    rows += [(-1, "http://h1.com/\x01", "c"), (-5, "http://h1.com/", "c" * 3), *[(70 + i % 9, "http://hot.com/", f"{i}") for i in range(40)]]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        manifest = warc.write_archives(pages(spark, rows)).cache()
        assert manifest.count() == 9
    finally:
        for name, value in (("adaptive.enabled", "true"), ("autoBroadcastJoinThreshold", "10485760"), ("shuffle.partitions", "4")):
            spark.conf.set(f"spark.sql.{name}", value)
    index = warc.merge_index(spark, manifest).orderBy("part", "seq").cache()
    got = warc.read_captures(index, warc.folder_of(manifest)).collect()
    assert sorted(map(str, got)) == sorted(map(str, warc.read_archives(manifest).collect()))
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = top.get(h or "")
        revisit = first is not None and i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    listed = index.collect()
    order = [(r.url_key, r.stamp, -(1 << 64) if r.page_id is None else r.page_id) for r in listed]
    assert order == sorted(order) and len(order) == len(rows) and sum(r.length for r in listed) == manifest.groupBy().sum("bytes").first()[0]
    assert {r.page_id for r in listed} == {i for i, _, _ in rows}
    # what the index doesn't list isn't read
    some = warc.read_captures(index.where("page_id % 3 = 1"), warc.folder_of(manifest)).collect()
    assert sorted(r.page_id for r in some) == sorted(r.page_id for r in listed if r.page_id is not None and r.page_id % 3 == 1 and r.page_id > 0)


def test_no_pages(spark):
    manifest = warc.write_archives(pages(spark, []))
    index = warc.merge_index(spark, manifest)
    assert warc.read_archives(manifest).count() == 0 and index.count() == 0 and warc.read_captures(index, warc.folder_of(manifest)).count() == 0


def test_small_payloads_are_responses(spark):
    got = warc.read_archives(warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least_bytes=3)).collect()
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<body><header><h1>Site</h1></header><nav>a</nav><article><h1>T &amp; x</h1><p>a <b>b<br>c<p>d&nbsp;e<div class='cookie-notice'>we use</div><ul><li>one<li>two</ul></article><footer>f", "T & x\na b c\nd e\none\ntwo"),
        ('<article><p>x &lt; y<script>var a="</p><p>no";</script></p><!-- <p>no</p> --><style>p{}</style><p>z</p></article>', "x < y\nz"),
        ("<main><p>kept</p><section id='comments'><p>hi</p></section><form><p>name</p><input></form><aside>side</aside><div class='advert'>buy</div></main><p>after</p>", "kept"),
        ("<article><p>main</p></article><article class='comment'><p>first!</p></article>", "main"),
        ("<div><h1>T</h1><p>para one</p><p><a href=x>only link</a></p></div><p>x < y and a<3</p>", "T\npara one\nx < y and a<3"),
        ("<article><p>open", "open"),
        ("<ARTICLE><P CLASS=\"a'b\">q &copy; &#x41; &bogus;</P><p hidden>h</p></ARTICLE>", "q © A &bogus;"),
        ("plain text\n  only", "plain text only"),
        ("<article><p>a <span class=ad>buy</span> b</p><p class='noticebox'>n</p><ad-slot>x</ad-slot><div id=readerComments><p>c</p></div><button>go</button></article>", "a b"),
        ("<article><header><h1>Head</h1><p>by line</p></header><p>one</p><nav>n</nav><p>one</p></article>", "Head\none\none"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_template_of_a_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(htmltext, "BROADCAST_TOKENS", broadcast)
    rows = []
    for i in range(30):
        rows.append((i, f"http://www.site.com/{i}", f"<html><body><div class='w'><p>Welcome to our portal</p><p>All rights reserved</p></div><div class='c'><p>Story {i} begins here with words.</p><p>More of {i}.</p></div></body></html>"))
    for i in range(30, 33):  # too few pages for a template
        rows.append((i, f"http://small.com/{i}", "<div><p>Shared line</p></div>"))
    rows += [(40, None, None), (41, "x", ""), (42, "http://www.site.com/a", "<article>" + "<p>long text</p>" * 3000 + "</article>")]
    got = {r.page_id: r for r in htmltext.extract(pages(spark, rows)).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[3].text == "Story 3 begins here with words.\nMore of 3." and got[31].text == "Shared line"
    assert got[40].text == "" and got[40].url is None and got[42].text.count("\n") == 2999
    assert htmltext.extract(pages(spark, [])).count() == 0


def test_shared_passages_stay(spark):
    line = "A passage that many articles of the host quote in full."
    rows = [(i, "http://a.com/x", f"<body><nav>m</nav><article><p>Own {i}.</p>" + (f"<p>{line}</p>" if i % 3 else "") + "</article></body>") for i in range(60)]
    got = htmltext.extract(pages(spark, rows)).collect()
    assert all(r.text == f"Own {r.page_id}." + (f"\n{line}" if r.page_id % 3 else "") for r in got)


@pytest.mark.parametrize("names", ["layout has-sidebar", "content no-sidebar", "main with-comments", "single-widget-area", "post comments-open", "site-header-layout", "paywall", "sidebar", "layoutNoSidebar"])
@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_wrappers_with_boilerplate_words(names, tag, attribute):
    page = f"<body><div class=menu>m</div><div {attribute}='{names}'><{tag}><p>kept</p><div class='sidebar'>side</div></{tag}></div><div class='site-footer'>f</div></body>"
    assert htmltext.main_text(page) == "kept"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<form id=aspnetForm><div class='layout has-sidebar'><main><p>kept</p><form>f</form></main></div></form>", "kept"),
        ("<article class='post with-comments'><p>kept</p></article>", "kept"),
        ("<div class='layout has-sidebar'><p>no article</p></div>", "no article"),
        ("<article><p>kept</p></article><div class='related'><article>card</article></div><aside><article>a</article></aside><div class=comments><article>c</article></div>", "kept"),
        ("<article><p>kept</p><div class='related-posts'><article>card</article></div><div class=comments><article>c</article></div></article>", "kept"),
        ("<div class='related'><article>card</article></div><div><p>text of a page without article</p></div>", "card\ntext of a page without article"),
        ("<div hidden><article>h</article></div><nav><article>n</article></nav>", ""),
    ],
)
def test_articles_in_wrappers(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_repeated_pages_keep_their_text(spark, monkeypatch, broadcast):
    monkeypatch.setattr(htmltext, "BROADCAST_TOKENS", broadcast)
    article = "<body><nav><p>a menu</p></nav><article><h1>Head line</h1><p>The one article of its host.</p></article></body>"
    plain = "<body><div><p>First words of the text.</p><p>Second words of it.</p></div></body>"
    rows = [(i, f"http://copies.com/{i}", article) for i in range(20)] + [(20, "http://copies.com/other", article.replace("one", "other"))]
    # captures of one article at different times are different contents
    rows += [(30 + i, "http://captured.com/x", article.replace("a menu", f"at {i}")) for i in range(20)]
    rows += [(60 + i, f"http://plain.com/{i}", plain) for i in range(20)] + [(80, "http://plain.com/x", "<p>Else</p>"), (81, "http://plain.com/y", None), (82, "http://plain.com/z", "")]
    # ten pages, each of them twice and one of them ten times, have a template as they have once
    body = "<div class='w'><p>Welcome to our portal</p><p>All rights reserved</p></div><p>Story {} begins here.</p>"
    rows += [(100 + i, f"http://twice.com/{i}", body.format(i % 10)) for i in range(20)] + [(120 + i, "http://twice.com/0", body.format(0)) for i in range(8)]
    got = {r.page_id: r for r in htmltext.extract(pages(spark, rows)).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert all(got[i].text == "Head line\nThe one article of its host." for i in [*range(20), *range(30, 50)])
    assert all(got[i].text == "First words of the text.\nSecond words of it." for i in range(60, 80))
    assert all(got[100 + i].text == f"Story {i % 10 if i < 20 else 0} begins here." for i in range(28))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><section id='discussion'><p>The discussion of our results.</p></section><p class='legal'>The court held.</p><p>x</p></article>", "T\nThe discussion of our results.\nThe court held.\nx"),
        ("<div><h1>Title</h1><p>Lead</p></div><article><p>body</p></article><div><h2>More</h2><p>of us</p></div>", "Title\nLead\nbody"),
        ("<div class='ad'><p>buy</p></div><p>Lead</p><article><p>body</p></article>", "Lead\nbody"),
        ("<article>" + "".join(f"<div class='{w}'>{w}</div>" for w in "feedback related popular share search rail widget alert commentary cookies-recipe advertising-history subscription".split()) + "</article>", "\n".join("feedback related popular share search rail widget alert commentary cookies-recipe advertising-history subscription".split())),
    ],
)
def test_nothing_of_an_article_is_lost(page, text):
    assert htmltext.main_text(page) == text


def shuffled_site(rng, n, semantic):
    """Pages of one host with known article text; where tags and classes say nothing, all is div with random class names or none."""
    name = lambda: "" if rng.random() < 0.3 else f" class='{''.join(rng.choice('bcdfghjkz') for _ in range(4))}'"
    shell = {k: name() for k in ("menu", "lead", "story", "foot", "promo", "wrap")}
    words = lambda n: " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 9))) for _ in range(n))
    menu = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(5))
    notice, promo = words(12), rng.random() < 0.5
    for i in range(n):
        title, body = words(5), [words(rng.randint(8, 60)) for _ in range(rng.randint(2, 9))]
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body)
        parts = [f"<div{shell['menu']}><ul>{menu}</ul></div>", f"<div{shell['promo']}>{words(6)}</div>" if promo else f"<div{shell['promo']}>{notice}</div>", f"<article>{inner}</article>" if semantic else f"<div{shell['story']}>{inner}</div>", f"<div{shell['foot']}>{notice} <b>{words(2)}</b></div>"]
        yield f"<html><body><div{shell['wrap']}>{''.join(parts)}</div></body></html>", "\n".join([title, *body])


@pytest.mark.parametrize("semantic", [True, False])
def test_sites_with_random_names(spark, semantic):
    rng, rows, want = random.Random(11), [], {}
    for host in range(12):
        for page, text in shuffled_site(rng, 9, semantic):
            want[len(rows)] = text
            rows.append((len(rows), f"http://h{host}.com/{len(rows)}", page))
    got = {r.page_id: r.text for r in htmltext.extract(pages(spark, rows)).collect()}
    assert got == want
    if not semantic:  # the template decides: a page by itself doesn't tell its article
        assert not any(htmltext.main_text(h) == want[i] for i, _, h in rows)


def brute_template(rows, support=htmltext.SUPPORT):
    """Token vectors over distinct pages, classes of equal vectors, nesting: without fingerprints or partial sums."""
    distinct = list(dict.fromkeys(rows))
    vectors, parent = {}, {}
    for i, page in enumerate(distinct):
        p = htmltext.parse(page)
        for k, path in enumerate(p.paths):
            vectors.setdefault(("path", path), {})[i] = p.count[k]
            parent["path", path] = ("path", p.paths[max(p.parents[k], 0)])
        for text, k in zip(p.texts, p.at):
            own = vectors.setdefault(("text", p.paths[k], text), {})
            own[i] = own.get(i, 0) + 1
    vectors = {t: v for t, v in vectors.items() if len(v) >= support * len(distinct)}
    alive = set(vectors)
    while True:
        classes = {}
        for t in alive:
            classes.setdefault(tuple(sorted(vectors[t].items())), []).append(t)
        ok = {t for own in classes.values() for t in own if t == ("path", htmltext._ROOT) or len(own) > 1 and (t[0] == "text" or parent[t] in alive)}
        if ok == alive:
            return alive
        alive = ok


def test_classes_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for host in range(6):
        own = [page for page, _ in shuffled_site(rng, 10, False)]
        rows += [(len(rows) + k, f"http://h{host}.com/", page) for k, page in enumerate(own + own[:3])]
    df = pages(spark, rows)
    host = htmltext.F.xxhash64(htmltext.host_of(htmltext.F.col("url")))
    df = df.select(htmltext.F.col("page_id").alias("id"), "url", host.alias("host"), "html", htmltext.F.xxhash64("url", "html").alias("seed"))
    parsed = df.mapInArrow(htmltext._parsed, f"id long, url string, host long, seed long, {htmltext._BLOCKS}")
    got = {r.host: set(r.often) for r in htmltext.templates(htmltext._shared(parsed)).collect()}
    hosts = {r.url: r.host for r in df.select("url", "host").distinct().collect()}
    for url, key in hosts.items():
        want = brute_template([h for _, u, h in rows if u == url])
        texts = [t for t in want if t[0] == "text"]
        assert got[key] == set(htmltext._text_tokens([t[2] for t in texts], htmltext.np.array([t[1] for t in texts], "i8")).tolist()) and texts


@pytest.mark.parametrize("page", ["<div>" * 64_000, "<div>" * 32_000 + "<li></li>x" * 32_000, "<ul>" + "<li><div>" * 20_000 + "<li>" * 20_000, "<b>" * 64_000 + "</i>" * 64_000, "<div class=a>x" * 30_000 + "</section>" * 30_000, "<p><i>" * 40_000, "<a '\"> " * 20_000])
def test_deep_pages_take_little(page):
    import time
    import tracemalloc

    began = time.perf_counter()
    htmltext.main_text(page + "<article>kept</article>")
    assert time.perf_counter() - began < 10
    tracemalloc.start()
    htmltext.parse(page)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


# URLs


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls(spark):
    rng = random.Random(3)
    parts = [["http://", "https://", "", "x://"], ["example.com", "www.Example.COM", "a.www.example.com", "example.net", "net", "xnet", "com", "", "b.net:80", "u@example.com"], ["", "/", "/en/", "/en", "/es/x", "/fr/?a", "/en/é", "//en/"], ["", "?q=/en/", "#/es/", "\n"]]
    rows = [(i, "".join(rng.choice(p) for p in parts), None) for i in range(300)] + [(300, None, None), (301, "", None), (301, "http://" + "a." * 500 + "net/es/", None)]
    got = [tuple(r) for r in urlfilter.judge_urls(pages(spark, rows), URL_RULES).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute_verdict(u, URL_RULES)) for i, u, _ in rows], key=str)
    assert urlfilter.judge_urls(pages(spark, []), URL_RULES).count() == 0


def test_rules_of_many_lengths(spark):
    rng = random.Random(8)
    rules = [(rng.choice(["allow", "block"]), f"h{i % 40}.com", "/" + "ab" * rng.randint(0, 3)) for i in range(300)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    rows = [(i, f"http://s.h{rng.randint(0, 45)}.com/" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 8))), None) for i in range(200)]
    got = sorted(tuple(r) for r in urlfilter.judge_urls(pages(spark, rows), rules).select("page_id", "rule", "verdict").collect())
    assert [g[1:] for g in got] == [brute_verdict(u, rules)[2:] for _, u, _ in sorted(rows)]


def test_collisions_are_confirmed(spark, monkeypatch):
    rules = urlfilter.Rules(urlfilter.write_rules(spark, [("block", "a.com", "/"), ("block", "b.com", "/")]))
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda _: int(rules.digests[0]))
    assert rules.find([b"other.com/"]).tolist() == [-1]
