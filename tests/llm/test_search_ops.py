"""Decontamination, SimHash, HTML text, URL filters and sharding against brute force and hand-made cases."""

import random

from corpusmill.llm import decontaminate, html_text, sharding, simhash, url_filter
from pyspark.sql import functions as F


def words(rng, n, vocab=30):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def test_decontaminate_matches_brute_force(spark):
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate([1, 2, 5, 13, 14, 40, 0])] + [(7, None), (None, "w1 w2"), (8, words(rng, 20))]
    docs = [(i, words(rng, rng.randrange(0, 60))) for i in range(40)] + [(50, None), (51, ""), (52, items[5][1].upper() + " tail"), (52, items[5][1])]
    docs += [(60, words(rng, 900) + " " + items[9][1] + " " + words(rng, 700)), (61, "É" + items[3][1] + "," + items[4][1].replace(" ", "; "))]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, found string")
    b = spark.createDataFrame([(x, y, 1) for x, y in items], "item_id long, text string, n_words int")
    for limit in (2_000_000, 20):
        got = decontaminate.judged(d, b, max_words=limit).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(tuple, got)) == sorted(decontaminate.brute_force(docs, items))
    assert decontaminate.judged(d.limit(0), b).count() == 0
    assert not decontaminate.judged(d, b.limit(0)).where("contaminated").count()
    assert decontaminate.decontaminated(d, b).columns == d.columns


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(0, 12), 4)) for i in range(60)] + [(100, None), (101, ""), (102, "  "), (7, "a b c d")]
    base = words(rng, 400, 1000).split()
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(400)] = "x"
        rows.append((200 + i, " ".join(copy)))
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    assert got == sorted(simhash.brute_force(rows))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in got}


def test_simhash_stars_equal_pairs(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(60)} | set(seeds)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from corpusmill.llm.components import components

    a = {tuple(r) for r in components(simhash.links(df, pair_limit=4)).collect()}
    b = {tuple(r) for r in components(simhash.links(df, pair_limit=1 << 30)).collect()}
    assert a == b and a


def test_simhash_fingerprint_uses_sparks_xxhash64(spark):
    one = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert simhash.fingerprint("A  b\tc") == one % (1 << 64)


def test_fingerprint_chunks(monkeypatch):
    text = words(random.Random(1), 500, 90)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole


def test_html_text():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav><!-- c -->"
        "<div class='ad'>Buy now, it is cheap.</div><div id=cookie-notice>We use cookies</div><article><header><h1>Head &amp; line</h1></header><p><b>One,  two\n three.<br><p>Four &eacute;&#8364; five</p>"
        "<ul><li>x<li>y</ul><aside>side</aside><form><p>Search</p></form><div class='comments'><p>A reader says, hello there my friend.</p></div></article><footer>&copy; me</footer></body></html>"
    )
    assert html_text.main_text(page) == "Head & line\nOne, two three.\nFour é€ five\nx\ny"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("plain text") == "plain text"
    assert html_text.main_text("<div><div class=content><p>" + "Long text, with commas. " * 9 + "</div><div class=sidebar><a href=x>l</a></div></div>").startswith("Long text")
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_html_text_beside_the_best_container():
    seven = "<p>" + "word, " * 3 + "x" * 290 + "</p>"
    items = "".join(f"<li>item {i}</li>" for i in range(5))
    links = "<ul>" + "".join(f"<li><a href=/{i}>Other page {i}</a></li>" for i in range(5)) + "</ul>"
    page = f"<body>{links}<article><h1>Head</h1><section>{seven * 5}</section><section><p>Short, one, two.</p></section><ul>{items}</ul></article></body>"
    got = html_text.main_text(page).split("\n")
    assert got[0] == "Head" and got[6:] == ["Short, one, two.", *(f"item {i}" for i in range(5))]
    parts = f"<body>{links}<div><div><div>{seven * 5}</div></div><div><div><p>Uncle</p></div></div>loose <a href=x>text</a> stays<dl><dt>term</dt></dl><pre>code</pre><table><tr><td>cell</td></tr></table><h3>Sub</h3><p>End</p>{links}</div></body>"
    assert html_text.main_text(parts).split("\n")[5:] == ["Uncle", "loose text stays", "term", "code", "cell", "Sub", "End"]


def test_html_columns(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "t"), (1, "<p>a</p>", "t"), (2, None, "u")], "page_id long, html string, text string")
    rows = df.select("page_id", html_text.extracted(F.col("html")).alias("m")).select("page_id", "m.*").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]


RULES = [url_filter.host_rule("com", "/en/", "block"), url_filter.host_rule("example.com", "/en/7", "allow"), url_filter.Rule("|*/x^"), url_filter.Rule("z")]


def test_url_filter(spark):
    cases = [
        ("http://a.Example.COM/en/75?q", "a.example.com", "/en/75", "example.com/en/7", "allow"),
        ("http://example.com/en/8#f", "example.com", "/en/8", "com/en/", "block"),
        ("http://notcom/en/8", "notcom", "/en/8", None, "allow"),
        ("x://com/en/", "com", "/en/", "com/en/", "block"),
        ("http://com/En/", "com", "/En/", None, "allow"),
        ("http://h.org/casino/adserver/1", "h.org", "/casino/adserver/1", None, "block"),
        ("http://casino-x.org", "casino-x.org", "", None, "block"),
        ("com/en/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("x://com/en/" + "y" * 100_000, "com", "/en/" + "y" * 100_000, "com/en/", "block"),
    ]
    df = spark.createDataFrame([(i, c[0], "old") for i, c in enumerate(cases)], "page_id long, url string, host string")
    df = df.union(df.limit(1))
    got = url_filter.filtered(df, RULES[:2]).select("url", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [*cases, cases[0]]))
    assert url_filter.filtered(df.limit(0), RULES).count() == 0
    assert url_filter.tokens("||example.com/en/7") == ["example", "com", "en"]
    assert {r.verdict for r in url_filter.filtered(df.where("url like '%75%'"), [], general=RULES[3:]).collect()} == {"allow"}


def shards_of(rows, limit):
    """Splits by hand: a bucket over the limit with more than one row splits on its next bit."""
    out, todo = {}, [("", rows)]
    while todo:
        prefix, inside = todo.pop()
        if sum(b for _, _, b in inside) <= limit or len(inside) == 1 or len(prefix) == 60:
            out |= {i: prefix for i, _, _ in inside}
        else:
            for bit in "01":
                if part := [r for r in inside if r[1][len(prefix)] == bit]:
                    todo.append((prefix + bit, part))
    return out


def test_sharding(spark):
    rng = random.Random(2)
    docs = [(i, "é" * rng.randrange(0, 200)) for i in range(300)] + [(1000, "x" * 5000), (1001, None)]
    df = spark.createDataFrame([(a, b, "s") for a, b in docs], "doc_id long, text string, shard string")
    hashed = [(r.doc_id, f"{r.h:060b}", r.bytes) for r in sharding.hashed(df, ["doc_id"], "text").collect()]
    for limit in (1, 500, 3000, 10**6):
        got = sharding.sharded(df, limit=limit).collect()
        assert {r.doc_id: r.shard for r in got} == shards_of(hashed, limit)
        assert all(len(r.shard) == r.depth and r.oversized == (r.n_bytes > limit) for r in got)
    assert sharding.sharded(df.limit(0)).count() == 0


def test_sharding_deals_copies_over_pages(spark):
    df = spark.createDataFrame([(1, "abcd")] * 50 + [(None, None)] * 3 + [(i, "z") for i in range(9)], "doc_id long, text string")
    got = sharding.sharded(df.repartition(5), limit=10).collect()
    total = {}
    for r in got:
        total[r.shard, r.page] = total.get((r.shard, r.page), 0) + r.n_bytes
    assert len(got) == 62 and max(total.values()) <= 10
    assert len({r.page for r in got if r.doc_id == 1 and r.n_bytes == 4}) == 25
