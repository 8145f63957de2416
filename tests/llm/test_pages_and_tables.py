import random

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, html_text, oracles, queries, sharding
from loomgraph.llm.url_filter import host_of, url_filter


def test_blocks_and_zones():
    page = '<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p><b>One<br>two <i>x</i><p>three\n  four<aside>ad</aside><div class="comments"><p>first!</div><form>q</form><p>end &eacute;&#x41;</article><footer>f</footer>'
    assert html_text.main_blocks(html_text.blocks(page)) == ["A & B", "One two x", "three four", "end éA"]
    assert html_text.main_blocks(html_text.blocks('<div id="content"><p>x<script>var a="</div>"</script>y</div><div>z</div>')) == ["xy"]
    assert html_text.main_blocks(html_text.blocks("<p>a<p>b")) is None
    for odd in ("", "<", "<p", "<!-- open", "<p class='x", "</p></div>", "<script>never closed", 'a<b "c> d', "&#xD800;&bogus;"):
        html_text.blocks(odd)


def test_attributes_and_hints():
    main = lambda page: html_text.main_blocks(html_text.blocks(page))
    for odd in ('style="overflow:hidden"', 'aria-hidden="false"', 'data-id="share"', 'href="/x?id=login"', "title='class=nav'", 'data-class = "menu" title="a hidden role=form"', "data-hidden", 'class="a" class="comments"'):
        assert main(f"<article><div {odd}><p>a <a {odd}>b</a></div></article>") == ["a b"], odd
    for marked in ("hidden", 'x=1 HIDDEN=""', "role = menu", "class=comments", '''title="it's"id='share\'''', 'class="nav'):
        assert main(f"<article><p>a</p><div {marked}>b</div></article>") == ["a"], marked
    text = "the words of the article itself"
    assert main(f'<article class="post comments-open"><p>{text}</article>') == [text]
    assert main(f'<div class="layout with-sidebar"><article><p>{text}<div class="comments">c</div></article><div class="sidebar">s</div></div>') == [text]
    assert main(f'<div class="layout with-sidebar"><main id="search"><p>{text}</main></div>') == [text]
    for wrapper in ("layout", "layout with-sidebar"):
        assert main(f'<div class="{wrapper}"><article class="post"><p>{text}<article class="comment">d</article></article><div class="comments"><article>c</article><article>e</article></div></div>') == [text]
    assert main(f'<article>teaser</article><div class="with-sidebar"><article><p>{text}</article></div>') == ["teaser", text]
    assert main(f"<div hidden><article>{text}</article></div>") == main(f"<nav><article>{text}</article></nav>") == []


def page_rows():
    rng = random.Random(6)
    menu = "<div>Home About Contact Terms Privacy Help Jobs Press Legal Blog</div>"
    bottom = "<div>All rights reserved by the owners of this place since 1999 and on</div>"
    rows = []
    for i in range(12):
        body = " ".join(f"w{rng.randrange(10_000)}" for _ in range(40))
        rows.append((i, f"https://www.site.org/{i}", f"{menu}<div>{body}</div>{bottom}", body))
    rows += [(100, "https://other.org/a", f"{menu}<div>alone here</div>", "Home About Contact Terms Privacy Help Jobs Press Legal Blog\nalone here"), (101, None, None, ""), (102, "nonsense", "", ""), (103, "https://site.org/copy", "<article><p>same words in both copies of this article text</p></article>", "same words in both copies of this article text"), (104, "https://site.org/copy2", "<article><p>same words in both copies of this article text</p></article>", "same words in both copies of this article text")]
    return rows


def test_host_repeats_decide_without_markup(spark):
    rows = page_rows()
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").selectExpr("*", "1 as text").repartition(4)
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(df).collect()}
    assert got == {r[0]: (r[3], len(r[3])) for r in rows}
    assert html_text.main_text(df.limit(0)).collect() == []


def test_covered_runs_go_and_unique_runs_and_copies_stay(spark):
    rng = random.Random(16)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared, tail = words(60), words(12)
    own = [words(50) for _ in range(3)] + [words(100), words(30) + " end", words(30) + " end"]
    twin = words(40)
    bodies = [f"<p>{shared} {own[0]}</p>", f"<p>{own[1]} {shared}</p>", f"<p>{own[2][:200]} {shared} {own[2][200:]}</p>", f"<p>{own[3]} {tail}</p>", f"<p>{own[4]}</p>", f"<p>{own[5]}</p>", f"<p>{tail}</p><p>{twin}</p>", f"<p>{tail}</p> <p>{twin}</p>"]
    want = [own[0], own[1], " ".join(f"{own[2][:200]} {own[2][200:]}".split()), *own[3:], twin, twin]
    df = spark.createDataFrame([(i, f"https://site.org/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == dict(enumerate(want))


def test_suffix_array_matches_sorting():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in [1, 2, 60] + [60] * 30:
        tokens, page = rng.integers(1, 4, n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
        suffix = [[int(t) for t, p in zip(tokens[i:], page[i:], strict=True) if p == page[i]] for i in range(n)]
        order, common = html_text.suffix_array(tokens, page)
        assert [suffix[i] for i in order] == sorted(suffix)
        for a, b, got in zip(order[:-1], order[1:], common[1:], strict=True):
            assert got == next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))


def test_array_alone_matches_brute_force(spark):
    rng = random.Random(21)
    shared = [" ".join(f"s{rng.randrange(10**9)}" for _ in range(n)) for n in (5, 7, 8, 9, 20)]
    rows = []
    for i in range(40):
        blocks = [rng.choice(shared) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        tag = rng.choice(["article", "nav", "p"])
        rows.append((i, f"https://h{i % 3}.org/{i}", "".join(f"<{tag}>{b}</{tag}>" for b in blocks), [" ".join(b.split()) for b in blocks]))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(5), markup=False).collect()}
    sets = {}
    for i, u, _, blocks in rows:
        w = " ".join(blocks).split()
        sets[i] = (u.split("/")[2], w, {tuple(w[k : k + 8]) for k in range(len(w) - 7)}, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    copy = lambda a, b: 100 * len(sets[a][3] & sets[b][3]) >= 90 * len(sets[a][3] | sets[b][3])
    group = {i: min(j for j in sets if copy(i, j)) for i in sets}
    for i, _, _, blocks in rows:
        h, w, _, _ = sets[i]
        gone = set()
        for k in range(len(w) - 7):
            pages = {group[j] for j in sets if sets[j][0] == h and tuple(w[k : k + 8]) in sets[j][2]}
            if len(pages) > 1:
                gone |= set(range(k, k + 8))
        want, at = [], 0
        for b in blocks:
            left = [x for k, x in enumerate(b.split(), at) if k not in gone]
            at += len(b.split())
            if left:
                want.append(" ".join(left))
        assert got[i] == "\n".join(want), i


def test_near_copies_keep_their_text_and_teasers_give_way(spark):
    rng = random.Random(31)
    menu = " ".join(f"m{rng.randrange(10**9)}" for _ in range(12))
    words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    other = [*words[:150], "changed", *words[151:]]
    rows = [(i, "https://c.org/", f"<p>{menu}</p><p>{' '.join(w)}</p>") for i, w in enumerate((words, other, words[:50][::-1]))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: " ".join(words), 1: " ".join(other), 2: " ".join(words[:50][::-1])}
    main = lambda page: html_text.main_blocks(html_text.blocks(page))
    long = " ".join(words)
    assert main(f"<article>teaser of another</article><main><p>{long}</main>") == [long]
    assert main(f"<main><p>skip <article>{long}</article></main>") == [long]
    assert main("<main><nav>m</nav></main><article>a</article>") == ["a"]
    assert len(main(f"<article><p>{'long text ' * 200_000}</article>")[0]) == 1_999_999


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 30, 55])))) for i in range(15)] + [(50, None), (51, " ,.")]
    docs, planted = [], set()
    for d in range(60):
        words = [word() for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            i, text = rng.choice(items[:15])
            leak = text.upper().split()
            if len(leak) > 30 and d % 2:
                leak[len(leak) // 2] = "CHANGED"
            words[len(words) // 2 : len(words) // 2] = [w + "," for w in leak]
            planted.add((d, i))
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as item_id", "1.0 as similarity")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def plain(t):
        return "".join(c for c in (t or "").lower() if not (c.isascii() and not c.isalnum() and not c.isspace())).split()

    want = {}
    for d, t in docs:
        w = plain(t)
        for i, b in items:
            x = plain(b)
            width = min(5, len(x))
            if not x or len(w) < len(x):  # shorter ones: test_documents_shorter_than_an_item_are_leaks
                continue
            bag = lambda v: [tuple(v[k : k + width]) for k in range(len(v) - width + 1)]  # noqa: B023, E731
            own = bag(x)
            for s in range(len(w) - len(x) + 1):
                part = bag(w[s : s + len(x)])
                both = sum(min(part.count(g), own.count(g)) for g in set(own))
                v = both / (len(part) + len(own) - both)
                if v >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), round(v, 6))
    assert got == want and planted <= set(got)
    assert decontaminate.contaminated(df, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_documents_shorter_than_an_item_are_leaks(spark):
    rng = random.Random(15)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for i, n in enumerate([30] * 5 + [9] * 200 + [14] * 5 + [5, 3])]
    docs, want = [], {}
    for i, text in items:
        words = text.split()
        for cut in range(1, min(8, len(words))):
            # Shingles left of the item's; a cut in the middle breaks four more.
            docs += [(20 * i + cut, " ".join(words[cut:])), (20 * i + 10 + cut, " ".join(words[: len(words) // 2] + words[len(words) // 2 + cut :]))]
            for d, left in docs[-2:]:
                own, part = ([tuple(v[k : k + 5]) for k in range(len(v) - 4)] for v in (words, left.split()))
                both = len(set(own) & set(part))
                if part and both / (len(own) + len(part) - both) >= 0.8:
                    want[d, i] = (round(both / (len(own) + len(part) - both), 6), 0, len(left.split()))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want[2, 0] == (0.923077, 0, 28) and len(want) > 200
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in got} == want


@pytest.mark.parametrize("size", [400, 900])
def test_block_index_finds_all_within_the_radius_and_selects(size):
    """400 items are compared one by one, 900 looked up in the tables."""
    import numpy as np

    rng = np.random.default_rng(3)
    items = rng.integers(0, 256, (size, 16)).astype(np.uint8)
    index = decontaminate.BlockIndex(items)
    assert index.few == (size == 400)
    for radius in (decontaminate.RADIUS, decontaminate.SHORT_RADIUS):
        flips = np.zeros((size, 128), np.uint8)
        for i in range(size):
            flips[i, rng.choice(128, rng.integers(radius - 6, radius + 3), replace=False)] = 1
        asked = np.concatenate([items ^ np.packbits(flips, axis=1), rng.integers(0, 256, (size, 16)).astype(np.uint8)])
        far = np.array([np.unpackbits(a ^ items, axis=1).sum(axis=1) for a in asked])
        w, i = index.candidates(asked, radius)
        assert set(zip(w.tolist(), i.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True))
    share = len(index.blocked(asked[size:], decontaminate.RADIUS)[0]) / size**2
    assert 0.05 < share < 0.1


def test_recall_at_the_threshold():
    rng = random.Random(17)
    found = asked = 0
    for i in range(300):
        n = rng.randint(20, 120)
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        part, own = words[:], [tuple(words[k : k + 5]) for k in range(n - 4)]
        for _ in range(200):
            more = part[:]
            more[rng.randrange(n)] = "x"
            both = len(set(own) & {tuple(more[k : k + 5]) for k in range(n - 4)})
            if both / (2 * len(own) - both) < 0.8:
                break
            part = more
        both = len(set(own) & {tuple(part[k : k + 5]) for k in range(n - 4)})
        asked += 1
        found += len(decontaminate.Benchmark([(i, " ".join(words))], 0.8).matches(" ".join(["a", "b", *part, "c"])))
    assert found >= 0.99 * asked


def test_benchmark_in_blocks_long_texts_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(18)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(7)]
    docs = [(i, f"before {t} after") for i, t in items] * 2 + [(50, "filler text " * 100_000 + items[3][1] + " more" * 1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(i, i) for i in range(7)} | {(50, 3)}
    for limit in (decontaminate.BLOCK_ITEMS, 3):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", limit)
        got = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_url_list_matches_sql(spark, sf_dir):
    assert differences(queries.op6_url_filter(spark, sf_dir), connect(sf_dir), oracles.ORACLES["op6_url_filter"]) is None


def test_url_cases(spark):
    changes = spark.createDataFrame([("a.org", "deny", "add", "2024-01-10"), ("a.org", "deny", "remove", "2024-02-10"), ("x.a.org", "allow", "add", "2024-01-20"), ("A.org", "deny", "add", "2024-01-10"), (None, "deny", "add", "2024-01-01")], "name string, kind string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows = [(1, "http://a.org/x", "2024-01-09"), (2, "http://U:p@A.ORG:80/x", "2024-01-10"), (3, "http://b.a.org.", "2024-02-09"), (4, "http://a.org", "2024-02-10"), (5, "http://x.a.org", "2024-01-25"), (6, None, "2024-01-25"), (7, "nonsense", "2024-01-25"), (8, "http://a.org", None), (8, "http://a.org", None), (9, "http://notа.org", "2024-01-25"), (10, "http://nota.org", "2024-01-25")]
    caps = spark.createDataFrame(rows, "id long, url string, at string").selectExpr("*", "'c' as kept")
    got = [(r.capture_id, r.kept) for r in url_filter(caps, changes, "id", "url", "at").orderBy("capture_id").collect()]
    assert got == [(1, True), (2, False), (3, False), (4, True), (5, True), (6, True), (7, True), (8, True), (8, True), (9, True), (10, True)]
    assert caps.select(host_of(F.lit("ftp://h.x:1?q")).alias("h")).first().h == "h.x"


def test_url_entries_of_many_labels(spark):
    name = "b.c.d.e.f.g.h.i.j"
    changes = spark.createDataFrame([(name, "deny", "add", "2024-01-10"), (f"x.{name}", "allow", "add", "2024-01-10")], "name string, kind string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    hosts = [name, f"a.{name}", f"q.r.{name}", f"y.x.{name}", name[2:], f"a{name}"]
    caps = spark.createDataFrame([(i, f"http://{h}/", "2024-02-01") for i, h in enumerate(hosts)], "id long, url string, at string")
    got = {r.capture_id: (r.matched_name, r.kept) for r in url_filter(caps, changes, "id", "url", "at").collect()}
    assert got == {0: (name, False), 1: (name, False), 2: (name, False), 3: (f"x.{name}", True), 4: (None, True), 5: (None, True)}


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300), rng.choice(["en", "fr"])) for i in range(3000)]
    rows += [(5000 + i, "one text in many copies", "en") for i in range(900)] + [(None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "3 as shard").repartition(5)
    got = sharding.kd_shards(df, {"size": F.octet_length(F.coalesce("text", F.lit(""))), "lang": F.crc32(F.coalesce("lang", F.lit("")).cast("binary"))}).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(24))
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    mean = sum(sizes.values()) / 24
    assert all(abs(v - mean) < 0.1 * mean for v in sizes.values()), sizes
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    few = sharding.kd_shards(df.limit(3), {"size": F.octet_length("text")}).collect()
    assert len(few) == 3 and sharding.kd_shards(df.limit(0), {"size": F.octet_length("text")}).collect() == []


def shards_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    return by


def test_shards_of_repeated_rows_are_equal(spark):
    rows = [(None, "one text in many repeated rows")] * 2400 + [(i, "y" * 20) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    by = shards_of(sharding.kd_shards(df, {"size": F.octet_length("text")}).collect())
    total = sum(len((t or "").encode()) + 8 for _, t in rows)
    assert set(by) == set(range(24)) and sum(map(len, by.values())) == len(rows)
    assert all(abs(sum(r["size"] for r in v) - total / 24) <= 0.01 * total / 24 + 38 for v in by.values())
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


def test_cuts_are_weighted_medians(spark):
    rng = random.Random(12)
    rows = [(i, "z" * rng.randint(0, 80), rng.randrange(50)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    halves = shards_of(sharding.kd_shards(df, {"kind": F.col("kind")}, 2).collect())
    kind = {i: k for i, _, k in rows}
    assert max(kind[r.doc_id] for r in halves[0]) <= min(kind[r.doc_id] for r in halves[1])
    sizes = sorted((k, len(t) + 8) for _, t, k in rows)
    total = sum(s for _, s in sizes)
    left = sum(r["size"] for r in halves[0])
    assert abs(left - total / 2) <= sharding.TOLERANCE * total / 2
    upto, median = 0, None
    for k, s in sizes:
        upto += s
        if upto >= total / 2:
            median = k
            break
    assert median in (max(kind[r.doc_id] for r in halves[0]), min(kind[r.doc_id] for r in halves[1]))
    by = shards_of(sharding.kd_shards(df, {"kind": F.col("kind"), "size": F.octet_length("text")}).collect())
    assert all(abs(sum(r["size"] for r in v) - total / 24) <= 0.01 * total / 24 + 88 for v in by.values())
