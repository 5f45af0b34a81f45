"""Web archives, web pages, nearest neighbours and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import ann, graph, html_extract, registry, warc
from millrace.llm.common import chi2_cdf, chi2_quantile
from millrace.sources.storage import materialize

SMALL = "/root/testdata/sf0.001"


# Common parts


def test_components_of_random_graphs(spark):
    luck = random.Random(3)
    edges = [(luck.randrange(200), luck.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 1000 + i) for i in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_chi_square():
    assert abs(chi2_cdf(3.841458820694124, 1) - 0.95) < 1e-12 and abs(chi2_quantile(0.95, 8) - 15.507313055865453) < 1e-9 and chi2_cdf(0, 3) == 0


# Web archives

RECORDS = warc.RECORD + ", key string, full boolean, base_id bigint"


def captured(*rows):
    return [(*r, "clash", True, 1) for r in rows]


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/?b=2&a=1&utm_source=x#top", "https://user@example.com:443/a?a=1&b=2", "example.com/a/?a=1&b=2&ref=z"]
    other = ["http://example.com/A?a=1&b=2", "http://m.example.com/a?a=1&b=2", None, "", "http://example.com/a?a=1"]
    rows = spark.createDataFrame([(u,) for u in same + other], "u string").select(warc.canonical_url(F.col("u")).alias("c")).collect()
    assert [r["c"] for r in rows[:3]] == ["example.com/a?a=1&b=2"] * 3
    assert len({r["c"] for r in rows[3:]} | {rows[0]["c"]}) == 6 and rows[5]["c"] is None


def test_revisits_by_validators_and_headers(spark):
    full = {"ETag": '"1"', "Content-Type": "text/html", "Last-Modified": "mon", "X": "old", "Content-Length": "3"}
    rows = captured(
        (1, "http://a.org/p", 10, 200, full, "one"),
        (2, "https://www.a.org/p/", 20, 304, {"etag": 'W/"1"', "x": "new", "content-length": "0", "connection": "drop-me", "drop-me": "1"}, None),
        (3, "http://a.org/p", 30, 304, {"etag": '"2"'}, None),
        (4, "http://a.org/p", 5, 304, {"etag": '"1"'}, None),
        (5, "http://a.org/p", 40, 304, {"last-modified": "mon"}, None),
        (6, "http://a.org/p", 50, 304, None, None),
        (7, "http://a.org/p", 60, 200, {"etag": '"2"'}, "two"),
        (8, "http://a.org/p", 10**9, 304, {"etag": '"2"', "y": None}, None),
        (9, None, 70, 304, {"etag": '"2"'}, None),
        (10, "http://a.org/p", None, 304, {"etag": '"2"'}, None),
        (11, "http://a.org/q", 1, 404, {}, None),
    )
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert {k: (r["base_id"], r["outcome"], r["payload"]) for k, r in got.items()} == {
        2: (1, "etag", "one"), 3: (1, "mismatch", None), 4: (None, "orphan", None), 5: (1, "last-modified", "one"), 6: (1, "unvalidated", None),
        8: (7, "etag", "two"), 9: (None, "orphan", None), 10: (None, "orphan", None),
    }
    assert got[2]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "last-modified": "mon", "x": "new", "content-length": "3"}
    assert got[2]["status"] == 200 and got[3]["status"] == 304


@pytest.mark.parametrize("stretch", [1, 7, 100, 10**6])
def test_as_of_equals_a_scan(spark, stretch):
    luck = random.Random(stretch)
    rows = [(i, luck.choice("ab"), luck.randrange(300), luck.random() < 0.3) for i in range(200)]
    want = {}
    for i, key, t, full in rows:
        if not full:
            earlier = [(t2, j) for j, key2, t2, full2 in rows if full2 and key2 == key and (t2, j) < (t, i)]
            want[i] = max(earlier)[1] if earlier else None
    keys = spark.createDataFrame(rows, "record_id bigint, key string, captured bigint, full boolean")
    assert {r["record_id"]: r["base_id"] for r in warc.latest_full(keys, stretch).collect()} == want


def test_rows_of_one_id_are_told_apart_by_their_place(spark):
    rows = captured(*[(1, "http://a.org/p", 10 - k, 200, {"etag": f'"{k}"'}, f"payload {k}") for k in range(4)], (2, "http://a.org/p", 20, 304, {"etag": '"3"'}, None), (2, "http://a.org/p", 20, 304, {"etag": '"3"'}, None))
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS).repartition(3)).collect()
        assert [(r["record_id"], r["base_id"], r["outcome"], r["payload"]) for r in got] == [(2, 1, "etag", "payload 3")] * 2


def test_no_records(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


# Web pages


def main_text(page):
    return [t for _, _, t in html_extract.located(page, None)[1]]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (None, []),
        ("", []),
        ("<p>a&nbsp;&amp; b<br>c<p>d", ["a & b c", "d"]),
        ('<nav>m</nav><main><h1>T</h1><p>one <b>two</b>three</p><div id="comments"><p>bad</p></div><aside>s</aside><ul><li>i<li>j</ul></main><footer>f</footer>', ["T", "one twothree", "i", "j"]),
        ('<article><header><h1>T</h1></header><p>x<script>var a="</p>"</script>y</p><span class="ad">buy</span><form>q</form></article><article class="comment">c</article>', ["T", "xy"]),
        ('<body><div class="cookie-notice">c</div><div class="content has-sidebar"><article><p>Text &lt;b&gt;</p></article></div>', ["Text <b>"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>one<!-- no -->two</p><style>p{}</style><div hidden>h</div>", ["onetwo"]),
        ("<div>" * 3000 + "deep", ["deep"]),
        ("<p>top</p>" + "<div>" * 200 + "<nav>menu link</nav><p>text</p>" + "</div>" * 200 + "<p>end</p>", ["top", "text", "end"]),
        ("<main><article><p>one part</p></article><hr><article><p>two part</p></article><article><p>and three</p></article></main><p>out</p>", ["one part", "two part", "and three"]),
        ("x" * 300_000, ["x" * 300_000]),
    ],
)
def test_blocks_of_a_page(page, blocks):
    assert main_text(page) == blocks


@pytest.mark.parametrize("name", ['class="content no-sidebar"', 'class="layout-sidebar-right"', 'class="post ad-free"', 'class="row hidden-xs"', 'id="related-work"', 'class="widget"'])
def test_a_name_does_not_cost_the_main_text(name):
    page = f'<body><div class="sidebar">links</div><div {name}><p>The main text of the page stands here.</p></div></body>'
    assert main_text(page) == ["The main text of the page stands here."]


def test_constant_texts_of_a_host_go(spark):
    page = "<body><div><p>Welcome to our site</p><h2>{0}</h2><p>{0} is what this page says</p>{1}<p>All about us</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(f"Word{i}", "<p>More</p>" * (i in (1, 2))), i) for i in range(8)]
    rows += [(100 + i, "http://copies.org/x", page.format("Same", ""), i) for i in range(5)]
    rows += [(200, None, None, 0), (201, "", "<p>alone</p>", 0), (202, "nonsense", "", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host bigint")
    got = {r["page_id"]: r["blocks"] for r in html_extract.extract_pages(pages).collect()}
    assert len(got) == len(rows)
    assert got[1] == ["Word1", "Word1 is what this page says", "More"]
    # Copies of one article are no evidence of a template.
    assert got[100] == ["Welcome to our site", "Same", "Same is what this page says", "All about us"]
    assert got[200] == [] and got[201] == ["alone"] and got[202] == []
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_two_pages_make_a_wrapper_and_more_make_it_grow(spark):
    two = [(i, "http://two.org/", f"<div><p>Subscribe to us today</p><p>Text of page {i}</p></div>", i) for i in range(2)]
    # A notice that the first pages lack stands on most others.
    notice = lambda i: "" if i % 3 == 0 else "<section><p>Read our letter</p></section>"
    many = [(10 + i, "http://many.org/", f"<div><p>Words {i} here</p>{notice(i)}<p>More {i} words</p></div>", i) for i in range(12)]
    pages = spark.createDataFrame(two + many, "page_id bigint, url string, html string, blocks bigint")
    got = {r["page_id"]: r["blocks"] for r in html_extract.extract_pages(pages).collect()}
    assert got == {i: [f"Text of page {i}"] for i in range(2)} | {10 + i: [f"Words {i} here", f"More {i} words"] for i in range(12)}


@pytest.mark.parametrize("together", [4, 64])
def test_a_wrapper_has_what_most_pages_have_whichever_they_are(spark, monkeypatch, together):
    monkeypatch.setattr(html_extract, "TOGETHER", together)
    luck, rows, want = random.Random(4), [], {}
    for site in range(50):
        with_notice = set(luck.sample(range(12), 7))
        for i in range(12):
            at = 100 * site + i
            notice = "<section><p>Read our letter</p></section>" if i in with_notice else ""
            texts = [f"Words {at} {k}" for k in range(1 + i)]
            rows.append((at, f"http://h{site}.org/", f"<div><h1>Title {at}</h1>{notice}{''.join(f'<p>{t}</p>' for t in texts)}<ul><li>About us</ul></div>"))
            want[at] = [f"Title {at}", *texts]
    got = {r["page_id"]: r["blocks"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_only_what_at_most_a_share_of_the_articles_have_is_left_out():
    luck = random.Random(5)
    pages = [(luck.randint(1, 5), {k for k in range(8) if luck.random() < (k + 1) / 9}) for _ in range(40)]
    trees = []
    for weight, has in pages:
        page = "<div>" + "".join(f'<section id="s{k}"><p>x</section>' for k in sorted(has)) + "</div>"
        trees.append((html_extract.skeleton(html_extract.read(page)[0]), None, weight, weight))
    parts = [html_extract.put_together(trees[at : at + 7], 0.0, 0.25) for at in range(0, 40, 7)]
    text, held, weight = html_extract.put_together([(t, h, w, w) for t, h, w in parts], 0.25, 0.5)
    assert weight == sum(w for w, _ in pages)
    left = {n.label for n in html_extract.reference(text)[1]}
    for k in range(8):
        assert f"section s{k}" in left or 2 * sum(w for w, has in pages if k in has) <= weight
    assert "section s0" not in left and "section s7" in left


def test_alignment_skips_what_one_page_has_more():
    wrapper = html_extract.skeleton(html_extract.read("<div><p>a</p><h2>b</h2><ul><li>c</ul></div>")[0])
    _, seen = html_extract.located("<div><p>x</p><section><p>new</p></section><h2>y</h2><ul><li>z<li>w</ul></div>", wrapper)
    nodes = html_extract.reference(wrapper)[1]
    assert [nodes[n].label for n, _, _ in seen if n >= 0] == ["p", "h2", "li"]


def slow_matching(a, b):
    """Weight of the best matching by the recursion that defines it."""
    if a.label != b.label:
        return 0
    table = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, p in enumerate(a.kids):
        for j, q in enumerate(b.kids):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + slow_matching(p, q))
    return 2 + (a.said == b.said != 0) + table[-1][-1]


def aligned_weight(page, wrapper):
    """Weight of what ``align`` paired, which has to keep the order and the parents."""
    root, nodes = html_extract.reference(wrapper)
    html_extract.align(page, root)
    total, todo = 0, [page]
    while todo:
        n = todo.pop()
        total += 2 + (n.said == nodes[n.number].said != 0)
        paired = [k for k in n.kids if k.number >= 0]
        places = [next(i for i, q in enumerate(nodes[n.number].kids) if q.number == k.number) for k in paired]
        assert places == sorted(set(places)) and all(k.label == nodes[k.number].label for k in paired)
        todo += paired
    return total


def random_page(luck, depth, width):
    if depth == 0 or luck.random() < 0.3:
        return f"<{(t := luck.choice(['p', 'h2', 'blockquote']))}>{luck.choice('abcde')}</{t}>"
    tag = luck.choice(["div", "section", "ul"])
    return f"<{tag}>" + "".join(random_page(luck, depth - 1, width) for _ in range(luck.randint(0, width))) + f"</{tag}>"


@pytest.mark.parametrize("in_rows", [1024, 0])
def test_alignment_is_the_best_matching(monkeypatch, in_rows):
    monkeypatch.setattr(html_extract, "IN_ROWS", in_rows)
    luck = random.Random(in_rows)
    for _ in range(60):
        page, other = (html_extract.read("".join(random_page(luck, 3, 4) for _ in range(luck.randint(1, 5))))[0] for _ in range(2))
        wrapper = html_extract.skeleton(other)
        assert aligned_weight(page, wrapper) == slow_matching(page, html_extract.reference(wrapper)[0])


def test_many_children_are_matched_as_few_are(monkeypatch):
    luck = random.Random(1)
    part = lambda: f"<div><p>{luck.choice('abcdefgh')}</p>" + "<p>same</p>" * luck.randint(0, 2) + "</div>"
    a, b = ("".join(part() for _ in range(300)) for _ in range(2))
    wrapper = html_extract.skeleton(html_extract.read(b)[0])
    in_rows = aligned_weight(html_extract.read(a)[0], wrapper)
    monkeypatch.setattr(html_extract, "IN_ROWS", 10**9)
    assert in_rows == aligned_weight(html_extract.read(a)[0], wrapper) == slow_matching(html_extract.read(a)[0], html_extract.reference(wrapper)[0])


# Nearest neighbours


def slow_nearest(rows, query_ids, k=5):
    sound = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in sound:
        if q in query_ids:
            scores = [(-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), i) for i, w in sound if i != q]
            out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in scores)[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_neighbours_with_copies_and_bad_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    luck = np.random.default_rng(5)
    centres = luck.normal(size=(20, 16))
    vectors = [[float(np.float32(x)) for x in centres[i % 20] + 0.3 * luck.normal(size=16)] for i in range(600)]
    vectors += [vectors[0]] * 40 + [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [2 * x for x in vectors[1]]]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>").withColumn("id", F.lit(1)).withColumn("leaf", F.lit("x"))
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = slow_nearest(list(enumerate(vectors)), set(range(0, 700, 20)))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)
    assert got[0] == want[0] == [600, 601, 602, 603, 604]


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1.0])
def test_cosine_of_any_scale(scale):
    a, b = np.array([[1.0, 2.0, 3.0]]), np.array([[3.0, 2.0, -1.0]])
    assert ann.cosine(a * scale, b * scale)[0] == pytest.approx(4 / 14) and ann.cosine(a, b * scale)[0] == pytest.approx(4 / 14)


def test_neighbours_of_a_real_table(spark):
    """Recall against brute force on all of a table, with leaves that are cut into slabs."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()]
    sound = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in sound]), np.array([v for _, v in sound], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in np.nonzero(ids % 50 == 0)[0]:
        far = -(x @ x[q])
        far[ids == ids[q]] = np.inf
        want = ids[np.lexsort((ids, np.round(far, 12)))[:5]]
        hits, total = hits + len(set(want.tolist()) & got[int(ids[q])]), total + len(want)
    assert hits >= 0.95 * total


def test_at_most_one_in_a_hundred_neighbours_is_ruled_out():
    # A neighbour at this multiple of its squared distance in projection is still looked for.
    assert 1 - chi2_cdf(chi2_quantile(ann.CONFIDENCE, ann.DIRECTIONS), ann.DIRECTIONS) <= 0.01 + 1e-9


def test_few_or_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table, table.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


# The pipeline and the registry


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = materialize(stage(spark, now, SMALL), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
            counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    assert now.select("doc_id").distinct().count() == counts[-1] and "sequence_id" in now.columns


def test_stages_on_rows_without_names_and_texts(spark):
    clean = " ".join(f"word{i % 97} and{i}" for i in range(60))
    rows = [(None, clean, None, None, 5), (None, "junk", "en", "s", 4), (None, None, "en", None, None), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, clean + " end", "en", "s", 9), (3, clean + " end", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    now, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, SMALL), name)
        left.append(sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in now.collect()))
    full = len(clean)
    assert left == [[(0, full), (3, full + 4), (3, full + 4)]] * 2 + [[(0, full), (3, full + 4)]]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SMALL)
        assert out.count() == 0


def test_the_registry():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 11))
    assert {"pipeline", *registry.queries()} <= set(entry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())


def test_warc_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    got = registry.queries()["op2_warc_revisits"](spark, SMALL)
    want = con.sql(registry.oracle_sql()["op2_warc_revisits"])
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    assert columns == sorted(want.columns) and sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
