"""Odd inputs of every operator, and results against plain versions."""

import hashlib
import json
import math
import random
import re
import struct
import time
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA, same_rows
from tests.llm import brute
from voxloom.llm import html_extraction, packing, queries
from voxloom.llm.exact_dedup import DigestIndex, exact_duplicates
from voxloom.llm.html_extraction import Page, extract_main_text, style_tree
from voxloom.llm.language_id import Settings, held_out, identify_languages, train, train_on
from voxloom.llm.ngram_join import derive, ngram_components
from voxloom.llm.packing import Schedule, load_encoder, pack
from voxloom.llm.piece_lattice import SPACE, decode_pieces, load_model, segment_nbest, segment_texts
from voxloom.llm.sentence_dedup import remove_repeated_spans
from voxloom.llm.sharding import assign_shards
from voxloom.llm.tool_calls import REPLY_SCHEMA, canonical_json, conversation_calls, link_tool_calls
from voxloom.llm.transport_stream import access_units, describe_media, padded, read_stream, store_texts, write_stream

LONG = " ".join(f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "Same TEXT here", "en", None, 1), (4, "same text HERE", None, "b", 1), (4, "same text HERE", None, "b", 1), (5, LONG, "en", "b", 2),
    (6, LONG + " more", "en", "b", 2), (None, "no id", "en", "c", 3), (7, "   \n\t", None, "c", 3), (8, "12345 !!!", "en", "c", 3), (9, "ÄÖÜ straße İ", "de", "c", 3), (10, "äÖÜ straße İ", "de", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, digest int"
CLASH = ["id", "n", "sid", "key", "run", "first", "tokens", "queue", "part", "shard", "kept", "host", "html", "found", "score"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def tok(name="byte_bpe_50k.json"):
    return queries.tokenizer_path(name)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name]))


# 1 HTML extraction


def test_pages():
    cases = {
        "": "", "plain & text &amp; &nbsp;x": "plain & text & x", "<p>a<p>b": "a\nb", "<nav>x<article>hi<br>there</article>": "hi there", "<!-- never closed": "",
        "<div class=ad>q</div><div>r<table><tr><td>1<td>2</table></div>": "r\n1\n2", "<article><header><h1>T</h1></header><p>x</p><div id='comments'><p>c</p></div></article><p>out": "T\nx",
        "<script>x</script>y<script>z": "y", "<p>1 < 2 &lt; 3</p>": "1 < 2 < 3", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "a\nb\nc\nd", "<form>f</form><aside>s</aside><footer>t</footer>u": "u",
        "<article>a <math><mi>x</mi></math> b <svg><text>s</text></svg> <object>o</object><noscript>n</noscript></article>": "a x b s on", "<noscript>n</noscript>u": "u", "<p>a<textarea><p>q</textarea> b": "a b",
        "<p>a</p><ol class='commentlist'><li>c</ol><div class='sidebarwidget'>w</div><p class='shareholders'>s": "a\ns", '<a href="x>y">link</a> <b>bold': "link bold", "<style>p{}</style><p hidden>h</p><p>v": "v",
    }
    for source, text in cases.items():
        assert Page(source, with_features=True).text() == text, source


@pytest.mark.parametrize("limit", [html_extraction.BROADCAST_BRANCHES, 0])
def test_style_tree_removes_what_all_pages_share(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extraction, "BROADCAST_BRANCHES", limit)
    rows = [(i, "http://h.org/%d" % i, f"<body><div class='top'><p>Always the same</p></div><div class='story'><p>Story number {i} {'x' * i}</p></div></body>") for i in range(30)]
    rows += [(100, "http://one.org/", "<div class='top'><p>Always the same</p></div>"), (101, None, None), (None, "", ""), (0, "http://h.org/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASH if c != "html"})
    got = [(r.page_id, r.text, r.n_chars) for r in extract_main_text(pages).collect()]
    for i, text, n in got:
        assert n == len(text)
        if i is not None and i < 30:
            assert text == f"Story number {i} {'x' * i}".strip()
        else:
            assert text == ("Always the same" if i == 100 else "")
    assert len(got) == len(rows) and extract_main_text(pages.limit(0)).count() == 0
    tree = style_tree(pages).where("host = 'h.org'").collect()
    assert all(0 <= r.content <= 1 + 1e-9 for r in tree) and min(r.content for r in tree) < 0.1


def test_style_tree_of_the_test_pages(spark):
    report = html_extraction.removal_report(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()
    tree, names = sum(r.by_importance + r.by_both for r in report), sum(r.by_name for r in report)
    # menus and adverts are drawn from a small stock, so the tree finds them on every page without their names
    assert all(r.by_importance + r.by_both > 0 for r in report) and tree > names > 0 and sum(r.kept for r in report) > 10 * tree


def test_style_tree_without_names_or_articles(spark):
    random.seed(4)
    stock = [f"Menu line {k} of a stock" for k in range(12)]

    def page(host, i):  # no class, id or element tells content from chrome; one text in ten is a copy
        top, low = random.choice(stock), random.choice(stock)
        own = f"Text {i if i % 10 else 0} of {host}"
        return f"http://{host}.org/{i}", f"<div><ul><li>{top}</ul></div><div id='post-{i}'><div><p>{own}</p><p>More {'x' * (i % 9)}</p>{'<p>y</p>' * (i % 4)}</div></div><table><tr><td>{low}</table>", own

    rows = [page("big", i) for i in range(300)] + [page(f"small{k}", i) for k in range(80) for i in range(1, 3)]
    df = spark.createDataFrame([(n, url, html) for n, (url, html, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    for n, (_, _, own) in enumerate(rows):
        assert got[n].startswith(own + "\nMore") and "Menu" not in got[n], rows[n]
    # half of the host's texts at a path are the same and half are a page's own: none goes
    rows = [(i, f"http://h.org/{i}", f"<div><p>{'Nothing here' if i % 2 else f'Own text {i}'}</p></div><i>{i}</i>") for i in range(200)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{'Nothing here' if i % 2 else f'Own text {i}'}\n{i}" for i in range(200)}
    # equal pages count as one; equal siblings don't cancel
    rows = [(i, "http://h.org/", "<div><p>Same page</p></div>") for i in range(50)]
    assert {r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same page"}
    two, four = (Page("<table>" + "<tr><td>a</td></tr>" * n + "</table>", with_features=True).features for n in (2, 4))
    assert all(two[k] != four[k] for k in two if k in four)
    began = time.perf_counter()
    Page("<div><b>" * 8000, with_features=True)
    assert time.perf_counter() - began < 3


def test_articles_that_a_host_repeats(spark):
    def page(i, article, tag="article"):
        return i, f"http://h.org/{i}", f"<html><body class='b{i}'><div>Same line</div><p>Menu {i} {'y' * i}</p><{tag}>{article}</{tag.split()[0]}></body></html>"

    for tag in ("article", "main", "div role=main", "div role=article"):
        rows = [page(i, "<h2>Summary</h2><p>Not found</p>", tag) for i in range(38)] + [page(i, f"<h2>Summary</h2><p>Only {i}</p>", tag) for i in (38, 39)]
        got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: "Summary\n" + ("Not found" if i < 38 else f"Only {i}") for i in range(40)}, tag
    # a branch of low importance that holds an article, and the rest of it
    rows = [(i, f"http://h.org/{i}", f"<p>Menu {i}</p><div><p>Same line</p><div role=main>Text {i // 39}</div></div>") for i in range(40)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i // 39}" for i in range(40)}


def test_names_of_content():
    long = "the text of this page " * 5
    cases = {
        "<article class='post comments-open'>a</article>": "a", "<div id='content' class='no-sidebar'>a</div>": "a", "<section id='related-work'>a</section><p>b": "a\nb",
        "<div role='main' class='widget'>a</div><p>b": "a", "<article class='comment related'>a</article>b": "a",
        f"<div class='page overlay'><div class='share'>s</div>{long}</div><p>b": f"{long}\nb", f"<article><div class='widget'>{long}</div></article><p>{long}": long,
        f"<div class='overlay'><div class='widget'>{long}<div class='ad'>s</div></div></div><p>b": f"{long}\nb", f"<article><p>b</p><div id='comments'>{long}</div></article>": "b",
        f"<p>{long}</p><div id='comments'><article class='comment-body'>c</article></div>": long, f"<div class='widget'><div role='main'>a</div>{long}</div>": "a",
        "<p>some words</p><div class='post-comments'>a</div><div id='comment-list'>b</div><ul class='siteFooter-inner'><li>c</ul><a class='skip-to-content'>d</a><p class='x sidebar'>e</p><p class='ad-2'>f": "some words",
        f"<nav>{long}</nav><p>a</p><div class='hasSidebar'>b</div>": "a\nb", "": "", "<div class='ad'></div>": "",
    }
    for source, text in cases.items():
        for features in (False, True):
            assert Page(source, with_features=features).text() == "\n".join(t.strip() for t in text.split("\n")), source


def test_pages_against_markup(spark):
    import html

    source = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op1_site_style_tree(spark, DATA).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


# 2 packing


def test_packing(spark, odd, empty, texts):
    encode = load_encoder(tok())
    for df, rows in ((odd, [(r[0], r[1]) for r in ODD]), (spark.read.parquet(f"{DATA}/documents.parquet"), texts)):
        pieces = pack(df, tok(), window=1024, quantum=128).collect()
        by_doc = {}
        for p in pieces:
            by_doc.setdefault(p.doc_id, []).append(p)
        for i, text in dict(rows).items():
            ids = np.append(encode(text or ""), 0).astype("<u4")
            copies = sum(r[0] == i for r in rows)
            mine = sorted(by_doc[i], key=lambda p: p.start)
            assert sum(p.length for p in mine) == copies * len(ids) and {p.doc_tokens for p in mine} == {len(ids)}
            for p in mine:
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
        at = 0
        for s, o, n in places:
            assert s * 1024 + o == at and o + n <= 1024
            at += n
    assert pack(empty, tok()).count() == 0


@pytest.mark.parametrize("limit", [packing.BROADCAST_ROWS, -1])
def test_packing_keeps_proportions(spark, monkeypatch, limit):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", limit)
    rows = [(i, "token " * 300, "big" if i % 4 else "small") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    pieces = pack(df, tok(), window=1024, quantum=128).collect()
    share = {}
    for p in pieces:
        share.setdefault(p.sequence_id, {}).setdefault(p.queue, 0)
        share[p.sequence_id][p.queue] += p.length
    last = max(share)
    assert all(sum(s.values()) == 1024 for k, s in share.items() if k < last)
    assert all(abs(s.get("small", 0) - 256) <= 128 for k, s in share.items() if k < last)
    total = 0
    for k in range(last):  # deficits are carried: the running share never drifts
        total += share[k].get("small", 0)
        assert abs(total - 256 * (k + 1)) <= 128


def plain_round_robin(sizes, weights, quantum):
    """The queue of each token, by a plain loop: the queue whose next quantum is most overdue is served."""
    served, taken, out = [0] * len(sizes), [0] * len(sizes), []
    while any(t < n for t, n in zip(taken, sizes)):
        q = min((i for i in range(len(sizes)) if taken[i] < sizes[i]), key=lambda i: (Fraction(2 * served[i] + 1, weights[i]), i))
        n = min(quantum, sizes[q] - taken[q])
        out += [q] * n
        served[q] += 1
        taken[q] += n
    return out


@pytest.mark.parametrize("closed", [1024, 2])
def test_packing_against_a_plain_round_robin(spark, monkeypatch, closed):
    monkeypatch.setattr(packing, "CLOSED_FORM_QUEUES", closed)
    random.seed(8)
    rows = [(i, "word " * random.randrange(0, 90), random.choice(["a", "b", "b", "b", "c", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for targets in (None, {"a": 0.6, "b": 0.2}):
        got = pack(df, tok(), window=64, quantum=16, targets=targets).collect()
        names = [None, "a", "b", "c"]
        sizes = [sum(p.length for p in got if p.queue == q) for q in names]
        share = np.array(sizes) / sum(sizes)
        wanted = np.array([(targets or {}).get(q, s) for q, s in zip(names, share)])
        weights = [max(1, int(x)) for x in np.rint(wanted / wanted.sum() * packing.WEIGHT_UNIT)]
        want = plain_round_robin(sizes, weights, 16)
        found = [None] * sum(sizes)
        for p in got:
            at = p.sequence_id * 64 + p.offset
            assert found[at : at + p.length] == [None] * p.length
            found[at : at + p.length] = [names.index(p.queue)] * p.length
        assert found == want
        if targets:  # while no queue is empty, every window has its targets, which are not the natural shares
            full = min(max(i for i, q in enumerate(want) if q == k) for k in range(4)) // 64
            off = [want[: 64 * w].count(1) - 64 * w * wanted[1] / wanted.sum() for w in range(full + 1)]
            assert full > 3 and abs(wanted[1] / wanted.sum() - share[1]) > 0.1 and max(map(abs, off)) <= 32  # deficits are carried
    for i, text, _ in rows:  # every document lies in its queue as a whole, in order
        mine = sorted((p.start, p.length, p.sequence_id * 64 + p.offset) for p in got if p.doc_id == i)
        assert [m[0] for m in mine] == [0, *np.cumsum([m[1] for m in mine])[:-1].tolist()] and [m[2] for m in mine] == sorted(m[2] for m in mine)


def test_packing_with_many_or_no_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "CLOSED_FORM_QUEUES", 3)
    df = spark.createDataFrame([(i, "some words " * i, f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    many = pack(df, tok(), window=64, quantum=8, targets={"s11": 0.5}).collect()
    assert {p.queue for p in many} == {f"s{i}" for i in range(12)}
    for pieces in (many, pack(df.drop("source"), tok(), window=64, queue_col=None).collect()):
        places = sorted((p.sequence_id * 64 + p.offset, p.length) for p in pieces)
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(n for _, n in places) == 2 * 66 + 11 + 12


def test_schedule_is_a_plain_round_robin():
    random.seed(3)
    for _ in range(50):
        sizes = np.array([random.randrange(0, 900) for _ in range(random.randrange(1, 6))])
        weights = np.array([random.randrange(1, 50) for _ in sizes])
        s = Schedule(sizes, weights, 16)
        found = [None] * int(sizes.sum())
        for q, n in enumerate(sizes):
            if n:
                for _, _, length, at in zip(*packing.pieces(np.array([0]), np.array([n]), 16, 64, lambda row, j: s.position(np.full(len(j), q), j)), strict=True):  # noqa: B023
                    assert found[at : at + length] == [None] * length
                    found[at : at + length] = [q] * length
        assert found == plain_round_robin(sizes.tolist(), weights.tolist(), 16)


def test_encoder_matches_the_library():
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(tok(name))
        for text in ["", "Hello  world's\n\n\tx", "naïve 日本 𝄞", "<|endoftext|> a", "a<|endoftext|><|endoftext|>\n b <|endoftext", LONG[:5000]]:
            assert load_encoder(tok(name))(text).tolist() == t.encode(text, add_special_tokens=False).ids
        t.encode_special_tokens = True
        for text in ["<|endoftext|> a", "a<|endoftext|>"]:
            assert load_encoder(tok(name), True)(text).tolist() == t.encode(text, add_special_tokens=False).ids


# 3 tool calls


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "add", '{"y": 2, "x": 1}', None), (1, "b", 4, "add", '{"x": "1"}', ["a", "c"]), (1, "c", 9, "add", "not json", []), (1, "a", 7, "add", '{"x":1,"y":1}', None), (1, None, 3, "add", '{"x":1,"y":1}', None),
            (2, "a", None, "nope", "{}", ["b"]), (2, "b", 1, "add", '{"x":1,"y":2,"z":3}', ["a"]), (3, "a", 0, "add", '{"x":1.5,"y":2}', ["missing"]), (3, "a", 0, "add", '{"x":1.5,"y":2}', ["missing"]),
        ],
        "conv long, call_id string, position long, name string, arguments string, after array<string>",
    ).withColumn("level", F.lit("clash"))
    results = spark.createDataFrame([(1, "a", 5, "3"), (1, "a", 6, "later"), (1, "z", 8, None), (2, "a", 2, "r"), (1, None, 1, "q")], "conv long, call_id string, position long, content string")
    schema = {"add": {"properties": {"x": {"type": "integer", "minimum": 0}, "y": {"type": "number"}}, "required": ["x", "y"], "additionalProperties": False}}
    rows = link_tool_calls(calls, results, schema).collect()
    got = {(r.conv, r.call_id, r.position, r.result_position): r for r in rows}
    first = got[(1, "a", 0, 5)]
    assert first.status == "linked" and first.errors == []
    assert first.json == '{"arguments":{"x":1,"y":2},"call_id":"a","errors":[],"level":0,"name":"add","result":"3","status":"linked"}'
    b = got[(1, "b", 4, None)]
    assert b.level == 10 and b.errors == ["x: not integer", "y: missing"] and b.status == "unanswered"
    assert got[(1, "c", 9, None)].errors == ["arguments: not JSON"] and json.loads(got[(1, "c", 9, None)].json)["arguments"] == "not json"
    assert got[(1, "a", 7, None)].status == "duplicate" and got[(1, None, 3, None)].status == "unanswered"
    assert got[(1, "a", None, 6)].status == "duplicate" and got[(1, "z", None, 8)].status == "orphan" and got[(1, None, None, 1)].status == "orphan"
    assert got[(2, "a", -1, 2)].status == got[(2, "b", 1, None)].status == "cyclic" and got[(2, "b", 1, None)].errors == ["unknown property"] and got[(2, "b", 1, None)].level == 1
    assert got[(3, "a", 0, None)].errors == ["x: not integer"]
    assert sorted(r.status for r in rows if r.conv == 3) == ["duplicate", "unanswered"] and len(rows) == 9 + 3  # two results are linked
    assert all(json.loads(r.json) == json.loads(json.dumps(json.loads(r.json), sort_keys=True)) for r in got.values())
    assert link_tool_calls(calls.limit(0), results.limit(0), schema).count() == 0
    assert spark.range(1).select(canonical_json(F.lit('{ "b": [1, 2.50], "a": {"d": null, "c": "é"} }'))).first()[0] == '{"a":{"c":"é","d":null},"b":[1,2.5]}'


def test_call_order_against_a_plain_walk(spark):
    random.seed(2)
    rows, truth = [], {}
    for conv in range(12):
        n = random.randrange(2, 40)
        after = {i: [] for i in range(n)}
        for i in range(n):  # chains, shared predecessors, some cycles and ids that no call has
            after[i] = [str(j) for j in {random.randrange(n) for _ in range(random.choice([0, 1, 1, 2]))} if j < i or conv % 3 == 0 or conv % 3 == 1 and j > i] + (["none"] if i % 7 == 0 else [])
        position = {i: random.randrange(30) for i in range(n)}
        level = {}
        while True:
            more = {i: max([position[i], *(level[int(b)] + 1 for b in after[i] if b != "none")]) for i in range(n) if i not in level and all(b == "none" or int(b) in level for b in after[i])}
            if not more:
                break
            level |= more
        truth |= {(conv, str(i)): (level.get(i, position[i]), i not in level) for i in range(n)}
        rows += [(conv, str(i), position[i], "t", "{}", after[i]) for i in range(n)]
    rows += [(99, str(i), 0, "t", "{}", [str(i - 1)]) for i in range(300)]
    truth |= {(99, str(i)): (i, False) for i in range(300)}
    calls = spark.createDataFrame(rows, "conv long, call_id string, position long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv long, call_id string, position long, content string")
    got = {(r.conv, r.call_id): (r.level, r.status == "cyclic") for r in link_tool_calls(calls, results, {"t": {}}).collect()}
    assert got == truth and {c for _, c in got.values()} == {True, False}


def test_argument_schemas(spark):
    schema = {
        "t": {
            "properties": {
                "flag": {"enum": [True, None]}, "size": {"enum": ["a", 2]}, "n": {"minLength": 3, "minimum": 2}, "s": {"type": ["string", "null"], "minLength": 2, "maxLength": 3, "pattern": "^x"},
                "list": {"type": "array", "items": {"type": "integer", "maximum": 5}}, "in": {"type": "object", "properties": {"a": {"type": "object", "required": ["b"], "additionalProperties": False}}},
            },
        }
    }
    cases = {
        '{"flag":true,"size":2.0,"n":5,"s":"xy","list":[1,5],"in":{"a":{"b":1}}}': ["in.a: unknown property"], '{"flag":null,"size":"a","s":null,"list":[],"in":{}}': [],
        '{"flag":"true","size":"2","n":1,"s":"y"}': ["flag: not in enum", "n: minimum", "s: minLength", "s: pattern", "size: not in enum"], '{"list":[1,"x",9,9],"in":{"a":{}}}': ["in.a.b: missing", "list[]: maximum", "list[]: not integer"],
        '[1]': ["not an object"], '{"n":"ab","s":"xyzz"}': ["n: minLength", "s: maxLength"], '{"n":"abc","list":3}': ["list: not array"],
    }
    calls = spark.createDataFrame([(i, "a", 0, "t", text, []) for i, text in enumerate(cases)], "conv long, call_id string, position long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv long, call_id string, position long, content string")
    got = {r.conv: r.errors for r in link_tool_calls(calls, results, schema).collect()}
    assert got == dict(enumerate(cases.values()))


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (1, None, "user", "x"), (None, 0, "user", "y"), (1, 5, "assistant", "z"), (1, 0, "user", None)]
    found = link_tool_calls(*conversation_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), REPLY_SCHEMA).collect()
    assert sorted((r.status, len(r.errors)) for r in found) == [("duplicate", 1), ("linked", 1), ("orphan", 0), ("unanswered", 0), ("unanswered", 1)]


# 4 pieces


def test_pieces(spark, odd, empty, texts):
    m = load_model(tok("piece_bpe_32k.model"))
    score = {m.names[i]: m.scores[i] for i in m.own}

    def plain(text, n):
        t = chr(SPACE) + text.replace(" ", chr(SPACE))
        best = [[(0.0)]] + [[] for _ in t]
        for i in range(1, len(t) + 1):
            found = []
            for k in range(1, min(i, m.longest) + 1):
                s = score.get(t[i - k : i], m.unknown if k == 1 else None)
                found += [b + s for b in best[i - k]] if s is not None else []
            best[i] = sorted(found, reverse=True)[:n]
        return best[-1]

    samples = ["a", "hello world", " a  b", "日本𝄞 foo\nbar\tx", "x" * 150, "𝄞", "Straße naïve", LONG[:300]]
    for text, found in zip(samples, segment_texts(m, samples, 5), strict=True):
        assert [s for s, _ in found] == plain(text, 5)
        assert len({x.tobytes() for _, x in found}) == len(found)
        assert all(m.decode(x).decode() == text for _, x in found)
    for length in (700, 20_000):  # one word of ties, against the plain best paths where these are quick
        began = time.perf_counter()
        found = segment_texts(m, ["x" * length], 4)[0]
        assert time.perf_counter() - began < 30 and len({x.tobytes() for _, x in found}) == 4 and all(m.decode(x) == b"x" * length for _, x in found)
        assert [s for s, _ in found] == plain("x" * length, 4)
    short = {i: t for i, t in texts if len(t or "") < 2500}
    best = {r.doc_id: [x.score for x in r.nbest] for r in queries.op4_piece_nbest(spark, DATA).collect() if r.doc_id in short}
    assert best == {i: plain(t or "", 4) if t else [0.0] for i, t in short.items()}
    rows = segment_nbest(odd, tok("piece_bpe_32k.model"), n=3, with_ids=True)
    for r in rows.collect():
        assert r.round_trip and r.n_pieces == len(r.ids) == r.nbest[0].n_pieces and [x.score for x in r.nbest] == sorted((x.score for x in r.nbest), reverse=True)
    back = decode_pieces(rows, tok("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in ODD)
    assert segment_nbest(empty, tok("piece_bpe_32k.model")).count() == 0


# 5 sentence spans


def test_span_dedup(spark, odd, empty, documents, texts):
    got = {r.doc_id: (r.text, r.n_removed) for r in remove_repeated_spans(documents).collect()}
    assert got == brute.span_dedup(texts)
    out = remove_repeated_spans(odd).collect()
    assert len(out) == len(ODD) and set(out[0].asDict()) == {*odd.columns, "n_removed"}
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].text is None and by_id[5].text == LONG and by_id[6].n_removed > 3000 and by_id[4].text == "same text HERE"
    assert remove_repeated_spans(empty).count() == 0


def test_embedded_passage(spark):
    passage = "".join(f"One{k} two three four five six seven. Eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen{k}. " for k in range(3))
    rows = [(i, f"Own start {i} of the text. {passage}And own end {i}.") for i in range(5)] + [(9, "Nothing that repeats. At all. In this text, truly.")]
    got = {r.doc_id: r.text for r in remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[5][1]
    for i in range(1, 5):
        assert got[i] == f"Own start {i} of the text. And own end {i}."


def test_passages_however_they_are_cut(spark):
    random.seed(11)

    def text(n, stops=0.0, kind="own"):
        return [f"{kind}{random.randrange(4000)}" + ("." if random.random() < stops else "") for _ in range(n)]

    rows = []
    for k in range(40):
        passage = text(random.choice([51, 60, 90]), random.choice([0.0, 0.02, 0.1, 0.5]), "w")
        for copy in range(3):  # in mid-sentence, with other words before it, and wrapped anew
            around = text(random.randrange(0, 40)) + passage + text(random.randrange(0, 40))
            gap = lambda: random.choice([" ", " ", "\n", "  "]) if copy else " "
            rows.append((3 * k + copy, "".join(w + gap() for w in around)))
    got = [(r.doc_id, r.text) for r in remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert not any(map(any, brute.repeated_words(got, 51).values()))
    assert dict(got) == {i: t for i, (t, _) in brute.span_dedup(rows).items()}
    for i, t in got:  # what surrounds the passages stays
        assert [w for w in t.split() if w[0] == "o"] == [w for w in dict(rows)[i].split() if w[0] == "o"]


def test_no_passage_of_51_words_stays(documents):
    got = [(r.doc_id, r.text) for r in remove_repeated_spans(documents).collect()]
    assert not any(map(any, brute.repeated_words(got, 51).values()))


def test_span_dedup_with_clashing_columns(spark):
    names = ["__hash", "__cut", "__id", "__spans", "run", "id", "body", "text.x", "n"]
    passage = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, passage + " and more")], "doc_id long, text string").withColumns({c: F.lit("mine") for c in names})
    got = {r["doc_id"]: r.asDict() for r in remove_repeated_spans(df).collect()}
    assert got[1]["text"] == passage and got[2]["n_removed"] > 0 and all(got[i][c] == "mine" for i in (1, 2) for c in names)


# 6 transport streams


def test_streams_round_trip():
    random.seed(1)
    for n in [0, 1, 63, 64, 100, 161, 162, 163, 176, 183, 184, 185, 346, 347, 32767, 32768, 32769, 70000]:
        payload = random.randbytes(n)
        report = read_stream(write_stream(payload))
        s = report.streams[0]
        assert s.data == payload and not (report.bad_sections or report.skipped_bytes or s.lost or s.repeated) and all(s.random_access)
        assert s.pts == [3600 * i for i in range(len(s.pts))]
        assert brute.demultiplex(write_stream(payload)) == (payload, s.pts, s.random_access)


def test_damaged_streams():
    m = write_stream(bytes(70000))
    dropped = read_stream(b"xx" + m[: 188 * 20] + m[188 * 21 :])
    assert dropped.skipped_bytes == 2 and dropped.streams[0].lost == 1 and len(dropped.streams[0].data) == 70000 - 184
    doubled = read_stream(m[: 188 * 5] + m[188 * 4 :])
    assert doubled.streams[0].repeated == 1 and doubled.streams[0].data == bytes(70000)
    bad = bytearray(m)
    bad[10] ^= 1
    assert read_stream(bytes(bad)).bad_sections == 1
    assert read_stream(b"").streams == [] and read_stream(b"G" * 188).streams == [] and read_stream(b"junk" * 100).packets == 0


def test_media_columns(spark, odd, empty):
    stored = store_texts(odd)
    got = sorted(describe_media(stored).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    for r, row in zip(got, sorted(ODD, key=lambda r: (r[0] or 0, len((r[1] or "").encode()))), strict=True):
        text = (row[1] or "").encode()
        payload = padded(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert brute.demultiplex(write_stream(payload))[0] == payload
        assert r.media_sha256 == hashlib.sha256(write_stream(payload)).hexdigest()
    units = access_units(stored, "doc_id", "media").where("doc_id = 5").orderBy("unit").collect()
    assert b"".join(u.data for u in units) == padded(LONG.encode()) and all(u.random_access for u in units)
    assert describe_media(store_texts(empty)).count() == 0


# 7 exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(odd, empty, keep):
    norm = [((r[1] or "").translate(brute._LOWER), r[0]) for r in ODD]
    pick = min if keep == "min" else max
    got = exact_duplicates(odd, keep=keep).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    for text, i in norm:
        ids = [j for t, j in norm if t == text]
        r = by[(i, hashlib.sha256(text.encode()).hexdigest())]
        best = pick([j for j in ids if j is not None], default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), i == best)
    assert exact_duplicates(empty).count() == 0


def test_digest_index_grows(spark):
    index = DigestIndex(spark)
    index.flush(spark.createDataFrame([("aa", 5), ("bb", 6)], "digest string, id long"))
    index.flush(spark.createDataFrame([("aa", 3), ("aa", 9)], "digest string, id long"))
    assert sorted(map(tuple, index.compact().collect())) == [("aa", 3, 3), ("bb", 6, 1)]
    index.flush(spark.createDataFrame([("aa", 1), ("cc", 2)], "digest string, id long"))
    assert sorted(map(tuple, index.lookup(["aa", "cc", "dd"]).collect())) == [("aa", 1, 1), ("aa", 3, 3), ("cc", 2, 1)]
    assert sorted(map(tuple, index.compact().collect())) == [("aa", 1, 4), ("bb", 6, 1), ("cc", 2, 1)] and index.runs().count() == 6
    assert [tuple(r) for r in index.lookup(["aa"]).collect()] == [("aa", 1, 4)]


@pytest.mark.parametrize("pages", [1, 8])
def test_filter_of_hits(spark, pages):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    hits = spark.createDataFrame([(digest(i),) for i in range(0, 3000, 3)], "digest string")
    bits = DigestIndex.hit_filter(hits, pages)
    rows = spark.createDataFrame([(digest(i), i) for i in range(3000)], "digest string, id long")
    passed = {r.id for r in DigestIndex.may_hit(rows, bits, pages).collect()}
    assert set(range(0, 3000, 3)) <= passed and len(passed) < 1000 + 2000 * 1.5 * 1000 / (pages * 32768)
    assert [DigestIndex.filter_pages(n) for n in (0, 1, 4096, 8193, 10**12)] == [1, 1, 1, 2, 16384]


def test_stashes_are_released(spark):
    from voxloom.llm.scratch import new_folder, release, shared_dir, stash

    stash(spark.range(3), "some").count()
    folder = Path(new_folder(spark, "x").removeprefix("file://")).parent
    assert any(folder.iterdir()) and str(folder).startswith(shared_dir(spark).removeprefix("file://"))
    release(spark)
    assert not folder.exists()


# 8 sharding


def test_sharding(spark, odd, empty, documents):
    for df in (odd, documents):
        got = assign_shards(df, [1.0] * 8).collect()
        assert len(got) == df.count() and {r.law for r in got} == {"key"}
        for s in range(8):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert all(r.grown_shard in (r.shard, 8) for r in got)
        sizes = {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
        for r in got:
            text = (sizes[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        for r in got:  # the winners, by a plain loop; spark's hash of a key and a number is XXH64 seeded with 42, then with its result

            def best(weights):
                scores = []
                for i, w in enumerate(weights):
                    h = 42 if r.doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
                    h = xxhash.xxh64_intdigest(struct.pack("<i", i), h)
                    scores.append((w / -math.log(((h >> 11) + 0.5) / 2**53), -i))
                return -max(scores)[1]

            assert (r.shard, r.grown_shard) == (best([1.0] * 8), best([1.0] * 9))
    assert assign_shards(empty, [1.0] * 8).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    shares = {r.shard: r["count"] / 20_000 for r in assign_shards(many, [1.0, 2.0, 5.0], new_weight=1.0).groupBy("shard").count().collect()}
    assert abs(shares[0] - 1 / 8) < 0.02 and abs(shares[1] - 2 / 8) < 0.02 and abs(shares[2] - 5 / 8) < 0.02
    with pytest.raises(ValueError):
        assign_shards(many, [0.0])


# 9 language ID


def test_language_id(spark, odd, empty, documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    got = identify_languages(documents).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)
    rows = identify_languages(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id in (1, 2, 7, 8):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de")
    assert identify_languages(empty).count() == 0
    unlabelled = identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_training_is_repeatable_and_bounded():
    texts = [f"the cat {i} sat on the mat" for i in range(40)] + [f"die Katze {i} sitzt auf der Matte" for i in range(40)]
    a, b = (train(texts, ["en"] * 40 + ["de"] * 40, Settings(buckets=1 << 12)) for _ in range(2))
    assert np.array_equal(a.table, b.table) and a.reject_below <= 0.5
    assert a.probabilities(pa.array(["the mat", "auf der Matte", "", "x" * 3_000_000])).shape == (4, 2)
    assert train([], []) is None


def test_scores_against_a_plain_loop(documents):
    from voxloom.llm.textcols import _MIX1, _MIX2

    def mix(x):
        mask = (1 << 64) - 1
        x ^= x >> 30
        x = x * int(_MIX1) & mask
        x ^= x >> 27
        x = x * int(_MIX2) & mask
        return x ^ x >> 31

    rows = [r for r in documents.select("doc_id", "text", "lang").limit(60).collect() if r.text and len(r.text) < 3000]
    model = train([r.text for r in rows], [r.lang or "none" for r in rows], Settings(buckets=1 << 12))
    for r in rows[:20]:
        data = r.text.encode().lower() if r.text.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in r.text.encode())
        total, n = np.zeros(len(model.labels)), 0
        for order in (2, 3, 4):
            for i in range(len(data) - order + 1):
                total += model.table[mix(int.from_bytes(data[i : i + order], "big") + (order << 40)) % (1 << 12)]
                n += 1
        score = np.exp((total / n + model.bias) / model.temperature)
        assert np.allclose(model.probabilities(pa.array([r.text]))[0], score / score.sum(), atol=1e-5)


def test_rare_labels_and_long_texts_are_learned(spark):
    rows = [(i, f"the cat {i} sat on the mat", "en") for i in range(3000)] + [(i, f"die Katze {i} sitzt auf der Matte", "de") for i in range(3000, 3030)]
    rows += [(i, "12 " * 2000 + f"le chat {i} est assis sur le tapis " * 300, "fr") for i in range(3030, 3090)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = Settings(train_rows=300, train_bytes=2000, buckets=1 << 12)
    model = train_on(docs, "doc_id", "text", "lang", F.lit(True), small)
    assert model.labels == ["de", "en", "fr"]
    texts = pa.array(["die Katze sitzt auf der Matte", "the cat sat on the mat", "le chat est assis sur le tapis"])
    assert model.probabilities(texts).argmax(axis=1).tolist() == [0, 1, 2]
    # long texts only
    model = train_on(docs.where("lang = 'fr'"), "doc_id", "text", "lang", F.lit(True), small)
    assert model.labels == ["fr"]


def test_held_out_of_null(spark):
    assert spark.range(1).select(held_out(F.lit(None).cast("long"))).first()[0] is False


# 10 n-gram join


def test_ngram_components(spark, odd, empty, documents, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(documents).collect()}
    assert got == brute.jaccard_components(texts)
    rows = ngram_components(odd).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by_id[1].n_shingles == 0 and by_id[7].component_id == 7 and by_id[4].component_id == 3 and by_id[6].component_id == 5
    assert by_id[9].component_id == 9 and by_id[10].component_id == 10 and by_id[None].component_id is None
    assert ngram_components(empty).count() == 0


def test_ngram_components_at_random(spark):
    random.seed(5)
    base = [" ".join(random.choice("abcdefgh") * 3 for _ in range(random.randrange(1, 60))) for _ in range(12)]
    rows = []
    for i in range(160):
        found = random.choice(base).split()
        for _ in range(random.randrange(0, 4)):
            if found:
                found[random.randrange(len(found))] = random.choice("xyz")
        rows.append((i, " ".join(found)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.jaccard_components(rows)


def test_derived_answers(spark):
    known = spark.createDataFrame([(1, 9, 100, 100, 98), (2, 9, 100, 100, 97), (3, 9, 100, 100, 60)], "a long, b long, na long, nb long, common long")
    pairs = spark.createDataFrame([(1, 2, 100, 100), (1, 3, 100, 100), (1, 4, 100, 100)], "a long, b long, na long, nb long")
    assert {(r.a, r.b): r.linked for r in derive(pairs, known).collect()} == {(1, 2): True, (1, 3): False, (1, 4): None}


def test_components_of_long_chains(spark):
    from voxloom.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 50 != 49] + [(500, 500), (7, 7)], "x long, y long")
    assert {r.node: r.root for r in components(links, "x", "y").collect()} == {i: i // 50 * 50 for i in range(300)} | {}
