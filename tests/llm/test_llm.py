"""Every operator of granary.llm on small fixtures: edge cases, and brute force where SQL can't say it."""

import hashlib
import json
import random
import re
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import chat_format as chat
from granary.llm import html_extract as html_x
from granary.llm import queries as Q
from granary.llm import secret_scan as sec
from granary.llm import sentencepiece_codec as spm
from granary.llm.components import connected_components
from granary.llm.exact_dedup import exact_dedup
from granary.llm.maxscore import search
from granary.llm.ordinal_quality import fit_ordinal, score_quality
from granary.llm.poisson_mix import poisson_mix
from granary.llm import simhash as sim
from granary.llm.simhash import block_views, majority, sample_views, shingle_hashes, simhash_components, trie_links
from granary.llm.suffix_dedup import remove_repeats

CLASH = "_row string, kept string, keep_id string, group_size string, text_sha256 string, spans string, rate string, copy string, fp string, component_id string, host string, g string, score string, doc string, t string"
EXTRA = tuple("x" * 15)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASH


def table(spark, rows):
    """documents with (doc_id, text, source), and many extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "en", s, None, *EXTRA) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [(1, "the same text " * 9, "a"), (2, "the same text " * 9, "b"), (3, None, None), (4, "", "a"), (5, long, "a"), (6, long + " end", None), (None, "the same text " * 9, "a"), (7, "only once", "b"), (7, "only once", "b"), (None, None, None), (8, " \n\t ", "a"), (9, "🦀 <|end|> ", "c")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


# ---- 1


def test_ordinal_fit_recovers_grades():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (600, 4))
    y = np.clip(x[:, 0] + x[:, 1], 0, 2)
    row, col = np.nonzero(x)
    m = fit_ordinal(row, col, np.ones(len(row)), y, 3, least_z=0)
    up = m.above(x[:, :4] @ m.weights[:4])
    assert m.thresholds[0] < m.thresholds[1] and ((up >= 0.5).sum(axis=1) == y).mean() > 0.97


def test_quality(spark, edge, empty):
    rng = random.Random(1)
    good = ["river stone cloud meadow", "tree bird song", "house garden path"]
    rows = [(i, " ".join(rng.choice(good) for _ in range(9)) + (" idiot" if i % 3 == 1 else " $$$!! @@@" if i % 3 == 2 else ""), "a") for i in range(300)]
    docs = table(spark, rows)
    ratings = spark.createDataFrame([(i, (2, 1, 0)[i % 3]) for i in range(200)] + [(None, 1), (5000, 1), (3, None)], "rated_id bigint, grade int")
    got = score_quality(docs, ratings, train_rows=150).select("_row.doc_id", "expected_grade", "tail_probability", "kept").collect()
    assert len(got) == 300 and np.mean([r["kept"] == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] >= 200]) > 0.95
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in got)
    assert score_quality(edge, ratings.limit(0)).filter("kept").count() == 12
    assert score_quality(edge, ratings).count() == 12
    assert score_quality(empty, ratings).count() == 0


def test_held_out_accuracy():
    """Fitted on four fifths of the labelled documents and judged on the others, five times."""
    from granary.llm import ordinal_quality as oq

    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT text, quality, toxic FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL ORDER BY doc_id").fetchall()
    found = [oq.features(t) for t, _, _ in rows]
    y = np.array([0 if q == 0 else 1 if t else 2 for _, q, t in rows])
    toxic = np.array([t for _, _, t in rows])
    fold = np.random.default_rng(0).integers(0, 5, len(rows))
    kept = np.zeros(len(rows), bool)
    for f in range(5):
        train = np.flatnonzero(fold != f).tolist()
        row = np.repeat(np.arange(len(train)), [len(found[i]) for i in train])
        col, val = (np.fromiter((x for i in train for x in (found[i] if k == 0 else found[i].values())), kind) for k, kind in ((0, np.int64), (1, float)))
        m = oq.fit_ordinal(row, col, val, y[train], 3, most_share=0.1, balance=0.5)
        for i in np.flatnonzero(fold == f).tolist():
            kept[i] = m.above(np.array([sum(float(m.weights[k]) * v for k, v in found[i].items())]))[0, 1] >= 0.5
    assert kept[y == 2].mean() >= 0.98 and (~kept[y == 0]).mean() >= 0.97 and (~kept[toxic == 1]).mean() >= 0.9


def test_grades(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0), (None, 0), (1, None)], "q int, t int")
    assert [r[0] for r in df.select(Q.grade_of(F.col("q"), F.col("t"))).collect()] == [0, 0, 1, 2, None, None]


# ---- 2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/{n}">Menu {n}</a></ul></nav><!-- ad --><div class="ad">Buy {n}</div><div class="cookie-notice">We use cookies</div>
<{tag}><h2>Title&nbsp;{n} &amp; more</h2><p>First   para<b>graph</b>
of {n}<br>goes on<p>Second &lt;{n}&gt;<form><input value=1>Sign up</form></{end}><aside>Side {n}</aside><section id="comments"><p>Comment {n}</section><footer>&copy; {n}</footer>"""


@pytest.mark.parametrize("tag", ["article", "main", "div class='post-content'"])
def test_pages(spark, empty, tag):
    page = lambda n: PAGE.format(n=n, tag=tag, end=tag.split()[0])
    rows = [(i, "http://h.example/x" if i else None, page(i)) for i in range(12)] + [(20, "http://h.example/y", None), (21, "nonsense", ""), (22, "http://h.example/z", "<p>open <b>bold"), (23, "http://q.example/", "a < b <notatag & &unknown; <!-- open")]
    got = {r["page_id"]: r["text"] for r in html_x.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Title {i} & more\n\nFirst paragraph of {i} goes on\n\nSecond <{i}>"
    assert got[20] == "" and got[21] == "" and got[22] == "open bold" and got[23].startswith("a < b")
    assert html_x.extract_pages(empty.selectExpr("doc_id page_id", "text url", "text html")).count() == 0


def test_wrapper_finds_template_without_roles():
    pages = [f"<html><body><div><span>Home</span></div><div><p>Story number {i}, long enough to be the region of content here.</p><p>{'more ' * (i + 3)}</p></div><div><span>All rights</span></div></body></html>" for i in range(10)]
    assert html_x.extract_group(pages)[3] == "Story number 3, long enough to be the region of content here.\n\n" + "more " * 5 + "more"
    # Copies of one page are no evidence of a template.
    assert html_x.extract_group([pages[0]] * 30)[29].startswith("Story number 0") or "Story number 0" in html_x.extract_group([pages[0]] * 30)[29]


def test_copies_do_not_hide_the_template(spark):
    rows = [(i, "http://h.example/x", f"<article><div>Same words</div><p>Story {i}</p></article>") for i in range(20)]
    copies = [(100 + i, "http://h.example/x", rows[0][2]) for i in range(3000)]
    kind = "page_id bigint, url string, html string"
    few = {r["page_id"]: r["text"] for r in html_x.extract_pages(spark.createDataFrame(rows, kind)).collect()}
    got = html_x.extract_pages(spark.createDataFrame(rows + copies + copies[:1], kind)).collect()
    many = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 3021 and few == {i: f"Story {i}" for i in range(20)}
    assert all(many[i] == few[i] for i in few) and all(many[i] == "Story 0" for i, _, _ in copies)


def test_deep_and_broken_html():
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    assert html_x.extract_group([deep])[0] == "core"
    for n in (130, 20_000):
        page = "<div id=page><article><p>Start</p>" + "<div>" * n + "A<nav>Menu</nav><p>C<p>D" + "</div>" * n + "<p>B</p></article><p>outside</p></div>"
        assert html_x.extract_group([page]) == ["Start\n\nA\n\nC\n\nD\n\nB"]
        assert html_x.extract_group(["<b>x " * n + "<p>end"])[0].endswith("x\n\nend")
    a, b, c, d = (html_x.own_text(html_x.parse(x)) for x in ("<p> one <b>t</b>wo <i> </i>\nthree</p>", "<div><div>one two<u> three</u> </div></div>", "one twothree", "one three two"))
    assert a == b and a[0] == 13 and len({b, c, d}) == 3
    assert html_x.extract_group(["<script>x", "<", "<!--", None, "</p></div>text"]) == ["", "<", "", "", "text"]


def random_tree(rng, depth=4):
    x = html_x.Node(rng.choice(["div", "p", "ul", "b"]))
    x.items = [random_tree(rng, depth - 1) if rng.random() < 0.7 else f"t{rng.randrange(5)}" for _ in range(rng.randrange(0, 5))] if depth else ["leaf"]
    return x


def as_wrapper(x):
    w = html_x.Wrapper(x.label)
    w.children = [as_wrapper(c) for c in html_x._kids(x)]
    return w


def best_match(w, x):
    """Simple tree matching over runs of equal siblings, by trying every order-preserving match."""
    left, right = html_x._wrapper_runs(w.children), html_x._runs(html_x._kids(x))

    def best(i, j):
        if i == len(left) or j == len(right):
            return 0
        out = max(best(i + 1, j), best(i, j + 1))
        if left[i][0].label == right[j][0].label:
            out = max(out, best_match(left[i][0], right[j][0]) * min(len(left[i]), len(right[j])) + best(i + 1, j + 1))
        return out

    return 1 + best(0, 0)


def test_tree_matching_against_brute_force(monkeypatch):
    rng = random.Random(4)
    for _ in range(150):
        a, b = random_tree(rng), random_tree(rng)
        b.tag = b.label = a.label
        assert html_x.Matcher().similarity(as_wrapper(a), b) == best_match(as_wrapper(a), b)
        w, at = as_wrapper(a), {}
        html_x.align(w, b, at)
        assert len(at) == len([x for x in html_x._below(b) if x.tag not in html_x.VOID]) and all(v.label == x.label for x in html_x._below(b) for v in [at[id(x)]])
        assert html_x.Matcher().similarity(w, b) == best_match(w, b) == best_match(as_wrapper(b), b)


def test_width_does_not_change_the_match(monkeypatch):
    """The way long lists are matched gives the very match, ties included, that short lists get, whatever is held or compared at once."""
    rng = random.Random(8)

    def edited(x):
        y = html_x.Node(x.tag)
        y.items = [c if isinstance(c, str) else edited(c) for c in x.items if rng.random() > 0.1] + [random_tree(rng, 1) for _ in range(rng.randrange(2))]
        return y

    def places(w, b):
        left, right = html_x._wrapper_runs(w.children), html_x._runs(html_x._kids(b))
        return [(a and id(a[0]), x and id(x[0])) for a, x in html_x.Matcher().matched(left, right)]

    for k in range(60):
        a, b = html_x.Node("div"), html_x.Node("div")
        a.items = [random_tree(rng, 2) for _ in range(rng.randrange(40))]
        b.items = [edited(c) for c in a.items if rng.random() > 0.1] if k % 3 else [random_tree(rng, 2) for _ in range(rng.randrange(40))]
        w = as_wrapper(a)
        monkeypatch.setattr(html_x, "PAIRS", 1 << 40)
        want = places(w, b), html_x.Matcher().similarity(w, b)
        monkeypatch.setattr(html_x, "PAIRS", 0)
        for short, known in ((64, 1 << 20), (2, 1 << 20), (64, 1)):
            monkeypatch.setattr(html_x, "SHORT", short)
            monkeypatch.setattr(html_x, "KNOWN", known)
            assert (places(w, b), html_x.Matcher().similarity(w, b)) == want


def test_width_does_not_change_the_text(monkeypatch):
    """Pages of 150 blocks in any order, beyond 4,096 pairs of runs: the wrapper is the one of exact matching."""
    rng = random.Random(1)
    parts = ["<p>x", "<h2>t</h2>", "<ul><li>a<li>b</ul>", "<p>x <b>y</b> <a>z</a>", "<table><tr><td>1</table>", "<h3>q</h3>"]
    pages = ["<body><div class=c>" + "".join(rng.choice(parts) for _ in range(150)) + "</div></body>" for _ in range(16)]
    got = html_x.extract_group(pages)
    monkeypatch.setattr(html_x, "PAIRS", 1 << 40)
    assert got == html_x.extract_group(pages)


def test_wrapper_alone_tells_articles(spark):
    """Without any role: class words unknown and articles, menus and footers all called div, the wrapper finds the article also where a page's advert is longer."""
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    texts = [words(1 if i % 7 == 0 else 60) for i in range(40)]
    pages = [f"<body><div><ul>{''.join(f'<li><a href=/{words(1)}>{words(1)}</a></li>' for _ in range(6))}</ul></div><div class=x>{words(8)}</div><div class=y><h1>T{i}</h1><p>{t}</p></div><div class=z>Our site. {words(3)}</div></body>" for i, t in enumerate(texts)]
    want = [f"T{i}\n\n{t}" for i, t in enumerate(texts)]
    assert html_x.extract_group(pages) == want
    assert sum(a != b for a, b in zip(html_x.extract_group(pages, induce=False), want)) >= 5


def test_names_and_hidden_elements():
    assert html_x.noise_names("share-price") == html_x.noise_names("search-results") == html_x.noise_names("article-body shareholder") == frozenset()
    assert html_x.noise_names("share-buttons ad-slot-3 post-comments") >= {"share", "ad", "comments"}
    page = "<article><p>One</p><div class='share-price'>Price 3</div><div class=search-results>Found 4</div><div hidden>no</div><div style='color:red; display : none'>no</div><p data-hidden=1>Two</p><div class='share-links'>no</div></article>"
    assert html_x.extract_group([page]) == ["One\n\nPrice 3\n\nFound 4\n\nTwo"]


def test_wide_pages_are_linear():
    import time

    wide = lambda n, k: "<article>" + "".join(f"<p>a{i}{k}</p><ul><li>b{i}</ul>" for i in range(n)) + f"<table><td>{k}</table></article>"
    took = []
    for n in (2000, 8000):
        began = time.process_time()
        got = html_x.extract_group([wide(n, k) for k in range(2)] + [wide(n - 1, 3)])
        took.append(time.process_time() - began)
        assert len(got[0].split("\n\n")) == 2 * n + 1
    assert took[1] < 8 * took[0]


# ---- 3


@given(st.text(alphabet="<|[]/\\sINSTYSend>x \n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escaping_round_trip_in_python(s):
    # The patterns are plain enough to mean the same in Python and Java.
    done = re.sub(chat.CONTROLS, r"\1\2\\\3", s)
    assert not re.search(r"<\||</?s>|\[/?INST\]", done)
    assert re.sub(chat.ESCAPED, r"\1\2\3", done) == s


def test_chat(spark):
    rows = [(1, 1, "assistant", "b <|end|> c"), (1, 0, "user", None), (1, 0, None, "x"), (2, None, "assistant", "<\\|start|> [INST] </s>"), (None, 0, "assistant", "n"), (3, 0, "assistant", "a\n"), (3, 0, "assistant", "a\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, t string")
    got = {r["conv_id"]: [tuple(x) for x in r["ts"]] for r in chat.format_conversations(df).select("conv_id", chat.parse_formatted(F.col("formatted")).alias("ts")).collect()}
    assert got == {1: [("", "x"), ("user", ""), ("assistant", "b <|end|> c")], 2: [("assistant", "<\\|start|> [INST] </s>")], None: [("assistant", "n")], 3: [("assistant", "a\n")] * 2}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "s3://a.png", 56, 57, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), ("image", None, None, None, None, None, None), ("odd", "<|end|>", None, None, None, None, None), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df, "parts").select("*", chat.parse_formatted(F.col("formatted")).alias("ts")).first()
    assert r["formatted"] == "<|start|>user<|body|>see <|image:0:6|><|audio:1:50|><|document:2:1536|><|image:3:1|><\\|end|><|end|><|start|>assistant<|body|><|end|>"
    assert [(a["index"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "s3://a.png", 6), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 1536), (3, "image", None, 1)]
    assert r["n_attachment_tokens"] == 1593 and [tuple(t) for t in r["ts"]] == [("user", "see <|end|>"), ("assistant", "")]


@given(st.lists(st.sampled_from(["<", "|", "end", "|>", "<|end|><", "|start|>assistant<", "|body|>evil", "\\", "[", "INST]", "/s>", chat.MARK, "+image:0:1", "-", None]), max_size=8), st.sets(st.integers(0, 8), max_size=3))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_no_control_string_from_several_parts(spark, texts, images):
    """However a text is cut into parts, and wherever attachments stand between, the turn comes back as it was."""
    parts = []
    for i, t in enumerate(texts):
        parts += [("image", "<|end|>", "r", 1, 1, None, None)] * (i in images) + [("text", t, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "fine", None, None, None, None, None)])], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df, "parts").select("*", chat.parse_formatted(F.col("formatted")).alias("ts")).first()
    assert [tuple(t) for t in r["ts"]] == [("user", "".join(t or "" for t in texts)), ("assistant", "fine")]
    n = sum(i in images for i in range(len(texts)))
    assert [a["index"] for a in r["attachments"]] == list(range(n)) and len(re.findall(r"<\|image:[0-9]+:1\|>", r["formatted"])) == n


# ---- 4


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_exact_dedup(edge, empty, limit):
    got = exact_dedup(edge, broadcast_limit_bytes=limit).select("_row.doc_id", "_row.text", "_row.kept", F.col("kept").alias("k"), "keep_id", "group_size", "text_sha256").collect()
    assert len(got) == 12 and all(r[2] == "x" for r in got)
    by = {}
    for r in got:
        by.setdefault(r["text"] or "", []).append(r)
    for text, rows in by.items():
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert {r["keep_id"] for r in rows} == {max(ids, default=None)} and {r["group_size"] for r in rows} == {len(rows)}
        assert sum(r["k"] for r in rows) == 1 and [r["doc_id"] for r in rows if r["k"]] == [max(ids, default=None)]
        assert {r["text_sha256"] for r in rows} == {hashlib.sha256(text.encode()).hexdigest()}
    assert exact_dedup(empty, broadcast_limit_bytes=limit).count() == 0


def test_rows_that_pass_the_filter_never_move(spark):
    from granary.llm import exact_dedup as dedup

    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 50_000).cast("string")).alias("text"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (64 << 20, 4096 * 2):  # 10,000 texts repeat: five segments, in three scans with the smaller limit
            probed = dedup.possibly_repeated(docs, broadcast_limit_bytes=limit)
            plan = probed._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"(?<!Broadcast)Exchange", plan) and plan.count("BroadcastHashJoin") == (1 if limit > 1 << 20 else 3)
            r = probed.agg(F.count(F.lit(1)).alias("n"), F.count_if("_maybe").alias("maybe")).first()
            assert r["n"] == 60_000 and 20_000 <= r["maybe"] < 20_800
            r = dedup.exact_dedup(docs, broadcast_limit_bytes=limit).agg(F.count_if(F.col("kept")).alias("kept"), F.max("group_size").alias("most")).first()
            assert (r["kept"], r["most"]) == (50_000, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ties_are_decided_by_content(spark):
    docs = spark.createDataFrame([(1, "t", c) for c in "abcab"] + [(2, "u", None), (2, "u", None), (1, "u", "z"), (None, "v", "p"), (None, "v", "q")], "doc_id bigint, text string, extra string")
    def kept(df):
        return sorted(((r[0], r[1], r[2]) for r in exact_dedup(df).filter("kept").select("_row.doc_id", "_row.text", "_row.extra").collect()), key=str)

    first = kept(docs)
    assert [x[:2] for x in first] == [(1, "t"), (2, "u"), (None, "v")] and all(kept(docs.repartition(n)) == first for n in (1, 3))
    assert exact_dedup(docs).count() == 10


# ---- 5


def test_base_patterns():
    t = 'password = "short" Token:abcdefgh1 secret=token:abcdefghij api_key="AKIAABCDEFGHIJKL" ' + "f" * 31 + " " + "0f" * 16 + " AKIA123 ſecret=abcdefgh"
    got = [(sec.KINDS[k], t[a:b]) for a, k, b in sec.base_spans(t)]
    assert got == [("assign", "Token:abcdefgh1"), ("assign", 'api_key="AKIAABCDEFGHIJKL'), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0f" * 16)]


def test_markov_on_held_out_samples():
    evidence = sec.train(sec.labelled_samples(11))
    hit = [bool(sec.model_spans(s, evidence)) == bool(y) for s, y in sec.labelled_samples(seed=77, n=800)]
    assert np.mean(hit) > 0.99


def test_markov_on_held_out_documents():
    """Fitted on a part of the documents, the models alone find the secrets of the others, and nothing else."""
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' ORDER BY hash(doc_id)").fetchall()
    texts = [t or "" for (t,) in rows]
    evidence = sec.train(sec.labelled_samples(), sum(sec.labelled_counts(t) for t in texts[:2000]))
    planted = found = spans = wrong = 0
    for t in texts[2000:]:
        base, got = sec.base_spans(t), sec.model_spans(t, evidence)
        planted += sum(k == 0 for _, k, _ in base)
        found += sum(any(u < end and start < v for u, _, v in got) for start, k, end in base if k == 0)
        spans += len(got)
        wrong += sum(not any(u < end and start < v for start, _, end in base) for u, _, v in got)
    assert planted > 100 and found >= 0.98 * planted and wrong <= 0.02 * spans


def test_stretches_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        bits = rng.normal(size=30)
        got = sec.stretches(bits, 5, 2.0)
        best = max(((bits[a:b].sum(), -a, -b) for a in range(30) for b in range(a + 1, 31)))
        assert bool(got) == (best[0] >= 2) and (not got or abs(bits[got[0][0] - 5 : got[0][1] - 5].sum() - best[0]) < 1e-9)


BASE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), kinds(k, kind, p, least) AS (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?[A-Za-z0-9+/_.=-]+', 8),
  (1, 'access', 'AKIA[A-Z0-9]+', 16), (2, 'hex', '[0-9a-f]+', 32)
), m AS (SELECT doc_id, k, kind, least, regexp_extract_all(t, p) AS found, regexp_split_to_array(t, p) AS gaps FROM d, kinds),
x AS (SELECT doc_id, k, kind, least, i, found[i] AS s, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda f: length(f))), 0) AS start FROM m, LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i)),
ok AS (SELECT *, start + length(s) AS stop FROM x WHERE length(CASE WHEN k = 0 THEN regexp_extract(s, '^[A-Za-z_]+?["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE s END) >= least)
SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k), '')) AS base_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN ok USING (doc_id) GROUP BY doc_id
"""


def test_base_columns_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted((a, int(b or 0), int(c or 0), int(d or 0), e) for a, b, c, d, e in con.sql(BASE_SQL).fetchall())
    got = Q.op5_secret_scan(spark, folder)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()) == want
    assert got.filter("spans LIKE '%markov%'").count() > 0


def test_secrets(edge, empty, spark):
    docs = table(spark, [(1, "key Zx9Qw7Lk2Vb8Nm4Tr6Yp1Hs5 and my_long_identifier_name_2024_value", "a"), (2, None, "a"), (3, "see lib/path/Zx9Qw7Lk2Vb8Nm4Tr6Yp1Hs5 or kQzXvBnMwRtYpLdFgHsJcUiOeA", "a")])
    got = {r[0]: [tuple(x) for x in r[1]] for r in sec.scan_secrets(docs).collect()}
    assert got[2] == [] and got[1] == [("markov", 4, 28)]
    assert [k for k, _, _ in got[3]] == ["markov"] * 2 and all(abs(a - b) <= 2 for (_, u, v), w in zip(got[3], [(13, 37), (41, 67)]) for a, b in zip((u, v), w))
    assert sec.scan_secrets(edge).count() == 12 and sec.scan_secrets(empty).count() == 0


# ---- 6


def test_poisson(edge, empty, spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 3000, "big").when(F.col("id") < 3990, "small").otherwise(None).alias("source"), F.lit("x").alias("rate"))
    got = poisson_mix(docs, weights={"big": 1, "small": 1, "null": 2}, total=8000)
    n = {r["source"]: r["n"] for r in got.groupBy("_row.source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(n[s] - m) < 5 * m**0.5 for s, m in {"big": 2000, "small": 2000, None: 4000}.items())
    keys = [r[0] for r in got.select("shuffle_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    again = poisson_mix(docs.repartition(7), weights={"big": 1, "small": 1, "null": 2}, total=8000)
    assert got.exceptAll(again).count() == 0 and again.count() == got.count()
    assert set(poisson_mix(docs, weights={"small": 1}).select("_row.source").distinct().collect()) == {("small",)}
    assert poisson_mix(docs, weights={}).count() == 0 and poisson_mix(empty).count() == 0
    assert poisson_mix(edge).select("_row.*").columns == edge.columns


# ---- 7


def brute_top(rows, queries, k):
    out = []
    for qid, q in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid)[:k]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_search(spark, empty):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 16)).astype(np.float32)
    base[1000:2000] = base[0]  # a third of all vectors are the same
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    bad = [(5000, None), (5100, [1.0, None]), (5200, [float("nan")] * 16), (5300, [float("inf")] * 16), (None, rows[0][1]), (5400, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id bigint, embedding array<float>, score string").repartition(3)
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows] + [(5400, [])]
    queries = {i: v for i, v in whole if i % 100 == 0}
    got = sorted(tuple(r) for r in search(df, df.filter("vec_id % 100 = 0"), k=10).collect())
    assert got == brute_top(whole, queries, 10)
    few = df.filter("vec_id IN (0, 1, 2)")
    assert search(few, few.filter("vec_id = 0")).count() == 2
    assert search(df.limit(0), df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e14] * 4), (1, [1e14] * 4)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        search(huge, huge).collect()


def test_essential_terms_follow_the_threshold(monkeypatch):
    from granary.llm import maxscore as M

    monkeypatch.setattr(M, "BLOCK", 512)
    monkeypatch.setattr(M, "STEP", 8)
    rng = np.random.default_rng(0)
    columns = np.floor(1024 * rng.normal(size=(32, 6000)) * np.linspace(0.1, 2, 32)[:, None])
    query = np.floor(1024 * rng.normal(size=32))
    work = []
    got = M.top_k(np.arange(6000), columns, -1, query, 10, work=work)
    score = query @ columns
    assert got == [(int(i), int(score[i])) for i in np.lexsort((np.arange(6000), -score))[:10]]
    splits = [s for _, s, _ in work]
    assert splits[0] == 32 and all(a >= b for a, b in zip(splits, splits[1:])) and splits[-1] < 16
    assert sum(made for _, _, made in work) < 0.7 * 32 * 6000
    # Ids may repeat; a threshold that nothing can reach ends the search.
    assert M.top_k(np.array([3, 3, 1]), np.array([[1.0, 1.0, 1.0]]), 1, np.array([2.0]), 2) == [(3, 2), (3, 2)]
    assert M.essential_terms(np.array([9.0, 5.0, 2.0, 0.0]), -4.0, 1.0) == 2 and M.essential_terms(np.array([9.0, 5.0, 2.0, 0.0]), -4.0, None) == 3


# ---- 8


def test_sentencepiece_parity():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.SENTENCEPIECE_MODEL)
    codec = spm.Codec(open(Q.SENTENCEPIECE_MODEL, "rb").read())
    rng = random.Random(9)
    texts = ["", " ", "  a", "Hello  world.\n\n\tx", "</s><s><unk> <0x0A>", "日本語 ж😀", "▁x ▁▁", "a" * 700, "x\x00y", *[" " * n + "the" for n in range(45)]]
    texts += ["".join(rng.choices("abc  \n▁é日😀THE", k=rng.randint(1, 200))) for _ in range(200)]
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == sp.encode(texts)
    # A marker in the text comes back as a space, which is reported.
    assert all(codec.round_trips(t, g.tolist()) == (spm.META not in t) for t, g in zip(texts, got))
    assert [codec.decode(g.tolist()) for g in got] == [sp.decode(g.tolist()) for g in got]


def proto(pieces, kind, **norm):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    def number(n, v):
        return varint(n << 3) + varint(v)

    out = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, t)) for p, s, t in pieces)
    out += field(2, number(3, kind) + number(35, 1) + number(40, 0) + number(41, 1) + number(42, 2))
    return out + field(3, number(3, norm.get("prefix", 1)) + number(4, norm.get("trim", 0)) + number(5, 1))


@pytest.mark.parametrize("trim", [0, 1])
def test_unigram_model(trim):
    import sentencepiece

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", -9.0, 6) for i in range(256)], *[(p, s, 1) for p, s in (("▁", -3), ("a", -4), ("b", -4.5), ("c", -5), ("ab", -4.2), ("▁ab", -4.1), ("bc", -6), ("abc", -7.9), ("▁c", -5.5))]]
    data = proto(pieces, spm.UNIGRAM, trim=trim)
    codec, sp = spm.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["abc ab", "cabab  abc", " abcabc", "aéb", "", "b a", "c  "]
    assert [g.tolist() for g in codec.encode(texts)] == sp.encode(texts)


def test_encode_documents(edge, empty, spark):
    got = spm.encode_documents(edge, Q.SENTENCEPIECE_MODEL)
    rows = got.collect()
    assert len(rows) == 12 and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert sorted(r["decoded_sha256"] for r in rows) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in edge.collect())
    text = {r["doc_id"]: r["text"] for r in spm.decode_documents(got, Q.SENTENCEPIECE_MODEL).collect()}
    assert text[9] == "🦀 <|end|> " and text[3] == ""
    assert spm.encode_documents(empty, Q.SENTENCEPIECE_MODEL).count() == 0


# ---- 9


def links(fps, budget, full=None):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i + 1, len(fps)):
            d = [bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in zip(fps[i], fps[j])]
            if d[0] <= budget and (full is None or sum(d) <= full):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 127), max_size=9)), min_size=2, max_size=60), st.sampled_from([(2, None), (5, None), (13, None), (3, 4)]), st.sampled_from([4, 1 << 16]), st.booleans())
@settings(max_examples=60, deadline=None)
def test_trie_join_against_brute_force(picks, setting, leaves, split):
    budget, full = setting
    base = np.random.default_rng(2).integers(0, 2**63, 4, dtype=np.uint64)
    fps = sorted({(int(base[b]) ^ sum(1 << k for k in set(flips) if k < 64), sum(1 << (k - 64) for k in set(flips) if k >= 64)) for b, flips in picks})
    x = np.array(fps, np.uint64).reshape(-1, 2)
    up = list(range(len(x)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    old, sim.LEAVES = sim.LEAVES, leaves
    try:
        m = len(x) // 2
        found = trie_links(x, None, budget, full)
        if split:
            found = trie_links(x[:m], None, budget, full) + [(i + m, j + m) for i, j in trie_links(x[m:], None, budget, full)] + [(i, j + m) for i, j in trie_links(x[:m], x[m:], budget, full)]
        assert split or len({root(i) for i in range(len(x))}) - len(found) >= 1
        for i, j in found:
            up[max(root(i), root(j))] = min(root(i), root(j))
    finally:
        sim.LEAVES = old
    assert [root(i) for i in range(len(x))] == links(fps, budget, full)


def test_views_miss_nothing_within_the_budget():
    rng = np.random.default_rng(1)
    for budget in (0, 1, 2, 7, 20):
        views = block_views(budget)
        assert sorted(b for v in views for b in v.bits) == list(range(64))
        x = rng.integers(0, 2**63, (200, 1), dtype=np.uint64)
        y = x.copy()
        for r in range(200):
            for b in rng.choice(64, budget, replace=False):
                y[r, 0] ^= np.uint64(1 << int(b))
        assert np.any([v.lead(x) == v.lead(y) for v in views], axis=0).all()
    # Sampled views: no more pairs at the stated share of differing bits are missed than asked for.
    views = sample_views(1 << 20, 4, 0.15, 0.01)
    x = rng.integers(0, 2**63, (3000, 4), dtype=np.uint64)
    flips = np.packbits(rng.random((3000, 256)) < 0.15, axis=1).view(">u8").astype(np.uint64)
    assert len(views[0].bits) == 10 and 1 - np.any([v.lead(x) == v.lead(x ^ flips) for v in views], axis=0).mean() < 0.05
    assert sample_views(100, 4, 0.15, 0.01)[0].bits == ()


def test_equal_first_words_stay_small():
    """Rows that agree in the whole first word are one node of its trie: they are compared in tiles, and joined ones are skipped."""
    import resource

    rng = np.random.default_rng(3)
    x = np.column_stack([np.full(6000, 5, np.uint64), *(rng.integers(0, 2**63, 6000, dtype=np.uint64) & np.uint64(15) for _ in range(3))])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(trie_links(x, None, 20, 60)) == 5999
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 200
    # Without any link all pairs are looked at, still in tiles.
    far = np.column_stack([np.full(3000, 5, np.uint64), *(rng.integers(0, 2**63, 3000, dtype=np.uint64) for _ in range(3))])
    assert trie_links(far, None, 20, 20) == []
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 200


def test_fingerprint_definition():
    import xxhash

    t = "The Quick\tbrown fox THE end É"
    words = ["the", "quick", "brown", "fox", "the", "end", "É"]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(5)]
    assert shingle_hashes(t, 3).tolist() == h
    assert majority(shingle_hashes(t, 3))[0] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 5)
    assert majority(shingle_hashes(" \n", 3)) == [0] and majority(shingle_hashes(None, 3)) == [0]


def test_simhash(edge, empty, spark):
    got = simhash_components(edge).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r["fp"][0], []).append(r)
    assert {r["component_id"] for r in by[0]} == {3}  # null, empty and blank texts
    assert simhash_components(empty).count() == 0
    rng = random.Random(4)
    base = [[f"w{rng.randrange(900)}" for _ in range(400)] for _ in range(12)]
    rows = []
    for i in range(300):
        w = list(base[i % 12])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w), "a"))
    got = sorted((r["doc_id"], r["component_id"], tuple(r["fp"])) for r in simhash_components(table(spark, rows)).collect())
    assert [g[1] for g in got] == links([g[2] for g in got], 2)
    # Rows that share an id are rows of their own; a component is named by its smallest id.
    same = table(spark, [(7, rows[0][1], "a"), (7, rows[1][1], "a"), (3, rows[1][1], "a"), (9, rows[0][1], "a"), (None, rows[2][1], "a")])
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash_components(same).collect()) == [(-1, None), (3, 3), (7, 3), (7, 7), (9, 7)]


@pytest.mark.parametrize("chunk", [4096, 16])
def test_linked_nodes_in_chunks(spark, monkeypatch, chunk):
    """Subtrees of many chunks give the components of brute force, groups of near copies and loose rows alike."""
    monkeypatch.setattr(sim, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 6)
    fps = sorted({int(base[k % 6]) ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False))) for k in range(400)})
    table_ = spark.createDataFrame([(i, [f]) for i, f in enumerate(fps)], "node bigint, fp array<bigint>")
    for views, budget in ((block_views(2), 2), ([sim.View(())], 2), ([sim.View((0, 1))], 2)):
        roots = dict(tuple(r) for r in sim.linked_roots(table_, views, budget).collect())
        want = links([(f,) for f in fps], budget)
        got = [roots.get(i, i) for i in range(len(fps))]
        if views[0].bits != (0, 1):
            assert got == want
        assert all(want[i] == want[g] for i, g in enumerate(got))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}
    # Many partitions, so that no task sees a whole component; two parents of a node; repeated edges.
    rng = random.Random(2)
    odd = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 901), (900, 902), (900, 901)]
    up = {x: x for e in odd for x in e}
    for a, b in odd:
        old, new = max(up[a], up[b]), min(up[a], up[b])
        up = {k: new if v == old else v for k, v in up.items()}
    rows = [tuple(r) for r in connected_components(spark.createDataFrame(odd, "a bigint, b bigint").repartition(40)).collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == {k: v for k, v in up.items() if any(a != b and k in (a, b) for a, b in odd)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- 10


def brute_cut(rows, depth):
    out, seen = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        hit = [any(s < i for s in seen.get(b[k : k + depth], ())) for k in range(max(0, len(b) - depth + 1))]
        gone = np.zeros(len(b), bool)
        for k, h in enumerate(hit):
            if h:
                gone[k : k + depth] = True
        for k in range(max(0, len(b) - depth + 1)):
            seen.setdefault(b[k : k + depth], set()).add(i)
        out.setdefault((i, len(b), int(gone.sum())), []).append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("crowded", [64, 1])
def test_remove_repeats(spark, edge, empty, crowded, monkeypatch):
    from granary.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rng = random.Random(8)
    shared = ["".join(rng.choices("ab ", k=rng.randint(20, 200))) for _ in range(6)] + ["=" * 300, "é" * 60]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choices("abcdé ", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (50, rows[5][1]), (202, None)]
    got = {}
    for r in remove_repeats(table(spark, [(i, t, "a") for i, t in rows]).repartition(5), depth=50, gram=16).collect():
        got.setdefault((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"])), []).append(bytes(r["kept"]))
    want = brute_cut(rows, 50)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_radix_groups_against_brute_force():
    from granary.llm import suffix_dedup as S

    rng = np.random.default_rng(9)
    for depth in (3, 8, 11, 50):
        for alphabet in (1, 2, 4):
            buf = rng.integers(97, 97 + alphabet, 400).astype(np.uint8)
            at = np.sort(rng.choice(400 - depth + 1, 200, replace=False))
            bucket = rng.integers(0, 2, 200)
            left, group = S.radix_groups(buf, at, bucket, depth)
            by = {}
            for i, (a, b) in enumerate(zip(at.tolist(), bucket.tolist())):
                by.setdefault((b, buf[a : a + depth].tobytes()), []).append(i)
            want = [sorted(v) for _, v in sorted(by.items()) if len(v) > 1]
            assert [sorted(left[group == g].tolist()) for g in np.unique(group)] == want
    assert S.radix_groups(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), 50)[0].tolist() == []


def test_remove_repeats_with_extreme_ids(spark):
    """Repeated ids and ids at the ends of their type come back as they are."""
    t = "x" * 30 + "a long passage that two of the documents share, word for word, to its end" + "y" * 30
    for more in ([], [(2**63 - 1, t), (2**62 + 5, "z" + t), (-(2**63), "short")]):
        rows = [(2**63 - 1, t), (-(2**63), "q" + t), (4611686018427387909, t[:90]), (0, t[20:]), *more]
        got = sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in remove_repeats(table(spark, [(i, x, "a") for i, x in rows]).repartition(3)).collect())
        want = sorted((i, n, cut, kept) for (i, n, cut), each in brute_cut(rows, 50).items() for kept in each)
        assert got == want


def test_remove_repeats_edges(edge, empty):
    got = remove_repeats(edge).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 7)}
    assert len(got) == 12 and by[1]["spans"] == [] and bytes(by[2]["kept"]) == b"" and by[3]["n_bytes"] == 0
    # The words repeat within the long text, so the space after its last word is in it too.
    assert bytes(by[6]["kept"]) == b"end" and all(not r["spans"] for r in got if r["doc_id"] in (None, 7))
    assert remove_repeats(empty).count() == 0


# ---- the pipeline and the registry


def test_registry_and_sql(spark):
    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    names = Q.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    for name, sql in Q.oracle_sql().items():
        df = names[name](spark, folder)
        cols = sorted(df.columns)
        r = con.execute(sql)
        at = [[d[0] for d in r.description].index(c) for c in cols]
        assert sorted(repr(list(x)) for x in df.select(*cols).collect()) == sorted(repr([x[i] for i in at]) for x in r.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "tokens"]
    kept = []
    for name, stage in P.STAGES:
        before = docs
        docs = P.materialize(stage(spark, docs, folder), name)
        if name != "tokens":
            assert docs.columns == columns
        kept.append(docs.count())
        if name == "exact_dedup":
            assert docs.groupBy("text").count().filter("count > 1").count() == 0 and docs.select("text").distinct().count() == before.select("text").distinct().count()
    assert kept[0] >= kept[1] >= kept[2] and kept[3] == kept[4]
    assert docs.filter("NOT round_trip").count() == 0
    assert stage(spark, before.limit(0), folder).count() == 0
    empty = before.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder).count() == 0


@pytest.mark.parametrize("shingles", [1 << 19, 2000])
def test_near_dedup_is_by_similarity(spark, monkeypatch, shingles):
    """Pairs of all similarities around the limit, against brute force over words; also with components in several chunks."""
    import corpus_pipeline as P

    monkeypatch.setattr(sim, "SHINGLES", shingles)
    rng = random.Random(8)
    rows = []
    for n in range(80):
        base = [f"w{rng.randrange(5000)}" for _ in range(304)]
        rows.append((len(rows), " ".join(base), "a"))
        for _ in range(2):
            # One changed word in ten breaks five of 300 shingles.
            w = list(base)
            for k in range(2 + n % 14):
                w[10 + 20 * k] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w), "a"))
    rows += [(None, rows[0][1], "a"), (1000, None, "a"), (1001, " ", "a"), (1002, "few words", "a"), (1003, "few  words", "a")]
    sets = []
    for i, t, _ in rows:
        w = (t or "").split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
    up = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and len(a & b) / len(a | b) >= 0.8:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = {k: new if v == old else v for k, v in up.items()}
    want = [i for i, _ in sets if up[i] == i]
    got = [r["doc_id"] for r in P.near(spark, table(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # There is something to confirm: the candidates' budgets join more.
    fps = sim.fingerprints(table(spark, rows), width=5, n_words=4).filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"))
    coarse = sim.linked_roots(fps, [sim.View(())], 19, 58).filter("node <> root").count()
    assert fps.count() - coarse < len(want) - 1


def test_pipeline_against_brute_force(spark):
    """Each stage's rows, from what its predecessor kept, against a plain version over all rows of the smallest tables."""
    import sentencepiece

    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    docs = P.materialize(P.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), "q")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{folder}/labels.parquet'").fetchall()
    assert sum(i in rows for i, q, t in labels if q == 1 and t == 0) >= 0.95 * sum(q == 1 and t == 0 for _, q, t in labels)

    docs = P.materialize(P.exact(spark, docs, folder), "e")
    last = {}
    for i, t in sorted(rows.items()):
        last[t] = i
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(last.values())

    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for t, i in last.items() for w in [t.encode().lower().split()]}
    up = {i: i for i in sets}
    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.8:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = {k: new if v == old else v for k, v in up.items()}
    docs = P.materialize(P.near(spark, docs, folder), "n")
    assert sorted(r["doc_id"] for r in docs.collect()) == [i for i in order if up[i] == i]

    left = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", left)
    want = sorted((r[0], r[1]) for r in con.sql(f"SELECT doc_id, copy FROM ({Q.OP6_SQL})").fetchall())
    docs = P.materialize(P.mix(spark, docs, folder), "m")
    assert sorted(r["doc_id"] for r in docs.collect()) == [i for i, _ in want]

    lib = sentencepiece.SentencePieceProcessor(model_file=Q.SENTENCEPIECE_MODEL)
    texts = dict(zip(left["doc_id"], left["text"]))
    for r in P.tokens(spark, docs, folder).collect():
        assert r["ids"] == lib.encode(texts[r["doc_id"]] or "") and r["round_trip"]


def test_pipeline_stages_with_odd_rows(spark, edge, empty):
    """Nulls, ties, repeated ids and clashing columns go through every stage; all but the last keep the columns."""
    import corpus_pipeline as P

    docs, counts = edge, []
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != "tokens":
            assert out.columns == edge.columns and out.dtypes == edge.dtypes
        counts.append(out.count())
        docs = out if name in ("exact_dedup", "near_dedup") or name == "mix" else docs if name == "quality" else out
    # Of 12 rows seven texts are different (null equals empty), of which the long two are near copies, and so are the two without words.
    assert counts[1:3] == [7, 5]


def test_near_dedup_goes_by_rows(spark):
    """Rows that share an id are dropped each for its own text; of equal rows one stays."""
    import corpus_pipeline as P

    words = [f"w{i}" for i in range(300)]
    t, other = " ".join(words), " ".join(f"v{i}" for i in range(300))
    rows = [(1, t, "a"), (2, t + " more", "a"), (2, other, "a"), (3, other + " end", "a"), (5, "alone", "b"), (5, "alone", "b"), (None, t, "a")]
    got = sorted(((r["doc_id"], r["text"]) for r in P.near(spark, table(spark, rows), "").collect()), key=str)
    assert got == sorted([(1, t), (2, other), (5, "alone"), (None, t)], key=str)


def test_large_group_of_near_copies(spark, monkeypatch):
    """A group that fills many chunks is joined through its smallest id; what that leaves is compared with all."""
    import corpus_pipeline as P

    monkeypatch.setattr(sim, "SHINGLES", 3000)
    monkeypatch.setattr(sim, "CHUNK", 64)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w), "a"))
    rows += [(1000 + i, " ".join(f"q{rng.randrange(10**9)}" for _ in range(100)), "a") for i in range(300)]
    kept = [r["doc_id"] for r in P.near(spark, table(spark, rows), "").collect()]
    assert sorted(kept) == [0, *range(1000, 1300)]


def test_jaccard_links():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint64)) for _ in range(300)]
    every, third = np.ones(300, bool), np.arange(300) % 3 == 0
    for probe, index in ((every, every), (third, ~third), (third, every)):
        want = [(i, j) for i in range(300) for j in range(300) if i != j and probe[i] and index[j] and len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
        a, b = sim._Labels(300), sim._Labels(300)
        for i, j in sim.jaccard_links(np.arange(300), sets, probe, index, 0.8):
            assert (i, j) in want or (j, i) in want
            a.link(i, j)
        for i, j in want:
            b.link(i, j)
        assert a.of.tolist() == b.of.tolist()
