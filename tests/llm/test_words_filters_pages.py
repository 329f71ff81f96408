"""Spelling variants, filter audit and page extraction against plain accounts of their contracts."""

import html
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_small_ops import LONG, ODD, words_of

from skirmish.llm import filter_audit, html_extract, spelling

SF = "/root/testdata/sf0.001"


# --- spelling variants -----------------------------------------------------------------------


def plain_variants(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            if less in n:
                near[w].add(less)
                near[less].add(w)
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return out


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("subtree", [3, 40, spelling.SUBTREE])
def test_variants_equal_brute_force(spark, docs, subtree):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdéÿ") for _ in range(rng.randint(7, 9))) for _ in range(30)]
    pool = base * 12 + ["Straße", "STRASSEN", "z" * 90, "z" * 91, "y" * 70 + "x", "y" * 70 + "w"] * 3
    for w in base:
        k = rng.randrange(len(w))
        pool += [w[:k] + rng.choice("abÿ") + w[k + rng.randint(0, 1) :]] * rng.randint(1, 2)
    # words of one vector that are near by a letter of the same group, and more than fit a subtree
    pool += ["weiß" + c + "àbc" for c in "àáâãäåæç"] * 2
    rows = [*ODD, (None, "grüßend GRüßend grüßend")]
    rows += [(i, " ".join(rng.choice(pool) for _ in range(40)).upper() if i % 3 == 0 else "-".join(rng.choice(pool) for _ in range(60))) for i in range(40)]
    want = plain_variants(rows)
    assert any(f for _, f, *_ in want) and any(k > 2 for *_, k, _ in want)
    got = variant_rows(spelling.variants(docs(rows, extra=True), subtree=subtree))
    assert got == sorted(want)


def test_chains_end_at_the_root(spark, docs):
    counts = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts)]
    want = plain_variants(rows)
    assert ("abcdefg", "abcdefgh", "abcdefghij", 2, 1, 20) in want
    assert variant_rows(spelling.variants(docs(rows))) == sorted(want)


def test_variants_of_no_words(spark, docs):
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([(1, "short words only"), (2, None)])).count() == 0


# --- filter audit ------------------------------------------------------------------------------


def fails_of(text, first_id, doc_id):
    w = words_of(text)
    out = {"A"} if len(w) < 100 else set()
    out |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    return out | ({"E"} if doc_id is not None and first_id is not None and doc_id > first_id else set())


def plain_audit(docs, labels):
    """One document and order at a time."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1}
    bad = {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for i, text, lang in docs:
        parts[lang or ""].append((i, fails_of(text or "", first.get(text or ""), i)))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(rows)))
            for step, f in enumerate(order):
                gone = [k for k in left if f in rows[k][1]]
                left = [k for k in left if f not in rows[k][1]]
                earlier = set(range(len(rows))) - set(left) - set(gone)
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left),
                    len(gone),
                    sum(f in rows[k][1] for k in earlier),
                    sum(fails == {f} for _, fails in rows),
                    sum(rows[k][0] in good for k in gone),
                    sum(rows[k][0] in bad for k in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(f"{'W' * (k % 4 == 1)}{rng.randrange(90 + 40 * (k % 3))}w" for _ in range(rng.choice([40, 120]))) for k in range(12)]
    texts += [t + " #" for t in texts[:5]] + [None, "", " \t", LONG]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(90)]
    rows += [rows[3], rows[3], (None, texts[0], "en"), (None, texts[0], "en"), (None, None, None), (1, texts[1], "fr"), (1, texts[2], "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("part", "mask", "digest", "n", "good", "toxic", "step"):
        d = d.withColumn(name, d["doc_id"].cast("string"))
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(d, m).collect()}
    # null doc_ids have no label
    want = plain_audit(rows, [x for x in labels if x[0] is not None])
    assert got == want


def test_audit_of_no_documents(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs([]), labels).count() == 0
    rows = filter_audit.audit(docs([(1, None)]), labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert all(r.removed == (r.filter_order[r.step - 1] == "A") for r in rows)


def test_min_plus_step_is_the_first_filter_that_fails():
    masks = np.arange(32)
    steps = filter_audit.removal_steps(masks)
    for o, order in enumerate(filter_audit.ORDERS):
        for m in masks:
            hit = [s for s, f in enumerate(order) if m >> "ABCDE".index(f) & 1]
            assert steps[m, o] == (hit[0] if hit else 5)


# --- page extraction -----------------------------------------------------------------------------


def test_messages_equal_enumeration():
    page = "<nav class=menu><a>x</a></nav><div><h1>One two</h1><p>Some text here.<p>More text.</div>"
    woods = html_extract.forest([html_extract.parse(page), html_extract.parse("<p>other</p>")])
    rng = np.random.default_rng(3)
    model = html_extract.Model(rng.normal(size=html_extract.FEATURES), rng.normal(size=(html_extract.GROUPS, 2, 2)))
    n = len(woods.x)
    unary = woods.x @ model.unary
    states = np.array(list(itertools.product([0, 1], repeat=n)))
    score = states @ unary
    for i in np.flatnonzero(woods.parent >= 0):
        score = score + model.pair[woods.group[i], states[:, woods.parent[i]], states[:, i]]
    weight = np.exp(score - score.max())
    weight /= weight.sum()
    content, edge = html_extract.marginals(model, woods)
    assert np.allclose(content, weight @ states)
    for i in np.flatnonzero(woods.parent >= 0):
        both = weight @ (states[:, woods.parent[i]] * states[:, i])
        assert np.isclose(edge[i, 1, 1], both)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = [" ".join(rng.choice(["rain", "river", "stone", "and", "the", "of"]) for _ in range(rng.randint(3, 60))).capitalize() + "." for _ in range(20)]
        rows.append((i, f"<body>{''.join(f'<p>{t}</p>' for t in text)}</body>"))
    return html_extract.fit(html_extract.labelled_pages(spark.createDataFrame(rows, "page_id long, html string")))


PAGE = """<!DOCTYPE html><html lang="en"><head><title>Rain</title><style>p{margin:0}</style></head><body class="ad-free">
<header class="site-header"><a href="/">The Site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this page.</p><button>OK</button></div>
<form action="/s"><label>Search</label><input name="q"><select><option>all</option></select></form>
<!-- <p>not this</p> --><script>var t = "</p><p>nor this";</script>
<div id="wrap"><article><h1>Rain &amp; stone</h1><p>The <b>river</b> runs&nbsp;\n  over the st<i>one</i> and the rain.<br>Then it &lt;stops&gt;.
<p>No end tag here, and a caf&eacute; &#233; &#x2014 too.<div class="ad">Buy the stone now.</div><ul><li>first<li>second</ul><p>Short.</p></article>
<aside class="sidebar"><h2>More</h2><p>Other texts of the site.</p></aside></div>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I like the river and the stone of it.</p></div></section>
<footer>&copy; The Site</footer>"""
TEXT = (
    "Rain & stone The river runs over the stone and the rain. Then it <stops>. "
    "No end tag here, and a café é — too. first second Short."
)


def test_page_by_hand(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<nav>only a menu</nav>"), (None, None, PAGE), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS text", "url AS n_chars", "url AS place")
    got = sorted((tuple(r) for r in html_extract.extract(pages, model).collect()), key=repr)
    want = [(i, u, TEXT if h == PAGE else "", len(TEXT) if h == PAGE else 0) for i, u, h in rows]
    assert got == sorted(want, key=repr)
    assert html_extract.extract(pages.limit(0), model).count() == 0


def test_whole_query_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(pages).count() == 0


def test_held_out_layouts(model):
    """Pages drawn from other texts: whole pages right, and characters."""
    rng = random.Random(9)
    right = kept = meant = got = 0
    for k in range(150):
        texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "of", "a"]) for _ in range(rng.randint(2, 50))) + "." for _ in range(15)]
        page = html_extract._Layout(texts, 1000 + k).page()
        tree = html_extract.parse(page)
        label = html_extract.forest([tree]).label
        truth = " ".join(" ".join(t for i, t, _ in tree.pieces if label[i]).split())
        found = html_extract.content_texts([re.sub(' data-main="."', "", page)], model)[0]
        a, b = Counter(truth.split()), Counter(found.split())
        right += truth.split() == found.split()
        kept, meant, got = kept + (a & b).total(), meant + a.total(), got + b.total()
    assert right >= 0.85 * 150 and kept >= 0.97 * meant and kept >= 0.97 * got


def test_odd_markup_ends(model):
    for junk in ("<" * 50_000, "<a " * 50_000, "<div>" * 50_000 + "x", "<p>" * 50_000, "<!--" * 50_000, "<b>" * 50_000, "</i>" * 50_000, "<script>" * 9, "<li>" * 20_000):
        assert len(html_extract.content_texts([junk], model)) == 1
    long = f"<article><h1>t</h1>{'<p>word word word.</p>' * 30_000}</article>"
    assert html_extract.content_texts([long], model)[0].count("word") == 90_000


def test_own_labelled_pages(spark):
    pages = [(k, f'<div class=x data-main="1"><p>text {k}</p></div><div class=x data-main="0"><a href=y>link {k}</a></div>') for k in range(20)]
    own = html_extract.fit(spark.createDataFrame(pages, "place long, html string"))
    assert html_extract.content_texts(["<div class=x><p>text</p></div><div class=x><a href=y>link</a></div>"], own) == ["text"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not there")
def test_driver_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub("<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())
