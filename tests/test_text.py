"""Page texts against a state machine, licence lines against exact counts, cosine search against all products."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.pages import ENTITIES, INLINE, UNSEEN, blocks, decoded, page_texts
from weftline.operators import redaction
from weftline.operators.redaction import frequent_shapes, licence_shapes, redacted
from weftline.operators.similarity import cosine_top_k
from weftline.sources.tables import table

SPACE = " \t\n\x0b\f\r"


def tag_end(html, at):
    """Where a tag that begins at `at` ends, quoted attributes passed over; None if it does not."""
    quote = None
    for i in range(at, len(html)):
        c = html[i]
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i + 1
    return None


def plain(text):
    out, i = "", 0
    while i < len(text):
        m = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);").match(text, i)
        known = None
        if m and m[1][0] == "#":
            n = int(m[1][2:], 16) if m[1][1] in "xX" else int(m[1][1:])
            known = chr(n) if 31 < n < 0xD800 or 0xDFFF < n < 0x110000 else None
        elif m:
            known = ENTITIES.get(m[1])
        out, i = (out + known, m.end()) if known is not None else (out + text[i], i + 1)
    return re.sub(f"[{SPACE}]+", " ", out).strip(" ")


def machine(html):
    """(block, text, link characters) of a page, one character after the other."""
    parts, links, i, linked = [""], [[]], 0, False
    while i < len(html):
        rest = html[i:]
        if rest.startswith("<!--"):
            end = html.find("-->", i + 4)
            i = len(html) if end < 0 else end + 3
            continue
        m = re.match(r"<(/?)([a-zA-Z][^\t\n\f\r />\"']*)", rest)
        name, end = (m[2].lower(), tag_end(html, i + 1)) if m else ("", None)
        if rest[:2] in ("<!", "<?"):
            end = html.find(">", i)
            i = len(html) if end < 0 else end + 1
        elif end and name in UNSEEN and not m[1] and rest[m.end()] in "\t\n\f\r />":
            shut = re.compile(rf"</{name}[\t\n\f\r ]*>", re.I).search(html, end)
            i = shut.end() if shut else len(html)
        elif end and name == "a":
            linked, i = not m[1], end
            if linked:
                links[-1].append("")
        elif end and name in INLINE.split("|"):
            i = end
        elif re.match("</?[a-zA-Z]", rest) and (end := tag_end(html, i + 1)):
            parts.append("")
            links.append([])
            linked, i = False, end
        else:
            parts[-1] += html[i]
            if linked:
                links[-1][-1] += html[i]
            i += 1
    found = [(k, plain(p), len(plain(" ".join(x)))) for k, (p, x) in enumerate(zip(parts, links))]
    return [(k, p, min(n, len(p))) for k, p, n in found if p]


ODD = [
    "", None, "no tags &amp; &lt;b&gt; &bogus; &#8364; &#x1F600; &#0; & &amp",
    '<p title="a > b">one</p><p title=\'<script>\'>two</p>',
    "<script>if (a < b) { x = '<p>no</p>' }</script>yes<SCRIPT src='x'>never</script >end",
    "<!-- <p>no</p> --><p>yes<!-- open <p>never", "<style>p{}</style><title>no</title><abc>x</abc>",
    "<ul><li><a href='/x'>link</a> and text <a href=y>more &amp; more</a></li></ul>tail<a>open link<p>next</p>", "a < b > c <3 </ p>", "<p>" + "word " * 20000 + "</p>", "<a-b>x</a-b><article>y</article><b>bold</b>er<br>line", "<p class=\"" + "x" * 50000 + "\">long</p>", '<p class="open>text',
]


def test_pages_like_a_state_machine(spark):
    rows = [(i, h, "text") for i, h in enumerate(ODD)]
    found = {}
    for r in blocks(spark.createDataFrame(rows, "page_id long, html string, raw string")).orderBy("page_id", "block").collect():
        found.setdefault(r.page_id, []).append((r.block, r.text, r.link_chars))
    for i, html, _ in rows:
        assert found.get(i, []) == machine(html or ""), html
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    texts = {r.page_id: r for r in page_texts(pages).collect()}
    for r in pages.collect():
        own = machine(r.html)
        good = [t for _, t, n in own if len(t) >= 20 and n <= 0.5 * len(t)]
        assert (texts[r.page_id].text, texts[r.page_id].n_blocks, texts[r.page_id].n_kept) == ("\n".join(good), len(own), len(good))
    empty = page_texts(spark.createDataFrame([(1, None), (None, "<p>some text that is long enough</p>"), (2, "<p>x</p>")], "page_id long, html string"))
    assert {r.page_id: (r.text, r.n_blocks, r.n_kept) for r in empty.collect()} == {1: ("", 0, 0), None: ("some text that is long enough", 1, 1), 2: ("", 1, 0)}


def test_references_are_read_once(spark):
    df = spark.createDataFrame([("&amp;lt; &#38;#60;",)], "t string")
    assert df.select(decoded(F.col("t")).alias("x")).first().x == "&lt; &#60;"


@pytest.mark.parametrize("counters", [redaction.COUNTERS, 7])
def test_frequent_lines_are_all_found_and_exact(spark, monkeypatch, counters):
    """Many lines of any frequency about the threshold, a third of the documents one text."""
    monkeypatch.setattr(redaction, "COUNTERS", counters)
    draw = np.random.default_rng(10)
    lines = [f"line {chr(97 + i % 26)}{chr(97 + i // 26)} of the licence" for i in range(300)]
    docs = []
    for i in range(600):
        own = [lines[int(300 * x**2)] for x in draw.random(8)] + ["".join(draw.choice(list("abcdefgh"), 9))]
        docs.append((i, "\n".join(own) if i % 3 else "Copyright 2020 A\ncopyright 1999 A \n\nbody", "t"))
    docs += [(900, None, "t"), (901, "", "t"), (902, "x\n" * 5000, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, shape string").repartition(7)
    count = {}
    for _, text, _ in docs:
        for line in {re.sub("[0-9]+", "0", x.strip(" ").lower()) for x in (text or "").split("\n")} - {""}:
            count[line] = count.get(line, 0) + 1
    for share, least in ((0.01, 1), (0.05, 5), (0.0, 40), (1.0, 1)):
        wanted = {k: n for k, n in count.items() if n >= max(least, int(np.ceil(share * len(docs))), 1)}
        assert {r["shape"]: r.docs for r in frequent_shapes(df, share, least).collect()} == wanted
    assert "copyright 0 a" in {r["shape"] for r in licence_shapes(df, 0.1).collect()}
    out = {r.doc_id: (r.text, r["shape"]) for r in redacted(df, 0.1).collect()}
    assert out[0] == ("[licence]\n[licence]\n\nbody", "t") and out[900] == (None, "t") and len(out) == len(docs)
    assert frequent_shapes(df.limit(0)).count() == 0 == redacted(df.limit(0)).count()
    text = "mail a.b@c.example.org or +49 (30) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.1."
    assert redacted(spark.createDataFrame([(text,)], "text string")).first().text == "mail [email] or [phone], card [card], host [ip]."


def cosines(rows, k):
    sound = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max(len(v) for _, v in sound)
    unit = lambda v: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max())
    sound = [(i, unit(np.pad(v, (0, size - len(v))))) for i, v in sound]
    out = []
    for q, x in dict(reversed([s for s in sound if s[0] % 5 == 0])).items():
        scores = sorted((-round(float(x @ y), 9) + 0.0, i) for i, y in sound if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "size", "k"), [(300, 40, 7), (30, 3, 50), (2500, 24, 3)])
def test_cosine_search_with_ties_and_zero_vectors(spark, n, size, k):
    draw = np.random.default_rng(13)
    centre = draw.normal(size=(6, size)) * np.linspace(4, 0.2, size)
    vectors = [(i, (centre[i % 6] + 0.3 * draw.normal(size=size)).tolist()) for i in range(n)]
    vectors += [(n + i, [2.0 * x for x in vectors[i][1]]) for i in range(20)]  # equal directions
    vectors += [(5000, [0.0] * size), (5005, None), (5010, [1.0, None]), (5015, [float("nan")] * size), (5020, [1.0]), (5025, [1e300, -1e300]), (5030, [1e-300]), (None, [1.0]), (5035, [])]
    df = spark.createDataFrame([(*v, "u") for v in vectors], "vec_id long, embedding array<double>, unit string").repartition(4)
    found = sorted(tuple(r) for r in cosine_top_k(df, F.col("id") % 5 == 0, k).collect())
    wanted = cosines(vectors, k)
    assert [r[:2] for r in found] == [r[:2] for r in wanted]
    assert np.allclose([r[3] for r in found], [r[3] for r in wanted], atol=2e-9)
    assert np.mean([a[2] == b[2] for a, b in zip(found, wanted)]) > 0.999  # scores a digit apart may change places


def test_bounds_skip_products_where_vectors_cluster(spark):
    draw = np.random.default_rng(14)
    centre = draw.normal(size=(10, 64)) * np.linspace(3, 0.05, 64)
    vectors = [(i, (centre[i % 10] + 0.1 * draw.normal(size=64)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    worked = spark.sparkContext.accumulator(0)
    assert cosine_top_k(df, F.col("id") % 20 == 0, 5, worked=worked).count() == 750
    assert worked.value < 0.3 * 150 * 3000
    assert cosine_top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0
