"""Operators 2, 3 and 9."""

from __future__ import annotations

import random

import numpy as np
import pytest

from opsloom.llm import near_vectors as vectors
from opsloom.llm.decontaminate import MultiIndex, contaminated, drop_contaminated
from opsloom.llm.near_vectors import linked, near_vectors, quantise
from opsloom.llm.text_density import Page, extract_main_text, main_text

from conftest import sentence
from test_text_dedup import roots

VECTORS = "vec_id long, embedding array<float>, label int, component_id string, rep long, part string"


def brute(rows, threshold=0.93):
    usable = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = (np.array(v, np.float32).astype(float), label)
    edges = [(a, b) for a in usable for b in usable if a != b and usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0])
             and usable[a][0] @ usable[b][0] / np.linalg.norm(usable[a][0]) / np.linalg.norm(usable[b][0]) >= threshold]
    root = roots([r[0] for r in rows], edges)
    return {i: (sum(a == i for a, _ in edges), root[i]) for i in root}


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        base = rows[rng.integers(len(rows))][1] if rows and rng.random() < 0.6 else None
        v = rng.normal(0, 1, 24) if base is None or len(base) != 24 else np.array(base) + rng.normal(0, rng.choice([0, 0.05, 0.25, 0.4]), 24)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if base is None else rows[-1][2]))
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (503, [None] + [1.0] * 23, 1), (504, rows[0][1], None),
             (505, [], 0), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0), (508, [1e-30, 2e-30], 0), (509, [1e30, 2e30], 0), (510, [float("inf"), 1.0], 0)]
    full = [(*r, "c", 3, "p") for r in rows]
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(full, VECTORS)).collect()}
    assert found == brute(rows)
    assert found[506][0] == 3 and found[501] == (0, 501)


def test_near_vectors_in_many_tiles(spark):
    rng, block = np.random.default_rng(2), vectors.BLOCK
    rows = [(int(i), [float(np.float32(x)) for x in v], 1) for i, v in
            zip(rng.permutation(150), np.repeat(rng.normal(0, 1, (30, 8)), 5, axis=0) + rng.normal(0, 0.12, (150, 8)))]
    try:
        vectors.BLOCK = 16
        found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame([(*r, "", 0, "") for r in rows], VECTORS)).collect()}
    finally:
        vectors.BLOCK = block
    assert found == brute(rows)


def test_near_vectors_ties_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, -0.0], 1)]
    found = near_vectors(spark.createDataFrame([(*r, "", 0, "") for r in rows], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found if r.vec_id) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, None)]
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(3)
    for dims in (3, 64, 1500):
        x, y = rng.normal(0, 1, (200, dims)), rng.normal(0, 1, (150, dims))
        y[:100] = x[:100] + rng.normal(0, 0.4, (100, dims))
        u, v = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
        (a, sa, na, ea), (b, sb, nb, eb) = quantise(u), quantise(v)
        coded = (a * sa[:, None]) @ (b * sb[:, None]).T
        assert (np.abs(coded - u @ v.T) <= np.outer(ea, nb) + np.outer(na, eb) + np.outer(ea, eb) + 1e-12).all()
        assert (linked(x, y, 0.93) == (u @ v.T >= 0.93)).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, a long notice text that is dense enough to look like an article of its own.</p></div>
%s
<form><p>Write to us</p><textarea>x</textarea></form><!-- <p>gone</p> --><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("body,want", [
    ("<article><h1>Head &amp; more</h1><p><b>One &lt;two&gt;<br>three<p>Four\n  five&nbsp;six</p><aside>no</aside><div class=ad>no</div></article>",
     "Head & more\n\nOne <two> three\n\nFour five six"),
    ("<div id=main><h2>Title here</h2><p>First paragraph, which is long enough to be text.</p><p>Second one, also long enough to be text.</p>"
     "<p>Short.</p><ul><li>item one</li><li>item two</li></ul></div><div id=sidebar><p>Side text</p></div><div class='comments'><p>Nice!</p></div>",
     "Title here\n\nFirst paragraph, which is long enough to be text.\n\nSecond one, also long enough to be text.\n\nShort.\n\nitem one\n\nitem two"),
    ("<div><div><section><p>One paragraph that has a length.</p></section><section><p>Another paragraph that has a length.</p></section></div></div>",
     "One paragraph that has a length.\n\nAnother paragraph that has a length."),
    ("<div class='site-header'><p>A header that is as long as any text here.</p></div><article><p title='a hidden gem'>Kept text.</p>"
     "<p hidden>no</p><p style='color:red; display: none'>no</p><div class=sideBar>no</div><article class='comment'><p>no, a reader</p></article></article>",
     "Kept text."),
    ("<div class='entry-header'><h1>Name</h1></div><div class=entry><p>The text of the entry, long enough to win.</p><p>And more of it here.</p></div>",
     "Name\n\nThe text of the entry, long enough to win.\n\nAnd more of it here."),
    ("<p>unclosed <i>markup <b>text</i> here</p> tail", "unclosed markup text here\n\ntail"),
    ("", "")])
def test_main_text(body, want):
    assert main_text(PAGE % body) == want


@pytest.mark.parametrize("wrapper", [
    'div class="layout with-sidebar"', 'div id="page" class="no-sidebar"', 'div class="container has-banner"', 'div class="hasBanner"',
    'section class="social-history"', 'div class="page--sidebar"', 'div class="modal-open"', 'div data-id="menu" data-role="navigation"',
    'div title="a class=ad of its own"', 'div class="elementor-widget"', 'div class="widget"', 'div class="related"', 'div class="search"'])
@pytest.mark.parametrize("text", ["<p>First of the text, which is long enough to win.</p><p>And more of it here, as long as that.</p>",
                                  "<div><div><p>First of the text, which is long enough to win.</p></div><p>And more of it here, as long as that.</p></div>"])
def test_main_text_in_a_wrapper(wrapper, text):
    want = "First of the text, which is long enough to win.\n\nAnd more of it here, as long as that."
    name = wrapper.split()[0]
    assert main_text(PAGE % f"<{wrapper}>{text}<div class='social-links'>no</div></{name}><div class=footer-links>no</div>") == want


@pytest.mark.parametrize("name", ["ad", "sidebar", "comments", "nav-wrapper", "promo", "site-header"])
def test_marked_wrappers_of_the_page(name):
    """No mark takes an article, main or h1 with it; beside an article or main it cuts, also the largest sum."""
    text, long = "<p>Text of the page.</p>", "<p>Much longer text of something else that takes no part, and more of it.</p>"
    assert main_text(PAGE % f"<div class='{name}'><article>{text}</article></div>") == "Text of the page."
    assert main_text(PAGE % f"<div class='{name}'><main>{text}</main></div>") == "Text of the page."
    assert main_text(PAGE % f"<div class='{name}'><h1>Name</h1>{text}{text}</div>") == "Name\n\nText of the page.\n\nText of the page."
    assert main_text(PAGE % f"<article>{text}</article><div class='{name}'>{long}</div>") == "Text of the page."
    assert main_text(PAGE % f"<main>{text}</main><div class='{name}'>{long}</div>") == "Text of the page."


def test_marks_inside_and_beside_main():
    text = "<p>Text of the page, in a box of its own.</p><p>And more of it here.</p>"
    got = main_text(PAGE % f"<main><div class=widget>{text}</div></main><div class=promo><p>Much longer text of something else that takes no part.</p></div>")
    assert got == "Text of the page, in a box of its own.\n\nAnd more of it here."
    boxes = "".join(f"<div class=elementor-widget><p>Paragraph {i} of the page's text.</p></div>" for i in range(9))
    want = "\n\n".join(f"Paragraph {i} of the page's text." for i in range(9))
    assert main_text(PAGE % f"<div>{boxes}</div>") == main_text(PAGE % boxes) == want
    assert main_text(PAGE % f"<main><h1>Name</h1>{boxes}</main>") == "Name\n\n" + want


def test_headings_by_class():
    text = "<p>The text of the section, long enough to win.</p><p>And more of it here, as long.</p>"
    got = main_text(PAGE % f"<div id=text><div class='section-header'><h2>Heading</h2></div>{text}<div class='header'>no</div></div>")
    assert got == "Heading\n\nThe text of the section, long enough to win.\n\nAnd more of it here, as long."


LONG = "This sentence is one of a hundred characters and it stands for any sentence of a text on a web page. "


@pytest.mark.parametrize("body,want", [
    (f"<main><article><p>One. {LONG * 6}</p></article><article><p>Two. {LONG * 2}</p></article></main>", ["One.", "Two."]),
    (f"<article><p>One. {LONG * 3}</p></article><article class='teaser'><p>Two. {LONG * 5}</p></article>", ["One.", "Two."]),
    (f"<main><p class=lead>Lead. {LONG}</p><article><p>One. {LONG * 4}</p></article></main>", ["Lead.", "One."]),
    (f"<main><h1>Title.</h1><article><p>One. {LONG * 4}</p></article></main>", ["Title.", "One."]),
    (f"<article><p>One. {LONG * 3}</p></article><div class='reader-responses'><article><p>Two. {LONG * 9}</p></article></div>", ["One."]),
    (f"<article><p>One. {LONG * 3}</p></article><div class='reader-responses'><p>Two. {LONG * 9}</p></div>", ["One."]),
    (f"<article><p>One. {LONG * 3}</p></article><section class='user-feedback'><article><p>Two. {LONG * 9}</p></article></section>", ["One."]),
    (f"<div class=a><p>One. {LONG * 5}</p><p>Two. {LONG * 5}</p></div><div class=b><p>Short.</p></div>", ["One.", "Two.", "Short."]),
    (f"<article><p>One. {LONG * 3}</p><p>Two. {LONG} <a href=x>a link</a></p><p><a href=x>Three.</a></p></article>", ["One.", "Two.", "Three."]),
    (f"<article><p>One. {LONG * 3}</p></article><div><a href=x>Two.</a> <a href=y>Three.</a> <a href=z>Four.</a></div>", ["One."]),
    (f"<div><p>One. {LONG * 3}</p></div><div><ul><li><a href=x>Two.</a><li><a href=y>Three.</a></ul></div>", ["One."]),
])
def test_what_stands_beside_the_leading_text(body, want):
    assert [block.split()[0] for block in main_text(PAGE % body).split("\n\n")] == want


def test_densities_against_their_definition():
    """Each node's density and density sum, worked out from its subtree alone, on all pages; and the leading node's threshold."""
    import math

    import pyarrow.parquet as pq

    pages = [x for x in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist() if x]
    pages += [PAGE % f"<main><p class=lead>{LONG}</p><article><p>{LONG * 4} <a href=x>a link in it</a></p></article></main><ul><li><a>x</a><li><a>y</a></ul>"]
    for page in pages:
        tree = Page(page)
        of, sums = tree.densities()

        def parts(i):
            """All runs of text (with whether they stand in a link) and all elements below a node."""
            texts, tags = [], []
            for x in tree.items[i]:
                if isinstance(x, str):
                    texts.append((len(" ".join(x.split())), tree.tag[i] == "a"))
                else:
                    below, inner = parts(x)
                    texts += [(n, link or tree.tag[i] == "a") for n, link in below]
                    tags += [tree.tag[x], *inner]
            return texts, tags

        def density(i):
            texts, tags = parts(i)
            chars, linked = sum(n for n, _ in texts), sum(n for n, link in texts if link)
            links = tags.count("a") + (tree.tag[i] == "a")
            if not chars:
                return 0.0
            outside = max(chars - linked, 1)
            base = math.log(max(chars / outside * linked + share * chars, 1) + math.e)
            ratio = max(chars / max(linked, 1) * max(len(tags), 1) / max(links, 1), 1 if linked else 2)
            return chars / max(len(tags), 1) * math.log(ratio) / math.log(base)

        share = 0.0
        whole, _ = parts(tree.tag.index("body"))
        share = sum(n for n, link in whole if link) / max(sum(n for n, _ in whole), 1)
        for i in range(len(tree.tag)):
            assert of[i] == pytest.approx(density(i))
            texts, _ = parts(i)
            up = i
            while up >= 0 and tree.tag[up] != "a":
                up = tree.parent[up]
            runs = 0.0 if up >= 0 else sum(n * math.log(max(n, 2)) / math.log(math.log(max(share * n, 1) + math.e))
                                           for n in (len(" ".join(x.split())) for x in tree.items[i] if isinstance(x, str)) if n)
            want = runs + sum(density(x) for x in tree.items[i] if not isinstance(x, str))
            assert sums[i] == pytest.approx(want if any(n and not link for n, link in texts) else 0.0)


def test_main_text_of_odd_pages(spark):
    pages = ["", None, "plain text", "<p>a", "<" * 3000, "<div>" * 20_000 + "deep", "<a href=x>only a link</a>", "<script>x", "</p></div>x", "<p>" + "word " * 100_000,
             "<p title='a>b'>q</p>", "<!-- open"]
    rows = spark.createDataFrame([(i, "u", p, "t", 1) for i, p in enumerate(pages)] + [(1, None, None, "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    found = extract_main_text(rows).collect()
    assert len(found) == len(pages) + 1 and all(r.n_chars == len(r.text) for r in found)
    got = {r.page_id: r.text for r in found}
    assert got[0] == got[1] == got[6] == got[7] == got[11] == "" and got[2] == "plain text" and got[3] == "a" and got[5] == "deep" and got[8] == "x"
    assert got[9] == " ".join(["word"] * 100_000) and got[10] == "q"
    assert extract_main_text(rows.limit(0)).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for radius in (3, 9, 19):
        index = MultiIndex(prints, radius)
        for _ in range(40):
            one = prints[rng.integers(len(prints))]
            for bit in rng.choice(64, rng.integers(0, 25), replace=False):
                one ^= np.uint64(1) << np.uint64(bit)
            assert index.within(one).tolist() == np.flatnonzero(np.bitwise_count(prints ^ one) <= radius).tolist()


def test_decontamination(spark, frame, odd_rows):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.choice([12, 25, 40, 41]))) for i in range(30)] + [(77, "one two"), (78, None), (79, ""), (3, "A tie of ITEM three with more words in it")]
    rows, want = list(odd_rows), set()
    for k in range(60):
        item, text = items[rng.randrange(30)]
        w = text.split()
        if k % 3 == 1:
            w[0] = w[0].upper()
        if k % 3 == 2:
            w = [sentence(rng, 1) if rng.random() < 0.5 else x for x in w]  # no longer a copy
        else:
            want.add((1000 + k, item))
        rows.append((1000 + k, sentence(rng, rng.randint(0, 50)) + " " + " ".join(w) + "\n" + sentence(rng, rng.randint(0, 50))))
    rows += [(5000, "one two"), (5001, "one two three"), (5002, "a TIE of item three with more words in it")]
    want |= {(5000, 77), (5002, 3)}
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    found = contaminated(frame(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and all(r.similarity >= 0.8 for r in found)
    clean = drop_contaminated(frame(rows), benchmark)
    assert clean.columns == frame(rows).columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if r[0] not in {d for d, _ in want})
    assert contaminated(frame([]), benchmark).count() == 0
    assert contaminated(frame(rows), benchmark.limit(0)).count() == 0 and drop_contaminated(frame(rows), benchmark.limit(0)).count() == len(rows)


def test_decontamination_in_several_passes(spark, frame, monkeypatch):
    from opsloom.llm import decontaminate

    rng = random.Random(9)
    items = [(i, sentence(rng, 20)) for i in range(12)]
    rows = [(i, sentence(rng, 30) + " " + t) for i, t in items] + [(100, sentence(rng, 60))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 300)
    assert {(r.doc_id, r.item_id) for r in contaminated(frame(rows), benchmark).collect()} == {(i, i) for i, _ in items}
    assert [r.doc_id for r in drop_contaminated(frame(rows), benchmark).collect()] == [100]


def test_decontamination_by_all_windows(spark):
    """Items with some of their words replaced: similarities from 0.5 to 1, every window compared with every item."""
    from brute_windows import best_windows

    rng = random.Random(41)
    items = [(i, sentence(rng, rng.choice((12, 20, 40, 60)))) for i in range(25)] + [(90, sentence(rng, 3)), (91, ""), (92, None)]
    docs = []
    for i in range(240):
        words = items[i % 25][1].split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        if rng.random() < 0.3:
            words = words[rng.randrange(2):len(words) - rng.randrange(2)]
        docs.append((i, f"{sentence(rng, rng.randrange(30))} {' '.join(words)} {sentence(rng, rng.randrange(30))}"))
    docs += [(500, items[25][1]), (501, f"{items[25][1]} more"), (502, items[3][1][:40])]
    found = best_windows(docs, items)
    between = [s for s in found.values() if 0.7 <= s <= 0.9]
    assert len(between) > 40
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold=0.8).collect()}
    want = {pair: s for pair, s in found.items() if s >= 0.8}
    assert got == pytest.approx(want)
