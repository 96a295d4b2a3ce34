import math
import random
import statistics
import time
import tracemalloc

import pytest

from lexmatch.llm import extract
from lexmatch.llm.html import Reader

LONG = "This sentence is long enough to be read, with commas, marks; and an end. It goes on for a while, as articles do."
CASES = {
    "article": (f"<html><body><nav><ul><li><a href=x>Home</a></ul></nav><div class=ad>Buy, now.</div><article><h1>Title</h1><p><b>{LONG}<br><p>Short.</article><footer>&copy; me</footer>", ["Title", LONG, "Short."]),
    "classes": (f"<div id=header><p>Site name, a motto, and more.</p></div><div class='content'><h2>Head</h2><p>{LONG}</p><ul><li>One<li>Two</ul><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div><div id=comments><p>{LONG} I, for one, agree.</p></div>", ["Head", LONG, "One", "Two", LONG]),
    "body": (f"<body><header>Site</header><h1>Head</h1><p>{LONG}</p><p>a &lt;b&gt; &amp; &#99;&nbsp;d</p><form><p>{LONG}</p></form><aside>{LONG}</aside></body>", ["Head", LONG, "a <b> & c d"]),
    "comments inside": (f"<article><p>{LONG}</p><section class='reader-comments'><h3>Replies</h3><p>{LONG}</p></section></article>", [LONG]),
    "notice": (f"<div class='cookie-notice'>{LONG}</div><main><p>{LONG}</p></main>", [LONG]),
    "scripts": (f"<script>var p = '</p><p>no</p>';</script><style>p{{}}</style><article><p>{LONG}<script>x()</script></p><noscript>no</noscript><!-- <p>no</p> --></article>", [LONG]),
    "cut off": (f"<article><p>{LONG}</p><p>and th", [LONG, "and th"]),
    "table": (f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table></article>", [LONG, "a", "b", "c"]),
    "white space": ("<article><p>  a\n\tb   <i>c</i>d </p></article>", ["a b cd"]),
    "no markup": ("just text", ["just text"]),
    "nothing": ("<html><body></body></html>", []),
    "odd signs": ("<article><p>1 < 2 and <3, a<b</p></article>", ["1 < 2 and <3, a"]),
    "open quote": (f"<article><p>{LONG}</p><p title=\"x>rest", [LONG, "rest"]),
    "hidden": (f"<article><p>{LONG}</p><p hidden>no</p><div style='display: none'>no</div></article>", [LONG]),
    "sidebar layout class": (f"<div class='page has-sidebar'><article class='post'><p>{LONG}</p></article></div>", [LONG]),
}


@pytest.mark.parametrize("name", CASES)
def test_main_blocks(name):
    page, want = CASES[name]
    assert extract.main_blocks(page) == want


def test_extract(spark):
    rows = [(1, "u", CASES["article"][0], 5), (2, None, None, 6), (2, None, None, 6), (None, "v", "", 7)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [tuple(x) for x in got] == [(1, "u", "\n\n".join(["Title", LONG, "Short."]), len(LONG) + 15), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)]
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_long_and_broken_pages_end():
    for page in ("<" * 100_000, "<a href='" * 20_000, "<p>" * 50_000, "&" * 100_000, "<div " * 50_000 + ">", "<!--" * 50_000, "</p>" * 50_000, "<script>" * 20_000, '<a x="' * 30_000):
        extract.main_blocks(page)
    big = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert extract.main_blocks(big) == [LONG] * 20_000


#: No article, no main, no classes: only the ratios can tell the text from the rest.
PLAIN = [
    f"<div><div><a href=/>Home</a> <a href=/n>News</a></div><div>Login now</div></div><div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div><div>Share it</div><div>Next story</div></div></div>",
    f"<table><tr><td>Home<td>Shop<td>Team</table><div><div>{LONG}</div><div>{LONG} {LONG}</div></div><div><div><div>12 replies</div></div></div>",
    f"<body><div><ul><li>One<li>Two<li>Three</ul></div><div><div><p>{LONG}<p>{LONG}</div><div><span>Rate this</span></div></div><div>Imprint</div>",
]


@pytest.mark.parametrize("page", PLAIN)
def test_ratios_decide(page, monkeypatch):
    got = extract.main_blocks(page)
    assert LONG in got and not {"Login now", "Share it", "Next story", "Home", "12 replies", "Imprint", "One", "Rate this"} & set(got)
    monkeypatch.setattr(extract, "content_paths", lambda blocks, threshold: {b.path for b in blocks})
    assert len(extract.main_blocks(page)) > len(got)
    monkeypatch.setattr(extract, "content_paths", lambda blocks, threshold: set())
    assert extract.main_blocks(page) == []


def slow_content_paths(lines, threshold):
    """The ratios by their definition, over (path, text, characters in links) of each node in page order."""
    names = [p for p, _, _ in lines]
    of = {p: [x for x in lines if x[0] == p] for p in names}
    ratio = {p: (sum(len(t) - k for _, t, k in xs) / len(xs), sum(t.count(c) for _, t, _ in xs for c in ".,;:!?…。、，！？；：¿¡") / len(xs)) for p, xs in of.items()}

    def smooth(i, which):
        near = [(w, ratio[names[j]][which]) for w, j in zip((0.06, 0.24, 0.4, 0.24, 0.06), range(i - 2, i + 3)) if 0 <= j < len(lines)]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    fused = [smooth(i, 0) * math.log(1.05 + smooth(i, 1)) for i in range(len(lines))]
    spread = statistics.pstdev(fused) or statistics.mean(fused)
    score = {p: min(statistics.mean(x for x, q in zip(fused, names) if p == q), 4 * ratio[p][0] * math.log(1.05 + ratio[p][1])) for p in of}
    return {p for p, x in score.items() if x > 0 and (x >= threshold * spread or x == max(score.values()))}


def test_ratios_equal_brute_force():
    r = random.Random(5)
    for n in range(300):
        words = lambda k: " ".join(r.choice(["word", "wordy,", "end.", "to", "a"]) for _ in range(r.randint(1, k)))
        page = "".join(r.choice([f"<div class='{r.choice('ab')} c'>", "<div>", "</div>", "<section>", "</section>", f"<p>{words(40)}", f"<li>{words(3)}", f"<p><a href=x>{words(5)}</a> {words(4)}</p>", words(6)]) for _ in range(r.randint(1, 30)))
        reader = Reader(page)
        lines = []
        for b, number in zip(reader.blocks, [extract._paths(reader.elements)[b.at.order] if b.at.order >= 0 else 0 for b in reader.blocks]):
            b.path = number
            chain = [(e.name, tuple(sorted(e.attributes().get("class", "").split()))) for e in b.at.lineage()]
            lines.append((tuple(chain), b.text, b.links))
        names = {b.path: p for b, (p, _, _) in zip(reader.blocks, lines)}
        assert len(names) == len(set(names.values()))
        assert {names[x] for x in extract.content_paths(reader.blocks, 0.35)} == (slow_content_paths(lines, 0.35) if lines else set()), page


def test_deep_pages_take_time_and_memory_by_their_length():
    for piece in ("<div>x. ", "<article>x, y. ", "<h1>x. ", "<figure class='a b'>x. ", "<figcaption><img src=x>y "):
        page = piece * (1_000_000 // len(piece))
        began = time.process_time()
        tracemalloc.start()
        extract.main_blocks(page)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.process_time() - began < 20 and most < 300 << 20
