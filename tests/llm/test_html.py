import random
import re
import time

import pytest

from srcfacts.llm.html import text_of


def test_blocks_lists_tables():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <h1>Head&amp;er</h1><p>One <b>bold</b>
    text<p>Two<br>lines<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li>y</ol>
    <table><caption>Cap</caption><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>é<td>22</table>
    <div hidden>no</div><div style="display: none">no</div><script>var a="</p>";</script><!-- no --><pre>  k
    v</pre>5 < 6 &lt; 7</body></html>"""
    assert text_of(page).split("\n") == [
        "Head&er", "", "One bold text", "", "Two", "lines", "", "- a", "- b", "  - c", "- d", "", "3. x", "4. y", "",
        "Cap", "Name       N", "long name  1", "é          22", "", "  k", "    v", "", "5 < 6 < 7",
    ]


def test_broken_and_empty():
    assert text_of("") == "" and text_of("<") == "<" and text_of("a</x></p>b") == "a\n\nb".replace("\n\n", "\n\n")
    assert text_of("<p>" * 3000 + "x") == "x"
    assert text_of("<div>" * 5000 + "deep") == "deep"
    assert text_of("<ul><li>" * 300 + "deep").endswith("deep")
    assert text_of("<a href=\"x>y\">t</a><script>unclosed") == "t"


def test_all_visible_words_are_kept():
    rng = random.Random(1)
    tags = ["p", "div", "b", "ul", "li", "table", "tr", "td", "ol", "pre", "blockquote", "dl", "dd", "span", "h2", "th", "option", "tbody"]
    for _ in range(3000):
        parts, n = [], 0
        for _ in range(rng.randint(1, 25)):
            kind = rng.random()
            if kind < 0.4:
                n += 1
                parts.append(f" w{n} ")
            else:
                parts.append(f"<{'/' if kind > 0.75 else ''}{rng.choice(tags)}>")
        got = re.findall(r"w\d+", text_of("".join(parts)))
        assert sorted(got) == sorted(f"w{i}" for i in range(1, n + 1)), "".join(parts)


def test_visibility_is_read_by_attribute():
    for shown in ('class="hidden md:block"', 'title="The hidden truth"', 'data-type="hidden"', "aria-hidden=true", 'data-style="display:none"', "alt='style=\"display:none\"'"):
        assert text_of(f"<div {shown}>yes</div>") == "yes", shown
    for gone in ("hidden", 'HIDDEN=""', 'class="a" hidden', "style='color:red; display : none'", 'style="visibility:hidden!important"', "style=display:none"):
        assert text_of(f"<div {gone}>no</div>yes") == "yes", gone
    assert text_of("<dialog open>yes</dialog><dialog>no</dialog>") == "yes"
    assert text_of("<svg><title>no</title><text>one</text></svg> <math><mi>x</mi></math>") == "one x"


def test_visibility_as_a_browser_paints():
    cases = {
        '<div hidden="false">no</div>yes': "yes",
        "<div hidden/>no</div>yes": "yes",
        '<div hidden style="display:block">yes</div>': "yes",
        '<p style="display:none;display:inline">yes</p>': "yes",
        '<p style="display:none!important;display:inline">no</p>yes': "yes",
        '<div style="visibility:hidden">no <b style="visibility:visible">yes</b> no</div>': "yes",
        '<div style="display:none"><b style="visibility:visible;display:block">no</b></div>yes': "yes",
        '<table style="visibility:hidden"><tr><td>no<td style="visibility: visible">yes</table>': "  yes",
        "<details><summary>yes</summary>no</details>": "yes",
        "<details open><summary>a</summary>b</details>": "a\nb",
        "<head><title>no</title><p>yes": "yes",
        "<svg><g hidden/><text>yes</text></svg>": "yes",
        "<svg><![CDATA[a<b]]></svg> <![CDATA[no]]>": "a<b",
        "a</ no >b<?no?><!no>c": "abc",
        "<ol><li value=7>x<li>y</ol>": "7. x\n8. y",
        "yes<b no": "yes",
    }
    for page, want in cases.items():
        assert text_of(page) == want, page


def test_cells_keep_their_columns():
    page = "<table><tr><td rowspan=2>a<td colspan=2>b<td>c<tr><td>d<td>e<td>f<tbody><tr><td>g<td>h<td>i<td rowspan=0>jj<tr><td colspan=3>k</table>"
    assert text_of(page).split("\n") == ["a  b     c", "   d  e  f", "g  h  i  jj", "k"]
    assert text_of("<table><tfoot><tr><td>z<td>1<tbody><tr><td>y<td>2<thead><tr><td>x<td>3</table>").split("\n") == ["x  3", "y  2", "z  1"]
    assert text_of("<table><tr><td><table><tr><td>a<td>b<tr><td>ccc<td>d</table><td>e</table>").split("\n") == ["a    b  e", "ccc  d"]


def test_lists_of_any_depth_keep_their_marks():
    lines = text_of("".join(f"<ul><li>w{i} " for i in range(200))).split("\n")
    assert [x.strip() for x in lines] == [f"- w{i}" for i in range(200)] and all(len(x) < 100 for x in lines)


def brute_table(rows):
    """The grid cell by cell; one line a cell."""
    grid = {}
    for r, row in enumerate(rows):
        c = 0
        for text, across, down in row:
            while (r, c) in grid:
                c += 1
            for i in range(r, min(r + down, len(rows))):
                for j in range(c, c + across):
                    grid.setdefault((i, j), ("", False))
            grid[r, c] = (text, across)
            c += across
    starts = sorted({c for (_, c), (_, across) in grid.items() if across})
    wide = {c: 0 for c in starts}
    for (_, c), (text, across) in grid.items():
        if across and [x for x in starts if c <= x < c + across] == [c]:
            wide[c] = max(wide[c], len(text))
    spans = sorted(([x for x in starts if c <= x < c + across], text) for (_, c), (text, across) in grid.items() if across)
    for inside, text in sorted(spans, key=lambda s: (len(s[0]), s[0], len(s[1]))):
        if len(inside) > 1 and inside[-1] != starts[-1]:
            wide[inside[-1]] += max(0, len(text) - sum(wide[x] for x in inside) - 2 * (len(inside) - 1))
    lines = []
    for r in range(len(rows)):
        line = ""
        for c in starts:
            text, across = grid.get((r, c), ("", False))
            if across and text:
                offset = sum(wide[x] + 2 for x in starts if x < c)
                line = line.ljust(offset) + text
        lines.append(line)
    return [x for x in lines if x]


def test_tables_against_a_plain_grid():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [[("".join(rng.choice("xyz") for _ in range(rng.randint(1, 9))), rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan='{d}'>{t}" for t, a, d in row) for row in rows) + "</table>"
        got = text_of(page).split("\n")
        if len({c for row in rows for c in range(len(row))}) > 1:
            assert got == brute_table(rows), page


def brute_lines(node, seen, lines):
    """Words of a tree (tag, style, children): a new line at each edge of a block."""
    tag, style, children = node
    if style == "hidden":
        return
    seen = {"visibility:hidden": False, "visibility:visible": True}.get(style, seen)
    if tag == "div":
        lines.append([])
    for x in children:
        if isinstance(x, str):
            lines[-1] += [x] if seen else []
        else:
            brute_lines(x, seen, lines)
    if tag == "div":
        lines.append([])


def test_trees_against_a_plain_walk():
    rng = random.Random(6)

    def grown(depth):
        style = rng.choice(["", "", "", "hidden", "visibility:hidden", "visibility:visible", "color:red"])
        return rng.choice(["div", "div", "b"]), style, [f"w{rng.randint(0, 99)}" if depth > 4 or rng.random() < 0.5 else grown(depth + 1) for _ in range(rng.randint(0, 4))]

    def written(node):
        if isinstance(node, str):
            return f" {node} "
        tag, style, children = node
        return f"<{tag}{' hidden' if style == 'hidden' else f' style={style}' if style else ''}>" + "".join(map(written, children)) + f"</{tag}>"

    for _ in range(2000):
        node = ("div", "", [grown(0) for _ in range(3)])
        lines = [[]]
        brute_lines(node, True, lines)
        assert text_of(written(node)) == "\n".join(" ".join(x) for x in lines if x), written(node)


TOKENS = ["<div>", "<p>", "<ul><li>", "<ul><li>a", "<table><tr><td>", "<table><tr><td>x<td>", "<td>a<br>", "<td rowspan=9999>a<tr>", "<td colspan=1000 rowspan=9>", '<a "x ', "<a x='y ", '<a x="y> ', "<a ", "<!--", "</p>", "<script></script ", "<dl><dd>", "<pre>a\n", "<ul><li><table><tr><td>", "<table><tr><td>a<td>b<br>c", "<p><button>", "a<table>b", "<table><tr><td>x<br>y<td>"]


@pytest.mark.parametrize("token", TOKENS)
def test_time_grows_with_the_page(token):
    def taken(n: int) -> float:
        page = (token * (n // len(token) + 1))[:n]
        start = time.process_time()
        text_of(page)
        return time.process_time() - start

    assert taken(80_000) < 4 * 2.5 * max(min(taken(20_000) for _ in range(2)), 0.02)


def test_numbers_and_controls():
    assert text_of("<ol><li></li><li>b</li></ol>") == "2. b"
    assert text_of("<ol reversed><li>a</li><li hidden>no</li><li>b<li>c</ol>") == "3. a\n2. b\n1. c"
    assert text_of("<ol reversed start=9><li>a</li><li value=4>b<li>c</ol>") == "9. a\n4. b\n3. c"
    assert text_of("<p>x<button>go</button><textarea>t</textarea>y") == "x go t y"
    assert text_of("<button>go</button>") == "go"
