"""Layout, visibility, hostile pages, and a second renderer for the pages of the tables."""

import time

import brute
import pyarrow.parquet as pq
import pytest

from corpusloom.llm import html

TABLES = [
    ("<table><tr><td colspan=2>wide header cell<td>z<tr><td>a<td>b<td>c</table>", "wide header cell  z\na  b              c"),
    ("<table><tr><td>日本語<td>1<tr><td>abcdef<td>2<tr><td>é<td>3</table>", "日本語  1\nabcdef  2\né       3"),
    ("<table><tr><td rowspan=2>r<td>1<td>x<tr><td colspan=2>both<tr><td>q<td>w<td>e</table>", "r  1  x\n   both\nq  w  e"),
    ("<table><tr><td rowspan=0>all<td>1<tr><td>2<tr><td>3</table>", "all  1\n     2\n     3"),
    ("<table><tr><td colspan=0>a<td>b<tr><td colspan=-3>c<td>d</table>", "a  b\nc  d"),
    ("<table><tr><td>a<td>b<td>c<tr><td colspan=3>" + "w" * 12 + "</table>", "a  b  c\n" + "w" * 12),
    ("<table><tr><td>" + "long " * 40 + "<td>n<tr><td>k<td>m</table>", "long " * 40 + " n\nk  m"),
]
SEEN = [
    ('<p style="visibility:hidden">a<b style="visibility:visible">B</b></p>', "B"),
    ('<p style="display:none">a<b style="display:block;visibility:visible">B</b></p>', ""),
    ("<style>.x{display:none} #y { visibility: hidden } b { display:none } p.z{display:none}</style><p class='q x'>1<p id=y>2<i style='visibility: visible'>3</i><b>4</b><p class=z>5<div class=z>6</div>", "3\n\n6"),
    ("<style>p{display:none}.on{display:block}</style><p>no<p class=on>yes<p style='display:block'>too", "yes\n\ntoo"),
    ("<style>.x{display:none!important}</style><p class=x style='display:block'>no<p>yes", "yes"),
    ("<style>@media print{p{display:none}} @media screen{i{display:none}} /* b{display:none} */ div p, a[x]{display:none}</style><div><p>yes<i>no</i> <b>b</b></div>", "yes b"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<p hidden>no<p hidden style='display:block'>yes", "yes"),
    ("<ul><li style='visibility:hidden'>no<li>yes</ul>", "- yes"),
    ("<svg visibility=hidden><text>no<tspan visibility=visible>yes</tspan></text></svg>", "yes"),
]
LISTS = [
    ("<ol start=-1><li>a<li>b<li>c</ol>", "-1. a\n0. b\n1. c"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol reversed start=10><li>a<li value=4>b<li>c</ol>", "10. a\n4. b\n3. c"),
    ("<ol start=12345678><li>a<li value=99999999999999999999>b<li value=x>c</ol>", "12345678. a\n2147483647. b\n2147483648. c"),
]


@pytest.mark.parametrize(("page", "shown"), TABLES + SEEN + LISTS)
def test_what_is_shown_and_where(page, shown):
    assert "\n".join(x.rstrip() for x in html.render(page).split("\n")) == "\n".join(x.rstrip() for x in shown.split("\n"))


MB = 1 << 20
HOSTILE = {
    "spans": "<table>" + "<tr><td colspan=1000 rowspan=1000>" * (MB // 34),
    "wide spans": "<table><tr>" + "<td colspan=1000>x" * (MB // 18),
    "many rows of spans": "<table>" + "<tr><td colspan=900>ab<td rowspan=60000>c" * (MB // 40),
    "nested tables": "<table><td>a<td>b" * (MB // 17),
    "closed nested tables": "<table><tr><td>a<td>" * (MB // 40) + "</table>" * (MB // 40),
    "nested definitions": "<dd>x" * (MB // 5),
    "nested lists": "<ol><li>x" * (MB // 9),
    "quotes of quotes": "<blockquote>x" * (MB // 13),
    "a long cell over many rows": "<table><tr><td>" + "w" * (MB // 2) + "<td>e" + "<tr><td><td>x" * (MB // 26),
    "a cell of many lines beside many cells": "<table><tr><td>" + "x<br>" * (MB // 10) + "<td>y" * (MB // 10),
    "tags that a quote leaves open": "<p " * (MB // 3) + "'>",
    "quotes left open": "<p a='" + '<p a="' * (MB // 6) + ">",
    "blocks in a button": "<p><button>" + "<div>" * (MB // 5),
    "stray ends": "<b>" * (MB // 8) + "</i></p>" * (MB // 16),
    "less-than signs": "<" * MB,
    "comments": "<!-- " * (MB // 5),
    "ampersands": "&am" * (MB // 3),
    "style tags": "<style" * (MB // 6) + "display:",
    "style rules": "<style>" + ".a.b,.c{display:none}" * (MB // 42) + "</style>" + "<p class=c>" * (MB // 22),
    "blanks": "<p>a" + " " * MB + "b<pre>" + "\n" * 1000 + "</pre>",
    "drawings": "<svg><text>a<math><mi>b" * (MB // 23),
    "attributes": "<p " + "a=b " * (MB // 4) + ">x",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_and_length_grow_with_the_page(name):
    page = HOSTILE[name]
    took = []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        out = html.render(part)
        took.append(time.process_time() - began)
        assert len(out) <= 200 * len(part), name
    assert took[1] < 12 and took[1] < 10 * took[0] + 2, took


def test_nothing_is_lost_in_deep_or_wide_markup():
    for page in ("<table><td>a<td>b" * 3000, "<dd>a" * 3000, "<table>" + "<tr><td colspan=1000 rowspan=9>a<td>b" * 3000):
        assert html.render(page).count("a") == 3000


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_pages_against_a_second_renderer(sf):
    pages = pq.read_table(f"/root/testdata/{sf}/pages.parquet", columns=["html"]).column(0).to_pylist()
    for p in pages:
        assert html.render(p) == brute.visible_text(p)
    assert len(pages) >= 50
