import time

import pytest

from solvara.llm.html_text import html_text, rendered

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<h1>T</h1><div>x</div><div>y</div>", "T\n\nx\ny"),
    ("<title>t</title><script>var a='<p>'</script><style>p{}</style>x", "x"),
    ("<div hidden>a</div><div style='display: none'>b</div><i style='visibility:hidden'>c</i>d", "d"),
    ("<style>.no,#q{display:none} p.z{visibility:hidden}</style><b class='x no'>1</b><b id=q>2</b><p class=z>3</p>4", "4"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>x<table><tr><td>1<td>2</table></table>", "x\n\n1  2"),
    ("<pre> a\n  b</pre>", " a\n  b"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
    ("1 < 2 <b>3", "1 < 2 3"),
    ("<!-- c --><!DOCTYPE html>a<!-- open", "a"),
    ("<p>a</p></p>b", "a\n\nb"),
    ("a <b> b</b> c", "a b c"),
    ("<textarea>t<b></textarea>", "t<b>"),
    ("x<hr>y", "x\n\n---\n\ny"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_layout(html, text):
    assert rendered(html) == text


def test_broken_pages_take_linear_time():
    for unit in ("<", "<a ", "<div>", '<a b="', "<li>", "</div>", "<table>", "<p><b>", "<ul><li>x", "<b><div>", "<b id=x><i><div></b>", "<button><p>", "<table><tr><td>", "<svg>", "<dl><dd>"):
        start = time.process_time()
        rendered(unit * 15_000)
        assert time.process_time() - start < 20


def test_tables(spark):
    rows = [(1, "<p>a", 5), (2, None, 6), (None, "", 7), (1, "<p>a", 5)]
    df = html_text(spark.createDataFrame(rows, "page_id long, html string, text int"))
    assert [(r.page_id, r.text) for r in df.collect()] == [(1, "a"), (2, None), (None, ""), (1, "a")]
    assert df.limit(0).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<style>@media print{.n{display:none}}</style><b class=n>1</b>", "1"),
        ("<style>@media (max-width:600px){.n{display:none} .m{display:none}} .k{display:none}</style><b class=n>1</b><b class=m>2</b><b class=k>3</b>", "12"),
        ("<style>@media screen{.n{display:none}} @media only screen, print{.m{display:none}}</style><b class=n>1</b><b class=m>2</b>3", "3"),
        ("<style media=print>.n{display:none}</style><b class=n>1</b>", "1"),
        ("<style>.m.open{display:block}.m{display:none}</style><b class=m>1</b><b class='m open'>2</b>", "2"),
        ("<style>.m{display:none}.m{display:block}.k{display:none!important}.k{display:block}</style><b class=m>1</b><b class=k>2</b>", "1"),
        ("<style>.m{display:none}.k{display:none!important}</style><b class=m style='display:inline'>1</b><b class=k style='display:inline'>2</b>", "1"),
        ("<style>.m{content:'}.k{display:none}'}</style><b class=k>1</b>", "1"),
        ("a <svg><title>t</title><defs/><path d='x'/><text>one</text> <text>two</text></svg> b", "a one two b"),
        ("<math><mi>x</mi> <mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
        ("<svg><path d='x'><p>kept</p>", "kept"),
    ],
)
def test_conditions_cascade_and_foreign_text(html, text):
    assert rendered(html) == text


@pytest.mark.parametrize("html, text", [
    ("<style>.m .h{display:none}</style><div class=m><p><b class=h>no</b>yes</p></div><b class=h>too</b>", "yes\n\ntoo"),
    ("<style>ul > li.h{display:none}</style><ul><li class=h>no<li>yes</ul>", "- yes"),
    ("<style>div > b{display:none}</style><div><i><b>shown</b></i><b>no</b></div>", "shown"),
    ("<style>.a > .b .c{display:none}</style><div class=a><div class=b><p><i class=c>no</i>x</div></div><div class=b><i class=c>y</i></div>", "x\n\ny"),
    ("<style>.b > .c{display:none}</style><div class=b><div class='b q'><i class=c>no</i></div>x</div>", "x"),
    ("<style>* .h{display:none}</style><p><b class=h>no</b>x", "x"),
    ("<style>#a .h{display:none} .h{display:inline}</style><p id=a><b class=h>no</b>x", "x"),
    ("<style>.h + p{display:none} a:hover{display:none}</style><p class=h>x<p><a>no</a><p><a>y</a>", "x\n\ny"),
    ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no</div>", "yes"),
    ("<div style='visibility:hidden'><ul><li>no</ul><hr><p style='visibility:inherit'>no</p></div>x", "x"),
    ("<div style='visibility:hidden'><div style='display:block'>no</div></div>x", "x"),
    ("<p style='display:hidden'>x", "x"),
    ("<div style='display:none'><p style='visibility:visible'>no</p></div>x", "x"),
    ("<table><tr><td>日本<td>b<tr><td>abcde<td>d</table>", "日本   b\nabcde  d"),
    ("<table><tr><td>ée<td>b<tr><td>abc<td>d</table>", "ée   b\nabc  d"),
])
def test_combinators_visibility_and_width(html, text):
    assert rendered(html) == text


def test_deep_selectors_stay_cheap():
    import time

    page = "<style>" + "".join(f"div div .x{i} > .y{'{'}display:none{'}'}" for i in range(40)) + "</style>" + "<div>" * 200 + "<p class=y>text</p>" * 300
    start = time.perf_counter()
    assert rendered(page).count("text") == 300 and time.perf_counter() - start < 10


DEEP = "<div>" * 300


@pytest.mark.parametrize("html, text", [
    (DEEP + "<p style='display:none'>no</p>yes", "yes"),
    (DEEP + "<table><tr><td>x<td>y</table>", "x  y"),
    (DEEP + "<style>div .h > b{display:none}</style><p class=h><b>no</b>yes</p>", "yes"),
    ("<ul><li>" * 300 + "x", "  " * 40 + "- x"),
])
def test_depth_changes_nothing(html, text):
    assert rendered(html) == text


@pytest.mark.parametrize("html, text", [
    ("a<!-->b-->c", "ab-->c"), ("a<!--->b", "ab"), ("a<!--x--!>b", "ab"), ("a</>b</3>c", "abc"), ("a</", "a</"),
    ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"),
    ("<p><i>one<p>two</i> three", "one\n\ntwo three"),
    ("<b class=h>a<p>b</b>c</p><style>.h{display:none}</style>", "c"),
    ("<b>1<i class=h>2<div>3</b>4</i>5</div>6<style>.h{display:none}</style>", "1\n5\n6"),
    ("<b>a<div>x<div>y</b>z</div>w</div>v", "a\nx\nyz\nw\nv"),
    ("<p title=it's>a</p>b", "a\n\nb"), ('<p class="a"">x', "x"), ("<a title='>'>x</a>", "x"),
    ("<ul><li>a<table><tr><td><li>b</table><li>c</ul>", "- a\n\n- b\n\n- c"),
    ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"), ("<ol reversed start=7><li>a<li>b</ol>", "7. a\n6. b"),
    ("<form>x <input type=submit value=Go> <input type=submit><input type=text value=q><input type=submit hidden></form>", "x Go Submit"),
])
def test_comments_formatting_and_controls(html, text):
    assert rendered(html) == text


@pytest.mark.parametrize("style, text", [
    ("[data-x]", "bcdef"), ("b[lang|=en]", "acdef"), ("a[href^='/ad']", "abdef"), ("[title~=w]", "abcef"), ("[k=\"z, {z\" i]", "abcdf"), ("[title*=v]", "abcef"), ("[href$='s'], #q", "abde"),
    ("b + b", "acdef"), ("b ~ a", "abdef"), ("b + b ~ i", "abc"), ("b + i", "abcdef"), ("a>b", "abcdef"), ("p > a + i", "abcef"), ("i:first-child, b", "abcdef"), ("", "abcdef"), ("+ b", "abcdef"),
])
def test_selectors(style, text):
    if style.endswith(", b"):
        text = text.replace("a", "").replace("b", "")
    page = f"<style>i{{content:'}} ; display:none;'}} {style}{{display:none}}</style><p><b data-x>a</b><b lang=en-us>b</b><a href=/ads>c</a><i title='v w'>d</i><i k='Z, {{Z'>e</i><i id=q>f</i></p>"
    assert rendered(page) == text


def plainly(html: str) -> str:
    """The layout of simple pages, by replacing tags one after another: no tree, no cascade."""
    import re
    from html import unescape

    html = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<!DOCTYPE[^>]*>", "", html)
    html = re.sub(r"[ \t\r\n\f]+", " ", html)
    blocks = r"</?(?:p|h[1-6]|ul|li|div|nav|article|footer|body|html)\b"
    html = re.sub(rf"(<p[ >](?:(?!{blocks}).)*)(?={blocks})", r"\1</p>", html)  # any block ends a paragraph
    html = re.sub(r"<br>", "\x01", html)
    html = re.sub(r"</?(?:p|h[1-6]|ul)(?: [^>]*)?>", "\x02", html)
    html = re.sub(r"<li>", "\x03- ", html)
    html = re.sub(r"</?(?:div|li|nav|article|footer|body|html)(?: [^>]*)?>", "\x03", html)
    html = re.sub(r"</?(?:a|b)(?: [^>]*)?>", "", html)
    html = re.sub(r" *([\x01\x02\x03]) *", r"\1", unescape(html))
    html = re.sub(r"\x03- ", "\x03-\x00", html)
    html = re.sub(r"[\x01\x02\x03]*\x02[\x01\x02\x03]*", "\n\n", html)
    return re.sub(r"[\x01\x03]+", "\n", html).replace("\x00", " ").strip("\n ")


def test_all_pages_as_a_plain_renderer_lays_them_out():
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html.dropna()
    for html in pages:
        assert rendered(html) == plainly(html)
