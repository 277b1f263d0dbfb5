"""Text functions on small texts, some against independent implementations."""

import random
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import text as X
from lodestone.functions import tokens as T
from lodestone.functions import wikitext as W
from lodestone.operators import chunks as C


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_redirects(spark):
    texts = ["#REDIRECT [[apple pie#top|x]]", "  # redirect [[B]]", "#REDIRECT [[open", "text #REDIRECT [[A]]", "", None]
    assert values(spark, X.redirect_target(F.col("t")), texts) == ["Apple pie", "B", None, None, None, None]
    assert values(spark, X.is_redirect(F.col("t")), texts) == [True, True, True, False, False, None]
    odd = ["#redirect [[\n a b\t]]", "#REDIRECT [[A|x\ny]]", "#REDIRECT [[A#b|c#d]]", "#REDIRECT [[ ]]", "#REDIRECT [[|x]]", "#REDIRECT [[A] ]", "#REDIRECT[[ß]]", "\u00a0#REDIRECT [[\u3000x]]"]
    assert values(spark, X.redirect_target(F.col("t")), odd) == ["A b", "A", "A", None, None, None, "SS", "X"]


def test_links(spark):
    texts = ["[[b]] [[B#x|y]] [[ c ]] [[File:x]] [[:d]] [[A]] [[e", "no", ""]
    assert values(spark, X.links(F.col("t"), F.lit("A")), texts) == [["B", "C", "E"], [], []]
    odd = ["[[\n b]] [[\tc\t|x]] [[d\ne]] [[ \u00a0f]] [[]] [[ ]]"]
    assert values(spark, X.links(F.col("t"), F.lit("A")), odd) == [["B", "C", "D", "F"]]


def test_namespaces(spark):
    named = "Category: File: Image: Media: Help: User: User talk:|Talk: Wikipedia: WP: Template: Template talk:|Portal: Special: Module: MediaWiki: Book: Draft: TimedText: Education Program:|"
    names = [n.strip().replace("|", "") for n in re.findall(r"[A-Z][A-Za-z]*(?: talk| Program)?:", named)]
    assert len(set(names)) == len(X.EXCLUDED_NAMESPACES) == 20 and set(names) == set(X.EXCLUDED_NAMESPACES)
    texts = [f"[[{n}x]] [[{n.lower()}y]]" for n in names] + ["[[Topic:x]] [[Wikipedia talk:y]]"]
    got = values(spark, X.links(F.col("t"), F.lit("A")), texts)
    assert got[-1] == ["Topic:x", "Wikipedia talk:y"]
    # the test is case-sensitive, but a link's first letter is raised before it
    assert all(g == ([] if n[1:] == n[1:].lower() else [n[0] + n[1:].lower() + "y"]) for g, n in zip(got, names))


def test_sections_and_markup(spark):
    texts = ["lead '''b'''\n== One ==\nbody [[x|label]] {{t|{{u}}}}\n=== Two ===\n<!-- c -->end"]
    (parts,) = values(spark, X.sections(F.col("t")), texts)
    assert [(p.section, p.body) for p in parts][1:] == [("One", "body [[x|label]] {{t|{{u}}}}"), ("Two", "<!-- c -->end")]
    assert parts[0].section is None
    assert values(spark, X.strip_markup(F.col("t")), ["a '''b''' [[x|label]] {{t|{{u}}}}c [[File:q.png|thumb|see [[z]]]]<span>d</span>"]) == ["a b label c d"]


PAPER = """<html><head><title>t</title><style>x</style></head><body><nav>n</nav><article class="ltx_document x">
<h1 class="ltx_title_document">T</h1><div class="ltx_authors">me</div><h6 class="ltx_title ltx_title_abstract">Abstract</h6><p>We  do
<math alttext="x|y" display="inline"><mi>x</mi></math>.</p>
<h2 class="ltx_title"><span class="ltx_tag">1 </span>Intro</h2><p><span class="ltx_font_bold">b</span> <em class="ltx_font_italic">i</em> <span class="ltx_font_typewriter">c</span> <b>plain</b>
<a href="#r">in</a> <a href="http://e.org/">out</a> <cite>(<a href="#b1">[1]</a>, <a href="#b2">Two</a>)</cite> &amp; <code>q</code></p>
<math display="block">z</math>
<ul><li>one <b>1</b></li><li>two</li></ul><ol><li>x<li>y</ol>
<figure><div><figure class="ltx_table"><table><thead><tr><th>A|B</th><th>C</th></tr></thead><tr><td>1</td></tr><tr></tr></table>
<figcaption><span class="ltx_tag">Table 1: </span>Cap</figcaption></figure></div><img src="a.png"></figure>
<pre>a
 b</pre><h3></h3><table></table></article><footer>f</footer></body></html>"""


def test_html(spark):
    (got,) = values(spark, H.html_to_markdown(F.col("t")), [PAPER])
    wanted = """## Abstract

We  do
$x|y$.

## Intro

**b** *i* `c` plain
in [out](http://e.org/) [[1], Two] & `q`

$$z$$

- one 1
- two

1. xy

*Table 1: Cap*

| A\\|B | C |
| --- | --- |
| 1 |  |

```
a
 b
```
"""
    assert got == wanted
    assert values(spark, H.html_to_markdown(F.col("t")), ["<p>a<br>b</p><!-- c --><p>d", "", None, "x</p>y"]) == ["a\nb\n\nd\n", "\n", None, "xy\n"]
    page = '<body><nav>n</nav><p class="a&amp;b">1 &lt; 2 <img src="x.png"><img src="/y.png"><math alttext="a<b">q</math><math display="block">z</math></p></body>'
    assert values(spark, H.html_local_view(F.col("t"), F.lit("12.3")), [page]) == ['<p class="a&amp;b">1 &lt; 2 <img src="https://arxiv.org/html/12.3/x.png"/><img src="/y.png"/>\\(a&lt;b\\)$$z$$</p>']


def test_markup_html(spark):
    texts = [
        "== H ==\n'''b''' ''i'' [[A|b]]s [[Category:C]]",
        "=== A <b>c</b> \"d\" ===\n== = ==\nx  \n\n\n\ny__TOC__ __init__",
        "<nowiki>[[x]] <b></nowiki> <NOWIKI>&</NOWIKI> <nowiki>open",
        "<gallery mode=x>\nFile:a.png|One [[l]]\nimage:b.png\nnote|no\n File:c.png| Two \n</gallery><gallery></gallery><score x>a</score><mapframe a=1/>",
        "a<!-- c -->{{t|{{u|{{v}}}}}}<ref name=x/><ref>r\n</ref><references><ref>q</ref></references><includeonly>no</includeonly><noinclude>yes</noinclude>[[File:x|[[Image:y]] z]]",
    ]
    assert values(spark, X.markup_to_html(F.col("t")), texts) == [
        '<h2 id="H">H</h2>\n<b>b</b> <i>i</i> <a href="/article/A">bs</a>',
        '<h3 id="A_c_&quot;d&quot;">A <b>c</b> "d"</h3>\n<h2 id="=">=</h2>\nx\n\ny __init__',
        "&#91;&#91;x&#93;&#93; &lt;b&gt; &amp; <nowiki>open",
        '<ul class="gallery-captions">\n<li>One <a href="/article/l">l</a></li>\n<li>Two</li>\n</ul><div class="unsupported-content">[unsupported: score]</div><div class="unsupported-content">[unsupported: mapframe]</div>',
        "ayes",
    ]
    assert values(spark, X.snippet(F.col("t")), ["{{box}}'''A''' is [[x|one]] thing here. And more.\n== H =="]) == ["A is one thing here."]


def pack(text, limit):
    """The rule of packing, written out as a loop."""
    if len(text) <= limit:
        return [text]
    parts, open_ = [], ""
    for p in text.split("\n\n"):
        if len(p) > limit and not (open_ and len((open_ + "\n\n" + p).lstrip()) <= limit):
            if open_:
                parts.append(open_)
            open_ = ""
            parts += [p[i : i + limit] for i in range(0, len(p), limit)]
        elif not open_ or len((open_ + "\n\n" + p).lstrip()) <= limit:
            open_ = (open_ + "\n\n" + p).lstrip() if open_ else p
        else:
            parts.append(open_)
            open_ = p
    return parts + [open_] if open_ else parts


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab\n é", max_size=60), min_size=1, max_size=20))
def test_packing(spark, texts):
    assert values(spark, X.pack_paragraphs(F.col("t"), 12), texts) == [pack(t, 12) for t in texts]


def test_porter_against_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter ascii')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    rng = random.Random(1)
    ends = "ing ed s es ies ational tional enci izer ation ator alism iveness fulness ousness aliti biliti logi icate ative alize ical ful ness ance ence able ible ant ement ment ent ion ism ate iti ous ive ize y e ll eed".split()
    roots = "relat condit hop fall fil hopp troubl siz happ vis commun electr adjust depend activ bowdler formal oper triplic controll rat ceas sk y tann agree".split()
    words = sorted({rng.choice(roots) + rng.choice(ends) + rng.choice(["", "", rng.choice(ends)]) for _ in range(1500)})
    for i, w in enumerate(words):
        con.execute("INSERT INTO f(rowid, t) VALUES (?, ?)", (i + 1, w))
    wanted = dict(con.execute("SELECT doc, term FROM v").fetchall())
    assert [(w, T.stem(w)) for w in words] == [(w, wanted[i + 1]) for i, w in enumerate(words)]


def test_bm25_against_sqlite(spark, sf_dir):
    from lodestone.operators.retrieval import bm25

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='ascii')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    wanted = dict(con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH 'the AND of'").fetchall())
    got = dict(bm25(docs, "doc_id", F.col("text"), ["the", "of"]).collect())
    assert set(got) == set(wanted)
    assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_years_of_five_digits(spark):
    given = ["253402300799", "253402300800", "518393913601", "-62135596801", "-62167219201", "-99999999999"]
    wanted = ["9999-12-31 23:59:59", "10000-01-01 00:00:00", "18397-04-01 13:20:01", "0000-12-31 23:59:59", "-1-12-31 23:59:59", "-1199-02-15 14:13:21"]  # DuckDB's strftime
    assert values(spark, X.from_unix(F.col("t").cast("long")), given) == wanted


def test_small_forms(spark):
    assert values(spark, X.from_unix(F.col("t").cast("long")), ["0", "86399", "1700000000", "-1"]) == ["1970-01-01 00:00:00", "1970-01-01 23:59:59", "2023-11-14 22:13:20", "1969-12-31 23:59:59"]
    assert values(spark, X.elapsed(F.col("t").cast("int")), ["5", "65", "3725"]) == ["5s", "1m 5s", "1h 2m"]
    assert values(spark, X.first_sentence(F.col("t")), ["It is one. And two.\n== H ==", "short", "x" * 20 + " y" * 200]) == ["It is one.", "", ("x" * 20 + " y" * 110)[:238].rsplit(" ", 0)[0] + "…"]
    assert values(spark, X.article_path(F.col("t")), ["A b/c?d"]) == ["A_b/c%3Fd"]
    assert values(spark, X.like_prefix(F.col("t"), "a%"), ["A%x", "ab", "ä"]) == [True, False, False]
    assert re.fullmatch("[A-Z][a-z]+", values(spark, X.normalize_title(F.col("t")), ["apple"])[0])


ARTICLE = """{{Infobox person
| name = [[A|Ann]] '''B'''
| image = a.png
| born = {{birth date|1980|1|2}}
| works = {{plainlist|
* [[X|one]]<ref>r</ref>
* two
}}
| none =
}}
Lead {{t|{{u}}}} text<!-- c --> with <math>E=mc^2</math>, {{math|a + b}}, {{chem|H|2|O|link=yes}} and [[File:q.png|thumb|see [[z]]]] more.
== One ==
Before
{| class=w
|+ Cap
! A !! scope=col | B
|-
| style="x" | 1 || [[p|q]]
|-
| 3 || || 5
tail
{|
| inner
|}
|}
After


end
=== Two ===
{| open
| x
"""


def test_article_chunks(spark):
    df = spark.createDataFrame([(1, "T", ARTICLE), (2, "R", "#REDIRECT [[T]]"), (3, "N", None), (4, "E", "")], "k int, title string, t string")
    got = [(r.chunk_type, r.section, r.chunk_index, r.text) for r in C.article_chunks(df, "k", "title", "t").orderBy("place", "chunk_index").collect()]
    assert got == [
        ("infobox", None, 0, "Infobox: T — person\nname: Ann B\nborn: 1980 1 2\nworks: one / two"),
        ("prose", None, 0, "Lead  text with E=mc^2, a + b, H2O and  more."),
        ("table", "One", 0, "Table: Cap\nA: 1 | B: q\nA: 3 | col3: 5 tail"),
        ("prose", "One", 0, "Before\n\nAfter\n\nend"),
        ("prose", "Two", 0, "{| open\n| x"),
    ]


def test_tables(spark):
    wiki = "x\n{|\n| a || b\n|-\n| 1 || 2\n|}\n:{|\n! H\n|-\n|\n| v\nmore\n|}\n{|\n|}\ny"
    df = spark.createDataFrame([(1, wiki)], "k int, t string")
    rows = [(r.table_index, r.heading, r.row) for r in C.table_rows(df, "k", "t").orderBy("table_index", "row_index").collect()]
    assert rows == [(0, "Table: untitled", "a: 1 | b: 2"), (1, "Table: untitled", "col2: v more")]
    assert W.cut_tables(wiki)[1] == "x" + "\n" * 15 + "y"
    assert W.cut_tables("a\n{|\n{|\n| x\n|}\nb")[1] == "a\n{|\n\n\n\nb"
    lines = [f"row {k} " + "x" * k for k in range(40)]
    packs = W.packed_lines("Head", lines, 100)
    assert [x for p in packs for x in p.split("\n")[1:]] == lines and all(p.startswith("Head\n") and (len(p) <= 100 or p.count("\n") == 1) for p in packs)


def test_species_and_formulas():
    text = "{{Speciesbox\n| name = Cat\n| genus = ''Felis''\n| image_alt = x\n}} {{infobox_x}} {{other|{{Infobox y|a=1}}}}"
    assert W.info_boxes(text, "C") == [("Taxon: C (Cat)", ["genus: Felis"])]
    assert W.info_boxes("{{Infobox|a={{b|c|d}}|e=[[f|g]]|h}}", "C") == [("Infobox: C", ["a: c d", "e: g", "3: h"])]
    assert W.inline_formulas("<chem>H2</chem> {{ce|A|B}} {{math|\\frac{a}{b}}} {{tmath|1=x=y}} {{chem}} {{math|open") == "H2 AB \\frac{a}{b} x=y  {{math|open"
    assert W.plain("[//e.org a b] [[A]]s [[b|c|d]] {{x|}} <i>t</i> [[open") == "a b As c|d  t [[open"


@pytest.mark.parametrize("text", ["", None])
def test_chunks_of_nothing(spark, text):
    df = spark.createDataFrame([(1, "t", text)], "k int, title string, t string")
    assert C.article_chunks(df, "k", "title", "t").count() == 0


def test_free_queries_against_sqlite(spark, tmp_path):
    from lodestone.operators import index as I
    from lodestone.operators.retrieval import phrases, sparse_search

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["e-mail", "e mail", "mail", "e", "Été", "x.y", "the", "?", "e-mail-e"]) for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='ascii')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, t string")
    path = str(tmp_path / "index")
    I.write(df, path, "doc_id", F.col("t"))
    for query in ("e-mail", "the E-Mail ?", "mail mail", "Été the", 'x"."y e'):
        match = " AND ".join('"' + w.replace('"', "") + '"' for w in query.split() if phrases(w))
        wanted = dict(con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall())
        for found in (sparse_search(df, "doc_id", F.col("t"), query), I.search(spark, path, query)):
            got = dict(found.collect())
            assert set(got) == set(wanted), query
            assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got), query
    assert I.search(spark, path, '"?" ""').count() == 0
    assert sparse_search(df, "doc_id", F.col("t"), '"?" ""').count() == 0


def test_markup_readers_are_linear():
    """16,000 openers of each kind take no more than twice the time for each that 1,000 take; deep nesting doesn't recurse."""
    import timeit

    from lodestone.functions import wikitext as T

    took = lambda work, text: min(timeit.repeat(lambda: work(text), number=1, repeat=5))  # noqa: E731  without garbage collection

    for opener in ("{{math|", "{{chem|a", "<math>", "<math ", "<ce", "<!-- ", "<ref>", "<ref name=", "[[a|", "{{infobox x|", "[http://a b ", "{|\n", "{", "<gallery"):
        for work in (T.inline_formulas, T.plain, T.link_targets, lambda t: T.info_boxes(t, "t"), T.cut_tables):
            few, many = (took(work, opener * n) for n in (1_000, 16_000))
            assert many <= 2 * 16 * max(few, 2e-4), (opener, few, many)
    deep = "{{infobox x|a={{b|" * 3_000 + "}}" * 6_000
    assert T.info_boxes(deep, "t") and T.plain("[[a|" * 5_000 + "x" + "]]" * 5_000) == "x"


def test_elements_and_formulas():
    from lodestone.functions import wikitext as T

    drop = lambda body: ""
    assert T._elements('a<ref name="x"/>b<ref>c</ref>d<REF>e</ref >f<ref>g', ["ref"], drop, slash=False, single=True) == "abdf<ref>g"
    assert T._elements("<math>x<math>y</math>z</math>", ["math"], lambda b: f"({b})") == "(x<math>y)z</math>"
    assert T._uncommented("a<!-- b -->c<!-- d") == "ac<!-- d"
    assert T.inline_formulas("{{math|a{b}}} {{math|{c}} {{math|d}}}") == "a{b} {{math|{c}} d}"
    text = "{{a|x={{b|1}}|[[l|{{c}}]]|y}} {{d {{e}}"
    assert [(text[a:z][:3], out) for a, z, _, out in T.every_template(text)] == [("{{a", True), ("{{b", False)]
