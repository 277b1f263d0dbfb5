"""HTML of papers as markdown, and as a body to show locally; small helpers for Arrow batches.

A page is folded while it is read: each element gathers what its children gave and turns
into text when it ends, so no tree is built.
"""

from __future__ import annotations

import html as entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.cluster import ship

#: Elements and classes that are no part of a paper's text, and elements without an end.
CHROME_TAGS = ["nav", "header", "footer", "script", "style"]
CHROME_CLASSES = ["ltx_TOC", "ltx_page_navbar", "ltx_dates", "ltx_authors", "ltx_title_document"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
#: Signs around text of a class.
FONTS = {"ltx_font_bold": "**", "ltx_font_italic": "*", "ltx_font_typewriter": "`"}


class _Element:
    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs = tag, attrs
        self.classes = (attrs.get("class") or "").split()
        self.out: list[str] = []  # what children turned into
        self.raw: list[str] = []  # the text below, as it stands
        self.items: list = []  # items of a list, rows of a table, cells of a row, keys of a citation
        self.caption: str | None = None


def _one_line(text: str) -> str:
    return " ".join(text.split())


class _Fold(HTMLParser):
    """Calls `ended(element)` for the text of each element; `root` is the paper, else the body, else all."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Element("", {})]
        self.papers: list[str] = []
        self.bodies: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open.append(_Element(tag, dict(attrs)))
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and any(e.tag == tag for e in self.open[1:]):
            while self.open[-1].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        self.open[-1].out.append(self.text(data))
        self.open[-1].raw.append(data)

    def _end(self) -> None:
        e = self.open.pop()
        inner = "".join(e.out)
        if e.tag == "article" and "ltx_document" in e.classes:
            self.papers.insert(0, inner)  # the outermost ends last
        elif e.tag == "body":
            self.bodies.append(inner)
        if e.tag in CHROME_TAGS or any(c in CHROME_CLASSES for c in e.classes):
            return
        above = self.open[-1]
        above.out.append(self.ended(e, inner))
        above.raw += e.raw

    def root(self, page: str) -> str:
        self.feed(page)
        self.close()
        while len(self.open) > 1:
            self._end()
        return self.papers[0] if self.papers else self.bodies[0] if self.bodies else "".join(self.open[0].out)

    def text(self, data: str) -> str:
        return data

    def ended(self, e: _Element, inner: str) -> str:
        raise NotImplementedError


class _Markdown(_Fold):
    def ended(self, e: _Element, inner: str) -> str:
        above = self.open[-1]
        rule = getattr(self, f"end_{e.tag}", None)
        if rule is not None:
            return rule(e, inner, above)
        if "ltx_tag" in e.classes and any(o.tag in ("h2", "h3", "h4", "h5", "h6") for o in self.open):
            return ""  # numbers of sections; those of figures stay
        for name, sign in FONTS.items():
            if name in e.classes:
                return sign + inner + sign
        return inner

    def end_math(self, e: _Element, inner: str, above: _Element) -> str:
        source = e.attrs.get("alttext")
        sign = "$$" if e.attrs.get("display") == "block" else "$"
        return sign + ("".join(e.raw) if source is None else source) + sign

    def end_h1(self, e: _Element, inner: str, above: _Element) -> str:
        return ""

    def _heading(self, e: _Element, inner: str, above: _Element) -> str:
        title = _one_line(inner)
        level = 2 if "ltx_title_abstract" in e.classes else int(e.tag[1])
        return f"\n{'#' * level} {title}\n\n" if title else ""

    end_h2 = end_h3 = end_h4 = end_h5 = end_h6 = _heading

    def end_p(self, e: _Element, inner: str, above: _Element) -> str:
        return inner + "\n\n"

    def end_br(self, e: _Element, inner: str, above: _Element) -> str:
        return "\n"

    def end_img(self, e: _Element, inner: str, above: _Element) -> str:
        return ""

    def end_a(self, e: _Element, inner: str, above: _Element) -> str:
        for o in self.open:
            if o.tag == "cite":
                o.items.append(" ".join(x.strip() for x in e.raw if x.strip()))
        label, href = _one_line(inner), e.attrs.get("href") or ""
        return f"[{label}]({href})" if href and not href.startswith("#") else label

    def end_cite(self, e: _Element, inner: str, above: _Element) -> str:
        return f"[{', '.join(e.items)}]" if e.items else ""

    def end_pre(self, e: _Element, inner: str, above: _Element) -> str:
        return f"\n```\n{''.join(e.raw)}\n```\n\n"

    def end_code(self, e: _Element, inner: str, above: _Element) -> str:
        return f"`{''.join(e.raw)}`"

    def end_li(self, e: _Element, inner: str, above: _Element) -> str:
        if above.tag not in ("ul", "ol"):
            return inner
        above.items.append(_one_line(inner))
        return ""

    def end_ul(self, e: _Element, inner: str, above: _Element) -> str:
        return "\n" + "".join(f"- {x}\n" for x in e.items) + "\n"

    def end_ol(self, e: _Element, inner: str, above: _Element) -> str:
        return "\n" + "".join(f"{k}. {x}\n" for k, x in enumerate(e.items, 1)) + "\n"

    def _cell(self, e: _Element, inner: str, above: _Element) -> str:
        if above.tag == "tr":
            above.items.append(_one_line(inner).replace("|", "\\|"))
        return inner

    end_td = end_th = _cell

    def end_tr(self, e: _Element, inner: str, above: _Element) -> str:
        table = next((o for o in reversed(self.open) if o.tag == "table"), None)
        if table is None:
            return inner
        if e.items:
            table.items.append(e.items)
        return ""

    def end_table(self, e: _Element, inner: str, above: _Element) -> str:
        if not e.items:
            return ""
        width = max(map(len, e.items))
        rows = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in e.items]
        rows.insert(1, "| " + " | ".join(["---"] * width) + " |")
        return "\n" + "\n".join(rows) + "\n"

    def end_figcaption(self, e: _Element, inner: str, above: _Element) -> str:
        """A caption goes to the front of the outermost figure around it that has none yet."""
        figure = next((o for o in self.open if o.tag == "figure" and o.caption is None), None)
        if figure is None:
            return inner
        figure.caption = _one_line(inner)
        return ""

    def end_figure(self, e: _Element, inner: str, above: _Element) -> str:
        return inner if e.caption is None else f"\n*{e.caption}*\n\n{inner}"


class _LocalView(_Fold):
    """The paper's HTML with absolute picture addresses and formulas between the signs of a browser's typesetter."""

    def __init__(self, base: str):
        super().__init__()
        self.base = base

    def text(self, data: str) -> str:
        return entities.escape(data, quote=False)

    def ended(self, e: _Element, inner: str) -> str:
        if e.tag == "math":
            source = e.attrs.get("alttext")
            left, right = ("$$", "$$") if e.attrs.get("display") == "block" else ("\\(", "\\)")
            return left + self.text("".join(e.raw) if source is None else source) + right
        source = e.attrs.get("src") if e.tag == "img" else None
        if source and not source.startswith(("http://", "https://", "/")):
            e.attrs["src"] = self.base + source
        given = "".join(f" {k}" if v is None else f' {k}="{entities.escape(v)}"' for k, v in e.attrs.items())
        return f"<{e.tag}{given}/>" if e.tag in VOID else f"<{e.tag}{given}>{inner}</{e.tag}>"


def markdown(page: str | None) -> str | None:
    """Markdown of a page: no trailing white space, one blank line at most, one line break at the end."""
    if page is None:
        return None
    out: list[str] = []
    for line in map(str.rstrip, _Markdown().root(page).splitlines()):
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip() + "\n"


def local_view(page: str | None, paper: str | None) -> str | None:
    return None if page is None else _LocalView(f"https://arxiv.org/html/{paper}/").root(page)


@F.pandas_udf(StringType())
def _markdown(page: pd.Series) -> pd.Series:
    return page.map(markdown)


@F.pandas_udf(StringType())
def _local_view(page: pd.Series, paper: pd.Series) -> pd.Series:
    return pd.Series([local_view(h, p) for h, p in zip(page, paper, strict=True)], dtype=object)


def html_to_markdown(page: Column) -> Column:
    """Headings, paragraphs, lists, tables, figures, citations, formulas, code and links as markdown; null stays null."""
    ship(SparkSession.active())
    return _markdown(page)


def html_local_view(page: Column, paper: Column) -> Column:
    """The body to show for a paper's id: chrome left out, picture addresses absolute, formulas for a browser's typesetter."""
    ship(SparkSession.active())
    return _local_view(page, paper)
