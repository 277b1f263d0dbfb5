"""Bracketed wiki markup that regexes cannot follow: templates, tables, info boxes and formulas of one text.

Small helpers for Arrow batches (`operators.chunks`). They read a text once, keep a stack
of what is open and look closings up in a list made once, so unclosed or deeply nested
markup takes no longer than other text. Nothing recurses.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

#: Templates that are formulas, chemical formulas, tables of species and lists.
MATH_NAMES = ["math", "tmath", "mvar", "bigmath"]
CHEM_NAMES = ["chem", "chem2", "mhchem", "ce"]
TAXON_NAMES = ["speciesbox", "taxobox", "automatic taxobox"]
LIST_NAMES = ["plainlist", "flatlist"]
#: Beginnings of fields of an info box that hold no text.
IMAGE_FIELDS = [
    "image", "img", "logo", "flag", "coat", "map", "photo", "picture", "banner", "seal", "shield", "emblem",
    "signature", "sound", "audio", "video",
]
#: Tags whose bodies are no text.
SILENT_TAGS = ["ce", "chem", "gallery", "graph", "imagemap", "math", "score", "timeline"]

_BRACKETS = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_FORMULA_OPEN = re.compile(r"(?i)\{\{\s*(" + "|".join(MATH_NAMES + CHEM_NAMES) + r")\s*([|}])")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_MEDIA = re.compile(r"(?i)\s*(?:file|image|media)\s*:")
_WEB_LINK = re.compile(r"\[(?:https?:|ftp:)?//[^\s\[\]]+([^\[\]]*)\]")


def _next(places: list[int], at: int) -> int:
    """The first of sorted places from `at` on; -1 if there is none."""
    k = bisect_left(places, at)
    return places[k] if k < len(places) else -1


def _uncommented(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (z := text.find("-->", a + 4)) >= 0:
        out.append(text[at:a])
        at = z + 3
    return "".join([*out, text[at:]])


def _elements(text: str, names: list[str], inside: Callable[[str], str], slash: bool = True, single: bool = False) -> str:
    """`inside(body)` in place of each element of the tags `names`, in any case; unclosed ones stay.

    Without `slash` an opening tag holds none; with `single` tags that close themselves go.
    """
    shape = "|".join(names)
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in re.finditer(rf"(?i)</({shape})\s*>", text):
        ends.setdefault(m[1].lower(), []).append(m.span())
    rights, slashes = [m.start() for m in re.finditer(">", text)], [m.start() for m in re.finditer("/", text)]
    out, at = [], 0
    for m in re.finditer(rf"(?i)<({shape})\b", text):
        right = _next(rights, m.end())
        if m.start() < at or right < 0:
            continue
        closing = ends.get(m[1].lower(), [])
        k = bisect_left(closing, (right + 1,))
        slashed = 0 <= _next(slashes, m.end()) < right
        if k < len(closing) and not (slashed and not slash):
            out += [text[at : m.start()], inside(text[right + 1 : closing[k][0]])]
            at = closing[k][1]
        elif single and slashed and text[right - 1] == "/":
            out.append(text[at : m.start()])
            at = right + 1
    return "".join([*out, text[at:]])


def every_template(text: str) -> list[tuple[int, int, list[int], bool]]:
    """(start, end, bars, outermost) of all templates in order, but those in links; a bar in an inner template or link is not the outer one's."""
    out: list[tuple[int, int, list[int], int]] = []
    open_: list[tuple[str, int, list[int], int]] = []  # sign, place, bars, place of the template around it: -1 for none, -2 in a link
    for m in _BRACKETS.finditer(text):
        sign, at = m[0], m.start()
        if sign in ("{{", "[["):
            around = -1 if not open_ else open_[-1][1] if open_[-1][0] == "{{" else -2
            open_.append((sign, at, [], around))
        elif sign == "|":
            if open_ and open_[-1][0] == "{{":
                open_[-1][2].append(at)
        elif sign == "]]":
            if open_ and open_[-1][0] == "[[":
                open_.pop()
        else:
            while open_ and open_[-1][0] == "[[":
                open_.pop()  # a link that is never closed ends with the template around it
            if open_:
                _, start, bars, around = open_.pop()
                out.append((start, m.end(), bars, around))
    found, kept = [], {-1}
    for start, end, bars, around in sorted(out):
        if around in kept:  # what stands around it is closed, and no link
            kept.add(start)
            found.append((start, end, bars, around == -1))
    return found


def _parts(text: str, start: int, end: int, bars: list[int]) -> list[str]:
    cuts = [start + 1, *bars, end - 2]
    return [text[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]


def templates(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, parts) of the outermost templates; parts are cut at the bars that stand in no inner template or link."""
    return [(start, end, _parts(text, start, end, bars)) for start, end, bars, outermost in every_template(text) if outermost]


def _named(part: str) -> tuple[str | None, str]:
    """Name and value of a template's part; no name for one by position."""
    at = part.find("=")
    inner = min((k for k in (part.find("{{"), part.find("[["), part.find("<")) if k >= 0), default=len(part))
    return (part[:at].strip(), part[at + 1 :]) if 0 <= at < inner else (None, part)


def plain(text: str) -> str:
    """Text without comments, templates, silent tags, media links and quotes; labels of links and insides of tags stay."""
    text = _folded(_elements(_uncommented(text), SILENT_TAGS, lambda body: "", slash=False), "{{", "}}", lambda body: "")
    text = _TAG.sub("", _folded(text, "[[", "]]", _label))
    return re.sub("'{2,5}", "", _WEB_LINK.sub(lambda m: m[1].strip(), text)).strip()


def _label(link: str) -> str:
    target, bar, label = link.partition("|")
    return "" if _MEDIA.match(link) else label if bar else target


def _folded(text: str, left: str, right: str, render: Callable[[str], str]) -> str:
    """`render(body)` in place of what stands between brackets, innermost first; unpaired brackets stay."""
    stack: list[list[str]] = [[]]
    at = 0
    for m in re.finditer(re.escape(left) + "|" + re.escape(right), text):
        stack[-1].append(text[at : m.start()])
        at = m.end()
        if m[0] == left:
            stack.append([])
        elif len(stack) > 1:
            body = "".join(stack.pop())
            stack[-1].append(render(body))
        else:
            stack[-1].append(right)
    stack[-1].append(text[at:])
    return left.join("".join(pieces) for pieces in stack)


def link_targets(text: str) -> list[str]:
    """Targets of all closed links in order, those inside of templates and of other links too; comments hold none."""
    text, found, stack = _uncommented(text), [], []
    for m in re.finditer(r"\[\[|\]\]", text):
        if m[0] == "[[":
            stack.append(m.end())
        elif stack:
            begin = stack.pop()
            found.append((begin, re.split(r"[|#]|\[\[", text[begin : m.start()], maxsplit=1)[0].strip()))
    return [target for _, target in sorted(found) if target and "\n" not in target]


def _formula_ends(text: str) -> Callable[[int], int]:
    """For a place in `text`, where the braces that close a template open there begin, single ones inside counted; -1 if they are missing."""
    braces = [(m.start(), m[0]) for m in re.finditer(r"[{}]", text)]
    waiting, partner = [], {}
    for k, (_, sign) in enumerate(braces):
        if sign == "{":
            waiting.append(k)
        elif waiting:
            partner[waiting.pop()] = k
    ends = [-1] * (len(braces) + 1)
    for k in range(len(braces) - 1, -1, -1):  # from the back: the answer for a place before each brace
        at, sign = braces[k]
        if sign == "{":
            ends[k] = ends[partner[k] + 1] if k in partner else -1
        else:
            ends[k] = at if text.startswith("}}", at) else ends[k + 1]
    places = [at for at, _ in braces]
    return lambda at: ends[bisect_left(places, at)]


def _top_level(body: str) -> list[str]:
    """A template's body cut at the bars outside of braces."""
    depth, cuts = 0, [-1]
    for m in re.finditer(r"[{}|]", body):
        if m[0] == "|":
            if not depth:
                cuts.append(m.start())
        else:
            depth = depth + 1 if m[0] == "{" else max(0, depth - 1)
    cuts.append(len(body))
    return [body[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]


def inline_formulas(text: str) -> str:
    """Formulas as text: the bodies of `math`, `chem` and `ce` tags, the first part of formula templates, the parts of chemical ones in a row; named parts go."""
    out, at, end_of = [], 0, _formula_ends(text)
    while m := _FORMULA_OPEN.search(text, at):
        out.append(text[at : m.start()])
        if m[2] == "}":
            empty = text.startswith("}}", m.end() - 1)
            out.append("" if empty else m[0])
            at = m.end() + empty
            continue
        end = end_of(m.end())
        if end < 0:
            out.append(m[0])
            at = m.end()
            continue
        body = text[m.end() : end]
        if m[1].lower() in CHEM_NAMES:
            out.append("".join(p for p in _top_level(body) if "=" not in p))
        else:
            out.append(re.sub(r"^\s*1\s*=", "", body).strip())
        at = end + 2
    return _elements("".join([*out, text[at:]]), ["math", "chem", "ce"], lambda body: body)


def packed_lines(head: str, lines: list[str], limit: int) -> list[str]:
    """Texts of `head` and as many lines as fit in `limit` characters; a line that does not fit alone stays whole."""
    out: list[list[str]] = []
    size = limit + 1
    for line in lines:
        if size + 1 + len(line) > limit:
            out.append([head])
            size = len(head)
        out[-1].append(line)
        size += 1 + len(line)
    return ["\n".join(x) for x in out]


def _flat(text: str) -> str:
    return plain(text).replace("\n", " ")


def _cell(text: str) -> str:
    """A cell's text; what stands before a bar are attributes, unless a link begins there."""
    before, bar, after = text.strip().partition("|")
    return _flat(after if bar and "[" not in before else text)


class _Table:
    """Rows of one table, fed line by line; tables inside of cells are passed over."""

    def __init__(self) -> None:
        self.caption, self.head, self.rows, self.open, self.is_head = "", [], [], [], False

    def end_row(self, last: bool = False) -> None:
        if self.open:
            if self.is_head or last and not self.rows and not self.head:
                self.head = self.open
            else:
                self.rows.append(self.open)
        self.open, self.is_head = [], False

    def feed(self, line: str) -> None:
        if line.startswith("|+"):
            self.caption = _flat(line[2:])
        elif line.startswith("|-"):
            self.end_row()
        elif line[:1] in ("!", "|"):
            self.is_head |= line[0] == "!"
            self.open += map(_cell, line[1:].split(line[0] * 2))
        elif line and self.open:
            self.open[-1] = f"{self.open[-1]} {_flat(line)}".strip()

    def lines(self) -> list[str]:
        self.end_row(last=True)
        if not self.head and self.rows:
            self.head = self.rows.pop(0)
        names = lambda k: self.head[k] if k < len(self.head) else f"col{k + 1}"
        found = (" | ".join(f"{names(k)}: {c}" for k, c in enumerate(row) if c) for row in self.rows)
        return [x for x in found if x]


def cut_tables(text: str) -> tuple[list[tuple[str, list[str]]], str]:
    """((heading, rows) of each closed table, the text with empty lines in their place); unclosed tables stay as they are."""
    lines = text.split("\n")
    opens = [bool(re.match(r"\s*\{\|", x)) for x in lines]
    closes = [bool(re.match(r"\s*\|\}", x)) for x in lines]
    # from the back: where a table that begins at a line ends, by the closings that wait for their opening
    ends, waiting = {}, []
    for k in range(len(lines) - 1, -1, -1):
        if closes[k]:
            waiting.append(k)
        elif re.match(r"[:\s]*\{\|", lines[k]) and waiting:
            ends[k] = waiting[-1]
            if opens[k]:
                waiting.pop()
    tables, k = [], 0
    while k < len(lines):
        if k not in ends:
            k += 1
            continue
        table, depth = _Table(), 0
        for j in range(k + 1, ends[k]):
            depth += opens[j]
            if not depth:
                table.feed(lines[j].strip())
            depth -= closes[j]
        rows = table.lines()
        if rows:
            tables.append((f"Table: {table.caption or 'untitled'}", rows))
        after = ends[k] + 1
        lines[k:after] = [""] * (after - k)
        k = after
    return tables, "\n".join(lines)


def _value(raw: str) -> str:
    """A field's text; of one that holds templates only, the items of a list or the parts by position."""
    text = plain(raw)
    if text:
        return text
    items, loose = [], []
    for start, end, bars, _ in every_template(raw):
        name, *parts = _parts(raw, start, end, bars)
        if name.strip().lower() in LIST_NAMES and not items:
            for key, value in map(_named, parts):
                if key not in ("style", "class", "indent") and not items:
                    value = _elements(value, ["ref"], lambda body: "", slash=False, single=True)
                    items = [x for x in (plain(line.strip().lstrip("*#")) for line in value.split("\n")) if x]
        loose += [v.strip() for key, v in map(_named, parts) if (key is None or key.isdigit()) and v.strip()]
    return " / ".join(items) if items else " ".join(loose)


def info_boxes(text: str, title: str) -> list[tuple[str, list[str]]]:
    """(heading, `field: value` lines) of each outermost info box or species box; pictures and empty fields are left out."""
    found = []
    for _, _, (name, *parts) in templates(text):
        name = _uncommented(name).strip()
        fields = [(str(k + 1) if key is None else key, v.strip()) for k, (key, v) in enumerate(map(_named, parts))]
        if name.lower().startswith("infobox"):
            kind = name[len("infobox") :].strip(" _")
            head, hidden = f"Infobox: {title}" + (f" — {kind}" if kind else ""), ""
        elif name.lower() in TAXON_NAMES:
            common = dict(fields).get("name", "")
            head, hidden = f"Taxon: {title}" + (f" ({common})" if common else ""), "name"
        else:
            continue
        lines = []
        for field, raw in fields:
            low = field.lower()
            value = "" if low == hidden or low.startswith(tuple(IMAGE_FIELDS)) else _value(raw).replace("\n", " / ").strip()
            if value:
                lines.append(f"{field}: {value}")
        if lines:
            found.append((head, lines))
    return found
