"""Titles, redirects, links, categories, white space and display forms as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The namespaces whose links are no article links. The test is case-sensitive.
EXCLUDED_NAMESPACES = [
    "Category:", "File:", "Image:", "Media:", "Help:", "User:", "User talk:", "Talk:", "Wikipedia:", "WP:",
    "Template:", "Template talk:", "Portal:", "Special:", "Module:", "MediaWiki:", "Book:", "Draft:", "TimedText:", "Education Program:",
]

#: White space is any that Unicode has, line breaks included.
_REDIRECT = r"(?iU)^\s*#\s*REDIRECT\s*\[\["
HEADING = r"(?m)^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$"
LINK_TARGET = r"(?U)\[\[\s*([^\[\]|\n#]+)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def normalize_title(title: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(title, 1, 1)), F.substring(title, F.lit(2), F.char_length(title)))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def redirect_target(text: Column) -> Column:
    """The normalised title a page redirects to; null if it is no complete redirect.

    What stands between the opening brackets and the first closing ones is cut at its
    label and at its section.
    """
    rest = F.regexp_replace(text, _REDIRECT, "")
    closed = F.substring_index(rest, "]", 1)
    complete = is_redirect(text) & F.startswith(F.substring(rest, F.char_length(closed) + 1, F.lit(2)), F.lit("]]"))
    target = strip(F.substring_index(F.substring_index(closed, "|", 1), "#", 1))
    return F.when(complete, F.nullif(normalize_title(target), F.lit("")))


def is_redirect(text: Column) -> Column:
    """Starts like a redirect, closed or not."""
    return text.rlike(_REDIRECT)


def normalize_target(link: Column) -> Column:
    """A link target without its section."""
    return normalize_title(strip(F.substring_index(link, "#", 1)))


def is_excluded(title: Column) -> Column:
    """Empty, led by a colon, or of a namespace that has no articles."""
    out = (title == "") | title.startswith(":")
    for namespace in EXCLUDED_NAMESPACES:
        out = out | title.startswith(namespace)
    return out


def links(text: Column, own_title: Column) -> Column:
    """Article links of a text in order of first occurrence; links to `own_title` are left out. No closing brackets needed."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(LINK_TARGET), F.lit(1)), lambda t: normalize_title(strip(t)))
    return F.array_distinct(F.filter(targets, lambda t: ~is_excluded(t) & (t != own_title)))


def categories(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)\[\[Category:([^\]|]+)"), F.lit(1))
    return F.transform(found, strip)


def collapse_white_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def first_sentence(text: Column, limit: int = 240) -> Column:
    """The lead up to the first full stop before a capital; else `limit` characters up to a word and an ellipsis; short leads give ''."""
    lead = collapse_white_space(F.regexp_replace(text, r"(?s)\n=.*$", ""))
    sentence = F.regexp_extract(lead, r"^(.*?\.)(?= [A-Z])", 1)
    head = F.substring(lead, 1, limit)
    cut = F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…"))
    out = F.when(sentence != "", sentence).when(F.char_length(lead) <= limit, lead).otherwise(cut)
    return F.when(F.char_length(out) < 10, F.lit("")).otherwise(out)


def like_prefix(column: Column, prefix: str) -> Column:
    """SQL LIKE 'prefix%' with wildcards escaped, letters A-Z of either case."""
    return ascii_lower(column).startswith(prefix.translate(str.maketrans(UPPER, LOWER)))


def document_prompt(title: Column, section: Column, text: Column) -> Column:
    """What is embedded for a chunk: a header of title and section, a blank line, the text."""
    header = F.when(section.isNull() | (section == ""), title).otherwise(F.concat(title, F.lit(" - "), section))
    return F.concat(F.lit("search_document: "), header, F.lit("\n\n"), text)


def query_prompt(text: Column) -> Column:
    return F.concat(F.lit("search_query: "), text)


def paper_prompt(title: Column, abstract: Column, subjects: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), abstract, F.lit("\n\nCategories: "), subjects)


def article_path(title: Column) -> Column:
    """A title as a URL path: everything quoted but slashes."""
    quoted = F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(quoted, F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))


def elapsed(seconds: Column) -> Column:
    """Seconds as `Ns`, `Nm Ns` or `Nh Nm`."""
    s = seconds.cast("long")
    text = lambda c: c.cast("string")
    hours, minutes = F.floor(s / 3600), F.floor(s / 60)
    return (
        F.when(s < 60, F.concat(text(s), F.lit("s")))
        .when(s < 3600, F.concat(text(minutes), F.lit("m "), text(s % 60), F.lit("s")))
        .otherwise(F.concat(text(hours), F.lit("h "), text(F.floor(s % 3600 / 60)), F.lit("m")))
    )


def started_display(text: Column) -> Column:
    """An ISO time as `5 Jan 2026 07:08 UTC`, its own clock kept; other text as it is."""
    time = text.try_cast("timestamp_ntz")
    return F.when(time.isNull(), text).otherwise(F.concat(F.date_format(time, "d MMM yyyy HH:mm"), F.lit(" UTC")))


def embedded_display(text: Column) -> Column:
    """An ISO time as `2026-01-05 07:08`, a dash where there is none; other text as it is."""
    time = text.try_cast("timestamp_ntz")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("—")).when(time.isNull(), text).otherwise(F.date_format(time, "yyyy-MM-dd HH:mm"))


def from_unix(seconds: Column) -> Column:
    """Seconds since 1970 as `YYYY-MM-DD HH:MM:SS` in UTC, whatever the session's time zone; years of other than four digits as plain numbers."""
    clock = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    # Spark writes +10000 and -0001
    day = F.regexp_replace(day, r"^\+|(?<=^-)0+", "")
    return F.concat_ws(" ", day, F.concat_ws(":", two(clock / 3600), two(clock % 3600 / 60), two(clock % 60)))


def pack_paragraphs(text: Column, limit: int) -> Column:
    """A long text as parts of at most `limit` characters, paragraphs packed greedily.

    A paragraph over the limit is cut hard, and its tail is a part of its own. Paragraphs
    that are joined lose the white space before the first.
    """
    piece = "array<string>"
    hard = lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / limit).cast("int")),
        lambda i: F.substring(p, i * limit + 1, F.lit(limit)),
    )
    start = F.struct(F.array().cast(piece).alias("parts"), F.lit("").alias("open"))
    flush = lambda a: F.when(a["open"] != "", F.concat(a["parts"], F.array(a["open"]))).otherwise(a["parts"])

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a["open"] == "", p).otherwise(F.regexp_replace(F.concat(a["open"], F.lit("\n\n"), p), r"(?U)^\s+", ""))
        return (
            F.when(F.char_length(p) > limit, F.struct(F.concat(flush(a), hard(p)).alias("parts"), F.lit("").alias("open")))
            .when(F.char_length(joined) <= limit, F.struct(a["parts"].alias("parts"), joined.alias("open")))
            .otherwise(F.struct(flush(a).alias("parts"), p.alias("open")))
        )

    packed = F.aggregate(F.split(text, "\n\n"), start, step, flush)
    return F.when(F.char_length(text) <= limit, F.array(text)).otherwise(packed)


def sections(text: Column) -> Column:
    """Array of (section, body): heading lines of two to six equal signs start a section; the lead has a null section."""
    marked = F.regexp_replace(text, HEADING, "\u0001$2\u0002")
    parts = F.split(marked, "\u0001")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(p.contains("\u0002"), F.substring_index(p, "\u0002", 1)).alias("section"),
            F.trim(F.regexp_replace(F.when(p.contains("\u0002"), F.substring_index(p, "\u0002", -1)).otherwise(p), r"^\s+|\s+$", "")).alias("body"),
        ),
    )


def strip_markup(text: Column) -> Column:
    """Plain text of wiki markup: no comments, templates, files, tags, quotes or link brackets, labels kept.

    Nested templates go innermost first, five levels deep.
    """
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(gallery|graph|imagemap|score|timeline)\b[^>/]*>.*?</\1\s*>", "")
    for _ in range(5):
        out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    out = F.regexp_replace(out, r"(?i)\[\[\s*(?:File|Image|Media)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", "")
    out = F.regexp_replace(out, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[(?:https?:)?//[^ \]]+ ([^\]]*)\]", "$1")
    out = F.regexp_replace(out, r"</?[A-Za-z][^<>]*>", "")
    return F.regexp_replace(F.regexp_replace(out, r"'{2,5}", ""), r"^\s+|\s+$", "")


#: What a behaviour switch looks like, and blocks that have no HTML here.
SWITCH = r"__[A-Z]+(?:_[A-Z]+)*__"
UNSUPPORTED_BLOCKS = ["score", "timeline", "hiero", "imagemap", "mapframe", "maplink"]


def _in_place(text: Column, tag: str, body: Callable[[Column], Column]) -> Column:
    """`body(inside)` in place of each element `tag`, without regard to case; what is never closed stays."""
    pieces = F.split(text, rf"(?i)(?=<{tag}\b)|(?<=</{tag}>)")
    element = rf"(?is)^<{tag}\b[^>]*>(.*)</{tag}>$"
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(element), body(F.regexp_extract(p, element, 1))).otherwise(p)), "")


def _escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def literal_blocks(text: Column) -> Column:
    """`nowiki` as signs that no later step reads, galleries as lists of their captions, blocks without HTML as a note."""
    shielded = lambda x: F.replace(F.replace(_escaped(x), F.lit("[["), F.lit("&#91;&#91;")), F.lit("]]"), F.lit("&#93;&#93;"))

    def captions(inside: Column) -> Column:
        files = F.filter(F.transform(F.split(inside, "\n"), strip), lambda x: x.rlike(r"(?i)^(?:File|Image):[^|]*\|"))
        found = F.filter(F.transform(files, lambda x: strip(F.regexp_replace(x, r"^[^|]*\|", ""))), lambda x: x != "")
        items = F.array_join(F.transform(found, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "\n")
        return F.when(F.size(found) > 0, F.concat(F.lit('<ul class="gallery-captions">\n'), items, F.lit("\n</ul>"))).otherwise("")

    out = _in_place(_in_place(text, "nowiki", shielded), "gallery", captions)
    for tag in UNSUPPORTED_BLOCKS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*/>|<{tag}\b[^>]*>.*?</{tag}>", f'<div class="unsupported-content">[unsupported: {tag}]</div>')
    return out


def clean_markup(text: Column, depth: int = 8) -> Column:
    """Markup without comments, notes, switches, templates and links to files and categories; what is for this page only stays.

    Templates and links go innermost first, `depth` levels deep.
    """
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<includeonly\b[^>]*/>|<includeonly\b[^>]*>.*?</includeonly>|</?(?:noinclude|onlyinclude)\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?i)<ref(?:erences)?\b[^>]*/>", "")
    out = F.regexp_replace(out, r"(?is)<(ref|references)\b[^>]*>.*?</\1>", "")
    out = F.regexp_replace(out, SWITCH, "")
    for pattern in (r"\{\{[^{}]*\}\}", r"(?i)\[\[(?:Category|File|Image|Media):[^\[\]]*\]\]"):
        for _ in range(depth):
            out = F.regexp_replace(out, pattern, "")
    return out


def _heading_line(line: Column) -> Column:
    """A line as a heading if it is one, the most signs first; its anchor has no tags and underscores for spaces."""
    out = line
    for level in range(2, 7):
        shape = rf"^={{{level}}}\s*(.+?)\s*={{{level}}}\s*$"
        title = strip(F.regexp_extract(line, shape, 1))
        anchor = _escaped(F.replace(strip(F.regexp_replace(title, "<[^>]+>", "")), F.lit(" "), F.lit("_")))
        made = F.concat(F.lit(f'<h{level} id="'), anchor, F.lit('">'), title, F.lit(f"</h{level}>"))
        out = F.when(line.rlike(shape), made).otherwise(out)
    return out


def markup_to_html(text: Column) -> Column:
    """Headings with anchors, bold, italics and links of markup as HTML; the rest is left as it is. Lines lose white space at their ends."""
    out = clean_markup(literal_blocks(text))
    out = F.array_join(F.transform(F.split(out, "\n"), _heading_line), "\n")
    out = F.regexp_replace(out, r"'''''(.+?)'''''", "<b><i>$1</i></b>")
    out = F.regexp_replace(out, r"'''(.+?)'''", "<b>$1</b>")
    out = F.regexp_replace(out, r"''(.+?)''", "<i>$1</i>")
    out = F.regexp_replace(out, r"\[\[([^\[\]|]+)\|([^\[\]]+)\]\]([a-z]*)", '<a href="/article/$1">$2$3</a>')
    out = F.regexp_replace(out, r"\[\[([^\[\]|]+)\]\]([a-z]*)", '<a href="/article/$1">$1$2</a>')
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?m)[ \t\f\x0B\r]+$", "")


def snippet(text: Column) -> Column:
    """The first sentence of an article's lead, its markup taken off."""
    return first_sentence(strip_markup(F.regexp_replace(text, r"(?s)\n=.*$", "")))
