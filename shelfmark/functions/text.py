"""Text helpers as Column expressions; the two entity decoders are vectorised Python."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode whitespace, not just U+0020."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def clean_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?U){SPACE}+", " "))


def _decode(value):
    if value is None or "&" not in value:
        return value
    once = html.unescape(value)
    return html.unescape(once) if "&" in once else once


@F.pandas_udf(T.StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    """Decode entities, with a second pass for double-encoded text."""
    return values.map(_decode, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescape_all(values: pd.Series) -> pd.Series:
    """Decode every string of an array.

    Non-deterministic for the planner: a filter on what is derived from the result must not
    copy the call into its own expressions.
    """
    return values.map(lambda items: [_decode(v) for v in items], na_action="ignore")


unescape_all = unescape_all.asNondeterministic()


@F.pandas_udf(T.StringType())
def _unescape_once(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def alnum_key(c: Column) -> Column:
    """Lower-case letters and digits only, of text whose entities are already decoded."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def comparison_key(c: Column) -> Column:
    return alnum_key(unescape_html(F.coalesce(c, F.lit(""))))


def clean_html(c: Column) -> Column:
    """Break tags become newlines, other tags go, entities are decoded, blank lines collapse."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<(br|/p|/li|div[^>]*)>", "\n")
    text = _unescape_once(F.regexp_replace(text, r"<[^>]+>", ""))
    return strip(F.regexp_replace(text, f"(?U)\\n{SPACE}*\\n", "\n"))


def raw_description(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<br>"), F.lit("\n"))


def has_content(c: Column) -> Column:
    """True when something is left after tags and non-breaking spaces are gone."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>", "")
    return strip(F.regexp_replace(text, r"(?i)&nbsp;", " ")) != ""


def html_to_text(c: Column) -> Column:
    """The text nodes of a fragment, each trimmed, one per line."""
    bare = F.regexp_replace(
        F.coalesce(c, F.lit("")), r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", "\x00"
    )
    decoded = _unescape_once(F.regexp_replace(bare, r"</?[a-zA-Z!][^>]*>", "\x00"))
    parts = F.transform(F.split(decoded, "\x00"), strip)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def xml_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def html_escape(c: Column) -> Column:
    out = F.replace(xml_escape(c), F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#x27;"))


def strip_control(c: Column) -> Column:
    """Drop the control characters a spreadsheet cell may not hold."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def float_text(c: Column) -> Column:
    """A double as its shortest decimal text: plain from 1e-4 up to 1e16, exponent outside."""
    plain = F.regexp_replace(c.cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    java = c.cast("string")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    power = F.substring_index(java, "E", -1).cast("int")
    exponent = F.concat(
        mantissa,
        F.lit("e"),
        F.when(power < 0, "-").otherwise("+"),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    size = F.abs(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


class _Markdown(HTMLParser):
    """Small event handler that writes ATX headings, lists, links and emphasis."""

    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.lists, self.hrefs, self.skip = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "table", "tr", "section", "blockquote"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind, count = self.lists[-1] if self.lists else ("ul", 0)
            if self.lists:
                self.lists[-1][1] += 1
            indent = "  " * max(len(self.lists) - 1, 0)
            self.out.append("\n" + indent + (f"{count + 1}. " if kind == "ol" else "* "))
        elif tag == "a":
            self.hrefs.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            seen = dict(attrs)
            self.out.append(f"![{seen.get('alt') or ''}]({seen.get('src') or ''})")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(self.skip - 1, 0)
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif tag == "a" and self.hrefs:
            self.out.append(f"]({self.hrefs.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            lead = " " if data[:1].isspace() else ""
            tail = " " if data[-1:].isspace() and data.strip() else ""
            self.out.append(lead + " ".join(data.split()) + tail)


def _markdown(fragment):
    reader = _Markdown()
    reader.feed(fragment)
    reader.close()
    lines, blank = [], True
    for line in "".join(reader.out).split("\n"):
        kept = line.rstrip(" ") + ("  " if line.endswith("  ") and line.strip() else "")
        if kept.strip() or not blank:
            lines.append(kept if kept.strip() else "")
        blank = not kept.strip()
    return "\n".join(lines).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(values: pd.Series) -> pd.Series:
    return values.map(_markdown, na_action="ignore")
