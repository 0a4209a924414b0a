"""The one Arrow stage: each page is read once into the elements that some rule can use.

Everything downstream is native. Elements stay in an array on the page's own row, so reading a
product out of a page moves no data between tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.base import first_of, let
from shelfmark.functions.text import strip
from shelfmark.operators.rules import (
    IMAGE_ATTRIBUTES, MARKUP_FIELDS, SELECTORS, selector_parts, selector_pattern, selector_rows,
)

ELEMENT = (
    "struct<pos:int,stop:int,tag:string,path:string,fields:array<string>,hits:array<int>,"
    "attrs:map<string,string>,texts:array<string>,html:string>"
)
ERROR_TAG = "!error"
PAGES_AT_ONCE = 128

# HTML elements without an end tag, and those closed by a following sibling.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {
    "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article",
          "footer", "header", "nav", "main", "form", "blockquote", "pre", "hr", "dl"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"},
}
SILENT = {"script", "style", "template"}
KEPT_TAGS = {"h1", "title", "meta", "img", "a"}
KEPT_ATTRIBUTES = {
    "content", "property", "name", "itemprop", "itemtype", "value", "href", "src", "data-src",
    "srcset", "data-srcset", *IMAGE_ATTRIBUTES,
}


def rule_ids(field: str, selectors: dict = SELECTORS) -> tuple:
    """(first, last) number of a field's rules, counted over all fields in their order."""
    before = 0
    for name, listed in selectors.items():
        if name == field:
            return before, before + len(listed) - 1
        before += len(listed)
    raise KeyError(field)


class _Vocabulary:
    """Rules as steps over tokens, and which steps and fields a token may lead to."""

    def __init__(self, selectors, keep_path):
        self.keep_path = keep_path
        self.steps, self.rules = [], []
        self.by_token, self.by_inside, self.fields, self.inside_fields = {}, {}, {}, {}
        for field, listed in selectors.items():
            for steps in map(selector_parts, listed):
                number = len(self.rules)
                self.rules.append((field, len(steps) - 1))
                for place, parts in enumerate(steps):
                    self.steps.append((number, place, parts))
                    # A step is tried where an element has its last part.
                    anchor, inside = parts[-1]
                    target = self.by_inside if inside else self.by_token
                    target.setdefault((anchor, inside) if inside else anchor, []).append(len(self.steps) - 1)
                key = steps[-1][-1]
                place = self.inside_fields if key[1] else self.fields
                place.setdefault(key if key[1] else key[0], set()).add(field)
        parts = {p for _, _, step in self.steps for p in step}
        self.tokens = {token for token, inside in parts if not inside}
        self.inside = {p for p in parts if p[1]}
        self.attributes = {t[1:].partition("=")[0] for t, _ in parts if t.startswith("@")}
        self.looked_at = {"id", "class", *self.attributes}
        self.markup = {n for n, (field, _) in enumerate(self.rules) if field in MARKUP_FIELDS}

    def tokens_of(self, tag, attrs):
        """The element's tokens that some rule looks at, its tag first."""
        seen = [tag]
        if attrs.get("id"):
            seen.append("#" + " ".join(attrs["id"].split()))
        seen += ["." + name for name in (attrs.get("class") or "").split()]
        for name, value in attrs.items():
            if name in self.attributes:
                seen += ["@" + name, f"@{name}=" + " ".join((value or "").split())]
        return [tag] + [t for t in seen[1:] if t in self.tokens or any(self.holds(t, p) for p in self.inside)]

    @staticmethod
    def holds(token, part):
        start, inside = part
        return token.startswith(start) and inside in token[len(start):]

    def matched_steps(self, tokens):
        """(rule, place) of every step that an element with these tokens satisfies."""
        tried = [n for t in tokens for n in self.by_token.get(t, ())]
        tried += [n for part, listed in self.by_inside.items() if any(self.holds(t, part) for t in tokens) for n in listed]
        for n in tried:
            rule, place, parts = self.steps[n]
            if all(any(self.holds(t, p) for t in tokens) if p[1] else p[0] in tokens for p in parts):
                yield rule, place

    def fields_of(self, tokens):
        found = set().union(*(self.fields.get(t, ()) for t in tokens))
        return found.union(*(f for part, f in self.inside_fields.items() if any(self.holds(t, part) for t in tokens)))


class _PageReader(HTMLParser):
    """Event handler that keeps a stack of open elements and writes out the wanted ones.

    An open element holds, per rule, how many leading steps it and its ancestors satisfy, so that
    an element is matched from its own tokens and its parent alone, however deep it lies. Without
    ``keep_path``, elements that only repeat a rule's match are left out: a rule's first element
    counts, and all images, anchors, headings, meta tags and items are kept anyway.
    """

    def __init__(self, words, page):
        super().__init__(convert_charrefs=True)
        self.words, self.page = words, page
        self.stack, self.found, self.texts, self.count, self.silent = [], [], [], 0, 0
        self.open, self.met, self.known = Counter(), set(), {}
        self.lines = [0] + [m.end() for m in re.finditer("\n", page)]

    def here(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def described(self, tag, attrs):
        key = (tag, *[(k, v) for k, v in attrs.items() if k in self.words.looked_at])
        if key not in self.known:
            tokens = self.words.tokens_of(tag, attrs)
            self.known[key] = tokens, sorted(self.words.matched_steps(tokens))
        return self.known[key]

    def handle_starttag(self, tag, attrs, empty=False):
        while self.stack and tag in CLOSED_BY.get(self.stack[-1]["tag"], ()):
            self.close_top(self.here())
        attrs = dict(reversed(attrs))
        tokens, steps = self.described(tag, attrs)
        above = self.stack[-1]["done"] if self.stack else {}
        hits = [rule for rule, place in steps if place == self.words.rules[rule][1] and above.get(rule, 0) == place]
        further = {rule: place + 1 for rule, place in steps if place < self.words.rules[rule][1] and above.get(rule, 0) == place}
        entry = {"tag": tag, "tokens": tokens, "hits": hits, "new": [h for h in hits if h not in self.met],
                 "done": {**above, **further} if further else above,
                 "attrs": attrs, "pos": self.count, "text": len(self.texts), "start": self.here()}
        self.met.update(hits)
        self.count += 1
        self.stack.append(entry)
        self.open[tag] += 1
        if tag in SILENT:
            self.silent += 1
        if tag in VOID or empty:
            self.close_top(self.here() + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, empty=tag in VOID)

    def handle_endtag(self, tag):
        if self.open[tag]:
            begin = self.here()
            while self.stack[-1]["tag"] != tag:
                self.close_top(begin)
            self.close_top(self.page.find(">", begin) + 1 or len(self.page))

    def handle_data(self, data):
        # Text directly under a silent element belongs to that element alone.
        if not self.silent and data.strip():
            self.texts.append(data.strip())

    def path_of(self, entry):
        return "".join("\n\t" + "\t".join(e["tokens"]) + "\t" for e in [*self.stack, entry])

    def close_top(self, end):
        entry = self.stack.pop()
        tag, attrs, words = entry["tag"], entry["attrs"], self.words
        self.open[tag] -= 1
        self.silent -= tag in SILENT
        fields = words.fields_of(entry["tokens"]) if words.keep_path else {words.rules[h][0] for h in entry["hits"]}
        if not (entry["new"] or (fields and words.keep_path) or tag in KEPT_TAGS or "itemprop" in attrs):
            return
        markup = fields & MARKUP_FIELDS if words.keep_path else words.markup.intersection(entry["new"])
        self.found.append({
            "pos": entry["pos"], "stop": self.count, "tag": tag,
            "path": self.path_of(entry) if words.keep_path else None,
            "fields": sorted(fields), "hits": entry["hits"],
            "attrs": {k: v or "" for k, v in attrs.items() if k in KEPT_ATTRIBUTES},
            "texts": self.texts[entry["text"]:],
            "html": self.page[entry["start"]:end] if markup else None,
        })


def _read(words, page):
    if not page:
        return []
    try:
        reader = _PageReader(words, page)
        reader.feed(page)
        reader.close()
        while reader.stack:
            reader.close_top(len(page))
        return sorted(reader.found, key=lambda e: e["pos"])
    except Exception as problem:  # one unreadable page must not fail the job
        return [{"pos": 0, "stop": 0, "tag": ERROR_TAG, "path": "", "fields": [], "hits": [], "attrs": {},
                 "texts": [type(problem).__name__], "html": None}]


def _read_batches(words, batches):
    """Elements are several times as large as their pages, so they are handed back a few pages at a time."""
    for pages in batches:
        for start in range(0, len(pages), PAGES_AT_ONCE):
            yield pages.iloc[start:start + PAGES_AT_ONCE].map(lambda page: _read(words, page))


def element_array(page: Column, selectors: dict = SELECTORS, keep_path: bool = False) -> Column:
    """``array<struct>`` of the elements of one page that some rule matches or some layer reads.

    ``hits`` numbers the rules an element matches. ``keep_path`` also keeps elements that only
    share a token with a rule, and their paths, for rules that are joined later.
    """
    words = _Vocabulary(selectors, keep_path)

    @F.pandas_udf(f"array<{ELEMENT}>")
    def read_pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _read_batches(words, batches)

    # Non-deterministic for the planner: it must not be copied into the expressions that use it.
    return read_pages.asNondeterministic()(page)


def page_elements(pages: DataFrame, selectors: dict = SELECTORS) -> DataFrame:
    """One row per element: ``(url, pos, stop, tag, path, fields, attrs, texts, html)``."""
    return pages.select("url", F.explode(element_array(F.col("html"), selectors, keep_path=True)).alias("e")).select(
        "url", "e.*"
    )


def selector_table(spark, selectors: dict = SELECTORS) -> DataFrame:
    return spark.createDataFrame(
        selector_rows(selectors), "field string, rank int, selector string, pattern string"
    )


def apply_selector_rules(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """First selector per page and field whose first element has text.

    The rule table has one row per selector, so it is small by construction; its size is
    checked by the planner, which broadcasts it below the session's threshold.
    """
    keyed = elements.select(
        "url", "pos", "path", F.array_join("texts", " ").alias("text"), "html",
        F.explode("fields").alias("field"),
    )
    hits = keyed.join(rules, "field").where(F.expr("path rlike pattern"))
    first = hits.groupBy("url", "field", "rank", "selector").agg(
        F.min_by(F.struct("text", "html"), "pos").alias("hit")
    )
    return (
        first.where("hit.text <> ''")
        .groupBy("url", "field")
        .agg(F.min_by(F.struct("selector", "hit.text", "hit.html"), "rank").alias("best"))
        .select("url", "field", "best.*")
    )


# ── Expressions over the element array of a page ──────────────────────────


def of_tag(elements: Column, tag: str) -> Column:
    return F.filter(elements, lambda e: e["tag"] == tag)


def first_filled(values: Column) -> Column:
    """First non-empty string of an array, or an empty one."""
    return F.coalesce(first_of(F.filter(values, lambda v: v != "")), F.lit(""))


def words(element: Column) -> Column:
    return F.coalesce(F.array_join(element["texts"], " "), F.lit(""))


def matched(elements: Column, rule: Column) -> Column:
    return F.filter(elements, lambda e: F.array_contains(e["hits"], rule))


def rule_numbers(field: str, selectors: dict = SELECTORS) -> Column:
    first, last = rule_ids(field, selectors)
    return F.sequence(F.lit(first), F.lit(last))


def selector_name(field: str, rule: Column, selectors: dict = SELECTORS) -> Column:
    """``css:<selector>`` of a rule number."""
    first, _ = rule_ids(field, selectors)
    names = F.array(*[F.lit(f"css:{s}") for s in selectors[field]])
    return F.get(names, rule - first)


def css_hit(elements: Column, field: str, selectors: dict = SELECTORS) -> Column:
    """``struct(source, text, html)`` of the first rule whose first element has text."""
    tried = F.transform(
        rule_numbers(field, selectors),
        lambda r: F.struct(r.alias("rule"), first_of(matched(elements, r)).alias("node")),
    )
    filled = F.filter(tried, lambda h: F.size(h["node"]["texts"]) > 0)
    hits = F.transform(
        filled,
        lambda h: F.struct(
            selector_name(field, h["rule"], selectors).alias("source"),
            F.array_join(h["node"]["texts"], " ").alias("text"),
            h["node"]["html"].alias("html"),
        ),
    )
    return first_of(hits)


_META_ATTRIBUTES = ("property", "name", "itemprop")


def _meta_lists(metas: Column, keys: tuple) -> Column:
    """Contents per key and attribute, in that order, of the ``<meta>`` elements given."""
    wanted = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(k).alias("k")) for k in keys for a in _META_ATTRIBUTES]
    )
    return F.transform(
        wanted,
        lambda w: F.transform(
            F.filter(metas, lambda e: e["attrs"][w["a"]] == w["k"]),
            lambda e: strip(F.coalesce(e["attrs"]["content"], F.lit(""))),
        ),
    )


def meta_value(metas: Column, *keys: str) -> Column:
    """First non-empty content: per key and attribute, only the first element counts."""
    return first_filled(
        F.transform(_meta_lists(metas, keys), lambda l: F.coalesce(first_of(l), F.lit("")))
    )


def meta_values(metas: Column, *keys: str) -> Column:
    """Every distinct non-empty content for the keys, in key then attribute order."""
    return F.array_distinct(F.filter(F.flatten(_meta_lists(metas, keys)), lambda v: v != ""))


def microdata_values(elements: Column, *props: str) -> Column:
    """``map(prop, value)``: the first non-empty value per ``itemprop``, from an attribute that
    carries it, else from the text."""
    names = F.array(*[F.lit(p) for p in props])
    carriers = F.array(*[F.lit(a) for a in ("content", "value", "href", "src", "data-src")])

    def value(e):
        listed = F.transform(carriers, lambda a: strip(F.coalesce(e["attrs"][a], F.lit(""))))
        return first_filled(F.concat(listed, F.array(F.array_join(e["texts"], ""))))

    marked = F.filter(elements, lambda e: e["attrs"]["itemprop"].isNotNull())
    found = let(
        marked,
        lambda m: F.transform(
            names,
            lambda p: first_filled(F.transform(F.filter(m, lambda e: e["attrs"]["itemprop"] == p), value)),
        ),
    )
    return F.map_from_arrays(names, found)
