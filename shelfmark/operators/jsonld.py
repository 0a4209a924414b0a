"""JSON-LD as Variant values, flattened inside the page's own row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.base import first_of, let
from shelfmark.functions.money import to_number
from shelfmark.functions.text import SPACE, strip
from shelfmark.operators.elements import first_filled

# Schema.org types, last name part, lower case.
PRODUCT_TYPES = [
    "product", "individualproduct", "productmodel", "productgroup", "vehicle", "book",
    "softwareapplication", "itempage",
]
BREADCRUMB_TYPE = "breadcrumblist"
# Keys that make a node the better candidate.
SCORED_KEYS = ["name", "offers", "image", "description", "sku", "brand"]
NESTED_KEYS = ["about", "item", "mainEntityOfPage", "mainEntity"]
NAME_KEYS = ["name", "url", "@id", "value", "contentUrl"]

_SCRIPT = (
    r"(?is)<script[^>]*type\s*=\s*[\"']?[^\"'>]*ld\+json[^\"'>]*[\"']?[^>]*>(.*?)</script>"
)
_COMMENTS = r"(?is)(<script\b.*?</script>)|<!--.*?-->"


def _get(node: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, f'$["{key}"]', kind)


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def is_object(value: Column) -> Column:
    return _fields(value).isNotNull()


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _none() -> Column:
    return F.array().cast("array<variant>")


def as_list(value: Column) -> Column:
    return let(
        value,
        lambda v: F.when(~_present(v), _none()).otherwise(F.coalesce(_items(v), F.array(v))),
    )


def jsonld_payloads(html: Column) -> Column:
    """Bodies of the ld+json scripts of the document proper; failing those, of the whole text."""
    body = F.regexp_replace(F.regexp_extract(html, r"(?is)\A(.*?)(?:</html\s*>|\z)", 1), _COMMENTS, "$1")
    inside = F.regexp_extract_all(body, F.lit(_SCRIPT), F.lit(1))
    anywhere = F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1))
    return (
        F.when(~F.lower(F.coalesce(html, F.lit(""))).contains("ld+json"), F.array().cast("array<string>"))
        .when(F.size(inside) > 0, inside)
        .otherwise(anywhere)
    )


def parse_lenient(payload: Column) -> Column:
    """A block as Variant, without CDATA or comment wrappers and, on a retry, trailing commas."""
    text = strip(F.regexp_replace(strip(payload), r"^<!\[CDATA\[|\]\]>$", ""))
    text = strip(F.regexp_replace(text, r"^<!--|-->$", ""))
    relaxed = F.regexp_replace(text, f"(?U),{SPACE}*([}}\\]])", "$1")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(relaxed))


def _children(value: Column) -> Column:
    """What a value leads to, in visiting order: last pushed, first seen."""

    def of_object(fields):
        nested = F.filter(
            F.array(*[fields[key] for key in NESTED_KEYS]), lambda n: n.isNotNull() & is_object(n)
        )
        graph = fields["@graph"]
        listed = F.coalesce(F.reverse(_items(graph)), F.when(is_object(graph), F.array(graph)), _none())
        return F.concat(nested, listed)

    return F.coalesce(F.reverse(_items(value)), let(_fields(value), of_object), _none())


def _visits(value: Column, nesting: Column) -> Column:
    """A value and all it leads to, parents first; ``nesting`` is a bound of its levels.

    Level by level: an item carries its place among the items above, and the places give the order.
    """
    start = F.array(F.struct(F.array(F.lit(0)).alias("place"), value.alias("v")))

    def below(edge):
        return F.flatten(F.transform(edge, lambda e: F.transform(
            _children(e["v"]), lambda c, i: F.struct(F.concat(e["place"], F.array(i)).alias("place"), c.alias("v"))
        )))

    def step(state, _):
        grown = let(below(state["edge"]), lambda b: F.struct(F.concat(state["seen"], b).alias("seen"), b.alias("edge")))
        return F.when(F.size(state["edge"]) == 0, state).otherwise(grown)

    def ordered(seen):
        places = F.array_sort(F.transform(seen, lambda s, i: F.struct(s["place"].alias("place"), i.alias("i"))))
        return F.transform(places, lambda p: F.get(seen, p["i"])["v"])

    levels = F.sequence(F.lit(0), nesting)
    walked = F.aggregate(levels, F.struct(start.alias("seen"), start.alias("edge")), step, lambda state: state["seen"])
    return let(walked, ordered)


def jsonld_nodes(payloads: Column) -> Column:
    """Every object of every block at any depth, ``array<variant>``, in visiting order."""

    def of_block(payload):
        root = F.filter(F.array(parse_lenient(payload)), lambda v: v.isNotNull())
        # No value has more levels than its text has opening brackets.
        nesting = F.length(payload) - F.length(F.translate(payload, "{[", ""))
        return F.filter(F.flatten(F.transform(root, lambda v: _visits(v, nesting))), is_object)

    return F.flatten(F.transform(payloads, of_block))


def type_names(node: Column) -> Column:
    """Lower-case last parts of ``@type``."""
    kinds = F.filter(as_list(_get(node, "@type")), lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(
        kinds,
        lambda v: F.lower(F.element_at(F.split(strip(F.try_variant_get(v, "$", "string")), "[/#:]"), -1)),
    )


def best_product_node(nodes: Column) -> Column:
    """The node of a product type with most fields filled; the first visited one on ties."""

    def key(node, position):
        score = F.aggregate(
            F.array(*[F.lit(k) for k in SCORED_KEYS]), F.lit(0),
            lambda n, k: n + _is_filled(_fields(node)[k]).cast("int"),
        )
        return let(
            type_names(node),
            lambda names: F.struct(
                F.arrays_overlap(names, F.array(*[F.lit(t) for t in PRODUCT_TYPES])).alias("is_product"),
                F.array_join(names, " ").contains("product").alias("named_product"),
                score.alias("score"),
                (-position).alias("first"),
            ),
        )

    best = F.array_max(F.filter(F.transform(nodes, key), lambda k: k["is_product"]))
    return let(best, lambda b: F.get(nodes, -b["first"]))


def _is_filled(value: Column) -> Column:
    return let(
        value,
        lambda v: F.coalesce(_present(v) & ~F.to_json(v).isin('""', "[]", "{}", "0", "false"), F.lit(False)),
    )


def _scalar_text(value: Column) -> Column:
    """Text of a string, number or boolean; NULL for anything else."""
    kind = F.when(_present(value) & _items(value).isNull() & ~is_object(value), F.schema_of_variant(value))
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind.isNotNull(), strip(text))


def first_str(value: Column, depth: int = 2) -> Column:
    """A plain string out of a string, number, object or list; entities are left as they are."""

    def of_fields(fields):
        keys = F.array(*[F.lit(k) for k in NAME_KEYS])
        return first_filled(
            F.transform(keys, lambda k: F.coalesce(let(fields[k], _scalar_text), F.lit("")))
        )

    def choose(v):
        options = [_scalar_text(v), let(_fields(v), of_fields)]
        if depth:
            listed = F.transform(_items(v), lambda i: first_str(i, depth - 1))
            options.append(first_filled(listed))
        return F.when(_present(v), F.coalesce(*options)).otherwise(F.lit(""))

    return F.coalesce(let(value, choose), F.lit(""))


def node_text(node: Column, key: str) -> Column:
    return first_str(_get(node, key))


def node_texts(node: Column, *keys: str) -> Column:
    """``map(key, text)`` of several fields of a node."""
    names = F.array(*[F.lit(k) for k in keys])
    return F.map_from_arrays(
        names, let(_fields(node), lambda f: F.transform(names, lambda k: first_str(f[k])))
    )


def _offer_number(offer: Column) -> Column:
    def usable(v):
        return v.isNotNull() & ~F.is_variant_null(v) & (F.to_json(v) != '""')

    def number(v):
        kind = F.schema_of_variant(v)
        return (
            F.when(kind == "BOOLEAN", F.lit(None).cast("double"))
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
            .otherwise(to_number(F.try_variant_get(v, "$", "string")))
        )

    spec = F.try_variant_get(offer["priceSpecification"], "$.price", "variant")
    options = F.filter(F.array(offer["price"], offer["lowPrice"], spec), usable)
    return let(first_of(options), number)


def offers_summary(node: Column) -> Column:
    """``struct(price_value, currency, availability)`` over the offers of a product node."""

    def summary(offers):
        def first_text(key):
            return first_filled(F.transform(offers, lambda o: first_str(o[key])))

        return F.struct(
            F.array_min(F.transform(offers, _offer_number)).alias("price_value"),
            first_text("priceCurrency").alias("currency"),
            F.element_at(F.split(first_text("availability"), "[/#]"), -1).alias("availability"),
        )

    fields = F.transform(as_list(_get(node, "offers")), _fields)
    return let(F.filter(fields, lambda o: o.isNotNull()), summary)


def jsonld_breadcrumbs(nodes: Column) -> Column:
    """Names of the first breadcrumb list that has any, by position; entities undecoded."""

    def trail(node):
        entries = F.transform(
            F.filter(
                F.transform(as_list(_get(node, "itemListElement")), _fields), lambda e: e.isNotNull()
            ),
            lambda e: F.struct(
                first_filled(
                    F.transform(F.array(F.lit("name"), F.lit("item")), lambda k: first_str(e[k]))
                ).alias("name"),
                let(e["position"], _position).alias("position"),
            ),
        )
        named = F.filter(entries, lambda e: e["name"] != "")
        placed = F.transform(
            named,
            lambda e, i: F.struct(
                F.coalesce(e["position"], i + 1).alias("position"), i.alias("i"), e["name"].alias("name")
            ),
        )
        return F.transform(F.sort_array(placed), lambda e: e["name"])

    lists = F.filter(nodes, lambda n: F.array_contains(type_names(n), BREADCRUMB_TYPE))
    trails = F.filter(F.transform(lists, trail), lambda t: F.size(t) > 0)
    return F.coalesce(first_of(trails), F.array().cast("array<string>"))


def _position(value: Column) -> Column:
    text = strip(F.try_variant_get(value, "$", "string"))
    number = F.try_variant_get(value, "$", "double").cast("int")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(_present(value) & (~is_text | text.rlike(r"^[+-]?[0-9]+$")), number)
