"""Rule tables: page selectors, platform fingerprints. Users may pass longer lists of their own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Selectors per field, most specific first.
TITLE_SELECTORS = [
    "h1.product_title", "h1.product-title", ".product-title h1", ".product_title", "h1.page-title",
    ".page-title .base", 'h1[itemprop="name"]', ".product-name h1", "h1.entry-title",
    "h1.product-single__title", ".product__title h1", "h1.product-detail-name", "#product-title",
]
PRICE_SELECTORS = [
    ".summary .price ins .woocommerce-Price-amount bdi",
    ".summary .price .woocommerce-Price-amount bdi",
    ".price ins .woocommerce-Price-amount bdi", ".price .woocommerce-Price-amount bdi",
    ".woocommerce-Price-amount bdi", ".woocommerce-Price-amount", "[data-price-amount]",
    ".price-wrapper .price", ".product-info-price .price", ".product__price .price-item--sale",
    ".product__price", ".price-item--regular", ".product-price", ".price-box .price",
    ".current-price", ".price",
]
BREADCRUMB_SELECTORS = [
    ".woocommerce-breadcrumb", ".breadcrumbs-container", "nav.woocommerce-breadcrumb",
    ".rank-math-breadcrumb", ".yoast-breadcrumb", "#breadcrumbs", ".breadcrumbs", "nav.breadcrumb",
    "ol.breadcrumb", "ul.breadcrumb", ".breadcrumb", ".page-breadcrumb", '[class*="breadcrumb"]',
]
GALLERY_SELECTORS = [
    ".woocommerce-product-gallery__wrapper img", ".woocommerce-product-gallery img",
    ".product-gallery img", ".product-images img", ".product-image-gallery img",
    ".flex-control-thumbs img", ".product__media img", ".product-single__media img",
    ".fotorama img", ".gallery-placeholder img", ".swiper-wrapper .product-image img",
    "[data-product-images] img", "#product-images img", ".product-detail-images img",
    ".thumbnails img",
]
SHORT_DESCRIPTION_SELECTORS = [
    ".woocommerce-product-details__short-description", ".product-short-description",
    ".short-description", ".product__description--short", '.summary [itemprop="description"]',
]
LONG_DESCRIPTION_SELECTORS = [
    "#tab-description", ".woocommerce-Tabs-panel--description", "#description",
    ".product-description", ".description-tab", ".product__description",
    ".product-single__description", ".product.attribute.description .value",
    '[itemprop="description"]', ".tab-content .description",
]
BRAND_SELECTORS = [
    '[itemprop="brand"]', ".woocommerce-product-attributes-item--attribute_pa_brand td",
    ".brand a", ".product-brand", ".product-brand-name",
]
SKU_SELECTORS = [".sku", '[itemprop="sku"]', ".product_meta .sku", ".product-sku"]
LISTING_SELECTORS = [
    ".product-thumb a", ".product-layout a", ".product-item a", ".caption a", ".product-grid a",
    ".product-list a",
]
REGION_SELECTORS = [".product", "#product", '[itemtype*="Product"]', "main"]

SELECTORS = {
    "title": TITLE_SELECTORS,
    "price": PRICE_SELECTORS,
    "breadcrumbs": BREADCRUMB_SELECTORS,
    "gallery": GALLERY_SELECTORS,
    "short_description": SHORT_DESCRIPTION_SELECTORS,
    "long_description": LONG_DESCRIPTION_SELECTORS,
    "brand": BRAND_SELECTORS,
    "sku": SKU_SELECTORS,
    "listing": LISTING_SELECTORS,
    "region": REGION_SELECTORS,
}
# Fields whose hits keep their markup.
MARKUP_FIELDS = {"short_description", "long_description"}

# Image attributes, full-size ones first.
IMAGE_ATTRIBUTES = [
    "data-large_image", "data-o_src", "data-full-url", "data-zoom-image", "data-src",
    "data-lazy-src", "data-original", "data-image", "src",
]
# Crumbs that are navigation and not categories.
BREADCRUMB_FILLER = [
    "home", "homepage", "shop", "store", "all", "all products", "products", "categories",
    "category", "catalogue", "catalog", "browse", "main", "index", "you are here", "back",
]
# Words that dress a brand up as a category.
CATEGORY_NOISE = (
    r"\b(phones?|smartphones?|laptops?|tablets?|tvs?|televisions?|accessories|products?|shop|"
    r"store|collection|in kenya|kenya)\b"
)
# Platform id, name, supported, and (pattern, evidence) pairs, first match wins.
PLATFORM_RULES = [
    ("woocommerce", "WordPress + WooCommerce", True, [
        (r"/plugins/woocommerce/", "WooCommerce plugin assets"),
        (r"woocommerce-page|woocommerce-js|wc-block", "WooCommerce CSS/JS markers"),
        (r"/wp-json/wc/", "WooCommerce REST API reference"),
    ]),
    ("shopify", "Shopify", True, [
        (r"cdn\.shopify\.com", "Shopify CDN assets"),
        (r"Shopify\.theme|shopify-section", "Shopify theme runtime"),
        (r"myshopify\.com", "myshopify.com domain reference"),
    ]),
    ("wordpress", "WordPress (no store plugin detected)", False, [
        (r"/wp-content/", "wp-content asset paths"),
        (r"/wp-includes/", "wp-includes asset paths"),
        (r"name=[\"']generator[\"'] content=[\"']WordPress", "WordPress generator meta tag"),
    ]),
    ("magento", "Magento", False, [
        (r"/static/version\d+", "Magento versioned static assets"),
        (r"Magento_|mage/requirejs", "Magento JS modules"),
    ]),
    ("prestashop", "PrestaShop", False, [
        (r"prestashop", "PrestaShop marker"),
        (r"/modules/ps_", "PrestaShop core modules"),
    ]),
    ("opencart", "OpenCart", False, [
        (r"route=common/home", "OpenCart routing"),
        (r"catalog/view/theme", "OpenCart theme path"),
    ]),
    ("bigcommerce", "BigCommerce", False, [
        (r"cdn\d*\.bigcommerce\.com", "BigCommerce CDN"),
    ]),
    ("wix", "Wix", False, [
        (r"static\.parastorage\.com", "Wix static hosting"),
        (r"wixstatic\.com", "Wix media CDN"),
    ]),
    ("squarespace", "Squarespace", False, [
        (r"Static\.SQUARESPACE_CONTEXT", "Squarespace runtime context"),
        (r"squarespace\.com", "Squarespace reference"),
    ]),
]

_PART = re.compile(r'([.#]?)([\w-]+)|\[([\w-]+)(?:(\*?=)"([^"]*)")?\]')


def selector_parts(selector: str) -> list:
    """One list per step of a descendant selector, of (token, is a substring test)."""
    steps = []
    for step in re.sub(r'"[^"]*"', lambda m: m.group().replace(" ", "\x00"), selector).split():
        parts = []
        for mark, name, attribute, test, value in _PART.findall(step.replace("\x00", " ")):
            if not attribute:
                parts.append((mark + name, False))
            elif test == "*=":
                parts.append(("." if attribute == "class" else f"@{attribute}=", value))
            else:
                parts.append((f"@{attribute}={value}" if test else f"@{attribute}", False))
        steps.append(parts)
    return steps


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s@=])", r"\\\1", text)


def selector_pattern(selector: str) -> str:
    """The selector as a regular expression over an element path (one line per ancestor)."""

    def line(parts):
        tests = [
            rf"(?=[^\n]*\t{_quoted(token)}[^\t\n]*{_quoted(inside)})" if inside
            else rf"(?=[^\n]*\t{_quoted(token)}\t)"
            for token, inside in parts
        ]
        return r"\n" + "".join(tests)

    return r"(?s:.*)".join(line(p) for p in selector_parts(selector)) + r"[^\n]*\z"


def selector_rows(selectors: dict = SELECTORS) -> list:
    """(field, rank, selector, pattern) rows of a rule table."""
    return [
        (field, rank, selector, selector_pattern(selector))
        for field, listed in selectors.items()
        for rank, selector in enumerate(listed)
    ]


# ── Rule tables of a user ─────────────────────────────────────────────────

# A rule table is configuration that every task holds; a longer one is taken for a mistake.
MOST_RULES = 10_000
_STEP = re.compile(rf"(?:{_PART.pattern})+")


def _listed(rules: DataFrame, columns: list) -> list:
    rows = rules.select(*columns).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table has at most {MOST_RULES} rows")
    for row in rows:
        empty = [c for c in columns if row[c] is None or row[c] == ""]
        if empty:
            raise ValueError(f"rule without {', '.join(empty)}: {row}")
    return rows


def selectors_of(rules: DataFrame, base: dict = SELECTORS) -> dict:
    """Selectors per field: the rows of ``rules(field, rank, selector)`` by rank, then those of ``base``.

    A field that ``base`` lacks, a selector that cannot be read, a null or empty value and a table
    of more than ``MOST_RULES`` rows raise ``ValueError``. Equal ranks go by selector, repeated
    selectors count once; an empty table gives ``base``.
    """
    own: dict = {field: [] for field in base}
    for row in sorted(_listed(rules, ["field", "rank", "selector"]), key=lambda r: (r["rank"], r["selector"])):
        if row["field"] not in own:
            raise ValueError(f"no field {row['field']}; fields are {', '.join(base)}")
        steps = re.sub(r'"[^"]*"', '""', row["selector"]).split()
        if not steps or not all(_STEP.fullmatch(step) for step in steps):
            raise ValueError(f"selector cannot be read: {row['selector']}")
        own[row["field"]].append(row["selector"])
    return {field: list(dict.fromkeys([*own[field], *base[field]])) for field in base}


def platform_rules_of(rules: DataFrame, base: list = PLATFORM_RULES) -> list:
    """Platform rules: those of ``rules(rank, platform, name, supported, pattern, evidence)``, then ``base``.

    Rows of one platform are its evidence, by pattern; platforms go by their smallest rank, then by
    id, and come before those of ``base``, of which one of the same id is replaced. Null or empty
    values, patterns that are no regular expression, two names or verdicts for one platform and a
    table of more than ``MOST_RULES`` rows raise ``ValueError``; an empty table gives ``base``.
    """
    found: dict = {}
    rows = _listed(rules, ["rank", "platform", "name", "supported", "pattern", "evidence"])
    for row in sorted(rows, key=lambda r: (r["rank"], r["platform"], r["pattern"])):
        try:
            re.compile(row["pattern"])
        except re.error as problem:
            raise ValueError(f"pattern cannot be read: {row['pattern']}: {problem}") from problem
        kept = found.setdefault(row["platform"], (row["platform"], row["name"], row["supported"], []))
        if kept[1:3] != (row["name"], row["supported"]):
            raise ValueError(f"platform {row['platform']} is described in two ways")
        kept[3].append((row["pattern"], row["evidence"]))
    return [*found.values(), *(rule for rule in base if rule[0] not in found)]
