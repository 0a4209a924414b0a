"""Prices in text: reading a number, a currency code, and writing a display price."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from shelfmark.functions.text import SPACE, strip

# Display symbols per currency code.
CURRENCY_SYMBOLS = {
    "KES": "KSh", "USD": "$", "EUR": "€", "GBP": "£", "UGX": "USh",
    "TZS": "TSh", "NGN": "₦", "ZAR": "R", "INR": "₹",
}
# Currency tokens as they stand in rendered prices, and the codes they mean.
CURRENCY_TOKENS = r"(?i)(KSh|Ksh|KES|USD|EUR|GBP|UGX|TZS|NGN|ZAR|INR|\$|€|£|₦|₹)"
TOKEN_CODES = {"KSH": "KES", "$": "USD", "€": "EUR", "£": "GBP", "₦": "NGN", "₹": "INR"}


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])


def currency_symbols(code: Column) -> Column:
    """The display symbol of a code, or the code itself."""
    upper = F.upper(F.coalesce(code, F.lit("")))
    return F.coalesce(F.try_element_at(_literal_map(CURRENCY_SYMBOLS), upper), upper)


def to_number(text: Column) -> Column:
    """First number in a text; commas and spaces are separators, repeated dots are thousands."""
    digits = F.regexp_extract(strip(text), f"(?U)([0-9][0-9.,\\s]*[0-9]|[0-9])", 1)
    digits = F.regexp_replace(digits, f"(?U)[\\s,]|{SPACE}", "")
    many_dots = F.length(digits) - F.length(F.replace(digits, F.lit("."))) > 1
    return F.when(many_dots, F.replace(digits, F.lit("."))).otherwise(digits).try_cast("double")


def format_price(value: Column, currency: Column) -> Column:
    """Symbol and grouped amount; decimals only where the value has them."""
    whole = F.format_number(value, 0)
    fraction = F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")
    amount = F.when(value == F.floor(value), whole).otherwise(fraction)
    return F.when(value.isNull(), F.lit("")).otherwise(
        strip(F.concat_ws(" ", currency_symbols(currency), amount))
    )


def currency_in(text: Column) -> Column:
    token = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), CURRENCY_TOKENS, 1))
    return F.coalesce(F.try_element_at(_literal_map(TOKEN_CODES), token), token)


def split_price_text(text: Column) -> Column:
    """``struct(currency, value)`` of a rendered price."""
    return F.struct(currency_in(text).alias("currency"), to_number(text).alias("value"))
