"""The product record: one fixed schema that every reader, operator and sink agrees on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.functions.text import float_text

# Export column order.
CORE_FIELDS = [
    "title", "brand", "price", "url", "categories", "images", "short_description", "long_description",
]
DETAIL_FIELDS = ["price_value", "currency", "sku", "availability", "in_stock"]
EXPORT_FIELDS = CORE_FIELDS + DETAIL_FIELDS
LIST_FIELDS = ["categories", "images"]
UNKNOWN_BRAND = "Unknown"

FIELD_TYPES = {
    "categories": T.ArrayType(T.StringType()),
    "images": T.ArrayType(T.StringType()),
    "price_value": T.DoubleType(),
    "in_stock": T.BooleanType(),
    "extracted_by": T.MapType(T.StringType(), T.StringType()),
}
ALL_FIELDS = EXPORT_FIELDS + ["extracted_by"]
PRODUCT_SCHEMA = T.StructType(
    [T.StructField(name, FIELD_TYPES.get(name, T.StringType())) for name in ALL_FIELDS]
)


def normalize_records(df: DataFrame) -> DataFrame:
    """Pad missing fields and coerce types; columns outside the schema are carried along."""
    have = dict(df.dtypes)

    def field(name):
        target = FIELD_TYPES.get(name, T.StringType())
        if name not in have:
            value = F.lit(None).cast(target)
        elif name in LIST_FIELDS and not have[name].startswith("array"):
            value = F.when(F.col(name).isNotNull(), F.array(F.col(name).cast("string")))
        elif have[name] == "double" and isinstance(target, T.StringType):
            value = float_text(F.col(name))
        else:
            value = F.col(name).cast(target)
        if name in LIST_FIELDS:
            value = F.coalesce(value, F.array().cast(target))
        elif name == "extracted_by":
            value = F.coalesce(value, F.create_map().cast(target))
        elif name == "brand":
            value = F.coalesce(F.nullif(value, F.lit("")), F.lit(UNKNOWN_BRAND))
        elif isinstance(target, T.StringType):
            value = F.coalesce(value, F.lit(""))
        return value.alias(name)

    extra = [F.col(c) for c in df.columns if c not in ALL_FIELDS]
    return df.select(*[field(name) for name in ALL_FIELDS], *extra)


def export_rows(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """Flat string rows in the export order: lists joined, NULL empty, booleans yes/no."""
    rendered = {
        "categories": F.coalesce(F.array_join("categories", " > "), F.lit("")),
        "images": F.coalesce(F.array_join("images", " | "), F.lit("")),
        "in_stock": F.when(F.col("in_stock"), "yes").when(~F.col("in_stock"), "no").otherwise(""),
        "price_value": F.coalesce(float_text(F.col("price_value")), F.lit("")),
    }
    columns = [
        rendered.get(name, F.coalesce(F.col(name).cast("string"), F.lit(""))).alias(name)
        for name in EXPORT_FIELDS
    ]
    return df.select(*columns, *[F.col(c) for c in keep])
