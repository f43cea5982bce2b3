"""Decoding of list-valued JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE_TEXT = "none identified"


def json_list(c: Column) -> Column:
    """Null or blank gives [], a JSON list its items, anything else a list of that one value."""
    text = F.coalesce(c, F.lit(""))
    scalar = F.coalesce(F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string").getField("v"), text)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.ltrim(text).startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array(text)))
        .otherwise(F.array(scalar))
    )


def item_name(item: Column, *keys: str) -> Column:
    """Items that are JSON objects give their first non-null key, plain items themselves."""
    named = F.coalesce(*[F.get_json_object(item, f"$.{k}") for k in keys], item)
    return F.when(F.ltrim(item).startswith("{"), named).otherwise(item)


def item_names(items: Column, *keys: str) -> Column:
    return F.transform(items, lambda i: item_name(i, *keys))


def real_item(item: Column, mode: str = "equals") -> Column:
    """True for items that say something: the two readings of the 'none identified' placeholder."""
    present = item.isNotNull() & (item != "")
    if mode == "equals":
        return present & (F.lower(item) != NONE_TEXT)
    if mode == "contains":
        return present & ~F.contains(F.lower(item), F.lit(NONE_TEXT))
    if mode == "any":
        return present
    raise ValueError(f"unknown mode {mode}")


def real_items(items: Column, mode: str = "equals") -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda i: real_item(i, mode))
