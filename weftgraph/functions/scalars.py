"""Scalar column functions: ids, hex, ratios, display."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from weftgraph.schemas import ID_BIAS


def node_id(address: Column, bias: int = ID_BIAS) -> Column:
    """Id of an address; eight hex digits at least, more where it needs them."""
    return F.format_string("FUN_%08x", address + F.lit(bias))


def parse_hex(text: Column) -> Column:
    """``0x...`` text as BIGINT; null for other text and for values over 63 bits."""
    digits = F.regexp_extract(text, "^0x([0-9a-fA-F]+)$", 1)
    return F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 16, F.conv(digits, 16, 10).try_cast("bigint"))


def to_hex(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def address(text: Column) -> Column:
    """An address written in hex or in decimal."""
    return F.coalesce(parse_hex(F.lower(text)), text.try_cast("bigint"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Six decimals, half to even; null for denominator 0."""
    return F.bround(F.try_divide(numerator.cast("double"), denominator.cast("double")), 6)


def anchor_color_class(node: Column, kind: Column, policy: str) -> Column:
    return F.concat(F.lit("ADDR:"), node) if policy == "address" else F.concat(F.lit("ROLE:"), kind)


def display_symbol(symbol: Column, case: Column) -> Column:
    """Without the case's namespace and the trailing hash."""
    short = F.when(symbol.startswith(F.concat(case, F.lit("::"))), F.substr(symbol, F.length(case) + 3)).otherwise(symbol)
    return F.regexp_replace(short, "::h[0-9a-fA-F]{16}$", "")


def normalised_warning(message: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(message, "0x[0-9a-fA-F]+", "0x<addr>"), r"\s+", " "))


def is_import(name: Column, kind: Column) -> Column:
    return F.coalesce(name.startswith("sym.imp."), F.lit(False)) | F.coalesce(kind == "sym", F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value, ties to even.

    The JVM's formatter rounds the shortest decimal form half up (0.125 to 0.13), so cells go through Python in batches.
    """

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.{digits}f}")

    return F.when(value.isNotNull(), shown(value.cast("double")))


def metric_text(value: Column) -> Column:
    return F.coalesce(fixed(value, 2), F.lit("N/A"))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def linked_address(mapped: Column, mapped_base: Column, linked_base: Column) -> Column:
    return mapped - mapped_base + linked_base


def value_text(value: Column, kind: str) -> Column:
    """A table cell: ``-`` for null, yes and no, thousands with commas, four decimals, other text as it is."""
    if kind == "double":
        return F.coalesce(fixed(value, 4), F.lit("-"))
    shown = F.when(value, "yes").otherwise("no") if kind == "boolean" else F.format_number(value, 0) if kind == "bigint" else value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), shown), F.lit("-"))


def nested(record: Column, *keys: str, default: str | None = None) -> Column:
    """A field of nested JSON text; the default where a level is missing or no object."""
    found = F.get_json_object(record, "$" + "".join(f"['{k}']" for k in keys))
    return found if default is None else F.coalesce(found, F.lit(default))
