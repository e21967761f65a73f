"""Clean-up of scraped strings: prices, dates, text, personal data, domains."""

from __future__ import annotations

import html as html_lib

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The price pattern's parts, currency signs, date formats in order, personal data.
AMOUNT = r"(?U)([$€£¥₹]|[A-Z]{3}(?=[\s\d]))?\s*(\d[\d,.\s]*\d|\d)\s*([A-Z]{3}|[$€£¥₹])?"
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
EMAIL, PHONE = r"(?U)[\w.+-]+@[\w-]+\.\w+", r"(?U)(?<!\d)(?:\+?\d[\d\-\s()]{7,}\d)(?!\d)"


def price(text: Column) -> Column:
    """struct<amount,currency>; null where there is no amount."""
    raw = F.nullif(F.regexp_extract(text, AMOUNT, 2), F.lit(""))
    sign = F.coalesce(F.nullif(F.regexp_extract(text, AMOUNT, 1), F.lit("")), F.nullif(F.regexp_extract(text, AMOUNT, 3), F.lit("")), F.nullif(F.regexp_extract(text, r"(?U)\b([A-Z]{3})\b", 1), F.lit("")))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])[sign], sign)
    digits = F.replace(raw, F.lit(" "), F.lit(""))
    comma, dot = F.locate(",", F.reverse(digits)), F.locate(".", F.reverse(digits))  # 0: none; else the distance from the end
    no_comma = F.replace(digits, F.lit(","), F.lit(""))
    plain = (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((comma > 0) & (dot > 0), no_comma).when((comma == 2) | (comma == 3), F.replace(digits, F.lit(","), F.lit("."))).when(comma > 0, no_comma).otherwise(digits)
    )
    amount = plain.try_cast("double")
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), named.alias("currency")))


@F.arrow_udf(StringType())
def unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html_lib.unescape(t) if "&" in t else t for t in texts.to_pylist()], pa.string())


def clean_text(text: Column, collapse: bool = True) -> Column:
    """Character references decoded, white space collapsed.

    There is no table of named references in the JVM: they are decoded by an Arrow UDF, to which only texts with an ampersand send their characters.
    """
    decoded = unescaped(F.when(text.contains("&"), text))
    plain = F.coalesce(decoded, text)
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), "^ | $", "") if collapse else plain


def date(text: Column) -> Column:
    """ISO first, then the formats in order (month before day); null if none fits."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:?\d{2}|Z)?)?$"), t.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS])


def redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]"), PHONE, "[REDACTED_PHONE]")


def domain(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("AUTHORITY"))
