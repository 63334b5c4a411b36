"""Values read from documents: numbers, strengths, dates, confidences, keys. Column expressions but for signing."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(value: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), pattern, group), F.lit(""))


def quantity(value: Column) -> Column:
    """The first number; a comma ends it, so 1,750 is 1."""
    return _first(value, r"[-+]?\d*\.?\d+").try_cast("double")


def strength(value: Column) -> Column:
    """struct(amount, unit) of the first number that a unit follows, or null."""
    pattern = r"(?i)(\d*\.?\d+)\s*(mg|mcg|g|ml|iu|%)"
    amount = _first(value, pattern, 1).try_cast("double")
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), F.lower(_first(value, pattern, 2)).alias("unit")))


def plain_number(cell: Column) -> Column:
    """The first number as text, without its commas, or null."""
    return F.replace(_first(cell, r"-?[\d,]*\.?\d+"), F.lit(","), F.lit(""))


def to_float(value: Column) -> Column:
    """A number with commas; anything else is null."""
    s = F.trim(F.replace(value.cast("string"), F.lit(","), F.lit("")))
    return F.when(s.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), s.try_cast("double"))


def header_form(cell: Column) -> Column:
    """A header cell without white space and dots, lower case."""
    return F.lower(F.translate(F.coalesce(cell, F.lit("")), " \t\n\x0b\f\r.", ""))


def clean(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


#: Tried in turn; a form without a day is its month's first day. Differs from a fuzzy parse on purpose: it never depends on today.
DATE_FORMS = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "d/M/yy"),
    (r"\d{1,2}-\d{1,2}-\d{2}", "d-M-yy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-yyyy"),
    (r"[A-Za-z]{3} \d{4}", "MMM yyyy"),
    (r"[A-Za-z]{3}-\d{2}", "MMM-yy"),
    (r"\d{1,2}/\d{4}", "M/yyyy"),
    (r"\d{1,2}-\d{4}", "M-yyyy"),
    (r"\d{1,2}/\d{2}", "M/yy"),
]


_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_TIMES = r"\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(\s*[ap]\.?m\b)?|\d{1,2}(\.\d{2})?\s*[ap]\.?m\b"


def worded_date(value: Column) -> Column:
    """A date whose month is a word, whole or from three letters on, in any order, among other words, weekdays and times.

    One pass over the tokens: the first month counts; a number of four digits is the year; of the others the first up to 31 is the day,
    with or without an ordinal's ending, and one after it the year of this century. Without a day it is the month's first,
    without a month or a year none: it never depends on today.
    """
    text = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), _TIMES, " ")
    tokens = F.regexp_extract_all(text, F.lit(r"[a-z]+|\d+(?:st|nd|rd|th)?"), F.lit(0))
    months = F.array(*map(F.lit, _MONTHS))
    none = F.lit(None).cast("int")

    def step(state: Column, token: Column) -> Column:
        digits = F.regexp_extract(token, r"^\d{1,4}(?!\d)", 0)
        n, size, ordinal = F.nullif(digits, F.lit("")).try_cast("int"), F.length(digits), token.rlike("[a-z]$")
        month = F.when((F.length(token) >= 3) & n.isNull(), F.nullif(F.array_position(F.transform(months, lambda m: m.startswith(token)), F.lit(True)).cast("int"), F.lit(0)))
        day = F.when(state["day"].isNull() & (size <= 2) & n.between(1, 31), n)
        year = F.when(day.isNull() & ~ordinal, F.when(size == 4, n).when((size == 2) & state["day"].isNotNull(), n + 2000))
        return F.struct(F.coalesce(state["day"], day).alias("day"), F.coalesce(state["month"], month).alias("month"), F.coalesce(state["year"], year).alias("year"))

    start = F.struct(none.alias("day"), none.alias("month"), none.alias("year"))
    plain = lambda s: F.when(s["month"].isNotNull() & s["year"].isNotNull(), F.format_string("%04d-%02d-%02d", s["year"], s["month"], F.coalesce(s["day"], F.lit(1))))
    return F.try_to_timestamp(F.aggregate(tokens, start, step, plain), F.lit("yyyy-MM-dd")).cast("date")


def _at_once() -> tuple[str, str]:
    """A pattern of a whole text that has one date, in any of the forms, and no digit beside it; and what it becomes: year-month-day.

    Where it matches, no other form could be found in the text but in a part of that date. Any other text gets
    "--" before it, and an empty one stays empty.
    """
    part = {"yyyy": r"(\d{4})", "yy": r"(\d{2})", "MMM": "([A-Za-z]{3})", "M": r"(\d{1,2})", "d": r"(\d{1,2})"}
    digits, letters, places, n = [], [], {"y": "", "M": "", "d": ""}, 0
    for _, form in sorted(DATE_FORMS, key=lambda f: f[1].startswith("MMM")):
        said = ""
        for x in re.findall("y+|M+|d+|.", form):
            said += part.get(x) or re.escape(x)
            if x in part:
                places[x[0]] += f"${(n := n + 1)}"
        (letters if form.startswith("MMM") else digits).append(said)
    begin = rf"\D*+(?<![/.-])(?:{'|'.join(digits)})|(?:\D*[^\d/.-])?(?:{'|'.join(letters)})"
    return rf"(?s)\A(?:(?:{begin})(?:[^\d/.-]\D*+)?|(.+))\z", "-".join(places.values()) + f"${n + 1}"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def date(value: Column) -> Column:
    """Day first, ISO as ISO, months as words; month and year give the first of the month; anything else is null.

    A text that has one date and no other digit is read by one pattern; on others, and on what is no date by that, the forms are
    tried in turn.
    """

    def in_turn(text: Column) -> Column:
        tries = []
        for pattern, form in DATE_FORMS:
            alone = rf"(?<![\d/.-])({pattern})(?![\d/.-])"
            tries.append(F.when(text.rlike(alone), F.try_to_timestamp(F.initcap(F.regexp_extract(text, alone, 1)), F.lit(form)).cast("date")))
        return F.when(text.rlike(r"\d"), F.coalesce(*tries, worded_date(text)))

    def of_parts(said: Column) -> Column:
        """year-month-day, the year of two digits or four, the month a number or three letters, the day perhaps empty."""
        plain = F.rtrim(said, F.lit("-"))
        short = F.when(F.substring(said, 3, 1) == "-", F.concat(F.lit("20"), plain).try_cast("date"))
        named = F.when(~said.startswith("--"), F.try_to_timestamp(said, F.lit("[yyyy][yy]-[MMM][M]-[d]")).cast("date"))
        return F.coalesce(plain.try_cast("date"), short, named)

    return F.coalesce(_let(F.regexp_replace(value, *_at_once()), of_parts), _let(value, in_turn))


def idempotency_key(document_id: Column, connector_id: Column) -> Column:
    return F.concat_ws(":", document_id, connector_id)


def confidence_percent(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("long")


def bucket_at_least(c: Column) -> Column:
    """For a field: none, low under 0.6, medium under 0.85, else high."""
    return F.when(c.isNull(), "none").when(c < 0.6, "low").when(c < 0.85, "medium").otherwise("high")


def bucket_above(c: Column) -> Column:
    """For a document: none, high above 0.85, medium above 0.6, else low; differs from the above at just those two."""
    return F.when(c.isNull(), "none").when(c > 0.85, "high").when(c > 0.6, "medium").otherwise("low")


def match_badge(score: Column) -> Column:
    return F.when(score >= 85, "strong").when(score >= 70, "likely").otherwise("weak")


#: Parts of an error's text, lower case, that make it worth another try.
TRANSIENT = ["503", "overloaded", "unavailable", "429", "resource_exhausted", "rate limit", "try again", "timeout", "deadline", "500", "internal"]


def is_transient(code: Column, message: Column) -> Column:
    """Worth another try: rate limits, server errors, and messages that say so."""
    said = F.lower(F.coalesce(message, F.lit("")))
    found = F.coalesce(code.isin(429, 500, 503), F.lit(False))
    for part in TRANSIENT:
        found = found | F.contains(said, F.lit(part))
    return found


def doc_type_of(content: Column) -> Column:
    """A stand-in for a model: an invoice says so in its first 64 bytes."""
    return F.when(F.contains(F.upper(F.substring(content.cast("string"), 1, 64)), F.lit("INVOICE")), "invoice").otherwise("prescription")


def content_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".pdf"), "application/pdf").when(n.endswith(".png"), "image/png").when(n.endswith(".webp"), "image/webp").otherwise("image/jpeg")


def sign(secret: str, body: str) -> str:
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def verify(secret: str, body: str, signature: str) -> bool:
    return hmac.compare_digest(sign(secret, body), signature or "")


def signature(body: Column, secret: str) -> Column:
    """As sign(), from the two keyed hashes that HMAC-SHA256 is."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    once = F.unhex(F.sha2(F.concat(inner, body.cast("string").cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, once), 256))
