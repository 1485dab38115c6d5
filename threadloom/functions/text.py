"""Text expressions: repair, duplicate forms, redaction, shingles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wrongly decoded punctuation and its repair, in the order of application.
REPAIRS = (
    ("â€™", "’"),
    ("â€˜", "‘"),
    ("â€œ", "“"),
    ("â€\x9d", "”"),
    ("â€“", "–"),
    ("â€”", "—"),
    ("Â ", " "),
    (" ", " "),
)

# Redaction patterns by class, in the order of application.
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>()]+|www\.[^\s<>()]+"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PHONE = r"(?<![\w.])(?:\+?\d[\d\s().-]{7,}\d)(?!\w)"
HANDLE = r"(?<!\w)@([A-Za-z0-9_]+)"
NUMBER = r"\b\d{6,}\b"
URL_TAIL = r"[.,!?;:)\]}]*"


@F.pandas_udf(T.StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition; ASCII passes through."""
    for s in batches:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition and full case folding."""
    for s in batches:
        yield s.map(lambda t: None if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(T.StringType())
def unaccented(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Without combining marks after compatibility decomposition."""
    for s in batches:
        yield s.map(lambda t: t if t is None or t.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)))


def squeezed(c: Column) -> Column:
    """Runs of white space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def normalized(c: Column) -> Column:
    """Repaired punctuation, no zero-width blanks, canonical composition, squeezed white space; null reads as empty."""
    out = F.coalesce(c, F.lit(""))
    for broken, right in REPAIRS:
        out = F.replace(out, F.lit(broken), F.lit(right))
    for ch in ("​", "﻿"):
        out = F.replace(out, F.lit(ch), F.lit(""))
    return squeezed(nfc(out))


def duplicate_form(c: Column) -> Column:
    """The form in which two texts count as copies."""
    return squeezed(folded(c))


def redaction_steps(c: Column, brand_handles: Sequence[str] = (), safe_domains: Sequence[str] = ()) -> list[tuple[str, Column, Column]]:
    """(class, count, text after it) of each step of redaction, in order; the last text is the redacted one."""
    steps: list[tuple[str, Column, Column]] = []

    def step(name: str, pattern: str, replacement: str, text: Column) -> Column:
        after = F.regexp_replace(text, f"(?iU){pattern}", replacement)
        steps.append((name, F.regexp_count(text, F.lit(f"(?iU){pattern}")), after))
        return after

    text = step("email", EMAIL, "[EMAIL]", c)
    if safe_domains:
        hosts = "|".join(re.escape(d.lower()) for d in safe_domains)
        safe = rf"https?://((?:[\w-]+\.)*(?:{hosts}))(?::\d+)?(?:[/?#][^\s<>()]*?)?({URL_TAIL})(?=[\s<>()]|$)"
        text = step("safe_url", safe, r"[URL:$1]$2", text)
        parts = F.split(text, r"\[URL:")
        text = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lower(F.substring_index(p, "]", 1)), F.substr(p, F.length(F.substring_index(p, "]", 1)) + 1)))), "[URL:")
    url = rf"(?:https?://|www\.)[^\s<>()]*?({URL_TAIL})(?=[\s<>()]|$)"
    text = step("url", url, r"[URL]$1", text)
    text = step("ip_address", IP, "[IP]", text)
    text = step("phone", PHONE, "[PHONE]", text)
    if brand_handles:
        own = "|".join(re.escape(h) for h in brand_handles)
        text = step("brand_handle", rf"(?<!\w)@(?:{own})(?![A-Za-z0-9_])", "[BRAND]", text)
    text = step("customer_handle", HANDLE, "[CUSTOMER]", text)
    step("long_number", NUMBER, "[NUMBER]", text)
    return steps


def redacted(c: Column, brand_handles: Sequence[str] = (), safe_domains: Sequence[str] = ()) -> Column:
    return redaction_steps(c, brand_handles, safe_domains)[-1][2]


def audit_redacted(c: Column, limit: int = 500) -> Column:
    """Redaction for audit excerpts: no addresses of hosts, no phone before handles, cut to ``limit`` characters."""
    out = F.regexp_replace(c, f"(?U){EMAIL}", "[EMAIL]")
    out = F.regexp_replace(out, r"(?U)https?://\S+|www\.\S+", "[URL]")
    out = F.regexp_replace(out, r"(?U)(?<!\w)@[A-Za-z0-9_]+", "[USER]")
    out = F.regexp_replace(out, r"(?U)(?<!\w)\+?\d[\d\s().-]{7,}\d(?!\w)", "[PHONE]")
    out = F.regexp_replace(out, f"(?U){NUMBER}", "[NUMBER]")
    return F.substring(out, 1, limit)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once per row: the optimizer would copy it to every place of use, also into loops."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def char_shingles(c: Column, size: int) -> Column:
    """All distinct substrings of a length; a shorter text is its own shingle."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - size + 1)), lambda i: F.substring(c, i, F.lit(size))))


def feature_text(message: Column, context: Column | None = None) -> Column:
    """Context and message joined, redacted, without placeholders: what the text models read."""
    whole = message if context is None else F.trim(F.concat_ws(" ", context, message))
    return F.regexp_replace(redacted(whole), r"\[[A-Z_]+\]", " ")


def dense_text(message: Column, context: Column) -> Column:
    """As :func:`feature_text`, but the message first: an encoder that cuts long texts loses old context, never the message."""
    none = F.lit("")
    return F.concat(feature_text(F.coalesce(message, none)), F.lit(" "), feature_text(F.coalesce(F.array_join(context, " "), none)))
