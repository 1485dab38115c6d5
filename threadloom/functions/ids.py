"""Ids, flags and times as they are spelled in raw message dumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and format characters that may surround a value.
BLANKS = r"[\s\p{Z}\p{Cf}\p{Cc}]"


def stripped(c: Column) -> Column:
    """Without surrounding white space of any kind, including zero-width characters."""
    return F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+$", "")


def cleaned(c: Column) -> Column:
    """Stripped; blank becomes null."""
    return F.nullif(stripped(c), F.lit(""))


def name_id(c: Column) -> Column:
    """An example, group or thread id in its plain form: lower case, no surrounding blanks; blank is null."""
    return F.lower(cleaned(c))


def message_id(c: Column) -> Column:
    """The whole number a message id denotes, as BIGINT; null where it denotes none.

    ``0012``, `` 12``, ``"12"``, ``[12]``, ``12.0`` and ``"1,200"`` are readings of a number; ids are 64-bit, and a longer run of
    digits names no message.
    """
    bare = F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}\p{Cc}\"'\[\]{}()]+|[\s\p{Z}\p{Cf}\p{Cc}\"'\[\]{}()]+$", "")
    number = F.regexp_extract(bare, r"^\+?([0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.0*)?$", 1)
    other = F.regexp_replace(number, ",", "").try_cast("bigint")
    return F.when(c.rlike("^[0-9]{1,18}$"), c.try_cast("bigint")).otherwise(other)


def flag(c: Column) -> Column:
    """True or false where the text reads so, whatever its case and surrounding blanks; else null."""
    x = F.lower(stripped(c))
    return F.when(x == "true", F.lit(True)).when(x == "false", F.lit(False))


def moment(c: Column) -> Column:
    """The moment a time text names, in UTC; null if it names none.

    Reads ``Sat Mar 04 19:01:19 +0000 2023`` and ISO 8601 with an offset, ``Z`` or neither (then UTC). The weekday is not checked.
    """
    x = stripped(c)
    mail = F.try_to_timestamp(F.regexp_extract(x, r"^[A-Za-z]{3},? ([A-Z][a-z]{2} [0-9]{1,2} [0-9:]{8} [+-][0-9]{4} [0-9]{4})$", 1), F.lit("MMM d HH:mm:ss Z yyyy"))
    iso = F.regexp_extract(x, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)$", 1)
    return F.when(x.rlike("^[A-Za-z]"), mail).otherwise(iso.try_cast("timestamp"))
