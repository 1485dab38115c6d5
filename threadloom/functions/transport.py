"""What services say about limits, as column expressions: durations, usage, quota headers, kinds of refusal, waits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of durations in seconds, categories of refusal, reasons that services give.
UNIT_SECONDS = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
CATEGORIES = ("billing", "daily", "quota_unavailable", "temporary", "unknown", "not_rate_limited")
USAGE_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens")
RETRY_REASONS = ("rate_limit_exceeded", "too_many_requests", "RATE_LIMIT_EXCEEDED")
DAILY_REASONS = ("quota_exceeded", "DAILY_LIMIT_EXCEEDED")
UNSPECIFIED_REASON = "QUOTA_EXCEEDED"
SECRETS = r"AIza|gh[pousr]_|sk-|(?i:secret|password|api.?key|token=)"


def seconds(text: Column) -> Column:
    """The length of ``2m59.56s``, ``12.5s``, ``1d2h`` or ``300ms`` in seconds; null for anything else."""
    whole = text.rlike(r"^(?:\d+(?:\.\d+)?(?:ms|[dhms]))+$")
    part = r"(\d+(?:\.\d+)?)(ms|[dhms])"
    numbers, units = F.regexp_extract_all(text, F.lit(part), 1), F.regexp_extract_all(text, F.lit(part), 2)
    by_unit = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("double") * by_unit[u]), F.lit(0.0), lambda a, x: a + x)
    return F.when(whole, total)


def safe_identifier(text: Column) -> Column:
    """A short name of letters, digits and ``_./-``; null for anything that might hold a secret."""
    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9_./-]{0,199}$") & ~text.rlike(SECRETS), text)


def usage(json: Column) -> Column:
    """``prompt_tokens, completion_tokens, total_tokens, cached_tokens, reasoning_tokens`` of a response; what is absent or no whole number stays null."""

    def number(path: str) -> Column:
        raw = F.get_json_object(json, f"$.usage.{path}")
        return F.when(raw.rlike(r"^\d{1,18}$"), raw.try_cast("bigint"))

    plain = [number(f).alias(f) for f in USAGE_FIELDS]
    return F.struct(*plain, number("prompt_tokens_details.cached_tokens").alias("cached_tokens"), number("completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"))


def quota_headers(headers: Column) -> Column:
    """``limit_*, remaining_*, reset_*_seconds`` for requests and tokens from a map of response headers; unreadable values are null."""
    fields = []
    for group in ("requests", "tokens"):
        for kind in ("limit", "remaining"):
            raw = headers[f"x-ratelimit-{kind}-{group}"]
            fields.append(F.when(raw.rlike(r"^\d{1,18}$"), raw.try_cast("bigint")).alias(f"{kind}_{group}"))
        fields.append(seconds(headers[f"x-ratelimit-reset-{group}"]).alias(f"reset_{group}_seconds"))
    return F.struct(*fields)


def refusal(status: Column, reasons: Column, quotas: Column, zero_quota: Column, has_delay: Column) -> Column:
    """The category of a refusal; the first that holds of billing, daily, no quota, temporary, unknown.

    ``reasons`` and ``quotas`` are arrays of reason codes and of quota names, ``zero_quota`` whether a quota is 0, ``has_delay`` whether a time
    to retry was given. Null arrays read as empty.
    """
    reasons, quotas = F.coalesce(reasons, F.array().cast("array<string>")), F.coalesce(quotas, F.array().cast("array<string>"))
    names = F.transform(quotas, lambda q: F.regexp_replace(F.lower(q), "[^a-z]", ""))
    short = (F.size(names) > 0) & F.forall(names, lambda n: n.rlike("perminute|persecond"))
    hinted = (F.size(names) == 0) & ~F.array_contains(reasons, UNSPECIFIED_REASON) & (F.coalesce(has_delay, F.lit(False)) | F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in RETRY_REASONS])))
    return (
        F.when(F.exists(reasons, lambda r: r.startswith("BILLING_")), "billing")
        .when(F.exists(names, lambda n: n.rlike("perday|daily")) | F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in DAILY_REASONS])), "daily")
        .when(F.coalesce(zero_quota, F.lit(False)), "quota_unavailable")
        .when(((status == 429) & (short | hinted)) | (status == 503), "temporary")
        .when(status.isin(429, 503), "unknown")
        .otherwise("not_rate_limited")
    )


def reservation(tokens: Column) -> Column:
    """Tokens to reserve for a request of so many: a tenth more and 512."""
    return (F.ceil(tokens * F.lit(1.1)) + 512).cast("bigint")


def retry_wait(index: Column, jitter: Column, until: Column, now: Column, first: float, most: float) -> Column:
    """Seconds to wait before try ``index``: the base doubles up to ``most``, but never less than the time the server named."""
    own = F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), F.least(index, F.lit(20))) + F.greatest(jitter, F.lit(0.0)))
    return F.greatest(own, F.coalesce(F.greatest(until - now, F.lit(0.0)), F.lit(0.0)))
