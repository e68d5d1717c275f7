"""Is a response a page? First-match classifiers over HTML and status, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelathe.functions.text import digit_share, visible_text

#: Marks of challenge pages in HTML, any case (fixed values).
BLOCK_MARKS = (
    "cf-chl-bypass", "__cf_chl_", "/cdn-cgi/challenge-platform/", "cf-turnstile", "<title>just a moment...", "datadome", "dd-captcha",
    "px-captcha", "_pxhd", "_px3", "akam-sw.js", "_incapsula_resource",
)
#: Sentences of block pages in visible text, lower case (fixed values).
BLOCK_PHRASES = (
    "unable to give you access", "unfortunately we are unable", "access denied", "you don't have permission to access",
    "you do not have permission to access", "pardon our interruption", "as you were browsing", "incapsula incident",
    "sorry, you have been blocked", "checking your browser before accessing", "this website is using a security service to protect itself",
    "please verify you are a human", "complete the security check to access", "are you a robot", "enable javascript and cookies to continue",
    "extra security in place to prevent bots", "automatically identified a security issue",
)
REFERENCE = r"reference\s*(?:error|#|number)?\s*[:#]?\s*\d{1,3}\.[0-9a-f]{6,}\.\d{6,}\.[0-9a-f]{6,}"
FRAMEWORKS = ("__NEXT_DATA__", "ng-version", "data-reactroot", "window.__NUXT__")
SOFT_STATUS = (402, 403, 406, 429, 503)


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in words))


def has_block_mark(html: Column) -> Column:
    return any_of(F.lower(html), BLOCK_MARKS)


def has_block_text(html: Column) -> Column:
    """Only small pages: a long article may speak of access denied."""
    text = F.lower(visible_text(html))
    return (F.length(html) <= 60_000) & F.length(text).between(1, 4000) & (any_of(text, BLOCK_PHRASES) | text.rlike(REFERENCE))


def size(html: Column) -> Column:
    return F.length(F.regexp_replace(html, r"^\s+|\s+$", ""))


def escalation_reason(html: Column, status: Column, numeric: Column | bool = False) -> Column:
    """Why a plain response should be fetched by a browser; none if it need not."""
    numeric = F.lit(numeric) if isinstance(numeric, bool) else numeric
    visible, n = F.length(visible_text(html)), F.length(html)
    return (
        F.when(has_block_mark(html), "block_signature")
        .when(has_block_text(html), "block_content")
        .when(status.isin(*SOFT_STATUS), "soft_status")
        .when(size(html) < 500, "empty_body")
        .when(any_of(html, FRAMEWORKS), "js_framework")
        .when((n > 1000) & (n < 8000) & (visible < 300), "interstitial_like")
        .when(numeric & (n > 1000) & (digit_share(html) < 0.001), "no_digits")
        .when((n > 2000) & (visible < 200), "empty_text")
        .otherwise("none")
    )


def is_hard_block(html: Column, status: Column) -> Column:
    """Still a block page after the browser had it."""
    return (status.isin(403, 429, 503) & (size(html) < 2000)) | (has_block_mark(html) & (size(html) < 20_000)) | has_block_text(html)


def null_rate_fires(nulls: Column, total: Column, product: Column, product_null: Column, prefilled: Column) -> Column:
    """Whether so much is null that a second source is asked."""
    return (
        F.when(total == 0, False)
        .when(total <= 2, (nulls >= 1) & ~prefilled)
        .when(total <= 4, nulls >= 2)
        .when(product & product_null, True)
        .otherwise(nulls >= 0.2 * total)
    )


def error_row(code: Column) -> Column:
    """The error struct of a code: message, and whether a later try may succeed."""
    retry = code.isin("FETCH_BLOCKED", "TIMEOUT", "LLM_ERROR", "LLM_UNAVAILABLE", "LLM_RATE_LIMITED", "LLM_TIMEOUT", "LLM_EMPTY", "URL_UNREACHABLE")
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.lower(F.regexp_replace(code, "_", " ")).alias("message"), retry.alias("retryable")))
