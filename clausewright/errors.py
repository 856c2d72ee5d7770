"""Errors, and the classes of failed model calls."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import BACKOFF_BASE, RETRIES

T = TypeVar("T")


class ClausewrightError(Exception):
    """Base of all."""


class FileParseError(ClausewrightError):
    """A document cannot be read."""


class EmptyDocumentError(ClausewrightError):
    """A document gives no chunk."""


@dataclass
class CallError(ClausewrightError):
    """A model call that failed: what kind, and whether to try again."""

    error_type: str
    message: str
    details: str = ""
    is_retryable: bool = False

    def user_message(self) -> str:
        out = self.message + (f"\n   Details: {self.details}" if self.details else "")
        return out + ("\n   This is a temporary issue; retry in a few moments." if self.is_retryable else "")


#: (pattern of the lower-cased text, type, message, retryable), the first that occurs counts.
CLASSES = (
    (r"529|overloaded", "API_OVERLOADED", "The model service is overloaded", True),
    (r"429|rate_limit", "RATE_LIMIT", "The model service's rate limit is exceeded", True),
    (r"401|403|authentication", "AUTH_FAILED", "Authentication failed", False),
    (r"json|parse", "INVALID_RESPONSE", "The model returned an invalid response", True),
)
TRANSIENT = r"timeout|connection"


def classify(error: Exception) -> CallError:
    text = str(error)
    for pattern, kind, message, again in CLASSES:
        if re.search(pattern, text.lower()):
            return CallError(kind, message, text[:200], again)
    return CallError(type(error).__name__, "The model request failed", text[:200], bool(re.search(TRANSIENT, text.lower())))


def error_class(text: Column) -> Column:
    """Struct of error_type and is_retryable of an error text, in a plan."""
    low = F.lower(text)
    out = F.struct(F.lit("OTHER").alias("error_type"), low.rlike(TRANSIENT).alias("is_retryable"))
    for pattern, kind, _, again in reversed(CLASSES):
        out = F.when(low.rlike(pattern), F.struct(F.lit(kind).alias("error_type"), F.lit(again).alias("is_retryable"))).otherwise(out)
    return out


def with_retries(call: Callable[[], T], retries: int = RETRIES, base: float = BACKOFF_BASE, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; after an error it waits base ** attempt seconds, and gives up after ``retries`` tries or at once if another try is in vain."""
    for attempt in range(retries):
        try:
            return call()
        except Exception as e:
            error = e if isinstance(e, CallError) else classify(e)
            if attempt + 1 == retries or not error.is_retryable:
                raise error from e
            sleep(base**attempt)
    raise ValueError("no tries")
