"""What can go wrong, and what is worth another try."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass


class StoreError(Exception):
    """Any error of the store."""


class OversizedEntry(StoreError):
    """An entry that no memtable can hold."""


class ExhaustedSegments(StoreError):
    """All log segments await their flush."""


class CorruptFrame(StoreError):
    """A frame whose checksum is wrong."""


class TruncatedFrame(StoreError):
    """A frame that ends early."""


class MissingOrder(StoreError):
    """A log segment without its order record."""


class CommitConflict(StoreError):
    """Another writer took the catalogue's next version."""


#: Kinds of error, the first that fits; those of the JVM by the name of a cause.
KINDS = (
    ("interrupted", (InterruptedError,), ("InterruptedIOException", "InterruptedException", "ClosedByInterruptException")),
    ("would block", (BlockingIOError,), ()),
    ("timed out", (TimeoutError,), ("SocketTimeoutException", "ConnectTimeoutException", "TimeoutException")),
    ("closed", (BrokenPipeError, ConnectionError, EOFError), ("ClosedChannelException", "EOFException")),
    ("io", (OSError,), ("IOException", "FileNotFoundException")),
)
TRANSIENT = {"interrupted", "would block", "timed out"}


def kind_of(error: BaseException) -> str:
    """interrupted, would block, timed out, closed, io or other."""
    names = _java_names(error)
    for kind, types, java in KINDS:
        if isinstance(error, types) or any(n in java for n in names):
            return kind
    return "other"


def _java_names(error: BaseException) -> list[str]:
    """Class names of a JVM error and its causes, the innermost last."""
    names, cause = [], getattr(error, "java_exception", None)
    while cause is not None and len(names) < 20:
        names.append(cause.getClass().getSimpleName())
        cause = cause.getCause()
    return names


def is_transient(error: BaseException) -> bool:
    return kind_of(error) in TRANSIENT


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 5
    base_ms: int = 100
    most_ms: int = 5_000

    def cap_ms(self, attempt: int) -> int:
        """The longest delay before try number attempt + 2."""
        return min(self.base_ms << min(attempt, 32), self.most_ms)


def retry_if(policy: RetryPolicy, act: Callable, worth: Callable[[BaseException], bool] = is_transient, sleep: Callable[[float], None] = time.sleep):
    """act's result; after an error that is worth it, waits up to the cap at random and tries again."""
    for attempt in range(policy.attempts):
        try:
            return act()
        except Exception as error:
            if attempt + 1 >= policy.attempts or not worth(error):
                raise
            sleep(random.uniform(0, policy.cap_ms(attempt)) / 1000)
    raise ValueError("a policy needs one attempt at least")
