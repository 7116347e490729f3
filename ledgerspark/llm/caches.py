"""What a Python worker keeps between tasks.

Spark reuses workers, and what a module holds in them lives as long as they do. Only one operator's vocabularies and word caches are kept
at a time: the first task of another operator drops them, so a worker never holds the sum of what several stages remember.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_kept: dict[Any, Any] = {}
_owner: list[str] = [""]


def worker_cache(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once per key while this owner alone uses the worker."""
    if _owner[0] != owner:
        _kept.clear()
        _owner[0] = owner
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
