"""What callers send, checked and cleaned before it becomes a plan; settings from an environment; numbers as text."""

from __future__ import annotations

import html
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from ..operators.reviews import ReviewFilter

#: The least and the most that a parameter may be.
RANGES = {"limit": (1, 100), "offset": (0, None), "min_rating": (0, 1), "max_rating": (0, 1), "max_rows": (1, 1_000_000), "n_results": (1, 20), "chat_results": (1, 10)}
YES = ("1", "true", "yes", "on")


def compact(params: Mapping[str, Any]) -> dict[str, Any]:
    """Without what asks for nothing: null, '', 'all' and empty lists."""
    return {k: v for k, v in params.items() if v is not None and not (isinstance(v, str) and v in ("", "all")) and not (isinstance(v, (list, tuple)) and not v)}


def checked(**params: Any) -> dict[str, Any]:
    """The parameters, if each lies in its range."""
    for name, value in params.items():
        low, high = RANGES.get(name, (None, None))
        if value is not None and ((low is not None and value < low) or (high is not None and value > high)):
            raise ValueError(f"{name} is {low} to {high}" if high is not None else f"{name} is at least {low}")
    return params


def date(value: str | None) -> datetime | None:
    """An ISO date or time, UTC without an offset; None where it can't be read."""
    try:
        found = datetime.fromisoformat(value.strip().replace("Z", "+00:00")) if value else None
    except ValueError:
        return None
    return found.replace(tzinfo=timezone.utc) if found and found.tzinfo is None else found


def review_filter(**params: Any) -> ReviewFilter:
    """From query parameters: blank ones and dates that can't be read leave their condition out."""
    texts = {k: v.strip() for k in ("query", "source", "sentiment", "product", "category") if isinstance(v := params.get(k), str) and v.strip()}
    numbers = checked(min_rating=params.get("min_rating"), max_rating=params.get("max_rating"))
    return ReviewFilter(**texts, **numbers, date_start=date(params.get("date_start")), date_end=date(params.get("date_end")))


def flag(env: Mapping[str, str], name: str, default: bool) -> bool:
    text = env.get(name, "").strip().lower()
    return text in YES if text else default


def whole(env: Mapping[str, str], name: str, default: int) -> int:
    try:
        return int(env.get(name, "").strip())
    except ValueError:
        return default


def decimal(env: Mapping[str, str], name: str, default: float) -> float:
    try:
        return float(env.get(name, "").strip())
    except ValueError:
        return default


def items(env: Mapping[str, str], name: str) -> tuple[str, ...]:
    """Parts between commas and line ends, blank ones left out."""
    return tuple(p for p in (part.strip() for part in env.get(name, "").replace("\n", ",").split(",")) if p)


def escaped(value: Any) -> str:
    return html.escape(str(value or ""), quote=True)


def count_text(value: Any) -> str:
    try:
        return f"{int(value):,}"
    except (TypeError, ValueError):
        return "0"


def percent_text(value: Any) -> str:
    try:
        return f"{float(value):.2%}"
    except (TypeError, ValueError):
        return "0.00%"
