"""Names of periodic notes (survey S20, X13-X15): driver-side date formatting."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta

#: The default formats of the five kinds.
DEFAULT_FORMATS = {"daily": "YYYY-MM-DD", "weekly": "YYYY-[W]ww", "monthly": "YYYY-MM", "quarterly": "YYYY-[Q]Q", "yearly": "YYYY"}
ALIASES = {
    "today": ("daily", 0), "yesterday": ("daily", -1), "tomorrow": ("daily", 1), "daily": ("daily", 0), "weekly": ("weekly", 0), "this week": ("weekly", 0), "this-week": ("weekly", 0),
    "monthly": ("monthly", 0), "this month": ("monthly", 0), "this-month": ("monthly", 0), "quarterly": ("quarterly", 0), "yearly": ("yearly", 0), "this year": ("yearly", 0), "this-year": ("yearly", 0),
}


def ordinal(n: int) -> str:
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


_PARTS = {
    "YYYY": lambda d: f"{d.year:04d}", "YY": lambda d: f"{d.year % 100:02d}", "GGGG": lambda d: f"{d.isocalendar()[0]:04d}", "gggg": lambda d: f"{d.isocalendar()[0]:04d}", "GG": lambda d: f"{d.isocalendar()[0] % 100:02d}",
    "MMMM": lambda d: d.strftime("%B"), "MMM": lambda d: d.strftime("%b"), "MM": lambda d: f"{d.month:02d}", "Mo": lambda d: ordinal(d.month), "M": lambda d: str(d.month),
    "DDDD": lambda d: f"{d.timetuple().tm_yday:03d}", "DDD": lambda d: str(d.timetuple().tm_yday), "DD": lambda d: f"{d.day:02d}", "Do": lambda d: ordinal(d.day), "D": lambda d: str(d.day),
    "dddd": lambda d: d.strftime("%A"), "ddd": lambda d: d.strftime("%a"), "E": lambda d: str(d.isoweekday()), "d": lambda d: str(d.isoweekday() % 7),
    "WW": lambda d: f"{d.isocalendar()[1]:02d}", "Wo": lambda d: ordinal(d.isocalendar()[1]), "W": lambda d: str(d.isocalendar()[1]), "ww": lambda d: f"{d.isocalendar()[1]:02d}", "wo": lambda d: ordinal(d.isocalendar()[1]), "w": lambda d: str(d.isocalendar()[1]),
    "Qo": lambda d: ordinal((d.month + 2) // 3), "Q": lambda d: str((d.month + 2) // 3),
    "HH": lambda d: f"{d.hour:02d}", "H": lambda d: str(d.hour), "hh": lambda d: f"{(d.hour + 11) % 12 + 1:02d}", "h": lambda d: str((d.hour + 11) % 12 + 1), "mm": lambda d: f"{d.minute:02d}", "m": lambda d: str(d.minute), "ss": lambda d: f"{d.second:02d}", "s": lambda d: str(d.second), "A": lambda d: "AM" if d.hour < 12 else "PM", "a": lambda d: "am" if d.hour < 12 else "pm",
}
_SCAN = re.compile(r"\[([^\]]*)(?:\]|$)|" + "|".join(sorted(map(re.escape, _PARTS), key=len, reverse=True)))


def format_date(pattern: str, when: datetime) -> str:
    """``[literal]`` text passes through; the longest known token wins; other characters stay."""
    return _SCAN.sub(lambda m: m[1] if m[0].startswith("[") else _PARTS[m[0]](when), pattern)


def load_config(daily_json: str | None = None, periodic_json: str | None = None) -> dict[str, dict[str, str]]:
    """Formats and folders from the two settings texts; a missing or malformed one counts as absent."""
    out = {k: {"format": f, "folder": ""} for k, f in DEFAULT_FORMATS.items()}

    def parsed(text: str | None) -> dict:
        try:
            got = json.loads(text or "{}")
        except ValueError:
            return {}
        return got if isinstance(got, dict) else {}

    for kind, spec in [("daily", parsed(daily_json)), *((k, parsed(periodic_json).get(k)) for k in DEFAULT_FORMATS)]:
        if isinstance(spec, dict):
            if isinstance(spec.get("format"), str) and spec["format"]:
                out[kind]["format"] = spec["format"]
            if isinstance(spec.get("folder"), str):
                out[kind]["folder"] = spec["folder"].strip("/")
    return out


def resolve_alias(alias: str, now: datetime, config: dict[str, dict[str, str]] | None = None) -> tuple[str, str] | None:
    """(kind, path without suffix) of an alias such as ``today``; null if it is none."""
    found = ALIASES.get(alias.strip().lower())
    if not found:
        return None
    kind, days = found
    spec = (config or load_config())[kind]
    name = format_date(spec["format"], now + timedelta(days=days))
    return kind, f"{spec['folder']}/{name}" if spec["folder"] else name
