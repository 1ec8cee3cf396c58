"""Templates in names and SQL: {{ variable }} and {{ helper argument ... }}. Unknown names are errors that list what there is."""

from __future__ import annotations

import datetime
import re
import time
from collections.abc import Mapping
from typing import Any


class TemplateError(ValueError):
    """A template that can't be rendered."""


def shouty(text: str) -> str:
    """SCREAMING_SNAKE_CASE: words end at separators, before a capital after a small letter, and before the last capital of a run."""
    words = re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W_A-Z]+|[A-Z]+", text)
    return "_".join(w.upper() for w in words)


#: What a template may call.
HELPERS = {
    "now_timestamp": lambda: int(time.time()),
    "now_timestamp_ms": lambda: time.time_ns() // 1_000_000,
    "pad": lambda value, width: f"{int(value):0{int(width)}d}",
    "shoutySnakeCase": shouty,
    "schema_of": lambda s: s.partition(".")[0] if "." in s else "",
    "table_of": lambda s: s.partition(".")[2] if "." in s else s,
    "ensure_trailing": lambda s: s if s.endswith("/") else f"{s}/",
}

_PLACE = re.compile(r"\{\{\s*(.*?)\s*\}\}", re.DOTALL)
_WORD = re.compile(r"""\s*("[^"]*"|'[^']*'|-?\d+(?![\w.])|[A-Za-z_][\w.]*)""")


def render(template: str, context: Mapping[str, Any]) -> str:
    def fail(what: str) -> TemplateError:
        return TemplateError(f"{what} in {template!r}; variables: {', '.join(sorted(context))}; helpers: {', '.join(HELPERS)}")

    def value(word: str) -> Any:
        if word[0] in "\"'":
            return word[1:-1]
        if word.lstrip("-").isdigit():
            return int(word)
        if word not in context:
            raise fail(f"unknown name {word!r}")
        return context[word]

    def place(m: re.Match) -> str:
        words, at = [], 0
        while at < len(m[1]):
            if (w := _WORD.match(m[1], at)) is None:
                raise fail(f"can't read {m[1]!r}")
            words.append(w[1])
            at = w.end()
        if not words:
            raise fail("nothing to put")
        if words[0] in HELPERS and words[0] not in context:
            try:
                return str(HELPERS[words[0]](*map(value, words[1:])))
            except (TypeError, ValueError, AttributeError) as e:
                if isinstance(e, TemplateError):
                    raise
                raise fail(f"{words[0]}: {e}") from None
        if len(words) > 1:
            raise fail(f"unknown helper {words[0]!r}")
        return str(value(words[0]))

    return _PLACE.sub(place, template)


def context(name: str, variables: Mapping[str, str], **more: Any) -> dict[str, Any]:
    """What templates of a table see: variables for all tables, over them those for this one (prefixed with its name), its name, and the clock."""
    prefix = f"{shouty(name)}_"
    own = {k.lower(): v for k, v in variables.items() if not k.startswith(prefix)}
    own |= {k[len(prefix) :].lower(): v for k, v in variables.items() if k.startswith(prefix)}
    now = datetime.datetime.now(datetime.UTC)
    clock = {"YYYY": "%Y", "MM": "%m", "DD": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}
    return own | {"name": name, "rfc3339": now.strftime("%Y-%m-%dT%H:%M:%SZ"), "ms": f"{now.microsecond // 1000:03d}"} | {k: now.strftime(f) for k, f in clock.items()} | more
