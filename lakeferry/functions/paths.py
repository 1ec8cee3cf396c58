"""Paths and URLs: patterns that name parts of a path, URL parts, and joining of locations."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    """A pattern that can't be read, or a path that doesn't fit one."""


_TOKEN = re.compile(r"\{(?P<name>\w+)\}|(?P<star>\*)|(?P<text>[^/{}*]+)")


@dataclass(frozen=True)
class PathPattern:
    """{name} names a part, {_} passes over one, * takes all that follow, anything else must be there as it is.

    Within one segment a named part ends at the next literal, or takes the rest. Segments of the path beyond the pattern
    are passed over.
    """

    pattern: str

    @cached_property
    def groups(self) -> list[list[tuple[str, str]]]:
        """For each segment its parts: (name|skip|star|text, value)."""
        out = []
        for segment in self.pattern.lstrip("/").split("/"):
            parts, at = [], 0
            for m in _TOKEN.finditer(segment):
                if m.start() != at:
                    break
                at = m.end()
                parts.append(("skip", "") if m["name"] == "_" else (m.lastgroup, m[m.lastgroup]))
            if at != len(segment) or not parts:
                raise PatternError(f"can't read {segment!r} in pattern {self.pattern!r}")
            out.append(parts)
        return out

    @cached_property
    def names(self) -> list[str]:
        return [v for g in self.groups for k, v in g if k == "name"]

    @cached_property
    def regex(self) -> str:
        """A regular expression, of Java's and Python's common part, with a group for each name."""
        out = []
        for parts in self.groups:
            if parts == [("star", "*")]:
                out.append("(?:/.*)?" if out else ".*")
                return f"^/?{''.join(out)}$"
            for (a, _), (b, _) in zip(parts, parts[1:], strict=False):
                if a == b == "name":
                    raise PatternError(f"names need a literal between them in {self.pattern!r}")
            own, literal = [], lambda k: parts[k + 1][1] if k + 1 < len(parts) and parts[k + 1][0] == "text" else None  # noqa: B023
            for k, (kind, value) in enumerate(parts):
                if kind == "text":
                    own.append(re.escape(value))
                elif kind == "name":
                    # Up to the first place where the literal that follows stands.
                    own.append(f"((?:(?!{re.escape(end)})[^/])*)" if (end := literal(k)) else "([^/]+)" if len(parts) == 1 else "([^/]*)")
                elif len(parts) == 1:
                    own.append("[^/]+")
            out.append(("/" if out else "") + "".join(own))
        return f"^/?{''.join(out)}(?:/.*)?$"

    def parse(self, path: str) -> dict[str, str]:
        m = re.match(self.regex, path, re.DOTALL)
        if m is None:
            raise PatternError(f"{path!r} doesn't fit {self.pattern!r}")
        return dict(zip(self.names, m.groups(), strict=True))

    def extract(self, path: Column) -> Column:
        """A struct of the named parts of a column of paths; fields are null where a path doesn't fit."""
        fits = path.rlike(self.regex)
        return F.struct(*(F.when(fits, F.regexp_extract(path, self.regex, k + 1)).alias(n) for k, n in enumerate(self.names)))


def url_parts(url: Column) -> Column:
    """A struct of a URL's scheme, host, path, and of its last segment the filename, stem, extension and base name.

    stem: up to the last dot; base_name: up to the first one; full_extension: all behind the first dot.
    """
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.struct(
        F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1).alias("scheme"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("host"),
        path.alias("path"),
        name.alias("filename"),
        F.regexp_extract(name, r"^(.+?)(?:\.[^.]*)?$", 1).alias("stem"),
        F.regexp_extract(name, r"^[^.]+\.([^.]+)$|\.([^.]+)$", 0).alias("extension"),
        F.regexp_extract(name, r"^([^.]*)", 1).alias("base_name"),
        F.regexp_extract(name, r"^[^.]*\.(.*)$", 1).alias("full_extension"),
    )


def resolve_url(url: str, base: str | None = None) -> str:
    """An absolute location: with a scheme as it is, an absolute path as a file, a relative one below base, or the working directory."""
    if url.startswith("file://") and not url.startswith("file:///"):
        return "file://" + os.path.abspath(url[len("file://") :])  # file://relative, an old form
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+://", url):
        return url
    if os.path.isabs(url):
        return f"file://{url}"
    return join_url(base, url) if base else "file://" + os.path.abspath(url)


def join_url(base: str, relative: str) -> str:
    """base and relative with one slash between them; empty segments of relative go."""
    return base.rstrip("/") + "/" + "/".join(p for p in relative.split("/") if p)


def local_path(url: str) -> str | None:
    """The path of a local file's URL, or None for another store."""
    parts = urlsplit(url)
    return parts.path if parts.scheme in ("file", "") else None
