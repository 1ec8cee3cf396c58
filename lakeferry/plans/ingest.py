"""Files taken in by a Python hook: a pattern names the parts of a file's path, a module found by them says which statements to run."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from lakeferry.functions.paths import PathPattern
from lakeferry.plans.runner import captured


class IngestError(RuntimeError):
    """A hook that isn't there, or that asks for what can't be done."""


@dataclass(frozen=True)
class Plan:
    """What a hook returns: statements before, the load itself, statements after."""

    sql: Sequence[str]
    pre_sql: Sequence[str] = field(default_factory=tuple)
    post_sql: Sequence[str] = field(default_factory=tuple)


def module_paths(pattern: PathPattern, base: str) -> list[str]:
    """Where a pattern's module may be, the first there counts: in a folder for each segment, in a file named by the last one, or in one
    file named by all of them. Segments are named by their names and literals; * and what follows name nothing."""
    names = []
    for parts in pattern.groups:
        if parts == [("star", "*")]:
            break
        if own := "".join(v for k, v in parts if k in ("name", "text")):
            names.append(own)
    paths = [os.path.join(base, *names, "__init__.py")]
    if names:
        paths += [os.path.join(base, *names) + ".py", os.path.join(base, "_".join(names) + ".py")]
    return paths


def find_hook(paths: Sequence[str], name: str = "process") -> Callable[..., Any]:
    """The function of that name in the first module that has it."""
    for path in paths:
        if not os.path.exists(path):
            continue
        spec = importlib.util.spec_from_file_location(f"lakeferry_hook_{abs(hash(path))}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        if callable(found := getattr(module, name, None)):
            return found
    raise IngestError(f"no function {name} in any of {', '.join(paths)}")


def url_data(url: str) -> dict[str, str | None]:
    """A URL's parts, as hooks see them."""
    p = urlsplit(url)
    name = p.path.rpartition("/")[2] or None
    stem, dot, ext = (name or "").rpartition(".")
    base, first, rest = (name or "").partition(".")
    return {
        "full_url": url, "scheme": p.scheme, "host": p.hostname, "path": p.path, "filename": name, "file_stem": (stem if dot and stem else name), "extension": ext if dot and stem else None,
        "base_name": base if first else None, "full_extension": rest if first else None, "query": p.query or None, "fragment": p.fragment or None,
    }


def storage_data(url: str) -> dict[str, str]:
    """Which store holds a file: account, container and path of a blob store, else the URL and its path."""
    p = urlsplit(url)
    host, path = p.hostname or "", p.path.lstrip("/")
    if p.scheme in ("az", "azure", "abfs", "abfss", "adl") or host.endswith((".blob.core.windows.net", ".dfs.core.windows.net")):
        if "@" in p.netloc:  # container@account
            return {"type": "azure", "storage_account": host.partition(".")[0], "container": p.netloc.partition("@")[0], "path": path}
        container, _, rest = path.partition("/")
        return {"type": "azure", "storage_account": host.partition(".")[0], "container": container, "path": rest}
    return {"type": "local", "url": url, "path": p.path}


def ingest(spark: SparkSession, url: str, pattern: str, base: str, context: dict[str, Any] | None = None) -> list[dict[str, Any]]:
    """Run what the hook for this file says; the first rows of each statement's result."""
    own = PathPattern(pattern)
    parts = own.parse(storage_data(url)["path"])
    plan = find_hook(module_paths(own, base))(url_data(url), storage_data(url), parts, None, context or {})
    if not isinstance(plan, Plan) or not plan.sql:
        raise IngestError("a hook returns a Plan with statements")
    return captured(spark, [*plan.pre_sql, *plan.sql, *plan.post_sql])
