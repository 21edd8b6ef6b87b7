"""Options: defaults in dataclasses, overridden by a mapping (a file), then by ``a.b=value`` (a command line)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import fields, is_dataclass


def merged(options, file: dict | None = None, line: Sequence[str] = ()):
    """``options`` with the values of ``file`` and then of ``line``; afterwards every ``post_init`` runs, the outer one last. Raises KeyError for an unknown name."""
    _put(options, file or {})
    for item in line:
        path, _, raw = item.partition("=")
        *outer, last = path.split(".")
        try:
            value = json.loads(raw)
        except json.JSONDecodeError:
            value = raw
        for name in reversed([*outer, last]):
            value = {name: value}
        _put(options, value)
    _finish(options)
    return options


def _put(options, values: dict) -> None:
    known = {f.name for f in fields(options)}
    for name, value in values.items():
        if name not in known:
            raise KeyError(f"unknown option {name!r}")
        if is_dataclass(getattr(options, name)) and isinstance(value, dict):
            _put(getattr(options, name), value)
        else:
            setattr(options, name, value)


def _finish(options) -> None:
    for f in fields(options):
        if is_dataclass(getattr(options, f.name)):
            _finish(getattr(options, f.name))
    if hasattr(options, "post_init"):
        options.post_init()
