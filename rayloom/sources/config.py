"""Configuration files: a section per job, paths with placeholders."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def filled(value: Any, values: Mapping[str, str]) -> Any:
    """``value`` with ``{name}`` replaced in every string of it; lists stay lists and maps stay maps."""
    if isinstance(value, str):
        for name, text in values.items():
            value = value.replace("{" + name + "}", text)
        return value
    if isinstance(value, Mapping):
        return {k: filled(v, values) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [filled(v, values) for v in value]
    return value


def section(path: str, name: str, values: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The section ``name`` of a YAML file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return filled(yaml.safe_load(f)[name], values or {})
