"""Layered settings: machine, then shared, then local, field by field; some sections only from some layers."""

from __future__ import annotations

from typing import Any

LAYERS = ("machine", "shared", "local")
#: Sections that name what a machine runs or knows are not taken from a shared file.
REFUSED: dict[str, tuple[str, ...]] = {"shared": ("endpoints", "keys")}


def merged(layers: dict[str, dict[str, Any]]) -> dict[str, Any]:
    def over(low: dict, high: dict) -> dict:
        out = dict(low)
        for k, v in high.items():
            out[k] = over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
        return out

    result: dict[str, Any] = {}
    for name in LAYERS:
        own = layers.get(name) or {}
        bad = [s for s in REFUSED.get(name, ()) if s in own]
        if bad:
            raise ValueError(f"{', '.join(bad)} may not be set in the {name} layer")
        result = over(result, own)
    return result
