"""Settings: layered dictionaries, dotted access."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any


def deep_merge(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers win; dictionaries merge key by key, everything else is replaced."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def flatten(tree: Mapping[str, Any], head: str = "") -> Iterator[tuple[str, Any]]:
    for k, v in tree.items():
        if isinstance(v, Mapping):
            yield from flatten(v, f"{head}{k}.")
        else:
            yield f"{head}{k}", v


class Config:
    """Merged settings with dotted get; paths stay under the root."""

    def __init__(self, *layers: Mapping[str, Any], root: str = "."):
        self.values, self.root = deep_merge(*layers), Path(root).resolve()

    @classmethod
    def load(cls, *files: str, defaults: Mapping[str, Any] | None = None, root: str = ".") -> Config:
        import yaml

        layers = [yaml.safe_load(Path(f).read_text()) or {} for f in files if Path(f).exists()]
        return cls(defaults or {}, *layers, root=root)

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def path(self, key: str, default: str = ".") -> Path:
        p = (self.root / str(self.get(key, default))).resolve()
        if not p.is_relative_to(self.root):
            raise ValueError(f"{key} leaves the project root")
        return p
