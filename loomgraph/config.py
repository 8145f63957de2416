"""Layered settings (files, then environment) and the storage profile."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

PREFIX = "LOOMGRAPH_"


def load(folder: str = "config", environ: dict[str, str] | None = None) -> dict:
    """default.json, then <RUN_MODE>.json if there, then LOOMGRAPH_SECTION__KEY variables; later ones win."""
    environ = dict(os.environ) if environ is None else environ
    out: dict = json.loads(Path(folder, "default.json").read_text())
    mode = Path(folder, f"{environ.get('RUN_MODE', 'development')}.json")
    layers = [json.loads(mode.read_text())] if mode.exists() else []
    for name, value in sorted(environ.items()):
        if name.startswith(PREFIX):
            *sections, key = name.removeprefix(PREFIX).lower().split("__")
            layer: dict = {key: value}
            for s in reversed(sections):
                layer = {s: layer}
            layers.append(layer)

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    for layer in layers:
        out = merge(out, layer)
    return out


@dataclass(frozen=True)
class StorageProfile:
    """Tiers asked for; `resolved` says what is to be had. Spark's own storage levels decide where cached data lives."""

    hot: str = "cpu_memory"
    cold: str = "nvme"
    zero_copy: str = "disabled"
    gpu_runtime: str = "disabled"
    vram_budget: int | None = None

    def resolved(self) -> tuple[str, str, str | None]:
        """(hot tier, zero copy, why it fell back)."""
        if self.hot == "gpu_vram" and self.gpu_runtime == "disabled":
            return "cpu_memory", "disabled", "GPU runtime is disabled; falling back to CPU memory"
        direct = self.zero_copy == "gpu_direct" and self.hot != "gpu_vram"
        return self.hot, "disabled" if direct else self.zero_copy, None
