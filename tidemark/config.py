"""Run configuration: defaults, deep merge, validation, flat parameters."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

#: The defaults a run starts from.
DEFAULTS: dict[str, Any] = {
    "io": {"sampling_rate": 1.0},
    "heatmap": {"lower": -1e20, "upper": 1e16, "binarize": False, "origin": "lower", "cmap": "hot", "dpi": 180},
    "detrend": {"degree": 1, "max_trials": 100, "min_samples": 0.5, "random_state": 42},
    "peaks": {"prominence": 1.0, "width": 1.0, "distance": None, "adaptive": False, "minimum_per_track": 1},
    "period": {"min_freq": None, "max_freq": None},
    "features": {"fit_window_period_frac": 0.5, "classify": {"ripple_max_deg": 10.0, "surf_min_deg": 20.0, "prominence_min_px": 1.0}},
    "overlay": {"max_points": 300},
    "kymo": {
        "backend": "onnx", "track_xy_order": "auto",
        "morphology": {"mode": "directional", "directional": {"kv": 5, "kh": 5, "diag_bridge": True}, "classic": {"kernel": 3}},
        "tracking": {"max_branch_steps": 256, "decision_recent_tail": 16},
    },
    "service": {"resume": {"enabled": True}, "db_batch_size": 50, "emit_overlay_every_tracks": 1, "progress_every_secs": 2.0},
}
PERIOD_KEYS = {"sampling_rate", "min_freq", "max_freq"}


def deep_merge(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """base with over on top: mappings are merged key by key, anything else is replaced."""
    out = deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def effective(over: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with a run's own settings. The flat spelling of the morphology settings is accepted beside the nested one."""
    cfg = deep_merge(DEFAULTS, over)
    flat = (over or {}).get("kymo", {}).get("morphology", {})
    nested = cfg["kymo"]["morphology"]
    for short, (part, key) in {"dir_kv": ("directional", "kv"), "dir_kh": ("directional", "kh"), "diag_bridge": ("directional", "diag_bridge"), "classic_kernel": ("classic", "kernel")}.items():
        if short in flat:
            nested[part][key] = flat[short]
            nested.pop(short, None)
    return cfg


def validate(cfg: Any) -> dict[str, Any]:
    """The mapping, or ValueError: not a mapping, or unknown keys under period."""
    if not isinstance(cfg, dict):
        raise ValueError("a configuration is a mapping")
    unknown = set(cfg.get("period") or {}) - PERIOD_KEYS
    if unknown:
        raise ValueError(f"unknown keys under period: {sorted(unknown)}")
    return cfg


def axis_order(cfg: dict[str, Any]) -> str:
    """'yx' or 'xy': how the columns of a track file are read."""
    kymo = cfg.get("kymo", {})
    order = str(kymo.get("track_xy_order", "auto")).lower()
    return order if order != "auto" else ("yx" if str(kymo.get("backend", "onnx")).lower() == "onnx" else "xy")


def providers(value: str | list[str] | None) -> list[str] | None:
    """A list of names from None, a list, or a comma-separated string."""
    if value is None:
        return None
    parts = value.split(",") if isinstance(value, str) else value
    return [p.strip() for p in parts if str(p).strip()] or None
