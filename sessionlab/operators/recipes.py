"""Checks of a detection recipe (a small configuration, not data)."""

import math
from numbers import Real

from ..schemas import BEHAVIOR_FEATURES

#: Least and most value of each number; None leaves that side open, and a least value marked open is not allowed itself.
RANGES = {
    "version": (1, None), "window_seconds": (30, 30), "tail_cutoff": ("open", 0, 0.05), "consecutive_windows": (1, 20), "minimum_attacks": (0, 10_000), "minimum_margin": (None, None),
    "validation.maximum_fpr_upper_95": ("open", 0, 0.05), "validation.minimum_recall": (0.5, 1),
    **{f"validation.minimum_{name}": ("open", 0, None) for name in ("human_players", "days", "network_conditions", "legit_hours")},
}
TEXTS = ("name", "mechanism", "source")
CHOICES = {"target": ("automation", "cheat"), "validation.require_same_client_control": (False, True)}


def _at(spec: dict, path: str):
    for key in path.split("."):
        spec = spec.get(key) if isinstance(spec, dict) else None
    return spec


def problems(spec: dict) -> list[str]:
    """What is wrong with a recipe, as `path: what is expected`."""
    found = []
    for path, bounds in RANGES.items():
        value, (least, most) = _at(spec, path), bounds[-2:]
        number = isinstance(value, Real) and not isinstance(value, bool) and math.isfinite(value)
        if not number or least is not None and (value < least or "open" in bounds and value == least) or most is not None and value > most:
            sign = ">" if "open" in bounds else ">="
            found.append(f"{path}: a number" + (f" {sign} {least}" if least is not None else "") + (f" <= {most}" if most is not None else ""))
    found += [f"{path}: one of {options}" for path, options in CHOICES.items() if _at(spec, path) not in options]
    found += [f"{path}: some text" for path in TEXTS if not _at(spec, path)]
    name = _at(spec, "id")
    if not (isinstance(name, str) and 3 <= len(name) <= 64 and name[0].isascii() and name[0].islower() and all(c.isascii() and (c.islower() or c.isdigit() or c in "._-") for c in name)):
        found.append("id: 3 to 64 lower-case letters, digits, dots, bars, a letter first")
    features = _at(spec, "features") or []
    if not features or len({*features}) < len(features) or {*features} - {*BEHAVIOR_FEATURES}:
        found.append("features: different registered ones, one at least")
    return found


def validate_recipe(spec: dict) -> dict:
    """The recipe itself; ValueError names everything that is wrong with it."""
    if found := problems(spec):
        raise ValueError("; ".join(found))
    return spec
