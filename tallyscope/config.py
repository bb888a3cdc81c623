"""Analysis modes and presets: fixed values, and dimension tables that operators join.

The values of ``BASE``, ``MODES`` and ``PRESETS`` are fixed ones that results depend on. The
weights here combine the methods of a configured run; ``constants.METHOD_WEIGHTS`` are those of
the unnormalised session score, and differ (reinforcement learning 0.15 here, 0.30 there).
"""

from __future__ import annotations

from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession

from tallyscope.constants import CONTAMINATION
from tallyscope.functions.chi2 import critical_value

BASE = {
    "benford": {"significance": 0.05, "minimum_sample": 30, "round_number": 0.35, "preference": 0.20},
    "zipf": {"minimum_word_length": 3, "remove_stopwords": False, "top_words": 100, "deviation": 0.5},
    "risk": {"low": 0.3, "medium": 0.6, "high": 0.8, "critical": 0.9, "minimum_confidence": 0.7},
    "weights": {"benford": 0.25, "zipf": 0.15, "isolation_forest": 0.20, "pyod_ensemble": 0.25, "reinforcement_learning": 0.15},
    "quality": {"minimum_sample": 30, "maximum_missing": 20.0, "maximum_duplicates": 5.0, "maximum_outliers": 10.0},
    "detectors": {"methods": ["isolation_forest", "lof", "ocsvm"], "trees": 100, "neighbours": 20, "percentile": 90.0},
}
MODES = {
    "standard": {},
    "custom": {},
    "conservative": {
        "risk": {"low": 0.2, "medium": 0.5, "high": 0.75, "critical": 0.85},
        "benford": {"significance": 0.01, "minimum_sample": 50},
        "quality": {"minimum_sample": 50, "maximum_missing": 10.0},
    },
    "aggressive": {
        "risk": {"low": 0.4, "medium": 0.65, "high": 0.85, "critical": 0.95},
        "benford": {"significance": 0.10, "minimum_sample": 20, "round_number": 0.30, "preference": 0.15},
    },
}
PRESETS = {
    "financial_audit_standard": ("standard", {"benford": {"minimum_sample": 50}, "weights": {"benford": 0.30}}),
    "fraud_investigation": ("aggressive", {"weights": {"reinforcement_learning": 0.25}}),
    "compliance_review": ("conservative", {"quality": {"maximum_missing": 5.0}, "risk": {"minimum_confidence": 0.8}}),
    "high_volume_processing": ("standard", {"detectors": {"trees": 50}}),
    "research_analysis": (
        "standard",
        {"zipf": {"remove_stopwords": True, "top_words": 200}, "detectors": {"methods": ["isolation_forest", "lof", "ocsvm", "knn"]}},
    ),
}


def _merged(base: dict, *changes: dict) -> dict:
    out = deepcopy(base)
    for change in changes:
        for section, values in change.items():
            out[section].update(values)
    return out


def for_mode(mode: str = "standard", **changes: dict) -> dict:
    """Configuration of a mode; ``changes`` override single values by section."""
    return _merged(BASE, MODES[mode], changes) | {"mode": mode}


def preset(name: str) -> dict:
    mode, changes = PRESETS[name]
    return for_mode(mode, **changes)


def contamination(mode: str = "standard", sensitivity: str = "standard") -> float:
    """Contamination rate; an unknown sensitivity falls back to standard."""
    low, middle, high = CONTAMINATION[mode]
    return {"conservative": low, "aggressive": high}.get(sensitivity, middle)


def mode_dimension(spark: SparkSession) -> DataFrame:
    """Risk thresholds by mode, four rows."""
    rows = [(m, *[float(for_mode(m)["risk"][k]) for k in ("low", "medium", "high", "critical")]) for m in MODES]
    return spark.createDataFrame(rows, "mode string, low double, medium double, high double, critical double")


def digit_dimension(spark: SparkSession, dof: int = 8) -> DataFrame:
    """What a digit test needs by mode, four rows: critical value at the mode's significance, least sample."""
    rows = []
    for m in MODES:
        settings = for_mode(m)["benford"]
        rows.append((m, critical_value(dof, 1 - settings["significance"]), settings["minimum_sample"]))
    return spark.createDataFrame(rows, "mode string, mode_critical double, minimum_sample int")


def preset_dimension(spark: SparkSession, section: str) -> DataFrame:
    """``(preset, mode, values of the section)``, one row for each preset."""
    rows = [{"preset": name, "mode": preset(name)["mode"]} | preset(name)[section] for name in PRESETS]
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))


def preset_weights(spark: SparkSession) -> DataFrame:
    """``(preset, method, weight)``."""
    return spark.createDataFrame([(name, m, float(w)) for name in PRESETS for m, w in preset(name)["weights"].items()], "preset string, method string, weight double")


def preset_digits(spark: SparkSession, dof: int = 8) -> DataFrame:
    """What a digit test needs by preset: critical value at its significance, least sample."""
    found = [(name, preset(name)["benford"]) for name in PRESETS]
    rows = [(name, critical_value(dof, 1 - x["significance"]), x["minimum_sample"]) for name, x in found]
    return spark.createDataFrame(rows, "preset string, mode_critical double, minimum_sample int")
