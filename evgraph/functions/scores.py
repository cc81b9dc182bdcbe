"""Shares, bands, percentages and guarded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Percent done by stage.
PROGRESS = {
    "Validation": 5, "RepositoryAcquisition": 15, "FileScanning": 30, "LanguageDetection": 40, "ProjectDetection": 50, "StaticAnalysis": 65,
    "DependencyAnalysis": 75, "ApiAnalysis": 80, "DatabaseAnalysis": 85, "EvidenceGeneration": 90, "Persistence": 95, "Completed": 100,
}
SUPPORTED = {"c#": "Full", "csharp": "Full", "cs": "Full", "typescript": "Full", "ts": "Full", "javascript": "Partial", "js": "Partial"}


def confidence(value: Column) -> Column:
    """A score in [0, 1]; anything else is an error."""
    return F.when((value >= 0) & (value <= 1) & ~F.isnan(value), value).otherwise(F.raise_error(F.concat(F.lit("confidence out of range: "), value.cast("string"))).cast("double"))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def share(part: Column, whole: Column, places: int = 2) -> Column:
    """Percent, rounded half to even."""
    return F.bround(100.0 * part / whole, places)


def band(value: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    return F.when(value.isNull(), "Zero").when(value >= high, "High").when(value >= medium, "Medium").otherwise("Low")


def progress(stage: Column, failed: Column) -> Column:
    out = F.lit(10)
    for name, percent in PROGRESS.items():
        out = F.when(stage == name, percent).otherwise(out)
    return F.when(failed, 0).otherwise(out)


def support(language: Column) -> Column:
    out = F.lit("Unsupported")
    for name, label in SUPPORTED.items():
        out = F.when(F.lower(language) == name, label).otherwise(out)
    return out


def percent_text(value: Column) -> Column:
    return F.concat(F.bround(100 * value, 0).cast("int").cast("string"), F.lit("%"))
