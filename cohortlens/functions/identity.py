"""Stable identifiers: SHA-256 over key-sorted compact JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import constants as C

_KEEP_NULLS = {"ignoreNullFields": "false"}


def json_object(**fields: Column) -> Column:
    """Compact JSON object with its keys in sorted order and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), _KEEP_NULLS)


def digest(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(text, 256))


def _vehicle(make: Column, model: Column, year: Column, generation: Column | None) -> dict[str, Column]:
    if generation is None:
        generation = F.lit(None).cast("string")
    return {"generation": generation, "make": make, "model": model, "year": year}


def association_id(make: Column, model: Column, year: Column, generation: Column | None = None) -> Column:
    return digest("vehicle_association_", json_object(**_vehicle(make, model, year, generation)))


def vehicle_id(make: Column, model: Column, year: Column, generation: Column | None = None) -> Column:
    return digest("vehicle_", json_object(**_vehicle(make, model, year, generation)))


def configuration_id(
    make: Column,
    model: Column,
    year: Column,
    transmission: Column,
    drivetrain: Column,
    generation: Column | None = None,
    trim: Column | None = None,
    engine: Column | None = None,
) -> Column:
    absent = F.lit(None).cast("string")
    fields = _vehicle(make, model, year, generation)
    fields |= {
        "trim": absent if trim is None else trim,
        "engine": absent if engine is None else engine,
        "transmission": transmission,
        "drivetrain": drivetrain,
    }
    return digest("configuration_", json_object(**fields))


def is_configuration_id(value: Column) -> Column:
    return value.rlike("\\Aconfiguration_[0-9a-f]{64}\\z")


def event_id(
    record: Column,
    *,
    dataset: str = C.EVENT_DATASET,
    organization: str = C.EVENT_ORGANIZATION,
    source_type: str = C.EVENT_SOURCE_TYPE,
) -> Column:
    return digest(
        "event_",
        json_object(
            dataset=F.lit(dataset),
            organization=F.lit(organization),
            source_record_id=record,
            source_type=F.lit(source_type),
        ),
    )


def application_id(prefix: str, *parts: Column) -> Column:
    """Identifier of one document-to-product relation, over a JSON array."""
    return digest(f"{prefix}_app_", F.to_json(F.array(*parts)))


def filing_id(fields: dict[str, Column], prefix: str = C.FILING_PREFIX) -> Column:
    """Identifier of one production row over all its fields.

    The text is UTF-8 JSON; labels outside ASCII are not escaped.
    """
    return digest(f"{prefix}_", json_object(**fields))
