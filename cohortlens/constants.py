"""Names, orders and limits that every stage shares.

The tuples below are fixed values: they set column order and must stay equal to
the published contract, so they are written out in that order.
"""

from __future__ import annotations

# --- fixed values: enumerations -------------------------------------------------

COMPONENTS = (
    "engine",
    "transmission",
    "electrical",
    "cooling",
    "suspension",
    "brakes",
    "steering",
    "fuel_system",
    "hvac",
    "exhaust",
    "body",
    "airbags_restraints",
    "tires_wheels",
    "other",
    "unknown",
)
SEVERITIES = ("unknown", "low", "moderate", "high", "critical")
SEVERE = ("moderate", "high", "critical")
SELECTED_COMPONENTS = ("engine", "transmission", "electrical", "brakes", "steering")
EVIDENCE = ("crash", "fire", "injury", "death")
QUALITY_FLAGS = (
    "broad_other_component",
    "encoding_control_character",
    "extreme_mileage",
    "extreme_report_delay",
    "future_model_year",
    "missing_configuration_detail",
    "missing_mileage",
    "missing_narrative",
    "negative_report_delay",
    "oversized_narrative",
    "short_narrative",
    "zero_mileage",
)
RECALL_TYPES = ("VEHICLE", "EQUIPMENT", "CHILD_RESTRAINT", "TIRE", "OTHER")
RECALL_TYPE_CODES = {"V": "VEHICLE", "E": "EQUIPMENT", "C": "CHILD_RESTRAINT", "T": "TIRE"}
COMMUNICATION_TYPES = (
    "SERVICE_BULLETIN",
    "SERVICE_CAMPAIGN",
    "WARRANTY_PROGRAM",
    "OVER_THE_AIR",
    "EMISSIONS",
    "OTHER",
    "UNKNOWN",
)
COMMUNICATION_TYPE_NAMES = {
    "Service Bulletin/Repair Instructions": "SERVICE_BULLETIN",
    "Service Campaign": "SERVICE_CAMPAIGN",
    "Warranty Program/Extension": "WARRANTY_PROGRAM",
    "Over The Air": "OVER_THE_AIR",
    "Emissions": "EMISSIONS",
    "Other": "OTHER",
}
TRANSMISSION_ALIASES = {
    "automatic": "automatic",
    "auto": "automatic",
    "manual": "manual",
    "cvt": "cvt",
    "continuously variable transmission": "cvt",
    "dct": "dct",
    "dual clutch": "dct",
    "dual clutch transmission": "dct",
    "other": "other",
    "unknown": "unknown",
}
DRIVETRAIN_ALIASES = {
    "fwd": "fwd",
    "front wheel drive": "fwd",
    "rwd": "rwd",
    "rear wheel drive": "rwd",
    "awd": "awd",
    "all wheel drive": "awd",
    "4wd": "four_wd",
    "4x4": "four_wd",
    "four wheel drive": "four_wd",
    "other": "other",
    "unknown": "unknown",
}
# Component roots in match order; the first family with a matching root wins.
COMPONENT_ROOTS = (
    ("exhaust", ("ENGINE AND ENGINE COOLING:EXHAUST SYSTEM",)),
    ("cooling", ("ENGINE AND ENGINE COOLING:COOLING SYSTEM",)),
    (
        "transmission",
        (
            "POWER TRAIN:AUTOMATIC TRANSMISSION",
            "POWER TRAIN:MANUAL TRANSMISSION",
            "POWER TRAIN:CLUTCH ASSEMBLY",
        ),
    ),
    ("engine", ("ENGINE", "ENGINE AND ENGINE COOLING")),
    ("electrical", ("ELECTRICAL SYSTEM",)),
    ("suspension", ("SUSPENSION",)),
    ("brakes", ("SERVICE BRAKES", "SERVICE BRAKES, HYDRAULIC")),
    ("steering", ("STEERING",)),
    ("fuel_system", ("FUEL/PROPULSION SYSTEM", "FUEL SYSTEM, GASOLINE", "FUEL SYSTEM, DIESEL")),
    ("hvac", ("VISIBILITY:DEFROSTER/DEFOGGER/HVAC SYSTEM", "EQUIPMENT:APPLIANCE:AIR CONDITIONER")),
    ("body", ("STRUCTURE",)),
    ("airbags_restraints", ("AIR BAGS", "SEAT BELTS", "CHILD SEAT")),
    ("tires_wheels", ("TIRES", "WHEELS")),
)

# --- fixed values: source layouts -----------------------------------------------

COMPLAINT_COLUMNS = (
    "CMPLID", "ODINO", "MFR_NAME", "MAKETXT", "MODELTXT", "YEARTXT", "CRASH", "FAILDATE",
    "FIRE", "INJURED", "DEATHS", "COMPDESC", "CITY", "STATE", "VIN", "DATEA", "LDATE",
    "MILES", "OCCURENCES", "CDESCR", "CMPL_TYPE", "POLICE_RPT_YN", "PURCH_DT",
    "ORIG_OWNER_YN", "ANTI_BRAKES_YN", "CRUISE_CONT_YN", "NUM_CYLS", "DRIVE_TRAIN",
    "FUEL_SYS", "FUEL_TYPE", "TRANS_TYPE", "VEH_SPEED", "DOT", "TIRE_SIZE", "LOC_OF_TIRE",
    "TIRE_FAIL_TYPE", "ORIG_EQUIP_YN", "MANUF_DT", "SEAT_TYPE", "RESTRAINT_TYPE",
    "DEALER_NAME", "DEALER_TEL", "DEALER_CITY", "DEALER_STATE", "DEALER_ZIP", "PROD_TYPE",
    "REPAIRED_YN", "MEDICAL_ATTN", "VEHICLES_TOWED_YN", "STATE_OF_INCIDENT",
    "VEHICLE_OPERATOR",
)
RECALL_COLUMNS = (
    "RECORD_ID", "CAMPNO", "MAKETXT", "MODELTXT", "YEARTXT", "MFGCAMPNO", "COMPNAME",
    "MFGNAME", "BGMAN", "ENDMAN", "RCLTYPECD", "POTAFF", "ODATE", "INFLUENCED_BY", "MFGTXT",
    "RCDATE", "DATEA", "RPNO", "FMVSS", "DESC_DEFECT", "CONEQUENCE_DEFECT",
    "CORRECTIVE_ACTION", "NOTES", "RCL_CMPT_ID", "MFR_COMP_NAME", "MFR_COMP_DESC",
    "MFR_COMP_PTNO", "DO_NOT_DRIVE", "PARK_OUTSIDE",
)
RECALL_REQUIRED = ("RECORD_ID", "CAMPNO", "MAKETXT", "MODELTXT", "YEARTXT", "RCLTYPECD")
COMMUNICATION_COLUMNS = (
    "source_id", "replacement", "added", "document", "communicated", "campaign", "type",
    "make", "model", "year", "component", "system", "subsystem", "summary",
)
COMMUNICATION_REQUIRED = (
    "source_id", "added", "document", "communicated", "type", "make", "model", "year",
    "component", "summary",
)
COMPACT_COLUMNS = (
    "TSB/Document ID", "Make", "Model", "Model Year", "Concise Summary",
)

# --- fixed values: limits and versions ------------------------------------------

MIN_MODEL_YEAR, MAX_MODEL_YEAR = 1886, 2100
EXTREME_MILEAGE = 500_000
EXTREME_DELAY_DAYS = 3_652
SHORT_NARRATIVE = 10
LONG_NARRATIVE = 2_048
MILEAGE_UNIT = "miles"
PRODUCTION_CATEGORY = "L"
SEED = 20220913
THRESHOLD = 0.5
SENSITIVITY_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
BOOTSTRAP_SAMPLES = 1_000
TARGET_VERSION = "future-complaint-activity-1.0"
TARGET_THRESHOLDS = (1, 2, 3, 5, 10)
SUPPORT_THRESHOLDS = (1, 2, 5, 10, 20, 50)

# Identity namespaces: part of the hashed text, so they decide the ids.
EVENT_SOURCE_TYPE = "nhtsa_odi_complaint"
EVENT_ORGANIZATION = "national highway traffic safety administration (nhtsa)"
EVENT_DATASET = "office of defects investigation vehicle owner complaints"
RECALL_PREFIX = "nhtsa_recall"
COMMUNICATION_PREFIX = "nhtsa_mc"
FILING_PREFIX = "nhtsa_ewr"

KEY = ("normalized_make", "normalized_model", "model_year")
COHORT_ID = "broad_vehicle_id"

# --- column layouts derived from the enumerations --------------------------------

EVENT_FEATURE_COLUMNS = (
    "event_id", "source_type", "source_record_id", "source_reference_id", COHORT_ID,
    "known_configuration_id", *KEY, "component", "severity", "report_date", "report_year",
    "report_month", "occurrence_date", "occurrence_year", "vehicle_age_at_report_years",
    "report_before_model_year", "vehicle_age_at_occurrence_years",
    "occurrence_before_model_year", "occurrence_to_report_delay_days", "mileage",
    "mileage_unit", "mileage_observed", "death_count", "injury_count", "crash_positive",
    "fire_positive", "injury_positive", "death_positive",
    *(f"quality_{flag}" for flag in QUALITY_FLAGS),
)


def _pairs(template: str, names: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(
        template.format(name=name, kind=kind) for name in names for kind in ("count", "share")
    )


COHORT_FEATURE_COLUMNS = (
    COHORT_ID, *KEY, "complaint_event_count", "unique_event_count",
    "unique_source_reference_count", "first_observed_report_date",
    "last_observed_report_date", "known_configuration_count", "known_configuration_share",
    *_pairs("component_{name}_complaint_{kind}", COMPONENTS),
    *_pairs("severity_{name}_complaint_{kind}", SEVERITIES),
    *(
        f"{name}_{part}"
        for name in EVIDENCE
        for part in ("evidence_observed_count", "positive_count", "positive_share_of_observed")
    ),
    "mileage_observed_count", "mileage_observed_share", "mileage_all_observed_median_miles",
    "report_delay_observed_count", "report_delay_observed_share", "report_delay_median_days",
    *_pairs("quality_{name}_{kind}", QUALITY_FLAGS),
)
PRODUCTION_MATCH_COLUMNS = (
    COHORT_ID, *KEY, "complaint_event_count", "production_match_status", "match_method",
    "production_count", "production_source_record_count", "production_source_record_ids",
    "production_reporting_periods", "ambiguity_candidate_count", "complaints_per_10k_produced",
)
COMMUNICATION_EVIDENCE_VALUES = (
    "unique_communication_count", "communication_applicability_row_count",
    "source_expanded_row_count", "unique_manufacturer_document_id_count",
    "first_communication_date", "last_communication_date",
    "summary_observed_communication_count",
    "manufacturer_component_observed_communication_count",
    *(f"communication_type_{name.lower()}_count" for name in COMMUNICATION_TYPES),
    *(f"component_{name}_communication_count" for name in COMPONENTS),
)
RECALL_EVIDENCE_VALUES = (
    "unique_recall_campaign_count", "recall_applicability_row_count", "first_recall_date",
    "last_recall_date", "noncompliance_campaign_count",
    "known_affected_population_campaign_count", "remedy_observed_campaign_count",
    *(f"recall_type_{name.lower()}_campaign_count" for name in RECALL_TYPES),
    *(f"component_{name}_recall_campaign_count" for name in COMPONENTS),
)
TARGET_COLUMNS = (
    COHORT_ID, *KEY, "target_definition_version", "cutoff_date", "horizon_months",
    "future_window_start", "future_window_end", "target_eligible", "eligibility_reason",
    "cohort_age_at_cutoff", "historical_complaint_count", "future_complaint_count",
    "future_any_complaint", *(f"future_complaint_at_least_{n}" for n in (2, 3, 5, 10)),
    "future_severe_complaint_count", "future_severe_complaint_activity",
    *(f"future_component_{name}_complaint_count" for name in SELECTED_COMPONENTS),
)

# --- as-of feature families -------------------------------------------------------

IDENTITY_FEATURES = (COHORT_ID, *KEY, "cohort_age_at_cutoff", "feature_cutoff_date")
VOLUME_FEATURES = (
    "historical_complaint_count", "historical_unique_odino_count", "historical_years_observed",
    "historical_first_report_date", "historical_last_report_date",
    "days_since_last_historical_complaint",
)
RECENCY_MONTHS = (12, 24, 36)
RECENCY_FEATURES = tuple(f"complaints_last_{m}m" for m in RECENCY_MONTHS)
COMPONENT_FEATURES = _pairs("historical_complaint_component_{name}_{kind}", COMPONENTS)
SEVERITY_FEATURES = _pairs("historical_complaint_severity_{name}_{kind}", SEVERITIES)
EVIDENCE_FEATURES = tuple(f"historical_{name}_positive_count" for name in EVIDENCE)
MILEAGE_FEATURES = (
    "historical_mileage_observed_count", "historical_mileage_observed_share",
    "historical_mileage_median",
)
COMMUNICATION_FEATURES = (
    "communication_observed_by_cutoff", "communication_asof_status",
    "historical_unique_communication_count", "historical_first_communication_date",
    "historical_last_communication_date", "days_since_last_communication",
    *(f"historical_communication_type_{name.lower()}_count" for name in COMMUNICATION_TYPES),
    *(f"historical_communication_component_{name}_count" for name in COMPONENTS),
)
RECALL_FEATURES = (
    "recall_observed_by_cutoff", "recall_asof_status",
    "historical_unique_recall_campaign_count", "historical_first_recall_date",
    "historical_last_recall_date", "days_since_last_recall",
    "historical_recall_noncompliance_count", "historical_recall_do_not_drive_count",
    "historical_recall_park_outside_count",
    *(f"historical_recall_component_{name}_count" for name in COMPONENTS),
)
FEATURE_COLUMNS = (
    *IDENTITY_FEATURES, *VOLUME_FEATURES, *RECENCY_FEATURES, *COMPONENT_FEATURES,
    *SEVERITY_FEATURES, *EVIDENCE_FEATURES, *MILEAGE_FEATURES, *COMMUNICATION_FEATURES,
    *RECALL_FEATURES,
)
FEATURE_FAMILIES = {
    "STATIC": IDENTITY_FEATURES,
    "HISTORICAL_COMPLAINT_VOLUME": VOLUME_FEATURES,
    "HISTORICAL_COMPLAINT_RECENCY": RECENCY_FEATURES,
    "HISTORICAL_COMPLAINT_COMPONENTS": COMPONENT_FEATURES,
    "HISTORICAL_COMPLAINT_SEVERITY": (
        *SEVERITY_FEATURES, *EVIDENCE_FEATURES, *MILEAGE_FEATURES,
    ),
    "COMMUNICATIONS": COMMUNICATION_FEATURES,
    "RECALLS": RECALL_FEATURES,
    "OPTIONAL_PRODUCTION": (),
}


def model_columns(names: tuple[str, ...]) -> list[str]:
    """Feature names a model may see: no dates, statuses, ids or labels."""
    identity = {COHORT_ID, "normalized_make", "normalized_model"}
    return [n for n in names if not n.endswith(("_date", "_status")) and n not in identity]


COMPLAINT_MODEL = [
    "model_year", "cohort_age_at_cutoff",
    *model_columns(VOLUME_FEATURES), *RECENCY_FEATURES, *COMPONENT_FEATURES,
    *SEVERITY_FEATURES, *MILEAGE_FEATURES, *EVIDENCE_FEATURES,
]
COMMUNICATION_MODEL = model_columns(COMMUNICATION_FEATURES)
RECALL_MODEL = model_columns(RECALL_FEATURES)
ALL_EVIDENCE_MODEL = [*COMPLAINT_MODEL, *COMMUNICATION_MODEL, *RECALL_MODEL]
IDENTITY_MODEL = ["normalized_make", "normalized_model"]
EXPERIMENTS = {
    "historical_count_only": ["historical_complaint_count"],
    "complaint_volume_recency": [*model_columns(VOLUME_FEATURES), *RECENCY_FEATURES],
    "complaint_features": COMPLAINT_MODEL,
    "complaints_plus_communications": [*COMPLAINT_MODEL, *COMMUNICATION_MODEL],
    "complaints_plus_recalls": [*COMPLAINT_MODEL, *RECALL_MODEL],
    "complaints_communications_recalls": ALL_EVIDENCE_MODEL,
    "all_evidence_make_model_identity": [*ALL_EVIDENCE_MODEL, *IDENTITY_MODEL],
}
BINARY_FEATURES = ("communication_observed_by_cutoff", "recall_observed_by_cutoff")
