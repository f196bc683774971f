"""Fixed lookup values of the identity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Governorate codes of the national ID number and their names.
GOVERNORATES = {
    "01": "Cairo",
    "02": "Alexandria",
    "03": "Port Said",
    "04": "Suez",
    "11": "Damietta",
    "12": "Dakahlia",
    "13": "Ash Sharqia",
    "14": "Kaliobeya",
    "15": "Kafr El - Sheikh",
    "16": "Gharbia",
    "17": "Monoufia",
    "18": "El Beheira",
    "19": "Ismailia",
    "21": "Giza",
    "22": "Beni Suef",
    "23": "Fayoum",
    "24": "El Menia",
    "25": "Assiut",
    "26": "Sohag",
    "27": "Qena",
    "28": "Aswan",
    "29": "Luxor",
    "31": "Red Sea",
    "32": "New Valley",
    "33": "Matrouh",
    "34": "North Sinai",
    "35": "South Sinai",
    "88": "Foreign",
}

# Field classes of the detector, and which of them a capture needs.
FIELDS = ["firstName", "lastName", "nid", "address", "serial"]
REQUIRED_FIELDS = ["lastName", "nid", "address", "serial"]
OPTIONAL_FIELDS = ["firstName"]
FIELD_LABELS = {
    "lastName": "Last Name",
    "nid": "National ID",
    "address": "Address",
    "serial": "Serial",
}

# Detector confidence floors per stage.
STAGE_FLOORS = {"card": 0.5, "field": 0.3, "digit": 0.4}

# Rating labels.
RATING_LABELS = {
    1: "Poor - Not suitable for OCR",
    2: "Fair - Limited OCR accuracy",
    3: "Good - Moderate OCR accuracy",
    4: "Very Good - High OCR accuracy",
    5: "Excellent - Perfect for OCR",
}

# Verification statuses, each step's completed set below.
STEP_STATUSES = {
    "document": ["document_uploaded", "document_verified", "otp_verified", "completed"],
    "verification": ["document_verified", "otp_verified", "completed"],
    "otp": ["otp_verified", "completed"],
    "complete": ["completed"],
}

ANGLES = [0, 90, 180, 270]
ID_DIGITS = 14


def governorates(spark: SparkSession) -> DataFrame:
    """The 28 governorates as an inline table, so its size is known to Catalyst."""
    rows = ", ".join(f"('{code}', '{name}')" for code, name in GOVERNORATES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(code, name)")
