"""Personal-data vocabulary: types, sensitivities, name and value patterns."""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------
# Column-name patterns, matched case-insensitively anywhere in the name; the
# first type in this order wins.
NAME_PATTERNS: dict[str, list[str]] = {
    "name": [
        r"name", r"first.?name", r"last.?name", r"full.?name", r"customer.?name", r"user.?name",
        r"account.?holder", r"given.?name", r"surname", r"^fn$", r"^ln$",
    ],
    "email": [r"email", r"e.?mail", r"mail", r"email.?address"],
    "phone": [
        r"phone", r"mobile", r"cell", r"tel", r"telephone", r"contact.?number", r"phone.?number",
        r"mobile.?number",
    ],
    "ssn": [r"ssn", r"social.?security", r"tax.?id", r"sin"],
    "national_id": [
        r"national.?id", r"passport", r"aadhaar", r"pan", r"voter.?id", r"license", r"dl.?number",
    ],
    "credit_card": [
        r"credit.?card", r"card.?number", r"cc.?num", r"pan.?number", r"card.?no", r"payment.?card",
    ],
    "bank_account": [
        r"bank.?account", r"account.?number", r"acct.?num", r"routing", r"iban", r"swift", r"bic",
    ],
    "address": [
        r"address", r"street", r"\bcity\b", r"\bstate\b", r"country", r"postal", r"\bzip\b", r"pincode",
        r"residence",
    ],
    "zip_code": [r"zip", r"postal.?code", r"pin.?code", r"postcode"],
    "ip_address": [r"ip.?address", r"ip$", r"client.?ip", r"user.?ip"],
    "device_id": [
        r"device.?id", r"device.?uuid", r"udid", r"android.?id", r"idfa", r"idfv", r"hardware.?id",
    ],
    "date_of_birth": [r"dob", r"birth.?date", r"date.?of.?birth", r"birthday"],
    "age": [r"^age$", r"customer.?age", r"user.?age"],
    "gender": [r"gender", r"sex", r"male.?female"],
    "username": [r"user.?name", r"login", r"user.?id", r"userid"],
    "password": [r"password", r"passwd", r"pwd", r"secret", r"pin$"],
}

# Value patterns, found anywhere in a text value.
VALUE_PATTERNS: dict[str, list[str]] = {
    "email": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
    "phone": [
        r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
        r"\+91[-.\s]?\d{10}",
        r"\d{10,15}",
    ],
    "ssn": [r"\d{3}[-.\s]?\d{2}[-.\s]?\d{4}"],
    "credit_card": [
        r"4[0-9]{12}(?:[0-9]{3})?",
        r"5[1-5][0-9]{14}",
        r"3[47][0-9]{13}",
        r"6(?:011|5[0-9][0-9])[0-9]{12}",
        r"\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}",
    ],
    "iban": [r"[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}"],
    "ip_address": [r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"],
    "mac_address": [r"([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})"],
    "date_of_birth": [r"\d{2}[-/]\d{2}[-/]\d{4}", r"\d{4}[-/]\d{2}[-/]\d{2}"],
    "zip_code": [r"\d{5}(-\d{4})?", r"\d{6}", r"[A-Z]\d[A-Z]\s?\d[A-Z]\d"],
    "gps_coordinates": [
        r"[-+]?([1-8]?\d(\.\d+)?|90(\.0+)?),\s*[-+]?(180(\.0+)?|((1[0-7]\d)|([1-9]?\d))(\.\d+)?)"
    ],
    "imei": [r"\d{15}"],
    "national_id": [r"[A-Z]{5}\d{4}[A-Z]", r"\d{12}"],
}

SENSITIVITY: dict[str, str] = {
    "ssn": "critical", "credit_card": "critical", "bank_account": "critical", "password": "critical",
    "biometric": "critical", "name": "high", "email": "high", "phone": "high", "address": "high",
    "national_id": "critical", "passport": "critical", "drivers_license": "critical",
    "date_of_birth": "high", "ip_address": "medium", "device_id": "medium", "mac_address": "medium",
    "gps_coordinates": "high", "zip_code": "medium", "age": "medium", "gender": "medium",
    "income": "medium", "occupation": "medium", "iban": "critical", "swift": "high", "imei": "high",
    "username": "medium", "unknown": "low",
}

DEFAULT_TREATMENT: dict[str, str] = {
    "name": "hash", "email": "hash", "phone": "mask", "ssn": "redact", "national_id": "redact",
    "credit_card": "redact", "bank_account": "hash", "address": "generalize", "zip_code": "generalize",
    "ip_address": "mask", "device_id": "hash", "date_of_birth": "generalize", "age": "generalize",
    "gender": "suppress", "income": "generalize", "gps_coordinates": "generalize", "username": "hash",
    "password": "redact",
}
FALLBACK_TREATMENT = "hash"

TREATMENTS = [
    "hash", "hmac", "mask", "generalize", "pseudonymize", "redact", "tokenize", "noise", "suppress",
]

NAME_CONFIDENCE = 0.8
VALUE_RATIO_MIN = 0.1
# -------------------------------------------------------------------------------

SENSITIVITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "none": 4}


def recommendation(pii_type: str) -> str:
    return "remove" if SENSITIVITY.get(pii_type, "low") == "critical" else "transform"


def value_pattern_list() -> list[tuple[int, str, str]]:
    """(order, type, pattern) for all value patterns."""
    flat = [(t, p) for t, ps in VALUE_PATTERNS.items() for p in ps]
    return [(i, t, p) for i, (t, p) in enumerate(flat)]
