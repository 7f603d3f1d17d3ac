"""Fixed values that must equal the audited application's for identical results.

Everything below is data (patterns, keyword lists, thresholds, labels and message texts),
stated plainly and in the original order.  Operators turn these lists into small rule
DataFrames or literal expressions; no logic lives here.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: personal-data patterns (category -> regex), original order.
# ---------------------------------------------------------------------------
PII_PATTERNS: dict[str, str] = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
    "ssn": r"\b\d{3}-?\d{2}-?\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "license_plate": r"\b[A-Z0-9]{2,3}[-\s]?[A-Z0-9]{3,4}\b",
}

# Java regex: (?U) makes \b, \d, \s, \w Unicode-aware like Python's ``re`` on str.
JAVA_REGEX_FLAGS = "(?U)"

# ---------------------------------------------------------------------------
# FIXED VALUES: sensitive-name keywords, "extended" rule set (6 categories).
# ---------------------------------------------------------------------------
EXTENDED_KEYWORDS: dict[str, list[str]] = {
    "demographic": ["age", "gender", "sex", "race", "ethnicity", "religion", "nationality"],
    "financial": ["income", "salary", "wage", "credit", "debt", "loan", "mortgage"],
    "health": ["health", "medical", "disease", "condition", "diagnosis", "treatment"],
    "location": ["address", "zip", "postal", "latitude", "longitude", "gps"],
    "behavioral": ["purchase", "browse", "click", "view", "search", "preference"],
    "biometric": ["fingerprint", "facial", "iris", "voice", "dna", "biometric"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES: sensitive-name keywords, "basic" rule set (9 categories).
# ---------------------------------------------------------------------------
BASIC_KEYWORDS: dict[str, list[str]] = {
    "age": ["age", "birth", "dob"],
    "gender": ["gender", "sex"],
    "race": ["race", "ethnicity", "ethnic"],
    "religion": ["religion", "religious"],
    "location": ["address", "zip", "postal", "location", "lat", "lon"],
    "personal_id": ["id", "ssn", "social", "passport", "license"],
    "financial": ["income", "salary", "wage", "credit", "score"],
    "health": ["health", "medical", "disease", "condition"],
    "contact": ["email", "phone", "mobile", "contact"],
}

# FIXED VALUES: identifier-like name fragments (privacy risk +3).
IDENTIFIER_KEYWORDS: list[str] = ["id", "key", "unique"]

# FIXED VALUES: privacy risk labels by score 0..5.
RISK_LABELS: list[str] = ["Very Low", "Low", "Medium", "High", "Very High", "Critical"]

# FIXED VALUES: target-name fragments.
TARGET_KEYWORDS: list[str] = ["status", "default", "approved", "outcome", "result", "class", "label", "target"]
# FIXED VALUES: outcome fragments used when a loan column exists.
LOAN_TARGET_KEYWORDS: list[str] = ["status", "default", "approved", "outcome", "result"]

# FIXED VALUES: default sensitive-feature fragments (first pass, then fallback, max 2).
SENSITIVE_DEFAULT_KEYWORDS: list[str] = ["gender", "race", "ethnicity", "age", "education"]
SENSITIVE_FALLBACK_KEYWORDS: list[str] = ["gender", "sex", "race", "ethnicity"]

# FIXED VALUES: sensitive names checked among the top-10 important features.
SENSITIVE_IMPORTANCE_KEYWORDS: list[str] = ["gender", "sex", "race", "ethnicity", "age", "religion", "marital"]

# ---------------------------------------------------------------------------
# FIXED VALUES: compliance frameworks and their requirements, original order.
# ---------------------------------------------------------------------------
COMPLIANCE_FRAMEWORKS: dict[str, list[str]] = {
    "GDPR": [
        "Data minimization",
        "Purpose limitation",
        "Storage limitation",
        "Accuracy",
        "Integrity and confidentiality",
        "Accountability",
    ],
    "CCPA": [
        "Notice at collection",
        "Notice of sale",
        "Right to know",
        "Right to delete",
        "Right to opt-out",
        "Non-discrimination",
    ],
    "HIPAA": [
        "Administrative safeguards",
        "Physical safeguards",
        "Technical safeguards",
        "Minimum necessary standard",
    ],
}
# FIXED VALUES: requirement-specific compliance recommendations (GDPR, when score < 1).
COMPLIANCE_REQUIREMENT_RECOMMENDATIONS: dict[str, str] = {
    "Data minimization": "Consider removing highly correlated or redundant features",
    "Accuracy": "Implement data validation and cleaning procedures",
    "Storage limitation": "Implement data retention policies and automated deletion",
}
# FIXED VALUES: general compliance recommendations, always appended in this order.
COMPLIANCE_GENERAL_RECOMMENDATIONS: list[str] = [
    "Conduct regular privacy impact assessments",
    "Implement privacy by design principles",
    "Ensure data subject rights can be exercised",
    "Maintain comprehensive data processing records",
]

# FIXED VALUES: basic privacy recommendations (always appended after the conditional ones).
PRIVACY_GENERAL_RECOMMENDATIONS: list[tuple[str, str]] = [
    ("data_minimization", "Only collect and use data necessary for the business purpose"),
    ("encryption", "Ensure sensitive data is encrypted at rest and in transit"),
    ("consent", "Verify proper consent mechanisms are in place"),
    ("retention", "Implement data retention policies"),
    ("geographic", "Consider GDPR, CCPA, and other regional privacy laws"),
]

# FIXED VALUES: thresholds used by the rules (defaults of the keyword arguments).
QI_UNIQUENESS_RANGE = (0.01, 0.9)
GENERALIZE_UNIQUENESS_RANGE = (0.1, 0.9)
KANON_MAX_COMBO = 4
BIAS_HIGH = 0.2
BIAS_MEDIUM = 0.1
INTERSECTIONAL_MIN_COUNT = 10
MISSING_CRITICAL = 70.0
MISSING_HIGH = 50.0
MISSING_MODERATE = 20.0
