"""Fixed values and settings. All settings are frozen dataclasses passed as arguments."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: texts and codes that results must contain unchanged ---
STAGES = ("UPLOADED", "REVIEWED", "APPROVED", "REJECTED", "AUDITED")
ACTIVE_STAGES = ("UPLOADED", "REVIEWED")
FUNNEL_STAGES = ("UPLOADED", "REVIEWED", "APPROVED", "REJECTED")
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH")
ROLES = ("AP_CLERK", "FINANCE_MANAGER", "AUDITOR", "MAIL_BOT")
CURRENCIES = ("USD", "EUR", "GBP", "INR", "AED", "SGD", "AUD", "CAD", "JPY", "CNY")
MIME_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/jpg")
FILE_EXTENSIONS = ("pdf", "png", "jpg", "jpeg")

# (stage before, stage after, roles that may do it); None = the record does not exist yet.
TRANSITIONS = (
    (None, "UPLOADED", ("MAIL_BOT", "AP_CLERK")),
    (None, "REVIEWED", ("AP_CLERK",)),
    ("UPLOADED", "UPLOADED", ("AP_CLERK",)),
    ("UPLOADED", "REVIEWED", ("AP_CLERK",)),
    ("REVIEWED", "REVIEWED", ("AP_CLERK", "FINANCE_MANAGER")),
    ("REVIEWED", "APPROVED", ("FINANCE_MANAGER",)),
    ("REVIEWED", "REJECTED", ("FINANCE_MANAGER",)),
    ("APPROVED", "APPROVED", ("FINANCE_MANAGER",)),
    ("APPROVED", "AUDITED", ("AUDITOR",)),
    ("AUDITED", "AUDITED", ("AUDITOR",)),
)
# --- end of fixed values ---


@dataclass(frozen=True)
class RiskWeights:
    low_confidence: int = 20
    math_mismatch: int = 30
    duplicate: int = 40
    anomaly: int = 25
    confidence_floor: float = 0.7
    anomaly_factor: int = 2
    high_from: int = 60
    medium_from: int = 30


@dataclass(frozen=True)
class MailRules:
    """Empty tuples switch a filter off; ``max_bytes <= 0`` switches the size limit off."""

    senders: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    max_bytes: int = 15 * 1024 * 1024
    ai_version: str = "v1"


@dataclass(frozen=True)
class Limits:
    mismatch_tolerance: float = 1.0
    sla_days: int = 3


RISK = RiskWeights()
LIMITS = Limits()
