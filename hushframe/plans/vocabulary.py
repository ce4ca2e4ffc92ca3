"""Closed vocabularies with their order, and the default policy. They must be exactly these for right results."""

ACTIONS = ("PASS", "TOKENIZE", "REDACT", "LOCAL_ANALYZE_TO_SANITIZED_TEXT", "LOCAL_ONLY", "BLOCK")
SOURCES = ("checksum", "regex", "keyword", "image_classifier", "ocr", "local_model")
SEVERITY = ("ID_CARD", "BANK_CARD", "PHONE", "EMAIL", "VEHICLE_PLATE", "ORG_ID", "ADDRESS_DETAILED", "PERSON", "MEDICAL_DATA", "UNKNOWN_SENSITIVE", "ORGANIZATION")
IMAGE_CLASSES = ("ORDINARY_IMAGE", "SENSITIVE_IMAGE", "ID_DOCUMENT_IMAGE", "UNKNOWN_IMAGE")
MODEL_TYPES = ("PERSON", "ADDRESS_DETAILED", "ORGANIZATION", "MEDICAL_DATA", "UNKNOWN_SENSITIVE")
ENTITY_TYPES = SEVERITY + ("FACE", "ID_DOCUMENT_IMAGE", "ORDINARY_IMAGE")

#: Words that show a picture to be a document, and a vision model's categories with their classes.
DOCUMENT_KEYWORDS = (
    "身份证", "居民身份证", "护照", "驾驶证", "行驶证", "户口", "签发机关", "有效期限", "银行卡", "信用卡", "社会保障", "医保卡", "出生日期", "公民身份号码",
    "港澳通行证", "台胞证", "军官证", "警官证", "营业执照", "统一社会信用代码", "出生医学证明", "结婚证", "房产证", "不动产权证", "组织机构代码",
    "机动车登记证书", "道路运输证", "从业资格证", "residence permit", "passport", "driver licen", "driving licence", "identity card", "id card",
    "date of birth", "place of birth", "issuing authority", "valid until", "cardholder", "expiry date", "social security",
)
VISION = {"identity_document": "ID_DOCUMENT_IMAGE", "sensitive": "SENSITIVE_IMAGE", "ordinary": "ORDINARY_IMAGE", "unclear": "SENSITIVE_IMAGE"}
MOST_VISION_BYTES = 8 << 20

POLICY = {
    "version": "2026-09-01.1",
    "defaults": {"unknown_entity": "BLOCK", "unsupported_content": "BLOCK", "detector_error": "BLOCK", "low_confidence": "REDACT"},
    "entities": {
        "ID_CARD": ("TOKENIZE", 0.50),
        "PERSON": ("TOKENIZE", 0.75),
        "PHONE": ("TOKENIZE", 0.60),
        "BANK_CARD": ("TOKENIZE", 0.60),
        "EMAIL": ("TOKENIZE", 0.70),
        "ADDRESS_DETAILED": ("TOKENIZE", 0.75),
        "ORGANIZATION": ("PASS", 0.75),
        "ORG_ID": ("TOKENIZE", 0.60),
        "VEHICLE_PLATE": ("TOKENIZE", 0.75),
        "MEDICAL_DATA": ("BLOCK", 0.0),
        "FACE": ("PASS", 0.0),
        "UNKNOWN_SENSITIVE": ("BLOCK", 0.0),
    },
    "content_classes": {"ORDINARY_IMAGE": "PASS", "ID_DOCUMENT_IMAGE": "LOCAL_ANALYZE_TO_SANITIZED_TEXT", "SENSITIVE_IMAGE": "LOCAL_ANALYZE_TO_SANITIZED_TEXT", "UNKNOWN_IMAGE": "BLOCK"},
    "purpose_overrides": {"medical_report_analysis": {"MEDICAL_DATA": ("PASS", 0.0)}},
}
LIMITS = {"turns": 50, "files": 20, "bytes": 209_715_200, "pages": 200, "mappings": 5000}
DURATION_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 120.0)


def checked_policy(policy: dict) -> dict:
    """The policy if it knows nothing but its own keys, entities and actions; else an error that names what is wrong."""
    wrong = [f"key {k}" for k in policy if k not in POLICY]
    wrong += [f"missing {k}" for k in ("version", "defaults", "entities") if k not in policy]
    wrong += [f"default {k}" for k in policy.get("defaults", {}) if k not in POLICY["defaults"]]
    wrong += [f"missing default {k}" for k in POLICY["defaults"] if k not in policy.get("defaults", {})]
    rules = {**policy.get("entities", {})}
    for purpose in policy.get("purpose_overrides", {}).values():
        rules |= purpose
    wrong += [f"entity {k}" for k in rules if k not in ENTITY_TYPES]
    wrong += [f"image class {k}" for k in policy.get("content_classes", {}) if k not in IMAGE_CLASSES]
    actions = [*policy.get("defaults", {}).values(), *policy.get("content_classes", {}).values(), *(a for a, _ in rules.values())]
    wrong += [f"action {a}" for a in actions if a not in ACTIONS]
    wrong += [f"confidence {c}" for _, c in rules.values() if not 0 <= c <= 1]
    if wrong:
        raise ValueError("policy: " + ", ".join(wrong))
    return policy
