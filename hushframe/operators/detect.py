"""Detectors: columns text -> array of findings. Each rule is one marked replacement inside the JVM; nothing is exploded.

Rules that can't match are not run: all labels stand in one trie, searched for once, which says whose labels a text holds; a rule
of shapes names what its matches must contain, and what several rules share is looked for once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column

from ..functions import checks
from ..functions.spans import let, marked_parts, placed
from ..functions.text import fold_fullwidth
from ..plans.vocabulary import SEVERITY, SOURCES

FINDING = "struct<source_rank:int,severity:int,shorter:int,doubt:double,start:int,end:int,rule_id:string,entity_type:string,source:string,confidence:double,raw:string,trail:array<string>>"


@dataclass(frozen=True)
class Shape:
    """A pattern between guards: characters that must not stand right before or after it."""

    rule_id: str
    entity_type: str
    core: str
    confidence: float
    before: str = ""
    after: str = ""
    hint: str = ""


@dataclass(frozen=True)
class Label:
    rule_id: str
    entity_type: str
    confidence: float
    labels: tuple[str, ...]


# Separators, patterns, labels and confidences must be these for right results.
SEP = "[ \\t\u00a0\u3000\\-\u2010-\u2015\uff0d.]{0,2}"
CJK = "一-龥"
PROVINCES = "京津冀晋蒙辽吉黑沪苏浙皖闽赣鲁豫鄂湘粤桂琼渝川贵云藏陕甘青宁新"
ADDRESS_LEAD = "住址地为是从往赴到于在家公司的了"
VALIDATED = 0.99
#: What every match of the rules for numbers holds.
DIGITS = r"(?U)\d{4}"
SHAPES = (
    Shape("cn_id_card_18", "ID_CARD", rf"\d{{6}}{SEP}\d{{8}}{SEP}\d{{3}}[\dXx]", 0.80, r"\d", r"\d", DIGITS),
    Shape("cn_id_card_15", "ID_CARD", r"[1-9]\d{5}\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}", 0.70, r"\d", r"\d", DIGITS),
    Shape("cn_travel_document", "ID_CARD", r"(?:[EG]\d{8}|[DSP]\d{7}|[CW]\d{8}|[HM]\d{8,10})", 0.60, "A-Za-z0-9", "A-Za-z0-9", DIGITS),
    Shape("cn_uscc", "ORG_ID", r"[0-9A-HJ-NPQRTUWXY]{18}", 0.55, "A-Za-z0-9", "A-Za-z0-9", "[0-9A-HJ-NPQRTUWXY]{18}"),
    Shape("cn_landline", "PHONE", r"(?:0\d{2,3}[-\s]\d{7,8}|\(0\d{2,3}\)\s?\d{7,8})", 0.65, r"\d\-", r"\d\-", DIGITS),
    Shape(
        "cn_detailed_address",
        "ADDRESS_DETAILED",
        rf"(?:[{CJK}]{{2,8}}(?:省|自治区))?(?:[{CJK}]{{2,8}}(?:市|区|县|旗))*[{CJK}A-Za-z0-9]{{2,8}}(?:路|街|大道|巷|弄|村|镇)[{CJK}A-Za-z0-9]{{0,12}}(?:号|弄|栋|幢|单元|室|层)",
        0.80,
        hint="[路街道巷弄村镇]",
    ),
    Shape("cn_phone_mobile", "PHONE", rf"(?:\+?86{SEP})?1[3-9]\d{SEP}\d{{4}}{SEP}\d{{4}}", 0.85, r"\d", r"\d", DIGITS),
    Shape("e164_phone", "PHONE", r"\+\d{1,3}[ \-]?\d{6,12}", 0.70, r"\d+", r"\d", r"\+"),
    Shape("bank_card_luhn", "BANK_CARD", rf"\d{{4}}{SEP}\d{{4}}{SEP}\d{{4}}{SEP}\d{{1,7}}", 0.55, r"\d", r"\d", DIGITS),
    Shape("email_address", "EMAIL", r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", 0.92, r"A-Za-z0-9._%+\-", "", "@"),
    Shape("cn_vehicle_plate", "VEHICLE_PLATE", rf"[{PROVINCES}][A-HJ-NP-Z][ ·\-]?[A-HJ-NP-Z0-9]{{4,5}}[A-HJ-NP-Z0-9挂学警港澳]", 0.85, "A-Z0-9", "A-Z0-9", f"[{PROVINCES}]"),
)
LABELS = (
    Label("label_person", "PERSON", 0.82, ("姓名", "患者姓名", "患者", "被保险人", "投保人", "受益人", "驾驶人", "驾驶员", "当事人", "联系人", "受检人", "报案人", "申请人", "户名", "接诊医师", "接诊医生", "主治医师", "主治医生", "医师", "医生", "name", "patient", "insured", "policyholder", "driver", "contact person")),
    Label("label_id_card", "ID_CARD", 0.85, ("公民身份号码", "身份证号码", "身份证号", "身份证", "证件号码", "证件号", "护照号", "港澳通行证", "台胞证", "驾驶证号", "驾照号", "id number", "id no", "identity card", "national id", "passport")),
    Label("label_phone", "PHONE", 0.80, ("联系电话", "手机号码", "移动电话", "电话号码", "联系方式", "手机号", "手机", "电话", "座机", "传真", "phone", "mobile", "tel", "telephone")),
    Label("label_address", "ADDRESS_DETAILED", 0.80, ("详细地址", "家庭住址", "现住址", "户籍地址", "通讯地址", "住所地", "地址", "住址", "住所", "address", "home address", "residence")),
    Label("label_bank_card", "BANK_CARD", 0.78, ("银行卡号", "开户账号", "收款账号", "卡号", "账号", "账户", "card number", "card no", "account number")),
    Label("label_email", "EMAIL", 0.80, ("邮箱", "电子邮箱", "email", "e-mail")),
    Label("label_plate", "VEHICLE_PLATE", 0.80, ("号牌号码", "车牌号码", "车牌号", "车牌", "plate number", "license plate")),
    Label("label_organization", "ORGANIZATION", 0.72, ("投保单位", "工作单位", "就诊医院", "医疗机构", "机构名称", "单位名称", "单位", "医院", "employer", "hospital", "organization")),
    Label("label_org_id", "ORG_ID", 0.85, ("统一社会信用代码", "社会信用代码", "纳税人识别号", "组织机构代码", "营业执照号", "unified social credit")),
    Label("label_medical_record", "UNKNOWN_SENSITIVE", 0.80, ("病案号", "病历号", "住院号", "门诊号", "就诊卡号", "诊疗卡号", "社保卡号", "医保卡号", "报告编号", "检验单号")),
)
STOP = "\n\r|、,，;；。！？（）()【】《》\t"
GAP = "[ \\t\u3000]{2,}"
LABEL_SEPARATOR = "(?:[\\s\\x1c-\\x1f]*[:\uff1a=][\\s\\x1c-\\x1f]*|[ \\t\u3000]{1,8})"
CONTEXT, BONUS = 24, 0.10


def label_words(rule: Label) -> str:
    return "|".join(w.replace("-", r"\-") for w in sorted(rule.labels, key=len, reverse=True))


def trie(words) -> str:
    """A pattern for any of the words, the longest that stands at a place first; letters that several begin with are compared once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for c, rests in heads.items():
        longer = trie(x for x in rests if x)
        parts.append(re.escape(c) + (f"(?:{longer})" + ("?" if "" in rests else "") if longer else ""))
    return "|".join(parts)


def _begin(words) -> str:
    """Nothing, before one of the first characters of the words: most places are passed by after one look."""
    return "(?=[" + "".join(sorted({re.escape(w[0]) for w in words})) + "])"


def labels_in(text: Column, labels) -> Column:
    """The labels, in lower case, that stand in the text before something that can end one: one search for all rules. At each place
    the longest is named."""
    words = sorted({w for rule in labels for w in rule.labels})
    pattern = rf"(?iuU){_begin(words)}(?=({trie(words)})[\s\x1c-\x1f:：=])"
    # letters beyond ASCII that a search without case takes for i, k and s
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: F.lower(F.translate(w, "ıİſK", "iisk"))))


def finding(rule_id: str, entity_type: str, source: Column, confidence: Column, start: Column, end: Column, raw: Column) -> Column:
    """The keys that order evidence come first: source, severity, length, confidence, then place and rule."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SOURCES)), source).cast("int") - 1
    severity = SEVERITY.index(entity_type) if entity_type in SEVERITY else len(SEVERITY)
    return F.struct(
        rank.alias("source_rank"), F.lit(severity).alias("severity"), (start - end).cast("int").alias("shorter"), (-confidence).alias("doubt"), start.cast("int").alias("start"), end.cast("int").alias("end"),
        F.lit(rule_id).alias("rule_id"), F.lit(entity_type).alias("entity_type"), source.alias("source"), confidence.alias("confidence"), raw.alias("raw"), F.array(F.concat_ws(":", source, F.lit(rule_id))).alias("trail"),
    ).cast(FINDING)


def _literal(rule: Shape | Label) -> Column:
    """What findings take from their rule."""
    severity = SEVERITY.index(rule.entity_type) if rule.entity_type in SEVERITY else len(SEVERITY)
    return F.expr(f"named_struct('rule_id', '{rule.rule_id}', 'entity_type', '{rule.entity_type}', 'severity', {severity}, 'confidence', {rule.confidence}D, 'label', {str(isinstance(rule, Label)).lower()})")


def _made(text: Column, rule: Column, start: Column, part: Column) -> Column:
    """The findings, one or none, of a match: its trimmed place, whether its check digits are right, and its value."""
    is_ = lambda *names: rule["rule_id"].isin(*names)
    lead = F.when(rule["label"], F.regexp_extract(part, r"(?U)^[\s\x1c-\x1f]*", 0)).when(is_("cn_detailed_address"), F.regexp_extract(part, f"^[{ADDRESS_LEAD}]*", 0)).otherwise("")
    tail = F.when(rule["label"], F.regexp_extract(part, r"(?U)[\s\x1c-\x1f]*\z", 0)).otherwise("")

    def of(x):
        good = F.when(is_("cn_id_card_18"), checks.id_ok(part)).when(is_("cn_uscc"), checks.org_ok(part)).when(is_("bank_card_luhn"), checks.luhn_ok(part)).otherwise(F.lit(False))
        source = F.when(rule["label"], "keyword").when(good, "checksum").otherwise("regex")
        rank = F.array_position(F.array(*(F.lit(s) for s in SOURCES)), source).cast("int") - 1
        confidence = F.when(source == "checksum", F.lit(VALIDATED)).otherwise(rule["confidence"])
        raw = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        return let(F.struct(rank.alias("rank"), source.alias("source"), confidence.alias("confidence")), lambda y: F.struct(
            y["rank"], rule["severity"], (x["start"] - x["end"]).alias("shorter"), (-y["confidence"]).alias("doubt"), x["start"], x["end"],
            rule["rule_id"], rule["entity_type"], y["source"], y["confidence"], raw.alias("raw"), F.array(F.concat_ws(":", y["source"], rule["rule_id"])).alias("trail"),
        ).cast(FINDING))

    place = F.struct((start + F.length(lead)).cast("int").alias("start"), (start + F.length(part) - F.length(tail)).cast("int").alias("end"))
    keep = ~is_("cn_id_card_18") | checks.id_date_plausible(part)
    return let(place, lambda x: F.when((x["start"] < x["end"]) & keep, F.array(of(x))).otherwise(F.array().cast(f"array<{FINDING}>")))


def all_findings(text: Column, shapes=SHAPES, labels=LABELS) -> Column:
    """Findings of all rules, by rule and place; null for null. The text is folded once, every gate that rules share is looked at
    once, and labels once for all. Positions and values are the text's own."""
    hints = list(dict.fromkeys(r.hint for r in shapes if r.hint))
    words = {w for rule in labels for w in rule.labels}
    none = F.array().cast("array<string>")

    def parts(folded, open_, seen):
        out = []
        for r in shapes:
            pattern = "(?U)" + (f"(?<![{r.before}])" if r.before else "") + r.core + (f"(?![{r.after}])" if r.after else "")
            gate = open_[hints.index(r.hint)] if r.hint else F.lit(True)
            out.append((r, F.when(gate, marked_parts(folded, pattern)).otherwise(none)))
        for r in labels:
            # a longer label of another rule may hide one of this rule that begins at the same place
            own = sorted(w for w in words if any(w.startswith(x) for x in r.labels))
            pattern = rf"(?iuU)({_begin(r.labels)}(?:{trie(r.labels)}){LABEL_SEPARATOR})([^{STOP}]{{1,64}}?)(?={GAP}|[{STOP}]|\z)"
            out.append((r, F.when(F.arrays_overlap(seen, F.array(*(F.lit(w) for w in own))), marked_parts(text, pattern, 1)).otherwise(none)))
        return F.array(*(F.struct(_literal(r).alias("rule"), p.alias("parts")) for r, p in out))

    def found(x):
        """One lambda for the matches of all rules: plans grow little with each."""
        return F.when(F.size(x["parts"]) > 1, F.flatten(F.transform(placed(x["parts"]), lambda s, i: _made(text, x["rule"], s["start"], F.element_at(x["parts"], 2 * i + 2))))).otherwise(F.array().cast(f"array<{FINDING}>"))

    def with_gates(folded):
        open_ = F.array(F.lit(True), *(folded.rlike(h) for h in hints))
        seen = labels_in(text, labels) if labels else none
        return let(open_, lambda o: let(seen, lambda s: F.flatten(F.transform(parts(folded, [o[i + 1] for i in range(len(hints))], s), found))))

    return F.when(text.isNotNull(), let(fold_fullwidth(text), with_gates))


def shape_findings(text: Column, rule: Shape) -> Column:
    return all_findings(text, [rule], [])


def label_findings(text: Column, rule: Label) -> Column:
    """Findings of one label rule: the value after the label, without the label."""
    return all_findings(text, [], [rule])


def boosted(text: Column, findings: Column) -> Column:
    """Pattern and checksum findings gain BONUS, up to 1, where a label of their type stands within CONTEXT characters before."""
    words = {}
    for rule in LABELS:
        words.setdefault(rule.entity_type, []).extend(w.lower() for w in rule.labels)
    table = F.create_map(*(x for t, w in words.items() for x in (F.lit(t), F.array(*(F.lit(v) for v in w)))))

    def one(f):
        begin = F.greatest(f["start"] - CONTEXT, F.lit(0))
        window = F.lower(F.substring(text, begin + 1, f["start"] - begin))
        near = F.exists(F.coalesce(table[f["entity_type"]], F.array().cast("array<string>")), lambda w: F.contains(window, w))
        confidence = F.when(f["source"].isin("regex", "checksum") & near, F.least(F.lit(1.0), f["confidence"] + F.lit(BONUS))).otherwise(f["confidence"])
        return f.withField("confidence", confidence).withField("doubt", -confidence)

    return F.transform(findings, one)
