"""Secret scans through an incremental blob ledger.

Texts are blobs, addressed by the SHA-256 of their content; rows (paths, versions) only point to them. A ledger holds every
(blob, rule version) pair scanned so far with its findings, also if there are none. A run looks into the ledger first, scans
only the pairs that it lacks, and joins findings back to every row. Of unseen texts, those without a rule's mark are known to
be quiet where they stand; the others are gathered by blob, so that each is scanned once. All work is DataFrame functions:
matches and their positions come from one regexp_replace that marks them and a split at the marks, so positions count code
points.

Null texts count as empty. Repeated rows each get their findings. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import keeps_columns, materialize

#: Changes whenever a rule does; part of what the ledger knows a scan by.
RULE_VERSION = "1"

#: kind: (pattern, least length of the group, group, what texts must contain to be worth the pattern). In order of listing.
BASE_RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, r"(?i)passw|secret|token|api_?key"),
    "access": (r"AKIA[A-Z0-9]+", 20, 0, "AKIA"),
    "hex": (r"[0-9a-f]+", 24, 0, r"[0-9a-f]{24}"),
}
EXTRA_RULES = {
    "pem": (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 1, 0, "-----BEGIN "),
    "forge": (r"\b(?:gh[pousr]|glpat|xox[abprs])[_-][A-Za-z0-9_-]{16,}", 1, 0, r"gh[pousr]_|glpat-|xox[abprs]-"),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0, "eyJ"),
    "userinfo": (r"://[^/\s:@]{1,64}:[^/\s:@]{1,128}@", 1, 0, r"://[^/\s:@]{1,64}:"),
}
RULES = BASE_RULES | EXTRA_RULES

_MARK = "\x01"
_FINDINGS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _matches(text: Column, rank: int, kind: str) -> Column:
    """All leftmost non-overlapping matches with their code point spans; those whose group is too short are dropped."""
    pattern, least, group, hint = RULES[kind]
    # the marks must be the only ones; the stand-in has the same length, and no pattern takes either
    marked = F.regexp_replace(F.translate(text, _MARK, "\x02"), pattern, f"{_MARK}$0{_MARK}")
    parts = F.transform(F.split(marked, _MARK), lambda p: F.struct(p.alias("p"), F.length(p).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.lit(None).cast(_FINDINGS).alias("found"))
    start = start.withField("found", F.array().cast(_FINDINGS))

    def step(acc, part):
        group_length = part["n"] if group == 0 else F.length(F.regexp_extract(part["p"], pattern, group))
        span = F.struct(acc["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (acc["at"] + part["n"]).alias("end"))
        return F.struct(
            (acc["at"] + part["n"]).alias("at"),
            (~acc["hit"]).alias("hit"),
            F.when(acc["hit"] & (group_length >= least), F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).cast(_FINDINGS).alias("found"),
        )

    return F.when(text.rlike(hint), F.aggregate(parts, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(_FINDINGS))


def findings(text: Column, kinds=tuple(RULES)) -> Column:
    """array<struct<start, rank, kind, end>> by start, then kind as listed."""
    return F.array_sort(F.flatten(F.array(*(_matches(text, rank, kind) for rank, kind in enumerate(RULES) if kind in kinds))))


def _addressed(docs: DataFrame, ledger: DataFrame | None, version: str) -> DataFrame:
    """docs with _text, _blob and _suspect: whether the ledger lacks the blob and a rule's mark stands in it."""
    rows = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit(""))).withColumn("_blob", F.sha2(F.col("_text").cast("binary"), 256))
    marks = F.lit(False)
    for _, _, _, hint in RULES.values():
        marks = marks | F.col("_text").rlike(hint)
    if ledger is None:
        return rows.withColumn("_suspect", marks)
    known = ledger.filter(F.col("version") == version).select(F.col("blob").alias("_blob"), F.lit(True).alias("_known")).distinct()
    return rows.join(known, "_blob", "left").withColumn("_suspect", F.when(F.col("_known"), False).otherwise(marks)).drop("_known")


def _ledger(paths: DataFrame, ledger: DataFrame | None, version: str) -> DataFrame:
    """The ledger with a row for every blob of paths (_blob, _suspect, _text of suspects)."""
    blobs = paths.filter("_suspect").groupBy("_blob").agg(F.first("_text").alias("_text"))
    loud = materialize(blobs.select(F.col("_blob").alias("blob"), F.lit(version).alias("version"), findings(F.col("_text")).alias("findings")), "ledger")
    quiet = paths.filter("not _suspect").select(F.col("_blob").alias("blob")).distinct()
    if ledger is not None:
        quiet = quiet.join(ledger.filter(F.col("version") == version).select("blob"), "blob", "left_anti")
    fresh = loud.unionByName(quiet.select("blob", F.lit(version).alias("version"), F.array().cast(_FINDINGS).alias("findings")))
    return fresh if ledger is None else ledger.select("blob", "version", "findings").unionByName(fresh)


def _found(paths: DataFrame, ledger: DataFrame | None, whole: DataFrame, version: str) -> DataFrame:
    """paths (_blob, _suspect, ..) with _found. Without an older ledger quiet rows have none, and aren't joined."""
    loud = whole.filter((F.col("version") == version) & (F.size("findings") > 0)).select(F.col("blob").alias("_blob"), F.col("findings").alias("_found"))
    if ledger is not None:
        return paths.join(loud, "_blob", "left")
    quiet = paths.filter("not _suspect").withColumn("_found", F.lit(None).cast(_FINDINGS))
    return quiet.unionByName(paths.filter("_suspect").join(loud, "_blob", "left"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(rows, ledger): doc_id, blob, findings for every row; and the new ledger (blob, version, findings)."""
    rows = _addressed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ledger, version)
    paths = materialize(rows.select("doc_id", "_blob", "_suspect", F.when(F.col("_suspect"), F.col("_text")).alias("_text")), "paths")
    whole = _ledger(paths, ledger, version)
    out = _found(paths.select("doc_id", "_blob", "_suspect"), ledger, whole, version)
    return out.select("doc_id", F.col("_blob").alias("blob"), F.coalesce("_found", F.array().cast(_FINDINGS)).alias("findings")), whole


@keeps_columns
def without_secrets(docs: DataFrame, mask: str = "[SECRET]", ledger: DataFrame | None = None, version: str = RULE_VERSION) -> DataFrame:
    """docs with every found span replaced by the mask; all rows and columns stay."""
    rows = materialize(_addressed(docs, ledger, version).withColumn("_text", F.when(F.col("_suspect"), F.col("_text"))), "addressed")
    whole = _ledger(rows.select("_blob", "_suspect", "_text"), ledger, version)
    out = _found(rows.drop("_text"), ledger, whole, version)

    def masked(found):
        """Spans are sorted; what lies within a masked place already is not masked again."""
        reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice(found, F.lit(1), i), lambda f: f["end"])), F.lit(0))  # noqa: E731  end of all before
        cut = lambda a, b: F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))
        parts = F.transform(found, lambda f, i: F.concat(cut(reach(i), f["start"]), F.when(f["start"] >= reach(i), F.lit(mask)).otherwise(F.lit(""))))
        return F.concat(F.array_join(parts, ""), cut(reach(F.size(found)), F.length("text")))

    out = out.withColumn("text", F.when(F.size("_found") > 0, masked(F.col("_found"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
