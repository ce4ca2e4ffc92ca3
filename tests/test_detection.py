"""All rules at once against a plain reading of the rules, gates and tries, and merging of very many findings."""

import random
import re
import time

import pyspark.sql.functions as F
import pytest

from hushframe.functions.spans import apply_edits
from hushframe.operators import detect, merge, tokens
from hushframe.plans.vocabulary import SEVERITY, SOURCES


def plain_findings(text):
    """(rule, start, end, raw) by one search for each rule, as the rules are written; check digits are tested elsewhere."""
    folded = "".join(chr(ord(c) - 0xFEE0) if re.match("[０-９Ａ-Ｚａ-ｚ]", c) else c for c in text)
    out = []
    for r in detect.SHAPES:
        pattern = (f"(?<![{r.before}])" if r.before else "") + r.core + (f"(?![{r.after}])" if r.after else "")
        for m in re.finditer(pattern, folded):
            a, b = m.span()
            if r.rule_id == "cn_detailed_address":
                a += len(re.match(f"[{detect.ADDRESS_LEAD}]*", m[0])[0])
            if r.rule_id == "cn_id_card_18":
                d = re.sub(r"[^0-9Xx]", "", m[0])
                if not (1900 <= int(d[6:10]) <= 2100 and 1 <= int(d[10:12]) <= 12 and 1 <= int(d[12:14]) <= 31):
                    continue
            if a < b:
                out.append((r.rule_id, a, b, text[a:b]))
    for r in detect.LABELS:
        words = "|".join(map(re.escape, sorted(r.labels, key=len, reverse=True)))
        pattern = rf"(?i)(?:{words})(?:\s*[:：=]\s*|[ \t　]{{1,8}})([^{detect.STOP}]{{1,64}}?)(?={detect.GAP}|[{detect.STOP}]|\Z)"
        for m in re.finditer(pattern, text):
            value = m[1].strip()
            a = m.start(1) + m[1].index(value) if value else 0
            if value:
                out.append((r.rule_id, a, a + len(value), value))
    return out


def texts():
    r = random.Random(8)
    labels = [w for rule in detect.LABELS for w in rule.labels]
    values = ["13812345678", "138 1234-5678", "１３８１２３４５６７８", "110101199003079999", "4539578763621486", "4539 5787 6362 1487", "wei.zhang@example.invalid", "京A12345", "苏E·12345", "Wei Zhang", "张伟", "91350100M000100Y43", "320502900307999", "E12345678", "0512-87654321", "(010) 88886666", "+44 2071838750", "北京市朝阳区建国路8号", "MR-77", "x@y", "12345", "\x01", "😀"]
    glue = [" ", ": ", "：", "=", "  ", "\n", "，", "", "\t", " : ", "\xa0", "HoTel "]
    out = []
    for _ in range(500):
        parts = [r.choice((r.choice(labels), r.choice(values), r.choice(labels).upper(), "text")) + r.choice(glue) for _ in range(r.randrange(1, 14))]
        out.append("".join(parts))
    return out + ["", "ſ name: Wei", "NAME: Wei", "contact personnel: x", "电子邮箱：a@b.cn，邮箱地址 北京"]


def test_all_rules_equal_a_plain_reading(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)) + [(-1, None)], "i int, text string").select("i", detect.all_findings(F.col("text")).alias("f"))
    got = {r.i: r.f for r in df.collect()}
    assert got.pop(-1) is None
    for i, text in enumerate(rows):
        assert [(f.rule_id, f.start, f.end, f.raw) for f in got[i]] == plain_findings(text), text


def test_trie_takes_the_longest_word_first():
    words = {"a", "ab", "abc", "b-c", "身份证", "身份证号", "身份证号码"}
    pattern = re.compile(detect.trie(sorted(words)))
    for w in words:
        assert pattern.fullmatch(w) and pattern.match(w + "zz")[0] == w
    assert not pattern.fullmatch("身份") and pattern.match("身份证号x")[0] == "身份证号"


def test_detectors_stand_in_the_plan_once(spark):
    df = spark.createDataFrame([("x",)], "text string")
    once = df.select(detect.all_findings(F.col("text")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    merged = df.select(merge.merged(detect.all_findings(F.col("text"))).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    count = lambda plan: plan.count("regexp_replace(")
    assert count(once) == count(merged) > 0


def greedy(findings):
    kept = []
    for c in sorted(findings):
        hit = next((k for k in kept if k[4] < c[5] and c[4] < k[5]), None)
        if hit is None:
            kept.append(list(c))
        elif c[1] < hit[1]:
            hit[1], hit[7], hit[9] = c[1], c[7], max(hit[9], c[9])
    return sorted((k[4], k[5], k[7], k[9]) for k in kept)


def made(r, n, spread):
    out = []
    for i in range(n):
        start = r.randrange(spread)
        size, source, severity = r.randrange(1, 30), r.randrange(3), r.randrange(len(SEVERITY))
        confidence = r.choice([0.5, 0.75, 0.99])
        out.append((source, severity, -size, -confidence, start, start + size, f"r{i}", SEVERITY[severity], SOURCES[source], confidence, "", [f"{i}"]))
    return out


@pytest.mark.parametrize(("n", "spread"), [(0, 1), (1, 9), (40, 60), (700, 6_000), (3000, 400_000)])
def test_merge_by_clusters_equals_the_plain_fold(spark, n, spread):
    rows = [(i, made(random.Random(i), n, spread)) for i in range(8 if n < 1000 else 2)]
    df = spark.createDataFrame(rows, f"i int, f array<{detect.FINDING}>")
    got = {r.i: sorted((k.start, k.end, k.entity_type, k.confidence) for k in r.m) for r in df.select("i", merge.merged(F.col("f")).alias("m")).collect()}
    assert got == {i: greedy(f) for i, f in rows}


def test_merging_many_findings_costs_little_for_each(spark):
    took = []
    for n in (5_000, 20_000):
        df = spark.createDataFrame([(made(random.Random(1), n, n * 40),)], f"f array<{detect.FINDING}>").repartition(1).cache()
        df.count()
        best = 1e9
        for _ in range(2):
            began = time.time()
            df.select(F.size(merge.merged(F.col("f"))).alias("n")).collect()
            best = min(best, time.time() - began)
        took.append(best)
        df.unpersist()
    assert took[1] < 10 * took[0] + 2, took  # four times the findings; the square would be sixteen times


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 400])
def test_edits_in_blocks_equal_plain_ones(spark, n):
    r = random.Random(n)
    text = "".join(r.choice("abé日😀") for _ in range(10 * n + 7))
    edits, want, at = [], "", 0
    for i in range(n):
        start = i * 10 + r.randrange(5)
        end = start + r.randrange(1, 5)
        edits.append((start, end, f"<{i}>"))
        want += text[at:start] + f"<{i}>"
        at = end
    want += text[at:]
    df = spark.createDataFrame([(text, edits)], "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert df.select(apply_edits(F.col("t"), F.col("e")).alias("x")).first().x == want


def test_replies_with_marks_and_many_tokens_are_restored(spark):
    token = lambda i: f"[[PGW_V1_EMAIL_{'ABCDEFGH'[i // 8]}{'ABCDEFGH'[i % 8]}CDEFGHJKLM]]"
    replies = [("a", "s", f"\x01{token(1)}\x02 and {token(2)}{token(1)}\x01"), ("b", "s", "none \x01"), ("c", "s", "".join(f"{token(i % 64)}-" for i in range(3000))), ("d", None, token(1))]
    vault = spark.createDataFrame([("s", token(i), f"v{i}") for i in range(64) if i != 2], "scope_id string, token string, original string")
    got = {r.reply_id: r for r in tokens.restored(spark.createDataFrame(replies, "reply_id string, scope_id string, text string"), vault).collect()}
    assert got["a"].restored_text == f"\x01v1\x02 and {token(2)}v1\x01" and (got["a"].seen, got["a"].restored, got["a"].unknown) == (3, 2, 1)
    assert got["b"].restored_text == "none \x01" and got["d"].restored_text == token(1)
    assert got["c"].restored_text == "".join(f"{token(2)}-" if i % 64 == 2 else f"v{i % 64}-" for i in range(3000))
