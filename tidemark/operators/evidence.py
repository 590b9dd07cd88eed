"""From results to context, prompts and parsed answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X

# Wording of citations, warnings, prompts, refusals and section names.
SEPARATOR = "\n\n---\n\n"
CITATION = "【来源：%s 第 %s 页】"
NO_SOURCE, NO_PAGE = "未知来源", "未知页码"
WARNING = "【检索置信度低】最佳片段相似度仅 %.4f，低于 %s，以下内容可能与问题无关，请勿据此编造结论。\n\n"
REFUSAL = "抱歉，知识库中未找到相关信息。请尝试更具体的查询。"
QUERY_FORMAT = "通道 %s 出现 %s 异常：%s"
SHAPE_LABELS = {
    "intermittent_spikes": "间歇性尖峰（孤立脉冲）",
    "high_freq_jitter": "持续高频抖动",
    "low_activity": "低活动/近静止",
    "unusual_shapes": "其他异常形态",
}
COMPARISON_LABELS = {"similar": "相似点", "different": "差异点", "evolution": "发展演变"}
GENERAL_PROMPT = """请对以下遥测异常进行诊断。

【异常信息】
{query}

【参考知识片段】
{context}

请严格按照系统提示中的7段结构输出诊断结论。"""
ANOMALY_PROMPT = """请对以下遥测异常进行诊断。

【异常信息】
- 通道: {channel_id}
- 异常类型: {anomaly_type}
- 异常描述: {anomaly_description}{extra}

【参考知识片段】
{context}

请严格按照系统提示中的结构输出诊断结论。"""
EXTRA_PART = """

【补充信息】
{lines}"""
COMPARISON_PROMPT = """对比分析：{query}

参考知识:
{context}

要求：列出{label}，最多3点，每点一行，每点≤30字，禁止废话。"""
SIMPLIFIED_PROMPT = """请对以下遥测异常进行诊断。

{lines}
参考知识:
{context}

按【通道定位】【异常类型】【可能原因】【影响评估】【建议措施】【紧急程度】【来源】结构输出。"""
MISSING_FIELD = "未提供"
UNKNOWN_DOCUMENT, UNKNOWN_PAGE, UNKNOWN_TYPE = "未知文献", "?", "未知"
SECTIONS = {
    "通道定位": ["通道定位", "传感器定位", "通道说明", "异常通道分析", "异常通道定位", "异常通道物理含义分析", "通道标识"],
    "异常类型": ["异常类型", "异常分类", "异常类型判断", "异常类型分析", "异常类型与可能原因"],
    "可能原因": ["可能原因", "原因分析", "异常原因", "潜在原因", "异常原因推断", "异常原因分析", "基于知识的可能原因"],
    "影响评估": ["影响评估", "影响分析", "潜在影响", "影响范围", "补充说明", "局限性说明", "知识局限性", "知识充分性", "知识依据", "知识缺口", "信息充足"],
    "结论": ["结论", "诊断结论", "总结"],
    "建议措施": ["建议措施", "排查建议", "处理建议", "应对措施", "建议后续操作", "诊断总结与建议", "建议"],
    "紧急程度": ["紧急程度", "严重程度", "优先级"],
    "来源": ["来源", "知识来源", "参考来源"],
}
SECTION_ORDER = ["可能原因", "影响评估", "结论", "建议措施", "来源"]
URGENCY = {"低": "low", "中": "medium", "高": "high", "紧急": "critical"}
FAILURES = ["RAG解释生成失败", "检索失败", "生成失败", "RAG 查询失败", "查询过程中出现错误", "RAG引擎初始化失败"]
UI_FAILURES = FAILURES + ["抱歉，查询过程中出现错误"]
MARKERS = ["【通道定位】", "【异常类型】", "【可能原因】", "【影响评估】", "【建议措施】", "【紧急程度】", "【来源】"]
KEY_MARKERS = ["【来源】", "【紧急程度】", "【建议措施】"]


def pack_context(results: DataFrame, budget: float = 2000.0, floor: float = 0.45) -> DataFrame:
    """One context per query: pieces in rank order up to the first that overflows the budget, each with its citation.

    Results: ``query_id, rank, content, score[, filename, page, low_confidence]``.
    """
    for c in ("filename", "page"):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast("string"))
    if "low_confidence" not in results.columns:
        results = results.withColumn("low_confidence", F.lit(False))
    q = W.partitionBy("query_id")
    best = F.max("score").over(q)
    warning = F.when(F.col("low_confidence"), F.format_string(WARNING, best, F.lit(str(floor))))
    rows = results.withColumn("_warning", warning).withColumn("_cost", X.token_cost(F.col("content")))
    spent = F.coalesce(X.token_cost(F.col("_warning")), F.lit(0.0)) + F.sum("_cost").over(
        q.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_fits", spent <= budget).withColumn(
        "_open", F.every("_fits").over(q.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    cite = F.format_string(CITATION, F.coalesce("filename", F.lit(NO_SOURCE)), F.coalesce(F.col("page").cast("string"), F.lit(NO_PAGE)))
    piece = F.when(F.col("_open"), F.concat(F.col("content"), F.lit("\n"), cite))
    packed = rows.groupBy("query_id").agg(
        F.max("_warning").alias("_w"), F.sort_array(F.collect_list(F.struct("rank", piece.alias("piece")))).alias("_p"),
        F.count_if("_open").alias("pieces"))
    kept = F.filter(F.transform("_p", lambda p: p["piece"]), lambda p: p.isNotNull())
    whole = F.concat(F.when(F.col("_w").isNotNull(), F.array("_w")).otherwise(F.array().cast("array<string>")), kept)
    return packed.select("query_id", "pieces", F.array_join(whole, SEPARATOR).alias("context"))


def context_from_sources(sources: Column) -> Column:
    """Numbered pieces from a stored array of source structs; empty ones keep their number but are left out."""
    numbered = F.transform(sources, lambda s, i: F.when(
        F.coalesce(s["content"], F.lit("")) != "", F.concat(F.lit("[片段"), (i + 1).cast("string"), F.lit("] "), s["content"])))
    return F.array_join(F.filter(numbered, lambda s: s.isNotNull()), "\n\n")


def query_text(channel: Column, shape: Column, description: Column) -> Column:
    return F.format_string(QUERY_FORMAT, channel, shape, description)


def general_format(x: Column, digits: int = 4) -> Column:
    """Shortest of fixed and scientific notation with that many significant digits."""
    sci = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    fixed = F.lit(None).cast("string")
    for e in range(-4, digits):
        fixed = F.when(exponent == e, F.format_string(f"%.{max(digits - 1 - e, 0)}f", x)).otherwise(fixed)
    def trim(s: Column) -> Column:
        return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    mantissa = trim(F.regexp_extract(sci, r"^(.*)e", 1))
    return F.coalesce(trim(fixed), F.concat(mantissa, F.regexp_extract(sci, r"(e[+-]\d+)$", 1)))


def describe_anomaly(label: Column, shape: Column, score: Column, summary: Column, threshold: float = 0.25) -> Column:
    """Description in words; features missing from the summary are left out."""
    name = shape
    for k, v in SHAPE_LABELS.items():
        name = F.when(shape == k, v).otherwise(name)
    def part(text: str, key: str, shown) -> Column:
        v = F.element_at(summary, F.lit(key))
        return F.when(v.isNotNull(), F.concat(F.lit(text + ": "), shown(v)))
    def places(n: int):
        return lambda v: F.format_string(f"%.{n}f", v)
    return F.concat_ws(
        "; ", F.format_string("检测到%s通道异常", label), F.format_string("异常类型: %s（%s）", shape, name),
        F.format_string("异常得分: %.2f (阈值%s)", score, F.lit(str(threshold))),
        part("均值", "mean", general_format), part("标准差", "std", general_format), part("峰度", "kurtosis", places(3)),
        part("峰值数", "n_peaks", places(1)), part("一阶差分峰数", "diff_peaks", places(1)))


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template's ``{name}`` fields from columns, NULL as an empty text; a field that nobody gives takes the fixed filler."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if i % 2 == 0 else _filled(values[x]) if x in values else F.lit(MISSING_FIELD) for i, x in enumerate(parts)])


def _lines(extra: Column) -> Column:
    return F.array_join(F.transform(extra, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")


def general_prompt(query: Column, context: Column) -> Column:
    return fill(GENERAL_PROMPT, {"query": query, "context": context})


def anomaly_prompt(channel: Column, shape: Column, description: Column, context: Column,
                   extra: Column | None = None) -> Column:
    """``extra``: array of ``name: value`` lines."""
    more = F.lit("") if extra is None else F.when(F.size(extra) > 0, fill(EXTRA_PART, {"lines": _lines(extra)})).otherwise("")
    return fill(ANOMALY_PROMPT, {"channel_id": channel, "anomaly_type": shape, "anomaly_description": description, "context": context, "extra": more})


def simplified_prompt(context: Column, extra: Column) -> Column:
    """What is asked when a template's fields are not at hand: the given ``name: value`` lines and the context."""
    return fill(SIMPLIFIED_PROMPT, {"lines": _lines(extra), "context": context})


def comparison_prompt(query: Column, context: Column, kind: str = "similar") -> Column:
    return fill(COMPARISON_PROMPT, {"query": query, "context": context, "label": F.lit(COMPARISON_LABELS.get(kind, "分析"))})


def citation(name: Column, page: Column) -> Column:
    return F.format_string("[%s p.%s]", name, page.cast("string"))


# ---- answers ------------------------------------------------------------------------------------

METRIC_HEADING = r"^\*\*\d*\.?\s*[^*]+\*\*\s*[:：]?$"


def _headings(line: Column) -> Column:
    """Canonical section names of a line, in order; none where it is no heading."""
    bare = X.strip(line)
    clean = F.replace(bare, F.lit("**"), F.lit(""))
    bold = F.rlike(bare, F.lit(r"^\*\*[^*]+\*\*\s*[:：]?")) & ~F.startswith(bare, F.lit("- ")) & ~F.startswith(bare, F.lit("* "))
    looks = (F.contains(bare, F.lit("【")) & F.contains(bare, F.lit("】"))) | F.rlike(bare, F.lit(r"^\*\*\d+\.\s")) | bold
    named = []
    for canonical, aliases in SECTIONS.items():
        hit = F.lit(False)
        for a in aliases:
            hit = hit | F.contains(clean, F.lit(a))
        named.append(F.when(hit, canonical))
    return F.when(looks, F.array_compact(F.array(*named))).otherwise(F.array().cast("array<string>"))


def _heading(line: Column) -> Column:
    """Canonical section name when the line is a heading, else NULL."""
    return F.get(_headings(line), F.lit(0))


def raw_sections(answers: DataFrame, key: str, text: str = "answer") -> DataFrame:
    """(key, section, body, metric): whole sections as they are written, headings included, and what stands before the first one as ``_header``.

    A heading line that names several sections gives its lines to the last of them and nothing to the others; a section that comes again
    replaces the earlier one. ``metric`` has the section's lines without empty ones and bold headings.
    """
    lines = F.split(text, "\n", -1)
    starts = F.flatten(F.transform(lines, lambda x, i: F.transform(_headings(x), lambda c: F.struct(i.alias("at"), c.alias("section")))))
    cut = answers.filter(F.length(text) > 0).select(key, lines.alias("_lines"), starts.alias("_starts"))
    first = F.coalesce(F.get("_starts", F.lit(0))["at"], F.lit(0))
    until = lambda k: F.coalesce(F.get("_starts", k + 1)["at"], F.size("_lines"))
    whole = F.transform("_starts", lambda s, k: F.struct(
        s["section"].alias("section"), X.strip(F.array_join(F.slice("_lines", s["at"] + 1, until(k) - s["at"]), "\n")).alias("body")))
    kept = F.filter(whole, lambda s, k: ~F.exists(F.slice("_starts", k + 2, F.size("_starts")), lambda t: t["section"] == s["section"]))
    header = X.strip(F.array_join(F.slice("_lines", F.lit(1), first), "\n"))
    every = F.concat(F.when(header != "", F.array(F.struct(F.lit("_header").alias("section"), header.alias("body")))).otherwise(
        F.array().cast("array<struct<section:string,body:string>>")), kept)
    found = cut.select(key, F.explode(every).alias("_s")).select(key, "_s.*")
    said = F.filter(F.transform(F.split("body", "\n", -1), X.strip), lambda x: (x != "") & ~F.rlike(x, F.lit(METRIC_HEADING)))
    return found.withColumn("metric", F.array_join(said, "\n"))


def parse_sections(answers: DataFrame, key: str, text: str = "answer") -> DataFrame:
    """(key, section, body): JSON objects first, else text under known headings.

    A heading that comes again replaces the earlier body. Comment and empty lines are dropped.
    """
    as_map = F.try_parse_json(F.col(text))
    flat = F.from_json(F.col(text), "map<string,string>")
    is_json = as_map.isNotNull() & F.rlike(F.col(text), F.lit(r"^\s*\{")) & flat.isNotNull()
    # One fold over the lines of an answer: what a heading has gathered is kept when the next one comes, if it is not empty.
    kind = "map<string,array<string>>"
    begin = F.struct(F.lit(None).cast("string").alias("at"), F.array().cast("array<string>").alias("body"), F.create_map().cast(kind).alias("done"))

    def close(s: Column) -> Column:
        put = F.map_concat(F.map_filter(s["done"], lambda k, _: k != s["at"]), F.create_map(F.coalesce(s["at"], F.lit("")), s["body"]))
        return F.when(s["at"].isNotNull() & (F.size(s["body"]) > 0), put).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        said = (X.strip(x["line"]) != "") & ~F.startswith(X.strip(x["line"]), F.lit("#"))
        return F.when(x["heading"].isNotNull(), F.struct(x["heading"].alias("at"), F.array().cast("array<string>").alias("body"), close(s).alias("done"))).otherwise(
            F.struct(s["at"].alias("at"), F.when(said & s["at"].isNotNull(), F.array_append(s["body"], x["line"])).otherwise(s["body"]).alias("body"), s["done"].alias("done")))

    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), _heading(x).alias("heading")))
    found = F.transform_values(F.aggregate(lines, begin, step, close), lambda _, body: X.strip(F.array_join(body, "\n")))
    rows = answers.select(key, F.when(is_json, flat).otherwise(found).alias("_found"))
    return rows.select(key, F.explode("_found").alias("section", "body"))


def garbled(text: Column) -> Column:
    """Failed generation, replacement characters, or mostly high characters that are not CJK."""
    failed = F.lit(False)
    for p in FAILURES:
        failed = failed | F.contains(text, F.lit(p))
    n = F.length(text)
    lost = (n - F.length(F.replace(text, F.lit("�"), F.lit("")))) * 2
    high = n - F.length(F.regexp_replace(text, r"[^\x{00}-\x{7f}\x{4e00}-\x{9fff}]", ""))
    return F.when(F.coalesce(n, F.lit(0)) == 0, False).otherwise(
        failed | (lost / n > 0.05) | ((n > 10) & (high / n > 0.3)))


def garbled_strict(text: Column) -> Column:
    """Variant of the display page: failures and replacement characters only, the latter counted three times when doubled."""
    failed = F.lit(False)
    for p in UI_FAILURES:
        failed = failed | F.contains(text, F.lit(p))
    n = F.length(text)
    single = n - F.length(F.replace(text, F.lit("�"), F.lit("")))
    double = (n - F.length(F.replace(text, F.lit("��"), F.lit("")))) / 2
    return F.when(F.coalesce(n, F.lit(0)) == 0, False).otherwise(failed | ((2 * single + double) / n > 0.05))


def diagnosis_detail(records: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Detail record: ordered sections, urgency and its level (medium by default).

    With ``answer``: whether it is garbled, in which case there are no sections and its raw text is empty. ``anomaly_score`` is rounded,
    ``anomaly_type`` and the entries of ``sources`` (filename, page, score) take their fixed fillers where they are missing.
    """
    named = sections.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("_all"))
    joined = records.join(named, key, "left")
    if "answer" in records.columns:
        joined = joined.withColumn("garbled", F.coalesce(garbled(F.col("answer")), F.lit(False))).withColumn(
            "_all", F.when(~F.col("garbled"), F.col("_all"))).withColumn("raw", F.when(F.col("garbled"), "").otherwise(F.coalesce("answer", F.lit("")))).drop("answer")
    if "anomaly_score" in records.columns:
        joined = joined.withColumn("anomaly_score", F.round("anomaly_score", 4))
    if "anomaly_type" in records.columns:
        joined = joined.withColumn("anomaly_type", F.coalesce("anomaly_type", F.lit(UNKNOWN_TYPE)))
    if "sources" in records.columns:
        joined = joined.withColumn("sources", F.transform(F.coalesce("sources", F.array()), lambda s: F.struct(
            F.coalesce(s["filename"], F.lit(UNKNOWN_DOCUMENT)).alias("filename"), F.coalesce(s["page"].cast("string"), F.lit(UNKNOWN_PAGE)).alias("page"), F.round(s["score"], 4).alias("score"))))
    urgency = F.coalesce(F.element_at("_all", F.lit("紧急程度")), F.lit("中"))
    level = F.lit("medium")
    for k, v in URGENCY.items():
        level = F.when(urgency == k, v).otherwise(level)
    order = F.array(*[F.lit(s) for s in SECTION_ORDER])
    shown = F.filter(F.transform(order, lambda s: F.struct(s.alias("section"), F.element_at("_all", s).alias("body"))),
                     lambda x: x["body"].isNotNull())
    return joined.withColumns({"urgency": urgency, "urgency_level": level, "shown_sections": shown}).drop("_all")


def marker_hits(text: Column) -> list[Column]:
    """Per answer: number of markers, of key markers, all seven, all three, failed."""
    def n(names: list[str]) -> Column:
        total = F.lit(0)
        for m in names:
            total = total + F.contains(text, F.lit(m)).cast("int")
        return total
    return [n(MARKERS).alias("n_markers"), n(KEY_MARKERS).alias("n_key_markers"), (n(MARKERS) == len(MARKERS)).alias("all_markers"),
            (n(KEY_MARKERS) == len(KEY_MARKERS)).alias("all_key_markers"),
            (F.startswith(text, F.lit("RAG")) | F.contains(text, F.lit("生成失败"))).alias("failed")]


def forbidden_claims(texts: DataFrame, key: str, text: str, patterns: dict[str, str], excuses: list[str]) -> DataFrame:
    """Lines that match a forbidden pattern and carry no correcting word."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    excused = F.lit(False)
    for e in excuses:
        excused = excused | F.contains(F.col("line"), F.lit(e))
    found = F.array_compact(F.array(*[F.when(F.rlike(F.col("line"), F.lit(p)), F.lit(reason)) for reason, p in patterns.items()]))
    return lines.filter(~excused).select(key, (F.col("line_no") + 1).alias("line_no"), F.explode(found).alias("reason"),
                                         F.substring(X.strip(F.col("line")), 1, 80).alias("line"))
