"""Dimension tables of the issue contract. The values are fixed by the format."""

from __future__ import annotations

SOURCES = ("thesis", "citation")
CATEGORIES = (
    "structure", "argumentation", "literature-review", "empirical", "legal-norms",
    "language", "policy", "academic-integrity", "citation-format", "citation-missing-info",
)
SUBSTANTIVE = ("argumentation", "empirical", "literature-review", "legal-norms", "academic-integrity")
SEVERITIES = ("fatal", "major", "minor")
SEVERITY_RANK = {"fatal": 0, "major": 1, "minor": 2}
SEVERITY_WEIGHT = {"fatal": 3.0, "major": 2.0, "minor": 1.0}
SEVERITY_LABEL = {"fatal": "致命", "major": "重要", "minor": "轻微"}
SCOPES = ("document", "chapter", "paragraph", "sentence", "span")
#: Tags that say what an issue's evidence is.
EVIDENCE = ("联网核实", "原文核对", "文本分析", "OOXML分析", "实质性硬伤", "元层评估", "规则依据")

#: Labels in report entries.
CATEGORY_LABEL = {
    "structure": "结构逻辑", "argumentation": "论证严谨性", "literature-review": "文献综述", "empirical": "实证分析", "legal-norms": "规范适用",
    "language": "语言表达", "policy": "政策建议", "academic-integrity": "学术诚信", "citation-format": "引注格式", "citation-missing-info": "引注缺失",
}
#: Labels in comments.
COMMENT_LABEL = {
    "structure": "结构", "argumentation": "论证深度", "literature-review": "文献综述", "empirical": "实证", "legal-norms": "规范适用",
    "language": "语言", "policy": "对策", "academic-integrity": "学术不端线索", "citation-format": "引注格式", "citation-missing-info": "引注信息",
}
ENTRY_LABEL = {"fatal": "❌ 致命", "major": "⚠️ 严重", "minor": "💡 轻微"}
