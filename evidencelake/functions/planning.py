"""F: planning of questions by rule tables: intents, modality, complexity, budgets, sub-questions, rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidencelake.functions.text import first_rule, has_any, year_range
from evidencelake.operators.filters import either

#: Words that ask for images and for tables, and the weights they set (fixed values).
IMAGE_WORDS = ["图表", "figure", "chart", "图像", "示意图", "流程图", "diagram"]
TABLE_WORDS = ["表格", "table", "数据", "对比", "性能指标", "实验结果"]
MODALITY_WEIGHTS = {"default": (0.5, 0.3, 0.2), "image_weighted": (0.3, 0.6, 0.1), "table_weighted": (0.4, 0.1, 0.5)}
#: Intents by keyword, in order (fixed values).
INTENTS = [
    (["对比", "比较", "区别", "差异", "vs", "compare", "versus", "comparison", "不同", "相同", "优劣", "优缺点"], "compare"),
    (["演进", "发展", "演变", "历史", "evolution", "timeline", "进化", "进展", "历程"], "evolution"),
    (["总结", "摘要", "概述", "主要", "核心", "贡献", "归纳", "要点"], "summary"),
    (["method", "methodology", "approach", "technique", "方法", "方法论", "技术", "实现方法", "算法"], "method"),
    (["results", "findings", "outcomes", "data", "结果", "发现", "数据", "实验结果", "性能"], "results"),
    (["code", "implementation", "algorithm", "script", "代码", "实现", "算法", "源码", "开源"], "code"),
    (["references", "citations", "bibliography", "related", "参考文献", "引用", "相关工作", "文献"], "references"),
]
#: Patterns of complex and of simple questions; complex ones first (fixed values).
COMPLEX = ["比较.*差异", "比较.*分析", "对比.*不同", ".*的区别", ".*和.*的差异", ".*与.*对比", ".*和.*的比较", ".*论文.*比较", "演进.*历程", ".*发展历程", "版本演进", "从.*到.*的演进", ".*发展脉络", "这几篇.*论文", "多个论文.*", "多篇.*", "所有论文.*", "优缺点", "研究现状", "综述", "局限性", "改进建议", "未来.*方向"]
SIMPLE = ["什么是", "定义.*是", "解释.*的", "摘要.*论文", "总结这篇.*内容", "概括.*主要内容"]
#: Budgets by depth: papers, sections of a paper, dense chunks, pool, reranked (fixed values).
DEPTHS = {"shallow": (6, 3, 24, 24, 8), "medium": (10, 4, 40, 40, 12), "deep": (16, 6, 72, 72, 20)}
DEFAULT_BUDGET = (12, 5, 120, 180, 10)
#: Section names of a page, in order (fixed values).
PAGE_SECTIONS = [("abstract", "Abstract"), ("introduction", "Introduction"), ("related work", "Related Work"), ("method|methods|methodology", "Methods"), ("experiments?|evaluation", "Experiments"), ("results?", "Results"), ("discussion", "Discussion"), ("conclusion", "Conclusion")]
#: What makes a chunk worth keeping (a fixed pattern).
HIGH_VALUE = r"(?i)\b(table|figure|fig\.?|ablation|benchmark|accuracy|recall|precision|f1|ndcg|mrr|\d+\.\d+|\d+%)\b"
#: Risk of tools; others are MEDIUM (fixed values).
TOOL_RISK = {"delete_paper": "CRITICAL", "execute_command": "CRITICAL", "upload_paper": "HIGH", "create_note": "MEDIUM", "update_note": "MEDIUM", "merge_documents": "MEDIUM", "external_search": "LOW", "rag_search": "LOW", "list_papers": "LOW", "read_paper": "LOW", "list_notes": "LOW", "read_note": "LOW", "extract_references": "LOW", "ask_user_confirmation": "LOW", "show_message": "LOW"}
#: Roles of sub-questions by family (fixed values).
ROLES = {
    "compare": ["method_a_result", "method_b_result", "metric_difference", "applicability_condition"], "evolution": ["version_stages", "key_changes", "trend_summary"],
    "survey": ["topic_overview", "method_clusters", "benchmark_summary"], "critique": ["author_stated_limitations", "experimental_boundaries", "failure_modes"], "limitation": ["author_stated_limitations", "experimental_boundaries", "failure_modes"],
}
#: Words that a weak first pass adds, by family (fixed values).
REWRITES = {"numeric": "metric value table", "compare": "metric value table", "survey": "overview summary benchmark", "figure": "figure caption visualization", "table": "table row column metric"}


def _low(q: Column) -> Column:
    return F.lower(F.coalesce(q, F.lit("")))


#: Phrases that ask for an intent where none of its words does; matched without case (fixed values).
INTENT_PATTERNS = {
    "compare": [r"(.+)和(.+)的(区别|差异|对比)", r"比较(.+)与(.+)", r"(.+)\s+vs\s+(.+)", r"(.+)和(.+)哪个(更好|更优)"],
    "evolution": [r"从(.+)到(.+)的(发展|演进|演变)", r"(.+)的(演进过程|发展历程)", r"(.+)的发展历史"],
    "summary": [r"总结(一下)?(.+)", r"(.+)的(主要贡献|核心思想)", r"(概述|简介)(.+)"],
    "method": [r"(how does|explain the) (method|methodology|approach)", r"what (method|approach|technique)", r"(.+)的(方法|方法论)", r"(method|methodology|approach) (of|for|section)"],
    "results": [r"(what are|show) (the )?(results|findings|outcomes)", r"(.+)的(结果|发现)", r"(results|findings) (of|from)"],
    "code": [r"(show|give me) (the )?code", r"(implementation|code) (details|for)", r"(.+)的(代码|实现)"],
    "references": [r"(list|show) (references|citations)", r"(.+)的参考文献", r"(references|citations|bibliography) (of|for)", r"related work"],
}


def detect_intent(q: Column) -> Column:
    """F-4: the first intent of which a word is in the question or else a pattern fits it; ``question`` if none."""
    raw = F.coalesce(q, F.lit(""))
    return first_rule([(either([has_any(_low(q), w), *(raw.rlike(f"(?i){p}") for p in INTENT_PATTERNS.get(n, []))]), n) for w, n in INTENTS], "question")


def metadata_filters(q: Column, this_year: int) -> Column:
    """F-15: ``year_from, year_to, author, keywords`` that a question asks for; each null if it does not.

    Years: "2023年", "2020-2023", "最近3年" (up to ``this_year``), else those of ``year_range``. The author: after "author:", or a name before 的.
    """
    t = F.coalesce(q, F.lit(""))
    get = lambda p, i=1: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    one, two, last = r"(\d{4})年", r"(\d{4})-(\d{4})", r"最近(\d+)年"
    other = year_range(q)
    years = lambda i: F.coalesce(get(one).cast("int"), get(two, i).cast("int"), F.when(t.rlike(last), this_year - (get(last).cast("int") if i == 1 else 0)), other["year_from" if i == 1 else "year_to"])
    author = F.coalesce(get(r"author[:\s]+([A-Za-z\x{4e00}-\x{9fa5}]+)"), get(r"(?:^|年|\s)([\x{4e00}-\x{9fa5}]{2,3})的"), get(r"([A-Z][a-z]+(?:[A-Z][a-z]+)?)的"))
    return F.struct(years(1).alias("year_from"), years(2).alias("year_to"), author.alias("author"), F.coalesce(F.nullif(F.trim(get("关于(.+)的")), F.lit("")), F.nullif(F.trim(get("(.+)相关")), F.lit(""))).alias("keywords"))


def detect_modality(q: Column) -> Column:
    """F-5: preset that a question asks for."""
    return first_rule([(has_any(_low(q), IMAGE_WORDS), "image_weighted"), (has_any(_low(q), TABLE_WORDS), "table_weighted")], "default")


def modality_weights(modality: Column) -> Column:
    """F-5: weights ``text, image, table`` of a preset."""
    table = F.create_map(*[x for m, (t, i, b) in MODALITY_WEIGHTS.items() for x in (F.lit(m), F.struct(F.lit(t).alias("text"), F.lit(i).alias("image"), F.lit(b).alias("table")))])
    return table[modality]


def complexity(q: Column) -> Column:
    """F-6: complex, simple or default; the first 1000 characters count."""
    head = F.substring(F.trim(F.coalesce(q, F.lit(""))), 1, 1000)
    return first_rule([(either(head.rlike(p) for p in COMPLEX), "complex"), (either(head.rlike(p) for p in SIMPLE), "simple")], "default")


def query_plan(questions: DataFrame, family: str = "family", depth: str = "depth") -> DataFrame:
    """F-7: budgets of each question by family, the depth's where one is set."""
    names = ["paper_top_k", "section_top_k", "dense_top_k", "pool_max", "rerank_top_k"]
    table = F.create_map(*[x for d, v in DEPTHS.items() for x in (F.lit(d), F.array(*[F.lit(n) for n in v]))])
    chosen = F.coalesce(table[F.lower(F.col(depth))], F.array(*[F.lit(n) for n in DEFAULT_BUDGET]))
    wide = F.col(family).isin("compare", "cross_paper", "survey", "related_work", "method_evolution", "conflicting_evidence")
    extra = {"graph_top_k": F.when(wide, 80).otherwise(50), "caption_top_k": F.when(F.col(family).isin("table", "figure"), 80).otherwise(50), "numeric_top_k": F.when(F.col(family) == "numeric", 80).otherwise(50), "lexical_top_k": F.lit(120)}
    return questions.withColumn("__b", chosen).withColumns({**{n: F.get("__b", F.lit(i)) for i, n in enumerate(names)}, **extra}).drop("__b")


def sub_questions(questions: DataFrame) -> DataFrame:
    """F-9: one row for each role of the family: ``query_id, role, sub_question``; others look the fact up."""
    roles = F.create_map(*[x for f, r in ROLES.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in r]))])
    each = questions.select("query_id", "question", F.explode(F.coalesce(roles[F.col("family")], F.array(F.lit("fact_lookup")))).alias("role"))
    text = F.when(F.col("role") == "fact_lookup", F.trim("question")).otherwise(F.concat(F.replace("role", F.lit("_"), F.lit(" ")), F.lit(" for: "), F.trim("question")))
    return each.select("query_id", "role", text.alias("sub_question"))


def rewrites(question: Column, family: Column) -> Column:
    """F-9: up to three rewrites for a weak first pass."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    table = F.create_map(*[F.lit(x) for kv in REWRITES.items() for x in kv])
    made = F.array(F.concat(q, F.lit(" evidence results methods")), F.concat(q, F.lit(" experiments ablation")), F.concat(q, F.lit(" "), table[family]))
    return F.slice(F.array_compact(made), 1, 3)


def entity_hints(q: Column) -> Column:
    """F-9: method-like and dataset-like names (five each), metrics and objects named in a question."""
    raw = F.coalesce(q, F.lit(""))
    names = lambda p: F.slice(F.array_distinct(F.slice(F.regexp_extract_all(raw, F.lit(p), 1), 1, 5)), 1, 5)
    words = lambda ws: F.array_compact(F.array(*[F.when(_low(q).contains(w), F.lit(w)) for w in ws]))
    return F.struct(
        names(r"\b([A-Z][A-Za-z0-9\-]{2,})\b").alias("methods"), names(r"\b([A-Z]{2,}(?:-[0-9]{2,})?)\b").alias("datasets"),
        words(["accuracy", "f1", "auc", "precision", "recall", "bleu", "rouge"]).alias("metrics"), words(["method", "result", "table", "figure", "ablation", "baseline"]).alias("objects"),
    )


def paper_ids_in(q: Column, pattern: str = r"\b(\d{4}\.\d{4,5}(?:v\d+)?)\b") -> Column:
    """F-16: paper ids named in a question."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(q, F.lit("")), F.lit(pattern), 1))


def page_section(text: Column, page: Column) -> Column:
    """F-32: section named in a page's first 2000 characters; early pages are introductions, the rest body."""
    head = F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 2000)
    return first_rule([(head.rlike(rf"\b({p})\b"), s) for p, s in PAGE_SECTIONS] + [(page <= 2, "Introduction")], "Body")


def high_value(text: Column) -> Column:
    """F-33: whether a chunk names tables, measures or decimal numbers."""
    return F.coalesce(text.rlike(HIGH_VALUE), F.lit(False))


def tool_risk(tool: Column) -> Column:
    """F-36: a tool's risk level."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TOOL_RISK.items() for x in kv])[tool], F.lit("MEDIUM"))


def confidence_level(mode: Column, degraded: Column, unsupported: Column, fallback: Column, recovered: Column) -> Column:
    """F-41: low, medium or high confidence of an answer."""
    return first_rule([
        (mode == "abstain", "low-confidence"), (fallback & ~recovered, "low-confidence"), ((unsupported > 0) & (mode != "full"), "low-confidence"), (mode == "partial", "medium-confidence"), (degraded | (unsupported > 0) | fallback, "medium-confidence"),
    ], "high-confidence")


def special_boundary(text: Column) -> Column:
    """F-20: whether a text begins a numbered item, a definition-like block or an equation."""
    return F.coalesce(text.rlike(r"(?i)^\s*(?:\d+[.)]\s|theorem\b|lemma\b|definition\b|algorithm\b|\$\$|\\begin\{)"), F.lit(False))


def has_equations(text: Column) -> Column:
    """F-20: whether a text has formula marks."""
    return F.coalesce(text.rlike(r"\$[^$]+\$|\\(?:frac|sum|int|begin\{equation\})|[=≈≤≥]\s*[-\d\\]"), F.lit(False))


def reranker_document(title: Column, section: Column, kind: Column, text: Column, compact: bool = False) -> Column:
    """F-25: the text a reranker sees."""
    if compact:
        return F.concat_ws(" | ", title, section, text)
    return F.concat_ws("\n", F.concat(F.lit("title: "), title), F.concat(F.lit("section: "), section), F.concat(F.lit("type: "), kind), F.concat(F.lit("text: "), text))


def contextual_text(title: Column, section: Column, page: Column, content: Column, most: int = 3000) -> Column:
    """F-18: a chunk with its title, section and page in brackets in front, cut to ``most`` characters; missing parts are left out."""
    part = lambda n, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"[{n}: "), c.cast("string"), F.lit("]")))
    return F.substring(F.concat_ws(" ", part("Title", title), part("Section", section), part("Page", page), content), 1, most)


#: Index tiers of each query family in order of priority: tier, content types, section hint, factor of k (fixed values).
ROUTES = {
    "fact": [("local_evidence", [], None, 1.0), ("structural", [], None, 1.0)],
    "compare": [("structural", [], None, 1.5), ("local_evidence", [], None, 1.0)],
    "numeric": [("local_evidence", ["table", "text"], "Results", 1.0), ("structural", [], None, 1.0)],
    "table": [("local_evidence", ["table"], None, 1.0), ("local_evidence", ["text"], None, 1.0)],
    "figure": [("local_evidence", ["image"], None, 1.0), ("local_evidence", ["text"], None, 1.0)],
    "survey": [("summary", [], None, 2.0), ("local_evidence", [], None, 1.0)],
    "evolution": [("summary", [], None, 2.0), ("structural", [], None, 1.0), ("local_evidence", [], None, 1.0)],
    "limitation": [("local_evidence", [], "Discussion", 1.0), ("structural", [], None, 1.0)],
    "critique": [("local_evidence", [], None, 1.0), ("structural", [], None, 1.0)],
}
#: Families whose answers also take citation hints (fixed values).
HINTED = ("fact", "compare", "survey", "evolution", "limitation")


def route_index(queries: DataFrame, force: str | None = None) -> DataFrame:
    """F-8: ``query_id, family, index_type, priority, content_types, section_hint, k_factor, citation_hints``: one row for each index to ask.

    Unknown and null families ask the local evidence only; ``force`` names the one index to ask instead, without hints.
    """

    def row(i: int, tier: str, types: list[str], section: str | None, factor: float) -> Column:
        kinds = F.array(*[F.lit(t) for t in types]).cast("array<string>")
        return F.struct(F.lit(tier).alias("index_type"), F.lit(i).alias("priority"), kinds.alias("content_types"), F.lit(section).cast("string").alias("section_hint"), F.lit(factor).alias("k_factor"))

    table = lambda routes: F.array(*[row(i + 1, *r) for i, r in enumerate(routes)])
    default = table([(force or "local_evidence", [], None, 1.0)])
    known = default if force else F.coalesce(F.create_map(*[x for f, r in ROUTES.items() for x in (F.lit(f), table(r))])[F.col("family")], default)
    hints = F.lit(False) if force else F.coalesce(F.col("family").isin(*HINTED), F.lit(False))
    return queries.select("query_id", "family", F.explode(known).alias("r"), hints.alias("citation_hints")).select("query_id", "family", "r.*", "citation_hints")


#: Task family, execution mode, depth, model policy, kernel and review of each query family (fixed values).
TASKS = {
    "fact": ("single_paper_fact", "local_evidence", "shallow", "flash", "local_kernel", "citation_first"),
    "numeric": ("single_paper_fact", "local_evidence", "shallow", "flash", "local_kernel", "citation_first"),
    "method": ("single_paper_method", "local_evidence", "medium", "flash", "local_kernel", "citation_first"),
    "table": ("single_paper_table_figure", "local_evidence", "medium", "flash", "local_kernel", "citation_first"),
    "figure": ("single_paper_table_figure", "local_evidence", "medium", "flash", "local_kernel", "citation_first"),
    "compare": ("compare", "local_compare", "medium", "pro", "dual_kernel", "matrix_first"),
    "cross_paper": ("cross_paper", "global_review", "deep", "pro", "global_kernel", "storm_lite"),
    "survey": ("survey", "global_review", "deep", "pro", "global_kernel", "storm_lite"),
    "related_work": ("related_work", "global_review", "deep", "pro", "global_kernel", "storm_lite"),
    "method_evolution": ("cross_paper", "global_review", "deep", "pro", "global_kernel", "storm_lite"),
    "conflicting_evidence": ("conflicting_evidence", "global_review", "deep", "pro", "global_kernel", "storm_lite"),
    "hard": ("hard", "global_review", "deep", "pro", "global_kernel", "storm_lite"),
}
#: Families whose answers are checked for truth whatever their execution mode (fixed values).
CHECKED = ("fact", "method", "numeric", "conflicting_evidence", "hard")
VERIFIER = "rarr_cove_scifact_lite"


def route_task(queries: DataFrame) -> DataFrame:
    """F-38: how the questions ``query_id, family[, claim_repair]`` are to be worked on: task family, mode, depth, policies and checks.

    Families that the table lacks, and null ones, go as facts. A claim repair keeps the task family and fixes all else.
    """
    names = ("task_family", "execution_mode", "depth", "model_policy", "kernel_scope", "review_strategy")
    row = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])
    family = F.when(F.col("family").isin(*TASKS), F.col("family")).otherwise("fact")
    repair = F.coalesce(F.col("claim_repair"), F.lit(False)) if "claim_repair" in queries.columns else F.lit(False)
    r = queries.select("query_id", family.alias("family"), F.create_map(*[x for f, v in TASKS.items() for x in (F.lit(f), row(v))])[family].alias("t"), repair.alias("repair"))
    fixed = {"execution_mode": "truthfulness_repair", "depth": "focused", "model_policy": "flash", "kernel_scope": "truthfulness_kernel", "review_strategy": "repair_loop"}
    columns = [F.when(F.col("repair"), fixed[n]).otherwise(F.col(f"t.{n}")).alias(n) if n in fixed else F.col(f"t.{n}").alias(n) for n in names]
    out = r.select("query_id", "family", *columns, "repair")
    wide = F.col("execution_mode") == "global_review"
    policy = F.when(F.col("repair"), "focused_claim_repair").when(F.col("depth").isin("medium", "deep"), "adaptive_depth").otherwise("fixed_depth")
    checked = F.col("repair") | wide | (F.col("execution_mode") == "local_compare") | F.col("family").isin(*CHECKED)
    return out.withColumns({"routing_policy": policy, "truthfulness_required": checked, "global_synthesis": wide, "verifier": F.lit(VERIFIER)}).drop("repair")
