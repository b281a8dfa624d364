"""F: Column functions over texts, questions and sections. Rule tables are plain data, first hit wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Patterns of a citation and a number (fixed values).
CITATION = r"\[[^\[\],]+,\s*[^\[\]]+\]"
NUMBER = r"\d+(?:\.\d+)?%?"

#: Families of the router in order: patterns on the lower-case question that must all be found, family (fixed values).
TABLE_FIGURE = r"\b(table|tab\.|rows?|columns?|figure|fig\.|caption)\b"
SURVEY = r"\b(survey|literature review|related work)\b"
FAMILY_RULES = [
    ([r"\b(conflict|contradict|inconsistent|disagree)\b|争议|矛盾|冲突"], "conflicting_evidence"),
    ([SURVEY + "|综述|研究现状", r"related work"], "related_work"),
    ([SURVEY + "|综述|研究现状"], "survey"),
    ([r"\b(evolution|timeline|history)\b|发展脉络|演进"], "method_evolution"),
    ([r"\b(hard|open problem|why is .* difficult)\b|挑战|难点"], "hard"),
    ([TABLE_FIGURE, r"figure|fig\."], "figure"),
    ([TABLE_FIGURE, r"table|tab\."], "table"),
    ([r"\b(compare|versus|vs\.?|difference|better than|worse than)\b"], "compare"),
    ([r"\b(across papers|cross paper|cross-paper)\b"], "cross_paper"),
    ([r"\b(accuracy|f1|bleu|rouge|recall@|precision@|latency|p-value|percent|%)\b"], "numeric"),
    ([r"\b(method|approach|architecture|algorithm|pipeline)\b"], "method"),
]
#: Families of the planner in order: substrings, family (fixed values).
PLANNER_RULES = [
    (["compare", "vs", "versus", "difference", "对比", "比较"], "compare"),
    (["evolution", "timeline", "trend", "演化", "发展", "迭代"], "evolution"),
    (["survey", "overview", "综述", "总结", "review of"], "survey"),
    (["figure", "fig.", "图", "caption"], "figure"),
    (["table", "tab.", "表"], "table"),
    (["accuracy", "f1", "auc", "score", "数值", "指标", "%", "率"], "numeric"),
    (["limitation", "局限", "不足", "weakness", "boundary"], "limitation"),
    (["critique", "批判", "critic", "challenge", "failure mode"], "critique"),
]
#: Families of the decomposer in order (fixed values).
DECOMPOSER_RULES = [
    (["figure", "fig.", "图", "caption"], "figure"),
    (["table", "tab.", "表格", "表"], "table"),
    (["accuracy", "f1", "auc", "score", "数值", "指标", "%"], "numeric"),
    (["limitation", "boundary", "局限", "限制"], "limitation"),
    (["critique", "weakness", "failure mode", "批判", "不足"], "critique"),
    (["evolution", "timeline", "progress", "development", "history", "versions", "from v", "v1", "v2", "v3", "v4", "generations", "iterations", "improvements over time"], "evolution"),
    (["compare", "contrast", "difference", "similarities", "vs", "versus", "between", "among", "across papers"], "compare"),
]
#: Kinds of claim in order (fixed values).
CLAIM_RULES = [
    (["compared", "better", "worse", "than", "outperform"], "comparative"),
    (["%", "score", "accuracy", "f1", "auc", "bleu", "rouge"], "numeric"),
    (["because", "due to", "leads to", "causes", "therefore"], "causal"),
    (["limitation", "fails", "weak", "challenging", "failure"], "limitation"),
]
#: Section names and what they stand for (fixed values).
SECTIONS = ("abstract", "introduction", "related_work", "method", "experiment", "result", "discussion", "conclusion", "limitation", "appendix")
SECTION_ALIASES = {
    "background": "introduction", "preliminaries": "introduction", "related work": "related_work", "literature review": "related_work", "methodology": "method",
    "approach": "method", "model": "method", "methods": "method", "experimental setup": "experiment", "evaluation": "experiment", "experiments": "experiment",
    "findings": "result", "results": "result", "analysis": "discussion", "future work": "limitation", "limitations": "limitation", "ablation": "experiment",
    "implementation details": "method", "conclusions": "conclusion", "supplementary": "appendix",
}


def first_rule(tests: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    start = F.when(tests[0][0], tests[0][1])
    return reduce(lambda c, t: c.when(*t), tests[1:], start).otherwise(otherwise)


def has_any(col: Column, words: list[str]) -> Column:
    """Whether a text contains any of some substrings."""
    return reduce(lambda a, b: a | b, (col.contains(w) for w in words))


def infer_query_family(q: Column) -> Column:
    """F-1: family of a question."""
    low = F.lower(F.coalesce(q, F.lit("")))
    return first_rule([(reduce(lambda a, b: a & b, [low.rlike(p) for p in ps]), f) for ps, f in FAMILY_RULES], "fact")


#: Families of the planner that an intent stands for (fixed values).
INTENT_FAMILIES = {"compare": "compare", "evolution": "evolution", "summary": "survey"}


def planner_family(q: Column, intent: Column | None = None) -> Column:
    """F-2: the planner's family; an ``intent`` counts as a word of its family."""
    low = F.lower(F.coalesce(q, F.lit("")))
    meant = F.lower(F.coalesce(intent, F.lit(""))) if intent is not None else F.lit("")
    named = {f: i for i, f in INTENT_FAMILIES.items()}
    return first_rule([(has_any(low, w) | (meant == named[f] if f in named else F.lit(False)), f) for w, f in PLANNER_RULES], "fact")


def decomposer_family(q: Column) -> Column:
    """F-3: the decomposer's family."""
    low = F.lower(F.coalesce(q, F.lit("")))
    return first_rule([(has_any(low, w), f) for w, f in DECOMPOSER_RULES], "fact")


def claim_type(claim: Column) -> Column:
    """H-1: kind of a claim."""
    return claim_type_of(F.lower(F.coalesce(claim, F.lit(""))))


def claim_type_of(low: Column) -> Column:
    """H-1: kind of a claim in lower case: a column of its own is lowered once, not for each word."""
    return first_rule([(has_any(low, w), f) for w, f in CLAIM_RULES], "factual")


def canonical_section(name: Column) -> Column:
    """F-13: canonical name of a section label: numbering off, aliases, else the longest alias inside it, else itself."""
    key = F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("_"), F.lit(" ")), r"^[\d.\-\s]+", ""), r"\s+", " ")
    exact = {s.replace("_", " "): s for s in SECTIONS} | SECTION_ALIASES
    by_length = sorted(SECTION_ALIASES.items(), key=lambda kv: -len(kv[0]))
    table = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])
    inside = first_rule([(key.contains(a), c) for a, c in by_length], "")
    return F.when(key == "", "").otherwise(F.coalesce(table[key], F.when(inside != "", inside), F.replace(key, F.lit(" "), F.lit("_"))))


def normalize_section_path(path: Column) -> Column:
    """F-13: canonical path of a raw one; separators ``/ > \\ | ::``; equal neighbours once."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), r"\s*(?:/|>|\\|\||::)\s*"), lambda s: F.trim(s) != "")
    names = F.filter(F.transform(parts, canonical_section), lambda s: s != "")
    kept = F.filter(names, lambda s, i: (i == 0) | (s != F.get(names, F.greatest(i - 1, F.lit(0)))))
    return F.array_join(kept, "/")


def section_leaf(path: Column) -> Column:
    """F-13: last part of a canonical path."""
    return F.substring_index(path, "/", -1)


def section_parent(path: Column) -> Column:
    """F-13: a canonical path without its last part."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stable_chunk_id(paper: Column, page: Column, section: Column, start: Column, end: Column) -> Column:
    """F-14: a chunk's id from where it stands."""
    parts = [F.coalesce(c.cast("string"), F.lit(d)) for c, d in ((paper, ""), (page, "0"), (section, ""), (start, "0"), (end, "0"))]
    return F.concat(F.lit("chunk_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 24))


def year_range(q: Column) -> Column:
    """F-15: ``year_from, year_to`` that a question names: "2019 to 2021", "since/after 2018", "before/until 2020", "in 2020"."""
    low = F.lower(F.coalesce(q, F.lit("")))
    year = r"((?:19|20)\d\d)"
    get = lambda p, i=1: F.when(low.rlike(p), F.regexp_extract(low, p, i)).cast("int")
    both = rf"{year}\s*(?:-|–|to|and)\s*{year}"
    since, until, only = rf"\b(?:since|after|from)\s+{year}", rf"\b(?:before|until|up to)\s+{year}", rf"\bin\s+{year}\b"
    return F.struct(F.coalesce(get(both), get(since), get(only)).alias("year_from"), F.coalesce(get(both, 2), get(until), get(only)).alias("year_to"))


def citations(text: Column) -> Column:
    """F-27: all ``[title, section]`` citations."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CITATION})"), 1)


def citation_density(text: Column) -> Column:
    """F-27: citations for each blank-separated word."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.when(words > 0, F.size(citations(text)) / words).otherwise(0.0)


def sentences(text: Column) -> Column:
    """Sentences: split after final marks and white space, trimmed, empties out."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s(?<=[。！？.!?]\s)\s*")  # the mark is looked for at white space only
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def tokens3(text: Column) -> Column:
    """Distinct lower-case tokens of three letters, digits or underscores at least."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]{3,})"), 1))


def unsupported_rate(text: Column) -> Column:
    """F-28: share of sentences without a citation."""
    s = sentences(text)
    return F.when(F.size(s) > 0, F.size(F.filter(s, lambda x: ~x.rlike(CITATION))) / F.size(s)).otherwise(0.0)


#: What names metrics, datasets (acronyms) and methods in a text, and refers to figures and tables (fixed values).
METRIC_NAME = r"(?i)\b(?:accuracy|f1|precision|recall|bleu|rouge|auc|ndcg|mrr|map|perplexity|score|ap@\d+|hit@\d+|recall@\d+)\b"
DATASET_NAME = r"\b[A-Z]{2,}(?:-[0-9A-Z]+)?(?:\d{2,4})?\b"
METHOD_NAME = r"\b[A-Z][A-Za-z0-9\-]{2,}(?:\s[A-Z][A-Za-z0-9\-]{2,})?\b"
FIGURE_NUMBER, TABLE_NUMBER = r"(?i)\b(?:figure|fig\.?)\s*(\d+)\b", r"(?i)\btable\s*(\d+)\b"


def hints(text: Column) -> Column:
    """F-17: the first three metrics, datasets and methods that a text names, and its first two figure and table references."""
    t = F.coalesce(text, F.lit(""))
    found = lambda p: F.regexp_extract_all(t, F.lit(f"({p})"), 1)
    first = lambda names, least: F.slice(F.array_distinct(F.filter(names, lambda x: F.length(x) >= least)), 1, 3)
    numbers = lambda p, label: F.transform(F.slice(F.regexp_extract_all(t, F.lit(p), 1), 1, 2), lambda x: F.concat(F.lit(label), x))
    return F.struct(
        first(F.transform(found(METRIC_NAME), lambda x: F.lower(x)), 1).alias("metrics"), first(found(DATASET_NAME), 3).alias("datasets"), first(found(METHOD_NAME), 4).alias("methods"),
        numbers(FIGURE_NUMBER, "Fig.").alias("figures"), numbers(TABLE_NUMBER, "Table ").alias("tables"),
    )


def citation_jump_url(paper: Column, chunk: Column, page: Column) -> Column:
    """F-26: where a citation leads."""
    return F.format_string("/read/%s?page=%s&source=evidence&source_id=%s", paper.cast("string"), page.cast("string"), chunk.cast("string"))


def source_type(ref: Column) -> Column:
    """F-35: what a reference string names: doi, arxiv, s2, pdf_url, url or unknown."""
    t = F.trim(F.coalesce(ref, F.lit("")))
    return first_rule([
        (t.rlike(r"(?i)^(?:doi:|https?://(?:dx\.)?doi\.org/)?10\.\d{4,9}/\S+$"), "doi"), (t.rlike(r"(?i)^(?:arxiv:|https?://arxiv\.org/(?:abs|pdf)/)?\d{4}\.\d{4,5}(?:v\d+)?(?:\.pdf)?$"), "arxiv"),
        (t.rlike(r"^(?:https?://www\.semanticscholar\.org/paper/\S*?)?[0-9a-f]{40}$"), "s2"), (t.rlike(r"(?i)^https?://\S+\.pdf(?:[?#]\S*)?$"), "pdf_url"), (t.rlike(r"(?i)^https?://\S+$"), "url"),
    ], "unknown")


def page_lines(text: Column) -> Column:
    """F-31: a page without blank, short, numeric, preprint-stamp and often repeated (more than three times) lines, blanks collapsed."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    good = F.filter(lines, lambda x: (F.length(x) > 2) & ~x.rlike(r"^[\d.\s]+$") & ~x.rlike(r"(?i)^arxiv:"))
    return F.array_join(F.filter(good, lambda x: F.size(F.filter(good, lambda y: y == x)) <= 3), "\n")


def chinese(text: Column) -> Column:
    """Whether a text has a CJK character."""
    return F.coalesce(text, F.lit("")).rlike(r"[\x{4e00}-\x{9fff}]")


def rounded(c: Column, places: int) -> Column:
    """A double as the nearest multiple of 10^-places, scaled first, as DuckDB and C round; Spark's ``round`` goes by the decimal digits instead, which differs for halves."""
    scale = float(10**places)
    return F.round(c * scale, 0) / scale


def cosine(a: Column, b: Column) -> Column:
    """F-34: cosine of two vectors; 0 for unequal lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """F-34: Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
