"""G: structure and summaries of documents, many papers at once."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evidencelake.functions.planning import has_equations, special_boundary

#: Heading patterns and their section, in order (fixed values).
IMRAD = [
    (r"(?i)^\s*(?:\d+\.?\s*)?abstract\b", "abstract"), (r"(?i)^\s*(?:\d+\.?\s*)?introduction\b", "introduction"), (r"(?i)^\s*(?:\d+\.?\s*)?(?:related work|background)\b", "related_work"),
    (r"(?i)^\s*(?:\d+\.?\s*)?(?:methods?|methodology|approach)\b", "methods"), (r"(?i)^\s*(?:\d+\.?\s*)?(?:results?|experiments?|evaluation|experimental setup)\b", "results"),
    (r"(?i)^\s*(?:\d+\.?\s*)?discussion\b", "discussion"), (r"(?i)^\s*(?:\d+\.?\s*)?(?:conclusions?|future work)\b", "conclusion"),
]


def imrad_header(text: Column) -> Column:
    """F-21: section that a short line heads; null if it is no heading."""
    c = F.when(F.length(text) > 120, None)
    for p, s in IMRAD:
        c = c.when(text.rlike(p), s)
    return c


def imrad(items: DataFrame) -> DataFrame:
    """G-6: items ``paper_id, pos, page_num, text`` to sections ``paper_id, section, words, page_start, page_end, confidence``.

    A heading holds until the next one; items before the first are ``front``. Papers without any heading are
    cut by position into four parts at n/4, n/2 and 3n/4 with confidence 0.3.
    """
    by = Window.partitionBy("paper_id")
    marked = items.withColumn("head", imrad_header(F.col("text")))
    run = F.last("head", ignorenulls=True).over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    n, i = F.count("*").over(by), F.row_number().over(by.orderBy("pos")) - 1
    marked = marked.withColumns({"run": run, "any": F.max(F.col("head").isNotNull()).over(by), "n": n, "i": i})
    quarter = F.when(F.col("i") < F.greatest(F.lit(1), F.floor(F.col("n") / 4)), "introduction").when(F.col("i") < F.floor(F.col("n") / 2), "methods").when(F.col("i") < F.floor(F.col("n") * 3 / 4), "results").otherwise("conclusion")
    section = F.when(F.col("any"), F.coalesce("run", F.lit("front"))).otherwise(quarter)
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return marked.withColumns({"section": section, "w": words}).groupBy("paper_id", "section").agg(F.sum("w").alias("words"), F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), F.max(F.when(F.col("any"), 0.9).otherwise(0.3)).alias("confidence"))


#: Rows that a fold over papers gives out at once.
FOLD_ROWS = 4096


def fold_papers(rows: DataFrame, fold: Callable[[list[tuple]], list[dict]], kinds: str) -> DataFrame:
    """``fold`` of each paper's rows, in order of ``pos``, without a call to Python for each paper: papers lie one after another in sorted partitions.

    ``fold`` has a paper's rows as tuples in the columns' order and gives dicts of ``kinds``; ``paper_id`` is put before them.
    """
    schema = StructType.fromDDL(f"paper_id {dict(rows.dtypes)['paper_id']}, {kinds}")
    at, arrow = rows.columns.index("paper_id"), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        each = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        for paper, own in itertools.groupby(each, lambda r: r[at]):
            out += [{"paper_id": paper, **x} for x in fold(list(own))]
            if len(out) >= FOLD_ROWS:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.repartition("paper_id").sortWithinPartitions("paper_id", F.col("pos").asc_nulls_last()).mapInArrow(run, schema)


def fold_chunks(items: DataFrame, size: int = 500) -> DataFrame:
    """G-2: items of a paper packed in order into chunks: ``paper_id, chunk_no, text, first_pos, last_pos, section, page_start, page_end, media``.

    ``items``: ``paper_id, pos, text`` and, where the paper has them, ``type`` (text, table or picture; text without the column), ``page``, ``bbox`` and ``section`` (a
    chunk's is that of its first paragraph). A paragraph joins the chunk before it with an empty line between, unless that is longer than
    ``size`` characters already. Tables and pictures belong to the chunk at whose end they stand, as ``media(type, page, bbox, text)``; those after which no paragraph begins
    a first chunk are left out. Empty paragraphs add nothing. A fold over one paper's items, which are few; papers run in parallel.
    """
    have = set(items.columns)
    column = lambda c, kind, other=None: (F.col(c) if c in have else F.lit(other)).cast(kind).alias(c)
    rows = items.select("paper_id", "pos", "text", column("type", "string", "text"), column("page", "int"), column("bbox", "string"), column("section", "string"))

    def fold(own: list[tuple]) -> list[dict]:
        made: list[dict] = []
        waiting: list[dict] = []
        for _, pos, text, kind, page, bbox, section in own:
            text = text or ""
            if kind in ("table", "picture"):
                (made[-1]["media"] if made else waiting).append({"type": kind, "page": page, "bbox": bbox, "text": text if kind == "table" else None})
                continue
            text = text.strip()
            if kind != "text" or not text:
                continue
            if made and len(made[-1]["text"]) <= size:
                last = made[-1]
                last["text"] += "\n\n" + text
                last["last_pos"] = pos
                if page:
                    last.update(page_start=last["page_start"] or page, page_end=page)
            else:
                made.append({"chunk_no": len(made), "text": text, "first_pos": pos, "last_pos": pos, "section": section, "page_start": page, "page_end": page, "media": waiting})
                waiting = []
        return made

    kinds = "chunk_no int, text string, first_pos long, last_pos long, section string, page_start int, page_end int, media array<struct<type: string, page: int, bbox: string, text: string>>"
    return fold_papers(rows, fold, kinds)


def fold_documents(docs: DataFrame, size: int = 500) -> DataFrame:
    """G-2 for documents ``doc_id, text`` that are one row each: text and places of the chunks of ``fold_chunks`` over their lines, folded in the row, without a shuffle.

    ``paper_id`` is the document's id. Null and blank texts give no chunk; repeated rows give their chunks each.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(F.trim(x).alias("t"), i.cast("long").alias("p"))), lambda x: x.t != "")
    chunk = "text string, first_pos bigint, last_pos bigint"
    start = F.from_json(F.lit('{"done": []}'), f"done array<struct<{chunk.replace(' ', ':').replace(',:', ', ')}>>, parts array<string>, first bigint, last bigint, length int")
    closed = lambda a: F.array_append(a.done, F.struct(F.array_join(a.parts, "\n\n").alias("text"), a["first"].alias("first_pos"), a["last"].alias("last_pos")))

    def step(a: Column, x: Column) -> Column:
        n = F.length(x.t)
        full = a.parts.isNotNull() & (a.length > size)
        fresh = a.parts.isNull() | full
        return F.struct(
            F.when(full, closed(a)).otherwise(a.done).alias("done"), F.when(fresh, F.array(x.t)).otherwise(F.array_append(a.parts, x.t)).alias("parts"), F.when(fresh, x.p).otherwise(a["first"]).alias("first"),
            x.p.alias("last"), F.when(fresh, n).otherwise(a.length + 2 + n).alias("length"),
        )

    folded = F.aggregate(lines, start, step, lambda a: F.when(a.parts.isNull(), a.done).otherwise(closed(a)))
    return docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(folded).alias("chunk_no", "c")).select("paper_id", "chunk_no", "c.*")


#: How much longer or shorter than the target the chunks of a section may be on average (fixed values).
SECTION_SHARE = {"introduction": 1.3, "methods": 1.0, "results": 1.1, "discussion": 1.4, "conclusion": 0.8, "abstract": 0.9}


def words_of(text: Column) -> Column:
    """How many blank-separated words a text has."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def chunk_quality(chunks: DataFrame, target: int = 500, most: int = 600) -> DataFrame:
    """G-4: for each paper 0.3 size match + 0.2 evenness + 0.25 boundaries + 0.25 coherence of its chunks ``paper_id, section, content``, by words.

    Evenness falls with the variance (100, 300, 500); a block that should not be cut and is over 1.2 times ``most`` costs 0.1 of the boundaries;
    coherence is 0.8 and 0.05 more for each section of several chunks whose mean is within a fifth of its own target, 1 at most.
    """
    sized = chunks.select("paper_id", F.coalesce("section", F.lit("unknown")).alias("section"), words_of(F.col("content")).alias("w"), special_boundary(F.col("content")).alias("special"))
    table = F.create_map(*[F.lit(x) for kv in SECTION_SHARE.items() for x in kv])
    own = F.floor(target * F.coalesce(table[F.lower("section")], F.lit(1.0)))
    parts = sized.groupBy("paper_id", "section").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.count_if(F.col("special") & (F.col("w") > most * 1.2)).alias("cut"))
    near = (F.col("n") > 1) & (F.abs(F.col("w") / F.col("n") - own) / own < 0.2)
    one = parts.groupBy("paper_id").agg(F.sum("n").alias("chunks"), (F.sum("w") / F.sum("n")).alias("mean"), (F.sum("ww") / F.sum("n")).alias("square"), F.sum("cut").alias("cut"), F.count_if(near).alias("near"))
    match = F.greatest(F.lit(0.0), 1 - F.abs(F.col("mean") - target) / target)
    variance = F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))
    even = F.when(variance < 100, 1.0).when(variance < 300, 0.7).when(variance < 500, 0.4).otherwise(0.1)
    boundary, coherence = F.greatest(F.lit(0.0), 1 - 0.1 * F.col("cut")), F.least(F.lit(1.0), 0.8 + 0.05 * F.col("near"))
    return one.select("paper_id", "chunks", "mean", variance.alias("variance"), boundary.alias("boundary"), coherence.alias("coherence"), (0.3 * match + 0.2 * even + 0.25 * boundary + 0.25 * coherence).alias("quality"))


def chunk_semantic(items: DataFrame, size: int | None = None, overlap: int = 100, least: int = 100, most: int = 600) -> DataFrame:
    """G-3: items ``paper_id, pos, page_num, section, text`` to chunks ``paper_id, chunk_no, section, page_start, page_end, start, end, words, overlap, equations, figures, special, text``.

    Each item keeps its place within its page (``start``, ``end``: lengths of the items before it), its marks and its section's size (500 words
    without a section, or ``size`` for all). In order of ``pos`` an item of fewer than half of ``least`` words joins the chunk before it while that is
    shorter than the item's size, both together have ``most`` words or fewer and neither is a block that should not be cut; a later
    section's name holds. Then each chunk but the first begins with the last ``overlap`` words of the one before. Items without a word are left
    out. The fold runs over one paper's items, papers in parallel.
    """
    t = F.col("text")
    adaptive = F.lit(size) if size is not None else F.when(F.coalesce("section", F.lit("")) != "", section_params(F.col("section"))["size"]).otherwise(500)
    span = F.length(t) + 1
    before = F.sum(span).over(Window.partitionBy("paper_id", "page_num").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - span
    low = F.lower(t)
    marked = items.where(words_of(t) > 0).select(
        "paper_id", "pos", "page_num", F.coalesce("section", F.lit("")).alias("section"), "text", words_of(t).alias("words"), adaptive.cast("int").alias("size"), before.alias("start"), (before + F.length(t)).alias("end"),
        has_equations(t).alias("equations"), (low.contains("figure") | low.contains("table")).alias("figures"), special_boundary(t).alias("special"),
    )
    columns, names = marked.columns, ["chunk_no", "section", "page_start", "page_end", "start", "end", "words", "overlap", "equations", "figures", "special", "text"]

    def fold(own: list[tuple]) -> list[dict]:
        made: list[dict] = []
        for x in (dict(zip(columns, row)) for row in own):
            last = made[-1] if made else None
            joins = last and last["words"] < x["size"] and x["words"] < least * 0.5 and last["words"] + x["words"] <= most and not last["special"] and not x["special"]
            if joins:
                last.update(text=last["text"] + "\n\n" + x["text"], words=last["words"] + x["words"], page_end=x["page_num"], end=max(last["end"], x["end"]), section=x["section"] or last["section"])
            else:
                made.append({**x, "page_start": x["page_num"], "page_end": x["page_num"], "overlap": 0})
        for n, x in enumerate(made):
            x["chunk_no"] = n
            if n and overlap:
                x.update(text=" ".join(made[n - 1]["text"].split()[-overlap:]) + "\n\n" + x["text"], overlap=overlap)
            x["words"] = len(x["text"].split())
        return [{c: x[c] for c in names} for x in made]

    kinds = "chunk_no int, section string, page_start int, page_end int, start long, end long, words int, overlap int, equations boolean, figures boolean, special boolean, text string"
    return fold_papers(marked, fold, kinds)


def section_summaries(chunks: DataFrame, n: int = 3, most: int = 200) -> DataFrame:
    """G-9, F-19: for each paper and section the first n texts (cut, repeats once) joined, and the chunk ids in order."""
    one = chunks.withColumn("head", F.substring("content", 1, most)).groupBy("paper_id", "section", "head").agg(F.min("pos").alias("pos"), F.min("chunk_id").alias("chunk_id"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "head", "chunk_id")))
    out = one.groupBy("paper_id", "section").agg(rows.alias("r"))
    return out.select("paper_id", "section", F.array_join(F.transform(F.slice("r", 1, n), lambda x: x.head), " ").alias("summary"), F.transform("r", lambda x: x.chunk_id).alias("chunk_ids"))


def average_linkage(unit: np.ndarray, cutoff: float) -> np.ndarray:
    """Labels of average-linkage clusters on cosine distance of unit vectors, all merges within ``cutoff``; numbered by their lowest rows.

    The mean distance between two clusters is 1 less the product of their mean vectors, so the sums of the clusters are all that is held. A chain
    of nearest neighbours merges whenever two are each other's nearest (the earlier in the chain, then the lower row on ties): that makes
    the same tree as always merging the nearest pair, in quadratic time and with memory for the vectors alone.
    """
    n = len(unit)
    sums, size, root = unit.astype(np.float64), np.ones(n), np.arange(n)
    alive, chain = np.ones(n, bool), []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            at = chain[-1]
            far = 1 - (sums @ sums[at]) / (size * size[at])
            far[~alive] = np.inf
            far[at] = np.inf
            near = int(np.argmin(far))
            if len(chain) > 1 and far[chain[-2]] <= far[near]:
                near = chain[-2]
                break
            chain.append(near)
        chain = chain[:-2]
        lo, hi = min(at, near), max(at, near)
        if far[near] <= cutoff:
            root[hi] = lo
        sums[lo] += sums[hi]
        size[lo] += size[hi]
        alive[hi] = False
    for i in range(n):  # a row's root lies below it
        root[i] = root[root[i]]
    return np.unique(root, return_inverse=True)[1]


def silhouette(unit: np.ndarray, labels: np.ndarray) -> float:
    """The mean silhouette by cosine distance; a row alone in its cluster counts 0, and so does a single cluster."""
    k = int(labels.max()) + 1
    if k < 2:
        return 0.0
    sums, size = np.zeros((k, unit.shape[1])), np.bincount(labels)
    np.add.at(sums, labels, unit)
    total = size - unit @ sums.T  # the distances of each row to all of each cluster, its own self as 1 - |row| squared
    own = np.arange(len(unit)), labels
    inside = (total[own] - (1 - (unit * unit).sum(axis=1))) / np.maximum(size[labels] - 1, 1)
    mean = total / size
    mean[own] = np.inf
    outside = mean.min(axis=1)
    score = np.divide(outside - inside, np.maximum(inside, outside), out=np.zeros(len(unit)), where=np.maximum(inside, outside) > 0)
    return float(np.where(size[labels] > 1, score, 0.0).mean())


def _units(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A group's vectors, and the same of length 1; zeros stay zeros."""
    m = np.array(pdf["embedding"].tolist(), np.float64)
    return m, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def page_clusters(vectors: DataFrame, by: str, cutoff: float = 0.8) -> DataFrame:
    """G-12: average-linkage clusters within each group: ``by, vec_id, cluster``; fewer than three are one cluster.

    Groups are a query's pages or a paper's chunks: the work of one is quadratic, its memory that of its vectors.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        labels = average_linkage(_units(pdf)[1], cutoff) if len(pdf) >= 3 else np.zeros(len(pdf), int)
        return pd.DataFrame({by: pdf[by], "vec_id": pdf["vec_id"], "cluster": labels.astype("int32")})

    return vectors.select(by, "vec_id", "embedding").groupBy(by).applyInPandas(run, f"{by} long, vec_id long, cluster int")


#: A cluster of chunks is cut further if it has more than FEW of them and the cut's silhouette is at least CLEAR (fixed values).
FEW, CLEAR = 5, 0.3


def raptor_tree(vectors: DataFrame, cutoff: float = 0.5, depth: int = 3, tighter: float = 1.0, few: int = FEW, clear: float = CLEAR) -> DataFrame:
    """G-11: a tree of centroids for each paper: ``paper_id, level, node, parent, embedding``; level 0 are the chunks, whose parent is the lowest node over them.

    Chunks are clustered by average linkage, and each cluster is a node of level 1; clusters of a cluster are of level 2, and so on while the level is below
    ``depth``, each at ``tighter`` times the cutoff above it (at 1, the average linkage of a cluster is one cluster again). Nothing is cut that has ``few`` chunks or fewer, or that
    falls into one cluster or into single chunks only, or whose cut has a silhouette below ``clear``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        paper = pdf["paper_id"].iloc[0]
        m, unit = _units(pdf)
        parents: list[str | None] = [None] * len(m)
        nodes, todo = [], [(1, np.arange(len(m)), None, cutoff)]
        while todo:
            level, rows, above, within = todo.pop(0)
            if level >= depth or len(rows) <= max(few, 2):
                continue
            labels = average_linkage(unit[rows], within)
            if not 1 < labels.max() + 1 < len(rows) or silhouette(unit[rows], labels) < clear:
                continue
            for k in range(labels.max() + 1):
                name, inside = f"n{level}_{sum(x[1] == level for x in nodes)}", rows[labels == k]
                nodes.append((paper, level, name, above, m[inside].mean(axis=0).tolist()))
                for i in inside.tolist():
                    parents[i] = name
                todo.append((level + 1, inside, name, within * tighter))
        leaves = [(paper, 0, f"c{i}", up, v.tolist()) for i, up, v in zip(pdf["vec_id"], parents, m)]
        return pd.DataFrame([*leaves, *nodes], columns=["paper_id", "level", "node", "parent", "embedding"])

    return vectors.select("paper_id", "vec_id", "embedding").groupBy("paper_id").applyInPandas(run, "paper_id long, level int, node string, parent string, embedding array<double>")


def reading_card(chunks: DataFrame, slots: dict[str, str]) -> DataFrame:
    """E-24: for each paper and slot the first chunk (page, then longest) whose section matches the slot's pattern."""
    each = chunks.select("paper_id", "chunk_id", "page_num", F.length("content").alias("n"), F.explode(F.array_compact(F.array(*[F.when(F.lower("section").rlike(p), s) for s, p in slots.items()]))).alias("slot"))
    w = Window.partitionBy("paper_id", "slot").orderBy("page_num", F.desc("n"), "chunk_id")
    return each.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("paper_id", "slot", "chunk_id")


def table_rows(tables: DataFrame) -> DataFrame:
    """F-23: pipe tables ``table_id, markdown`` to ``table_id, row_no, cells`` (a map from header to cell)."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = F.filter(F.split("markdown", "\n"), lambda x: x.contains("|") & ~x.rlike(r"^[\s|:-]+$"))
    rows = tables.select("table_id", F.posexplode(lines).alias("row_no", "line"), cells(F.get(lines, F.lit(0))).alias("head")).where("row_no > 0")
    width = F.least(F.size("head"), F.size(cells(F.col("line"))))
    return rows.select("table_id", "row_no", F.map_from_arrays(F.slice("head", F.lit(1), width), F.slice(cells(F.col("line")), F.lit(1), width)).alias("cells"))



#: Chunk size and overlap by section (fixed values).
SECTION_PARAMS = {"introduction": (1000, 120), "methods": (800, 150), "results": (650, 100), "discussion": (900, 120), "conclusion": (900, 120), "abstract": (400, 50)}


def section_params(section: Column) -> Column:
    """G-7: ``size, overlap`` for a section; 500 and 100 for others."""
    pair = lambda a, b: F.struct(F.lit(a).alias("size"), F.lit(b).alias("overlap"))
    table = F.create_map(*[x for s, (a, b) in SECTION_PARAMS.items() for x in (F.lit(s), pair(a, b))])
    return F.coalesce(table[F.lower(section)], pair(500, 100))


#: Patterns of the sections a chunk can be assigned to, in order (fixed values).
SECTION_PATTERNS = {
    "introduction": [
        r"^\s*introduction$", r"^\s*background$", r"^\s*引言$", r"^\s*简介$", r"^\s*背景$", r"^\s*前言$", r"^\s*绪论$", r"^\s*1\.?\s*introduction", r"^\s*i\.?\s*introduction", r"^\s*1[\.\s]引言", r"^\s*一[\.、\s]",
        r"introduction and background", r"^\s*研究背景", r"^\s*overview", r"^\s*motivation", r"^\s*related work", r"^\s*literature review",
    ],
    "methods": [
        r"^\s*methods?$", r"^\s*methodology$", r"^\s*方法$", r"^\s*研究方法$", r"^\s*实验方法$", r"^\s*方法论$", r"^\s*2\.?\s*methods?", r"^\s*ii\.?\s*methods?", r"^\s*2[\.\s]方法", r"^\s*二[\.、\s]",
        r"^\s*materials?\s*(and|&)\s*methods?", r"^\s*experimental\s*(setup|methods?)", r"^\s*材料与方法", r"^\s*实验设计", r"^\s*approach", r"^\s*experimental design",
    ],
    "results": [
        r"^\s*results?$", r"^\s*findings?$", r"^\s*结果$", r"^\s*实验结果$", r"^\s*研究发现$", r"^\s*研究结果$", r"^\s*3\.?\s*results?", r"^\s*iii\.?\s*results?", r"^\s*3[\.\s]结果", r"^\s*三[\.、\s]",
        r"results?\s*(and|&)\s*discussion", r"^\s*结果与分析", r"^\s*evaluation", r"^\s*experiments?", r"^\s*performance analysis", r"^\s*analysis",
    ],
    "conclusion": [
        r"^\s*conclusions?$", r"^\s*discussion$", r"^\s*总结$", r"^\s*讨论$", r"^\s*结论$", r"^\s*4\.?\s*(?:conclusions?|discussion)", r"^\s*iv\.?\s*(?:conclusions?|discussion)", r"^\s*4[\.\s]结论", r"^\s*四[\.、\s]",
        r"^\s*summary", r"^\s*concluding\s*remarks", r"^\s*结论与讨论", r"^\s*总结与展望", r"^\s*结论与展望", r"^\s*future work", r"^\s*limitations",
    ],
}
#: A section's page range counts from this confidence on; a heading has at most so many characters, and a chunk is searched for patterns in its first ones (fixed values).
SURE, HEADING, SEARCHED = 0.7, 50, 100


def section_by_pattern(text: Column, at_start: bool) -> Column:
    """The first of SECTION_PATTERNS that lower-case ``text`` matches, at its start or anywhere; null if none."""
    c = F.when(text.isNull(), None)
    for section, patterns in SECTION_PATTERNS.items():
        any_of = "|".join(f"(?:{p})" for p in patterns)
        c = c.when(text.rlike(f"^(?:{any_of})" if at_start else any_of), section)
    return c


def heading_section(text: Column) -> Column:
    """The section that a short text heads: by the word after its number, else by its beginning."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    word = F.nullif(F.regexp_extract(t, r"^[0-9]+[.\s]*([a-z]+)", 1), F.lit(""))
    return F.when(F.length(t) <= HEADING, F.coalesce(section_by_pattern(word, False), section_by_pattern(t, True)))


def assign_sections(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """G-5: ``chunks(paper_id, chunk_id, page_num, text)`` with ``section`` and ``by``, the step that found it.

    In this order: the heading that the chunk is, the first span of its paper with its page in range (from 0, to 999 where unknown) and a confidence of SURE or more, the
    first span of which an anchor occurs in the text, case aside, and a pattern in the text's beginning; else an empty section by ``none``. ``spans``: ``paper_id, ord,
    section, page_start, page_end, confidence, anchors``; a paper's spans travel to its chunks once, as one array. A null or zero page is in no range, an empty
    anchor is in every text, and a null one in none.
    """
    span = F.struct("ord", "section", F.coalesce("page_start", F.lit(0)).alias("a"), F.coalesce("page_end", F.lit(999)).alias("b"), F.coalesce("confidence", F.lit(0.5)).alias("sure"), F.transform("anchors", F.lower).alias("anchors"))
    per_paper = spans.groupBy("paper_id").agg(F.sort_array(F.collect_list(span)).alias("__spans"))
    low, page = F.lower(F.coalesce("text", F.lit(""))), F.col("page_num")
    first = lambda test: F.get(F.filter("__spans", test), F.lit(0))["section"]
    steps = {
        "heading": heading_section(F.col("text")),
        "page": F.when(page != 0, first(lambda s: page.between(s["a"], s["b"]) & (s["sure"] >= SURE))),
        "anchor": first(lambda s: F.exists(s["anchors"], lambda a: F.coalesce(F.contains(low, a), F.lit(False)))),
        "pattern": section_by_pattern(F.substring(low, 1, SEARCHED), False),
    }
    joined = chunks.join(per_paper, "paper_id", "left")
    found = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(c.alias("section"), F.lit(n).alias("by"))) for n, c in steps.items()]))
    one = F.coalesce(F.get(found, F.lit(0)), F.struct(F.lit("").alias("section"), F.lit("none").alias("by")))
    keep = [c for c in chunks.columns if c not in ("section", "by")]
    return joined.withColumn("__one", one).select(*keep, F.col("__one.section").alias("section"), F.col("__one.by").alias("by"))


def chunk_by_section(items: DataFrame) -> DataFrame:
    """G-3: items ``paper_id, pos, text, section`` cut into windows of their section's size and overlap: ``paper_id, section, chunk_no, start, content``.

    The items of a section follow each other in order, with a line feed between; offsets are within the section. A section's text is never
    held whole: running lengths give each item its place, and an item goes to the windows that it reaches into, in parts.
    """
    by = Window.partitionBy("paper_id", "section").orderBy("pos", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = items.where("text is not null").select("paper_id", "section", "pos", "text")
    total = known.groupBy(F.col("paper_id").alias("p0"), F.col("section").alias("s0")).agg((F.sum(F.length("text") + 1) - 1).alias("total"))
    placed = known.withColumn("at", F.sum(F.length("text") + 1).over(by) - F.length("text") - 1)
    same = F.col("paper_id").eqNullSafe(F.col("p0")) & F.col("section").eqNullSafe(F.col("s0"))
    whole = placed.join(total, same).drop("p0", "s0").withColumn("text", F.when(F.col("at") + F.length("text") < F.col("total"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    p = section_params(F.col("section"))
    sized = whole.where("length(text) > 0").select("paper_id", "section", "at", "text", "total", p["size"].cast("long").alias("size"), p["overlap"].cast("long").alias("overlap")).withColumn("step", F.col("size") - F.col("overlap"))
    zero = F.lit(0).cast("long")
    first = F.greatest(F.floor((F.col("at") - F.col("size")) / F.col("step")) + 1, zero)
    last = F.least(F.floor((F.col("at") + F.length("text") - 1) / F.col("step")), F.floor(F.greatest(F.col("total") - F.col("overlap") - 1, zero) / F.col("step")))
    reached = sized.withColumns({"first": first, "last": last}).where("first <= last").withColumn("n", F.explode(F.sequence("first", "last")))
    begin = F.col("n") * F.col("step") - F.col("at")  # of the window, within the item
    part = F.col("text").substr((F.greatest(begin, zero) + 1).cast("int"), (begin + F.col("size") - F.greatest(begin, zero)).cast("int"))
    parts = reached.groupBy("paper_id", "section", F.col("n").cast("int").alias("chunk_no"), (F.col("n") * F.col("step")).cast("int").alias("start")).agg(F.sort_array(F.collect_list(F.struct("at", part.alias("part")))).alias("parts"))
    return parts.select("paper_id", "section", "chunk_no", "start", F.trim(F.array_join(F.transform("parts", lambda x: x.part), "")).alias("content")).where("content <> ''")


def section_index(chunks: DataFrame) -> DataFrame:
    """A-7: a row for each section of a paper: ``section_id, paper_id, section, title, summary, key_terms, chunk_ids, table_ids, figure_ids``.

    The summary joins the heads (200 characters) of the first five anchors, or of the first three texts where no chunk has an
    anchor, and is cut at 1200; the lists are those of an index card: 20 terms, 50 chunks, 10 tables, 10 figures. ``chunks``: ``paper_id,
    chunk_id, section, pos, content_type, anchor, content``; a null section is ``unknown``.
    """
    section = F.coalesce(F.when(F.col("section") != "", F.col("section")), F.lit("unknown"))
    when = lambda c, v: F.when(c, v)
    in_order = lambda v: F.transform(F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct("pos", "chunk_id", v.alias("v"))))), lambda x: x.v)
    anchor, text = when(F.col("anchor") != "", F.substring("anchor", 1, 200)), F.substring(F.coalesce("content", F.lit("")), 1, 200)
    cid = F.col("chunk_id")
    one = chunks.withColumn("section", section).groupBy("paper_id", "section").agg(
        in_order(anchor).alias("anchors"), in_order(text).alias("texts"), in_order(cid).alias("ids"),
        in_order(when(F.col("content_type") == "table", cid)).alias("tables"), in_order(when(F.col("content_type").isin("figure", "caption"), cid)).alias("figures"),
    )
    summary = F.when(F.size("anchors") > 0, F.array_join(F.slice("anchors", 1, 5), " ")).otherwise(F.array_join(F.slice("texts", 1, 3), " "))
    words = F.translate("section", "_/", "  ")
    terms = F.slice(F.filter(F.split(words, r"\s+"), lambda w: F.length(w) > 2), 1, 20)
    return one.select(
        F.concat(F.col("paper_id").cast("string"), F.lit("::"), "section").alias("section_id"), "paper_id", "section", F.initcap(F.translate("section", "_", " ")).alias("title"), F.substring(summary, 1, 1200).alias("summary"),
        terms.alias("key_terms"), F.slice("ids", 1, 50).alias("chunk_ids"), F.slice("tables", 1, 10).alias("table_ids"), F.slice("figures", 1, 10).alias("figure_ids"),
    )


def write_summary_index(papers: DataFrame, chunks: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """A-7: the paper summaries ``papers`` and the section index of ``chunks`` as Parquet below ``path``, read back: what a summary search loads."""
    papers.write.mode("overwrite").parquet(f"{path}/papers")
    section_index(chunks).write.mode("overwrite").parquet(f"{path}/sections")
    spark = chunks.sparkSession
    return spark.read.parquet(f"{path}/papers"), spark.read.parquet(f"{path}/sections")
