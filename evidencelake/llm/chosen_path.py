"""Operator 3: n-gram Jaccard self join by chosen paths.

Texts are sets of hashed 5-word shingles; equal sets are one class of copies and take part
once. In each of a number of runs a set draws shingles with a hash that all sets share, so that
each set of n draws 1 / (0.8 n) of its shingles: sets of similarity 0.8 or more draw one in
common with probability 1 - 1/e or more, and a second one within that choice in the same way; the two
are a bucket. Buckets of more than LIMIT sets are split again on shingles drawn within the bucket,
down to MAX_DEPTH levels. ``runs_for`` repeats the runs until a pair at exactly the similarity shares a bucket
with the probability RECALL even where all levels were needed.

Small buckets are brute-forced on parity bitmaps, whose differing bits never exceed the sets'
symmetric difference, so no true pair is lost. What is still larger than LIMIT is
compared block by block, whole. The surviving pairs' connected sets are verified exactly,
again in blocks; tasks give a row for each set and block, never a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidencelake.operators.components import connected_components
from evidencelake.llm.workers import tidied
from evidencelake.scratch import broadcast_if_small, join_per_key, materialize

NGRAM, SIMILARITY = 5, 0.8
#: Least chance that a pair at exactly the similarity shares a bucket of the last level; more similar pairs have more.
RECALL = 0.9994
MAX_DEPTH, LIMIT, BLOCK = 4, 2048, 512
BITMAP = 1024
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SETS = "doc_id long, set_key binary, sid long, n long, bitmap binary, nodes array<long>"
MAX_BROADCAST_IDS, BATCH_ROWS, DRAWN_AT_ONCE = 1_000_000, 1024, 1 << 18


def runs_for(recall: float, depth: int = MAX_DEPTH) -> int:
    """Runs after which the chance that a pair at the similarity shares a bucket at ``depth`` is ``recall``.

    Such a pair draws at least one common shingle at each level on average (Poisson), so the chance that some chain of
    common draws reaches a level follows from the level above as for a branching process. The similarity itself sets the rate
    of the draws, not the runs.
    """
    reach = 1.0
    for _ in range(depth):
        reach = 1 - math.exp(-reach)
    return math.ceil(math.log(1 - recall) / math.log(1 - reach))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    return (x ^ (x >> np.uint64(27))) * ODD ^ (x >> np.uint64(31))


def shingle_set(text: str | None, ngram: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams (lower case, words between ASCII white space).

    Fewer words than ``ngram`` make one shingle of them all; no word makes none.
    """
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(ngram, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total = mix(total + hashes[i : len(words) - width + 1 + i] + ODD)
    return np.unique(total)


def draw(shingles: np.ndarray, parents: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The child buckets of each parent: index of the parent, and the child's id."""
    most = min(1.0, 1.0 / (similarity * len(shingles)))
    limit = np.uint64(min(int(most * 2**64), 2**64 - 1))
    step, rows, kept = max(1, DRAWN_AT_ONCE // max(1, len(shingles))), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a in range(0, len(parents), step):  # a few parents at a time: very long texts have many shingles
        drawn = mix(shingles[None, :] ^ parents[a : a + step, None])
        row, column = np.nonzero(drawn <= limit)
        rows.append(row + a)
        kept.append(drawn[row, column])
    row = np.concatenate(rows)
    return row, mix(np.concatenate(kept) + parents[row] * ODD)


def parity(shingles: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of shingles falls in b."""
    return np.packbits((np.bincount((shingles & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8)).tobytes()


def set_ids(shingles: np.ndarray) -> tuple[bytes, int]:
    """The key that equal sets share, and a 64-bit id from it."""
    key = xxhash.xxh3_128_digest(shingles.tobytes())
    return key, int.from_bytes(key[:8], "little", signed=True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows for the plans made and run inside: rows with a whole set are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _again(ngram: int) -> Callable:
    """``text, sid, ...`` to ``shingles, sid, ...`` of the rows whose set is ``sid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = [shingle_set(t, ngram) for t in part.column(0).to_pylist()]
                good = [i for i, (s, sid) in enumerate(zip(made, part.column(1).to_pylist())) if set_ids(s)[1] == sid]
                at = pa.array(good, pa.int64())
                rest = [c.take(at) for c in part.columns[1:]]
                yield pa.record_batch([pa.array([made[i].tobytes() for i in good], pa.binary()), *rest], names=["shingles", *part.schema.names[1:]])

    return run


def shingles_of(rows: DataFrame, needed: DataFrame, ngram: int) -> DataFrame:
    """``needed(sid, rep, ...)`` with ``shingles``, made again from the texts: sets are never stored.

    Needed rows that are few by count go to the texts; more of them and the texts are shuffled by id.
    """
    names = [c for c in needed.columns if c != "sid"]
    ids = broadcast_if_small(needed, MAX_BROADCAST_IDS)
    kinds = ", ".join(f"{c} long" for c in names)
    both = rows.withColumnRenamed("doc_id", "rep").join(ids, "rep")
    return both.select("text", "sid", *[F.col(c).cast("long").alias(c) for c in names]).mapInArrow(tidied(_again(ngram)), f"shingles binary, sid long, {kinds}")


def _sets(ngram: int, similarity: float, runs: int) -> Callable:
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * ODD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                columns: list[list] = [[] for _ in range(5)]
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, ngram)
                    key, sid = set_ids(s)
                    nodes = draw(s, draw(s, roots, similarity)[1], similarity)[1] if len(s) else s
                    for c, v in zip(columns, (key, sid, len(s), parity(s), nodes.astype(np.int64))):
                        c.append(v)
                types = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "set_key", "sid", "n", "bitmap", "nodes"])

    return run


def _split(similarity: float) -> Callable:
    """``node, sid, rep, shingles`` to the child buckets ``node, sid, rep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for node, sid, rep, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for child in draw(np.frombuffer(data, np.uint64), np.array([node], np.int64).view(np.uint64), similarity)[1].view(np.int64).tolist():
                    for c, v in zip(out, (child, sid, rep)):
                        c.append(v)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["node", "sid", "rep"])

    return run


def _counted(members: DataFrame) -> DataFrame:
    """Members of buckets of two or more, with the bucket's count ``c``."""
    return members.join(members.groupBy("node").agg(F.count("*").alias("c")).where("c > 1"), "node")


def _in_blocks(members: DataFrame, size: int) -> DataFrame:
    """Each member once for each pair of blocks of its bucket; one pair where the bucket is no larger than ``size``."""
    n = F.ceil(F.col("c") / size).cast("int")
    own = members.withColumn("own", F.pmod(F.xxhash64("sid", "node"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    placed = own.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("c", "other")
    return placed.repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi", "sid")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[tuple]]]:
    """Rows of each (node, lo, hi) in turn, one for each sid, and whether only pairs across the blocks count.

    Columns: ``node, lo, hi, sid, own``, then the payload. A group has at most two blocks.
    """
    key, rows = None, {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if len(rows) > 1:
                    yield key[1] != key[2], list(rows.values())
                key, rows = row[:3], {}
            rows[row[3]] = row
    if len(rows) > 1:
        yield key[1] != key[2], list(rows.values())


def _linked(rows: list[tuple], across: bool, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that count among ``may`` (a symmetric matrix), and for each set the first that they connect it to."""
    if across:
        own = np.array([r[4] for r in rows])
        may &= own[:, None] != own[None, :]
    np.fill_diagonal(may, False)
    root = np.arange(len(rows))
    busy = np.flatnonzero(may.any(axis=1))
    while True:
        before = root.copy()
        for i in busy:
            root[i] = min(root[i], root[may[i]].min())
        root = root[root]
        if (root == before).all():
            return may, root


def _near(similarity: float) -> Callable:
    """Buckets to ``src, dst``: each set with the first of those that the bitmaps may connect it to."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for across, rows in _groups(batches):
            n = np.array([r[5] for r in rows], np.int64)
            bits = np.frombuffer(b"".join(r[6] for r in rows), np.uint64).reshape(len(rows), -1)
            may = np.zeros((len(rows), len(rows)), bool)
            for i in range(len(rows)):
                sized = np.flatnonzero(np.minimum(n[i], n[i:]) >= similarity * np.maximum(n[i], n[i:]) - 1e-9) + i
                good = sized[np.bitwise_count(bits[sized] ^ bits[i]).sum(axis=1) <= (n[i] + n[sized]) * share + 1e-9]
                may[i, good] = may[good, i] = True
            _, root = _linked(rows, across, may)
            for i in np.flatnonzero(root != np.arange(len(rows))):
                src.append(rows[i][3])
                dst.append(rows[root[i]][3])
            if len(src) > 50_000:
                yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
                src, dst = [], []
        yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def common_counts(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over slices of the vocabulary."""
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    row, every = row[order], every[order]
    opens = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(opens) - 1
    shared = np.bincount(column) > 1  # a shingle of one set only is in no intersection
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2 ** 24 are exact
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (a, a + width))
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _exact(similarity: float) -> Callable:
    """Connected sets to ``sid, root, links``: verified links (counting copies) in this pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[int]] = [[], [], []]
        for across, rows in _groups(batches):
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            n = np.array([len(s) for s in sets], np.float64)
            both = common_counts(sets)
            true = np.zeros(both.shape, bool)
            for i, row in enumerate(both):
                shared = row.astype(np.float64)
                true[i] = shared >= similarity * (n[i] + n - shared) - 1e-9
            pairs, root = _linked(rows, across, true)
            links = pairs @ np.array([r[6] for r in rows], np.int64)
            for i in np.flatnonzero(links):
                for c, v in zip(out, (rows[i][3], rows[root[i]][3], int(links[i]))):
                    c.append(v)
        yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["sid", "root", "links"])

    return run


def jaccard_classes(docs: DataFrame, similarity: float = SIMILARITY, ngram: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id, copy_id, n_copies, n_links``.

    ``class_id`` is the least document id of those connected by pairs of similarity
    ``similarity`` or more, ``copy_id`` the least id of those with the same shingles,
    ``n_copies`` how many have them, ``n_links`` how many other rows are similar enough
    (copies too). Null and empty texts have no shingle and stand alone; a row with a null id is
    left out; repeated ids are rows of their own, and so are each other's copies when their
    texts are equal; extra columns are not read; an empty table gives no rows.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    with small_batches(spark):
        sets = materialize(rows.mapInArrow(tidied(_sets(ngram, similarity, runs_for(recall))), SETS), "sets")
    some = sets.where("n > 0")
    copies = materialize(some.groupBy("set_key", "sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "copies")

    first = some.select("set_key", F.col("doc_id").alias("rep"), "sid", "nodes").join(copies.select("set_key", "rep"), ["set_key", "rep"], "left_semi")
    live = materialize(_counted(first.select(F.explode("nodes").alias("node"), "sid", "rep")), "buckets-2")
    buckets = live.where(F.col("c") <= LIMIT)
    for depth in range(3, MAX_DEPTH + 1):
        big = live.where(F.col("c") > LIMIT)
        if big.isEmpty():
            break
        sets_inside = shingles_of(rows, big.select("sid", "rep").distinct(), ngram)
        inside = big.join(sets_inside, ["sid", "rep"]).select("node", "sid", "rep", "shingles")
        with small_batches(spark):
            live = materialize(_counted(inside.mapInArrow(tidied(_split(similarity)), "node long, sid long, rep long").distinct()), f"buckets-{depth}")
        buckets = buckets.unionByName(live if depth == MAX_DEPTH else live.where(F.col("c") <= LIMIT))

    known = buckets.join(some.select("sid", F.col("doc_id").alias("rep"), "n", "bitmap"), ["sid", "rep"])
    near = _in_blocks(known, LIMIT).select("node", "lo", "hi", "sid", "own", "n", "bitmap").mapInArrow(tidied(_near(similarity)), "src long, dst long")
    clusters = connected_components(near)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("c"))
    large = broadcast_if_small(sizes.where(F.col("c") > BLOCK), MAX_BROADCAST_IDS)  # the others are one block, whatever their size
    named = clusters.join(large, "component", "left").na.fill({"c": 1}).select(F.col("component").alias("node"), F.col("node").alias("sid"), "c").join(copies.select("sid", "rep", "n_copies"), "sid")
    held = shingles_of(rows, materialize(named.select("sid", "rep", "node", "c", "n_copies"), "clusters"), ngram)
    exact = _in_blocks(held, BLOCK).select("node", "lo", "hi", "sid", "own", "shingles", "n_copies").mapInArrow(tidied(_exact(similarity)), "sid long, root long, links long")
    with small_batches(spark):
        exact = materialize(exact, "links")

    classes = connected_components(exact.select(F.col("sid").alias("src"), F.col("root").alias("dst")))
    links = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    each = materialize(copies.join(classes.withColumnRenamed("node", "sid"), "sid", "left").join(links, "sid", "left"), "classes")
    lowest = each.where("component is not null").groupBy("component").agg(F.min("rep").alias("lowest"))
    each = join_per_key(each, lowest, "component").select("set_key", F.col("rep").alias("copy_id"), F.coalesce("lowest", "rep").alias("class_id"), "n_copies", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    out = sets.select("doc_id", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(each, "set_key", "left")
    one = F.lit(1).cast("long")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_copies", one).alias("n_copies"), F.coalesce("n_links", one - 1).alias("n_links"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose class has a document of a lower id.

    Rows with a null id stay, and so do all rows that repeat the class's lowest id.
    """
    gone = materialize(jaccard_classes(docs).where("class_id <> doc_id").select("doc_id").distinct(), "copies-gone")
    return docs.join(broadcast_if_small(gone, MAX_BROADCAST_IDS), "doc_id", "left_anti")


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Brute force: every pair of distinct shingle sets that share a shingle, and the components of the links.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w WHERE len(w) > 0),
r AS (SELECT s, min(doc_id) AS rep, count(*) AS n_copies, len(s) AS n FROM g GROUP BY s),
e AS (SELECT rep, n, n_copies, unnest(s) AS x FROM r),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(b.n_copies) AS other, count(*) AS k, any_value(a.n) + any_value(b.n) AS t FROM e a JOIN e b USING (x) WHERE a.rep <> b.rep GROUP BY ALL),
l AS (SELECT a, b, other FROM p WHERE k >= 0.8 * (t - k) - 1e-9),
reach AS (SELECT a AS v, b AS u FROM l UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.u),
c AS (SELECT v, min(u) AS low FROM reach GROUP BY v),
k AS (SELECT a AS v, sum(other) AS links FROM l GROUP BY a),
o AS (SELECT s, rep AS copy_id, least(rep, coalesce(low, rep)) AS class_id, n_copies, CAST(coalesce(links, 0) + n_copies - 1 AS BIGINT) AS n_links FROM r LEFT JOIN c ON c.v = rep LEFT JOIN k ON k.v = rep)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copy_id, d.doc_id) AS copy_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN o USING (s)
"""
