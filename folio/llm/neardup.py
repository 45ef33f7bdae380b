"""Near-duplicate documents by a chosen-path similarity join.

A document is its set of distinct five-word shingles. Documents with equal word sequences collapse to one
first. Then ``TREES`` independent trees branch the rest: at every node a document follows the ``BRANCHES``
positions that the node selects from its min-hash signature, to the child named by its minwise token there.
Nodes of up to ``small`` documents are compared exhaustively; larger ones branch on. A pair of similarity s
meets in a leaf of one tree with probability at least (2s - 1) / s**2 (0.89 at s = 0.75), whatever the depth,
so that eight trees miss one pair in 4 * 10**7. What still is large at ``depth`` is compared in pairs of blocks.

Leaves compare 128 signature bytes and only join documents that may be similar into loose clusters (a spanning
forest leaves the task, never all pairs). A cluster's documents then meet once with their full sets: all of
its pairs are counted over an inverted list, and those of similarity 0.75 or more join components. A cluster
over ``cluster_weight`` is dealt into blocks whose pairs are tasks of their own; its links go through the
same distributed component search as the loose ones.

A very long text is read whole, alone in its slice. Of equal texts the row with the smallest id stands for all; of the rows of a
component the smallest id names it.

Nulls: a text that is null or without words has an empty set and is linked with nothing. A text of one to
four words is one shingle, its whole sequence. For ``link``, rows that share an id are one document, and a row
without an id is linked with nothing and kept; ``deduplicate`` looks at rows, whatever their ids. An empty table
gives no rows. Other columns are ignored by ``link`` and carried along by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import free_name, hold, materialize, scratch_dir, slices, table

WORDS = 5
PERCENT = 75
TREES, BRANCHES = 8, 2
FIRST = TREES * BRANCHES
DEEP = 16
SIGNATURE = 128
#: Least share of equal signature bytes for a loose link: over four standard deviations under 0.75.
LOOSE = 0.58
SMALL, DEPTH = 2000, 10
CLUSTER_WEIGHT = 4_000_000
#: Up to so many ids (16 bytes each) a set of ids is broadcast; beyond, it is joined by shuffle.
SMALL_IDS = 2_000_000
_SEED = np.random.default_rng(5)
_ODD = _SEED.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _SEED.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
_STEP = _SEED.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only A-Z change, and only the contract's six separators split


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    total = h[:n] * _STEP[0]
    for k in range(1, WORDS):
        total += h[k : n + k] * _STEP[k]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[at : at + 2048, None] ^ _XOR) * _ODD).min(0), out=least)
    return least


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, digest of the word sequence, signature bytes, first-level and deeper minwise tokens); one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            hold("neardup")
            count, digest, sig, first, deep = [], [], [], [], []
            for text in b.column(text_col).to_pylist():
                words = words_of(text or "")
                s = shingles(words)
                count.append(len(s))
                if not len(s):
                    for c in (digest, sig, first, deep):
                        c.append(None)
                    continue
                least = signature(s)
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sig.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                first.append((least[:FIRST] + np.arange(FIRST, dtype=np.uint64)).view(np.int64))
                deep.append(least[FIRST : FIRST + DEEP].view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(first, longs), pa.array(deep, longs)], [id_col, "n_shingles", "digest", "sig", "first", "deep"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_shingles long, digest binary, sig binary, first array<long>, deep array<long>")


def _loose_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, rep, sig) sorted by node to a spanning forest (a, b) of each node's similar documents."""
    out_a: list[int] = []
    out_b: list[int] = []

    def close(reps: list[int], sigs: list[bytes]) -> None:
        if len(reps) < 2:
            return
        x = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
        left = np.arange(1, len(reps))  # not reached yet
        queue = [0]
        while len(left) or queue:
            if not queue:
                queue, left = [int(left[0])], left[1:]
            i = queue.pop()
            if not len(left):
                break
            near = (x[left] == x[i]).sum(1) >= LOOSE * x.shape[1]
            for j in left[near].tolist():
                queue.append(j)
                out_a.append(reps[i])
                out_b.append(reps[j])
            left = left[~near]

    node, reps, sigs = None, [], []
    for b in batches:
        for k, r, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if k != node:
                close(reps, sigs)
                node, reps, sigs = k, [], []
            reps.append(r)
            sigs.append(s)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
            out_a.clear()
            out_b.clear()
    close(reps, sigs)
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def leaves(reps: DataFrame, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(node, rep): the leaves of all trees that hold two documents or more, at most ``small`` each but for pairs of blocks."""
    spark = reps.sparkSession
    base = scratch_dir(spark)
    rows = reps.select("rep", F.explode("first").alias("node"))
    found = None
    for level in range(depth + 1):
        rows = materialize(rows, f"{base}/rows{level}")
        counted = rows.groupBy("node").count().filter(F.col("count") > 1)
        counted = materialize(counted, f"{base}/count{level}")
        fit = rows.join(counted.filter(F.col("count") <= small).select("node").hint("shuffle_merge"), "node").select("node", "rep")
        found = fit if found is None else found.unionByName(fit)
        large = counted.filter(F.col("count") > small)
        if large.isEmpty():
            return found
        # a node's size bounds the number of large nodes: each holds over ``small`` of the rows
        over = rows.join(F.broadcast(large) if large.count() <= SMALL_IDS else large.hint("merge"), "node")
        if level == depth:
            blocks = F.ceil(2 * F.col("count") / small).cast("int")
            own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
            pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))))
            pairs = over.select("node", "rep", pair.alias("p")).select(F.xxhash64("node", "p.i", "p.j").alias("node"), "rep")
            return found.unionByName(pairs.distinct())
        at = lambda k: F.pmod(F.xxhash64("node", F.lit(level), F.lit(k)), F.lit(DEEP // BRANCHES)).cast("int") + 1 + k * (DEEP // BRANCHES)  # noqa: E731, B023
        child = lambda k: F.xxhash64("node", F.lit(k), F.element_at("deep", at(k)))
        deep = reps.select("rep", "deep").hint("shuffle_merge")
        rows = over.join(deep, "rep").select("rep", F.explode(F.array(*map(child, range(BRANCHES)))).alias("node")).distinct()
    return found


def components(edges: DataFrame, base: str) -> DataFrame:
    """(id, comp): each vertex of (a, b) with the smallest vertex it reaches.

    Every round a vertex takes the least label among its neighbours, then its label's label, until none changes."""
    both = edges.filter(F.col("a") != F.col("b")).select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{base}/edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id"), f"{base}/labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.hint("shuffle_hash").withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        new = labels.join(near.hint("shuffle_hash").withColumnRenamed("a", "id"), "id").select("id", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        new = materialize(new, f"{base}/near{step}")
        up = new.select(F.col("id").alias("new"), F.col("new").alias("top"))
        jumped = new.join(up.hint("shuffle_hash"), "new").select("id", F.least("new", "top").alias("comp"), "old")
        jumped = materialize(jumped, f"{base}/labels{step}")
        labels = jumped.select("id", "comp")
        if jumped.filter(F.col("comp") != F.col("old")).isEmpty():
            return labels


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, rep, hashes) sorted by task to a spanning forest (a, b) of each task's confirmed links."""
    out: list[tuple[int, int]] = []

    def close(reps: list[int], sets: list[np.ndarray]) -> None:
        n = len(reps)
        if n < 2:
            return
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(n), size)
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(place, minlength=len(values))
        order = np.argsort(place, kind="stable")  # postings of each shingle, by document
        postings, start = owner[order], np.r_[0, np.cumsum(often)]
        ends = np.r_[0, np.cumsum(size)]
        top = list(range(n))

        def find(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        for i in range(n):
            mine = place[ends[i] : ends[i + 1]]
            mine = mine[often[mine] > 1]
            if not len(mine):
                continue
            length = often[mine]
            steps = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            shared = np.bincount(postings[np.repeat(start[mine], length) + steps], minlength=n)
            linked = np.flatnonzero(100 * shared >= PERCENT * (size[i] + size - shared))
            for j in linked[linked > i].tolist():
                a, b = find(i), find(j)
                if a != b:
                    top[b] = a
                    out.append((reps[i], reps[j]))

    def batch() -> pa.RecordBatch:
        rb = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
        out.clear()
        return rb

    task, reps, sets = None, [], []
    for b in batches:
        for k, r, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if k != task:
                close(reps, sets)
                task, reps, sets = k, [], []
            reps.append(r)
            sets.append(np.frombuffer(s, np.uint64))
        if out:
            yield batch()
    close(reps, sets)
    if out:
        yield batch()


def _sets(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            data = [shingles(words_of(t or "")).tobytes() for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("cluster"), pa.array(data, pa.binary())], ["rep", "cluster", "hashes"])

    return docs.mapInArrow(run, "rep long, cluster long, hashes binary")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, depth: int = DEPTH, cluster_weight: int = CLUSTER_WEIGHT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    base = scratch_dir(spark)
    sketched = materialize(sketch(docs, id_col, text_col), f"{base}/sketch")
    # the row that stands for each distinct text, combined in parts: a text of a third of the rows is a row a task
    first = sketched.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min_by(F.struct(F.col(id_col).cast("long").alias("rep"), "n_shingles", "sig", "first", "deep"), id_col).alias("r"))
    first = materialize(first.select("digest", "r.*"), f"{base}/first")
    reps = first.filter(F.col("rep").isNotNull()).drop("digest")
    met = leaves(reps, small, depth)
    signed = met.join(reps.select("rep", "sig").hint("shuffle_merge"), "rep").select("node", "rep", "sig")
    edges = signed.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(_loose_edges, "a long, b long")
    clusters = components(edges, f"{base}/loose")  # few documents are in any
    sizes = reps.select("rep", "n_shingles").join(clusters.hint("shuffle_hash"), F.col("rep") == F.col("id")).groupBy("comp").agg(F.sum("n_shingles").alias("weight"), F.count(F.lit(1)).alias("n"))
    placed = clusters.join(sizes.hint("shuffle_hash"), "comp").select(F.col("id").alias("rep"), F.col("comp").alias("cluster"), F.ceil(2 * F.greatest(F.col("weight") / cluster_weight, F.col("n") / (2 * small))).cast("int").alias("parts"))
    placed = materialize(placed, f"{base}/placed")
    wanted = placed.select(F.col("rep").alias(id_col), "cluster")
    wanted = F.broadcast(wanted) if placed.count() <= SMALL_IDS else wanted.hint("shuffle_merge")
    texts = docs.select(id_col, text_col).join(wanted, id_col).select(F.col(id_col).cast("long").alias("rep"), "cluster", text_col)
    sets = _sets(texts, text_col).join(placed.select("rep", "parts").hint("shuffle_hash"), "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("cluster", F.least(own, j), F.greatest(own, j)))
    tasks = sets.select(F.explode(F.when(F.col("parts") <= 2, F.array(F.col("cluster"))).otherwise(pairs)).alias("task"), "rep", "hashes")
    links = tasks.repartition("task").sortWithinPartitions("task", "rep").mapInArrow(_exact_links, "a long, b long")
    found = components(links, f"{base}/exact")
    worded = sketched.select(id_col, "n_shingles", "digest").filter(F.col("digest").isNotNull())
    whole = worded.join(first.select("digest", "rep").hint("shuffle_merge"), "digest", "left").drop("digest")
    out = whole.join(found.select(F.col("id").alias("rep"), "comp").hint("shuffle_merge"), "rep", "left")
    component = F.coalesce("comp", "rep", F.col(id_col).cast("long"))
    linked = out.select(id_col, "n_shingles", component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))
    # rows without words are linked with nothing, and join nothing
    alone = sketched.filter(F.col("digest").isNull()).select(id_col, "n_shingles", F.col(id_col).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id, once; a null id comes last.

    Rows are told apart by a number of their own, so that unlike texts under one id, or under none, all stay."""
    row = free_name(docs.columns, "row")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    linked = materialize(link(keyed.select(F.col(row).alias("id"), F.col(text_col).alias("text")), "id", "text"))
    copies = linked.filter(~F.col("kept")).select("id", F.col("component_id").alias("comp"))
    members = materialize(copies.unionByName(copies.select("comp").distinct().select(F.col("comp").alias("id"), "comp")))
    named = members.hint("shuffle_merge").join(keyed.select(F.col(row).alias("id"), F.col(id_col).alias("name")), "id")
    first = named.groupBy("comp").agg(F.min(F.struct(F.col("name").isNull().alias("last"), "name", "id")).alias("first"))
    gone = members.select("id").join(first.select(F.col("first.id").alias("id")).hint("shuffle_merge"), "id", "left_anti")
    gone = materialize(gone.select(F.col("id").alias(row)))
    gone = F.broadcast(gone) if gone.count() <= SMALL_IDS else gone.hint("shuffle_merge")
    return keyed.join(gone, row, "left_anti").select(docs.columns)


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * shared >= 75 * (len(p.s) + len(q.s) - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept FROM sets s JOIN reached r USING (doc_id) GROUP BY s.doc_id, s.s
"""

QUERIES = {"op8_chosen_path": op8_chosen_path}
ORACLE_SQL = {"op8_chosen_path": _SQL}
