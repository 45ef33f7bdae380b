"""Quality rules: rule statistics of whole texts, judged by an isolation forest.

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated three-word
windows). A hard base rule rejects short or repetitive texts. For the rest, an isolation forest measures how
few random splits isolate a document's statistics. It is grown on one half of a bounded sample of rows labelled
good, on those statistics that tell labelled rows apart; splits fall anywhere in a node's box, which at the root spans all
labelled rows, so that where no good row lies, a row is alone after few splits. The other half and the rows labelled bad
calibrate the score beyond which a document goes.

Nulls: a null text has no words and fails the base rule. Labels with a null id or quality are left out; of
several labels for one id the lowest counts, of several texts for one id the one with the least counts. Without
labelled rows of both kinds only the base rule rejects. Repeated rows are judged each. An empty table gives no rows.
A very long text is read whole, alone in its slice, in time linear in its length but for the sort of its windows. Rows with equal
statistics get equal verdicts; of equal thresholds the highest is taken.
``judge`` carries other columns along, but for those that bear the name of a column it adds; ``keep`` changes none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import hold, slices, table

FEATURES = ("word_length", "symbol_share", "symbols_per_word", "log_symbols", "dup_line_share", "repeat_share")
#: Bound of the labelled rows that are collected to grow and calibrate the forest.
MAX_FIT = 20_000
TREES, SAMPLE, SEED = 100, 256, 17
#: Splits from the root to a leaf at most; a split that parts nothing counts too.
DEPTH = 24
#: Share of the labelled good rows that calibration may reject at most; one row may always go.
MAX_LOSS = 0.01


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, first occurrences included; each position counts once."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    k = len(number)
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # three numbers do not fit one: rank the pairs first
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text.encode()
    words = data.split()  # bytes split at exactly blank, \t, \n, \v, \f, \r
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    dup = 0
    if b"\n" in data:
        lines = [line for line in data.split(b"\n") if line.strip(b" \t\v\f\r")]
        dup = len(lines) - len(set(lines))
    return len(words), len(text) - spaces, symbols, dup, repeat_words(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The hard rule, from rows of ``COUNTS``."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def features(counts: np.ndarray) -> np.ndarray:
    """``FEATURES`` of rows of ``COUNTS``."""
    words, chars = np.maximum(counts[:, 0], 1), np.maximum(counts[:, 1], 1)
    symbols = counts[:, 2]
    return np.column_stack([counts[:, 1] / words, symbols / chars, symbols / words, np.log1p(symbols), counts[:, 3] / words, counts[:, 4] / words])


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays, a row each: split feature (-1 at a leaf), split value, left child (right is next), path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row: 2 ** (-mean path / average path); near 1 is isolated early."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, path in zip(self.feature, self.value, self.left, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                if (f < 0).all():
                    break
                below = np.where(x[rows, np.maximum(f, 0)] < value[node], left[node], left[node] + 1)
                node = np.where(f < 0, node, below)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(average_path(self.sample)), 1e-9))


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, low: np.ndarray | None = None, high: np.ndarray | None = None, depth: int = DEPTH) -> Forest:
    """Trees over samples of ``x``. Every node has a box, at the root from ``low`` to ``high`` (else around ``x``), and splits it
    anywhere along one side; a node with one row or none is a leaf."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    low = x.min(0) if low is None else np.minimum(low, x.min(0))
    high = x.max(0) if high is None else np.maximum(high, x.max(0))
    built = []
    for _ in range(trees):
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, x[rng.choice(len(x), sample, replace=False)], low, high, 0)]
        while todo:
            at, rows, lo, hi, level = todo.pop()
            able = np.flatnonzero(hi > lo)
            if level >= depth or len(rows) < 2 or not len(able):
                nodes[at][3] = level + float(average_path(len(rows)))
                continue
            f = int(rng.choice(able))
            v = float(rng.uniform(lo[f], hi[f]))
            less = rows[:, f] < v
            nodes[at][:3] = [f, v, len(nodes)]
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = v
            todo += [(len(nodes), rows[less], lo, below, level + 1), (len(nodes) + 1, rows[~less], above, hi, level + 1)]
            nodes += [[-1, 0.0, 0, level + 1.0], [-1, 0.0, 0, level + 1.0]]
        built.append(np.array(nodes))
    width = max(map(len, built))
    flat = np.stack([np.vstack([b, np.tile([[-1.0, 0, 0, 0]], (width - len(b), 1))]) for b in built])
    return Forest(flat[:, :, 0].astype(np.int64), flat[:, :, 1], flat[:, :, 2].astype(np.int64), flat[:, :, 3], sample)


def calibrate(good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The score above which a document goes: rejects most bad rows per good row lost, and at most ``max_loss`` of the good, or one."""
    cuts = np.unique(np.r_[good, bad])
    lost = 1 - np.searchsorted(np.sort(good), cuts, side="right") / len(good)
    caught = 1 - np.searchsorted(np.sort(bad), cuts, side="right") / len(bad)
    gain = np.where(lost <= max(max_loss, 1 / len(good)) + 1e-9, caught - lost, -1)
    best = len(cuts) - 1 - int(np.argmax(gain[::-1]))
    above = cuts[best + 1] if best + 1 < len(cuts) else cuts[best] + 1e-6
    return float((cuts[best] + above) / 2)  # between two scores, so that rounding decides nothing


def informative(x: np.ndarray, y: np.ndarray, least: float = 0.1) -> list[int]:
    """Features that tell labelled rows apart: the chance that a good row ranks above a bad one is off one half by ``least``."""
    good, bad = (np.sort(x[y == k], axis=0) for k in (1, 0))
    off = []
    for f in range(x.shape[1]):
        below, upto = (np.searchsorted(bad[:, f], good[:, f], side=side).mean() / len(bad) for side in ("left", "right"))
        off.append(abs((below + upto) / 2 - 0.5))
    return [f for f, o in enumerate(off) if o >= least] or list(range(x.shape[1]))


@dataclass(frozen=True)
class Judge:
    """A forest over some of the features and the score above which a document goes."""

    forest: Forest
    used: list[int]
    most: float

    def anomaly(self, counts: np.ndarray) -> np.ndarray:
        return self.forest.score(features(counts)[:, self.used])


def _shared(docs: DataFrame, judge: Judge | None):
    return docs.sparkSession.sparkContext.broadcast(judge)  # TREES trees of a few hundred nodes


def _verdicts(texts: pa.Array, judge: Judge | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base rule, anomaly (NaN without a forest) and verdict of texts."""
    counts = np.array([text_statistics(t or "") for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))
    failed = base_failed(counts)
    anomaly = judge.anomaly(counts) if judge else np.full(len(counts), np.nan)
    return counts, failed, anomaly, ~failed & (anomaly <= judge.most) if judge else ~failed


def _counted(docs: DataFrame, id_col: str, text_col: str, judge: Judge | None, keep_text: bool) -> DataFrame:
    """The rows with their counts, ``base_failed``, ``anomaly`` and ``kept``; one map over the texts."""
    added = (*COUNTS, "base_failed", "anomaly", "kept")
    carried = [c for c in docs.columns if c not in added and (keep_text or c != text_col)]
    places = [docs.columns.index(c) for c in carried]
    at, shared = docs.columns.index(text_col), _shared(docs, judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            hold("quality")
            counts, failed, anomaly, kept = _verdicts(b.column(at), shared.value)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(anomaly, mask=np.isnan(anomaly)), pa.array(kept)], [*carried, *added])

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in carried] + [f"{c} long" for c in COUNTS] + ["base_failed boolean", "anomaly double", "kept boolean"])
    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> Judge | None:
    """Forest and threshold from the labelled rows that pass the base rule, at most ``max_fit``, taken in order of a hash of the id."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64(id_col), id_col).limit(max_fit).select(F.col(id_col).alias("id"), F.col("quality").alias("label"))
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")  # max_fit ids at most
    passed = _counted(some, "id", "text", None, False).filter(~F.col("base_failed"))
    sample = passed.groupBy("id", "label").agg(F.min(F.struct(*COUNTS)).alias("counts"), F.xxhash64("id").alias("hash")).orderBy("hash", "id").collect()
    counts = np.array([list(r.counts) for r in sample], np.int64).reshape(-1, len(COUNTS))
    y = np.array([r.label for r in sample])
    good = np.flatnonzero(y == 1)
    if len(good) < 2 or not (y == 0).any():
        return None
    x = features(counts)
    used = informative(x, y)
    x = x[:, used]
    forest = grow(x[good[::2]], low=x.min(0), high=x.max(0))
    return Judge(forest, used, calibrate(forest.score(x[good[1::2]]), forest.score(x[y == 0])))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row with its counts, ``base_failed``, ``anomaly`` (null without a forest) and ``kept``; the texts are not shuffled."""
    return _counted(docs, id_col, text_col, fit(docs, labels, id_col, text_col), keep_text)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns alone."""
    shared, at = _shared(docs, fit(docs, labels, id_col, text_col)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            hold("quality")
            yield b.filter(pa.array(_verdicts(b.column(at), shared.value)[3]))

    return docs.mapInArrow(run, docs.schema)


def op4_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_isolation_forest": op4_isolation_forest}
ORACLE_SQL: dict[str, str] = {}
