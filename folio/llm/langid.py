"""Language identification by hierarchical discrimination: the family first, then the languages within it.

A text is lower-cased and reduced to its letters, each run of anything else being one boundary mark. Its features are the relative
frequencies of the runs of one to ``ORDERS`` symbols, hashed to ``WIDTH`` buckets. One-versus-one linear support vector machines
(squared hinge loss, by dual coordinate descent) decide between families; others, trained for that family alone, between its
languages. Votes decide, then margins. A machine's margins become probabilities by a slope fitted on sampled texts that it was
not trained on; the score is the product of the winner's least probability against a rival, for its family and for itself.

As features are frequencies, a machine's margin is a mean of weights over the text: no vocabulary, no feature vector of a text
that is judged, and no shuffle of texts. Texts are read whole; a long one in pieces, which overlap by the length of a run.

The machines are fitted on the driver on a bounded sample: at most ``MAX_FIT`` labelled texts, shared equally among the (at most
``MAX_LANGUAGES``, most frequent first) languages, in order of a hash of id and text. Labels are counted over all rows.

A null text, one without a letter, or any text if nothing is learned, gives ``und`` with score 0; with one learned language the
score is 1. A null label teaches nothing; neither does a text without a letter. Ties between languages go to the one that comes
first by code point. A null id is hashed as an empty one. Repeated rows are judged each; repeats in the sample teach each. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import hold, slices, table

#: Buckets are the upper 17 bits of a 32-bit hash.
ORDERS, WIDTH = 5, 1 << 17
MAX_FIT, MAX_LANGUAGES = 2000, 200
UNKNOWN = "und"
#: Code points of a text that are worked on at once.
PIECE = 1_000_000
#: Families of languages by their codes (fixed values); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nds nl nn no sv yi", "romance": "an ast ca es fr fur gl it la oc pt rm ro sc wa", "slavic": "be bg bs cs hr hsb mk pl ru sh sk sl sr uk",
    "baltic": "lt lv", "celtic": "br cy ga gd gv kw", "uralic": "et fi hu se", "turkic": "az ba kk ky tk tr tt ug uz", "semitic": "am ar arz he mt ti",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur", "iranian": "fa ckb ku ps tg", "dravidian": "kn ml ta te", "austronesian": "ceb id jv mg mi ms su tl war",
    "bantu": "lg ln ny rw sn st sw tn xh zu", "sinitic": "wuu yue zh", "tai": "lo th", "mongolic": "mn", "japonic": "ja", "koreanic": "ko",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], f"={language}")


# --- features ---------------------------------------------------------------------------------------------------------------


class _Letters:
    """Which code points are letters; worked out once per process."""

    known: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls.known is None:
            cls.known = np.array([chr(i).isalpha() for i in range(0x110000)])
        return cls.known


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and boundary marks of all texts in one row, and where each text's begin and end; neighbours share a mark."""
    size = np.array([len(t) for t in texts])
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _Letters.table()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    before = np.r_[0, np.cumsum(kept)]
    first = 1 + np.r_[0, np.cumsum(size + 1)[:-1]]
    begin, end = before[first] - 1, before[first + size + 1]
    return np.where(letter, codes, np.uint32(32))[kept], begin, end


def _runs(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the run that begins at each symbol."""
    h = np.zeros(len(symbols), np.uint32)
    for n in range(ORDERS):
        if len(symbols) <= n:
            yield np.zeros(0, np.uint32)
            continue
        h = h[: len(symbols) - n] * np.uint32(0x9E3779B1) + symbols[n:]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        yield (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(15)


def _whole(text: str) -> np.ndarray:
    """The symbols of one text, taken in pieces that end behind a word."""
    out, at = [np.full(1, 32, np.uint32)], 0
    while at < len(text):
        stop = at + PIECE
        while stop < len(text) and text[stop - 1].isalpha():
            stop += 1
        symbols, begin, end = _symbols([text[at:stop]])
        out.append(symbols[begin[0] + 1 : end[0]])  # neighbours share a mark
        at = stop
    return np.concatenate(out)


def _stretches(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, buckets of its runs), for one stretch of a text's symbols after another."""
    for at in range(0, len(symbols), PIECE):
        for n, bucket in enumerate(_runs(symbols[at : at + PIECE + ORDERS - 1])):
            yield n, bucket[:PIECE]


def profile(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets of a text and their frequencies, each order summing to one; None without a letter."""
    symbols = _whole(text)
    if len(symbols) < 2:
        return None
    out = np.zeros(WIDTH)
    for n, bucket in _stretches(symbols):
        out += np.bincount(bucket, minlength=WIDTH) / max(len(symbols) - n, 1)
    places = np.flatnonzero(out)
    return places.astype("<i4"), out[places].astype("<f4")


def margins(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum over orders of the mean weight of its runs, a column per machine, and whether it has a letter.

    ``weights`` has a row per machine."""
    out = np.zeros((len(texts), len(weights)))
    if len(texts) == 1:
        symbols = _whole(texts[0])
        for n, bucket in _stretches(symbols) if len(symbols) > 1 else ():
            out[0] += [w[bucket].sum(dtype=float) / max(len(symbols) - n, 1) for w in weights]
        return out, np.array([len(symbols) > 1])
    symbols, begin, end = _symbols(texts)
    for n, bucket in enumerate(_runs(symbols)):
        stop = np.minimum(np.maximum(end - n, begin), len(bucket))
        first = np.minimum(begin, stop)
        for m, w in enumerate(weights):
            added = np.r_[0.0, np.cumsum(w[bucket], dtype=float)]
            out[:, m] += (added[stop] - added[first]) / np.maximum(stop - first, 1)
    some = end - begin > 1
    return np.where(some[:, None], out, 0), some


# --- machines ---------------------------------------------------------------------------------------------------------------

#: Profiles are scaled by this before a machine sees them, which sets how strongly weights are held back; sweeps over the rows at most.
GAIN, SWEEPS, TOLERANCE = 30.0, 20, 1e-2


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss, by dual coordinate descent; both labels weigh alike."""
    w, bias = np.zeros(WIDTH), 0.0
    cost = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    rng, alpha = np.random.default_rng(seed), np.zeros(len(y))
    square = np.array([GAIN**2 * float(v @ v) + 1 for _, v in rows])
    for _ in range(SWEEPS):
        most = 0.0
        for i in rng.permutation(len(y)):
            place, v = rows[i]
            slope = y[i] * (GAIN * float(w[place] @ v) + bias) - 1 + alpha[i] / (2 * cost[i])
            if alpha[i] == 0 and slope >= 0:
                continue
            most = max(most, abs(slope))
            new = max(alpha[i] - slope / (square[i] + 1 / (2 * cost[i])), 0.0)
            step = (new - alpha[i]) * y[i]
            w[place] += step * GAIN * v
            bias += step
            alpha[i] = new
        if most < TOLERANCE:
            break
    return GAIN * w, bias


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope of a logistic curve through zero; targets are drawn in by one row of each label, so that separable rows give a finite one."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        wrong = float(((1 / (1 + np.exp(-np.clip(middle * margin, -500, 500))) - target) * margin).sum())
        low, high = (middle, high) if wrong < 0 else (low, middle)
    return low


@dataclass(frozen=True)
class Model:
    """A contest is a list of names with one machine for each pair of them, in order; the first name's side is positive."""

    families: list[str]
    within: dict[str, list[str]]
    contests: dict[str, list[int]] = field(default_factory=dict)  # "" for families, else a family: its machines
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _won(self, contest: str, names: list[str], margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's place among the names, and its least probability against a rival."""
        votes, sums = np.zeros((len(margin), len(names))), np.zeros((len(margin), len(names)))
        least = np.ones((len(margin), len(names)))
        for m, (a, b) in zip(self.contests.get(contest, []), combinations(range(len(names)), 2), strict=True):
            d = margin[:, m] * self.slope[m]
            p = 1 / (1 + np.exp(-np.clip(d, -500, 500)))
            for at, sign, chance in ((a, d >= 0, p), (b, d < 0, 1 - p)):
                votes[:, at] += sign
                least[:, at] = np.minimum(least[:, at], chance)
            sums[:, a] += d
            sums[:, b] -= d
        best = np.where(votes == votes.max(1, keepdims=True), sums, -np.inf).argmax(1)
        return best, least[np.arange(len(margin)), best]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        margin, some = margins([t.lower() for t in texts], self.weights)
        margin = margin + self.bias
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.families:
            return names, score
        family, chance = self._won("", self.families, margin)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(some & (family == f))
            best, own = self._won(name, self.within[name], margin[rows])
            score[rows] = chance[rows] * own
            for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                names[r] = self.within[name][b]
        return names, score


def train(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Machines from rows (language, places, values of the profile); each fourth row of a language is kept for the slopes."""
    languages = sorted({s[0] for s in sample})
    within: dict[str, list[str]] = {}
    for name in languages:
        within.setdefault(family_of(name), []).append(name)
    families = sorted(within)
    seen: dict[str, int] = {}
    held = []
    for name, *_ in sample:
        seen[name] = seen.get(name, 0) + 1
        held.append(seen[name] % 4 == 0)
    rows = [(places, values.astype(float)) for _, places, values in sample]
    contests, weights, bias, slope = {}, [], [], []
    for contest, names in [("", families), *((f, within[f]) for f in families)]:
        own = [family_of(s[0]) if contest == "" else s[0] for s in sample]
        contests[contest] = []
        for a, b in combinations(names, 2):
            pick = [i for i, o in enumerate(own) if o in (a, b)]
            y = np.array([1.0 if own[i] == a else -1.0 for i in pick])
            apart = np.array([held[i] for i in pick])
            w, c = _machine([rows[i] for i, h in zip(pick, apart, strict=True) if not h], y[~apart])
            test = [i for i, h in zip(pick, apart, strict=True) if h] or pick
            margin = np.array([float(w[rows[i][0]] @ rows[i][1]) + c for i in test])
            contests[contest].append(len(weights))
            weights.append(w.astype(np.float32))
            bias.append(c)
            slope.append(_slope(margin, y[apart] if apart.any() else y))
    return Model(families, within, contests, np.array(weights, np.float32).reshape(-1, WIDTH), np.array(bias), np.array(slope))


# --- tables -----------------------------------------------------------------------------------------------------------------


def held_out(id_col: str) -> Column:
    """Rows that teach nothing: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_fit: int = MAX_FIT) -> Model:
    """A model from the rows of ``docs`` that have a language: at most ``max_fit`` texts, shared equally among languages."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counted:
        return Model([], {})
    each = max(1, max_fit // len(counted))
    # rows whose hash is low: about twice as many as are taken; equal rows have equal hashes, so the order still decides
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    low = F.create_map(*(F.lit(x) for r in counted for x in (r.lang, min(1 << 40, (1 << 40) * 2 * each // r.n + (1 << 20)))))
    rows = rows.withColumn("drawn", drawn).filter(F.col("drawn") < F.try_element_at(low, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("drawn", "id")  # each task keeps ``each`` rows a language before the shuffle
    taken = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= each).select("lang", "nth", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [profile(t.lower()) for t in b.column(2).to_pylist()]
            parts = (pa.array([None if p is None else p[k].tobytes() for p in found], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *parts], ["lang", "nth", "places", "values"])

    got = taken.mapInArrow(run, "lang string, nth int, places binary, values binary").filter(F.col("places").isNotNull()).orderBy("lang", "nth").collect()
    return train([(r.lang, np.frombuffer(r.places, "<i4"), np.frombuffer(r["values"], "<f4")) for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; one map over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``WIDTH`` numbers a machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hold("langid")
            names, score = shared.value.predict([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op11_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op11_language_families": op11_language_families}
ORACLE_SQL: dict[str, str] = {}
