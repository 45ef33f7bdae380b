"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct pre-tokens of a batch lie end to end in one numpy array of
symbols. Each round looks up the rank of every neighbouring pair, finds each sequence's lowest rank and
merges all its occurrences at once; a sequence is done when none of its pairs has a rank. The symbols that
survive are its tokens. A pre-token of over ``bpe.LONG`` bytes is worked rank by rank, in time near to linear.
Counts agree with the vocabulary's own library, special strings included.

Nulls count as empty texts (0 bytes, 0 tokens). Repeated rows are counted each. An empty table gives no
rows. Whole texts are read, however long; pre-tokens over ``KEEP_CHARS`` characters are not remembered. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.bpe import Merges
from folio.llm.common import hold, slices, table

TOKENIZER = "byte_bpe_50k.json"
#: The pattern by which a byte-level tokenizer cuts a text before merging (fixed value of the format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEEP_CHARS = 64
KEEP_ENTRIES = 1_000_000


#: White space other than blank and line feed, wherever Unicode or Python sees any.
_RARE_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _mixed(text: str) -> bool:
    """Whether white space meets white space or an end of the text, or is of a rare kind."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text:
        return True
    return any(c in text for c in _RARE_SPACE)


class ArrayMerger:
    """Counts the tokens of texts under a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec)
        specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.specials = specials
        self.cut = regex.compile(PRETOKEN)
        self.known: dict[str, int] = {}

    def _learn(self, chunks: set[str]) -> dict[str, int]:
        """Token counts of chunks, all their distinct pre-tokens merged together."""
        cuts = {c: self.cut.findall(c) for c in chunks}
        distinct = list({p for ps in cuts.values() for p in ps})
        n = dict(zip(distinct, self.merges.merge(pa.array(distinct, pa.string()))[1].tolist(), strict=True)) if distinct else {}
        return {c: sum(map(n.__getitem__, ps)) for c, ps in cuts.items()}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. A text whose words are parted by single blanks is counted word by word, each word with
        the blank before it, since no pre-token then reaches over a blank's left side; any other text is cut as a whole."""
        added, parts = [0] * len(texts), []
        for i, t in enumerate(texts):
            pieces = [t]
            if self.special and any(s in t for s in self.specials):
                pieces = self.special.split(t)
                added[i] = len(pieces) - 1
            parts += [(i, p) for p in pieces if p]
        if len(self.known) > KEEP_ENTRIES:
            self.known.clear()
        units: list[tuple[int, list[str]]] = []
        for i, p in parts:
            if _mixed(p):
                units.append((i, self.cut.findall(p)))
            else:
                words = p.split(" ")
                units.append((i, [words[0], *(" " + w for w in words[1:])]))
        fresh = {w for _, ws in units for w in ws if w not in self.known}
        if fresh:
            self.known.update(self._learn(fresh))
        for i, ws in units:
            added[i] += sum(map(self.known.__getitem__, ws))
        for w in fresh:
            if len(w) > KEEP_CHARS:
                del self.known[w]
        return added


_mergers: dict[str, ArrayMerger] = {}


def merger(path: str) -> ArrayMerger:
    """One per Python worker, as loading a vocabulary takes a while."""
    if path not in _mergers:
        _mergers[path] = ArrayMerger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; a map over partitions, no shuffle."""
    path = path or public_tokenizers.path(TOKENIZER)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        hold("tokens", m.known.clear)
        for b in slices(batches, text_col):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(sizes, pa.int64()), pa.array(m.count(texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op6_array_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op6_array_merge_counts": op6_array_merge_counts}
ORACLE_SQL: dict[str, str] = {}
