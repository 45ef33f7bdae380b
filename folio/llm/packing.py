"""Packing by concatenating and cutting.

All documents' token ids form one long line that is cut every ``length`` ids. Pass one tokenizes each
partition once, keeps the ids in a table together with the partition's number and the row's start within
the partition, and totals the partitions. A prefix sum over these totals (one number per partition) gives
every partition its global offset. Pass two cuts: a document's ids from g to g + n lie in windows
``g // length`` to ``(g + n - 1) // length``; where a window ends inside a document, or a partition, the
boundary record is simply the piece that starts there. Only the last window may be short, so there is no
padding elsewhere.

Nulls: a null text is packed as an empty one, whose only id is the end mark. Repeated rows and ids are
packed each. An empty table gives no rows. Long texts make many pieces and are never cut short. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.bpe import Merges
from folio.llm.common import hold, materialize, scratch_dir, slices, table

TOKENIZER = "word_bpe_49k.json"
LENGTH = 4096
END_ID = 2
#: Words that are encoded at once.
CHUNK_WORDS = 700_000
#: A word of Latin-1 letters and the ASCII marks behind it, but for the apostrophe and ``<``.
_PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:;=-@\\[-`{-~]*)$"


def _gather(values: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The pieces ``pick`` of values that lie end to end, ``lengths`` each."""
    starts, n = np.cumsum(lengths) - lengths, lengths[pick]
    return values[np.repeat(starts[pick] - np.cumsum(n) + n, n) + np.arange(n.sum())]


class WordEncoder:
    """Ids of texts as the library gives them, by distinct word: this vocabulary drops white space and no token reaches over it.

    A plain word is one pre-token of letters, in lower case, and one of marks; these are merged together in numpy.
    Any other word goes through the library. Nothing is remembered from one chunk of words to the next."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges.load(path)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has."""
        parts = pc.extract_regex(words, _PLAIN)
        plain = parts.is_valid()
        parts, rest = parts.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        letters = pc.utf8_lower(parts.field("letters")).dictionary_encode()
        marks = parts.field("marks").dictionary_encode()
        ids, sizes = self.merges.merge(pa.concat_arrays([letters.dictionary, marks.dictionary]))
        pair = np.column_stack([letters.indices.to_numpy(), marks.indices.to_numpy() + len(letters.dictionary)]).ravel()
        of_plain = sizes[pair].reshape(-1, 2).sum(1)
        other = [self.tokenizer.encode_batch_fast(rest[at : at + 1000], add_special_tokens=False) for at in range(0, len(rest), 1000)]
        of_rest = [np.array(e.ids, np.int64) for some in other for e in some]
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int64)  # plain words come first
        place[is_plain], place[~is_plain] = np.arange(len(of_plain)), len(of_plain) + np.arange(len(rest))
        values = np.concatenate([_gather(ids, sizes, pair), *of_rest])
        lengths = np.concatenate([of_plain, np.fromiter(map(len, of_rest), np.int64, len(rest))])
        return _gather(values, lengths, place), lengths[place]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (unsigned 16-bit numbers, as the vocabulary has fewer than 65,536), and how many each has."""
        split = pc.ascii_split_whitespace(texts)
        flat, bounds = split.flatten(), split.offsets.to_numpy()
        ids, sizes = [np.zeros(0, np.uint16)], np.zeros(len(flat), np.int32)
        for at in range(0, len(flat), CHUNK_WORDS):
            known = flat.slice(at, CHUNK_WORDS).dictionary_encode()
            values, n = self._distinct(known.dictionary)
            pick = known.indices.to_numpy()
            ids.append(_gather(values.astype(np.uint16), n, pick))
            sizes[at : at + len(pick)] = n[pick]
        total = np.r_[0, np.cumsum(sizes)]
        return np.concatenate(ids), total[bounds[1:] - bounds[0]] - total[bounds[:-1] - bounds[0]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit numbers."""
        ids, sizes = self.encode_array(pa.array(texts, pa.string()))
        return [x.astype("<u2").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """(id, part, part_start, doc_tokens, ids): each row's ids with the end mark, numbered within its partition."""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, part int, part_start long, doc_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        for b in slices(batches, text_col):
            hold("packing")
            ids, sizes = enc.encode_array(pc.fill_null(b.column(text_col), ""))
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes += 1
            bounds = np.r_[0, np.cumsum(sizes)]
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(2 * bounds), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + bounds[:-1]), pa.array(sizes), data],
                [id_col, "part", "part_start", "doc_tokens", "ids"],
            )
            at += int(bounds[-1])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: (id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = docs.sparkSession
    rows = materialize(tokenize(docs, id_col, text_col, path or public_tokenizers.path(TOKENIZER), end_id), f"{scratch_dir(spark)}/ids")
    totals = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())  # one row per partition
    offsets = [0, *accumulate(n for _, n in totals)]
    base = spark.createDataFrame([(p, o) for (p, _), o in zip(totals, offsets, strict=False)] or [(-1, 0)], "part int, part_offset long")
    placed = rows.join(F.broadcast(base), "part").select(id_col, (F.col("part_offset") + F.col("part_start")).alias("at"), "doc_tokens", "ids")
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids"):
            at = b.column("at").to_numpy()
            n = b.column("doc_tokens").to_numpy()
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(at)), pieces)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(window * length, at[row])
            stop = np.minimum((window + 1) * length, (at + n)[row])
            ids = [np.frombuffer(x.as_buffer(), "<u2") for x in b.column("ids")]
            cuts = [ids[r][s:e].astype("<u4").tobytes() for r, s, e in zip(row.tolist(), (start - at[row]).tolist(), (stop - at[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col).take(pa.array(row)), pa.array(start - at[row]), pa.array(stop - start), pa.array(cuts, pa.binary()), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(n[row]), pa.array(window), pa.array(start - window * length)],
                [id_col, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(cut, schema)


def op10_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op10_concat_cut": op10_concat_cut}
ORACLE_SQL: dict[str, str] = {}
