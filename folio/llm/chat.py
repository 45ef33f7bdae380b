"""Chat formatting with offset-aligned loss masks.

The rows of a conversation are rendered by one template, ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` per turn,
the whole is encoded once with character offsets, and the sorted spans of the assistant's texts are
intersected with the token spans by binary search. A token that also covers a template character carries
only its part of the text as loss span.

Control strings inside texts and roles are escaped reversibly: a ``<`` followed by n >= 1 bars gets one bar
more, so no rendered text contains ``<|`` with a single bar except the template's own marks; roles also
escape the backslash and the line feed.

Conversations are streams of rows sorted by turn, never collected: a conversation of over ``BLOCK_CHARS``
rendered characters is encoded in several blocks, cut where a turn ends. The mark that starts the next turn
is a token of its own, so the tokens are those of the whole. Hashes are carried along from block to block.

Nulls: a null text or role is empty; a null turn comes first; rows with a null conv_id are one conversation.
Rows with equal turns are ordered by role and text; repeated rows are turns each. Conversations without an
assistant have no loss. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
START, END = "<|im_start|>", "<|im_end|>"
BLOCK_CHARS = 1_000_000
ENCODE_CHARS = 500_000
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\|+)", r"<|\1", text)


def unescape(text: str) -> str:
    return re.sub(r"<\|(\|+)", r"<\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def render(turns: list[tuple[str, str]], learn: frozenset[str] = frozenset({"assistant"})) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns (role, text), and the spans of the texts to learn, sorted."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role in learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered text."""
    return [(unescape_role(role), unescape(body)) for role, body in _TURN.findall(text)]


def intersect(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each token span, its part within the (sorted, disjoint) spans; empty where there is none.

    A token touches at most one span here, as the marks between two turns are tokens of their own."""
    if not spans or not len(starts):
        return np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
    lo, hi = np.array(spans, np.int64).T
    k = np.minimum(np.searchsorted(hi, starts, side="right"), len(lo) - 1)
    a, b = np.maximum(starts, lo[k]), np.minimum(stops, hi[k])
    empty = a >= b
    a[empty] = b[empty] = 0
    return a.astype(np.int32), b.astype(np.int32)


_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, END)])
        _tokenizers[path] = t
    return _tokenizers[path]


_FIELDS = [("block", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("token_starts", pa.list_(pa.int32())), ("token_ends", pa.list_(pa.int32())), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, bool, list[tuple[str, str]]]]:
    """(conversation, block number, last block?, turns) from rows sorted by conversation and turn."""
    none = object()
    key, number, turns, size = none, 0, [], 0
    for b in batches:
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if key is not none and conv != key:
                yield key, number, True, turns
                number, turns, size = 0, [], 0
            elif size > BLOCK_CHARS:
                yield key, number, False, turns
                number, turns, size = number + 1, [], 0
            key = conv
            turns.append((role or "", text or ""))
            size += len(role or "") + len(text or "") + 32
    if key is not none:
        yield key, number, True, turns


def format_chats(rows: DataFrame, path: str | None = None, learn: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """Blocks of rendered, encoded and masked conversations: (conv_id, block, last, formatted, token_ids, token_starts,
    token_ends, loss_starts, loss_ends), in order within partitions. One shuffle, by conversation."""
    path = path or public_tokenizers.path(TOKENIZER)
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, block int, last boolean, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_starts array<int>, loss_ends array<int>"

    def encode(some: list, kind: pa.DataType) -> pa.RecordBatch:
        texts = [render(turns, learn) for *_, turns in some]
        encoded = _tokenizer(path).encode_batch([t for t, _ in texts], add_special_tokens=False)
        cols: list[list] = [[] for _ in range(5)]
        for (_, spans), e in zip(texts, encoded, strict=True):
            starts, stops = np.array(e.offsets, np.int64).reshape(-1, 2).T
            for c, x in zip(cols, (np.array(e.ids, np.int32), starts.astype(np.int32), stops.astype(np.int32), *intersect(starts, stops, spans)), strict=True):
                c.append(x)
        data = [pa.array([k for k, *_ in some], kind), [n for _, n, *_ in some], [x[2] for x in some], [t for t, _ in texts], *cols]
        return pa.RecordBatch.from_arrays([data[0], *(pa.array(d, t) for d, (_, t) in zip(data[1:], _FIELDS, strict=True))], ["conv_id", *(n for n, _ in _FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds.append(b.schema.field(0).type)
                yield b

        some, size = [], 0
        for block in _blocks(seen()):
            some.append(block)
            size += sum(len(t) for _, t in block[3])
            if size > ENCODE_CHARS:
                yield encode(some, kinds[0])
                some, size = [], 0
        if some:
            yield encode(some, kinds[0])

    ordered = rows.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


def digest(blocks: DataFrame) -> DataFrame:
    """What each formatted conversation says when read back, from its text and its loss spans alone."""
    schema = f"conv_id {dict(blocks.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            out: list[tuple] = []
            lists = [[x.values.to_numpy() for x in b.column(i)] for i in (7, 8)]
            for i, (conv, last, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if state is None:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                starts, stops = lists[0][i], lists[1][i]
                state[5] += len(starts)
                starts, stops = starts[starts < stops], stops[starts < stops]
                state[6] += len(starts)
                if len(starts):  # tokens that share a character overlap, neighbours touch: a gap ends a turn's text
                    reach = np.maximum.accumulate(stops)
                    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
                    for a, z in zip(starts[new].tolist(), reach[np.r_[new[1:] - 1, len(stops) - 1]].tolist(), strict=True):
                        said = unescape(text[a:z])
                        state[2] += len(said)
                        state[3].update(said.encode())
                state[4] += len(text)
                if last:
                    out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))
                    state = None
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"])

    return blocks.mapInArrow(run, schema)


def op3_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(f"{END}{START}assistant ok")
    two = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digest(format_chats(rows.unionByName(two)))


QUERIES = {"op3_offset_masks": op3_offset_masks}
ORACLE_SQL: dict[str, str] = {}
