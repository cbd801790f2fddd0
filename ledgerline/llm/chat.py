"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
spans of its turns, which are sorted, are intersected with the token spans by
binary search: a token carries loss where it lies within an assistant text.

The template writes a turn as ``[INST]role[/INST]text</s>``. Control strings inside
roles and texts are escaped: backslashes are doubled, then a backslash is put
after the first character of each control string. The reader undoes this exactly.
The tokenizer gets the control strings as special tokens, so no token straddles
the edge of a text. Its vocabulary file need lie on the driver only: Spark ships it to the
executors.

Rows of a conversation are ordered by turn, ties by role, then text; a null turn
comes first. Edge cases: a null or empty text is an empty turn and adds nothing
to the mask; a null role is an empty role; a null ``conv_id`` is one conversation;
repeated rows are turns of their own; a conversation is one training example and
is held whole in one task; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: Default vocabulary file, byte-level BPE; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters encoded in one call of the tokenizer.
GROUP = 1 << 20

_CONTROL = re.compile(r"\[INST\]|\[/INST\]|</s>")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each assistant text in it, sorted."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that lie within a span."""
    if not spans or not len(starts):
        return np.zeros(len(starts), dtype=bool)
    low, high = (np.array(x) for x in zip(*spans, strict=True))
    at = np.searchsorted(low, starts, side="right") - 1
    return (at >= 0) & (ends <= high[np.maximum(at, 0)]) & (ends > starts)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, each character once, unescaped by run of touching tokens.

    Tokens of one character (bytes of it) repeat its offsets, hence the running end.
    """
    runs: list[list[int]] = []
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return "".join(unescape(formatted[a:b]) for a, b in runs)


def load_tokenizer(path: str):
    """The tokenizer with the control strings as special tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (OPEN, CLOSE, END)])
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


_loaded: dict[str, object] = {}


def _groups(rows: list[tuple], size: int = GROUP) -> Iterator[list[tuple]]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _formatted(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if name not in _loaded:
        _loaded[name] = load_tokenizer(SparkFiles.get(name))
    tokenizer = _loaded[name]
    ints = pa.list_(pa.int32())
    for batch in batches:
        rendered = []
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            rendered.append((conv, *render([(t["role"], t["text"]) for t in turns])))
        for group in _groups(rendered):
            encoded = tokenizer.encode_batch([text for _, text, _ in group], add_special_tokens=False)
            ids, starts, ends, masks = [], [], [], []
            for (_, _, spans), code in zip(group, encoded, strict=True):
                offsets = np.array(code.offsets, dtype=np.int32).reshape(-1, 2)
                ids.append(code.ids)
                starts.append(offsets[:, 0])
                ends.append(offsets[:, 1])
                masks.append(token_mask(offsets[:, 0], offsets[:, 1], spans))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in group], batch.column("conv_id").type), pa.array([g[1] for g in group]), pa.array(ids, ints),
                 pa.array(starts, ints), pa.array(ends, ints), pa.array(masks, pa.list_(pa.bool_()))],
                ["conv_id", "formatted", "input_ids", "starts", "ends", "loss_mask"],
            )


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``conv_id, formatted, input_ids, starts, ends, loss_mask``, one row per conversation."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    schema = f"conv_id {kind}, formatted string, input_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"
    conversations.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    return whole.mapInArrow(lambda it: _formatted(name, it), schema)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("conv_id", "formatted", "starts", "ends", "loss_mask")]
        for i in range(batch.num_rows):
            conv, text = columns[0][i].as_py(), columns[1][i].as_py()
            starts, ends, mask = (c[i].values.to_numpy(zero_copy_only=False) for c in columns[2:])
            turns, loss = read_back(text), masked_text(text, starts, ends, mask.astype(bool))
            said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            out.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(starts), int(mask.sum())))
        kinds = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        data = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays(
            [pa.array(d, k) for d, k in zip(data, kinds, strict=True)],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"],
        )


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from text, offsets and mask alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        _digested,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_tokens long, loss_tokens long",
    )
