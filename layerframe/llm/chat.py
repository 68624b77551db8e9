"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of the
turns to learn from are intersected with the sorted token spans by binary search.

Template: ``<s>`` then per turn ``[INST]role[/INST]text</s>``. Control strings inside roles and texts
are broken with a backslash (and backslashes doubled), so the markers are the only control strings
of the output and `parse` restores every role and text exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOS, EOS, HEAD, TAIL = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (BOS, EOS, HEAD, TAIL)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_TO_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Iterable[tuple[str, str]], learn: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the sorted character spans of the texts to learn from."""
    parts, spans, at = [BOS], [], len(BOS)
    for role, text in turns:
        head, body = f"{HEAD}{escape(role)}{TAIL}", escape(text)
        at += len(head)
        if role in learn and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(EOS)
        parts += (head, body, EOS)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    out = []
    for turn in formatted[len(BOS):].split(EOS)[:-1]:
        role, text = turn[len(HEAD):].split(TAIL)
        out.append((unescape(role), unescape(text)))
    return out


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token that overlaps a span; all inputs sorted."""
    mask = np.zeros(len(starts), bool)
    if spans and len(starts):
        a, b = np.array(spans).T
        for lo, hi in zip(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"), strict=True):
            mask[lo:hi] = True
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """Text under the masked tokens, each character once (tokens of one split character share its span)."""
    s, e = starts[mask], ends[mask]
    if not len(s):
        return ""
    e = np.maximum.accumulate(e)
    new = np.r_[True, s[1:] > e[:-1]]
    return "".join(formatted[a:b] for a, b in zip(s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]], strict=True))


FORMATTED = "conv_id bigint, n_turns bigint, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``FORMATTED``.

    Turns are ordered by turn number (null first), then role and text; repeated rows are repeated
    turns. Null text or role is empty. Rows without conv_id form one conversation without id. Empty
    table: no rows. Columns other than conv_id, turn, role and text are not read. A conversation is
    the unit that is encoded, so it must fit a task; its length is not otherwise limited. The
    vocabulary file is read once on the driver and shipped to the tasks, so only its size is broadcast.
    """
    spark = conversations.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        tok = Tokenizer.from_str(vocabulary.value)
        tok.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                rendered = [render(zip(r, t, strict=True), learn) for r, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                out = {k: [] for k in ("ids", "starts", "ends", "mask")}
                for (_, spans), e in zip(rendered, tok.encode_batch([r[0] for r in rendered], add_special_tokens=False), strict=True):
                    offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                    out["ids"].append(e.ids)
                    out["starts"].append(offsets[:, 0])
                    out["ends"].append(offsets[:, 1])
                    out["mask"].append(mask_tokens(offsets[:, 0], offsets[:, 1], spans))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(r) for r in b.column(1).to_pylist()], pa.int64()), pa.array([r[0] for r in rendered]), pa.array(out["ids"], pa.list_(pa.int32())),
                     pa.array(out["starts"], pa.list_(pa.int32())), pa.array(out["ends"], pa.list_(pa.int32())), pa.array(out["mask"], pa.list_(pa.bool_()))],
                    names=["conv_id", "n_turns", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"],
                )

    return whole.mapInArrow(encode, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """Read back what `format_conversations` made: turn and loss digests per conversation."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {k: [] for k in ("n", "turns", "chars", "loss", "size", "tokens", "learned")}
            for text, starts, ends, mask in zip(b.column("formatted").to_pylist(), b.column("token_starts"), b.column("token_ends"), b.column("loss_mask"), strict=True):
                turns = parse(text)
                m = np.array(mask.values.to_numpy(zero_copy_only=False), bool)
                under = unescape(masked_text(text, starts.values.to_numpy(), ends.values.to_numpy(), m))
                for k, v in zip(rows, (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), sha(under), len(text), len(m), int(m.sum())), strict=True):
                    rows[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], names=["conv_id", *rows])

    out = formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(read, "conv_id bigint, n bigint, turns string, chars bigint, loss string, size bigint, tokens bigint, learned bigint")
    return out.toDF("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens")
