"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

BPE gives every prefix of a word one last token. An automaton over all tokens names, for each prefix, the
tokens it ends with; the last one is the candidate that BPE would keep apart from the unique last token of
the prefix before it. That border test undoes the merges of both sides, latest first, and fails if a merge
across the border would have come earlier. Following the last tokens back from the end gives the ids. The
work per word is linear in its length (times the few candidates), whatever the word, where merging by rank
needs a queue.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chat import TOKENIZER
from .textcore import CHUNK_BYTES

#: Fixed value: the public pattern by which this family of vocabularies splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded words kept for reuse by a task, the longest of them in bytes, and tested pairs of tokens kept.
CACHED_WORDS, CACHED_BYTES, CACHED_PAIRS = 1 << 17, 64, 1 << 18


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible Latin-1 characters stand for themselves, the others
    for 256, 257, ... in the order of the bytes."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixEncoder:
    """Encoder and decoder of one byte-level BPE vocabulary (the JSON text of a tokenizer file)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        added = {t["content"]: t for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added.values()):
            raise ValueError("added tokens that depend on their neighbours are not handled")
        ids = model["vocab"]
        self.size = n = 1 + max([*ids.values(), *(t["id"] for t in added.values())])
        self.bytes = [b""] * n
        for word, i in ids.items():
            self.bytes[i] = bytes(alphabet[c] for c in word)
        #: by token: place of its merge in the order of merges (-1: a single byte), and the two parts
        self.rank, self.parts = [-1] * n, [(-1, -1)] * n
        self.merges: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            token = ids[a + b]
            if self.rank[token] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[token], self.parts[token] = r, (ids[a], ids[b])
            self.merges[ids[a] * n + ids[b]] = r
        self.length = [len(b) for b in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for i in sorted(ids.values(), key=lambda i: self.rank[i]):
            if self._whole(i):
                self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.unknown = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.added = {c: t["id"] for c, t in added.items()}
        self.at_added = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(added, key=len, reverse=True)) + ")").split if added else None
        for c, i in self.added.items():
            self.bytes[i] = c.encode()
        self.cache, self.borders = _Words(self), _Borders(self)

    def _whole(self, token: int) -> bool:
        """BPE makes this token from its own bytes."""
        if self.rank[token] < 0:
            return self.length[token] == 1
        a, b = self.parts[token]
        return all(self.length[p] == 1 or self.automaton.exists(self.bytes[p].decode("latin-1")) for p in (a, b)) and self.apart(a, b, self.rank[token])

    def apart(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Does BPE leave the border between two neighbouring tokens alone, looking at merges that rank ``before``?

        The merge done last is undone first. A merge across the border wins if it ranks before the undone one;
        of equal merges the one further left is done first, so it also wins over an equal one on the right.
        """
        n, rank, parts, merges = self.size, self.rank, self.parts, self.merges
        while True:
            across = merges.get(left * n + right)
            if across is not None and across < before:
                return False
            if rank[left] > rank[right]:
                before, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                before, right = rank[right] + 1, parts[right][0]
            else:
                return True

    def word(self, word: bytes) -> list[int]:
        """Ids of one word, from the last tokens of its prefixes."""
        last, length, borders, n = [-1] * (len(word) + 1), self.length, self.borders, self.size
        for end, token in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = end - length[token]
                if not before or (last[before] >= 0 and borders[last[before] * n + token]):
                    last[end] = token
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def _words(self, text: str) -> Iterable[str]:
        if not text.isascii() and self.unknown[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():  # letters newer than this Python: the library's own splitter decides
            from tokenizers import pre_tokenizers

            spans = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
            return (text[a:b] for a, b in _whole_characters(o for _, o in spans))
        return self.split(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.at_added is None:
            return b"".join(map(self.cache.__getitem__, self._words(text)))
        out = []
        for k, piece in enumerate(self.at_added(text)):
            out.append(np.uint32(self.added[piece]).astype("<u4").tobytes() if k % 2 else b"".join(map(self.cache.__getitem__, self._words(piece))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of packed ids, special tokens included; ids beyond the vocabulary are skipped, broken UTF-8 is replaced."""
        a = np.frombuffer(ids, "<u4")
        return b"".join(map(self.bytes.__getitem__, a[a < self.size].tolist())).decode("utf-8", "replace")


class _Borders(dict):
    """Answers of the border test by pair of tokens; emptied when full."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, pair: int) -> bool:
        if len(self) >= CACHED_PAIRS:
            self.clear()
        self[pair] = found = self.encoder.apart(*divmod(pair, self.encoder.size))
        return found


class _Words(dict):
    """Packed ids by word; emptied when full."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = np.array(self.encoder.word(raw), "<u4").tobytes()
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


def _whole_characters(spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    at = 0
    for _, b in spans:
        if b > at:
            yield at, b
            at = b


@lru_cache(maxsize=2)
def encoder_of(vocabulary: str) -> PrefixEncoder:
    return PrefixEncoder(vocabulary)


def _mapped(docs: DataFrame, column: str, out: str, kind: str, tokenizer: str, how: str) -> DataFrame:
    """``docs`` with one more column, made from ``column`` row by row inside tasks."""
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType() if kind == "binary" else T.StringType())])
    arrow = pa.binary() if kind == "binary" else pa.string()
    place = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = getattr(encoder_of(vocabulary.value), how)
        empty = b"" if how == "decode" else ""
        for batch in batches:
            i, made, size = 0, [], 0
            for j, v in enumerate(batch.column(place), 1):
                v = v.as_py()
                made.append(use(empty if v is None else v))
                size += len(made[-1])
                if size >= CHUNK_BYTES or j == batch.num_rows:
                    part = batch.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, arrow)], names=[*batch.schema.names, out])
                    i, made, size = j, [], 0

    return docs.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, column: str = "text", out: str = "token_ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with the token ids of ``column``: binary, little-endian unsigned 32-bit integers.

    Ids are those of the library's encoder without special tokens added; the text of a special token is that
    token. Null and empty texts have no ids. Rows stay as they are, repeated ones too, with their other columns,
    null or not; an empty table gives none. A column already named ``out`` is replaced. A text
    is encoded whole and must fit a task; its words are taken one by one. The vocabulary file is read once on
    the driver and shipped to the tasks, so only its size is broadcast.
    """
    return _mapped(docs, column, out, "binary", tokenizer, "encode")


def decode_texts(encoded: DataFrame, column: str = "token_ids", out: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """``encoded`` with the text of its token ids, special tokens included; null ids give an empty text."""
    return _mapped(encoded, column, out, "string", tokenizer, "decode")


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, number of ids, and hashes of the ids and the decoded text."""
    return coded.select(
        "doc_id", F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
