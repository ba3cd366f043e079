"""Byte-pair encoding with a queue of merges over a linked list of symbols, and decoding from vocabulary strings."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mlwatch.llm.batches import released, slices

CACHED_CHUNKS = 1 << 17
CACHED_PIECES = 1 << 17
PLAIN = "ɐ"  # below it there are no combining marks, and every release of Unicode has the same letters and digits


class Codec:
    """Encoder and decoder for one vocabulary file of words-with-ends byte-pair encoding.

    A text is cut at spaces and line feeds, which never belong to a token. What stands between them is encoded once and
    kept in a memory of bounded size, the least lately used half of which is dropped when it is full.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids |= self.special
        names = [""] * (max(self.ids.values()) + 1)
        for name, i in self.ids.items():
            names[i] = name
        self.names = pa.array(names)
        own = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = own.normalizer, own.pre_tokenizer
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.between = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.shown = byte_characters()
        self.forget()

    def forget(self) -> None:
        """Empty the memory of what has been encoded: workers live on, and the tasks of later steps need room."""
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.new_pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def merge(self, shown: str) -> list[int]:
        """Ids of one pre-token, given as the visible stand-ins of its bytes.

        Symbols form a doubly linked list. A queue holds (rank, position) of every adjacent pair that can merge; the
        lowest rank goes first and the leftmost of equal ones. An entry whose pair has changed meanwhile is stale: it is
        skipped when it comes up.
        """
        ids, merges = self.ids, self.merges
        symbols = [ids[c] for c in shown]
        symbols[-1] = ids[shown[-1] + self.end]
        n = len(symbols)
        queue = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            found = merges.get((left, right))
            if found is not None:
                queue.append((found[0], i - 1, left, right, found[1]))
            left = right
        if not queue:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            _, i, left, right, merged = heappop(queue)
            j = after[i]
            if symbols[i] != left or j == n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                right = symbols[k]
                found = merges.get((merged, right))
                if found is not None:
                    heappush(queue, (found[0], i, merged, right, found[1]))
            h = before[i]
            if h >= 0:
                left = symbols[h]
                found = merges.get((left, merged))
                if found is not None:
                    heappush(queue, (found[0], h, left, merged, found[1]))
        return [s for s in symbols if s >= 0]

    def piece(self, text: str, shown: str | None = None) -> bytes:
        """Ids of one pre-token as 32-bit numbers."""
        key = shown if shown is not None else text
        got = self.new_pieces.get(key)
        if got is None:
            got = self.old_pieces.get(key)
            if got is None:
                if shown is None:
                    shown = "".join([self.shown[b] for b in text.encode()])
                got = array("i", self.merge(shown)).tobytes()
            if len(self.new_pieces) >= CACHED_PIECES:
                self.old_pieces, self.new_pieces = self.new_pieces, {}
            self.new_pieces[key] = got
        return got

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if max(text, default="") < PLAIN:
            return b"".join([self.piece(p) for p in self.pattern.findall(text.lower())])
        found = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return b"".join([self.piece("", p) for p, _ in found if p])

    def chunk(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            if self.between is not None and "<" in text:
                parts = self.between.split(text)
                got = b"".join(
                    [np.int32(self.special[p]).tobytes() if p in self.special else self.plain(p) for p in parts if p]
                )
            else:
                got = self.plain(text)
        if len(self.new) >= CACHED_CHUNKS:
            self.old, self.new = self.new, {"": b""}
        self.new[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers."""
        out = []
        for part in text.replace("\n", " ").split(" "):
            got = self.new.get(part)
            out.append(self.chunk(part) if got is None else got)
        return b"".join(out)

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        blobs = [self.encode(t) if t else b"" for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), np.int32)))

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """Vocabulary strings of the ids, joined as the vocabulary's lack of a decoder says: by one space."""
        flat = self.names.take(ids.flatten())
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy())]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat), " ")


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: itself where it can be shown, the next free one from 256 else."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the token ids of each whole text as an array of integers.

    A null or empty text gives an empty array. Strings of special tokens in a text are that token. Rows keep their
    columns, repeated ones too; a column that has the name of the new one is replaced. No row moves: one narrow pass.
    """
    kept = df.drop(into)
    schema = kept.select("*", F.lit(None).cast("array<int>").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in slices(batches, text):
            ids = own.encode_batch(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, into])
        own.forget()
        released()

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for; a null array gives an empty text."""
    kept = df.drop(into)
    schema = kept.select("*", F.lit(None).cast("string").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = own.decode_batch(part.column(ids).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, into])

    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows: columns ``ids`` and ``decoded`` join the others."""
    kept = df.drop("ids", "decoded")
    schema = kept.select(
        "*", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias("decoded")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in slices(batches, text):
            ids = own.encode_batch(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, ids, own.decode_batch(ids)], [*b.schema.names, "ids", "decoded"]
            )
        own.forget()
        released()

    return kept.mapInArrow(run, schema)
