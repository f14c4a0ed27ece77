"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that stands next to each other inside no token of the vocabulary can never be joined by a
merge, so every place where such a pair occurs is a certain cut: what stands left and right of it encodes
independently. The most frequent of these, a letter before white space, is also certain for the pre-tokenizer
(none of its alternatives crosses one, and none looks back), so whole texts are first split there; each piece
then runs through the pre-tokenizer's pattern, is cut at the remaining forced pairs, and only the fragments are
merged. Pieces repeat, so their ids are kept in a table of bounded size.

Supports tokenizers of the byte-level BPE kind in the tokenizers library's JSON form, with special tokens
recognised in the text as that library does by default (no added specials, no truncation, no padding).

Defined results: a null text encodes like an empty one, to no ids; other columns are ignored; repeated rows give
repeated rows; any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quire.session import ship

#: Pre-tokenizer pattern of the byte-level kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode White_Space, as a class of a pattern (fixed value).
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TABLE_ENTRIES = 300_000
LONGEST_KEPT = 48
NEVER = 1 << 60


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary, by the kind's rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Table(dict):
    """text -> its ids, as packed little-endian unsigned 32-bit integers.

    Of two generations: when the younger is full it becomes the elder, and what is asked for again moves back.
    """

    def __init__(self, encode):
        self.encode, self.elder = encode, {}

    def __missing__(self, text: str) -> bytes:
        found = self.elder.get(text)
        if found is None:
            found = self.encode(text)
        if len(text) <= LONGEST_KEPT:
            if len(self) >= TABLE_ENTRIES:
                self.elder = dict(self)
                self.clear()
            self[text] = found
        return found


class ByteBPE:
    def __init__(self, spec: str):
        import regex

        spec = json.loads(spec)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
        letters = _byte_alphabet()
        self.token = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.id = {t: i for i, t in self.token.items()}
        self.rank: dict[tuple[int, int], int] = {}  # a pair's place in the order of merges
        self.merged: list[int] = []  # what the merge at that place gives
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.rank[self.id[a], self.id[b]] = rank
            self.merged.append(self.id[a + b])
        self.byte_id = [self.id.get(bytes([b])) for b in range(256)]
        self.inside = bytearray(1 << 16)  # by pair of bytes: does it stand inside any token
        for t in self.token.values():
            for x, y in zip(t, t[1:]):
                self.inside[x << 8 | y] = 1
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.special_at = regex.compile(f"({marks})") if marks else None
        self.words = regex.compile(PATTERN)
        self.pieces = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.table, self.word = _Table(self._piece), _Table(self._word)

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.words.findall(piece)))

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        inside = self.inside
        cuts = [i for i, x in enumerate(zip(raw, raw[1:]), 1) if not inside[x[0] << 8 | x[1]]]
        ids: list[int] = []
        for s, e in zip([0, *cuts], [*cuts, len(raw)]):
            ids += self._fragment(raw[s:e])
        return struct.pack(f"<{len(ids)}I", *ids)

    def _fragment(self, raw: bytes) -> list[int]:
        """Merges in order of rank, leftmost first, with a heap: long fragments take n log n steps."""
        ids = [self.byte_id[x] for x in raw]
        if len(ids) <= 24:
            return self._short(ids)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.merged[self.rank[pair]], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], i, p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in self.rank:
                heapq.heappush(heap, (self.rank[p], before[i], p))
        return [i for i in ids if i >= 0]

    def _short(self, ids: list[int]) -> list[int]:
        """The same for a short fragment, by looking for the least rank each time."""
        get = self.rank.get
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [self.merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as packed little-endian unsigned 32-bit integers."""
        parts = self.special_at.split(text) if self.special_at and any(s in text for s in self.special) else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.table.__getitem__, self.pieces(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(spec: str) -> ByteBPE:
    return ByteBPE(spec)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) and, where wanted, ids array<int> and decoded string.

    tokenizer: the path of a tokenizer file. The driver reads it and ships its contents, a few MB by the size of
    the vocabulary, so executors need no copy of it.
    """
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 256):
                part = b.slice(at, 256)
                n, ids_hex, text_hex, ids, texts = [], [], [], [], []
                for t in part.column(1):
                    packed = bpe.encode(t.as_py() or "")
                    text = bpe.decode(packed)
                    n.append(len(packed) // 4)
                    ids_hex.append(hashlib.sha256(packed).hexdigest())
                    text_hex.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(packed, "<i4"))
                    if with_decoded:
                        texts.append(text)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
                cols += [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [pa.array(texts, pa.string())] * with_decoded
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_decoded])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(ids: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) from arrays of ids; null or empty arrays give an empty text."""
    ship(ids.sparkSession)
    spec = ids.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for b in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return ids.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {ids.schema[id_col].dataType.simpleString()}, text string")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def session_encode(spark: SparkSession, texts: list[str], tokenizer: str) -> list[list[int]]:
    """Encodes a few texts on the driver, for tests and exploration."""
    bpe = ByteBPE(Path(tokenizer).read_text("utf-8"))
    return [np.frombuffer(bpe.encode(t), "<u4").tolist() for t in texts]
