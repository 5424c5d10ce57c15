"""Operator 3: byte-level BPE encoding and decoding.

A text is cut at special tokens, then into words by the pattern of byte-level
BPE.  A word's parts and the ranks of its adjacent pairs stand in two contiguous
arrays; the lowest rank is found by a scan, its boundary deleted, and the ranks
beside it refreshed.  Words of over ``LONG`` parts use a heap of pairs with the
same order of merges, as the scans would take quadratic time.  Encoded words
are kept in caches of a fixed number of entries.

Decoding looks up the bytes of each id and joins them; bytes that are no UTF-8
become U+FFFD.

Defined cases: a null text is empty, an empty text has no tokens and its digests
are those of no bytes; repeated rows are encoded each; null ids stay null; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spool as S

#: Parts beyond which a word is merged by a heap.
LONG = 200
#: Entries of a cache.
CACHED = 400_000
#: A vocabulary file beyond this size is not sent to the executors.
FILE_BYTES = 64 << 20

#: White space as Unicode has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_EDGES = regex.compile(rf"[{_SPACE}][{_SPACE}]|^[{_SPACE}]|[{_SPACE}]$")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    def __init__(self, file: str):
        spec = json.loads(file)
        letters, model = byte_letters(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = [model["vocab"][c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        vocab = model["vocab"]
        #: (left << 32 | right) -> (rank << 32 | merged)
        self.merge = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.after, self.alone = _Cache(self, " "), _Cache(self, "")

    def word(self, text: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.byte_id[b] for b in text]
        if len(parts) > LONG:
            return self._by_heap(parts)
        get, none = self.merge.get, 1 << 62
        ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i] = low & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], none)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.merge.get
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = r & 0xFFFFFFFF, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < n and (x := get(parts[k] << 32 | parts[nxt[k]])) is not None:
                    heapq.heappush(heap, (x, k, parts[k], parts[nxt[k]]))
        return [p for p in parts if p >= 0]

    def pack(self, text: str) -> bytes:
        """Ids of the words of a text, four bytes each."""
        out = []
        for w in WORDS.findall(text):
            if len(w) > 40:
                ids = self.word(w.encode())
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(self.alone.word(w))
        return b"".join(out)

    def segment(self, text: str) -> bytes:
        if not text:
            return b""
        if _EDGES.search(text):  # a space may belong to what stands on either side
            return self.pack(text)
        first, *rest = text.split(" ")
        return self.alone[first] + b"".join(map(self.after.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self.segment(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.segment(text[at:m.start()]), struct.pack("<I", self.special[m.group()])]
            at = m.end()
        return b"".join([*out, self.segment(text[at:])])

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


class _Cache(dict):
    """Text without a space -> packed ids of it, standing after ``lead``."""

    def __init__(self, tokenizer: Tokenizer, lead: str):
        super().__init__()
        self.tokenizer, self.lead, self.words = tokenizer, lead, {}

    def word(self, w: str) -> bytes:
        x = self.words.get(w)
        if x is None:
            ids = self.tokenizer.word(w.encode())
            x = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.words) < CACHED // 2:
                self.words[w] = x
        return x

    def __missing__(self, text: str) -> bytes:
        t = self.tokenizer
        if "\n" in text:  # a line feed between two words is a word of its own
            head, *lines = text.split("\n")
            gap = t.alone.word("\n")
            return b"".join([self[head], *(gap + t.alone[x] for x in lines)])
        out = t.pack(self.lead + text)
        if len(self) < CACHED and len(text) <= 40:
            self[text] = out
        return out


_OPEN: dict[int, Tokenizer] = {}

KINDS = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
         "decoded": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def _encode(shared, columns: tuple[str, ...]):
    def run(batches):
        key = hash(shared.value)
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Tokenizer(shared.value)
        t = _OPEN[key]
        for piece in S.pieces(batches, 2 << 20):
            out: dict[str, list] = {c: [] for c in columns}
            for i in range(len(piece)):
                ids = t.encode(piece.doc(i).decode("utf-8", "replace"))
                if "ids" in out:
                    out["ids"].append(np.frombuffer(ids, "<i4"))
                if "n_tokens" in out:
                    out["n_tokens"].append(len(ids) // 4)
                if "ids_sha256" in out:
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                if "decoded" in out or "decoded_sha256" in out:
                    text = t.decode(ids)
                    if "decoded" in out:
                        out["decoded"].append(text)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.ids.cast(pa.int64()), *(pa.array(out[c], KINDS[c][1]) for c in columns)], ["doc_id", *columns])
    return run


def bpe_encode(docs: DataFrame, vocabulary: str, columns: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, and decode the ids where a column asks for it.

    columns: any of ids, n_tokens, ids_sha256, decoded, decoded_sha256.
    vocabulary: path of a tokenizer file, read by the driver.
    """
    file = Path(vocabulary)
    if file.stat().st_size > FILE_BYTES:
        raise ValueError(f"{vocabulary}: over {FILE_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(file.read_text(encoding="utf-8"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(shared, tuple(columns)), ", ".join(["doc_id long", *(f"{c} {KINDS[c][0]}" for c in columns)]))


def _decode(shared):
    def run(batches):
        t = Tokenizer(shared.value)
        for b in batches:
            texts = [t.decode(np.asarray(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of arrays of ids; null is an empty array."""
    shared = encoded.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids"))
    return rows.mapInArrow(_decode(shared), "doc_id long, text string")
