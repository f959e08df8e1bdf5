"""Byte-pair encoding and decoding with a public vocabulary file, by a queue of merge ranks over linked symbols.

The vocabulary is read once on the driver and sent to the executors as a broadcast; its size is that of the file.

Defined cases: a null or empty text has no tokens and decodes to the empty text; very long texts are encoded whole;
repeated rows are encoded each; an empty table gives an empty result; other columns of the input are not looked at.
A special token's string inside a text is that token, as the tokenizers library has it by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a worker's caches; they are emptied when full, which costs time and changes no result.
CACHE_CHUNKS, CACHE_PIECES = 400_000, 300_000
#: Marks a symbol that was merged into the one before it.
GONE = 1 << 60
#: Capital letters that Python's lower-casing maps by their context or doesn't know, each with its own small letter.
LOWER_APART = str.maketrans({"Σ": "σ", "\u1c89": "\u1c8a", "\ua7cb": "\u0264", "\ua7cc": "\ua7cd", "\ua7da": "\ua7db", "\ua7dc": "\u019b"} | {chr(0x10D50 + i): chr(0x10D70 + i) for i in range(22)})


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself where Latin-1 prints it, else the next free code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary whose pieces end in a word-end mark: NFC, white space to blanks, lower case, split, bytes, merges."""

    def __init__(self, file: str | bytes):
        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        ids, self.bytes = self.vocab, byte_symbols()
        self.heads = [ids[s] for s in self.bytes]
        self.tails = [ids[s + self.end] for s in self.bytes]
        #: By rank: the pair of ids packed in one number, and the merged id.
        self.pairs: list[int] = []
        self.merged: list[int] = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.append(ids[a] << 20 | ids[b])
            self.merged.append(ids[a + b])
        self.ranks = {p: r for r, p in enumerate(self.pairs)}
        self.strings = {i: s for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(splits[0])
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.special_start = commonprefix(list(self.special))  # what all of them begin with: texts without it hold none
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self._shown: dict[str, str] = {}

    def piece(self, text: str) -> list[int]:
        """Ids of one piece. The queue holds (rank, position) as one number; if the pair there is another by now, it is stale."""
        data = text.encode()
        ids = [self.heads[b] for b in data]
        ids[-1] = self.tails[data[-1]]
        n, rank, pairs = len(ids), self.ranks.get, self.pairs
        queue, left = [], ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            if (r := rank(left << 20 | right)) is not None:
                queue.append(r << 32 | i)
            left = right
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            entry = heapq.heappop(queue)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] << 20 | ids[j] != pairs[r]:
                continue
            ids[i] = new = self.merged[r]
            ids[j] = GONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << 20 | ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << 20 | new)) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [i for i in ids if i != GONE]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without white space as little-endian 32-bit numbers; its decoded text goes to the cache beside."""
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).translate(LOWER_APART)
        parts, pieces, low = [], self._pieces, plain.lower()
        if low.isalpha():  # one run of letters
            found = (low,)
        elif low[-1] in ".,;:!?" and low[:-1].isalpha():
            found = (low[:-1], low[-1])
        else:
            found = self.pieces.findall(low)
        for p in found:
            if (packed := pieces.get(p)) is None:
                ids = self.piece(p)
                packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(p) < 64:
                    if len(pieces) >= CACHE_PIECES:
                        pieces.clear()
                    pieces[p] = packed
            parts.append(packed)
        out = parts[0] if len(parts) == 1 else b"".join(parts)
        if len(self._chunks) >= CACHE_CHUNKS:
            self._chunks.clear()
            self._shown.clear()
        self._chunks[chunk] = out
        self._shown[chunk] = " ".join([self.strings[i] for i in struct.unpack(f"<{len(out) // 4}I", out)])
        return out

    def encode_packed(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text as little-endian unsigned 32-bit numbers, and the decoded text."""
        ids, shown, cache, texts = [], [], self._chunks, self._shown
        for part in self.at_special.split(text) if self.special and self.special_start in text else (text,):
            if part in self.special:
                ids.append(struct.pack("<I", self.special[part]))
                shown.append(part)
                continue
            for chunk in _BLANKS.split(part) if _CONTROL.search(part) else part.split():
                if chunk:
                    ids.append(cache.get(chunk) or self._chunk(chunk))
                    shown.append(texts[chunk])
        return b"".join(ids), " ".join(shown)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, one blank between them (the file names no decoder); unknown ids are skipped."""
        return " ".join([s for s in map(self.strings.get, ids) if s is not None])


#: White space as the pattern \s of the file's normaliser has it: Unicode's property, without the separators 0x1C to 0x1F.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROL = re.compile("[\x1c-\x1f]")
_LOADED: dict[str, WordBpe] = {}


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with ids (array<int>), decoded (string) and n_tokens (long) for each whole text.

    Columns of docs named so are replaced. `vocabulary` is the path of a word-level BPE file.
    """
    with open(vocabulary, "rb") as f:
        spec = f.read()
    sent, name = docs.sparkSession.sparkContext.broadcast(spec), hashlib.sha256(spec).hexdigest()
    kept = [c for c in docs.columns if c not in ("ids", "decoded", "n_tokens")]
    if text not in kept:
        raise ValueError(f"no column {text}")
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _LOADED.get(name)  # a worker keeps the last vocabulary and its caches over tasks
        if model is None:
            _LOADED.clear()
            model = _LOADED[name] = WordBpe(sent.value)
        for big in batches:
            for start in range(0, big.num_rows, 1000):
                batch = big.slice(start, 1000)
                packed = [model.encode_packed(t or "") for t in batch.column(place).to_pylist()]
                flat = np.frombuffer(b"".join(p for p, _ in packed), "<u4").astype(np.int32)
                counts = np.array([len(p) // 4 for p, _ in packed], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                more = [pa.ListArray.from_arrays(offsets, flat), pa.array([d for _, d in packed], pa.string()), pa.array(counts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, "ids", "decoded", "n_tokens"])

    schema = T.StructType(list(docs.select(*[F.col(f"`{c}`") for c in kept]).schema))
    for name, kind in (("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType()), ("n_tokens", T.LongType())):
        schema = schema.add(name, kind)
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `encode_documents` reduced to digests within the same tasks."""
    encoded = encode_documents(docs.select("doc_id", "text"), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            ids, decoded = b.column("ids"), b.column("decoded")
            flat, at = np.asarray(ids.flatten(), "<u4"), np.asarray(ids.offsets)
            at = at - at[0]
            digests = [sha(flat[i:j].tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            texts = [sha(t) for t in decoded.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(spark: SparkSession) -> str:
    """spark.glossa.vocabulary where it is set, else the installed package's word-level file."""
    if named := spark.conf.get("spark.glossa.vocabulary", None):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
