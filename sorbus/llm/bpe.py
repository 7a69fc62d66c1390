"""Byte-level BPE encoding and decoding (operator 9).

A text is cut before every single space that has no white space on either side. No pre-token spans such a cut, so each
chunk is encoded alone. Arrow cuts a block of texts, finds its distinct chunks and lays their ids out again; a bounded
cache holds the ids of chunks between blocks. Within a chunk not yet cached there are two tiers: a minimal perfect hash
over the vocabulary resolves each pre-token that is itself a token; the others are merged with a heap over a linked list
of bytes.

Null text counts as empty: no ids. A text may hold any code point; what cannot be decoded as UTF-8 alone (ids cut within
a character) comes back as the same bytes. Extra columns pass through except those named like the new column.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.llm.common import prepare, table

CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = rf"^{SPACE}| {SPACE}|{SPACE} | $"
BLOCK_BYTES = 4_000_000


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most BLOCK_BYTES of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encode_texts(texts: pa.Array, first: Callable[[list[str]], list[bytes]], later: Callable[[list[str]], list[bytes]]) -> pa.Array:
    """The ids of each text as bytes. `first` encodes distinct chunks that open a text, `later` those after a space.

    Texts in which a space has white space beside it are cut by a regular expression, all others at each space.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, ODD)
    made, order = [], np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
    for some in (pc.split_pattern(texts.filter(pc.invert(odd)), " "), pa.array([CUT.split(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))):
        if not len(some):
            continue
        edges, flat = some.offsets.to_numpy().astype(np.int64), some.flatten()
        coded, opens = flat.dictionary_encode(), flat.take(pa.array(edges[:-1])).dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = pa.array(later(words) + first(opens.dictionary.to_pylist()), pa.large_binary())
        which = coded.indices.to_numpy().astype(np.int64)
        which[edges[:-1]] = len(words) + opens.indices.to_numpy()
        out = ids.take(pa.array(which))
        ends = np.frombuffer(out.buffers()[1], np.int64)[edges]
        made.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends), out.buffers()[2]]))
    if not made:
        return pa.array([], pa.binary())
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return pa.concat_arrays(made).take(pa.array(back)).cast(pa.binary())


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys to 0..n-1, a displacement per bucket of about four keys, or the slot of a lone key."""

    def __init__(self, keys: list[bytes]):
        import xxhash

        n = max(1, len(keys))
        self.n, self.m = n, n // 4 + 1
        h = [xxhash.xxh3_128_intdigest(k) for k in keys]
        lo, hi = np.array([x & 0xFFFFFFFF for x in h], np.int64), np.array([x >> 32 & 0xFFFFFFFF for x in h], np.int64)
        step = np.array([x >> 64 & 0xFFFFFFFF for x in h], np.int64)
        bucket = lo % self.m
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.m + 1))
        self.shift, self.slot = np.zeros(self.m, np.int64), np.full(n, -1, np.int64)
        free, spare = np.ones(n, bool), None
        for b in np.argsort(-np.diff(edges), kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if not len(own):
                break
            if len(own) == 1:  # buckets come by falling size: the rest take the free slots one by one
                if spare is None:
                    spare = iter(np.flatnonzero(free).tolist())
                at = next(spare)
                self.shift[b], self.slot[at] = -1 - at, own[0]
                continue
            d = 0
            while True:
                at = self.place(hi[own], step[own], d)
                if free[at].all() and len(set(at.tolist())) == len(at):
                    break
                d += 1
            self.shift[b], free[at], self.slot[at] = d, False, own
        self.shift, self.slot = self.shift.tolist(), self.slot.tolist()

    def __call__(self, key: bytes) -> int:
        """The only index that the key can have."""
        import xxhash

        x = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(x & 0xFFFFFFFF) % self.m]
        return self.slot[-1 - d if d < 0 else self.place(x >> 32 & 0xFFFFFFFF, x >> 64 & 0xFFFFFFFF, d)]

    def place(self, hi, step, d: int):
        """The d-th choice of a slot; under 2^62, so alike for arrays and integers."""
        return ((hi ^ (d * 0x9E3779B1 & 0xFFFFFFFF)) * (step & 0x3FFFFFFF | 1) >> 20) % self.n


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}


class Vocabulary:
    """Tokens and ranks, with the two tiers of look-up."""

    PIECES, CHUNKS = 250_000, 250_000

    def __init__(self, raw: bytes, pattern: str):
        import regex

        self.ranks = parse_ranks(raw)
        self.tokens = list(self.ranks)
        self.ids = [self.ranks[t] for t in self.tokens]
        by_id = [b""] * (max(self.ids, default=-1) + 1)
        for i, token in zip(self.ids, self.tokens, strict=True):
            by_id[i] = token
        self.by_id = pa.array(by_id, pa.large_binary())
        self.find = PerfectHash(self.tokens)
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.first, self.later = Chunks(self, ""), Chunks(self, " ")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: always join the two neighbours of least rank, the left ones on a tie."""
        ranks, n = self.ranks, len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a = part[i]
            if a is None or (j := after[i]) >= n or len(a) + len(b := part[j]) != size:
                continue  # one of the two has been merged since
            part[i], part[j] = (a := a + b), None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(a + part[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(part[k])))
            if (k := before[i]) >= 0 and (r := ranks.get(part[k] + a)) is not None:
                heapq.heappush(heap, (r, k, len(part[k]) + size))
        return [ranks[p] for p in part if p is not None]

    def piece(self, word: str) -> bytes:
        got = self.pieces.get(word)
        if got is None:
            raw = word.encode("utf-8", "surrogatepass")
            k = self.find(raw)
            ids = [self.ids[k]] if self.tokens[k] == raw else self.merge(raw)
            got = np.array(ids, "<u4").tobytes()
            if len(word) <= 64:
                if len(self.pieces) >= self.PIECES:
                    self.pieces.clear()
                self.pieces[word] = got
        return got

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return encode_texts(texts, self.first.all, self.later.all)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes that each row of ids stands for."""
        raw = [x or b"" for x in ids.to_pylist()]
        edges = np.cumsum([0] + [len(x) // 4 for x in raw])
        out = self.by_id.take(pa.array(np.frombuffer(b"".join(raw), "<u4")))
        ends = np.frombuffer(out.buffers()[1], np.int64)[edges] if edges[-1] else edges
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(ends), out.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())


class Chunks(dict):
    """chunk -> ids, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lead: str):
        self.vocabulary, self.lead = vocabulary, lead

    def __missing__(self, part: str) -> bytes:
        got = b"".join(map(self.vocabulary.piece, self.vocabulary.split(self.lead + part)))
        if len(part) <= 64:
            if len(self) >= Vocabulary.CHUNKS:
                self.clear()
            self[part] = got
        return got

    def all(self, parts: list[str]) -> list[bytes]:
        return [self[p] for p in parts]


HELD: dict[int, Vocabulary] = {}


def vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    """Built once in a worker."""
    key = hash((raw, pattern))
    if key not in HELD:
        HELD.clear()
        HELD[key] = Vocabulary(raw, pattern)
    return HELD[key]


def with_column(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    df = df.drop(name)
    return df, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` binary"])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """df with `out`: the ids of `text` as little-endian unsigned 32-bit integers.

    The vocabulary file is read on the driver and broadcast; its size, about 1 MB, doesn't grow with the data.
    """
    spark = prepare(df.sparkSession)
    raw = spark.sparkContext.broadcast(open(ranks_path, "rb").read())
    if not keep_text and out != text:
        df = df.select(*[c for c in df.columns if c != out])
    df, schema = with_column(df, out)
    if not keep_text:
        schema = ", ".join(x for x in schema.split(", ") if not x.startswith(f"`{text}` "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value, pattern)
        for batch in batches:
            for part in blocks(batch, text):
                ids = v.encode(part.column(text))
                kept = [(n, part.column(n)) for n in part.schema.names if keep_text or n != text]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + [ids], names=[n for n, _ in kept] + [out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with `out`: the bytes that the ids stand for."""
    spark = prepare(df.sparkSession)
    raw = spark.sparkContext.broadcast(open(ranks_path, "rb").read())
    df, schema = with_column(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value, pattern)
        for batch in batches:
            for part in blocks(batch, ids):
                made = v.decode(part.column(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes that these decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs, path, public_tokenizers.PATTERN, keep_text=False)
    both = decode(ids, path, public_tokenizers.PATTERN)
    return both.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
