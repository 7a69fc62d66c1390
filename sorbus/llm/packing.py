"""Order-preserving packing (operator 1).

The tokens of a partition's documents, in order, are cut into sequences. Cuts may fall at document ends, at sentence ends
(at a price) and, where none is near, anywhere (at a higher price). f(j) = price(j) + EACH + min over i with tokens(i, j) <= size
of f(i) + padding(tokens(i, j)): padding is size - tokens, with the least f(i) + position kept by a monotone queue; or none
where the length is a power of two, of which there are few to look at. EACH keeps sequences from getting short for that.
What is left at the end of a partition is cut into such lengths.

Null text counts as empty: only its end token. Repeated rows are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sorbus.llm.bpe import parse_ranks
from sorbus.llm.common import prepare, table, texts_of

SENTENCE, INSIDE, EACH, STEP = 4.0, 12.0, 24.0, 32
END_OF_TEXT = "<|endoftext|>"  # the added token after the ranks
HELD: dict[str, tuple] = {}


def tokenizer(path: str, pattern: str):
    """The encoder of a file of ranks, and the ids of tokens that end a sentence."""
    if path not in HELD:
        import tiktoken

        ranks = parse_ranks(open(path, "rb").read())
        ends = np.zeros(max(ranks.values()) + 2, bool)
        for token, i in ranks.items():
            ends[i] = token[-1:] in b".!?\n"
        HELD[path] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: max(ranks.values()) + 1}), ends)
    return HELD[path]


def choose_cuts(at: np.ndarray, price: np.ndarray, size: int) -> list[int]:
    """Indices of the candidate positions where sequences end; at[0] = 0 and the last one always is one."""
    pos, cost = at.tolist(), price.tolist()
    n = len(pos)
    f, back, place = [0.0] * n, [0] * n, {p: i for i, p in enumerate(pos)}
    whole = [1 << b for b in range(size.bit_length())]
    queue: deque[int] = deque([0])
    for j in range(1, n):
        p = pos[j]
        while p - pos[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best = f[i] + size - p + pos[i]
        for w in whole:
            k = place.get(p - w)
            if k is not None and f[k] < best:
                best, i = f[k], k
        f[j], back[j] = best + cost[j] + EACH, i
        v = f[j] + p
        while queue and f[queue[-1]] + pos[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    step = max(1, min(STEP, size))
    price = np.full(len(ids) + 1, np.inf)
    price[1:][ends[ids]] = SENTENCE
    price[np.cumsum(lengths)] = 0
    price[0] = price[-1] = 0
    at = np.flatnonzero(np.isfinite(price))
    gaps = np.flatnonzero(np.diff(at) > step)
    for g in gaps:
        price[np.arange(at[g] + step, at[g + 1], step)] = INSIDE
    at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def pack(docs: DataFrame, path: str, pattern: str, size: int = 2048, end_id: int = 1, block: int = 1 << 18) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) per piece.

    path: a file of ranks; every match of pattern is encoded apart, but a literal END_OF_TEXT is the added token.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, ends = tokenizer(path, pattern)
        number = TaskContext.get().partitionId() << 33
        held: list[list] = []  # doc_id, its ids, tokens already out

        def emit(last: bool):
            nonlocal number, held
            lengths = [len(x[1]) - x[2] for x in held]
            if not lengths:
                return None
            ids = np.concatenate([x[1][x[2] :] for x in held])
            at, price = candidates(ids, ends, lengths, size)
            cuts = at[choose_cuts(at, price, size)].tolist()
            tail = len(ids) if last else None
            if len(cuts) > 1 or last:
                begin = cuts[-2] if len(cuts) > 1 else 0
                cuts = cuts[:-1]
                if last:
                    rest = tail - begin
                    for bit in range(rest.bit_length() - 1, -1, -1):
                        if rest >> bit & 1:
                            begin += 1 << bit
                            cuts.append(begin)
            else:
                return None
            rows, k, start = [], 0, 0
            for cut in cuts:
                offset = 0
                while start < cut:
                    d, all_ids, done = held[k]
                    n = min(len(all_ids) - done, cut - start)
                    piece = all_ids[done : done + n].astype("<u4").tobytes()
                    rows.append((d, done, n, piece, len(all_ids), number, offset))
                    offset, start = offset + n, start + n
                    held[k][2] += n
                    if held[k][2] == len(all_ids):
                        k += 1
                number += 1
            held = held[k:]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        total = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for d, t in zip(part.column("doc_id").to_pylist(), texts_of(part.column("text")), strict=True):
                    ids = np.append(tok.encode_to_numpy(t, allowed_special="all").astype(np.int64), end_id)
                    held.append([d, ids, 0])
                    total += len(ids)
                    if total >= block:
                        if (made := emit(False)) is not None:
                            yield made
                        total = sum(len(x[1]) - x[2] for x in held)
        if (made := emit(True)) is not None:
            yield made

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_digest(pieces: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return with_digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
