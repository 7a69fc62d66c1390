"""Removal of repeated byte strings (operator 6).

Each string of `size` bytes has a key: the least hash of its grams of size/2 bytes, so equal strings meet under one key.
Consecutive strings of one key form a segment. Equal segments collapse to their first occurrence: within a batch of texts
before anything is shuffled, so a segment that many texts share is one row a batch, then under their key. All others are
repeats throughout. Under keys with several different segments, or one in which
the key's gram occurs twice (a short period), the first occurrences are compared by a Burrows-Wheeler
transform: intervals of suffixes that agree in l bytes are extended backward to l + 1, all intervals of a length at once,
dropping those of one suffix, until `size`; what is left are exactly the repeated strings. Segments of more than
GROUP_BYTES under one key are not compared together: they are cut again, by the least hash of longer grams, and equal
ones collapse again. Where these still have more than GROUP_BYTES under one key, each string gets a third key, a hash of
all its bytes, and the first of a key stays.

Null text: empty. Texts below `size` bytes keep all. A row is its doc_id and its text (`th`, the hash of it): equal rows
share their ranges, other texts of the same id are documents of their own, ordered by `th`. An empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorbus.llm.common import Stored, map_arrow, mix64, prepare, table, texts_of
from sorbus.operators.graph import release, shared

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
GROUP_BYTES = 1_000_000
SLICE_BYTES = 8 << 20  # of text whose segments are collapsed at once, but a longer text is a slice of its own
POWERS = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(POWERS.get("b", ())) < n:
        m = max(n, 1 << 16)
        for name, base in (("b", BASE), ("i", INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            POWERS[name] = np.multiply.accumulate(x)
    return POWERS["b"], POWERS["i"]


def segments(raw: bytes, size: int, k: int, seed: int = 0) -> list[np.ndarray]:
    """Keys (least hashes of grams of k bytes, under a seed), content hashes, starts and lengths of the segments of a text,
    and whether the key's gram occurs twice in it."""
    n = len(raw)
    if n < size:
        return [*[np.empty(0, np.int64)] * 4, np.empty(0, bool)]
    b, inv = powers(n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[np.frombuffer(raw, np.uint8)] * b[:n], out=p[1:])
    h = mix64((p[k:] - p[: n - k + 1]) * inv[: n - k + 1] + np.uint64(seed))
    width, m, span = size - k + 1, h, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: len(h) - width + 1], m[width - span : width - span + len(h) - width + 1])
    at = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    end = np.concatenate([at[1:], [len(m)]]) - 1 + size
    content = mix64((p[end] - p[at]) * inv[at] + np.uint64(0x51) * (end - at).astype(np.uint64))
    grams = end - at - k + 1
    edge = np.cumsum(grams) - grams
    inside = np.repeat(at - edge, grams) + np.arange(grams.sum())
    twice = np.add.reduceat(h[inside] == np.repeat(m[at], grams), edge, dtype=np.int64) > 1
    return [m[at].view(np.int64), content.view(np.int64), at, end - at, twice]


def string_hashes(raw: bytes, size: int) -> np.ndarray:
    """A hash of every string of `size` bytes."""
    n = len(raw) - size + 1
    b, inv = powers(len(raw) + 1)
    p = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[np.frombuffer(raw, np.uint8)] * b[: len(raw)], out=p[1:])
    return mix64((p[size:] - p[:n]) * inv[:n]).view(np.int64)


def raw_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


SEGMENT = ["key", "sh", "doc_id", "th", "pos", "n", "twice"]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in some column; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def split_repeats(key: np.ndarray, sh: np.ndarray, doc: np.ndarray, th: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in this order: which open a (key, sh), and which repeat its opening at another place."""
    first = changes(key, sh)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return first, (doc != doc[lead]) | (th != th[lead]) | (pos != pos[lead])


def segment_table(docs: DataFrame, size: int) -> DataFrame:
    """Rows SEGMENT: the first of equal segments in a slice of texts; and, with null `twice`, byte ranges that repeat one."""

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total = np.cumsum([len(t) for t in texts_of(batch.column("text"))])
        lo = 0
        while lo < len(total):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            doc, th = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            made = [segments(raw_of(t), size, size // 2) for t in texts_of(part.column("text"))]
            which = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
            if not len(which):
                continue
            key, sh, pos, n, twice = (np.concatenate([m[i] for m in made]) for i in range(5))
            doc, th = doc[which], th[which]
            order = np.lexsort((pos, th, doc, sh, key))
            key, sh, doc, th, pos, n, twice = (x[order] for x in (key, sh, doc, th, pos, n, twice))
            first, again = split_repeats(key, sh, doc, th, pos)
            yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (key, sh, doc, th, pos, n, twice)], names=SEGMENT)
            if again.any():
                doc, th, pos, end = (x[again] for x in (doc, th, pos, pos + n))
                order = np.lexsort((pos, th, doc))
                doc, th, pos, end = (x[order] for x in (doc, th, pos, end))
                new = np.flatnonzero(changes(doc, th) | np.append(True, pos[1:] > end[:-1]))  # ends rise within a text
                end = end[np.append(new[1:], len(doc)) - 1]
                doc, th, pos = doc[new], th[new], pos[new]
                spread = mix64(doc.view(np.uint64) ^ mix64(pos.view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.zeros(len(new), np.int64)), pa.array(doc), pa.array(th), pa.array(pos), pa.array(end - pos), pa.nulls(len(new), pa.bool_())], names=SEGMENT)

    return map_arrow(docs, run, "key long, sh long, doc_id long, th long, pos long, n long, twice boolean")


def settle(segs: DataFrame) -> DataFrame:
    """(key, doc_id, th, pos, n): byte ranges that repeat a segment, with null key; and, under keys with several different
    segments or a short period, the first of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stub, out = None, False  # the row that opens the last (key, sh), and whether the firsts of its key go out

        def rows(keys: pa.Array, cols: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, *(pa.array(c) for c in cols)], names=["key", "doc_id", "th", "pos", "n"])

        for batch in batches:
            done = batch.filter(batch.column("twice").is_null())
            if done.num_rows:
                yield rows(pa.nulls(done.num_rows, pa.int64()), [done.column(c).to_numpy() for c in SEGMENT[2:6]])
            live = batch.filter(batch.column("twice").is_valid())
            if not live.num_rows:
                continue
            cols = [live.column(c).to_numpy(zero_copy_only=False) for c in SEGMENT]
            if stub is not None:
                cols = [np.append(s, c).astype(c.dtype) for s, c in zip(stub, cols, strict=True)]
            key, sh, doc, th, pos, n, twice = cols
            first, again = split_repeats(key, sh, doc, th, pos)
            if again.any():
                yield rows(pa.nulls(int(again.sum()), pa.int64()), [c[again] for c in (doc, th, pos, n)])
            runs = np.flatnonzero(changes(key))
            mixed = (np.add.reduceat(first, runs, dtype=np.int64) > 1) | np.logical_or.reduceat(twice, runs)
            held = stub is not None and out  # the stub has gone out, and so do all firsts of its key
            mixed[0] |= held
            go = first & np.repeat(mixed, np.diff(np.append(runs, len(key))))
            if held:
                go[0] = False
            if go.any():
                yield rows(pa.array(key[go]), [c[go] for c in (doc, th, pos, n)])
            last = np.flatnonzero(first)[-1]
            stub, out = [c[last] for c in cols], bool(mixed[-1])

    spread = segs.repartition("key").sortWithinPartitions("key", "sh", "doc_id", "th", "pos")
    return spread.select(*SEGMENT).mapInArrow(run, "key long, doc_id long, th long, pos long, n long")


def suffix_array(s: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the suffixes by their first `upto` values at least (prefix doubling); and names, by place, of the strings
    of the length, at most `upto`, that comes third."""
    n, k, rank, named = len(s), 1, s.astype(np.int64), (s.astype(np.int64), 1)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - k)] = rank[k:] + 1
        both = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(both)
        new = np.cumsum(np.append(False, both[order][1:] != both[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if k <= upto:
            named = rank, k
        if k > upto or new[-1] == n - 1:
            return order, *named


def repeated(parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, in the joined parts, of the strings of `size` bytes that occur twice or more, and a name of each string."""
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    s = np.empty(starts[-1], np.int64)
    for i, p in enumerate(parts):
        s[starts[i] : starts[i + 1] - 1] = np.frombuffer(p, np.uint8).astype(np.int64) + len(parts)
        s[starts[i + 1] - 1] = i  # ends differ, so no string that spans one repeats
    sa, named, length = suffix_array(s, size)
    bwt = s[sa - 1]
    row_of = np.empty(len(s), np.int64)
    row_of[sa] = np.arange(len(s))
    lf = row_of[sa - 1]
    # The order is known from names of strings of `length`: the intervals of these are where the expansion sets out.
    name = named[sa]
    rows = np.flatnonzero(np.bincount(name)[name] > 1)
    name = name[rows]
    spot = np.full(len(s), -1, np.int64)
    for _ in range(size - length):
        keep = bwt[rows] >= len(parts)  # an end is never extended over
        rows, name = rows[keep], name[keep]
        if not len(rows):
            break
        to = lf[rows]
        spot[to] = name
        rows = np.sort(to) if len(to) < len(s) // 16 else np.flatnonzero(spot >= 0)
        name, char = spot[rows], s[sa[rows]]
        spot[rows] = -1
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (char[1:] != char[:-1]) | (rows[1:] != rows[:-1] + 1)])
        name = np.cumsum(new) - 1
        several = np.bincount(name)[name] > 1
        rows, name = rows[several], name[several]
    return sa[rows], name


def later(segs: list[tuple], size: int) -> list[tuple[tuple, int, int]]:
    """(row, start, end) of strings in segments (row, pos, bytes) that also start earlier in another one."""
    at, name = repeated([x[2] for x in segs], size)
    if not len(at):
        return []
    starts = np.cumsum([0] + [len(x[2]) + 1 for x in segs])
    which = np.searchsorted(starts, at, "right") - 1
    rows = sorted({x[0] for x in segs})
    code = {x: i for i, x in enumerate(rows)}
    doc = np.array([code[x[0]] for x in segs], np.int64)[which]
    pos = np.array([x[1] for x in segs], np.int64)[which] + at - starts[which]
    order = np.lexsort((pos, doc, name))
    doc, pos, name = doc[order], pos[order], name[order]
    first = np.concatenate([[True], name[1:] != name[:-1]])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    flag = (doc != doc[lead]) | (pos != pos[lead])
    doc, pos = doc[flag], pos[flag]
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    if not len(doc):
        return []
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)]))
    end = np.concatenate([new[1:], [len(doc)]]) - 1
    return list(zip([rows[i] for i in doc[new]], pos[new].tolist(), (pos[end] + size).tolist(), strict=True))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def ranges(docs: DataFrame, size: int = 100) -> DataFrame:
    """(doc_id, th, spans): per text its byte ranges [a, b) that repeat strings which start earlier."""
    docs = docs.withColumn("th", text_hash())
    settled = Stored(settle(segment_table(docs, size)))
    release(docs.sparkSession)
    whole = settled.df.where("key is null").select("doc_id", "th", F.col("pos").alias("a"), (F.col("pos") + F.col("n")).alias("b"))
    firsts = settled.df.where("key is not null")
    hot = firsts.groupBy("key").agg(F.sum("n").alias("total")).where(F.col("total") > GROUP_BYTES).select("key", F.lit(True).alias("hot"))
    own = firsts.join(hot, "key", "left").groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", F.coalesce("hot", F.lit(False)).alias("hot"), "pos", "n")).alias("segs"))
    once = docs.join(own, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for d, h, t, found in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), texts_of(batch.column("text")), batch.column("segs").to_pylist(), strict=True):
            raw = raw_of(t)
            rows = [(x["key"], None, d, h, x["pos"], raw[x["pos"] : x["pos"] + x["n"]], None) for x in found if not x["hot"]]
            for x in found:
                for lo in range(x["pos"], x["pos"] + x["n"] - size + 1 if x["hot"] else 0, 65_536):
                    part = raw[lo : min(lo + 65_535 + size, x["pos"] + x["n"])]
                    rows += [(key, sh, d, h, lo + at, part[at : at + n], twice) for key, sh, at, n, twice in zip(*(c.tolist() for c in segments(part, size, 9 * size // 10, 1)), strict=True)]
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[lo : lo + 10_000], strict=True), kinds, strict=True)], names=names)

    names = ["key", "sh", "doc_id", "th", "pos", "raw", "twice"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    pieces = Stored(map_arrow(once.select("doc_id", "th", "text", "segs"), cut, "key long, sh long, doc_id long, th long, pos long, raw binary, twice boolean"))
    release(docs.sparkSession)
    # Those cut again: equal ones collapse; what is still different under one key is compared, or told apart by string.
    here, one, several = F.struct("doc_id", "th", "pos"), Window.partitionBy("key", "sh"), Window.partitionBy("key")
    finer = pieces.df.where("sh is not null").withColumn("opens", F.min(here).over(one) == here)
    differ = (F.min("sh").over(several) != F.max("sh").over(several)) | F.max("twice").over(several)
    finer = finer.withColumns({"differ": differ, "total": F.sum(F.when(F.col("opens"), F.length("raw"))).over(several)})
    kind = F.when(~F.col("opens"), 0).when(F.col("differ"), F.when(F.col("total") > GROUP_BYTES, 2).otherwise(1))
    finer = finer.select("key", "doc_id", "th", "pos", F.length("raw").alias("n"), F.when(F.col("opens"), F.col("raw")).alias("raw"), kind.alias("kind")).where("kind is not null")
    finer = Stored(finer)
    cold = pieces.df.where("sh is null").select("key", "doc_id", "th", "pos", "raw").union(finer.df.where("kind = 1").select("key", "doc_id", "th", "pos", "raw"))
    cold = cold.repartition("key").sortWithinPartitions("key", "doc_id", "th", "pos")

    def strings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k, d, h, p, r in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "th", "pos", "raw")), strict=True):
            made = string_hashes(r, size)
            cols = [pa.repeat(pa.scalar(x, pa.int64()), len(made)) for x in (k, d, h)]
            yield pa.RecordBatch.from_arrays([cols[0], pa.array(made), cols[1], cols[2], pa.array(p + np.arange(len(made)))], names=["key", "whole", "doc_id", "th", "pos"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, total = [], None, 0

        def out():
            r = later(held, size)
            return pa.RecordBatch.from_arrays([pa.array([x[0][i] for x in r], pa.int64()) for i in range(2)] + [pa.array([x[i] for x in r], pa.int64()) for i in (1, 2)], names=["doc_id", "th", "a", "b"])

        for batch in batches:
            for k, d, h, p, r in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "th", "pos", "raw")), strict=True):
                if k != key and total > GROUP_BYTES:
                    yield out()
                    held, total = [], 0
                key = k
                held.append(((d, h), p, r))
                total += len(r)
        if held:
            yield out()

    hashed = map_arrow(finer.df.where("kind = 2").select("key", "doc_id", "th", "pos", "raw"), strings, "key long, whole long, doc_id long, th long, pos long")
    again = hashed.withColumn("opens", F.min(here).over(Window.partitionBy("key", "whole")) == here).where("not opens")
    found = whole.union(cold.mapInArrow(match, "doc_id long, th long, a long, b long"))
    found = found.union(finer.df.where("kind = 0").select("doc_id", "th", "pos", F.col("pos") + F.col("n"))).union(again.select("doc_id", "th", "pos", F.col("pos") + size))
    spans = shared(found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    settled.drop()
    pieces.drop()
    finer.drop()
    release(docs.sparkSession)
    return spans


def remove_repeats(docs: DataFrame, size: int = 100, as_text: bool = False) -> DataFrame:
    """docs with `kept`, n_bytes, n_removed and n_spans; other columns pass through.

    kept: the remaining bytes; or as text, which they are but for characters cut in two at a removed run: these go.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "spans__", "th__")
    spans = ranges(docs.select("doc_id", "text").where("doc_id is not null"), size).select("doc_id", F.col("th").alias("th__"), F.col("spans").alias("spans__"))
    both = docs.withColumn("th__", text_hash()).join(spans, ["doc_id", "th__"], "left").drop("th__")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name != "spans__"), f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = []
        for t, found in zip(texts_of(batch.column("text")), batch.column("spans__").to_pylist(), strict=True):
            raw, parts, end, gone, n = raw_of(t), [], 0, 0, 0
            for a, b in sorted((x["a"], x["b"]) for x in found or []):
                if a > end or n == 0:
                    parts.append(raw[end:a])
                    n, gone, end = n + 1, gone + b - a, b
                elif b > end:
                    gone, end = gone + b - end, b
            parts.append(raw[end:])
            left = b"".join(parts)
            made.append((left.decode("utf-8", "ignore") if as_text else left, len(raw), gone, n))
        kept = [c for c in batch.schema.names if c != "spans__"]
        cols = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string() if as_text else pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + cols, names=[*kept, "kept", "n_bytes", "n_removed", "n_spans"])

    return map_arrow(both, run, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], size: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """The same by a set of all strings, in order; for tests."""
    seen, out = set(), {}
    for d in sorted(texts):
        raw = texts[d]
        mark = np.zeros(len(raw), bool)
        for i in range(len(raw) - size + 1):
            s = raw[i : i + size]
            if s in seen:
                mark[i : i + size] = True
            seen.add(s)
        spans = int(mark[0]) + int((mark[1:] & ~mark[:-1]).sum()) if len(raw) else 0
        kept = np.frombuffer(raw, np.uint8)[~mark].tobytes()
        out[d] = (len(raw), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out
