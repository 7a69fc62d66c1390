"""Exact Jaccard join on word shingles (operator 8) and the groups that its links form.

Texts with the same shingle set are collapsed first, so a group of copies is one representative. Two sets with
100 |A & B| >= t |A | B| share one of the first n - ceil(t n / 100) + 1 shingles of each, in one order for all (prefix
filter): by rising frequency, so that passages which many texts share come last, then by hash. Frequencies are counted over
all texts, CHUNK_ROWS at a time, from FEW texts of these on; the FREQUENT most frequent shingles go to all executors, the
others count as rare. Which they are decides only how many sets meet: every order finds all links.
Rows of these prefixes meet by shingle, ordered by size; a shingle that one set alone has ends there. If a shingle at place
i of A is the first one that A and B share, they share n - i at most (position filter), so A reaches sets of at most
(100 n - (100 + t) i) / t shingles: the sets of a shingle are cut where none of the smaller ones reaches the next. What holds
together forms a tile, or blocks of BLOCK sets each, of which every two whose sizes can link form one; shingles with the same
sets form it once. In a tile, bitmaps of parities (their length follows the set's size) give an upper bound of the overlap by
counting bits: short ones first, which leave few rows of few tiles, then long ones. What passes is checked by an exact
intersection of the sorted shingle arrays, made once more from the texts of the sets that are left.

In each of ROUNDS rounds every set's likeliest candidate outside its group so far is checked, then all candidates whose
ends are still in different groups: what is left out can't change a group.

Null or wordless text: an empty set, linked with nothing. Fewer words than a shingle has: the whole sequence is one
shingle. Rows that share an id are one document: it is linked by any of its texts. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.llm.common import map_arrow, prepare, ragged, shingles, table, texts_of
from sorbus.operators.graph import connected_components, release, shared

BITS = 512
SHORT, LONG = 0.5, 4  # bits per shingle of the two bitmaps, at least
ROUNDS = 1  # of likeliest candidates, before all that are left
BLOCK = 2_000
MEET = 512
BROADCAST_KEYS = 200_000  # rows of ids alone, so a few MB
CHUNK_ROWS, FEW, FREQUENT = 1000, 3, 100_000


def words_of(text: str) -> list[bytes]:
    """Runs of other than the six ASCII white spaces, A-Z lower-cased; lower() and split() of bytes know ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def sets_of(texts: list[str], k: int) -> list[np.ndarray]:
    h, at = shingles(*ragged([words_of(t) for t in texts]), k)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def bitmap(s: np.ndarray, per: float) -> bytes:
    """Parity of the number of shingles per bit; `per` bits per shingle at least. Its halves fold into a shorter one."""
    size = max(BITS, 1 << int(len(s) * per).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1).astype(np.uint8)).tobytes()


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that several of CHUNK_ROWS texts share, the most frequent last; FREQUENT at most."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            found, n = np.unique(shingles(*ragged([words_of(t) for t in texts_of(batch.column("text").slice(at, CHUNK_ROWS))]), k)[0], return_counts=True)
            often = n >= FEW
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["tok", "n"])

    counts = map_arrow(docs.select("text"), run, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n"))
    return np.array([r.tok for r in counts.orderBy(F.desc("n"), "tok").limit(FREQUENT).select("tok").collect()], np.int64)[::-1].view(np.uint64)


def set_table(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, set_id, n, bits, short, pre): a 128-bit name of the set, its size, bitmaps and prefix; no text, no whole set."""
    by_hash = np.argsort(frequent)
    known = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash))

    def prefix(s: np.ndarray) -> bytes:
        length = len(s) - -(-percent * len(s) // 100) + 1
        hashes, ranks = known.value
        if not len(hashes) or not len(s):
            return s[:length].tobytes()
        at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
        often = hashes[at] == s
        rare = s[~often][:length]
        if len(rare) == length:
            return rare.tobytes()
        last = s[often][np.argsort(ranks[at[often]])]
        return np.concatenate([rare, last[: length - len(rare)]]).tobytes()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = sets_of(texts_of(part.column("text")), k)
            ids = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary())
            pre = pa.array([prefix(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array([len(s) for s in found], pa.int64()), pa.array([bitmap(s, LONG) for s in found], pa.binary()), pa.array([bitmap(s, SHORT) for s in found], pa.binary()), pre], names=["doc_id", "set_id", "n", "bits", "short", "pre"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, set_id binary, n long, bits binary, short binary, pre binary")


def prefixes(reps: DataFrame) -> DataFrame:
    """(tok, rep, size): a set's prefix; size is n times 2 ** 32 and the shingle's place, so its order is n's."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            pre = part.column("pre").to_pylist()
            lengths = np.array([len(x) // 8 for x in pre], np.int64)
            rows = np.repeat(np.arange(len(pre)), lengths)
            place = np.arange(len(rows)) - (np.cumsum(lengths) - lengths)[rows]
            size = (part.column("n").to_numpy()[rows] << 32) + place
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(pre), np.int64)), part.column("rep").take(pa.array(rows)), pa.array(size)], names=["tok", "rep", "size"])

    return map_arrow(reps.select("rep", "n", "pre"), run, "tok long, rep long, size long")


def cuts(tok: np.ndarray, n: np.ndarray, reach: np.ndarray, percent: int) -> np.ndarray:
    """Where rows sorted by tok and n begin a new run: another tok, or a size that no row before it with this tok reaches."""
    new = np.concatenate([[True], tok[1:] != tok[:-1]])
    base = np.cumsum(new) << 40  # more than any reach
    most = np.maximum.accumulate(base + reach) - base
    new[1:] |= most[:-1] < percent * n[1:]
    return np.flatnonzero(np.concatenate([new, [True]]))


def only(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of df with these keys; the keys go to all executors if they number at most BROADCAST_KEYS."""
    keys = shared(keys)
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def blocks(reps: DataFrame, percent: int) -> DataFrame:
    """(tok, part, name, lo, hi, reps): runs of sets with a shingle, by size, in blocks; part is -1 where there is but one."""
    rows = prefixes(reps).repartition("tok").sortWithinPartitions("tok", "size", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[bytes] = set()
        out: list[tuple] = []

        def block(tok: int, part: int, rep: np.ndarray, n: np.ndarray) -> None:
            name = xxhash.xxh3_128_digest(np.sort(rep).tobytes())
            if part < 0:
                if name in seen:
                    return
                if len(seen) >= 50_000:
                    seen.clear()
                seen.add(name)
            out.append((tok, part, name, int(n[0]), int(n[-1]), rep))

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            flat = pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in cols[5]]).astype(np.int32), pa.array(np.concatenate(cols[5])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)] + [flat], names=["tok", "part", "name", "lo", "hi", "reps"])

        tok = rep = n = reach = np.empty(0, np.int64)
        part = 0  # of the last run: blocks already out

        def group(lo: int, hi: int, done: int, last: bool) -> tuple[int, int]:
            """Blocks of the run lo to hi, of which `done` are out before; all rows go if it ends here."""
            while hi - lo > BLOCK:
                block(int(tok[lo]), done, rep[lo : lo + BLOCK], n[lo : lo + BLOCK])
                lo, done = lo + BLOCK, done + 1
            if last and (done or hi - lo > 1):
                block(int(tok[lo]), done if done else -1, rep[lo:hi], n[lo:hi])
            return lo, done

        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            more = (batch.column("tok").to_numpy(), batch.column("rep").to_numpy(), size >> 32, 100 * (size >> 32) - (100 + percent) * (size & 0xFFFFFFFF))
            tok, rep, n, reach = (np.concatenate(x) for x in zip((tok, rep, n, reach), more, strict=True))
            at = cuts(tok, n, reach, percent)
            rows_of, lo = np.diff(at), at[:-1]
            # Of two rows, the larger set must reach the smaller one too.
            go = (rows_of > 2) | ((rows_of == 2) & (reach[np.minimum(lo + 1, len(tok) - 1)] >= percent * n[lo]))
            go[0] |= part > 0
            for g in np.flatnonzero(go[:-1]).tolist():
                group(at[g], at[g + 1], part if g == 0 else 0, True)
            lo, part = group(at[-2], at[-1], part if len(at) == 2 else 0, False)
            if part:
                reach[lo] = reach[at[-2] :].max()  # what is out reaches on
            tok, rep, n, reach = tok[lo:], rep[lo:], n[lo:], reach[lo:]
            if len(out):
                yield made()
        if len(tok):
            group(0, len(tok), part, True)
        if out:
            yield made()

    return rows.mapInArrow(run, "tok long, part int, name binary, lo long, hi long, reps array<long>")


def fold(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of `size` bytes each, from longer ones."""
    out = np.zeros((len(bits), size // 8), np.uint64)
    for i, b in enumerate(bits):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, size // 8), 0)
    return out


def may_link(rows: list[tuple], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, q, like) of the rows (side, rep, n, bits, label) of a tile, sorted by n and rep: places p before q that may link.

    Rows of one label aren't compared, nor are rows of the same side 0 or 1.
    """
    side, n, label = (np.array([r[i] for r in rows], np.int64) for i in (0, 2, 4))
    a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    bits, held, one = [r[3] for r in rows], {}, side[0] == 2
    width = np.array([len(x) for x in bits])
    # Sets of one width at a time, so that no short set's bitmap decides how far a long set's is folded.
    edge = np.unique(np.concatenate([np.arange(0, len(b), 128), 1 + np.flatnonzero(np.diff(width[b])), [len(b)]]))
    for x, end in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        y = b[x:end]
        # Both sides are sorted by size: only sizes that can link are compared, in a single tile each pair once.
        lo = np.searchsorted(n[a], -(-percent * n[y[0]] // 100))
        z = a[lo : np.searchsorted(n[a], n[y[-1]], "right")]
        if not len(z):
            continue
        size = int(min(width[z].min(), width[y].min()))
        if size not in held:
            held[size] = np.zeros((len(rows), size // 8), np.uint64)
            held[size][width >= size] = fold([w for w in bits if len(w) >= size], size)
        bit = held[size]
        far = np.zeros((len(z), len(y)), np.int64)
        for w in range(bit.shape[1]):
            far += np.bitwise_count(bit[z, w][:, None] ^ bit[y, w][None, :])
        na, ny = n[z][:, None], n[y][None, :]
        most = np.minimum((na + ny - far) // 2, np.minimum(na, ny))
        before = z[:, None] < y[None, :] if one else np.ones((1, 1), bool)
        other = label[z][:, None] != label[y][None, :]
        p, q = np.nonzero((100 * most >= percent * (na + ny - most)) & before & other)
        if len(p):
            yield z[p], y[q], (most / (na + ny - most))[p, q]


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[tuple]]]:
    """(tile, its rows (side, rep, n, bits, label)) of batches sorted by tile."""
    held, key = [], None
    for batch in batches:
        for t in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "rep", "n", "bits", "label")), strict=True):
            if t[0] != key:
                if len(held) > 1:
                    yield key, held
                held, key = [], t[0]
            held.append(t[1:])
    if len(held) > 1:
        yield key, held


def in_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.repartition("tile").sortWithinPartitions("tile", "n", "rep").select("tile", "side", "rep", "n", "bits", "label")


def flagged(tiles: DataFrame, percent: int) -> DataFrame:
    """(tile, side, rep): the rows of tiles that may link with another one there, by short bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, rows in by_tile(batches):
            hit = np.zeros(len(rows), bool)
            for p, q, _ in may_link(rows, percent):
                hit[p] = hit[q] = True
            if hit.any():
                at = np.flatnonzero(hit).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(at), pa.binary()), pa.array([rows[i][0] for i in at], pa.int32()), pa.array([rows[i][1] for i in at], pa.int64())], names=["tile", "side", "rep"])

    return in_tiles(tiles.withColumn("label", F.col("rep"))).mapInArrow(run, "tile binary, side int, rep long")


def candidates(tiles: DataFrame, percent: int, best: bool) -> DataFrame:
    """(src, dst) of tile rows (tile, side, rep, n, bits, label): sets that may link and have not the same label.

    With `best`, for each dst only the likeliest src. src comes before dst by size, then by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # tiles of a group hold many of its pairs again
        for _, rows in by_tile(batches):
            if len({r[4] for r in rows}) == 1:
                continue
            rep = np.array([r[1] for r in rows], np.int64)
            for p, q, like in may_link(rows, percent):
                if best:
                    order = np.lexsort((rep[p], -like, q))
                    order = order[np.concatenate([[True], q[order][1:] != q[order][:-1]])]
                    p, q, like = p[order], q[order], like[order]
                pairs = list(zip(rep[p].tolist(), rep[q].tolist(), strict=True))
                new = np.array([x not in seen for x in pairs])
                if len(seen) > 300_000:
                    seen.clear()
                seen.update(pairs)
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rep[p[new]]), pa.array(rep[q[new]]), pa.array(like[new])], names=["src", "dst", "like"])

    made = in_tiles(tiles).mapInArrow(run, "src long, dst long, like double")
    if best:
        return made.groupBy("dst").agg(F.min(F.struct(-F.col("like"), "src")).alias("x")).select("x.src", "dst")
    return made.select("src", "dst").distinct()


def meetings(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the sets of pairs meet: (hub, i, j, src, dst) per pair, and (hub, i, j, doc_id) per set and meeting.

    All pairs of a cluster meet at its least set, so its sets' arrays go there once. The sets of a hub are dealt into buckets
    of some MEET; a meeting holds two buckets, however large the hub.
    """
    hubs = connected_components(pairs).withColumnRenamed("component", "hub")
    at = pairs.join(hubs.withColumnRenamed("node", "src"), "src")
    size = at.select("hub", F.explode(F.array("src", "dst")).alias("doc_id")).distinct().groupBy("hub").agg(F.ceil(F.count("*") / MEET).alias("g"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.col("g")).cast("int")
    i, j = bucket("src"), bucket("dst")
    at = shared(at.join(size, "hub").select("hub", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), "src", "dst"))
    return at, at.select("hub", "i", "j", F.explode(F.array("src", "dst")).alias("doc_id")).distinct()


def exact(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (src, dst) that link, by the sorted shingle arrays of their sets (rep, set_id, doc_id).

    Arrays are made from the texts where these lie and shuffled once, to their meetings.
    """
    at, to = meetings(pairs)
    wanted = shared(to.withColumnRenamed("doc_id", "rep").join(sets.select("rep", "set_id", "doc_id"), "rep"))
    rows = only(docs.select("doc_id", "text"), wanted, ["doc_id"], "inner").select("hub", "i", "j", "rep", "set_id", "doc_id", "text")

    def arrays(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            texts, names = texts_of(part.column("text")), part.column("set_id").to_pylist()
            new = np.cumsum([i == 0 or t != texts[i - 1] for i, t in enumerate(texts)]) - 1  # rows of one text follow each other
            own = [s.tobytes() for s in sets_of([t for i, t in enumerate(texts) if i == 0 or t != texts[i - 1]], k)]
            is_it = [xxhash.xxh3_128_digest(x) for x in own]
            # A repeated id has several texts; only that whose set is the one in question counts.
            good = pa.array([is_it[i] == n for i, n in zip(new.tolist(), names, strict=True)])
            arrs = pa.array([own[i] for i in new.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("hub", "i", "j", "rep")), arrs], names=["hub", "i", "j", "src", "arr"]).filter(good)

    made = map_arrow(rows, arrays, "hub long, i int, j int, src long, arr binary")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = made.select("hub", "i", "j", F.lit(0).alias("kind"), "src", none("dst", "long"), "arr").union(at.select("hub", "i", "j", F.lit(1), "src", "dst", none("arr", "binary")))
    spread = both.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "kind")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, {}
        for batch in batches:
            src, dst = [], []
            for *here, kind, s, d, arr in zip(*(batch.column(c).to_pylist() for c in ("hub", "i", "j", "kind", "src", "dst", "arr")), strict=True):
                if here != key:
                    key, sets = here, {}
                if not kind:
                    sets[s] = np.frombuffer(arr, np.uint64)
                    continue
                a, b = sets[s], sets[d]
                same = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * same >= percent * (len(a) + len(b) - same):
                    src.append(s)
                    dst.append(d)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return shared(spread.select("hub", "i", "j", "kind", "src", "dst", "arr").mapInArrow(check, "src long, dst long"))


def links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(src, dst) of the sets (rep, set_id, doc_id, n, bits, pre) that link: enough to connect all that links connect."""
    made = shared(blocks(reps, percent))
    one = made.select(F.col("name").alias("tile"), F.lit(2).alias("side"), "reps").dropDuplicates(["tile"])
    split = made.where("part >= 0")
    at = lambda x: split.select("tok", *[F.col(c).alias(f"{c}_{x}") for c in ("part", "name", "lo", "hi", "reps")])
    two = at("a").join(at("b"), "tok").where(f"part_a < part_b and hi_a <= hi_b and 100 * hi_a >= {percent} * lo_b")
    two = two.select(F.concat("name_a", "name_b").alias("tile"), "reps_a", "reps_b").dropDuplicates(["tile"])
    two = two.select("tile", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("reps_a").alias("reps")), F.struct(F.lit(1).alias("side"), F.col("reps_b").alias("reps")))).alias("x")).select("tile", "x.*")
    rows = one.union(two).select("tile", "side", F.explode("reps").alias("rep"))
    likely = shared(flagged(rows.join(reps.select("rep", "n", F.col("short").alias("bits")), "rep"), percent))
    held = shared(only(reps.select("rep", "set_id", "doc_id", "n", "bits"), likely.select("rep").distinct(), ["rep"]))
    del reps, made, one, split, two, rows
    release(docs.sparkSession)
    known = None
    for turn in range(ROUNDS + 1):
        best = turn < ROUNDS
        if known is None:
            labelled = likely.withColumn("label", F.col("rep"))
        else:
            comps = connected_components(known).withColumnRenamed("node", "rep")
            labelled = only(likely, comps, ["rep"], "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
            mixed = labelled.groupBy("tile").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("tile")
            labelled = labelled.join(mixed, "tile", "left_semi")
        pairs = shared(candidates(labelled.join(held.select("rep", "n", "bits"), "rep"), percent, best))
        release(docs.sparkSession)
        new = exact(docs, held, pairs, k, percent)
        known = new if known is None else shared(known.union(new))
        release(docs.sparkSession)
    return known


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs; a null doc_id is left out."""
    prepare(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    wide = shared(set_table(docs, k, percent, frequent_shingles(docs, k)))
    full = wide.where("n > 0").withColumn("rep", F.xxhash64("set_id"))
    first = F.min(F.struct("doc_id", "n", "bits", "short", "pre")).alias("r")
    reps = shared(full.groupBy("rep", "set_id").agg(first).select("rep", "set_id", "r.*"))
    names = shared(reps.select("rep", "set_id", "doc_id"))
    sets = shared(wide.select("doc_id", "set_id", "n"))
    several = sets.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a != b").select("doc_id")
    same = shared(sets.where("n > 0").select("doc_id", F.xxhash64("set_id").alias("rep")).join(several, "doc_id", "left_semi").distinct())
    given = [reps]
    del wide, full, reps
    release(docs.sparkSession)
    bound = same.join(same.groupBy("doc_id").agg(F.min("rep").alias("dst")), "doc_id").select(F.col("rep").alias("src"), "dst")
    comps = connected_components(shared(links(docs, given.pop(), k, percent).union(bound))).withColumnRenamed("node", "rep")
    release(docs.sparkSession)
    group = shared(names.join(comps, "rep", "left").select("set_id", "rep", "doc_id", F.coalesce("component", "rep").alias("g")))
    least = group.join(group.groupBy("g").agg(F.min("doc_id").alias("c")), "g").select("set_id", "rep", "c")
    own = same.join(least, "rep").groupBy("doc_id").agg(F.min("c").alias("own"))
    out = sets.select("doc_id", "set_id", "n").join(least.select("set_id", "c"), "set_id", "left").join(own, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("own", "c", "doc_id").alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents at a Jaccard likeness of 0.85 on 4-word shingles."""
    return jaccard_groups(table(spark, sf_dir, "documents"), 4, 85)
