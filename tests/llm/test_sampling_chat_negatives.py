"""Operators 11 to 13: against SQL on given tables, against plain loops on odd ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from sorbus.llm import chat, negatives, resample
from sorbus.llm.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_resampling", "op12_chat", "op13_negatives"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want, got = con.sql(SQL[name]).df(), QUERIES[name](spark, D).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(want)
    order = lambda f: f[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


# --- 11


def plain_resample(docs, target, orders, buckets, seed, percent, min_words):
    def grams(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in grams(x)[1]), Counter(b for x in target for b in grams(x)[1])
    n_s, n_t, out = sum(s.values()), sum(t.values()), []
    for d, x in docs:
        n, f = grams(x)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in f]
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[: percent * len(able) // 100])]
    left = Counter(tuple(r[:4]) for r in out) - Counter(r[:4] for r in drawn)
    return sorted([*drawn, *[(*r, None) for r in left.elements()]], key=str)


ODD = [
    (1, None), (2, ""), (3, "The Quick BROWN fox, jumps over 2 lazy dogs"), (3, "The Quick BROWN fox, jumps over 2 lazy dogs"), (3, "another text of this id"),
    (4, "Éa ÉA éa KK straße 漢字 \U0001f600 x\x00y _a{b}"), (5, "word " * 300), (None, "no id at all here"), (6, "!!! ... ---"), (7, "one"), (8, "a b"),
    (9, "x" * 3_000_000 + " " + "long text of many words " * 60_000),
]
TARGET = ["the quick fox", None, "", "lazy dogs jump over straße 漢字"]


@pytest.mark.parametrize(("orders", "min_words", "percent"), [((1, 1), 1, 100), ((1, 3), 2, 50), ((2, 3), 3, 40), ((1, 2), 10**6, 100), ((1, 2), 1, 0)])
def test_resampling_by_plain_loops(spark, orders, min_words, percent):
    docs, target = spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame([(t,) for t in TARGET], "text string")
    wide = docs.selectExpr("*", "1 as bucket", "2 as row", "'x' as `a, b`", "3 as gain", "4 as words")
    rows = resample.resample(wide, target, orders, 97, 5, percent, min_words, chunk=64)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, rows.collect()), key=str) == plain_resample(ODD, TARGET, orders, 97, 5, percent, min_words)


def test_resampling_of_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(7, "same words here")] * 40 + [(8, "same words here")] * 40, "doc_id long, text string")
    got = resample.resample(docs, docs.limit(0), (1, 2), 10, 1, 50, 1).collect()
    ranked = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 80 and ranked == list(range(1, 41)) and len({r.doc_id for r in got if r["rank"]}) == 1
    assert resample.resample(docs.limit(0), docs, (1, 1), 10, 1, 50, 1).count() == 0
    with pytest.raises(ValueError, match="orders"):
        resample.resample(docs, docs, (2, 1))


def test_drawn_documents(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more words", i % 3) for i in range(50)], "doc_id long, text string, kept int")
    found = resample.resample(docs, docs, percent=20, min_words=1)
    drawn = resample.drawn_documents(docs, found)
    assert drawn.count() == 10 and drawn.columns == docs.columns


def test_words_are_not_shuffled_for_order_one(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet")
    plan = resample.features(rows, (1, 1), 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" in plan
    assert "Window" in resample.features(rows, (1, 2), 100)._jdf.queryExecution().executedPlan().toString()


# --- 12


PIECES = ["<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "</SYS>>", "ROLE>>", "|endoftext|>", "a", *chat.CONTROLS, "é", "\n", "😀", ""]


def test_escaping_round_trips():
    rnd = random.Random(1)
    some = lambda n: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, n)))
    for _ in range(5000):
        t = some(8)
        assert chat.unescape(chat.escape(t)) == t and not chat.TURN.search(chat.escape(t))
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", some(3)]), some(6)) for _ in range(rnd.randint(0, 5))]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b, _ in spans] == [t for _, t in turns] and spans == sorted(spans)


def test_mask_by_plain_loops():
    rng = np.random.default_rng(2)
    for _ in range(200):
        edges = np.sort(rng.choice(60, 8, replace=False))
        spans = [(int(a), int(b), bool(rng.integers(2))) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        starts = np.sort(rng.integers(0, 60, 20))
        ends = starts + rng.integers(0, 4, 20)
        want = [any(said and a < e and s < b and s < e for a, b, said in spans) for s, e in zip(starts, ends, strict=True)]
        assert chat.loss_mask(starts, ends, spans).tolist() == want


def odd_chats():
    rnd = random.Random(3)
    some = lambda n: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, n)))
    rows = [(i, t, rnd.choice(["user", "assistant", "assistant", "system", "tool", None]), rnd.choice([None, some(9), some(9)])) for i in range(40) for t in range(rnd.randint(1, 6))]
    return [*rows, (50, None, None, None), (50, 0, "assistant", "x"), (50, 0, "assistant", "x"), (None, 1, "assistant", "no id"), (None, 0, "user", "?"), (60, 0, "user", "q"), (60, 1, "assistant", "word é漢 " * 300_000 + "</s>"), (61, 0, "assistant", "y" * 2_000_000)]


def test_chats_read_back(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = odd_chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as `n, turns`", "'z' as loss")
    made = chat.format_chats(df, public_tokenizers.path("byte_bpe_50k.json"))
    convs = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs[c].append((role or "", text or ""))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in made.collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        r, said = got[c], [t for role, t in turns if role == "assistant" and t]
        assert r.n_turns == len(turns) and chat.parse(r.formatted) == turns
        starts, ends, loss = np.array(r.starts), np.array(r.ends), np.array(r.loss, bool)
        assert chat.said(r.formatted, starts, ends, loss) == said
        plain = [i for i in r.ids if i <= 50256]
        assert max(r.ids) < 50257 + len(chat.CONTROLS)
        if c == 60:  # what lies between marks is encoded as the vocabulary encodes it
            tok.encode_special_tokens = True
            assert plain == [i for t in turns for i in tok.encode(chat.escape(t[1]), add_special_tokens=False).ids]
    for r in chat.digests(made).collect():
        turns = convs[r.conv_id]
        text = "".join(t for role, t in turns if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.digests(chat.format_chats(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


# --- 13


def plain_negatives(rows, every, n_pos, n_neg, low, high, scale):
    use = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    use = [r for r in use if max((x * x for x in r[2]), default=0) * len(r[2]) < negatives.LARGEST]
    anchors, out = {}, []
    for r in sorted(use):
        if r[0] % every == 0:
            anchors.setdefault(r[0], r)
    for a, lab, v in anchors.values():
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, other) for i, other, w in use if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:n_pos]:
            ok = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(ok[:n_neg])]
    return sorted(out)


def vectors(kind, n=260, d=9):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d)) * {"unit": 0.3, "large": 3000, "huge": 40_000, "tiny": 0.002}[kind]
    x = np.abs(x) if kind == "tiny" else x
    return [(int(i % 200), int(rng.integers(3)), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


ODD_VECTORS = [
    (None, 1, [1.0] * 9), (10, None, [1.0] * 9), (20, 1, None), (30, 1, [float("nan")] * 9), (30, 2, [None] + [1.0] * 8), (40, 1, [float("inf")] + [0.0] * 8),
    (50, 1, [1.0, 2.0]), (60, 1, [2.0, 1.0]), (70, 2, [1.5, 0.5]), (80, 0, []), (90, 0, []), (100, 1, []), (110, 0, [0.0] * 9), (120, 1, [3e38] * 9), (130, 1, [-2.0] * 9),
]


@pytest.mark.parametrize("kind", ["unit", "large", "huge", "tiny"])
def test_negatives_by_plain_loops(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "DENSE", 8)
    rows = vectors(kind) + ODD_VECTORS + vectors(kind)[:30]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as v", "2 as score", "3 as band", "4 as `a, b`").repartition(3)
    for low, high, block in ((50, 95, 4096), (-20, 120, 16)):
        got = negatives.mine(df, 10, 4, 3, low, high, 256, block).collect()
        assert sorted(map(tuple, got)) == plain_negatives(rows, 10, 4, 3, low, high, 256)


def test_pairs_that_cannot_qualify_are_dropped():
    rng = np.random.default_rng(5)
    v, q = rng.integers(-100, 100, (400, 16)), rng.integers(-100, 100, (20, 16))
    exact = v @ q.T
    low, high = np.full((20, 1), 1000), np.full((20, 1), 30_000)
    i, j, s = negatives.survivors(negatives.Planes(v), q, np.ones(exact.shape, bool), low, high, np.full((20, 1), negatives.OPEN), 3)
    assert (s == exact[i, j]).all() and len(i) < exact.size / 4
    for a in range(20):
        inside = sorted((x for x in exact[:, a] if 1000 <= x <= 30_000), reverse=True)[:3]
        assert sorted((x for x in s[j == a] if 1000 <= x <= 30_000), reverse=True)[:3] == inside


def test_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(df).count() == 0 and negatives.mine(df.limit(0)).count() == 0
    assert negatives.mine(df.limit(0)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# --- 8: prefixes by rising frequency


def test_shared_passages_form_no_tiles(spark):
    """Texts that share a passage, and else nothing: it comes last in their prefixes, so they don't meet; near copies do."""
    from sorbus.llm import jaccard

    rng = np.random.default_rng(7)
    passage = " ".join(f"common{i}" for i in range(40))
    own = lambda i, n=200: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, f"{passage} {own(i)}") for i in range(300)] + [(1000 + i, f"{passage} {own(i)} {rng.integers(9)}") for i in range(0, 300, 50)]
    docs = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string").coalesce(2)
    frequent = jaccard.frequent_shingles(docs, 4)
    assert 37 <= len(frequent) <= 60
    reps = jaccard.set_table(docs, 4, 85, frequent).withColumn("rep", jaccard.F.col("doc_id"))
    tiles = jaccard.blocks(reps).collect()
    assert tiles and max(len(r.reps) for r in tiles) <= 3
    plain = jaccard.blocks(jaccard.set_table(docs, 4, 85, frequent[:0]).withColumn("rep", jaccard.F.col("doc_id"))).collect()
    assert max(len(r.reps) for r in plain) > 100
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, 4, 85).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
