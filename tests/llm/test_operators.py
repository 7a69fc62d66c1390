import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sorbus.llm import aq, bpe, fingerprint, html, jaccard, langid, lm, packing, suffix, toxicity
from sorbus.llm.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "the quick brown fox jumps over the lazy dog " * 40, "en", "a", 1),
    (4, "the quick brown fox jumps over the lazy dog " * 40, "en", "b", 1), (5, "ééé " * 900, "fr", "b", 1), (6, "one two", "en", None, 7),
    (7, "ONE two", "en", "a", 7), (8, "123 456 !!!", None, "a", 11), (6, "one two", "en", None, 7), (9, "x" * 20000 + " y", "en", "a", 20002),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{D}/documents.parquet'").fetchall())


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    length, cover = Counter(), Counter()
    for r in sorted(QUERIES["op1_packing"](spark, D).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == length[r.sequence_id] and r.start == cover[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        length[r.sequence_id] += r.length
        cover[r.doc_id] += r.length
    assert cover == {d: len(v) for d, v in ids.items()} and max(length.values()) <= 2048
    assert sum(2048 - n for n in length.values() if n & (n - 1)) < 0.03 * sum(length.values())


def test_packing_of_the_added_token(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(p.path("byte_bpe_50k.json"))  # as it is, so the literal token is one id
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "end.<|endoftext|><|endoftext|>\n x <|endoftext"), (4, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN).orderBy("doc_id", "start").collect()
    ids = defaultdict(list)
    for r in got:
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert ids == {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows} and 50256 in ids[2]


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    pad = lambda n: 0 if n & (n - 1) == 0 else 8 - n
    for _ in range(30):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 6, 12))])
        price = rng.integers(0, 5, len(at)).astype(float)
        best = [0.0] + [np.inf] * 12
        for j in range(1, 13):
            best[j] = min(best[i] + pad(at[j] - at[i]) + price[j] + packing.EACH for i in range(j) if at[j] - at[i] <= 8)
        cuts = [0, *packing.choose_cuts(at, price, 8)]
        assert sum(pad(at[j] - at[i]) + price[j] + packing.EACH for i, j in zip(cuts, cuts[1:])) == pytest.approx(best[12])


def test_packing_into_short_sequences(spark):
    import public_tokenizers as p

    df = spark.createDataFrame([(i, "some words and more of them " * i) for i in range(20)], "doc_id long, text string").coalesce(1)
    for size in (1, 2, 7, 31):
        got = packing.pack(df, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, size).collect()
        length = Counter()
        for r in got:
            length[r.sequence_id] += r.length
        assert max(length.values()) <= size and sum(length.values()) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    make = lambda bad: " ".join([*rng.choice(words, 30), *(["vile"] if bad else []), *rng.choice(words, 10)])
    rows = [(make(i % 4 == 0), int(i % 4 == 0)) for i in range(300)]
    model = toxicity.train(rows)
    df = spark.createDataFrame([(1, "a clean text w1", 0), (2, "w2 w3 Vile w4", 1), (3, None, 0), (4, "", 0)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert got[2].score > 0.7 > 0.3 > got[1].score and got[3].score == got[4].score < 0.5
    assert [(s.begin, s.end) for s in got[2].spans] == [(6, 10)] and got[1].spans == []
    turkish = spark.createDataFrame([(1, "İ w3 vile w4")], "doc_id long, text string")  # lower case is a character longer
    assert [(s.begin, s.end) for s in toxicity.score(turkish, model).first().spans] == [(5, 9)]
    assert toxicity.train([("a", 1)]) is None and toxicity.score(df, None).count() == 4


def test_toxicity_query(spark):
    """Held-out documents against their labels; and the marginals against all paths of a short text."""
    d = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    rows = QUERIES["op2_toxicity"](spark, d).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p and y for p, y in held) >= 0.7 * sum(y for _, y in held) and sum(p and not y for p, y in held) <= 0.02 * len(held)
    rng = np.random.default_rng(5)
    model = {"moves": rng.normal(size=(2, 2)), "start": rng.normal(size=(2, 2))}
    score = rng.normal(size=5)
    weight = np.zeros((5, 2))
    for path in range(32):
        y = [path >> t & 1 for t in range(5)]
        w = np.exp(model["start"][:, y[0]]).sum() * np.exp(sum(model["moves"][a, b] for a, b in zip(y, y[1:])) + score[np.array(y) == 1].sum())
        weight[np.arange(5), y] += w
    assert toxicity.marginals(score, np.array([0]), model)[0] == pytest.approx(weight[:, 1] / weight.sum(1))


def test_forward_by_blocks():
    m = np.random.default_rng(2).random((300, 2, 2))
    v, want = np.array([0.5, 0.5]), []
    for x in m:
        v = v @ x
        want.append(v := v / v.sum())
    assert np.allclose(toxicity.forward(m, np.array([0.5, 0.5])), want)


def test_fingerprint(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op3_fingerprint"](spark, D).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for k, d in enumerate(ids):
        e = fingerprint.edited(texts[d], texts[ids[(k + 1) % len(ids)]])
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[d].fingerprint == fingerprint.to_text(fingerprint.sketch(texts[d]))
    exact = lambda t: fingerprint.sketch(t, scale=1)  # noqa: E731  every hash is below the threshold
    off, shares = [], []
    for k, d in enumerate(ids):
        t, n = texts[d], texts[ids[(k + 1) % len(ids)]]
        e = fingerprint.edited(t, n)
        assert got[d].n_chars == len(t) and (got[d].edited_fingerprint == got[d].fingerprint or t != e)
        back, made = fingerprint.from_text(got[d].edited_fingerprint), fingerprint.sketch(e)
        assert back.bound == made.bound and (back.hashes == made.hashes).all()
        for near, share, o in ((got[d].near_edited, got[d].in_edited, e), (got[d].near_next, got[d].in_next, n)):
            a, b = exact(t), exact(o)
            off.append(abs(near - fingerprint.likeness(a, b, t == o)))
            used = fingerprint.compared(fingerprint.sketch(t), fingerprint.sketch(o))[0]
            shares.append((share - fingerprint.containment(a, b)) * np.sqrt(used))
            assert off[-1] < 0.4
    assert np.mean(off) < 0.03 and np.max(np.abs(shares)) < 2.5
    long = [r for r in got.values() if r.n_chars > 2000]
    assert sum(len(r.fingerprint) for r in long) < sum(r.n_chars for r in long) / 10


def test_sketch_bounds():
    """What is kept, and that sketches merge to that of the texts together, however unequal they are."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 300_000)]
    whole, part = " ".join(words), " ".join(words[7000:7400])
    w, p, every = fingerprint.sketch(whole), fingerprint.sketch(part), fingerprint.sketch(whole, scale=1)
    assert w.bound == 2**40 // fingerprint.SCALE and len(every.hashes) == 299_996
    assert (w.hashes == every.hashes[every.hashes < w.bound]).all() and abs(len(w.hashes) / len(every.hashes) * fingerprint.SCALE - 1) < 0.05
    assert len(p.hashes) == fingerprint.LEAST and p.bound > w.bound
    assert fingerprint.containment(p, w) == 1 and fingerprint.containment(w, p) < 0.01
    both = fingerprint.sketch(f"{whole} {part}")
    merged = fingerprint.merge(w, p)
    assert merged.bound == w.bound and set(merged.hashes) <= set(both.hashes) and len(both.hashes) - len(merged.hashes) <= 4
    few = fingerprint.sketch("a b c d e f")
    assert few.bound == 2**40 and len(few.hashes) == 2 and fingerprint.from_text(fingerprint.to_text(few)).bound == 2**40
    none = fingerprint.sketch("")
    assert fingerprint.likeness(none, none, True) == 1 and fingerprint.likeness(none, few, False) == 0


def test_fingerprint_of_a_long_text_and_many_ranges(spark):
    rows = [(i, f"a{i} b c d e f g", i) for i in range(0, 900, 3)] + [(450, "x y z " * 1_000_000, 1), (901, None, 2), (None, "lost", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket long").repartition(40)
    got = {(r.doc_id, r.n_chars): r for r in fingerprint.fingerprints(df).collect()}
    assert len(got) == 302 and got[450, 6_000_000].in_next == 0 and got[901, 0].near_edited == 1
    order = sorted(((d, t or "") for d, t, _ in rows if d is not None))
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        assert got[d, len(t)].edited_sha256 == hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest()


def test_html(spark):
    model = html.trained()
    page = "<head><title>T</title><style>x</style></head><body><nav><a href='/'>Home</a></nav><article><h1>Big  news</h1><p>One &amp; two<br>three</p><p>Four</article><footer>f</footer></body>"
    assert html.main_text(page, model) == "Big news\n\nOne & two three\n\nFour"
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, page, "z")], "page_id long, html string, text string")
    assert [r.n_chars for r in html.extract(df).orderBy("page_id").collect()][:2] == [0, 0]


def test_html_of_all_pages(spark):
    """The registered query against what a regular expression finds in the one layout that the pages have."""
    from html import unescape

    d = "/root/testdata/sf0.01"

    def article(page):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1].replace("<br>", " ")
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body))
        return "\n\n".join(x for x in parts if x)

    want = {i: (url, article(page)) for i, url, page in duckdb.sql(f"select page_id, url, html from '{d}/pages.parquet'").fetchall()}
    assert {r.page_id: (r.url, r.text) for r in QUERIES["op4_html"](spark, d).collect()} == want


RIVER = "The river rose by two metres overnight and flooded the lower part of the town, where most shops had closed before noon."
MAYOR = "Nobody was hurt, said the mayor, but the old bridge will stay shut until engineers have looked at its piers next week."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div id="inhalt"><h1>Hochwasser</h1><p>{RIVER}</p></div>', ["Hochwasser", RIVER]),
        (f"<h1>High water</h1><p>{RIVER}</p><p>It rained again.</p><p>{MAYOR}</p>", ["High water", RIVER, "It rained again.", MAYOR]),
        ("A note in a file without any markup, as mail programs write it.", ["A note in a file without any markup, as mail programs write it."]),
        (f"<table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td><h1>High water</h1><p>{RIVER}</p><p>{MAYOR}</p></td><td>Buy one, get one free, today only</td></tr></table>", ["High water", RIVER, MAYOR]),
        (f'<body><div class="wrap7"><div class="k1"><a href=/>Start</a> | <a href=/n>News</a> | <a href=/s>Sport</a></div><div class="k2"><h1>High water</h1><p>{RIVER}</p><p>{MAYOR}</p></div><div class="k3"><a href=/i>Imprint</a> <a href=/p>Privacy</a></div></div></body>', ["High water", RIVER, MAYOR]),
        (f"<body><nav><a href=/>Start</a></nav><main><h1>High water</h1><p>{RIVER}</p><blockquote><p>{MAYOR}</p></blockquote></main><footer>&copy; Town Paper</footer></body>", ["High water", RIVER, MAYOR]),
        (f'<body><article class="zeitung"><h1>High water</h1><p>{RIVER}</p><p>{MAYOR}</p></article><section id="comments"><h3>Comments</h3><p>My cellar is full of water too, and nobody came to help us.</p></section></body>', ["High water", RIVER, MAYOR]),
    ],
)
def test_html_of_pages_written_by_hand(page, want):
    """None comes from what the tree was grown on; most have no names, or some that it has never seen."""
    assert html.main_text(page, html.trained()) == "\n\n".join(want)


def test_html_tree_does_not_set_out_from_names():
    assert "mark" not in html.NAMES[html.trained()[1][0]]


def test_html_tables(spark):
    df = spark.createDataFrame([(1, f"<p>{RIVER}", 5), (1, f"<p>{RIVER}", 5), (2, f"<h1>Long</h1>" + f"<p>{RIVER} " * 20_000, 6)], "page_id long, html string, n_chars long")
    got = sorted(tuple(r) for r in html.extract(df).select("page_id", "text", "n_chars").collect())
    assert got[0] == got[1] == (1, RIVER, len(RIVER))
    assert got[2][2] == len(got[2][1]) == len("Long") + 20_000 * (len(RIVER) + 2)
    assert html.extract(df.limit(0)).count() == 0


def test_html_layouts():
    known, tree = html.trained()
    used, todo = set(), [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            used.add(html.NAMES[t[0]])
            todo += t[2:]
    assert {"words", "links"} <= used and used & {"words before", "words after"} and used & {"links before", "links after"}
    wrong = total = 0
    for page in html.labelled_pages(150, seed=77):  # pages the tree was not grown on
        kept = set(html.main_text(page, (known, tree)).split("\n\n"))
        for b in html.blocks_of(page):
            total += 1
            wrong += (b.text in kept) != (b.text.lstrip("© |")[:1] == "m")
    assert wrong < 0.03 * total
    long = "word " * 40 + "end."
    page = f'<ul class="menu"><li><a href=/>b</a></li></ul><article><div class="entry-header"><h1 class="post-header">A title</h1></div><p class="social-history">{long}</p><div class="share"><a href=x>Share</a> <a href=y>Post</a></div></article><div class="comments"><p>I liked it very much.</p></div>'
    assert html.main_text(page, (known, tree)) == f"A title\n\n{long}"


@pytest.mark.parametrize("page", ["<![foo]><p>x", "<a " * 40_000, "<div>" * 8000 + "</p>" * 8000, "<p><td>" + "<b>" * 8000 + "<div></div>" * 8000, '<a "' * 30_000 + ">", "<!--" * 30_000, "<script>" * 20_000, "<ul>" + "<li><b>" * 20_000, "<i><p>" + "<b>" * 8000 + "</i>" * 8000, "<", "</", "<>", "&#xFFFFFFFF;&", "<p a='"])
def test_html_hostile(page):
    import time

    began = time.perf_counter()
    html.main_text(page, html.trained())
    assert time.perf_counter() - began < 10


def test_search_recall(spark):
    x = dict(duckdb.sql(f"select vec_id, embedding from '{D}/embeddings.parquet'").fetchall())
    got = defaultdict(set)
    for r in QUERIES["op5_aq_search"](spark, D).collect():
        got[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(float(np.dot(np.array(x[r.query_id], float), np.array(x[r.vec_id], float))))
    hits = 0
    for q in got:
        near = sorted((-float(np.dot(np.array(x[q], float), np.array(v, float))), i) for i, v in x.items() if i != q)[:20]
        hits += len(got[q] & {i for _, i in near})
    assert hits >= 0.9 * 20 * len(got)
    bad = spark.createDataFrame([(0, [0.0, 0.0]), (20, None), (40, [1.0, None]), (60, [1.0, 2.0]), (61, [float("nan"), 1.0]), (62, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in aq.search(bad).collect()] == [(60, 62)]
    assert aq.search(bad.limit(0)).count() == 0


def test_search_ties(spark):
    """More copies of one vector than are ranked again, in two blocks of queries: the smaller ids come first."""
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(3000 + i, [1.0, -float(i)]) for i in range(50)]
    got = aq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1000, block=4).orderBy("query_id", "rank").collect()
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append(r.vec_id)
    assert found[0] == list(range(1, 21)) and found[2000] == found[1000] == list(range(20)) and found[3000] == list(range(20))


def test_search_of_repeated_ids_in_any_order_of_rows(spark):
    """A repeated id's query is its least vector; columns with clashing names are not read; batches and files don't matter."""
    rng = np.random.default_rng(9)
    rows = [(i % 2900, rng.standard_normal(8).round(3).tolist(), float(i)) for i in range(3000)]
    rows += [(40, None, 0.0), (40, [0.0] * 8, 0.0), (None, [1.0] * 8, 0.0), (80, [1.0] * 7, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").withColumn("v", F.lit(1)).withColumn("query_id", F.lit(2))
    first = sorted(tuple(r) for r in aq.search(df.coalesce(1)).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert sorted(tuple(r) for r in aq.search(df.repartition(7)).collect()) == first
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(first) == 20 * 145
    held = [(i, v) for i, v, _ in rows if i is not None and v and len(v) == 8 and any(v)]
    hits = 0
    for q in (0, 20, 80, 2880):
        mine = np.array(min(v for i, v in held if i == q))
        want = sorted((-float((np.array(v) * mine).sum()), i) for i, v in held if i != q)[:20]
        got = [(i, s) for a, _, i, s in first if a == q]
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))
        hits += len({(i, round(-s, 9)) for s, i in want} & {(i, round(s, 9)) for i, s in got})
    assert hits >= 72


@pytest.mark.parametrize("n", [10_000, 20_000])
def test_search_recall_beyond_the_budget(spark, n):
    """Isotropic vectors, all in one batch that is far larger than what is ranked again."""
    x = np.random.default_rng(3).standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, n)
    try:
        df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)})).coalesce(1)
        got = aq.search(df, every=200).collect()
    finally:
        spark.conf.unset(key)
    assert len(got) == 20 * n // 200
    hits = 0
    for q in range(0, n, 200):
        score = x @ x[q]
        score[q] = -9
        hits += len(set(np.argsort(-score)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.95 * len(got)


def test_suffix(spark, odd, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_suffix_dedup"](spark, D).collect()}
    assert got == suffix.brute_force({d: t.encode() for d, t in texts.items()})
    one = odd.dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(one).collect()}
    assert got == {d: v[:3] for d, v in suffix.brute_force({r[0]: (r[1] or "").encode() for r in ROWS}).items()}


def test_suffix_of_a_hot_key(spark, monkeypatch):
    """A phrase in many surroundings: no task compares much more than GROUP_BYTES at once, and the result is the same."""
    rng = np.random.default_rng(4)
    junk = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    phrase, long, bound, later = junk(70), junk(130), 20_000, suffix.later
    rows = [(d, junk(90) + (phrase if d % 2 else long) + junk(90) + ("é" * 300 if d < 5 else "")) for d in range(600)] + [(700, "x" * 30_000), (701, junk(9) + "xy" * 15_000)]

    def bounded(segs, size):
        assert sum(len(x[2]) for x in segs) <= 2 * bound
        return later(segs, size)

    monkeypatch.setattr(suffix, "GROUP_BYTES", bound)
    monkeypatch.setattr(suffix, "later", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeats(df).collect()}
    assert got == suffix.brute_force({d: t.encode() for d, t in rows})


def test_suffix_of_two_texts_under_one_id(spark):
    rng = np.random.default_rng(6)
    junk = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    a, b, c = junk(400), junk(150), junk(150)
    twice = b + c + b  # its own repeat must not touch the other text
    df = spark.createDataFrame([(5, a), (5, twice), (5, twice), (7, junk(30) + a[:250]), (8, c[:120])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(df).collect())
    assert got == [(5, 400, 0, 0), (5, 450, 150, 1), (5, 450, 150, 1), (7, 280, 250, 1), (8, 120, 120, 1)]


def test_lm(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(SQL["op7_lm"]).fetchall()}
    assert {r.doc_id: (r.n_words, pytest.approx(r.log_score, abs=2e-4) if r.log_score is not None else None) for r in QUERIES["op7_lm"](spark, D).collect()} == want


def test_jaccard(spark, odd, texts):
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    s, up = {d: sets(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if b < a and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_jaccard"](spark, D).collect()}
    assert got == {d: (len(s[d]), root(d)) for d in ids}
    small = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(odd, 4, 85).collect()}
    old = jaccard.BLOCK, jaccard.MEET
    jaccard.BLOCK, jaccard.MEET = 3, 2  # every shingle that four sets share is cut into blocks
    try:
        cut = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_jaccard"](spark, D).collect()}
    finally:
        jaccard.BLOCK, jaccard.MEET = old
    assert cut == got
    assert small[1] == (0, 1) and small[2] == (0, 2) and small[4][1] == 3 and small[7] == (1, 6) and small[9] == (1, 9)


def test_bpe(spark, texts):
    import public_tokenizers as p
    import tiktoken

    raw = open(p.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = bpe.Vocabulary(raw, p.PATTERN)
    all_texts = [*texts.values(), "", None, "  a\n\n b ", "don't  x", "日本語 é" * 50, "<|endoftext|>", " " * 300 + "z", " a", "a ", "a\n b", " \x1c a\x1c b", "a\x85 b", "a\u3000 b\tc d", "I'm  'll x"]
    ids = v.encode(pa.array(all_texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [enc.encode_ordinary(t or "") for t in all_texts]
    assert v.decode(ids).to_pylist() == [(t or "").encode() for t in all_texts]
    assert v.encode(pa.array([], pa.string())).to_pylist() == [] and v.decode(pa.array([None, b""], pa.binary())).to_pylist() == [b"", b""]


def test_language(spark):
    con = duckdb.sql(f"select doc_id, lang from '{D}/documents.parquet'").fetchall()
    lang = dict(con)
    got = [r for r in QUERIES["op10_langid"](spark, D).collect() if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.9 * len(got)
    model = langid.train([("the cat and the dog", "en"), ("le chat et la souris", "fr")] * 20)
    assert langid.predict_texts([None, "", "123 !", "the dog"], model)[0] == ["und", "und", "und", "en"]
    rng = np.random.default_rng(0)
    m, x, y, e = langid.new_model(2, rng), langid.windows(b"some bytes here" * 9), np.array([0, 1, 0]), 1e-5
    loss = lambda: -sum(langid.log_shares(x, m)[t, n, y[n]] for t in range(48) for n in range(3) if x[n, t] != 256) / (x != 256).sum()
    for k, at in (("uf", (0, 3)), ("cb", (2, 1)), ("ef", (ord("s"), 5)), ("w", (3, 1))):
        g = langid.gradients(x, y, m)[k][at]
        m[k][at] += e
        up = loss()
        m[k][at] -= 2 * e
        assert (up - loss()) / (2 * e) == pytest.approx(g, rel=1e-3, abs=1e-7)
        m[k][at] += e


def test_odd_and_empty_tables(spark, odd):
    import public_tokenizers as p

    empty = odd.limit(0)
    path, multi = p.path("byte_bpe_50k.tiktoken"), p.path("byte_bpe_multi_50k.tiktoken")
    for f in (
        lambda d: packing.pack(d, path, p.PATTERN), lambda d: bpe.encode(d.withColumnRenamed("source", "ids"), multi, p.PATTERN), fingerprint.fingerprints,
        lambda d: suffix.remove_repeats(d.withColumnRenamed("source", "kept")), lm.lm_scores, jaccard.jaccard_groups,
        lambda d: langid.predict(d.withColumnRenamed("source", "lang_pred"), None), lambda d: toxicity.score(d.withColumnRenamed("source", "score"), None),
    ):
        assert f(empty).count() == 0
        assert f(odd).count() >= 9


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D).checkpoint()
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert counts[0] == sum(any(c.isalpha() for c in t) for t in texts.values()) and counts == sorted(counts, reverse=True)
    assert counts[-1] > 0.6 * counts[0]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, D).select("doc_id").distinct().count() == counts[-1]


def test_jaccard_of_repeated_ids(spark):
    a, b = "aa bb cc dd ee ff gg hh", "xx yy zz ww vv uu tt ss"
    df = spark.createDataFrame([(3, a), (7, a), (7, b), (9, b), (7, ""), (11, "q"), (12, None), (12, a + " new"), (3, "r s")], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.jaccard_groups(df).collect())
    assert got == [(3, 1, 3), (3, 4, 3), (7, 0, 3), (7, 4, 3), (7, 4, 3), (9, 4, 3), (11, 1, 11), (12, 0, 3), (12, 5, 3)]


def test_widths_in_a_tile():
    """A short set in a tile doesn't shorten the bitmaps by which long sets are judged."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    far = np.concatenate([base[:3400], rng.integers(0, 2**63, 600).astype(np.uint64)])  # likeness 0.74
    near = np.concatenate([base[:3900], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sets = sorted((np.unique(s) for s in (rng.integers(0, 2**63, 60).astype(np.uint64), base, far, near)), key=len)
    rows = [(2, i, len(s), jaccard.bitmap(s, jaccard.LONG), i) for i, s in enumerate(sets)]
    found = {(int(p), int(q)) for ps, qs, _ in jaccard.may_link(rows, 85) for p, q in zip(ps, qs)}
    like = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for j in range(4) for i in range(j)}
    assert found == {p for p, x in like.items() if x >= 0.85} and len(found) == 1


def test_runs_of_a_shingle():
    """Two sets that can link by their sizes and the shingle's places lie in one run; sets that none reaches don't."""
    rng = np.random.default_rng(2)
    for percent in (50, 80, 85, 100):
        n = rng.integers(1, 400, 600)
        place = (rng.random(600) * (n - -(-percent * n // 100) + 1)).astype(np.int64)
        tok = rng.integers(-3, 3, 600)
        order = np.lexsort((place, n, tok))
        tok, n, place = tok[order], n[order], place[order]
        reach = 100 * n - (100 + percent) * place
        at = jaccard.cuts(tok, n, reach, percent)
        run = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for i in range(600):
            for j in range(i + 1, 600):
                most = min(n[i] - place[i], n[j] - place[j])  # shared, if this shingle is the first shared one
                if tok[i] == tok[j] and 100 * most >= percent * (n[i] + n[j] - most):
                    assert run[i] == run[j]
        assert all(tok[c] != tok[c - 1] or (reach[(tok == tok[c]) & (np.arange(600) < c)] < percent * n[c]).all() for c in at[1:-1])


def test_lm_over_another_corpus(spark, monkeypatch):
    """Slices and buckets of any size, and counts of another table, give what counting by hand gives."""
    monkeypatch.setattr(lm, "SLICE_BYTES", 40)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 16)
    corpus = [(1, "a b c a b"), (2, "A b c d"), (3, "c d"), (4, None), (5, "")]
    docs = [(1, "a b c a b"), (2, "A b c d"), (2, "c d"), (9, " "), (10, None)]
    n = Counter()
    for _, t in corpus:
        w = (t or "").lower().split()
        n.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total = sum(c for g, c in n.items() if len(g) == 1)

    def score(g):
        if len(g) == 1:
            return np.log(n[g] / total)
        return np.log(n[g] / n[g[:-1]]) if n[g] >= 2 else np.log(0.4) + score(g[1:])

    want = {}
    for d, t in docs:
        w = (t or "").lower().split()
        m, s = want.get(d, (0, 0.0))
        want[d] = m + len(w), s + sum(score(tuple(w[max(0, i - 2) : i + 1])) for i in range(len(w)))
    schema = "doc_id long, text string"
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm.lm_scores(spark.createDataFrame(docs, schema), corpus=spark.createDataFrame(corpus, schema)).collect()}
    assert got == {d: (m, pytest.approx(s, abs=1e-4) if m else None) for d, (m, s) in want.items()}


def test_bpe_query(spark, texts):
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {d: (len(ids := enc.encode_ordinary(t)), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for d, t in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op9_bpe"](spark, D).collect()} == want


def test_language_by_plain_loops():
    """The scores of texts against the recurrences written out byte by byte."""
    model = langid.train([("the cat and the dog " * 9, "en"), ("le chat et la souris " * 9, "fr"), ("der hund und die katze " * 9, "de")])
    h, sig = langid.HIDDEN, lambda x: 1 / (1 + np.exp(-x))

    def states(raw, d):
        s, out = np.zeros(h), {}
        for t in range(len(raw)) if d == "f" else reversed(range(len(raw))):
            e = model["e" + d][raw[t]].astype(float)
            gate = sig(e[: 2 * h] + s @ model["u" + d])
            cand = np.tanh(e[2 * h :] + (gate[h:] * s) @ model["c" + d])
            s = s + gate[:h] * (cand - s)
            out[t] = s
        return out

    for text in ("the dog et la souris", "x", "der hund " * 30, "é" * 100):
        raw = text.encode()
        padded = list(raw) + [langid.PAD] * (-len(raw) % langid.WINDOW)
        logs = np.zeros(len(model["classes"]))
        for lo in range(0, len(padded), langid.WINDOW):
            part = padded[lo : lo + langid.WINDOW]
            f, b = states(part, "f"), states(part, "b")
            for t, byte in enumerate(part):
                if byte != langid.PAD:
                    o = np.concatenate([f[t], b[t]]) @ model["w"] + model["b"]
                    logs += o - np.log(np.exp(o).sum())
        p = np.exp(4 * (logs - logs.max()) / len(raw))
        p /= p.sum()
        (lang,), (score,) = langid.predict_texts([text], model)
        assert lang == model["classes"][int(p.argmax())] and score == pytest.approx(p.max(), rel=1e-3)


def test_odd_texts_meet_trained_models(spark, odd):
    labels = spark.createDataFrame([(d, int(d % 2)) for d in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(d, ("foul " if d % 2 else "fair ") * 20 + f"w{d % 7}", "en" if d % 3 else "fr") for d in range(400)] + [(5, None, None), (6, "", "en")], "doc_id long, text string, lang string")
    long = odd.union(spark.createDataFrame([(20, "foul words é " * 300_000, "en", "a", 1), (None, "x", None, None, None)], SCHEMA)).withColumn("score", F.lit("s")).withColumn("lang_score", F.lit(1))
    tox = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(long, tox).collect()}
    assert len(got) == 11 and got[1].score == got[2].score < 0.5 and 0 <= got[20].score <= 1 and got[20].score > 0.7 and len(got[20].spans) >= 300_000
    lang = langid.learn(docs)
    got = {r.doc_id: r for r in langid.predict(long, lang).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[8].lang_pred == "und" and got[20].lang_pred in ("en", "fr") and len(got) == 11
    assert toxicity.score(long.limit(0), tox).count() == langid.predict(long.limit(0), lang).count() == 0
    assert toxicity.learn(docs.limit(0), labels) is None and langid.learn(docs.limit(0)) is None


def test_samples_are_bounded(spark):
    from sorbus.llm.common import sample_rows

    df = spark.range(3000).select(F.col("id").alias("k"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("t"))
    rows = sample_rows(df, "k", "t", 200, 1 << 20)
    assert len(rows) == 200 == len({r.k for r in rows}) and rows == sample_rows(df.repartition(7), "k", "t", 200, 1 << 20)
    few = sample_rows(df, "k", "t", 200, 500)
    assert 0 < sum(2 * len(r.t) for r in few) <= 500 and len(sample_rows(df.limit(20), "k", "t", 200, 1 << 20)) == 20
    assert sample_rows(df.limit(0), "k", "t", 5, 5) == [] and len(sample_rows(spark.range(50).select(F.lit(1).alias("k"), F.lit("a").alias("t")), "k", "t", 9, 99)) == 9


def test_stages_take_odd_and_empty_tables(spark, odd):
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, D).checkpoint()
            assert docs.columns == corpus_pipeline.COLUMNS
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids)) and 1 not in ids and 8 not in ids
        assert set(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()) == set(ids)
