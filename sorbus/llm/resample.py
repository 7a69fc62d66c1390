"""Importance resampling towards a target distribution (operator 11).

Words come from a position table: posexplode gives each word and its place, and lead() over a document's places gives the
words that follow it, so an order of n words needs n - 1 of them. Every n-gram is hashed into a bucket; buckets are counted
over the documents and over the target, a bucket's gain is the scaled logarithm of the ratio of its shares there, and the
gains are joined to the n-grams of each document and averaged. Gumbel noise, drawn from a hash of the id, turns the
highest scores into a sample without replacement, in proportion to the weights.

Order 1 alone needs no following words, so its words are not shuffled at all: they are counted, and looked up, where they
are read. For higher orders long documents are laid out in chunks, which overlap by what an n-gram reaches, so a window
holds at most a chunk. The table of gains has at most `buckets` rows and goes to all executors.

Null text: no words. A document without features has weight 0. Every row is a document of its own: repeated rows and rows
that share an id each count, each with its own rank. A null id is written as nothing after the seed's colon, and comes last
among equal scores. Other columns than the id and the text are not read, whatever their names. Texts are whole, of any
length. An empty table gives an empty result; an empty target gives the gains of T = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorbus.llm.common import prepare, table
from sorbus.operators.graph import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK = 4096
STEP = 1024  # scores are counted by so many at once, then one by one
SCHEMA = "doc_id long, n_features long, weight long, score long, rank long"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def position_table(rows: DataFrame, orders: tuple[int, int], chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, n_words, word, next1, next2, ...) of rows (row, doc_id, n_words, words): a row per word, in which the
    next words are null beyond the document's end; a row of nulls for a document without words."""
    reach = orders[1] - 1
    if not reach:
        return rows.select("row", "doc_id", "n_words", F.posexplode_outer("words").alias("pos", "word")).drop("pos")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_words")), F.lit(chunk))
    cut = rows.withColumn("start", F.explode(starts)).select("row", "doc_id", "n_words", "start", F.slice("words", F.col("start"), F.lit(chunk + reach)).alias("words"))
    places = cut.select("row", "doc_id", "n_words", "start", F.posexplode_outer("words").alias("pos", "word"))
    along = Window.partitionBy("row", "start").orderBy("pos")
    following = [F.lead("word", j).over(along).alias(f"next{j}") for j in range(1, reach + 1)]
    laid = places.select("row", "doc_id", "n_words", "pos", "word", *following)
    return laid.where(F.col("pos").isNull() | (F.col("pos") < chunk)).drop("pos")


def buckets_of(places: DataFrame, orders: tuple[int, int], buckets: int) -> DataFrame:
    """(row, doc_id, n_words, bucket): a row per feature, or one without bucket for a document without features."""
    grams = []
    for n in range(orders[0], orders[1] + 1):
        parts = [F.col("word"), *[F.col(f"next{j}") for j in range(1, n)]]
        grams.append(F.when(parts[-1].isNotNull(), F.concat_ws(" ", *parts)))
    kept = ["row", "doc_id", "n_words"]
    if len(grams) == 1:
        each = places.select(*kept, grams[0].alias("gram"))
    else:
        each = places.select(*kept, F.explode(F.array(*grams)).alias("gram"))
    return each.select(*kept, (F.crc32(F.col("gram").cast("binary")) % buckets).alias("bucket"))


def features(docs: DataFrame, orders: tuple[int, int], buckets: int, chunk: int = CHUNK) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.select("row", "doc_id", F.size("words").alias("n_words"), "words")
    return buckets_of(position_table(rows, orders, chunk), orders, buckets)


def gains(docs: DataFrame, target: DataFrame, orders: tuple[int, int], buckets: int, chunk: int = CHUNK) -> DataFrame:
    """(bucket, gain) of every bucket that docs or target use."""
    count = lambda df, n: features(df, orders, buckets, chunk).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(n))
    both = shared(count(docs, "s").join(count(target, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    every_s, every_t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(every_s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(every_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def score(docs: DataFrame, target: DataFrame, orders: tuple[int, int], buckets: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) per document."""
    table_of_gains = F.broadcast(gains(docs, target, orders, buckets, chunk))  # of `buckets` rows at most
    joined = features(docs, orders, buckets, chunk).join(table_of_gains, "bucket", "left")
    per = joined.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long")
    return per.select("row", "doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(seed))


def least_drawn(able: DataFrame, n: int) -> int:
    """The n-th highest score, from two counts: of scores by STEP, then one by one within the step that holds it."""
    left = n
    step = None
    for r in sorted(able.groupBy(F.floor(F.col("score") / STEP).alias("step")).count().collect(), key=lambda r: -r.step):
        step = r.step
        if r["count"] >= left:
            break
        left -= r["count"]
    inside = able.where((F.col("score") >= step * STEP) & (F.col("score") < (step + 1) * STEP))
    value = None
    for r in sorted(inside.groupBy("score").count().collect(), key=lambda r: -r.score):
        value = r.score
        if r["count"] >= left:
            break
        left -= r["count"]
    return value


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with its rows' numbers from 1 in the order of `by`: range partitions are numbered apart, and only one count of
    each meets the others."""
    laid = shared(df.orderBy(*by).withColumn("__part", F.spark_partition_id()))
    counts = laid.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = laid.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*by)))
    return inside.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__at", "__before")


def resample(
    docs: DataFrame, target: DataFrame, orders: tuple[int, int] = (1, 2), buckets: int = 10_000, seed: int = 0, percent: int = 10,
    min_words: int = 20, chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of docs (doc_id, text), by the texts of target (text).

    Of the N documents of at least min_words words, floor(percent * N / 100) are drawn; rank is null for the others.
    """
    if not 1 <= orders[0] <= orders[1] or buckets < 1:
        raise ValueError("orders must be 1 or more, lower first, and buckets 1 or more")
    prepare(docs.sparkSession)
    scored = shared(score(docs.select("doc_id", "text"), target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets, seed, chunk))
    able = scored.where(F.col("n_words") >= min_words)
    n = percent * able.count() // 100
    if not n:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    enough = (F.col("n_words") >= min_words) & (F.col("score") >= least_drawn(able, n))
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    drawn = numbered(scored.where(enough), by, "place")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = drawn.select(*columns, F.when(F.col("place") <= n, F.col("place")).alias("rank"))
    return ranked.union(scored.where(~enough).select(*columns, F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs, whole, whose id was drawn in found, which resample() gave."""
    return docs.join(found.where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words and more, drawn towards the words of the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), orders=(1, 1), buckets=10_000, seed=2024, percent=10, min_words=20)


def crc_sql(name: str) -> str:
    """The crc32 of a text's UTF-8 bytes in DuckDB, by the table `crc_steps` (steps: a list of 256)."""
    h = f"hex(encode({name}))"
    byte = f"(('0x' || substr({h}, 2*i-1, 2))::utinyint::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length({h})//2+1), lambda i: {byte})), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"




WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RESAMPLE_SQL = f"""
with recursive bits as (select i::bigint as i, i::bigint as v, 0 as k from range(256) t(i) union all
  select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8),
crc_steps as (select list(v order by i) as steps from bits where k = 8),
d as (select row_number() over () as row_id, doc_id, {WORDS_SQL} as ws from documents),
dw as (select row_id, doc_id, unnest(ws) as word from d),
bw as (select unnest({WORDS_SQL}) as word from benchmark),
vocabulary as (select word, {crc_sql("word")} % 10000 as bucket from (select word from dw union select word from bw), crc_steps),
s as (select bucket, count(*) as s from dw join vocabulary using (word) group by 1),
t as (select bucket, count(*) as t from bw join vocabulary using (word) group by 1),
totals as (select (select coalesce(sum(s), 0) from s) as all_s, (select coalesce(sum(t), 0) from t) as all_t),
gains as (select bucket, floor(1000*ln((coalesce(t, 0)+1)::double*(all_s+10000)::double/((s+1)::double*(all_t+10000)::double))) as gain from s left join t using (bucket), totals),
w as (select row_id, floor(sum(gain)/count(*)) as weight from dw join vocabulary using (word) join gains using (bucket) group by 1),
h as (select d.*, len(ws) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from d left join w using (row_id)),
scored as (select *, weight + floor(-1000*ln(-ln((h+0.5)/4294967296))) as score from h),
ranked as (select row_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when place <= n*10//100 then place end::bigint as rank
from scored left join ranked using (row_id)
"""
