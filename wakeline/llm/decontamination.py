"""Benchmark decontamination (op4): passages of documents that are like an item of a benchmark.  DataFrame functions only.

Words are lower-cased runs without ASCII white space; an item of m words is compared with windows of m words (all of a shorter document), by
the weighted Jaccard similarity of their five-word shingles (of the whole, if m is under five), whose weights are how often they occur in each.

1. A window that is alike has at least `need` places whose shingle the item has too, as the similarity bounds the common weight from below.  The places of each document and
   item that share a shingle are sorted, and every window with `need` of them is kept, wherever in it they lie and in whatever order: no other can be alike.
2. Each window, and each item, gets a SimHash of 128 bits from its weighted shingles.
3. Multi-index: the fingerprint has 8 blocks of 16 bits, and of two fingerprints at most `RADIUS` = 31 bits apart some block differs in at most 3.
   Items are indexed under all values within 3 bits of each block, windows look their blocks up, so all pairs within the radius, and of equal m, meet.
4. Pairs within the radius are verified by the exact similarity; `least` or more is reported.  Items of fewer than `FEW` shingles, whose fingerprints say little,
   are verified with each window that step 1 kept for them, whatever the radius.

Two weighted sets of many shingles with similarity 0.8 are about 19 +- 4 bits apart, so the radius loses about two in a thousand at the threshold and fewer above it; nothing else is lost.
Documents are read once to find windows and once more, those with windows only, to cut them out.  They are not shuffled as long as the shingles of the benchmark and the windows are at most `BROADCAST`
rows each, which is counted, and broadcast; beyond that they are joined by shuffle.  Null or blank documents and items match nothing, nor does an empty table.  Repeated rows are reported once; rows
with equal ids and different texts each for itself.  Of equally alike windows the first is reported.  A text is one row however long, with 16 bytes for each of its words; the windows of
a text are rows.  Other columns are not read by `contaminated` and pass through `clean`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import documents, scratch

SHINGLE, RADIUS, BLOCKS = 5, 31, 8
#: Items of fewer shingles are verified without regard to the radius.
FEW = 16
BROADCAST = 1 << 20
_LANES = 0x0000000100000001


def word_hashes(text: str | Column) -> Column:
    words = F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def shingles(words: str, k: int) -> Column:
    """Hashes of all runs of k of the word hashes."""
    w = F.col(words)
    last = F.size(w) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def own_shingles(words: str) -> Column:
    """Shingles of a window: of five words, or the whole of a shorter one."""
    size = F.size(words)
    short = reduce(lambda c, k: F.when(size == k, shingles(words, k)).otherwise(c), range(1, SHINGLE), F.array().cast("array<bigint>"))
    return F.when(size >= SHINGLE, shingles(words, SHINGLE)).otherwise(short)


def weights(rows: DataFrame, key: str) -> DataFrame:
    """key, gram, n: how often each shingle occurs in the words of each row."""
    return rows.select(key, F.explode(own_shingles("words")).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def simhash(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """key, more, left, right: the two halves of a SimHash of 128 bits of the words of each row.  The shingles of a row are added up where it is read."""
    grams = rows.select(key, *more, F.explode(own_shingles("words")).alias("gram"))
    halves = {"left": F.xxhash64("gram", F.lit(1)), "right": F.xxhash64("gram", F.lit(2))}
    grams = grams.select(key, *more, *[h.alias(k) for k, h in halves.items()])
    lanes = [F.sum(F.shiftright(F.col(k), j).bitwiseAND(F.lit(_LANES))).alias(f"{k}{j}") for k in halves for j in range(32)]
    sums = grams.groupBy(key, *more).agg(F.count("*").alias("total"), *lanes)

    sums = sums.select(key, *more, "total", *[F.array(*[f"{k}{j}" for j in range(32)]).alias(k) for k in halves])

    def bits(k: str) -> Column:
        # each sum holds two counts, of bit j and of bit j + 32
        low, high = f"({k}[j] & 4294967295L)", f"shiftrightunsigned({k}[j], 32)"
        return F.expr(f"aggregate(sequence(0, 31), 0L, (all, j) -> all | if({low} * 2 > total, shiftleft(1L, j), 0L) | if({high} * 2 > total, shiftleft(1L, j + 32), 0L))").alias(k)

    return sums.select(key, *more, bits("left"), bits("right"))


def blocks() -> Column:
    """The fingerprint's blocks, as an array of (number, value)."""
    own = [F.shiftrightunsigned(F.col(h), 16 * i).bitwiseAND(F.lit(0xFFFF)) for h in ("left", "right") for i in range(BLOCKS // 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(own)])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_key, doc_id, item_id, start_word, n_words, similarity: of every document and item that it has a passage like, the likest window, first on ties.
    doc_key is a hash of id and text."""
    items = benchmark.select(F.xxhash64(F.col(item_col).cast("long"), item_text_col).alias("item"), F.col(item_col).cast("long").alias("item_id"), word_hashes(item_text_col).alias("words"))
    items = items.withColumn("m", F.size("words")).filter("m > 0").dropDuplicates(["item"])
    items = scratch(items.withColumn("k", F.least("m", F.lit(SHINGLE))), "items")
    seeds = scratch(items.select("item", "m", "k", F.explode(F.array_distinct(own_shingles("words"))).alias("gram")), "seeds")
    kinds = {r["k"]: r["count"] for r in seeds.groupBy("k").count().collect()}
    few = sum(kinds.values()) <= BROADCAST

    texts = docs.select(F.xxhash64(F.col(id_col).cast("long"), text_col).alias("doc_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.select("doc_key", word_hashes("text").alias("words"))
    found = None
    for k in sorted(kinds) or [SHINGLE]:
        own = seeds.filter(F.col("k") == k).select("gram", "item", "m", "k")
        at = rows.select("doc_key", F.size("words").alias("n_words"), F.posexplode(shingles("words", k)).alias("at", "gram"))
        at = at.join(F.broadcast(own) if few else own, "gram").drop("gram")
        found = at if found is None else found.unionByName(at)
    hits = found.groupBy("doc_key", "item", "m", "k", "n_words").agg(F.sort_array(F.collect_set("at")).alias("at"))
    hits = hits.withColumn("total", F.least("m", "n_words") - F.col("k") + 1)  # shingles of a window
    hits = hits.withColumn("need", F.ceil((F.col("total") + F.col("m") - F.col("k") + 1) * F.lit(least / (1 + least)) - 1e-9).cast("int")).filter("size(at) >= need")
    # windows that hold the places i to i + need - 1, but not those that hold place i - 1 and as many
    starts = F.expr("transform(sequence(0, size(at) - need), i -> struct(greatest(0, at[i + need - 1] - total + 1, if(i > 0, at[i - 1] + 1, 0)) AS low, least(at[i], greatest(n_words - m, 0)) AS high))")
    ranges = hits.select("doc_key", "item", "m", "k", F.explode(starts).alias("r")).filter("r.low <= r.high")
    places = ranges.select("doc_key", "item", "m", "k", F.explode(F.sequence("r.low", "r.high")).alias("start"))
    places = scratch(places.withColumn("window", F.xxhash64("doc_key", "m", "start")), "places")

    of_doc = places.groupBy("doc_key").agg(F.collect_set(F.struct("window", "m", "start")).alias("places"))
    of_doc = F.broadcast(of_doc) if places.count() <= BROADCAST else of_doc
    windows = texts.join(of_doc, "doc_key").select("doc_key", "doc_id", word_hashes("text").alias("words"), "places").withColumn("p", F.explode("places"))
    windows = windows.select("p.window", "doc_key", "doc_id", "p.m", "p.start", F.slice("words", F.col("p.start") + 1, F.col("p.m")).alias("words"))
    windows = scratch(windows.groupBy("window").agg(*[F.first(c).alias(c) for c in ("doc_key", "doc_id", "m", "start", "words")]), "windows")

    marks, index = simhash(windows, "window", "m"), simhash(items, "item", "m")
    near = F.split(F.lit(",".join(str(v) for v in range(1 << 16) if v.bit_count() <= RADIUS // BLOCKS)), ",").cast("array<int>")  # a constant
    index = index.select("item", "m", F.col("left").alias("item_left"), F.col("right").alias("item_right"), F.explode(blocks()).alias("b"))
    index = index.withColumn("flip", F.explode(near)).select("*", F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("flip").cast("long")).alias("value")).drop("b", "flip")
    asked = marks.select("window", "m", "left", "right", F.explode(blocks()).alias("b")).select("*", "b.block", "b.value").drop("b")
    apart = F.bit_count(F.col("left").bitwiseXOR(F.col("item_left"))) + F.bit_count(F.col("right").bitwiseXOR(F.col("item_right")))
    # the index is far larger than its plan lets Spark guess: never broadcast it
    pairs = asked.join(index.hint("merge"), ["block", "value", "m"]).filter(apart <= RADIUS).select("window", "item")
    pairs = scratch(pairs.union(places.filter(F.col("m") - F.col("k") + 1 < FEW).select("window", "item")).distinct(), "pairs")

    of_window = weights(windows.join(pairs.select("window").distinct(), "window", "left_semi"), "window")
    both = pairs.join(of_window, "window").join(weights(items, "item").withColumnRenamed("n", "item_n"), ["item", "gram"])
    common = both.groupBy("window", "item").agg(F.sum(F.least("n", "item_n")).alias("common"))
    alike = common.join(windows.select("window", "doc_key", "doc_id", "start", F.size("words").alias("n_words")), "window").join(items.select("item", "item_id", "m"), "item")
    both_sizes = F.greatest(F.col("n_words") - SHINGLE + 1, F.lit(1)) + F.greatest(F.col("m") - SHINGLE + 1, F.lit(1))
    alike = alike.withColumn("similarity", F.col("common") / (both_sizes - F.col("common"))).filter(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best")
    out = alike.groupBy("doc_key", "doc_id", "item", "item_id").agg(best)
    return out.select("doc_key", "doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, in their own columns, that have no passage like an item."""
    bad = scratch(contaminated(docs, benchmark, least, id_col, text_col).select("doc_key").distinct(), "contaminated")
    few = bad.count() <= BROADCAST
    key = F.xxhash64(docs[id_col].cast("long"), docs[text_col])
    return docs.join(F.broadcast(bad) if few else bad, key == bad["doc_key"], "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity").distinct()


QUERIES = {"op4_decontamination": op4_decontamination}
SQL = {
    "op4_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
im AS (SELECT item_id, w, len(w) AS m, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ig AS (SELECT item_id, m, k, unnest(range(0, m - k + 1)) AS at, unnest(list_transform(range(1, m - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM im),
k AS (SELECT DISTINCT k FROM ig),
dg AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS at, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM d, k WHERE len(w) >= k),
b AS (SELECT DISTINCT dg.doc_id, ig.m FROM dg JOIN ig ON dg.g = ig.g AND dg.k = ig.k),
s AS (SELECT b.doc_id, b.m, unnest(range(0, greatest(1, len(d.w) - b.m + 1))) AS start FROM b JOIN d ON d.doc_id = b.doc_id),
sw AS (SELECT s.doc_id, s.m, s.start, d.w[s.start + 1:s.start + s.m] AS w FROM s JOIN d ON d.doc_id = s.doc_id),
sg AS (
  SELECT doc_id, m, start, g, count(*) AS n FROM (
    SELECT doc_id, m, start, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' ')) END) AS g FROM sw)
  GROUP BY ALL),
ic AS (SELECT item_id, m, g, count(*) AS n FROM ig GROUP BY ALL),
st AS (SELECT doc_id, m, start, sum(n) AS total FROM sg GROUP BY ALL),
it AS (SELECT item_id, sum(n) AS total FROM ic GROUP BY ALL),
c AS (SELECT sg.doc_id, sg.m, sg.start, ic.item_id, sum(least(sg.n, ic.n)) AS common FROM sg JOIN ic ON sg.g = ic.g AND sg.m = ic.m GROUP BY ALL),
j AS (
  SELECT c.doc_id, c.item_id, c.start, len(sw.w) AS n_words, c.common::DOUBLE / (st.total + it.total - c.common)::DOUBLE AS similarity
  FROM c JOIN st USING (doc_id, m, start) JOIN it USING (item_id) JOIN sw USING (doc_id, m, start))
SELECT doc_id, item_id, start::BIGINT AS start_word, n_words::BIGINT AS n_words, similarity FROM j WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""
}
