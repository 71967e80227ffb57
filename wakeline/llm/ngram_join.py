"""N-gram Jaccard join (op7): documents whose sets of word n-grams are alike, and the components they form.

Two sets link when 100 * |A ^ B| >= 85 * |A v B|.  The join is exact.

1. How many sets hold each n-gram is counted (a keyed exchange of distinct hashes), which orders n-grams by rarity.  Only sets with an n-gram in
   their prefix (size - ceil(.85 size) + 1 rarest ones) that another set holds too can link at all.  Equal sets are one node.
2. The prefixes make an index of lists.  Skipping by set relations, a node is first joined with the one least node that it shares most lists with, its head; a verified
   link makes the head answer for it: what is in one component needs no further comparison, and where the node is compared with another set later on, its answer is derived from
   the head's, which is computed once for all its nodes, by the n-grams that the two differ in (`derive`).
3. Lists that still hold several components are compared across these: a list is cut into blocks by position, and a pair
   of blocks is skipped whole when the positions alone rule a link out; length, position and a parity sketch (a lower bound of the
   symmetric difference) rule out single pairs.  In each round a node is verified against its nearest node of another component, one pair a node, and
   components grow; when a round finds no link, all pairs still left are verified.

Lists longer than `LIST` are dealt out in pairs of parts, so no task holds more than two parts of one, and a head that very many are compared with is salted (later rounds leave that to adaptive skew joins).  Equal sets, of any number, are collapsed by
partial aggregation before they are shuffled.  Null and empty texts have an empty set and link with nothing.  Rows with equal ids are
joined each for itself; a null id is never a component's name unless all its documents have none.  Ties between nodes go to the least hash.  An empty table gives no rows; other columns are
not read, whatever their names.  A very long text is a chunk of its own, and its set one row: a worker holds some 60 bytes for each of its words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import Rolling, WordRuns, ask, chunked, documents, exact, give_back, meet, mix, n_buckets, pack_arrays, pack_table, scratch, send_counts, slices, sum_counts, text_bytes, unpack_arrays, unpack_table

#: Bytes of text that are read at a time, and shingles that are ordered at a time; a longer text is alone.
SLICE = 1 << 18
#: Entries of a list that one part holds, about.
LIST = 4096
#: Rows with one node that one copy of its n-grams serves, about; and rows of a table of hot nodes that is broadcast.
SPLIT, BROADCAST = 4096, 1 << 20
#: 64-bit words of the parity sketch.
SKETCH = 16


class Shingles:
    """Distinct shingles of each text of a chunk: hashes, one text after the other, and how many each has.  Texts are read and sorted some 256 KB at a time, as all working arrays of a
    chunk would be a worker's largest."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, n: int):
        parts = [self._part(part.to_pylist(), n) for part in slices(texts, SLICE)]
        hashes, size, signature = zip(*parts) if parts else ([np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)])
        self.hashes, self.size, self.signature = np.concatenate(hashes), np.concatenate(size), np.concatenate(signature)
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def _part(texts: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = WordRuns(texts, lower=True, split_bytes=SLICE)
        roll = Rolling(w.hash)
        at = np.flatnonzero(w.inside(n))
        owner = np.repeat(np.arange(len(w.size)), w.size)[at] if len(at) else np.empty(0, np.int64)
        hashes = roll.runs(at, n)
        few = np.flatnonzero((w.size > 0) & (w.size < n))  # the whole sequence, in a space of its own for each length
        hashes = np.concatenate([hashes, mix(roll.runs(w.start[few], w.size[few]) + w.size[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, size = hashes[new], np.bincount(owner[new], minlength=len(w.size))
        sums, end = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)]), np.cumsum(size)
        return hashes, size, mix(sums[end] - sums[end - size] + size.astype(np.uint64))

    def keys(self, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The hashes without their last `drop` bits, sorted, and how many different sets have each."""
        _, first = np.unique(self.signature, return_index=True)
        keep = np.zeros(len(self.size), bool)
        keep[first] = True
        short = self.hashes[np.repeat(keep, self.size)]
        short >>= drop
        short <<= drop
        short.sort()
        at = np.flatnonzero(np.append(True, short[1:] != short[:-1])[: len(short)])
        return short[at], np.diff(at, append=len(short))

    def by_rarity(self, drop: np.uint64, own: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Order each text's hashes by the code of their key (own: sorted keys) and then by hash; returns how many have the code 1."""
        alone, at = np.zeros(len(self.size), np.int64), 0
        while at < len(self.size):
            end = max(at + 1, int(np.searchsorted(self.start, self.start[at] + SLICE, side="right")) - 1)
            i, j = self.start[at], self.start[end - 1] + self.size[end - 1]
            owner, grams = np.repeat(np.arange(end - at), self.size[at:end]), self.hashes[i:j]
            rank = code[np.searchsorted(own, grams >> drop << drop)]
            grams[:] = grams[np.lexsort((rank, owner))]  # which are in the order of hashes
            alone[at:end] = np.bincount(owner[rank == 1], minlength=end - at)
            at = end
        return alone


def _codes(total: np.ndarray) -> np.ndarray:
    """Frequencies in a byte: exact up to 127, then by eighths of a doubling."""
    return np.minimum(np.where(total < 128, total, 128 + 8 * np.log2(np.maximum(total, 128) / 128)), 255).astype(np.uint8)


def _answer(got: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    places, _, total = sum_counts(got)
    codes = _codes(total)
    return [(b, c, pack_arrays(codes[p])) for b, c, p in zip(got["bucket"], got["chunk"], places)]


def sets(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """row_key (a hash of id and text), doc_id, size, sig, skip, grams of every row; grams (rarest first) only where a prefix n-gram, from number `skip` on, is in
    other sets too."""
    total = text_bytes(docs, text_col)
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    chunks, k = chunked(docs, total, pack_table, id_col, text_col, more={"row_key": key}), n_buckets(total // 8)
    # frequencies need no full hash: a shared key only makes two n-grams look more frequent, alike for all sets
    drop = np.uint64(max(0, 64 - (max(1, total // 4).bit_length() + 17)))

    def emit(chunk: int, payload: bytes):
        own, counts = Shingles(unpack_table(payload).column("text"), n).keys(drop)
        return send_counts(chunk, own, counts.astype(np.int64), k)

    def ordered(chunk: int, payload: bytes, said: list) -> pd.DataFrame:
        rows = unpack_table(payload)
        s = Shingles(rows.column("text"), n)
        rows = rows.drop_columns(["text"])
        code = np.concatenate([unpack_arrays(p)[0] for _, p in sorted(said)] or [np.empty(0, np.uint8)])
        alone = s.by_rarity(drop, s.keys(drop)[0], code)
        grams = s.hashes.view(np.int64)
        prefix = s.size - -(-num * s.size // den) + 1
        some = (s.size > 0) & (alone < prefix)
        cut = [grams[a : a + m] if ok else None for a, m, ok in zip(s.start, s.size, some)]
        return pd.DataFrame({"row_key": exact(rows.column("row_key")), "doc_id": exact(rows.column("doc_id")), "size": s.size, "sig": s.signature.view(np.int64), "skip": alone, "grams": cut})

    return meet(chunks, ask(chunks, emit, _answer, k), ordered, "row_key long, doc_id long, size long, sig long, skip long, grams array<long>")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of all nodes of the links (a, b)."""
    both = scratch(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        after = scratch(step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("label"), (F.least("low", F.coalesce("lower", "low")) != F.col("label")).alias("moved")), "label")
        label = after.select("node", "label")
        if after.filter("moved").limit(1).count() == 0:
            return label


def _fits(num: int, den: int, n, m, at_n, at_m):
    """Whether sets of n and m elements, that share the elements at places at_n and at_m but none before, may be so alike."""
    need = F.ceil((n + m) * num / F.lit(num + den))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (F.least(n - at_n, m - at_m) >= need)


def with_grams(rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Join the n-grams of the node `name` to rows with columns a and b.  A node in many rows is salted: its n-grams are copied once for about `SPLIT` of them, and these spread."""
    hot = scratch(rows.groupBy(name).agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select(name, F.ceil(F.col("n") / SPLIT).alias("salts")), "hot")
    grams = nodes.select(F.col("node").alias(name), F.col("grams").alias(f"grams_{name}"))
    n = hot.count()
    if not n:
        return rows.join(grams, name)
    hot = F.broadcast(hot) if n <= BROADCAST else hot
    rows = rows.join(hot, name, "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("a", "b"), "salts")).otherwise(0)).drop("salts")
    grams = grams.join(hot, name, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return rows.join(grams, [name, "salt"]).drop("salt")


def compared(pairs: DataFrame, nodes: DataFrame, salted: bool = False) -> DataFrame:
    """a, b, grams_a, grams_b, common of pairs; `salted` if some b may be in very many."""
    # the side with a hot node goes first, while its rows are light
    grams = nodes.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    rows = pairs.select("a", "b")
    both = (with_grams(rows, nodes, "b") if salted else rows.join(grams.toDF("b", "grams_b"), "b")).join(grams, "a")
    return both.withColumn("common", F.size(F.array_intersect("grams_a", "grams_b")))


def _alike(common, size_a, size_b, num: int, den: int):
    return common * den >= (size_a + size_b - common) * num


def verify(pairs: DataFrame, nodes: DataFrame, num: int, den: int, salted: bool = False) -> DataFrame:
    """The pairs (a, b) that link, and what a has more and less than b."""
    both = compared(pairs, nodes, salted).filter(_alike(F.col("common"), F.size("grams_a"), F.size("grams_b"), num, den))
    return both.select("a", "b", F.array_except("grams_a", "grams_b").alias("more"), F.array_except("grams_b", "grams_a").alias("less"))


def derive(pairs: DataFrame, nodes: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, where a is known by its difference from a similar set, its head (heads: a, head, more, less).  The head's answer for b is computed once for all of its
    sets: common(a, b) = common(head, b) + |more ^ b| - |less ^ b|.  Mostly the sizes of the differences decide already; else they are compared with b, and a itself never is."""
    named = pairs.select("a", "b").join(heads, "a")
    asked = named.select(F.col("head").alias("a"), "b").distinct()
    whole = nodes.select(F.col("node").alias("head"), F.size("grams").alias("size_head")), nodes.select(F.col("node").alias("b"), F.size("grams").alias("size_b")), nodes.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    answers = compared(asked.filter("a <> b"), nodes).select(F.col("a").alias("head"), "b", "common")
    answers = answers.union(asked.filter("a = b").select(F.col("a").alias("head"), "b", F.lit(None).cast("int")))
    answers = answers.join(whole[0], "head").join(whole[1], "b").withColumn("common", F.coalesce("common", "size_b"))
    named = named.join(answers, ["head", "b"]).withColumn("size_a", F.col("size_head") + F.size("more") - F.size("less"))
    alike = lambda c: _alike(c, F.col("size_a"), F.col("size_b"), num, den)
    named = named.filter(alike(F.col("common") + F.size("more"))).withColumn("sure", alike(F.col("common") - F.size("less")))
    named = scratch(named.select("a", "b", "more", "less", "common", "size_a", "size_b", "sure"), "derived")
    common = F.col("common") + F.size(F.array_intersect("more", "grams_b")) - F.size(F.array_intersect("less", "grams_b"))
    return named.filter("sure").select("a", "b").union(named.filter("not sure").join(whole[2], "b").filter(alike(common)).select("a", "b"))


def parity(grams: np.ndarray) -> np.ndarray:
    """Bits that say of how many elements fall on them, whether odd.  Two sets differ in at least as many elements as their sketches in bits."""
    h = mix(grams.view(np.uint64))
    bits = np.bincount((h % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def block_pairs(place: np.ndarray, size: np.ndarray, label: np.ndarray, sketch: np.ndarray, part: np.ndarray, split: bool, num: int, den: int):
    """Pairs of entries (of different labels, and parts if the list is split) of one list that may link, with their sketches' distance."""
    order = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.diff(place[order], prepend=-1, append=-1))
    blocks = [order[i:j] for i, j in zip(edges, edges[1:])]
    most = int(2 * size.max() * (den - num) / (den + num))
    found = []
    for i, x in enumerate(blocks):
        for y in blocks[i:]:
            if place[x[0]] + place[y[0]] > most:
                break  # and so are all blocks of later positions
            for x_at in range(0, len(x), 1024):
                xs = x[x_at : x_at + 1024]
                n, m = size[xs][:, None], size[y][None, :]
                need = -(-(n + m) * num // (num + den))
                ok = (label[xs][:, None] != label[y][None, :]) & (np.minimum(n, m) * den >= np.maximum(n, m) * num)
                ok &= np.minimum(n - place[xs][:, None], m - place[y][None, :]) >= need
                if split:
                    ok &= part[xs][:, None] != part[y][None, :]
                if y is x:
                    ok &= xs[:, None] < y[None, :]
                a, b = np.nonzero(ok)
                a, b = xs[a], y[b]
                for k in range(0, len(a), 1 << 18):
                    u, v = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
                    far = np.bitwise_count(sketch[u] ^ sketch[v]).sum(axis=1, dtype=np.int64)
                    near = far <= size[u] + size[v] - 2 * (-(-(size[u] + size[v]) * num // (num + den)))
                    found.append(np.stack([u[near], v[near], far[near]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def candidates(entries: DataFrame, n_tasks: int, num: int, den: int, best: int = 0) -> DataFrame:
    """Pairs (a < b, far) across labels that the filters leave; with `best` only that many of the nearest to each node in a list."""

    def run(got: pd.DataFrame) -> pd.DataFrame:
        give_back()
        out = []
        for (_, i, j), g in got.groupby(["gram", "part_a", "part_b"], sort=False):
            label = g["label"].to_numpy()
            if (label == label[0]).all():
                continue
            sketch = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
            pairs = block_pairs(g["place"].to_numpy(), g["size"].to_numpy(), label, sketch, g["part"].to_numpy(), i != j, num, den)
            if best and len(pairs):
                both = np.concatenate([pairs, pairs[:, [1, 0, 2]]])
                both = both[np.lexsort((label[both[:, 1]], both[:, 2], both[:, 0]))]
                head = np.flatnonzero(np.diff(both[:, 0], prepend=-1))
                nth = np.arange(len(both)) - np.repeat(head, np.diff(np.append(head, len(both))))
                pairs = both[nth < best]
            node = g["node"].to_numpy()
            x, y = node[pairs[:, 0]], node[pairs[:, 1]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y), pairs[:, 2]], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64), columns=["a", "b", "far"])

    parts = F.ceil(F.col("n") / F.lit(LIST)).cast("int")
    dealt = entries.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("gram", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "node", "size", "place", "label", "sketch")
    return dealt.groupBy(F.pmod(F.xxhash64("gram", "part_a", "part_b"), F.lit(n_tasks))).applyInPandas(run, "a long, b long, far long").distinct()


def with_sketch(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            give_back()
            yield pd.DataFrame({"node": b["node"], "sketch": [parity(np.asarray(g, np.int64)).tobytes() for g in b["grams"]]})

    return nodes.select("node", "grams").mapInPandas(run, "node long, sketch binary")


def links(found: DataFrame, num: int, den: int) -> DataFrame:
    """node, label of all nodes of `found` (see `sets`) that link with another."""
    spark = found.sparkSession
    nodes = found.filter(F.col("grams").isNotNull()).groupBy(F.col("sig").alias("node")).agg(*[F.first(c).alias(c) for c in ("size", "skip", "grams")])
    nodes = scratch(nodes, "nodes")
    prefix = F.col("size") - F.ceil(F.col("size") * num / F.lit(den)).cast("long") + 1
    listed = F.slice("grams", (F.col("skip") + 1).cast("int"), (prefix - F.col("skip")).cast("int"))
    index = nodes.select("node", "size", "skip", F.posexplode(listed).alias("place", "gram")).select("gram", "node", "size", (F.col("place") + F.col("skip")).alias("place"))
    lists = index.groupBy("gram").agg(F.count("*").alias("n"), F.min(F.struct("node", "size", "place")).alias("head")).filter("n > 1")
    lists = scratch(lists, "lists")

    # 1: with the head of most lists in common
    met = index.join(lists, "gram").filter(F.col("node") != F.col("head.node")).filter(_fits(num, den, F.col("size"), F.col("head.size"), F.lit(0), F.lit(0)))
    met = met.groupBy(F.col("node").alias("a"), F.col("head.node").alias("b")).agg(F.count("*").alias("shared"))
    met = met.groupBy("a").agg(F.max(F.struct("shared", -F.col("b"))).alias("top")).select("a", (-F.col("top")["col2"]).alias("b"))
    heads = scratch(verify(met, nodes, num, den, salted=True).withColumnRenamed("b", "head"), "heads")
    links = heads.select("a", F.col("head").alias("b"))
    label = components(spark, links)

    # 2: across components
    shared = scratch(index.join(lists.select("gram", "n"), "gram"), "index")
    # every entry of a list is dealt once for each of the list's parts
    dealt = lists.agg(F.sum(F.col("n") * F.ceil(F.col("n") / F.lit(LIST)))).first()[0] or 0
    n_tasks = max(spark.sparkContext.defaultParallelism, dealt // 20_000 + 1)
    best, tried = 3, scratch(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "tried")
    while True:
        named = scratch(shared.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
        mixed = scratch(named.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("gram"), "mixed")
        entries = named.join(mixed, "gram", "left_semi").join(with_sketch(nodes), "node")
        pairs = candidates(entries, n_tasks, num, den, best).join(tried, ["a", "b"], "left_anti")
        if best:  # one for each node
            each = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
            near = pairs.select(each.alias("p"), "far").groupBy("p.node").agg(F.min(F.struct("far", "p.other")).alias("near"))
            pairs = near.select(F.least("node", "near.other").alias("a"), F.greatest("node", "near.other").alias("b")).distinct()
        pairs = scratch(pairs.select("a", "b"), "pairs")
        known = heads.select("a")
        fresh = verify(pairs.join(known, "a", "left_anti"), nodes, num, den).select("a", "b")
        fresh = scratch(fresh.union(derive(pairs.join(known, "a", "left_semi"), nodes, heads, num, den)), "linked")
        more = fresh.limit(1).count()
        if more:
            links = links.union(fresh)
            label = components(spark, links)
        if not best:
            return label
        tried = tried.union(pairs)
        best = best if more else 0


def ngram_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; also row_key, a hash of its id and text, and component, which is alike for the rows of one component only (null for an empty set)."""
    found = scratch(sets(docs, n, num, den, id_col, text_col), "sets")
    label = links(found, num, den)
    named = found.filter("size > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    named = scratch(named.join(label.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "doc_id", F.coalesce("label", "sig").alias("component")), "named")
    least = scratch(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    named = scratch(named.join(least, "component").select("sig", "component", "component_id"), "component")
    rows = found.select("doc_id", "row_key", "size", F.when(F.col("size") > 0, F.col("sig")).alias("sig")).join(named, "sig", "left")
    return rows.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key", "component")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op7_ngram_join": op7_ngram_join}
SQL = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reach) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
}
