"""Document fingerprints (op3): improbable-feature digests.

Every window of `WINDOW` bytes has an entropy; how often each (quantised) entropy occurs in the whole corpus is counted
first, 1001 numbers in all, and the rarer an entropy, the lower the rank of its windows.  In each run of `RUN` windows the lowest
rank, leftmost on ties, scores a point; windows of `POINTS` points or more are the text's features.  They go into
a chain of Bloom filters of 2048 bits, `PER_FILTER` features each.  Two chains are as alike as, on average, the filters of the
shorter one to their best match in the other: bits in common, less what chance alone gives, over the most there could be.

A text shorter than a window is one feature, a text without a chosen window has its lowest window as feature.  Null counts as
the empty text, whose fingerprint is the empty string; two empty ones are alike (1.0), an empty one and another are not (0.0).
An empty table gives no rows; other columns are not read, whatever their names.  Texts are worked on `BLOCK` bytes at a time, but a longer one in one go:
a worker holds some 40 bytes for each of its.

`next` documents: texts are dealt once, by blocks of the id's order; a block gets the first row of the block after it as well, so each
task streams sorted rows and holds two at a time besides its batch.  Rows with equal ids are ordered by text, null ids come first, and the
last row's next is the first.  Block borders are at most `MAX_BLOCKS` ids.
"""

from __future__ import annotations

import base64
import hashlib
import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import CHUNK_BYTES, documents, id_back, id_text, mix, text_bytes

WINDOW, RUN, POINTS, PER_FILTER, BITS = 64, 64, 16, 160, 2048
LEVELS = 1001
#: Entropies below this level make no feature.
LEAST_LEVEL = 100
MAX_BLOCKS = 8192
#: Bytes that are worked on at once.
BLOCK = 1 << 19

_SCALE = 1 << 20
_PART = np.array([0] + [round(-c / WINDOW * math.log2(c / WINDOW) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_GAIN = np.diff(_PART, prepend=0).astype(np.int32)  # entropy of c equal bytes over that of c - 1


def _joined(texts: list[bytes]):
    """Groups of texts as one array each, with gaps wider than a window: (array, starts, sizes, numbers)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t) + WINDOW
        if size >= BLOCK or i == len(texts) - 1:
            sizes = np.array([len(texts[k]) for k in group], np.int64)
            x = np.frombuffer(b"".join(texts[k] + bytes(WINDOW) for k in group) + bytes(WINDOW), np.uint8)
            yield x, np.cumsum(sizes + WINDOW) - sizes - WINDOW, sizes, group
            group, size = [], 0


def levels(x: np.ndarray) -> np.ndarray:
    """Entropy level of the window at each position of x (the last WINDOW have none)."""
    n = len(x)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for s in range(1, WINDOW):
        same = (x[s:] == x[:-s]).view(np.uint8)
        ahead[:-s] += same
        behind[s:] += same
    step = _GAIN[behind[WINDOW:]] - _GAIN[ahead[: n - WINDOW]]
    first = _PART[np.bincount(x[:WINDOW], minlength=256)].sum()
    h = np.cumsum(step, dtype=np.int64)
    h = np.concatenate([[0], h[:-1]]) + first
    return np.maximum(h * (LEVELS - 1) // (6 * _SCALE), 0)


def _inside(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which positions start a window that lies within a text."""
    mark = np.zeros(n + 1, np.int8)
    some = sizes >= WINDOW
    mark[starts[some]] += 1
    mark[starts[some] + sizes[some] - WINDOW + 1] -= 1
    return np.cumsum(mark[:-1]).astype(bool)


def level_counts(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(LEVELS, np.int64)
    for x, starts, sizes, _ in _joined(texts):
        if len(x) > 2 * WINDOW:
            at = levels(x)
            out += np.bincount(at[_inside(len(at), starts, sizes)], minlength=LEVELS)[:LEVELS]
    return out


def ranks_of(counts) -> np.ndarray:
    """Rank of each level: the rarer, the lower; levels under the least are out of the question."""
    order = np.argsort(np.asarray(counts, np.int64), kind="stable")
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    rank[:LEAST_LEVEL] = LEVELS
    return rank


def _hashes(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the window at each of the positions."""
    lanes = np.ascontiguousarray(x[at[:, None] + np.arange(WINDOW)]).view("<u8")
    h = np.full(len(at), WINDOW, np.uint64)
    for k in range(WINDOW // 8):
        h = mix(h * np.uint64(3) + lanes[:, k])
    return h


def digests(texts: list[bytes], rank: np.ndarray) -> list[bytes]:
    """The chain of filters of each text."""
    out: list[bytes] = [b""] * len(texts)
    none = np.int64(LEVELS + 1) << 40
    for x, starts, sizes, numbers in _joined(texts):
        n = len(x) - WINDOW
        at, ok = levels(x), _inside(n, starts, sizes)
        key = np.where(ok, rank[at] << 40, none) + np.arange(n)
        low, reach = key, 1
        while reach < RUN:
            ahead = np.full(n, none)
            ahead[: n - reach] = low[reach:]
            low, reach = np.minimum(low, ahead), 2 * reach
        # runs that lie within a text, and the one run of a text with fewer windows
        begins = np.zeros(n + 1, np.int8)
        some = sizes >= WINDOW
        begins[starts[some]] += 1
        begins[starts[some] + np.maximum(sizes[some] - WINDOW - RUN + 2, 1)] -= 1
        chosen = low[np.cumsum(begins[:-1]).astype(bool)]
        points = np.bincount(chosen[chosen >> 40 < LEVELS] & ((1 << 40) - 1), minlength=n)
        picked = np.flatnonzero(points >= POINTS)
        hashes, first = _hashes(x, picked), np.searchsorted(picked, starts)
        last = np.searchsorted(picked, starts + sizes)
        for k, i in enumerate(numbers):
            if sizes[k] == 0:
                continue
            own = hashes[first[k] : last[k]]
            if not len(own):
                if sizes[k] < WINDOW:
                    spot = starts[k]
                else:
                    spot = starts[k] + np.argmin(key[starts[k] : starts[k] + sizes[k] - WINDOW + 1])
                own = _hashes(x, np.array([spot]))
            out[i] = _chain(own)
    return out


def _chain(features: np.ndarray) -> bytes:
    _, at = np.unique(features, return_index=True)
    own = features[np.sort(at)]
    bits = np.zeros(-(-len(own) // PER_FILTER) * BITS, np.uint8)
    base = np.arange(len(own)) // PER_FILTER * BITS
    for k in range(5):
        bits[base + (own >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; symmetric."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b) or (len(a) == len(b) and a > b):
        a, b = b, a
    x, y = (np.frombuffer(v, np.uint64).reshape(-1, BITS // 64) for v in (a, b))
    nx, ny = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (x, y))
    best = np.zeros(len(x))
    for k in range(len(y)):
        both = np.bitwise_count(x & y[k]).sum(axis=1, dtype=np.int64)
        chance, most = nx * ny[k] / BITS, np.minimum(nx, ny[k])
        cut = chance + 0.3 * (most - chance)
        best = np.maximum(best, (both - cut) / np.maximum(most - cut, 1e-9))
    return float(np.clip(best, 0.0, 1.0).mean())


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks from the entropy levels of all windows of all documents: 1001 sums are collected."""

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            total += level_counts([t.encode() for t in b["text"] if t])
        yield pd.DataFrame({"level": np.arange(LEVELS), "n": total})

    text = docs.select(F.col(text_col).cast("string").alias("text"))
    rows = text.mapInPandas(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = [0] * LEVELS
    for r in rows:
        counts[r["level"]] = r["n"]
    return ranks_of(counts)


def fingerprints(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row, where it is read."""

    def run(batches):
        for b in batches:
            chains = digests([(t or "").encode() for t in b["text"]], rank)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [base64.b64encode(c).decode() for c in chains]})

    rows = docs.select(id_text(id_col), F.col(text_col).cast("string").alias("text"))
    return id_back(rows.mapInPandas(run, "doc_id string, fingerprint string"))


def _block(key, bounds: list[int]):
    """Number of bounds that are <= key, by binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    size = 1 << (len(bounds).bit_length() - 1)
    steps = F.array(*[F.lit(size >> k) for k in range(size.bit_length())])
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")  # a constant, however many there are
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.try_element_at(table, at + s) <= key), at + s).otherwise(at))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows block, extra, doc_id, text; partitions sorted so that after each row (extra 0) its next one comes, in the same block."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = min(MAX_BLOCKS, max(1, math.ceil(text_bytes(rows) / CHUNK_BYTES)))
    cuts = rows.agg(F.percentile_approx("doc_id", F.split(F.lit(",".join(str(k / n) for k in range(1, n))), ",").cast("array<double>"), 100 * n)).first()[0] if n > 1 else []
    rows = rows.withColumn("block", _block(key, sorted(set(cuts or [])))).withColumn("extra", F.lit(0))
    firsts = sorted((r["block"], r["first"]) for r in rows.groupBy("block").agg(F.min(key).alias("first")).collect())
    if not firsts:
        return rows.select("block", "extra", "doc_id", "text")
    # at most MAX_BLOCKS rows of 12 bytes: the first key of each block, and the block before it
    before = docs.sparkSession.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "key long, block int")
    spare = rows.select(key.alias("key"), "text").join(F.broadcast(before), "key").groupBy("key", "block").agg(F.min("text").alias("text"))
    spare = spare.select("block", F.lit(1).alias("extra"), F.lit(None).cast("long").alias("doc_id"), "text")
    both = rows.select("block", "extra", "doc_id", "text").unionByName(spare)
    return both.repartition(2 * n, "block").sortWithinPartitions("block", "extra", F.col("doc_id").asc_nulls_first(), "text")


def edited(text: str, follower: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def fingerprint_report(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches):
        held = None  # the last row so far: block, extra, doc_id, text, chain
        for b in batches:
            rows = list(zip(b["block"], b["extra"], b["doc_id"], b["text"]))
            chains = digests([r[3].encode() for r in rows], rank)
            rows = [(*r, c) for r, c in zip(rows, chains)]
            if held:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(r, s) for r, s in zip(rows, rows[1:]) if not r[1]]
            changed = [edited(r[3], s[3]) for r, s in pairs]
            out = []
            for (r, s), text, chain in zip(pairs, changed, digests([t.encode() for t in changed], rank)):
                sha = hashlib.sha256(text.encode()).hexdigest()
                out.append((r[2], len(r[3]), sha, base64.b64encode(r[4]).decode(), base64.b64encode(chain).decode(), likeness(r[4], chain), likeness(r[4], s[4])))
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows = in_order(docs, id_col, text_col).select("block", "extra", id_text("doc_id"), "text")
    return id_back(rows.mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return fingerprint_report(docs, rarity(docs))


QUERIES = {"op3_fingerprints": op3_fingerprints}
