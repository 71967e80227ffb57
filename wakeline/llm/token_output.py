"""Token-ID output (op1): documents packed into an id matrix of fixed width.

Best fit, longest first; a segment tree over the rooms 0..width finds the least room that takes a piece in
log(width) steps.  Overlong documents are split without loss.  Each row of the matrix comes with its
cumulative segment lengths and the positions, which start again at 0 with each segment.

Packing happens where the texts are read: a task packs windows of `WINDOW` ids, so nothing is shuffled and a worker holds one
window, and the ids of the text that fills it, however long.  Null and empty texts are one segment, the end id alone.  Rows with equal ids are packed each for itself; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import documents, id_text
from wakeline.llm.tokenizer import cuts, tokenizer

#: Ids that a task packs at a time.
WINDOW = 8 << 20

SCHEMA = "window_key string, row long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class RoomTree:
    """Segment tree over rooms: how many bins have each room; finds the least room of at least s."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.n)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        i = room + self.n
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, bin) with the least room of at least `least`, removed from the tree."""
        count, i = self.count, least + self.n
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a subtree to the right has bins
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:  # down, to its first leaf with bins
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.n
        b = self.bins[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, b


def pack_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin, longest item first."""
    tree, bins = RoomTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = capacity, len(bins)
            bins.append([])
        room, b = found
        bins[b].append(i)
        tree.add(room - sizes[i], b)
    return bins


def matrix(segments: list[tuple[int | None, int, np.ndarray]], width: int, pad_id: int, dtype: str, key: str, first: int) -> pd.DataFrame:
    """Rows of SCHEMA for segments (doc_id, piece, ids)."""
    rows = []
    spot = np.arange(width, dtype=dtype)
    for r, items in enumerate(pack_decreasing([len(s[2]) for s in segments], width)):
        ids, at = np.full(width, pad_id, dtype), np.zeros(width, dtype)
        ends = [0]
        for i in items:
            part, end = segments[i][2], ends[-1]
            ids[end : end + len(part)] = part
            at[end : end + len(part)] = spot[: len(part)]
            ends.append(end + len(part))
        rows.append((key, first + r, ends[-1], [segments[i][0] for i in items], [segments[i][1] for i in items], ends, ids.tobytes(), at.tobytes()))
    return pd.DataFrame(rows, columns=["window_key", "row", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids"])


def token_output(docs: DataFrame, json_file: str, width: int = 2048, end_id: int = 50256, pad_id: int = 50256, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The packed matrix.  window_key and row together name a row; window_key is the task's first id and its number.  Ties in length go by order of reading.
    input_ids and position_ids hold `width` little-endian numbers, of 16 bits if the vocabulary and width allow, else 32; n_tokens of them are no padding."""

    def run(batches):
        encode = tokenizer(json_file)
        dtype = "<u2" if max(encode.size, end_id + 1, pad_id + 1, width) <= 1 << 16 else "<u4"
        held, size, first, key = [], 0, 0, None
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                doc = None if doc is None else int(doc)
                ids = np.append(encode.encode(text), np.uint32(end_id)).astype(dtype)
                key = key or f"{doc}-{b['at'].iloc[0]}"
                held += [(doc, k, ids[s : s + n]) for k, (s, n) in enumerate(cuts(len(ids), width))]
                size += len(ids)
                if size >= window:
                    yield (out := matrix(held, width, pad_id, dtype, key, first))
                    first, held, size = first + len(out), [], 0
        if held:
            yield matrix(held, width, pad_id, dtype, key, first)

    rows = docs.select(id_text(id_col), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("at"))
    return rows.mapInPandas(run, SCHEMA)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_token_output": op1_token_output}
