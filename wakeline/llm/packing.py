"""Best-fit packing (op10): pieces of documents into as few sequences as possible.

`pack` places lengths best fit first, longest first, and then improves by local search: it takes the least
filled bins and moves their items into other underfull bins, or exchanges one item for one or two
others, whenever that increases the sum of squared fills, until a bin is empty and gone.  It stops when the number
of bins meets the lower bound ceil(sum / capacity) or no step helps.

Documents are packed in shards of about `SHARD` pieces that are dealt by hash of the piece and of where it stands, so a worker holds a bounded number of
lengths whatever the corpus and equal rows spread; only (id, piece, length, checksum) are shuffled.  The least filled sequences of `FAN` shards are then packed anew
together, and those of `FAN` such groups again, until one group is left, so what is left over doesn't grow with the shards.  Null and empty texts are one piece, the end id alone; rows with equal ids are packed each for itself; an empty table gives an empty result.
Ties in length go by id and piece.  A worker holds the ids of one text, however long, at a time besides a batch of texts.  `pieces` reads id and text only; `place` passes other columns through, whatever their names but
_part, sequence_id and offset.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wakeline.llm.common import documents, give_back, id_back, id_text, scratch
from wakeline.llm.tokenizer import cuts, tokenizer

#: Pieces in a shard, about.
SHARD = 8192
#: Least filled bins that one round of the local search tries to empty.
TRIES = 64
#: Shards whose least filled bins are packed anew together, and the pieces that each hands on, about.
FAN, HANDED = 16, 128


class Bins:
    """Bins of item numbers; bins that are not full can be found by their room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.own: dict[int, list[tuple[int, int]]] = {}  # sorted (size, item) of bins, as long as they stay

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that still takes it."""
        rooms: list[int] = []  # sorted rooms that some bin has
        at: dict[int, list[int]] = defaultdict(list)
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            s = self.sizes[i]
            k = bisect.bisect_left(rooms, s)
            if k == len(rooms):
                b, left = len(self.items), self.capacity - s
                self.items.append([i])
                self.room.append(left)
            else:
                r = rooms[k]
                b = at[r].pop()
                if not at[r]:
                    rooms.pop(k)
                left = r - s
                self.items[b].append(i)
                self.room[b] = left
            if left:
                if not at[left]:
                    bisect.insort(rooms, left)
                at[left].append(b)

    def local_search(self) -> None:
        least = math.ceil(sum(self.sizes) / self.capacity) if self.sizes else 0
        while sum(map(bool, self.items)) > least:
            under = sorted((b for b, it in enumerate(self.items) if it and self.room[b]), key=lambda b: -self.room[b])
            if not any([self._empty(b, under) for b in under[:TRIES]]) and not any(self._empty(b, under) for b in under[TRIES:]):
                break
        keep = [b for b, it in enumerate(self.items) if it]
        self.items, self.room = [self.items[b] for b in keep], [self.room[b] for b in keep]

    def _empty(self, b: int, under: list[int]) -> bool:
        """Steps that take weight out of bin b into fuller bins.  True if any was taken."""
        any_step = False
        while self.items[b]:
            step = next((s for x in sorted(self.items[b], key=lambda i: -self.sizes[i]) if (s := self._step(b, x, under))), None)
            if step is None:
                break
            x, other, back = step
            out, into = sum(self.sizes[y] for y in back), self.sizes[x]
            self.items[b].remove(x)
            self.items[b] += back
            for y in back:
                self.items[other].remove(y)
            self.items[other].append(x)
            self.room[other] -= into - out
            self.room[b] += into - out
            self.own.pop(b, None)
            self.own.pop(other, None)
            any_step = True
        return any_step

    def _step(self, b: int, x: int, under: list[int]):
        """(item, other bin, items that come back): the step with item x that gains most, if one gains."""
        size, fill, best, gain = self.sizes[x], self.capacity - self.room[b], None, 0
        for o in under:
            room = self.room[o]
            if o == b or not room or not self.items[o]:
                continue
            if 2 * room * (self.capacity - fill) <= gain:
                continue  # what filling it up would gain
            full = self.capacity - room
            own = self.own.get(o) or self.own.setdefault(o, sorted((self.sizes[y], y) for y in self.items[o]))
            options = [(0, [])] if size <= room else []
            # one for one and two for one: what comes back is less than x by at most the room
            options += [(s, [y]) for s, y in own if 0 < size - s <= room]
            lo, hi = 0, len(own) - 1
            while lo < hi:
                two = own[lo][0] + own[hi][0]
                if two >= size:
                    hi -= 1
                else:
                    if size - two <= room:
                        options.append((two, [own[lo][1], own[hi][1]]))
                    lo += 1
            for back, items in options:
                d = size - back
                # (full + d)^2 + (fill - d)^2 - full^2 - fill^2
                if (g := 2 * d * (full - fill + d)) > gain:
                    best, gain = (x, o, items), g
        return best


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin.  Sizes are between 1 and the capacity."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.local_search()
    return bins.items


def pieces(docs: DataFrame, json_file: str, most: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The id pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian uint32)."""
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches):
        encode = tokenizer(json_file).encode
        for b in batches:
            give_back()
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = np.concatenate([encode(text), end]).astype("<u4")
                for k, (start, n) in enumerate(cuts(len(ids), most)):
                    raw = ids[start : start + n].tobytes()
                    rows.append((doc, k, start, n, zlib.crc32(raw), *[raw] * with_ids))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    rows = docs.select(id_text(id_col), F.col(text_col).cast("string").alias("text"))
    return id_back(rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids))


def least_filled(sizes: list[int], bins: list[list[int]], capacity: int, most: int) -> set[int]:
    """The least filled bins that aren't full: as many as have `most` items together, one at least."""
    fill = [sum(sizes[i] for i in items) for items in bins]
    out, n = set(), 0
    for b in sorted((b for b, f in enumerate(fill) if f < capacity), key=fill.__getitem__):
        n += len(bins[b])
        if out and n > most:
            break
        out.add(b)
    return out


def place(found: DataFrame, capacity: int, shard: int = SHARD) -> DataFrame:
    """Add sequence_id and offset to pieces (columns doc_id, piece, length and any others) that stand in a table, so that a task that runs again deals them alike."""
    spare = found.filter(F.col("length") < capacity)
    parts = [max(1, math.ceil(spare.count() / shard))]
    while parts[-1] > 1:
        parts.append(math.ceil(parts[-1] / FAN))
    schema = T.StructType([*found.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", "sequence_id", "offset"))])

    def packed(rows: DataFrame, k: int) -> DataFrame:
        n, rounds, fan, handed = parts[k], len(parts), FAN, HANDED

        def run(key, rows):
            give_back()
            part = key[0].as_py()
            rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length", "ids_crc32") if c in rows.column_names])
            sizes, order, seq, off = rows.column("length").to_pylist(), [], [], []
            bins = pack(sizes, capacity)
            on = least_filled(sizes, bins, capacity, handed) if n > 1 else ()
            for b, items in enumerate(bins):
                at = 0
                for i in items:
                    order.append(i)
                    seq.append(-1 if b in on else ((b * n + part) * rounds + k) * 2)
                    off.append(at)
                    at += sizes[i]
            rows, long = rows.take(pa.array(order, pa.int64())).drop_columns(["_part"]), pa.int64()
            for name, values in (("_part", [part // fan] * len(order)), ("sequence_id", seq), ("offset", off)):
                rows = rows.append_column(name, pa.array(values, long))
            return rows.cast(to_arrow_schema(schema))

        return rows.groupBy("_part").applyInArrow(run, schema)

    left, out = spare.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id()), F.lit(parts[0])).cast("long")), []
    for k in range(len(parts) - 1):
        done = scratch(packed(left, k), "packed")
        out.append(done.filter("sequence_id >= 0"))
        left = done.filter("sequence_id < 0").select(*found.columns, "_part")
    full = found.filter(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    all_ = packed(left, len(parts) - 1).drop("_part")
    for done in out:
        all_ = all_.unionByName(done.drop("_part"))
    return all_.unionByName(full)


def best_fit_packing(docs: DataFrame, json_file: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset of every piece of every document."""
    return place(scratch(pieces(docs, json_file, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
