"""Shared plumbing of the text operators: scratch tables, chunked documents and keyed exchange.

Rows are never gathered on the driver.  Texts are cut where they are read into *chunks* of a bounded number of
bytes (`chunked`) and dealt once; a chunk is the unit a Python worker holds.  Where a chunk needs to know something
about the whole corpus (how often a key occurs, which probability an n-gram has) it sends one blob of
distinct, pre-aggregated keys to every *bucket* of the key space and gets one blob back (`ask`).  A hot
key therefore reaches a bucket once per chunk, however often it occurs.
"""

from __future__ import annotations

import math
import mmap
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a chunk; a worker holds a few times as much.
CHUNK_BYTES = 8 << 20
#: Keys that one bucket takes, about.
BUCKET_KEYS = 1 << 20

#: Moments after which `give_back` ends, if nothing is freed or taken.
QUIET = 10

ASK_SCHEMA = "bucket long, chunk long, payload binary"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).  In local mode a temporary one if none is set; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="wakeline-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/wakeline-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def id_text(id_col: str = "doc_id"):
    """The id as text, for Python workers: pandas would make doubles of long ids that stand beside a null, and round them."""
    return F.col(id_col).cast("long").cast("string").alias("doc_id")


def id_back(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0])


def chunked(docs: DataFrame, total: int, make: Callable[[pa.Table], bytes], id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 0, more: dict | None = None) -> DataFrame:
    """chunk, payload: what `make` makes of the rows (doc_id, text and the columns `more`) of each chunk of about `chunk_bytes` bytes of text, a longer text being a chunk of
    its own.  Chunks are made where the rows are read, so equal rows spread as they lie, and dealt once.  Their names hang on the
    partition and the place there: `docs` should be a table, or anything else that is read alike when a task runs again."""
    most = chunk_bytes or CHUNK_BYTES
    n = max(1, math.ceil(total / most))

    def run(batches):
        from pyspark import TaskContext

        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def done():
            give_back()
            return pa.RecordBatch.from_pydict({"chunk": [chunk], "payload": [make(pa.Table.from_batches(held))]}, pa.schema([("chunk", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            after = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                base = after[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(after, base + most - size, side="right")))
                held.append(batch.slice(at, end - at))
                size += int(after[end - 1] - base)
                at = end
                if size >= most or at < batch.num_rows:
                    yield done()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(k) for k, c in (more or {}).items()])
    return rows.mapInArrow(run, "chunk long, payload binary").repartition(n, "chunk")


def slices(texts: pa.Array | pa.ChunkedArray, most: int) -> Iterator[pa.Array | pa.ChunkedArray]:
    """The texts in order, in parts of at most `most` bytes; a longer text is a part of its own."""
    after = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def pack_table(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack_table(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def exact(ids: pa.ChunkedArray) -> pd.Series:
    """Long ids as pandas has them without rounding, null or not."""
    return ids.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def n_buckets(keys: int) -> int:
    return max(1, math.ceil(keys / BUCKET_KEYS))


def ask(
    chunks: DataFrame,
    emit: Callable[..., list[tuple[int, int, bytes]]],
    answer: Callable[[pd.DataFrame], list[tuple[int, int, bytes]]],
    n: int,
    heard: DataFrame | None = None,
) -> DataFrame:
    """One round: `emit` makes (bucket, chunk, payload) blobs of a chunk's number and payload (and of the (bucket, payload) rows it heard in
    the round before); `answer` turns all blobs of one of the `n` buckets into blobs for the chunks.  There are as many partitions as buckets, so tasks don't grow with the corpus."""
    return asked(chunks, emit, n, heard).groupBy("bucket").applyInPandas(lambda got: blobs(answer(got)), ASK_SCHEMA)


def blobs(rows: list) -> pd.DataFrame:
    give_back()
    return pd.DataFrame(rows, columns=["bucket", "chunk", "payload"])


def asked(chunks: DataFrame, emit: Callable[..., list[tuple[int, int, bytes]]], n: int, heard: DataFrame | None = None) -> DataFrame:
    if heard is None:
        out = chunks.groupBy("chunk").applyInPandas(lambda part: blobs(emit(int(part["chunk"].iloc[0]), part["payload"].iloc[0])), ASK_SCHEMA)
    else:
        out = meet(chunks, heard, lambda *args: blobs(emit(*args)), ASK_SCHEMA)
    return out.repartition(max(n, 2), "bucket")


def meet(chunks: DataFrame, heard: DataFrame, step: Callable[[int, bytes, list[tuple[int, bytes]]], pd.DataFrame], schema) -> DataFrame:
    """`step` of each chunk's number and payload and of what it heard."""

    def run(part: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return blobs([]) if schema == ASK_SCHEMA else pd.DataFrame()
        give_back()
        return step(int(part["chunk"].iloc[0]), part["payload"].iloc[0], list(zip(said["bucket"].tolist(), said["payload"].tolist())))

    return chunks.groupBy("chunk").cogroup(heard.groupBy("chunk")).applyInPandas(run, schema)


_asked, _giver = False, None


def give_back(after: float = 1.0) -> None:
    """Return freed memory to the system every moment from now on, until nothing has been freed or taken for `QUIET` moments: what is in hand at the last call is freed later, and
    workers live on from stage to stage, where what they keep adds to the executor's."""
    import threading

    global _asked, _giver
    _asked = True
    if _giver is None or not _giver.is_alive():
        _giver = threading.Thread(target=_give, args=(after,), daemon=True)
        _giver.start()


def _give(after: float) -> None:
    import time

    global _asked
    quiet, size = 0, 0
    while _asked or quiet < QUIET:
        asked, _asked = _asked, False
        time.sleep(after)
        if asked or abs(_resident() - size) > 1 << 20:
            _trim()
            quiet, size = 0, _resident()
        else:
            quiet += 1


def _resident() -> int:
    """Bytes of memory that the process has; 0 where that can't be read."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * mmap.PAGESIZE
    except OSError:
        return 0


def _trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def _narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in as few bytes as they need."""
    if a.dtype.kind not in "iu" or not len(a) or int(a.min()) < 0:
        return a
    return a.astype(np.min_scalar_type(int(a.max())))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of any length and dtype as one blob: bytes of the same weight together, compressed."""
    import zstandard

    small = [np.ascontiguousarray(_narrow(a)) for a in arrays]
    head = [len(arrays)]
    for a, s in zip(arrays, small):
        head += [ord(a.dtype.char), ord(s.dtype.char), len(a)]
    body = b"".join(s.view(np.uint8).reshape(len(s), s.dtype.itemsize).T.tobytes() for s in small)
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + body)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8), 8 + 24 * n, []
    for kind, stored, size in head.reshape(-1, 3):
        dtype = np.dtype(chr(stored))
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype).astype(chr(kind), copy=False))
        at += int(size) * dtype.itemsize
    return out


def pack_sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted uint64 keys as the first and the differences, which are small."""
    return keys[:1], np.diff(keys)


def unpack_sorted(first: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([first, gaps]), dtype=np.uint64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of uniformly spread uint64 keys, by range: sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordIds(dict):
    """Numbers words in order of first use: ids[word] gives the number, new or old."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_hashes(words) -> np.ndarray:
    """64-bit hashes of byte strings."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text in UTF-8, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(doc_id, m: int) -> int:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def id_crc_mod(col: str, m: int):
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


class Words:
    """The words of a chunk's texts, one array after the other: number of each word, where each text starts and how long it is."""

    def __init__(self, texts, split: Callable[[str | None], list[bytes]]):
        ids = WordIds()
        parts = []
        for t in texts:
            words = split(t)
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.at = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.distinct = word_hashes(list(ids))
        self.ids = ids


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of any run of words, equal for equal runs wherever they stand."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * powers(_BASE, n), dtype=np.uint64)])
        self.back = powers(_BASE_INVERSE, n)

    def runs(self, at: np.ndarray, n) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.back[at])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_tables = [powers(_BASE, 1 << 16), powers(_BASE_INVERSE, 1 << 16)]


def byte_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of UTF-8 text, and where they start; made for the whole array at once."""
    x = np.frombuffer(data, np.uint8)
    word = np.zeros(len(x) + 2, np.int8)
    word[1:-1] = ~_SPACE[x]
    step = np.diff(word)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(_tables[0]) < len(x):
        _tables[:] = [powers(_BASE, len(x)), powers(_BASE_INVERSE, len(x))]
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTES[x] * _tables[0][: len(x)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _tables[1][start] + (end - start).astype(np.uint64)), start


class WordRuns:
    """Hashes of the words of a chunk's texts, one text after the other: where each text starts and how many it has."""

    def __init__(self, texts, lower: bool, split_bytes: int = 1 << 20):
        hashes, sizes, held, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], 0

        def done():
            found, start = byte_words(b"\n".join(held))
            hashes.append(found)
            sizes.append(np.diff(np.searchsorted(start, np.cumsum([len(h) + 1 for h in held])), prepend=0))

        for t in texts:
            d = (t or "").encode("utf-8", "surrogatepass")
            held.append(d.lower() if lower else d)  # of bytes: A-Z only
            size += len(d) + 1
            if size >= split_bytes:
                done()
                held, size = [], 0
        if held:
            done()
        self.hash, self.size = np.concatenate(hashes), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def inside(self, n: int) -> np.ndarray:
        """Which places start n words of one text."""
        return np.repeat(self.start + self.size, self.size) - np.arange(len(self.hash)) >= n


def send_counts(chunk: int, keys: np.ndarray, counts: np.ndarray, n: int, all_buckets: bool = False) -> list[tuple[int, int, bytes]]:
    """Blobs of sorted distinct keys with counts, one for each bucket that gets a key, or for each bucket."""
    edges = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    return [(b, chunk, pack_arrays(*pack_sorted(keys[i:j]), counts[i:j])) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i or all_buckets]


def sum_counts(got: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the blobs of a bucket: where each blob's keys are in the sorted distinct keys, those keys, and their summed counts."""
    blobs = [unpack_arrays(p) for p in got["payload"]]
    keys = [unpack_sorted(b[0], b[1]) for b in blobs]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate([b[2] for b in blobs]), len(distinct)).astype(np.int64)
    return np.split(place, np.cumsum([len(k) for k in keys])[:-1]), distinct, total


def own_row(chunk: int, payload: bytes) -> tuple[int, int, bytes]:
    """A blob that a chunk sends to itself: its bucket is its own and hands it back."""
    return -1 - chunk, chunk, payload
