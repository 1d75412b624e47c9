"""Packed text blocks and a bulk key exchange between them.

Several operators must ask one question of the whole corpus for very many small
keys ("does this hash occur elsewhere, and where first?").  One Spark row per
key would cost far more than the key itself, so documents are packed into
blocks of a few MB, every block sends the sorted distinct keys it holds as one
binary value per key shard, each shard merges what all blocks sent, and the
answer travels back as a binary value aligned with what was asked.  A key that
fills a third of the corpus is one entry per block: hot keys need no salting.

Blocks are written once to the shared folder, so every later pass (and every
retried task) sees the same block ids and the same row order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddyframe.session import checkpoint_dir

BLOCK_BYTES = 2 << 20       # text bytes per block; a longer document is a block of its own
SHARD_KEYS = 1 << 18        # keys a shard is sized for
BATCH_ROWS = 256            # Arrow rows per batch: bounds a worker's memory when texts are long

BLOCK_SCHEMA = "block long, n_docs long, n_bytes long, ids binary, lens binary, data binary, rest binary"
ASK_SCHEMA = "shard int, block long, payload binary"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small: whole texts travel in them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_kept: dict[str, object] = {}   # of this Python worker


def keep(name: str, make: Callable[[], object]) -> object:
    """What the tasks of one operator leave for its next ones in a Python worker (Spark uses it again for any task)."""
    if name not in _kept:
        let_go()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Another operator's task begins: what was kept in this Python worker goes, and Arrow gives back what it holds
    for further batches; else the worker's memory is the sum of what every operator needs."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


def unsqueeze(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _to_bytes(batches: list[pa.RecordBatch]) -> bytes | None:
    if not batches[0].num_columns:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return squeeze(sink.getvalue().to_pybytes())


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    let_go()
    task = TaskContext.get()
    nxt = (task.partitionId() if task else 0) << 32
    pend: list[tuple[np.ndarray, np.ndarray, bytes, pa.RecordBatch]] = []
    size = 0

    def flush():
        nonlocal nxt, pend, size
        ids = np.concatenate([p[0] for p in pend])
        lens = np.concatenate([p[1] for p in pend])
        row = [nxt, len(ids), int(lens.sum()), ids.tobytes(), squeeze(lens.tobytes()),
               squeeze(b"".join(p[2] for p in pend)), _to_bytes([p[3] for p in pend])]
        nxt, pend, size = nxt + 1, [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, [pa.int64()] * 3 + [pa.binary()] * 4)],
            names=["block", "n_docs", "n_bytes", "ids", "lens", "data", "rest"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        text = batch.column(1).fill_null("").cast(pa.large_string())
        offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = memoryview(text.buffers()[2] or b"")
        rest = batch.select(batch.schema.names[2:])
        start = 0
        for i in range(len(ids)):  # cut where the block is full
            room = offs[i + 1] - offs[start] + size
            if room > block_bytes and (i > start or pend):
                if i > start:
                    pend.append((ids[start:i], np.diff(offs[start:i + 1]), bytes(data[offs[start]:offs[i]]),
                                 rest.slice(start, i - start)))
                yield flush()
                start = i
        pend.append((ids[start:], np.diff(offs[start:]), bytes(data[offs[start]:offs[-1]]), rest.slice(start)))
        size = sum(len(p[2]) for p in pend)
    if pend:
        yield flush()


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int | None = None,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents as blocks of whole UTF-8 texts (null: empty), written to the shared folder; the columns
    named in ``carry`` travel along row by row."""
    small_batches(docs.sparkSession)
    block_bytes = block_bytes or BLOCK_BYTES
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                       *[F.col(f"`{c}`").alias(f"carry{i}") for i, c in enumerate(carry)])
    return _bucketed(slim.mapInArrow(lambda it: _blocks(it, block_bytes), BLOCK_SCHEMA))


def _bucketed(blocks: DataFrame) -> DataFrame:
    """Written to the shared folder in buckets by block, so that answers come to the blocks and the texts,
    however often they are read, are never shuffled."""
    spark = blocks.sparkSession
    name = f"llm_blocks_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 100_000)
    (blocks.write.bucketBy(buckets, "block").option("path", shared_path(spark, "blocks")).format("parquet")
     .saveAsTable(name))
    df = spark.table(name)
    spark.sql(f"DROP TABLE {name}")     # an external table: its files and the resolved plan stay
    return df


class Block:
    """One unpacked block: ``ids``, ``offs`` (n + 1 byte offsets) and the joined UTF-8 ``data``."""

    def __init__(self, row):
        self.id = int(row.block)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.offs = np.concatenate([[0], np.cumsum(np.frombuffer(unsqueeze(row.lens), np.int64))]).astype(np.int64)
        self.data = unsqueeze(row.data) if row.data else b""
        self._rest = getattr(row, "rest", None)

    def texts(self) -> Iterator[bytes]:
        o = self.offs.tolist()
        return (self.data[a:b] for a, b in zip(o, o[1:]))

    def rest(self) -> pa.Table:
        """The carried columns, a row per document."""
        return pa.ipc.open_stream(unsqueeze(self._rest)).read_all()


def shard_count(blocks: DataFrame, bytes_per_key: float) -> int:
    """Shards in proportion to the corpus (one small job over the size column)."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(least, 1 + int(total // (64 << 10))), int(total / bytes_per_key / SHARD_KEYS) + 1)


def by_shard(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Bounds of each shard's slice in sorted uint64 ``keys`` (shards split the key range evenly)."""
    edges = np.array([(s << 64) // shards for s in range(1, shards)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def ask_rows(out: list, block: int, keys: np.ndarray, shards: int, payload: Callable[[int, int], bytes]) -> None:
    """Append one (shard, block, payload) row per shard that gets any of the sorted ``keys``."""
    b = by_shard(keys, shards)
    for s in np.flatnonzero(np.diff(b)).tolist():
        out.append((s, block, payload(int(b[s]), int(b[s + 1]))))


def asks(blocks: DataFrame, ask: Callable[[Block], list[tuple[int, int, bytes]]]) -> DataFrame:
    """What every block asks: ``ask(Block)`` gives (shard, block, payload) rows."""
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame(ask(Block(row)), columns=["shard", "block", "payload"])
    small_batches(blocks.sparkSession)
    return blocks.drop("rest").mapInPandas(run, ASK_SCHEMA)


def answer(asked: DataFrame, merge: Callable[[list[bytes], list[int]], list[bytes]]) -> DataFrame:
    """Each shard's answers: ``merge(payloads, blocks)`` gives one binary per payload, in order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable").reset_index(drop=True)
        back = merge(pdf.payload.tolist(), pdf.block.tolist())
        return pd.DataFrame({"shard": pdf.shard, "block": pdf.block, "payload": back})
    return asked.groupBy("shard").applyInPandas(run, ASK_SCHEMA)


def settle(blocks: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Bring answers back to their blocks: ``finish(Block, answer rows in shard order) -> pandas``."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [finish(Block(row), right.sort_values([c for c in ("kind", "shard") if c in right], kind="stable"))
               for row in left.itertuples(index=False)]
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
    small_batches(blocks.sparkSession)
    return blocks.drop("rest").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


# --- "who holds the first copy?" over 128-bit digests ------------------------------------------------

def first_copy_payload(hi: np.ndarray, lo: np.ndarray, doc: np.ndarray) -> Callable[[int, int], bytes]:
    """Payload of (digest, smallest document holding it) entries sorted by ``hi``."""
    return lambda a, b: (np.int64(b - a).tobytes() + hi[a:b].tobytes() + lo[a:b].tobytes()
                         + squeeze(doc[a:b].tobytes()))


def first_copy_merge(payloads: list[bytes], blocks: list[int]) -> list[bytes]:
    """One byte per entry: 1 where this block holds the copy with the smallest document id
    (between blocks with that same id: the smallest block), else 0."""
    n = [int(np.frombuffer(p[:8], np.int64)[0]) for p in payloads]
    hi = np.concatenate([np.frombuffer(p, np.uint64, k, 8) for p, k in zip(payloads, n)])
    lo = np.concatenate([np.frombuffer(p, np.uint64, k, 8 + 8 * k) for p, k in zip(payloads, n)])
    doc = np.concatenate([np.frombuffer(unsqueeze(p[8 + 16 * k:]), np.int64) for p, k in zip(payloads, n)])
    src = np.repeat(np.arange(len(n)), n)  # payloads come in block order
    order = np.lexsort((src, doc, lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    first = np.zeros(len(order), np.uint8)
    first[order[new]] = 1
    cuts = np.cumsum(n)[:-1]
    return [squeeze(np.packbits(x).tobytes()) for x in np.split(first, cuts)]


def first_copy_bits(answers: pd.DataFrame, shards: int, keys: np.ndarray) -> np.ndarray:
    """The answers' bits, aligned with the sorted keys that were asked."""
    b = by_shard(keys, shards)
    out = np.zeros(len(keys), bool)
    for s, payload in zip(answers.shard, answers.payload):
        bits = np.unpackbits(np.frombuffer(unsqueeze(payload), np.uint8))
        out[b[s]:b[s + 1]] = bits[:b[s + 1] - b[s]].astype(bool)
    return out
