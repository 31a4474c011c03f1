"""Token ids in training order: a keyed permutation gives every sequence a global slot, shards hold the slots in order.

1. ``sequences``: texts become token ids of a public byte-level BPE (two bytes each), closed by the end-of-text id and
   cut into sequences of SEQ tokens. Before that the texts are dealt by ranges of a keyed hash of (doc_id, digest of the
   text), so a stored file holds a range of hashes, in order.
2. ``slots``: a sequence's place in the order of (hash, doc_id, digest, number in the document) is its index: what the files
   with lower hashes hold, plus its row in its file. So the index comes from the data alone, however the input is split.
   A keyed Feistel network over the next power of four, walked along its cycles until it falls below the number of
   sequences, turns the index into its slot. That is a bijection, so no slot is empty or taken twice.
3. ``write_shards``: rows are dealt to range partitions of a fixed number of slots, sorted, and each range is written as a
   file of fixed-stride records (16 bytes of header: document, number in the document, tokens, big-endian; then the ids,
   little-endian, filled up with the end id; then a line end), so slot s of a shard stands at s times the stride. Shards
   are written a share at a time, so that shuffle files take the room of a share only. A manifest (number and length of
   the sequences, slots in a shard, key, checksum of the index) is written first. A run on the same path leaves complete
   shards alone if its manifest is the same, and is refused if it is not.
4. ``shard_rows`` reads shards as rows, a task for some of them; ``read_shard`` seeks to any slot and reads on.

Defined results: a null or empty text is one sequence that holds the end id alone; repeated rows each keep their
sequences; a null doc_id is null in the rows and -2**63 in the files; texts of any length are taken whole; further columns
are ignored whatever their names; an empty table has no shard and no row. The order depends on the key and the documents,
and on nothing else; rows alike in id and text stand next to each other in the index, so they are one task's.
"""

from __future__ import annotations

import base64
import contextlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, shared_dir, sliced, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that byte-level BPE of this family splits texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID, SEQ, SLOTS_PER_SHARD, KEY, ROUNDS = 50256, 512, 16384, 20240607, 6
#: The files' first places are broadcast up to so many files (of some 100 bytes each).
BROADCAST_FILES = 50_000
HEADER = np.dtype([("doc_id", ">i8"), ("seq_no", ">i4"), ("n_tokens", ">i4")])
NO_ID = -(2**63)
#: Sequences that a task gathers before it sends them; shares in which shards are written.
TOGETHER, SHARES = 2048, 6


_encoders: dict[int, tiktoken.Encoding] = {}


def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    """The vocabulary's BPE, once per worker."""
    key = hash(vocabulary)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def sequences(docs: DataFrame, vocabulary_path: str = VOCABULARY, seq: int = SEQ, key: int = KEY) -> DataFrame:
    """doc_id, seq_no (from 0), n_tokens, tokens (little-endian pairs of bytes), h (the documents' hash), in order of h
    within a partition; partitions hold ranges of h."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        held: list[tuple] = []
        for batch in sliced(batches):
            for doc_id, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                ids = np.array([*(encode(text) if text else ()), END_ID], "<u2")
                held += [(doc_id, k, min(seq, len(ids) - a), ids[a : a + seq].tobytes(), h) for k, a in enumerate(range(0, len(ids), seq))]
                if len(held) > TOGETHER:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_d", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    rows = rows.withColumn("h", F.xxhash64(F.lit(key), "doc_id", "_d"))
    dealt = rows.repartitionByRange("h", "doc_id", "_d").sortWithinPartitions("h", "doc_id", "_d")
    return mapped(dealt.select("doc_id", "text", "h"), run, "doc_id long, seq_no int, n_tokens int, tokens binary, h long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "seq_no", "n_tokens", "tokens", "h"])


def permuted(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of indexes below n: a balanced Feistel network, walked along its cycles back into the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.Philox(key)).integers(0, 2**63, rounds, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def slots(table: DataFrame, key: int = KEY) -> DataFrame:
    """The stored sequences with their slot. The files' counts are summed up in the order of their hashes."""
    table = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = table.groupBy("_file").agg(F.count("*").alias("_n"), F.min("h").alias("_h"))
    first = counts.select("_file", (F.sum("_n").over(Window.orderBy("_h")) - F.col("_n")).alias("_first"))  # a row for each file
    n = table.count()

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), n, key))

    files = counts.count()
    rows = table.join(F.broadcast(first) if files <= BROADCAST_FILES else first, "_file")
    return rows.withColumn("slot", slot(F.col("_first") + F.col("_row"))).drop("_file", "_row", "_first", "h")


def manifest(table: DataFrame, seq: int, per_shard: int, key: int) -> dict:
    """What a run has to agree in with another to write to the same shards: the checksum goes over each document's hash
    (which is of its id and text), sequences and their lengths, whatever the order of the rows."""
    row = F.xxhash64("h", "doc_id", "seq_no", "n_tokens")
    found = table.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("index")).first()
    return {"n": found.n, "index": found["index"], "seq": seq, "per_shard": per_shard, "key": key}


def agreed(spark: SparkSession, path: str, own: dict) -> None:
    """Write the manifest of a new path; of one that is there already, refuse another."""
    text = json.dumps(own, sort_keys=True)
    where = f"{path}/_manifest"
    if _exists(spark, f"{where}/_SUCCESS"):
        there = spark.read.text(where).first()[0]
        if there != text:
            raise ValueError(f"{path} holds the shards of another run: {there}, not {text}")
    elif _exists(spark, path) and _shards(spark, path).take(1):
        raise ValueError(f"{path} holds shards without a manifest")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(where)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards' files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").contains("/shard="))


def training_order(docs: DataFrame, vocabulary_path: str = VOCABULARY, seq: int = SEQ, per_shard: int = SLOTS_PER_SHARD, key: int = KEY, path: str | None = None) -> DataFrame:
    """Writes the shards to path (where a run that broke off is taken up again), or else to a new folder shards-... in the
    shared folder, and returns their rows: slot, shard, offset (of the record in its shard), doc_id, seq_no, n_tokens,
    tokens, in order of slots within a shard."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        table = stored(sequences(docs, vocabulary_path, seq, key), "sequences")
    agreed(spark, path, manifest(table, seq, per_shard, key))
    rows = slots(table, key)
    write_shards(rows.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int")), path, seq)
    return shard_rows(spark, path, seq, per_shard)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes within it drop their shuffle files when they are done."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)


def stride(seq: int = SEQ) -> int:
    return HEADER.itemsize + 2 * seq + 1


def write_shards(rows: DataFrame, path: str, seq: int = SEQ) -> None:
    """Write the shards that are not complete yet, one file each under path/shard=N, through Spark's committer."""
    sizes = rows.groupBy("shard").agg((F.count("*") * stride(seq)).alias("bytes"))
    spark = rows.sparkSession
    if _exists(spark, path):
        there = _shards(spark, path).groupBy(F.regexp_extract("path", r"shard=(\d+)", 1).cast("int").alias("shard")).agg(F.sum("length").alias("bytes"))
        rows = rows.join(there.join(sizes, ["shard", "bytes"]).select("shard"), "shard", "left_anti")
    big = lambda c, digits: F.unhex(F.lpad(F.hex(c), digits, "0"))
    head = F.concat(big(F.coalesce("doc_id", F.lit(NO_ID)), 16), big("seq_no", 8), big("n_tokens", 8))
    filled = F.concat("tokens", F.unhex(F.repeat(F.lit(np.array([END_ID], "<u2").tobytes().hex()), (seq - F.col("n_tokens")).cast("int"))))
    out = rows.select("shard", "slot", F.concat(head, filled).cast("string").alias("record"))
    most = sizes.agg(F.max("shard")).first()[0] or 0
    with shuffles_removed(spark):  # a share's go when it is written
        for k in range(SHARES):
            share = ranged(out.where(F.col("shard") % SHARES == k), most).sortWithinPartitions("shard", "slot").select("shard", "record")
            share.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("shard").text(path)


def ranged(rows: DataFrame, most: int) -> DataFrame:
    """rows dealt by equal ranges of their shard, of which the last is known, so nothing has to be sampled."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, F.floor(F.col("shard").cast("double") * n / (most + 1)).cast("int"))


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def _record(seq: int) -> np.dtype:
    return np.dtype([("head", HEADER), ("ids", "<u2", (seq,)), ("end", "u1")])


ROWS = "slot long, shard int, offset long, doc_id long, seq_no int, n_tokens int, tokens binary"


def shard_rows(spark: SparkSession, path: str, seq: int = SEQ, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The shards' records as rows; a task holds a few whole shards, so their size bounds its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, shard in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                records = np.frombuffer(content.as_buffer(), _record(seq))
                for a in range(0, len(records), TOGETHER):
                    part = records[a : a + TOGETHER]
                    places, n = np.arange(a, a + len(part)), part["head"]["n_tokens"].astype(np.int32)
                    ids = part["head"]["doc_id"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(places + shard * per_shard), pa.array(np.full(len(part), shard, np.int32)), pa.array(places * stride(seq)), pa.array(ids, mask=ids == NO_ID),
                        pa.array(part["head"]["seq_no"].astype(np.int32)), pa.array(n), pa.array([x[:k].tobytes() for x, k in zip(part["ids"], n, strict=True)], pa.binary()),
                    ], ["slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", "tokens"])

    if not _exists(spark, path) or not (files := _shards(spark, path)).take(1):
        return spark.createDataFrame([], ROWS)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("int")
    return mapped(files.select("content", shard.alias("shard")), run, ROWS)


def read_shard(spark: SparkSession, path: str, shard: int, first: int = 0, seq: int = SEQ, together: int = 256) -> Iterator[tuple[int, int, np.ndarray]]:
    """doc_id, seq_no, ids of a shard's records from its record ``first`` on: a seek, then some records at a time."""
    jvm, kind = spark._jvm, _record(seq)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    (file,) = [f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    stream = fs.open(file.getPath())
    try:
        stream.seek(first * kind.itemsize)
        while content := bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(together * kind.itemsize, file.getLen() - stream.getPos()))):
            for r in np.frombuffer(content, kind):
                yield int(r["head"]["doc_id"]), int(r["head"]["seq_no"]), r["ids"][: r["head"]["n_tokens"]]
    finally:
        stream.close()
