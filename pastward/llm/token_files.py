"""Token ids on disk: one shared zstandard dictionary, every document a frame of its own.

A file holds the documents of one stretch of the ``id`` order. It is one row of a Parquet table, so that Spark
writes and reads it on any store and a failed task leaves no half file behind:

    magic (6 bytes), id width (2), documents (4), SHA-256 of the dictionary (32),
    ids of the documents (8 each), 1 where such an id is null (1 each),
    token offsets (8 each, one more than documents), byte offsets of the frames (likewise), frames

All numbers are little-endian. Offsets count from the file's first document; the row tells how many ids of the same
partition come before, and ``table_bases`` how many come before the partition. The dictionary is trained on a sample of
at most ``SAMPLE`` documents of at most ``SAMPLE_CHARS`` characters; it changes sizes, never contents.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastward.llm.shared import out_batch, rows_of
from pastward.llm.token_ids import END_ID, encoder

MAGIC = b"PWIDS1"
SAMPLE = 1_000
SAMPLE_CHARS = 16_384
DICTIONARY_BYTES = 65_536
FILE_BYTES = 4 << 20
FILE_DOCUMENTS = 4_096
_HEAD = struct.Struct("<6sHI32s")
_FILES = "part int, file_no int, first_id long, last_id long, documents int, tokens_before long, tokens long, dictionary_hash string, file binary"


def _narrow(packed: bytes, width: int) -> bytes:
    import numpy as np

    return np.frombuffer(packed, "<u4").astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, width: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The dictionary, trained on the driver on the sample named above; empty without any text."""
    import zstandard

    short = docs.filter(F.length(text_col).between(1, SAMPLE_CHARS))
    ids = short.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    sample = short.join(F.broadcast(ids), id_col).orderBy(F.xxhash64(id_col), id_col, text_col).limit(SAMPLE)
    arrays = [_narrow(encoder(vocabulary).packed(row[0]), width) for row in sample.select(text_col).collect()]
    arrays = [a for a in arrays if a]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: use them as they are
        return b"".join(arrays)[:DICTIONARY_BYTES]


def _compressor(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared)


def _decompressor(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=shared)


def pack_file(ids: list[int | None], counts: list[int], frames: list[bytes], width: int, dictionary: bytes) -> bytes:
    """Bytes of one file."""
    import numpy as np

    starts = np.concatenate([[0], np.cumsum(counts, dtype="<u8")]).astype("<u8")
    places = np.concatenate([[0], np.cumsum([len(f) for f in frames], dtype="<u8")]).astype("<u8")
    return b"".join([
        _HEAD.pack(MAGIC, width, len(ids), hashlib.sha256(dictionary).digest()),
        np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids), starts.tobytes(), places.tobytes(), *frames,
    ])


class TokenFile:
    """Reads one file; ``document`` decodes a single frame."""

    def __init__(self, data: bytes, dictionary: bytes):
        import numpy as np

        magic, self.width, count, digest = _HEAD.unpack_from(data)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file of this dictionary")
        at = _HEAD.size
        values = np.frombuffer(data, "<i8", count, at)
        at += 8 * count
        self.ids = [None if null else int(v) for v, null in zip(values, data[at:at + count])]
        at += count
        self.starts = np.frombuffer(data, "<u8", count + 1, at)
        self.places = np.frombuffer(data, "<u8", count + 1, at + 8 * (count + 1))
        self.data, self.body, self.frames = data, at + 16 * (count + 1), _decompressor(dictionary)

    def document(self, number: int):
        """Ids of a document as 32-bit numbers."""
        import numpy as np

        start, end = self.body + int(self.places[number]), self.body + int(self.places[number + 1])
        return np.frombuffer(self.frames.decompress(self.data[start:end]), f"<u{self.width}").astype("<u4")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), append the end id to each and write the files in ascending ``id_col`` order.

    Null ids come first; rows with equal ids lie side by side, ordered by text. Extra columns are ignored. A table
    without rows gives a folder without files. One range exchange of the texts; nothing else is shuffled.
    """
    spark = docs.sparkSession
    width = 2 if encoder(vocabulary).size <= 65_536 else 4
    dictionary = train_dictionary(docs, vocabulary, width, id_col, text_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches):
        from pyspark import TaskContext

        known, compress = encoder(vocabulary), _compressor(dictionary).compress
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, size = [], [], [], 0
        end = struct.pack("<I", END_ID)

        def file():
            nonlocal ids, counts, frames, size, number, before
            row = [part, number, ids[0], ids[-1], len(ids), before, sum(counts), digest, pack_file(ids, counts, frames, width, dictionary)]
            number, before = number + 1, before + sum(counts)
            ids, counts, frames, size = [], [], [], 0
            return _file_batch(row)

        for doc_id, text in rows_of(batches):
            packed = known.packed(text) + end
            frame = compress(_narrow(packed, width))
            ids.append(doc_id)
            counts.append(len(packed) // 4)
            frames.append(frame)
            size += len(frame)
            if size >= FILE_BYTES or len(ids) >= FILE_DOCUMENTS:
                yield file()
        if ids:
            yield file()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    rows.mapInArrow(encode, _FILES).write.option("compression", "none").parquet(f"{path}/files")


def _file_batch(row: list):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _FILES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The files, and the dictionary (at most ``DICTIONARY_BYTES``)."""
    files = spark.read.schema(_FILES).parquet(f"{path}/files")
    return files, bytes(spark.read.parquet(f"{path}/dictionary").head()["dictionary"])


def table_bases(files: DataFrame) -> DataFrame:
    """Ids before each partition of the writer: one row per partition."""
    totals = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    import pyarrow as pa

    files, dictionary = _opened(spark, path)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for base, before, data in rows_of(batches, 1):
            file = TokenFile(data, dictionary)
            crcs = [zlib.crc32(file.document(k).tobytes()) for k in range(len(file.ids))]
            starts = file.starts.astype("int64")
            yield out_batch(schema, [file.ids, starts[:-1] + (base + before), starts[1:] - starts[:-1], crcs])

    # One row per partition of the writer, so the broadcast side is bounded by their number.
    rows = files.join(F.broadcast(table_bases(files)), "part").select("base", "tokens_before", "file")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """Ids of one document: finds its file by the bounds in the table, decodes one frame."""
    files, dictionary = _opened(spark, path)
    # Null ids stand first, so a file that begins with one may hold any id up to its last.
    within = F.coalesce(F.col("first_id") <= doc_id, F.lit(True)) & (F.col("last_id") >= doc_id)
    for row in files.filter(within).select("file").toLocalIterator():
        file = TokenFile(bytes(row[0]), dictionary)
        if doc_id in file.ids:
            return file.document(file.ids.index(doc_id)).tolist()
    return None
