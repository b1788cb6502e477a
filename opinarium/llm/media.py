"""Media columns: payloads in content-defined chunks, stored once, read back verified.

A text's UTF-8 bytes, padded, become 8-bit samples of a WAV file. A rolling
gear hash cuts the file into chunks; digests find by Spark joins which medium
owns each distinct chunk. The store has a row for each medium that owns any,
with the chunks it owns; ordered chunk lists (the manifest) name the chunks
of every medium. A medium that owns all its chunks is read from its row;
the others get theirs by a join on digests. Each is verified against its
SHA-256 before features are computed.

Bytes are shuffled compressed: once to bring the copies of a text together,
and again only the chunks of media that share some. The store's own
compression (zstd pages) spans chunks.

Null texts count as empty (64 zero samples); equal texts share one medium;
repeated rows get equal results; an empty table gives an empty table; columns
of df other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import add_columns, importable, mix, slices, text_column, written

UNIT = 64
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 2048, 13, 32768
#: 8 kHz, one channel, 8 bits: the header of a WAV file.
RATE = 8000

GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wav(samples: bytes) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def samples_of(medium: bytes) -> bytes:
    riff, size, wave, _, _, form, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", medium)
    if (riff, wave, data, form, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8) or n != len(medium) - 44 or size != n + 36:
        raise ValueError("not a WAV file of 8-bit samples")
    return medium[44:]


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks: where the gear hash of the last 32 bytes has MASK_BITS zeros, within the size limits."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # h[i]: the sum of GEAR[data[i - j]] << j for j under 2 * step
        h[step:] += h[:-step].copy() << np.uint32(step)
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, start = [], 0
    while n - start > MIN_CHUNK:
        i = np.searchsorted(marks, start + MIN_CHUNK)
        end = min(int(marks[i]) if i < len(marks) else n, start + MAX_CHUNK, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def features(samples: bytes) -> str:
    """Mean, root mean square about the middle, and crossings of the middle, of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


MANIFEST = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("media_sha256", T.BinaryType()), T.StructField("digests", T.ArrayType(T.BinaryType()))])
CHUNK = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("shared", T.BooleanType()), T.StructField("data", T.BinaryType())])
READ = T.StructType(
    [
        T.StructField("key", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.BinaryType()), T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.BinaryType()), T.StructField("feature", T.StringType()),
    ]
)


def _manifest(texts: list[str]) -> list[list]:
    rows = []
    for text in texts:
        medium = wav(payload_of(text))
        raw = text.encode("utf-8", "surrogatepass")
        rows.append((digest16(raw), len(raw), hashlib.sha256(medium).digest(), [digest16(c) for c in chunks(medium)]))
    return [list(x) for x in zip(*rows)] if rows else [[], [], [], []]


def _packed(texts: list[str]) -> list[list]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=12).compress
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    return [[digest16(r) for r in raws], [pack(r) for r in raws]]


def _owned(packed: list[bytes], owned: list[list[dict]]) -> list[list]:
    """Of each packed text: its medium's digest and number of chunks, and the owned chunks."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out = []
    for z, mine in zip(packed, owned):
        shared = {x["ordinal"]: x["shared"] for x in mine}
        text = unpack(z).decode("utf-8", "surrogatepass")
        medium = wav(payload_of(text))
        parts = chunks(medium)
        out.append((hashlib.sha256(medium).digest(), len(parts), [{"ordinal": i, "digest": digest16(parts[i]), "shared": shared[i], "data": parts[i]} for i in sorted(shared)]))
    return [list(x) for x in zip(*out)] if out else [[], [], []]


def _read_back(df: DataFrame) -> DataFrame:
    """READ for rows key, media_sha256, n_chunks, chunks (ordinal, data)."""
    importable(df.sparkSession)
    types = to_arrow_schema(READ)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(start, 256).to_pylist():
                    parts = sorted((c["ordinal"], c["data"]) for c in row["chunks"])
                    if [p[0] for p in parts] != list(range(row["n_chunks"])):
                        raise ValueError(f"chunks of {row['media_sha256'].hex()} are missing")
                    medium = b"".join(p[1] for p in parts)
                    if (sha := hashlib.sha256(medium).digest()) != row["media_sha256"]:
                        raise ValueError(f"the chunks of {row['media_sha256'].hex()} make {sha.hex()}")
                    samples = samples_of(medium)
                    rows.append((row["key"], len(samples), hashlib.sha256(samples).digest(), zlib.crc32(samples[-UNIT:]), len(medium), sha, features(samples)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), types)], schema=types)

    return df.mapInArrow(run, READ)


class MediaStore:
    """The tables that hold the media of df's texts: documents, media (the manifest) and chunks."""

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        docs = df.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))
        listed = written(add_columns(docs, MANIFEST, _manifest, ["text"], sliced="text").drop("text"), "manifest")
        self.documents = listed.select("doc_id", "key", "n_bytes")
        self.media = written(listed.groupBy("key").agg(F.first("media_sha256").alias("media_sha256"), F.first("digests").alias("digests")), "media")
        uses = self.media.select("key", F.posexplode("digests").alias("ordinal", "digest"))
        owners = uses.groupBy("digest").agg(F.min(F.struct("key", "ordinal")).alias("owner"), F.count("*").alias("uses"))
        self.owners = written(owners.select("digest", F.col("owner.key").alias("key"), F.col("owner.ordinal").alias("ordinal"), "uses"), "owners")
        owned = self.owners.groupBy("key").agg(F.collect_list(F.struct("ordinal", (F.col("uses") > 1).alias("shared"))).alias("owned"))
        made = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("packed", T.BinaryType())])
        texts = add_columns(docs.select("text"), made, _packed, ["text"], sliced="text").select("key", "packed").groupBy("key").agg(F.first("packed").alias("packed"))
        row = T.StructType([T.StructField("media_sha256", T.BinaryType()), T.StructField("n_chunks", T.IntegerType()), T.StructField("chunks", T.ArrayType(CHUNK))])
        stored = add_columns(texts.join(owned, "key"), row, _owned, ["packed", "owned"], sliced="packed")
        self.chunks = written(stored.select("key", *row.names), "chunks", 9)

    def read(self) -> DataFrame:
        """READ for each medium, from the stored chunks."""
        whole = self.chunks.where(F.size("chunks") == F.col("n_chunks"))
        # The rest have their own chunks and, by digest, those that other media (or other places in them) own.
        own = self.chunks.where(F.size("chunks") < F.col("n_chunks")).select("key", F.explode("chunks").alias("c")).select("key", "c.ordinal", "c.data")
        uses = self.media.select(F.col("key").alias("user"), F.posexplode("digests").alias("place", "digest"))
        lent = uses.join(self.owners.where("uses > 1"), "digest").where("user <> key or place <> ordinal").select("digest", F.col("user").alias("key"), F.col("place").alias("ordinal"))
        offered = self.chunks.select(F.explode(F.filter("chunks", lambda c: c["shared"])).alias("c")).select("c.digest", "c.data")
        parts = own.union(written(lent, "lent").join(offered, "digest").select("key", "ordinal", "data"))
        parts = parts.groupBy("key").agg(F.collect_list(F.struct("ordinal", "data")).alias("chunks"))
        parts = parts.join(self.media, "key").select("key", "media_sha256", F.size("digests").alias("n_chunks"), "chunks")
        return _read_back(whole.select("key", "media_sha256", "n_chunks", F.transform("chunks", lambda c: F.struct(c["ordinal"].alias("ordinal"), c["data"].alias("data"))).alias("chunks"))).union(_read_back(parts))

    def verified(self) -> DataFrame:
        """doc_id, n_bytes and the fields of READ for each document."""
        hexed = lambda c: F.lower(F.hex(c)).alias(c)
        fields = [hexed(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in READ.fields[1:]]
        return self.documents.join(self.read(), "key").select("doc_id", "n_bytes", *fields)
