"""Token ids in length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard is ``SWR1`` + id width (u32), then for each document: length (u64), masked CRC of the length (u32), ids
(little-endian u16 or u32), masked CRC of the ids (u32). ``<shard>.idx`` has a row of four u64 for each document:
has-id flag, doc_id, offset of the record, number of ids. The mask is a rotation plus a constant, so that checksums
of data that holds checksums stay sound. CRC-32 is zlib's.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterwave.llm.common import whole_text
from scatterwave.runtime import scratch_path, ship

MAGIC = b"SWR1"
#: Fixed value of the checksum mask.
MASK_DELTA = 0xA282EAD8
END_ID = 1
#: Distinct pieces in a generation of those that a worker remembers.
CACHE_PIECES = 300_000
#: Characters that are encoded at a time, unless one text has more.
CHUNK_CHARS = 8_000_000
#: Bytes of input that a shard aims at, and records that are read back at a time.
SHARD_BYTES, READ_ROWS = 2**27, 10_000
#: New pieces that are encoded as one text, and the word that parts them.
GROUP, MARK = 500, "~"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


#: The text rules of tokenizers that may be fed piece by piece.
PIECEWISE_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECEWISE_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def piecewise(tokenizer) -> bool:
    """Whether a tokenizer's ids of a text are those of its pieces: its rules are the ones that ``Encoder`` is proven for."""
    rules = json.loads(tokenizer.to_str())
    normal, pre, model = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}, rules["model"]
    steps = pre.get("pretokenizers") or [{}]
    return (
        normal.get("normalizers") == PIECEWISE_NORMALIZERS
        and steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": PIECEWISE_PATTERN} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in rules["added_tokens"])
        and model["type"] == "BPE" and not model.get("dropout") and rules["truncation"] is None and rules["padding"] is None
    )


_STOP = re.compile("(?<=[a-zß-öø-ÿ])([.,]) ")


class Encoder:
    """Ids of whole texts as packed bytes.

    The tokenizer's pattern never matches across a space or line feed, nor across the end of a run of letters, and
    neither its normaliser nor its special strings reach across a space; so a text's ids are those of its pieces, one
    after the other. Its normaliser lower-cases: in Latin-1 texts, where no composition takes place, that is done
    first, so that more pieces are alike. Each distinct piece is encoded by the library and remembered; the pieces
    are held in two generations, of which the older is forgotten. A tokenizer with other rules gets whole texts.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.piecewise = piecewise(self.tokenizer)
        ids = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else -1
        self.young, self.old = {}, {}

    def prepared(self, text: str) -> str:
        """The text with a space wherever it may be cut."""
        if "<|" not in text:  # special strings are found before anything is lower-cased
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return _STOP.sub(r" \1 ", text.replace("\n", " "))

    def encode_new(self, pieces: list[str]) -> list[bytes]:
        """By the library, GROUP pieces at a time with a mark between; a group in which marks don't add up goes piece by piece."""
        width, out = np.dtype(self.dtype).itemsize, []
        groups = [pieces[i : i + GROUP] for i in range(0, len(pieces), GROUP)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([f" {MARK} ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(group) - 1 and not any(MARK in p for p in group):
                raw, bounds = ids.tobytes(), (cuts * width).tolist()
                out += [raw[a:b] for a, b in zip([0, *[c + width for c in bounds]], [*bounds, len(raw)])]
            else:
                out += [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
        return out

    def known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those not remembered are encoded together."""
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young
        young, new = self.young, []
        for piece in pieces:
            if piece not in young:
                if (ids := self.old.get(piece)) is None:
                    new.append(piece)
                else:
                    young[piece] = ids
        young.update(zip(new, self.encode_new(new)))
        return [young[piece] for piece in pieces]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Pieces are cut, told apart and replaced by their ids as whole arrays; Python sees distinct pieces only."""
        if not self.piecewise:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lists = pc.split_pattern(pa.array([self.prepared(t) for t in texts], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        at, ids = coded.indices.to_numpy(), self.known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        starts, own = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        flat = np.frombuffer(b"".join(ids), self.dtype)
        out = flat[np.repeat(starts[at] - ends[:-1], own) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy()]
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, first, held = [], 0, 0
        for i, text in enumerate(texts):
            if i > first and held + len(text) > CHUNK_CHARS:
                out += self._encode(texts[first:i])
                first, held = i, 0
            held += len(text)
        return out + self._encode(texts[first:]) if texts else out


@lru_cache(maxsize=1)
def encoder(path: str, dtype: str) -> Encoder:
    """A worker process keeps its encoder, and what it remembers, from task to task."""
    return Encoder(path, dtype)


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def vocabulary_dtype(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 2**16 else "<u4"


def shard_count(docs: DataFrame) -> int:
    """Shards of about ``SHARD_BYTES`` of text by the size that Spark knows of the input, and no fewer than its shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 2**60:  # not known: measured
        size = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def write_records(docs: DataFrame, tokenizer: str, out: str, partitions: int | None = None) -> pd.DataFrame:
    """Writes shards in ascending order of doc_id under ``out`` and gives their manifest.

    Rows go to shards by range, so shard order is id order; ids that are null come first and equal ids go by text.
    Null texts are empty: their record holds the end id alone. A task writes under a name of its own and renames
    when complete, so a retried or doubled task leaves one whole shard. The manifest has one row per shard.
    """
    spark = docs.sparkSession
    ship(spark)
    dtype = vocabulary_dtype(tokenizer)
    n = partitions or shard_count(docs)
    filesystem, root = _filesystem(out)
    filesystem.create_dir(root, recursive=True)

    def run(batches):
        filesystem, root = _filesystem(out)
        encode, end = encoder(tokenizer, dtype), np.array([END_ID], dtype).tobytes()
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        name, count, at, tokens = f"{root}/shard-{part:06d}", 0, 8, 0
        width = np.dtype(dtype).itemsize
        with filesystem.open_output_stream(f"{name}.{attempt}") as f, filesystem.open_output_stream(f"{name}.idx.{attempt}") as offsets:
            f.write(MAGIC + struct.pack("<I", width))
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                frames, index = [], []
                for doc_id, body in zip(ids, encode(texts)):
                    body += end
                    head = struct.pack("<Q", len(body))
                    frames += [head, struct.pack("<I", masked(head)), body, struct.pack("<I", masked(body))]
                    index.append((doc_id is not None, (doc_id or 0) % 2**64, at, len(body) // width))
                    at += 16 + len(body)
                    tokens += len(body) // width
                f.write(b"".join(frames))
                offsets.write(np.array(index, "<u8").tobytes())
                count += len(index)
        if not count:
            filesystem.delete_file(f"{name}.{attempt}")
            filesystem.delete_file(f"{name}.idx.{attempt}")
            return
        filesystem.move(f"{name}.idx.{attempt}", f"{name}.idx")
        filesystem.move(f"{name}.{attempt}", f"{name}.bin")
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "docs": [count], "tokens": [tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))  # parts rows that share an id
    ordered = hashed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    manifest = ordered.mapInArrow(run, "part long, path string, docs long, tokens long").toPandas()
    manifest = manifest.sort_values("part", ignore_index=True)
    manifest["start"] = manifest["tokens"].cumsum() - manifest["tokens"]
    return manifest


def read_index(path: str) -> np.ndarray:
    filesystem, root = _filesystem(path)
    with filesystem.open_input_stream(f"{root}.idx") as f:
        return np.frombuffer(f.read(), "<u8").reshape(-1, 4)


def read_record(handle, offset: int, width: int) -> np.ndarray:
    """One document's ids at an offset of the index; a damaged frame raises."""
    handle.seek(offset)
    head = handle.read(12)
    (size,), (check,) = struct.unpack("<Q", head[:8]), struct.unpack("<I", head[8:])
    if masked(head[:8]) != check:
        raise ValueError(f"damaged length at {offset}")
    body = handle.read(size)
    if len(body) != size or masked(body) != struct.unpack("<I", handle.read(4))[0]:
        raise ValueError(f"damaged record at {offset}")
    return np.frombuffer(body, f"<u{width}")


def read_records(path: str, order=None):
    """Yields ``(doc_id or None, ids)`` of a shard, in file order or in any order of index rows."""
    filesystem, root = _filesystem(path)
    index = read_index(path)
    with filesystem.open_input_file(f"{root}.bin") as f:
        if f.read(4) != MAGIC:
            raise ValueError(f"not a record file: {path}")
        (width,) = struct.unpack("<I", f.read(4))
        for i in range(len(index)) if order is None else order:
            known, doc_id, offset, _ = (int(v) for v in index[i])
            yield (doc_id - 2**64 if doc_id >= 2**63 else doc_id) if known else None, read_record(f, offset, width)


def digest_records(spark: SparkSession, manifest: pd.DataFrame) -> DataFrame:
    """From the files alone: ``doc_id, start, n_tokens, ids_crc32`` (of the ids as little-endian u32)."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if manifest.empty:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                records, at = read_records(path), start
                while own := list(islice(records, READ_ROWS)):
                    rows = []
                    for doc_id, ids in own:
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(manifest[["path", "start"]], "path string, start long")
    return shards.repartition(len(manifest)).mapInArrow(run, schema)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write every document and describe what the files hold, one row per row of ``docs``.

    Null texts are empty: their record holds the end id alone. Ids that are null come first; rows that repeat an id
    follow each other. An empty table gives no rows. Only doc_id and text are read, so other columns may have any names.
    """
    spark = docs.sparkSession
    return digest_records(spark, write_records(docs, tokenizer, scratch_path(spark, "records")))
