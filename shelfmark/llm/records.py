"""Token ids as length-delimited binary records, with an offset index for reads in any order.

Data file ``part-NNNNN.records``: per document the TFRecord framing
``u64 length, u32 masked crc32c(length), payload, u32 masked crc32c(payload)``, little-endian. The
payload is ``i64 doc_id, u32 1 if the id is known, u32 width, token ids``; ids take 2 bytes where
the vocabulary has at most 65,536 tokens, else 4.
Index file ``part-NNNNN.index``: 24 bytes per record: ``i64 doc_id, u64 offset, u32 payload bytes,
u32 flag``. ``read_record`` finds one record through it without reading the rest.
Manifest (Parquet): one row per block of consecutive records: file, block, offset, bytes, records,
tokens. Readers get blocks, so a large file is read by many tasks.

Documents are range-partitioned and sorted by id, so ascending file numbers hold ascending ids. A
task writes to a name of its own and renames the finished file: a repeated task writes the same
bytes again, and half-written files are never read. Files go through pyarrow's file systems to the
folder that all executors share.

Defined results: NULL text is empty text; a document always ends with the end id, so empty texts
have one token; NULL ids sort first; documents of one id are ordered by text; an empty table gives
no records; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark.llm.bpe import WORD_CACHE, Recent
from shelfmark.llm.common import limit_batches
from shelfmark.session import new_folder, stage

BLOCK_BYTES = 4 << 20
GATHER_BYTES = 16 << 20    # of texts that are encoded together
CHUNK = 64                 # bytes of a message that the checksum steps through at once
HEAD = "<qII"             # of a payload
INDEX_ENTRY = "<qQII"
_POLYNOMIAL = 0x82F63B78   # Castagnoli, reflected
_MASK_DELTA = 0xA282EAD8   # of the framing's masked checksums


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()


def _apply(operator: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit states, given as four tables of 256."""
    return (operator[0][x & 255] ^ operator[1][(x >> 8) & 255] ^ operator[2][(x >> 16) & 255]
            ^ operator[3][x >> 24])


def _zero_operators(count: int) -> list[np.ndarray]:
    """Maps of the state over 1, 2, 4, ... zero bytes."""
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([values << np.uint32(8 * k) for k in range(4)])
    out = [_TABLE[one & 255] ^ (one >> 8)]
    while len(out) < count:
        out.append(_apply(out[-1], out[-1]))
    return out


_ZEROS = _zero_operators(40)


def _skip(states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """States after as many zero bytes as ``sizes`` says."""
    states = states.copy()
    for bit in range(int(sizes.max(initial=0)).bit_length()):
        at = (sizes >> bit) & 1 == 1
        states[at] = _apply(_ZEROS[bit], states[at])
    return states


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of many messages at once.

    Messages are cut into chunks of CHUNK bytes, zeros in front of the first (they leave an empty
    state as it is). All chunks step through their bytes together; a chunk's state is then moved
    over the bytes behind it, and the states of a message add up by exclusive or.
    """
    if not messages:
        return np.empty(0, np.uint32)
    size = np.array([len(m) for m in messages], np.int64)
    chunks = np.maximum(1, -(-size // CHUNK))
    data = np.frombuffer(b"".join(p for m, n, c in zip(messages, size, chunks)
                                  for p in (bytes(int(c * CHUNK - n)), m)), np.uint8)
    columns = np.ascontiguousarray(data.reshape(-1, CHUNK).T)
    state = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        state = _TABLE[(state ^ column) & 255] ^ (state >> np.uint32(8))
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    behind = np.repeat(first + chunks, chunks) - 1 - np.arange(len(state))
    total = np.bitwise_xor.reduceat(_skip(state, behind * CHUNK), first)
    start = _skip(np.full(len(messages), 0xFFFFFFFF, np.uint32), size)
    return total ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Framed records."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    marks = zip(masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist())
    return [n + struct.pack("<I", a) + p + struct.pack("<I", b)
            for n, p, (a, b) in zip(lengths, payloads, marks)]


def parse(data: bytes) -> list[bytes]:
    """Payloads of consecutive records; raises ValueError when a checksum or length is wrong."""
    payloads, lengths, marks, at = [], [], [], 0
    while at < len(data):
        if at + 16 > len(data):
            raise ValueError("a record is cut off")
        size, head = struct.unpack_from("<QI", data, at)
        if at + 16 + size > len(data):
            raise ValueError("a record is cut off")
        lengths.append(data[at:at + 8])
        payloads.append(data[at + 12:at + 12 + size])
        marks.append((head, *struct.unpack_from("<I", data, at + 12 + size)))
        at += 16 + size
    marks = np.array(marks, np.uint32).reshape(-1, 2)
    if ((masked(crc32c(lengths)) != marks[:, 0]).any()
            or (masked(crc32c(payloads)) != marks[:, 1]).any()):
        raise ValueError("a checksum is wrong")
    return payloads


# A full stop or comma that stays with the symbol before it (İ ends in one once it is lower-cased).
_SYMBOL_BEFORE = re.compile(r"[.,][ \n](?<=[^\w\s]..)|[.,][ \n](?<=[_İ\x1c-\x1f]..)")


def prepared(text: str | None) -> str:
    """A text whose pieces between blanks are encoded each for itself, with the ids of the whole.

    ASCII text is lower-cased here already, unless it may hold a special token, and full stops and
    commas at word ends get a blank of their own, unless some symbol comes before one.
    """
    text = (text or "").replace("\n", " ")
    if text.isascii() and "<|" not in text:
        text = text.lower()
    if not _SYMBOL_BEFORE.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text


class LibraryEncoder:
    """Texts to id bytes with a tokenizer file of the ``tokenizers`` library.

    For a file that drops white space, ids of pieces between blanks follow each other, so pieces
    are encoded once and remembered. Words of letters alone are sent to the library many at a time
    as one text; its word-end tokens tell them apart again.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = 1 + max(self.tokenizer.get_vocab().values())
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for name, i in self.tokenizer.get_vocab().items():
            self.ends[i] = name.endswith("</w>")
        self.known = Recent(None, 2 * WORD_CACHE)  # pieces and words, filled by ``learn`` alone

    def packed(self, ids: list[int]) -> np.ndarray:
        return np.array(ids, self.kind)

    @staticmethod
    def _split(piece: str) -> tuple[str, str] | None:
        """Letters and closing punctuation, if the piece is no more than that."""
        word = piece.rstrip(".,;:!?")
        if word.isalpha() and word[-1] != "İ":  # that one ends in a mark once lower-cased
            return (word.lower() if word.isascii() else word), piece[len(word):]
        return None

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of new pieces; their new words are encoded together."""
        known, splits = self.known, [self._split(p) for p in missing]
        parts = {x for s in splits if s for x in s}
        out = {x: known[x] for x in parts if x in known}
        new = [x for x in parts if x not in out and x.isalpha()]
        for i in range(0, len(new), 2000):
            some = new[i:i + 2000]
            ids = self.packed(self.tokenizer.encode_batch_fast(
                [" ".join(some)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                data, cuts = ids.tobytes(), [0, *(ids.itemsize * ends).tolist()]
                out.update((w, data[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))
        whole = {p for p, s in zip(missing, splits) if s is None}
        other = [x for x in {*parts, *whole} if x not in out]
        out.update(zip(other, (self.packed(e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(
            other, add_special_tokens=False))))
        out.update((p, out[s[0]] + out[s[1]]) for p, s in zip(missing, splits) if s)
        for piece, found in out.items():
            known.keep(piece, found)
        return out

    def _distinct(self, pieces: list[str]) -> list[bytes]:
        found = [self.known.get(p) for p in pieces]
        new = self.learn([p for p, f in zip(pieces, found) if f is None])
        return [new[p] if f is None else f for p, f in zip(pieces, found)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Id bytes of each text: pieces are told apart by the column library, looked up once per
        batch, and their ids laid out again by place."""
        lists = pc.split_pattern(pa.array([prepared(t) for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        found = self._distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        ids = pa.LargeListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)])),
            pa.array(np.frombuffer(b"".join(found), self.kind)))
        laid = ids.take(coded.indices).flatten().to_numpy(zero_copy_only=False).tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])])
        pieces = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        cuts = (upto[pieces] * self.kind.itemsize).tolist()
        return [laid[a:b] for a, b in zip(cuts, cuts[1:])]


_encoders: dict[str, LibraryEncoder] = {}  # of this worker process, kept from task to task


def encoder_of(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to GATHER_BYTES, so that fewer pieces are distinct."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


#: Record bytes that a task reads back.
TASK_BYTES = 8 * BLOCK_BYTES

_MANIFEST = "file string, block int, offset bigint, bytes bigint, records bigint, tokens bigint"


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write the records of ``docs`` (doc_id, text) below ``folder``; returns the manifest."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end, width = encoder.packed([end_id]).tobytes(), encoder.kind.itemsize
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}"
        draft = f"{root}/.{name}-{uuid.uuid4().hex}"
        rows, index, at = [], [], 0
        block = [0, 0, 0]  # offset, records, tokens
        with store.open_output_stream(f"{draft}.records") as out:
            for batch in gathered(batches):
                texts = encoder.batch(batch.column("text").to_pylist())
                ids = batch.column("doc_id").to_pylist()
                payloads = [struct.pack(HEAD, d or 0, d is not None, width) + t + end
                            for d, t in zip(ids, texts)]
                for d, payload, frame in zip(ids, payloads, frames(payloads)):
                    out.write(frame)
                    tokens = (len(payload) - 16) // width
                    index.append(struct.pack(INDEX_ENTRY, d or 0, at, len(payload),
                                             d is not None))
                    at, block[1], block[2] = at + len(frame), block[1] + 1, block[2] + tokens
                    if at - block[0] >= BLOCK_BYTES:
                        rows.append((f"{name}.records", len(rows), block[0], at - block[0],
                                     block[1], block[2]))
                        block = [at, 0, 0]
        if block[1]:
            rows.append((f"{name}.records", len(rows), block[0], at - block[0], block[1], block[2]))
        with store.open_output_stream(f"{draft}.index") as out:
            out.write(b"".join(index))
        for kind in ("index", "records"):
            store.move(f"{draft}.{kind}", f"{root}/{name}.{kind}")
        names = ["file", "block", "offset", "bytes", "records", "tokens"]
        frame = pd.DataFrame(rows, columns=names).astype({"file": str, "block": "int32"})
        frame = frame.astype({c: "int64" for c in names[2:]})
        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    ordered = (docs.select("doc_id", "text").repartitionByRange(*key[:2])
               .sortWithinPartitions(*key))
    return stage(ordered.mapInArrow(run, _MANIFEST), "manifest")


def token_ids(payload: bytes) -> np.ndarray:
    """The ids of a payload as 32-bit numbers."""
    width = struct.unpack_from(HEAD, payload)[2]
    return np.frombuffer(payload, f"<u{width}", offset=16).astype("<u4")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (u32 little-endian bytes), in tasks of one block each.

    ``start`` counts the tokens of all documents before: totals of files, then of blocks within a
    file, then within a block. Only the totals per file (one row per writing task) meet in a window
    without partitions.
    """
    files = manifest.groupBy("file").agg(F.sum("tokens").alias("all"))
    number = F.regexp_extract("file", r"(\d+)\.records$", 1).cast("bigint")  # names sort as text
    before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (manifest.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
              .join(files, "file")
              .select("file", "block", "offset", "bytes", "records", "tokens",
                      (F.col("base") + F.col("inner")).alias("start")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        for batch in batches:
            for b in batch.itertuples():
                with store.open_input_file(f"{root}/{b.file}") as f:
                    f.seek(b.offset)
                    payloads = parse(f.read(b.bytes))
                if len(payloads) != b.records:
                    raise ValueError(f"{b.file}: block {b.block} has {len(payloads)} records")
                heads = [struct.unpack_from(HEAD, p) for p in payloads]
                ids = [token_ids(p) for p in payloads]
                sizes = np.array([len(i) for i in ids], np.int64)
                yield pd.DataFrame({
                    "doc_id": pd.array([d if known else None for d, known, _ in heads], "Int64"),
                    "start": b.start + np.concatenate([[0], np.cumsum(sizes)[:-1]]),
                    "n_tokens": sizes, "ids": [i.tobytes() for i in ids]})

    # the manifest's own rows are tiny, so tasks are sized by the bytes that they will read
    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(1, -(-size // TASK_BYTES), min(manifest.count(), spark.sparkContext.defaultParallelism))
    return blocks.repartition(tasks, "file", "block").mapInPandas(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_record(folder: str, name: str, position: int) -> tuple[int | None, np.ndarray]:
    """One record of a file through its index: doc_id and token ids."""
    store, root = _store(folder)
    with store.open_input_file(f"{root}/{name}.index") as f:
        f.seek(position * struct.calcsize(INDEX_ENTRY))
        doc_id, offset, size, known = struct.unpack(
            INDEX_ENTRY, f.read(struct.calcsize(INDEX_ENTRY)))
    with store.open_input_file(f"{root}/{name}.records") as f:
        f.seek(offset)
        payload = parse(f.read(16 + size))[0]
    return (doc_id if known else None), token_ids(payload)


def crc_of(rows: DataFrame) -> DataFrame:
    """``rows`` with the unsigned crc32 of the id bytes instead of the ids."""
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write to a new folder of the shared store and read back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    return read(spark, folder, write(docs, tokenizer, end_id, folder))
