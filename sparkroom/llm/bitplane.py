"""Token ids in bit-plane files.

Documents are dealt into ranges of doc_id, encoded there and their ids, each
document closed by an end id, cut into blocks of ``BLOCK`` ids. A block's ids
are transposed into bit planes (plane p holds bit p of every id), each plane
packed eight to a byte and compressed with zstandard; the chunk is its header
and planes. A dataset is a folder of Parquet files: one row for each chunk, with
its part, number, first id, and an index of the documents whose ids it holds, so
that reading a chunk needs no other.

Equal doc_ids are told apart by a text hash and then arbitrarily. Reading puts
the pieces of documents that cross chunks together again; the sum of the parts'
sizes gives each part its place in the whole.

Defined results: a null or empty text has the end id alone; null doc_ids come
first; rows that repeat are each written; an empty table gives no chunks; other
columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroom.llm.common import scratch_path
from sparkroom.llm.memory import PieceMemory

BLOCK = 65_536
END_ID = 2
LEVEL = 3
# Fixed value: the head of a chunk.
MAGIC, HEAD = b"BPL1", struct.Struct("<4sIB")
#: Pieces whose ids a Python worker remembers; when it is full it starts anew.
MEMORY_PIECES = 800_000
#: White space beside the blank and the newline.
_OTHER_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: A Latin letter or digit and the ASCII mark after it.
_ENDS = r"([0-9A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\[-`{-~])"
#: Texts encoded together, and new pieces put into one text for the library.
TEXTS, PIECES = 1024, 64
PART_BYTES = 1 << 26

CHUNKS = "part int, chunk int, first long, n_ids int, payload binary, docs array<struct<no:long,doc_id:long,at:int,n:int,piece:int,last:boolean,start:long>>"
ARROW_DOC = pa.struct([("no", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("piece", pa.int32()), ("last", pa.bool_()), ("start", pa.int64())])
ARROW_CHUNKS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("docs", pa.list_(ARROW_DOC))])


def pack(ids: np.ndarray, level: int = LEVEL) -> bytes:
    """A chunk of one block of ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    squeeze, cells, bits = zstandard.ZstdCompressor(level=level), ids.view(np.uint8).reshape(-1, 4), []
    for p in range(planes):
        if p % 8 == 0:
            byte = np.ascontiguousarray(cells[:, p // 8])
        bits.append(squeeze.compress(np.packbits(byte & np.uint8(1 << p % 8)).tobytes()))
    return HEAD.pack(MAGIC, len(ids), planes) + b"".join(struct.pack("<I", len(b)) for b in bits) + b"".join(bits)


def unpack(chunk: bytes) -> np.ndarray:
    """The ids of a chunk."""
    magic, n, planes = HEAD.unpack_from(chunk)
    if magic != MAGIC:
        raise ValueError("not a bit-plane chunk")
    sizes = struct.unpack_from(f"<{planes}I", chunk, HEAD.size)
    at, expand = HEAD.size + 4 * planes, zstandard.ZstdDecompressor()
    cells, byte = np.zeros((n, 4), np.uint8), np.zeros(n, np.uint8)
    for p, size in enumerate(sizes):
        raw = np.frombuffer(expand.decompress(chunk[at : at + size], max_output_size=(n + 7) // 8), np.uint8)
        byte |= np.unpackbits(raw, count=n) << np.uint8(p % 8)
        at += size
        if p % 8 == 7 or p == planes - 1:
            cells[:, p // 8], byte = byte, np.zeros(n, np.uint8)
    return cells.view("<u4").reshape(-1).astype(np.uint32)


class WordEncoder:
    """The library's ids of whole texts, with the ids of pieces kept.

    A byte-level BPE cuts a text by a pattern and merges inside the cuts alone. It
    cuts before a blank between two marks that are no white space, on both sides
    of a lone newline between such marks, and between a Latin letter or digit and
    an ASCII mark after it; so a text's ids are those of its pieces cut there.
    Arrow cuts the texts and numbers their distinct pieces; those not met before
    are encoded by the library, several as one text, where the blank that opens a
    piece, or a newline put between pieces, tells them apart again. Texts where
    white space meets white space, or with a special token's letters, go to the
    library whole, as do all texts with a tokenizer that doesn't open every word
    with a mark of its own."""

    def __init__(self, path: str, memory: int = MEMORY_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        size = self.lib.get_vocab_size()
        self.opens = np.array([(self.lib.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        special = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.odd = "|".join(["^$", "^ ", " $", "  ", r"^\n", r"\n$", r"\n\n", r"\n ", r" \n", f"[\0{_OTHER_BLANKS}]", *special])
        line, words = (self.lib.encode(t, add_special_tokens=False).ids for t in ("\n", " a b,c"))
        self.line = line[0] if line else -1
        self.cuts = len(line) == 1 and self.opens[words].tolist() == [True, True, False, False]
        self.known = PieceMemory(memory)

    @classmethod
    @lru_cache(maxsize=2)
    def shared(cls, path: str) -> WordEncoder:
        """One encoder for all tasks that a worker runs."""
        return cls(path)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> bool:
        """Work out the pieces not met before; False if they can't be told apart."""
        missing = self.known.missing(pieces)
        for blank in (True, False):
            new = [w for w in missing if (w[0] == " ") == blank and w != "\n"]
            if not new:
                continue
            between = "" if blank else "\n"
            ids = np.fromiter(chain.from_iterable(self.whole([between + between.join(new[i : i + PIECES]) for i in range(0, len(new), PIECES)])), np.uint32)
            starts = np.flatnonzero(self.opens[ids] if blank else ids == self.line)
            if len(starts) != len(new):
                return False
            sizes = np.diff(starts, append=len(ids))
            if not blank:
                ids, sizes = np.delete(ids, starts), sizes - 1
            self.known.keep(new, ids, sizes)
        if "\n" in missing:
            self.known.keep(["\n"], np.array([self.line], np.uint32), np.array([1]))
        return True

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if self.cuts else texts.slice(0, 0)
        if not len(plain):
            return [np.array(x, np.uint32) for x in self.whole(texts.to_pylist())]
        cut = pc.replace_substring(pc.replace_substring_regex(plain, _ENDS, "\\1\0\\2"), " ", "\0 ")
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", "\0\n\0"), "\0")
        named = lists.values.dictionary_encode()
        pieces = named.dictionary.to_pylist()
        if not self.learn(pieces):
            return [np.array(x, np.uint32) for x in self.whole(texts.to_pylist())]
        ids, ends = self.known.ids(pieces, named.indices.to_numpy(), lists.offsets.to_numpy())
        found = iter(np.split(ids, ends[1:-1]))
        others = iter(self.whole(texts.filter(pa.array(odd)).to_pylist()))
        return [np.array(next(others), np.uint32) if o else next(found) for o in odd.tolist()]


def write(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block: int = BLOCK, parts: int | None = None) -> None:
    """Encode whole texts and write their ids, in order of ``key``, under ``path``.

    There are as many parts as the session has shuffle partitions, or more, so
    that each has ``PART_BYTES`` of text at most on average."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    order = ["doc_id", "h", "salt"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), WordEncoder.shared(tokenizer)
        held: list[np.ndarray] = []
        docs: list[dict] = []
        size = chunk = no = done = 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            nonlocal held, docs, size, chunk, done
            ids = np.concatenate(held)
            out = [{"part": part, "chunk": chunk, "first": done, "n_ids": len(ids), "payload": pack(ids), "docs": docs}]
            done, chunk, held, docs, size = done + len(ids), chunk + 1, [], [], 0
            return pa.RecordBatch.from_pylist(out, schema=ARROW_CHUNKS)

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                some = batch.slice(i, TEXTS)
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1))):
                    ids = np.concatenate((ids, end))
                    start, piece = done + size, 0
                    while len(ids):
                        take = ids[: block - size]
                        ids = ids[len(take) :]
                        docs.append({"no": no, "doc_id": doc, "at": size, "n": len(take), "piece": piece, "last": not len(ids), "start": start})
                        held.append(take)
                        size, piece = size + len(take), piece + 1
                        if size == block:
                            yield close()
                    no += 1
        if size:
            yield close()

    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(chunks, CHUNKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, no (place in its part), doc_id, start, and its ids as little-endian
    unsigned 32-bit numbers in ``ids``, of every document."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = sorted((r.part, r.n) for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row for each part
    base, bases = 0, []
    for part, n in sizes:
        bases.append((part, base))
        base += n

    def pieces(whole: bool) -> DataFrame:
        """Documents inside one chunk, or the pieces of the others."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, payload, docs in zip(pdf.part, pdf.payload, pdf.docs):
                    chosen = [d for d in docs if (d["piece"] == 0 and d["last"]) == whole]
                    if chosen:
                        ids = memoryview(unpack(payload).astype("<u4").tobytes())
                        rows = [(part, d["no"], d["doc_id"], d["start"], d["piece"], bytes(ids[4 * d["at"] : 4 * (d["at"] + d["n"])])) for d in chosen]
                        out = pd.DataFrame(rows, columns=["part", "no", "doc_id", "start", "piece", "ids"])
                        out["doc_id"] = out.doc_id.astype("Int64")
                        yield out

        return chunks.select("part", "payload", "docs").mapInPandas(run, "part int, no long, doc_id long, start long, piece int, ids binary")

    columns = ["part", "no", "doc_id", "start", "ids"]
    # documents inside one chunk need no shuffle; the pieces of the others are few
    parted = pieces(False).groupBy("part", "no").agg(F.max("doc_id").alias("doc_id"), F.max("start").alias("start"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    joined = pieces(True).select(columns).union(parted.withColumn("ids", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))).select(columns))
    if not bases:
        return joined
    place = spark.createDataFrame(bases, "part int, base long")
    return joined.join(F.broadcast(place), "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def encoded(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``read`` gives of a dataset that ``write`` has put in the shared folder."""
    path = scratch_path(df.sparkSession, "token-ids")
    write(df, path, tokenizer, key, text)
    return read(df.sparkSession, path)

