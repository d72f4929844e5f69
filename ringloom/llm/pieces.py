"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ringloom.llm.common import fresh, lean_batches, partitions

MARK = "▁"
#: Bytes of text in a block of documents, and for each share of the table of distinct words, about.
BLOCK_BYTES, SHARE_BYTES = 8 << 20, 64 << 20
#: What a text with runs of white space is cut into: a newline and what follows it up to a mark, or marks and what follows them.
CHUNK = re.compile(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks(text: str) -> list[str]:
    """The marked words of a text, as keys of the table: a word with one mark stands without it, a word with more marks, or marks alone, with all of them, and a word at the start of a line with its newline."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    keys = text.replace("\n", " \n").split(" ")
    if "" not in keys:
        return keys
    out = []
    for c in CHUNK.findall(MARK + text.replace(" ", MARK)):
        out.append(c[1:] if c[0] == MARK and len(c) > 1 and c[1] != MARK else c)
    return out


class Model:
    """A model whose pieces cross neither marks nor newlines, so that marked words can be cut one by one."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross white space; its texts can't be cut into words")
        self.mark = sp.piece_to_id(MARK)
        self.kind = np.dtype(np.uint16 if len(pieces) <= 1 << 16 else np.uint32)
        if sp.encode("\na")[0] != self.mark or sp.normalize(" a\tb ") != f"{MARK}{MARK}a\tb{MARK}":
            raise ValueError("this model changes white space; its texts can't be cut into words")

    def segment(self, keys: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids of each key, and what they decode to as part of a text: with the first mark, if there is one, as a space."""
        plain = [k.replace(MARK, " ")[1:] if k[0] == MARK else k for k in keys]
        ids = self.sp.encode(plain, num_threads=1)
        for i, k in enumerate(keys):
            if k[0] == "\n":
                ids[i] = ids[i][1:]
            elif not plain[i]:
                ids[i] = [self.mark]
        back = self.sp.decode([[self.mark, *x] for x in ids], num_threads=1)
        return ids, back


def spelled(key: str) -> str:
    """What a key stands for in a text."""
    return key if key[0] == "\n" else key.replace(MARK, " ") if key[0] == MARK else " " + key


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block = batch.column(batch.num_columns - 1).to_numpy()
        rows = batch.select(range(batch.num_columns - 1))
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        blocks, loads = [], []
        for part in np.split(order, cuts) if len(order) else []:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
                w.write_batch(rows.take(pa.array(part)))
            blocks.append(int(block[part[0]]))
            loads.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(loads, pa.binary())], ["block", "load"])


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def _restored(data: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data.as_py())


def _opened(load: bytes) -> pa.Table:
    with pa.ipc.open_stream(load) as r:
        return r.read_all()


def _texts(load: bytes) -> list[str | None]:
    """The texts of a load: its last column."""
    table = _opened(load)
    return table.column(table.num_columns - 1).to_pylist()


def _distinct(n: int):
    """Of rows sorted by block, each block's distinct keys, parted in `n` shares by hash."""

    def parted(block: int, keys: set[str]) -> pa.RecordBatch:
        shares: dict[int, list[str]] = {}
        for key in sorted(keys):
            shares.setdefault(zlib.crc32(key.encode()) % n, []).append(key)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(shares), pa.int64()), pa.array([block] * len(shares), pa.int64()),
                pa.array([_squeezed(" ".join(x).encode()) for x in shares.values()], pa.binary()),
            ],
            ["share", "block", "keys"],
        )

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, set()
        for batch in batches:
            for block, load in zip(batch.column("block").to_pylist(), batch.column("load"), strict=True):
                if block != now and have:
                    yield parted(now, have)
                    have = set()
                now = block
                for text in _texts(load.as_buffer()):
                    if text:
                        have.update(chunks(text))
        if have:
            yield parted(now, have)

    return distinct


def _segment(path: str):
    """Of rows sorted by share, the ids of their keys; each key of a share is segmented once."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        width = model.kind.itemsize
        now, table = None, {}
        for batch in batches:
            counts, ids, odd = [], [], []
            for share, packed in zip(batch.column("share").to_pylist(), batch.column("keys"), strict=True):
                if share != now:  # no other share has its keys
                    now, table = share, {}
                keys = _restored(packed).decode().split(" ")
                new = [k for k in keys if k not in table]
                if new:
                    for k, x, back in zip(new, *model.segment(new), strict=True):
                        table[k] = (np.array(x, model.kind).tobytes(), None if back == spelled(k) else back)
                cut = [table[k] for k in keys]
                counts.append(_squeezed(np.array([len(x) // width for x, _ in cut], np.uint32).tobytes()))
                ids.append(_squeezed(b"".join(x for x, _ in cut)))
                odd.append([{"key": k, "back": b} for k, (_, b) in zip(keys, cut, strict=True) if b is not None])
            kind = pa.list_(pa.struct([("key", pa.string()), ("back", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("keys"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary()), pa.array(odd, kind)],
                ["block", "keys", "counts", "ids", "odd"],
            )

    return segment


def _join(schema: pa.Schema):
    def join(docs: pa.Table, words: pa.Table) -> pa.Table:
        at: dict[str, int] = {}
        odd: dict[str, str] = {}
        counts, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for i in range(words.num_rows):
            for key in _restored(words.column("keys")[i]).decode().split(" "):
                at[key] = len(at)
            counts.append(np.frombuffer(_restored(words.column("counts")[i]), np.uint32))
            flat = _restored(words.column("ids")[i])
            kind = np.uint16 if len(flat) == 2 * counts[-1].sum() else np.uint32
            ids.append(np.frombuffer(flat, kind).astype(np.int32))
            for x in words.column("odd")[i].as_py() or []:
                odd[x["key"]] = x["back"]
        size, flat = np.concatenate(counts).astype(np.int64), np.concatenate(ids)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        tables = []
        for load in docs.column("load"):
            rows = _opened(load.as_buffer())
            lists, lengths, backs = [], [], []
            for text in rows.column(rows.num_columns - 1).to_pylist():
                keys = chunks(text or "")
                where = np.fromiter(map(at.__getitem__, keys), np.int64, len(keys))
                n = size[where]
                total = int(n.sum())
                # the ids of the words one after another: each word's start, counted on from where it falls
                step = np.repeat(start[where] - np.concatenate([[0], np.cumsum(n)])[:-1], n) if total else np.zeros(0, np.int64)
                lists.append(flat[step + np.arange(total)])
                lengths.append(total)
                if odd and not odd.keys().isdisjoint(keys):
                    backs.append("".join(odd[k] if k in odd else spelled(k) for k in keys)[1:])
                else:
                    backs.append((text or "").replace(MARK, " "))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            found = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
            rows = rows.select(range(rows.num_columns - 1)).append_column("ids", found).append_column("decoded", pa.array(backs, pa.string()))
            tables.append(rows.cast(schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return join


def encode(docs: DataFrame, columns=("doc_id",), model: str | None = None) -> DataFrame:
    """`columns` of each row of `docs`, with ids, the ids of its text, and decoded, the text that they decode to.

    Rows are dealt to blocks of about BLOCK_BYTES of text, and travel packed. Each block sends its distinct marked words, parted by hash into shares, to the table of distinct words; there each word is segmented once, for all blocks, and its ids go back to the blocks that asked. A block then joins ids to the places of its words. A word that every document has is one row a block, so nothing grows with its count. A block is made of rows of one input partition, dealt by doc_id (the text where that is null), or of several small partitions; so it is made alike when a lost task is run again, its rows travel many at a time, and rows that repeat fall in as many blocks as partitions have them.

    A null text counts as an empty one and has no ids; texts of any length stay whole, each in one block; rows that repeat give rows that repeat; an empty table gives no rows; columns that aren't named are not read, but `columns` may not hold ids or decoded. Sets the session's Arrow batches to 8 MB.
    """
    lean_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    parts = docs.select(F.spark_partition_id().alias("part"), F.octet_length("text").cast("long").alias("size")).groupBy("part").agg(F.sum("size").alias("size"))
    n_parts, size, most = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    together, split, shares = max(1, BLOCK_BYTES * n_parts // max(1, size)), max(1, -(-most // BLOCK_BYTES)), max(n, -(-size // SHARE_BYTES))
    model = model or default_model()
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    block = F.floor(F.spark_partition_id() / F.lit(together)) * split + F.pmod(key, F.lit(split))
    given = docs.select(*columns)
    held = docs.select(*columns, F.col("text").alias(fresh(given, "text")), block.cast("long").alias(fresh(given, "block")))
    packed = held.mapInArrow(_pack, "block long, load binary").repartition(n, "block").sortWithinPartitions("block")
    asked = packed.mapInArrow(_distinct(shares), "share long, block long, keys binary").repartition(n, "share").sortWithinPartitions("share")
    told = asked.mapInArrow(_segment(model), "block long, keys binary, counts binary, ids binary, odd array<struct<key:string,back:string>>")
    schema = T.StructType(given.schema.fields).add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_join(to_arrow_schema(schema)), schema)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, the hashes of ids and decoded text, and `more` columns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
