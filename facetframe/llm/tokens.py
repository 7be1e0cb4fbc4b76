"""Token counts of flat token streams by a separator scan.

A stream is a flat file without index: token identifiers one after the other, documents ended by one identifier. It is cut into
blocks, ranges of its bytes that know nothing of each other; each block finds its separators, and a prefix scan over the blocks' summaries tells where the
document that a block begins in the middle of has started and how many have ended before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..session import shared_path, ship
from ._bytes import trimmed, utf8
from ._common import cut, place_of, small


@dataclass(frozen=True)
class TokenFiles:
    """``vocabulary``: path of a byte-level rank file on every executor; ``pattern``: its splitting of text.
    ``separator``: the identifier that ends a document; ``block``: tokens in a block, ``task_blocks`` in a task, about, and ``chunk``
    in a first-level scan; ``width``: bytes of an identifier. Files are reached by pyarrow, which knows local and shared folders,
    HDFS, S3 and GCS.
    """

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    separator: int = 50256
    block: int = 1 << 18
    task_blocks: int = 64
    chunk: int = 4096
    width: int = 2


_encodings: dict[str, object] = {}


def encoding(p: TokenFiles):
    if p.vocabulary not in _encodings:
        import tiktoken

        with open(p.vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[p.vocabulary] = tiktoken.Encoding("ranks", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[p.vocabulary]


def _packed(p: TokenFiles, folder: str):
    """Texts to one flat token file a task attempt. Rows: doc_id, file and ordinal of each document, and the file's bytes at last."""

    def rows(ids: list[int | None], name: str, first: int, length: int | None = None) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), pa.array([length] * n, pa.int64())], names=["doc_id", "stream", "ordinal", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoding(p).encode_ordinary, np.dtype(f"<u{p.width}")
        name = f"tokens-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.bin"
        ordinal, length, out = 0, 0, None
        end = np.array([p.separator], kind).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                place, path = place_of(folder)
                place.create_dir(path, recursive=True)
                out = place.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)
            data, offsets = utf8(batch.column(1))
            for k in range(batch.num_rows):
                raw = np.array(encode(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")), kind).tobytes() + end
                out.write(raw)
                length += len(raw)
            yield rows(batch.column(0).to_pylist(), name, ordinal)
            ordinal += batch.num_rows
        if out is not None:
            out.close()
            yield rows([None], name, ordinal, length)

    return trimmed(run)


def pack(docs: DataFrame, folder: str, p: TokenFiles = TokenFiles()) -> tuple[DataFrame, DataFrame]:
    """Writes flat token files below the shared ``folder``: (doc_id, stream, ordinal) of the documents, and the files (stream, path, length).

    A file belongs to the result only if the task that wrote it has ended well; what a lost attempt leaves is not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = cut(rows.mapInArrow(_packed(p, folder), "doc_id long, stream string, ordinal long, length long"))
    files = packed.where("length is not null").select("stream", F.concat(F.lit(f"{folder}/"), "stream").alias("path"), "length")
    return packed.where("length is null").select("doc_id", "stream", "ordinal"), files


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(stream, path, length) of the files that Spark lists under ``path``; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream"), "path", "length")


def _separated(p: TokenFiles):
    """Reads blocks (stream, at, path, offset, size) of files: their separators, their positions in the block and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, path, file = np.dtype(f"<u{p.width}"), None, None
        for batch in batches:
            ends, length = [], []
            for its, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size")), strict=True):
                if its != path:
                    path = its
                    place, at = place_of(path)
                    file = place.open_input_file(at)
                raw = file.read_at(size, offset)
                ids = np.frombuffer(raw, kind, len(raw) // p.width)
                ends.append(np.flatnonzero(ids == p.separator))
                length.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("at"), pa.array(ends, pa.list_(pa.int64())), pa.array(length, pa.int64())], names=["stream", "at", "ends", "length"])

    return trimmed(run)


def blocks_of(files: DataFrame, p: TokenFiles = TokenFiles()) -> DataFrame:
    """(stream, at, ends, length) of every block of ``files`` (stream, path, length): a task reads some ranges of bytes, never a whole file."""
    ship(files.sparkSession)
    size = p.block * p.width
    total = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 0
    cuts = files.where("length > 0").select("stream", "path", "length", F.explode(F.expr(f"sequence(0L, cast(ceil(length / {size}) as bigint) - 1)")).alias("at"))
    cuts = cuts.selectExpr("stream", "at", "path", f"at * {size} as offset", f"least({size}, length - at * {size}) as size")
    spread = max(1, ceil(int(total) / p.task_blocks))
    found = cuts.repartitionByRange(spread, "stream", "at").mapInArrow(_separated(p), f"stream {dict(files.dtypes)['stream']}, at long, ends array<long>, length long")
    return cut(found)


def separator_scan(blocks: DataFrame, p: TokenFiles = TokenFiles()) -> DataFrame:
    """stream, ordinal, first_token, n_tokens and closed of every document of the streams, from their blocks (stream, at, ends, length).

    Blocks follow each other by ``at``; other columns are ignored. n_tokens leaves the separator out; two separators in a
    row are a document of no tokens. Tokens after a stream's last separator are one document that is not closed. An
    identifier cut off at a file's end is dropped. Empty blocks add nothing. An empty table gives an empty table.

    The prefix scan has two levels: over the blocks of a chunk, and over the chunks of a stream.
    """
    ends = F.size("ends")
    found = blocks.select("stream", "at", "ends", "length", F.floor(F.col("at") / p.chunk).alias("chunk"))
    before = Window.partitionBy("stream", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = found.withColumns({"begin": F.coalesce(F.sum("length").over(before), F.lit(0)), "ended": F.coalesce(F.sum(ends).over(before), F.lit(0))})
    inside = inside.withColumn("last", F.expr("begin + try_element_at(ends, -1)"))
    inside = inside.withColumn("prior", F.max("last").over(before))
    chunks = inside.groupBy("stream", "chunk").agg(F.sum("length").alias("tokens"), F.sum(ends).alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("stream").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({"chunk_begin": F.coalesce(F.sum("tokens").over(earlier), F.lit(0)), "chunk_ended": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    chunks = chunks.withColumn("last", F.col("chunk_begin") + F.col("last"))
    chunks = cut(chunks.withColumn("chunk_prior", F.max("last").over(earlier)))
    told = inside.join(small(chunks.select("stream", "chunk", "chunk_begin", "chunk_ended", "chunk_prior"), chunks.count()), ["stream", "chunk"])
    told = told.selectExpr("stream", "ends", "chunk_begin + begin as begin", "chunk_ended + ended as ended", "coalesce(chunk_begin + prior, chunk_prior, -1) + 1 as open_from")
    each = told.select("stream", "begin", "open_from", "ended", F.posexplode("ends").alias("k", "end"), "ends")
    closed = each.select("stream", (F.col("ended") + F.col("k")).alias("ordinal"), F.expr("if(k = 0, open_from, begin + ends[k - 1] + 1)").alias("first_token"), F.expr("begin + end").alias("stop"), F.lit(True).alias("closed"))
    total = chunks.groupBy("stream").agg(F.sum("tokens").alias("stop"), F.sum("n").alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("first_token"))
    tail = total.where("stop > first_token").select("stream", "ordinal", "first_token", "stop", F.lit(False).alias("closed"))
    return closed.union(tail).select("stream", F.col("ordinal").cast("long").alias("ordinal"), F.col("first_token").cast("long").alias("first_token"), (F.col("stop") - F.col("first_token")).cast("long").alias("n_tokens"), "closed")


def token_counts(docs: DataFrame, p: TokenFiles = TokenFiles()) -> DataFrame:
    """doc_id, stream, ordinal and n_tokens of every row of ``docs`` (doc_id, text), counted in the flat files they are packed to.

    A null or empty text has no tokens. Repeated rows are documents of their own. An empty table gives an empty table.
    """
    packed, files = pack(docs, shared_path(docs.sparkSession, "tokens"), p)
    counts = separator_scan(blocks_of(files, p), p)
    return packed.join(counts.select("stream", "ordinal", "n_tokens"), ["stream", "ordinal"]).select("doc_id", "stream", "ordinal", "n_tokens")
