"""Token ids as Arrow IPC files of fixed-size-list batches.

Documents are dealt into shards by ranges of their id, in ascending order. A shard is one Arrow
file whose rows are sequences of equal length (``ids``: fixed_size_list<uint16 or uint32>[L],
``mask``: fixed_size_list<bool>[L], false only for the padding of the last row), so token ``t``
of a shard is element ``t % L`` of row ``t // L`` and a memory-mapped reader takes any sequence
without a copy. A document's ids run on over row borders; each ends with ``end_id``.

Recovery: a task writes under a name of its own attempt and returns it in its index rows; only
the rows of the attempt that Spark commits name a file, so repeated attempts do no harm.

Defined results: a null or empty text is the end id alone. Null ids come first; rows of one id are in
the order of a hash of their texts. Repeated rows are encoded each. An empty table writes no file. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import sys
import threading
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_batches, hand_back, materialise, work_path

INDEX_SCHEMA = "shard int, path string, doc_id long, at long, n_tokens long"


class PieceEncoder:
    """Byte-pair encoding of whole texts with the tokenizers library, one call per *new* piece.

    The byte-level pre-tokeniser always starts a token at a blank that stands between two
    characters that are not white space, so ids of a text are those of its blank-separated
    pieces one after another. A new piece is cut by the pre-tokeniser's rule and merged by the
    library's own model; ids of recent pieces are kept in two generations of bounded size.
    Texts in which this does not hold (runs of white space, added tokens) are encoded whole.
    """

    #: The byte-level pre-tokeniser's rule.
    RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, capacity: int = 400_000, dtype: str = "<u2"):
        import json

        import regex
        from tokenizers import Tokenizer, models

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        bpe = spec["model"]
        # The same model without the library's own cache, whose lock costs more than it saves here.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in bpe["merges"]]
        options = {k: bpe[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if bpe.get(k)}
        self.merge = models.BPE(bpe["vocab"], merges, cache_capacity=0, **options).tokenize
        self.dtype, self.capacity, self.known, self.old = dtype, capacity, {}, {}
        self.code = "H" if np.dtype(dtype).itemsize == 2 else "I"
        self.cut = regex.compile(self.RULE).findall
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.whole = [""] if not plain else [t for t in added if t]  # a text that holds one is encoded whole
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.tails: dict[str, bytes] = {}
        self.letters = {b: chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}
        self.tails = {c: self._piece(c) for c in ".,;:!?)"}

    def _piece(self, piece: str) -> bytes:
        if piece[-1:] in self.tails and piece[0] == " " and piece[1:-1].isalpha():  # a word and one mark
            return (self.known.get(piece[1:-1]) or self._new(piece[1:-1])) + self.tails[piece[-1]]
        ids = array(self.code)
        for p in [piece] if piece[1:].isalpha() else self.cut(piece):
            p = "\u0120" + p[1:] if p.isascii() and p[1:].isalnum() and p[0] == " " else p.encode().decode("latin-1").translate(self.letters)
            ids.extend([t.id for t in self.merge(p)])
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def _new(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise _RunOfSpaces
            ids = self._piece(" " + piece)
        if len(self.known) >= self.capacity:
            self.old, self.known = self.known, {}
        self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace() and not any(t in text for t in self.whole):
            get, new = self.known.get, self._new
            try:
                return self._piece(first) + b"".join([get(p) or new(p) for p in rest])
            except _RunOfSpaces:
                pass
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


class _RunOfSpaces(Exception):
    """A blank of the text stands beside other white space."""


_encoders: dict[tuple[str, str], PieceEncoder] = {}
_leaving: list[threading.Timer] = []

#: Seconds without a task after which a worker process lets go of its encoder.
IDLE_S = 2.0


def encoder_of(path: str, dtype: str) -> PieceEncoder:
    """The encoder of a tokenizer, once a worker process: its vocabulary and known pieces serve all its tasks."""
    while _leaving:
        _leaving.pop().cancel()
    if (path, dtype) not in _encoders:
        _encoders.clear()
        _encoders[path, dtype] = PieceEncoder(path, dtype=dtype)
    return _encoders[path, dtype]


def _let_go() -> None:
    _encoders.clear()
    hand_back()


def let_go_when_idle() -> None:
    """Spark keeps its workers for other jobs, so an encoder of 150 MB must not stay in an idle one."""
    timer = threading.Timer(IDLE_S, _let_go)
    timer.daemon = True
    _leaving.append(timer)
    timer.start()


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ShardWriter:
    """Packs a run of ids into fixed-size-list record batches of one Arrow file."""

    def __init__(self, path: str, length: int, rows: int, dtype: str):
        self.fs, self.at = _fs(path)
        self.fs.create_dir(self.at.rsplit("/", 1)[0], recursive=True)
        self.length, self.step, self.kind = length, length * rows, np.dtype(dtype)
        value = pa.from_numpy_dtype(self.kind.newbyteorder("="))
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.at)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n = [], 0

    def _batch(self, ids: np.ndarray) -> None:
        full = -(-len(ids) // self.length) * self.length
        mask = np.ones(full, dtype=bool)
        mask[len(ids):] = False
        padded = np.concatenate([ids, np.zeros(full - len(ids), ids.dtype)]) if full > len(ids) else ids
        make = pa.FixedSizeListArray.from_arrays
        self.out.write_batch(pa.record_batch([make(pa.array(padded), self.length), make(pa.array(mask), self.length)], schema=self.schema))

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids) // self.kind.itemsize
        if self.n >= self.step:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype=self.kind)
        whole = len(ids) if last else len(ids) // self.step * self.step
        for k in range(0, whole, self.step):
            self._batch(ids[k : min(k + self.step, whole)])
        self.held, self.n = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()


class ShardReader:
    """Random access to the ids of a shard; local files are memory-mapped."""

    def __init__(self, path: str):
        fs, at = _fs(path)
        self.source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.step = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else 0

    def ids(self, at: int, n: int) -> Iterator[np.ndarray]:
        """Views of ids ``at`` to ``at + n``, a record batch at a time."""
        while n > 0:
            k, off = divmod(at, self.step)
            part = self.file.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)[off : off + n]
            yield part
            at, n = at + len(part), n - len(part)


def encode_shards(batches: Iterator[pa.RecordBatch], root: str, tokenizer: str, end_id: int, length: int, rows: int, dtype: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, encoder, writer, at = TaskContext.get().partitionId(), encoder_of(tokenizer, dtype), None, 0
    path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.arrow"
    end, width = np.array([end_id], dtype=dtype).tobytes(), np.dtype(dtype).itemsize
    for b in batches:
        doc_ids, starts, counts = b.column(0), [], []
        for text in b.column(1):
            writer = writer or ShardWriter(path, length, rows, dtype)
            ids = encoder.encode(text.as_py() or "") + end
            writer.add(ids)
            starts.append(at)
            counts.append(len(ids) // width)
            at += counts[-1]
        yield pa.record_batch([pa.array([shard] * len(starts), pa.int32()), pa.array([path] * len(starts)), doc_ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["shard", "path", "doc_id", "at", "n_tokens"])
    if writer:
        writer.close()
    let_go_when_idle()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048, rows: int = 256, text_col: str = "text", id_col: str = "doc_id", dtype: str = "<u2", root: str | None = None, batch_rows: int = 1024, batch_size: str = "8m") -> DataFrame:
    """Write the shards; returns the index: shard, path, doc_id, at (in its shard), n_tokens.

    Python workers get at most ``batch_rows`` texts and about ``batch_size`` bytes at a time.
    """
    root = root or work_path(docs.sparkSession, "tokens")
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows of one id go by their texts, so reruns agree and a hot id (or null) is cut into several shards.
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = rows_in.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    index = ordered.mapInArrow(lambda it: encode_shards(it, root, tokenizer, end_id, length, rows, dtype), INDEX_SCHEMA)
    with arrow_batches(docs.sparkSession, batch_rows, batch_size):
        return materialise(index, "token-index")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, reader = None, None
    for b in batches:
        sums = []
        for p, at, n in zip(b.column("path").to_pylist(), b.column("at").to_pylist(), b.column("n_tokens").to_pylist()):
            if p != path:
                path, reader = p, ShardReader(p)
            crc = 0
            for part in reader.ids(at, n):
                crc = zlib.crc32(part.astype("<u4"), crc)
            sums.append(crc)
        yield pa.record_batch([b.column("shard"), b.column("doc_id"), b.column("at"), b.column("n_tokens"), pa.array(sums, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(index: DataFrame) -> DataFrame:
    """Read the shards back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark: SparkSession = index.sparkSession
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row a shard
    base, before = [], 0
    for r in totals:
        base.append((r["shard"], before))
        before += r["n"]
    bases = spark.createDataFrame(base, "shard int, base long")
    # As many read tasks as shards: the small index must not be merged into a few.
    dealt = index.repartitionByRange(max(1, len(base)), "shard").sortWithinPartitions("shard", "at")
    read = dealt.mapInArrow(_checked, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    bases = F.broadcast(bases) if len(base) <= 1_000_000 else bases
    return read.join(bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
