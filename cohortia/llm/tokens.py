"""Token ids in Arrow files of equal-length sequences.

A file is in Arrow's random-access (IPC file) format. Every row is one sequence: ``ids``, a fixed-size list of ``length``
ids, and ``mask``, a fixed-size list of as many booleans, false where the file's last sequence is padded. All record
batches but the last have ``SEQUENCES`` rows, so sequence i is row i % SEQUENCES of batch i // SEQUENCES, and a memory map
gives it without copying. A second file beside it holds the documents: id, first position in the file's ids and number of
ids. Files hold documents in ascending order of their ids, and later files later documents.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.llm.shared import BLOCK_BYTES, keep, shared_folder, small_batches

#: Sequences of a record batch.
SEQUENCES = 128
#: Pieces whose ids a Python worker remembers.
REMEMBERED = 700_000
#: Pieces that go through the tokenizer as one text; a piece takes longer in longer texts.
TOGETHER = 32

_coders: dict[tuple, Coder] = {}


class Coder:
    """Ids of whole texts, as little-endian bytes.

    Byte-level vocabularies split a text before every space that a visible character follows, so the pieces between such
    places have ids of their own. Pieces go through the tokenizer and are remembered, as words repeat a lot; the ids are
    those of the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes | None] = {}
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(k) or "").startswith("\u0120") for k in range(size)])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _even(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces after a space. Many go through as one text; a piece holds no space but the one before it, so
        each begins at the next id whose token starts with a space."""
        texts = ["".join([" " + p for p in pieces[k : k + TOGETHER]]) for k in range(0, len(pieces), TOGETHER)]
        found = []
        for ids, k in zip(self._ids(texts), range(0, len(pieces), TOGETHER), strict=True):
            own = pieces[k : k + TOGETHER]
            starts = np.flatnonzero(self.spaced[np.frombuffer(ids, self.kind)]) * self.kind.itemsize
            if len(starts) == len(own) and starts[0] == 0:
                ends = [*starts[1:].tolist(), len(ids)]
                found += [ids[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
            else:  # a vocabulary with tokens of another kind
                found += self._ids([" " + p for p in own])
        return found

    def _uneven(self, pieces: list[str], known: dict[str, bytes | None]) -> bytes:
        """For texts with several spaces together: pieces that start with white space belong to the piece before."""
        found, own, merged = [], pieces[0], True
        for piece in pieces[1:]:
            if known[piece] is None:
                own, merged = (own if merged else " " + own) + " " + piece, True
            else:
                found.append((own, merged))
                own, merged = piece, False
        found.append((own, merged))
        fresh = iter(self._ids([x for x, merged in found if merged]))
        return b"".join([next(fresh) if merged else known[x] for x, merged in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [text.split(" ") for text in texts]
        fresh = list(set().union(*split).difference(self.known))
        even = [p for p in fresh if p and not p[0].isspace()]
        found = dict.fromkeys(fresh)
        found.update(zip(even, self._even(even), strict=True))
        # the commonest pieces come early; when enough are remembered, others are worked out in each block anew
        known = self.known
        if len(known) < REMEMBERED:
            known.update(found)
            found = {}
        firsts, get = self._ids([pieces[0] for pieces in split]), known.get
        result = []
        for first, pieces in zip(firsts, split, strict=True):
            parts = [get(p) or found.get(p) for p in pieces[1:]]
            try:
                result.append(first + b"".join(parts))
            except TypeError:
                result.append(self._uneven(pieces, dict(zip(pieces[1:], parts, strict=True))))
        return result


def default_tokenizer() -> str:
    """The installed public byte-level vocabulary; any file of the tokenizers library can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


class SequenceFile:
    """Packs ids into equal-length sequences and writes them with the list of documents."""

    def __init__(self, folder: str, name: str, kind: np.dtype, length: int, id_type: pa.DataType):
        self.files, at = pyarrow.fs.FileSystem.from_uri(folder)
        self.kind, self.length, self.path = kind, length, f"{folder}/{name}"
        value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([pa.field("ids", pa.list_(value, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.out = self.files.open_output_stream(f"{at}/{name}.arrow")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.index = f"{at}/{name}.documents.arrow"
        self.id_type = id_type
        self.waiting: list[bytes] = []
        self.waiting_ids, self.n_tokens = 0, 0
        self.documents: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        for column, value in zip(self.documents, (doc_id, self.n_tokens, n), strict=True):
            column.append(value)
        self.n_tokens += n
        self.waiting.append(ids)
        self.waiting_ids += n
        if self.waiting_ids >= SEQUENCES * self.length:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.kind)
        step = SEQUENCES * self.length
        whole = len(ids) // step * step
        for start in range(0, whole, step):
            self._batch(ids[start : start + step], step)
        rest = ids[whole:]
        if last and len(rest):
            size = -(-len(rest) // self.length) * self.length
            self._batch(np.concatenate([rest, np.zeros(size - len(rest), self.kind)]), len(rest))
            rest = rest[:0]
        self.waiting, self.waiting_ids = [rest.tobytes()], len(rest)

    def _batch(self, ids: np.ndarray, filled: int) -> None:
        mask = pa.array(np.arange(len(ids)) < filled)
        columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._write(True)
        self.writer.close()
        self.out.close()
        names, kinds = ("doc_id", "start", "n_tokens"), (self.id_type, pa.int64(), pa.int64())
        found = pa.table({n: pa.array(x, t) for n, x, t in zip(names, self.documents, kinds, strict=True)})
        with self.files.open_output_stream(self.index) as out, pa.ipc.new_file(out, found.schema) as writer:
            writer.write_table(found, max_chunksize=1 << 16)


def write_sequences(
    docs: DataFrame, folder: str, tokenizer: str, length: int = 2048, end_id: int = 2, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes the ids of all texts below ``folder`` and returns the manifest, one row per file: part, path, n_docs, n_tokens.

    Every text is encoded whole, without special tokens, and ``end_id`` follows each. NULL and empty texts consist of
    end_id alone. Documents stand in ascending order of their ids, NULL first; equal ids in the order of a hash of
    their texts, which lets ranges cut an id that many documents share; repeated rows are written as often as they come. An empty table writes nothing. Other columns are left alone.

    Texts are shuffled once, by ranges of ids. A task writes files under names no other attempt uses and only the names
    that a finished attempt returns are in the manifest, so lost executors and repeated tasks leave no wrong file in use.
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, code, end = TaskContext.get().partitionId(), None, coder(tokenizer), None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            start, size = 0, 0
            for k in range(len(ids) + 1):
                if k == len(ids) or size >= BLOCK_BYTES:
                    own = [x or "" for x in texts.slice(start, k - start).to_pylist()]
                    for doc_id, found in zip(ids[start:k], code.encode(own), strict=True):
                        if out is None:
                            end = np.array([end_id], code.kind).tobytes()
                            out = SequenceFile(folder, f"part-{part:05d}-{uuid.uuid4().hex}", code.kind, length, batch.schema.field(0).type)
                        out.add(doc_id, found + end)
                    start, size = k, 0
                if k < len(ids):
                    size += texts[k].as_buffer().size if texts[k].is_valid else 0
        if out is not None:
            out.close()
            columns = [pa.array([x]) for x in (part, out.path, len(out.documents[0]), out.n_tokens)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "path", "n_docs", "n_tokens"])

    files, at = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    rows = small_batches(docs).select(F.col(id_column).cast(id_type).alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return keep(ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "manifest")


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    files, at = pyarrow.fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(pa.memory_map(at) if files.type_name == "local" else files.open_input_file(at))


def read_sequence(path: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one sequence of a file; the ids are a view of the mapped file."""
    batch = _open(f"{path}.arrow").get_batch(number // SEQUENCES)
    ids, mask = (batch.column(c)[number % SEQUENCES].values for c in (0, 1))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_documents(path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of a file's document list, with each document's ids; ids that span batches are put together."""
    sequences, index = _open(f"{path}.arrow"), _open(f"{path}.documents.arrow")
    batch, rest, at = 0, np.zeros(0, np.uint16), 0
    for k in range(index.num_record_batches):
        documents = index.get_batch(k)
        ids = []
        for n in documents.column(2).to_numpy():
            parts, missing = [], int(n)
            while missing:
                if at == len(rest):
                    rest, at, batch = sequences.get_batch(batch).column(0).flatten().to_numpy(), 0, batch + 1
                parts.append(rest[at : at + missing])
                at, missing = at + len(parts[-1]), missing - len(parts[-1])
            ids.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        yield documents, ids


def document_checks(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): read back from the files. start counts the ids of all documents before;
    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit integers. One row per file is ordered in one task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for documents, ids in read_documents(path):
                    crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                    start = pa.array(documents.column(1).to_numpy() + offset)
                    columns = [documents.column(0), start, documents.column(2), crc]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = placed.repartition(max(1, manifest.count()))
    return dealt.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = 2048, end_id: int = 2) -> DataFrame:
    """Writes all documents and returns what is read back of each; ``folder`` is below the shared folder by default."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/llm-sequences-{uuid.uuid4().hex}"
    manifest = write_sequences(docs, folder, tokenizer, length, end_id)
    return document_checks(manifest, docs.schema["doc_id"].dataType.simpleString())
