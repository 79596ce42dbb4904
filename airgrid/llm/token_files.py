"""Token ids in Arrow files: equal-length sequences and masks that can be mapped and read at random.

Texts are ranged by id, so part k holds the ids of a run of documents in order.  A part is an Arrow file (the stream format
with a footer): batches of fixed-size lists ``tokens`` (16 or 32 bits unsigned, by the vocabulary) and ``mask`` (a bit each), uncompressed
and of one size, so that row r is at a known offset of the mapped file.  The last sequence of a part is padded; its mask says
where.  A second file holds the documents of the part: id, first token and number of tokens.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import shared_folder

CACHE = 400_000


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if re.match("(file:)?/(?!/)", path) else path)


class _Places(dict):
    """Numbers of pieces; a new piece gets the next number and is kept in ``fresh`` until its ids are learnt."""

    def __init__(self, *args):
        super().__init__(*args)
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


#: A mark behind a letter or digit begins a new pre-token.
MARK = re.compile("[.,;:!?*$&#%|<>](?<=[a-z0-9ß-öø-ÿ].)")
#: With one of these, normal forms and case no longer go letter by letter; "<|" may begin a special token.
HARD = re.compile("[\u0300-\u036f]|<\\|")
#: Letters that normal forms and lower case leave alone: such a piece is one pre-token.
WORD = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """The letter that a byte-level pre-tokenizer shows for each byte: itself if printable, else the next from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - shown))}


BYTE_LETTERS = _byte_letters()


def _pieces(text: str) -> list[str]:
    """Pieces whose ids, one after the other, are those of the whole text: no pre-token spans an ASCII blank, nor a letter and
    a mark behind it, and the tokenizer ignores the case of A-Z."""
    if not HARD.search(text):
        text = MARK.sub(r" \g<0>", text.lower() if text.isascii() else text.encode().lower().decode())
    return text.replace("\n", " ").split(" ")


class _Encoder:
    """Ids of whole texts, piece by piece.  Ids of pieces are remembered, those seen once are forgotten when there are too many."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.place = _Places({"": 0, None: 1})  # None stands for the end id
        self.flat, self.used = np.full(1 << 16, end_id, np.uint32), 1
        self.first, self.length, self.uses = np.zeros((3, 1 << 16), np.int64)
        self.length[1] = 1
        probe = "Ab, cdé. x1!  'tis\nÀ*"
        if self.encode([probe])[0].tolist() != [*self.tokenizer.encode(probe, add_special_tokens=False).ids, end_id]:
            raise ValueError("this tokenizer doesn't encode piece by piece")

    def _ids(self, fresh: list[str]) -> list[list[int]]:
        """Ids of pieces; plain words go straight to the tokenizer's model."""
        out = [[t.id for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LETTERS))] if WORD.fullmatch(p) else None for p in fresh]
        others = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([fresh[i] for i in others], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _forget(self) -> None:
        """Keep the pieces seen more than once, unless these are too many too."""
        keep = np.flatnonzero(self.uses[: len(self.place)] > 1)
        keep = np.r_[0, 1, keep[keep > 1]] if len(keep) < CACHE // 2 else np.arange(2)
        names, length = list(self.place), self.length[keep]
        first = np.cumsum(length) - length
        self.used = int(length.sum())
        self.flat[: self.used] = self.flat[np.repeat(self.first[keep] - first, length) + np.arange(self.used)]
        self.place = _Places(zip([names[i] for i in keep.tolist()], range(len(keep))))
        self.first[: len(keep)], self.length[: len(keep)] = first, length
        self.uses[:] = 0

    def _learn(self, fresh: list[str]) -> None:
        """Append the ids of new pieces to the tables, which grow by doubling."""
        got = self._ids(fresh)
        total, n = len(self.place), len(self.place) - len(fresh)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        more = np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))
        while self.used + len(more) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while total > len(self.first):
            self.first, self.length, self.uses = (np.r_[x, np.zeros_like(x)] for x in (self.first, self.length, self.uses))
        self.flat[self.used : self.used + len(more)] = more
        self.length[n:total] = lengths
        self.first[n:total] = self.used + (np.cumsum(lengths) - lengths)
        self.used += len(more)
        fresh.clear()

    def encode(self, texts: list[str], ends: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it (of parts of texts, where ``ends`` says so), and the number for each."""
        if len(self.place) > CACHE:
            self._forget()
        number, flat, sizes = self.place.__getitem__, [], []
        for i, t in enumerate(texts):
            before = len(flat)
            flat.extend(map(number, _pieces(t)))
            if ends is None or ends[i]:
                flat.append(1)
            sizes.append(len(flat) - before)
        if self.place.fresh:
            self._learn(self.place.fresh)
        at = np.array(flat, np.int64)
        self.uses[: len(self.place)] += np.bincount(at, minlength=len(self.place))
        length, first = self.length[at], self.first[at]
        total = np.r_[0, np.cumsum(length)]
        out = self.flat[np.repeat(first - total[:-1], length) + np.arange(total[-1])]
        return out, np.diff(total[np.r_[0, np.cumsum(sizes)]])


#: Characters of a part of a text, and of the parts that are encoded together.
PART, TOGETHER = 1 << 16, 1 << 20


def parts(text: str) -> list[str]:
    """A text cut at blanks, which encode to nothing, into parts of about ``PART`` characters; one without blanks is one part."""
    out, lo = [], 0
    while len(text) - lo > PART and (at := text.find(" ", lo + PART)) >= 0:
        out.append(text[lo:at])
        lo = at + 1
    return [*out, text[lo:]]


def _together(texts: Iterable[str]) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """Parts of texts, about ``TOGETHER`` characters at a time: the texts' numbers, the parts, and whether they end their text."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for i, text in enumerate(texts):
        own = parts(text)
        for k, part in enumerate(own):
            for column, value in zip(held, (i, part, k + 1 == len(own))):
                column.append(value)
            size += len(part) + 1
            if size >= TOGETHER or len(held[0]) >= 1024:
                yield held
                held, size = ([], [], []), 0
    if held[0]:
        yield held


_encoders: dict[tuple[str, int], _Encoder] = {}


def _encoder(path: str, end_id: int) -> _Encoder:
    """One encoder for each worker process, so that its next tasks know the pieces."""
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = _Encoder(path, end_id)
    return _encoders[path, end_id]


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        head = json.load(f)
    return 1 + max([*head["model"]["vocab"].values(), *(t["id"] for t in head.get("added_tokens", []))])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, length: int = 1024, rows: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write the files.  Returns the manifest (part, path, docs, tokens), one row for each part.

    A null text is empty and still gets the end id.  Documents stand in ascending id order, null ids first; rows that
    share an id are ordered by text.  An empty table writes no files.  Columns other than these two are not read.  A task
    that is run again replaces its files by equal ones.  ``folder`` must be one that all executors reach.
    """
    folder = folder or shared_folder(docs.sparkSession)
    dtype = np.uint16 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else np.uint32
    ordered = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, sink = TaskContext.get().partitionId(), None, None
        kind = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))], {"dtype": np.dtype(dtype).name})
        ids, counts, left, total = [], [], np.zeros(0, dtype), 0
        fs, base = _located(folder)

        def put(flat: np.ndarray, valid: int) -> None:
            mask = np.arange(len(flat)) < valid
            sink.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (flat, mask)], schema=kind))

        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = _encoder(tokenizer, end_id)
                fs.create_dir(base, recursive=True)
                name = f"{base}/part-{part:06d}"
                mine = f"{name}.{TaskContext.get().taskAttemptId()}"
                out = fs.open_output_stream(mine + ".tmp")
                sink = pa.ipc.new_file(out, kind)
            per_text = np.zeros(batch.num_rows, np.int64)
            for number, some, ends in _together(t.as_py() for t in batch.column("text")):
                got, n = encoder.encode(some, ends)
                np.add.at(per_text, number, n)
                total += len(got)
                left = np.concatenate([left, got.astype(dtype)])
                while len(left) >= rows * length:
                    put(left[: rows * length], rows * length)
                    left = left[rows * length :]
            counts.append(per_text)
            ids.append(batch.column("doc_id"))
        if encoder is not None:
            if len(left):
                flat = np.zeros(-(-len(left) // length) * length, dtype)
                flat[: len(left)] = left
                put(flat, len(left))
            sink.close()
            out.close()
            n = np.concatenate(counts)
            index = pa.table({"doc_id": pa.chunked_array(ids), "first": (np.cumsum(n) - n), "n_tokens": n})
            with fs.open_output_stream(mine + ".index.tmp") as f, pa.ipc.new_file(f, index.schema) as w:
                w.write_table(index)
            fs.move(mine + ".index.tmp", name + ".index.arrow")
            fs.move(mine + ".tmp", name + ".arrow")
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([folder + f"/part-{part:06d}"]), pa.array([len(n)]), pa.array([total])], ["part", "path", "docs", "tokens"])

    return ordered.mapInArrow(write, "part long, path string, docs long, tokens long")


class TokenFile:
    """Random access to one part: ``sequence(r)`` gives row r, its ids as a view and its mask unpacked, ``tokens(a, b)`` ids a to b of the part's documents."""

    def __init__(self, path: str):
        fs, name = _located(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(name + ".arrow") if local else fs.open_input_file(name + ".arrow"))
        with fs.open_input_file(name + ".index.arrow") as f:
            self.index = pa.ipc.open_file(f).read_all()
        self.kind = self.reader.schema.field("tokens").type
        self.length = self.kind.list_size
        self.rows = len(self.reader.get_batch(0)) if self.reader.num_record_batches else 0

    def batch(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.reader.get_batch(b)
        tokens = got.column("tokens").flatten().to_numpy(zero_copy_only=True)
        return tokens.reshape(-1, self.length), got.column("mask").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.length)

    def mask_bits(self, b: int) -> np.ndarray:
        """The masks of batch ``b`` as they lie in the file, eight to a byte from the lowest bit: a view, as ids are."""
        held = self.reader.get_batch(b).column("mask").flatten()
        return np.frombuffer(held.buffers()[1], np.uint8)[: -(-len(held) // 8)]

    def sequence(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        tokens, mask = self.batch(r // self.rows)
        return tokens[r % self.rows], mask[r % self.rows]

    def tokens(self, a: int, b: int) -> np.ndarray:
        per = self.rows * self.length
        out = [np.zeros(0, self.kind.value_type.to_pandas_dtype())]
        for k in range(a // per, -(-b // per)):
            tokens, mask = self.batch(k)
            out.append(tokens[mask][max(0, a - k * per) : b - k * per])
        return np.concatenate(out)


def read_tokens(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Per document, read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids
    as little-endian unsigned 32-bit integers).  One task for each part; parts are few, so their offsets are one window."""
    offset = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.withColumn("offset", offset).select("path", "offset").collect()
    if len({p.path for p in parts}) < len(parts):
        raise ValueError("two tasks wrote one part")
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist()):
                file = TokenFile(path)
                first, n = (file.index.column(c).to_numpy() for c in ("first", "n_tokens"))
                end, at, lo = first + n, 0, 0
                crcs = [0] * len(n)
                for k in range(file.reader.num_record_batches):
                    tokens, mask = file.batch(k)
                    got = tokens[mask].astype("<u4")
                    hi = int(np.searchsorted(first, at + len(got)))
                    for i in range(lo, hi):  # documents that stand here, in part or whole
                        crcs[i] = zlib.crc32(got[max(0, first[i] - at) : end[i] - at], crcs[i])
                    at += len(got)
                    lo = int(np.searchsorted(end, at, side="right"))
                yield from pa.table({"doc_id": file.index.column("doc_id"), "start": first + base, "n_tokens": n, "ids_crc32": np.array(crcs, np.int64)}).combine_chunks().to_batches()

    frame = spark.createDataFrame([(p.path, p.offset) for p in parts], "path string, offset long").repartition(max(1, len(parts)))
    return frame.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", **options) -> DataFrame:
    """Write the files, then read them back (see ``write_tokens`` and ``read_tokens``)."""
    from .scratch import stage

    return read_tokens(stage(write_tokens(docs, tokenizer, doc_id=doc_id, **options)), docs.schema[doc_id].dataType.simpleString())
