"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranks.

The model file is a protocol buffer; its few fields are serialised here.  A piece is a token's bytes, each shown as one printable
letter; its score is the negative rank, so the pair that sentencepiece merges first is the one of lowest rank.  The normaliser is
the identity and no blanks are added or changed.  Texts are cut into pre-tokens first, and each is encoded on its own; ids are
decoded by turning the letters of their pieces back into bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of one run of text, words and pre-tokens that a worker remembers, and the longest of these.
RUN, CACHE, LONG = 1 << 16, 200_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


LETTERS = byte_letters()
BYTES = {letter: b for b, letter in enumerate(LETTERS)}
#: Latin-1 text of some bytes to their letters.
SHOW = {b: letter for b, letter in enumerate(LETTERS)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in order of their ranks, which must be 0, 1, ... without gaps."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(token) for token, n in map(bytes.split, filter(bytes.strip, f))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must go from 0 without gaps")
    return [ranks[n] for n in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer: a varint, a 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model: piece n is token n, and one more is the unknown piece, which no text meets."""
    # fixed values: field numbers and types of the public model format
    piece, text, score, kind, unknown = 1, 1, 2, 3, 2
    trainer, model_type, bpe, normalizer, name, dummy_prefix, extra_blanks, escape_blanks = 2, 3, 2, 3, 1, 3, 4, 5
    unk_id, bos_id, eos_id, pad_id, none = 40, 41, 42, 43, 2**64 - 1
    out = [_field(piece, _field(text, t.decode("latin-1").translate(SHOW).encode()) + _field(score, float(-n))) for n, t in enumerate(tokens)]
    out.append(_field(piece, _field(text, b"<unk> ") + _field(score, 0.0) + _field(kind, unknown)))
    out.append(_field(trainer, _field(model_type, bpe) + _field(unk_id, len(tokens)) + _field(bos_id, none) + _field(eos_id, none) + _field(pad_id, none)))
    out.append(_field(normalizer, _field(name, b"identity") + _field(dummy_prefix, 0) + _field(extra_blanks, 0) + _field(escape_blanks, 0)))
    return b"".join(out)


def runs(text: str, limit: int = RUN) -> Iterator[str]:
    """Pieces of about ``limit`` characters, cut before a blank between two characters that aren't white space: no
    pre-token reaches over such a place.  A text without one is one piece."""
    lo = 0
    while len(text) - lo > limit:
        at = text.find(" ", lo + limit)
        while at != -1 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        yield text[lo:at]
        lo = at
    yield text[lo:]


#: Blanks beside other white space, and the places where a pre-token surely ends.
ODD, EDGE = re.compile(r" \s|\s "), re.compile(r"(?<=\S)(?= \S)")


class _Remembered(dict):
    """Ids by string.  Those not met again while ``CACHE`` others come in are forgotten, so memory doesn't grow with the corpus."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, tuple[int, ...]] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that are not known; from then on the others are at hand."""
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        new = [k for k in keys if k not in self]
        self.update((k, self.before[k]) for k in new if k in self.before)
        return [k for k in new if k not in self]

    def forget(self, keys: list[str]) -> None:
        for k in keys:
            if len(k) > LONG:
                del self[k]


class ByteBpe:
    """Ids of texts and bytes of ids."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        self.whole = {p: (i,) for i, p in enumerate(pieces)}
        self.bytes = [bytes(map(BYTES.__getitem__, p)) for p in pieces]
        self.words, self.tokens = _Remembered(), _Remembered()

    def _encode(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Ids of texts, each pre-token on its own; one that is a token is that token, whatever merges lead to."""
        cut = list(map(self.split, texts))
        new = self.tokens.missing(set(chain.from_iterable(cut)))
        shown = [p.encode().decode("latin-1").translate(SHOW) for p in new]
        merged = [p for p in shown if p not in self.whole]
        ids = dict(zip(merged, map(tuple, self.model.encode(merged, num_threads=1)))) if merged else {}
        self.tokens.update((p, self.whole.get(s) or ids[s]) for p, s in zip(new, shown))
        out = [tuple(chain.from_iterable(map(self.tokens.__getitem__, c))) for c in cut]
        self.tokens.forget(new)
        return out

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids, a run of text at a time.  No pre-token reaches over a blank between two characters that aren't white space, so
        what stands between such blanks is encoded once and remembered."""
        for run in runs(text):
            odd = ODD.search(run)
            first, *words = EDGE.split(run) if odd else run.split(" ")
            if odd:
                words = [w[1:] for w in words]
            new = self.words.missing(set(words))
            start, *got = self._encode([first, *(" " + w for w in new)])
            self.words.update(zip(new, got))
            yield [*start, *chain.from_iterable(map(self.words.__getitem__, words))]
            self.words.forget(new)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_own: dict[int, ByteBpe] = {}


def byte_bpe_digests(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text encoded, then decoded from its ids: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space),
    decoded_sha256 (of the decoded bytes).

    A null text is empty: no ids, digests of nothing.  Rows that repeat an id, null ids included, have a row each.  Very long
    texts are encoded and hashed in runs.  An empty table gives an empty result; other columns are not read.  The
    vocabulary is read once, by the driver; tasks get the model (under 2 MB for 50,000 tokens).
    """
    model = serialise(read_ranks(ranks))
    key = int.from_bytes(hashlib.sha256(model + pattern.encode()).digest()[:8], "big")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _own:
            _own.clear()
            _own[key] = ByteBpe(model, pattern)
        bpe = _own[key]
        decimal = [str(i) for i in range(len(bpe.bytes))].__getitem__
        for batch in batches:
            out = []
            for t in batch.column(1):
                n, ids_sha, decoded_sha = 0, hashlib.sha256(), hashlib.sha256()
                for ids in bpe.encode(t.as_py() or ""):
                    if ids:
                        ids_sha.update(((" " if n else "") + " ".join(map(decimal, ids))).encode())
                        decoded_sha.update(bpe.decode(ids))
                        n += len(ids)
                out.append((n, ids_sha.hexdigest(), decoded_sha.hexdigest()))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
