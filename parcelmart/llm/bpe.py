"""Byte-level BPE through a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Splits text before the merges; must equal the pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Python's classes and those of the rank file's own library differ in four control characters, which are no space there.
_SPACE = r"\p{White_Space}"
#: The same split for texts below U+02B0, where letters, numbers and spaces are few ranges; for Python's faster engine.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN_PATTERN = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pre-tokens remembered by a worker; the memory is emptied when it is full.
REMEMBERED = 300_000
#: Characters of text that are encoded together.
BLOCK_CHARS = 2_000_000
_UNKNOWN = "⁇unknown"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}


def byte_alphabet() -> list[str]:
    """A visible character for each byte: printable Latin-1 bytes stand for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: piece 0 is unknown, piece i+1 the i-th token by rank with score -rank.

    Text is not normalised: no dummy prefix, no space folding or escaping.
    """
    alphabet = byte_alphabet()
    model = _piece(_UNKNOWN, 0.0, 2)
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        model += _piece("".join(alphabet[b] for b in token), -float(rank), 1)
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, 0)
    trainer += b"".join(_number(f, -1) for f in (41, 42, 43)) + _bytes(45, _UNKNOWN.encode())
    normaliser = _bytes(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return model + _bytes(2, trainer) + _bytes(3, normaliser)


class _Memory(dict):
    """Pre-token -> [ids as text, decoded bytes, ids]. A new pre-token gets an empty entry, filled at the end of a block."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> list:
        self.new.append(part)
        entry = self[part] = ["", b"", ()]
        return entry


class Codec:
    """Encodes and decodes in one process. Made from the model bytes and the ranks alone."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import re

        import regex
        import sentencepiece

        self.ranks = ranks
        self.by_piece = [0, *sorted(ranks.values())]
        self.token = {rank: token for token, rank in ranks.items()}
        self.mapped = dict(enumerate(byte_alphabet()))
        spaces = pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", r"\P{White_Space}").replace(r"\s", _SPACE)
        self.split_any = regex.compile(spaces).findall
        self.beyond_latin = re.compile("[^\x00-\u02af]").search if pattern == PATTERN else None
        self.split_latin = re.compile(_LATIN_PATTERN).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known = _Memory()

    def split(self, text: str) -> list[str]:
        if self.beyond_latin is None or self.beyond_latin(text):
            return self.split_any(text)
        return self.split_latin(text)

    def pre_token_ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of each pre-token: its own rank if it has one, else the merges of the model."""
        raw = [p.encode() for p in parts]
        rest = [i for i, r in enumerate(raw) if r not in self.ranks]
        merged = self.pieces.encode([raw[i].decode("latin-1").translate(self.mapped) for i in rest], num_threads=1) if rest else []
        by_place = dict(zip(rest, merged))
        return [[self.by_piece[k] for k in by_place[i]] if i in by_place else [self.ranks[r]] for i, r in enumerate(raw)]

    def entries(self, texts: list[str | None]) -> list[list[list]]:
        """The entries of all pre-tokens of each text, encoded together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.__getitem__
        found = [list(map(get, self.split(t or ""))) for t in texts]
        new, self.known.new = self.known.new, []
        for part, ids in zip(new, self.pre_token_ids(new)):
            self.known[part][:] = ",".join(map(str, ids)), self.decode(ids), ids
        return found

    def encode(self, text: str | None) -> list[int]:
        return [i for entry in self.entries([text])[0] for i in entry[2]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids, sha256 of the decoded bytes); ids are decoded pre-token by pre-token."""
        out = []
        for entries in self.entries(texts):
            ids = ",".join([e[0] for e in entries])
            decoded = hashlib.sha256(b"".join([e[1] for e in entries])).hexdigest()
            count = ids.count(",") + 1 if entries else 0
            out.append((count, hashlib.sha256(ids.encode()).hexdigest(), decoded))
        return out


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of int): the ids of every whole text. NULL and empty texts have none."""
    return _with(docs, ranks_path, pattern, text, "token_ids array<int>", lambda codec, ts: [(codec.encode(t),) for t in ts])


def decode_documents(docs: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary): the bytes of an id column; NULL ids give no bytes."""
    return _with(docs, ranks_path, PATTERN, ids, "decoded binary", lambda codec, ts: [(codec.decode(t or []),) for t in ts])


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text's ids and of what they decode to."""
    new = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _with(docs, ranks_path, pattern, text, new, lambda codec, ts: codec.digests(ts))


def _with(docs: DataFrame, ranks_path: str, pattern: str, column: str, new: str, function) -> DataFrame:
    """One pass, no shuffle, any size of text. New columns replace old ones of the same name."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    names = [f.name for f in added]
    place = docs.columns.index(column)
    rest = [c for c in docs.columns if c not in names]
    fields = [f for f in docs.schema if f.name in rest]
    ranks = read_ranks(ranks_path)
    model = serialise_model(ranks)
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in new.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the codec's many entries hold no cycles
        codec = Codec(model, ranks, pattern)
        for batch in batches:
            values = batch.column(place)
            rows, held, chars = [], [], 0
            for value in values:
                held.append(value.as_py())
                chars += len(held[-1] or "")
                if chars > BLOCK_CHARS:
                    rows += function(codec, held)
                    held, chars = [], 0
            rows += function(codec, held)
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in names]
            columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *names])

    return docs.mapInArrow(run, StructType([*fields, *added]))
