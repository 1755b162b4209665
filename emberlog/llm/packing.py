"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Each scan partition packs its own documents in blocks of about ``block_tokens``, so packing adds no
shuffle. A block's tokens are dealt to exactly as many slots as they fill: sequences of full length and,
for what is left, sequences of powers of two (which need no padding). Pieces go in descending length to the
slot of least estimated attention cost (linear plus quadratic) that still has room; a piece that fits
nowhere is cut at the roomiest slot.
"""

from __future__ import annotations

import gc
import re
from struct import Struct, pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, in_arrow, text_of

#: Token id that ends a document.
END_ID = 1
#: Bound on each cache of one Python worker.
CACHE_CHUNKS = 200_000
#: ASCII characters that are neither letters, digits nor white space; without the apostrophe, which may begin a piece.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_WORKER = CACHES.setdefault("packing", {})
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class ChunkEncoder:
    """Token ids as little-endian uint32 bytes. A byte-level vocabulary never merges across a single space
    between two non-space characters, nor across a single line break there, so texts are cut at both and equal
    chunks are encoded once; new chunks are cut into the vocabulary's own pieces, and words are looked up without the
    marks that end them. Texts that hold an added token go through the tokenizer whole; with
    ``encode_special_tokens``, special ones are read as plain text."""

    def __init__(self, path: str, encode_special_tokens: bool = True):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        if whole.normalizer is not None or type(whole.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        self.split, self.model, self.letters = whole.pre_tokenizer.pre_tokenize_str, whole.model, _byte_letters()
        whole.no_truncation()
        whole.no_padding()
        whole.encode_special_tokens = encode_special_tokens
        self.whole = whole
        self.added = [t.content for t in whole.get_added_tokens_decoder().values() if not (t.special and encode_special_tokens)]
        self.packs = [Struct(f"<{n}I").pack for n in range(64)]
        self.space, self.line = self.letters[0x20], self._piece(self.letters[0x0A])
        self.marks = {m: self._piece(m) for m in MARKS}
        #: Ids of chunks, with the space before them unless they begin with a line break; and of those cached before.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, mapped: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(mapped)]
        return self.packs[len(ids)](*ids) if len(ids) < 64 else pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Letters with the space before them."""
        return self._piece(self.space + (word if word.isascii() else self._mapped(word)))

    def _mapped(self, piece: str) -> str:
        return piece.encode("utf-8").decode("latin-1").translate(self.letters)

    def _marks(self, tail: str) -> bytes:
        return self.marks.get(tail) or self._piece(tail)

    def _bare(self, text: str) -> bytes:
        """Any text without a cache."""
        # Letters, and marks after them, are one piece each; anything else is cut by the vocabulary's rule.
        word = text.rstrip(MARKS)
        if word.isalpha():
            ids = self._piece(self._mapped(word))
            return ids + self._marks(text[len(word) :]) if len(word) < len(text) else ids
        return b"".join([self._piece(piece) for piece, _ in self.split(text)])

    def _learn(self, new: set[str]) -> set[str]:
        """Put new chunks into the cache; those returned begin or end with white space, so that texts can't be cut there."""
        cache, older, uncut = self.cache, self.older, set()
        for chunk in new:
            ids = older.get(chunk)
            if ids is None:
                if chunk.isalpha():
                    ids = self._word(chunk)
                elif (word := chunk.rstrip(MARKS)).isalpha():
                    ids = cache.get(word) or older.get(word)
                    if ids is None:
                        ids = cache[word] = self._word(word)
                    ids += self._marks(chunk[len(word) :])
                else:
                    broken = chunk[:1] == "\n"
                    rest = chunk[1:] if broken else chunk
                    if not rest or rest[0].isspace() or rest[-1].isspace():
                        uncut.add(chunk)
                        continue
                    ids = self.line + self._bare(rest) if broken else self._bare(" " + rest)
            cache[chunk] = ids
        return uncut

    def encode(self, texts: list[str]) -> list[bytes]:
        if not any(a in t for a in self.added for t in texts):
            return self._plain(texts)
        held = [any(a in t for a in self.added) for t in texts]
        plain = iter(self._plain([t for t, h in zip(texts, held) if not h]))
        return [self._whole(t) if h else next(plain) for t, h in zip(texts, held)]

    def _whole(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        gc.disable()  # millions of small strings and no cycles
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        firsts = [chunks.pop(0) for chunks in cut]
        uncut = self._learn(set().union(*cut).difference(self.cache))
        get, out = self.cache.__getitem__, []
        for text, first, chunks in zip(texts, firsts, cut):
            if first[-1:].isspace() or uncut and not uncut.isdisjoint(chunks):
                out.append(self._uneven(text))
            else:
                out.append(self._bare(first) + b"".join(map(get, chunks)))
        gc.enable()
        return out

    def _uneven(self, text: str) -> bytes:
        """A text with more white space than single spaces and line breaks; its ends aren't cached."""
        first, *chunks = _CUT.split(text)
        last = self._bare(" " + chunks.pop()) if chunks else b""
        self._learn(set(chunks).difference(self.cache))
        return self._bare(first) + b"".join(map(self.cache.__getitem__, chunks)) + last


def encoder(path: str) -> ChunkEncoder:
    if path not in _WORKER:
        _WORKER[path] = ChunkEncoder(path, encode_special_tokens=False)
    return _WORKER[path]


def slots(total: int, length: int) -> list[int]:
    """Sequence lengths that hold ``total`` tokens without padding: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(sizes: list[int], length: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, slot, offset) that place every token of the documents once."""
    room = np.array(slots(sum(sizes), length), np.int64)
    filled, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    todo = [(min(length, n - at), d, at) for d, n in enumerate(sizes) for at in range(0, n, length)]
    todo.sort(key=lambda p: (-p[0], p[1], p[2]))
    out = []
    for size, doc, start in todo:
        while size:
            fits = np.flatnonzero(room >= size)
            slot = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            put = min(size, int(room[slot]))
            out.append((doc, start, put, slot, int(filled[slot])))
            room[slot] -= put
            filled[slot] += put
            cost[slot] += linear * put + quadratic * put * put
            size, start = size - put, start + put
    return out


KIND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _packer(path: str, length: int, block_tokens: int, linear: float, quadratic: float):
    end = np.array([END_ID], "<u4").tobytes()

    def flush(docs, first):
        pieces = assign([len(ids) // 4 for _, ids in docs], length, linear, quadratic)
        rows = [(docs[d][0], s, n, len(docs[d][1]) // 4, first + slot, o, docs[d][1][4 * s : 4 * (s + n)]) for d, s, n, slot, o in pieces]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KIND.types)], schema=KIND)

    def run(batches):
        model, first, held, tokens = encoder(path), TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                for doc, ids in zip(part.column(0).to_pylist(), model.encode(part.column(1).to_pylist())):
                    held.append((doc, ids + end))
                    tokens += len(ids) // 4 + 1
                    if tokens >= block_tokens:
                        yield flush(held, first)
                        first += len(slots(tokens, length))
                        held, tokens = [], 0
        if held:
            yield flush(held, first)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, length: int = 2048, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """Pack all documents. ``vocabulary`` is the tokenizer file's path on the executors.

    Returns one row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian
    uint32). Null text is empty: such a document is its end token. Repeated rows are packed once each; a
    null doc_id stays null. Added tokens of the vocabulary in a text get their own ids, as Tokenizer.encode gives
    by default. Texts of any length are cut freely. An empty table gives no rows; other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return in_arrow(rows, _packer(vocabulary, length, block_tokens, linear, quadratic), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary", "packing")
