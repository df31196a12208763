"""Bounded-space online packing of token pieces into fixed windows.

Every partition keeps at most ``open_windows`` windows open. A document is cut into full windows and a rest; the rest
goes to the open window it fits best. When none fits, the fullest window is filled up with the head of the rest and
emitted, so emitted windows hold no padding. What is open at a partition's end is merged over ever fewer groups of
partitions; the very last tokens are cut into windows whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is the closing id alone; repeated rows are packed one by one; an empty table gives
no rows; a null identifier is kept as null; further columns are ignored.
"""

from __future__ import annotations

import itertools
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.scratch import staged

#: Partitions whose leftovers one task merges.
FAN_IN = 64
_FIELDS = dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "place"], pa.int64()) | {"ids": pa.binary()}
_SCHEMA = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in _FIELDS)
#: White space other than blank, tab, line feed and carriage return; texts that hold any are encoded whole.
_ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space, so no token spans it: the ids of a text are those of its words between blanks. Signs
    after a word's last letter make tokens of their own, so a word is looked up in two parts. The distinct parts of some texts
    are looked up at once in Arrow arrays, and those not met lately are encoded, together where they are letters. At most
    ``most`` parts are remembered (some 50 bytes each) between calls; when there are more, the half met last stays. Longer
    texts than ``piece`` are cut at blanks.
    """

    def __init__(self, path: str, closing_id: int = 1, most: int = 500_000, piece: int = 1_000_000) -> None:
        (self.tokenizer, self.last), self.most, self.piece = _tokenizer(path), most, piece
        self.parts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met, self.turn = np.zeros(0, np.int64), 0
        # these are met in the text as it stands, so one in capitals is none; texts with any are encoded whole
        self.added = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.closing = closing_id.to_bytes(4, "little")

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, each of which the tokenizer takes as one: encoded as one line and cut at its words."""
        line = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(line.ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._whole(words)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * z] for a, z in itertools.pairwise([0, *ends.tolist()])]

    def _encoded(self, words: list[str]) -> list[bytes]:
        found: dict[str, bytes] = {}
        for own, encode in (([w for w in words if w.isalpha()], self._letters), ([w for w in words if not w.isalpha()], self._whole)):
            for i in range(0, len(own), 10_000):
                found.update(zip(own[i : i + 10_000], encode(own[i : i + 10_000]), strict=True))
        return [found[w] for w in words]

    def _ids(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts of words."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy().copy()
        new = parts.filter(pa.array(at < 0))
        at[at < 0] = np.arange(len(new)) + len(self.parts)
        if len(new):
            self.parts = pa.concat_arrays([self.parts, new])
            self.ids = pa.concat_arrays([self.ids, pa.array(self._encoded(new.to_pylist()), pa.large_binary())])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.turn += 1
        self.met[at] = self.turn
        found = self.ids.take(pa.array(at))
        if len(self.parts) > self.most:
            stay = pa.array(np.argsort(-self.met, kind="stable")[: self.most // 2])
            self.parts, self.ids, self.met = self.parts.take(stay), self.ids.take(stay), self.met[stay]
        return found

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose only white space is blank, tab, line feed and carriage return, in lower case already."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        ends, coded = words.offsets.to_numpy(), pc.dictionary_encode(words.flatten())
        parts = pc.dictionary_encode(_parts(coded.dictionary))
        at, flat = _buffers(self._ids(parts.dictionary).take(parts.indices))
        found = pa.Array.from_buffers(pa.large_binary(), len(coded.dictionary), [None, pa.py_buffer(at[::2].copy()), flat])
        at, flat = _buffers(found.take(coded.indices))
        return [bytes(flat[a:z]) for a, z in itertools.pairwise(at[ends - ends[0]].tolist())]

    def _cut(self, text: str) -> list[str]:
        """Pieces of about ``piece`` characters, cut before blanks."""
        out, at = [], 0
        while len(text) - at > self.piece:
            cut = text.find(" ", at + self.piece)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        some, owner, size = [], [], 0

        def flush() -> None:
            for i, ids in zip(owner, self._split(some) if some else [], strict=True):
                out[i].append(ids)
            some.clear()
            owner.clear()

        for i, text in enumerate(texts):
            text = text or ""
            plain = text.isascii()
            odd = any(c in text for c in _ODD_ASCII) or not plain and any(c in text for c in _ODD_WIDE)
            low = text.lower()
            odd |= any(token in low for token in self.added)
            if odd or not plain and ("\u03a3" in text or not unicodedata.is_normalized("NFC", text)):
                out[i] = self._whole([text])
                continue
            for part in self._cut(low):
                some.append(part)
                owner.append(i)
                size += len(part)
                if size > 8 * self.piece:
                    flush()
                    size = 0
        flush()
        return [b"".join([*own, self.closing]) for own in out]


def _buffers(array: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets and bytes of an array of long texts or binaries."""
    _, at, flat = array.buffers()
    return np.frombuffer(at, np.int64)[array.offset : array.offset + len(array) + 1], flat or pa.py_buffer(b"")


def _parts(words: pa.Array) -> pa.Array:
    """Of every word its letters and the ASCII signs after them, in turn; of words that are not so, all and nothing."""
    letters = pc.ascii_rtrim(words, characters=string.punctuation)
    length = pc.if_else(pc.utf8_is_alpha(letters), pc.binary_length(letters), pc.binary_length(words)).to_numpy()
    at, flat = _buffers(words)
    cuts = np.empty(2 * len(words) + 1, np.int64)
    cuts[::2], cuts[1::2] = at, at[:-1] + length
    return pa.Array.from_buffers(pa.large_string(), 2 * len(words), [None, pa.py_buffer(cuts), flat])


_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer, and which of its tokens end a word: one for each vocabulary and worker process."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        last = np.zeros(found.get_vocab_size(), bool)
        last[[i for token, i in found.get_vocab().items() if token.endswith("</w>")]] = True
        _TOKENIZERS[path] = found, last
    return _TOKENIZERS[path]


#: One encoder for each vocabulary and worker process, so that later tasks find known words.
_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, closing_id: int) -> Encoder:
    if (path, closing_id) not in _ENCODERS:
        _ENCODERS[path, closing_id] = Encoder(path, closing_id)
    return _ENCODERS[path, closing_id]


class Packer:
    """Places pieces ``(doc_id, start, doc_tokens, ids)``; ``rows`` collects what was emitted."""

    def __init__(self, window: int, open_windows: int, first_id: int, part: int) -> None:
        self.window, self.most, self.next_id, self.part = window, open_windows, first_id, part
        self.open: list[list] = []  # [tokens, pieces]
        self.rows: list[tuple] = []

    def _row(self, piece: tuple, sequence: int | None, offset: int, place: int, keep: bool) -> tuple:
        doc, start, total, ids = piece
        return doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, self.part, place, ids if keep else None

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append(self._row(p, self.next_id, offset, 0, False))
            offset += len(p[3]) // 4
        self.next_id += 1

    def add(self, doc: int | None, start: int, total: int, ids: bytes) -> None:
        size = 4 * self.window
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self._emit([(doc, start + at // 4, total, ids[at : at + size])])
        ids, start = ids[whole:], start + whole // 4
        while ids:
            n = len(ids) // 4
            fitting = [w for w in self.open if self.window - w[0] >= n]
            if fitting:
                best = max(fitting, key=lambda w: w[0])
                best[0] += n
                best[1].append((doc, start, total, ids))
                if best[0] == self.window:
                    self.open.remove(best)
                    self._emit(best[1])
                return
            if len(self.open) < self.most:
                self.open.append([n, [(doc, start, total, ids)]])
                return
            full = max(self.open, key=lambda w: w[0])
            gap = self.window - full[0]
            self.open.remove(full)
            self._emit([*full[1], (doc, start, total, ids[: 4 * gap])])
            ids, start = ids[4 * gap :], start + gap

    def leave(self) -> None:
        """Hands what is open on to the next round, ids included."""
        place = 0
        for w in self.open:
            for p in w[1]:
                self.rows.append(self._row(p, None, 0, place, True))
                place += 1
        self.open = []

    def finish(self) -> None:
        """Cuts the last tokens into windows of powers of two."""
        rest = [p for w in self.open for p in w[1]]
        left, self.open = sum(len(p[3]) // 4 for p in rest), []
        while left:
            want = min(self.window, 1 << (left.bit_length() - 1))
            left, pieces = left - want, []
            while want:
                doc, start, total, ids = rest[0]
                n = min(want, len(ids) // 4)
                pieces.append((doc, start, total, ids[: 4 * n]))
                rest[0] = (doc, start + n, total, ids[4 * n :])
                if not rest[0][3]:
                    rest.pop(0)
                want -= n
            self._emit(pieces)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True)], list(_FIELDS))


def _first_id(round_: int, part: int) -> int:
    return (round_ << 58) | (part << 26)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, open_windows: int = 16, closing_id: int = 1) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, closing_id).encode
        packer = Packer(window, open_windows, _first_id(0, part), part)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                some = b.slice(i, 2000)
                for doc, ids in zip(some.column("doc_id").to_pylist(), encode(some.column("text").to_pylist()), strict=True):
                    packer.add(doc, 0, len(ids) // 4, ids)
                yield packer.take()
                pa.default_memory_pool().release_unused()  # else each worker keeps what its largest texts took
        packer.leave()
        yield packer.take()

    done = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, _SCHEMA), "packed")
    parts = [done.filter("sequence_id is not null")]
    left, round_ = done.filter("sequence_id is null"), 0
    most = left.agg(F.max("part")).first()[0]
    while most is not None:
        round_, last = round_ + 1, most < FAN_IN

        def merge(key: tuple, rows: pa.Table, *, round_: int = round_, last: bool = last) -> pa.Table:
            part = key[0].as_py()
            packer = Packer(window, open_windows, _first_id(round_, part), part)
            for r in rows.sort_by([("part", "ascending"), ("place", "ascending")]).select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
                packer.add(r["doc_id"], r["start"], r["doc_tokens"], r["ids"])
            packer.finish() if last else packer.leave()
            return pa.Table.from_batches([packer.take()])

        merged = left.withColumn("group", F.expr(f"part div {FAN_IN}")).groupBy("group").applyInArrow(merge, _SCHEMA)
        merged = staged(merged, "packed-rest")
        parts.append(merged.filter("sequence_id is not null"))
        left = merged.filter("sequence_id is null")
        most = None if last else left.agg(F.max("part")).first()[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
