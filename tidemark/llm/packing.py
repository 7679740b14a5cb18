"""Packing of token sequences into windows of fixed length, in bounded space."""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Texts holding this string go to the tokenizer whole, which reads it as one token.
_SPECIAL = "<|endoftext|>"
_SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, open int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.int32())])


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, as the tokenizer gives them.

    No token reaches across a single space that stands between two other characters, so a
    text is cut there and the ids of frequent words are remembered; the memory has a
    fixed number of entries, words beyond it are encoded each time, many in one call.
    """

    # Fixed value: the published split pattern of byte-level vocabularies.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word != _SPECIAL}
        self.fast = Encoding("words", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(w) for w in ranks]
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _joined(self, units: list[str]) -> list[bytes]:
        """Ids of words that all begin with a space, from one call: tokens are dealt back by their bytes."""
        ids = self.fast.encode_to_numpy("".join(units), disallowed_special=()).astype("<u4")
        ends = np.cumsum([len(u.encode()) for u in units])
        at = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        return [ids[a:z].tobytes() for a, z in zip([0, *at[:-1]], at)]

    def encode(self, texts: list[str]) -> list[bytes]:
        known, heads, held, new = self.known.get, [], [], set()
        for text in texts:
            if _SPECIAL in text:
                heads.append(np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                held.append(([], []))
                continue
            # where white space stands on both sides of a space, only clean cuts are taken
            head, *rest = re.split(r"(?<=\S) (?=\S)", text) if re.search(r"\s \s|\s $", text) else text.split(" ")
            heads.append(self.fast.encode_to_numpy(head, disallowed_special=()).astype("<u4").tobytes())
            got = list(map(known, rest))
            new.update([u for u, g in zip(rest, got) if g is None])
            held.append((rest, got))
        if not new:
            return [h + b"".join(got) for h, (_, got) in zip(heads, held)]
        words = list(new)
        extra = dict(zip(words, self._joined([" " + u for u in words])))
        room = self.remembered - len(self.known)
        if room > 0:
            self.known.update(list(extra.items())[:room])
        return [h + b"".join([extra[u] if g is None else g for u, g in zip(*ug)]) for h, ug in zip(heads, held)]


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary. Task functions travel by value and have no globals that last, so it is kept with the library it wraps."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class Packer:
    """A fixed number of open windows. Pieces are (doc_id, start, ids, doc_tokens).

    A piece goes to the fullest window that still holds it. When none does, a new window
    is opened, or, with all in use, the fullest is emitted first, after its rest, if
    that is ``least`` ids or more, has been filled with the head of the piece.
    """

    def __init__(self, length: int, windows: int, least: int):
        self.length, self.windows, self.least = length, windows, least
        self.open: list[tuple[int, int]] = []  # (free, key), ascending: the fullest first
        self.held: dict[int, list[tuple]] = {}
        self.key = 0

    def _put(self, free: int, key: int, piece: tuple) -> Iterator[list[tuple]]:
        self.held[key].append(piece)
        free -= len(piece[2]) // 4
        if free:
            bisect.insort(self.open, (free, key))
        else:
            yield self.held.pop(key)

    def add(self, doc_id, ids: bytes) -> Iterator[list[tuple]]:
        total = len(ids) // 4
        for a in range(0, total, self.length):
            yield from self._place((doc_id, a, ids[4 * a:4 * (a + self.length)], total))

    def _place(self, piece: tuple) -> Iterator[list[tuple]]:
        n = len(piece[2]) // 4
        if n == self.length:
            yield [piece]
            return
        at = bisect.bisect_left(self.open, (n, -1))
        if at < len(self.open):
            yield from self._put(*self.open.pop(at), piece)
            return
        if len(self.open) == self.windows:
            free, key = self.open.pop(0)
            if free >= self.least:
                doc, start, ids, total = piece
                self.held[key].append((doc, start, ids[:4 * free], total))
                piece = (doc, start + free, ids[4 * free:], total)
                n -= free
            yield self.held.pop(key)
        self.key += 1
        self.held[self.key] = []
        yield from self._put(self.length, self.key, piece)

    def close(self) -> tuple[list[list[tuple]], list[tuple]]:
        """Merge what is open: (full windows, pieces of the one that is not full)."""
        left = [p for _, key in self.open for p in self.held.pop(key)]
        self.open = []
        full, now, free = [], [], self.length
        for doc, start, ids, total in left:
            while ids:
                take = ids[:4 * free]
                now.append((doc, start, take, total))
                start, ids, free = start + len(take) // 4, ids[len(take):], free - len(take) // 4
                if not free:
                    full.append(now)
                    now, free = [], self.length
        return full, now


def _rows(windows: list[list[tuple]], first: int, open_: int | None) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(7)]
    for n, window in enumerate(windows):
        at = 0
        for doc, start, ids, total in window:
            for c, v in zip(cols, (doc, start, ids, total, first + n, at, open_)):
                c.append(v)
            at += len(ids) // 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _powers(pieces: list[tuple]) -> list[list[tuple]]:
    """Cut the last window into windows of falling powers of two, so that none of them is padded."""
    left, out = list(pieces), []
    total = sum(len(p[2]) // 4 for p in left)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        now = []
        while size:
            doc, start, ids, n = left.pop(0)
            take = ids[:4 * size]
            now.append((doc, start, take, n))
            size -= len(take) // 4
            if len(take) < len(ids):
                left.insert(0, (doc, start + len(take) // 4, ids[len(take):], n))
        out.append(now)
    return out


def pack(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1,
         windows: int = 64, least: int = 16, fan_in: int = 64) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers vocabulary file that every executor can read.
    Every scan partition packs its own documents with ``windows`` open windows and no
    shuffle (see :class:`Packer`); at its end the open windows are merged by cutting, which leaves
    at most one window that is not full. These leftovers, one per partition, are merged
    ``fan_in`` at a time until one is left, which is cut into windows whose lengths are
    powers of two. Windows hold ``length`` ids, at least ``length - least + 1`` where one
    was emitted early, or a power of two.

    Null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed each for
    itself. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    end = np.asarray([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a part number above 2^31 is not reached, nor 2^32 windows in one part
        base, made, packer, coder, done = TaskContext.get().partitionId() << 32, 0, Packer(length, windows, least), encoder(tokenizer), []
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                for i, ids in zip(part.column(0).to_pylist(), coder.encode([t or "" for t in part.column(1).to_pylist()])):
                    done.extend(packer.add(i, ids + end))
                if len(done) >= 256:
                    yield _rows(done, base + made, None)
                    made, done = made + len(done), []
        full, rest = packer.close()
        yield _rows(done + full, base + made, None)
        if rest:
            yield _rows([rest], base + made + len(done) + len(full), int(base >> 32))

    parts = stage(source.mapInArrow(first, _SCHEMA))
    packed = parts.filter("open IS NULL")
    left, level = parts.filter("open IS NOT NULL"), 0
    count = (left.agg(F.max("open")).first()[0] or 0) + 1
    last = None
    while last is None:
        level += 1
        only = count <= fan_in

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            base, packer, made = (1 << 62) + (level << 56) + (int(key[0].as_py()) << 24), Packer(length, windows, least), []
            rows = table.sort_by([("open", "ascending"), ("offset", "ascending")]).to_pydict()
            kept: dict[int, list[tuple]] = {}
            for o, *piece in zip(rows["open"], rows["doc_id"], rows["start"], rows["ids"], rows["doc_tokens"]):
                kept.setdefault(o, []).append(tuple(piece))
            for pieces in kept.values():
                for p in pieces:
                    made.extend(packer._place(p))
            full, rest = packer.close()
            made += full + (_powers(rest) if only else [])
            out = [_rows(made, base, None)]
            if rest and not only:
                out.append(_rows([rest], base + len(made), int(key[0].as_py())))
            return pa.Table.from_batches(out, _ARROW)

        merged = stage(left.withColumn("g", F.expr(f"open div {fan_in}")).groupBy("g").applyInArrow(merge, _SCHEMA))
        packed = packed.unionByName(merged.filter("open IS NULL"))
        if only:
            last = merged
        left, count = merged.filter("open IS NOT NULL"), -(-count // fan_in)
    return packed.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")
