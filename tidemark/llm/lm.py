"""Language-model scores from a weighted backoff automaton over word n-grams.

Counts of n-grams become a smoothed model, p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m) with h' the history
without its oldest word, down to p(w) = (c(w) + 1) / (N + V + 1). As an automaton: every
history seen in training is a state, every n-gram an arc with its log-probability, and the
failure arc of a state leads to the shorter history at a cost of log m / (c(h) + m).

The model grows with the corpus, so it never lies in one place. Documents are dealt into blocks;
a block asks for the counts of its own different n-grams, the questions are summed by
ranges of the n-gram hash, and the answers return to the block, which builds the part of
the automaton that its texts can reach and traverses them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_text import U, column, mix, slices, word_hashes
from .common import release, stage

#: Bits of an n-gram's hash; the lowest marks single words.
BITS = 56
_TOP = U((1 << BITS) - 1)
_STOP = mix(np.array([0x5354], U))[0]  # both the end of a text and the history before its first word: they are as frequent


@dataclass
class Grams:
    """N-grams of some texts. ``keys[k]`` are those of order k+1 ending at each place; ``valid[k]`` tells where there is one."""

    keys: list[np.ndarray]
    valid: list[np.ndarray]
    bounds: np.ndarray
    tokens: np.ndarray


def grams(b: np.ndarray, offsets: np.ndarray, order: int) -> Grams:
    """Places of a text: the beginning, its words, the end."""
    h, first = word_hashes(b, offsets)
    words = np.diff(first)
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words + 2, out=bounds[1:])
    seq = np.full(bounds[-1], _STOP, U)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[:-1]] = False
    inner[bounds[1:] - 1] = False
    seq[inner] = h
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], words + 2)
    keys, valid, full = [(seq >> U(64 - BITS)) | U(1)], [np.ones(len(seq), bool)], seq
    for k in range(1, order):
        full = np.concatenate([full[:1], mix(full[:-1] * U(0xD6E8FEB86659FD93) + seq[1:] + U(k))])
        keys.append((full >> U(64 - BITS)) & ~U(1))
        valid.append(place >= k)
    return Grams(keys, valid, bounds, words + 1)


@dataclass
class Automaton:
    """The part of the model that some texts reach, as arrays over the places of the texts.

    ``state[k]``: count of the history of k words before a place, 0 where training has no such
    state. ``arc[k]``: count of the arc from there. ``root``: probability without a history.
    """

    state: list[np.ndarray]
    arc: list[np.ndarray]
    root: np.ndarray
    weight: float

    def traverse(self) -> np.ndarray:
        """Log10 probability of every place: the arc out of the longest state, failure arcs taken at their cost where it is missing."""
        p = self.root
        for state, arc in zip(self.state, self.arc):
            p = np.where(state > 0, (arc + self.weight * p) / (state + self.weight), p)
        return np.log10(p)


def _wide(gaps: np.ndarray) -> tuple[int, bytes]:
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return width, np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _narrow(width: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(U)


def _counts(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _uncounts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> U(BITS - 32)) * U(ranges)) >> U(32)


def _block_keys(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """All different keys of a block, sorted, and its slices."""
    buf, offsets = column(texts)
    parts, found = list(slices(buf, offsets)), []
    for _, _, b, o in parts:
        g = grams(b, o, order)
        found.append(np.unique(np.concatenate([k[v] for k, v in zip(g.keys, g.valid)])))
    return (np.unique(np.concatenate(found)) if found else np.zeros(0, U)), parts


_ASK = "range int, block int, first long, width int, gaps binary, counts binary"
_ANSWER = "block int, range int, counts binary, tokens long, words long"


def score(docs: DataFrame, training: Column, doc: str = "doc_id", text: str = "text", order: int = 2, weight: float = 20.0, block_bytes: int = 6_000_000, range_keys: int = 2_500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, training, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` marks the rows to learn from (null counts as false). Tokens are the words of :mod:`bytes_text` and one end
    per text. ``n_known``: tokens that occur in training. ``base_score``: log10 probability
    without any history, add-one smoothed; ``score``: that of the automaton with histories of up
    to ``order - 1`` words and backoff weight ``weight``.

    A block holds about ``block_bytes`` of text, a hash range about ``range_keys`` questions,
    so a task's memory does not grow with the corpus; a frequent n-gram is asked for once
    per block, so no range is hot. N-grams are told apart by 56 bits of a hash.
    Null or empty text is its end alone. Null and repeated ids and repeated rows are scored
    each. Other columns are left out. Without training rows every token has probability 1. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    size = source.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(16, -(-size // block_bytes))
    # about one question for each six bytes of text
    ranges = max(16, -(-size // (6 * range_keys)))
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        keys, _ = _block_keys(table["text"], order)
        learned = table.filter(table["training"])
        buf, offsets = column(learned["text"])
        seen = np.zeros(len(keys), np.int64)
        for _, _, b, o in slices(buf, offsets):
            g = grams(b, o, order)
            # the beginning of a text counts nothing: it is as frequent as the end
            g.valid[0][g.bounds[:-1]] = False
            some, n = np.unique(np.concatenate([k[v] for k, v in zip(g.keys, g.valid)]), return_counts=True)
            seen[np.searchsorted(keys, some)] += n
        cut = np.flatnonzero(np.diff(_range(keys, ranges))) + 1
        rows = []
        for k, n in zip(np.split(keys, cut), np.split(seen, cut)):
            if len(k):
                width, gaps = _wide(np.diff(k))
                rows.append((int(_range(k[:1], ranges)[0]), key[0].as_py(), int(k[0]), width, gaps, _counts(n)))
        names = ("range", "block", "first", "width", "gaps", "counts")
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows) if rows else [[]] * 6, kinds)})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        asked = [np.cumsum(np.concatenate([np.array([f], U), _narrow(w, g)]), dtype=U) for f, w, g in zip(rows["first"], rows["width"], rows["gaps"])]
        every = np.concatenate(asked)
        place = np.argsort(every, kind="stable")
        ordered = every[place]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        totals = np.add.reduceat(np.concatenate([_uncounts(c) for c in rows["counts"]])[place], np.flatnonzero(new))
        own = totals[(ordered[new] & U(1)) == U(1)]
        back = np.empty(len(every), np.int64)
        back[place] = totals[np.cumsum(new) - 1]
        cut = np.cumsum([len(a) for a in asked])[:-1]
        n = len(asked)
        return pa.table({
            "block": pa.array(rows["block"], pa.int32()), "range": pa.array([key[0].as_py()] * n, pa.int32()), "counts": pa.array([_counts(c) for c in np.split(back, cut)], pa.binary()),
            "tokens": pa.array([int(own.sum())] + [0] * (n - 1), pa.int64()), "words": pa.array([int((own > 0).sum())] + [0] * (n - 1), pa.int64())})

    answers = stage(dealt.groupBy("block").applyInArrow(ask, _ASK).groupBy("range").applyInArrow(answer, _ANSWER))
    tokens, words = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("words")).first())
    release(spark)

    def traverse(texts: pa.Table, found: pa.Table) -> pa.Table:
        keys, parts = _block_keys(texts["text"], order)
        got = found.sort_by("range")["counts"].to_pylist()
        counts = np.concatenate([_uncounts(c) for c in got]) if got else np.zeros(0, np.int64)
        out = {n: np.zeros(len(texts), t) for n, t in (("n_tokens", np.int64), ("n_known", np.int64), ("base_score", float), ("score", float))}
        for i, j, b, o in parts:
            g = grams(b, o, order)
            seen = [np.where(v, counts[np.where(v, np.searchsorted(keys, np.where(v, k, keys[0])), 0)], 0) for k, v in zip(g.keys, g.valid)]
            root = (seen[0] + 1.0) / (tokens + words + 1.0)
            states = [np.concatenate([[0], s[:-1]]) for s in seen[:-1]]
            states = [np.where(v, s, 0) for s, v in zip(states, g.valid[1:])]
            logs = Automaton(states, seen[1:], root, weight).traverse()
            base, known = np.log10(root), (seen[0] > 0).astype(np.int64)
            for x in (logs, base, known):
                x[g.bounds[:-1]] = 0
            out["n_tokens"][i:j] = g.tokens
            for name, x in (("score", logs), ("base_score", base), ("n_known", known)):
                out[name][i:j] = np.add.reduceat(x, g.bounds[:-1])
        return pa.table({"doc_id": texts["doc_id"], "training": texts["training"], **{n: pa.array(v) for n, v in out.items()}})

    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(traverse, "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "training", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
