"""Mixing documents to target weights of domains that are known only softly."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_text import LOWER, column, slices, word_bounds
from .common import stage

#: Hashed byte pairs that the classifier counts.
CELLS = 4096


def pair_counts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, CELLS) counts of neighbouring bytes, A-Z lower-cased; no pair reaches across texts."""
    n = len(offsets) - 1
    low = LOWER[b].astype(np.int64)
    cell = ((low[:-1] * 257 + low[1:]) * 40503 >> 4) % CELLS
    doc = np.repeat(np.arange(n), np.diff(offsets))
    same = doc[:-1] == doc[1:]
    return np.bincount(doc[:-1][same] * CELLS + cell[same], minlength=n * CELLS).reshape(n, CELLS)


@dataclass
class Domains:
    """A multinomial model of byte pairs per domain. ``sharpness``: the weight of the mean log-likelihood ratio against the prior."""

    names: list[str]
    prior: np.ndarray
    logs: np.ndarray
    sharpness: float = 60.0

    def posterior(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities per text, rows summing to 1; the prior where a text has no pair."""
        pairs = np.maximum(counts.sum(1, keepdims=True), 1)
        z = np.log(self.prior) + (counts @ self.logs.T) / pairs * np.minimum(self.sharpness, pairs)
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def learn(docs: DataFrame, labelled: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "domain", sample_rows: int = 20_000) -> Domains:
    """The model from at most ``sample_rows`` rows of the labelled table (id, domain), those with the smallest hash of their id.

    Counts are summed in the cluster; one row of counts per domain reaches the driver. Null ids and domains
    are left out, of several domains of an id the first in order counts. Without labelled rows there is one domain, the empty name.
    """
    named = labelled.select(F.col(doc).cast("long").alias("doc_id"), F.col(label).cast("string").alias("domain")).dropna().groupBy("doc_id").agg(F.min("domain").alias("domain"))
    named = stage(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            kinds = np.array(batch.column(0).to_pylist(), object)
            for i, j, b, o in slices(*column(batch.column(1)), 1 << 18):
                for a in range(i, j, 512):
                    z = min(j, a + 512)
                    c = pair_counts(b[o[a - i]:o[z - i]], o[a - i:z - i + 1] - o[a - i])
                    for d in set(kinds[a:z]):
                        held = total.setdefault(d, [0, np.zeros(CELLS, np.int64)])
                        held[0] += int((kinds[a:z] == d).sum())
                        held[1] += c[kinds[a:z] == d].sum(0)
        rows = [(d, -1, n) for d, (n, _) in total.items()] + [(d, int(x), int(c[x])) for d, (_, c) in total.items() for x in np.flatnonzero(c)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.int32(), pa.int64()))], names=["domain", "cell", "n"])

    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # at most sample_rows short rows are broadcast
    counts = source.join(F.broadcast(named), "doc_id").select("domain", "text").mapInArrow(local, "domain string, cell int, n long").groupBy("domain", "cell").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["domain"] for r in counts}) or [""]
    table, rows = np.full((len(names), CELLS), 0.5), np.ones(len(names))
    for r in counts:
        if r["cell"] < 0:
            rows[names.index(r["domain"])] += r["n"]
        else:
            table[names.index(r["domain"]), r["cell"]] += r["n"]
    return Domains(names, rows / rows.sum(), np.log(table / table.sum(1, keepdims=True)))


def memberships(docs: DataFrame, model: Domains, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (hash of id and text), n_tokens (words plus one), posterior (in the order of the model's names) per row."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, o in slices(*column(batch.column(2)), 1 << 18):
                _, _, first = word_bounds(b, o)
                p = np.concatenate([model.posterior(pair_counts(b[o[a]:o[z]], o[a:z + 1] - o[a])) for a in range(0, j - i, 512) for z in [min(j - i, a + 512)]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first) + 1), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))], names=["doc_id", "row", "n_tokens", "posterior"])

    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(F.col(doc).cast("string"), F.col(text).cast("string")).alias("row"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(local, "doc_id long, row long, n_tokens long, posterior array<double>")


def fold(posterior: np.ndarray, steps: list[np.ndarray], hold: float, least: float) -> np.ndarray:
    """Rates after the given gradient steps, from 1 on: each step moves a rate against the gaps of its domains and back to 1 a little, then onto what is allowed."""
    rate = np.maximum(np.ones(len(posterior)), least)
    for gap in steps:
        rate = np.maximum(rate - posterior @ gap - hold * (rate - 1), least)
    return rate


def rates(held: DataFrame, model: Domains, targets: dict[str, float], least: float = 0.0, hold: float = 1e-4, rounds: int = 40, close: float = 1e-4) -> DataFrame:
    """``held`` (see :func:`memberships`) with a column ``rate``: expected copies of each document.

    Minimises the squared relative gaps between the expected tokens of the domains, sums of
    rate * tokens * posterior, and the targets, and slightly the distance of the rates from 1,
    over rates of at least ``least``, by projected gradient steps. ``targets`` are weights by domain name;
    domains without one get none. With ``least`` 0 the whole is as large as the corpus; otherwise
    just as large that no domain need lose, so documents can stay whole.
    A step is one pass over the staged memberships that returns one sum per domain; a rate follows from the
    steps alone, so nothing is written between them. Ends when every gap is below ``close`` of its target, or after ``rounds`` steps with a warning that names the gaps left.
    """
    k = len(model.names)
    weight = np.array([max(0.0, targets.get(n, 0.0)) for n in model.names])
    weight = weight / weight.sum() if weight.sum() > 0 else np.full(k, 1 / k)

    def totals(steps: list[np.ndarray]) -> np.ndarray:
        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                total += (fold(p, steps, hold, least) * batch.column(0).to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["domain", "n"])

        rows = held.select("n_tokens", "posterior").mapInArrow(local, "domain int, n double").groupBy("domain").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(k)
        for r in rows:
            out[r["domain"]] = r["n"]
        return out

    natural = totals([])
    whole = natural.sum()
    if whole > 0 and least > 0:
        whole = max(whole, float((natural[weight > 0] / weight[weight > 0]).max()) * min(least, 1.0))
    target = whole * weight
    size, steps, now = np.maximum(natural, max(natural.sum(), 1.0) * 1e-9), [], natural
    for _ in range(rounds):
        if (np.abs(now - target) <= close * np.maximum(target, 1e-9 * max(whole, 1.0))).all():
            break
        steps.append((now - target) / size)
        now = totals(steps)
    else:
        left = {n: round(float((a - b) / max(b, 1.0)), 6) for n, a, b in zip(model.names, now, target)}
        warnings.warn(f"after {rounds} steps the expected tokens still miss the targets by these shares: {left}", stacklevel=2)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
            yield batch.append_column("rate", pa.array(fold(p, steps, hold, least)))

    kinds = ", ".join(f"{n} {t}" for n, t in held.dtypes)
    return held.mapInArrow(local, f"{kinds}, rate double")


def copies(rate: Column, row: Column) -> Column:
    """Whole copies of an expected number: the fraction becomes one more by a draw that the row decides."""
    draw = F.pmod(F.xxhash64(row, F.lit("copies")), F.lit(1 << 32)) / float(1 << 32)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc: str = "doc_id", text: str = "text", label: str = "domain", least: float = 0.0, sample_rows: int = 20_000) -> tuple[Domains, DataFrame]:
    """(model, table) of doc_id, row, n_tokens, posterior, rate, copies for every row of ``docs``.

    Null and empty texts have one token and the prior as posterior. Repeated rows get the same rate each.
    Null ids are kept. An empty table gives no rows. Other columns are left out.
    """
    model = learn(docs, labelled, doc, text, label, sample_rows)
    held = stage(memberships(docs, model, doc, text))
    return model, rates(held, model, targets, least).withColumn("copies", copies(F.col("rate"), F.col("row")))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc: str = "doc_id", text: str = "text", label: str = "domain", least: float = 0.0, sample_rows: int = 20_000) -> DataFrame:
    """``docs`` with every row as often as its rate says, all columns kept. See :func:`mix_rates`."""
    _, table = mix_rates(docs, labelled, targets, doc, text, label, least, sample_rows)
    times = stage(table.groupBy("row").agg(F.max("copies").alias("__times")).filter("__times > 0").withColumnRenamed("row", "__row"))
    named = docs.withColumn("__row", F.xxhash64(F.col(doc).cast("string"), F.col(text).cast("string")))
    return named.join(times, "__row").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__row", "__times", "__n")
