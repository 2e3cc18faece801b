"""Quality classifier: a convolutional network over bytes, in numpy.

Every byte has a learned vector, to which a learned echo vector is added where the ECHO bytes that start there
also start at most LAGS bytes earlier (filters alone cannot tell that a word is said again). Learned filters of
WIDTH bytes slide over the whole document at every STRIDE bytes. Chunks of two segments, each overlapping the
next by one segment, keep each filter's greatest response; a document's features are the greatest and the mean
chunk response of each filter, and one logistic unit turns them into a probability. Nothing but the bytes of
the text is an input.

A filter's response is a sum of one table row for each of its bytes (byte vector times filter slice), so scoring
is WIDTH gathers for each position. Only the positions that won their chunk carry gradient, so training costs
little more than scoring. Training runs on the driver over every byte of a bounded number of labelled rows;
scoring runs in Arrow batches. Both look at a bounded slice of a text at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import one_each, tidied

#: Filter width and step in bytes, bytes in a segment (a chunk is two), filters, numbers in a byte's vector.
WIDTH, STRIDE, SEGMENT, FILTERS, VECTOR = 8, 2, 256, 24, 8
#: Bytes that must agree for an echo, and the greatest distance at which they are looked for.
ECHO, LAGS = 6, 32
#: Symbols: bytes, bytes with an echo, and what follows the end of a text, whose vector is zero.
PAD = 512
#: Segments of one text that are looked at together.
BLOCK = 256


@dataclass
class Network:
    vectors: np.ndarray  # (256, VECTOR)
    echo: np.ndarray  # (VECTOR,)
    filters: np.ndarray  # (WIDTH, VECTOR, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    shift: float

    def tables(self) -> np.ndarray:
        return np.einsum("bv,wvf->wbf", self.symbols(), self.filters).astype(np.float32)

    def symbols(self) -> np.ndarray:
        return np.vstack([self.vectors, self.vectors + self.echo, np.zeros((1, VECTOR))])


def padded(raw: bytes) -> tuple[np.ndarray, int]:
    """The symbols, then PAD up to whole segments and one filter's width more; the number of segments (one at least)."""
    segments = max(1, -(-len(raw) // SEGMENT))
    out = np.full(segments * SEGMENT + WIDTH, PAD, np.int16)
    data = np.frombuffer(raw, np.uint8)
    out[: len(raw)] = data
    if len(raw) > ECHO:
        n = len(raw) - ECHO + 1
        grams = data[:n].astype(np.uint64)
        for k in range(1, ECHO):
            grams |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        again = np.zeros(n, bool)
        for lag in range(1, min(LAGS, n - 1) + 1):
            again[lag:] |= grams[lag:] == grams[:-lag]
        out[:n] += again.astype(np.int16) << 8
    return out, segments


def responses(tables: np.ndarray, data: np.ndarray, segments: int) -> np.ndarray:
    """(segments, positions in a segment, FILTERS): every filter at every position of consecutive segments."""
    n = segments * SEGMENT // STRIDE
    total = tables[0].take(data[0 : n * STRIDE : STRIDE], axis=0)
    for w in range(1, WIDTH):
        total += tables[w].take(data[w : w + n * STRIDE : STRIDE], axis=0)
    return total.reshape(segments, SEGMENT // STRIDE, FILTERS)


def segment_maxima(tables: np.ndarray, data: np.ndarray, segments: int) -> np.ndarray:
    parts = []
    for first in range(0, segments, BLOCK):
        last = min(segments, first + BLOCK)
        parts.append(responses(tables, data[first * SEGMENT : last * SEGMENT + WIDTH], last - first).max(axis=1))
    return np.concatenate(parts)


def segment_winners(tables: np.ndarray, data: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """segment_maxima, and the first position in its segment at which each filter reaches it."""
    top, where = [], []
    for first in range(0, segments, BLOCK):
        last = min(segments, first + BLOCK)
        all_ = responses(tables, data[first * SEGMENT : last * SEGMENT + WIDTH], last - first)
        where.append(all_.argmax(axis=1))
        top.append(np.take_along_axis(all_, where[-1][:, None, :], 1)[:, 0])
    return np.concatenate(top), np.concatenate(where)


def features(top: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk responses from segment maxima, and the document's (greatest, mean) features."""
    chunks = np.maximum(top[:-1], top[1:]) if len(top) > 1 else top
    chunks = np.maximum(chunks + bias, 0)
    return chunks, np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])


def score(net: Network, raw: bytes, tables: np.ndarray | None = None) -> float:
    """The probability that a text is of label 1."""
    data, segments = padded(raw)
    _, doc = features(segment_maxima(net.tables() if tables is None else tables, data, segments), net.bias)
    return float(1 / (1 + np.exp(-np.clip(doc @ net.out + net.shift, -30, 30))))


def train(texts: list[bytes], labels: list[int], epochs: int = 14, batch: int = 16, rate: float = 4e-3, least_steps: int = 1_500, seed: int = 10) -> Network:
    """Fit by Adam on the logistic loss, with more epochs if they would make fewer than least_steps steps.

    Every byte of every text is trained on, as it is scored. With one class only the probability is that class's. The result
    depends on the order of the rows and on seed.
    """
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, VECTOR)),
        rng.normal(0, 0.5, VECTOR),
        rng.normal(0, 1 / np.sqrt(WIDTH * VECTOR), (WIDTH, VECTOR, FILTERS)),
        np.zeros(FILTERS),
        rng.normal(0, 0.1, 2 * FILTERS),
        0.0,
    )
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.shift = 10.0 if set(labels) == {1} else -10.0 if labels else 0.0
        return net
    shown = [padded(raw) for raw in texts]
    names = ("vectors", "echo", "filters", "bias", "out", "shift")
    first = {k: np.zeros_like(getattr(net, k), dtype=float) for k in names}
    second = {k: np.zeros_like(getattr(net, k), dtype=float) for k in names}
    step, y = 0, np.asarray(labels, float)
    a_pass = -(-len(shown) // batch)
    epochs = max(epochs, -(-least_steps // a_pass))
    total = epochs * a_pass
    for _ in range(epochs):
        order = rng.permutation(len(shown))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            grads = _gradients(net, [shown[i] for i in chosen], y[chosen])
            step += 1
            pace = rate * (1 - 0.9 * step / total)
            for k in names:
                g = grads[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                change = pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - change)
    net.shift = float(net.shift)
    return net


def _gradients(net: Network, rows: list[tuple[np.ndarray, int]], y: np.ndarray) -> dict[str, np.ndarray]:
    """Mean gradients of the logistic loss over a few documents, which are scored side by side."""
    tables, symbols = net.tables(), net.symbols()
    out = {"vectors": np.zeros_like(net.vectors), "echo": np.zeros_like(net.echo), "filters": np.zeros_like(net.filters), "bias": np.zeros_like(net.bias), "out": 1e-4 * net.out, "shift": np.zeros(())}
    for (data, segments), want in zip(rows, y, strict=True):
        top, where = segment_winners(tables, data, segments)
        chunks, doc = features(top, net.bias)
        err = (1 / (1 + np.exp(-np.clip(doc @ net.out + net.shift, -30, 30))) - want) / len(rows)
        out["out"] = out["out"] + err * doc
        out["shift"] = out["shift"] + err
        d_chunks = np.full_like(chunks, 0) + err * net.out[FILTERS:] / len(chunks)
        d_chunks[chunks.argmax(axis=0), np.arange(FILTERS)] += err * net.out[:FILTERS]
        d_chunks *= chunks > 0
        out["bias"] += d_chunks.sum(axis=0)
        d_top = np.zeros_like(top)
        if len(top) > 1:
            left = top[:-1] >= top[1:]
            np.add(d_top[:-1], np.where(left, d_chunks, 0), out=d_top[:-1])
            np.add(d_top[1:], np.where(left, 0, d_chunks), out=d_top[1:])
        else:
            d_top += d_chunks
        for at in range(0, segments, BLOCK):
            seg, fil = np.nonzero(d_top[at : at + BLOCK])
            if not len(seg):
                continue
            seg += at
            grad = d_top[seg, fil]
            starts = seg * SEGMENT + where[seg, fil] * STRIDE
            for w in range(WIDTH):
                seen = data[starts + w]
                # by (symbol, filter), then through the product symbols x filters
                cell = np.bincount(seen.astype(np.int64) * FILTERS + fil, grad, (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
                back = cell[:PAD] @ net.filters[w].T
                out["vectors"] += back[:256] + back[256:]
                out["echo"] += back[256:].sum(axis=0)
                out["filters"][w] += symbols.T @ cell
    return out


def held_out(key: Column) -> Column:
    """Rows that never teach: the checksum of the key as text leaves 1 when divided by 3; a null key never teaches."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int) -> list[tuple[int, bytes]]:
    """(label, whole text) of at most max_rows labelled keys that may teach, those whose hash is smallest, in that order.

    Of rows with the same key the one with the least text teaches.
    """
    few = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_k"))
        .agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_k"), "_k")
        .limit(max_rows)
    )
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(few), "_k")  # max_rows pairs of numbers
    found = one_each(rows, "_k", "_text", "_label").select(F.xxhash64("_k").alias("_h"), "_k", "_label", "_text").collect()
    return [(r._label, r._text.encode("utf-8")) for r in sorted(found, key=lambda r: (r._h, r._k, r._text))]


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 3_000, **kwargs) -> Network:
    """Train on a bounded sample of the labelled rows that are not held out."""
    rows = sample(df, labels, key, text, label, max_rows)
    return train([raw for _, raw in rows], [y for y, _ in rows], **kwargs)


def classify(df: DataFrame, net: Network, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, held_out, score, predicted and the carried columns, one row for each row of df.

    The score reads every byte of the text; a null or empty text is all padding and scores what that gives.
    """
    tables = net.tables()
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    kept = [key, *(c for c in carry if c != key)]
    sent = kept if text in kept else [*kept, text]
    at_text = sent.index(text)
    schema = ", ".join(f"`_c{i}` {kind[c]}" for i, c in enumerate(kept)) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text)
            scores = []
            for at in range(0, len(texts), 256):
                scores += [score(net, (t or "").encode("utf-8"), tables) for t in texts.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores, pa.float64())], [*(f"_c{i}" for i in range(len(kept))), "score"])

    scored = df.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(sent))).mapInArrow(tidied(run), schema)
    return scored.select(
        F.col("_c0").alias(key),
        held_out(F.col("_c0")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept) if i),
    )


def crc_fold(key: int) -> int:
    """The fold of a key as the held-out rule sees it, for tests."""
    return zlib.crc32(str(key).encode()) % 3
