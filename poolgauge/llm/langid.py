"""Language identification with a byte-level convolutional network trained in numpy.

The network reads fixed windows of :data:`WINDOW` bytes: byte classes are
embedded, convolved with filters of several widths, passed through ReLU,
max-pooled over the window and classed by a softmax layer. It is trained on
windows of a bounded, hash-chosen sample of labelled texts.

A whole text is cut into consecutive windows (the last is padded); the text's
class is the one with the greatest mean of window log-probabilities, weighted
by the bytes each window holds, and its score is that class's share after a
softmax over the means.

Applying: embedding and filters fold into one table per filter offset, and two
neighbouring offsets into one table over pairs of classes, so a convolution is
one or two table rows added per byte. The tables are a few MB whatever the
corpus, and are broadcast.

Scale: training reads a sample of distinct texts of every learnable language:
``per_language`` of each, less if that would exceed ``sample_texts`` together,
but ``least_texts`` of each in any case; four windows of each text, drawn by
a hash of the text, so a text that a third of all rows repeat counts once.
Applying is one pass without shuffle.

Defined cases: null text, or text without a letter, is ``und`` with score 1;
without any labelled text every text with letters is ``und`` with score 0;
a null doc_id is not held out and not learned from; rows that repeat a doc_id
are each labelled; of languages with equal means the first by name wins; lang,
source and doc_id take no part in a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge.shipping import ship_code

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 12
#: Bounds of the labelled sample, in distinct texts: of a language, of all together, and what each language has in any case.
PER_LANGUAGE = 1500
SAMPLE_TEXTS = 24_000
LEAST_TEXTS = 100
WINDOWS_PER_TEXT = 4
EPOCHS = 6
BATCH_WINDOWS = 256

_LETTER = re.compile(r"[^\W\d_]")


def _byte_classes() -> np.ndarray:
    """Class 0 is padding; letters of either case share one; digits share one; bytes of UTF-8 sequences have their own."""
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if 97 <= b | 32 <= 122 and b < 128:
            out[b] = 1 + (b | 32) - 97
        elif b in b" \t\n\r\x0b\x0c":
            out[b] = 27
        elif 48 <= b <= 57:
            out[b] = 28
        elif b < 128:
            out[b] = 29
        else:  # second bytes carry the letter: 64 values; lead bytes are told apart by their low bits
            out[b] = 30 + (b & 0x3F) if b < 0xC0 else 94 + (b & 0x1F)
    return out


CLASSES = _byte_classes()
N_CLASSES = 128


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, tables by pair of classes (offsets 0-1, 2-3, ...) and, for an odd width, one by class."""
        all_tables = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            by_offset = [(self.embedding @ f[k]).astype(np.float32) for k in range(w)]
            pairs = [(by_offset[k][:, None, :] + by_offset[k + 1][None, :, :]).reshape(-1, FILTERS) for k in range(0, w - 1, 2)]
            all_tables.append(pairs + ([by_offset[-1]] if w % 2 else []))
        return all_tables

    def pooled(self, classes: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Max-pooled features of windows of classes (n, WINDOW)."""
        pairs = classes[:, :-1].astype(np.int32) * N_CLASSES + classes[:, 1:]
        out = []
        for w, bias, parts in zip(WIDTHS, self.biases, tables, strict=True):
            n = classes.shape[1] - w + 1
            total = parts[0][pairs[:, :n]]
            for k, table in enumerate(parts[1:], 1):
                total += table[pairs[:, 2 * k : 2 * k + n]] if len(table) > N_CLASSES else table[classes[:, 2 * k : 2 * k + n]]
            out.append(np.maximum(total.max(axis=1) + bias, 0))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, classes: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        logits = self.pooled(classes, tables) @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all windows of the texts, the text each belongs to and the bytes it holds."""
    counts = np.array([-(-len(t) // size) for t in texts], dtype=np.int64)
    flat = np.zeros(int(counts.sum()) * size, dtype=np.uint8)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        flat[at : at + len(t)] = CLASSES[np.frombuffer(t, np.uint8)]
        at += n * size
    owner = np.repeat(np.arange(len(texts)), counts)
    held = np.full(len(owner), size, dtype=np.float32)
    last = np.cumsum(counts) - 1
    some = counts > 0
    held[last[some]] = [len(t) - (n - 1) * size for t, n in zip(texts, counts.tolist(), strict=True) if n]
    return flat.reshape(-1, size), owner, held


def train(samples: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on cross-entropy; the same samples in the same order give the same network."""
    languages = sorted({x for _, x in samples})
    rng = np.random.default_rng(seed)
    normal = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    net = Network(languages, normal(N_CLASSES, EMBEDDING, by=0.3), [normal(w, EMBEDDING, FILTERS, by=(w * EMBEDDING) ** -0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), len(languages), by=0.2), np.zeros(len(languages), np.float32))
    net.embedding[0] = 0
    params = [net.embedding, *net.filters, *net.biases, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    x, owner, _ = windows([t for t, _ in samples])
    y = np.array([languages.index(lang) for _, lang in samples])[owner]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            step += 1
            grads = _gradients(net, x[order[a : a + 128]], y[order[a : a + 128]])
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.embedding[0] = 0
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n, size = x.shape
    e = net.embedding[x]
    tops, sums = [], []
    for w, f, b in zip(WIDTHS, net.filters, net.biases, strict=True):
        cols = np.concatenate([e[:, k : size - w + 1 + k] for k in range(w)], axis=2)
        z = cols @ f.reshape(w * EMBEDDING, FILTERS)
        top = z.argmax(axis=1)
        tops.append(top)
        sums.append(np.take_along_axis(z, top[:, None, :], 1)[:, 0] + b)
    pre = np.concatenate(sums, axis=1)
    hidden = np.maximum(pre, 0)
    logits = hidden @ net.out + net.out_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    back = (p @ net.out.T) * (pre > 0)
    ge, gf, gb = np.zeros_like(net.embedding), [], []
    rows = np.arange(n)[:, None]
    for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        parts = []
        for k in range(w):
            at = tops[i] + k
            parts.append(np.einsum("nfe,nf->ef", e[rows, at], g))
            np.add.at(ge, x[rows, at], g[:, :, None] * f[k].T[None])
        gf.append(np.stack(parts))
        gb.append(g.sum(axis=0))
    return [ge, *gf, *gb, hidden.T @ p, p.sum(axis=0)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_texts: int = SAMPLE_TEXTS, least_texts: int = LEAST_TEXTS) -> list[tuple[bytes, str]]:
    """Windows of a bounded sample of the learnable texts, chosen by a hash of the text, in a fixed order.

    Every language is learned. :data:`WINDOWS_PER_TEXT` windows spread over the
    whole length of each chosen text are brought to the driver, never the
    text; a language gives at most its share of distinct texts.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    th = F.xxhash64("text", F.lit("sample"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(th).alias("n")).orderBy("lang").collect()
    if not sizes:
        return []
    most = min(per_language, max(least_texts, sample_texts // len(sizes)))
    # half as many again are drawn, so that an estimate of the count cannot leave too few
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * most / max(1, r["n"]))))])
    draw = F.pmod(th, F.lit(1_000_000)) / 1_000_000
    picked = known.select("lang", "text", th.alias("th"), draw.alias("draw")).where(F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(-1.0)) > F.col("draw"))
    last = F.greatest(F.length("text") - WINDOW, F.lit(0))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_TEXT - 1)), lambda k: F.floor(last * k / (WINDOWS_PER_TEXT - 1)).cast("int")))
    parts = F.transform(places, lambda at: F.substring(F.col("text"), at + 1, F.lit(WINDOW)))
    each = picked.select("lang", "th", "draw", parts.alias("parts")).groupBy("lang", "th", "draw").agg(F.min("parts").alias("parts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "th"))
    rows = each.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "parts").collect()
    rows.sort(key=lambda r: (r["lang"], r["rank"]))
    return [(p.encode("utf-8")[:WINDOW], r["lang"]) for r in rows for p in r["parts"] if p]


def classify(texts: list[str | None], net: Network | None, tables: list) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts."""
    lettered = [t is not None and _LETTER.search(t) is not None for t in texts]
    names, scores = ["und"] * len(texts), np.where(lettered, 0.0, 1.0)
    mine = np.flatnonzero(lettered)
    if net is None or not len(mine):
        return names, scores
    total = np.zeros((len(mine), len(net.languages)))
    weight = np.zeros(len(mine))
    done, group, size = 0, [], 0

    def flush() -> None:
        nonlocal done, group, size
        x, owner, held = windows(group)
        for a in range(0, len(x), BATCH_WINDOWS):
            part = slice(a, a + BATCH_WINDOWS)
            np.add.at(total, done + owner[part], net.log_probabilities(x[part], tables) * held[part, None])
        np.add.at(weight, done + owner, held)
        done, group, size = done + len(group), [], 0

    for k in mine.tolist():
        group.append(texts[k].encode("utf-8"))
        size += len(group[-1])
        if size >= 1 << 20:
            flush()
    flush()
    mean = total / weight[:, None]
    best = mean.argmax(axis=1)
    share = np.exp(mean - mean.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    for k, b, s in zip(mine.tolist(), best.tolist(), share.max(axis=1).tolist(), strict=True):
        names[k], scores[k] = net.languages[b], s
    return names, scores


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables() if net else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                names, scores = classify(part.column(2).to_pylist(), model, tables)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the learnable part of ``docs`` and label all of it."""
    samples = sample(docs)
    return predict(docs, train(samples) if samples else None)
