"""Language identification: sparse multinomial logistic regression on TF-IDF of characters.

Features are hashed runs of one to three characters of the lower-cased text, everything that
isn't a letter being one blank. A text is the mean over its runs of their inverse document
frequencies, each at the place of its feature. Document frequencies are counted over all
training documents. The weights are fitted by follow-the-regularised-leader (per-coordinate
rates, elastic net: the L1 part makes weights zero, the L2 part keeps them small) on a sample
of at most about `per_lang` training documents of each language and `most_rows` in all, drawn
by a hash of the row; a fifth of the sample is kept back to fit the temperature that calibrates
probabilities. Its targets are smoothed as for one more row of either kind, so that languages
that are told apart without error have a temperature too.

What is collected is bounded: document frequencies by the number of features, the sample by
`most_rows`, and the weights by features x `most_langs`; more languages are refused.

Defined results: null text and text without a letter are `und` with score 0; without any
training row all are `und`; documents of null id or null language are predicted like others
(those of null language aren't learned from); empty tables give no rows. Whole texts are
read. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoflock.llm.common import lean

FEATURES = 1 << 16
PIECE = 1 << 19
BLANK = 32


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts in a row, and where each text's features start (and the end)."""
    # a text begins with a blank of its own; the next one's ends it
    lowered = [" " + t.lower() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.append(np.where(letters()[code], code, BLANK), BLANK).astype(np.uint32)
    a, b, c = code, np.append(code[1:], BLANK), np.append(code[2:], [BLANK, BLANK])[: len(code)]
    mult = np.uint32(0x9E3779B1)
    h1 = a * mult
    h2 = (h1 ^ b) * np.uint32(0x85EBCA6B)
    h3 = (h2 ^ c) * np.uint32(0xC2B2AE35)
    ids = np.stack([(h >> np.uint32(7)) % np.uint32(FEATURES) for h in (h1, h2 + np.uint32(1), h3 + np.uint32(2))], 1)
    use = np.stack([a != BLANK, (a != BLANK) | (b != BLANK), b != BLANK], 1)
    counts = use.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(counts)])[first]
    return ids[use], starts


def pieces(column: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    texts = [t or "" for t in column.to_pylist()]
    row = 0
    while row < len(texts):
        stop, size = row, 0
        while stop < len(texts) and (stop == row or size + len(texts[stop]) <= PIECE):
            size += len(texts[stop])
            stop += 1
        part = texts[row:stop]
        yield row, part, *grams(part)
        row = stop


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x langs, times the inverse document frequencies
    bias: np.ndarray
    temperature: float

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.diff(starts)
        out = np.tile(self.bias, (len(n), 1)).astype(np.float64)
        some = np.flatnonzero(n)
        if len(some):
            for k in range(len(self.langs)):
                sums = np.add.reduceat(self.weights[ids, k], starts[:-1][some], dtype=np.float64)
                out[some, k] += sums / n[some]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(column))
        table = letters()
        for row, texts, ids, starts in pieces(column):
            if not self.langs:
                langs += ["und"] * len(texts)
                continue
            p = softmax(self.logits(ids, starts) / self.temperature)
            best = p.argmax(axis=1)
            n = np.diff(starts)
            for k, t in enumerate(texts):
                known = n[k] > 0 and any(table[ord(c)] for c in t)
                langs.append(self.langs[best[k]] if known else "und")
                scores[row + k] = p[k, best[k]] if known else 0.0
        return langs, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for _, _, ids, starts in pieces(batch.column("text")):
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if b - a > 4000:
                        df[np.flatnonzero(np.bincount(ids[a:b], minlength=FEATURES))] += 1
                    else:
                        df[np.unique(ids[a:b])] += 1
            n += batch.num_rows
        df[FEATURES] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["feature", "n"])

    rows = train.select("text").mapInArrow(lean(count), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    table = rows.toArrow().to_pydict()
    df = np.zeros(FEATURES + 1, np.int64)
    df[table["feature"]] = table["n"]
    return df[:FEATURES], int(df[FEATURES])


def sample(train: DataFrame, per_lang: int, most_langs: int, most_rows: int) -> tuple[list[str], list[tuple]]:
    """The languages, and (language, features, their counts) of a bounded sample."""
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(most_langs + 1).collect()
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not counts:
        return [], []
    per_lang = min(per_lang, most_rows // len(counts))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1.0, per_lang / r.n))).otherwise(share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for _, _, f, starts in pieces(batch.column("text")):
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    i, n = np.unique(f[a:b], return_counts=True)
                    ids.append(i.astype(np.uint16).tobytes())
                    counts.append(n.astype(np.uint32).tobytes())
            order = batch.column("order")
            yield pa.RecordBatch.from_arrays(
                [order, batch.column("lang"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                ["order", "lang", "ids", "counts"],
            )

    drawn = train.where(spread < share).select(F.xxhash64("text", "doc_id").alias("order"), "lang", "text")
    rows = drawn.mapInArrow(lean(features), "order long, lang string, ids binary, counts binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["order"], r["lang"], r["ids"]))
    return [r.lang for r in counts], [
        (r["lang"], np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["counts"], np.uint32)) for r in rows
    ]


def ftrl(
    rows: list[tuple[int, np.ndarray, np.ndarray]],
    classes: int,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.002,
    l2: float = 0.1,
    epochs: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after `epochs` passes over rows of (class, features, values)."""
    z, n = np.zeros((FEATURES + 1, classes), np.float32), np.zeros((FEATURES + 1, classes), np.float32)

    def weights(i: np.ndarray) -> np.ndarray:
        penalty = np.where(i == FEATURES, 0.0, l1)[:, None]
        w = (np.sign(z[i]) * penalty - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) > penalty, w, 0.0)

    for _ in range(epochs):
        for y, i, x in rows:
            i, x = np.append(i.astype(np.int64), FEATURES), np.append(x, 1.0)
            w = weights(i)
            p = softmax((x @ w)[None, :])[0]
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(FEATURES + 1))
    return w[:FEATURES], w[FEATURES]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """What logits are to be divided by for the least log loss against smoothed targets: golden-
    section search."""
    rows, classes = z.shape
    if classes < 2:
        return 1.0
    slip = 1.0 / (rows + 2)
    target = np.full(z.shape, slip / (classes - 1))
    target[np.arange(rows), y] = 1 - slip

    def loss(log_t: float) -> float:
        x = z / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float((target * (np.log(np.exp(x).sum(axis=1, keepdims=True)) - x)).sum(axis=1).mean())

    a, b, g = np.log(1e-3), np.log(1e3), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 1500,
    most_langs: int = 200,
    most_rows: int = 24_000,
    scale: float = 20.0,
) -> Model:
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training(F.col("doc_id")))
    langs, rows = sample(train, per_lang, most_langs, most_rows)
    rows = [r for r in rows if len(r[1])]
    if not langs or not rows:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    df, n = document_frequencies(train)
    idf = scale * np.log((n + 1) / (df + 1))
    where = {x: k for k, x in enumerate(langs)}
    made = [(where[y], i, c / c.sum() * idf[i]) for y, i, c in rows]
    back = made[::5] if len(made) >= 20 else []
    front = [r for k, r in enumerate(made) if k % 5] if back else made
    w, bias = ftrl(front, len(langs))
    t = 1.0
    if back:
        logits = np.array([x @ w[i] + bias for _, i, x in back])
        t = temperature(logits, np.array([y for y, _, _ in back]))
    return Model(langs, (idf[:, None] * w).astype(np.float32), bias, t)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    read = docs.select(
        F.col(id_col).alias("doc_id"), (~in_training(F.col(id_col))).alias("held_out"), F.col(text_col).alias("text")
    )
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """docs, all columns, without rows whose language is `und` or less likely than `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)))
            good = [x != "und" and s >= least for x, s in zip(langs, scores, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
