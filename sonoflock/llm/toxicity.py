"""Toxicity scores that see through disguised spelling: a noisy channel, then a classifier.

The channel turns letters into look-alike digits and signs, repeats letters, hides letters
behind asterisks, and puts signs or blanks between them. A word that shows traces of it is a
lattice: each character stands for one of several letters or for nothing, each at a cost. The
path of least cost under a trigram model of characters is found by the Viterbi algorithm, and
the words it spells are read besides the ones as written. A word without such traces has one
path only, itself, and needs no search. The model of characters is counted over all documents.

The classifier reads which words and beginnings of words (4 to 6 bytes) a text holds. It knows
the smoothed log ratio of the chances of each in toxic and in other texts, for those that are
more frequent in toxic ones; the sum over a text is turned into a probability by logistic
regression. By which factor, and by how many standard errors if at all, a feature must be more
frequent is chosen by cross-validation: the log loss of training rows under models of the other
folds decides, and the logistic regression is fitted on the sums that these models give. It is
fitted on at most about `per_class` labelled training rows of either class, drawn by a hash of
doc_id. What is collected is bounded by that sample and by the model's alphabet.

Defined results: null text is empty; a text without any known feature has the probability of
such a text; rows without a label are scored like others; without training rows of both
classes all scores are 0; of several labels of a document the largest counts. Whole texts are
read. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoflock.llm.common import lean

from sonoflock.llm import textbytes

# Look-alikes of letters.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h",
}
COST_LOOK, COST_DROP, COST_BREAK, COST_REPEAT = 1.0, 4.5, 5.0, 0.5
SYMBOLS = 28  # blank, a to z, any other letter
#: What isn't part of a word: ASCII other than letters.
NOT_LETTER = textbytes.separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
PREFIXES = (4, 5, 6)
FOLDS = 5  # of training rows; equal texts are in one fold
#: What cross-validation chooses from, the strictest first: factors, and standard errors.
RULES = [(factor, errors) for errors in (5, 4, 3, 2, 0) for factor in (32, 16, 8, 4)]
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[0xC0:] = 27  # the first byte of another letter; 0x80 to 0xBF go on with it
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(0x80, 0x100)]] = True
_LOOK = np.zeros(256, bool)
_LOOK[[ord(c) for c in LOOKS_LIKE]] = True


def char_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


@dataclass
class Channel:
    """The character model and the search through lattices."""

    cost: np.ndarray  # of the third of three characters: SYMBOLS ** 3
    known: dict[tuple[str, bool], str] = field(default_factory=dict)

    def __post_init__(self):
        self.table = self.cost.tolist()

    def lattice(self, token: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each place of a lower-cased token what may be read there, and its cost."""
        places = []
        for m in re.finditer(r"(.)\1*", token, re.DOTALL):
            c, n = m[1], len(m[0])
            if c.isalpha():
                if n >= 3:
                    places.append([(c, COST_REPEAT), (c + c, COST_REPEAT)])
                else:
                    places.append([(c * n, 0.0)])
                if spaced:
                    places.append([("", 0.0), (" ", COST_BREAK)])
                continue
            if n >= 3:
                places.append([("", 0.0), (" ", COST_LOOK)])
            elif c == "*" and n == 2:  # each hides a letter, of any kind
                hidden = [(x, COST_LOOK + (x not in LOOKS_LIKE[c])) for x in map(chr, range(97, 123))]
                places += [[*hidden, ("", COST_DROP), (" ", COST_BREAK)]] * n
            else:
                looks = [(x * n, COST_LOOK * n) for x in LOOKS_LIKE.get(c, "")]
                looks += [(x, COST_LOOK + COST_REPEAT) for x in LOOKS_LIKE.get(c, "") if n == 2]
                places.append([*looks, ("", COST_DROP if looks else COST_LOOK), (" ", COST_BREAK)])
            if spaced:
                places.append([("", 0.0), (" ", COST_BREAK)])
        return places

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest spelling of a disguised word, or words."""
        if (token, spaced) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # paths as chains, from their end
            for choices in [*self.lattice(token, spaced), [(" ", 0.0)]]:
                new: dict[tuple[int, int], tuple[float, tuple]] = {}
                for (a, b), (cost, path) in best.items():
                    for string, more in choices:
                        x, y, total = a, b, cost + more
                        for c in string:
                            z = char_class(c)
                            total += self.table[x][y][z]
                            x, y = y, z
                        if (x, y) not in new or total < new[x, y][0]:
                            new[x, y] = (total, (string, path))
                best = new
            path, spelled = min(best.values(), key=lambda x: x[0])[1], []
            while path:
                string, path = path
                spelled.append(string)
            self.known[token, spaced] = "".join(reversed(spelled)).strip()
        return self.known[token, spaced]


def count_characters(column: pa.Array) -> np.ndarray:
    """How often each three characters follow one another; runs of non-letters are one blank."""
    out = np.zeros(SYMBOLS**3, np.int64)
    data, offsets = textbytes.buffers(column)
    for a in range(0, len(data), textbytes.PIECE):
        part = data[a : a + textbytes.PIECE]
        part = part[(part < 0x80) | (part >= 0xC0)]
        c = _CLASS[part].astype(np.int64)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])] if len(c) else c
        if len(c) > 2:
            out += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=len(out))
    return out


def fit_channel(docs: DataFrame) -> Channel:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            total += count_characters(batch.column("text"))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    rows = docs.mapInArrow(lean(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    n = np.full(SYMBOLS**3, 0.1)
    n[rows["k"]] += rows["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    n[0, 0] = n.sum(axis=0)[0]  # a token begins as after any blank
    return Channel(-np.log(n / n.sum(axis=2, keepdims=True)))


def disguised(words: textbytes.Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Tokens (runs without white space, folded) that show traces of the channel: look-alikes
    beside a letter, signs between letters, letters repeated or apart; and runs of tokens of one
    letter or look-alike, as (first, end). A sign three times or more stands for nothing."""
    data, start, end = words.data, words.start, words.end
    n = len(data)
    letter, look = _LETTER[data], _LOOK[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    same = np.zeros(n, bool)
    same[1:] = data[1:] == data[:-1]
    third = np.zeros(n, bool)
    third[2:] = same[2:] & same[1:-1]
    many = third.copy()
    many[:-1] |= third[1:]
    many[:-2] |= third[2:]
    inside = look & ~many & (before | after)
    sign = ~letter & ~textbytes.BLANK[data]
    inside |= sign & before & after
    inside[:-1] |= sign[:-1] & same[1:] & before[:-1] & after[1:]
    triple = np.zeros(n, bool)
    triple[2:] = letter[2:] & same[2:] & same[1:-1] & (data[2:] < 0x80)
    ascii_letter = letter & (data < 0x80)
    alone = ascii_letter & ~before & ~after

    def per_token(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[end] - total[start]

    n_letters, n_alone = per_token(ascii_letter), per_token(alone)
    odd = (n_letters > 0) & ((per_token(inside) > 0) | (per_token(triple) > 0) | (n_alone >= 3))
    single = (end - start <= 2) & (n_letters + per_token(look) == 1) & (per_token(letter) == n_letters)
    single &= (end - start == 1) | (per_token(sign & ~look & ((data < 48) | (data > 57))) == 1)  # with a comma or the like
    of = words.text_of()
    runs = []
    k = np.flatnonzero(single)
    if len(k) > 2:
        cut = np.flatnonzero((np.diff(k) > 1) | (np.diff(of[k]) > 0)) + 1
        for part in np.split(k, cut):
            if len(part) >= 3 and n_letters[part].any():
                runs.append((int(part[0]), int(part[-1]) + 1))
    return np.flatnonzero(odd), runs


def named(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) of words and of their beginnings."""
    index, features = [np.arange(len(start))], [textbytes.span_hashes(data, start, end)]
    for size in PREFIXES:
        k = np.flatnonzero(end - start > size)
        index.append(k)
        features.append(textbytes.span_hashes(data, start[k], start[k] + size) ^ np.uint64(size * 0x9E3779B97F4A7C15 % 2**64))
    return np.concatenate(index), np.concatenate(features)


def features(column: pa.Array, channel: Channel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, texts, text index, feature) of each piece; features can repeat."""
    for tokens in textbytes.pieces(column, textbytes.BLANK, fold=True):
        start, end = textbytes.find_words(tokens.data, tokens.offsets, NOT_LETTER)
        of = np.searchsorted(tokens.offsets, start, side="right") - 1
        index, found = named(tokens.data, start, end)
        texts, out = [of[index]], [found]
        odd, runs = disguised(tokens)
        of = tokens.text_of()
        spelled, owner = [], []
        for k in odd.tolist():
            spelled.append(channel.decode(tokens.word(k).decode(errors="ignore")))
            owner.append(of[k])
        for a, b in runs:
            spelled.append(channel.decode("".join(tokens.word(k).decode(errors="ignore") for k in range(a, b)), True))
            owner.append(of[a])
        if spelled:
            data, offsets = textbytes.buffers(pa.array(spelled, pa.large_string()))
            start, end = textbytes.find_words(data, offsets, NOT_LETTER)
            index, found = named(data, start, end)
            texts.append(np.array(owner)[np.searchsorted(offsets, start, side="right") - 1][index])
            out.append(found)
        yield tokens.first_row, tokens.texts, np.concatenate(texts), np.concatenate(out)


def restore(text: str, channel: Channel) -> str:
    """A text with its disguised words spelled out, words joined by blanks."""
    column = pa.array([text], pa.large_string())
    out: list[str] = []
    for tokens in textbytes.pieces(column, textbytes.BLANK, fold=True, limit=1 << 40):
        odd, runs = disguised(tokens)
        new = {k: channel.decode(tokens.word(k).decode(errors="ignore")) for k in odd.tolist()}
        for a, b in runs:
            new[a] = channel.decode("".join(tokens.word(k).decode(errors="ignore") for k in range(a, b)), True)
            new |= dict.fromkeys(range(a + 1, b), "")
        out += [new.get(k, tokens.word(k).decode(errors="replace")) for k in range(len(tokens.start))]
    return " ".join(x for x in out if x)


@dataclass
class Model:
    channel: Channel
    features: np.ndarray  # sorted
    ratios: np.ndarray
    slope: float
    bias: float
    fitted: bool = True

    def hits(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, index of a known feature), each once in a text."""
        if not len(self.features):
            return
        for row, _, t, f in features(column, self.channel):
            at = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
            hit = self.features[at] == f
            pairs = np.unique(t[hit].astype(np.int64) * len(self.features) + at[hit])
            yield row + pairs // len(self.features), pairs % len(self.features)

    def sums(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for t, at in self.hits(column):
            np.add.at(out, t, self.ratios[at])
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.sums(column) + self.bias, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[float, float]:
    """Slope and bias by Newton's method."""
    w, m = np.zeros(2), np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        g = m.T @ (p - y) / len(y) + l2 * w
        h = (m * (p * (1 - p))[:, None]).T @ m / len(y) + (l2 + 1e-9) * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0]), float(w[1])


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, int, int]:
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = one.where(~held_out(F.col("doc_id")))
    counts = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(n1, 1))).otherwise(min(1.0, per_class / max(n0, 1)))
    drawn = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000 < share)
    # about 2 * per_class rows, whatever the corpus
    return docs.join(F.broadcast(drawn), "doc_id").select("text", "toxic"), n1, n0


def rates(tox: np.ndarray, clean: np.ndarray, rows1: int, rows0: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature the smoothed log ratio, and by how many standard errors it is more frequent
    in toxic rows; -inf for features that fewer than `least` toxic rows have."""
    p1, p0 = (tox + 0.5) / (rows1 + 1), (clean + 0.5) / (rows0 + 1)
    error = np.sqrt(p1 * (1 - p1) / max(rows1, 1) + p0 * (1 - p0) / max(rows0, 1))
    return np.log(p1 / p0), np.where(tox >= least, (p1 - p0) / (error * (1 - p1)), -np.inf)


def chosen(ratio: np.ndarray, errors: np.ndarray, rule: tuple[int, int]) -> np.ndarray:
    return (ratio > np.log(rule[0])) & (errors > rule[1])


def log_loss(x: np.ndarray, y: np.ndarray, slope: float, bias: float) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * (slope * x + bias))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, least: int = 4) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic)."""
    channel = fit_channel(docs.select("text"))
    spark = docs.sparkSession
    train, n1, n0 = training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), per_class)
    train = train.withColumn("fold", F.pmod(F.hash("text"), F.lit(FOLDS)))
    nothing = Model(channel, np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0, False)
    if not n1 or not n0:
        return nothing
    names = [f"{kind}{k}" for kind in ("n", "rows") for k in range(FOLDS)]

    def count(of: DataFrame, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, in how many rows of each fold they are (folds x features), rows of each fold."""
        shared = spark.sparkContext.broadcast((channel, among))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            channel, among = shared.value
            for batch in batches:
                fold = batch.column("fold").to_numpy()
                seen, folds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for row, _, t, f in features(batch.column("text"), channel):
                    if among is not None:
                        k = np.minimum(np.searchsorted(among, f), len(among) - 1)
                        t, f = t[among[k] == f], f[among[k] == f]
                    order = np.lexsort((f, t))
                    t, f = t[order], f[order]
                    new = np.ones(len(t), bool)
                    new[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
                    seen.append(f[new])
                    folds.append(fold[row + t[new]].astype(np.int64))
                f, at = np.unique(np.concatenate(seen), return_inverse=True)
                n = np.bincount(np.concatenate(folds) * len(f) + at, minlength=FOLDS * len(f)).reshape(FOLDS, -1)
                n = np.concatenate([n, np.zeros((FOLDS, 1), n.dtype)], axis=1)
                rows = np.zeros_like(n)
                rows[:, -1] = np.bincount(fold, minlength=FOLDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(f.view(np.int64), 0)), *map(pa.array, n), *map(pa.array, rows)], ["f", *names]
                )

        kinds = ", ".join(f"{x} long" for x in ["f", *names])
        sums = of.select("text", "fold").mapInArrow(lean(run), kinds).groupBy("f").agg(*[F.sum(x).alias(x) for x in names])
        n, rows = (sum(F.col(x) for x in half) for half in (names[:FOLDS], names[FOLDS:]))
        table = sums.where((n >= (least if among is None else 1)) | (rows > 0)).toArrow()
        f = table["f"].to_numpy().view(np.uint64)
        both = np.array([table[x].to_numpy() for x in names], np.int64).reshape(2, FOLDS, len(f))
        order = np.argsort(f)
        order = order[both[0].sum(axis=0)[order] >= (least if among is None else 1)]
        return f[order], both[0][:, order], both[1].sum(axis=1)

    f, tox, rows1 = count(train.where("toxic = 1"), None)
    if not len(f):
        return nothing
    g, n, rows0 = count(train.where("toxic = 0"), f)
    clean = np.zeros((FOLDS, len(f)), np.int64)
    clean[:, np.searchsorted(f, g)] = n
    # for each fold what the other folds say; at the end what all say
    whole = [x.sum(axis=0) for x in (tox, clean, rows1, rows0)]
    left = [[w - x[k] for w, x in zip(whole, (tox, clean, rows1, rows0), strict=True)] for k in range(FOLDS)]
    said = [rates(*x, least) for x in [*left, whole]]
    some = np.any([chosen(*x, (min(r[0] for r in RULES), min(r[1] for r in RULES))) for x in said], axis=0)
    wide = Model(channel, f[some], np.zeros(0), 1.0, 0.0)
    shared = spark.sparkContext.broadcast((wide, [(ratio[some], errors[some]) for ratio, errors in said]))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each row under each rule: of the other folds' model, then of the whole model."""
        wide, said = shared.value
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            x = np.zeros((2 * len(RULES), batch.num_rows))
            for t, at in wide.hits(batch.column("text")):
                for which in range(FOLDS + 1):
                    mine = slice(None) if which == FOLDS else fold[t] == which
                    ratio, errors = said[which]
                    for r, rule in enumerate(RULES):
                        weight = np.where(chosen(ratio, errors, rule), ratio, 0)
                        x[r + (which == FOLDS) * len(RULES)] += np.bincount(t[mine], weight[at[mine]], batch.num_rows)
            sums = pa.array(list(np.ascontiguousarray(x.T)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([sums, batch.column("toxic")], ["x", "toxic"])

    seen = train.select("text", "fold", F.col("toxic").cast("int").alias("toxic"))
    seen = seen.mapInArrow(lean(total), "x array<double>, toxic int").toArrow().to_pydict()
    x, y = np.array(seen["x"]).T, (np.array(seen["toxic"]) == 1).astype(float)
    if x[: len(RULES)].any():
        lines = [logistic(row, y) for row in x[: len(RULES)]]
        best = int(np.argmin([log_loss(row, y, *line) for row, line in zip(x, lines, strict=False)]))
        slope, bias = lines[best]
    else:  # too few rows to leave out a fold: the strictest rule that knows a feature
        found = np.flatnonzero(x[len(RULES) :].any(axis=1))
        best = int(found[0]) if len(found) else 0
        slope, bias = logistic(x[len(RULES) + best], y)
    ratio, errors = said[-1]
    keep = chosen(ratio, errors, RULES[best])
    return Model(channel, f[keep], ratio[keep], slope, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.scores(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), scores], ["doc_id", "held_out", "score"]
            )

    read = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")
    )
    kind = read.schema["doc_id"].dataType.simpleString()
    scored = read.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
