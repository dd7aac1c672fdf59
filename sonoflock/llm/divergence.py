"""How the sources of each language differ in their use of terms.

Terms are counted batch by batch in the tasks that read the texts, then by Spark. A language
keeps the terms that occur in enough of its documents. Within a (language, source) group a kept
term has the smoothed share p = 1 + floor(SCALE (count + 2) / (N + 2 V)); two shares diverge by
floor((p - q)^2 / (p + q)). All of it is exact: decimals where a product could pass 63 bits.

Part `pair` sums the divergence over all kept terms, for each other source of the language. Most
terms don't occur in most sources, so the sum starts from V times the divergence of two absent
terms, and only what differs from that baseline is added: for terms in one of the two sources by
the number of terms with each count, for terms in both from the rows of each term. No term is
met in a source where it doesn't occur.

Part `term` ranks a group's terms and keeps the first k. Each group's kth value is found by radix
selection: a histogram over the high bits of the values, then over the next bits among values
that share them, each a Spark aggregate with one row for each group and digit. Where several
terms share the kth value, histograms over their UTF-8 bytes go on, over pieces that double in
length, until the ties that still fit are told from the others. Only rows beyond the threshold
are sorted.

Defined results: null text, lang and source count as ''; every (lang, source) that occurs is a
group, even without terms; where a language keeps no term its pairs have value 0 and nothing is
ranked; repeated rows are documents of their own; empty tables give nothing. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.llm import textbytes
from sonoflock.llm.common import lean, materialise

SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP = 10
#: [^\x00-\x40\x5B-\x60\x7B-\x7F]+
NOT_LETTER = textbytes.separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Texts are counted in pieces of so many bytes.
PIECE = 4 << 20
#: Bits of a value for each histogram; values are below 2 to the BITS.
DIGIT, BITS = 16, 32
COUNTS = "lang string, source string, term string, n long, docs long"
GROUP = ["lang", "source"]


def _piece(words: textbytes.Words, group: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of one piece; group: of each of its texts."""
    hashes = words.hashes()
    _, index, which = textbytes.distinct(hashes)
    clash = np.flatnonzero(~textbytes.same_spans(words.data, words.start, words.end, index[which]))
    if len(clash):  # words of equal hash and other bytes stand for themselves; Spark adds them up
        which[clash] = len(index) + np.arange(len(clash))
        index = np.concatenate([index, clash])
    size = len(index)
    pairs, times = np.unique(words.text_of() * size + which, return_counts=True)
    keys, inverse = np.unique(group[pairs // size] * size + pairs % size, return_inverse=True)
    n = np.bincount(inverse, times, len(keys)).astype(np.int64)
    docs = np.bincount(inverse, minlength=len(keys))
    raw, at = words.data.tobytes(), index[keys % size]
    terms = [raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
    return keys // size, terms, n, docs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        names = sorted(set(pairs))
        number = {x: k for k, x in enumerate(names)}
        group = np.fromiter(map(number.__getitem__, pairs), np.int64, len(pairs))
        # a row without a term for each group, so that none is lost
        yield _rows(names, np.arange(len(names)), [b""] * len(names), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64))
        for words in textbytes.pieces(batch.column("text"), NOT_LETTER, fold=True, limit=PIECE):
            if len(words.start):
                yield _rows(names, *_piece(words, group[words.first_row : words.first_row + words.texts]))


def _rows(names: list[tuple[str, str]], group: np.ndarray, terms: list[bytes], n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1))
    return pa.RecordBatch.from_arrays(
        [lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
        ["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group, and
    one row with the term '' for each group."""
    plain = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))],
        F.col(text_col).alias("text"),
    )
    found = plain.mapInArrow(lean(_count), COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(SCALE (n + 2) / (total + 2 kept))."""
    over = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", over, (total + 2 * kept).cast("decimal(20,0)")).cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so all fits 63 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pick(counts: DataFrame, by: Column) -> DataFrame:
    """Of each group the first digit, in an order, at which `need` rows have passed, how many
    rows came before, and how many have that digit."""
    onward = Window.partitionBy(*GROUP).orderBy(by)
    through = F.sum("n").over(onward.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("through", through).where(
        (F.col("through") >= F.col("need")) & (F.col("through") - F.col("n") < F.col("need"))
    )


def thresholds(scored: DataFrame, k: int, digit: int = DIGIT, bits: int = BITS, step: int = 4) -> DataFrame:
    """(lang, source, value, bound, reach) of each group with more than k rows: of scored, (lang,
    source, item, value), the k rows that come first are those of a greater value, and those of
    this value whose item's first `reach` bytes are at most `bound` (null: all of them)."""
    size = scored.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("all"))
    state = materialise(size.where(F.col("all") > k).select(*GROUP, F.lit(0).cast("long").alias("value"), F.lit(k).cast("long").alias("need")), "radix")
    shift = bits
    while shift > 0:
        high, shift = shift, max(shift - digit, 0)
        met = scored.join(state.withColumnRenamed("value", "prefix"), GROUP).where(F.shiftright("value", high) == F.col("prefix"))
        counts = met.groupBy(*GROUP, "need", F.shiftright("value", shift).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        found = _pick(counts, F.desc("value"))
        left = F.col("need") - (F.col("through") - F.col("n"))
        state = materialise(found.select(*GROUP, "value", left.alias("need"), "n"), "radix")
    # ties: groups where more rows have the kth value than still fit
    done = [state.where("need = n").select(*GROUP, "value", F.lit(None).cast("binary").alias("bound"), F.lit(0).alias("reach"))]
    open_ones = state.where("need < n").select(*GROUP, "value", "need", F.lit(b"").alias("bound"))
    length = 0
    while not open_ones.isEmpty():
        # a long item that others share stays one digit of twice the bytes, round after round
        tied = scored.join(open_ones, [*GROUP, "value"]).withColumn("bytes", F.col("item").cast("binary"))
        same = tied.where(F.substring("bytes", 1, length) == F.col("bound"))
        length += step
        counts = same.groupBy(*GROUP, "value", "need", F.substring("bytes", 1, length).alias("bound")).agg(F.count(F.lit(1)).alias("n"))
        found = _pick(counts, F.asc("bound"))
        left = F.col("need") - (F.col("through") - F.col("n"))
        state = materialise(found.select(*GROUP, "value", "bound", left.alias("need"), "n"), "radix")
        done.append(state.where("need = n").select(*GROUP, "value", "bound", F.lit(length).alias("reach")))
        open_ones = state.where("need < n").select(*GROUP, "value", "need", "bound")
        step *= 2
    return reduce(DataFrame.unionByName, done)


def first_ranks(scored: DataFrame, k: int, **params) -> DataFrame:
    """The k first rows of each group of scored, (lang, source, item, value), by value descending,
    then item, with their rank. Only rows beyond a group's threshold are sorted."""
    limit = thresholds(scored, k, **params).withColumnsRenamed({"value": "least", "lang": "l", "source": "s"})
    joined = scored.join(limit, (scored["lang"] == limit["l"]) & (scored["source"] == limit["s"]), "left")
    tie = (F.col("value") == F.col("least")) & (
        F.col("bound").isNull() | (F.expr("substring(cast(item as binary), 1, reach)") <= F.col("bound"))
    )
    kept = joined.where(F.col("least").isNull() | (F.col("value") > F.col("least")) | tie)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return kept.select(*GROUP, "item", "value", rank.alias("rank"))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language. kept: (lang, source, term, n,
    p); groups: (lang, source, p0, kept)."""
    a = groups.select("lang", "source", "p0", "kept")
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = a.join(b, "lang").where(F.col("source") < F.col("item"))
    base = both.select("lang", "source", "item", F.coalesce(F.col("kept") * apart(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # a term of one source as if it weren't in the other: the same for all terms of that count
    tally = kept.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    one = tally.join(a.drop("kept"), GROUP).join(other, "lang").where(F.col("source") != F.col("item"))
    one = one.withColumn("value", F.col("n") * (apart(p, q0) - apart(p0, q0)))
    one = one.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "value")
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # a term of both: what the two baselines have put in comes out again
    mine = kept.join(a.drop("kept"), GROUP).select("lang", "term", "source", "p", "p0")
    theirs = mine.select("lang", "term", F.col("source").alias("item"), p.alias("q"), p0.alias("q0"))
    shared = mine.join(theirs, ["lang", "term"]).where(F.col("source") < F.col("item"))
    shared = shared.withColumn("value", apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))
    shared = shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    total = base.unionByName(one).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    total = materialise(total, "pairs")
    return total.unionByName(total.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each group from every other
    source of its language, all ranks, and its most over-used terms, ranks to `top`."""
    terms = materialise(term_counts(docs, **columns), "terms")
    words = terms.where("term != ''")
    vocabulary = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    kept = materialise(words.drop("docs").join(vocabulary.drop("docs"), ["lang", "term"]), "kept-terms")

    sizes = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    langs = sizes.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    kinds = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = terms.where("term = ''").select(*GROUP)
    groups = groups.join(sizes, GROUP, "left").join(langs, "lang", "left").join(kinds, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    baseline = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.when(F.col("kept") > 0, F.col("kept"))))
    groups = materialise(groups.withColumn("p0", baseline), "groups")

    known = groups.select(*GROUP, "total", "lang_total", "kept")
    placed = kept.join(known, GROUP)
    placed = placed.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    placed = placed.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    placed = materialise(placed.select(*GROUP, "term", "n", "p", "q"), "shares")

    pairs = pair_values(placed.select(*GROUP, "term", "n", "p"), groups)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    over = placed.where("p > q").select(*GROUP, F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    best = first_ranks(over, top).select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)


#: The same in DuckDB's SQL; {0} and {1} are A-Z and a-z.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
vocabulary AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN vocabulary USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM vocabulary GROUP BY lang),
g AS (
  SELECT a.lang, a.source, coalesce(b.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) b USING (lang, source)),
p AS (
  SELECT g.lang, g.source, vocabulary.term, coalesce(c.n, 0) AS n,
         1 + (coalesce(c.n, 0) + 2)::HUGEINT * 1000000000 // (g.total + 2 * v.v)::HUGEINT AS p,
         1 + (vocabulary.lang_n + 2)::HUGEINT * 1000000000 // (v.total + 2 * v.v)::HUGEINT AS q
  FROM g JOIN vocabulary USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = vocabulary.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM x QUALIFY part = 'pair' OR rank <= 10"""
