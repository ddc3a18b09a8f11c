"""Quality rules with n-gram perplexity: words by a model that grows with the corpus, spelling by a model per language.

Words: ``word_pairs`` gives a text's mean negative log probability by word, by the words and word pairs of all other texts
of its language, none folded or left out. A text is rejected if its figure lies more than ``width`` deviations above the
median of its language; a text that others resemble has a low figure, which is no fault.

Spelling: bytes are read as symbols of an alphabet of 64 (cased letters, digit, kinds of punctuation, white space, folded
bytes of other letters), with a modified Kneser-Ney model of order 4. Folding and order bound this model to 64^4 n-grams, so
it can be broadcast; what they hide, the words tell apart. Spark counts all n-grams of all documents; each task sums its
own first. A language's model is a set of sorted arrays of n-gram codes (an n-gram's hash that cannot collide) with log
probabilities and back-off weights, searched by bisection. A document's figure is its mean negative log probability by
symbol. The band of a language lies ``width`` deviations around its median.

A deviation joins the language's scaled median deviation with the sampling error of a mean over so many symbols or words,
so a short text is not rejected for being short.

Copies: each distinct text of a language counts once, in its models and in its medians, so a group of copies moves
none; every row is judged. Only texts that occur twice are looked up, by hash; their further copies are subtracted.

Defined results: null and empty texts have no words and fail the base rules; a null language is a language of its own;
repeated rows are judged each; an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.batches import hand_back, slices
from loomlog.llm.text_stats import rule_counts
from loomlog.llm.word_pairs import answers, blocks, weighed
from loomlog.session import cut, ship_by_value

ship_by_value(__name__)

ORDER, BITS = 4, 6
SLICE_BYTES = 1 << 20
MODEL_BYTES = 256 << 20  # of models that a task holds at a time; more languages are scored in further passes
BROADCAST_LANGUAGES = 100_000
MIN_WORDS, REPEAT_PERCENT = 10, 20  # the base rules
WIDTH, LEAST_DEVIATION = 3.0, 0.02  # of the bands; figures are natural logarithms
SYMBOL_VARIANCE, WORD_VARIANCE = 2.0, 16.0  # of a symbol's or word's log probability; give the sampling error of a mean
STEP = 1000  # figures are put in bins of 1 / STEP to find medians


def _alphabet() -> bytes:
    """By byte: white space 0, a-z, A-Z, digit 53, sentence punctuation 54, other punctuation 55, control 56, others."""
    table = bytearray(256)
    for b in range(256):
        c = chr(b)
        if b in b" \t\n\x0b\x0c\r":
            table[b] = 0
        elif "a" <= c <= "z":
            table[b] = 1 + b - ord("a")
        elif "A" <= c <= "Z":
            table[b] = 27 + b - ord("A")
        elif "0" <= c <= "9":
            table[b] = 53
        elif c in ".,;:?'\"()-":
            table[b] = 54
        elif 32 < b < 127:
            table[b] = 55
        elif b < 128:
            table[b] = 56
        else:
            table[b] = 57 + b % 7
    return bytes(table)


ALPHABET = _alphabet()
GAP = b" " * (ORDER - 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each symbol of the texts, and how many each text has.

    Every text is preceded by white space, so no n-gram mixes two texts.
    """
    coded = [text.encode().translate(ALPHABET) for text in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    joined = np.frombuffer((b"\0" * (ORDER - 1)).join([b"", *coded]), np.uint8).astype(np.int32)
    codes = joined[: len(joined) - ORDER + 1] << (BITS * (ORDER - 1))
    for i in range(1, ORDER):
        codes = codes | joined[i : len(joined) - ORDER + 1 + i] << (BITS * (ORDER - 1 - i))
    # Of the windows of the joined texts, those that end in a gap are left out.
    keep = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)[:-1] + (ORDER - 1) * np.arange(len(sizes) - 1)
    for i in range(ORDER - 1):
        keep[ends + i] = False
    return codes[keep], sizes


def by_language(langs: list, texts: list) -> dict[str | None, list[int]]:
    out: dict[str | None, list[int]] = {}
    for i, (lang, text) in enumerate(zip(langs, texts)):
        if text:
            out.setdefault(lang, []).append(i)
    return out


def text_hash(text) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def copies(docs: DataFrame) -> DataFrame:
    """(lang, text, extra): texts that a language holds more than once, with the number of rows beyond the first."""
    hashed = docs.where(F.length("text") > 0).select("lang", "text", text_hash(F.col("text")).alias("digest"))
    repeated = hashed.groupBy("lang", "digest").count().where("count > 1").select("digest").distinct()
    some = hashed.join(cut(repeated, "repeated-texts"), "digest", "left_semi")
    return some.groupBy("lang", "text").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def gram_counts(docs: DataFrame, further: DataFrame) -> DataFrame:
    """(lang, gram, n) over the distinct texts of each language of ``docs`` (columns lang, text); ``further``: its ``copies``."""
    less = _gram_sums(further.select("lang", "text", (-F.col("extra")).alias("times")))
    return _gram_sums(docs.select("lang", "text", F.lit(1).cast("long").alias("times"))).unionByName(less).groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).where("n > 0")


def _gram_sums(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) by task over ``docs`` (columns lang, text, times); a row counts ``times`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def summed(lang):
            codes = np.concatenate([c for c, _ in held[lang]])
            counts = np.concatenate([n for _, n in held[lang]])
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            return codes[begins], np.add.reduceat(counts, begins)

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = part.column("text").to_pylist()
                times = part.column("times").to_numpy()
                for lang, rows in by_language(part.column("lang").to_pylist(), texts).items():
                    codes, sizes = grams([texts[i] for i in rows])
                    if (times[rows] == 1).all():
                        found = np.unique(codes, return_counts=True)
                    else:
                        codes, at = np.unique(codes, return_inverse=True)
                        found = codes, np.zeros(len(codes), np.int64)
                        np.add.at(found[1], at, np.repeat(times[rows], sizes))
                    held.setdefault(lang, []).append(found)
                    if len(held[lang]) >= 8:
                        held[lang] = [summed(lang)]
                if len(held) > 256:
                    yield from map(row, held, map(summed, held))
                    held = {}
        yield from map(row, held, map(summed, held))
        held.clear()
        hand_back()

    def row(lang, found):
        codes, counts = found
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram int, n bigint")


def discounts(counts: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney, by min(count, 3); index 0 is unused."""
    n = [0, *(int(np.count_nonzero(counts == i)) for i in (1, 2, 3, 4))]
    plain = np.array([0.0, 0.5, 1.0, 1.5])
    if min(n[1:4]) == 0:
        return plain
    y = n[1] / (n[1] + 2 * n[2])
    out = np.array([0.0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]])
    return np.where((out > 0) & (out <= np.arange(4)), out, plain)


class Model:
    """Sorted code arrays by order: n-grams with log probabilities, contexts with log back-off weights."""

    def __init__(self, levels):
        self.levels = levels

    @classmethod
    def train(cls, codes: np.ndarray, counts: np.ndarray) -> "Model":
        order = np.argsort(codes)
        tables = {ORDER: (codes[order].astype(np.int32), counts[order].astype(np.int64))}
        for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols before them
            tables[k] = np.unique(tables[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True)
        levels, below = [], None
        for k in range(1, ORDER + 1):
            keys, n = tables[k]
            taken = discounts(n)[np.minimum(n, 3)]
            contexts, begins = np.unique(keys >> BITS, return_index=True)
            total = np.add.reduceat(n, begins)
            weight = np.add.reduceat(taken, begins) / total
            at = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys))))
            lower = 2.0**-BITS if below is None else below[1][np.searchsorted(below[0], keys & ((1 << BITS * (k - 1)) - 1))]
            p = (n - taken) / total[at] + weight[at] * lower
            below = keys, p
            levels.append((keys.astype(np.int32), np.log(p).astype(np.float32), contexts.astype(np.int32), np.log(weight).astype(np.float32)))
        return cls(levels)

    def to_bytes(self) -> list[bytes]:
        return [array.tobytes() for level in self.levels for array in level]

    @classmethod
    def from_bytes(cls, blobs: list[bytes]) -> "Model":
        arrays = [np.frombuffer(b, (np.int32, np.float32)[i % 2]) for i, b in enumerate(blobs)]
        return cls([tuple(arrays[i : i + 4]) for i in range(0, len(arrays), 4)])

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        ordered = np.sort(codes.astype(np.int64) << 32 | np.arange(len(codes)))  # searches in order are several times as fast
        codes, order = (ordered >> 32).astype(np.int32), ordered & 0xFFFFFFFF
        out, open_ = np.zeros(len(codes), np.float32), np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            keys, log_p, contexts, log_weight = self.levels[k - 1]
            code = codes[open_] & ((1 << BITS * k) - 1)
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            hit = keys[at] == code
            out[open_[hit]] += log_p[at[hit]]
            open_, code = open_[~hit], code[~hit]
            if not len(open_):
                break
            context = code >> BITS
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            out[open_] += np.where(contexts[at] == context, log_weight[at], 0)
        out[open_] += np.float32(-BITS * np.log(2))
        given = np.empty_like(out)
        given[order] = out
        return given


def models(counts: DataFrame) -> DataFrame:
    """(lang, blobs, size): a model per language; a group has 64^4 rows at most."""

    def train(table: pa.Table) -> pa.Table:
        blobs = Model.train(table["gram"].to_numpy(), table["n"].to_numpy()).to_bytes()
        return pa.table({
            "lang": pa.array([table["lang"][0].as_py()], pa.string()), "blobs": pa.array([blobs], pa.list_(pa.binary())),
            "size": pa.array([sum(map(len, blobs))], pa.int64()),
        })

    return cut(counts.groupBy("lang").applyInArrow(train, "lang string, blobs array<binary>, size bigint"), "language-models")


def scored(docs: DataFrame, trained: DataFrame, answered: tuple[str, int], with_text: bool = False) -> DataFrame:
    """Rows of ``docs`` (lang, text and others) with the base counts, ``figure`` and ``word_figure``; the text only if asked for."""
    spark = docs.sparkSession
    rest = [f for f in docs.schema.fields if with_text or f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{c} bigint" for c in COUNTS] + ["figure double, word_figure double"])

    def passes():
        batch, held = [], 0
        for r in trained.select("lang", "size").orderBy("lang").toLocalIterator():
            if batch and held + r["size"] > MODEL_BYTES:
                yield batch
                batch, held = [], 0
            batch.append(r["lang"])
            held += r["size"]
        yield batch

    def score(known, langs: set | None, others: bool) -> DataFrame:
        """Rows of ``langs``; ``others``: also those without words of any language's model. Blocks are of all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = {lang: Model.from_bytes(blobs) for lang, blobs in known.value.items()}
            for block in blocks(batches):
                for part, by_words in weighed(block, *answered):
                    if langs is not None:
                        some = [(lang in langs) if text else others for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist())]
                        part, by_words = part.filter(pa.array(some, pa.bool_())), [f for f, take in zip(by_words, some) if take]
                    texts = part.column("text").to_pylist()
                    figures: list[float | None] = [None] * len(texts)
                    for lang, rows in by_language(part.column("lang").to_pylist(), texts).items():
                        codes, sizes = grams([texts[i] for i in rows])
                        begins = np.append(0, np.cumsum(sizes)[:-1])
                        sums = np.add.reduceat(ready[lang].log_probabilities(codes).astype(np.float64), begins)
                        for i, figure in zip(rows, (-sums / sizes).tolist()):
                            figures[i] = figure
                    counts = list(zip(*map(rule_counts, texts))) or [[]] * len(COUNTS)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(f.name) for f in rest), *(pa.array(c, pa.int64()) for c in counts), pa.array(figures, pa.float64()), pa.array(by_words, pa.float64())],
                        [*(f.name for f in rest), *COUNTS, "figure", "word_figure"],
                    )
            ready.clear()
            hand_back()

        return docs.mapInArrow(run, schema)

    groups, out = list(passes()), None
    for langs in groups:
        wanted = trained if len(groups) == 1 else trained.where(_among("lang", langs))
        known = spark.sparkContext.broadcast({r["lang"]: [bytes(b) for b in r["blobs"]] for r in wanted.select("lang", "blobs").toLocalIterator()})
        some = score(known, None if len(groups) == 1 else set(langs), out is None)
        out = some if out is None else out.unionByName(some)
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _among(column: str, values: list):
    found = F.col(column).isin([v for v in values if v is not None])
    return found | F.col(column).isNull() if None in values else F.coalesce(found, F.lit(False))


def bands(rows: DataFrame, figure: str = "figure") -> DataFrame:
    """(lang, middle, deviation) from the figures of all distinct texts; exact medians of binned figures."""

    def median(binned: DataFrame, name: str) -> DataFrame:
        sums = binned.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("lang")
        ranked = sums.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        return ranked.where(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min("bin").alias(name))

    once = rows.where(F.col(figure).isNotNull()).groupBy("lang", "digest").agg(F.min(figure).alias("figure"))
    bins = once.groupBy("lang", F.round(F.col("figure") * STEP).cast("long").alias("bin"))
    binned = cut(bins.agg(F.count(F.lit(1)).alias("n")), "bins")
    centre = cut(median(binned, "centre"), "centres")
    if centre.count() <= BROADCAST_LANGUAGES:
        centre = F.broadcast(centre)
    other = centre.withColumnRenamed("lang", "l")
    off = binned.join(other, F.col("lang").eqNullSafe(F.col("l"))).select("lang", F.abs(F.col("bin") - F.col("centre")).alias("bin"), "n")
    spread = median(off, "spread").withColumnRenamed("lang", "l")
    deviation = F.greatest(1.4826 * F.col("spread") / STEP, F.lit(LEAST_DEVIATION))
    met = spread.join(centre, F.col("lang").eqNullSafe(F.col("l")))
    return cut(met.select("lang", (F.col("centre") / STEP).alias("middle"), deviation.alias("deviation")), "bands")


def judge(
    docs: DataFrame, keep: list[str], lang: str = "lang", text: str = "text", width: float = WIDTH, with_text: bool = False, stored: bool = False,
) -> DataFrame:
    """``keep`` columns as struct ``row``, base counts, ``figure``, ``perplexity``, ``word_figure``, ``base_failed`` and ``kept``.

    ``with_text`` adds the column ``text``. ``stored`` says that ``docs`` reads a table and no rows move between tasks, so that
    two readings deal rows out alike; else it is stored first.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:  # else the splits follow the cores of the moment
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = (rows if stored else cut(rows, "texts")).withColumn("digest", text_hash(F.col("text")))
    further = cut(copies(rows), "copies")
    trained = models(gram_counts(rows, further))
    judged = cut(scored(rows, trained, answers(rows, further), with_text), "figures")
    for figure in ("figure", "word_figure"):
        limits = bands(judged, figure)
        if limits.count() <= BROADCAST_LANGUAGES:
            limits = F.broadcast(limits)
        names = {"lang": f"{figure}_lang", "middle": f"{figure}_middle", "deviation": f"{figure}_deviation"}
        limits = limits.withColumnsRenamed(names)
        judged = judged.join(limits, F.col("lang").eqNullSafe(F.col(f"{figure}_lang")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))

    def reach(figure: str, variance: float, n: Column) -> Column:
        deviation = F.col(f"{figure}_deviation")
        return width * F.sqrt(deviation * deviation + variance / F.greatest(n, F.lit(1)))

    by_symbols, by_words = reach("figure", SYMBOL_VARIANCE, F.col("word_chars") + F.col("n_words")), reach("word_figure", WORD_VARIANCE, F.col("n_words"))
    inside = F.col("figure").between(F.col("figure_middle") - by_symbols, F.col("figure_middle") + by_symbols)
    inside &= F.col("word_figure") <= F.col("word_figure_middle") + by_words
    return judged.select("row", *(["text"] if with_text else []), *COUNTS, "figure", F.exp("figure").alias("perplexity"), "word_figure",
                         failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"))
