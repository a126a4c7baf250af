"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has probabilities of the vocabulary's pieces. A word's probability is
the sum over all its segmentations, by the forward algorithm; a text's is the
product over its words, runs of letters in lower case. Since no piece spans two words,
a word seen before is looked up. The probabilities are fitted by expectation
maximisation (forward and backward sums over the words of the sample).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from rupaka.llm.common import Scratch, released, small_batches, table, written
from rupaka.llm.lattice import Lattice, lattice
from rupaka.llm.op1_token_counts import MODEL

#: A run of letters; a longer one counts as several words, which bounds what one word needs.
WORD, GAP = re.compile(r"[^\W\d_]{1,1024}"), re.compile(r"[\W\d_]")
#: Characters of a text that are split into words at once, up to the next gap between words.
PART = 1 << 16
#: Words that are looked up at once.
GROUP = 1 << 17
#: Labelled documents of each language that the model is fitted on, at most; rounds of fitting; words that one worker remembers.
SAMPLE, ROUNDS, REMEMBERED = 8000, 3, 1 << 17
#: Parts in which a language's rows are ranked before all are.
PARTS = 64
#: Probability of a character that the vocabulary doesn't have; pseudo-counts in all, shared out by the languages' mean.
UNKNOWN, SMOOTH = 1e-9, 200.0
NONE = "und"


def parts_of(text: str) -> Iterator[str]:
    """The text in parts that end where a word does."""
    start = 0
    while len(text) - start > PART:
        gap = GAP.search(text, start + PART)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end
    if start < len(text):
        yield text[start:]


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case, each with a space in front; runs without any letter (such as superscripts) don't count."""
    found = WORD.findall((text or "").lower())
    if not "".join(found).isalpha():
        found = [w for w in found if any(map(str.isalpha, w))]
    return [" " + w for w in found]


def forward(lat: Lattice, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language; p: pieces x languages, with a last row of zeros."""
    out = np.empty((len(words), p.shape[1]))
    for members, codes in lat.by_length(words):
        alpha, shift = [np.ones((len(members), p.shape[1]))], np.zeros((len(members), p.shape[1]))
        for end, found in enumerate(lat.matched(codes), 1):
            new = np.where((found[0] < 0)[:, None], UNKNOWN, p[found[0]]) * alpha[-1]
            for n, ids in enumerate(found[1:], 2):
                if ids is not None:
                    new += p[ids] * alpha[-n]
            alpha = [*alpha[-lat.longest :], new]
            if end % 8 == 0:  # keeps numbers within range; ratios stay
                alpha = [a / new for a in alpha]
                shift += np.log(new)
        out[members] = np.log(alpha[-1]) + shift
    return out


def expected(lat: Lattice, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words seen ``counts`` times, under one language's p."""
    out = np.zeros(lat.size + 1)
    for members, codes in lat.by_length(words):
        n, width = codes.shape
        edges = list(lat.matched(codes))
        weight = [[None if ids is None else np.where(ids < 0, UNKNOWN if k == 0 else 0.0, p[ids]) for k, ids in enumerate(found)] for found in edges]
        alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        alpha[0], beta[width] = 1, 1
        scale = np.ones((width + 1, n))
        for end in range(1, width + 1):  # alpha is scaled at each end, so long words don't underflow
            run = np.ones(n)
            for k, w in enumerate(weight[end - 1]):
                if w is not None:
                    alpha[end] += w * alpha[end - 1 - k] / run
                run = run * scale[end - 1 - k] if end - 1 - k > 0 else run
            scale[end] = alpha[end]
            alpha[end] = 1
        pieces, shares = [], []
        for end in range(width, 0, -1):
            run = scale[end].copy()
            for k, w in enumerate(weight[end - 1]):
                if w is not None:
                    share = w * beta[end] / run
                    beta[end - 1 - k] += share
                    ids = edges[end - 1][k]
                    on = ids >= 0
                    pieces.append(ids[on])
                    shares.append((counts[members] * share)[on])
                run = run * scale[end - 1 - k] if end - 1 - k > 0 else run
        out += np.bincount(np.concatenate(pieces), np.concatenate(shares), lat.size + 1)
    out[-1] = 0
    return out[:-1]


class Model:
    """langs, and log-free piece probabilities ``p`` (pieces + 1 x languages, the last row zero)."""

    def __init__(self, langs: list[str], p: np.ndarray, vocabulary: str):
        self.langs, self.p, self.vocabulary, self.name = langs, p, vocabulary, uuid.uuid4().hex


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Piece probabilities from expected counts (pieces x languages)."""
    whole = counts.sum(0, keepdims=True)
    shared = (counts / np.maximum(whole, 1e-300)).mean(1, keepdims=True) * 0.9 + 0.1 / len(counts)
    return np.vstack([(counts + SMOOTH * shared) / (whole + SMOOTH), np.zeros((1, counts.shape[1]))])


def sample_words(labelled: DataFrame, most: int = SAMPLE, table_of=written) -> DataFrame:
    """lang, word, n: the word counts of at most ``most`` ids of each language of labelled (doc_id, text, lang), taken by a hash of doc_id; rows without letters don't count."""
    labelled = labelled.filter(F.col("text").rlike(r"\p{L}"))
    # a hash of the hash, so that the choice isn't tied to other uses of it; cut in parts first, so that a large language is no hot task
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS))).orderBy("h", "doc_id")
    few = labelled.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64(F.xxhash64("doc_id"))).withColumn("k", F.row_number().over(part)).filter(F.col("k") <= most)
    few = table_of(few.select("doc_id", "lang", "h", F.shiftright("h", 56).alias("bin")))
    # 256 bins of the hash: those before the last are taken whole, only the one that the bound falls in is ranked
    bins = few.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("room", most - before).filter("room > 0").select(F.col("lang").alias("b_lang"), F.col("bin").alias("b_bin"), "room", (F.col("n") <= F.col("room")).alias("whole"))
    held = few.join(F.broadcast(bins), (F.col("lang") == F.col("b_lang")) & (F.col("bin") == F.col("b_bin")))
    last = held.filter("not whole").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter("k <= room")
    chosen = held.filter("whole").select("doc_id", "lang").union(last.select("doc_id", "lang"))
    rows = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text")):
                seen.update((lang, w) for w in words_of(t.as_py()))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], schema=schema)

    return table_of(rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))


def fit(labelled: DataFrame, vocabulary: str = MODEL, most: int = SAMPLE) -> Model:
    """Fits the piece probabilities on a bounded sample of each language's labelled rows (doc_id, text, lang); the driver gets sums for pieces and languages only."""
    with Scratch(labelled.sparkSession) as kept:
        return _fitted(sample_words(labelled, most, kept), vocabulary)


def _fitted(counted: DataFrame, vocabulary: str) -> Model:
    """Expectation maximisation over lang, word, n."""
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    size = lattice(vocabulary).size
    p = np.vstack([np.full((size, len(langs)), 1.0 / size), np.zeros((1, len(langs)))])
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("e", pa.float64())])
    for _ in range(ROUNDS if langs else 0):
        shared = counted.sparkSession.sparkContext.broadcast(p)

        @released
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lat = lattice(vocabulary)
            sums = {}
            for b in batches:
                lang, word, n = np.array(b.column("lang").to_pylist(), object), b.column("word").to_pylist(), np.asarray(b.column("n"), float)
                for k in set(lang):
                    at = np.flatnonzero(lang == k)
                    sums[k] = sums.get(k, 0) + expected(lat, [word[i] for i in at], n[at], shared.value[:, langs.index(k)])
            for k, e in sums.items():
                ids = np.flatnonzero(e)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(ids)), pa.array(ids.astype(np.int32)), pa.array(e[ids])], schema=schema)

        # rounded, so that the order of summation leaves no trace
        sums = counted.mapInArrow(run, "lang string, piece int, e double").groupBy("lang", "piece").agg(F.round(F.sum("e"), 6).alias("e"))
        counts = np.zeros((size, len(langs)))
        for r in sums.collect():
            counts[r.piece, langs.index(r.lang)] = r.e
        p = smoothed(counts)
    return Model(langs, p, vocabulary)


class Scorer:
    """Log probabilities of texts, with up to ``most`` words remembered in tables of fixed size."""

    def __init__(self, model: Model, most: int = REMEMBERED):
        self.model, self.lat, self.most = model, lattice(model.vocabulary), most
        self.known: dict[str, int] = {}
        self.table = np.empty((most, len(model.langs)))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text the log probability under each language; None without letters.

        Words are looked up a part of a text at a time, so what is held at once doesn't
        follow a text's length.
        """
        out: list[np.ndarray | None] = [None] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for k, t in enumerate(texts):
            for part in parts_of(t or ""):
                if words := words_of(part):
                    waiting.append((k, words))
                    size += len(words)
                if size >= GROUP:
                    self._add(waiting, out)
                    waiting, size = [], 0
        self._add(waiting, out)
        return out

    def _add(self, waiting: list[tuple[int, list[str]]], out: list[np.ndarray | None]) -> None:
        words = set().union(*(w for _, w in waiting))
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, list(words)
        if len(new) > len(self.table):  # a part's words alone
            self.table = np.empty((len(new), len(self.model.langs)))
        if new:
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new))))
            self.table[at : at + len(new)] = forward(self.lat, new, self.model.p)
        for k, w in waiting:
            found = self.table[np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))].sum(0)
            out[k] = found if out[k] is None else out[k] + found


#: The scorer of the last model that a worker has served; its size is bounded.
_scorers: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    if model.name not in _scorers:  # a worker serves many tasks
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, and the columns of docs named in ``keep`` as they are.

    score is the predicted language's posterior under equal priors; equal
    probabilities go to the language that sorts first. Null and empty texts and texts
    without letters get ``und`` and 0, as does every text if the model has no languages.
    A run of over 1,024 letters counts as several words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    # a text goes to Python once, and comes back only if it is kept
    other = [c for c in keep if c != text_col]
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in other))
    names = [*(["text"] if text_col in keep else []), *(f"keep_{c}" for c in other)]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        score = scorer(m)
        for b in batches:
            out = []
            for x in score(b.column("text").to_pylist()) if m.langs else [None] * b.num_rows:
                if x is None:
                    out.append((NONE, 0.0))
                else:
                    k = int(x.argmax())
                    out.append((m.langs[k], float(1 / np.exp(np.minimum(x - x[k], 0)).sum())))
            said = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 2, (pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *said, *(b.column(c) for c in names)], names=["doc_id", "lang_pred", "score", *names])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *asked.select(*names).schema.fields])
    kept = [F.col("text" if c == text_col else f"keep_{c}").alias(c) for c in keep]
    return asked.mapInArrow(run, schema).select("doc_id", "lang_pred", "score", *kept)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    return predict(docs, fit(known)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
