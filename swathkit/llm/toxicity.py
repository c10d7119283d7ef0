"""Toxicity by a logistic model with counterfactual regularisation.

Features of a text are the presence of its lower-cased words and of their five-byte beginnings,
hashed into 2**20 places. The model is fitted on a bounded sample of labelled texts. For every
sampled text that names a group (an identity term), a counterfactual is made in which each term is
swapped for another one, and the squared change of the score (the probability, not its logit) is
penalised, so that what a neutral mention of a group adds to a score goes to nothing. Scoring needs
the weights alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._kernels import mix, span_digests, text_slices
from .common import Workspace, arrow_batches, text_key

#: Words for groups of people, singular, plural and as adjectives, in the languages of
#: the corpus; the default of a parameter.
IDENTITY_TERMS = (
    "woman", "women", "female", "man", "men", "male", "girl", "girls", "boy", "boys", "muslim", "muslims", "islamic", "christian", "christians",
    "jew", "jews", "jewish", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists", "catholic", "catholics",
    "immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners", "gay", "gays", "lesbian", "lesbians", "homosexual",
    "bisexual", "transgender", "queer", "black", "blacks", "white", "whites", "asian", "asians", "latino", "latinos", "african", "africans",
    "arab", "arabs", "disabled", "deaf", "blind", "elderly",
    "frau", "frauen", "mann", "männer", "muslimisch", "muslime", "christ", "christen", "christlich", "jude", "juden", "jüdisch",
    "einwanderer", "flüchtling", "flüchtlinge", "ausländer", "schwul", "lesbisch", "behindert",
    "femme", "femmes", "homme", "hommes", "musulman", "musulmans", "musulmane", "chrétien", "chrétiens", "juif", "juifs", "juive",
    "immigré", "immigrés", "réfugié", "réfugiés", "étranger", "étrangers", "noir", "noirs",
    "mujer", "mujeres", "hombre", "hombres", "musulmán", "musulmanes", "cristiano", "cristianos", "judío", "judíos",
    "inmigrante", "inmigrantes", "refugiado", "refugiados", "extranjero", "extranjeros", "negro", "negros",
)
#: Labelled texts that the model is fitted on at most, features that it keeps, and kept features of all
#: these texts together (4 bytes each on the driver: 80 MB).
SAMPLE_ROWS, FEATURES, SAMPLE_FEATURES = 20_000, 20_000, 20_000_000
BITS, PREFIX_BYTES = 20, 5
PENALTY, RIDGE, STEPS = 20.0, 2e-4, 300

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, text number, feature): the distinct features of the texts, slice by slice."""
    lowered = pc.utf8_lower(column.fill_null("") if column.null_count else column)
    for first, last, body, offsets in text_slices(lowered):
        n = len(body)
        letter = _LETTER[body]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = letter[:-1], letter[1:]
        starts = np.flatnonzero(letter & (~before | edge[:n]))
        ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
        owner = np.searchsorted(offsets, starts, side="right") - 1
        whole = span_digests(body, starts, ends)[0] >> np.uint64(64 - BITS)
        long = ends - starts > PREFIX_BYTES
        begin = mix(span_digests(body, starts[long], starts[long] + PREFIX_BYTES)[0] + np.uint64(1)) >> np.uint64(64 - BITS)
        both = np.unique(np.concatenate([owner << BITS | whole.astype(np.int64), owner[long] << BITS | begin.astype(np.int64)]))
        yield first, last, both >> BITS, both & ((1 << BITS) - 1)


def word_features(words: tuple[str, ...]) -> list[np.ndarray]:
    """The features of single words."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    for first, last, owner, feature in features(pa.array(words, pa.string())):
        for k in range(first, last):
            out[k] = feature[owner == k - first]
    return out


@dataclass
class Model:
    """Weights by feature, an intercept, and how many sampled texts gave counterfactuals."""

    weights: np.ndarray
    bias: float
    pairs: int = 0

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, last, owner, feature in features(column):
            out[first:last] = np.bincount(owner, weights=self.weights[feature], minlength=last - first)
        return _logistic(out + self.bias)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(feature: np.ndarray, every: np.ndarray, with1: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Of features held by ``every`` texts, ``with1`` of them with label 1, those that tell the labels apart best."""
    expected = every * n1 / n
    chi = np.where(every >= 3, (with1 - expected) ** 2 / np.maximum(expected * (1 - every / n), 1e-9), 0)
    kept = np.lexsort((feature, -chi))[:FEATURES]
    return feature[kept[chi[kept] > 6]]


def fit(texts: list[np.ndarray], labels: np.ndarray, penalty: float = PENALTY, terms: tuple[str, ...] = IDENTITY_TERMS, steps: int = STEPS) -> Model:
    """Fit on texts given by their features; without both labels, the share of label 1 is the score."""
    feature = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found, at = np.unique(feature, return_inverse=True)
    chosen = telling(found, np.bincount(at, minlength=len(found)), np.bincount(at, weights=labels[owner], minlength=len(found)), max(len(labels), 1), int(labels.sum()))
    return fit_chosen(texts, labels, chosen, penalty, terms, steps)


def fit_chosen(texts: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, penalty: float = PENALTY, terms: tuple[str, ...] = IDENTITY_TERMS, steps: int = STEPS) -> Model:
    """Fit with the ``chosen`` features, and those of identity terms."""
    weights, share = np.zeros(1 << BITS), (labels.sum() + 0.5) / (len(labels) + 1)
    if not len(labels) or labels.min() == labels.max():
        return Model(weights, float(np.log(share / (1 - share))))
    n, n1 = len(labels), labels.sum()
    own = word_features(terms)
    kept = np.unique(np.concatenate([chosen, *own])).astype(np.int64)
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    owner, feature = np.repeat(np.arange(n), [len(t) for t in texts]), np.concatenate(texts)
    used = place[feature] >= 0
    owner, column = owner[used], place[feature[used]]
    # Counterfactuals: what swapping terms adds to, and takes from, the features of a text.
    text_of, shift_row, shift_column, shift_value = [], [], [], []
    rng = np.random.default_rng(7)
    term_of: dict[int, set[int]] = {}
    for k, fs in enumerate(own):
        for f in fs.tolist():
            term_of.setdefault(f, set()).add(k)
    known = np.array(sorted(term_of), np.int64)
    for i, t in enumerate(texts):
        mine = set(t[np.isin(t, known)].tolist())
        named = sorted(k for k in {k for f in mine for k in term_of[f]} if mine.issuperset(own[k].tolist()))
        if not named or len(own) < 2:
            continue
        for k in named:
            other = (k + 1 + int(rng.integers(len(own) - 1))) % len(own)
            for fs, value in ((own[k], -1.0), (own[other], 1.0)):
                shift_row += [len(text_of)] * len(fs)
                shift_column += place[fs].tolist()
                shift_value += [value] * len(fs)
        text_of.append(i)
    pairs = len(text_of)
    text_of, shift_row, shift_column, shift_value = np.array(text_of, np.int64), np.array(shift_row, np.int64), np.array(shift_column, np.int64), np.array(shift_value)
    w, bias, m, v = np.zeros(len(kept)), float(np.log(share / (1 - share))), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / (n - n1))  # both labels count the same
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[column], minlength=n) + bias
        p = _logistic(z)
        error, swapped = (p - labels) * weight, 0.0
        if pairs:
            other = _logistic(z[text_of] + np.bincount(shift_row, weights=shift_value * w[shift_column], minlength=pairs))
            slope = penalty * 2 / pairs * (other - p[text_of])
            error[text_of] += slope * (other * (1 - other) - p[text_of] * (1 - p[text_of]))
            swapped = np.bincount(shift_column, weights=shift_value * (slope * other * (1 - other))[shift_row], minlength=len(kept))
        g = np.append(np.bincount(column, weights=error[owner], minlength=len(kept)) + swapped + RIDGE * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    weights[kept] = w
    return Model(weights, float(bias), pairs)


def held_out() -> F.Column:
    """Documents that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, work: Workspace, rows: int = SAMPLE_ROWS, terms: tuple[str, ...] = IDENTITY_TERMS) -> Model:
    """Fit on at most ``rows`` labelled documents, those with the smallest hashes of their ids, and of these
    on as many as have ``SAMPLE_FEATURES`` kept features together.

    Labels that are neither 0 nor 1 are left out; of several labels of a document the larger holds, of
    several texts that share a doc_id the one with the smallest key. Null and empty texts have no
    features. Without labels, or with one kind only, every text gets the same score.
    """
    arrow_batches(docs.sparkSession)
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` short rows: a proven bound for the broadcast. Texts of one doc_id combine before the shuffle.
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = joined.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(text_key(F.col("text")), F.col("text").isNull())).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, owner, feature in features(batch.column(2)):
                n = last - first
                offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n).cast(pa.int32()), lists], names=["doc_id", "toxic", "features"])

    held = work.save(one.mapInArrow(extract, "doc_id long, toxic int, features array<int>"), "sample")
    n, n1 = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or n1 in (0, n):
        return fit([], np.zeros(0, np.int64)) if not n else Model(np.zeros(1 << BITS), float(np.log((n1 + 0.5) / (n - n1 + 0.5))))
    # Counts per feature, at most 2 ** BITS rows, are combined; the chosen FEATURES alone come to the driver.
    counts = held.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("every"), F.sum("toxic").alias("with1")).where("every >= 3")
    expected = F.col("every") * (n1 / n)
    chi = F.pow(F.col("with1") - expected, 2) / F.greatest(expected * (1 - F.col("every") / n), F.lit(1e-9))
    top = counts.withColumn("chi", chi).where("chi > 6").orderBy(F.desc("chi"), "f").limit(FEATURES).select("f").toArrow()
    chosen = top["f"].to_numpy().astype(np.int64)
    kept = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([chosen, *word_features(terms)])))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            number, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
            good = np.isin(flat, kept.value)
            left = np.bincount(np.repeat(np.arange(len(number)), number)[good], minlength=len(number))
            offsets = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[good]))], names=["doc_id", "toxic", "features"])

    small = work.save(held.mapInArrow(keep, "doc_id long, toxic int, features array<int>"), "kept")
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = small.select("doc_id", F.sum(F.size("features")).over(order).alias("sum"))  # at most ``rows`` rows
    found = small.join(F.broadcast(sizes.where(F.col("sum") <= SAMPLE_FEATURES).select("doc_id")), "doc_id").toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    lists = found["features"].chunk(0) if found.num_rows else pa.array([], pa.list_(pa.int32()))
    values, offsets = lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    work.drop("sample", "kept")
    return fit_chosen([values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], found["toxic"].to_numpy().astype(np.int64), chosen, terms=terms)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts have no features, so their score is the intercept's; texts of any length are
    scored whole. A null doc_id is not held out. Repeated rows give repeated results, an empty table an empty one; other columns are
    not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    used = np.flatnonzero(model.weights)
    sent = spark.sparkContext.broadcast((used, model.weights[used], model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = sent.value
        weights = np.zeros(1 << BITS)
        weights[at] = values
        own = Model(weights, bias)
        for batch in batches:
            p = own.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
