"""Mixing sources to target weights by soft membership.

1. Domains come from a labelled table: ``junk`` (quality 0), else ``toxic`` (toxic 1), else ``clean``. A
   classifier on text statistics and lexicon hits (random Fourier features, one ridge regression per
   domain, isotonic calibration) gives every document its posterior of each domain.
2. Every document gets a rate >= 0, the number of times it is to be read. The expected tokens of domain k
   are the sum over documents of rate * tokens * posterior of k. Projected gradient steps on the squared
   distance to the targets, from rate 1 for all, fit the rates: a step moves each rate along the
   document's posteriors and projects it onto [0, ``MAX_RATE``]. The gradient is preconditioned by the
   (domains x domains) matrix of the documents that can still move. A step needs only that matrix and
   the domain totals, one sum over partitions; a document's rate follows from its own posteriors and the
   list of past steps, so no table of rates is kept or rewritten.
3. ``copies`` rounds the rate, plus a small shift along the document's posteriors, to whole repetitions by a hash of
   doc_id. Rounding is right on average only, and long documents weigh much; so the shift is fitted like the
   rates, to the totals that the rounded copies deliver, until these no longer come closer to the targets.
   ``shares`` states target, fitted and delivered shares.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. ``MAX_RATE`` bounds repetition; if targets cannot be met within
it, the rates are the nearest that can.

Defined cases: a null or empty text has no tokens and some posterior. Repeated rows get the same rate.
Extra columns pass through; an empty table gives an empty result. Without labels all domains are
equally likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import quality_classifier as qc
from lattica.llm.bpe import HashTable
from lattica.llm.common import U64, any_names, blocks, discard, materialize, texts, utf8
from lattica.llm.textstats import NAMES, block_stats, column_matrix, matrix_column, summed
from lattica.llm.toxicity import block_votes, find_patterns

DOMAINS = ["clean", "toxic", "junk"]
#: Shares of all tokens that production asks for.
TARGETS = {"clean": 0.95, "toxic": 0.04, "junk": 0.01}
MAX_RATE, CLOSE, RIDGE, SEED = 4.0, 1e-5, 1e-3, 23
_D = len(NAMES) + 3


def _stats(raw: np.ndarray, offsets: np.ndarray, patterns: list[int]) -> np.ndarray:
    table = HashTable(12)
    table.add(np.array(patterns, U64))
    parts = [np.c_[block_stats(r, o), block_votes(r, o, table, len(patterns))[:, -3:]] for a, b in blocks(offsets) for r, o in [(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])]]
    return np.concatenate(parts or [np.zeros((0, _D))])


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y array): one-hot domains; several labels of a document are averaged."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("domain IS NOT NULL")
    shares = one.groupBy("doc_id").agg(*[F.avg((F.col("domain") == d).cast("double")).alias(d) for d in DOMAINS])
    return shares.select("doc_id", F.array(*DOMAINS).alias("y"))


def fit_domains(docs: DataFrame, labels: DataFrame) -> dict:
    """The classifier: patterns, standardisation, ridge weights and calibration curves of each domain."""
    y = domain_labels(labels)
    patterns = find_patterns(docs, y.select("doc_id", F.col("y")[1].alias("y")))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), matrix_column(_stats(*utf8(b.column(1)), patterns))], ["doc_id", "stats"])

    stats = materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>"))
    train = stats.join(y, "doc_id").select("stats", "y")
    k = len(DOMAINS)

    def moments(b):
        x = column_matrix(b.column(0), _D)
        return np.stack([np.full(_D, len(x)), x.sum(0), (x * x).sum(0)])

    m = summed(train, moments, _D)
    model = {"patterns": patterns, "stats": stats}
    if not len(m):
        return model | {"mean": np.zeros(_D), "std": np.ones(_D), "beta": np.zeros((qc.FEATURES + 1, k)), "curves": np.full((k, qc.BINS), 1 / k)}
    mean = m[1] / m[0]
    std = np.sqrt(np.maximum(m[2] / m[0] - mean ** 2, 1e-12)) + 1e-6

    def normal(b):
        f = qc._features(column_matrix(b.column(0), _D), mean, std)
        return np.c_[f.T @ f, f.T @ column_matrix(b.column(1), k)]

    n = summed(train, normal, qc.FEATURES + 1 + k)
    beta = np.linalg.solve(n[:, :-k] + qc.RIDGE * m[0, 0] / qc.FEATURES * np.diag([1.0] * qc.FEATURES + [0.0]), n[:, -k:])

    def histogram(b):
        to = np.clip(_bins(qc._features(column_matrix(b.column(0), _D), mean, std) @ beta), 0, qc.BINS - 1).astype(int)
        t = column_matrix(b.column(1), k)
        return np.stack([np.bincount(to[:, i], w, qc.BINS) for i in range(k) for w in (None, t[:, i])]).astype(float)

    h = summed(train, histogram, qc.BINS)
    return model | {"mean": mean, "std": std, "beta": beta, "curves": np.stack([qc.isotonic(h[2 * i], h[2 * i + 1]) for i in range(k)])}


def _bins(raw: np.ndarray) -> np.ndarray:
    return (raw + 0.5) / 2 * qc.BINS


def posteriors(model: dict, x: np.ndarray) -> np.ndarray:
    """Posterior of each domain for rows of statistics."""
    raw = _bins(qc._features(x, model["mean"], model["std"]) @ model["beta"])
    p = np.stack([np.interp(raw[:, i] - 0.5, np.arange(qc.BINS), c) for i, c in enumerate(model["curves"])], 1) + 1e-9
    return p / p.sum(1, keepdims=True)


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the given steps."""
    r = np.ones(len(p))
    for g in steps:
        r = np.clip(r - p @ g, 0, MAX_RATE)
    return r


def _tokens(x: np.ndarray) -> np.ndarray:
    return np.rint(np.expm1(x[:, 0]))


def copies_of(p: np.ndarray, steps: list[np.ndarray], shift: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Whole repetitions of documents with posteriors ``p`` and uniform shares."""
    return np.floor(np.clip(rates(p, steps) + p @ shift, 0, MAX_RATE) + share).astype(np.int64)


def _wanted(targets: dict[str, float]) -> np.ndarray:
    want = np.array([targets.get(d, 0.0) for d in DOMAINS])
    return want / want.sum()


def fit_rates(stats: DataFrame, model: dict, targets: dict[str, float]) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of projected gradient that bring the expected domain totals to their shares of all tokens, and the shift that brings the rounded ones there.

    Both go on until the targets are met within ``CLOSE`` or a step no longer comes nearer; the best step stays.
    """
    k, want = len(DOMAINS), _wanted(targets)
    model = {x: y for x, y in model.items() if x != "stats"}
    rows = stats.select("stats", _share(F.col("doc_id")).alias("share"))

    def measured(steps, shift):
        """(preconditioner, distance of the totals from the targets), as shares of all tokens; nothing without tokens."""
        def totals(b):
            x = column_matrix(b.column(0), _D)
            p, n = posteriors(model, x), _tokens(x)
            r = rates(p, steps)
            free = n * ((r > 0) & (r < MAX_RATE))
            given = r if shift is None else copies_of(p, steps, shift, b.column(1).to_numpy(zero_copy_only=False))
            return np.c_[(p * free[:, None]).T @ p, p.T @ (n * given), p.T @ n]

        s = summed(rows, totals, k + 2)
        total = s[:, k + 1].sum() if len(s) else 0
        return (s[:, :k] / total + RIDGE * np.eye(k), s[:, k] / total - want) if total else None

    def fitted(at, step):
        """The best of a series of steps, each from the distance that the one before left."""
        best, least = at, np.inf
        while (found := measured(*at)) is not None:
            near = np.abs(found[1]).max()
            if near >= least * 0.99:
                break
            best, least = at, near
            if near < CLOSE:
                break
            at = step(at, np.linalg.solve(*found))
        return best

    steps = fitted(((), None), lambda at, g: ((*at[0], g), None))[0]
    shift = fitted((steps, np.zeros(k)), lambda at, g: (at[0], at[1] - g))[1]
    return list(steps), shift


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, the posterior of each domain, rate, copies."""
    slim = texts(docs, id_col, text_col)
    model = fit_domains(slim, labels)
    stats = model.pop("stats")
    steps, shift = fit_rates(stats, model, targets)

    def run(batches):
        for b in batches:
            x = column_matrix(b.column(1), _D)
            p = posteriors(model, x)
            copies = copies_of(p, steps, shift, b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_tokens(x).astype(np.int64)), *[pa.array(c) for c in p.T], pa.array(rates(p, steps)), pa.array(copies)], ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"])

    return stats.select("doc_id", "stats", _share(F.col("doc_id")).alias("share")).mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double, copies long")


def shares(mixed: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """For each domain its target, and its share of all expected tokens by the fitted rates and by the copies delivered, of rows of ``mix``."""
    want = dict(zip(DOMAINS, _wanted(targets).tolist(), strict=True))
    total = {of: F.sum(F.col("n_tokens") * F.col(of)) for of in ("rate", "copies")}
    one = [F.struct(F.lit(d).alias("domain"), F.lit(want[d]).alias("target"), *[F.try_divide(F.sum(F.col("n_tokens") * F.col(of) * F.col(f"p_{d}")), total[of]).alias(name) for of, name in (("rate", "fitted"), ("copies", "delivered"))]) for d in DOMAINS]
    return mixed.agg(F.array(*one).alias("d")).select(F.explode("d").alias("d")).select("d.*")


def _share(doc_id):
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-1)), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)


@any_names
def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says; the same columns, and no shuffle of texts."""
    slim = texts(docs, id_col, text_col)
    model = fit_domains(slim, labels)
    stats = model.pop("stats")
    steps, shift = fit_rates(stats, model, targets)
    discard(stats)
    names = docs.columns

    def run(batches):
        for b in batches:
            p = posteriors(model, _stats(*utf8(b.column(text_col)), model["patterns"]))
            copies = copies_of(p, steps, shift, b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
            yield b.select(names).take(pa.array(np.repeat(np.arange(b.num_rows), copies)))

    return docs.withColumn("_lattica_share", _share(F.col(id_col))).mapInArrow(run, docs.schema)
