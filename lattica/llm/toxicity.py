"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters. A seed lexicon, plus words and word beginnings that labelled training documents prove to
   be telling. They are found in a bounded sample of labelled rows (``MAX_LABELLED``, chosen by the hash
   of the id); at most ``MOST_VOTERS`` are kept. Each is one voter: it votes when a text holds the
   pattern. Pattern voters for the number and the density of hits join them.
2. Label model. For each of the two hidden classes the votes have a mean, the voter's accuracy, and all
   have a common covariance, their correlations. Expectation-maximisation estimates them from all
   documents, labelled or not, starting from the sample's labels; each round is one sum over partitions.
   Correlated voters share their weight, since the covariance is inverted as a whole.
3. A logistic classifier on the votes and densities is fitted to the posterior labels of all documents
   by Newton steps, again on partition sums. Its score is calibrated by isotonic regression on labels
   of the training fold.

Words are runs of letters (A-Z lower-cased, and any byte above 0x7F). Labels are learned from outside the
held-out fold only; a score depends on the text alone.

Defined cases: a null or empty text has no votes and gets the score of such texts. Several labels of
one document are averaged. Repeated rows are scored each, extra columns are ignored, an empty table
gives an empty result. Without labels the seed lexicon votes alone.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.bpe import HashTable
from lattica.llm.common import LOWER, U64, blocks, discard, in_crc, materialize, mix, powers, texts, utf8
from lattica.llm.quality_classifier import isotonic
from lattica.llm.textstats import column_matrix, matrix_column, summed

# Words of abuse that start the lexicon.
SEEDS = ["stupid", "idiot", "moron", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown"]
#: Labelled rows that patterns are sought in, and patterns kept.
MAX_LABELLED, MOST_VOTERS = 20_000, 96
#: Lengths in bytes of word beginnings; 0 is the whole word.
PREFIXES = [0, 4, 5, 6, 7]
LEAST_HITS, LEAST_ODDS, LEAST_GAIN = 5, 12.0, 4
#: Patterns that the choice is made from, and buckets that texts of the sample are told apart by.
CANDIDATES, TEXTS = 1000, 1 << 30
#: Rounds of estimation end once no coefficient moves by more than this share of the largest.
#: ``MOST_ROUNDS`` only guards against estimates that swing for ever; a warning tells if it is met.
STILL, MOST_ROUNDS, BINS = 0.02, 60, 1024
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def pattern_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each of ``PREFIXES`` a hash of each word (0 where it is too short), and the words' rows."""
    solid = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = solid & np.r_[True, ~solid[:-1]] | solid & edge[:-1] if len(raw) else solid
    last = solid & np.r_[~solid[1:], True] | solid & edge[1:] if len(raw) else solid
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((LOWER[raw].astype(U64) + U64(1)) * up[:len(raw)], out=total[1:])
    out = []
    for k in PREFIXES:
        to = ends if not k else np.minimum(starts + k, ends)
        h = mix((total[to] - total[starts]) * down[starts] + U64((k + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) | U64(1)
        out.append(h if not k else np.where(ends - starts > k, h, U64(0)))
    return out, np.searchsorted(offsets, starts, side="right") - 1


def seed_hashes() -> list[int]:
    data = " ".join(SEEDS).encode()
    return [int(x) for x in pattern_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0][0]]


def find_patterns(docs: DataFrame, y: DataFrame) -> list[int]:
    """Hashes of the most telling patterns of labelled documents, seeds first."""
    labelled = y.count()
    per = min(1.0, MAX_LABELLED / max(1, labelled))
    sample = y.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(per * (1 << 20)))

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            toxic = batch.column(2).to_numpy(zero_copy_only=False) >= 0.5
            for a, b in blocks(offsets):
                hashes, row = pattern_hashes(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                h = np.concatenate(hashes)
                r = np.tile(row, len(hashes))
                order = np.lexsort((r, h))
                h, r = h[order], r[order]
                new = (h != 0) & np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else h != 0
                h, bad = h[new], toxic[a:b][r[new]]
                u, inv = np.unique(h, return_inverse=True)
                pos = np.bincount(inv, bad, len(u)).astype(np.int64)
                some = pos > 0
                n = np.bincount(inv, minlength=len(u))
                yield pa.RecordBatch.from_arrays([pa.array(u[some].view(np.int64)), pa.array(pos[some]), pa.array((n - pos)[some])], ["h", "pos", "neg"])
                # patterns of clean texts count against those of toxic ones; their own are not needed
                yield pa.RecordBatch.from_arrays([pa.array(u[~some].view(np.int64)), pa.array(np.zeros((~some).sum(), np.int64)), pa.array(n[~some])], ["h", "pos", "neg"])

    slim = texts(docs)
    # the sample has about MAX_LABELLED ids at most, so it is broadcast and only its texts are written
    joined = materialize(slim.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y"))
    totals = joined.agg(F.sum((F.col("y") >= 0.5).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    base = max(1, totals["pos"] or 0) / max(1, totals["n"] - (totals["pos"] or 0))
    counts = joined.mapInArrow(run, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = (F.col("pos") + 0.5) / (F.col("neg") + 1.0) / base
    best = counts.where((F.col("pos") >= LEAST_HITS) & (odds >= LEAST_ODDS)).select("h", (F.log(odds) * F.sqrt("pos")).alias("worth")).orderBy(F.desc("worth"), "h").limit(CANDIDATES).collect()
    worth = {r["h"] & 0xFFFFFFFFFFFFFFFF: r["worth"] for r in best}
    seeds = seed_hashes()
    candidates = [*seeds, *(h for h in worth if h not in set(seeds))]

    def held(batches):
        table = HashTable(14)
        table.add(np.array(candidates, U64))
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            toxic = batch.column(2).to_numpy(zero_copy_only=False) >= 0.5
            for a, b in blocks(offsets):
                own = offsets[a:b + 1] - offsets[a]
                part = raw[offsets[a]:offsets[b]]
                text = np.array([zlib.crc32(part[x:y]) % TEXTS for x, y in zip(own[:-1], own[1:], strict=True)], np.int64)
                hashes, row = pattern_hashes(part, own)
                pairs = [np.stack([place[on], text[row[on]]], 1) for h in hashes for place in [table.find(h)] for on in [np.flatnonzero((place >= 0) & (h != 0) & toxic[a:b][row])]]
                pairs = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["place", "text"])

    found = {r["place"]: set(r["texts"]) for r in joined.mapInArrow(held, "place long, text long").groupBy("place").agg(F.collect_set("text").alias("texts")).collect()}
    discard(joined)
    return _cover(candidates, found, worth, len(seeds))


def _cover(candidates: list[int], covers: dict[int, set], worth: dict[int, float], n_seeds: int) -> list[int]:
    """Seeds, then greedily the patterns that most toxic texts need that fewer than two chosen ones hold.

    Copies of a text count once, so words of one much-copied text are not taken for a lexicon.
    """
    times: dict[int, int] = {}
    chosen = list(range(n_seeds))
    for c in chosen:
        for t in covers.get(c, ()):
            times[t] = times.get(t, 0) + 1
    left = {c for c in covers if c >= n_seeds}
    while left and len(chosen) < MOST_VOTERS:
        gain = {c: sum(times.get(t, 0) < 2 for t in covers[c]) for c in left}
        c = max(left, key=lambda x: (gain[x], worth.get(candidates[x], 0), -x))
        if gain[c] < LEAST_GAIN:
            break
        chosen.append(c)
        left = {x for x in left if gain[x] >= LEAST_GAIN and x != c}
        for t in covers[c]:
            times[t] = times.get(t, 0) + 1
    return [candidates[c] for c in chosen]


def votes_of(docs: DataFrame, patterns: list[int]) -> DataFrame:
    """(doc_id, votes array<double>): a vote of each pattern, then hits, density and their logarithms."""
    def run(batches):
        table = HashTable(12)
        table.add(np.array(patterns, U64))
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            parts = [block_votes(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], table, len(patterns)) for a, b in blocks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), matrix_column(np.concatenate(parts or [np.zeros((0, len(patterns) + 3))]))], ["doc_id", "votes"])

    slim = texts(docs)
    return slim.mapInArrow(run, "doc_id long, votes array<double>")


def block_votes(raw: np.ndarray, offsets: np.ndarray, table: HashTable, m: int) -> np.ndarray:
    n = len(offsets) - 1
    hashes, row = pattern_hashes(raw, offsets)
    out, words, hits = np.zeros((n, m + 3)), np.bincount(row, minlength=n), np.zeros(n)
    any_hit = np.zeros(len(row), bool)
    for h in hashes:
        place = table.find(h)
        got = np.flatnonzero((place >= 0) & (h != 0))
        out[row[got], place[got]] = 1
        any_hit[got] = True
    hits = np.bincount(row[any_hit], minlength=n)
    out[:, m], out[:, m + 1], out[:, m + 2] = hits > 0, np.log1p(hits), np.minimum(1, 20 * hits / np.maximum(1, words))
    return out


def _gaussian(mean: np.ndarray, cov: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the log-odds of two classes with means ``mean`` and one covariance."""
    w = np.linalg.solve(cov, mean[1] - mean[0])
    return w, float(np.log(prior / (1 - prior)) - w @ (mean[0] + mean[1]) / 2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def label_model(votes: DataFrame, labelled: DataFrame, d: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the posterior of the hidden class, by expectation-maximisation over all documents."""
    def moments(x, q):
        return np.r_[np.c_[x.T @ x, x.T @ q, x.sum(0)], [np.r_[np.zeros(d), q.sum(), len(q)]]]

    def estimate(s):
        n1, n = s[d, d], s[d, d + 1]
        n1 = min(max(n1, 1.0), max(n - 1.0, 1.0))
        m1, m0 = s[:d, d] / n1, (s[:d, d + 1] - s[:d, d]) / max(1.0, n - n1)
        cov = s[:d, :d] / n - n1 / n * np.outer(m1, m1) - (1 - n1 / n) * np.outer(m0, m0)
        return _gaussian(np.stack([m0, m1]), cov + 0.02 * np.eye(d), min(0.5, max(0.01, n1 / n)))

    first = summed(labelled, lambda b: moments(column_matrix(b.column(0), d), b.column(1).to_numpy(zero_copy_only=False)), d + 2)
    if len(first) and 0 < first[d, d] < first[d, d + 1]:
        w, b0 = estimate(first)
    else:
        w, b0 = np.r_[np.ones(len(SEEDS)), np.zeros(d - len(SEEDS))] * 4, -2.0
    for _ in range(MOST_ROUNDS):
        def expected(batch, w=w, b0=b0):
            x = column_matrix(batch.column(0), d)
            return moments(x, _sigmoid(x @ w + b0))

        s = summed(votes.select("votes"), expected, d + 2)
        if not len(s):
            return w, b0
        before, (w, b0) = np.r_[w, b0], estimate(s)
        if _still(before, np.r_[w, b0]):
            return w, b0
    warnings.warn("the label model did not settle", stacklevel=2)
    return w, b0


def _still(before: np.ndarray, after: np.ndarray) -> bool:
    return np.abs(after - before).max() <= STILL * np.abs(after).max()


def linear_classifier(votes: DataFrame, w: np.ndarray, b0: float, d: int) -> np.ndarray:
    """Logistic regression on posterior labels by Newton steps; the last coefficient is the constant."""
    beta = np.zeros(d + 1)
    for _ in range(MOST_ROUNDS):
        def step(batch, beta=beta):
            x = column_matrix(batch.column(0), d)
            z = np.c_[x, np.ones(len(x))]
            p, q = _sigmoid(z @ beta), _sigmoid(x @ w + b0)
            return np.c_[(z * (p * (1 - p) + 1e-4)[:, None]).T @ z, z.T @ (q - p), np.full(d + 1, len(x))]

        s = summed(votes.select("votes"), step, d + 3)
        if not len(s):
            return beta
        ridge = 1e-3 * s[0, d + 2] * np.diag([1.0] * d + [1e-6])
        before, beta = beta, beta + np.linalg.solve(s[:, :d + 1] + ridge, s[:, d + 1] - ridge @ beta)
        if _still(before, beta):
            return beta
    warnings.warn("the classifier did not settle", stacklevel=2)
    return beta


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, modulo: int = 3, rest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = texts(docs, id_col, text_col)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL").where(in_crc("doc_id", modulo, rest, False)).groupBy("doc_id").agg(F.avg("y").alias("y"))
    patterns = find_patterns(docs, y)
    d = len(patterns) + 3
    votes = materialize(votes_of(docs, patterns))
    labelled = votes.join(y, "doc_id").select("votes", "y")
    w, b0 = label_model(votes, labelled, d)
    beta = linear_classifier(votes, w, b0, d)

    def raw(x):
        return np.clip(((x @ beta[:-1] + beta[-1]) / 40 + 0.5) * BINS, 0, BINS - 1)

    def histogram(batch):
        to, t = raw(column_matrix(batch.column(0), d)).astype(int), batch.column(1).to_numpy(zero_copy_only=False)
        return np.stack([np.bincount(to, minlength=BINS), np.bincount(to, t, BINS)]).astype(float)

    h = summed(labelled, histogram, BINS)
    curve = isotonic(h[0], h[1]) if len(h) else _sigmoid((np.arange(BINS) / BINS - 0.5) * 40)

    def run(batches):
        for b in batches:
            score = np.interp(raw(column_matrix(b.column(1), d)) - 0.5, np.arange(BINS), curve)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return votes.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", in_crc("doc_id", modulo, rest, True).alias("held_out"), "score", "predicted")
