"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``TRAIN_ROWS``, by hash of doc_id) is the
   only thing learned from. Words and word stems that toxic rows of the sample
   use far more often than chance form a lexicon.
2. The lexicon is dealt over many voters; pattern voters (stems, shouting, runs
   of exclamation marks, a lack of hits) join them. Each votes toxic, clean or
   abstains on a text.
3. A generative label model estimates each voter's accuracy and the pairwise
   correlation of voters from their votes alone (expectation maximisation
   with votes of correlated voters discounted). It gives every sampled row a
   posterior label.
4. A linear classifier learns the posteriors from rates of hits, and is
   calibrated on the sample's labels. It scores every whole text.

Null texts count as empty. Empty texts get the score of a text without hits.
Rows are scored one by one, so repeated rows and ties need no rule. Without
both toxic and clean rows to learn from, every score is 0. Extra columns of
the documents are ignored by ``score_documents`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import chunks, words
from skirmish.session import cut

# Labelled rows learned from, at most.
TRAIN_ROWS = 20_000
# Lexicon entries of each kind (words, stems), at most; the strongest stay.
LEXICON = 1_000
# Texts of the sample that must hold an entry, and its least excess in
# standard deviations of chance.
SUPPORT, EXCESS = 4, 5.5
WORD_VOTERS, STEM_VOTERS, STEM = 10, 4, 5
# Bound of the linear classifier before its scale is fitted; only against overflow.
LIMIT = 200.0
CUTOFF = 0.7
_PUNCTUATION = "!?.,;:\"'()[]{}<>|*#%&$_-+=/\\~`"


@dataclass
class Model:
    """What scoring needs: the lexicon, voters' figures and the linear classifier."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    platt: tuple[float, float] = (1.0, 0.0)
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _bare(word: str) -> str:
    return word.strip(_PUNCTUATION).lower()


def _stem(word: str) -> str:
    return word[:STEM] if len(word) > STEM else ""


def _presence(batches):
    """(term, toxic texts, clean texts) of each chunk; stems carry a leading blank."""
    for batch in batches:
        for part in chunks(batch):
            codes, lengths, vocabulary = words(part.column("text"))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            bare = [_bare(w) for w in vocabulary]
            for terms in (bare, [" " + _stem(w) if _stem(w) else "" for w in bare]):
                named, inverse = np.unique(np.array(terms, dtype=object), return_inverse=True)
                if not len(named):
                    continue
                pair = np.unique(owner * len(named) + inverse[codes])
                text, term = pair // len(named), pair % len(named)
                bad = np.bincount(term, toxic[text], len(named)).astype(np.int64)
                all_ = np.bincount(term, minlength=len(named))
                keep = np.array([t != "" for t in named]) & (all_ > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(named[keep].tolist(), pa.string()),
                        pa.array(bad[keep]),
                        pa.array((all_ - bad)[keep]),
                    ],
                    ["term", "bad", "good"],
                )


def _feature_names() -> int:
    return 2 * (WORD_VOTERS + STEM_VOTERS) + 6


def _features(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(features, votes) of each text. Votes: 1 toxic, -1 clean, 0 abstains."""
    codes, lengths, vocabulary = words(texts)
    n, groups = len(lengths), WORD_VOTERS + STEM_VOTERS
    owner = np.repeat(np.arange(n), lengths)
    bare = [_bare(w) for w in vocabulary]
    hits = np.zeros((n, groups))
    by_word = np.array([model.words.get(w, -1) for w in bare], dtype=np.int64)
    by_stem = np.array([model.stems.get(_stem(w), -1) for w in bare], dtype=np.int64)
    by_stem[by_word >= 0] = -1  # a listed word is not counted again by its stem
    for table, first in ((by_word, 0), (by_stem, WORD_VOTERS)):
        if len(codes):
            group = table[codes]
            hit = group >= 0
            np.add.at(hits, (owner[hit], group[hit] + first), 1)
    shouted = np.array([len(w) > 2 and w.isupper() for w in vocabulary], dtype=float)
    marked = np.array(["!!" in w for w in vocabulary], dtype=float)
    count = np.maximum(lengths, 1)
    loud, marks = (
        np.bincount(owner, flag[codes], n) / count if len(codes) else np.zeros(n)
        for flag in (shouted, marked)
    )
    word_hits, stem_hits = hits[:, :WORD_VOTERS].sum(1), hits[:, WORD_VOTERS:].sum(1)
    rates = hits / count[:, None]
    features = np.column_stack(
        [
            np.log1p(200 * rates),
            hits > 0,
            np.log1p(200 * word_hits / count),
            np.log1p(200 * stem_hits / count),
            word_hits > 0,
            (hits[:, :WORD_VOTERS] > 0).sum(1),
            loud,
            marks,
        ]
    ).astype(float)
    votes = np.zeros((n, groups + 5), np.int8)
    votes[:, :groups] = hits > 0
    votes[:, groups] = np.where(word_hits / count > 0.005, 1, np.where(word_hits == 0, -1, 0))
    votes[:, groups + 1] = np.where((word_hits == 0) & (stem_hits <= 1), -1, 0)
    votes[:, groups + 2] = np.where(word_hits + stem_hits >= 3, 1, np.where(word_hits == 0, -1, 0))
    votes[:, groups + 3] = np.where(loud > 0.5, 1, 0)
    votes[:, groups + 4] = np.where((marks == 0) & (stem_hits == 0), -1, 0)
    return features, votes


def _balanced(odds: np.ndarray, prior: float) -> np.ndarray:
    """Probabilities from log odds, moved so that their mean is the prior.

    Without that the toxic class drifts to whatever other group of documents draws votes.
    """
    low, high = -60.0 - odds.max(initial=0), 60.0 - odds.min(initial=0)
    for _ in range(60):
        shift = (low + high) / 2
        found = 1 / (1 + np.exp(-np.clip(odds + shift, -30, 30)))
        low, high = (low, shift) if found.mean() > prior else (shift, high)
    return found


def label_model(votes: np.ndarray, prior: float, rounds: int = 50):
    """Posterior of the toxic class for each row, voters' accuracies, correlations.

    Each voter has its own odds of voting toxic, clean or not at all in either
    class. Correlations are those of votes within a class; a voter's say is
    divided by 1 plus the sum of its squared correlations with the others, so
    that copies of one opinion count about once.
    """
    n, m = votes.shape
    shown = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    lean = votes.sum(1)
    # voters lean one way at the start; the most toxic share is the prior
    start = np.quantile(lean, 1 - prior) if n else 0
    posterior = np.where(lean > start, 0.9, np.where(lean == start, prior, 0.05))
    say, corr = np.ones(m), np.eye(m)
    table = np.zeros((2, m, 3))
    for step in range(rounds):
        weight = np.stack([1 - posterior, posterior], 1)
        for c in (0, 1):
            table[c] = (np.einsum("n,nmk->mk", weight[:, c], shown) + 0.5) / (weight[:, c].sum() + 1.5)
        if step % 5 == 4:
            left = np.zeros((n, m))
            for c in (0, 1):
                left += weight[:, c, None] * (votes - (table[c] @ np.array([-1.0, 0, 1]))[None])
            spread = left.std(0)
            alive = spread > 1e-6
            corr = np.eye(m)
            if alive.sum() > 1:
                corr[np.ix_(alive, alive)] = np.corrcoef(left[:, alive].T)
            say = 1 / (1 + (corr**2).sum(1) - 1)
        odds = np.einsum("nmk,mk->n", shown * say[None, :, None], np.log(table[1] / table[0]))
        new = _balanced(odds, prior)
        if np.abs(new - posterior).max(initial=0) < 1e-6 and step > 10:
            break
        posterior = new
    right = table[1, :, 2] * prior + table[0, :, 0] * (1 - prior)
    cast = right + table[0, :, 2] * (1 - prior) + table[1, :, 0] * prior
    return posterior, right / np.maximum(cast, 1e-9), corr


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Labelled rows to learn from, never held-out ones: (doc_id, text, toxic).

    A doc_id with contradicting labels counts as toxic if any says so.
    """
    ids = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("long").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # at most TRAIN_ROWS ids: bounded, so broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    # copies say nothing new, and would make every word of theirs look telling
    once = found.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")).agg(
        F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d"), F.max("toxic").alias("toxic")
    )
    return once.orderBy("_text").limit(rows).select("d.doc_id", "d.text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn a model from at most ``rows`` labelled documents."""
    picked = cut(sample(docs, labels, rows))
    sizes = picked.agg(
        F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))
    ).first()
    bad, good = int(sizes[0]), int(sizes[1])
    model = Model()
    if not bad or not good:
        return model
    share = bad / (bad + good)
    terms = (
        picked.mapInArrow(_presence, "term string, bad long, good long")
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .withColumn("chance", (F.col("bad") + F.col("good")) * F.lit(share))
        .withColumn("excess", (F.col("bad") - F.col("chance")) / F.sqrt(F.col("chance") * (1 - share)))
        .where((F.col("bad") >= SUPPORT) & (F.col("excess") >= EXCESS))
        .where(F.col("bad") >= F.col("good"))
    )
    for stem in (False, True):
        strongest = (
            terms.where(F.col("term").startswith(" ") if stem else ~F.col("term").startswith(" "))
            .orderBy(F.col("excess").desc(), "term")
            .limit(LEXICON)
            .select("term")
            .collect()
        )
        voters = STEM_VOTERS if stem else WORD_VOTERS
        entries = {r.term.strip(): i % voters for i, r in enumerate(strongest)}
        if stem:
            model.stems = entries
        else:
            model.words = entries

    def seen(batches, model=model):
        for batch in batches:
            for part in chunks(batch):
                x, v = _features(part.column("text"), model)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("toxic"),
                        pa.array(x.tolist(), pa.list_(pa.float64())),
                        pa.array(v.tolist(), pa.list_(pa.int32())),
                    ],
                    ["doc_id", "toxic", "x", "v"],
                )

    rows_seen: pd.DataFrame = picked.mapInArrow(
        seen, "doc_id long, toxic long, x array<double>, v array<int>"
    ).toPandas()
    rows_seen = rows_seen.sort_values("doc_id", kind="stable")
    x = np.stack(rows_seen["x"].to_numpy())
    votes = np.stack(rows_seen["v"].to_numpy()).astype(np.int8)
    truth = rows_seen["toxic"].to_numpy().astype(float)
    posterior, model.accuracies, model.correlations = label_model(votes, share)
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - model.centre) / model.scale
    model.weights = _logistic(x, posterior, 1.0)
    raw = x @ model.weights[:-1] + model.weights[-1]
    slope, shift = _logistic(np.clip(raw, -LIMIT, LIMIT)[:, None], truth, 0.1)
    # the posterior's direction is kept; only its scale and offset follow the labels
    model.platt = (max(float(slope), 1e-3), float(shift))
    return model


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Scores from 0 to 1 of texts; 0 for a model that had nothing to learn from."""
    if model.weights is None:
        return np.zeros(len(texts))
    x, _ = _features(texts, model)
    raw = (x - model.centre) / model.scale @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-(np.clip(raw, -LIMIT, LIMIT) * model.platt[0] + model.platt[1])))


def _scored(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """(row: struct of the kept columns, score); no column of the documents can clash."""
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def scored(batches, model=model):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(scores(part.column("text"), model))],
                    ["row", "score"],
                )

    return inside.mapInArrow(scored, inside.select("row").schema.add("score", "double"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document."""
    out = _scored(docs, ["doc_id"], model)
    return out.select("row.doc_id", "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below the cut-off, with all their columns."""
    return _scored(docs, docs.columns, model).where(F.col("score") < CUTOFF).select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
