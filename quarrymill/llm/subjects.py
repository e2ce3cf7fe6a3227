"""Subject areas of documents: every subject that a passage of three or more sentences treats.

Method: a chain of classifiers, one per subject, over term, source and structure features and the
subjects decided before it, which models how subjects occur together; a beam search over the chain
finds the likeliest combination under probabilities calibrated for labels that annotators left out.
Nothing but the chain decides: the number of sentences on a subject is one of its features. What
sentences tell is alike for all subjects, so the members of the chain share a prior fitted on all of them.
The term features come from a sentence model of the same labelled sample, fitted by expectation
maximisation, since a label belongs to a document but its evidence to a few sentences.

Scale: models are fitted on the driver from at most ``MAX_LABELLED`` labelled documents, chosen by
the hash of their id, and are of fixed size; every document is then classified in a narrow pass.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 6000
TERM_SLOTS = 1 << 15
LEAST_SENTENCES = 3
BEAM = 8
# Ridge of the prior that the members of the chain share, and of each member towards it.
PRIOR_RIDGE = 0.1
MEMBER_RIDGE = 10.0

# Characters that end a sentence; a full stop does before white space, a line break unless a word goes on.
_ENDS = np.array([ord(c) for c in "。！？!?；\n\r"], np.uint32)
_SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x3000], np.uint32)
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))


def _slot(hashed: np.ndarray) -> np.ndarray:
    mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(TERM_SLOTS)).astype(np.int64)


def _powers(radix: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), radix, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Bags:
    """Sentences of many documents as a ragged array of term slots: hashed Latin words and pairs of Chinese characters."""

    slots: np.ndarray
    bounds: np.ndarray  # of sentences in slots
    documents: np.ndarray  # document of each sentence

    @classmethod
    def of(cls, texts: Sequence[str | None]) -> Bags:
        """Reads all texts at once as one array of characters; sentences without terms are left out."""
        plain = [unicodedata.normalize("NFKC", t) if t else "" for t in texts]
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        if not n:
            return cls(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
        sizes = np.array([len(p) for p in plain], np.int64)
        owner = np.repeat(np.arange(len(plain)), sizes)
        first = np.append(True, owner[1:] != owner[:-1])
        last = np.append(first[1:], True)
        before, after = np.append(np.uint32(0), codes[:-1]), np.append(codes[1:], np.uint32(0))
        before[first], after[last] = 0, 0
        small = (codes >= 97) & (codes <= 122)
        big = (codes >= 65) & (codes <= 90)
        joins = small | big | (codes == 44)
        # A line break within a sentence: after a letter or comma, before a small letter.
        feed = (codes == 10) & np.append(small[1:], False) & ~last
        crlf = feed & (before == 13)
        two_back = np.append(np.zeros(2, bool), joins[:-2])[:n] & (np.append(np.full(2, -1), owner[:-2])[:n] == owner)
        wrapped = feed & np.where(crlf, two_back, np.append(False, joins[:-1]) & ~first)
        ends = np.isin(codes, _ENDS) & ~wrapped
        ends[np.flatnonzero(wrapped & crlf) - 1] = False
        dot = (codes == 46) & ~first & ~np.isin(before, _SPACES) & (last | np.isin(after, _SPACES))
        sentence = np.cumsum(ends | dot | first)

        chinese = (codes >= 0x4E00) & (codes <= 0x9FFF)
        pairs = np.flatnonzero(chinese[:-1] & chinese[1:] & ~first[1:])
        pair_hash = codes[pairs].astype(np.uint64) * _RADIX + codes[pairs + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

        letter = small | big
        inner = letter | (codes == 39) | (codes == 0x2019) | (codes == 45)
        starts = np.flatnonzero(inner & (first | ~np.append(False, inner[:-1])))
        stops = np.flatnonzero(inner & (last | ~np.append(inner[1:], False))) + 1
        begun = np.minimum.reduceat(np.where(letter, np.arange(n), n), starts) if len(starts) else starts
        whole = (begun < n) & (stops - begun >= 2)
        begun, stops = begun[whole], stops[whole]
        lower = np.where(big, codes + 32, codes).astype(np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(lower * _powers(_RADIX, n), dtype=np.uint64))
        word_hash = (sums[stops] - sums[begun]) * _powers(_INVERSE, n)[begun]

        at = np.concatenate([pairs, begun])
        slots = _slot(np.concatenate([pair_hash, word_hash]))
        order = np.argsort(sentence[at], kind="stable")
        own = sentence[at][order]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        return cls(slots[order], np.append(new, len(own)).astype(np.int64), owner[at[order][new]].astype(np.int64))

    def scores(self, log_p: np.ndarray) -> np.ndarray:
        """Sum of term scores per sentence: sentences x classes. ``log_p``: slots x classes."""
        if len(self.bounds) < 2:
            return np.zeros((0, log_p.shape[1]))
        return np.add.reduceat(log_p[self.slots], self.bounds[:-1], axis=0)


class SentenceModel:
    """Naive Bayes over sentences, the last class being general remarks; fitted from document labels."""

    def __init__(self, log_p: np.ndarray, prior: np.ndarray) -> None:
        self.log_p, self.prior = log_p, prior

    @classmethod
    def fit(cls, bags: Bags, labels: np.ndarray, rounds: int = 12) -> SentenceModel:
        k = labels.shape[1] + 1
        stray = 0.03  # of the mass goes to subjects that a document isn't labelled with
        allowed = np.concatenate([np.where(labels > 0, 1.0, stray), np.full((len(labels), 1), 0.5)], axis=1)
        weight = allowed[bags.documents]
        posterior = weight / weight.sum(axis=1, keepdims=True)
        sizes = np.diff(bags.bounds)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        log_p = prior = None
        for step in range(rounds):
            counts = np.stack([np.bincount(bags.slots, posterior[owner, c], TERM_SLOTS) for c in range(k)], axis=1)
            if step == 0:  # general remarks start as what all subjects share
                counts[:, -1] = np.exp(np.log(counts[:, :-1] + 0.05).mean(axis=1))
            smooth = counts + 0.02
            log_p = np.log(smooth / smooth.sum(axis=0))
            prior = np.log(posterior.mean(axis=0) + 1e-6)
            score = bags.scores(log_p) + np.log(weight) + prior
            score -= score.max(axis=1, keepdims=True)
            posterior = np.exp(score)
            posterior /= posterior.sum(axis=1, keepdims=True)
        return cls(log_p, prior)

    def posterior(self, bags: Bags) -> np.ndarray:
        score = bags.scores(self.log_p) + self.prior
        score -= score.max(axis=1, keepdims=True, initial=-1e9)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


def structure(posterior: np.ndarray, documents: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document and subject: sentences, and features of their number, share and longest run."""
    k = posterior.shape[1] - 1
    best = posterior.argmax(axis=1) if len(posterior) else np.zeros(0, np.int64)
    counts = np.bincount(documents * (k + 1) + best, minlength=n * (k + 1)).reshape(n, k + 1).astype(float)
    # A general remark doesn't end a passage.
    own = best < k
    key = (documents * (k + 1) + best)[own]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    run = np.zeros(n * (k + 1))
    np.maximum.at(run, key[begin], np.diff(np.append(begin, len(key))))
    run = run.reshape(n, k + 1)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    own, run = counts[:, :k], run[:, :k]
    steps = [(own >= n) * 1.0 for n in (1, 2, LEAST_SENTENCES, LEAST_SENTENCES + 1)]
    return own, np.stack([*steps, np.minimum(run, 4) / 4, own / total], axis=2)


def _fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge towards ``prior``."""
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """Classifier chain in order of falling frequency, with a beam search over combinations."""

    def __init__(self, order: list[int], weights: list[np.ndarray], kept: float, sources: list[str]) -> None:
        self.order, self.weights, self.kept, self.sources = order, weights, kept, sources

    @staticmethod
    def _inputs(features: np.ndarray, sources: np.ndarray, k: int) -> np.ndarray:
        others = np.delete(features[:, :, LEAST_SENTENCES - 1], k, axis=1)
        return np.concatenate([features[:, k, :], others.sum(axis=1, keepdims=True), 0.3 * sources], axis=1)

    def one_hot(self, sources: Sequence[str | None]) -> np.ndarray:
        out = np.zeros((len(sources), len(self.sources)))
        place = {s: i for i, s in enumerate(self.sources)}
        for i, s in enumerate(sources):
            if s in place:
                out[i, place[s]] = 1.0
        return out

    @classmethod
    def fit(cls, features: np.ndarray, counts: np.ndarray, sources: Sequence[str | None], labels: np.ndarray) -> Chain:
        order = np.argsort(-labels.sum(axis=0), kind="stable").tolist()
        chain = cls(order, [], 1.0, sorted({s for s in sources if s}))
        hot = chain.one_hot(sources)
        one = np.ones((len(labels), 1))
        own = features.shape[2] + 1
        pooled = np.concatenate([np.concatenate([cls._inputs(features, hot, k)[:, :own], one], axis=1) for k in order])
        common = _fit_logistic(pooled, labels[:, order].T.ravel(), np.zeros(own + 1), PRIOR_RIDGE)
        for at, k in enumerate(order):
            x = np.concatenate([cls._inputs(features, hot, k), labels[:, order[:at]], one], axis=1)
            prior = np.concatenate([common[:own], np.zeros(x.shape[1] - own - 1), common[-1:]])
            chain.weights.append(_fit_logistic(x, labels[:, k], prior, MEMBER_RIDGE))
        # The part of evident subjects that annotators noted; probabilities are corrected by it.
        evident = counts >= 2 * LEAST_SENTENCES
        if evident.sum() >= 20:
            chain.kept = float(np.clip(labels[evident].mean(), 0.5, 1.0))
        return chain

    def decode(self, features: np.ndarray, sources: Sequence[str | None]) -> np.ndarray:
        """The likeliest combination per document: documents x subjects of 0 and 1."""
        n, k = len(features), len(self.order)
        hot = self.one_hot(sources)
        score = np.zeros((n, 1))
        taken = np.zeros((n, 1, k))
        for at, subject in enumerate(self.order):
            w = self.weights[at]
            x = self._inputs(features, hot, subject)
            fixed = x @ w[: x.shape[1]] + w[-1]
            logit = fixed[:, None] + taken[:, :, self.order[:at]] @ w[x.shape[1] : -1]
            p = np.clip(1 / (1 + np.exp(-np.clip(logit, -30, 30))) / self.kept, 1e-9, 1 - 1e-9)
            width = score.shape[1]
            both = np.concatenate([score + np.log1p(-p), score + np.log(p)], axis=1)
            keep = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            score = np.take_along_axis(both, keep, axis=1)
            taken = np.take_along_axis(taken, (keep % width)[:, :, None], axis=1)
            taken[:, :, subject] = keep >= width
        return taken[:, 0, :]


@dataclass
class SubjectModel:
    subjects: list[str]
    sentence_model: SentenceModel
    chain: Chain

    def predict(self, texts: Sequence[str | None], sources: Sequence[str | None]) -> np.ndarray:
        """Documents x subjects."""
        bags = Bags.of(texts)
        _, features = structure(self.sentence_model.posterior(bags), bags.documents, len(texts))
        return self.chain.decode(features, sources) > 0


def refine(model: SentenceModel, documents: DataFrame, pull: float = 200.0) -> SentenceModel:
    """One round of expectation maximisation over every document of the corpus.

    Each partition sends its expected term counts per class, ``TERM_SLOTS x classes`` at most. The
    model fitted from labels keeps the weight of ``pull`` terms per class.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    k = model.log_p.shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERM_SLOTS, k))
        mass = np.zeros(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                bags = Bags.of(batch.column(0).slice(at, 1000).to_pylist())
                p = shared.value.posterior(bags)
                mass += p.sum(axis=0)
                owner = np.repeat(np.arange(len(p)), np.diff(bags.bounds))
                for c in range(k):
                    total[:, c] += np.bincount(bags.slots, p[owner, c], TERM_SLOTS)
        slots = np.flatnonzero(total.sum(axis=1) > 1e-3)
        rows = [total[slots], mass[None, :]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slots, TERM_SLOTS)), *[pa.array(np.concatenate(rows)[:, c]) for c in range(k)]], ["slot", *[f"c{c}" for c in range(k)]]
        )

    schema = "slot long, " + ", ".join(f"c{c} double" for c in range(k))
    text = documents.select(unnamed_text(documents).alias("text")).where("text is not null")
    got = text.mapInArrow(count, schema).groupBy("slot").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k)]).toPandas()
    counts = np.zeros((TERM_SLOTS + 1, k))
    counts[got.slot.to_numpy()] = got[[f"c{c}" for c in range(k)]].to_numpy()
    mass, counts = counts[-1], counts[:-1] + pull * np.exp(model.log_p)
    smooth = counts + 0.02
    return SentenceModel(np.log(smooth / smooth.sum(axis=0)), np.log((mass + 1) / (mass + 1).sum()))


def unnamed_text(documents: DataFrame) -> Column:
    """The text without the entity it was filed under: names stand in sentences of all kinds and tell nothing of the subject."""
    text = F.col("text").cast("string")
    if "entity_name" not in documents.columns:
        return text
    name = F.trim(F.col("entity_name").cast("string"))
    return F.when(F.length(name) > 1, F.replace(text, name, F.lit(" "))).otherwise(text)


def labelled_sample(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list:
    """At most ``limit`` labelled documents, by the hash of their id, with all of their labels."""
    ids = labels.where("subject is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(limit)
    chosen = labels.where("subject is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    slim = documents.select("doc_id", unnamed_text(documents).alias("text"), F.col("source").cast("string").alias("source"))
    return slim.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "source", "labels").orderBy("doc_id").collect()


def train_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, limit: int = MAX_LABELLED) -> SubjectModel:
    """Fits the models; the descriptions of the subject areas count as labelled texts of their own."""
    known = areas.where("subject is not null").orderBy("subject").collect()
    subjects = [r["subject"] for r in known]
    rows = labelled_sample(documents, labels, limit)
    texts = [r["text"] for r in rows] + ["。".join(x for x in (r["name_en"], r["name_zh"], r["description"]) if x) for r in known]
    y = np.zeros((len(texts), len(subjects)))
    for i, r in enumerate(rows):
        for s in r["labels"]:
            if s in subjects:
                y[i, subjects.index(s)] = 1.0
    for j in range(len(known)):
        y[len(rows) + j, j] = 1.0
    bags = Bags.of(texts)
    sentence_model = refine(SentenceModel.fit(bags, y), documents)
    counts, features = structure(sentence_model.posterior(bags), bags.documents, len(texts))
    n = len(rows)
    chain = Chain.fit(features[:n], counts[:n], [r["source"] for r in rows], y[:n])
    return SubjectModel(subjects, sentence_model, chain)


def assign_subjects(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """``doc_id, subject``: every subject that a passage of the document treats.

    Null, empty and blank texts have none. Whole texts are read; extra columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = shared.value.predict(part.column(1).to_pylist(), part.column(2).to_pylist())
                row, subject = np.nonzero(found)
                names = np.array(shared.value.subjects, dtype=object)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(names[subject], pa.string())], ["doc_id", "subject"])

    slim = documents.select(F.col("doc_id").cast("long"), unnamed_text(documents).alias("text"), F.col("source").cast("string"))
    return slim.mapInArrow(run, "doc_id long, subject string")
