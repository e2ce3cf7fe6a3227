"""Mixing sources to target weights: how often each document is used.

Method: every document has a membership in the domains: certain where its source is recorded, else
the posterior of a naive Bayes classifier trained on the documents whose source is known. Projected
gradient descent on the least squares between expected domain totals and targets fits nonnegative,
capped rates. Documents of equal membership share a rate, so the descent runs on a table of groups:
in every round each task finds the rates of its groups and adds up their domain totals, and only one
number per domain comes to the driver. Rates depend on the totals of the rounds before and on nothing
else, so no state is kept between rounds and a lost executor costs nothing but its tasks.

Rates become whole copies: the whole part for all; of a recorded source one more for the documents
first in a hash order until the missing tokens are reached, and one document that fits the rest; of
documents without a source one more with the probability of the fraction, by hash.

A document without a source has no limit of repeats in ``mix_targets``: it is used at most
``unlabelled_repeats`` times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.subjects import TERM_SLOTS, Bags
from quarrymill.llm.tokens import encode_documents
from quarrymill.session import cut_lineage

MEMBERSHIP_STEPS = 8
HASH_BITS = 12


def _document_slots(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(document, slot)`` of the distinct terms of each text."""
    bags = Bags.of(texts)
    sizes = np.diff(bags.bounds)
    both = np.unique(np.repeat(bags.documents, sizes) * TERM_SLOTS + bags.slots)
    return both // TERM_SLOTS, both % TERM_SLOTS


class SourcePosterior:
    """Naive Bayes over hashed terms: ``domains x TERM_SLOTS`` counts, bounded by the targets."""

    def __init__(self, domains: Sequence[str], counts: np.ndarray, documents: np.ndarray) -> None:
        self.domains = list(domains)
        smooth = counts + 0.1
        self.log_likelihood = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.copy()
        self.log_prior = np.log((documents + 1.0) / (documents + 1.0).sum())

    def __call__(self, texts: Sequence[str | None]) -> np.ndarray:
        """Texts x domains."""
        score = np.tile(self.log_prior, (len(texts), 1))
        documents, slots = _document_slots(texts)
        if len(documents):
            first = np.flatnonzero(np.append(True, documents[1:] != documents[:-1]))
            score[documents[first]] += np.add.reduceat(self.log_likelihood[slots], first, axis=0)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train_posterior(df: DataFrame, domains: Sequence[str], text: str = "text", source: str = "source") -> SourcePosterior:
    """Counts over every document of a known domain, added up per partition before the shuffle."""
    place = {d: i for i, d in enumerate(domains)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), TERM_SLOTS + 1), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                labels = np.array([place[x] for x in part.column(0).to_pylist()], np.int64)
                documents, slots = _document_slots(part.column(1).to_pylist())
                np.add.at(total, (labels[documents], slots), 1)
                total[:, TERM_SLOTS] += np.bincount(labels, minlength=len(place))
        at, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(slot), pa.array(total[at, slot])], ["domain", "slot", "n"])

    known = df.where(F.col(source).isin(list(domains))).select(F.col(source), F.col(text))
    rows = known.mapInArrow(count, "domain long, slot long, n long").groupBy("domain", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(place), TERM_SLOTS + 1))
    counts[rows.domain.to_numpy(np.int64), rows.slot.to_numpy(np.int64)] = rows.n.to_numpy(float)
    return SourcePosterior(domains, counts[:, :TERM_SLOTS], counts[:, TERM_SLOTS])


def predict_sources(
    df: DataFrame, domains: Sequence[str], model: SourcePosterior | None = None, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """``doc_id, predicted, posterior`` (array by domain) of the documents without a source."""
    shared = df.sparkSession.sparkContext.broadcast(model or train_posterior(df, domains, text, source))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value(batch.column(1).to_pylist())
            best = [shared.value.domains[int(p.argmax())] for p in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array([p.tolist() for p in found], pa.list_(pa.float64()))],
                [key, "predicted", "posterior"],
            )

    missing = df.where(F.col(source).isNull()).selectExpr(f"cast(`{key}` as long) `{key}`", f"cast(`{text}` as string) `{text}`")
    return missing.mapInArrow(predict, f"`{key}` long, predicted string, posterior array<double>")


def _descend(membership: np.ndarray, upper: np.ndarray, goal: np.ndarray, reach: np.ndarray, history: Sequence[np.ndarray]) -> np.ndarray:
    """The point after the rounds of ``history`` (domain totals of each round's look-ahead), in units of the goal.

    Accelerated projected gradient; every group's way depends on the totals only. A group's step is its part in what
    its domains can reach at most, ``reach``: the steps of a domain then add up to 1 at most, which makes the descent
    converge, and fast where few groups hold most of a domain.
    """
    x = np.zeros(len(upper))
    y, momentum = x, 1.0
    step = upper / np.maximum(np.where(membership > 0, reach, 0.0).max(axis=1, initial=0.0), 1e-300)
    for totals in history:
        new = np.clip(y - step * (membership @ (totals - goal)), 0.0, upper)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y, x, momentum = new + (momentum - 1) / following * (new - x), new, following
    return np.stack([x, y])


def _memberships(groups: Sequence[str], domains: Sequence[str]) -> np.ndarray:
    """Groups x domains: ``=source`` is certain, else steps by domain."""
    out = np.zeros((len(groups), len(domains)))
    place = {d: i for i, d in enumerate(domains)}
    for i, g in enumerate(groups):
        if g[0] == "=":
            out[i, place[g[1:]]] = 1.0
        else:
            soft = np.array(g.split(","), float)
            out[i] = soft / max(soft.sum(), 1.0)
    return out


class RateFit:
    """Rates of groups (``grp, tokens, cap``) whose expected domain totals come nearest to ``targets``."""

    def __init__(self, groups: DataFrame, domains: Sequence[str], targets: np.ndarray, rounds: int = 60, tolerance: float = 1e-5) -> None:
        self.domains = list(domains)
        self.scale = max(float(targets.max(initial=0.0)), 1.0)
        self.goal = targets / self.scale
        self.history: list[np.ndarray] = []
        n = len(self.domains)
        self.reach = self._sum(groups, n, lambda m, upper: upper @ m)
        last = np.full(n, np.inf)
        for _ in range(rounds):
            at, ahead = self._sum(groups, 2 * n, lambda m, upper: (self.point(m, upper) @ m).ravel()).reshape(2, -1)
            if np.abs(at - last).max(initial=0.0) < tolerance and len(self.history) > 1:
                break
            last = at
            self.history.append(ahead)

    def point(self, membership: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return _descend(membership, upper, self.goal, self.reach, self.history)

    def rates(self, groups: Sequence[str], tokens: np.ndarray, caps: np.ndarray) -> np.ndarray:
        found = self.point(_memberships(groups, self.domains), caps * tokens / self.scale)[0] * self.scale
        return np.divide(found, tokens, out=np.zeros(len(tokens)), where=tokens > 0)

    def _sum(self, groups: DataFrame, size: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Adds up over all groups what ``of`` makes of the memberships and upper bounds of a batch."""
        domains, scale = self.domains, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    part = of(_memberships(b.column(0).to_pylist(), domains), b.column(1).to_numpy() * b.column(2).to_numpy() / scale)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        rows = groups.select("grp", F.col("tokens").cast("double"), F.col("cap").cast("double")).mapInArrow(run, "i long, v double")
        got = rows.toPandas()  # ``size`` numbers per task
        return np.bincount(got.i.to_numpy(np.int64), got.v.to_numpy(float), size).astype(float)

    def table(self, groups: DataFrame) -> DataFrame:
        """``grp, rate`` of every group."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rates = self.rates(b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rates)], ["grp", "rate"])

        return groups.select("grp", F.col("tokens").cast("double"), F.col("cap").cast("double")).mapInArrow(run, "grp string, rate double")


def mix_documents(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    unlabelled_repeats: int = 1,
    model: bytes | None = None,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The mix ``doc_id, source, tokens, copies`` and the report of the shares reached.

    ``total_tokens``: the size of the mix; by default the largest at which every target that has
    documents can be met within its repeats. Sources without a target are not drawn; a target
    without documents is reported as not met. Documents without tokens are not drawn. In the report
    ``mixed_tokens`` are those of the recorded source, ``expected_tokens`` those by membership, of which
    ``actual_share`` and ``met`` are.
    """
    spark = documents.sparkSession
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null").collect()}
    domains = sorted(wanted)
    share = np.array([wanted[d][0] for d in domains])
    counted = encode_documents(documents, model=model, counts=True, carry=("source",))
    if unlabelled_repeats and domains:
        guessed = predict_sources(documents, domains).select("doc_id", "posterior")
        steps = F.transform("posterior", lambda p: F.round(p * MEMBERSHIP_STEPS).cast("int"))
        counted = counted.join(guessed.select("doc_id", F.array_join(steps, ",").alias("soft")), "doc_id", "left")
    else:
        counted = counted.withColumn("soft", F.lit(None).cast("string"))
    eligible = F.col("source").isin(domains) | (F.col("source").isNull() & F.col("soft").isNotNull())
    place = F.xxhash64(F.col("doc_id"), F.lit(seed))
    slim = cut_lineage(
        counted.where(eligible & (F.col("tokens") > 0))
        .withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col("source")), F.col("soft")))
        .withColumn("place", F.shiftrightunsigned(place, 64 - 2 * HASH_BITS))
        .select("doc_id", "source", "tokens", "grp", "place")
    )
    certain = F.col("grp").startswith("=")
    caps = F.lit(unlabelled_repeats).cast("double")
    for d in domains:
        caps = F.when(F.col("grp") == "=" + d, float(wanted[d][1])).otherwise(caps)
    groups = cut_lineage(slim.groupBy("grp").agg(F.sum("tokens").alias("tokens")).withColumn("cap", caps))
    # One row per recorded source with a target, however many soft groups there are.
    held = {r["grp"][1:]: float(r["tokens"]) for r in groups.where(certain).collect()}
    if total_tokens is None:
        reach = [held[d] * wanted[d][1] / wanted[d][0] for d in domains if held.get(d, 0) > 0 and wanted[d][0] > 0]
        total_tokens = int(min(reach, default=0))
    fit = RateFit(groups, domains, share * total_tokens)

    drawn = [d for d in domains if d in held]
    tokens = np.array([held[d] for d in drawn])
    most = np.array([wanted[d][1] for d in drawn], float)
    rates = fit.rates(["=" + d for d in drawn], tokens, most) if drawn else np.zeros(0)
    # Whole copies for all; the bound of those with one more is found by coarse bucket, then within the one that is cut.
    plan = []
    for d, rate, n, cap in zip(drawn, rates, tokens, most, strict=True):
        whole = int(np.floor(rate + 1e-9))
        rest = (rate - whole) * n
        plan.append(("=" + d, whole, float(rest if whole < cap and rest > 0.5 else 0.0)))
    planned = slim.join(F.broadcast(spark.createDataFrame(plan, "grp string, whole int, missing double")), "grp")
    coarse = F.shiftright("place", HASH_BITS)
    buckets = planned.where("missing > 0").groupBy("grp", coarse.alias("bucket")).agg(F.sum("tokens").alias("tokens")).toPandas()
    cuts = []
    for g, whole, missing in plan:
        own = buckets[buckets.grp == g].sort_values("bucket")
        sizes = np.cumsum(own.tokens.to_numpy())
        k = int(np.searchsorted(sizes, missing, side="right"))
        if missing <= 0 or k >= len(sizes):
            cuts.append((g, whole, 0 if missing <= 0 else 1 << (2 * HASH_BITS), -1, 0.0))
        else:
            bucket = int(own.bucket.to_numpy()[k])
            cuts.append((g, whole, bucket << HASH_BITS, bucket, float(missing - (sizes[k - 1] if k else 0.0))))
    cut = spark.createDataFrame(cuts, "grp string, whole int, bound long, cut long, missing double")
    fine = slim.join(F.broadcast(cut), "grp").where(coarse == F.col("cut")).groupBy("grp", "place").agg(F.sum("tokens").alias("tokens")).toPandas()
    final = []
    for g, whole, bound, bucket, missing in cuts:
        left = 0.0
        if bucket >= 0:
            own = fine[fine.grp == g].sort_values("place")
            sizes = np.cumsum(own.tokens.to_numpy())
            k = int(np.searchsorted(sizes, missing, side="right"))
            bound = int(own.place.to_numpy()[k - 1]) + 1 if k else bound
            left = float(missing - (sizes[k - 1] if k else 0.0))
        final.append((g, whole, bound, left))
    chosen = spark.createDataFrame(final, "grp string, whole int, bound long, left double")
    # What is left up to the document at the bound goes to the one document beyond it that fits best.
    gap = F.abs(F.col("tokens") - F.col("left"))
    beyond = slim.join(F.broadcast(chosen.where("left > 0")), "grp").where((F.col("place") >= F.col("bound")) & (gap < F.col("left")))
    filler = {r["grp"]: r["doc_id"] for r in beyond.groupBy("grp").agg(F.min_by("doc_id", F.struct(gap, "place", "doc_id")).alias("doc_id")).collect()}
    chosen = spark.createDataFrame([(g, w, b, filler.get(g)) for g, w, b, _ in final], "grp string, whole int, bound long, filler long")
    extra = ((F.col("place") < F.col("bound")) | F.coalesce(F.col("doc_id") == F.col("filler"), F.lit(False))).cast("int")
    recorded = slim.join(F.broadcast(chosen), "grp").select("doc_id", "source", "tokens", "grp", (F.col("whole") + extra).alias("copies"))
    fraction = F.col("place") / float(1 << (2 * HASH_BITS)) < F.col("rate") - F.floor("rate")
    soft = slim.where(~certain).join(fit.table(groups.where(~certain)), "grp")
    soft = soft.select("doc_id", "source", "tokens", "grp", (F.floor("rate") + fraction.cast("int")).cast("int").alias("copies"))
    drawn_rows = recorded.unionByName(soft).where("copies > 0")
    mix = drawn_rows.drop("grp")

    used = drawn_rows.groupBy("grp").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens")).withColumn("cap", F.lit(1.0))
    totals = _expected(used, domains)
    reached = {r["grp"][1:]: r["tokens"] for r in used.where(certain).collect()}
    everything = float(totals.sum())
    rows = []
    for d, expected in zip(domains, totals.tolist(), strict=True):
        goal = wanted[d][0] * total_tokens
        met = expected > 0 and abs(expected - goal) <= 0.02 * goal
        part = expected / everything if everything else 0.0
        rows.append((d, wanted[d][0], wanted[d][1], int(held.get(d, 0.0)), int(reached.get(d, 0)), expected, part, bool(met)))
    report = spark.createDataFrame(
        rows,
        "source string, target_share double, max_repeats int, available_tokens long, mixed_tokens long, expected_tokens double, actual_share double, met boolean",
    )
    return mix, report


def _expected(used: DataFrame, domains: Sequence[str]) -> np.ndarray:
    """Expected tokens by domain of what is drawn."""
    fit = RateFit.__new__(RateFit)
    fit.domains, fit.scale = list(domains), 1.0
    return fit._sum(used, len(domains), lambda m, upper: upper @ m)
