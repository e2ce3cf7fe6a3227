import numpy as np

from quarrymill.llm.mixing import RateFit, mix_documents, predict_sources

SCHEMA = "doc_id long, text string, source string, tokens string, copies string, grp string"


def fitted(spark, groups, domains, targets):
    frame = spark.createDataFrame(groups, "grp string, tokens double, cap double").repartition(3)
    fit = RateFit(frame, domains, np.array(targets), rounds=400, tolerance=1e-9)
    names, tokens, caps = (list(x) for x in zip(*groups, strict=True))
    rates = fit.rates(names, np.array(tokens), np.array(caps))
    assert {r.grp: r.rate for r in fit.table(frame).collect()} == dict(zip(names, rates.tolist(), strict=True))
    return rates


def test_fit_against_closed_form(spark):
    hard = [("=a", 100.0, 1.0), ("=b", 200.0, 2.0), ("=c", 50.0, 5.0)]
    assert np.allclose(fitted(spark, hard, ["a", "b", "c"], [50.0, 300.0, 1000.0]), [0.5, 1.5, 5.0], atol=1e-5)


def test_fit_against_brute_force(spark):
    """Soft groups: no point of a grid within the caps comes nearer to the targets."""
    groups = [("=a", 100.0, 1.0), ("4,4", 100.0, 2.0), ("=b", 50.0, 1.0), ("2,6", 80.0, 1.0)]
    member = np.array([[1, 0], [0.5, 0.5], [0, 1], [0.25, 0.75]])
    size, cap = np.array([g[1] for g in groups]), np.array([g[2] for g in groups])
    for targets in ([120.0, 80.0], [300.0, 10.0], [10.0, 400.0]):
        miss = lambda r: float(((np.asarray(r) * size @ member - targets) ** 2).sum())  # noqa: B023, E731
        rates = fitted(spark, groups, ["a", "b"], targets)
        assert (rates >= 0).all() and (rates <= cap + 1e-9).all()
        grid = np.stack(np.meshgrid(*[np.linspace(0, c, 11) for c in cap]), axis=-1).reshape(-1, 4)
        assert miss(rates) <= min(map(miss, grid)) + 1e-2


def test_no_groups(spark):
    assert len(RateFit(spark.createDataFrame([], "grp string, tokens double, cap double"), ["a", "b"], np.zeros(2)).domains) == 2


def make(spark):
    texts = {"a": "stone river boat", "b": "light cloud rain storm", "c": "tree leaf"}
    rows = [(i, texts[s] * 3, s, "x", "y", "z") for i, s in enumerate(["a"] * 300 + ["b"] * 900 + ["c"] * 40)]
    rows += [(5000, "stone river boat", None, "x", "y", "z"), (5001, None, "a", "x", "y", "z"), (5002, "", "b", "x", "y", "z"), (5003, "other", "other", "x", "y", "z")]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    return spark.createDataFrame(rows, SCHEMA), targets


def test_shares_and_caps(spark):
    documents, targets = make(spark)
    mix, report = mix_documents(documents, targets)
    caps = {"a": 2, "b": 1, "c": 3, None: 1}
    rows = mix.collect()
    assert all(1 <= r.copies <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    by = {r.source: r for r in report.collect()}
    assert [by[s].met for s in ("a", "b", "c", "gone")] == [True, True, True, False]
    total = sum(r.mixed_tokens for r in by.values())
    assert abs(by["a"].mixed_tokens / total - 0.5 / 0.9) < 0.01 and by["gone"].mixed_tokens == 0


def test_target_out_of_reach(spark):
    documents, targets = make(spark)
    _, report = mix_documents(documents, targets, total_tokens=100_000)
    by = {r.source: r for r in report.collect()}
    assert not any(r.met for r in by.values()) and by["b"].mixed_tokens == by["b"].available_tokens


def test_unlabelled(spark):
    documents, targets = make(spark)
    assert [(r.doc_id, r.predicted) for r in predict_sources(documents, ["a", "b", "c"]).collect()] == [(5000, "a")]
    mix, _ = mix_documents(documents, targets, unlabelled_repeats=1)
    assert {r.copies for r in mix.where("source is null").collect()} <= {1}
    mix, report = mix_documents(documents, targets, unlabelled_repeats=0)
    assert not mix.where("source is null").count() and all(r.expected_tokens == r.mixed_tokens for r in report.collect())


def test_long_documents_are_drawn_alike(spark):
    """No size keeps a document out: a long one is drawn as often as short ones."""
    rows = [(i, "stone river boat " * (200 if i % 10 == 0 else 1), "a", "x", "y", "z") for i in range(2000)]
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    documents = spark.createDataFrame(rows, SCHEMA)
    total = mix_documents(documents, targets)[0].groupBy().sum("tokens").first()[0]
    mix, report = mix_documents(documents, targets, total_tokens=total // 2)
    drawn = [r.doc_id % 10 == 0 for r in mix.collect()]
    assert 70 <= sum(drawn) <= 130 and 750 <= len(drawn) - sum(drawn) <= 1050
    assert abs(report.first().mixed_tokens - total // 2) <= 13  # tokens of a short document


def test_empty(spark):
    documents, targets = make(spark)
    mix, report = mix_documents(documents.limit(0), targets)
    assert mix.count() == 0 and not any(r.met for r in report.collect())
