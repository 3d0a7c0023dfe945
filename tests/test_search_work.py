"""How much searches compute, beside what they find."""

from dataclasses import replace

import numpy as np

from popshift.operators import evaluate as ev, generators as gen
from popshift.sources.population import population


def test_silhouettes_of_several_labellings():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(at, 1, (150, 3)) for at in (0, 4, 9)])
    labels = [np.repeat([0, 1, 2], 150), rng.integers(0, 4, 450), np.zeros(450, int), np.r_[0, np.ones(449, int)]]

    def plain(label):
        d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), []
        for i, own in enumerate(label):
            if (label == own).sum() == 1 or len(set(label)) < 2:
                out.append(0.0)
                continue
            a = d[i, label == own].sum() / ((label == own).sum() - 1)
            b = min(d[i, label == g].mean() for g in set(label) - {own})
            out.append((b - a) / max(a, b))
        return np.mean(out)

    assert np.allclose(gen.silhouettes(x, labels), [plain(y) for y in labels])


def test_models_moved_together_move_as_alone(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (900, 3)) + rng.integers(0, 3, 900)[:, None] * 5
    base = spark.createDataFrame([(row.tolist(),) for row in x], "_x array<double>")
    starts = [x[:k] for k in (2, 3, 5)]
    found = gen.fit_centres(base, starts, 8)
    for start, moved in zip(starts, found, strict=True):
        for _ in range(8):
            label = ((x[:, None] - start[None]) ** 2).sum(axis=2).argmin(axis=1)
            start = np.array([x[label == k].mean(axis=0) if (label == k).any() else start[k] for k in range(len(start))])
        assert np.allclose(moved, start, atol=1e-3)


def test_labels_of_clusters_are_written_once(spark, sf, monkeypatch):
    """The distance to every centre is an expression over all columns; each level of the naming tree reads the rows."""
    made, write = [], gen.staged
    monkeypatch.setattr(gen, "staged", lambda df, tag: made.append(tag) or write(df, tag))
    roles = ev.Roles(numeric=("l_quantity", "c_acctbal"), categorical=("c_mktsegment",))
    found, diagnostics = gen.clusters(population(spark, sf), roles, replace(gen.SearchConfig(), k_range=(2, 3), max_pct=1.0))
    assert found.count() and {"drawn", "labels"} <= set(made) and len(diagnostics) <= 2
