import numpy as np
import pytest

from paddyframe.operators import linear
from paddyframe.operators.homotopy import kkt_violation, lasso_path


def centred(X, y):
    X, y = X - X.mean(0), y - y.mean()
    return X.T @ X, X.T @ y


def designs():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 12))
    y = X @ rng.normal(size=12) + rng.normal(size=200)
    yield "plain", X, y
    yield "copies and negatives", np.column_stack([X, X[:, :4], -X[:, 2:6], X[:, :3]]), y
    dummies = np.eye(7)[rng.integers(0, 7, 200)]
    yield "all dummies", np.column_stack([X[:, :5], dummies]), y + dummies @ np.arange(7)
    yield "more features than rows", rng.normal(size=(30, 80)), rng.normal(size=30)
    yield "constant column", np.column_stack([X, np.ones(200)]), y
    yield "sums of others", np.column_stack([X, X[:, 0] + X[:, 1], X[:, 2] - X[:, 3] + X[:, 4]]), y
    t = np.linspace(0, 20, 200)
    yield "smooth, nearly collinear", np.column_stack([np.sin(t + 0.02 * k) for k in range(15)] + [X]), y + np.sin(t)
    grid = np.array([[a, b, c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)] * 4, float)
    yield "orthogonal ties", grid, grid @ np.array([2.0, 2.0, -2.0])
    yield "noise-free", X, X @ np.r_[1.0, -1, np.zeros(10)]
    yield "nothing to explain", X, np.zeros(200)


@pytest.mark.parametrize("name,X,y", list(designs()), ids=[d[0] for d in designs()])
def test_every_alpha_is_optimal(name, X, y):
    ZZ, Zy = centred(X, y)
    n = len(y)
    alphas = np.logspace(0, -3, 100) * max(np.abs(Zy).max() / n, 1e-12)
    path = lasso_path(ZZ, Zy, n * alphas)
    assert path is not None and path.shape == (100, X.shape[1])
    assert max(kkt_violation(ZZ, Zy, w, n * a) for w, a in zip(path, alphas)) < 1e-8 or not Zy.any()


def test_features_drop_out_on_the_way():
    """Paths on which a coefficient passes zero: the events must include drops."""
    dropped = 0
    for seed in range(60):
        rng = np.random.default_rng(seed)
        X = rng.normal(size=(25, 8)) @ rng.normal(size=(8, 8))
        ZZ, Zy = centred(X, rng.normal(size=25))
        lams = np.abs(Zy).max() * np.logspace(0, -4, 400)
        path = lasso_path(ZZ, Zy, lams)
        assert max(kkt_violation(ZZ, Zy, w, a) for w, a in zip(path, lams)) < 1e-8
        on = path != 0
        dropped += int((on[:-1] & ~on[1:]).sum())
    assert dropped > 10


def test_path_agrees_with_coordinate_descent():
    rng = np.random.default_rng(3)
    X = rng.normal(size=(150, 20)) @ rng.normal(size=(20, 20))
    ZZ, Zy = centred(X, X[:, 0] - X[:, 5] + rng.normal(size=150))
    alphas = np.abs(Zy).max() / 150 * np.logspace(0, -3, 30)
    path = lasso_path(ZZ, Zy, 150 * alphas)
    for w, a in zip(path, alphas):
        assert np.allclose(w, linear.lasso_cd(ZZ, Zy, 150, a, w, max_iter=50_000, tol=1e-12), atol=1e-7 * np.abs(path).max())


def test_descent_takes_over_where_the_sweep_gives_up(monkeypatch):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(60, 4))
    y = X @ np.array([1.0, -2, 0, 0]) + rng.normal(size=60)
    A = np.column_stack([np.ones(60), X, y])
    want = linear._path(A.T @ A, np.array([0.5, 0.1]))
    monkeypatch.setattr(linear, "lasso_path", lambda *a: None)
    assert np.allclose(linear._path(A.T @ A, np.array([0.5, 0.1])), want, atol=1e-5)
