"""Regime-switching Gaussian pair models: parameters, conversions and checks on small dense matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TOL = 1e-8


@dataclass(frozen=True)
class RegimeModel:
    """Z = (X, Y) given regimes j, k: means (K, n), gamma (K, n, n) = Cov Z, sigma (K, K, n, n) = Cov(Z_n, Z_n+1), joint (K, K)."""

    mean: np.ndarray
    gamma: np.ndarray
    sigma: np.ndarray
    joint: np.ndarray
    n_x: int = 1

    @property
    def marginal(self) -> np.ndarray:
        return self.joint.sum(axis=1)

    @property
    def transition(self) -> np.ndarray:
        return self.joint / self.marginal[:, None]

    def pair_cov(self, j: int, k: int) -> np.ndarray:
        return np.block([[self.gamma[j], self.sigma[j, k]], [self.sigma[j, k].T, self.gamma[k]]])

    def regression(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """F, Q and the constant N of Z_n+1 = F Z_n + N + noise(Q), for each pair of regimes."""
        k_all, n = self.mean.shape
        f, q, c = np.zeros((k_all, k_all, n, n)), np.zeros((k_all, k_all, n, n)), np.zeros((k_all, k_all, n))
        for j in range(k_all):
            for k in range(k_all):
                f[j, k], q[j, k] = cov_to_fq(self.gamma[j], self.sigma[j, k], self.gamma[k])
                c[j, k] = self.mean[k] - f[j, k] @ self.mean[j]
        return f, q, c


def cov_to_fq(gamma_j: np.ndarray, sigma: np.ndarray, gamma_k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f = np.linalg.solve(gamma_j.T, sigma).T
    return f, gamma_k - f @ sigma


def fq_to_cov(f: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gamma, sigma of a stationary pair: vec(gamma) = (I - F x F)^-1 vec(Q), sigma = gamma F'."""
    n = len(q)
    gamma = np.linalg.solve(np.eye(n * n) - np.kron(f, f), q.reshape(-1)).reshape(n, n)
    return gamma, gamma @ f.T


def square_root(q: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((q + q.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def is_positive(m: np.ndarray, tol: float = TOL) -> bool:
    """Symmetric and positive definite; the zero matrix passes."""
    return bool(np.allclose(m, m.T, atol=tol) and (not m.any() or np.linalg.eigvalsh(m).min() > 0))


def nearest_positive(m: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def is_consistent(cov: np.ndarray, tol: float = TOL) -> bool:
    """Blocks of cov (K, K, 2n, 2n): the diagonal ones depend on one regime only."""
    n = cov.shape[-1] // 2
    own = cov[range(len(cov)), range(len(cov)), :n, :n]
    return bool(np.allclose(cov[:, :, :n, :n], own[:, None], atol=tol) and np.allclose(cov[:, :, n:, n:], own[None], atol=tol))


def feedback(model: RegimeModel) -> np.ndarray:
    """F_yx of each pair: how the hidden state drives the next observation."""
    return model.regression()[0][:, :, model.n_x :, : model.n_x]


def feedback_from_cov(model: RegimeModel) -> np.ndarray:
    """The same zero test from covariances alone: Cov(X_n, Y_n+1) less what Y_n explains of it, for each pair."""
    x = model.n_x
    gain = np.linalg.solve(np.swapaxes(model.gamma[:, x:, x:], 1, 2), np.swapaxes(model.gamma[:, :x, x:], 1, 2))
    return model.sigma[:, :, :x, x:] - np.swapaxes(gain, 1, 2)[:, None] @ model.sigma[:, :, x:, x:]


def is_open_loop_from_cov(model: RegimeModel, tol: float = TOL) -> bool:
    return bool(np.abs(feedback_from_cov(model)).max() <= tol)


def is_open_loop(model: RegimeModel, tol: float = TOL) -> bool:
    return bool(np.abs(feedback(model)).max() <= tol)


def nearest_open_loop(model: RegimeModel) -> RegimeModel:
    """The model with F_yx = 0 that keeps all else: Cov(X_n, Y_n+1) becomes Cov(X, Y) Var(Y)^-1 Cov(Y_n, Y_n+1)."""
    x = model.n_x
    sigma = model.sigma.copy()
    for j in range(len(model.mean)):
        gain = np.linalg.solve(model.gamma[j][x:, x:].T, model.gamma[j][:x, x:].T).T
        sigma[j, :, :x, x:] = gain @ sigma[j, :, x:, x:]
    return RegimeModel(model.mean, model.gamma, sigma, model.joint, x)


def reversed_model(model: RegimeModel) -> RegimeModel:
    """The same process read backwards in time."""
    return RegimeModel(model.mean, model.gamma, model.sigma.transpose(1, 0, 3, 2), model.joint.T, model.n_x)


def linear_state_space(model: RegimeModel) -> RegimeModel:
    """Scalar adjustment to X autonomous (F_xy = 0) and Y_n+1 a function of X_n+1 only."""
    sigma = model.sigma.copy()
    for j, k in np.ndindex(model.joint.shape):
        (vx, cxy), (_, _) = model.gamma[j]
        a = sigma[j, k, 0, 0]
        out = model.gamma[k][0, 1] / model.gamma[k][0, 0]
        sigma[j, k] = [[a, a * out], [a * cxy / vx, a * cxy / vx * out]]
    return RegimeModel(model.mean, model.gamma, sigma, model.joint, model.n_x)


def repaired(gamma: np.ndarray, bound: float = 0.5) -> np.ndarray:
    """Correlations beyond 1 in absolute value are set to +-bound."""
    sd = np.sqrt(np.diag(gamma))
    rho = gamma / np.outer(sd, sd)
    rho = np.where(np.abs(rho) > 1, np.sign(rho) * bound, rho)
    np.fill_diagonal(rho, 1)
    return rho * np.outer(sd, sd)


def repaired_model(model: RegimeModel, bound: float = 0.5) -> RegimeModel:
    """Correlations of each pair repaired, then the nearest open loop: each regime's covariance is the mean of what its pairs' repairs say of it."""
    h, k_all = model.gamma.shape[-1], len(model.mean)
    gamma, sigma = np.zeros_like(model.gamma), model.sigma.copy()
    for j, k in np.ndindex(model.joint.shape):
        cov = repaired(model.pair_cov(j, k), bound)
        sigma[j, k] = cov[:h, h:]
        gamma[j] += cov[:h, :h] / (2 * k_all)
        gamma[k] += cov[h:, h:] / (2 * k_all)
    return nearest_open_loop(RegimeModel(model.mean, gamma, sigma, model.joint, model.n_x))


def is_admissible(model: RegimeModel) -> bool:
    """Whether the model, its reverse, and the open loops nearest to both have positive covariances for each pair."""
    for own in (model, reversed_model(model)):
        for each in (own, nearest_open_loop(own)):
            if not all(is_positive(each.pair_cov(j, k)) for j, k in np.ndindex(each.joint.shape)):
                return False
    return True


def steady_state(transition: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eig(transition.T)
    v = np.real(vectors[:, np.argmin(np.abs(values - 1))])
    return v / v.sum()


def checked_joint(joint: np.ndarray, tol: float = 1e-4) -> np.ndarray:
    """A joint law of two successive regimes: entries in [0, 1], normalised, equal row and column sums."""
    joint = np.asarray(joint, dtype=float)
    if (joint < 0).any() or (joint > 1).any():
        raise ValueError("entries of a joint law lie in [0, 1]")
    joint = joint / joint.sum() if abs(joint.sum() - 1) > tol else joint
    if not np.allclose(joint.sum(axis=0), joint.sum(axis=1), atol=tol):
        raise ValueError("a stationary joint law has equal row and column sums")
    return joint


def from_regression(m: np.ndarray, lambda2: float, p: np.ndarray, pi2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """F, Q and mean of one pair from x' = M.(x, y, y', 1), var Lambda2, and y' = P.(y, 1), var Pi2."""
    f = np.array([[m[0], m[1] + p[0] * m[2]], [0.0, p[0]]])
    q = np.array([[lambda2 + m[2] ** 2 * pi2, m[2] * pi2], [m[2] * pi2, pi2]])
    mean_y = p[1] / (1 - p[0])
    return f, q, np.array([(m[3] + mean_y * (m[1] + m[2])) / (1 - m[0]), mean_y])


def model_from_regression(m: np.ndarray, lambda2: np.ndarray, p: np.ndarray, pi2: np.ndarray, joint: np.ndarray) -> RegimeModel:
    """A model from regressions of all pairs: M (K, K, 4), Lambda2, P (K, K, 2), Pi2. Own moments are those of the pairs (j, j)."""
    k_all = len(joint)
    f, q, mean = np.zeros((k_all, k_all, 2, 2)), np.zeros((k_all, k_all, 2, 2)), np.zeros((k_all, 2))
    for j, k in np.ndindex(k_all, k_all):
        f[j, k], q[j, k], own = from_regression(m[j, k], lambda2[j, k], p[j, k], pi2[j, k])
        mean[j] = own if j == k else mean[j]
    gamma = np.array([fq_to_cov(f[j, j], q[j, j])[0] for j in range(k_all)])
    return RegimeModel(mean, gamma, np.einsum("jab,jkcb->jkac", gamma, f), joint)


def interpolate(corners: np.ndarray, a: float, b: float) -> np.ndarray:
    """Bilinear mean of corners (2, 2, ...) at (a, b)."""
    return (1 - a) * (1 - b) * corners[0, 0] + (1 - a) * b * corners[0, 1] + a * (1 - b) * corners[1, 0] + a * b * corners[1, 1]


def example_model() -> RegimeModel:
    """Two regimes, fitted by hand to the scale of events.value; used by the catalogue."""
    mean = np.array([[10.0, 45.0], [20.0, 60.0]])
    gamma = np.array([[[100.0, 90.0], [90.0, 400.0]], [[225.0, 60.0], [60.0, 900.0]]])
    scale = np.array([[0.6, 0.3], [0.3, 0.5]])
    sigma = np.array([[scale[j, k] * np.sqrt(np.outer(np.diag(gamma[j]), np.diag(gamma[k]))) * [[1.0, 0.3], [0.4, 0.8]] for k in (0, 1)] for j in (0, 1)])
    return RegimeModel(mean, gamma, sigma, np.array([[0.55, 0.1], [0.1, 0.25]]))
