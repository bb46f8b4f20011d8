"""Small learners over a bounded table of statistics, in numpy on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Condition:
    """``column > cut`` or, with ``above`` false, ``column <= cut``."""

    column: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.column] > self.cut if self.above else x[:, self.column] <= self.cut


Rule = tuple[Condition, ...]


def rule_holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def simplified(rule: Rule) -> Rule:
    """One bound a side and column."""
    best: dict[tuple[int, bool], float] = {}
    for c in rule:
        key = (c.column, c.above)
        best[key] = c.cut if key not in best else (max if c.above else min)(best[key], c.cut)
    return tuple(Condition(k[0], k[1], v) for k, v in sorted(best.items()))


def cuts_of(x: np.ndarray, bins: int = 24) -> list[np.ndarray]:
    """Candidate thresholds of each column: midpoints between neighbouring values at quantiles."""
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) < 2:
            out.append(np.zeros(0))
            continue
        at = np.unique(np.searchsorted(values, np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[:-1], method="lower")))
        at = np.unique(np.concatenate((at, np.linspace(0, len(values) - 2, min(bins, len(values) - 1)).astype(int))))
        at = at[at < len(values) - 1]
        out.append((values[at] + values[at + 1]) / 2)
    return out


def _grow(x, cuts, grad, hess, rows, depth, path, paths):
    """Regression tree on gradients; gathers the path of every node and returns the step of each row in ``rows``."""
    total_g, total_h = grad[rows].sum(), hess[rows].sum()
    step = np.full(len(rows), total_g / (total_h + 1.0))
    if path:
        paths.append(path)
    if depth == 0 or len(rows) < 10:
        return step
    best, base = None, total_g ** 2 / (total_h + 1.0)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        bucket = np.searchsorted(cut, x[rows, j], side="left")
        g = np.cumsum(np.bincount(bucket, weights=grad[rows], minlength=len(cut) + 1))[:-1]
        h = np.cumsum(np.bincount(bucket, weights=hess[rows], minlength=len(cut) + 1))[:-1]
        n = np.cumsum(np.bincount(bucket, minlength=len(cut) + 1))[:-1]
        gain = g ** 2 / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - base
        gain[(n < 5) | (n > len(rows) - 5)] = -1
        k = int(np.argmax(gain))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (gain[k], j, cut[k])
    if best is None:
        return step
    _, j, cut = best
    left = x[rows, j] <= cut
    step[left] = _grow(x, cuts, grad, hess, rows[left], depth - 1, (*path, Condition(j, False, float(cut))), paths)
    step[~left] = _grow(x, cuts, grad, hess, rows[~left], depth - 1, (*path, Condition(j, True, float(cut))), paths)
    return step


def boosted_paths(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, rate: float = 0.3, share: float = 0.7, seed: int = 7) -> list[Rule]:
    """Paths of gradient-boosted trees as rules, each once."""
    rng, score, cuts, paths = np.random.default_rng(seed), np.zeros(len(y)), cuts_of(x), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < share)
        own: list[Rule] = []
        if len(rows) > 10:
            step = np.zeros(len(y))
            step[rows] = _grow(x, cuts, grad, hess, rows, depth, (), own)
            score[rows] += rate * step[rows]
            rest = np.setdiff1d(np.arange(len(y)), rows)
            for rule in own:  # rows left out move with the last path that holds
                hold = rule_holds(rule, x[rest])
                inside = rule_holds(rule, x[rows])
                if inside.any():
                    step[rest[hold]] = step[rows[inside]].mean()
            score[rest] += rate * step[rest]
        paths.extend(own)
    return list(dict.fromkeys(simplified(p) for p in paths))


def lasso_logistic(z: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic fit (accelerated proximal gradient)."""
    n, k = z.shape
    w = v = np.zeros(k)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b = c = float(np.log(mean / (1 - mean)))
    power = np.ones(k) / max(1, k) ** 0.5
    for _ in range(20):
        power = z.T @ (z @ power)
        norm = np.linalg.norm(power)
        if norm == 0:
            break
        power /= norm
    rate = 1.0 / (0.25 * (max(norm if k else 0.0, 1e-9) / n + 1.0))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30)))
        step = v - rate * (z.T @ (p - y) / n)
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * strength, 0)
        new_b = c - rate * float((p - y).mean())
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def log_loss(score: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, score) - y * score))


def sparse_ensemble(x: np.ndarray, y: np.ndarray, *, strengths=(0.02, 0.01, 0.005, 0.002, 0.001), seed: int = 7, **params) -> tuple[list[tuple[Rule, float]], float]:
    """([(rule, weight)], intercept): tree paths weighed by a lasso whose strength a held-back third chooses."""
    y = y.astype(float)
    if len(y) < 20 or y.min() == y.max():
        mean = (y.sum() + 0.5) / (len(y) + 1)
        return [], float(np.log(mean / (1 - mean)))
    rules = boosted_paths(x, y, seed=seed, **params)
    z = np.stack([rule_holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    share = z.mean(axis=0)
    used = np.flatnonzero((share > 0.002) & (share < 0.998))
    rules, z = [rules[i] for i in used], z[:, used]
    _, one = np.unique(z, axis=1, return_index=True)  # equal columns once
    one = np.sort(one)
    rules, z = [rules[i] for i in one], z[:, one]
    back = np.random.default_rng(seed).random(len(y)) < 1 / 3
    best = min(strengths, key=lambda s: (lambda w, b: log_loss(z[back] @ w + b, y[back]))(*lasso_logistic(z[~back], y[~back], s, 200)))
    w, b = lasso_logistic(z, y, best)
    return [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6], float(b)


def decision_list(x: np.ndarray, y: np.ndarray, *, max_rules: int = 12, max_conditions: int = 3, min_rows: int = 5, precision: float = 0.95,
                  seed: int = 7) -> list[Rule]:
    """Sequential covering: rules for y = 1, in order.

    Each rule grows condition by condition on two thirds of the rows still uncovered, by information gain over the rows it
    holds for; then it loses its last conditions as long as the other third does not speak against that. A rule is kept if
    its precision, with one doubtful row added, reaches ``precision`` on both parts together; what it covers leaves.
    """
    rows, rules, rng = np.arange(len(y)), [], np.random.default_rng(seed)
    back = rng.random(len(y)) < 1 / 3
    for _ in range(max_rules):
        grow, prune = rows[~back[rows]], rows[back[rows]]
        if y[grow].sum() < min_rows:
            break
        rule: Rule = ()
        inside = grow
        while len(rule) < max_conditions and y[inside].min(initial=1) == 0:
            p0 = y[inside].sum()
            base = np.log2(p0 / len(inside))
            best = None
            for j, cut in enumerate(cuts_of(x[inside])):
                if not len(cut):
                    continue
                bucket = np.searchsorted(cut, x[inside, j], side="left")
                low1 = np.cumsum(np.bincount(bucket, weights=y[inside], minlength=len(cut) + 1))[:-1]
                low = np.cumsum(np.bincount(bucket, minlength=len(cut) + 1))[:-1]
                for above, ones, n in ((False, low1, low), (True, p0 - low1, len(inside) - low)):
                    gain = np.where(ones >= min_rows, ones * (np.log2(np.maximum(ones, 1e-9) / np.maximum(n, 1)) - base), -1)
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                        best = (gain[k], Condition(j, above, float(cut[k])))
            if best is None:
                break
            rule = (*rule, best[1])
            inside = grow[rule_holds(rule, x[grow])]
        worth = lambda r: (lambda h: (y[h].sum() - (1 - y[h]).sum()) / max(1, len(h)))(prune[rule_holds(r, x[prune])])
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hold = rows[rule_holds(rule, x[rows])] if rule else rows[:0]
        if not len(hold) or y[hold].sum() / (len(hold) + 1) < precision or y[hold].sum() < min_rows:
            break
        rules.append(simplified(rule))
        rows = np.setdiff1d(rows, hold)
    return rules
