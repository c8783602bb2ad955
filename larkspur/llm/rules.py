"""Ordered rule lists by incremental reduced-error pruning, and their form as SQL CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Labelled rows that a rule list is fitted on at most.
FIT_ROWS = 20_000


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.above else x[self.feature] < self.value

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value!r}D"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(x.values()))), dtype=bool)
    for test in rule:
        hit &= test.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: int, speaks_for: dict[str, bool]) -> Rule:
    """Add the test of the largest information gain until no negative row is covered."""
    rule: Rule = ()
    hit = np.ones(len(y), dtype=bool)
    while (hit & ~y).any():
        p0, n0 = (hit & y).sum(), (hit & ~y).sum()
        base = np.log2(p0 / (p0 + n0)) if p0 else 0.0
        best, gain = None, 1e-9
        for f, v in x.items():
            inside = v[hit]
            marks = np.unique(np.quantile(inside, np.linspace(0, 1, cuts)))
            for a in (marks[:-1] + marks[1:]) / 2:
                for above in (speaks_for[f],) if f in speaks_for else (True, False):
                    side = hit & ((v >= a) if above else (v < a))
                    p = (side & y).sum()
                    n = (side & ~y).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - base)) > gain:
                        best, gain = Test(f, above, round(float(a), 4)), g
        if best is None:
            break
        rule = (*rule, best)
        hit &= best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """Drop final tests while (p - n) / (p + n) on the pruning rows does not fall."""

    def worth(r: Rule) -> float:
        hit = covers(r, x)
        p, n = (hit & y).sum(), (hit & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule), 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def _merged(rule: Rule) -> Rule:
    """The same rule with the strictest test per feature and direction."""
    strict: dict[tuple[str, bool], Test] = {}
    for t in rule:
        old = strict.get((t.feature, t.above))
        if old is None or (t.value > old.value) == t.above:
            strict[t.feature, t.above] = t
    return tuple(strict.values())


def induce(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 7, cuts: int = 40, speaks_for: dict[str, bool] | None = None) -> list[Rule]:
    """Rules for the rows where y holds, first match decides; rows that no rule covers are the other class.

    Each rule is grown on two thirds of the rows left and pruned on the rest; a rule that is wrong on half or more of
    the pruning rows it covers ends the list. `speaks_for` holds, for features known to speak for y only when large (True) or
    small (False), which; their tests have that direction alone.
    """
    if len(y) > FIT_ROWS:
        raise ValueError(f"fit on at most {FIT_ROWS} labelled rows")
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(y), dtype=bool)
    while (left & y).any():
        rows = np.flatnonzero(left)
        rng.shuffle(rows)
        cut = len(rows) * 2 // 3
        grow, prune = rows[:cut], rows[cut:]
        part = lambda idx: {f: v[idx] for f, v in x.items()}
        if not y[grow].any():
            break
        rule = _merged(_prune(_grow(part(grow), y[grow], cuts, speaks_for or {}), part(prune), y[prune]))
        hit = covers(rule, part(prune))
        if not rule or (hit & ~y[prune]).sum() >= max(1, (hit & y[prune]).sum()):
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def case(rules: list[Rule]) -> str:
    """The rule list as a SQL CASE expression: true where a rule covers the row."""
    if not rules:
        return "false"
    whens = " ".join(f"when {' and '.join(t.sql() for t in r)} then true" for r in rules)
    return f"case {whens} else false end"


def predict(rules: list[Rule], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(next(iter(x.values()))), dtype=bool)
    for r in rules:
        out |= covers(r, x)
    return out
