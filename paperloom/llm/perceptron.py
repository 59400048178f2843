"""Averaged perceptron over string features."""

from __future__ import annotations

from collections import defaultdict


class AveragedPerceptron:
    """Multi-class perceptron; the weights are averaged over all updates."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {}
        self._total: dict[tuple[str, str], float] = defaultdict(float)
        self._stamp: dict[tuple[str, str], int] = defaultdict(int)
        self._n = 0

    def scores(self, features: list[str], ops: list[str]) -> list[float]:
        out = dict.fromkeys(ops, 0.0)
        for f in features:
            row = self.w.get(f)
            if row:
                for op in ops:
                    if op in row:
                        out[op] += row[op]
        return [out[op] for op in ops]

    def learn(self, features: list[str], ops: list[str], right: str) -> None:
        s = self.scores(features, ops)
        guess = ops[max(range(len(ops)), key=s.__getitem__)]
        self._n += 1
        if guess == right:
            return
        for f in features:
            row = self.w.setdefault(f, {})
            for op, v in ((right, 1.0), (guess, -1.0)):
                self._total[f, op] += (self._n - self._stamp[f, op]) * row.get(op, 0.0)
                self._stamp[f, op] = self._n
                row[op] = row.get(op, 0.0) + v

    def average(self) -> None:
        for f, row in self.w.items():
            for op in row:
                total = self._total[f, op] + (self._n - self._stamp[f, op]) * row[op]
                row[op] = total / max(self._n, 1)
        self._total.clear()
        self._stamp.clear()
