"""When a training loop slows down and when it ends."""

from __future__ import annotations

import math
from dataclasses import dataclass

from actiscope.operators.evaluate import PLATEAU_THRESHOLD
from actiscope.schema import LEARNING_RATE, PLATEAU_FACTOR, PLATEAU_PATIENCE, STOP_PATIENCE


@dataclass
class StopRule:
    """Early stopping with a rate that is cut on a plateau, one call per epoch."""

    rate: float = LEARNING_RATE
    patience: int = STOP_PATIENCE
    plateau_patience: int = PLATEAU_PATIENCE
    factor: float = PLATEAU_FACTOR
    best: float = math.inf
    mark: float = math.inf
    wait: int = 0
    flat: int = 0

    def update(self, loss: float) -> tuple[bool, bool]:
        """Whether the epoch is the best so far, and whether to stop."""
        if loss < self.mark * (1 - PLATEAU_THRESHOLD):
            self.mark, self.flat = loss, 0
        else:
            self.flat += 1
            if self.flat > self.plateau_patience:
                self.rate, self.flat = self.rate * self.factor, 0
        improved = loss < self.best
        self.best, self.wait = (loss, 0) if improved else (self.best, self.wait + 1)
        return improved, self.wait >= self.patience
