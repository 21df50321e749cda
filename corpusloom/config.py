"""Settings of a training run, checked when made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EmbeddingConfig:
    """Defaults and checks of the command line's options; owners, sample and seed are explicit here."""

    dimensions: int = 100
    window_size: int = 3
    epochs: int = 10
    learning_rate: float = 0.1
    min_learning_rate: float = 0.0001
    negative_samples: int = 5
    min_count: int = 5
    sample: float = 1e-3
    owners: int = 16
    seed: int = 42
    threshold_scope: str = "owner"  # or "global"
    scope: str = "document"  # or "corpus"
    rounds_per_epoch: int = 1
    batch: int = 64

    def __post_init__(self) -> None:
        for name in ("dimensions", "window_size", "epochs", "learning_rate", "min_learning_rate", "negative_samples", "min_count", "owners", "rounds_per_epoch", "batch"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be greater than zero, not {getattr(self, name)}")
        if self.threshold_scope not in ("owner", "global") or self.scope not in ("document", "corpus"):
            raise ValueError("unknown scope")

    def rate(self, epoch: int) -> float:
        """Learning rate of an epoch, counted from 0; the minimum is approached but not reached."""
        return self.learning_rate - epoch * (self.learning_rate - self.min_learning_rate) / max(1, self.epochs)
