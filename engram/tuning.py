"""Parameters that the environment may set, each inside its range; a bad value counts as none."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from engram.functions import scoring
from engram.operators import maintain, modes, search

PREFIX = "ENGRAM_"


@dataclass(frozen=True)
class Tunables:
    """Defaults of search and upkeep."""

    decay_alpha: float = scoring.DECAY_ALPHA
    half_life_days: float = 0.0
    mmr_lambda: float = search.SearchParams.mmr_lambda
    rewrite_sure: float = modes.REWRITE_SURE
    staged_short: int = modes.STAGED_SHORT
    staged_asked: int = modes.STAGED_ASKED
    near_duplicate: float = maintain.NEAR_DUPLICATE
    auto_merge: float = maintain.AUTO_MERGE

    @property
    def alpha(self) -> float:
        """The decay rate: of the half-life where one is set."""
        return scoring.half_life_alpha(self.half_life_days) if self.half_life_days > 0 else self.decay_alpha


RANGES: dict[str, tuple[float, float]] = {
    "decay_alpha": (0.0, 1.0),
    "half_life_days": (0.0, 3650.0),
    "mmr_lambda": (0.0, 1.0),
    "rewrite_sure": (0.0, 1.0),
    "staged_short": (1, 50),
    "staged_asked": (5, 200),
    "near_duplicate": (0.5, 1.0),
    "auto_merge": (0.5, 1.0),
}


def tunables(env: Mapping[str, str] | None = None) -> Tunables:
    """Tunables with what ``env`` sets, such as ENGRAM_DECAY_ALPHA."""
    env, base, found = os.environ if env is None else env, Tunables(), {}
    for f in fields(base):
        try:
            v = type(getattr(base, f.name))(env.get(PREFIX + f.name.upper(), "").strip())
        except ValueError:
            continue
        low, high = RANGES[f.name]
        if math.isfinite(v) and low <= v <= high:
            found[f.name] = v
    return replace(base, **found)
