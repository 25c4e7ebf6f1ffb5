"""Run configuration: nested settings with validation, dotted overrides and a fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Labels:
    horizon: str = "close_next"
    max_gap: int = 5
    halflife: float = 756.0


@dataclass(frozen=True)
class Splits:
    folds: int = 8
    purge: int = 2
    embargo: int = 5
    least_train: int = 500
    anchored: bool = True


@dataclass(frozen=True)
class Costs:
    commission_bps: float = 1.0
    spread_bps: float = 1.0
    slippage_bps: float = 2.0

    @property
    def one_way_bps(self) -> float:
        return self.commission_bps + self.spread_bps + self.slippage_bps


@dataclass(frozen=True)
class Data:
    anchor_offset: int = 60
    least_rows: int = 750
    context: tuple[str, ...] = ()


@dataclass(frozen=True)
class Trust:
    blocks: int = 12
    permutations: int = 60
    pbo_alarm: float = 0.35
    dsr_alarm: float = 0.90
    least_trades: int = 60


@dataclass(frozen=True)
class Trading:
    sizing: str = "continuous"
    threshold: float = 0.55
    most_position: float = 0.35
    least_position: float = 0.02
    leverage: float = 1.0


@dataclass(frozen=True)
class Models:
    families: tuple[str, ...] = ("elastic_net", "forest", "boosted")
    trials: int = 24
    most_features: int = 40
    seed: int = 7


@dataclass(frozen=True)
class Config:
    symbols: tuple[str, ...] = ()
    data: Data = field(default_factory=Data)
    labels: Labels = field(default_factory=Labels)
    splits: Splits = field(default_factory=Splits)
    models: Models = field(default_factory=Models)
    trust: Trust = field(default_factory=Trust)
    trading: Trading = field(default_factory=Trading)
    costs: Costs = field(default_factory=Costs)

    def checked(self) -> "Config":
        """This, if its settings go together; all that don't are named at once otherwise."""
        from .operators.labels import EXIT

        wrong, rows = [], EXIT.get(self.labels.horizon, (None, None))[1]
        if rows is None:
            wrong.append(f"labels.horizon must be one of {sorted(EXIT)}")
        elif self.splits.purge < rows + 1:
            wrong.append(f"splits.purge ({self.splits.purge}) must be {rows + 1} or more, the horizon and a row, or labels overlap")
        rules = {
            "splits need a fold and no negative embargo": self.splits.folds >= 1 and self.splits.embargo >= 0,
            "costs can't be negative": min(self.costs.commission_bps, self.costs.spread_bps, self.costs.slippage_bps) >= 0,
            "trust.blocks must be even, and 6 or more": self.trust.blocks % 2 == 0 and self.trust.blocks >= 6,
            "trading.threshold must lie in [0.5, 1)": 0.5 <= self.trading.threshold < 1,
            "trading.most_position must lie in (0, 2]": 0 < self.trading.most_position <= 2,
            "trading.least_position must be below most_position": self.trading.least_position < self.trading.most_position,
            "data.anchor_offset must lie in 1 to 180 minutes": 0 < self.data.anchor_offset <= 180,
            "models.trials must be 5 or more": self.models.trials >= 5,
        }
        wrong += [text for text, fine in rules.items() if not fine]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    def changed(self, overrides: dict[str, object]) -> "Config":
        """A copy with dotted settings replaced, e.g. {"labels.horizon": "open_next"}; later ones win."""
        out = self
        for path, value in overrides.items():
            out = _set(out, path.split("."), value)
        return out.checked()

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def _set(node, path: list[str], value):
    if not is_dataclass(node) or path[0] not in {f.name for f in fields(node)}:
        raise KeyError(".".join(path))
    return replace(node, **{path[0]: value if len(path) == 1 else _set(getattr(node, path[0]), path[1:], value)})


def for_run(base: Config, universe: dict, symbol: str, variant: str | None = None) -> Config:
    """The settings of one symbol: those of the universe, then of the variant, then the symbol's own; keys that begin with _ are notes."""
    out = base
    for more in (universe.get("config"), (universe.get("variants") or {}).get(variant) if variant else None, (universe.get("overrides") or {}).get(symbol)):
        out = out.changed({k: v for k, v in (more or {}).items() if not k.startswith("_")})
    return replace(out, symbols=(symbol,))
