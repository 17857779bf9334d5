"""Runtime settings: which targets, feature groups and lookbacks are active."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

# The names a settings file may list.
TARGETS = {
    "OUTAGE_CELL_UNAVAILABLE": "target_cell_unavailable_2h",
    "OUTAGE_CELL_OUTAGE": "target_cell_outage_2h",
    "OUTAGE_CELL_FAULT": "target_cell_fault_2h",
    "OUTAGE_SERVICE_UNAVAILABLE": "target_service_unavailable_2h",
}
FEATURES = {"BBU_ALARM": "bbu", "RRU_ALARM": "rru", "POWER_ALARM": "power"}
MODES = ("STAGING", "PRODUCTION")


@dataclass(frozen=True)
class Settings:
    active_targets: tuple[str, ...] = tuple(TARGETS)
    active_features: tuple[str, ...] = tuple(FEATURES)
    lookback_hours: tuple[int, ...] = (6, 24, 336, 720)
    environment_mode: str = "STAGING"
    problems: tuple[str, ...] = field(default=(), compare=False)

    @property
    def feature_groups(self) -> list[str]:
        return [short for key, short in FEATURES.items() if key in self.active_features]

    @property
    def target_columns(self) -> list[str]:
        return [column for key, column in TARGETS.items() if key in self.active_targets]

    @property
    def streak_hours(self) -> int:
        return min(self.lookback_hours) if self.lookback_hours else 6

    def to_json(self) -> dict:
        return {
            "ACTIVE_TARGETS": list(self.active_targets),
            "ACTIVE_FEATURES": list(self.active_features),
            "LOOKBACK_WINDOWS_HOURS": list(self.lookback_hours),
            "ENVIRONMENT_MODE": self.environment_mode,
        }

    @classmethod
    def from_json(cls, data: dict) -> "Settings":
        """Missing keys take the default; unknown names are reported, not guessed."""
        base = cls().to_json()
        base.update({k: v for k, v in data.items() if k in base})
        problems = [f"unknown target {t}" for t in base["ACTIVE_TARGETS"] if t not in TARGETS]
        problems += [f"unknown feature {f}" for f in base["ACTIVE_FEATURES"] if f not in FEATURES]
        if base["ENVIRONMENT_MODE"] not in MODES:
            problems.append(f"unknown mode {base['ENVIRONMENT_MODE']}")
        lookbacks = tuple(int(h) for h in base["LOOKBACK_WINDOWS_HOURS"])
        problems += [f"lookback {h} is not positive" for h in lookbacks if h <= 0]
        return cls(
            active_targets=tuple(t for t in base["ACTIVE_TARGETS"] if t in TARGETS),
            active_features=tuple(f for f in base["ACTIVE_FEATURES"] if f in FEATURES),
            lookback_hours=tuple(h for h in lookbacks if h > 0),
            environment_mode=base["ENVIRONMENT_MODE"],
            problems=tuple(problems),
        )

    @classmethod
    def load(cls, path: str) -> "Settings":
        """Settings of ``path``; an absent or unreadable file gives the defaults."""
        if not os.path.exists(path):
            return cls()
        try:
            with open(path, encoding="utf-8") as handle:
                return cls.from_json(json.load(handle))
        except (OSError, ValueError, TypeError) as error:
            return cls(problems=(f"defaults used: {error}",))

    def save(self, path: str) -> None:
        folder = os.path.dirname(path)
        if folder:
            os.makedirs(folder, exist_ok=True)
        with open(path, "w", encoding="utf-8") as handle:
            json.dump(self.to_json(), handle, indent=2)

    def with_changes(self, **changes) -> "Settings":
        values = asdict(self)
        values.update(changes)
        return Settings(**values)
