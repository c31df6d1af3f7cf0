"""Strategy files: one YAML document for each strategy, in a folder of the driver. They are configuration, a few rows."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import asdict
from pathlib import Path
from typing import Any

from ..schema import Strategy


def file_name(name: str) -> str:
    """Lower case; blanks, slashes and what isn't a word character, a dash or a dot become one underscore."""
    return re.sub(r"_+", "_", re.sub(r"[^\w\-.]", "_", name.lower())).strip("_")


def from_dict(data: Mapping[str, Any]) -> Strategy:
    """A strategy from a document with the published keys; ml_config and risk_exit are nested, and other keys passed over."""
    ml, risk = data.get("ml_config") or {}, data.get("risk_exit") or {}
    sides = lambda key: {side: tuple(texts or ()) for side, texts in (data.get(key) or {}).items()}
    reduce = {side: tuple((c["condition"], float(c.get("reduce_pct", 50))) for c in found or ()) for side, found in (data.get("reduce_conditions") or {}).items()}
    return Strategy(
        name=data["name"], indicators=dict(data.get("indicators") or {}), entry=sides("entry_conditions"), exit=sides("exit_conditions"), reduce=reduce,
        timeframes=tuple(data.get("timeframes") or ("1h",)), symbols=tuple(data.get("symbols") or ()), enabled=data.get("enabled", True), mode=data.get("mode", "trend"),
        ml_weight=float(ml.get("weight", 0.3)) if ml.get("enabled") else None, stop_pct=risk.get("stop_loss_pct"), trailing_pct=risk.get("trailing_stop_pct"),
        max_hold_hours=risk.get("max_hold_hours"), use_indicator_exits=risk.get("use_indicator_exits", True),
    )


def to_dict(s: Strategy) -> dict[str, Any]:
    own = asdict(s)
    lists = lambda key: {side: [*texts] for side, texts in own[key].items()}
    risk = {"stop_loss_pct": s.stop_pct, "trailing_stop_pct": s.trailing_pct, "max_hold_hours": s.max_hold_hours, "use_indicator_exits": s.use_indicator_exits}
    return {
        "name": s.name, "enabled": s.enabled, "mode": s.mode, "timeframes": [*s.timeframes], "symbols": [*s.symbols], "indicators": own["indicators"],
        "entry_conditions": lists("entry"), "exit_conditions": lists("exit"),
        "reduce_conditions": {side: [{"condition": c, "reduce_pct": p} for c, p in found] for side, found in s.reduce.items()},
        "ml_config": {"enabled": s.ml_weight is not None, "weight": s.ml_weight if s.ml_weight is not None else 0.3},
        "risk_exit": {k: v for k, v in risk.items() if v is not None},
    }


class StrategyFolder:
    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _path(self, name: str) -> Path:
        return self.folder / f"{file_name(name)}.yaml"

    def save(self, strategy: Strategy) -> None:
        """Replaces a file of the same name."""
        import yaml

        self.folder.mkdir(parents=True, exist_ok=True)
        self._path(strategy.name).write_text(yaml.safe_dump(to_dict(strategy), allow_unicode=True, sort_keys=False), encoding="utf-8")

    def load(self, name: str) -> Strategy:
        """FileNotFoundError if there is none."""
        import yaml

        return from_dict(yaml.safe_load(self._path(name).read_text(encoding="utf-8")))

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.yaml"))

    def load_all(self) -> list[Strategy]:
        return [self.load(n) for n in self.names()]

    def delete(self, name: str) -> bool:
        """Whether there was one."""
        found = self._path(name).exists()
        self._path(name).unlink(missing_ok=True)
        return found
