"""The configuration of a run: nested JSON to a checked, frozen object."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

CATEGORIES = ("events", "calls", "delegatecalls", "zero_value_calls", "creations")
STAGES = ("extraction", "decoding", "transformation")
SOURCES = ("normal_transactions", "internal_transactions", "transactions_by_events")


@dataclass(frozen=True)
class Config:
    dapp: tuple[str, ...]
    non_dapp: tuple[str, ...] = ()
    min_block: int = 0
    max_block: int = 1 << 62
    sources: frozenset[str] = frozenset(SOURCES)
    output: frozenset[tuple[str, str]] = frozenset((side, c) for side in ("dapp", "non_dapp") for c in CATEGORIES)
    stages: frozenset[str] = frozenset(STAGES)
    sensitive_events: bool = False
    log_folder: str = "output"
    node_url: str | None = None
    delegatecall_value_filter: bool = True
    order_by_tx_index: bool = False
    prune: str = "after"
    incomplete: str = "warn"  # or fail: what a run does if captured pages are not whole
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        problems = []
        if not self.dapp or not all(isinstance(a, str) and a for a in self.dapp):
            problems.append("contracts.dapp needs addresses")
        if not (isinstance(self.min_block, int) and isinstance(self.max_block, int) and 0 <= self.min_block <= self.max_block):
            problems.append("block_range needs 0 <= min_block <= max_block")
        if self.prune not in ("after", "before"):
            problems.append("prune is after or before")
        if self.incomplete not in ("warn", "fail"):
            problems.append("misc.incomplete is warn or fail")
        if not self.log_folder:
            problems.append("misc.log_folder is empty")
        if problems:
            raise ValueError("; ".join(problems))

    @classmethod
    def from_dict(cls, raw: dict) -> Config:
        def part(*names: str, default=None):
            value = raw
            for n in names:
                value = value.get(n, {}) if isinstance(value, dict) else {}
            return default if value == {} else value

        def on(flags, names) -> set[str]:
            bad = [k for k, v in (flags or {}).items() if k in names and not isinstance(v, bool)]
            if bad:
                raise ValueError(f"{bad} must be true or false")
            return {k for k in names if (flags or {}).get(k, True)}

        node = part("ethereum_node", default=None)
        url = f"{node['protocol']}{node['host']}:{node['port']}" if node else None
        lower = lambda xs: tuple(x.lower() for x in xs or ())
        return cls(
            dapp=lower(part("contracts", "dapp")),
            non_dapp=lower(part("contracts", "non_dapp")),
            min_block=part("block_range", "min_block", default=0),
            max_block=part("block_range", "max_block", default=1 << 62),
            sources=frozenset(on(part("extraction"), SOURCES)),
            output=frozenset((side, c) for side in ("dapp", "non_dapp") for c in on(part("output", side), CATEGORIES)),
            stages=frozenset(on(part("stages"), STAGES)),
            sensitive_events=bool(part("misc", "sensitive_events", default=False)),
            log_folder=part("misc", "log_folder", default="output"),
            order_by_tx_index=bool(part("misc", "order_by_tx_index", default=False)),
            node_url=url,
            incomplete=part("misc", "incomplete", default="warn"),
        )

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path) as f:
            return cls.from_dict(json.load(f))
