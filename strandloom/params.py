"""Run parameters and their checks."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    #: Node length; an edge has k + 1 letters.
    k: int = 23
    both_strands: bool = True
    #: Edges seen less often are not built, and edges at or below `drop_mult` are not searched.
    min_edge_count: int = 1
    drop_mult: int = 1
    #: Start edges.
    min_start_mult: int = 20
    min_start_indegree: int = 2
    #: Cycle lengths in nodes, ends included.
    min_cycle: int = 28
    max_cycle: int = 77
    #: Largest integer ratio of a start's multiplicity to that of an edge on its cycle.
    max_ratio: int = 500
    #: A start with so many cycles or more loses all of them.
    cycle_cap: int = 500
    #: If set, a start with more open paths stops with the cycles found so far, and is reported as truncated.
    max_frontier: int | None = None
    #: Arrays.
    min_cycles: int = 2
    max_repeat_nodes: int = 26
    min_spacer_nodes: int = 23
    min_spacers: int = 3
    min_spacer_letters: int = 23
    max_spacer_letters: int = 50
    #: Share of a start's cycles that must hold a node for it to belong to the repeat.
    support: float = 1.0

    @property
    def trim(self) -> int:
        """Letters cut from the end of a spelled cycle so that one period is left."""
        return self.k - 2

    def __post_init__(self) -> None:
        wrong = [f.name for f in fields(self) if f.name not in ("both_strands", "support", "drop_mult") and (v := getattr(self, f.name)) is not None and v < 1]
        if self.k < 3:
            wrong.append("k")
        if not 0 < self.support <= 1:
            wrong.append("support")
        if self.min_cycle > self.max_cycle:
            wrong.append("min_cycle")
        if self.min_spacer_letters > self.max_spacer_letters:
            wrong.append("min_spacer_letters")
        if wrong:
            raise ValueError(f"out of range: {', '.join(sorted(set(wrong)))}")
