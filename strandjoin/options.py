"""Options of an alignment run, checked together."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AlignOptions:
    """mode "v": at most v mismatches; mode "n": at most n in the first `seed_len` bases and at most max_penalty in all."""

    mode: str = "n"
    v: int = 2
    n: int = 2
    seed_len: int = 28
    max_penalty: int = 70
    rounding: bool = True
    forward: bool = True
    reverse: bool = True
    k: int | None = None
    every: bool = False
    best: bool = False
    strata: bool = False
    m: int | None = None
    sample_m: int | None = None
    min_insert: int = 0
    max_insert: int = 250
    orientation: str = "fr"
    allow_contain: bool = False
    report_singles: bool = False
    skip: int = 0
    upto: int | None = None
    trim5: int = 0
    trim3: int = 0
    seed: int = 0
    strict: bool = False

    def __post_init__(self) -> None:
        bad = [
            ("mode is v or n", self.mode not in ("v", "n")),
            ("-v is 0 to 3", not 0 <= self.v <= 3),
            ("-n is 0 to 3", not 0 <= self.n <= 3),
            ("-l is 5 at least", self.seed_len < 5),
            ("-e is 0 at least", self.max_penalty < 0),
            ("-3 is 0 at least", self.trim3 < 0),
            ("-5 is 0 at least", self.trim5 < 0),
            ("-k is 1 at least", self.k is not None and self.k < 1),
            ("-m is 1 at least", self.m is not None and self.m < 1),
            ("-M is 1 at least", self.sample_m is not None and self.sample_m < 1),
            ("-m and -M exclude each other", self.m is not None and self.sample_m is not None),
            ("the orientation is fr, rf or ff", self.orientation not in ("fr", "rf", "ff")),
            ("-I is at most -X", self.min_insert > self.max_insert),
            ("a strand is searched", not (self.forward or self.reverse)),
            ("--strata needs --best", self.strata and not self.best),
            ("--strata needs -k over 1, -a, -m or -M", self.strata and not (self.every or (self.k or 1) > 1 or self.m or self.sample_m)),
            ("-s and -u are 0 at least", self.skip < 0 or (self.upto or 0) < 0),
        ]
        wrong = [what for what, x in bad if x]
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def budget(self) -> int:
        """Mismatches allowed in the part that seeds cover."""
        return self.v if self.mode == "v" else self.n

    @property
    def shortest(self) -> int:
        """The least read length that can align."""
        return 4 if self.mode == "n" else max(1, self.budget + 1)

    @property
    def limit(self) -> int | None:
        return None if self.every else self.k or 1


def last_wins(flags: list[tuple[str, int]], strict: bool = False) -> AlignOptions:
    """Options from flags ("v", 3), ("n", 2)...: of -v and -n the last holds, or both are an error where strict."""
    names = [f for f, _ in flags]
    if strict and "v" in names and "n" in names:
        raise ValueError("-v and -n exclude each other")
    found = {("seed_len" if f == "l" else "max_penalty" if f == "e" else "trim5" if f == "5" else "trim3" if f == "3" else f): x for f, x in flags}
    modes = [f for f in names if f in ("v", "n")]
    return AlignOptions(mode=modes[-1] if modes else "n", **found)
