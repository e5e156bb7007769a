"""Schemas and option objects of event histories: entities with events, edges, parameter draws, observations and windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expr import z_value

PARAMETERS = ("R0", "k", "r", "alpha", "theta")

DRAWS = T.StructType([T.StructField("traj_id", T.LongType()), *(T.StructField(p, T.DoubleType()) for p in PARAMETERS)])
EVENTS = T.StructType([T.StructField("traj_id", T.LongType()), T.StructField("t", T.DoubleType())])
EDGES = T.StructType([T.StructField("traj_id", T.LongType()), T.StructField("parent_t", T.DoubleType()), T.StructField("child_t", T.DoubleType())])
WINDOWS = T.StructType([T.StructField("win_id", T.IntegerType()), T.StructField("t_min", T.DoubleType()), T.StructField("t_max", T.DoubleType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
OBSERVATIONS = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("n", T.LongType())])


@dataclass(frozen=True)
class Parameter:
    """A named range; fixed where both ends are equal."""

    name: str
    lo: float
    hi: float

    def __post_init__(self) -> None:
        if self.lo > self.hi:
            raise ValueError(f"{self.name}: {self.lo} > {self.hi}")

    @property
    def fixed(self) -> bool:
        return self.lo == self.hi


@dataclass
class Parameters:
    """The five ranges and validators: SQL expressions over their names (a power is ``power(x, y)``)."""

    ranges: dict[str, Parameter]
    validators: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        lower = {p.lower(): p for p in PARAMETERS}
        given = {lower.get(n.lower()) for n in self.ranges}
        if given != set(PARAMETERS) or len(self.ranges) != len(PARAMETERS):
            raise ValueError(f"needs each of {PARAMETERS} once, got {tuple(self.ranges)}")
        self.ranges = {lower[n.lower()]: p for n, p in self.ranges.items()}

    def require(self, expr: str) -> Parameters:
        self.validators.append(expr)
        return self

    def valid(self) -> Column:
        """All validators hold; none hold trivially."""
        out = F.lit(True)
        for e in self.validators:
            out = out & F.expr(e)
        return out


@dataclass(frozen=True)
class WindowOptions:
    """Options of acceptance windows, in days and shares."""

    sigma_days: float = 1.8
    beta: float = 0.75
    neighbor_weight: float = 0.6
    grid_step_days: float = 0.2
    min_seg_days: float = 1.0
    kmax: int = 3
    baseline_p: float = 0.10
    alpha: float = 0.10
    h_max: float = 0.30
    eps_share: float = 1e-6
    include_gap_windows: bool = True
    include_union_windows: bool = True
    max_unions_to_keep: int = 6
    gap_scale: float = 0.4
    include_global_total: bool = True
    day_snap: bool = False
    strategy: str = "both"  # or cluster, segment

    @property
    def z_alpha(self) -> float:
        return z_value(self.alpha)

    @property
    def z_beta(self) -> float:
        return z_value(1 - self.beta)
