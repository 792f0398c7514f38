"""Every threshold the audits run under, defined once.

Fixed values that must equal the audited behaviour (window quantiles, bin
counts, level caps, significance levels, materiality cut-offs, precedence).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
AUDIT_TRAIN = (0.0, 0.17)
AUDIT_HOLDOUT = (0.83, 1.0)
SPLIT_CUTS = (0.75, 0.85, 0.90)          # train / gap / validation / test
NULL_BUCKET = "__null__"
OTHER_BUCKET = "__other__"
Z95 = 1.959963984540054                  # qnorm(0.975)
SECONDS_PER_DAY = 86400
FREQUENCY_MIN_COUNT = 2
FREQUENCY_TRAIN_FRACTION = 0.75
PSI_EPS = 1e-6
PRECEDENCE = ("time_consistency", "distribution_shift", "redundancy",
              "segment_qualification")
RARITY_BREAKS = (0, 10, 100, 1000, 10000)   # bands [0,10) [10,100) ... [10000, inf)
RARITY_LABELS = ("<10", "10-99", "100-999", "1k-10k", ">10k")
PSI_GRID = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)
RHO2_GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class TCPolicy:
    train_window: tuple = AUDIT_TRAIN
    holdout_window: tuple = AUDIT_HOLDOUT
    bins: int = 10
    max_levels: int = 20
    margin: float = 0.02          # recorded only; no rule uses it
    min_rows: int = 100
    min_positives: int = 10
    conf_level: float = 0.95
    alpha: float = 0.05
    min_gini_drop: float = 0.04
    woe_eps: float = 0.05
    reject_by_block: bool = True


@dataclass(frozen=True)
class DSPolicy:
    bins: int = 10
    max_levels: int = 20
    permutations: int = 200
    psi_threshold: float = 0.25
    alpha: float = 0.05


@dataclass(frozen=True)
class RDPolicy:
    min_rho2: float = 0.8
    redun_r2: float = 0.9
    max_group: int | None = None  # no limit


@dataclass(frozen=True)
class SQPolicy:
    bins: int = 10
    min_rows: int = 100
    min_positives: int = 10
    artefact_auc: float = 0.55
    alpha: float = 0.05
    reject: bool = False


@dataclass(frozen=True)
class CatPolicy:
    max_levels: int = 50
    draws: int = 500
    min_rows: int = 50
    conf_level: float = 0.95
    period_floor: float = 0.1


@dataclass(frozen=True)
class Policy:
    tc: TCPolicy = field(default_factory=TCPolicy)
    ds: DSPolicy = field(default_factory=DSPolicy)
    rd: RDPolicy = field(default_factory=RDPolicy)
    sq: SQPolicy = field(default_factory=SQPolicy)
    cat: CatPolicy = field(default_factory=CatPolicy)
    precedence: tuple = PRECEDENCE


POLICY = Policy()
