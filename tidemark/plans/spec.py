"""Names and parameters of a panel and of the analyses on it."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Feature lists of the models.
FEATURES = (
    "ret_z_60", "ret_5d", "ret_21d", "mom_12_1", "vol_ratio", "vol_of_vol", "vol_20", "dist_sma_20", "dist_sma_60", "dist_sma_200",
    "trend_strength", "bb_pctb", "bb_bandwidth", "rsi_14", "macd_hist", "drawdown", "drawdown_speed", "max_drawdown_252", "xs_ret_rank",
    "xs_vol_rank", "xs_mom_rank", "beta_60", "corr_spy_60", "idio_vol_60", "amihud", "hl_range", "turnover_z_60", "is_month_end",
    "is_quarter_end", "pregel_score",
)
BAYES_FEATURES = ("ret_z_60", "vol_ratio", "vol_of_vol", "drawdown", "drawdown_speed", "skew_60", "kurt_60", "trend_strength", "bb_bandwidth", "pregel_score")
NODE_FEATURES = ("xs_ret_rank", "xs_vol_rank", "xs_mom_rank", "dist_sma_20", "dist_sma_60", "bb_pctb", "ret_z_60", "vol_ratio", "drawdown", "trend_strength")


@dataclass(frozen=True)
class PanelSpec:
    """Columns that make a table a panel, and its benchmark entity (None: the one with most rows, first by name)."""

    entity: str = "ticker"
    time: str = "date"
    group: str = "asset_class"
    price: str = "adj_close"
    benchmark: str | None = None


@dataclass(frozen=True)
class Params:
    initial_train: int = 504
    refit_every: int = 63
    min_obs: int = 252
    hold_days: int = 5
    threshold: float = 0.5
    stop_loss: float = -0.02
    edge_threshold: float = 0.30
    graph_days: int = 90
    layers: int = 3
    least_nodes: int = 5
    costs_bps: tuple[int, ...] = (0, 5, 10, 20)
    bootstrap: int = 1000
    annual: int = 252
    groups: tuple[str, ...] = field(default=("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))

    @property
    def periods(self) -> float:
        """Predictions of a year."""
        return self.annual / self.refit_every


PANEL, PARAMS = PanelSpec(), Params()
