"""The operator catalogue: name -> family, input kind, parameters and expression builder."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from ..plans.expr import Node

# Which parameters are refused.
#: Whole-number parameters that may be below 1.
ANY_WHOLE = {"utc_offset_minutes", "n_first", "n_last", "fast_type", "slow_type", "signal_type", "adf_lags", "displacement"}
#: Smallest period of operators that need more than one row.
LEAST_PERIOD = {
    2: "AdaptiveCci Alpha Beta BetaNeutralSpread BipowerVariation BurkeRatio CalmarRatio ChoppinessIndex CommonSenseRatio ConditionalValueAtRisk CorrelationTrendIndicator DetrendedStdDev DistanceSsd HasbrouckInformationShare "
    "HistoricalVolatility InformationRatio JumpIndicator KaseDevStop KendallTau LinearRegression LinRegChannel LinRegIntercept LinRegSlope M2Measure MartinRatio PairwiseBeta PearsonCorrelation ProjectionBands RSquared "
    "RollingCorrelation RollingCovariance RollingMinMaxScaler Rwi SharpeRatio SortinoRatio SpearmanCorrelation SpreadBollingerBands SterlingRatio TailRatio TradeSignAutocorrelation TrendLabel TreynorRatio Tsf TsfOscillator "
    "TtmSqueeze UpsidePotentialRatio ValueAtRisk YangZhangVolatility",
    3: "KRatio OuHalfLife RollMeasure Skewness SpreadAr1Coefficient StandardError StandardErrorBands",
}
#: Bounds of numbers: parameter or operator.parameter -> condition on x.
BOUNDS = {
    "multiplier": "x > 0", "atr_multiplier": "x > 0", "percent": "x > 0", "pct": "x > 0", "step_size": "x > 0", "block_size": "x > 0", "bucket_volume": "x > 0", "divisor": "x > 0", "num_std": "x > 0", "bb_mult": "x > 0",
    "kc_mult": "x > 0", "k_inner": "x > 0", "k_outer": "x > 0", "v": "0 <= x <= 1", "gamma": "0 <= x <= 1", "quantile": "0 <= x <= 1", "confidence": "0 < x < 1", "decay": "0 < x < 1", "omega": "x > 0",
    "Garch11.alpha": "x >= 0", "Garch11.beta": "x >= 0", "HoltWinters.alpha": "0 < x <= 1", "HoltWinters.beta": "0 < x <= 1", "coverage": "0 < x <= 1", "value_area_pct": "0 < x <= 1", "q": "x >= 2",
    "LeadLagCrossCorrelation.window_": "x >= 2", "beta_period": "x >= 2", "z_period": "x >= 2",
}
#: Conditions that tie parameters.
TIED = {
    "Garch11": "alpha + beta < 1", "VarianceRatio": "period >= q + 2", "Autocorrelation": "lag_ < period", "Psar": "af_start <= af_max", "Cointegration": "period >= 2 * adf_lags + 4",
    **dict.fromkeys("ZeroLagMacd AwesomeOscillatorHistogram Kama VolumeWeightedMacd Stc Kvo PpoHistogram ChaikinOscillator Ppo MacdIndicator Apo AwesomeOscillator VolumeOscillator MacdHistogram DecyclerOscillator".split(), "fast < slow"),
}

#: Columns that each kind of input needs, besides key and order.
INPUTS = {
    "x": ("x",),
    "pair": ("x", "y"),
    "candle": ("open", "high", "low", "close", "volume"),
    "timed": ("open", "high", "low", "close", "volume", "ts"),
    "derivatives": ("funding_rate", "mark_price", "index_price", "futures_price", "open_interest", "long_size", "short_size", "taker_buy_volume", "taker_sell_volume", "long_liquidation", "short_liquidation"),
    "trade": ("price", "size", "side"),
    "quote": ("price", "size", "side", "mid"),
    "book": ("bids", "asks"),
    "breadth": ("adv", "dec", "adv_volume", "dec_volume", "volume", "members", "highs", "lows", "above", "signals"),
}


@dataclass
class Operator:
    name: str
    family: str
    kind: str
    build: Callable[..., Node | dict[str, Node]]
    params: dict = field(default_factory=dict)

    def outputs(self, **params) -> dict[str, Node]:
        """Output name -> node; a single output is named ``value``."""
        unknown = set(params) - set(self.params)
        if unknown:
            raise ValueError(f"{self.name} has no parameter {sorted(unknown)}")
        self.check(self.params | params)
        got = self.build(**(self.params | params))
        return got if isinstance(got, dict) else {"value": got}

    def check(self, values: dict) -> None:
        """Refuses parameters that have no meaning, before any plan is made."""

        def refuse(why: str) -> None:
            raise ValueError(f"{self.name}: {why}")

        for k, v in values.items():
            default = self.params[k]
            if isinstance(default, bool) or not isinstance(default, int | float):
                continue
            if not isinstance(v, int | float) or isinstance(v, bool) or not math.isfinite(v):
                refuse(f"{k} must be a finite number")
            if isinstance(default, int):
                if v != int(v):
                    refuse(f"{k} must be whole")
                if k not in ANY_WHOLE and v < 1:
                    refuse(f"{k} must be at least 1")
            for bound in (BOUNDS.get(k), BOUNDS.get(f"{self.name}.{k}")):
                if bound and not eval(bound, {"x": v}):  # noqa: S307  a fixed text of this module
                    refuse(f"{k} must satisfy {bound.replace('x', k)}")
        least = next((n for n, names in LEAST_PERIOD.items() if self.name in names.split()), 1)
        if values.get("period", least) < least:
            refuse(f"period must be at least {least}")
        if (tied := TIED.get(self.name)) and not eval(tied, {}, values):  # noqa: S307  a fixed text of this module
            refuse(f"{tied} must hold")


OPERATORS: dict[str, Operator] = {}


def family(name: str, kind: str):
    """Decorator maker: registers a function under its name, with its defaults as parameters."""

    def at(kind=kind):
        def add(f):
            params = {k: p.default for k, p in inspect.signature(f).parameters.items()}
            OPERATORS[f.__name__] = Operator(f.__name__, name, kind, f, params)
            return f

        return add

    return at


def get(name: str) -> Operator:
    if name not in OPERATORS:
        raise KeyError(f"unknown operator {name}")
    return OPERATORS[name]
