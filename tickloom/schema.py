"""Types, intervals and default parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Minutes of each interval name; an unknown name counts as an hour.
MINUTES = {"1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "8h": 480, "12h": 720, "1d": 1440, "3d": 4320, "1w": 10080}

BARS = "symbol string, bar_start timestamp_ntz, bar_end timestamp_ntz, open double, high double, low double, close double, volume double"
TRADES = (
    "run_id string, strategy string, symbol string, side int, entry_price double, exit_price double, quantity double, amount double, "
    "cost double, pnl double, pnl_pct double, exit_reason string, opened_at timestamp_ntz, closed_at timestamp_ntz"
)
EQUITY = "run_id string, ts timestamp_ntz, equity double, balance double, invested double"
KLINE_MESSAGE = "stream string, data struct<e:string,k:struct<s:string,i:string,c:string,x:boolean,T:bigint,o:string,h:string,l:string,v:string>>"
#: Positional fields of a raw candle of the exchange's REST interface.
RAW_KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")


def minutes(interval: str) -> int:
    return MINUTES.get(interval, 60)


def duration(interval: str) -> str:
    return f"{minutes(interval)} minutes"


@dataclass(frozen=True)
class RiskParams:
    """Limits of the account; percentages are whole numbers."""

    max_daily_drawdown: float = 5.0
    max_weekly_drawdown: float = 10.0
    max_daily_loss: float = 500.0
    max_consecutive_losses: int = 5
    max_position_pct: float = 10.0
    max_leverage: float = 3.0
    max_open_trades: int = 8
    max_exposure_pct: float = 80.0
    min_stop_pct: float = 0.5
    trailing_pct: float = 2.0
    emergency_pct: float = -5.0
    position_pct: float = 5.0
    stop_pct: float = 2.0
    take_profit_pct: tuple[float, ...] = (3.0, 5.0, 10.0)
    leverage: float = 2.0
    core_share: float = 0.7
    satellite_share: float = 0.3
    min_position_pct: float = 1.0


@dataclass(frozen=True)
class CostParams:
    """Fee of each side and spread of a round trip, in per cent."""

    taker_fee_pct: float = 0.04
    spread_pct: dict[str, float] = field(default_factory=dict)
    default_spread_pct: float = 0.03
    enabled: bool = True


@dataclass(frozen=True)
class SignalWeights:
    indicator: float = 0.5
    ml: float = 0.3
    news: float = 0.2
    threshold: float = 0.5
    counter_threshold: float = 0.65


@dataclass(frozen=True)
class Strategy:
    """A declarative strategy; conditions are texts of the condition language, by side."""

    name: str
    indicators: dict[str, dict] = field(default_factory=dict)
    entry: dict[str, tuple[str, ...]] = field(default_factory=dict)
    exit: dict[str, tuple[str, ...]] = field(default_factory=dict)
    reduce: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict)
    timeframes: tuple[str, ...] = ("1h",)
    symbols: tuple[str, ...] = ()
    enabled: bool = True
    mode: str = "indicator"
    ml_weight: float | None = None
    ml_threshold: float | None = None
    stop_pct: float | None = None
    trailing_pct: float | None = None
    max_hold_hours: float | None = None
    use_indicator_exits: bool = True
