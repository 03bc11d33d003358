"""All indicators of one series, one closed bar at a time: what the block operators are held against."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from tickloom.operators.features import FeatureConfig


def _mean(values: list[float]) -> float:
    return math.fsum(values) / len(values)


def _spread(values: list[float]) -> float:
    m = _mean(values)
    return math.sqrt(math.fsum((v - m) ** 2 for v in values) / len(values))


def _safe(top: float | None, bottom: float | None) -> float | None:
    return None if top is None or bottom is None or bottom == 0 else top / bottom


@dataclass
class SeriesState:
    """What has to be remembered between bars; plain lists and numbers, so it stores as JSON."""

    closes: list[float] = field(default_factory=list)
    volumes: list[float] = field(default_factory=list)
    smooth: dict[str, list[float]] = field(default_factory=dict)  # name -> [count, value]
    last_ms: int = -1
    prev_diff: float | None = None
    known_bandwidth: float | None = None
    last_bandwidth: float | None = None

    def _scan(self, name: str, x: float, alpha: float, seed: int = 1) -> float | None:
        count, value = self.smooth.get(name, [0, 0.0])
        count += 1
        value = value + x / seed if count <= seed else value + alpha * (x - value)
        self.smooth[name] = [count, value]
        return value if count >= seed else None

    def advance(self, high: float, low: float, close: float, volume: float, c: FeatureConfig) -> dict[str, float | None]:
        """All feature columns of the bar that just closed."""
        before = self.closes[-1] if self.closes else None
        self.closes = [*self.closes, close][-(c.reach + 1):]
        self.volumes = [*self.volumes, volume][-c.relative_volume_period:]
        closes, n = self.closes, len(self.closes)

        def tail(size: int) -> list[float] | None:
            return closes[-size:] if n >= size else None

        out: dict[str, float | None] = {f"ret_{p}": _safe(close - closes[-1 - p], closes[-1 - p]) if n > p else None for p in c.return_periods}
        w = tail(c.sma_period)
        out["sma"] = _mean(w) if w else None
        w = tail(c.stddev_period)
        out["stddev"] = _spread(w) if w else None
        w = tail(c.zscore_period)
        out["zscore"] = _safe(close - _mean(w), _spread(w)) if w else None
        out.update(self._bands(tail(c.bollinger_period), close, c.bollinger_k))
        out["roc"] = _safe((close - closes[-1 - c.roc_period]) * 100, closes[-1 - c.roc_period]) if n > c.roc_period else None
        out.update(self._line(tail(c.regression_period)))
        # A return needs two positive closes; others are skipped.
        logs = [math.log(b / a) for a, b in zip(closes, closes[1:]) if a > 0 and b > 0]
        out["autocorrelation"] = self._lagged(logs[-c.autocorrelation_period:], c.autocorrelation_lag) if len(logs) >= c.autocorrelation_period else None
        out["realized_volatility"] = _spread(logs[-c.realized_volatility_period:]) if len(logs) >= c.realized_volatility_period else None
        out["relative_volume"] = _safe(volume, _mean(self.volumes)) if len(self.volumes) == c.relative_volume_period else None
        out["ema"] = self._scan("ema", close, 2 / (c.ema_period + 1))
        reach = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        out["atr"] = self._scan("atr", reach, 1 / c.atr_period, c.atr_period)
        out["rsi"] = out["ewma_volatility"] = None
        if before is not None:
            gain = self._scan("gain", max(close - before, 0.0), 1 / c.rsi_period, c.rsi_period)
            loss = self._scan("loss", max(before - close, 0.0), 1 / c.rsi_period, c.rsi_period)
            if gain is not None and loss is not None:
                out["rsi"] = 50.0 if gain == loss == 0 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
            if before > 0 and close > 0:
                out["ewma_volatility"] = math.sqrt(self._scan("variance", math.log(close / before) ** 2, 1 - c.ewma_lambda) or 0.0)
        out["fast_ema"], out["slow_ema"] = self._scan("fast", close, 2 / 13), self._scan("slow", close, 2 / 27)
        out["prev_diff"], out["diff"] = self.prev_diff, out["fast_ema"] - out["slow_ema"]
        self.prev_diff = out["diff"]
        w = tail(10)
        out["lookback_return"] = _safe(close - w[0], w[0]) if w else None
        out["prev_bandwidth"], out["last_bandwidth"] = self.known_bandwidth, self.last_bandwidth
        self.known_bandwidth = out["bandwidth"] if out["bandwidth"] is not None else self.known_bandwidth
        self.last_bandwidth = out["bandwidth"]
        return out

    @staticmethod
    def _bands(w: list[float] | None, close: float, k: float) -> dict[str, float | None]:
        names = ("bb_middle", "bb_upper", "bb_lower", "percent_b", "bandwidth")
        if not w:
            return dict.fromkeys(names)
        m, s = _mean(w), k * _spread(w)
        if s == 0 or m == 0:
            return dict.fromkeys(names)
        return dict(zip(names, (m, m + s, m - s, (close - m + s) / (2 * s), 2 * s / m)))

    @staticmethod
    def _line(w: list[float] | None) -> dict[str, float | None]:
        names = ("reg_slope", "reg_intercept", "reg_r2")
        if not w or _spread(w) == 0:
            return dict.fromkeys(names)
        n, m = len(w), _mean(w)
        covariance = math.fsum((i - (n - 1) / 2) * (y - m) for i, y in enumerate(w)) / n
        slope = covariance / ((n * n - 1) / 12)
        return dict(zip(names, (slope, m - slope * (n - 1) / 2, slope * covariance / _spread(w) ** 2)))

    @staticmethod
    def _lagged(r: list[float], lag: int) -> float | None:
        a, b = r[:-lag], r[lag:]
        ma, mb = _mean(a), _mean(b)
        return _safe(math.fsum((x - ma) * (y - mb) for x, y in zip(a, b)) / len(a), _spread(a) * _spread(b))


COLUMNS = (
    "ret_1", "ret_5", "ret_15", "ret_60", "sma", "stddev", "zscore", "bb_middle", "bb_upper", "bb_lower", "percent_b", "bandwidth", "roc", "reg_slope", "reg_intercept", "reg_r2",
    "autocorrelation", "realized_volatility", "relative_volume", "ema", "atr", "rsi", "ewma_volatility", "fast_ema", "slow_ema", "prev_diff", "diff", "lookback_return", "prev_bandwidth",
    "last_bandwidth",
)
