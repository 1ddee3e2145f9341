"""Streams give what the batch queries give, so their oracles are those of the batch queries."""

from oracles.market import ORACLES as MARKET
from oracles.policy import ORACLES as POLICY

ORACLES: dict[str, str] = {
    "stream_signals": POLICY["signals"], "stream_pointer": POLICY["current_signal"], "stream_change_feed": POLICY["change_feed"],
    "stream_alerts": POLICY["alert_dispatch"],
    "stream_bars": f"SELECT * EXCLUDE (width_s) FROM ({MARKET['ohlcv_bars']}) WHERE width_s = 60",
}
