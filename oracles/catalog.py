"""All oracle texts by query name."""

from oracles import checks, market, news, policy, streams, training

ORACLES = {**market.ORACLES, **news.ORACLES, **policy.ORACLES, **training.ORACLES, **streams.ORACLES, **checks.ORACLES}
