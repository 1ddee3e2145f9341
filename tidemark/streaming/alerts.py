"""Alerts of a signal stream: the batch rule on every micro-batch, with its state in versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.alerts import PAIR, STATE, candidates, decided, ready, rules_of, to_members
from tidemark.session import cut_lineage
from tidemark.sources.tables import overwrite_batch
from tidemark.streaming.ledger import held_table


class AlertJob:
    """`foreachBatch` body over a stream of signals in the order of their issue.

    Saved between batches: the last ready signal of every pair, which is the predecessor of the next one whether it was wanted or not, and
    the cooldown state of every rule. A batch reads the state of the newest earlier batch and replaces its own folder, so a repeated batch
    sends the same alerts.
    """

    def __init__(self, subscriptions: DataFrame, root: str, now: str = "issued_at", daily_reset: bool = True):
        self.rules, self.members = rules_of(subscriptions)
        self.root, self.now, self.daily_reset = root, now, daily_reset

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, states = (held_table(spark, f"{self.root}/{name}", batch_id) for name in ("prior", "state"))
        made = cut_lineage(decided(candidates(batch, self.rules, self.now, before), states, self.daily_reset))
        overwrite_batch(to_members(made, self.members), f"{self.root}/alerts", batch_id)

        left = made.where("NOT _sent").select("subscription_id", *STATE)
        if states is not None:
            left = left.unionByName(states.join(left.select("subscription_id"), "subscription_id", "left_anti"))
        overwrite_batch(left, f"{self.root}/state", batch_id)
        last = ready(batch).groupBy(*PAIR).agg(F.max_by(F.struct("label", "confidence"), F.struct(self.now, "sequence")).alias("prior"))
        if before is not None:
            last = last.unionByName(before.join(last.select(*PAIR), PAIR, "left_anti"))
        overwrite_batch(last, f"{self.root}/prior", batch_id)
