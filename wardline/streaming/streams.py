"""Streaming extensions: calls checked as they come, verdict counts per window, and ledgers sealed with state.

The batch operators have no streaming counterpart in what they were modelled on; these are additions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gate import Gate
from ..operators.ledger import GENESIS


def checked(gate: Gate, calls: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """A stream of calls against the registry and, if given, a static table of scans."""
    return gate.check(calls, scans)


def verdict_counts(verdicts: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Decisions per event-time window, final once the watermark has passed."""
    return verdicts.withWatermark(ts, late).groupBy(F.window(ts, window), "decision").agg(F.count(F.lit(1)).alias("n"))


SEALED = "chain string, seq long, prev string, digest string, body string"


class Sealer(StatefulProcessor):
    """Keeps the head and length of one chain and seals its entries as they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("head", "head string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, n = self.state.get() if self.state.exists() else (GENESIS, 0)
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "body"]).itertuples():
            digest = hashlib.sha256(f"{head}|{n}|{row.body}".encode()).hexdigest()
            out.append((key[0], n, head, digest, row.body))
            head, n = digest, n + 1
        self.state.update((head, n))
        yield pd.DataFrame(out, columns=["chain", "seq", "prev", "digest", "body"])

    def close(self) -> None:
        pass


def sealed(entries: DataFrame) -> DataFrame:
    """chain, seq, prev, digest, body of a stream of entries (chain, ts, body); digests are those of the batch ledger."""
    return entries.groupBy("chain").transformWithStateInPandas(Sealer(), SEALED, "Append", "None")
