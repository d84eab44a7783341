"""Sufficient statistics that grow with a stream: each micro-batch adds its sums, and fits need no other data.

Beyond the batch operators: Gaussian moments are additive, so a model can be refitted after any batch at a cost that doesn't depend on
how much has been seen. With a folder the sums and the number of the batch they reach are put in place together, by one rename, before a batch
counts as done; a stream that starts again goes on from there, and a batch that it repeats adds nothing.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.basis import Knots
from ..operators.spline import Prepared, TensorSpline
from ..plans.backends import MomentBackend, build
from ..sources.state import StateFolder


class StreamMoments:
    """foreachBatch target. A stream numbers its batches upwards, so the last number tells which have been seen."""

    def __init__(self, spec: TensorSpline, knots: list[Knots], spark: SparkSession | None = None, folder: str | None = None):
        self.spec, self.knots, self.sums, self.last = spec, knots, None, -1
        self.store = StateFolder(spark, folder) if folder else None
        if self.store and (found := self.store.latest()):
            self._from(found[1])

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        s, sums = self.spec, self.sums
        if not df.isEmpty():
            m = build(df, self.knots, s.x, s.y, "gaussian", s.weight, s.offset, s.linear, kind="moments").m
            sums = m if sums is None else {k: sums[k] + m[k] for k in m}
        if self.store:
            self.store.put(batch_id, self._text(batch_id, sums))
        self.sums, self.last = sums, batch_id

    def fit(self):
        be = MomentBackend([k.k for k in self.knots], self.sums)
        return Prepared(self.spec, "gaussian", self.knots, [], 1 + len(self.spec.linear), be).fit()

    @staticmethod
    def _text(last: int, sums: dict | None) -> str:
        return json.dumps({"last": last, "sums": {k: np.asarray(v).tolist() for k, v in (sums or {}).items()}})

    def _from(self, text: str) -> None:
        state = json.loads(text)
        self.last, self.sums = state["last"], {k: np.array(v) for k, v in state["sums"].items()} or None

    def save(self, spark: SparkSession, path: str) -> None:
        StateFolder(spark, path).put(max(self.last, 0), self._text(self.last, self.sums))

    def load(self, spark: SparkSession, path: str) -> StreamMoments:
        self._from(StateFolder(spark, path).latest()[1])
        return self
