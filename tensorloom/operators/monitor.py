"""A fit's trace in a shared folder, and the state from which it goes on after the driver is lost.

At the end of each sweep (and of each outer step of automatic smoothing) the trace so far and what the loop needs to go on are put in place by one
rename. A fit that is started again with the same monitor folder, data and settings takes up after the last sweep recorded, and ends with the
same cores as one that never stopped.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..plans.backends import State
from ..sources.state import StateFolder


class FitMonitor:
    """every: sweeps between records of a stage. after: called with each record (a dict), for progress on a screen or elsewhere."""

    def __init__(self, spark: SparkSession, folder: str, every: int = 1, after=None):
        self.spark, self.store, self.every, self.after = spark, StateFolder(spark, folder), every, after
        self.number, self.open, self.stages, self.rows = -1, None, {}, []
        if (found := self.store.latest()) is not None:
            self.number, self.open = found[0], json.loads(found[1])
            self.rows = self.open["rows"]

    @staticmethod
    def _settings(p) -> str:
        """What must be the same for a recorded state to be a state of this fit."""
        about = [p.family, p.sizes, p.n_beta, float(p.backend.n), repr(p.control), [repr(x.tolist()) for x in p.penalties]]
        return hashlib.sha256(json.dumps(about).encode()).hexdigest()

    def record(self, p, stage: str, s: State, sweep: int, more: dict) -> None:
        row = {"stage": stage, "sweep": sweep, "objective": more.get("objective"), "lambda": np.asarray(p.lam, float).tolist()}
        self.rows.append(row)
        if self.after is not None:
            self.after(row)
        if stage == "outer":  # what the stages within it recorded belongs to the step that is done
            self.stages = {}
        own = {"sweep": sweep, "cores": [c.tolist() for c in s.cores], "layout": ["C" if c.flags.c_contiguous else "F" for c in s.cores], "beta": s.beta.tolist(), "lam": np.asarray(p.lam, float).tolist(), "smooth": [t.lam for t in p.smooths], "more": more}
        self.stages[stage] = own
        if sweep % self.every == 0 or stage == "outer":
            self.number += 1
            self.store.put(self.number, json.dumps({"settings": self._settings(p), "stages": self.stages, "history": p.history, "rows": self.rows}))

    def take(self, p, stage: str, s: State) -> tuple[State, int, dict]:
        """Once for each stage: where the recorded fit stood."""
        if self.open is None or stage not in self.open["stages"]:
            if self.open is not None and stage != "outer" and "outer" not in self.open["stages"]:
                self.open = None
            return s.copy(), 0, {}
        if self.open["settings"] != self._settings(p):
            raise ValueError("the folder holds the states of another fit; clear it, or name another")
        own = self.open["stages"].pop(stage)
        self.stages[stage] = own
        p.lam = np.array(own["lam"])
        for t, x in zip(p.smooths, own["smooth"], strict=True):
            t.lam = x
        if not p.history:
            p.history.extend(self.open["history"])
        # In memory as they were: products of arrays in another order may differ in the last bits.
        return State([np.array(c, order=o) for c, o in zip(own["cores"], own.get("layout", "C" * len(own["cores"])), strict=True)], np.array(own["beta"])), own["sweep"], own["more"]

    def done(self) -> None:
        """The fit has ended: its states go, so that the folder can serve another. The trace stays in `rows`."""
        self.store.clear()
        self.open, self.stages, self.number = None, {}, -1

    def trace_frame(self) -> DataFrame:
        """A row for each record: stage, sweep, objective (null for outer steps), lambda."""
        return self.spark.createDataFrame([(r["stage"], r["sweep"], r["objective"], r["lambda"]) for r in self.rows], "stage string, sweep int, objective double, lambda array<double>")
