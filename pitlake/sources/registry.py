"""The log of all runs: JSON lines that can only be added to, the study that runs belong to, and looks at the holdout."""

from __future__ import annotations

import contextlib
import datetime
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.sources.lake import append_jsonl, canonical, read_jsonl

UNNAMED = "unnamed"
_study: ContextVar[str] = ContextVar("study", default=UNNAMED)

RUNS = "run_id string, study string, fingerprint string, strategy string, params string, setting string, seed long, start string, end string, data_version string, sharpe double, cagr double, touches boolean, notes string, logged_at string"
TOUCHES = "strategy string, study string, mode string, start string, end string, reason string, logged_at string"


@contextlib.contextmanager
def study(name: str) -> Iterator[str]:
    """Runs logged within belong to the study of this name; the one before is in force again afterwards."""
    if not name.strip():
        raise ValueError("a study needs a name")
    token = _study.set(name)
    try:
        yield name
    finally:
        _study.reset(token)


def current_study() -> str:
    return _study.get()


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="microseconds")


def data_version(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: a short hash of what a table holds (rows, first and last of each key column, sum of row hashes), the same in
    whatever order its rows lie. It is computed in one pass, partial sums first."""
    row = F.xxhash64(*df.columns)
    parts = [F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 31))).cast("string"), F.lit(""))]
    parts += [F.coalesce(f(F.col(k)).cast("string"), F.lit("")) for k in key for f in (F.min, F.max)]
    return df.agg(F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 16).alias("data_version"))


def fingerprint(strategy: str, params: dict, setting: str, start: str, end: str, seed: int = 0, version: str = "") -> str:
    """What a run was, as a short hash, whatever the order of its parameters."""
    import hashlib

    text = canonical({"strategy": strategy, "params": params, "setting": setting, "start": start, "end": end, "seed": seed, "data": version})
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class Registry:
    """Runs, curves and looks under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _has(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self, name: str, kind: str) -> DataFrame:
        schema = self.spark.createDataFrame([], kind).schema
        path = f"{self.root}/{name}"
        return read_jsonl(self.spark, path, schema) if self._has(path) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, kind: str, record: dict) -> None:
        append_jsonl(self.spark, f"{self.root}/{name}", [record], self.spark.createDataFrame([], kind).schema)

    def log_run(self, *, strategy: str, params: dict, setting: str, start: str, end: str, seed: int = 0, version: str = "", touches: bool = False, notes: str = "", **stats: float) -> dict:
        """Add a run to the log, in the study in force. Every run is logged: there is no switch."""
        record = {
            "run_id": uuid.uuid4().hex, "study": current_study(), "fingerprint": fingerprint(strategy, params, setting, start, end, seed, version), "strategy": strategy, "params": canonical(params),
            "setting": setting, "seed": seed, "start": start, "end": end, "data_version": version, "touches": touches, "notes": notes, "logged_at": now(),
        } | {k: float(v) for k, v in stats.items() if k in ("sharpe", "cagr")}
        self._append("runs", RUNS, record)
        return record

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def log_curve(self, run_id: str, values: DataFrame) -> None:
        """Month-end values (date, nav) of a run; a later curve of the run supersedes."""
        last = values.groupBy(F.last_day("date").alias("month")).agg(F.round(F.max_by("nav", "date"), 6).alias("nav"))
        line = last.agg(F.sort_array(F.collect_list(F.struct("month", "nav"))).alias("x")).select(F.lit(run_id).alias("run_id"), F.lit(now()).alias("logged_at"), F.col("x.month").alias("dates"), F.col("x.nav").alias("navs"))
        line.coalesce(1).write.mode("append").json(f"{self.root}/curves")

    def curves(self) -> DataFrame:
        """run_id, date, nav of each run's last curve."""
        lines = self._read("curves", "run_id string, logged_at string, dates array<date>, navs array<double>")
        last = lines.groupBy("run_id").agg(F.max_by(F.struct("dates", "navs"), "logged_at").alias("x"))
        return last.select("run_id", F.explode(F.arrays_zip("x.dates", "x.navs")).alias("p")).select("run_id", F.col("p.dates").alias("date"), F.col("p.navs").alias("nav"))

    def touch(self, *, strategy: str, mode: str, start: str, end: str, reason: str = "") -> None:
        """Note a look at the holdout."""
        self._append("touches", TOUCHES, {"strategy": strategy, "study": current_study(), "mode": mode, "start": start, "end": end, "reason": reason, "logged_at": now()})

    def touches(self) -> DataFrame:
        return self._read("touches", TOUCHES)

    def run(self, job: Callable[[], Any], *, strategy: str, mode: str, start: str, end: str, boundary: str, reason: str = "") -> Any:
        """What a job gives, whose window is from start to end. A window that reaches into the holdout must be asked for by
        mode (include or only), and the look is written down before the job runs, so that a job that fails has looked too."""
        if mode not in ("exclude", "include", "only"):
            raise ValueError(f"unknown mode {mode}")
        if end >= boundary:
            if mode == "exclude":
                raise ValueError(f"{end} lies in the holdout, which begins on {boundary}")
            self.touch(strategy=strategy, mode=mode, start=start, end=end, reason=reason)
        return job()


def run_rows(rows: DataFrame) -> DataFrame:
    """What reports show of runs: names and figures, without their parameters."""
    return rows.select("run_id", "study", "strategy", "setting", "start", "end", F.round("sharpe", 3).alias("sharpe"), F.round("cagr", 4).alias("cagr"))


def parameter(c: str, name: str) -> Column:
    """A parameter of the JSON text of a run."""
    return F.get_json_object(c, f"$.{name}")

