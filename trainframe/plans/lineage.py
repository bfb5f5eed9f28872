"""Where a dataset comes from: operations with row counts that are observed while the data is written."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Step:
    operation: str
    params: dict
    rows_out: int | None = None


@dataclass
class Lineage:
    """A chain of steps from a source. Counts come from observations, so they cost no pass of their own."""

    source: str
    steps: list[Step] = field(default_factory=list)
    created: float = field(default_factory=time.time)
    _seen: list[Observation] = field(default_factory=list, repr=False)

    def track(self, df: DataFrame, operation: str, **params) -> DataFrame:
        seen = Observation()
        self._seen.append(seen)
        self.steps.append(Step(operation, params))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def finish(self) -> Lineage:
        """Fill the counts in, after an action has run."""
        for step, seen in zip(self.steps, self._seen, strict=True):
            step.rows_out = seen.get["n"]
        return self

    def to_json(self) -> str:
        return json.dumps({"source": self.source, "created": self.created, "steps": [asdict(s) for s in self.steps]}, ensure_ascii=False, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Lineage:
        got = json.loads(text)
        return cls(got["source"], [Step(**s) for s in got["steps"]], got["created"])

    def report(self) -> str:
        lines = [f"from {self.source}"]
        for k, s in enumerate(self.steps, 1):
            lines.append(f"{k}. {s.operation} {s.params or ''} -> {'?' if s.rows_out is None else s.rows_out} rows")
        return "\n".join(lines)


def save_with_lineage(df: DataFrame, path: str, lineage: Lineage) -> None:
    """Write ``df`` and ``<path>.lineage.json`` beside it."""
    from ..sources.files import save

    save(df, path)
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".lineage.json")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(lineage.finish().to_json().encode()))
    finally:
        out.close()
