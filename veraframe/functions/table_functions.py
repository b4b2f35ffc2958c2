"""User functions in the FROM clause of SQL: detectors by LATERAL, and passes over the ordered rows of a group.

A detector gives rows (det, confidence) for a content; null contents have none. A pass sees a group's rows in order, one at a
time, and holds what it needs of those before; Spark partitions and sorts the table as the function asks for, so the call
needs no PARTITION BY. Null group keys are a group, no rows give no rows; tables without the columns are refused when the
query is analysed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

DETECTIONS = T.StructType().add("det", T.IntegerType()).add("confidence", T.DoubleType())


def register_detector(spark: SparkSession, name: str, detector: Callable[[object], Iterable[tuple[int, float]]]) -> None:
    """``SELECT t.*, d.det, d.confidence FROM t, LATERAL name(t.content) d`` gives the detector's finds in each content."""

    class Detector:
        @staticmethod
        def analyze(content: AnalyzeArgument) -> AnalyzeResult:
            if content.isTable:
                raise ValueError(f"{name} takes a content, not a table")
            return AnalyzeResult(DETECTIONS)

        def eval(self, content: object) -> Iterator[tuple[int, float]]:
            for det, confidence in detector(content) if content is not None else ():
                yield int(det), float(confidence)

    spark.udtf.register(name, udtf(Detector))


def register_runs(spark: SparkSession, name: str, group: str, position: str, most_gap: int = 1) -> None:
    """``SELECT * FROM name(TABLE(t))``: (group, first, last, n) of the runs of rows whose positions are at most ``most_gap`` apart.

    ``position`` is an integer; rows without one are in no run.
    """

    class Runs:
        def __init__(self) -> None:
            self.run = None

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError(f"{name} takes a table")
            kinds = {f.name: f.dataType for f in table.dataType.fields}
            missing = {group, position} - set(kinds)
            if missing:
                raise ValueError(f"{name}: the table has no column {', '.join(sorted(missing))}")
            schema = T.StructType().add(group, kinds[group]).add("first", T.LongType()).add("last", T.LongType()).add("n", T.LongType())
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(group)], orderBy=[OrderingColumn(position)])

        def eval(self, row: Row) -> Iterator[tuple]:
            at = row[position]
            if at is None:
                return
            if self.run and at - self.run[2] <= most_gap:
                self.run = (*self.run[:2], at, self.run[3] + 1)
                return
            if self.run:
                yield self.run
            self.run = (row[group], at, at, 1)

        def terminate(self) -> Iterator[tuple]:
            if self.run:
                yield self.run

    spark.udtf.register(name, udtf(Runs))
