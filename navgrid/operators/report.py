"""Reports of faulty rows: the whole report is a table, the error carries a bounded text and the table's place."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from navgrid.session import discard, materialise

SHOWN = 1_000  # rows that an error names


class ReportedError(ValueError):
    """Rows that break a rule. ``place`` is the Parquet folder that lists them all, ``rows`` their number."""

    def __init__(self, text: str, rows: int, place: str):
        super().__init__(text)
        self.rows, self.place = rows, place

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.place)


def refuse(faulty: DataFrame, title: str, entry: Column, order: Sequence[Column | str]) -> None:
    """Raise ReportedError if there are faulty rows; ``title`` may name their number as {n}.

    Tasks write the report, and the driver gets the first entries in order (a top-n), at most SHOWN.
    """
    written = materialise(faulty)
    n = written.count()
    if not n:
        discard(written)
        return
    first = [r[0] for r in written.orderBy(*order).limit(SHOWN).select(entry).collect()]
    place = written.inputFiles()[0].rpartition("/")[0]
    rest = f" and {n - SHOWN} more, all listed in {place}" if n > SHOWN else ""
    raise ReportedError(f"{title.format(n=n)}: {', '.join(first)}{rest}", n, place)
