"""Table functions for SQL, registered in a session by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class TermTurns:
    """term_turns(TABLE(rows) PARTITION BY key ORDER BY turn, 'term,term'): per key and term the first turn (column
    ``turn``) whose lower-cased ``text`` holds the term, in how many turns it does, and how often without overlap.
    Its first output column is the table's first column, whatever its type. NULL texts hold nothing."""

    def __init__(self) -> None:
        self.key, self.found = None, {}

    @staticmethod
    def analyze(rows: AnalyzeArgument, terms: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or {"turn", "text"} - set(rows.dataType.names):
            raise ValueError("the first argument must be a table with the columns turn and text")
        if terms.value is None:
            raise ValueError("the terms must be a constant")
        first = rows.dataType.fields[0]
        numbers = (StructField(n, LongType()) for n in ("first_turn", "turns", "hits"))
        return AnalyzeResult(StructType([StructField(first.name, first.dataType), StructField("term", StringType()), *numbers]))

    def eval(self, row, terms: str) -> None:
        self.key = row[0]
        text = (row["text"] or "").lower()
        for term in terms.split(","):
            if n := text.count(term):
                first, turns, hits = self.found.get(term, (row["turn"], 0, 0))
                self.found[term] = (first, turns + 1, hits + n)

    def terminate(self) -> Iterator[tuple]:
        for term, counts in self.found.items():
            yield (self.key, term, *counts)


def register(spark: SparkSession) -> None:
    """Make the library's table functions known to a session's SQL."""
    spark.udtf.register("term_turns", TermTurns)
