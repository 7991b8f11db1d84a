"""Record scanners as table functions of SQL: one document, many records.

``register(spark)``, then::

    SELECT d.doc_id, r.* FROM docs d, LATERAL records(d.lines, 'employment') r
    SELECT * FROM records_of_lines(TABLE(SELECT doc_id, place, line FROM lines) PARTITION BY (doc_id) ORDER BY (place), 'employment')

The kind (employment, education, projects) is a constant, and decides the columns. The second takes a row a
line: a document is a partition, its lines come in order, and the columns of the key (all but ``line``, and
``place``, which only orders) are passed on in front of the record's. It hands every line to Python by itself;
``gathered`` makes arrays of a large table's lines first, for ``records``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .scanners import SCHEMAS


#: There is no session where a table function is analysed, hence no parser of types.
TYPES = {"string": StringType(), "array<string>": ArrayType(StringType())}


def _fields(kind: AnalyzeArgument) -> StructType:
    if not kind.isConstantExpression or kind.value not in SCHEMAS:
        raise ValueError(f"the kind of records has to be one of {', '.join(SCHEMAS)}")
    columns = [c.split() for c in SCHEMAS[kind.value][1].split(", ")]
    return StructType([StructField("ord", IntegerType()), *[StructField(name, TYPES[of]) for name, of in columns]])


def _rows(lines: list[str | None], kind: str) -> Iterator[tuple]:
    find, schema = SCHEMAS[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    for n, r in enumerate(find([x or "" for x in lines])):
        yield (n, *(r[c] for c in names))


@udtf
class Records:
    """The records of an array of lines; none for a null."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_fields(kind))

    def eval(self, lines, kind):
        yield from _rows(lines or [], kind)


@udtf
class RecordsOfLines:
    """The records of a partition of lines."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or "line" not in lines.dataType.names:
            raise ValueError("a table with a column line is needed")
        key = [f for f in lines.dataType.fields if f.name not in ("line", "place")]
        return AnalyzeResult(StructType([*key, *_fields(kind).fields]))

    def __init__(self):
        self.lines, self.key, self.kind = [], None, None

    def eval(self, row, kind):
        if self.kind is None:
            self.key, self.kind = tuple(row[c] for c in row.__fields__ if c not in ("line", "place")), kind
        self.lines.append(row["line"])

    def terminate(self):
        if self.kind is not None:
            for r in _rows(self.lines, self.kind):
                yield (*self.key, *r)


def gathered(lines: DataFrame) -> DataFrame:
    """lines: a key in any columns, place, line -> the key and lines, an array in order of place; a null line stays as one."""
    key = [c for c in lines.columns if c not in ("line", "place")]
    return lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "line")))["line"].alias("lines"))


def register(spark: SparkSession) -> None:
    spark.udtf.register("records", Records)
    spark.udtf.register("records_of_lines", RecordsOfLines)
