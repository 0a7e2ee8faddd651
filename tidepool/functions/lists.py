"""A table function that turns rows of a pool into one padded list for each query."""

from __future__ import annotations

from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _named(argument: AnalyzeArgument, what: str) -> str:
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{what} must be a constant")
    return argument.value


@udtf(useArrow=True)
class PaddedLists:
    """PaddedLists(TABLE(pool), 'query', 'item', 'label', 'feature,feature', length): a row for each query.

    query, list_len, items, x (length * features numbers, position by position) and y (labels); both are padded
    with zeros up to ``length``.  Rows go by their column ``rank``; those beyond ``length`` are left out, which is
    what a list's length means.  Null features and labels count as 0.
    """

    @staticmethod
    def analyze(pool: AnalyzeArgument, query: AnalyzeArgument, item: AnalyzeArgument, label: AnalyzeArgument, features: AnalyzeArgument, length: AnalyzeArgument) -> AnalyzeResult:
        if not pool.isTable:
            raise ValueError("the first argument must be a table")
        q, names = _named(query, "query"), _named(features, "features").split(",")
        have = pool.dataType.fieldNames()
        if lost := sorted({q, _named(item, "item"), _named(label, "label"), "rank", *names} - set(have)):
            raise ValueError(f"the table lacks {lost}")
        if _named(length, "length") < 1:
            raise ValueError("length must be positive")
        doubles = ArrayType(DoubleType())
        schema = StructType().add(q, pool.dataType[q].dataType).add("list_len", IntegerType()).add("items", ArrayType(LongType())).add("x", doubles).add("y", doubles)
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(q)], orderBy=[OrderingColumn("rank"), OrderingColumn(item.value)])

    def __init__(self):
        self.query, self.size, self.items, self.x, self.y = None, None, [], [], []

    def eval(self, row, query, item, label, features, length):
        if self.size is None:
            self.query, self.size = row[query], (length, len(features.split(",")))
        if len(self.items) < length:
            self.items.append(row[item])
            self.x += [float(row[f] or 0.0) for f in features.split(",")]
            self.y.append(float(row[label] or 0.0))

    def terminate(self):
        if self.size is not None:
            length, width = self.size
            n = len(self.items)
            yield self.query, n, self.items, self.x + [0.0] * ((length - n) * width), self.y + [0.0] * (length - n)
