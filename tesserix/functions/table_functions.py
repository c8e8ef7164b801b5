"""Table functions for SQL: SELECT ... FROM originals, LATERAL role_views(role, 'v4')."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tesserix.sources.relations import ROLE_CONDITIONS

GENERATIONS = sorted({g for g, _ in ROLE_CONDITIONS})


class RoleViews:
    """(condition, ord) of a role's views; none for roles that the generation doesn't have. The generation is a constant, checked when the query is analysed."""

    @staticmethod
    def analyze(role: AnalyzeArgument, generation: AnalyzeArgument) -> AnalyzeResult:
        if role.dataType != StringType():
            raise ValueError(f"a role is a string, not {role.dataType.simpleString()}")
        if not generation.isConstantExpression or generation.value not in GENERATIONS:
            raise ValueError(f"the generation is one of {', '.join(GENERATIONS)}")
        return AnalyzeResult(StructType().add("condition", StringType()).add("ord", IntegerType()))

    def eval(self, role: str, generation: str):
        yield from ((name, k) for k, name in enumerate(ROLE_CONDITIONS.get((generation, role), ())))


def register(spark: SparkSession) -> None:
    """Give the session the table functions of this module."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("role_views", udtf(RoleViews))
