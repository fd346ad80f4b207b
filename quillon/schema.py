"""Record shapes and the shape of semantic ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

ITEM = StructType([StructField("text_id", StringType()), StructField("text", StringType()), StructField("doc_id", StringType()), StructField("operation", StringType()), StructField("description", StringType())])
QUERY = StructType([StructField("text_id", StringType()), StructField("text", StringType())])
MESSAGE = StructType([StructField("role", StringType()), StructField("content", StringType())])
CHAT = StructType([StructField("conversations", ArrayType(MESSAGE))])
TEST_ITEM = StructType([StructField("text", StringType()), StructField("doc_id", StringType()), StructField("conversations", ArrayType(MESSAGE))])
PREDICTION = StructType(
    [StructField("text", StringType()), StructField("true_docid", StringType()), StructField("predicted_docid", ArrayType(StringType())), StructField("hit_at_1", BooleanType()), StructField("hit_at_10", BooleanType())]
)
RESULTS = StructType(
    [StructField("hit_at_1", DoubleType()), StructField("hit_at_10", DoubleType()), StructField("hit_at_1_count", LongType()), StructField("hit_at_10_count", LongType()), StructField("total", LongType()), StructField("predictions", ArrayType(PREDICTION))]
)
EDGE = StructType([StructField("prefix", ArrayType(IntegerType())), StructField("token", IntegerType()), StructField("lvl", IntegerType())])


@dataclass(frozen=True)
class IdSpec:
    """A semantic id: ``subspaces`` codes below ``codes``, and one more level for the collision ordinal."""

    dim: int = 64
    subspaces: int = 4
    codes: int = 8

    def __post_init__(self) -> None:
        if self.subspaces < 1 or self.dim % self.subspaces:
            raise ValueError(f"dimension {self.dim} can't be cut into {self.subspaces} equal subspaces")

    @property
    def width(self) -> int:
        return self.dim // self.subspaces

    @property
    def levels(self) -> int:
        return self.subspaces + 1
