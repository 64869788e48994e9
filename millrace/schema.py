"""Named dataset schemas, open to further columns, and their check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError

_STRING, _BINARY, _INTEGER, _INTS = T.StringType(), T.BinaryType(), T.LongType(), T.ArrayType(T.LongType())


@dataclass(frozen=True)
class Schema:
    """Required columns by name. Further columns are legal and flow through."""

    name: str
    columns: tuple[tuple[str, T.DataType], ...]

    def extend(self, name: str, *more: tuple[str, T.DataType] | Schema) -> Schema:
        """This schema with more columns, or with those of another schema."""
        columns = dict(self.columns)
        for x in more:
            columns.update(x.columns if isinstance(x, Schema) else [x])
        return Schema(name, tuple(columns.items()))

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, False) for n, t in self.columns])


Dataset = Schema("Dataset", (("id", _STRING),))
TokenizedDataset = Dataset.extend("TokenizedDataset", ("tokens", _INTS), ("mask", _INTS))
TokenizedClassificationDataset = TokenizedDataset.extend("TokenizedClassificationDataset", ("label", _INTEGER))
SourceDataset = Dataset.extend("SourceDataset", ("source", _STRING))
SummarizedMixin = Schema("SummarizedMixin", (("summary", _STRING),))
SummarizedSourceDataset = SourceDataset.extend("SummarizedSourceDataset", SummarizedMixin)
BinaryDataset = Dataset.extend("BinaryDataset", ("binary", _BINARY))
BinaryDatasetWithSource = BinaryDataset.extend("BinaryDatasetWithSource", SourceDataset)
FunctionDataset = Dataset.extend("FunctionDataset", ("name", _STRING))
FunctionDatasetWithSource = FunctionDataset.extend("FunctionDatasetWithSource", SourceDataset)
DisassembledFunctionDataset = FunctionDataset.extend("DisassembledFunctionDataset", ("disassembly", _STRING))
DisassembledFunctionDatasetWithSource = DisassembledFunctionDataset.extend("DisassembledFunctionDatasetWithSource", SourceDataset)
SummarizedDisassembledFunctionDatasetWithSource = DisassembledFunctionDatasetWithSource.extend(
    "SummarizedDisassembledFunctionDatasetWithSource", SummarizedMixin
)
VulnerabilityMixin = Schema("VulnerabilityMixin", (("vulnerability", _STRING),))
VulnerabilityDisassembledFunctionDatasetWithSource = DisassembledFunctionDatasetWithSource.extend(
    "VulnerabilityDisassembledFunctionDatasetWithSource", VulnerabilityMixin
)


def _fits(found: T.DataType, wanted: T.DataType) -> bool:
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(wanted, T.LongType):
        return isinstance(found, whole)
    if isinstance(wanted, T.ArrayType):
        return isinstance(found, T.ArrayType) and _fits(found.elementType, wanted.elementType)
    return type(found) is type(wanted)


def validate(df: DataFrame, schema: Schema, nulls: bool = False) -> DataFrame:
    """``df`` itself if it has the schema's columns, else a :class:`SchemaError`.

    Names and types are checked on the plan, without a job. With ``nulls``, a row with a null in a
    required column also raises, when it is computed.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    for name, kind in schema.columns:
        if name not in found:
            raise SchemaError(f"{schema.name} requires column {name!r}")
        if not _fits(found[name], kind):
            raise SchemaError(f"{schema.name} requires {kind.simpleString()} for {name!r}, not {found[name].simpleString()}")
    if nulls:
        for name, _ in schema.columns:
            error = F.raise_error(F.lit(f"{schema.name} allows no null in {name!r}"))
            df = df.withColumn(name, F.coalesce(F.col(name), error.cast(found[name])))
    return df


def require(df: DataFrame, columns: list[str] | tuple[str, ...]) -> None:
    """Raise a :class:`SchemaError` unless ``df`` has all ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
