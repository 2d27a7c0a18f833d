"""Functions of the file format over columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model.calc import function
from ..model.document import Pdf
from ..model.objects import PdfError, Stream
from ..runtime import ship


class _Plain:
    """Resolves nothing: a function given as objects without references."""

    def get(self, o):
        return o

    def dict(self, o):
        return o if isinstance(o, dict) else o.dict if isinstance(o, Stream) else {}

    def list(self, o):
        return o if isinstance(o, list) else []


def evaluated(df: DataFrame, spec: dict, inputs: list[str], out_col: str = "result", data: bytes | None = None) -> DataFrame:
    """df with the results (array of doubles) of a function of type 0, 2, 3 or 4 at its input columns.

    spec is the function's dictionary, data its stream's bytes where it has one. Null inputs, and inputs where the function
    fails, give null; a function that can't be read is an error at once."""
    ship(df.sparkSession)
    whole = spec if data is None else Stream(spec, data)
    function(_Plain(), whole)
    names, at = df.columns, len(df.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = function(_Plain(), whole)
        for b in batches:
            out = []
            for v in zip(*(b.column(at + k).to_pylist() for k in range(len(inputs)))):
                try:
                    out.append(f(list(v)) if None not in v else None)
                except (PdfError, ValueError, OverflowError, TypeError, IndexError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.list_(pa.float64()))], names=[*names, out_col])

    asked = df.select("*", *[F.col(c).cast("double").alias(f"_input_{k}") for k, c in enumerate(inputs)])
    return asked.mapInArrow(run, f"{schema}, `{out_col}` array<double>")


def function_values(files: DataFrame, object_col: str, input_col: str) -> DataFrame:
    """(doc_id, result, error): each file's function object at an array of inputs; no file fails the job."""
    ship(files.sparkSession)
    own = files.select(F.col("doc_id").cast("long"), F.col("content"), F.col(object_col).cast("int"), F.col(input_col).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..model.objects import Ref

        for b in batches:
            out, errors = [], []
            for data, num, v in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                try:
                    out.append(function(Pdf(data or b""), Ref(num, 0))(v or []))
                    errors.append(None)
                except (PdfError, ValueError, OverflowError, TypeError, IndexError, KeyError, AttributeError) as e:
                    out.append(None), errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["doc_id", "result", "error"])

    return own.mapInArrow(run, "doc_id long, result array<double>, error string")
