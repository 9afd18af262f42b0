"""Element types: Spark has no complex type, so complex elements are structs of re and im."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = {"float32": "float", "float64": "double", "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>"}
REAL = {"float32": "float32", "float64": "float64", "complex64": "float32", "complex128": "float64"}


def dtype_of(kind: T.DataType) -> str:
    """The numpy name of a cell type; TypeError for any other (whole numbers are to be cast by the caller)."""
    for name, text in NAMES.items():
        if kind.simpleString() == text:
            return name
    raise TypeError(f"unsupported element type {kind.simpleString()}; cast to one of {', '.join(NAMES.values())}")


def is_complex(dtype: str) -> bool:
    return dtype.startswith("complex")


def parts(v: Column, dtype: str) -> tuple[Column, Column]:
    return (v["re"], v["im"]) if is_complex(dtype) else (v, F.lit(0.0))


def make(re: Column, im: Column, dtype: str) -> Column:
    real = NAMES[REAL[dtype]]
    return F.struct(re.cast(real).alias("re"), im.cast(real).alias("im")) if is_complex(dtype) else re.cast(real)


def conjugate(v: Column, dtype: str) -> Column:
    return make(v["re"], -v["im"], dtype) if is_complex(dtype) else v


def numpy_dtype(dtype: str) -> np.dtype:
    return np.dtype(dtype).newbyteorder("<")
