"""Element types of tensors: label, storage in numpy, and type of a cell in Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T


@dataclass(frozen=True)
class ElementType:
    label: str
    numpy: str | None  # big-endian storage, or None for text and opaque bytes
    spark: T.DataType


#: Fixed values of the format. Unsigned types take the next wider Spark type; 64 bits need a decimal.
ELEMENT_TYPES = {
    t.label: t
    for t in (
        ElementType("uint8", ">u1", T.ShortType()),
        ElementType("uint16", ">u2", T.IntegerType()),
        ElementType("uint32", ">u4", T.LongType()),
        ElementType("uint64", ">u8", T.DecimalType(20, 0)),
        ElementType("int8", ">i1", T.ByteType()),
        ElementType("int16", ">i2", T.ShortType()),
        ElementType("int32", ">i4", T.IntegerType()),
        ElementType("int64", ">i8", T.LongType()),
        ElementType("float32", ">f4", T.FloatType()),
        ElementType("float64", ">f8", T.DoubleType()),
        ElementType("string", None, T.StringType()),
        ElementType("object", None, T.BinaryType()),
    )
}


def element_type(label: str) -> ElementType | None:
    """The type of a label, or None for an unknown one."""
    return ELEMENT_TYPES.get(label)


def dtype(label: str, little: bool = False) -> np.dtype:
    t = ELEMENT_TYPES[label]
    if t.numpy is None:
        raise ValueError(f"{label} has no numeric storage")
    d = np.dtype(t.numpy)
    return d.newbyteorder("<") if little else d
