"""The 32 attribute types, their Spark types, and literals of them."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import types as T

from .errors import BadValue

#: Type codes in the order of their numbers.
CODES = (
    "DT_UNKNOWN", "DT_STRING", "DT_SHORT", "DT_FLOAT", "DT_BOOLEAN", "DT_BYTE", "DT_LONG", "DT_DOUBLE",
    "DT_LONGLONG", "DT_ID", "DT_DATE", "DT_BYTESTR", "DT_BLOB", "DT_COMPLEX", "DT_DCOMPLEX", "DS_STRING",
    "DS_SHORT", "DS_FLOAT", "DS_BOOLEAN", "DS_BYTE", "DS_LONG", "DS_DOUBLE", "DS_LONGLONG", "DS_COMPLEX",
    "DS_DCOMPLEX", "DS_ID", "DS_DATE", "DS_BYTESTR", "DT_EXTERNALREFERENCE", "DS_EXTERNALREFERENCE", "DT_ENUM", "DS_ENUM",
)
NUMBER = {name: number for number, name in enumerate(CODES)}

#: A value whose type each row says by itself: exactly one of the arrays is not null.
UNKNOWN = T.StructType([
    T.StructField("datatype", T.StringType()),
    T.StructField("dbl", T.ArrayType(T.DoubleType())),
    T.StructField("lng", T.ArrayType(T.LongType())),
    T.StructField("str", T.ArrayType(T.StringType())),
    T.StructField("ts", T.ArrayType(T.TimestampNTZType())),
    T.StructField("bool", T.ArrayType(T.BooleanType())),
    T.StructField("bin", T.ArrayType(T.BinaryType())),
])
#: The array of UNKNOWN that holds values of a scalar type.
ARM = {
    "DT_STRING": "str", "DT_SHORT": "lng", "DT_FLOAT": "dbl", "DT_BOOLEAN": "bool", "DT_BYTE": "lng", "DT_LONG": "lng", "DT_DOUBLE": "dbl",
    "DT_LONGLONG": "lng", "DT_ID": "lng", "DT_DATE": "ts", "DT_BYTESTR": "bin", "DT_COMPLEX": "dbl", "DT_DCOMPLEX": "dbl",
    "DT_ENUM": "lng", "DT_EXTERNALREFERENCE": "str",
}


def _complex(part: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("r", part), T.StructField("i", part)])


SCALARS: dict[str, T.DataType] = {
    "DT_STRING": T.StringType(),
    "DT_SHORT": T.ShortType(),
    "DT_FLOAT": T.FloatType(),
    "DT_BOOLEAN": T.BooleanType(),
    "DT_BYTE": T.ShortType(),  # an octet is unsigned
    "DT_LONG": T.IntegerType(),
    "DT_DOUBLE": T.DoubleType(),
    "DT_LONGLONG": T.LongType(),
    "DT_ID": T.LongType(),
    "DT_DATE": T.TimestampNTZType(),
    "DT_BYTESTR": T.BinaryType(),
    "DT_BLOB": T.StructType([T.StructField("header", T.StringType()), T.StructField("content", T.BinaryType())]),
    "DT_COMPLEX": _complex(T.FloatType()),
    "DT_DCOMPLEX": _complex(T.DoubleType()),
    "DT_EXTERNALREFERENCE": T.StructType([T.StructField(n, T.StringType()) for n in ("description", "mimeType", "location")]),
    "DT_ENUM": T.IntegerType(),
}
INTEGERS = {"DT_SHORT": 16, "DT_BYTE": 9, "DT_LONG": 32, "DT_LONGLONG": 64, "DT_ID": 64, "DT_ENUM": 32}


def is_sequence(code: str) -> bool:
    return code.startswith("DS_")


def scalar_of(code: str) -> str:
    return "DT_" + code[3:] if is_sequence(code) else code


def sequence_of(code: str) -> str:
    return "DS_" + code[3:]


def is_string(code: str) -> bool:
    return scalar_of(code) == "DT_STRING"


def spark_type(code: str) -> T.DataType:
    if code == "DT_UNKNOWN":
        return UNKNOWN
    scalar = SCALARS[scalar_of(code)]
    return T.ArrayType(scalar) if is_sequence(code) else scalar


#: Spark types of files to type codes, where the model does not say one.
INFERRED = {"string": "DT_STRING", "smallint": "DT_SHORT", "tinyint": "DT_SHORT", "float": "DT_FLOAT", "boolean": "DT_BOOLEAN", "int": "DT_LONG", "double": "DT_DOUBLE", "bigint": "DT_LONGLONG", "timestamp": "DT_DATE", "timestamp_ntz": "DT_DATE", "binary": "DT_BYTESTR"}


def code_of(spark: T.DataType) -> str:
    if isinstance(spark, T.ArrayType):
        return sequence_of(code_of(spark.elementType))
    return INFERRED.get(spark.simpleString(), "DT_UNKNOWN")


COMPACT = re.compile(r"(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{1,6})?\d*")


def parse_date(text: str) -> datetime.datetime | None:
    """A compact date (YYYYMMDDhhmmss and a fraction, or the front of it) or an ISO one, in UTC; None if it is neither."""
    text = text.strip()
    if not text:
        return None
    if m := COMPACT.fullmatch(text):
        year, month, day, hour, minute, second, part = m.groups()
        try:
            return datetime.datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), int((part or "0").ljust(6, "0")))
        except ValueError:
            return None
    try:
        value = datetime.datetime.fromisoformat(text.replace("Z", "+00:00") if text.endswith("Z") else text)
    except ValueError:
        return None
    return value.astimezone(datetime.UTC).replace(tzinfo=None) if value.tzinfo else value


def coerce(code: str, value):
    """value as a literal of a scalar type; numbers may be written as strings."""
    code = scalar_of(code)
    try:
        if code == "DT_STRING":
            if isinstance(value, (dict, list)):
                raise BadValue(f"{value!r} is no string")
            return str(value)
        if code in INTEGERS:
            if isinstance(value, float) and not value.is_integer():
                raise BadValue(f"{value!r} is no integer")
            out = int(value)
            if not -(1 << (INTEGERS[code] - 1)) <= out < 1 << (INTEGERS[code] - 1):
                raise BadValue(f"{value!r} is out of the range of {code}")
            return out
        if code in ("DT_FLOAT", "DT_DOUBLE"):
            return float(value)
        if code == "DT_BOOLEAN":
            if isinstance(value, str):
                if value.lower() not in ("true", "false", "1", "0"):
                    raise BadValue(f"{value!r} is no boolean")
                return value.lower() in ("true", "1")
            return bool(value)
        if code == "DT_DATE":
            out = value if isinstance(value, datetime.datetime) else parse_date(str(value))
            if out is None:
                raise BadValue(f"{value!r} is no date")
            return out
        if code == "DT_BYTESTR":
            return value if isinstance(value, (bytes, bytearray)) else str(value).encode()
        if code in ("DT_COMPLEX", "DT_DCOMPLEX"):
            r, i = value
            return {"r": float(r), "i": float(i)}
        if code == "DT_EXTERNALREFERENCE":
            description, mime, location = value
            return {"description": description, "mimeType": mime, "location": location}
    except (TypeError, ValueError) as e:
        raise e if isinstance(e, BadValue) else BadValue(f"{value!r} is no {code}") from e
    raise BadValue(f"no literal can be compared with {code}")


def coerce_list(code: str, values: list) -> list:
    """A list as literals. Complex numbers are pairs, external references triples; both may come flat."""
    width = {"DT_COMPLEX": 2, "DT_DCOMPLEX": 2, "DT_EXTERNALREFERENCE": 3}.get(scalar_of(code), 1)
    if width > 1 and values and not isinstance(values[0], (list, tuple)):
        if len(values) % width:
            raise BadValue(f"{code} takes values in groups of {width}")
        values = [values[k : k + width] for k in range(0, len(values), width)]
    return [coerce(code, v) for v in values]
