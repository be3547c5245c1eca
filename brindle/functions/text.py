"""Between text and values: how values are written to text files, and how bytes are decoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

#: Up to here a double that is a whole number is written without a fraction or an exponent.
_WHOLE = float(1 << 53)
#: Encodings by name, lower case, and the charset that Spark decodes them by; hex and base64 have no charset.
CHARSETS = {"utf8": None, "utf-8": None, "latin1": "ISO-8859-1", "binary": "ISO-8859-1", "utf16le": "UTF-16LE", "utf-16le": "UTF-16LE", "ucs2": "UTF-16LE", "hex": None, "base64": None}


def as_text(c: Column, kind: DataType) -> Column:
    """A value as a line: null is empty, whole doubles have no fraction, arrays and structs are comma-joined."""
    if isinstance(kind, (DoubleType, FloatType)):
        d = c.cast("double")
        out = F.when(F.isnan(d), "NaN").when((F.abs(d) < _WHOLE) & (d == F.floor(d)), F.when(F.abs(d) < _WHOLE, d).cast("bigint").cast("string")).otherwise(d.cast("string"))
    elif isinstance(kind, ArrayType):
        out = F.array_join(F.transform(c, lambda x: as_text(x, kind.elementType)), ",")
    elif isinstance(kind, StructType):
        out = F.when(c.isNotNull(), F.concat_ws(",", *[as_text(c.getField(f.name), f.dataType) for f in kind.fields]))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def decoded(content: Column, encoding: str = "utf8") -> Column:
    """Bytes as text; malformed UTF-8 becomes U+FFFD."""
    name = encoding.lower()
    if name not in CHARSETS:
        raise ValueError(f"unknown encoding {encoding}; known are {', '.join(CHARSETS)}")
    if name == "hex":
        return F.lower(F.hex(content))
    if name == "base64":
        return F.base64(content)
    return F.decode(content, CHARSETS[name]) if CHARSETS[name] else F.make_valid_utf8(content.cast("string"))


def lines_of(text: Column) -> Column:
    """A text's lines: it is split at \\n alone, and one empty line at its end is dropped. An empty text has none."""
    return F.when(text != "", F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)).otherwise(F.array().cast("array<string>"))
