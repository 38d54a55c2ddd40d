"""Row types the sources yield."""

from pyspark.sql import types as T


def _fields(spec):
    return T.StructType([T.StructField(n, t) for n, t in spec])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
_AS = T.ArrayType(_S)

CELL = _fields([("cell_type", _S), ("source", _AS), ("raw", _S)])  # raw: the cell as JSON

FILE = _fields([
    ("filename", _S), ("path", _S), ("content", _S), ("lines", _AS),
    ("line_count", _I), ("code_line_count", _I), ("file_type", _S),
])

NOTEBOOK = _fields([
    ("filename", _S), ("path", _S), ("content", _S), ("cells", T.ArrayType(CELL)),
    ("metadata", T.MapType(_S, _S)), ("cell_count", _I), ("code_cell_count", _I), ("file_type", _S),
])

# Position of a log line: file, start of the split it was read from, and a
# number that grows within the split.
SEQ = _fields([("source", _S), ("block", _L), ("row", _L)])

FINDING = _fields([
    ("seq", SEQ), ("file_path", _S), ("line_number", _I), ("column_number", _I),
    ("issue_type", _S), ("severity", _S), ("message", _S), ("code_snippet", _S),
    ("suggested_fix", _S), ("category", _S), ("tag", _S),
])
