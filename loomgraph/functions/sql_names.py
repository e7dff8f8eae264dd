"""The vector functions under names of their own in SQL text, as SQL functions that the optimizer inlines.

Vectors are ARRAY<DOUBLE>; bytes and bits packed in bytes (the first element in the lowest bit) are
ARRAY<INT>. Vectors of different lengths are an error.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

V, I = "ARRAY<DOUBLE>", "ARRAY<INT>"
SAME = "if(size(a) <> size(b), raise_error(concat('vectors of different dimensions: ', size(a), ' and ', size(b))), {0})"
TOTAL = "aggregate({0}, 0D, (s, x) -> s + x)"
PAIRED = "zip_with(a, b, (x, y) -> {0})"
NORM = "sqrt(aggregate(transform({0}, x -> x * x), 0D, (s, x) -> s + x))"
#: name: (parameters, result, body).
FUNCTIONS = {
    "vec_length": (f"v {V}", "INT", "size(v)"),
    "vec_f32": ("text STRING", V, "from_json(text, 'array<double>')"),
    "vec_int8": ("text STRING", I, "from_json(text, 'array<int>')"),
    "vec_to_json": (f"v {V}", "STRING", "concat('[', array_join(transform(v, x -> if(isnan(x), 'null', format_string('%.6f', x))), ','), ']')"),
    "vec_distance_l2": (f"a {V}, b {V}", "DOUBLE", SAME.format(f"sqrt({TOTAL.format(PAIRED.format('(x - y) * (x - y)'))})")),
    "vec_distance_l1": (f"a {V}, b {V}", "DOUBLE", SAME.format(TOTAL.format(PAIRED.format("abs(x - y)")))),
    "vec_distance_cosine": (f"a {V}, b {V}", "DOUBLE", SAME.format(f"1 - try_divide({TOTAL.format(PAIRED.format('x * y'))}, {NORM.format('a')} * {NORM.format('b')})")),
    "vec_distance_hamming": (f"a {I}, b {I}", "INT", SAME.format("aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")),
    "vec_add": (f"a {V}, b {V}", V, SAME.format(PAIRED.format("x + y"))),
    "vec_sub": (f"a {V}, b {V}", V, SAME.format(PAIRED.format("x - y"))),
    "vec_slice": (f"v {V}, first INT, last INT", V, "if(first < 0 OR last <= first OR last > size(v), raise_error(concat('no elements from ', first, ' to ', last)), slice(v, first + 1, last - first))"),
    # the norm is computed once, as the element of an array
    "vec_normalize": (f"v {V}", V, f"transform(array({NORM.format('v')}), n -> transform(v, x -> if(n > 0, x / n, double('NaN'))))[0]"),
    "vec_quantize_int8": (f"v {V}", I, "transform(v, x -> int((x + 1) / (2D / 255) - 128))"),
    "vec_quantize_binary": (f"v {V}", I, "if(size(v) = 0 OR size(v) % 8 <> 0, raise_error('the dimension is no multiple of 8'), transform(sequence(0, size(v) - 8, 8), k -> aggregate(reverse(slice(v, k + 1, 8)), 0, (s, x) -> s * 2 + if(x > 0, 1, 0))))"),
}
#: Table functions: a row per element; of packed bits the highest bit of each byte comes first.
TABLES = {
    "vec_each": (f"v {V}", "SELECT pos, col FROM posexplode(v)", "DOUBLE"),
    "vec_each_bit": (f"v {I}", "SELECT pos * 8 + bit, getbit(col, 7 - bit) FROM posexplode(v) LATERAL VIEW explode(sequence(0, 7)) AS bit", "INT"),
}


def register(spark: SparkSession) -> list[str]:
    """Defines all functions in the session; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, body, kind) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE(rowid INT, value {kind}) RETURN {body}")
    return [*FUNCTIONS, *TABLES]
