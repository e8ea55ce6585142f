"""ARFF relations: a header of typed attributes, dense or sparse rows, ? for missing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.text_tables import placed_lines

_NUMBERS = ("numeric", "real", "integer")
_PARTS = re.compile(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|(\{[^}]*\})|(\S+)""")
_DEFAULT_DATE = "yyyy-MM-dd'T'HH:mm:ss"


def _words(line: str) -> list[str]:
    return [next((g for g in m.groups() if g is not None), "") for m in _PARTS.finditer(line)]


def parse_header(lines: list[str]) -> tuple[str, list[dict]]:
    """(relation name, attributes with name, kind, levels, format and, if relational, attributes)."""
    name, stack = "", [[]]
    for line in lines:
        words = _words(line.strip())
        if not words:
            continue
        tag = words[0].lower()
        if tag == "@relation":
            name = words[1] if len(words) > 1 else ""
        elif tag == "@attribute":
            kind = words[2].lower()
            if kind.startswith("{"):
                levels = [w.strip().strip("'\"") for w in words[2].strip("{}").split(",")]
                stack[-1].append({"name": words[1], "kind": "nominal", "levels": levels})
            elif kind == "relational":
                inner: list[dict] = []
                stack[-1].append({"name": words[1], "kind": "relational", "attributes": inner})
                stack.append(inner)
            elif kind == "date":
                stack[-1].append({"name": words[1], "kind": "date", "format": words[3] if len(words) > 3 else _DEFAULT_DATE})
            else:
                stack[-1].append({"name": words[1], "kind": "number" if kind in _NUMBERS else "string"})
        elif tag == "@end" and len(stack) > 1:
            stack.pop()
    return name, stack[0]


def _type(a: dict) -> T.DataType:
    if a["kind"] == "number":
        return T.DoubleType()
    if a["kind"] == "date":
        return T.TimestampType()
    if a["kind"] == "relational":
        return T.ArrayType(T.StructType([T.StructField(x["name"], _type(x)) for x in a["attributes"]]))
    return T.StringType()


def schema(attributes: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(a["name"], _type(a), metadata={"levels": a["levels"]} if a["kind"] == "nominal" else {}) for a in attributes])


def _value(raw: Column, a: dict) -> Column:
    raw = F.when(raw != "?", raw)
    if a["kind"] == "number":
        return raw.try_cast("double")
    if a["kind"] == "date":
        return F.try_to_timestamp(raw, F.lit(a["format"]))
    if a["kind"] == "relational":
        inner = a["attributes"]
        fields = ", ".join(f"`{i}` string" for i in range(len(inner)))
        rows = F.split(raw, "\\\\n|\n")
        return F.transform(rows, lambda r: (lambda s: F.struct(*(_value(s[str(i)], x).alias(x["name"]) for i, x in enumerate(inner))))(F.from_csv(r, fields, {"quote": '"'})))
    return raw


def read_arff(spark: SparkSession, path: str) -> tuple[str, bool, T.StructType, DataFrame]:
    """(relation, sparse, schema, rows). Lines up to the first @data come to the driver; the body stays distributed.

    The header is in one file, other files of a folder hold rows only; what follows @data is a row, whatever it begins with.
    A sparse row lists "position value" pairs (from 0); left-out cells are 0 for numbers, the first level for
    nominals, null otherwise.
    """
    text = placed_lines(spark, path).filter((F.col("line") != "") & ~F.col("line").startswith("%"))
    end = text.filter(F.lower("line") == "@data").orderBy("file", "start", "n").first()
    if end is None:
        raise ValueError(f"{path} has no @data")
    in_head = (F.col("file") == end["file"]) & ((F.col("start") < end["start"]) | (F.col("start") == end["start"]) & (F.col("n") <= end["n"]))
    name, attributes = parse_header([r["line"] for r in text.filter(in_head).orderBy("start", "n").collect()])
    body = text.filter(~in_head)
    sparse = body.filter(F.col("line").startswith("{")).limit(1).count() > 0
    n = len(attributes)
    if sparse:
        # quoted values may hold commas: pairs are matched, not split
        pair = "(\\d+)\\s+('(?:[^'\\\\]|\\\\.)*'|[^,}]+)"
        keys = F.regexp_extract_all("line", F.lit(pair), F.lit(1))
        values = F.transform(F.regexp_extract_all("line", F.lit(pair), F.lit(2)), lambda v: F.regexp_replace(F.trim(v), "^'|'$", ""))
        cells = body.withColumn("m", F.map_from_arrays(keys, values))
        default = lambda a: F.lit(0.0) if a["kind"] == "number" else F.lit(a["levels"][0]) if a["kind"] == "nominal" else F.lit(None).cast(_type(a))
        cols = [F.when(F.col("m")[str(i)].isNull(), default(a)).otherwise(_value(F.col("m")[str(i)], a)).alias(a["name"]) for i, a in enumerate(attributes)]
    else:
        cells = body.withColumn("c", F.from_csv("line", ", ".join(f"`{i}` string" for i in range(n)), {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}))
        cols = [_value(F.col("c")[str(i)], a).alias(a["name"]) for i, a in enumerate(attributes)]
    return name, sparse, schema(attributes), cells.select(*cols)


def _quoted(s: Column) -> Column:
    return F.when(s.rlike("[\\s,{}%'\"?]") | (s == ""), F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(s)


def _name(s: str) -> str:
    return f"'{s}'" if re.search(r"[\s,{}%]", s) else s


def header(df: DataFrame, name: str, comment: str = "") -> list[str]:
    out = [f"% {c}" for c in comment.splitlines()] + [f"@relation {_name(name)}"]
    for f in df.schema:
        levels = f.metadata.get("levels")
        kind = "{" + ",".join(map(_name, levels)) + "}" if levels else "numeric" if isinstance(f.dataType, T.NumericType) else f'date "{_DEFAULT_DATE}"' if isinstance(f.dataType, T.TimestampType) else "string"
        out.append(f"@attribute {_name(f.name)} {kind}")
    return [*out, "@data"]


def write_arff(df: DataFrame, path: str, name: str, sparse: bool = False, comment: str = "") -> None:
    """One text file: the header lines, then a line per row; strings are quoted only where needed."""
    text = lambda f: F.date_format(f.name, _DEFAULT_DATE) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.NumericType) else _quoted(F.col(f"`{f.name}`").cast("string"))
    cells = [F.coalesce(text(f), F.lit("?")) for f in df.schema]
    if sparse:
        drop = [(F.col(f"`{f.name}`") == 0) if isinstance(f.dataType, T.NumericType) else (F.col(f"`{f.name}`") == f.metadata["levels"][0]) if f.metadata.get("levels") else F.lit(False) for f in df.schema]
        row = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(d, F.lit(False)), F.concat_ws(" ", F.lit(str(i)), c)) for i, (c, d) in enumerate(zip(cells, drop))))), ","), F.lit("}"))
    else:
        row = F.concat_ws(",", *cells)
    head = df.sparkSession.createDataFrame([(x,) for x in header(df, name, comment)], "value string").coalesce(1)
    head.write.text(path)
    df.select(row.alias("value")).write.mode("append").text(path)
