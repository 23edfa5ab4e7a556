"""SQL functions of the engine, for use in spark.sql: expressions, no Python at run time, and one table function in Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

FUNCTIONS = {
    "log_tokens": ("content STRING", "ARRAY<STRING>", r"regexp_extract_all(content, '[^ \\t:=,\\n]+|[ \\t:=,\\n]', 0)"),
    "log_mask": ("toks ARRAY<STRING>", "ARRAY<STRING>", r"transform(toks, t -> CASE WHEN t RLIKE '^[0-9]+$' OR t RLIKE '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+' THEN '<*>' ELSE t END)"),
    "zigzag": ("n BIGINT", "BIGINT", "shiftleft(n, 1) ^ shiftright(n, 63)"),
    "unzigzag": ("z BIGINT", "BIGINT", "shiftrightunsigned(z, 1) ^ -(z & 1L)"),
    "varint_len": ("z BIGINT", "INT", "CASE " + " ".join(f"WHEN z < {1 << 7 * k}L THEN {k}" for k in range(1, 9)) + " ELSE 9 END"),
}


class LogRecords:
    """log_records(path): the lines of one file, read byte by byte as they stream by.

    For SQL over a table of paths, `FROM files, LATERAL log_records(files.path)`: a file a row, files side by side. A large file
    is better read by `sources.lines.read_lines`, in ranges. path is anything that pyarrow.fs opens on the executors.
    """

    def eval(self, path: str) -> Iterator[tuple[int, str]]:
        import os
        import re

        from pyarrow import fs

        if path is None:
            return
        files, name = fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), os.path.abspath(path))
        with files.open_input_stream(name) as stream:
            n, rest = 0, b""
            while chunk := stream.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                for line in whole:
                    yield n, line.decode("latin-1")
                    n += 1
            if rest:
                yield n, rest.decode("latin-1")


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions in the session; their names."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("log_records", udtf(LogRecords, returnType="line_no long, line string"))
    return [*FUNCTIONS, "log_records"]
