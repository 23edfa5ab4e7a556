"""Single steps on plain tables and files: samples, integer codecs, deltas, entropies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.config import LogConfig
from timberline.operators import codec, deltas, rules
from timberline.sources.lines import sample_blocks, with_blocks


def sample_lines(lines: DataFrame, config: LogConfig) -> DataFrame:
    """The lines of sampled blocks, as a log that can be written: every file ends in a line feed."""
    return sample_blocks(lines, config).select("file", "line_no", "line", F.lit(True).alias("final_newline"))


def encode_columns(lines: DataFrame, kind: str, block_lines: int) -> DataFrame:
    """Files of one integer a line -> (file, block_id, codec, n, payload)."""

    def encode(block: pd.DataFrame) -> pd.DataFrame:
        values = np.array([int(x) for x in block.sort_values("line_no")["line"]], dtype=np.int64)
        return pd.DataFrame({"file": [block["file"].iloc[0]], "block_id": [block["block_id"].iloc[0]], "codec": [kind], "n": [len(values)], "payload": [codec.encode_ints(values, kind, False)]})

    return with_blocks(lines, block_lines).groupBy("file", "block_id").applyInPandas(encode, "file string, block_id long, codec string, n long, payload binary")


def decode_columns(encoded: DataFrame, block_lines: int) -> DataFrame:
    """The inverse of encode_columns: (file, line_no, line, final_newline)."""

    def decode(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                values = codec.decode_ints(bytes(r.payload), r.codec, False)
                yield pd.DataFrame({"file": r.file, "line_no": r.block_id * block_lines + np.arange(len(values)), "line": [str(v) for v in values.tolist()], "final_newline": True})

    return encoded.mapInPandas(decode, "file string, line_no long, line string, final_newline boolean")


def with_deltas(table: DataFrame, column: str, order: str, ident: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """table with `up` and `do` of an integer column: differences to the next and the previous row, of the same id if one is given."""
    own = [*(keys or []), *([ident] if ident else [])]
    typed = table.withColumn(column, F.col(column).cast("bigint"))
    return typed.withColumns({"up": deltas.forward(column, own, [order]), "do": deltas.backward(column, own, [order])})


def column_entropies(table: DataFrame, columns: list[str]) -> DataFrame:
    """(candidate, n, entropy) of the columns, of their differences, and of one less two others."""
    forms = [rules.Form(str(i)) for i in range(len(columns))]
    candidates = [(f,) for f in forms] + rules.pairs(forms) + rules.triples(forms)
    found = rules.entropies_of(table, F.array(*[F.col(c).cast("bigint") for c in columns]), [tuple(int(f.base) for f in c) for c in candidates])
    names = [" - ".join(columns[int(f.base)] for f in c) for c in candidates]
    return found.select(F.get(F.from_json(F.lit(rules.json.dumps(names)), "array<string>"), F.col("candidate")).alias("candidate"), "n", "entropy")
