"""python -m timberline COMMAND: the pipeline and its single steps from a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.config import PRESETS, LogConfig, preset
from timberline.plans import batch, pipeline, tools
from timberline.plans.model import Model
from timberline.sources.lines import read_lines, read_segments, read_text_lines

COMMANDS = {
    "train": "learn headers, templates and rules from a log",
    "compress": "encode a log with a model",
    "restore": "write the files of an encoded log again",
    "parse": "a log as a table",
    "sample": "write sampled blocks of a log",
    "rules": "numeric rules of a CSV table of parameters",
    "entropy": "entropies of a CSV table's columns and their differences",
    "delta": "a CSV table with the up and down differences of a column",
    "encode": "files of one integer a line as an encoded column",
    "decode": "the inverse of encode",
    "batch": "train, compress and restore several types of logs, with a log and a summary",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="timberline", epilog="; ".join(f"{k}: {v}" for k, v in COMMANDS.items()))
    p.add_argument("command", choices=list(COMMANDS))
    p.add_argument("-I", "--input", required=True, help="log file or folder; for restore, the encoded table; for batch, a folder with one for each type")
    p.add_argument("-T", "--model", help="folder of the model")
    p.add_argument("-O", "--output", help="folder for the result")
    p.add_argument("-TL", "--level", choices=["0", "N"], default="0", help="N: search for numeric rules")
    p.add_argument("-D", "--delta", choices=["D", "ND"], default="D", help="deltas of header numbers")
    p.add_argument("-E", "--codec", choices=["Z", "NE", "P"], default="Z")
    p.add_argument("-B", "--block", type=int, default=LogConfig.block_lines, help="lines in a block")
    p.add_argument("-m", "--mode", choices=["Tot", "Seg", "Nor", "Sam"], default="Tot", help="Seg: the input is blocks already; Nor: train on all lines and not on a sample")
    p.add_argument("-R", "--rate", type=float, default=LogConfig.sample_rate, help="share of the blocks that are sampled")
    p.add_argument("-L", "--head", type=int, default=LogConfig.head_slots, help="header columns")
    p.add_argument("-Tp", "--type", help="a known kind of log, instead of -L and --boundary; for batch, several with commas")
    p.add_argument("-X", "--first", type=int, help="first block")
    p.add_argument("-Y", "--last", type=int, help="last block")
    p.add_argument("-s", "--similarity", type=float, default=LogConfig.similarity)
    p.add_argument("--boundary", help="full-match pattern of a record's first token, for multi-line records")
    p.add_argument("--search", action="store_true", help="the boundary may be found anywhere in the first token")
    p.add_argument("--miner", choices=["tree", "mask"], default="tree")
    p.add_argument("--archive", action="store_true", help="LZMA for each payload")
    p.add_argument("--utf8", action="store_true", help="read lines as UTF-8 and not byte by byte")
    p.add_argument("--log", help="table that batch appends its log to")
    p.add_argument("--column", help="for delta, the column")
    p.add_argument("--order", help="for rules and delta, the column that orders rows")
    p.add_argument("--ident", help="for delta, the column of identifiers")
    return p


def config_of(a: argparse.Namespace, kind: str | None) -> LogConfig:
    changes = {"level": a.level, "delta": a.delta == "D", "codec": a.codec, "block_lines": a.block, "sample_rate": a.rate, "similarity": a.similarity, "search": a.search}
    if kind and kind not in PRESETS:
        raise SystemExit(f"unknown kind of log: {kind}; known are {', '.join(sorted(PRESETS))}")
    return preset(kind, **changes) if kind else LogConfig(head_slots=a.head, boundary=a.boundary, **changes)


def need(a: argparse.Namespace, *names: str) -> None:
    missing = [f"--{n}" for n in names if getattr(a, n) is None]
    if missing:
        raise SystemExit(f"{a.command} needs {', '.join(missing)}")


def save(df: DataFrame, path: str | None) -> None:
    if path:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        df.show(1_000, truncate=False)


def on_table(a: argparse.Namespace, spark: SparkSession) -> None:
    table = spark.read.csv(a.input, header=True)
    if a.command == "entropy":
        return save(tools.column_entropies(table, table.columns).orderBy("entropy", "candidate"), a.output)
    if not a.order:  # rows as they come
        a.order = "row number"
        table = table.withColumn(a.order, F.monotonically_increasing_id())
    if a.command == "delta":
        need(a, "column")
        made = tools.with_deltas(table.withColumn(a.order, F.col(a.order).cast("bigint")), a.column, a.order, a.ident)
        return save(made.drop("row number"), a.output)
    found = pipeline.rules_of_table(table.withColumn(a.order, F.col(a.order).cast("bigint")), a.order, config_of(a, None))
    return save(spark.createDataFrame(list(found.items()), "new string, rule string"), a.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("timberline").getOrCreate()
    if a.command in ("rules", "entropy", "delta"):
        return on_table(a, spark)
    if a.command == "batch":
        need(a, "model", "output", "type")
        made = batch.run(spark, a.type.split(","), ["train", "compress", "restore"], lambda kind: config_of(a, kind), a.input, a.model, f"{a.output}/encoded", f"{a.output}/restored", a.log, a.archive)
        return batch.summary(made).orderBy(F.col("type").asc_nulls_last()).show(1_000, truncate=False)
    config = config_of(a, a.type)
    blocks = F.col("block_id").between(a.first, a.last) if a.first is not None and a.last is not None else F.lit(True)
    if a.command == "decode":
        need(a, "output")
        return pipeline.write_log(tools.decode_columns(spark.read.parquet(a.input), config.block_lines), a.output).show(1_000, truncate=False)
    if a.command == "restore":
        need(a, "model", "output")
        lines = pipeline.restore(spark.read.parquet(a.input).where(blocks), Model.load(spark, a.model), config)
        return pipeline.write_log(lines, a.output, "UTF-8" if a.utf8 else "ISO-8859-1").show(1_000, truncate=False)
    lines = read_segments(spark, a.input) if a.mode == "Seg" else read_text_lines(spark, a.input) if a.utf8 else read_lines(spark, a.input)
    if a.command == "sample":
        need(a, "output")
        return pipeline.write_log(tools.sample_lines(lines, config), a.output).show(1_000, truncate=False)
    if a.command == "encode":
        return save(tools.encode_columns(lines, config.codec, config.block_lines), a.output)
    lines = pipeline.as_blocks(lines, config).where(blocks)
    need(a, "model")
    if a.command == "train":
        return pipeline.train(lines, config, a.miner, sample=a.mode != "Nor").save(spark, a.model)
    model = Model.load(spark, a.model)
    return save(pipeline.parse(lines, model, config) if a.command == "parse" else pipeline.compress(lines, model, config, a.archive), a.output)


if __name__ == "__main__":
    main()
