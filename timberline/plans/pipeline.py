"""train, parse, compress and restore: each a DataFrame plan over blocks of lines.

A block is the unit of encoding and of memory: at most config.block_lines lines, whole in one task when it is encoded or
restored. Everything before that (framing, header, tokens, match) is expressions and a broadcast join.
"""

from __future__ import annotations

import lzma
import os
import re
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.config import LogConfig
from timberline.operators import codec, framing, header, matching, mining, rules, variables
from timberline.operators import tokens as tk
from timberline.plans.model import Model, is_large, usable
from timberline.sources.lines import sample_blocks, with_blocks

KEYS = ["file", "block_id"]
ENCODED = "file string, block_id long, stream string, codec string, n long, payload binary"


def as_blocks(lines: DataFrame, config: LogConfig) -> DataFrame:
    """lines (line_no, line[, file][, final_newline][, block_id]) with all of them."""
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.lit(""))
    if "final_newline" not in lines.columns:
        lines = lines.withColumn("final_newline", F.lit(True))
    return lines if "block_id" in lines.columns else with_blocks(lines, config.block_lines)


def _parsed(records: DataFrame, model_slots: list | None, config: LogConfig) -> DataFrame:
    parsed = header.with_head(records, config.head_slots)
    parsed = parsed.withColumn("status", header.head_status(model_slots if model_slots is not None else [], config))
    return parsed.withColumn("toks", F.when(F.col("status") == "ok", tk.tokens(F.col("head.content"))))


def parse(lines: DataFrame, model: Model, config: LogConfig) -> DataFrame:
    """Records with status, head, toks, eid and vars: the table to query a log by."""
    records = framing.frame(as_blocks(lines, config), KEYS, config)
    return matching.match(_parsed(records, model.slots, config), model.table(lines.sparkSession), config, model.stored is not None)


def train(lines: DataFrame, config: LogConfig, miner: str = "tree", sample: bool = True) -> Model:
    """miner: `tree` (similarity, in record order) or `mask` (grouping of masked tokens).

    Learns from sampled blocks of lines, which bounds what the miner's tasks hold; sample=False learns from all.
    """
    lines = as_blocks(lines, config)
    if sample:
        lines = sample_blocks(lines, config)
    records = framing.frame(lines, KEYS, config).cache()
    slots = header.infer_slots(_parsed(records, None, config), config)
    parsed = _parsed(records, slots, config)
    counted = matching.masked_counts(parsed).persist(StorageLevel.DISK_ONLY) if miner == "mask" else None
    if counted is not None and is_large(counted, "m"):
        model = Model(slots, [], stored=_stored(counted, config))
    else:
        model = Model(slots, usable(mining.tree_templates(parsed, config) if counted is None else matching.listed(counted), config))
    if counted is not None:
        counted.unpersist()
    if config.level == "N" and (model.templates or model.stored is not None):
        model.rules = find_rules(matching.match(parsed, model.table(lines.sparkSession), config, model.stored is not None), config)
    records.unpersist()
    return model


def _stored(counted: DataFrame, config: LogConfig) -> DataFrame:
    """The templates of a model as a table on the executors' disks, which is made anew where an executor is lost."""
    kept = matching.stored_templates(counted, config).persist(StorageLevel.DISK_ONLY)
    gone = counted.count() - kept.count()
    if gone:
        warnings.warn(f"{gone} templates are too long or too many", stacklevel=3)
    return kept


def find_rules(matched: DataFrame, config: LogConfig) -> dict[int, tuple[list[str], list[tuple[str, rules.Candidate]]]]:
    """Rules of the templates with two or more varying numeric columns, from the training records."""
    long = variables.long_form(matched, KEYS)
    placed = variables.roles(variables.profile(long), config.fixed_columns_share).cache()
    ids: dict[int, list[str]] = {}
    for r in variables.identifiers(placed, config.max_ids).orderBy("eid", "nth").collect():
        ids.setdefault(r["eid"], []).append(str(r["pos"]))
    numeric: dict[int, list[str]] = {}
    for r in placed.where("is_op AND kind = 'num'").orderBy("eid", "pos").collect():
        numeric.setdefault(r["eid"], []).append(str(r["pos"]))
    placed.unpersist()
    out = {}
    for eid, columns in numeric.items():
        if not 2 <= len(columns) <= config.max_numeric:
            continue
        own = ids.get(eid, [])
        forms = rules.all_forms(columns, own)
        candidates: list[rules.Candidate] = [(f,) for f in forms] + rules.pairs(forms) + rules.triples(forms)
        rows = matched.where(F.col("eid") == eid).select(*KEYS, "rec_id", *[F.element_at("vars", int(c) + 1).cast("bigint").alias(f"v{c}") for c in columns], *[F.element_at("vars", int(i) + 1).alias(f"v{i}") for i in own])
        for f in forms:
            if f.kind != rules.RAW:
                w = W.partitionBy(*KEYS, *([f"v{f.ident}"] if f.ident else [])).orderBy("rec_id")
                v = F.col(f"v{f.base}")
                rows = rows.withColumn(f"f{f.name}", F.coalesce(v - F.lag(v).over(w), v) if f.kind == rules.DO else F.coalesce(F.lead(v).over(w) - v, v))
        values = F.array(*[F.col(f"v{f.base}" if f.kind == rules.RAW else f"f{f.name}") for f in forms])
        place = {f: i for i, f in enumerate(forms)}
        found = rules.entropies_of(rows, values, [tuple(place[f] for f in c) for c in candidates])
        scores = {candidates[r["candidate"]]: r["entropy"] for r in found.collect()}  # a number a candidate; max_numeric bounds them
        out[eid] = (own, rules.greedy(columns, scores))
    return out


def rules_of_table(table: DataFrame, order: str, config: LogConfig) -> dict[str, str]:
    """Rules for a plain table of parameters (say, a CSV of strings): new column -> its difference of forms, in order."""
    columns = [c for c in table.columns if c != order]
    rows = table.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("block_id"), F.lit(1).alias("eid"), F.col(order).alias("rec_id"), F.array(*[F.col(c).cast("string") for c in columns]).alias("vars"))
    found = find_rules(rows, config).get(1, ([], []))[1]
    name = lambda f: "_".join(x for x in (columns[int(f.base)], f.kind if f.kind != rules.RAW else "", columns[int(f.ident)] if f.ident else "") if x)
    return {columns[int(new)]: " - ".join(map(name, c)) for new, c in found}


def _ints(v: list) -> np.ndarray | None:
    """Values as integers if each prints again as it was."""
    try:
        a = np.array([int(x) for x in v], dtype=np.int64)
    except (ValueError, OverflowError):
        return None
    return a if all(str(n) == x for n, x in zip(a.tolist(), v, strict=True)) and (not len(a) or np.abs(a).max() < 1 << 61) else None


def encode_block(block: pd.DataFrame, model: Model, config: LogConfig) -> Iterator[tuple[str, str, int, bytes]]:
    """Streams of one block: (name, codec, values, payload). Columns are typed per block, so drift costs size and no data."""
    block = block.sort_values("rec_id")
    ints = lambda name, v, delta: (name, config.codec + ("D" if delta else ""), len(v), codec.encode_ints(np.asarray(v, dtype=np.int64), config.codec, delta))
    texts = lambda name, v: (name, "T", len(v), codec.encode_strings(list(v)))
    yield ints("meta", [int(block["first_line"].iloc[0]), int(block["final_newline"].iloc[-1])], False)
    yield ints("eid", block["eid"], False)
    failed = block[block["eid"] <= 0]
    if len(failed):
        yield texts("fail", failed["raw"])
    good = block[block["eid"] > 0]
    if not len(good):
        return
    heads = list(good["values"])
    gaps = [g for row in good["gaps"] for g in row]
    if gaps:
        yield texts("gap", gaps)
    for s, slot in enumerate(model.slots):
        own = [row[s] for row in heads]
        yield from _encode_head(f"h{s}", own, slot, ints, texts, config)
    for eid, rows in good.groupby("eid", sort=True):
        columns = list(zip(*rows["vars"], strict=True))
        typed = {str(p): _ints(c) for p, c in enumerate(columns)}
        ids, steps = model.rules.get(int(eid), ([], []))
        use = len(rows) >= config.rule_rows and steps and all(typed[new] is not None for new, _ in steps)
        if use:
            names = {i: np.unique(np.array(columns[int(i)], dtype=object), return_inverse=True)[1] for i in ids}
            for k, v in enumerate(rules.apply_rules({c: typed[c] for c, _ in steps}, steps, names)):
                yield ints(f"r{eid}.{k}", v, False)
        done = {new for new, _ in steps} if use else set()
        for p, c in enumerate(columns):
            if str(p) in done:
                continue
            yield texts(f"v{eid}.{p}", c) if typed[str(p)] is None else ints(f"v{eid}.{p}", typed[str(p)], False)


def _encode_head(name, own, slot, ints, texts, config):
    if slot.pieces is not None:
        m = [re.match(slot.pattern(), x) for x in own]
        if all(m):
            for j in range(slot.numbers):
                yield ints(f"{name}.{j}", [int(x[j + 1]) for x in m], config.delta)
            return
    yield texts(name, own)


def decode_block(streams: dict[str, tuple[str, bytes]], model: Model, config: LogConfig) -> tuple[int, bool, list[str]]:
    """(first line, final newline, records) of a block."""

    def get(name: str):
        kind, payload = streams[name]
        return codec.decode_strings(payload) if kind == "T" else codec.decode_ints(payload, kind.rstrip("D"), kind.endswith("D"))

    first, newline = get("meta").tolist()
    eids = get("eid").tolist()
    failed = iter(get("fail") if "fail" in streams else [])
    n = sum(e > 0 for e in eids)
    slots = []
    for s, slot in enumerate(model.slots):
        if f"h{s}" in streams:
            slots.append(get(f"h{s}"))
        elif n:
            numbers = [get(f"h{s}.{j}").tolist() for j in range(slot.numbers)]
            slots.append([_print(slot.pieces, x) for x in (zip(*numbers, strict=True) if numbers else [()] * n)])
    gaps = get("gap") if "gap" in streams else []
    per = len(gaps) // n if n else 0
    templates = {t[0]: t[2] for t in model.templates}
    values = {e: _columns(e, templates[e], model, streams, get) for e in set(eids) if e > 0}
    cursor, at, out = dict.fromkeys(values, 0), 0, []
    for e in eids:
        if e <= 0:
            out.append(next(failed))
            continue
        parts = []
        for k in range(per):
            parts.append(gaps[at * per + k])
            if k < len(slots):
                parts.append(slots[k][at])
        own = iter([c[cursor[e]] for c in values[e]])
        parts += [str(next(own)) if t == tk.WILD else t for t in templates[e]]
        out.append("".join(parts))
        cursor[e] += 1
        at += 1
    return first, bool(newline), out


def _print(pieces, numbers) -> str:
    own = iter(numbers)
    return "".join(p if isinstance(p, str) else (str(next(own)).zfill(p) if p else str(next(own))) for p in pieces)


def _columns(eid: int, template: list[str], model: Model, streams: dict, get) -> list:
    n = sum(t == tk.WILD for t in template)
    out: dict[str, list] = {str(p): get(f"v{eid}.{p}") for p in range(n) if f"v{eid}.{p}" in streams}
    if f"r{eid}.0" in streams:
        ids, steps = model.rules[eid]
        names = {i: np.unique(np.array([str(x) for x in out[i]], dtype=object), return_inverse=True)[1] for i in ids}
        out |= rules.solve_rules([get(f"r{eid}.{k}") for k in range(len(steps))], steps, names)
    return [c.tolist() if isinstance(c, np.ndarray) else c for c in (out[str(p)] for p in range(n))]


def compress(lines: DataFrame, model: Model, config: LogConfig, archive: bool = False) -> DataFrame:
    """(file, block_id, stream, codec, n, payload). archive: each payload through LZMA; else leave that to the table's own compression."""
    lines = as_blocks(lines, config)
    parsed = parse(lines, model, config)
    firsts = lines.groupBy(*KEYS).agg(F.min("line_no").alias("first_line"), F.bool_and("final_newline").alias("final_newline"))
    rows = parsed.select(*KEYS, "rec_id", "eid", F.when(F.col("eid") <= 0, F.col("raw")).alias("raw"), F.col("head.values").alias("values"), F.col("head.gaps").alias("gaps"), "vars").join(firsts, KEYS)

    coder = model.coder()

    def encode(block: pd.DataFrame) -> pd.DataFrame:
        file, block_id = block["file"].iloc[0], block["block_id"].iloc[0]
        made = [(file, block_id, *r) for r in encode_block(block, coder, config)]
        out = pd.DataFrame(made, columns=["file", "block_id", "stream", "codec", "n", "payload"])
        if archive:
            out["payload"] = [lzma.compress(p) for p in out["payload"]]
            out["codec"] += "+L"
        return out

    return rows.groupBy(*KEYS).applyInPandas(encode, ENCODED)


def restore(encoded: DataFrame, model: Model, config: LogConfig) -> DataFrame:
    """(file, block_id, line_no, line, final_newline): the lines as they were."""

    coder = model.coder(model.templates)
    plain = lambda r: (r.codec.removesuffix("+L"), lzma.decompress(r.payload) if r.codec.endswith("+L") else bytes(r.payload))

    def decode_with(block: pd.DataFrame, own: Model) -> pd.DataFrame:
        first, newline, records = decode_block({r.stream: plain(r) for r in block.itertuples(index=False)}, own, config)
        text = [line for r in records for line in r.split("\n")]
        return pd.DataFrame({"file": block["file"].iloc[0], "block_id": block["block_id"].iloc[0], "line_no": np.arange(first, first + len(text)), "line": text, "final_newline": newline})

    def decode(block: pd.DataFrame) -> pd.DataFrame:
        return decode_with(block, coder)

    def decode_by(block: pd.DataFrame, used: pd.DataFrame) -> pd.DataFrame:
        return decode_with(block, coder.coder([(int(e), int(e), list(t), 0) for e, t in zip(used["eid"], used["tokens"], strict=True)]))

    def eids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [(r.file, r.block_id, int(e)) for r in batch.itertuples(index=False) for kind, data in [plain(r)] for e in np.unique(codec.decode_ints(data, kind.rstrip("D"), kind.endswith("D"))) if e > 0]
            yield pd.DataFrame(held, columns=["file", "block_id", "eid"])

    restored = "file string, block_id long, line_no long, line string, final_newline boolean"
    if model.stored is None:
        return encoded.groupBy(*KEYS).applyInPandas(decode, restored)
    used = encoded.where("stream = 'eid'").mapInPandas(eids, "file string, block_id long, eid int").join(model.stored.select("eid", "tokens"), "eid")
    return encoded.groupBy(*KEYS).cogroup(used.groupBy(*KEYS)).applyInPandas(decode_by, restored)


def write_log(lines: DataFrame, path: str, charset: str = "ISO-8859-1") -> DataFrame:
    """Restored lines as the files they came from, byte for byte: one below path for each, named as it was below their common folder.

    Returns (file, target, lines, bytes). A file's lines stream through one task in order, so a file may be larger than memory,
    and files are written side by side. Each is written under another name and renamed when it is whole, so a repeated task
    replaces its file. path is anything that pyarrow.fs opens on the executors: a shared folder, hdfs://, s3://, gs://.
    charset: as the lines were read; lines that it cannot hold raise.
    """
    low, high = lines.agg(F.min("file"), F.max("file")).first()
    common = os.path.commonprefix([low or "", high or ""])
    skip = common.rfind("/") + 1
    schema = "file string, target string, lines long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = LogFiles(path, charset, skip)
        for batch in batches:
            out.add(*[batch.column(i).to_pylist() for i in range(3)])
        out.close()
        yield pa.RecordBatch.from_pylist(out.done, pa.schema([("file", pa.string()), ("target", pa.string()), ("lines", pa.int64()), ("bytes", pa.int64())]))

    ordered = lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line", "final_newline")
    found = ordered.mapInArrow(run, schema)
    return lines.sparkSession.createDataFrame(found.collect(), schema)  # a row a file


class LogFiles:
    """Writes files in turn: lines come ordered by file."""

    def __init__(self, path: str, charset: str, skip: int):
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
            self.fs, self.root = fs.FileSystem.from_uri(path)
        else:
            self.fs, self.root = fs.LocalFileSystem(), os.path.abspath(path)
        self.charset, self.skip, self.file, self.out, self.done = charset, skip, None, None, []

    def add(self, files: list[str], lines: list[str], newlines: list[bool]) -> None:
        at = 0
        while at < len(files):
            to = at + 1
            while to < len(files) and files[to] == files[at]:
                to += 1
            if files[at] != self.file:
                self.close()
                self.open(files[at])
            data = ("\n" if self.n else "") + "\n".join(lines[at:to])
            self.put(data)
            self.n, self.newline, at = self.n + to - at, newlines[to - 1], to

    def put(self, text: str) -> None:
        self.bytes += self.out.write(text.encode(self.charset)) or 0

    def open(self, file: str) -> None:
        self.file, self.n, self.bytes = file, 0, 0
        self.target = f"{self.root}/{file[self.skip :] or 'log'}"
        self.partial = f"{self.target}.{uuid.uuid4().hex}"
        self.fs.create_dir(os.path.dirname(self.target), recursive=True)
        self.out = self.fs.open_output_stream(self.partial)

    def close(self) -> None:
        if self.out is None:
            return
        if self.newline:
            self.put("\n")
        self.out.close()
        self.fs.move(self.partial, self.target)
        self.done.append({"file": self.file, "target": self.target, "lines": self.n, "bytes": self.bytes})
        self.out = None


def failures(parsed: DataFrame) -> DataFrame:
    """(keys, rec_id, kind, reason, raw) of records that are kept raw."""
    kind = F.when(F.col("eid") == 0, "match").otherwise("load")
    return parsed.where("eid <= 0").select(*KEYS, "rec_id", kind.alias("kind"), F.col("status").alias("reason"), "raw")


def metrics(lines: DataFrame, encoded: DataFrame, parsed: DataFrame) -> DataFrame:
    """(metric, value): raw and encoded bytes, records by outcome."""
    raw = lines.agg(F.sum(F.length("line") + 1).alias("value")).select(F.lit("raw_bytes").alias("metric"), F.col("value").cast("long").alias("value"))
    size = encoded.agg(F.sum(F.octet_length("payload")).alias("value")).select(F.lit("encoded_bytes").alias("metric"), F.col("value").cast("long").alias("value"))
    outcome = F.when(F.col("eid") > 0, "matched").when(F.col("eid") == 0, "match_failed").otherwise("load_failed")
    return matching.union_all([raw, size, parsed.groupBy(outcome.alias("metric")).agg(F.count("*").alias("value"))])
