"""restore(compress(x)) == x, byte for byte."""

from __future__ import annotations

import itertools
import random

import pytest

from timberline.config import LogConfig
from timberline.plans import pipeline


def lines_of(spark, texts, block=None):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no long, line string")


def trip(spark, texts, config, miner="tree"):
    lines = lines_of(spark, texts)
    model = pipeline.train(lines, config, miner)
    back = pipeline.restore(pipeline.compress(lines, model, config), model, config)
    return [r["line"] for r in back.orderBy("line_no").collect()], model


def log(n, seed=1, words=("start", "stop", "read", "lost")):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = f"2024-01-{1 + i % 28:02d} 00:{i // 60 % 60:02d}:{i % 60:02d} {r.choice(['INFO', 'WARN'])} {r.randrange(9)}"
        out.append(f"{t} {r.choice(words)} job={i * 3} at {r.randrange(1000)}, took: {r.randrange(9) * 10 + i}")
    return out


@pytest.mark.parametrize(("level", "delta", "codec"), list(itertools.product("0N", (True, False), ("Z", "NE", "P"))))
def test_configurations(spark, level, delta, codec):
    config = LogConfig(level=level, delta=delta, codec=codec, block_lines=40, rule_rows=5)
    texts = log(100)
    back, model = trip(spark, texts, config)
    assert back == texts
    if level == "N":
        assert model.rules


EDGES = {
    "empty_line": ["2024-01-01 00:00:07 INFO 1 a=1", "", "2024-01-01 00:00:08 INFO 1 a=2"],
    "nul_byte": ["2024-01-01 00:00:07 INFO 1 a=\x001", "2024-01-01 00:00:08 INFO 1 a=2"],
    "leading_zero_var": [f"2024-01-01 00:00:07 INFO 1 id={x}" for x in ("007", "12", "0", "00")],
    "type_drift": [f"2024-01-01 00:00:07 INFO 1 id={x}" for x in ("1", "2", "3", "abc", "-4", "9" * 30)],
    "edge_whitespace": ["  2024-01-01 00:00:07 INFO 1 a  b  ", "\t2024-01-01 00:00:07 INFO 1 a  c  "],
    "mixed_delims": ["2024-01-01  00:00:07\tINFO | 1 a=1", "2024-01-01 00:00:07 INFO 1 a=1"],
    "latin1": ["2024-01-01 00:00:07 INFO 1 caf\xe9 \xff\xa0x", "2024-01-01 00:00:07 INFO 1 caf\xe9 \x85"],
    "wide": ["2024-01-01 00:00:07 INFO 1 日本 🎉=1", "2024-01-01 00:00:07 INFO 1 日本 🎊=1"],
    "crlf": ["2024-01-01 00:00:07 INFO 1 a=1\r", "2024-01-01 00:00:08 INFO 1 a=2\r"],
    "bracket_line": ["2024-01-01 00:00:07 INFO 1 [12]", "2024-01-01 00:00:08 INFO 1 [12]"],
    "whitespace_run": ["2024-01-01 00:00:07 INFO 1 a   b", "2024-01-01 00:00:08 INFO 1 a   c"],
    "header_leading_zero": [f"{x} b INFO 1 a=1" for x in ("0007", "12", "4294967297", "99999999999999999999")],
    "head_only": ["2024-01-01 00:00:07 ERROR 17", "2024-01-01 00:00:07 ERROR 17 x"],
    "short": ["a", "a b", ""],
    "id_with_space": [f"2024-01-01 00:00:07 INFO 1 u= v={i}" for i in range(5)],
    "one": ["2024-01-01 00:00:07 INFO 1 only"],
    "wild": ["2024-01-01 00:00:07 INFO 1 <*> x=<*>", "2024-01-01 00:00:08 INFO 1 <*> x=1"],
}


@pytest.mark.parametrize("name", sorted(EDGES))
def test_edges(spark, name):
    assert trip(spark, EDGES[name], LogConfig())[0] == EDGES[name]


@pytest.mark.parametrize("n", [19, 20, 21, 40])
def test_block_edges(spark, n):
    texts = log(n)
    assert trip(spark, texts, LogConfig(block_lines=20), "mask")[0] == texts


def test_multi_line_records(spark):
    texts = []
    for i, t in enumerate(log(30)):
        texts += ["[" + t] + [f"  at frame {k}" for k in range(i % 4)] + ([""] if i % 7 == 0 else [])
    texts = ["orphan", *texts, "[2024-01-01 00 x y", "  ends inside"]
    config = LogConfig(boundary=r"\[\d{4}-\d{2}-\d{2}.*", block_lines=17)
    back, _ = trip(spark, texts, config)
    assert back == texts
    parsed = pipeline.parse(lines_of(spark, texts), pipeline.train(lines_of(spark, texts), config), config)
    reasons = {r["status"] for r in parsed.select("status").distinct().collect()}
    assert {"load_failed:empty", "load_failed:no_head"} <= reasons


def test_limits_route_and_keep(spark):
    texts = [*log(10), "2024-01-01 00:00:07 INFO 1 " + "x" * 500, "2024-01-01 00:00:07 INFO 1 " + "a b " * 200]
    config = LogConfig(max_chars=400, max_tokens=50)
    assert trip(spark, texts, config)[0] == texts
    model = pipeline.train(lines_of(spark, texts[:10]), config)
    got = {r["status"] for r in pipeline.parse(lines_of(spark, texts), model, config).collect()}
    assert "load_failed:too_long" in got
    wide = LogConfig(max_tokens=50, max_chars=10_000)
    assert "load_failed:too_many_token" in {r["status"] for r in pipeline.parse(lines_of(spark, texts), model, wide).collect()}


def test_files_byte_for_byte(spark, tmp_path):
    from timberline.sources.lines import read_lines

    raw = b"2024-01-01 00:00:07 INFO 1 a=\xff\xe9 1\r\n\n2024-01-01 00:00:07 INFO 1 a=\xff b 2\nno newline at the end"
    (tmp_path / "x.log").write_bytes(raw)
    lines = read_lines(spark, str(tmp_path / "x.log"))
    config = LogConfig()
    model = pipeline.train(lines, config)
    back = pipeline.restore(pipeline.compress(lines, model, config, archive=True), model, config).orderBy("line_no").collect()
    text = "\n".join(r["line"] for r in back) + ("\n" if back[0]["final_newline"] else "")
    assert text.encode("latin-1") == raw
    pipeline.write_log(pipeline.restore(pipeline.compress(lines, model, config), model, config), str(tmp_path / "out"))
    assert (tmp_path / "out" / "x.log").read_bytes() == raw


def test_several_files_come_back_byte_for_byte(spark, tmp_path):
    """Read in many ranges, encoded in many blocks, written a file each."""
    from timberline.sources.lines import read_lines

    r = random.Random(4)
    files = {"a/0.log": b"", "a/1.log": b"\n", "a/2.log": b"x", "b/1.log": "\n".join(log(3000)).encode() + b"\n", "b/2.log": "\r\n".join(log(2000, 2)).encode(), "b/3.log": bytes(r.choice(b"ab \n\r\x00\xff=1") for _ in range(20_000))}
    for name, raw in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    config = LogConfig(block_lines=700)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = read_lines(spark, str(tmp_path / "in" / "*"))
        rows = lines.collect()
        for name, raw in files.items():
            own = sorted((x["line_no"], x["line"], x["final_newline"]) for x in rows if x["file"].endswith(name))
            assert [x[0] for x in own] == list(range(len(own))), name
            assert "\n".join(x[1] for x in own).encode("latin-1") + (b"\n" if own and own[0][2] else b"") == raw, name
        model = pipeline.train(lines, config)
        back = pipeline.restore(pipeline.compress(lines, model, config), model, config)
        written = pipeline.write_log(back, str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(written) == 5  # an empty file has no lines
    for name, raw in files.items():
        if raw:
            assert (tmp_path / "out" / name).read_bytes() == raw, name
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix != ".log"]


def test_wide_characters_are_written_as_they_were_read(spark, tmp_path):
    from timberline.sources.lines import read_text_lines

    raw = "2024-01-01 00:00:07 INFO 1 日本 🎉=1\n".encode() * 3
    (tmp_path / "x.log").write_bytes(raw)
    lines = read_text_lines(spark, str(tmp_path / "x.log"))
    pipeline.write_log(lines, str(tmp_path / "out"), "UTF-8")
    assert (tmp_path / "out" / "x.log").read_bytes() == raw


def test_blocks_are_sampled_by_file(spark):
    from timberline.sources.lines import sample_blocks

    lines = spark.range(20 * 4000).selectExpr("concat('f', cast(id % 20 as string)) AS file", "id div 20 AS line_no", "cast(id as string) AS line")
    got = sample_blocks(lines, LogConfig(sample_least=50, sample_rate=0.0))
    assert got.count() == 1_000 and got.select("file", "small_block").distinct().count() == 50
    assert got.select("small_block").distinct().count() > 20 and got.select("file").distinct().count() > 10


def test_model_saves_and_loads(spark, tmp_path):
    from timberline.plans.model import Model

    config = LogConfig(level="N", rule_rows=5)
    texts = log(60)
    model = pipeline.train(lines_of(spark, texts), config)
    model.save(spark, str(tmp_path / "m"))
    again = Model.load(spark, str(tmp_path / "m"))
    assert again == model
    back = pipeline.restore(pipeline.compress(lines_of(spark, texts), again, config), again, config)
    assert [r["line"] for r in back.orderBy("line_no").collect()] == texts


def test_unknown_lines_fail_to_match_and_come_back(spark):
    config = LogConfig()
    model = pipeline.train(lines_of(spark, log(30)), config)
    texts = [*log(5), "2024-01-01 00:00:07 INFO 1 something else entirely here", "x"]
    lines = lines_of(spark, texts)
    assert [r["line"] for r in pipeline.restore(pipeline.compress(lines, model, config), model, config).orderBy("line_no").collect()] == texts
    failed = pipeline.failures(pipeline.parse(lines, model, config)).collect()
    assert {r["kind"] for r in failed} == {"match", "load"}


def test_sources_agree_on_order(spark, tmp_path):
    from timberline.sources.lines import block_range, read_lines, read_segments, read_text_lines, sample_blocks, with_blocks

    texts = log(500)
    (tmp_path / "0.col").write_text("\n".join(texts) + "\n")
    (tmp_path / "1.col").write_text("\n".join(texts[:7]) + "\n")
    one = [r["line"] for r in read_lines(spark, str(tmp_path)).orderBy("file", "line_no").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        two = [r["line"] for r in read_text_lines(spark, str(tmp_path)).orderBy("file", "line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one == two == texts + texts[:7]
    assert sorted(r["block_id"] for r in read_segments(spark, str(tmp_path)).select("block_id").distinct().collect()) == [0, 1]
    lines = with_blocks(lines_of(spark, texts), 50)
    assert block_range(lines, 2, 3).count() == 100
    assert sample_blocks(lines, LogConfig(sample_least=3, sample_rate=0.0)).count() == 60
    assert sample_blocks(lines_of(spark, texts[:10]), LogConfig()).count() == 10


def test_a_model_too_large_for_the_driver_stays_a_table(spark, sf, con, tmp_path, monkeypatch):
    from helpers import differ

    from timberline.plans import catalog
    from timberline.plans import model as plans_model
    from timberline.sources import views

    config = LogConfig(head_slots=0, boundary=catalog.DOCS.boundary, max_templates=150, max_tokens=60)
    lines = views.doc_lines(spark, sf).selectExpr("'' AS file", "doc_id AS block_id", "line_no", "line", "true AS final_newline")
    matched = lambda m: sorted((r.block_id, r.rec_id, r.status, r.eid, tuple(r.vars or ())) for r in pipeline.parse(lines, m, config).collect())
    listed = pipeline.train(lines, config, "mask", sample=False)
    monkeypatch.setattr(plans_model, "DRIVER_TOKENS", 0)
    stored = pipeline.train(lines, config, "mask", sample=False)
    assert listed.templates and not stored.templates
    assert sorted((r.eid, r.ord, list(r.tokens), r.train_count) for r in stored.stored.collect()) == sorted(listed.templates)
    assert matched(stored) == matched(listed)
    stored.save(spark, str(tmp_path / "m"))
    loaded = plans_model.Model.load(spark, str(tmp_path / "m"))
    assert not loaded.templates and matched(loaded) == matched(listed)
    for archive in (False, True):
        back = pipeline.restore(pipeline.compress(lines, loaded, config, archive=archive), loaded, config)
        assert sorted(back.select("block_id", "line_no", "line").collect()) == sorted(lines.select("block_id", "line_no", "line").collect())
    assert not differ(catalog.QUERIES["roundtrip_multi"](spark, sf), con, catalog.ORACLE_SQL["roundtrip_multi"])
