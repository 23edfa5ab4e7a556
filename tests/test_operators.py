"""Single operators on small inputs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.config import LogConfig
from timberline.operators import codec, deltas, framing, header, matching, mining, rules
from timberline.operators import tokens as tk

# pos, v, id, do, up, doi, upi
DELTAS = [(0, 10, "a", 10, 5, 10, 20), (1, 15, "b", 5, 15, 15, -3), (2, 30, "a", 15, -18, 20, 30), (3, 12, "b", -18, 12, -3, 12)]
VARINTS = [(0, 0, "00"), (-1, 1, "01"), (1, 2, "02"), (-64, 127, "7F"), (64, 128, "8001"), (2147483647, 4294967294, "FEFFFFFF0F"), (-2147483648, 4294967295, "FFFFFFFF0F")]


def test_deltas(spark):
    df = spark.createDataFrame(DELTAS, "pos int, v long, id string, do long, up long, doi long, upi long")
    for name, make, undo, keys in (("do", deltas.backward, deltas.undo_backward, []), ("up", deltas.forward, deltas.undo_forward, []), ("doi", deltas.backward, deltas.undo_backward, ["id"]), ("upi", deltas.forward, deltas.undo_forward, ["id"])):
        got = df.withColumn("got", make("v", keys, ["pos"])).withColumn("back", undo("got", keys, ["pos"])).orderBy("pos").collect()
        assert [r["got"] for r in got] == [r[name] for r in got]
        assert [r["back"] for r in got] == [r["v"] for r in got]


def test_deltas_over_arrays():
    v, ids = np.array([r[1] for r in DELTAS]), {"id": np.array([0, 1, 0, 1])}
    for form, at in ((rules.Form("v", "do"), 3), (rules.Form("v", "up"), 4), (rules.Form("v", "do", "id"), 5), (rules.Form("v", "up", "id"), 6)):
        d = rules.derive(v, form, ids)
        assert d.tolist() == [r[at] for r in DELTAS]
        assert rules.underive(d, form, ids).tolist() == v.tolist()


def test_varints(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(VARINTS, "n long, z long, hex string")
    zz = codec.zigzag(F.col("n"))
    for r in df.select("n", "z", "hex", zz.alias("zz"), codec.unzigzag(F.col("z")).alias("back"), codec.varint_hex(zz).alias("h"), codec.varint_length(zz).alias("len")).collect():
        assert (r["zz"], r["back"], r["h"], r["len"]) == (r["z"], r["n"], r["hex"], len(r["hex"]) // 2)
    assert codec.varints(codec.zigzag_np(np.array([r[0] for r in VARINTS]))).hex().upper() == "".join(r[2] for r in VARINTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(1 << 60), 1 << 60)), st.sampled_from(["Z", "NE", "P"]), st.booleans())
def test_integers_come_back(v, name, delta):
    a = np.array(v, dtype=np.int64)
    assert codec.decode_ints(codec.encode_ints(a, name, delta), name, delta).tolist() == v


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=5) | st.sampled_from(["a", "b\n", ""])))
def test_strings_come_back(v):
    assert codec.decode_strings(codec.encode_strings(v)) == v


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 1000), st.integers(0, 1000), st.integers(0, 3)), min_size=1), st.randoms())
def test_rules_span_and_invert(rows, r):
    columns = ["0", "1", "2"]
    values = {c: np.array([x[i] for x in rows], dtype=np.int64) for i, c in enumerate(columns)}
    ids = {"9": np.array([x[3] for x in rows])}
    forms = rules.all_forms(columns, ["9"])
    candidates = [(f,) for f in forms] + rules.pairs(forms) + rules.triples(rules.all_forms(columns))
    chosen = rules.greedy(columns, {c: float(r.randrange(50)) for c in candidates})
    assert sorted(new for new, _ in chosen) == columns
    back = rules.solve_rules(rules.apply_rules(values, chosen, ids), chosen, ids)
    assert {c: v.tolist() for c, v in back.items()} == {c: v.tolist() for c, v in values.items()}


def test_greedy_breaks_ties_by_size_and_name():
    a, b = rules.Form("a"), rules.Form("b")
    assert rules.greedy(["a", "b"], {(a,): 1.0, (b,): 1.0, (b, a): 1.0}) == [("a", (a,)), ("b", (b,))]


def test_tokens(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a=1, b: 10.0.0.1:80  x\ty",)], "c string").withColumn("t", tk.tokens(F.col("c")))
    r = df.select("c", F.array_join("t", "").alias("j"), tk.mask(F.col("t")).alias("m")).first()
    assert r["j"] == r["c"]
    assert r["m"] == ["a", "=", "<*>", ",", " ", "b", ":", " ", "<*>", ":", "<*>", " ", " ", "x", "\t", "y"]
    one = spark.createDataFrame([(["u", "=", "1"], ["u", "=", "2"], ["u", "=", "<*>"])], "a array<string>, b array<string>, p array<string>")
    r = one.select(tk.merge(F.col("a"), F.col("b")).alias("m"), tk.distance(F.col("p"), F.col("a")).alias("d"), tk.rebuild(F.col("p"), tk.variables(F.col("a"), F.col("p"))).alias("s")).first()
    assert (r["m"], round(r["d"], 4), r["s"]) == (["u", "=", "<*>"], 0.3333, "u=1")


def test_first_template_wins_and_limits(spark):
    from pyspark.sql import functions as F

    t = matching.template_table(spark, [(7, 1, ["a", " ", "<*>"], 2), (3, 2, ["a", " ", "b"], 2), (9, 3, ["<*>"] * 5, 2)])
    rows = [("a b", "ok"), ("a c", "ok"), ("b c", "ok"), ("1 2 3", "ok"), ("a b", "load_failed:x")]
    df = spark.createDataFrame(rows, "c string, status string").withColumn("toks", tk.tokens(F.col("c")))
    got = matching.match(df, t, LogConfig(max_vars=4)).collect()
    assert sorted((r["c"], r["eid"], r["status"]) for r in got) == sorted(
        [("a b", 7, "ok"), ("a c", 7, "ok"), ("b c", 0, "match_failed"), ("1 2 3", -1, "load_failed:too_many_variable"), ("a b", -1, "load_failed:x")]
    )


def test_header_formats(spark):
    rows = [(0, i, f"2024-01-{i % 28 + 1:02d} {i * 7} {'x1' if i % 2 else 'y'} rest {i}", "ok") for i in range(100)]
    parsed = header.with_head(spark.createDataFrame(rows, "block_id long, rec_id long, raw string, status string"), 3)
    slots = header.infer_slots(parsed, LogConfig(head_slots=3))
    assert [s.pieces for s in slots] == [(4, "-", 2, "-", 2), (0,), None]
    assert re.match(slots[0].pattern(), "2024-01-02") and not re.match(slots[0].pattern(), "2024-1-02")


def test_orphans_and_heads(spark):
    rows = [(i, t) for i, t in enumerate(["x", "[1 a", " b", "", "c", "[2 d", "e"])]
    framed = framing.frame(spark.createDataFrame(rows, "line_no long, line string"), [], LogConfig(boundary=r"\[\d"))
    got = [(r["raw"], r["status"], r["n_lines"]) for r in framed.orderBy("rec_id").collect()]
    assert got == [("x", "load_failed:no_head", 1), ("[1 a\n b", "ok", 2), ("", "load_failed:empty", 1), ("c", "load_failed:no_head", 1), ("[2 d\ne", "ok", 2)]


def fold(rows, st_, levels=5):
    """The mining rules over one list, written plainly: nested dicts by length, then tokens; words only below the child cap.

    A leaf lies below as many tokens as there are levels, or one less than the record has, whichever is fewer.
    """
    root, clusters = {}, []
    for toks in rows:
        node, hit = root.setdefault(len(toks), {}), None
        way = toks[: min(levels, len(toks) - 1)]
        for t in way:
            node = node.get(t, node.get("<*>")) if node is not None else None
            if node is None:
                break
        if toks and node:
            scored = []
            for i, c in enumerate(node.get(None, [])):
                score, wild = 0, 0
                for p, t in zip(c[0], toks, strict=True):
                    if p in " \t:=,\n":
                        if p != t:
                            score = None
                            break
                    elif p == "<*>":
                        wild += 1
                    elif p == t:
                        score += 1
                if score is not None:
                    scored.append((score / len(toks), wild, -i))
            if scored and max(scored)[0] >= st_:
                hit = node[None][-max(scored)[2]]
        if hit:
            hit[0] = [p if p == t else "<*>" for p, t in zip(hit[0], toks, strict=True)]
            hit[1] += 1
            continue
        cluster = [list(toks), 1]
        clusters.append(cluster)
        node = root[len(toks)]
        for t in way:
            if t not in node and (any(ch in "0123456789" for ch in t) or len(node) >= 99):
                t = "<*>"
            node = node.setdefault(t, {})
        node.setdefault(None, []).append(cluster)
    return [(c[0], c[1]) for c in clusters if c[1] > 1]


@pytest.mark.parametrize("similarity", [0.1, 0.4, 0.6])
def test_tree_miner_is_the_sequential_fold(spark, similarity):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    texts = [" ".join(r.choice(["open", "close", "u1", "17", "x=3", "done:", "10.0.0.1"]) for _ in range(r.randrange(1, 6))) for _ in range(600)]
    df = spark.createDataFrame([(0, i, t, "ok") for i, t in enumerate(texts)], "block_id long, rec_id long, c string, status string").withColumn("toks", tk.tokens(F.col("c")))
    got = mining.tree_templates(df, LogConfig(similarity=similarity))
    masked = [["<*>" if re.fullmatch(r"[0-9]+", t) or re.match(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", t) else t for t in re.findall(tk.TOKEN, x)] for x in texts]
    assert [(t[2], t[3]) for t in got] == fold(masked, similarity)


def test_last_token_of_a_short_record_is_no_key(spark):
    from pyspark.sql import functions as F

    texts = ["login anna", "login bob", "login carl", "logout", "logout", "a b c d e f", "a b c d e g"]
    df = spark.createDataFrame([(0, i, t, "ok") for i, t in enumerate(texts)], "block_id long, rec_id long, c string, status string").withColumn("toks", tk.tokens(F.col("c")))
    assert [("".join(t[2]), t[3]) for t in mining.tree_templates(df, LogConfig())] == [("login <*>", 3), ("logout", 2), ("a b c d e <*>", 2)]


def test_templates_too_long_or_too_many():
    from timberline.plans.model import usable

    templates = [(i, i, ["a"] * (3 if i % 2 else 60), 2) for i in range(1, 9)]
    with pytest.warns(UserWarning, match="4 templates are too long and 1 too many"):
        assert [t[0] for t in usable(templates, LogConfig(max_tokens=50, max_templates=3))] == [1, 3, 5]
    assert usable(templates, LogConfig()) == templates


def test_boundary_by_search(spark):
    rows = [(i, t) for i, t in enumerate(["x[1] a", " b", "[2] c"])]
    lines = spark.createDataFrame(rows, "line_no long, line string")
    got = lambda config: [r["raw"] for r in framing.frame(lines, [], config).orderBy("rec_id").collect()]
    assert got(LogConfig(boundary=r"\[\d", search=True)) == ["x[1] a\n b", "[2] c"]
    assert got(LogConfig(boundary=r"\[\d\]")) == ["x[1] a", " b", "[2] c"]


def test_all_triples_are_scored(spark):
    """Also over identifiers and over many columns, by one constant list of places."""
    from pyspark.sql import functions as F

    from timberline.operators import rules

    forms = rules.all_forms([str(i) for i in range(6)], ["9"])
    rows = spark.createDataFrame([([(i * k * 7 + k) % 11 for k in range(len(forms))],) for i in range(40)], "v array<bigint>")
    three = rules.triples(forms)
    assert any(f[0].ident for f in three) and len(three) > 2_000
    place = {f: i for i, f in enumerate(forms)}
    some = [(f,) for f in forms] + rules.pairs(forms) + three
    found = {some[r["candidate"]]: r["entropy"] for r in rules.entropies_of(rows, F.col("v"), [tuple(place[f] for f in c) for c in some]).collect()}
    assert len(found) == len(some)
    check = some[:3] + some[len(forms) : len(forms) + 3] + some[-3:]
    name = lambda c: "-".join(f.name for f in c)
    exprs = {name(c): F.expr(" - ".join(f"v[{place[f]}]" for f in c)) for c in check}
    assert all(abs(found[c] - e["entropy"]) < 1e-9 for c in check for e in rules.entropies(rows, exprs).collect() if e["candidate"] == name(c))


def test_sql_functions(spark, tmp_path):
    from timberline.functions import register

    register(spark)
    (tmp_path / "a.log").write_bytes(b"one\r\n\xff two\n\nend")
    got = spark.sql(f"SELECT r.* FROM (SELECT '{tmp_path}/a.log' AS path UNION ALL SELECT CAST(NULL AS STRING)) f, LATERAL log_records(f.path) r ORDER BY line_no").collect()
    assert [tuple(r) for r in got] == [(0, "one\r"), (1, "\xff two"), (2, ""), (3, "end")]
    r = spark.sql("SELECT log_tokens('a=1') t, log_mask(log_tokens('a=1')) m, zigzag(-3) z, unzigzag(5) u, varint_len(300) n").first()
    assert (r["t"], r["m"], r["z"], r["u"], r["n"]) == (["a", "=", "1"], ["a", "=", "<*>"], 5, -3, 2)


def test_stream(spark, tmp_path):
    from timberline import streaming
    from timberline.plans import pipeline

    config = LogConfig(head_slots=1)
    texts = [f"t{i} job={i} ok" for i in range(20)]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_no long, line string")
    model = pipeline.train(lines, config)
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_no long, line string").parquet(str(tmp_path / "in"))
    q = streaming.encode_stream(stream, model, config, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    back = pipeline.restore(spark.read.parquet(str(tmp_path / "out")).drop("batch"), model, config)
    assert [r["line"] for r in back.orderBy("line_no").collect()] == texts
    q = streaming.parse_stream(stream, model, config).writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM parsed WHERE eid > 0").first()[0] == 20


def test_presets():
    from timberline.config import PRESETS, preset

    assert preset("Hadoop").head_slots == 3 and len(PRESETS) == 16 + 18
    assert preset("LogC").head_slots == 3 and preset("LogC").boundary and preset("LogQ").boundary is None
    with pytest.raises(ValueError):
        LogConfig(level="X")


def test_rules_of_a_table(spark, tmp_path):
    from timberline.plans.pipeline import rules_of_table

    rows = "\n".join(["n,a,b,c", *[f"{i},{i * 7},{i * 7 + 5},{i * i % 37}" for i in range(200)]])
    (tmp_path / "p.csv").write_text(rows)
    table = spark.read.csv(str(tmp_path / "p.csv"), header=True).selectExpr("CAST(n AS BIGINT) n", "a", "b", "c")
    found = rules_of_table(table, "n", LogConfig())
    assert set(found) == {"a", "b"} and any("do" in r or "up" in r or " - " in r for r in found.values())


def test_dictionary(spark):
    from timberline.operators.variables import dictionary

    df = spark.createDataFrame([(0, 0, "b"), (0, 1, "a"), (0, 2, "b"), (1, 3, "a")], "k long, o long, v string")
    assert sorted(tuple(r) for r in dictionary(df, ["k"], "v", "o").collect()) == [(0, "a", 1), (0, "b", 0), (1, "a", 0)]


def test_command_line(spark, tmp_path):
    from timberline.__main__ import main

    texts = "".join(f"t{i} INFO x job={i} took {i * 2}\n" for i in range(50))
    (tmp_path / "a.log").write_text(texts)
    for args in (f"train -I {tmp_path}/a.log -T {tmp_path}/m -L 2", f"compress -I {tmp_path}/a.log -T {tmp_path}/m -O {tmp_path}/z -L 2 -B 20", f"restore -I {tmp_path}/z -T {tmp_path}/m -O {tmp_path}/r -L 2 -B 20"):
        main(args.split(), spark)
    assert (tmp_path / "r" / "a.log").read_text() == texts


def test_commands_on_tables_and_columns(spark, tmp_path):
    from timberline.__main__ import main

    (tmp_path / "p.csv").write_text("\n".join(["n,a,b,who", *[f"{i},{i * 7},{i * 7 + 5},{i % 3}" for i in range(60)]]))
    main(f"rules -I {tmp_path}/p.csv --order n -O {tmp_path}/rules".split(), spark)
    assert {r["new"] for r in spark.read.parquet(str(tmp_path / "rules")).collect()} <= {"a", "b", "who"}
    main(f"entropy -I {tmp_path}/p.csv -O {tmp_path}/entropy".split(), spark)
    found = {r["candidate"]: r["entropy"] for r in spark.read.parquet(str(tmp_path / "entropy")).collect()}
    assert found["b - a"] == 0.0 and found["a"] > 200 and any(c.count(" - ") == 2 for c in found)
    main(f"delta -I {tmp_path}/p.csv --column a --order n --ident who -O {tmp_path}/delta".split(), spark)
    rows = spark.read.parquet(str(tmp_path / "delta")).collect()
    assert {(r["up"], r["do"]) for r in rows if 3 <= int(r["n"]) < 57} == {(21, 21)}
    values = [0, -1, 63, -64, 64, 2**31, -(2**40)]
    (tmp_path / "c").mkdir()
    for name in ("x.col", "y.col"):
        (tmp_path / "c" / name).write_text("".join(f"{v}\n" for v in values))
    for kind in ("Z", "NE", "P"):
        main(f"encode -I {tmp_path}/c -O {tmp_path}/e{kind} -E {kind} -B 3".split(), spark)
        main(f"decode -I {tmp_path}/e{kind} -O {tmp_path}/d{kind} -B 3".split(), spark)
        assert all((tmp_path / f"d{kind}" / n).read_text() == (tmp_path / "c" / n).read_text() for n in ("x.col", "y.col"))
    (tmp_path / "s.log").write_text("".join(f"line {i}\n" for i in range(5_000)))
    main(f"sample -I {tmp_path}/s.log -O {tmp_path}/s -R 0.0".split(), spark)
    text = (tmp_path / "s" / "s.log").read_text().splitlines()
    assert len(text) == 1_000 and text == sorted(text, key=lambda t: int(t[5:]))


def test_batch_goes_on_after_an_error(spark, tmp_path):
    from timberline.plans import batch

    for kind in ("Spark", "Hpc"):
        (tmp_path / "logs" / kind).mkdir(parents=True)
        for k in range(2):
            (tmp_path / "logs" / kind / f"{k}.log").write_bytes("".join(f"17/06/09 20:10:{i % 60:02d} INFO task {i * 3} on \xff{k}\n" for i in range(60)).encode("latin-1")[: -k or None])
    config = lambda kind: preset_of(kind)
    from timberline.config import preset as preset_of

    steps = ["train", "compress", "restore"]
    folders = [str(tmp_path / x) for x in ("logs", "models", "encoded", "restored", "log")]
    made = batch.run(spark, ["Spark", "Missing", "Hpc"], steps, lambda k: config(k if k != "Missing" else "Hpc"), *folders).collect()
    assert [(r["type"], r["step"], r["status"]) for r in made] == [*[("Spark", s, "ok") for s in steps], ("Missing", "train", "failed"), *[("Hpc", s, "ok") for s in steps]]
    for kind in ("Spark", "Hpc"):
        for k in range(2):
            assert (tmp_path / "restored" / kind / f"{k}.log").read_bytes() == (tmp_path / "logs" / kind / f"{k}.log").read_bytes()
    batch.run(spark, ["Hpc"], ["train"], config, *folders)
    log = spark.read.parquet(folders[-1])
    assert log.count() == 8
    total = {r["type"]: r for r in batch.summary(log).collect()}
    assert total["Missing"]["errors"] == 1 and total[None]["errors"] == 1 and total["Spark"]["ratio"] > 1 and total[None]["seconds"] >= total["Hpc"]["seconds"] > 0


def test_entropies_in_buckets_are_those_of_plain_counts(spark):
    r = random.Random(21)
    wide = [r.randrange(-(10**12), 10**12) for _ in range(40)]
    rows = [(r.randrange(5), r.choice([None, r.randrange(-300, 300)]), 61 * r.randrange(50), r.choice(wide) if i % 3 else r.randrange(10**15)) for i in range(5_000)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long").repartition(3)
    names = ["a", "b", "c", "d"]
    bounds = [(min(x for x in v if x is not None), max(x for x in v if x is not None)) for v in zip(*rows, strict=True)]
    candidates = [(0,), (1,), (2,), (3,), (1, 0), (2, 1), (0, 2), (3, 1), (2, 3), (0, 1, 2)]
    found = rules.entropies_in_buckets(df, names, bounds, candidates)
    assert "Generate" not in found._jdf.queryExecution().toString()  # a row is not multiplied by its candidates
    exprs = {str(k): F.expr(" - ".join(names[x] for x in c)) for k, c in enumerate(candidates)}
    expected = {int(r["candidate"]): (r["n"], r["entropy"]) for r in rules.entropies(df, exprs).collect()}
    got = {r["candidate"]: (r["n"], r["entropy"]) for r in found.collect()}
    assert got.keys() == expected.keys()
    assert all(got[k][0] == n and abs(got[k][1] - e) < 1e-3 for k, (n, e) in expected.items())
    beyond = rules.entropies_in_buckets(df, names, [(-(1 << 63), (1 << 63) - 1)] * 4, candidates)
    assert all(abs(r["entropy"] - expected[r["candidate"]][1]) < 1e-3 for r in beyond.collect())
    assert rules.entropies_in_buckets(df.limit(0), names, bounds, candidates).count() == 0


def test_greedy_rules_multiply_no_rows(spark, sf, monkeypatch):
    from timberline.plans import catalog

    monkeypatch.setattr(rules, "entropies", None)
    monkeypatch.setattr(rules, "entropies_of", None)
    assert {r["new"] for r in catalog.QUERIES["rules_spanning"](spark, sf).collect()} == set(catalog.VALUES)
