"""The registered queries over the shared tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.config import LogConfig
from timberline.operators import codec, deltas, framing, header, matching, mining, rules, variables
from timberline.operators import tokens as tk
from timberline.plans import pipeline
from timberline.plans.model import Model
from timberline.sources import lines as sources
from timberline.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EVENTS = LogConfig(head_slots=3, block_lines=2_000)
ORDERS = LogConfig(head_slots=1, block_lines=2_000)
#: A head word in letters followed by a space, as a multi-line boundary for prose: lines that start with a short word.
DOCS = LogConfig(head_slots=0, boundary=r"[A-Z][a-z]{1,3}", block_lines=2_000)

TOKEN = "[^ \\t:=,\\n]+|[ \\t:=,\\n]"
MASKED = "list_transform(toks, lambda t: CASE WHEN regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') THEN '<*>' ELSE t END)"
#: Event lines taken apart as the header parse does.
EVENT_PARTS = f"""
e AS ({views.EVENT_LOG}),
p AS (SELECT line_no, CAST(floor(line_no / 2000) AS BIGINT) AS block_id, line, regexp_extract(line, '^([ \\t|]*(?:[^ \\t|\\n]+[ \\t|]*){{3}})', 1) AS head FROM e),
t AS (SELECT *, regexp_extract_all(substr(line, length(head) + 1), '{TOKEN}') AS toks FROM p)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.as_blocks(views.event_log(spark, sf_dir), EVENTS)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed event records: (file, block_id, rec_id, raw, head, toks)."""
    return pipeline._parsed(framing.frame(events(spark, sf_dir), pipeline.KEYS, EVENTS), None, EVENTS)


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, block_id, toks) without framing, for expressions alone."""
    e = sources.with_blocks(views.event_log(spark, sf_dir), EVENTS.block_lines)
    return e.withColumn("head", header.split_head(F.col("line"), 3)).withColumn("toks", tk.tokens(F.col("head.content")))


# ---- templates


@query(f"WITH {EVENT_PARTS} SELECT array_to_string({MASKED}, '') AS template, count(*) AS n FROM t GROUP BY 1")
def flagship_template_counts(spark, sf_dir):
    e = event_tokens(spark, sf_dir)
    return e.groupBy(F.array_join(tk.mask(F.col("toks")), "").alias("template")).agg(F.count("*").alias("n"))


# ---- sources


@query(f"WITH v AS ({views.EVENT_LOG}) SELECT CAST(floor(line_no / 2000) AS BIGINT) AS block_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM v GROUP BY 1")
def block_segmentation(spark, sf_dir):
    return events(spark, sf_dir).groupBy("block_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query(f"WITH v AS ({views.EVENT_LOG}) SELECT CAST(floor(line_no / 2000) AS BIGINT) AS block_id, line_no, line FROM v WHERE floor(line_no / 2000) BETWEEN 1 AND 2")
def block_range_scan(spark, sf_dir):
    return sources.block_range(events(spark, sf_dir), 1, 2).select("block_id", "line_no", "line")


@query(
    f"""WITH v AS ({views.EVENT_LOG}), k AS (SELECT *, CAST(floor(line_no / 20) AS BIGINT) AS small_block FROM v),
    b AS (SELECT DISTINCT small_block FROM k), n AS (SELECT count(*) AS n FROM b),
    c AS (SELECT small_block FROM b ORDER BY (small_block * 2654435761) % 4294967296, small_block
          LIMIT (SELECT least(n, least(greatest(CAST(floor(n * 0.1) AS BIGINT), 50), 50000)) FROM n))
    SELECT small_block, line_no, line FROM k WHERE small_block IN (SELECT small_block FROM c)"""
)
def block_sample(spark, sf_dir):
    return sources.sample_blocks(views.event_log(spark, sf_dir), LogConfig(sample_rate=0.1)).select("small_block", "line_no", "line")


# ---- framing

FRAMED = f"""
l AS ({views.DOC_LINES}),
k AS (SELECT *, CASE WHEN length(line) = 0 THEN 'empty' WHEN regexp_full_match(regexp_extract(line, '^[ \\t|]*([^ \\t|]*)', 1), '[A-Z][a-z]{{1,3}}') THEN 'head' END AS kind0 FROM l),
m AS (SELECT *, coalesce(kind0, CASE WHEN last_value(kind0 IGNORE NULLS) OVER w = 'head' THEN 'part' ELSE 'orphan' END) AS kind FROM k
      WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CAST(sum(CASE WHEN kind = 'part' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS rec_id FROM m),
f AS (SELECT doc_id, rec_id, string_agg(line, chr(10) ORDER BY line_no) AS raw, count(*) AS n_lines, arg_min(kind, line_no) AS kind FROM r GROUP BY 1, 2)
"""
STATUS = "CASE kind WHEN 'empty' THEN 'load_failed:empty' WHEN 'orphan' THEN 'load_failed:no_head' ELSE CASE WHEN length(raw) > 300000 THEN 'load_failed:too_long' ELSE 'ok' END END"


@query(f"WITH {FRAMED} SELECT doc_id, rec_id, raw, n_lines, {STATUS} AS status FROM f")
def frame_multiline(spark, sf_dir):
    return framing.frame(views.doc_lines(spark, sf_dir), ["doc_id"], DOCS)


@query(f"WITH {FRAMED} SELECT {STATUS} AS status, count(*) AS n, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM f GROUP BY 1")
def frame_failures(spark, sf_dir):
    framed = framing.frame(views.doc_lines(spark, sf_dir), ["doc_id"], DOCS)
    return framed.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_lines").cast("long").alias("n_lines"))


# ---- header


@query(f"WITH {EVENT_PARTS} SELECT line_no, array_to_string(regexp_extract_all(head, '[^ \\t|\\n]+'), '~') AS heads, substr(line, length(head) + 1) AS content FROM p")
def head_split(spark, sf_dir):
    e = views.event_log(spark, sf_dir).withColumn("head", header.split_head(F.col("line"), 3))
    return e.select("line_no", F.array_join("head.values", "~").alias("heads"), F.col("head.content").alias("content"))


@query(
    f"""WITH v AS ({views.ORDER_LOG}), h AS (SELECT line_no, line, regexp_extract(line, '^([ \\t|]*(?:[^ \\t|\\n]+[ \\t|]*){{1}})', 1) AS head FROM v)
    SELECT line_no, substr(line, length(head) + 1) AS content FROM h"""
)
def content_split(spark, sf_dir):
    o = views.order_log(spark, sf_dir)
    return o.select("line_no", header.split_head(F.col("line"), 1)["content"].alias("content"))


RUNS = f"""
v AS ({views.ORDER_LOG}), h AS (SELECT line_no, regexp_extract(line, '^[ \\t|]*([^ \\t|\\n]+)', 1) AS val FROM v),
r AS (SELECT line_no, val, regexp_extract_all(val, '[0-9]+|[^0-9]+') AS runs FROM h),
u AS (SELECT line_no, i - 1 AS place, runs[i] AS part FROM r, LATERAL (SELECT unnest(range(1, len(r.runs) + 1)) AS i) x)
"""


def order_runs(spark, sf_dir) -> DataFrame:
    o = views.order_log(spark, sf_dir)
    return o.select("line_no", F.posexplode(header.runs(F.get(header.split_head(F.col("line"), 1)["values"], F.lit(0)))).alias("place", "part"))


@query(f"WITH {RUNS} SELECT CAST(place AS INT) AS place, CASE WHEN regexp_matches(part, '^[0-9]') THEN '%d' ELSE part END AS piece, count(*) AS n FROM u GROUP BY 1, 2")
def head_run_format(spark, sf_dir):
    return order_runs(spark, sf_dir).groupBy("place", F.when(F.col("part").rlike("^[0-9]"), "%d").otherwise(F.col("part")).alias("piece")).agg(F.count("*").alias("n"))


WIDTHS = f"{RUNS}, w AS (SELECT CAST(place AS INT) AS place, CAST(length(part) AS INT) AS width, count(*) AS n FROM u WHERE regexp_matches(part, '^[0-9]') GROUP BY 1, 2)"


def _widths(spark, sf_dir) -> DataFrame:
    return order_runs(spark, sf_dir).where(F.col("part").rlike("^[0-9]")).groupBy("place", F.length("part").alias("width")).agg(F.count("*").alias("n"))


@query(f"WITH {WIDTHS} SELECT place, width, n FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY n DESC, width) AS k FROM w) x WHERE k = 1")
def head_width_mode(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("place").orderBy(F.desc("n"), "width"))
    return _widths(spark, sf_dir).withColumn("k", nth).where("k = 1").drop("k")


@query(f"WITH {WIDTHS} SELECT place, width, round(n / sum(n) OVER (PARTITION BY place), 4) AS share, n / sum(n) OVER (PARTITION BY place) >= 0.95 AS fixed FROM w")
def head_share(spark, sf_dir):
    share = F.col("n") / F.sum("n").over(W.partitionBy("place"))
    return _widths(spark, sf_dir).select("place", "width", F.round(share, 4).alias("share"), (share >= 0.95).alias("fixed"))


#: Event lines with faults by event_id: an empty line, a header of another width, a header alone.
FAULTY = f"""
v AS (SELECT line_no, CASE WHEN line_no % 97 = 0 THEN '' WHEN line_no % 97 = 1 THEN substr(line, 3) WHEN line_no % 97 = 2 THEN substr(line, 1, 23) || ' LEVEL' ELSE line END AS line FROM ({views.EVENT_LOG}) x)
"""
TIMED = "^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
CLOCK = "^([0-9]{2}):([0-9]{2}):([0-9]{2}),([0-9]{3})$"
SLOTS = [header.Slot((4, "-", 2, "-", 2)), header.Slot((2, ":", 2, ":", 2, ",", 3)), header.Slot(None)]


def faulty(spark, sf_dir) -> DataFrame:
    n = F.col("line_no") % 97
    line = F.when(n == 0, "").when(n == 1, F.substring("line", 3, 1_000)).when(n == 2, F.concat(F.substring("line", 1, 23), F.lit(" LEVEL"))).otherwise(F.col("line"))
    return views.event_log(spark, sf_dir).withColumn("line", line)


@query(
    f"""WITH {FAULTY}, h AS (SELECT line_no, regexp_extract_all(regexp_extract(line, '^([ \\t|]*(?:[^ \\t|\\n]+[ \\t|]*){{3}})', 1), '[^ \\t|\\n]+') AS x FROM v)
    SELECT line_no, CAST(regexp_extract(x[1], '{TIMED}', 1) AS BIGINT) AS y, CAST(regexp_extract(x[1], '{TIMED}', 3) AS BIGINT) AS d,
           CAST(regexp_extract(x[2], '{CLOCK}', 4) AS BIGINT) AS ms FROM h WHERE len(x) = 3 AND regexp_matches(x[1], '{TIMED}') AND regexp_matches(x[2], '{CLOCK}')"""
)
def head_typed_parse(spark, sf_dir):
    p = faulty(spark, sf_dir).withColumn("head", header.split_head(F.col("line"), 3)).where(F.col("head.content").isNotNull())
    date, clock = [header.parse_slot(F.get(F.col("head.values"), F.lit(i)), SLOTS[i]) for i in (0, 1)]
    p = p.select("line_no", date.alias("a"), clock.alias("b")).where("a is not null and b is not null")
    return p.select("line_no", F.get("a", F.lit(0)).alias("y"), F.get("a", F.lit(2)).alias("d"), F.get("b", F.lit(3)).alias("ms"))


@query(
    f"""WITH {FAULTY}, h AS (SELECT line, regexp_extract(line, '^([ \\t|]*(?:[^ \\t|\\n]+[ \\t|]*){{3}})', 1) AS head FROM v),
    x AS (SELECT *, regexp_extract_all(head, '[^ \\t|\\n]+') AS x FROM h)
    SELECT CASE WHEN length(line) = 0 THEN 'load_failed:empty' WHEN head = '' OR NOT regexp_matches(x[1], '{TIMED}') OR NOT regexp_matches(x[2], '{CLOCK}') THEN 'load_failed:wrong_format'
                WHEN length(line) = length(head) THEN 'load_failed:no_content' ELSE 'ok' END AS status, count(*) AS n FROM x GROUP BY 1"""
)
def fail_reason_counts(spark, sf_dir):
    framed = framing.frame(pipeline.as_blocks(faulty(spark, sf_dir), EVENTS), pipeline.KEYS, EVENTS)
    return header.with_head(framed, 3).withColumn("status", header.head_status(SLOTS, EVENTS)).groupBy("status").agg(F.count("*").alias("n"))


#: The same with a NUL in some lines, and some that are longer than LIMITED allows.
LIMITED = LogConfig(head_slots=3, block_lines=2_000, max_chars=200)
LIMITS = f"{FAULTY}, g AS (SELECT line_no, CASE WHEN line_no % 97 = 3 THEN line || chr(0) WHEN line_no % 97 = 4 THEN line || repeat('x', 300) ELSE line END AS line FROM v)"


@query(
    f"""WITH {LIMITS}, h AS (SELECT line_no, line, regexp_extract(line, '^([ \\t|]*(?:[^ \\t|\\n]+[ \\t|]*){{3}})', 1) AS head FROM g),
    x AS (SELECT *, regexp_extract_all(head, '[^ \\t|\\n]+') AS x FROM h)
    SELECT line_no, CASE WHEN length(line) = 0 THEN 'load_failed:empty' WHEN strpos(line, chr(0)) > 0 THEN 'load_failed:bad_char' WHEN length(line) > 200 THEN 'load_failed:too_long'
                WHEN head = '' OR NOT regexp_matches(x[1], '{TIMED}') OR NOT regexp_matches(x[2], '{CLOCK}') THEN 'load_failed:wrong_format'
                WHEN length(line) = length(head) THEN 'load_failed:no_content' ELSE 'ok' END AS status FROM x"""
)
def load_failures(spark, sf_dir):
    n, line = F.col("line_no") % 97, F.col("line")
    lines = faulty(spark, sf_dir).withColumn("line", F.when(n == 3, F.concat(line, F.lit("\x00"))).when(n == 4, F.concat(line, F.lit("x" * 300))).otherwise(line))
    framed = framing.frame(lines, ["line_no"], LIMITED)
    return header.with_head(framed, 3).withColumn("status", header.head_status(SLOTS, LIMITED)).select("line_no", "status")


# ---- tokens


@query(f"WITH l AS ({views.DOC_LINES}) SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '{TOKEN}'))) AS BIGINT) AS n_tokens FROM l GROUP BY 1")
def token_counts(spark, sf_dir):
    return views.doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.size(tk.tokens(F.col("line")))).cast("long").alias("n_tokens"))


@query(f"WITH p AS (SELECT page_id, regexp_extract_all(html, '{TOKEN}') AS toks FROM pages), m AS (SELECT page_id, {MASKED} AS m FROM p) SELECT page_id, CAST(len(m) AS BIGINT) AS n, CAST(len(list_filter(m, lambda t: t = '<*>')) AS BIGINT) AS masked FROM m")
def token_masking(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", tk.mask(tk.tokens(F.col("html"))).alias("m"))
    return p.select("page_id", F.size("m").cast("long").alias("n"), F.size(F.filter("m", lambda t: t == tk.WILD)).cast("long").alias("masked"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) >= 2046 AS too_many FROM documents")
def too_many_tokens(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", (F.size(tk.tokens(F.col("text"))) >= LogConfig().max_tokens).alias("too_many"))


# ---- match

#: Templates that cover user= k= cents= id= lines of two kinds, by hand: the second never wins where the first fits.
CONTENT = ["user", "=", "<*>", " ", "k", "=", "<*>", " ", "cents", "=", "<*>", " ", "id", "=", "<*>"]
FIXED = [(1, 1, [*CONTENT[:6], "7", *CONTENT[7:]], 2), (2, 2, [*CONTENT[:6], "42", *CONTENT[7:]], 2), (3, 3, [*CONTENT[:6], "7", *CONTENT[7:]], 2)]
WIDE = [(1, 1, [*CONTENT[:6], "7", *CONTENT[7:]], 2), (2, 2, CONTENT, 2)]


def matched_events(spark, sf_dir, templates) -> DataFrame:
    p = event_tokens(spark, sf_dir).withColumn("status", F.lit("ok"))
    return matching.match(p, matching.template_table(spark, templates), EVENTS)


SHAPED = f"WITH {EVENT_PARTS}, s AS (SELECT *, toks[3] AS u, toks[7] AS k, toks[11] AS c, toks[15] AS i FROM t)"


@query(f"{SHAPED} SELECT line_no, CASE WHEN k = '7' THEN 1 WHEN k = '42' THEN 2 ELSE 0 END AS eid FROM s")
def template_match(spark, sf_dir):
    return matched_events(spark, sf_dir, FIXED).select("line_no", "eid")


@query(f"{SHAPED} SELECT line_no, line FROM s WHERE k NOT IN ('7', '42')")
def match_failed(spark, sf_dir):
    return matched_events(spark, sf_dir, FIXED).where("eid = 0").select("line_no", "line")


@query(f"{SHAPED} SELECT CASE WHEN k = '7' THEN 1 ELSE 2 END AS eid, count(*) AS n FROM s GROUP BY 1")
def template_usage(spark, sf_dir):
    return matching.usage(matched_events(spark, sf_dir, WIDE))


@query(f"{SHAPED} SELECT DISTINCT CASE WHEN k = '7' THEN 1 WHEN k = '42' THEN 2 ELSE 0 END AS eid FROM s")
def event_ids(spark, sf_dir):
    return matched_events(spark, sf_dir, FIXED).select("eid").distinct()


@query(f"{SHAPED} SELECT line_no, 'user=<*> k=' || CASE WHEN k = '7' THEN '7' ELSE '<*>' END || ' cents=<*> id=<*>' AS merged, round((4 + CASE WHEN k = '7' THEN 1 ELSE 0 END) / 15.0::DOUBLE, 4) AS likeness FROM s")
def template_merge(spark, sf_dir):
    template = F.lit(FIXED[0][2])
    e = event_tokens(spark, sf_dir)
    return e.select("line_no", F.array_join(tk.merge(template, F.col("toks")), "").alias("merged"), F.round(tk.distance(template, F.col("toks")), 4).alias("likeness"))


@query(f"{SHAPED} SELECT line_no, array_to_string(toks, '') AS content FROM s WHERE k <> '7'")
def record_rebuild(spark, sf_dir):
    m = matched_events(spark, sf_dir, WIDE).where("eid = 2")
    return m.select("line_no", tk.rebuild(F.lit(CONTENT), F.col("vars")).alias("content"))


@query(f"{SHAPED} SELECT block_id, line_no, CASE WHEN k IN ('7', '42') THEN 'matched' ELSE 'match' END AS stream, line FROM s")
def stream_merge(spark, sf_dir):
    m = matched_events(spark, sf_dir, FIXED)
    good = m.where("eid > 0").select("block_id", "line_no", F.lit("matched").alias("stream"), "line")
    return good.unionByName(m.where("eid = 0").select("block_id", "line_no", F.lit("match").alias("stream"), "line"))


# ---- variables


@query(
    f"""{SHAPED} SELECT line_no, CASE WHEN k = '7' THEN 1 ELSE 2 END AS eid, x.pos, x.value FROM s,
    LATERAL (SELECT unnest(CASE WHEN k = '7' THEN [0, 1, 2] ELSE [0, 1, 2, 3] END) AS pos, unnest(CASE WHEN k = '7' THEN [u, c, i] ELSE [u, k, c, i] END) AS value) x"""
)
def variable_extract(spark, sf_dir):
    m = matched_events(spark, sf_dir, WIDE)
    return m.select("line_no", "eid", F.posexplode("vars").alias("pos", "value"))


PROFILED = f"""{SHAPED}, v AS (SELECT line_no, CASE WHEN k = '7' THEN 1 ELSE 2 END AS eid, x.pos, x.value FROM s,
LATERAL (SELECT unnest(CASE WHEN k = '7' THEN [0, 1, 2] ELSE [0, 1, 2, 3] END) AS pos, unnest(CASE WHEN k = '7' THEN [u, c, i] ELSE [u, k, c, i] END) AS value) x),
q AS (SELECT eid, pos, CASE WHEN bool_and(CASE WHEN regexp_matches(value, '^(0|[1-9][0-9]{{0,9}})$') THEN CAST(value AS BIGINT) < 2147483648 ELSE false END) THEN 'num' ELSE 'str' END AS kind,
      count(DISTINCT value) AS n_distinct FROM v GROUP BY 1, 2)"""


def profiled(spark, sf_dir) -> DataFrame:
    m = matched_events(spark, sf_dir, WIDE).withColumnRenamed("line_no", "rec_id")
    return variables.profile(variables.long_form(m, ["block_id"]))


@query(f"{PROFILED} SELECT eid, pos, kind FROM q")
def variable_types(spark, sf_dir):
    return profiled(spark, sf_dir).select("eid", "pos", "kind")


@query(f"{PROFILED} SELECT eid, pos, n_distinct FROM q")
def variable_ndv(spark, sf_dir):
    return profiled(spark, sf_dir).select("eid", "pos", "n_distinct")


RANKED = f"{PROFILED}, o AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY n_distinct, pos) AS rank, floor(count(*) OVER (PARTITION BY eid) * (1 - 0.8::DOUBLE)) + 1 AS fixed FROM q)"


@query(f"{RANKED} SELECT eid, pos, CAST(rank AS INT) AS rank, rank > fixed AS is_op FROM o")
def op_split(spark, sf_dir):
    return variables.roles(profiled(spark, sf_dir)).select("eid", "pos", "rank", "is_op")


@query(f"{RANKED} SELECT eid, pos, CAST(nth AS INT) AS nth FROM (SELECT eid, pos, row_number() OVER (PARTITION BY eid ORDER BY pos) AS nth FROM o WHERE rank > fixed AND kind = 'str') x WHERE nth <= 3")
def id_columns(spark, sf_dir):
    return variables.identifiers(variables.roles(profiled(spark, sf_dir)))


#: Order lines of priorities in one word: two string variables, of which the one that varies more can be an identifier.
ORDER_TEMPLATE = ["<*>", " ", "order", "=", "<*>", " ", "cust", "=", "<*>", " ", "status", "=", "<*>"]
ORDER_VALUES = f"""WITH o AS ({views.ORDER_LOG}), p AS (SELECT line_no, regexp_extract_all(regexp_extract(line, '^[^ ]+ (.*)$', 1), '{TOKEN}') AS toks FROM o),
v AS (SELECT line_no, x.pos, x.value FROM p, LATERAL (SELECT unnest([0, 1, 2, 3]) AS pos, unnest([toks[1], toks[5], toks[9], toks[13]]) AS value) x WHERE len(toks) = 13),
q AS (SELECT pos, CASE WHEN bool_and(CASE WHEN regexp_matches(value, '^(0|[1-9][0-9]{{0,9}})$') THEN CAST(value AS BIGINT) < 2147483648 ELSE false END) THEN 'num' ELSE 'str' END AS kind,
      count(DISTINCT value) AS n_distinct FROM v GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n_distinct, pos) AS rank, floor(count(*) OVER () * (1 - 0.8::DOUBLE)) + 1 AS fixed FROM q)"""


def order_variables(spark, sf_dir) -> DataFrame:
    o = views.order_log(spark, sf_dir).withColumn("toks", tk.tokens(header.split_head(F.col("line"), 1)["content"])).withColumn("status", F.lit("ok"))
    matched = matching.match(o, matching.template_table(spark, [(1, 1, ORDER_TEMPLATE, 2)]), ORDERS).withColumnRenamed("line_no", "rec_id")
    return variables.roles(variables.profile(variables.long_form(matched, [])))


@query(f"{ORDER_VALUES} SELECT 1 AS eid, pos, kind, n_distinct, CAST(rank AS INT) AS rank, rank > fixed AS is_op FROM r")
def order_roles(spark, sf_dir):
    return order_variables(spark, sf_dir)


@query(f"{ORDER_VALUES} SELECT 1 AS eid, pos, CAST(row_number() OVER (ORDER BY pos) AS INT) AS nth FROM r WHERE rank > fixed AND kind = 'str' QUALIFY nth <= 3")
def order_identifiers(spark, sf_dir):
    return variables.identifiers(order_variables(spark, sf_dir))


# ---- deltas

BLOCK, ORDER = ["block_id"], list(views.ITEM_ORDER)
ITEMS = f"i AS ({views.ITEM_VALUES})"
SORT = ", ".join(ORDER)
_SQL = "WITH {items} SELECT block_id, {cols}, CAST(coalesce({e}, price) AS BIGINT) AS d FROM i WINDOW w AS (PARTITION BY {part} ORDER BY {sort})"


def _delta(name: str, forward: bool, ident: bool) -> None:
    keys = [*BLOCK, "supp"] if ident else BLOCK
    e = "lead(price) OVER w - price" if forward else "price - lag(price) OVER w"
    make, undo = (deltas.forward, deltas.undo_forward) if forward else (deltas.backward, deltas.undo_backward)

    def plain(spark, sf_dir):
        return views.item_values(spark, sf_dir).select("block_id", *ORDER, make("price", keys, ORDER).alias("d"))

    def inverse(spark, sf_dir):
        made = views.item_values(spark, sf_dir).withColumn("d", make("price", keys, ORDER))
        return made.select("block_id", *ORDER, undo("d", keys, ORDER).cast("long").alias("back"))

    QUERIES[name], QUERIES[f"{name}_inverse"] = plain, inverse
    ORACLE_SQL[name] = _SQL.format(items=ITEMS, cols=SORT, e=e, part=", ".join(keys), sort=SORT)
    ORACLE_SQL[f"{name}_inverse"] = f"WITH {ITEMS} SELECT block_id, {SORT}, price AS back FROM i"


for _name, _forward, _ident in (("delta_do", False, False), ("delta_up", True, False), ("delta_doi", False, True), ("delta_upi", True, True)):
    _delta(_name, _forward, _ident)


# ---- entropy and candidates

VALUES = ["part", "supp", "qty", "price"]
TOTAL = "CAST(sum(c) AS BIGINT) AS n, round(sum(c) * ln(sum(c)) - sum(c * ln(c)), 4) AS entropy"


def _unpivot(pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS candidate, {e} AS v FROM i" for k, e in pairs)


def _entropy_sql(pairs: list[tuple[str, str]]) -> str:
    return f"WITH {ITEMS}, x AS ({_unpivot(pairs)}), y AS (SELECT candidate, v, count(*) AS c FROM x GROUP BY 1, 2) SELECT candidate, {TOTAL} FROM y GROUP BY 1"


_SINGLE = [(c, c) for c in VALUES]
_PAIR = [(f"{a}-{b}", f"{a} - {b}") for i, b in enumerate(VALUES) for a in VALUES[i + 1 :]]
_TRIPLE = [(f"{c}-{b}-{a}", f"{c} - {b} - {a}") for i, a in enumerate(VALUES) for b in VALUES[i + 1 :] for c in VALUES if c not in (a, b)]


def _entropy(spark, sf_dir, pairs) -> DataFrame:
    return rules.entropies(views.item_values(spark, sf_dir), {k: F.expr(e) for k, e in pairs})


@query(_entropy_sql(_SINGLE))
def entropy_single(spark, sf_dir):
    return _entropy(spark, sf_dir, _SINGLE)


@query(_entropy_sql(_PAIR))
def entropy_pair(spark, sf_dir):
    return _entropy(spark, sf_dir, _PAIR)


@query(_entropy_sql(_TRIPLE))
def entropy_triple(spark, sf_dir):
    return _entropy(spark, sf_dir, _TRIPLE)


@query(f"SELECT candidate, entropy FROM ({_entropy_sql(_SINGLE + _PAIR)}) z ORDER BY entropy, candidate LIMIT 1")
def best_candidate(spark, sf_dir):
    return _entropy(spark, sf_dir, _SINGLE + _PAIR).orderBy("entropy", "candidate").limit(1).select("candidate", "entropy")


FORMS = [(n, f.base, f.ident) for n, f in enumerate(rules.all_forms(VALUES, ["supp_id", "part_id"]))]
_FORMS_SQL = "f(code, base, ident) AS (VALUES " + ", ".join(f"({n}, '{b}', '{i}')" for n, b, i in FORMS) + ")"


def _forms(spark) -> DataFrame:
    return spark.createDataFrame(FORMS, "code int, base string, ident string")


@query(f"WITH {_FORMS_SQL} SELECT a.code AS c1, b.code AS c2 FROM f a, f b WHERE a.code > b.code AND a.base <> b.base AND (a.ident = b.ident OR a.ident = '' OR b.ident = '')")
def candidate_pairs(spark, sf_dir):
    return rules.catalog(_forms(spark))


@query(
    f"""WITH {_FORMS_SQL} SELECT a.code AS c1, b.code AS c2, c.code AS c3 FROM f a, f b, f c
    WHERE b.code > c.code AND a.base <> b.base AND a.base <> c.base AND b.base <> c.base AND a.ident = b.ident AND b.ident = c.ident"""
)
def candidate_triples(spark, sf_dir):
    return rules.catalog_triples(_forms(spark))


def _item_rules(spark, sf_dir) -> list[tuple[str, rules.Candidate]]:
    plain = rules.all_forms(VALUES)
    rows = views.item_values(spark, sf_dir)
    for c in VALUES:
        rows = rows.withColumn(f"{c}_do", deltas.backward(c, BLOCK, ORDER)).withColumn(f"{c}_up", deltas.forward(c, BLOCK, ORDER))
    candidates: list[rules.Candidate] = [(f,) for f in plain] + rules.pairs(plain)
    ends = views.item_values(spark, sf_dir).agg(*[f(c).alias(f"{c}_{n}") for c in VALUES for n, f in (("low", F.min), ("high", F.max))]).first()
    bounds = [rules.bounds_of(f, ends[f"{f.base}_low"] or 0, ends[f"{f.base}_high"] or 0) for f in plain]
    place = {f: i for i, f in enumerate(plain)}
    found = rules.entropies_in_buckets(rows, [f.name for f in plain], bounds, [tuple(place[f] for f in c) for c in candidates])
    return rules.greedy(VALUES, {candidates[r["candidate"]]: r["entropy"] for r in found.collect()})


@query()
def greedy_rules(spark, sf_dir):
    chosen = [(i, new, "-".join(f.name for f in c)) for i, (new, c) in enumerate(_item_rules(spark, sf_dir))]
    return spark.createDataFrame(chosen, "step int, new string, rule string")


@query("SELECT * FROM (VALUES ('part'), ('price'), ('qty'), ('supp')) v(new)")
def rules_spanning(spark, sf_dir):
    return greedy_rules(spark, sf_dir).select("new").distinct()


# ---- codecs

SIGNED = f"WITH {ITEMS}, s AS (SELECT o1, o2, part, supp, price, part - supp * 300 AS n FROM i), z AS (SELECT *, CASE WHEN n < 0 THEN -2 * n - 1 ELSE 2 * n END AS zz FROM s)"
LENGTH = "CASE " + " ".join(f"WHEN zz < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"
_COLS = "o1, o2, part, supp, price"


def signed(spark, sf_dir) -> DataFrame:
    return views.item_values(spark, sf_dir).select("o1", "o2", "part", "supp", "price", (F.col("part") - F.col("supp") * 300).alias("n"))


@query(f"{SIGNED} SELECT {_COLS}, n, zz AS z, n AS back FROM z")
def zigzag_values(spark, sf_dir):
    s = signed(spark, sf_dir).withColumn("z", codec.zigzag(F.col("n")))
    return s.withColumn("back", codec.unzigzag(F.col("z")))


@query(f"{SIGNED} SELECT {LENGTH} AS bytes, count(*) AS n FROM z GROUP BY 1")
def varint_lengths(spark, sf_dir):
    return signed(spark, sf_dir).groupBy(codec.varint_length(codec.zigzag(F.col("n"))).alias("bytes")).agg(F.count("*").alias("n"))


@query(
    f"""{SIGNED} SELECT {_COLS}, list_aggregate(list_transform(range(0, {LENGTH}),
    lambda k: printf('%02X', ((zz >> (7 * k)) & 127) + CASE WHEN k < ({LENGTH}) - 1 THEN 128 ELSE 0 END)), 'string_agg', '') AS hex FROM z"""
)
def varint_bytes(spark, sf_dir):
    return signed(spark, sf_dir).select("o1", "o2", "part", "supp", "price", codec.varint_hex(codec.zigzag(F.col("n"))).alias("hex"))


@query(f"{SIGNED} SELECT count(*) AS n, CAST(count(*) FILTER (n < 0) AS BIGINT) AS negatives, CAST(sum(abs(n)) FILTER (n < 0) AS BIGINT) AS magnitude FROM z")
def positive_split(spark, sf_dir):
    low = F.col("n") < 0
    return signed(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(low).alias("negatives"), F.sum(F.when(low, F.abs("n"))).cast("long").alias("magnitude"))


@query(f"{SIGNED} SELECT CAST(sum(length(CAST(n AS VARCHAR)) + 1) AS BIGINT) AS text_bytes, CAST(sum({LENGTH}) AS BIGINT) AS varint_bytes FROM z")
def text_lengths(spark, sf_dir):
    z = codec.varint_length(codec.zigzag(F.col("n")))
    return signed(spark, sf_dir).agg(F.sum(F.length(F.col("n").cast("string")) + 1).cast("long").alias("text_bytes"), F.sum(z).cast("long").alias("varint_bytes"))


DICTIONARY = f"""v AS ({views.ORDER_LOG}), p AS (SELECT CAST(floor(line_no / 2000) AS BIGINT) AS block_id, line_no, regexp_extract(line, '^[^ ]+ ([^ ]+)', 1) AS val FROM v),
d AS (SELECT block_id, val, CAST(row_number() OVER (PARTITION BY block_id ORDER BY first) - 1 AS INT) AS dict_id FROM (SELECT block_id, val, min(line_no) AS first FROM p GROUP BY 1, 2) x)"""


def _dictionary(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = sources.with_blocks(views.order_log(spark, sf_dir), 2_000).select("block_id", "line_no", F.regexp_extract("line", "^[^ ]+ ([^ ]+)", 1).alias("val"))
    return p, variables.dictionary(p, BLOCK, "val", "line_no")


@query(f"WITH {DICTIONARY} SELECT block_id, val, dict_id FROM d")
def header_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir)[1]


@query(f"WITH {DICTIONARY} SELECT p.line_no, d.dict_id FROM p JOIN d USING (block_id, val)")
def dictionary_lookup(spark, sf_dir):
    rows, d = _dictionary(spark, sf_dir)
    return rows.join(d, ["block_id", "val"]).select("line_no", "dict_id")


# ---- cursors, fallbacks


@query(f"{SHAPED} SELECT line_no, block_id, CASE WHEN k = '7' THEN 1 ELSE 2 END AS eid, row_number() OVER (PARTITION BY block_id, k = '7' ORDER BY line_no) AS nth FROM s")
def template_cursor(spark, sf_dir):
    m = matched_events(spark, sf_dir, WIDE)
    return m.select("line_no", "block_id", "eid", F.row_number().over(W.partitionBy("block_id", "eid").orderBy("line_no")).cast("long").alias("nth"))


@query(f"{SHAPED} SELECT block_id, CASE WHEN k = '7' THEN 1 ELSE 2 END AS eid, count(*) AS n, count(*) < 600 AS bypass FROM s GROUP BY 1, 2")
def small_group_fallback(spark, sf_dir):
    m = matched_events(spark, sf_dir, WIDE).withColumnRenamed("line_no", "rec_id")
    return variables.small_groups(variables.long_form(m, BLOCK), BLOCK, 600)


@query(f"WITH {EVENT_PARTS}, m AS (SELECT array_to_string({MASKED}, '') AS template, min(line_no) AS first, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1) SELECT CAST(row_number() OVER (ORDER BY first) AS INT) AS eid, template, n AS train_count FROM m")
def template_table(spark, sf_dir):
    found = matching.masked_templates(event_records(spark, sf_dir))
    return Model([], found).metadata(spark).select("eid", F.col("text").alias("template"), "train_count")


@query()
def tree_miner_templates(spark, sf_dir):
    found = mining.tree_templates(event_records(spark, sf_dir), EVENTS)
    return Model([], found).metadata(spark)


# ---- whole pipeline


def _trip(lines: DataFrame, config: LogConfig, miner: str = "mask") -> DataFrame:
    model = pipeline.train(lines, config, miner, sample=False)
    return pipeline.restore(pipeline.compress(lines, model, config), model, config)


@query(f"SELECT line_no, line FROM ({views.EVENT_LOG}) x")
def roundtrip_single(spark, sf_dir):
    return _trip(views.event_log(spark, sf_dir), EVENTS).select("line_no", "line")


@query(f"SELECT line_no, line FROM ({views.EVENT_LOG}) x")
def roundtrip_rules(spark, sf_dir):
    config = LogConfig(head_slots=3, block_lines=2_000, level="N", codec="P")
    return _trip(views.event_log(spark, sf_dir), config, "tree").select("line_no", "line")


@query(f"SELECT doc_id, line_no, line FROM ({views.DOC_LINES}) x")
def roundtrip_multi(spark, sf_dir):
    config = LogConfig(head_slots=0, boundary=DOCS.boundary)
    lines = views.doc_lines(spark, sf_dir).select(F.lit("").alias("file"), F.col("doc_id").alias("block_id"), "line_no", "line", F.lit(True).alias("final_newline"))
    model = pipeline.train(lines, config, "mask", sample=False)
    return pipeline.restore(pipeline.compress(lines, model, config), model, config).select(F.col("block_id").alias("doc_id"), "line_no", "line")


@query()
def compression_ratio(spark, sf_dir):
    lines = views.event_log(spark, sf_dir)
    model = pipeline.train(lines, EVENTS, "mask", sample=False)
    encoded = pipeline.compress(lines, model, EVENTS, archive=True)
    return pipeline.metrics(lines, encoded, pipeline.parse(lines, model, EVENTS))


@query(f"WITH {EVENT_PARTS} SELECT regexp_extract(line, '^[^ ]+ [^ ]+ ([^ ]+)', 1) AS level, count(*) AS n, CAST(sum(CAST(toks[11] AS BIGINT)) AS BIGINT) AS cents FROM t GROUP BY 1")
def parsed_log_query(spark, sf_dir):
    lines = views.event_log(spark, sf_dir)
    parsed = pipeline.parse(lines, Model(SLOTS, WIDE[1:]), EVENTS)
    return parsed.groupBy(F.get("head.values", F.lit(2)).alias("level")).agg(F.count("*").alias("n"), F.sum(F.element_at("vars", 3).cast("bigint")).cast("long").alias("cents"))
