"""The engine's operators over the tables at hand, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import text as T
from quire.operators import ancestors, sequences
from quire.operators.render import BUILT_IN
from quire.plans import package_queries  # noqa: F401  registers its own
from quire.plans.registry import ORACLES, QUERIES, query, read  # noqa: F401  QUERIES and ORACLES hold what is registered
from quire.sources import packages


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_seq", "text"))


_BLOCKS = """(SELECT doc_id, CAST(i - 1 AS INT) AS block_seq, l[i] AS text FROM
  (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"""


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(noisy, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), ' +', ' ', 'g'), '^\n+', ''), '[\n ]+$', '') AS clean
FROM (SELECT doc_id, chr(10) || replace(replace(text, ' ', '  '), chr(10), chr(13) || chr(10) || chr(9)) || ' ' || chr(10) AS noisy FROM documents)
""")
def ws_normalize(spark, sf_dir):
    noisy = F.concat(F.lit("\n"), F.replace(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit("\r\n\t")), F.lit(" \n"))
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(noisy).alias("clean"))


@query(r"""
SELECT conv_id, turn, replace(replace(replace(replace(regexp_replace(noisy, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{84}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN chr(1) || text || '<a href="x">&amp;' || chr(127) ELSE text || chr(11) || '&' END AS noisy FROM conversations)
""")
def xml_escape_strip(spark, sf_dir):
    c = F.col("text")
    noisy = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\x01"), c, F.lit('<a href="x">&amp;\x7f'))).otherwise(F.concat(c, F.lit("\x0b&")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.xml_escape(noisy).alias("escaped"))


@query(f"SELECT * FROM {_BLOCKS}")
def line_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(f"SELECT doc_id, block_seq, CASE WHEN strlen(text) > 60 THEN 0 ELSE 1 END AS level, CAST(strlen(text) AS BIGINT) AS n_bytes FROM {_BLOCKS}")
def heading_demotion(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    level = T.demoted(T.heading_level(F.lit("Heading1")), F.col("text"), F.lit("left"))
    return b.select("doc_id", "block_seq", level.alias("level"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"""
SELECT doc_id, block_seq, (trim(noisy) = '' OR starts_with(trim(noisy), '--------') OR starts_with(trim(noisy), '------ ')) AS is_break FROM
(SELECT doc_id, block_seq, CASE block_seq % 5 WHEN 1 THEN '  ' WHEN 2 THEN '---------' || text WHEN 3 THEN ' ------ ' || text WHEN 4 THEN '-----' ELSE text END AS noisy FROM {_BLOCKS})
""")
def section_break_flags(spark, sf_dir):
    b, k = _blocks(spark, sf_dir), F.col("block_seq") % 5
    noisy = F.when(k == 1, "  ").when(k == 2, F.concat(F.lit("---------"), "text")).when(k == 3, F.concat(F.lit(" ------ "), "text")).when(k == 4, "-----").otherwise(F.col("text"))
    return b.select("doc_id", "block_seq", T.is_section_break(noisy, F.lit(0), F.lit(True)).alias("is_break"))


_FORMATS = "CASE role WHEN 'user' THEN 'decimalZero' WHEN 'assistant' THEN 'lowerLetter' ELSE 'decimal' END"


@query(f"""
SELECT conv_id, turn, role, n + 2 AS counter, CASE {_FORMATS} WHEN 'decimalZero' THEN printf('%02d', n + 2) WHEN 'decimal' THEN CAST(n + 2 AS VARCHAR)
  ELSE CASE WHEN n + 2 <= 26 THEN chr(CAST(96 + n + 2 AS INT)) ELSE chr(CAST(96 + (n + 1) // 26 AS INT)) || chr(CAST(97 + (n + 1) % 26 AS INT)) END END AS marker
FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
""")
def list_counters(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    counted = c.withColumn("counter", sequences.running_counter(["conv_id", "role"], ["turn"], F.lit(3)))
    fmt = F.when(F.col("role") == "user", "decimalZero").when(F.col("role") == "assistant", "lowerLetter").otherwise("decimal")
    return counted.select("conv_id", "turn", "role", F.col("counter").cast("long"), N.counter_text(F.col("counter"), fmt).alias("marker"))


@query("""
SELECT conv_id, turn, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM
(SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
""")
def list_islands(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return sequences.islands(c, ["conv_id"], ["turn"], "role").select("conv_id", "turn", "island")


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'error' THEN 'stop' WHEN event_type IN ('purchase', 'signup') THEN event_type END AS ev FROM events)
SELECT event_id, coalesce(first_value(ev IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 51 FOLLOWING) = 'purchase', false) AS ahead FROM e
""")
def lookahead_50(spark, sf_dir):
    e, kind = read(spark, sf_dir, "events"), F.col("event_type")
    ahead = sequences.same_ahead(["user_id"], ["ts"], F.when(kind.isin("purchase", "signup"), kind), kind == "error", F.lit("purchase"))
    return e.select("event_id", ahead.alias("ahead"))


@query("""
SELECT conv_id, turn, CASE WHEN level = 0 THEN CAST(greatest(c0, 1) AS VARCHAR) || '.' ELSE CAST(greatest(c0, 1) AS VARCHAR) || '.' || printf('%02d', greatest(c1, 1)) || ')' END AS marker FROM
(SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS level,
  count(*) FILTER (role = 'user') OVER w AS c0, count(*) FILTER (role <> 'user') OVER w AS c1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
""")
def multi_level_marker(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    level = F.when(F.col("role") == "user", 0).otherwise(1)
    counts = [F.sum((level == k).cast("int")).over(w) for k in (0, 1)]
    c = c.select("conv_id", "turn", F.when(level == 0, "%1.").otherwise("%1.%2)").alias("template"), *(n.alias(f"c{k + 1}") for k, n in enumerate(counts)))
    part = lambda s: F.when(s["level"] == 0, s["text"]).when(s["level"] == 1, N.counter_text(F.col("c1"), F.lit("decimal"))).otherwise(N.counter_text(F.col("c2"), F.lit("decimalZero")))
    return c.select("conv_id", "turn", F.array_join(F.transform(N.template_segments(F.col("template")), part), "").alias("marker"))


@query("""
WITH RECURSIVE units(v, s, k) AS (VALUES (1000,'m',1),(900,'cm',2),(500,'d',3),(400,'cd',4),(100,'c',5),(90,'xc',6),(50,'l',7),(40,'xl',8),(10,'x',9),(9,'ix',10),(5,'v',11),(4,'iv',12),(1,'i',13)),
r(size, rest, s) AS (SELECT DISTINCT p_size, p_size, '' FROM part UNION ALL
  SELECT size, rest - (SELECT max(v) FROM units WHERE v <= rest), s || (SELECT arg_max(units.s, v) FROM units WHERE v <= rest) FROM r WHERE rest > 0),
done AS (SELECT size, s FROM r WHERE rest = 0)
SELECT p_partkey, s AS lower_roman, upper(s) AS upper_roman, CASE WHEN p_size <= 26 THEN chr(96 + p_size) ELSE chr(96 + (p_size - 1) // 26) || chr(97 + (p_size - 1) % 26) END AS letter FROM part JOIN done ON p_size = size
""")
def roman_alpha(spark, sf_dir):
    n = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", N.counter_text(n, F.lit("lowerRoman")).alias("lower_roman"), N.counter_text(n, F.lit("upperRoman")).alias("upper_roman"), N.counter_text(n, F.lit("lowerLetter")).alias("letter"))


@query(r"""
SELECT t.k, r.r_regionkey, array_to_string(regexp_extract_all(t.s, '%(\d+)', 1), ',') AS levels, regexp_replace(t.s, '%\d+', '', 'g') AS literals
FROM (VALUES (1, '%1.'), (2, '(%1)'), (3, '%1.%2'), (4, 'plain'), (5, 'a%10b%3')) t(k, s), region r
""")
def lvltext_segments(spark, sf_dir):
    regions = read(spark, sf_dir, "region")
    templates = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(("%1.", "(%1)", "%1.%2", "plain", "a%10b%3"), 1)]))
    t = regions.select("r_regionkey", templates.alias("t")).select(F.col("t.k").alias("k"), "r_regionkey", N.template_segments(F.col("t.s")).alias("segments"))
    levels = F.array_join(F.transform(F.filter("segments", lambda s: s["level"] > 0), lambda s: s["level"].cast("string")), ",")
    return t.select("k", "r_regionkey", levels.alias("levels"), F.array_join(F.col("segments.text"), "").alias("literals"))


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS id, p_partkey // 2 AS parent, p_size > 25 AS defines FROM part),
walk(id, here, depth, path) AS (SELECT id, id, 0, [id] FROM n UNION ALL
  SELECT w.id, n.parent, w.depth + 1, list_append(w.path, n.parent) FROM walk w JOIN n ON n.id = w.here WHERE NOT n.defines AND NOT list_contains(w.path, n.parent))
SELECT n.id AS p_partkey, f.here AS found, f.depth AS depth FROM n LEFT JOIN (SELECT w.id, w.here, w.depth FROM walk w JOIN n ON n.id = w.here WHERE n.defines) f ON f.id = n.id
""")
def style_chain_nearest(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(F.lit(0).alias("doc"), "p_partkey", F.floor(F.col("p_partkey") / 2).alias("parent"), (F.col("p_size") > 25).alias("defines"))
    return ancestors.nearest(n, "p_partkey", "parent", "defines", ["doc"]).select("p_partkey", "found", "depth")


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, f.font) AS font FROM part
LEFT JOIN (VALUES ('ECONOMY', 'Calibri'), ('LARGE', 'Cambria'), ('MEDIUM', 'Arial')) f(kind, font) ON split_part(p_type, ' ', 1) = f.kind
""")
def theme_font_coalesce(spark, sf_dir):
    fonts = F.create_map(*[F.lit(x) for x in ("ECONOMY", "Calibri", "LARGE", "Cambria", "MEDIUM", "Arial")])
    own, word = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.split("p_type", " ")[0]
    # half of the fonts come by the second name of each pair
    odd = F.col("p_size") % 2 == 1
    font = T.resolved_font(F.when(odd, own), F.when(~odd, own), F.when(odd, word).otherwise(""), F.when(~odd, word), fonts)
    return read(spark, sf_dir, "part").select("p_partkey", font.alias("font"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 7 AS pos, o_orderkey % 2 = 1 AS direct, CASE WHEN o_orderkey % 5 = 0 THEN 'clear' ELSE 'left' END AS align FROM orders),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, pos ORDER BY direct DESC, o_orderkey DESC) AS n FROM s) WHERE n = 1)
SELECT o_custkey, string_agg(CAST(pos AS VARCHAR) || ':' || align, ' ' ORDER BY pos) AS stops FROM last WHERE NOT (direct AND align = 'clear') GROUP BY o_custkey
""")
def tab_overlay(spark, sf_dir):
    key = F.col("o_orderkey")
    stops = read(spark, sf_dir, "orders").select("o_custkey", key, (key % 7).alias("pos"), (key % 2 == 1).alias("direct"), F.when(key % 5 == 0, "clear").otherwise("left").alias("align"))
    kept = sequences.tab_overlay(stops, ["o_custkey"], "pos", "direct", "o_orderkey", "align")
    listed = kept.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("pos", "align"))).alias("a"))
    return listed.select("o_custkey", F.array_join(F.transform("a", lambda t: F.concat(t["pos"].cast("string"), F.lit(":"), t["align"])), " ").alias("stops"))


@query("""
WITH g AS (SELECT event_id, user_id, ts, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM events)
SELECT event_id, event_type = 'view' AND grp > 0 AS omitted,
  CASE WHEN event_type = 'signup' AND c > 0 THEN c + 1 WHEN event_type = 'view' AND grp = 0 THEN 2 END AS row_span
FROM (SELECT *, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id, grp) AS c FROM g)
""")
def vmerge_rowspan(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    return sequences.merge_groups(e, ["user_id"], ["ts"], kind == "signup", kind == "view").select("event_id", "omitted", "row_span")


@query("""
SELECT conv_id, turn, CAST(coalesce(sum(greatest(length(text) % 4, 1)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grid_col FROM conversations
""")
def grid_column(spark, sf_dir):
    column = sequences.grid_column(["conv_id"], ["turn"], F.length("text") % 4)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", column.cast("long").alias("grid_col"))


_PAGES = ", ".join(f"('{n}', {w}, {h})" for n, w, h in N.PAGES)


@query(f"""
SELECT o_orderkey, p.name AS preset FROM (SELECT o_orderkey, CAST(floor(w / 1440.0::DOUBLE * 72) AS INT) AS w, CAST(floor(h / 1440.0::DOUBLE * 72) AS INT) AS h FROM
  (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 11906 WHEN 1 THEN 15840 WHEN 2 THEN 12240 ELSE 10000 END AS w, CASE o_orderkey % 4 WHEN 0 THEN 16838 WHEN 1 THEN 12240 WHEN 2 THEN 20160 ELSE 10000 END AS h FROM orders)) s
LEFT JOIN (VALUES {_PAGES}) p(name, a, b) ON (s.w = p.a AND s.h = p.b) OR (s.w = p.b AND s.h = p.a)
""")
def page_preset(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    w = F.when(k == 0, 11906).when(k == 1, 15840).when(k == 2, 12240).otherwise(10000)
    h = F.when(k == 0, 16838).when(k == 1, 12240).when(k == 2, 20160).otherwise(10000)
    return read(spark, sf_dir, "orders").select("o_orderkey", N.page_preset(w, h).alias("preset"))


@query("""
SELECT l_returnflag, l_linestatus, x.inch, x.pt, count(*) AS n FROM lineitem,
LATERAL (SELECT printf('%.6f', CAST(l_quantity AS INT) / 1440.0::DOUBLE) AS inch, rtrim(rtrim(printf('%.6f', CAST(l_quantity AS INT) / 2.0::DOUBLE), '0'), '.') AS pt) x GROUP BY ALL
""")
def twips_format(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", N.fixed6(N.inches(q)).alias("inch"), N.points(q / F.lit(2.0)).alias("pt"))
    return rows.groupBy("l_returnflag", "l_linestatus", "inch", "pt").agg(F.count(F.lit(1)).alias("n"))


_SIDE = "printf('%.6f', p_size / 576.0::DOUBLE)"


@query(f"""
SELECT p_partkey, CASE WHEN style = 'none' THEN '' ELSE 'bt ' || {_SIDE} || ' ' || code || '1 #' || p_brand || '; bb ' || {_SIDE} || ' ' || code || '0 #auto' END AS border FROM
(SELECT *, CASE style WHEN 'double' THEN 'd' WHEN 'dotted' THEN 'dt' WHEN 'dashSmallGap' THEN 'ds' WHEN 'none' THEN 'n' ELSE 's' END AS code FROM
  (SELECT *, CASE p_size % 6 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'dotted' WHEN 3 THEN 'dashSmallGap' WHEN 4 THEN 'none' ELSE 'wave' END AS style FROM part))
""")
def border_attr(spark, sf_dir):
    k = F.col("p_size") % 6
    style = F.when(k == 0, "single").when(k == 1, "double").when(k == 2, "dotted").when(k == 3, "dashSmallGap").when(k == 4, "none").otherwise("wave")
    sides = N.border_side("bt", style, F.col("p_size"), F.lit(1), F.col("p_brand")), N.border_side("bb", style, F.col("p_size"), F.lit(0), F.lit("auto"))
    return read(spark, sf_dir, "part").select("p_partkey", N.border_attribute(*sides).alias("border"))


@query(r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '#s' || page_id WHEN 2 THEN '#s' || page_id ELSE url END AS target FROM pages
""")
def hyperlink_field(spark, sf_dir):
    k, url, anchor = F.col("page_id") % 4, F.col("url"), F.concat(F.lit("s"), F.col("page_id").cast("string"))
    instruction = (
        F.when(k == 0, F.concat(F.lit(' HYPERLINK "'), url, F.lit('" \\o "tip" ')))
        .when(k == 1, F.concat(F.lit('HYPERLINK "'), url, F.lit('" \\l "'), anchor, F.lit('"')))
        .when(k == 2, F.concat(F.lit('HYPERLINK \\l "'), anchor, F.lit('"')))
        .otherwise(F.concat(F.lit("HYPERLINK "), url, F.lit(' \\t "_blank"')))
    )
    return read(spark, sf_dir, "pages").select("page_id", T.hyperlink_target(instruction).alias("target"))


@query(r"""
SELECT page_id, href, CASE WHEN regexp_matches(href, '^(https?://|mailto:)') THEN href ELSE 'word/' || href END AS target, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages UNION ALL SELECT page_id, url FROM pages) GROUP BY ALL
""")
def link_resolve(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).unionByName(pages.select("page_id", F.col("url").alias("href")))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n")).withColumn("target", T.resolved_target(F.col("href")))


@query("""
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_ts, event_type) AS doc_order FROM
(SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL)
""")
def notes_order(spark, sf_dir):
    first = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))
    return first.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first_ts", "event_type")).cast("long").alias("doc_order"))


@query("SELECT user_id, event_type, arg_min(event_id, ts) AS event_id FROM events GROUP BY ALL")
def ordered_dedup(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return sequences.first_occurrences(e, ["user_id"], ["event_type"], ["ts"]).select("user_id", "event_type", "event_id")


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.from_texts(read(spark, sf_dir, "documents"))


@query(f"SELECT * FROM {_BLOCKS}")
def docx_roundtrip(spark, sf_dir):
    return packages.blocks(_packages(spark, sf_dir)).select("doc_id", "block_seq", "text")


@query(f"SELECT doc_id, 1 AS heading_level, block_seq, text FROM {_BLOCKS} WHERE block_seq = 0 AND strlen(text) <= 60")
def document_outline(spark, sf_dir):
    return packages.blocks(_packages(spark, sf_dir)).where("heading_level > 0").select("doc_id", "heading_level", "block_seq", "text")


@query(rf"""
SELECT doc_id, '<words xmlns="urn:words:v1" xmlns:s="urn:words:v1:style" version="1.2.0" mode="lossless" fidelity="verbatim" policy="preserve-and-flag">' || chr(10) ||
  '  <style unit="in">' || chr(10) || '    <s:custom name="heading 1" type="paragraph"/>' || chr(10) || '  </style>' || chr(10) || '  <write>' || chr(10) ||
  string_agg('    <' || tag || CASE WHEN block_seq = 0 AND tag = 'p' THEN ' c="heading 1"' ELSE '' END || '>' || escaped || '</' || tag || '>' || chr(10), '' ORDER BY block_seq) ||
  '  </write>' || chr(10) || '</words>' || chr(10) AS words_xml
FROM (SELECT doc_id, block_seq, CASE WHEN block_seq = 0 AND strlen(text) <= 60 THEN 'h1' ELSE 'p' END AS tag,
  replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM {_BLOCKS}) GROUP BY doc_id
""".replace("    <s:custom name=\"heading 1\" type=\"paragraph\"/>' || chr(10) || '", ""))
def words_render(spark, sf_dir):
    return packages.rendered(_packages(spark, sf_dir), "lossless").select("doc_id", "words_xml")


@query("SELECT doc_id, true AS valid, CAST(0 AS INT) AS n_errors, CAST(0 AS INT) AS n_warns FROM documents")
def words_verify(spark, sf_dir):
    checked = packages.verified(packages.rendered(_packages(spark, sf_dir)))
    return checked.select("doc_id", "valid", F.size("errors").alias("n_errors"), F.size("warns").alias("n_warns"))


@query("SELECT conv_id AS doc_id, CAST(n - 2 AS INT) AS item, '(' || printf('%02d', n) || ')' AS marker FROM (SELECT conv_id, 1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)")
def docx_list_markers(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    out = packages.rendered(packages.from_items(turns.select("doc_id", F.col("t.text").alias("texts"))))
    marks = F.regexp_extract_all("words_xml", F.lit('<li marker="([^"]*)">'), F.lit(1))
    return out.select("doc_id", F.posexplode(marks).alias("item", "marker"))


@query("""
WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, o_orderkey, o_orderkey % 3 + 1 AS span, o_orderkey % 2 = 0 AS restart FROM orders),
g AS (SELECT *, sum(CASE WHEN restart THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY r ROWS UNBOUNDED PRECEDING) AS grp FROM o),
s AS (SELECT *, count(*) FILTER (NOT restart) OVER (PARTITION BY o_custkey, grp) AS below FROM g)
SELECT o_custkey AS doc_id, CAST(r AS INT) AS row_idx, 0 AS cell_idx, 0 AS grid_col, CAST(CASE WHEN restart AND below > 0 THEN below + 1 WHEN NOT restart AND grp = 0 THEN 2 ELSE 0 END AS INT) AS row_span,
  NOT restart AND grp > 0 AS omitted, 'm' AS text FROM s
UNION ALL SELECT o_custkey, CAST(r AS INT), 1, 1, 0, false, CAST(o_orderkey AS VARCHAR) FROM o
UNION ALL SELECT o_custkey, CAST(r AS INT), 2, CAST(1 + span AS INT), 0, false, 'end' FROM o
""")
def docx_table_cells(spark, sf_dir):
    def cell(text, span, merge):
        return F.struct(text.alias("text"), span.cast("int").alias("span"), merge.alias("merge"))

    key, none = F.col("o_orderkey"), F.lit("none")
    row = F.array(cell(F.lit("m"), F.lit(1), F.when(key % 2 == 0, "restart").otherwise("continue")), cell(key.cast("string"), key % 3 + 1, none), cell(F.lit("end"), F.lit(1), none))
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("r"))
    out = packages.cells(packages.from_rows(orders.select("doc_id", F.col("r.row").alias("rows"))))
    return out.select("doc_id", "row_idx", "cell_idx", "grid_col", "row_span", "omitted", "text")


@query("""
WITH f AS (SELECT user_id, CAST(strlen(event_type) AS INT) AS id, min(ts) AS first_ts FROM events GROUP BY ALL)
SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_ts) - 1 AS INT) AS note_seq, id, 'note ' || id AS text FROM f
""")
def docx_notes_order(spark, sf_dir):
    events = read(spark, sf_dir, "events").groupBy("user_id", F.octet_length("event_type").alias("id")).agg(F.min("ts").alias("first_ts"))
    noted = events.groupBy(F.col("user_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("first_ts", "id"))).alias("n"))
    return packages.notes(packages.from_notes(noted.select("doc_id", F.col("n.id").alias("ids")))).select("doc_id", "note_seq", "id", "text")


@query("SELECT doc_id, 'parse' AS stage, doc_id % 3 = 0 AS is_empty FROM documents WHERE doc_id % 3 < 2")
def docx_errors(spark, sf_dir):
    k = F.col("doc_id") % 3
    spoilt = _packages(spark, sf_dir).select("doc_id", F.when(k == 0, F.lit(b"")).when(k == 1, F.substring("content", 1, 40)).otherwise(F.col("content")).alias("content"))
    return packages.errors(spoilt).select("doc_id", "stage", (F.col("doc_id") % 3 == 0).alias("is_empty"))


@query("SELECT source, arg_min(lang, doc_id) FILTER (lang IS NOT NULL AND lang <> '') AS lang FROM documents GROUP BY source")
def lang_first_value(spark, sf_dir):
    return sequences.first_filled(read(spark, sf_dir, "documents"), ["source"], "doc_id", "lang").select("source", "lang")


@query("""
WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL), usual AS (SELECT source, arg_max(lang, (n, lang)) AS lang FROM n GROUP BY source)
SELECT doc_id, CASE WHEN d.lang IS DISTINCT FROM u.lang THEN d.lang END AS lang FROM documents d LEFT JOIN usual u ON u.source IS NOT DISTINCT FROM d.source
""")
def span_suppression(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    counted = d.where("lang is not null").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    usual = counted.groupBy(F.col("source").alias("of")).agg(F.max_by("lang", F.struct("n", "lang")).alias("usual"))
    joined = d.join(F.broadcast(usual), d["source"].eqNullSafe(F.col("of")), "left")  # one row for each source
    return joined.select("doc_id", T.unless(F.col("lang"), F.col("usual")).alias("lang"))


@query("""
SELECT r_regionkey, 0 AS block, 0 AS seq, r_name AS line FROM region
UNION ALL SELECT n_regionkey, 1, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT), n_name FROM nation
UNION ALL SELECT n_regionkey, 2, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS INT), s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def style_union(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    regions = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_regionkey").alias("at"), F.col("r_name").alias("line"))
    nations = nation.select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("at"), F.col("n_name").alias("line"))
    suppliers = read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"), F.col("s_suppkey").alias("at"), F.col("s_name").alias("line"))
    return sequences.stacked(["r_regionkey"], "at", regions, nations, suppliers)


_BUILT_IN = ", ".join(f"'{x}'" for x in sorted(BUILT_IN))


@query(f"""
SELECT p_partkey, id FROM (SELECT p_partkey, CASE WHEN p_size <= 9 THEN 'Heading' || p_size WHEN p_size <= 20 THEN 'Caption' WHEN p_size <= 30 THEN 'My' || p_size ELSE p_brand END AS id,
  CASE WHEN p_size % 7 = 0 THEN 'Normal' WHEN p_size % 7 = 1 THEN '' ELSE p_type END AS name FROM part) WHERE id NOT IN ({_BUILT_IN}) AND name NOT IN ('Normal', 'Default Paragraph Font')
""")
def builtin_style_anti(spark, sf_dir):
    z = F.col("p_size")
    style_id = F.when(z <= 9, F.concat(F.lit("Heading"), z.cast("string"))).when(z <= 20, "Caption").when(z <= 30, F.concat(F.lit("My"), z.cast("string"))).otherwise(F.col("p_brand"))
    name = F.when(z % 7 == 0, "Normal").when(z % 7 == 1, "").otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", style_id.alias("id"), name.alias("name")).where(T.is_custom_style(F.col("id"), F.col("name"))).select("p_partkey", "id")


@query("""
WITH t AS (SELECT r_regionkey AS region, NULL AS nation, NULL AS customer FROM region UNION ALL SELECT n_regionkey, n_nationkey, NULL FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CAST(region AS BIGINT) AS region, CAST(coalesce(nation, -1) AS BIGINT) AS nation, CAST(coalesce(customer, -1) AS BIGINT) AS customer, CAST(row_number() OVER (PARTITION BY region ORDER BY nation NULLS FIRST, customer NULLS FIRST) AS INT) AS id FROM t
""")
def preorder_ids(spark, sf_dir):
    nation, none = read(spark, sf_dir, "nation"), F.lit(None).cast("long")
    within = [F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("nation")]
    customers = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(*within, F.col("c_custkey").cast("long").alias("customer"))
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("region"), none.alias("nation"), none.alias("customer"))
    nodes = regions.unionByName(nation.select(*within, none.alias("customer"))).unionByName(customers)
    return sequences.preorder_ids(nodes, ["region"], ["nation", "customer"]).fillna(-1, ["nation", "customer"])
