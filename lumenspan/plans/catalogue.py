"""Queries over the parquet tables, one for each relational operator, each with SQL that a second engine can run.

Every query runs over its whole tables. Limits appear only where the operator is one (top-k, a page of a poll).
"""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.functions import flow, layout
from lumenspan.functions.code import Source, functions
from lumenspan.functions.regex import bounded, glob_to_regex
from lumenspan.operators import components as connected
from lumenspan.operators import flows, graph, program, relate, search, windows
from lumenspan.operators.store import remove, shared_dir, stored
from lumenspan.session import shipped
from lumenspan.sources import blame
from lumenspan.sources import files as source
from lumenspan.streaming import source as streamed
from lumenspan.streaming import state as keyed
from lumenspan.streaming import watch

from . import lenses, views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = shipped(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.to_lines(_table(spark, sf_dir, "documents"), "doc_id")


SQL_LINES = """l AS (SELECT doc_id, unnest(a) AS line_text, unnest(range(1, len(a) + 1))::BIGINT AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"""
THE, OF = bounded("the"), bounded("of")
ENTRY_PATTERNS = [("article", THE), ("key", r"(token|secret)[ ]*[:=]"), ("preposition", OF)]
# Kinds and labels of markers, in order; the first that fits tells a line's effect.
MARKERS = [("secret", "assignment", r"(token|secret|password)[ ]*[:=]"), ("contact", "mail", r"[a-z]+@[a-z]+"), ("markup", "table", r" [|] "), ("text", "article", THE)]


@query(f"WITH {SQL_LINES} SELECT doc_id, line, line_text FROM l")
def lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"WITH {SQL_LINES} SELECT doc_id, line, line_text FROM l WHERE regexp_matches(line_text, '{THE}')")
def references(spark, sf_dir):
    return search.grep(_lines(spark, sf_dir), THE)


_HITS = " UNION ALL ".join(f"SELECT doc_id, line, {i}::BIGINT AS ord, '{label}' AS label FROM l WHERE regexp_matches(line_text, '{regex}')" for i, (label, regex) in enumerate(ENTRY_PATTERNS))


@query(f"WITH {SQL_LINES} {_HITS}")
def entrypoints(spark, sf_dir):
    return search.labelled_hits(_lines(spark, sf_dir), ENTRY_PATTERNS).select("doc_id", "line", "ord", "label")


@query(r"""WITH l AS (SELECT page_id, unnest(a) AS line_text, unnest(range(1, len(a) + 1))::BIGINT AS line FROM (SELECT page_id, string_split(html, '>') AS a FROM pages))
SELECT page_id, line FROM l WHERE regexp_matches(line_text, '[A-Za-z0-9_.$]*track[A-Za-z0-9_.$]*[ ]*\(')""")
def exitpoints(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.translate("html", "\n>", " \n").alias("text"))
    return search.grep(search.to_lines(pages, "page_id"), glob_to_regex("*track*") + r"[ ]*\(").select("page_id", "line")


_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(line_text, '{regex}') THEN '{kind}'" for kind, _, regex in MARKERS) + " END"


@query(f"WITH {SQL_LINES}, k AS (SELECT {_FIRST} AS kind FROM l) SELECT kind, count(*)::BIGINT AS n FROM k WHERE kind IS NOT NULL GROUP BY kind")
def side_effects(spark, sf_dir):
    hit = search.first_match(F.col("line_text"), MARKERS)
    return _lines(spark, sf_dir).select(hit.alias("hit")).where("hit is not null").groupBy(F.col("hit.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_ALL = " UNION ".join(f"SELECT doc_id, '{kind}' AS kind FROM l WHERE regexp_matches(line_text, '{regex}')" for kind, _, regex in MARKERS)


@query(f"WITH {SQL_LINES}, k AS ({_ALL}) SELECT doc_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM k GROUP BY doc_id")
def effect_kinds(spark, sf_dir):
    return search.kinds_by(_lines(spark, sf_dir), ["doc_id"], MARKERS)


TARGETS = r"(?:for|to|by|with)[ ]+([a-z_][a-z0-9_.]*)"


@query(f"SELECT t AS target, count(*)::BIGINT AS refs FROM (SELECT unnest(regexp_extract_all(lower(text), '{TARGETS}', 1)) AS t FROM documents) GROUP BY t")
def sql_tables(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.lower("text").alias("line_text"))
    return search.captures(docs, TARGETS, "target").groupBy("target").agg(F.count(F.lit(1)).alias("refs"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges made of a stream: each event's user calls the user of the event before; self-calls are no edges."""
    events = windows.previous(_table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", "user_id", "before")
    return events.where("before is not null and before <> user_id").select(F.col("user_id").alias("caller"), F.col("before").alias("callee"))


SQL_CALLS = "e AS (SELECT user_id AS caller, lag(user_id) OVER (ORDER BY event_id) AS callee FROM events), c AS (SELECT * FROM e WHERE callee IS NOT NULL AND callee <> caller)"


@query(f"WITH {SQL_CALLS} SELECT callee, count(*)::BIGINT AS sites, count(DISTINCT caller)::BIGINT AS callers FROM c GROUP BY callee")
def callers(spark, sf_dir):
    return program.caller_counts(_calls(spark, sf_dir))


SEED_USER = 8


@query(f"""WITH RECURSIVE {SQL_CALLS}, d AS (SELECT DISTINCT caller, callee FROM c), r AS (SELECT {SEED_USER}::BIGINT AS node, 0::BIGINT AS depth UNION SELECT caller, depth + 1 FROM r JOIN d ON callee = node WHERE depth < 12)
SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY node HAVING min(depth) > 0""")
def impact_set(spark, sf_dir):
    return graph.impact_set(_calls(spark, sf_dir), spark.createDataFrame([(SEED_USER,)], "node long"))


def _keys(spark: SparkSession, sf_dir: str, back: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Customers from 1 on, and edges from each to those of twice its key and one more, and to one further up, which closes cycles."""
    nodes = _table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").cast("long").alias("node"), "c_mktsegment", "c_nationkey")
    to = [F.col("node") * 2, F.col("node") * 2 + 1, *([back] if back is not None else [])]
    edges = nodes.select(F.col("node").alias("src"), F.explode(F.array(*to)).alias("dst"))
    return nodes, edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def _keys_sql(back: str) -> str:
    return f"""n AS (SELECT c_custkey::BIGINT AS k, c_mktsegment = 'BUILDING' AND c_nationkey = 7 AS chosen FROM customer WHERE c_custkey > 0),
e AS (SELECT DISTINCT a.k AS src, b.k AS dst FROM (SELECT k, unnest([2 * k, 2 * k + 1, {back}]) AS t FROM n) a JOIN n b ON b.k = a.t)"""


CHOSEN = "c_mktsegment = 'BUILDING' AND c_nationkey = 7"


@query(f"""WITH RECURSIVE {_keys_sql("k // 3")},
r AS (SELECT 1::BIGINT AS node, [1::BIGINT] AS p, false AS done UNION ALL SELECT dst, list_append(p, dst), chosen FROM r JOIN e ON src = node JOIN n ON k = dst WHERE NOT done AND len(p) < 13 AND NOT list_contains(p, dst))
SELECT '/' || array_to_string(p, '/') || '/' AS path FROM (SELECT p FROM r WHERE done ORDER BY len(p), p LIMIT 12)""")
def trace_paths(spark, sf_dir):
    """The twelve shortest ways, over a graph with cycles, to customers chosen by their columns; no bound on hops."""
    nodes, edges = _keys(spark, sf_dir, F.expr("node div 3"))
    found = graph.simple_paths(edges, spark.createDataFrame([(1,)], "node long"), ends=nodes.where(CHOSEN), most=12)
    return found.select(F.concat(F.lit("/"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/"), F.lit("/")).alias("path"))


@query("""WITH RECURSIVE m AS (SELECT c_custkey::BIGINT AS k, c_nationkey AS a, c_mktsegment = 'BUILDING' AND c_nationkey = 7 AS chosen FROM customer WHERE c_custkey > 0),
w AS (SELECT 4 * k AS src, 4 * k + 1 AS dst FROM m WHERE a % 5 <> 0 UNION ALL SELECT 4 * k + 1, 4 * k + 3 FROM m WHERE a % 3 = 0 UNION ALL SELECT 4 * k + 2, 4 * k + 3 FROM m WHERE a % 2 = 0),
s AS (SELECT k // 2 AS p, k AS site FROM m WHERE k // 2 IN (SELECT k FROM m)),
e AS (SELECT src, dst, 0::BIGINT AS push, 0::BIGINT AS pop FROM w UNION ALL SELECT 4 * p + 1, 4 * site, site, 0 FROM s UNION ALL SELECT 4 * site + 3, 4 * p + 2, 0, site FROM s),
r AS (SELECT 4 * k + 1 AS node, []::BIGINT[] AS stack FROM m WHERE chosen UNION
  SELECT dst, CASE WHEN push > 0 THEN list_append(stack, push) WHEN pop > 0 AND len(stack) > 0 THEN stack[1:len(stack) - 1] ELSE stack END FROM r JOIN e ON src = node WHERE pop = 0 OR len(stack) = 0 OR stack[len(stack)] = pop)
SELECT DISTINCT node FROM r""")
def matched_flow(spark, sf_dir):
    """Customers as methods: each calls those of twice its key and one more, with a local value, and gets results back. What chosen
    locals flow into, where a return only goes back to the site whose call was entered."""
    m = _keys(spark, sf_dir)[0].select("node", F.col("c_nationkey").alias("a"), F.expr(CHOSEN).alias("chosen"))
    at = lambda k, c="node": F.col(c) * 4 + k  # noqa: E731  (parameter, local, result of calls, return)
    edge = lambda test, a, b: m.where(test).select(at(a).alias("src"), at(b).alias("dst"))
    within = edge("a % 5 <> 0", 0, 1).union(edge("a % 3 = 0", 1, 3)).union(edge("a % 2 = 0", 2, 3))
    sites = m.select(F.col("node").alias("site"), F.expr("node div 2").alias("p")).join(m.select(F.col("node").alias("p")), "p", "left_semi")
    calls = sites.select("site", at(1, "p").alias("src"), at(0, "site").alias("dst"))
    returns = sites.select("site", at(3, "site").alias("src"), at(2, "p").alias("dst"))
    return flows.matched_reach(within, calls, returns, m.where("chosen").select(at(1).alias("node"))).select("node")


@query(f"""WITH RECURSIVE {_keys_sql("CASE WHEN k = 2 THEN 1 END")}, r AS (SELECT src AS start, dst AS node, 1::BIGINT AS depth FROM e UNION SELECT start, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 40)
SELECT start, node, min(depth)::BIGINT AS depth FROM r GROUP BY start, node""")
def subtype_closure(spark, sf_dir):
    """All pairs below each other in a tree that has one cycle at its top."""
    return graph.closure(_keys(spark, sf_dir, F.expr("CASE WHEN node = 2 THEN 1L END"))[1]).select("start", "node", "depth")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn opens a span that ends before the next one."""
    talk = _table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("start"))
    return talk.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("conv_id").orderBy("start")) - 1, F.lit(1 << 40)))


SQL_SPANS = "s AS (SELECT conv_id, turn AS start, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, 1099511627776) AS stop FROM conversations WHERE role = 'user')"


@query(f"WITH {SQL_SPANS} SELECT c.conv_id, c.turn, s.start FROM conversations c JOIN s ON c.conv_id = s.conv_id AND c.turn BETWEEN s.start AND s.stop")
def span_join(spark, sf_dir):
    points = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return relate.span_join(points, _spans(spark, sf_dir), ["conv_id"], "turn").select("conv_id", "turn", "start")


@query("""WITH s AS (SELECT conv_id, turn AS start FROM conversations WHERE role = 'user')
SELECT c.conv_id, c.turn, max(s.start) AS start FROM conversations c JOIN s ON c.conv_id = s.conv_id AND c.turn >= s.start GROUP BY c.conv_id, c.turn""")
def innermost(spark, sf_dir):
    points = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    spans = _table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("start"), F.lit(1 << 40).alias("end"))
    return relate.innermost(points, spans, ["conv_id"], "turn").select("conv_id", "turn", "start")


@query("""WITH o AS (SELECT doc_id, substr(sha1(text), 1, 12) AS h FROM documents WHERE lang <> 'es'),
n AS (SELECT doc_id, substr(sha1(CASE WHEN n_chars % 7 = 0 THEN text || '~' ELSE text END), 1, 12) AS h FROM documents WHERE lang <> 'fr')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""")
def manifest_diff(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    digest = lambda t: F.substring(F.sha1(t), 1, 12).alias("digest")
    old = docs.where("lang <> 'es'").select("doc_id", digest(F.col("text")))
    new = docs.where("lang <> 'fr'").select("doc_id", digest(F.when(F.col("n_chars") % 7 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))))
    return relate.manifest_diff(old, new, "doc_id", "digest")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 1000")
def watch_poll(spark, sf_dir):
    return watch.page(_table(spark, sf_dir, "events"), "event_id", 500, 1000).select("event_id", "user_id", "event_type")


@query("""SELECT event_type, count(*)::BIGINT AS n, max(event_id)::BIGINT AS last_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 600 MINUTE GROUP BY event_type""")
def watch_window(spark, sf_dir):
    kept = watch.arrived(_table(spark, sf_dir, "events").select("ts", "event_type", "event_id"), "ts", "600 MINUTE")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query("""SELECT event_type, count(*)::BIGINT AS n, min(event_id)::BIGINT AS first_id, max(event_id)::BIGINT AS last_id, (SELECT max(event_id) FROM events)::BIGINT AS mark FROM events WHERE event_id > 0 GROUP BY event_type""")
def watch_stream(spark, sf_dir):
    """Two rounds of the streaming source with its keyed state, the second of which re-reads ids and finds nothing new; then its window. Marks begin at 0."""
    events = streamed.Table("dev", "shop", "events", f"{sf_dir}/events.parquet", "event_id", "all")
    to = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(remove, spark, to)
    for _ in range(2):
        changes = keyed.keyed_window(streamed.follow(spark, events, grace=1000), minutes=600, grace=1000, buckets=8)
        keyed.start(changes, f"{to}/changes", f"{to}/checkpoint", availableNow=True).awaitTermination()
    rows = keyed.current(keyed.changes_in(spark, f"{to}/changes"))
    kind = F.element_at("values", F.array_position("columns", F.lit("event_type")).cast("int"))
    return rows.groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("mark").alias("mark"))


@query("SELECT coalesce(max(event_id), 0)::BIGINT AS last_id FROM events")
def watch_mark(spark, sf_dir):
    return watch.mark(_table(spark, sf_dir, "events"), "event_id")


def _blame(rows: DataFrame, key: str, author: Column, when: Column, order: Column, code: Column) -> DataFrame:
    """Lines (key, commit, author, date, line, code) of blame output made of rows, a source line for each."""
    shown = F.array(F.concat(F.sha1(author), F.lit(" 1 "), order.cast("string")), F.concat(F.lit("author "), author), F.concat(F.lit("author-time "), when.cast("string")), F.concat(F.lit("\t"), code))
    return blame.lines_of(rows.select(key, F.posexplode(shown).alias("p", "s"), order.alias("o")).select(key, (F.col("o") * 4 + F.col("p")).alias("n"), "s"), key)


@query(r"""WITH n AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3], ' ') AS name FROM benchmark UNION SELECT DISTINCT regexp_extract(url, '://[^/]*(/[^/?#]*/)', 1) FROM pages
  UNION SELECT DISTINCT source || '-' || lang FROM documents UNION SELECT DISTINCT regexp_extract(text, '[^\x20-\x7E\s][A-Za-z]+|, [a-z]+ ') FROM documents),
t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, html FROM pages)
SELECT name, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM t JOIN n ON name <> '' AND regexp_matches(text, '\b' || regexp_escape(name) || '\b') GROUP BY name""")
def names_in_texts(spark, sf_dir):
    """Names with spaces, slashes, hyphens, commas and letters outside ASCII, between word boundaries of documents and pages."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    first = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    names = _table(spark, sf_dir, "benchmark").select(first.alias("name")).union(pages.select(F.regexp_extract("url", "://[^/]*(/[^/?#]*/)", 1)))
    names = names.union(docs.select(F.concat_ws("-", "source", "lang"))).union(docs.select(F.regexp_extract("text", r"[^\x20-\x7E\s][A-Za-z]+|, [a-z]+ ", 0)))
    texts = docs.select(F.col("doc_id").alias("id"), "text").union(pages.select(-1 - F.col("page_id"), "html"))
    return search.names_in(texts, names).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("SELECT role AS author, count(*)::BIGINT AS n FROM conversations GROUP BY role")
def blame_authors(spark, sf_dir):
    found = _blame(_table(spark, sf_dir, "conversations"), "conv_id", F.col("role"), F.lit(1_700_000_000), F.col("turn") + 1, F.regexp_replace("text", "\n", " "))
    return blame.lines_by_author(found)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def blame_carry(spark, sf_dir):
    talk = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return windows.carry_forward(talk, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "asked")


@query(f"""WITH {SQL_LINES} SELECT doc_id, line, coalesce(sum(length(line_text) - length(replace(line_text, ',', '')) - length(line_text) + length(replace(line_text, '.', ''))) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS depth FROM l""")
def guard_depth(spark, sf_dir):
    count = lambda c: F.length("line_text") - F.length(F.replace(F.col("line_text"), F.lit(c), F.lit("")))
    return windows.running_depth(_lines(spark, sf_dir), ["doc_id"], count(","), count(".")).select("doc_id", "line", "depth")


@query(f"WITH {SQL_LINES} SELECT doc_id, line, max(CASE WHEN regexp_matches(line_text, '{OF}') THEN line END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS near FROM l")
def lookback8(spark, sf_dir):
    return windows.look_back(_lines(spark, sf_dir), ["doc_id"], F.col("line_text").rlike(OF), 8, "near").select("doc_id", "line", "near")


@query("""SELECT n_name AS repo, coalesce(CASE WHEN r_regionkey < 3 THEN lower(r_name) END, lower(replace(n_name, 'NATION', 'table'))) AS target, CASE WHEN r_regionkey < 3 THEN 'mapped' ELSE 'guessed' END AS note FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def db_chain(spark, sf_dir):
    region = _table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    guess = F.lower(F.replace(F.col("n_name"), F.lit("NATION"), F.lit("table")))
    return relate.left_with_default(_table(spark, sf_dir, "nation"), region, "n_regionkey", F.lower("r_name"), guess, "target", "note", "mapped", "guessed").select(F.col("n_name").alias("repo"), "target", "note")


def _java(rows: DataFrame, repo: Column, path: Column, text: Column) -> DataFrame:
    """Java files made of rows."""
    made = rows.select(repo.alias("repo"), path.alias("path"), F.lit(".java").alias("ext"), F.lit("java").alias("lang"), F.lit(False).alias("is_test"), text.alias("text"))
    return made.select("repo", "path", "ext", "lang", "is_test", F.substring(F.sha1("text"), 1, 12).alias("content_hash"), "text")


@query("""WITH e AS (SELECT DISTINCT c.c_nationkey AS a, s.s_nationkey AS b FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey WHERE c.c_nationkey <> s.s_nationkey)
SELECT x.n_name AS src, y.n_name AS dst, x.n_regionkey <> y.n_regionkey AS crosses FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b""")
def service_graph(spark, sf_dir):
    """Nations are classes, in a repository for each region; one calls another if its customers order from suppliers there."""
    t = lambda n: _table(spark, sf_dir, n)
    uses = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    uses = uses.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a")), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b")), "l_suppkey")
    nation = t("nation").select("n_nationkey", F.concat(F.lit("Nation"), "n_nationkey").alias("type"), F.concat(F.lit("region"), "n_regionkey").alias("repo"), "n_name")
    called = uses.where("a <> b").select("a", "b").distinct().groupBy(F.col("a").alias("n_nationkey")).agg(F.array_sort(F.collect_set("b")).alias("bs"))
    each = lambda shape: F.array_join(F.transform(F.coalesce("bs", F.array().cast("array<long>")), lambda b: F.format_string(shape, b, b)), "")
    text = F.concat(F.lit("class "), "type", F.lit(" {\n"), each("  private Nation%d n%d;\n"), F.lit("  void order() {\n"), each("    n%d.order(); // %d\n"), F.lit("  }\n}\n"))
    files = _java(nation.join(called, "n_nationkey", "left"), F.col("repo"), F.concat("type", F.lit(".java")), text)
    parsed, found = stored(source.parsed(files)), source.lines(files).select("repo", "path", "lang", "line", "text")
    edges = program.type_graph(parsed, found.where("path like '%.sql'"), found)[1].where("kind = 'api-call'")
    end = lambda k, name: nation.select(F.concat_ws("::", "repo", "type").alias(k), F.col("n_name").alias(name))
    return edges.join(end("from", "src"), "from").join(end("to", "dst"), "to").select("src", "dst", F.col("cross").alias("crosses"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path FROM pages), r AS (SELECT DISTINCT regexp_extract(path, '^[a-z]+://[^/]+') AS root FROM p UNION SELECT DISTINCT regexp_extract(path, '^[a-z]+://[^/]+/[^/]+') FROM p)
SELECT page_id, path, max_by(root, length(root)) AS root FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY page_id, path""")
def longest_prefix(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    roots = pages.select(F.explode(F.array(F.regexp_extract("path", "^[a-z]+://[^/]+", 0), F.regexp_extract("path", "^[a-z]+://[^/]+/[^/]+", 0))).alias("root"))
    return relate.longest_prefix(pages, "path", roots, "root").select("page_id", "path", "root")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey LIMIT 20")
def symbol_topk(spark, sf_dir):
    return relate.search_symbols(_table(spark, sf_dir, "part"), "p_name", "RING", ["p_name", "p_partkey"], 20).select("p_partkey", "p_name")


@query("SELECT lang, count(*)::BIGINT AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY n DESC, coalesce(list_position(['fr', 'de'], lang), 3), lang LIMIT 1")
def lang_argmax(spark, sf_dir):
    return relate.argmax_by(_table(spark, sf_dir, "documents"), "lang", ["fr", "de"]).select("lang", F.col("count").alias("n"))


@query("""SELECT doc_id, CASE WHEN e AND c THEN 'conflict' WHEN e THEN 'to_source' WHEN c THEN 'to_projection' ELSE 'unchanged' END AS decision FROM (SELECT doc_id, sha1(CASE WHEN n_chars % 3 = 0 THEN text || '~' ELSE text END) <> sha1(text) AS e, sha1(CASE WHEN n_chars % 5 = 0 THEN '~' || text ELSE text END) <> sha1(text) AS c FROM documents)""")
def sync_decision(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("anchor"), F.sha1(F.when(F.col("n_chars") % 3 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))).alias("block"), F.sha1(F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("~"), "text")).otherwise(F.col("text"))).alias("live"))
    return docs.select("doc_id", relate.sync_decision(F.col("block") != F.col("anchor"), F.col("live") != F.col("anchor")).alias("decision"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS k, count(*) OVER (PARTITION BY user_id)::BIGINT AS n FROM events")
def k_of_n(spark, sf_dir):
    return windows.k_of_n(_table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "user_id", "k", "n")


@query("""WITH core AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), e AS (SELECT o_custkey AS src, o_custkey + 1 AS dst FROM orders), near AS (SELECT k FROM core UNION SELECT dst FROM e WHERE src IN (SELECT k FROM core) UNION SELECT src FROM e WHERE dst IN (SELECT k FROM core))
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT k FROM near)""")
def semi_neighbours(spark, sf_dir):
    nodes = _table(spark, sf_dir, "customer")
    edges = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"))
    return graph.neighbours(nodes, edges, F.col("c_mktsegment") == "BUILDING", node="c_custkey").select("c_custkey", "c_name")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_stop(spark, sf_dir):
    return relate.without(_table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'fact' END AS kind, CASE WHEN event_type <> 'error' THEN event_type END AS text, CASE WHEN event_type <> 'error' THEN [event_type, props] END AS facts FROM events")
def json_props(spark, sf_dir):
    """Records in JSON made of events; those of errors are cut short, so they can't be read."""
    whole = F.to_json(F.struct(F.lit("fact").alias("kind"), F.col("event_type").alias("text"), F.array("event_type", "props").alias("facts")))
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.when(F.col("event_type") == "error", F.lit("{ no record")).otherwise(whole).alias("value"))
    return source.records(rows).select(F.col("n").alias("event_id"), "kind", "text", "facts")


@query("SELECT user_id, event_type, min(event_id)::BIGINT AS first_id, arg_min(value, event_id) AS first_value FROM events GROUP BY user_id, event_type")
def first_wins(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return relate.first_wins(events, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", F.col("event_id").alias("first_id"), F.col("value").alias("first_value"))


CALL = r"([a-z]+),"


@query(f"""WITH {SQL_LINES}, t AS (SELECT doc_id, line, unnest(regexp_extract_all(line_text, '{CALL}', 1)) AS callee FROM l)
SELECT DISTINCT source AS caller, callee, t.doc_id, line FROM t JOIN documents d ON t.doc_id = d.doc_id WHERE callee <> 'the' AND callee <> source""")
def call_edges(spark, sf_dir):
    found = _lines(spark, sf_dir)
    tokens = search.captures(found, CALL, "callee").select(F.col("doc_id").alias("path"), "line", "callee")
    spans = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("name"), F.lit(1).alias("start"), F.lit(1 << 40).alias("end"))
    made = search.call_edges(tokens, spans, tokens.select(F.col("callee").alias("name")), stop=["the"])
    return made.select("caller", "callee", F.col("path").alias("doc_id"), "line")


@query("SELECT doc_id, substr(sha1(text || chr(10)), 1, 12) AS digest FROM documents")
def block_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", layout.short_hash(F.concat("text", F.lit("\n"))).alias("digest"))


_BY_SOURCE = " UNION ".join(f"SELECT source, '{kind}' AS kind FROM l JOIN documents USING (doc_id) WHERE regexp_matches(line_text, '{regex}')" for kind, _, regex in MARKERS)


@query(f"WITH {SQL_LINES}, k AS ({_BY_SOURCE}) SELECT source, string_agg(kind, ',' ORDER BY kind) AS kinds FROM k WHERE source IS NOT NULL GROUP BY source")
def method_effects(spark, sf_dir):
    found = search.to_lines(_table(spark, sf_dir, "documents").where("source is not null"), "source")
    return search.kinds_by(found, ["source"], MARKERS)


@query("""WITH m AS (SELECT p_brand AS name, count(*)::BIGINT AS n FROM part GROUP BY p_brand) SELECT name, n FROM m WHERE n > 1""")
def ambiguous(spark, sf_dir):
    return program.ambiguous(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")))


@query("SELECT 'b' || substr(p_brand, 7) AS name, string_agg(DISTINCT lower(p_type), ', ' ORDER BY lower(p_type)) AS calls FROM part GROUP BY p_brand")
def cpg_methods(spark, sf_dir):
    """A file for each brand, with one method that calls the types of its parts, as often as there are parts."""
    brands = _table(spark, sf_dir, "part").groupBy(F.concat(F.lit("b"), F.substring("p_brand", 7, 100)).alias("name")).agg(F.collect_list(F.lower("p_type")).alias("ts"))
    text = F.concat(F.lit("class Brand {\n  void "), "name", F.lit("() {\n"), F.array_join(F.transform("ts", lambda t: F.concat(F.lit("    "), t, F.lit("();\n"))), ""), F.lit("  }\n}\n"))
    return program.calls_of(source.parsed(_java(brands, F.lit(""), F.concat("name", F.lit(".java")), text))).select("name", "calls")


@query("""WITH s AS (SELECT user_id AS scope, event_type AS field, count(*)::BIGINT AS n FROM events GROUP BY ALL), f AS (SELECT DISTINCT event_type AS field FROM events UNION SELECT 'never'), o AS (SELECT DISTINCT user_id AS scope FROM events)
SELECT scope, field, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 'never set' WHEN n > 1 THEN 'more than once' ELSE 'once' END AS note FROM (SELECT * FROM o, f) LEFT JOIN s USING (scope, field)""")
def object_flow_anomalies(spark, sf_dir):
    """A file for each user, with one method that makes an object and sets a field of it for each event."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_type")
    users = events.groupBy("user_id").agg(F.collect_list("event_type").alias("es"))
    text = F.concat(F.lit("class U"), "user_id", F.lit(" {\n  void make() {\n    Record r = new Record();\n"), F.array_join(F.transform("es", lambda e: F.concat(F.lit("    r.set"), F.initcap(e), F.lit("(1);\n"))), ""), F.lit("  }\n}\n"))
    parsed = stored(source.parsed(_java(users, F.lit("app"), F.concat(F.lit("U"), "user_id", F.lit(".java")), text)))
    fields = sorted(r[0] for r in events.select("event_type").distinct().collect())  # the fields of a type
    told = program.set_counts(program.object_flow(parsed, "Record"), [*fields, "never"])
    return told.select(F.regexp_extract("scope", r"U(\d+)\.", 1).cast("long").alias("scope"), "field", "n", "note")


def _truths(batches):
    for batch in batches:
        told = [flow.evaluate(c, {} if v is None else {"code": str(v)}) for c, v in zip(batch.column("cond").to_pylist(), batch.column("code").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("code"), pa.array(told, pa.bool_())], names=["doc_id", "code", "truth"])


@query("""SELECT doc_id, CASE WHEN lang <> 'fr' THEN n_chars % 10 END AS code, CASE WHEN lang <> 'fr' AND lang <> 'es' THEN CASE WHEN lang = 'en' THEN n_chars % 10 >= 5 ELSE n_chars % 10 <> 3 END END AS truth FROM documents""")
def evaluate_condition(spark, sf_dir):
    """Three-valued conditions: true or false from known inputs, else unknown, as where an input is missing or the form is another."""
    cond = F.when(F.col("lang") == "en", "code >= 5").when(F.col("lang") == "es", "code >= 5 && ready").otherwise("code != 3")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("n_chars") % 10).alias("code"), cond.alias("cond"))
    return rows.mapInArrow(_truths, "doc_id long, code long, truth boolean")


@query(f"""WITH {SQL_LINES}, c AS (SELECT doc_id, line, regexp_replace(line_text, '[ \\t]+$', '') AS code FROM l)
SELECT doc_id, line, code || CASE WHEN strlen(code) < 140 THEN repeat(' ', (140 - strlen(code))::BIGINT) ELSE '  ' END || 'text.md:' || line AS shown FROM c""")
def row_layout(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", layout.located(F.col("line_text"), F.lit("docs/text.md"), F.col("line")).alias("shown"))


_FIELD = """CASE WHEN regexp_matches({0}, '[,"]|^ ') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query(f"SELECT event_id, event_id::VARCHAR || ',' || {_FIELD.format('event_type')} || ',' || {_FIELD.format('props')} AS shown FROM events")
def csv_rows(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", layout.csv_row(F.col("event_id"), F.col("event_type"), F.col("props")).alias("shown"))


@query(r"""WITH w AS (SELECT p_partkey, p_brand, p_name, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part),
c AS (SELECT p_partkey, p_brand, p_name, string_agg(upper(substr(w, 1, 1)) || substr(w, 2), '' ORDER BY i) AS c FROM w GROUP BY p_partkey, p_brand, p_name)
SELECT p_partkey, lower(regexp_replace(c, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake, lower(p_brand) AS table_name, p_brand AS simple, regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name,
  CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '…' ELSE p_name END AS short FROM c""")
def names(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    camel = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))), "")
    return part.select(
        "p_partkey", program.snake(camel).alias("snake"), program.table_name(F.concat(F.lit('public."'), "p_brand", F.lit('"'))).alias("table_name"),
        layout.simple_name(F.concat(F.lit("a.b."), "p_brand", F.lit("<K, V>"))).alias("simple"), layout.file_name(F.col("p_name")).alias("file_name"), layout.truncated(F.col("p_name"), 8).alias("short"),
    )


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k, count(*)::BIGINT AS n FROM supplier GROUP BY 1)
SELECT 'nation' || coalesce(c.k, s.k) || '_row' AS name, CASE WHEN c.k IS NULL THEN '' ELSE 'Nation' || c.k || 'Row' END AS entity, coalesce(n, 0)::BIGINT AS migrations, CASE WHEN n IS NULL THEN '' ELSE 'lib' END AS mig_repo,
  CASE WHEN c.k IS NULL THEN 'from migration' ELSE 'default (snake_case of entity)' END AS map_note FROM c FULL JOIN s ON c.k = s.k""")
def tables_and_migrations(spark, sf_dir):
    """An entity for each nation with customers, and a migration for each supplier that alters its nation's table."""
    kinds = _table(spark, sf_dir, "customer").select(F.concat(F.lit("Nation"), "c_nationkey", F.lit("Row")).alias("name")).distinct()
    files = _java(kinds, F.lit("shop"), F.concat("name", F.lit(".java")), F.concat(F.lit("@Entity\npublic class "), "name", F.lit(" {\n}\n")))
    sql = _table(spark, sf_dir, "supplier").select(F.lit("lib").alias("repo"), F.concat(F.lit("db/migration/V"), "s_suppkey", F.lit("__x.sql")).alias("path"), F.lit(1).cast("long").alias("line"), F.concat(F.lit('ALTER TABLE public."Nation'), "s_nationkey", F.lit('_Row" ADD x INT')).alias("text"))
    tables, _ = program.db_model(program.types(stored(source.parsed(files))), sql)
    return tables.select("name", "entity", F.size("migrations").cast("long").alias("migrations"), "mig_repo", "map_note")


@query("""WITH g AS (SELECT n_name AS repo, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT a.repo, b.repo AS needs FROM customer JOIN g a ON c_nationkey = a.n_nationkey JOIN g b ON a.r_name = b.r_name AND a.repo <> b.repo""")
def group_prefix(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    groups = nation.select(F.col("n_name").alias("repo"), F.concat(F.lit("com."), F.lower("r_name"), F.lit("."), F.lower("n_name")).alias("group"), "n_nationkey")
    deps = _table(spark, sf_dir, "customer").join(groups, F.col("c_nationkey") == F.col("n_nationkey")).select("repo", "group", F.lit("lib").alias("artifact"), F.lit("1").alias("version"), F.lit("").alias("project"))
    return source.internal_dependencies(groups.select("repo", "group"), deps).select("repo", "needs")


_STARTS = "CASE lang WHEN 'en' THEN 'main' WHEN 'de' THEN 'handle' WHEN 'fr' THEN 'process' ELSE 'other' END"


@query(f"""WITH f AS (SELECT doc_id, source || '/' || CASE WHEN n_chars > 500 THEN 'OrderController' ELSE 'Order' END || '.java' AS path, {_STARTS} AS name FROM documents WHERE source IS NOT NULL)
SELECT doc_id AS start, path, name, (CASE name WHEN 'main' THEN 90 WHEN 'handle' THEN 80 WHEN 'process' THEN 70 ELSE 0 END + CASE WHEN contains(path, 'Controller') THEN 10 ELSE 0 END)::BIGINT AS score FROM f ORDER BY score DESC, path, doc_id LIMIT 1""")
def best_candidate(spark, sf_dir):
    """The function a reader would start with, of functions named by language, in files named by length."""
    path = F.concat("source", F.when(F.col("n_chars") > 500, "/OrderController.java").otherwise("/Order.java"))
    made = _table(spark, sf_dir, "documents").where("source is not null").select(F.col("doc_id").alias("start"), path.alias("path"), F.expr(_STARTS).alias("name"))
    return views.suggest_entry(made).select("start", "path", "name", F.col("score").cast("long").alias("score"))


@query("SELECT (count(*) FILTER (event_type IN ('click', 'purchase')))::BIGINT AS emits, (count(*) FILTER (event_type = 'view'))::BIGINT AS listens, (count(*) FILTER (event_type = 'signup'))::BIGINT AS regs FROM events")
def surface_totals(spark, sf_dir):
    """A script for each user, with a line for each event: an emit, a subscription, a registration, or a remark."""
    kind = F.when(F.col("event_type").isin("click", "purchase"), "bus.emit('%s')").when(F.col("event_type") == "view", "bus.on('%s', go)").when(F.col("event_type") == "signup", "registerAction('%s')").otherwise("// bus.emit('%s')")
    rows = _table(spark, sf_dir, "events").select("user_id", F.replace(kind, F.lit("%s"), F.col("event_type")).alias("s"))
    users = rows.groupBy("user_id").agg(F.array_join(F.collect_list("s"), "\n").alias("text"))
    files = _java(users, F.lit(""), F.concat("user_id", F.lit(".js")), F.col("text")).withColumns({"lang": F.lit("js"), "ext": F.lit(".js")})
    return lenses.surface_counts(lenses.surface(files))


@query(f"WITH {SQL_LINES}, k AS ({_ALL}) SELECT kind, count(*)::BIGINT AS docs FROM k GROUP BY kind")
def effect_legend(spark, sf_dir):
    kinds = search.kinds_by(_lines(spark, sf_dir), ["doc_id"], MARKERS)
    return kinds.select(F.explode(F.split("kinds", ",")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("docs"))


@query("""SELECT p_partkey, 'colour' AS field, 4 + (p_size > 25)::BIGINT AS at FROM part UNION ALL SELECT p_partkey, 'size', 4 FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, 'name', 3 + (p_size > 25)::BIGINT + 2 FROM part WHERE p_size > 25""")
def argument_overlap(spark, sf_dir):
    """Parts make an object and hand it to a stage: small ones to one that sets a field and hands it on to itself and to another."""
    call = F.when(F.col("p_size") > 25, F.lit("    int k = 1;\n    stage.second(o);\n    o.setName(k);\n")).otherwise(F.lit("    stage.first(o);\n"))
    text = F.concat(F.lit("class P"), "p_partkey", F.lit(" { private Stage stage; void make() {\n\n    Paint o = new Paint();\n"), call, F.lit("  }\n}\n"))
    parts = _java(_table(spark, sf_dir, "part"), F.lit("app"), F.concat(F.lit("P"), "p_partkey", F.lit(".java")), text)
    stage = "class Stage {\n  void first(Paint p) {\n    p.setSize(2);\n    first(p);\n    second(p);\n  }\n  void second(Paint q) {\n    q.setColour(1);\n  }\n}\n"
    files = parts.unionByName(source.from_texts(spark, {"Stage.java": stage}, "app"))
    found = program.object_flow(stored(source.parsed(files)), "Paint")
    return found.select(F.regexp_extract("scope", r"P(\d+)\.", 1).cast("long").alias("p_partkey"), "field", "at")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path FROM pages), r AS (SELECT DISTINCT regexp_extract(path, '[^/]*/[^/]*$') AS ref FROM p UNION SELECT DISTINCT regexp_extract(path, '[^/]*$') FROM p)
SELECT page_id, ref FROM p JOIN r ON path = ref OR ends_with(path, '/' || ref)""")
def suffix_match(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    refs = pages.select(F.explode(F.array(F.regexp_extract("path", "[^/]*/[^/]*$", 0), F.regexp_extract("path", "[^/]*$", 0))).alias("ref"))
    return relate.ends_with(pages, "path", refs, "ref").select("page_id", "ref")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def dates(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return _blame(events, "event_id", F.col("event_type"), F.unix_timestamp("ts"), F.lit(1), F.lit("x")).select("event_id", F.col("date").alias("day"))


@query(f"""WITH {SQL_LINES} SELECT doc_id, line, regexp_replace(regexp_replace(line_text, '''[^'']*''|"[^"]*"|`[^`]*`', ' ', 'g'), '//.*', '') AS code FROM l""")
def scrub(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", layout.scrubbed(F.col("line_text")).alias("code"))


@query("SELECT c_custkey AS node, (c_custkey // (c_custkey & -c_custkey))::BIGINT AS root FROM customer WHERE c_custkey > 0 AND (c_custkey % 2 = 0 OR 2 * c_custkey <= (SELECT max(c_custkey) FROM customer))")
def components(spark, sf_dir):
    """Each customer is tied to the one of twice its key: what is left of a key without factors of two tells its component."""
    keys = _table(spark, sf_dir, "customer").where("c_custkey > 0").select("c_custkey")
    edges = keys.select(F.col("c_custkey").alias("a"), (2 * F.col("c_custkey")).alias("b")).join(keys.select(F.col("c_custkey").alias("b")), "b", "left_semi")
    return connected.components(edges, stored)


@query(f"""WITH RECURSIVE {_keys_sql("k // 3")}, r AS (SELECT src AS start, dst AS node, 1::BIGINT AS depth FROM e JOIN n ON k = src WHERE chosen UNION SELECT start, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 40)
SELECT start, node, min(depth)::BIGINT AS depth FROM r GROUP BY start, node""")
def reachable_pairs(spark, sf_dir):
    """What each chosen customer reaches over a graph with cycles."""
    nodes, edges = _keys(spark, sf_dir, F.expr("node div 3"))
    return graph.closure(edges, starts=nodes.where(CHOSEN).select(F.col("node").alias("start"))).select("start", "node", "depth")


@query(f"WITH {SQL_LINES} SELECT doc_id, line, 'a' AS label FROM l WHERE regexp_matches(line_text, '{THE}') UNION ALL SELECT doc_id, line, 'b' FROM l WHERE contains(line_text, '|')")
def hit_union(spark, sf_dir):
    found = _lines(spark, sf_dir)
    return search.grep(found, THE).select("doc_id", "line", F.lit("a").alias("label")).unionByName(search.grep(found, "[|]").select("doc_id", "line", F.lit("b").alias("label")))


@query("""SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, min(event_id)::BIGINT AS first_id FROM events GROUP BY event_type UNION ALL SELECT 'none', 0, 0, NULL""")
def polled_groups(spark, sf_dir):
    """Groups of what was polled, with the one that had no rows."""
    events = _table(spark, sf_dir, "events")
    polled = events.select("event_type").distinct().unionByName(spark.createDataFrame([("none",)], "event_type string"))
    found = watch.by_table(events, polled, "event_type", F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("first_id"))
    return found.select("event_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("users", F.lit(0)).alias("users"), "first_id")


def _slices(batches):
    """Java texts to the lines that shape the variable p at their last return, each with why."""
    for batch in batches:
        rows = []
        for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            src = Source(text, "java")
            fn = functions(src)[0]
            rows += [(conv, n, why) for n, why in flow.shape(src, fn, "p", fn.end - 1).hits.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["conv_id", "line", "why"])


@query("""WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, 2::BIGINT AS line, 'method signature' AS why FROM t WHERE k = 1 UNION ALL SELECT conv_id, k + 2, CASE role WHEN 'user' THEN 'assignment' ELSE 'reachability condition' END FROM t WHERE role IN ('user', 'system') UNION ALL SELECT conv_id, n + 3, 'target line' FROM t WHERE k = 1""")
def line_notes(spark, sf_dir):
    """Talks as methods: users assign to the variable, the system tests it, assistants do something else."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("    p = p + u"), "turn", F.lit(";"))).when(F.col("role") == "system", F.lit("    if (p > 9) { log(1); }")).otherwise("    other.touch(1);")
    talks = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("s")))).alias("x"))
    text = F.concat(F.lit("class C {\n  int f(int p) {\n"), F.array_join(F.transform("x", lambda t: t["s"]), "\n"), F.lit("\n    return p;\n  }\n}\n"))
    return talks.select("conv_id", text.alias("text")).mapInArrow(_slices, "conv_id long, line long, why string")


@query("SELECT CASE WHEN count(DISTINCT coalesce(lang, '')) > 1 THEN 'data/docs' ELSE 'data/docs/' || any_value(coalesce(lang, '')) END AS directory FROM documents")
def common_directory(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return relate.common_directory(docs.select(F.concat(F.lit("data/docs/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/x.txt")).alias("path")), "path")
