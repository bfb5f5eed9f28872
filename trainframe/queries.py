"""Every operator of the library as a query over the sample tables, with the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rows as rowfn
from .functions import text as textfn
from .functions import tokens
from .functions.paths import path_column
from .operators import aggregate, dedupe, joins, order, presets, rows, sets, validate
from .sources import files
from .sources.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Queries without SQL, as theirs would compare all pairs of rows; tests compare them with brute force.
NO_SQL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    def add(f):
        (QUERIES if sql else NO_SQL)[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chats(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, messages): each conversation's turns in order."""
    c = table(spark, d, "conversations")
    said = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(F.transform(said, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


CHATS = "WITH c AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id) "


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, question, answer): the first user's and first assistant's texts."""
    c = table(spark, d, "conversations")

    def first(role: str):
        return F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))

    return c.groupBy("conv_id").agg(first("user").alias("question"), first("assistant").alias("answer"))


PAIRS = """WITH p AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS question,
  min_by(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id) """
WORD = "[[:word:]]"


# filters and projections

@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def filter_rows(spark, d):
    return rows.filter_rows(table(spark, d, "documents"), "x.lang == 'en' and x.n_chars > 500").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND NOT starts_with(source, 'src1') AND contains(lower(text), 'un')")
def filter_text(spark, d):
    return rows.filter_rows(table(spark, d, "documents"), "x.lang in ('de', 'fr')", "not x.source.startswith('src1')", "'un' in x.text.lower()").select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[!%]{2}')")
def filter_regex(spark, d):
    return rows.filter_rows(table(spark, d, "documents"), "re.search(r'[!%]{2}', x.text)").select("doc_id")


@query("SELECT event_id FROM events WHERE value > 50 OR event_type = 'error'")
def filter_or(spark, d):
    return rows.filter_rows(table(spark, d, "events"), "x.value is not None and x.value > 50 or x.event_type == 'error'").select("event_id")


@query("SELECT count(*) FILTER (l_linenumber = 1) AS failed, count(*) AS total FROM lineitem")
def filter_failures(spark, d):
    """Division by zero fails on a row."""
    return rows.count_failures(table(spark, d, "lineitem"), "x.l_quantity / (x.l_linenumber - 1) > 10")


@query(CHATS + "SELECT conv_id FROM c WHERE len(list_filter(m, lambda t: t.role = 'assistant' AND length(t.content) > 300)) > 0")
def filter_comprehension(spark, d):
    return rows.filter_rows(chats(spark, d), "any(m.role == 'assistant' and len(m.content) > 300 for m in x.messages)").select("conv_id")


@query("SELECT doc_id, length(text)::INT AS n, substr(text, 1, 10) AS head, upper(lang) AS up, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS kind, source || '/' || lang AS label FROM documents")
def select_derive(spark, d):
    spec = "doc_id, n=len(x.text), head=x.text[:10], up=x.lang.upper(), kind='long' if x.n_chars > 2000 else 'short', label=f'{x.source}/{x.lang}', absent"
    return rows.select_rows(table(spark, d, "documents"), spec)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, (l_linenumber % -3)::BIGINT + CASE WHEN l_linenumber % 3 <> 0 THEN -3 ELSE 0 END AS m, floor(l_orderkey / 7)::BIGINT AS q FROM lineitem")
def select_arithmetic(spark, d):
    return rows.select_rows(table(spark, d, "lineitem"), "l_orderkey, l_linenumber, net=x.l_extendedprice * (1 - x.l_discount), m=x.l_linenumber % -3, q=x.l_orderkey // 7")


@query("SELECT doc_id, lang || '!' AS lang, n_chars + 1 AS n_chars, length(text)::INT AS size FROM documents")
def map_statements(spark, d):
    return rows.map_rows(table(spark, d, "documents"), "x.size = len(x.text)\nx.lang = x.lang + '!'\nx.n_chars += 1\ndel x.text\ndel x.source")


@query("SELECT conv_id, (turn)::INT AS i, role, length(text)::INT AS n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations)")
def explode_rows(spark, d):
    out = rows.explode_rows(chats(spark, d), "messages", as_="m", index_as="i")
    return out.select("conv_id", "i", "m.role", F.length("m.content").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Z]'))::INT AS n FROM documents")
def python_map(spark, d):
    def capitals(row):
        return {"doc_id": row["doc_id"], "n": sum("A" <= ch <= "Z" for ch in row["text"])}

    return rows.map_python(table(spark, d, "documents").select("doc_id", "text"), capitals, "doc_id long, n int")


@query("SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations")
def flat_map(spark, d):
    said = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return rows.map_python(said, lambda r: ({**r, "word": w} for w in r["text"].split(" ")), "conv_id long, turn long, word string", flat=True)


@query("SELECT doc_id, trim(lang) AS language, source, n_chars, 'v1' AS version FROM documents WHERE trim(text, E' \\t\\n\\r') <> '' AND length(trim(text, E' \\t\\n\\r')) BETWEEN 100 AND 5000")
def clean_rows(spark, d):
    return rows.clean(table(spark, d, "documents"), strip_text=True, drop_empty=["text"], min_len={"text": 100}, max_len={"text": 5000}, drop=["text"], rename={"lang": "language"}, add={"version": "v1"}, reorder=["doc_id", "language"])


@query(CHATS + "SELECT conv_id, m[1].role AS first_role, len(m)::INT AS n FROM c WHERE len(m) >= 3")
def clean_promote(spark, d):
    out = rows.clean(chats(spark, d), min_len={"messages.#": 3}, promote={"messages[0].role": "first_role", "messages.#": "n"}, keep=["conv_id", "first_role", "n"])
    return out


# paths and row functions

@query(CHATS + "SELECT conv_id, m[-1].role AS last_role, len(m)::INT AS n, array_to_string(list_transform(m, lambda t: t.role), '|') AS roles, array_to_string(list_sort(list_distinct(list_transform(m, lambda t: t.role))), '|') AS kinds, m[1].content AS opening FROM c")
def field_paths(spark, d):
    c = chats(spark, d)
    names = {"last_role": "messages[-1].role", "n": "messages.#", "roles": "messages[*].role:join", "kinds": "messages[*].role:unique", "opening": "messages[*].content:first"}
    return c.select("conv_id", *(path_column(c, p).alias(n) for n, p in names.items()))


@query(CHATS + """, s AS (SELECT conv_id, m, list_transform(m, lambda t: CASE t.role WHEN 'system' THEN 'sys' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE substr(t.role, 1, 3) END) AS r FROM c)
SELECT conv_id, len(m)::INT AS turns, CASE WHEN len(r) > 5 THEN array_to_string(r[1:4], '→') || '→…' ELSE array_to_string(r, '→') END AS roles,
  coalesce(list_filter(m, lambda t: t.role = 'user')[1].content, '') AS first_user, list_sum(list_transform(m, lambda t: length(t.content)))::INT AS chars, '' AS calls, 0 AS imgs FROM s""")
def row_functions(spark, d):
    c = chats(spark, d)
    s = c.schema
    return c.select("conv_id", rowfn.turns(s).alias("turns"), rowfn.roles(s).alias("roles"), rowfn.first_user(s).alias("first_user"), rowfn.chars(s).alias("chars"), rowfn.calls(s).alias("calls"), rowfn.imgs(s).alias("imgs"))


@query("SELECT page_id FROM pages WHERE contains(lower(page_id::VARCHAR || chr(10) || url || chr(10) || html), 'href')")
def search_rows(spark, d):
    return rows.filter_rows(table(spark, d, "pages"), "search(x, 'HREF')").select("page_id")


@query("SELECT n_nationkey, n_nationkey::VARCHAR || chr(10) || n_name || chr(10) || n_regionkey::VARCHAR AS t FROM nation")
def full_text(spark, d):
    n = table(spark, d, "nation")
    return rows.select_rows(n, "n_nationkey, t=fulltext(x)") if n.columns == ["n_nationkey", "n_name", "n_regionkey"] else rows.select_rows(n.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey, t=fulltext(x)")


# joins

@query("SELECT c_custkey, c_name, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_left(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return joins.join_rows(c, table(spark, d, "nation"), left_on="x.c_nationkey", right_on="x.n_nationkey", order=["n_nationkey"]).drop("n_nationkey")


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS r_o_orderkey, arg_min(o_totalprice, o_orderkey) AS r_o_totalprice FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, r_o_orderkey, r_o_totalprice FROM customer JOIN f ON c_custkey = o_custkey""")
def join_inner_first(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = joins.join_rows(table(spark, d, "customer").select("c_custkey", "c_name"), o, left_on="x.c_custkey", right_on="x.o_custkey", how="inner", prefix="r_", order=["o_orderkey"])
    return out.drop("r_o_custkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti(spark, d):
    return joins.join_rows(table(spark, d, "documents"), table(spark, d, "labels"), on="x.doc_id", how="anti").select("doc_id", "lang")


@query("SELECT (count(*) - count(DISTINCT o_custkey))::BIGINT AS ignored FROM orders")
def join_duplicates(spark, d):
    return joins.duplicates(table(spark, d, "orders"), "x.o_custkey")


@query("""WITH a AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS k FROM documents), b AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT doc_id, lang, n_chars FROM a JOIN b USING (k)""")
def join_positions(spark, d):
    x = table(spark, d, "documents")
    lengths = x.select((-F.col("n_chars")).alias("shorter"), F.col("doc_id").alias("other"), "n_chars")
    return joins.merge_positions(x.select("doc_id", "lang"), lengths, ["doc_id"], ["shorter", "other"]).select("doc_id", "lang", "n_chars")


# groups and profiles

@query("SELECT lang AS key, count(*) AS count, round_even(count(*) / (SELECT count(*) FROM documents), 4) AS pct FROM documents GROUP BY lang")
def group_count(spark, d):
    return aggregate.group_count(table(spark, d, "documents"), "x.lang", ["doc_id"])


@query("""SELECT event_type AS key, count(*) AS n, sum(value) / count(*) AS average, max(value) AS high, count(*) FILTER (value > 50) AS big, median(value) AS mid, bool_or(value > 99) AS any_top
FROM events GROUP BY event_type ORDER BY count(*) DESC, min(event_id) LIMIT 3""")
def group_agg(spark, d):
    aggs = "average=sum(r.value for r in g) / len(g), high=max(r.value for r in g), big=len([r for r in g if r.value > 50]), mid=median(r.value for r in g), any_top=any(r.value > 99 for r in g)".replace("[r for r in g", "[r.value for r in g")
    return aggregate.group_agg(table(spark, d, "events"), "x.event_type", aggs, ["event_id"], top=3)


@query("SELECT unnest(['doc_id','quality','toxic']) AS field, unnest([count(doc_id), count(quality), count(toxic)]) AS count, unnest([count(*) - count(doc_id), count(*) - count(quality), count(*) - count(toxic)]) AS missing FROM labels")
def stats_quick(spark, d):
    return aggregate.quick_stats(table(spark, d, "labels").select("doc_id", "quality", "toxic")).drop("type")


@query("""SELECT 'text' AS field, count(nullif(text, '')) AS non_null, 1 - count(nullif(text, '')) / count(*) AS null_rate, count(DISTINCT nullif(text, '')) AS "distinct", min(length(text)) AS min_len, max(length(text)) AS max_len, NULL::DOUBLE AS "max" FROM documents
UNION ALL SELECT 'n_chars', count(n_chars), 1 - count(n_chars) / count(*), count(DISTINCT n_chars), NULL, NULL, max(n_chars)::DOUBLE FROM documents""")
def stats_profile(spark, d):
    return aggregate.profile(table(spark, d, "documents"), ["text", "n_chars"]).select("field", "non_null", "null_rate", "distinct", "min_len", "max_len", "max")


@query("SELECT source AS value, count(*) AS count FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5")
def stats_top_values(spark, d):
    return aggregate.top_values(table(spark, d, "documents"), "source", 5)


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type")
def value_counts(spark, d):
    return aggregate.value_counts(table(spark, d, "events"), "event_type")


@query("SELECT count(*) AS n, count(o_orderpriority) AS filled, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean FROM orders")
def column_snapshot(spark, d):
    return aggregate.column_snapshot(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT count(*) AS elements, count(DISTINCT role) AS \"distinct\", min(length(role)) AS min_len, max(length(role)) AS max_len FROM conversations")
def wildcard_profile(spark, d):
    return aggregate.wildcard_profile(chats(spark, d), "messages[*].role")


@query("""SELECT 'x.value' AS expr, count(value) AS n, count(*) - count(value) AS nulls, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99 FROM events""")
def describe(spark, d):
    return aggregate.describe(table(spark, d, "events"), ["x.value"])


@query("""WITH s AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents), b AS (SELECT least(floor((n_chars - lo) / ((hi - lo) / 8)), 7)::INT AS bin, count(*) AS count FROM documents, s GROUP BY 1)
SELECT g.bin::INT AS bin, coalesce(b.count, 0)::BIGINT AS count FROM range(8) AS g(bin) LEFT JOIN b ON g.bin = b.bin""")
def histogram(spark, d):
    return aggregate.histogram(table(spark, d, "documents"), "x.n_chars", 8).select("bin", "count")


@query("""SELECT 'conv_id' AS path, 'long' AS type, 1.0::DOUBLE AS rate, NULL AS "values" UNION ALL SELECT 'messages', 'array', 1.0, NULL UNION ALL SELECT 'messages[]', 'struct', 1.0, NULL
UNION ALL SELECT 'messages[].role', 'string', count(role) / count(*), array_to_string(list_sort(list_distinct(list(role))), ',') FROM conversations UNION ALL SELECT 'messages[].content', 'string', count(text) / count(*), NULL FROM conversations""")
def infer_schema(spark, d):
    return aggregate.infer_schema(chats(spark, d)).withColumn("values", F.array_join("values", ","))


# metrics

@query("SELECT quality::VARCHAR AS label, toxic::VARCHAR AS pred, count(*) AS count FROM labels GROUP BY ALL")
def confusion(spark, d):
    return aggregate.confusion(table(spark, d, "labels"), "quality", "toxic")


METRICS = """WITH c AS (SELECT quality::VARCHAR AS l, toxic::VARCHAR AS p FROM labels), k AS (SELECT DISTINCT l AS label FROM c),
m AS (SELECT label, (SELECT count(*) FROM c WHERE l = label) AS support, (SELECT count(*) FROM c WHERE p = label) AS said, (SELECT count(*) FROM c WHERE l = label AND p = label) AS hit FROM k),
r AS (SELECT label, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, hit / support AS recall, support FROM m),
f AS (SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM r) """


@query(METRICS + "SELECT * FROM f")
def class_metrics(spark, d):
    return aggregate.class_metrics(table(spark, d, "labels"), "quality", "toxic")


@query(METRICS + "SELECT round(sum(recall * support) / sum(support), 9) AS accuracy, round(sum(precision * support) / sum(support), 9) AS precision, round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1 * support) / sum(support), 9) AS f1, sum(support)::BIGINT AS n FROM f")
def overall_metrics(spark, d):
    m = aggregate.overall_metrics(table(spark, d, "labels"), "quality", "toxic")
    return m.select(*(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")), "n")


# order

@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY lang DESC, n_chars DESC, doc_id")
def sort_rows(spark, d):
    return order.sort_rows(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "(x.lang, x.n_chars)", ["doc_id"], desc=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def browse_sort(spark, d):
    return order.browse_sort(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")
def head(spark, d):
    return order.head(table(spark, d, "documents").select("doc_id", "lang"), 10, ["doc_id"])


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 10")
def tail(spark, d):
    return order.tail(table(spark, d, "documents").select("doc_id", "lang"), 10, ["doc_id"])


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id OFFSET 25")
def skip(spark, d):
    return order.skip(table(spark, d, "documents").select("doc_id", "lang"), 25, ["doc_id"])


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 15 OFFSET (SELECT count(*) - 20 FROM documents)")
def slice_rows(spark, d):
    return order.slice_rows(table(spark, d, "documents").select("doc_id"), -20, -5, ["doc_id"])


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id")
def shuffle(spark, d):
    """All rows with their columns; in another order than they came, which the test of operators looks at."""
    return order.shuffle(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"])


@query("""SELECT 100::BIGINT AS n, 100::BIGINT AS ids, 0::BIGINT AS strange, true AS again, true AS another""")
def sample(spark, d):
    """Of 100 rows: how many and how many distinct, how many that the table lacks; reruns agree, other seeds do not."""
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    one = order.sample(x, 100, ["doc_id"]).select("*", F.lit(1).alias("k"))
    twice = one.union(order.sample(x, 100, ["doc_id"]).select("*", F.lit(2))).union(order.sample(x, 100, ["doc_id"], seed=7).select("*", F.lit(3)))
    known = x.withColumn("there", F.lit(True))
    seen = twice.groupBy("doc_id", "lang", "n_chars").agg(F.collect_set("k").alias("k")).join(known, ["doc_id", "lang", "n_chars"], "left")
    first, same = F.array_contains("k", 1), F.array_contains("k", 1) == F.array_contains("k", 2)
    return seen.agg(F.count_if(first).alias("n"), F.count_distinct(F.when(first, F.col("doc_id"))).alias("ids"), F.count_if(F.col("there").isNull()).alias("strange"), F.bool_and(same).alias("again"), (F.count_if(first & ~F.array_contains("k", 3)) > 0).alias("another"))


#: What tells one row of lineitem from another; several share order and line number.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]


@query("SELECT count(*) // 3 AS rows, count(*) // 3 AS ids FROM lineitem")
def sample_many(spark, d):
    """A third of all rows: exactly so many, all distinct."""
    x, keys = table(spark, d, "lineitem"), LINE
    return order.sample(x, x.count() // 3, keys).agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("ids"))


@query("""WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT lang, n, row_number() OVER (ORDER BY n DESC, lang) AS k, count(*) OVER () AS groups, sum(n) OVER () AS total FROM g),
q AS (SELECT lang, CASE WHEN k < groups THEN greatest(1, floor(100 * n / total)) ELSE 100 - (SELECT sum(greatest(1, floor(100 * n / total))) FROM r WHERE k < groups) END AS quota FROM r)
SELECT doc_id, lang FROM (SELECT doc_id, lang, quota, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents JOIN q USING (lang)) WHERE k <= quota""")
def stratified_head(spark, d):
    return order.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", 100, ["doc_id"], how="head")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents) WHERE k <= 2")
def stratified_uniform(spark, d):
    return order.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", 40, ["doc_id"], uniform=True, how="tail")


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN k < floor(0.8 * t) THEN 'train' WHEN k < floor(0.8 * t) + floor(0.1 * t) THEN 'val' ELSE 'test' END AS split FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS t FROM documents)) GROUP BY split")
def split_sizes(spark, d):
    return order.split(table(spark, d, "documents").select("doc_id"), [0.8, 0.1, 0.1], ["doc_id"]).groupBy("split").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT count(*) AS t FROM lineitem)
SELECT unnest(['train', 'val', 'test']) AS split, unnest([floor(0.8 * t), floor(0.1 * t), t - floor(0.8 * t) - floor(0.1 * t)])::BIGINT AS n, unnest([floor(0.8 * t), floor(0.1 * t), t - floor(0.8 * t) - floor(0.1 * t)])::BIGINT AS ids FROM n""")
def split_lineitem(spark, d):
    """Every part read on its own with other columns: exact sizes, and no row in two parts."""
    whole = order.split(table(spark, d, "lineitem"), [0.8, 0.1, 0.1], LINE)
    parts = [whole.where(F.col("split") == n).select(*LINE, "split", *more) for n, more in (("train", []), ("val", ["l_tax"]), ("test", ["l_shipdate", "l_quantity"]))]
    rows_ = [p.select(*LINE, "split") for p in parts]
    once = rows_[0].union(rows_[1]).union(rows_[2]).groupBy(*LINE).agg(F.min("split").alias("split"), F.count("*").alias("n"))
    return once.groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("ids"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(0.7 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents")
def split_in_order(spark, d):
    return order.split(table(spark, d, "documents").select("doc_id"), [0.7, 0.3], ["doc_id"], seed=None)


# duplicates and sets

@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_text(spark, d):
    return dedupe.dedupe(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority")
def dedupe_keys(spark, d):
    return dedupe.dedupe(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT md5(text) AS value, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return dedupe.duplicate_groups(table(spark, d, "documents"), "text").select(F.md5(F.col("value").cast("binary")).alias("value"), "n")


@query("""WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substr(text, i, 3))) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 9) AS similarity FROM g a JOIN g b ON a.item_id < b.item_id
WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.8""")
def similar_pairs(spark, d):
    return dedupe.similar_pairs(table(spark, d, "benchmark"), "text", "item_id", num_perm=64).withColumn("similarity", F.round("similarity", 9))


@query()
def similar_documents(spark, d):
    return dedupe.similar_pairs(table(spark, d, "documents"), "text", "doc_id")


@query()
def dedupe_similar(spark, d):
    return dedupe.dedupe_similar(table(spark, d, "documents"), "text", "doc_id").select("doc_id")


@query("SELECT doc_id AS id, md5(text) AS text, lang FROM documents UNION ALL SELECT item_id, md5(text), NULL FROM benchmark")
def concat_rows(spark, d):
    both = sets.concat(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return both.select("id", F.md5(F.col("text").cast("binary")).alias("text"), "lang")


@query("""WITH o AS (SELECT DISTINCT c_nationkey AS k FROM customer), n AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT (SELECT count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM o)) AS added, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n)) AS removed, (SELECT count(*) FROM (SELECT * FROM o INTERSECT SELECT * FROM n)) AS unchanged""")
def diff_rows(spark, d):
    old, new = table(spark, d, "customer"), table(spark, d, "supplier")
    return sets.diff(old.select(F.col("c_nationkey").alias("k")), new.select(F.col("s_nationkey").alias("k")))


@query("""WITH o AS (SELECT doc_id, quality AS q FROM labels), n AS (SELECT doc_id, (n_chars > 500)::INT AS q FROM documents)
SELECT coalesce(o.doc_id, n.doc_id) AS key, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.q = n.q THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def diff_by_key(spark, d):
    old = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("q"))
    new = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("q"))
    return sets.diff_rows(old, new, "doc_id", ["doc_id"], ["doc_id"])


# texts

@query("SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), E' \\t\\n\\r') AS title FROM pages WHERE regexp_matches(html, '(?s)<title>(.*?)</title>')")
def tag_text(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", textfn.tag(F.col("html"), "title").alias("title")).where("title is not null")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), props) AS k FROM events""")
def extract_json(spark, d):
    return table(spark, d, "events").select("event_id", textfn.extract(F.col("props"), "json_key:k").alias("k"))


@query("SELECT conv_id, turn, trim(string_split(text, ' ')[2]) AS w, 'py' AS language, 'a = 1' AS code, 'after' AS thought FROM conversations WHERE len(string_split(text, ' ')) >= 2 AND trim(string_split(text, ' ')[2]) <> ''")
def extract_steps(spark, d):
    c = table(spark, d, "conversations").where(F.size(F.split("text", " ")) >= 2)
    block = textfn.code_snippets(F.concat(F.col("text").substr(0, 0), F.lit("```py\na = 1\n```")))
    thought = textfn.strip_think(F.concat(F.lit("<think>"), F.col("role"), F.lit("</think>\n after ")))
    word = textfn.strip(F.try_element_at(F.split("text", " "), F.lit(2)))
    return c.select("conv_id", "turn", word.alias("w"), block[0].language.alias("language"), block[0].code.alias("code"), thought.alias("thought")).where("w <> ''")


@query(CHATS + """SELECT conv_id, md5(array_to_string(list_transform(m, lambda t: '<|im_start|>' || t.role || chr(10) || t.content || '<|im_end|>'), chr(10))) AS chatml,
md5(array_to_string(list_transform(m, lambda t: CASE t.role WHEN 'system' THEN '<<SYS>>' || chr(10) || t.content || chr(10) || '<</SYS>>' WHEN 'user' THEN '[INST] ' || t.content || ' [/INST]' ELSE t.content END), chr(10))) AS llama2 FROM c""")
def message_templates(spark, d):
    c = chats(spark, d)
    return c.select("conv_id", *(F.md5(textfn.messages_text(F.col("messages"), t).cast("binary")).alias(t) for t in ("chatml", "llama2")))


# layouts

@query(PAIRS + "SELECT 'Be brief.' AS s, question AS u, answer AS a FROM p WHERE question <> '' AND answer <> ''")
def preset_openai_chat(spark, d):
    m = presets.openai_chat(pairs(spark, d), system_prompt="Be brief.")
    return m.select(F.col("messages")[0].content.alias("s"), F.col("messages")[1].content.alias("u"), F.col("messages")[2].content.alias("a"))


@query(PAIRS + "SELECT question AS instruction, '' AS input, answer AS output FROM p WHERE question IS NOT NULL AND answer IS NOT NULL")
def preset_alpaca(spark, d):
    return presets.alpaca(chats(spark, d).select("messages"))


@query(CHATS + "SELECT len(m)::INT AS n, CASE m[1].role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' WHEN 'tool' THEN 'observation' ELSE m[1].role END AS who, m[1].content AS value FROM c")
def preset_sharegpt(spark, d):
    s = presets.sharegpt(chats(spark, d))
    return s.select(F.size("conversations").alias("n"), F.col("conversations")[0]["from"].alias("who"), F.col("conversations")[0].value.alias("value"))


@query(PAIRS + "SELECT question, answer FROM p WHERE question IS NOT NULL AND answer IS NOT NULL")
def preset_simple_qa(spark, d):
    return presets.simple_qa(chats(spark, d))


@query(PAIRS + "SELECT question AS prompt, answer AS chosen, conv_id::VARCHAR AS rejected FROM p WHERE question <> '' AND answer <> '' AND conv_id <> 0")
def preset_dpo_pair(spark, d):
    return presets.dpo_pair(pairs(spark, d).withColumnRenamed("question", "ask"), prompt="ask", chosen="answer", rejected="conv_id")


@query(PAIRS + "SELECT 'request-' || (row_number() OVER (ORDER BY conv_id) - 1) AS custom_id, 'POST' AS method, question AS q FROM p WHERE question <> '' AND answer <> ''")
def convert_openai_batch(spark, d):
    p = pairs(spark, d).where("question <> '' and answer <> ''")
    return presets.to_openai_batch(p, "m", ["conv_id"]).select("custom_id", "method", F.col("body.messages")[0].content.alias("q"))


FOLD = CHATS + """, t AS (SELECT conv_id, role, text, turn, max(CASE WHEN role = 'user' THEN turn END) OVER w AS ask, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT t.conv_id, t.turn, q.text AS question, t.text AS answer FROM t JOIN conversations q ON q.conv_id = t.conv_id AND q.turn = t.ask WHERE t.role = 'assistant' AND t.ask IS NOT NULL AND (t.told IS NULL OR t.told < t.ask)),
l AS (SELECT conv_id, count(*) AS n, arg_max(question, turn) AS question, arg_max(answer, turn) AS answer FROM a GROUP BY conv_id) """


@query(FOLD + "SELECT l.question AS instruction, l.answer AS output, coalesce(greatest(l.n - 1, 0), 0)::INT AS history FROM c LEFT JOIN l USING (conv_id)")
def convert_llama_factory(spark, d):
    return presets.to_llama_factory(chats(spark, d)).select("instruction", "output", F.size("history").alias("history"))


@query(FOLD + "SELECT l.question AS query, l.answer AS response, coalesce(greatest(l.n - 1, 0), 0)::INT AS history FROM c LEFT JOIN l USING (conv_id)")
def convert_swift(spark, d):
    return presets.to_swift_query_response(chats(spark, d)).select("query", "response", F.size("history").alias("history"))


# validation

CHAT_OK = CHATS + ", v AS (SELECT conv_id, len(m) > 0 AND len(list_filter(m, lambda t: t.role IS NULL OR t.role NOT IN ('system', 'user', 'assistant', 'tool') OR t.content IS NULL)) = 0 AS ok FROM c) "


@query(CHAT_OK + "SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, count(*) FILTER (ok) / count(*) AS valid_ratio FROM v")
def validate_chats(spark, d):
    return validate.report(chats(spark, d), validate.openai_chat_schema())


DOCUMENT = validate.Schema({"text": validate.Field("str", min_length=100), "lang": validate.Field("str", choices=("en", "de", "fr")), "n_chars": validate.Field("int", min=50, max=9000), "source": validate.Field("str", pattern="src1")})


@query("""SELECT path, message, sum(n)::BIGINT AS n FROM (SELECT 'text' AS path, 'is shorter than 100' AS message, count(*) AS n FROM documents WHERE length(text) < 100 UNION ALL SELECT 'lang', 'is none of en, de, fr', count(*) FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
UNION ALL SELECT 'n_chars', 'is under 50', count(*) FROM documents WHERE n_chars < 50 UNION ALL SELECT 'n_chars', 'is over 9000', count(*) FROM documents WHERE n_chars > 9000 UNION ALL SELECT 'source', 'does not match src1', count(*) FROM documents WHERE NOT starts_with(source, 'src1')) GROUP BY ALL HAVING sum(n) > 0""")
def validate_errors(spark, d):
    return validate.error_counts(table(spark, d, "documents"), DOCUMENT)


@query("SELECT doc_id FROM documents WHERE length(text) >= 100 AND lang IN ('en', 'de', 'fr') AND n_chars BETWEEN 50 AND 9000 AND starts_with(source, 'src1')")
def valid_rows(spark, d):
    return validate.valid_rows(table(spark, d, "documents"), DOCUMENT).select("doc_id")


# tokens

TOKENS = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]+|[^\\p{{L}}\\p{{M}}\\p{{Nd}}_\\s]'))"


@query(f"SELECT doc_id, {TOKENS.format('text')}::INT AS token_count FROM documents")
def token_counter(spark, d):
    return tokens.token_counter(table(spark, d, "documents"), ["text"]).select("doc_id", "token_count")


@query(f"SELECT doc_id FROM documents WHERE {TOKENS.format('text')} BETWEEN 100 AND 1000")
def token_filter(spark, d):
    return tokens.token_filter(table(spark, d, "documents"), ["text"], 100, 1000).select("doc_id")


@query(f"""WITH t AS (SELECT {TOKENS.format('text')} AS n FROM documents) SELECT sum(n)::BIGINT AS total, count(*) AS count, round(avg(n), 6) AS avg, min(n)::BIGINT AS min, max(n)::BIGINT AS max, floor(quantile_cont(n, 0.25))::BIGINT AS p25, floor(median(n))::BIGINT AS median, floor(quantile_cont(n, 0.99))::BIGINT AS p99 FROM t""")
def token_stats(spark, d):
    t = tokens.token_counter(table(spark, d, "documents"), ["text"], "n")
    return aggregate.distribution(t, "n").select("total", "count", F.round("avg", 6).alias("avg"), "min", "max", "p25", "median", "p99")


@query(f"""WITH t AS (SELECT conv_id, role, {TOKENS.format('text')} AS n FROM conversations WHERE text <> '') SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS count, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (role = 'user'), 0)::BIGINT AS user, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS assistant, coalesce(sum(n) FILTER (role = 'system'), 0)::BIGINT AS system FROM t""")
def messages_token_stats(spark, d):
    return tokens.messages_token_stats(chats(spark, d)).select("count", "total", "user", "assistant", "system")


# pipelines and streams

@query("SELECT lang AS key, count(*) AS count, round_even(count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT text, lang, min(doc_id) AS doc_id FROM documents WHERE n_chars > 200 GROUP BY text, lang) GROUP BY lang")
def yaml_pipeline(spark, d):
    from .plans.pipeline import build

    spec = {"version": 1, "order": ["doc_id"], "steps": [{"type": "filter", "where": "x.n_chars > 200"}, {"type": "dedupe", "key": ["text", "lang"]}, {"type": "group", "by": "x.lang"}]}
    return build(table(spark, d, "documents"), spec)


@query("SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE value > 10 GROUP BY event_type")
def stream_filter(spark, d):
    from .streaming.operators import drain

    src = table(spark, d, "events")
    stream = spark.readStream.schema(src.schema).parquet(f"{d}/events.parquet*")
    return drain(rows.filter_rows(stream, "x.value > 10")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# sources and sinks: what is written and read again

def _again(df: DataFrame, name: str, **options) -> DataFrame:
    path = f"{new_path(df.sparkSession, 'io')}/{name}"
    files.save(df, path, **options)
    return files.load(df.sparkSession, path)


@query(CHATS + "SELECT conv_id, len(m) AS n, m[1].role AS first_role, md5(m[-1].content) AS last_text FROM c")
def io_jsonl(spark, d):
    m = _again(chats(spark, d), "chats.jsonl")
    return m.select("conv_id", F.size("messages").cast("long").alias("n"), F.col("messages")[0].role.alias("first_role"), F.md5(F.element_at("messages", -1).content.cast("binary")).alias("last_text"))


@query("SELECT doc_id, lang, md5(text) AS text FROM documents")
def io_jsonl_gz(spark, d):
    return _again(table(spark, d, "documents").select("doc_id", "lang", "text"), "docs.jsonl.gz").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT page_id, url, md5(html) AS html FROM pages")
def io_csv(spark, d):
    """Quotes, commas and line breaks inside of texts."""
    p = _again(table(spark, d, "pages"), "pages.csv")
    return p.select(F.col("page_id").cast("long").alias("page_id"), "url", F.md5(F.col("html").cast("binary")).alias("html"))


@query(CHATS + "SELECT conv_id, m[1].role AS first_role, md5(m[1].content) AS first_text FROM c")
def io_tsv_nested(spark, d):
    """Nested columns are JSON texts in the file and are decoded on the way back."""
    t = _again(chats(spark, d), "chats.tsv")
    at = lambda p: F.variant_get("messages", p, "string")
    return t.select(F.col("conv_id").cast("long").alias("conv_id"), at("$[0].role").alias("first_role"), F.md5(at("$[0].content").cast("binary")).alias("first_text"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def io_arrow(spark, d):
    return _again(table(spark, d, "customer"), "customer.arrow").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT event_id, event_type, value FROM events")
def io_parquet(spark, d):
    return _again(table(spark, d, "events"), "events.parquet", rows_per_file=1000).select("event_id", "event_type", "value")


@query("SELECT lpad((k // 300)::VARCHAR, 5, '0') AS shard, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) GROUP BY 1")
def io_sharded(spark, d):
    path = new_path(spark, "io")
    files.save_sharded(table(spark, d, "documents").select("doc_id", "lang"), path, 300, ["doc_id"])
    got = spark.read.option("basePath", path).schema("doc_id long, lang string, shard string").json(path)
    return got.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def io_append(spark, d):
    path = f"{new_path(spark, 'io')}/all.jsonl"
    for name, prefix in (("nation", "n"), ("region", "r")):
        t = table(spark, d, name)
        files.append(t.select(F.col(f"{prefix}_{name}key").alias("k"), F.col(f"{prefix}_name").alias("name")), path)
    return files.load(spark, path).select(F.col("k").cast("int").alias("k"), "name")


@query("SELECT unnest(['jsonl', 'parquet', 'csv']) AS format, unnest([(SELECT count(*) FROM events), (SELECT count(*) FROM orders), (SELECT count(*) FROM pages)]) AS n")
def io_count(spark, d):
    base, out = new_path(spark, "io"), []
    for fmt, name in (("jsonl", "events"), ("parquet", "orders"), ("csv", "pages")):
        files.save(table(spark, d, name), f"{base}/{name}.{fmt}")
        out.append((fmt, files.count_rows(spark, f"{base}/{name}.{fmt}")))
    return spark.createDataFrame(out, "format string, n long")


# more layouts, each against the conversations it came from

TURNS = "SELECT conv_id, string_agg({0} || chr(30) || text, chr(31) ORDER BY turn) AS t FROM conversations WHERE {1} GROUP BY conv_id"
SHARE = "CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' WHEN 'tool' THEN 'observation' ELSE role END"


def _said(df: DataFrame, name: str, role: str, text: str) -> DataFrame:
    """A digest of all turns of each row."""
    return df.select(F.md5(F.array_join(F.transform(F.col(name), lambda m: F.concat(m[role], F.lit("\x1e"), m[text])), "\x1f").cast("binary")).alias("said"))


@query("SELECT md5(t) AS said FROM (" + TURNS.format("role", "true") + ")")
def preset_sharegpt_to_messages(spark, d):
    return _said(presets.sharegpt_to_messages(presets.sharegpt(chats(spark, d))), "messages", "role", "content")


@query("SELECT md5(t) AS said, true AS add_generation_prompt FROM (" + TURNS.format("role", "true") + ")")
def convert_hf_chat(spark, d):
    out = presets.to_hf_chat(chats(spark, d), add_generation_prompt=True)
    return _said(out, "messages", "role", "content").withColumn("add_generation_prompt", F.lit(True))


@query("SELECT md5(t) AS said FROM (" + TURNS.format(SHARE, "true") + ")")
def convert_axolotl(spark, d):
    return _said(presets.to_axolotl(chats(spark, d)), "conversations", "from", "value")


@query("SELECT md5(coalesce(t, '')) AS said, coalesce(s, '') AS system FROM (SELECT conv_id, min_by(text, turn) FILTER (role = 'system') AS s FROM conversations GROUP BY conv_id) LEFT JOIN (" + TURNS.format(SHARE, "role <> 'system'") + ") USING (conv_id)")
def convert_llama_factory_sharegpt(spark, d):
    out = presets.to_llama_factory_sharegpt(chats(spark, d))
    return out.select(F.md5(F.array_join(F.transform("conversations", lambda m: F.concat(m["from"], F.lit("\x1e"), m["value"])), "\x1f").cast("binary")).alias("said"), "system")


@query("SELECT coalesce(max_by(text, turn) FILTER (role = 'user'), '') AS instruction, '' AS input, coalesce(max_by(text, turn) FILTER (role = 'assistant'), '') AS output, conv_id || '.png' AS image FROM conversations GROUP BY conv_id")
def convert_llama_factory_vlm(spark, d):
    c = chats(spark, d).withColumn("images", F.concat(F.col("conv_id").cast("string"), F.lit(".png")))
    return presets.to_llama_factory_vlm(c).select("instruction", "input", "output", F.col("images")[0].alias("image"))


@query("SELECT md5(coalesce(t, '')) AS said, [conv_id || '.png'] AS images FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (" + TURNS.format(SHARE, "role <> 'system'") + ") USING (conv_id)")
def convert_llama_factory_vlm_sharegpt(spark, d):
    c = chats(spark, d).withColumn("images", F.array(F.concat(F.col("conv_id").cast("string"), F.lit(".png"))))
    out = presets.to_llama_factory_vlm_sharegpt(c)
    return out.select(F.md5(F.array_join(F.transform("conversations", lambda m: F.concat(m["from"], F.lit("\x1e"), m["value"])), "\x1f").cast("binary")).alias("said"), "images")


@query("SELECT md5(CASE WHEN first = 'system' THEN t ELSE 'system' || chr(30) || 'Be brief.' || chr(31) || t END) AS said FROM (" + TURNS.format("role", "true") + ") JOIN (SELECT conv_id, min_by(role, turn) AS first FROM conversations GROUP BY conv_id) USING (conv_id)")
def convert_swift_messages(spark, d):
    return _said(presets.to_swift_messages(chats(spark, d), "Be brief."), "messages", "role", "content")


@query("SELECT md5(t) AS said FROM (" + TURNS.format("role", "role IN ('user', 'assistant', 'system')") + ")")
def convert_swift_vlm(spark, d):
    return _said(presets.to_swift_vlm(chats(spark, d)), "messages", "role", "content")


@query("SELECT doc_id::VARCHAR AS custom_id, lang AS content, 'm' AS model FROM documents WHERE n_chars > 500")
def import_openai_batch(spark, d):
    """Results as a batch returns them; those with another status than 200 are left out."""
    x = table(spark, d, "documents")
    message_ = F.struct(F.lit("assistant").alias("role"), F.col("lang").alias("content"))
    body = F.struct(F.lit("m").alias("model"), F.array(F.struct(message_.alias("message"))).alias("choices"), F.struct(F.col("n_chars").alias("total_tokens")).alias("usage"))
    status = F.when(F.col("n_chars") > 500, 200).otherwise(500)
    got = x.select(F.col("doc_id").cast("string").alias("custom_id"), F.struct(status.alias("status_code"), body.alias("body")).alias("response"))
    return presets.from_openai_batch(got).select("custom_id", "content", "model")


@query("""WITH l AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END AS k FROM customer),
r AS (SELECT CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS k, n_name, n_nationkey FROM nation), f AS (SELECT k, min_by(n_name, n_nationkey) AS n_name FROM r GROUP BY k)
SELECT c_custkey, l.k, n_name FROM l LEFT JOIN f ON l.k IS NOT DISTINCT FROM f.k""")
def join_null_keys(spark, d):
    """Null matches null, and of rows on the right that share a key, null among them, the first counts."""
    left = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("k"))
    right = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("k"), "n_name")
    return joins.join_rows(left, right, on="x.k", order=["n_nationkey"]).select("c_custkey", "k", "n_name")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS kind, CASE WHEN value > 50 THEN value ELSE 0.5 END AS value, 'x' AS note FROM events")
def clean_fill(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("kind"), F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return rows.clean(e, fill={"kind": "none", "value": "0.5", "note": "x"})


@query("""SELECT doc_id, 'look,' || lang AS calls, (length(text) - length(replace(text, 'e', '')))::INT AS imgs, length(text) - length(replace(text, 'e', '')) <> 2 AS mismatch FROM documents WHERE n_chars < 300""")
def tool_calls_and_images(spark, d):
    """Two calls, the first repeated, and an image's placeholder for each letter e of the text."""
    x = table(spark, d, "documents").where("n_chars < 300")

    def call(name):
        return F.struct(F.struct(name.alias("name"), F.lit("{}").alias("arguments")).alias("function"))

    made = F.array(call(F.lit("look")), call(F.col("lang")), call(F.lit("look")))
    turn = F.struct(F.lit("assistant").alias("role"), F.replace("text", F.lit("e"), F.lit("<image>")).alias("content"), made.alias("tool_calls"))
    x = x.select("doc_id", F.array(turn).alias("messages"), F.array(F.lit("a"), F.lit("b")).alias("images"))
    s = x.drop("images").schema
    return x.select("doc_id", rowfn.calls(s).alias("calls"), rowfn.imgs(s).alias("imgs"), rowfn.image_mismatch(x.schema).alias("mismatch"))


@query("SELECT conv_id, turn, len(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM conversations")
def text_lines(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(textfn.lines(F.replace("text", F.lit("."), F.lit("\n")))).cast("long").alias("n"))


@query("SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'S' WHEN bool_or(role = 'assistant') THEN 'A' WHEN bool_or(role = 'user') THEN 'U' END AS best FROM conversations GROUP BY conv_id")
def value_mapping(spark, d):
    c = chats(spark, d)
    return c.select("conv_id", textfn.map_with_priority(F.transform("messages", lambda m: m.role), {"user": "U", "assistant": "A", "system": "S"}).alias("best"))


@query("SELECT event_type, min(event_id) IS NOT NULL AS seen, count(DISTINCT event_type) AS n FROM events GROUP BY event_type")
def stream_dedupe(spark, d):
    """The first row of each key of a stream; the watermark is longer than the table's time."""
    from .streaming.operators import dedupe_stream, drain

    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(dedupe_stream(stream, ["event_type"], "ts", "36500 days"))
    return got.groupBy("event_type").agg(F.min("event_id").isNotNull().alias("seen"), F.count("*").alias("n"))
