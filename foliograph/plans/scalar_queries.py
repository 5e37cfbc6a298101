"""Queries of scalar functions, small operators and names over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, order
from ..sources import pdf_crypt, pdf_write
from ..sources.pdf import Text
from .queries import query

# -- formatting -------------------------------------------------------------------------


@query("""WITH n AS (SELECT event_id, event_id % 7990 / 8.0 AS v FROM events)
SELECT event_id, replace(printf('%.2f', v), '.', ',') AS two, replace(printf('%.1f', v), '.', ',') AS one, printf('%.0f', v) AS zero, replace(printf('%.1f', v / 100 * 100), '.', ',') || ' %' AS percent FROM n""")
def format_fixed(t, spark):
    """Eighths, so that many values are ties."""
    v = F.col("event_id") % 7990 / 8.0
    return t("events").select("event_id", T.fixed(v, 2).alias("two"), T.fixed(v, 1).alias("one"), T.fixed(v, 0).alias("zero"), T.format_percent(v / 100, 1).alias("percent"))


_B3 = "CASE WHEN v < 10 THEN printf('%.2f', v) WHEN v < 100 THEN printf('%.1f', v) ELSE printf('%.0f', v) END"


@query(f"""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(CAST(round(l_extendedprice * 100) AS BIGINT) * 125 / l_quantity) AS BIGINT) AS n FROM lineitem
), u AS (SELECT *, CASE WHEN n < 1000 THEN 0 WHEN n / 1e3 < 999.5 THEN 1 WHEN n / 1e6 < 999.5 THEN 2 ELSE 3 END AS k FROM n), x AS (SELECT *, n / pow(1000.0, k) AS v FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k = 0 THEN CAST(n AS VARCHAR) || ' B' ELSE {_B3} || CASE k WHEN 1 THEN ' KB' WHEN 2 THEN ' MB' ELSE ' GB' END END || '/s' AS rate FROM x""")
def format_rate(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.format_rate(F.round(F.col("l_extendedprice") * 100).cast("long") * 125, F.col("l_quantity"), "en").alias("rate"))


@query("""WITH n AS (SELECT event_id, event_id * 37 % 400000 AS s FROM events)
SELECT event_id, CASE WHEN s < 1 THEN 'just now' WHEN s < 60 THEN s || ' s ago' WHEN s >= 172800 THEN (s // 86400) || ' days ago' WHEN s < 3600 THEN (s // 60) || ' min ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' s ago'
ELSE (s // 3600) || ' h ' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || ' min ago' END AS long_form,
CASE WHEN s < 1 THEN 'just now' WHEN s < 60 THEN s || ' s ago' WHEN s >= 172800 THEN (s // 86400) || ' days ago' WHEN s < 3600 THEN (s // 60) || ' min ago' ELSE (s // 3600) || ' h ago' END AS short_form FROM n""")
def format_ago(t, spark):
    s = F.col("event_id") * 37 % 400000
    return t("events").select("event_id", T.format_ago(s, "en").alias("long_form"), T.format_ago(s, "en", short=True).alias("short_form"))


@query("""SELECT o_orderkey, replace(regexp_replace(printf('%,d', o_orderkey * 1237), ',', '.', 'g'), ' ', '') AS plain FROM orders""")
def format_grouped(t, spark):
    return t("orders").select("o_orderkey", T.grouped(F.col("o_orderkey") * 1237).alias("plain"))


# -- parsing ----------------------------------------------------------------------------

#: Units by part number, with how many bytes each stands for.
_UNITS = [("", 1), ("B", 1), ("k", 10**3), ("KB", 10**3), (" mb", 10**6), ("GB", 10**9), ("KiB", 1 << 10), ("MiB", 1 << 20), ("XB", None), ("?", None)]
_UNIT_SQL = " ".join(f"WHEN {k} THEN '{u}'" for k, (u, _) in enumerate(_UNITS))
_SCALE_SQL = " ".join(f"WHEN {k} THEN {v or 'NULL'}" for k, (_, v) in enumerate(_UNITS))


@query(f"""WITH x AS (SELECT p_partkey, p_size AS whole, p_partkey % 4 * 25 AS part, CASE p_partkey % 10 {_UNIT_SQL} END AS unit, CASE p_partkey % 10 {_SCALE_SQL} END AS scale FROM part)
SELECT p_partkey, whole || CASE WHEN p_partkey % 2 = 0 THEN ',' ELSE '.' END || part || unit AS text, CAST(floor((whole + CASE WHEN part = 0 THEN 0 WHEN part = 25 THEN 0.25 WHEN part = 50 THEN 0.5 ELSE 0.75 END)::DOUBLE * scale + 0.5) AS BIGINT) AS bytes FROM x""")
def parse_size(t, spark):
    unit = F.element_at(F.array(*[F.lit(u) for u, _ in _UNITS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ",").otherwise("."), (F.col("p_partkey") % 4 * 25).cast("string"), unit)
    return t("part").select("p_partkey", text.alias("text")).withColumn("bytes", T.parse_size(F.col("text")))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey % 24 AS h, o_orderkey % 60 AS m, o_custkey % 60 AS s FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN h || ':' || m || ':' || s WHEN 1 THEN m || ':' || s || '.5' WHEN 2 THEN s || '' WHEN 3 THEN h || 'h' || m || 'm' WHEN 4 THEN m || 'm' || s || ',25s' WHEN 5 THEN '1:' || h || ':' || m || ':' || s WHEN 6 THEN '-' || s ELSE s || ' min' END AS text,
CASE k WHEN 0 THEN h * 3600 + m * 60 + s WHEN 1 THEN m * 60 + s + 0.5 WHEN 2 THEN s WHEN 3 THEN h * 3600 + m * 60 WHEN 4 THEN m * 60 + s + 0.25 END::DOUBLE AS seconds FROM x""")
def parse_timecode(t, spark):
    h, m, s = ((F.col(c) % n).cast("string") for c, n in (("o_custkey", 24), ("o_orderkey", 60), ("o_custkey", 60)))
    h, m, s = (F.concat(x) for x in (h, m, s))
    c = F.concat
    forms = [c(h, F.lit(":"), m, F.lit(":"), s), c(m, F.lit(":"), s, F.lit(".5")), s, c(h, F.lit("h"), m, F.lit("m")), c(m, F.lit("m"), s, F.lit(",25s")), c(F.lit("1:"), h, F.lit(":"), m, F.lit(":"), s), c(F.lit("-"), s), c(s, F.lit(" min"))]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t("orders").select("o_orderkey", text.alias("text")).withColumn("seconds", T.parse_timecode(F.col("text")))


_WORDS = [("SÍ", True), (" on ", True), ("True", True), ("", True), ("No", False), ("off", False), ("0", False), ("maybe", None), ("2", None)]


@query("SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {str(v).lower() if v is not None else 'NULL'}" for k, (_, v) in enumerate(_WORDS)) + " END AS told FROM part")
def parse_bool(t, spark):
    word = F.element_at(F.array(*[F.lit(w) for w, _ in _WORDS]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return t("part").select("p_partkey", T.parse_bool(word).alias("told"))


#: Text around a part's number, and whether the whole is a number.
_AROUND = [("", "", True), (" ", "", False), ("", " ", False), ("-", ".50", True), ("+.", "e-7", True), ("", "d", False), ("1_", "", True), ("", "_", False), ("0x", "p-2", True), ("0x", "", False), ("", "e999", None), (".", ".", False), ("inf", "", False)]


@query("SELECT p_partkey, CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN {'p_size = 0' if v is None else str(v).lower()}" for k, (_, _, v) in enumerate(_AROUND)) + " END AS told FROM part")
def is_number(t, spark):
    at = (F.col("p_partkey") % 13 + 1).cast("int")
    before, after = (F.element_at(F.array(*[F.lit(x[k]) for x in _AROUND]), at) for k in (0, 1))
    return t("part").select("p_partkey", T.is_number(F.concat(before, F.col("p_size").cast("string"), after)).alias("told"))


# -- how values are written ---------------------------------------------------------------

_ASCII = r"regexp_full_match(text, '[\x00-\x7F]*')"


@query(f"SELECT doc_id, CASE WHEN {_ASCII} THEN strlen(text) ELSE 2 + 2 * length(text) END::INT AS n, CASE WHEN {_ASCII} THEN upper(hex(encode(left(text, 3)))) ELSE 'FEFF' END AS start FROM documents")
def text_bytes(t, spark):
    b = T.text_bytes(F.col("text"))
    return t("documents").select("doc_id", F.length(b).alias("n"), F.when(F.hex(F.substring(b, 1, 2)) == "FEFF", "FEFF").otherwise(F.hex(F.substring(b, 1, 3))).alias("start"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace(CAST(l_extendedprice AS VARCHAR), '[.]0$', '') AS told FROM lineitem")
def real_text(t, spark):
    told = F.pandas_udf(lambda s: s.map(pdf_write.real_text), "string")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", told("l_extendedprice").alias("told"))


@query("SELECT p_partkey, '/' || replace(replace(replace(p_brand || ' ' || p_name || '/', '#', '#23'), ' ', '#20'), '/', '#2F') AS told FROM part")
def name_bytes(t, spark):
    told = F.pandas_udf(lambda s: s.map(lambda x: pdf_write.name_bytes(x).decode()), "string")
    return t("part").select("p_partkey", told(F.concat("p_brand", F.lit(" "), "p_name", F.lit("/"))).alias("told"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_full_match(text, '[\x20-\x7E\t\n\r]*') THEN '(' || replace(replace(replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)'), chr(10), '\n'), chr(13), '\r') || ')' ELSE '<' || upper(hex(encode(text))) || '>' END AS told FROM conversations""")
def text_literal(t, spark):
    told = F.pandas_udf(lambda s: s.map(lambda x: pdf_write.text_literal(Text(x.encode())).decode()), "string")
    return t("conversations").select("conv_id", "turn", told("text").alias("told"))


_ENCODED = "[\\x00-\\x17 -~¡-¬®-ÿ" + pdf_crypt.LOW_SPECIAL + pdf_crypt.HIGH_SPECIAL + "€]*"


@query(f"SELECT doc_id, CASE WHEN regexp_full_match(text, '{_ENCODED}') THEN length(text) END::BIGINT AS n FROM documents")
def document_encoded(t, spark):
    size = F.pandas_udf(lambda s: s.map(lambda x: None if (b := pdf_crypt.document_encoded(x)) is None else len(b)).astype("Int64"), "long")
    return t("documents").select("doc_id", size("text").alias("n"))


# -- small operators ----------------------------------------------------------------------

_OPEN = {"region": "r_regionkey % 2 = 0", "nation": "n_nationkey % 3 <> 0"}


@query(f"""WITH n AS (SELECT nation.*, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS kids, {_OPEN["nation"]} AS is_open FROM nation)
SELECT 'r' || r_regionkey AS node, CAST((SELECT sum(1 + CASE WHEN is_open THEN kids ELSE 0 END) FROM n WHERE n_regionkey = r_regionkey) * CASE WHEN {_OPEN["region"]} THEN 1 ELSE -1 END AS BIGINT) AS visible FROM region
UNION ALL SELECT 'n' || n_nationkey, kids * CASE WHEN is_open THEN 1 ELSE -1 END FROM n UNION ALL SELECT 'c' || c_custkey, 0 FROM customer""")
def visible_descendants(t, spark):
    def level(name, key, up, opened):
        node = lambda c: F.concat(F.lit(c[0]), F.col(c).cast("string"))
        return t(name).select(F.lit(0).alias("doc_id"), node(key).alias("node"), (node(up) if up else F.lit(None).cast("string")).alias("parent"), F.col(key).cast("long").alias("ord"), F.expr(opened).alias("is_open"))

    nodes = level("region", "r_regionkey", None, _OPEN["region"]).unionByName(level("nation", "n_nationkey", "n_regionkey", _OPEN["nation"]).withColumn("parent", F.concat(F.lit("r"), F.substring("parent", 2, 99))))
    customers = level("customer", "c_custkey", "c_nationkey", "true").withColumn("parent", F.concat(F.lit("n"), F.substring("parent", 2, 99)))
    return graph.visible_descendants(nodes.unionByName(customers), "is_open").select("node", "visible")


@query("SELECT c_custkey, min(o_orderkey) AS first FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def first_of_source(t, spark):
    from pyspark.sql import Window

    rows = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
    nth = F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey"))
    return rows.withColumn("nth", nth).where("nth = 1").select("c_custkey", F.col("o_orderkey").alias("first"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ' ') AS parts FROM lineitem GROUP BY 1")
def distinct_references(t, spark):
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_partkey")).cast("array<string>"), " ").alias("parts"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def dump_first(t, spark):
    """The first 20, as the debug dump shows them: the limit is the feature."""
    return t("customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS new_no FROM (SELECT o_orderkey FROM orders UNION ALL SELECT -c_custkey FROM customer)")
def ordered_union(t, spark):
    rows = t("orders").select("o_orderkey").unionByName(t("customer").select((-F.col("c_custkey")).alias("o_orderkey")))
    return order.renumbered(rows, "o_orderkey")


# -- files --------------------------------------------------------------------------------


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name || '.pdf' WHEN 1 THEN s_name || '@x.pdf' WHEN 2 THEN s_name || '.pdf' WHEN 3 THEN s_name || '.pdf@wrong' ELSE s_name || '.pdf' END AS pattern,
CASE s_suppkey % 5 WHEN 0 THEN '1-3,odd' WHEN 2 THEN '-' WHEN 4 THEN 'REV' ELSE '' END AS spec FROM supplier""")
def split_arguments(t, spark):
    from ..sources.files import split_spec

    ends = F.element_at(F.array(*map(F.lit, (".pdf@1-3,odd", "@x.pdf", ".pdf@-", ".pdf@wrong", ".pdf@REV"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    split = F.pandas_udf(lambda s: pd.DataFrame([split_spec(x) for x in s], columns=["pattern", "spec"]), "pattern string, spec string")
    return t("supplier").select("s_suppkey", split(F.concat("s_name", ends)).alias("x")).select("s_suppkey", "x.pattern", "x.spec")


@query("""WITH f AS (SELECT DISTINCT conv_id FROM conversations) SELECT (row_number() OVER (ORDER BY conv_id % 3 <> 0, conv_id % 3, conv_id))::BIGINT AS ord, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'part' || conv_id % 3 || '/' END || 'file' || conv_id || '.pdf' AS name FROM f""")
def expand_patterns(t, spark):
    """Files named by conversations in folders, found by a pattern in natural order."""
    import os
    import tempfile

    from ..sources.files import expand, with_extension

    with tempfile.TemporaryDirectory() as top:
        for (conv,) in t("conversations").select("conv_id").distinct().collect():
            folder = os.path.join(top, f"part{conv % 3}" if conv % 3 else "")
            os.makedirs(folder, exist_ok=True)
            for ending in (".pdf", ".txt"):
                open(with_extension(os.path.join(folder, f"file{conv}.x"), ending), "w").close()
        found, _ = expand([os.path.join(top, "**/*.pdf"), top], lambda n: n.endswith(".pdf"), True)
        rows = [(k, os.path.relpath(p, top)) for k, p in enumerate(found, 1)]
    return spark.createDataFrame(rows, "ord long, name string")
