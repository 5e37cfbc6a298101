"""Queries over PDF files of every make, against the tables the files were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import pdf_tables
from . import pdf_files as made
from .queries import query

#: The turns as pages: n is the page number.
_P = "p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS pages FROM conversations)"


def _texts(rows) -> list[str]:
    return rows["text"].tolist()


def _told(contents: DataFrame) -> DataFrame:
    return contents.select("doc_id", "page_no", F.rtrim(F.col("content").cast("string")).alias("text"))


def _packed(t) -> DataFrame:
    def file(conv: int, rows) -> bytes:
        objects, pages = made.base_objects(_texts(rows))
        for n, (page, text) in enumerate(zip(pages, _texts(rows), strict=True)):
            objects[page - 2] = made.coded(text, (conv + n) % 11)
        return made.packed_file(objects, b"junk before\n" * (conv % 3))

    return made.files_of(t("conversations"), file)


@query(f"WITH {_P} SELECT CAST(conv_id AS VARCHAR) AS doc_id, n::INT AS page_no, rtrim(text, ' ') AS text FROM p")
def pdf_contents_packed(t, spark):
    return _told(pdf_tables.contents(_packed(t)))


@query(f"WITH {_P} SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc_id, pages::INT AS pages, (2 * pages + 5)::INT AS objects, 'OK' AS status FROM p")
def pdf_documents_packed(t, spark):
    return pdf_tables.documents(_packed(t)).select("doc_id", "pages", "objects", "status")


#: Revision and method by conversation; the last one's hash is slow, so few files have it.
_SEALS = ((2, "V2"), (3, "V2"), (4, "V2"), (4, "AESV2"), (5, "AESV3"))
_GIVEN = ("some word", "the ówner")


def _sealed(t) -> DataFrame:
    def file(conv: int, rows) -> bytes:
        revision, method = (6, "AESV3") if conv % 96 == 5 else _SEALS[conv % 5]
        user, owner = [("", "x"), (_GIVEN[0], "x"), ("unknown", _GIVEN[1]), ("unknown", "x")][conv % 4]
        return made.sealed_file(made.base_objects(_texts(rows))[0], revision, method, user, owner, -60 if conv % 2 else -4)

    return made.files_of(t("conversations"), file)


@query(f"WITH {_P} SELECT CAST(conv_id AS VARCHAR) AS doc_id, n::INT AS page_no, rtrim(text, ' ') AS text FROM p WHERE conv_id % 4 <> 3")
def pdf_contents_sealed(t, spark):
    return _told(pdf_tables.contents(_sealed(t), _GIVEN))


@query(f"""WITH {_P} SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc_id, CASE WHEN conv_id % 4 = 3 THEN 'Skip' ELSE 'OK' END AS status, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE pages END::INT AS pages,
true AS encrypted, conv_id % 2 = 1 AND conv_id % 4 <> 3 AS restricted FROM p""")
def pdf_documents_sealed(t, spark):
    return pdf_tables.documents(_sealed(t), _GIVEN).select("doc_id", "status", "pages", "encrypted", "restricted")


@query(f"""WITH {_P} SELECT count(DISTINCT conv_id) AS files, count(DISTINCT conv_id) FILTER (conv_id % 4 <> 3) AS ok, count(DISTINCT conv_id) FILTER (conv_id % 4 = 3) AS skipped, 0::BIGINT AS failed,
count(DISTINCT conv_id) FILTER (conv_id % 2 = 1 AND conv_id % 4 <> 3) AS restricted, CAST(count(*) FILTER (conv_id % 4 <> 3) AS BIGINT) AS pages FROM p""")
def pdf_run_totals(t, spark):
    return pdf_tables.run_totals(pdf_tables.documents(_sealed(t), _GIVEN))


@query(f"WITH {_P} SELECT CAST(conv_id AS VARCHAR) AS doc_id, n::INT AS page_no, rtrim(CASE WHEN conv_id % 5 = 3 AND n = 1 THEN replace(text, 'a', 'A') ELSE text END, ' ') AS text FROM p")
def pdf_contents_recovered(t, spark):
    return _told(pdf_tables.contents(made.files_of(t("conversations"), lambda conv, rows: made.damaged_file(made.base_objects(_texts(rows))[0], conv % 5))))


@query(f"WITH {_P} SELECT CAST(conv_id AS VARCHAR) AS doc_id, n::INT AS page_no, rtrim(CASE WHEN n % 2 = 1 THEN replace(text, 'a', 'A') ELSE text END, ' ') AS text FROM p")
def pdf_contents_updated(t, spark):
    def file(conv: int, rows) -> bytes:
        from ..sources.pdf import Stream

        objects, pages = made.base_objects(_texts(rows))
        changed = {page - 1: Stream({}, text.replace("a", "A").encode()) for page, text in list(zip(pages, _texts(rows), strict=True))[::2]}
        return made.updated_file(objects, changed, [pages[1] - 1], conv % 3 == 0)

    return _told(pdf_tables.contents(made.files_of(t("conversations"), file)))


@query(f"""WITH {_P} SELECT CAST(conv_id AS VARCHAR) AS doc_id, n::INT AS page_no, '[0 0 100 ' || ((n - 1) // 3) || ']' AS media_box, CASE WHEN n % 3 = 2 THEN '90' END AS rotate, rtrim(text, ' ') AS text FROM p""")
def pdf_page_tree(t, spark):
    files = made.files_of(t("conversations"), lambda conv, rows: made.written(made.tree_objects(_texts(rows)), 1))
    pages = pdf_tables.pages(files).select("doc_id", "page_no", F.col("media_box").cast("string").alias("media_box"), F.col("rotate").cast("string").alias("rotate"))
    return pages.join(_told(pdf_tables.contents(files)), ["doc_id", "page_no"])


# -- outlines, links and forms ------------------------------------------------------------


def _linked(t) -> DataFrame:
    return made.files_of(t("conversations"), lambda conv, rows: made.written(made.linked_objects(_texts(rows), rows["role"].tolist(), conv % 2 == 0), 1))


def _merged(t, bookmarks: str = "auto") -> DataFrame:
    files = _linked(t).select((F.col("conv_id") % 10).cast("string").alias("group"), F.col("conv_id").alias("src_ord"), F.col("doc_id").alias("title"), F.lit("odd").alias("spec"), "content")
    return pdf_tables.merge_groups(files, bookmarks=bookmarks)


def _merged_files(t, bookmarks: str = "auto") -> DataFrame:
    return _merged(t, bookmarks).select(F.col("group").alias("doc_id"), "content")


#: Bookmarks: top ones, the number of a page's top one, and pages after a merge of odd pages.
_B = f"""{_P}, b AS (SELECT *, n = 1 OR role = 'user' AS top, role || ' ñ ' || n AS title FROM p
), g AS (SELECT *, max(n) FILTER (top) OVER (PARTITION BY conv_id ORDER BY n) AS over_n FROM b
), sizes AS (SELECT conv_id, (max(n) + 1) // 2 AS taken FROM p GROUP BY conv_id
), files AS (SELECT conv_id, taken, coalesce(sum(taken) OVER (PARTITION BY conv_id % 10 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes)"""


@query(f"""WITH {_B} SELECT CAST(conv_id AS VARCHAR) AS doc_id, n::INT AS ord, CASE WHEN top THEN 0 ELSE 1 END AS depth, title, n::INT AS page_no,
(CASE WHEN top THEN (SELECT count(*) FROM g k WHERE k.conv_id = g.conv_id AND k.over_n = g.n AND NOT k.top) * CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END)::INT AS count FROM g""")
def pdf_outlines(t, spark):
    return pdf_tables.outlines(_linked(t))


@query(f"""WITH {_B}, alive AS (SELECT g.conv_id, n, n AS over_n, 1 AS depth, title, n % 2 = 1 AS shown, (SELECT count(*) FROM g k WHERE k.conv_id = g.conv_id AND k.over_n = g.n AND NOT k.top AND k.n % 2 = 1) AS kids FROM g WHERE top
), tops AS (SELECT * FROM alive WHERE shown OR kids > 0
), told AS (SELECT conv_id, n, depth, title, shown, kids * CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END AS count FROM tops
UNION ALL SELECT conv_id, n, 2, title, true, 0 FROM g WHERE NOT top AND n % 2 = 1
UNION ALL SELECT conv_id, 0, 0, CAST(conv_id AS VARCHAR), true, count(*) + CASE WHEN conv_id % 2 = 0 THEN sum(kids) ELSE 0 END FROM tops GROUP BY conv_id)
SELECT CAST(conv_id % 10 AS VARCHAR) AS doc_id, (row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, n))::INT AS ord, depth::INT AS depth, title, CASE WHEN shown THEN start + (greatest(n, 1) + 1) // 2 END::INT AS page_no, count::INT AS count FROM told JOIN files USING (conv_id)""")
def pdf_merge_outlines(t, spark):
    return pdf_tables.outlines(_merged_files(t))


@query(f"""WITH {_B} SELECT CAST(conv_id % 10 AS VARCHAR) AS doc_id, (row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id))::INT AS ord, 0 AS depth, CAST(conv_id AS VARCHAR) AS title, (start + 1)::INT AS page_no, 0 AS count FROM files""")
def pdf_merge_outlines_files(t, spark):
    return pdf_tables.outlines(_merged_files(t, "files"))


@query(f"""WITH {_B}, tops AS (SELECT g.conv_id, n FROM g WHERE top AND (n % 2 = 1 OR EXISTS (SELECT 1 FROM g k WHERE k.conv_id = g.conv_id AND k.over_n = g.n AND NOT k.top AND k.n % 2 = 1))
), told AS (SELECT conv_id, n, 0 AS depth FROM tops UNION ALL SELECT conv_id, n, 1 FROM g WHERE NOT top AND n % 2 = 1)
SELECT CAST(conv_id % 10 AS VARCHAR) AS doc_id, depth, count(*) AS n FROM told GROUP BY ALL""")
def pdf_merge_outlines_keep(t, spark):
    return pdf_tables.outlines(_merged_files(t, "keep")).groupBy("doc_id", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_P}, s AS (SELECT unnest([1, 2]) AS step) SELECT CAST(conv_id AS VARCHAR) AS doc_id, n::INT AS page_no, step AS ord, (n + step)::INT AS target FROM p, s WHERE n + step <= pages""")
def pdf_links(t, spark):
    return pdf_tables.links(_linked(t))


@query(f"""WITH {_B}, s AS (SELECT unnest([1, 2]) AS step) SELECT CAST(conv_id % 10 AS VARCHAR) AS doc_id, (start + (n + 1) // 2)::INT AS page_no, step AS ord, CASE WHEN step = 2 THEN start + (n + 3) // 2 END::INT AS target
FROM p JOIN files USING (conv_id), s WHERE n % 2 = 1 AND n + step <= pages""")
def pdf_merge_links(t, spark):
    return pdf_tables.links(_merged_files(t))


@query(f"""WITH {_B}, f AS (SELECT conv_id, role, min(n) AS first, count(*) AS kids FROM p WHERE n % 2 = 1 GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id % 10, role ORDER BY conv_id) AS k FROM f)
SELECT CAST(conv_id % 10 AS VARCHAR) AS doc_id, role || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name, kids::INT AS kids, 'v' AS value FROM o""")
def pdf_merge_forms(t, spark):
    return pdf_tables.fields(_merged_files(t)).select("doc_id", "name", "kids", "value")


@query(f"""WITH {_P}, f AS (SELECT DISTINCT conv_id, role FROM p WHERE n % 2 = 1) SELECT CAST(conv_id % 10 AS VARCHAR) AS "group", count(*)::INT AS fields, (count(*) - count(DISTINCT role))::INT AS renamed FROM f GROUP BY 1""")
def pdf_merge_renamed(t, spark):
    return _merged(t).select("group", "fields", "renamed")


@query(f"""WITH {_B} SELECT CAST(conv_id % 10 AS VARCHAR) AS doc_id, (start + (n + 1) // 2)::INT AS page_no, rtrim(text, ' ') AS text FROM p JOIN files USING (conv_id) WHERE n % 2 = 1""")
def pdf_merge_contents(t, spark):
    return _told(pdf_tables.contents(_merged_files(t)))


@query(f"""WITH {_P}, c AS (SELECT conv_id, max(pages) AS pages FROM p GROUP BY conv_id
), g AS (SELECT conv_id % 10 AS g, count(*) FILTER (conv_id % 7 <> 3) AS files, coalesce(sum(pages) FILTER (conv_id % 7 <> 3), 0) AS pages, bool_or(conv_id % 7 = 3) AS broken FROM c GROUP BY 1)
SELECT CAST(g AS VARCHAR) AS "group", 'skip' AS mode, files::INT AS files, (CASE WHEN files > 0 THEN pages ELSE 0 END)::INT AS pages, CASE WHEN files > 0 THEN 'OK' ELSE 'Fail' END AS status FROM g
UNION ALL SELECT CAST(g AS VARCHAR), 'strict', files::INT, (CASE WHEN broken OR files = 0 THEN 0 ELSE pages END)::INT, CASE WHEN broken OR files = 0 THEN 'Fail' ELSE 'OK' END FROM g""")
def pdf_skip_errors(t, spark):
    def file(conv: int, rows) -> bytes:
        data = made.written(made.base_objects(_texts(rows))[0], 1)
        return data.replace(b"/Catalog", b"/Cat").replace(b"/Root", b"/Roof") if conv % 7 == 3 else data

    files = made.files_of(t("conversations"), file).select((F.col("conv_id") % 10).cast("string").alias("group"), F.col("conv_id").alias("src_ord"), F.col("doc_id").alias("title"), F.lit("").alias("spec"), "content")
    told = [pdf_tables.merge_groups(files, skip_errors=mode == "skip").select("group", F.lit(mode).alias("mode"), "files", "pages", "status") for mode in ("skip", "strict")]
    return told[0].unionByName(told[1])


@query(f"""WITH {_P} SELECT CAST(conv_id AS VARCHAR) AS doc_id, n::INT AS page_no, (3 + 2 * n)::INT AS obj_num, (2 + 2 * n)::INT AS content_num FROM p""")
def pdf_edges(t, spark):
    """References from each page to its content, by the edges of objects."""
    objs = pdf_tables.objects(made.files_of(t("conversations"), lambda conv, rows: made.written(made.base_objects(_texts(rows))[0], 1)))
    kinds = objs.select("doc_id", F.col("num").alias("dst_num"), F.col("tag").alias("dst_tag"))
    page = objs.where("type_name = 'Page'").select("doc_id", F.col("num").alias("src_num"))
    found = pdf_tables.edges(objs).join(page, ["doc_id", "src_num"]).join(kinds, ["doc_id", "dst_num"]).where("dst_tag = 'stream'")
    return found.select("doc_id", ((F.col("src_num") - 3) / 2).cast("int").alias("page_no"), F.col("src_num").alias("obj_num"), F.col("dst_num").alias("content_num"))
