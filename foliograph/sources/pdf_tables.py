"""PDF files as tables, and merges as a group operation.

Each file is parsed in one task and gives rows; nothing of a file's problem stops the
others: it is a status row, and ``strict`` raises where that is wanted. Hashes are made
where a file is parsed, so finding equal objects across files is one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merkle
from .pdf import Document, PasswordError, Ref, Stream, Text, parse, walk, whole
from .pdf_merge import Source, merge, selected
from .pdf_write import digests, has_identity, printed, segments

DOCS = "doc_id string, length long, pages int, objects int, encrypted boolean, restricted boolean, status string, error string"
OBJECTS = "doc_id string, num int, tag string, type_name string, subtype string, raw_len long, identity boolean, digest binary, refs array<int>, segments array<binary>"
PAGES = "doc_id string, page_no int, obj_num int, media_box binary, crop_box binary, resources binary, rotate binary"
CONTENTS = "doc_id string, page_no int, content binary"
OUTLINES = "doc_id string, ord int, depth int, title string, page_no int, count int"
LINKS = "doc_id string, page_no int, ord int, target int"
FIELDS = "doc_id string, ord int, name string, kids int, value string"
MERGED = "group string, content binary, files int, pages int, bytes_in long, bytes_out long, merged int, bytes_saved long, bookmarks int, fields int, renamed int, status string, error string"


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, content) of files; doc_id is the path."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("doc_id"), "content")


def _tag(value: object) -> str:
    kinds = ((Stream, "stream"), (dict, "dict"), (list, "array"), (Ref, "ref"), (bool, "bool"), (int, "integer"), (float, "real"), (bytes, "string"), (str, "name"))
    return next((t for k, t in kinds if isinstance(value, k)), "null")


def _parsed(batches: Iterator[pa.RecordBatch], passwords: tuple[str, ...]) -> Iterator[tuple[str, bytes, Document | None, str, str]]:
    for batch in batches:
        for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                doc = parse(content or b"", passwords)
                doc.pages()
                yield doc_id, content or b"", doc, "OK", ""
            except Exception as e:  # one file's problem is its own row
                yield doc_id, content or b"", None, "Skip" if isinstance(e, PasswordError) else "Fail", f"{type(e).__name__}: {e}"[:500]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def documents(files: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """A row for each file: sizes, flags, and OK, Skip (no password fits) or Fail."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, content, doc, status, error in _parsed(batches, passwords):
            opener = doc.opener if doc else None
            yield _table([(doc_id, len(content), len(doc.pages()) if doc else 0, len(doc.places) if doc else 0, opener is not None or status == "Skip", bool(opener and opener.restricted), status, error or None)], DOCS)

    return files.select("doc_id", "content").mapInArrow(rows, DOCS)


def run_totals(docs: DataFrame) -> DataFrame:
    """One row about documents(): files by status, restricted ones, and pages."""
    by = {"ok": "OK", "skipped": "Skip", "failed": "Fail"}
    return docs.agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("status") == v).alias(k) for k, v in by.items()], F.count_if("restricted").alias("restricted"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


def strict(docs: DataFrame) -> DataFrame:
    """documents() that raises at the first file that isn't OK."""
    return docs.withColumn("status", F.when(F.col("status") == "OK", F.col("status")).otherwise(F.raise_error(F.concat("doc_id", F.lit(": "), "error"))))


def objects(files: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """A row for each object of the files that can be read, with its Merkle digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, _, doc, _, _ in _parsed(batches, passwords):
            if doc is None:
                continue
            every = {n: doc.get(n) for n in sorted(doc.places)}
            own, out = digests(every, str(doc_id).encode()), []
            for n, v in every.items():
                d = v.head if isinstance(v, Stream) else v if isinstance(v, dict) else {}
                name = lambda k, d=d: str(d[k]) if isinstance(d.get(k), str) else None
                out.append((doc_id, n, _tag(v), name("Type"), name("Subtype"), len(v.raw) if isinstance(v, Stream) else 0, has_identity(v), own[n], sorted({x.num for x in walk(v) if isinstance(x, Ref)}), segments(v)[0]))
            yield _table(out, OBJECTS)

    return files.select("doc_id", "content").mapInArrow(rows, OBJECTS)


def edges(objs: DataFrame) -> DataFrame:
    """(doc_id, src_num, dst_num) of the objects' references."""
    return objs.select("doc_id", F.col("num").alias("src_num"), F.explode("refs").alias("dst_num"))


def pages(files: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """A row for each page in order, with inherited attributes as printed values."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, _, doc, _, _ in _parsed(batches, passwords):
            found = doc.pages() if doc else []
            if found:
                yield _table([(doc_id, k, p.num, *(printed(doc.resolve(p.attrs[a])) if a in p.attrs else None for a in ("MediaBox", "CropBox", "Resources", "Rotate"))) for k, p in enumerate(found, 1)], PAGES)

    return files.select("doc_id", "content").mapInArrow(rows, PAGES)


def _each(files: DataFrame, schema: str, told: Callable[[Document], Iterator[tuple]], passwords: tuple[str, ...]) -> DataFrame:
    """doc_id and the rows that a function tells of each file that can be read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, _, doc, _, _ in _parsed(batches, passwords):
            found = [(doc_id, *r) for r in told(doc)] if doc else []
            if found:
                yield _table(found, schema)

    return files.select("doc_id", "content").mapInArrow(rows, schema)


def contents(files: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """The bytes of each page's content, decrypted and through its filters."""

    def told(doc: Document) -> Iterator[tuple]:
        for k, p in enumerate(doc.pages(), 1):
            value = doc.resolve(p.attrs.get("Contents"))
            parts = [doc.resolve(v) for v in (value if isinstance(value, list) else [value])]
            yield k, b"\n".join(doc.decoded(v) for v in parts if isinstance(v, Stream))

    return _each(files, CONTENTS, told, passwords)


def _shown_text(value: object) -> str | None:
    if not isinstance(value, Text):
        return None
    return bytes(value[2:]).decode("utf-16-be", "replace") if value.startswith(b"\xfe\xff") else bytes(value).decode("latin-1")


class _Targets:
    """Page numbers of destinations."""

    def __init__(self, doc: Document):
        self.doc, self.numbers, self.pages = doc, {}, len(doc.pages())
        for k, p in enumerate(doc.pages(), 1):
            self.numbers.setdefault(p.num, k)

    def of(self, node: dict) -> int | None:
        value = node.get("Dest")
        if value is None:
            action = self.doc.mapping(node.get("A"))
            value = action.get("D") if action.get("S") == "GoTo" else None
        explicit = self.doc.destination(value)
        page = explicit[0] if explicit else None
        if isinstance(page, Ref):
            return self.numbers.get(page.num)
        return page + 1 if isinstance(page, int) and not isinstance(page, bool) and 0 <= page < self.pages else None


def outlines(files: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """Bookmarks in the order they show; count is the signed one that is written."""

    def told(doc: Document) -> Iterator[tuple]:
        targets, seen, k = _Targets(doc), set(), 0
        stack = [(doc.mapping(doc.root.get("Outlines")).get("First"), 0)]
        while stack:
            ref, depth = stack.pop()
            if not isinstance(ref, Ref) or ref.num in seen or depth > 64:
                continue
            seen.add(ref.num)
            node, k = doc.mapping(ref), k + 1
            yield k, depth, _shown_text(doc.resolve(node.get("Title"))), targets.of(node), whole(node.get("Count")) or 0
            stack += [(node.get("Next"), depth), (node.get("First"), depth + 1)]

    return _each(files, OUTLINES, told, passwords)


def links(files: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """Link annotations of each page; target is a page number, or null."""

    def told(doc: Document) -> Iterator[tuple]:
        targets = _Targets(doc)
        for k, p in enumerate(doc.pages(), 1):
            nodes = [doc.mapping(a) for a in doc.resolve(p.attrs.get("Annots")) or []]
            for n, node in enumerate((a for a in nodes if a.get("Subtype") == "Link"), 1):
                yield k, n, targets.of(node)

    return _each(files, LINKS, told, passwords)


def fields(files: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """Root fields of the form, with their number of kids."""

    def told(doc: Document) -> Iterator[tuple]:
        for k, f in enumerate(doc.resolve(doc.mapping(doc.root.get("AcroForm")).get("Fields")) or [], 1):
            node = doc.mapping(f)
            yield k, _shown_text(doc.resolve(node.get("T"))), len(doc.resolve(node.get("Kids")) or []), _shown_text(doc.resolve(node.get("V")))

    return _each(files, FIELDS, told, passwords)


def shared_objects(objs: DataFrame) -> DataFrame:
    """objects() with keeper, "doc_id#num" of the first equal object in any file."""
    return merkle.representatives(objs.withColumn("key", F.concat("doc_id", F.lit("#"), F.lpad(F.col("num").cast("string"), 10, "0"))), "digest", "key")


def merge_groups(files: DataFrame, bookmarks: str = "auto", dedupe: bool = True, skip_errors: bool = False, passwords: tuple[str, ...] = ()) -> DataFrame:
    """One merged file for each group of files (group, src_ord, title, spec, content).

    A file that can't be read, or whose pages don't exist, fails its group, or with
    skip_errors is left out of it. A group is one task, as one file is written from it.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, sources, errors = pdf.sort_values("src_ord"), [], []
        for row in pdf.itertuples():
            try:
                doc = parse(row.content, passwords)
                sources.append(Source(doc, selected(doc.pages(), row.spec or ""), row.title or ""))
            except Exception as e:
                errors.append(f"{row.title}: {e}")
        out = {"group": pdf["group"].iloc[0], "content": None, "files": len(sources), "pages": 0, "bytes_in": int(pdf["content"].map(len).sum()), "bytes_out": 0, "merged": 0, "bytes_saved": 0, "bookmarks": 0, "fields": 0, "renamed": 0, "status": "OK", "error": "; ".join(errors) or None}
        if (errors and not skip_errors) or not sources:
            out["status"] = "Fail"
        else:
            content, stats = merge(sources, bookmarks, dedupe)
            out |= {"content": content, "bytes_out": len(content)} | {k: stats[k] for k in ("pages", "merged", "bytes_saved", "bookmarks", "fields", "renamed")}
        return pd.DataFrame([out])

    return files.select("group", "src_ord", "title", "spec", "content").groupBy("group").applyInPandas(one, MERGED)
