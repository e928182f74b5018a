"""CSV exports: triage, detection, readers (S-01 to S-08)."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as N
from ..functions.parsing import clean_headers
from ..operators import normalize
from ..schemas import SCHEMAS, StoreTables
from . import scratch

# Columns by which an export is recognised, and delimiters in order of preference.
SIGNATURES = {
    "shopify_orders": ["Name", "Created at", "Lineitem quantity", "Lineitem price"],
    "shopify_products": ["SKU", "Title"],
    "stripe": ["id", "Amount", "Status"],
    "google_ads": ["Day", "Campaign", "Cost"],
}
DELIMITERS = [",", ";", "\t", "|"]
#: By source, what stages an export's cells, and what makes tables of them.
NORMALIZE = {
    "shopify_orders": (normalize.order_cells, normalize.order_tables),
    "shopify_products": (normalize.product_cells, normalize.product_tables),
    "stripe": (normalize.payment_cells, normalize.payment_tables),
    "google_ads": (normalize.ad_cells, normalize.ad_tables),
}


_CODES = [(chr(b), bytes([b]).decode("windows-1252", "replace")) for b in range(0x80, 0xA0)]
#: Control characters of ISO 8859-1, and what windows-1252 has in their places.
_WINDOWS = "".join(a for a, b in _CODES if b != "\ufffd"), "".join(b for _, b in _CODES if b != "\ufffd")


_UNDEFINED = [bytes([b]) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
#: Bytes of a file's head, lines of it in which the header is looked for, and bytes read at a time.
HEAD, PREAMBLE, BLOCK = 8192, 10, 1 << 20
# How files of other kinds begin.
REFUSED = [(b"PK\x03\x04", "xlsx_or_zip"), (b"\xd0\xcf\x11\xe0", "xls"), (b"%PDF", "pdf"), (b"\xff\xfe", "utf16"), (b"\xfe\xff", "utf16")]
#: Stores that a task can open by itself; elsewhere Spark reads the files, whole.
OPENED = {"file", "hdfs", "s3", "s3a", "gs"}


#: Most bytes of a line that is looked at for quotes.
LINE = 1 << 24
_QUOTED = rb'"(?:[^",;\t|]|[,;\t|](?!")|"")*+"'
_LINE = re.compile(rb'(?:%s|[^",;\t|]*+)(?:[,;\t|](?:%s|[^",;\t|]*+))*+' % (_QUOTED, _QUOTED))


class _Lines:
    """Whether each line of a file stands by itself, so that the file may be cut at any line break.

    Every quoted cell has to begin and end in its line, whichever of the
    delimiters is the file's, and the line breaks have to be all of one kind.
    """

    def __init__(self) -> None:
        self.rest, self.plain, self.breaks = b"", True, [0, 0, 0]

    def see(self, block: bytes) -> None:
        if not self.plain:
            return
        held = self.rest + block
        cut = held.rfind(b"\n") + 1
        self._judge(held[:cut])
        self.rest = held[cut:]
        self.plain = self.plain and len(self.rest) <= LINE

    def end(self) -> bool:
        self._judge(self.rest)
        lf, cr, both = self.breaks
        return self.plain and (cr == 0 or cr == both == lf)

    def _judge(self, text: bytes) -> None:
        for i, mark in enumerate((b"\n", b"\r", b"\r\n")):
            self.breaks[i] += text.count(mark)
        if b'"' in text:
            self.plain = self.plain and all(b'"' not in line or _LINE.fullmatch(line.removesuffix(b"\r")) for line in text.split(b"\n"))


def _open(path: str):
    if path.startswith("file:"):
        return open(path[5:].replace("//", "/", 1) if path.startswith("file://") else path[5:], "rb")
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe=":/@"))
    return store.open_input_stream(name)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Head, sha256 and byte checks of each file, read in blocks."""
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            digest, decoder, utf8, undefined, head, lines = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), True, False, b"", _Lines()
            with _open(path) as file:
                while block := file.read(BLOCK):
                    digest.update(block)
                    lines.see(block)
                    head += block[: HEAD - len(head)]
                    undefined = undefined or any(b in block for b in _UNDEFINED)
                    if utf8:
                        try:
                            decoder.decode(block)
                        except UnicodeDecodeError:
                            utf8 = False
            found.append({"head": head, "sha256": digest.hexdigest(), "utf8": utf8 and not decoder.getstate()[0], "undefined": undefined, "plain": lines.end()})
        facts = pa.Table.from_pylist(found, pa.schema([("head", pa.binary()), ("sha256", pa.string()), ("utf8", pa.bool_()), ("undefined", pa.bool_()), ("plain", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(c.combine_chunks() for c in facts.columns)], ["path", "length", *facts.column_names])


def _file_facts(spark: SparkSession, glob: str) -> DataFrame:
    """path, length, head, sha256, utf8, undefined and plain (see ``_Lines``) of each file."""
    files = spark.read.format("binaryFile").load(glob)
    listed = files.select("path", "length")  # contents are not read for these
    schemes = {r.s for r in listed.select(F.split_part("path", F.lit(":"), F.lit(1)).alias("s")).distinct().collect()}
    if schemes <= OPENED:
        return listed.mapInArrow(_scan, "path string, length long, head binary, sha256 string, utf8 boolean, undefined boolean, plain boolean")
    plain = ~F.contains("content", F.lit(b'"')) & ~F.contains("content", F.lit(b"\r"))
    undefined = F.regexp_like(F.regexp_replace(F.hex("content"), "(..)", "$1 "), F.lit("(81|8D|8F|90|9D) "))
    return files.select("path", "length", F.substring("content", 1, HEAD).alias("head"), F.sha2("content", 256).alias("sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"), undefined.alias("undefined"), plain.alias("plain"))


def judge_head(head: bytes, utf8: bool, undefined: bool) -> dict[str, object]:
    """What a file's first bytes say: refusal, encoding, delimiter, header, the lines before it, and source."""
    refused = next((name for start, name in REFUSED if head.startswith(start)), "nul_bytes" if b"\0" in head else None)
    encoding = "UTF-8" if utf8 else "ISO-8859-1" if undefined else "windows-1252"
    # the last character of a head may be cut
    text = head.decode("utf-8", "ignore") if utf8 else head.decode("latin-1")
    lines = re.split("\r?\n", re.sub("^(\ufeff|ï»¿)", "", text))[:PREAMBLE]
    every = {c for columns in SIGNATURES.values() for c in columns}
    options = [([re.sub('^"|"$', "", x).strip() for x in line.split(d)], n, i) for n, line in enumerate(lines) for i, d in enumerate(DELIMITERS)]
    header, n, i = max(options, key=lambda o: (len(every & set(o[0])), -o[1], -o[2]))
    source = max(((len(columns), name) for name, columns in SIGNATURES.items() if set(columns) <= set(header)), default=(0, None))[1]
    return {"refused": refused, "encoding": encoding, "delimiter": DELIMITERS[i], "header": header, "title_rows": n, "header_text": lines[n], "source": source}


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("refused", pa.string()), ("encoding", pa.string()), ("delimiter", pa.string()), ("header", pa.list_(pa.string())), ("title_rows", pa.int32()), ("header_text", pa.string()), ("source", pa.string())]
    for batch in batches:
        found = [judge_head(r["head"], r["utf8"], r["undefined"]) for r in batch.select(["head", "utf8", "undefined"]).to_pylist()]
        columns = [pa.array([f[name] for f in found], kind) for name, kind in kinds]
        own = ["path", "length", "sha256", "plain"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *columns], [*own, *(name for name, _ in kinds)])


def triage_files(spark: SparkSession, glob: str) -> DataFrame:
    """S-05, S-07: per file its sha256, refusal, encoding, delimiter, header, the lines before it, and source.

    A task reads a file in blocks and keeps its first 8 KB; no row holds a
    file. The header is the line, of the first ten, that has most of the known
    columns; lines before it are a title.
    """
    return _file_facts(spark, glob).mapInArrow(_judge, "path string, length long, sha256 string, plain boolean, refused string, encoding string, delimiter string, header array<string>, title_rows int, header_text string, source string")


def _placed(cells: DataFrame, columns: list[str], convert) -> DataFrame:
    """The columns as text, with store_id (the folder), file and row_no."""
    name = F.col("file_path")
    row = F.struct(name.alias("file"), F.col("block").alias("block"), F.col("line").alias("line")).alias("row_no")
    return cells.select(*[convert(F.col(f"`{c}`")).alias(c) for c in columns], name.alias("file"), F.url_decode(F.element_at(F.split(name, "/"), -2)).alias("store_id"), row)


def _converted(encoding: str):
    # Spark reads no windows-1252; it is ISO 8859-1 but for 27 characters
    return (lambda x: F.translate(x, *_WINDOWS)) if encoding == "windows-1252" else (lambda x: x)


def read_export(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", delimiter: str = ",", multi_line: bool = True) -> DataFrame:
    """All columns as text, with store_id (the folder), file and row_no (S-06).

    ``row_no`` is a struct of the file's path, the start of the stretch that a
    task read, and a number that grows within it: rows of all files have one
    total order, whichever reads they came from. ``multi_line`` keeps quoted
    line breaks; a file is then one task, and parallelism comes from many
    files. A file whose lines stand by themselves is split without it.
    """
    read_as = "ISO-8859-1" if encoding == "windows-1252" else encoding
    raw = spark.read.csv(path, header=True, encoding=read_as, sep=delimiter, multiLine=multi_line, quote='"', escape='"', inferSchema=False, enforceSchema=False)
    columns = raw.columns
    numbered = raw.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return clean_headers(_placed(numbered, columns, _converted(encoding)))


def read_titled_export(spark: SparkSession, paths: list[str], header_text: str, header: list[str], encoding: str = "UTF-8", delimiter: str = ",") -> DataFrame:
    """V-11: as ``read_export``, of files whose header follows title rows; a row is a line.

    Each file's header is its first line equal to ``header_text``; lines up to it are left out.
    """
    text = F.decode(F.col("value").cast("binary"), "UTF-8" if encoding == "UTF-8" else "ISO-8859-1")
    numbered = spark.read.text(paths).select(F.regexp_replace(text, "^(\ufeff|ï»¿)|\r$", "").alias("text"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    start = numbered.filter(F.col("text") == header_text).groupBy("file_path").agg(F.min("line").alias("start"))
    body = numbered.join(start, "file_path").filter((F.col("line") > F.col("start")) & (F.length("text") > 0))
    names = [c or f"_c{i}" for i, c in enumerate(header)]
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    parsed = body.select(F.from_csv("text", schema, {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("c"), "file_path", "block", "line").select("c.*", "file_path", "block", "line")
    return clean_headers(_placed(parsed, names, _converted(encoding)))


def _columns(table: str) -> list[str]:
    return [c.split(" ")[0] for c in SCHEMAS[table].replace("decimal(19,4)", "decimal").split(", ")]


def missing_sources(stores: DataFrame, found: DataFrame) -> DataFrame:
    """S-08: an issue for each source that a store lacks, told from the files; no row is read for it."""
    grid = stores.select("store_id").distinct().withColumn("source", F.explode(F.array(*map(F.lit, SIGNATURES))))
    severity = F.when(F.col("source") == "shopify_orders", "error").otherwise("warning")
    missing = grid.join(found.select("store_id", "source").distinct(), ["store_id", "source"], "left_anti")
    return missing.select("store_id", "source", F.lit("missing_source").alias("kind"), severity.alias("severity"), F.format_string("no %s export", "source").alias("message"), F.lit(1).cast("long").alias("count"))


def _gather(spark: SparkSession, parts: dict[str, dict[str, DataFrame]], stores: DataFrame, found: DataFrame) -> StoreTables:
    """Canonical tables from the normalised sources, and an issue for each source that a store lacks.

    ``stores`` has store_id of all that are known, whatever was found of them;
    ``found`` has store_id and source.
    """
    empty = lambda t: spark.createDataFrame([], SCHEMAS[t])
    tables = {t: reduce(DataFrame.unionByName, [p[t].select(*_columns(t)) for p in parts.values() if t in p], empty(t)) for t in SCHEMAS}
    missing = missing_sources(stores, found)
    return StoreTables(**tables | {"issues": tables["issues"].unionByName(missing)})


def normalized(raw: dict[str, DataFrame], read: Callable[[], None] = lambda: None) -> dict[str, dict[str, DataFrame]]:
    """Tables by source. All rows are staged first; then ``read`` is called, as the files are not needed any more."""
    cells = {s: NORMALIZE[s][0](rows) for s, rows in raw.items()}
    read()
    return {s: NORMALIZE[s][1](c) for s, c in cells.items()}


def load_stores(spark: SparkSession, paths: dict[str, str], **options: object) -> StoreTables:
    """S-08: canonical tables from exports whose sources and encoding are known."""
    raw = {s: read_export(spark, p, **options) for s, p in paths.items()}
    found = reduce(DataFrame.unionByName, [rows.select("store_id", F.lit(s).alias("source")).distinct() for s, rows in raw.items()])
    return _gather(spark, normalized(raw), found, found)


@dataclass(frozen=True)
class Exports:
    """What lies in a folder: triaged files, raw rows by source as the files have them, issues of files that can't be read."""

    files: DataFrame
    raw: dict[str, DataFrame]
    issues: DataFrame


def export_files(spark: SparkSession, glob: str) -> DataFrame:
    """The triaged files with their stores, staged."""
    files = triage_files(spark, glob).withColumn("store_id", F.url_decode(F.element_at(F.split("path", "/"), -2)))
    return scratch.table(files, "exports-files")


def open_exports(spark: SparkSession, glob: str, sources: list[str] | None = None) -> Exports:
    """S-05 to S-08, V-11: raw rows by source of whatever files lie there; with ``sources`` the rows of those alone.

    Triage finds source, encoding, delimiter and header of each file, and files
    that agree in them are read together. Rows are not staged here: what
    normalises them reads them once and stages them with their numbers read.
    The driver sees the files' paths, as it does for any read.
    """
    files = export_files(spark, glob)
    bad = files.withColumn("reason", F.coalesce("refused", F.when(F.col("source").isNull(), "unknown_columns"))).filter("reason is not null")
    issues = bad.groupBy("store_id", "reason").agg(F.count(F.lit(1)).alias("count")).select(
        "store_id", F.lit("files").alias("source"), F.lit("refused_file").alias("kind"), F.lit("error").alias("severity"), F.col("reason").alias("message"), "count"
    )
    raw: dict[str, DataFrame] = {}
    titled = F.col("title_rows") > 0
    way = ["source", "encoding", "delimiter", "plain", F.when(titled, F.col("header_text")).alias("header_text"), F.when(titled, F.col("header")).alias("header")]
    wanted = files.filter("refused is null and source is not null")
    alike = (wanted if sources is None else wanted.filter(F.col("source").isin(sources))).groupBy(*way).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    for r in alike.orderBy("source", "encoding", "delimiter", "plain", "header_text").collect():  # a row for each way a source is written
        if r.header_text is None:
            rows = read_export(spark, r.paths, r.encoding, r.delimiter, multi_line=not r.plain)
        else:
            rows = read_titled_export(spark, r.paths, r.header_text, r.header, r.encoding, r.delimiter)
        raw[r.source] = raw[r.source].unionByName(rows, allowMissingColumns=True) if r.source in raw else rows
    return Exports(files, raw, issues)


def read_exports(spark: SparkSession, glob: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Raw rows by source, and issues of files that can't be read."""
    found = open_exports(spark, glob)
    return found.raw, found.issues


def load_exports(spark: SparkSession, glob: str, read: Callable[[], None] = lambda: None) -> StoreTables:
    """Files to canonical tables in one step, with every issue that reading them raised; ``read`` is called when the files are not needed any more."""
    found = open_exports(spark, glob)
    parts = normalized(found.raw, read)
    tables = _gather(spark, parts, found.files, found.files.filter("refused is null and source is not null"))
    return replace(tables, issues=tables.issues.unionByName(found.issues.select(*_columns("issues"))))


#: The columns that date a payment, by preference.
PAYMENT_DATES = ["Created (UTC)", "Created", "created"]


def format_probes(found: Exports) -> DataFrame:
    """V-11: per file the title rows before its header, the date column in use, other columns that look like one, and total rows.

    A total row of an advertising export has no day or no campaign, and says "total" in one of them.
    """
    files = found.files.filter("refused is null and source is not null")
    dates = F.array(*map(F.lit, PAYMENT_DATES))
    used = F.when(F.col("source") == "stripe", F.element_at(F.filter(dates, lambda c: F.array_contains(F.col("header"), c)), 1))
    others = F.filter("header", lambda c: F.contains(F.lower(c), F.lit("created")) & ~c.eqNullSafe(F.col("date_column")))
    out = files.withColumn("date_column", used).withColumn("other_date_columns", F.when(F.col("source") == "stripe", F.array_join(others, ",")))
    totals = None
    if "google_ads" in found.raw:
        rows = found.raw["google_ads"]
        first = F.coalesce(N.first_present(rows, "Campaign"), N.first_present(rows, "Day"), F.lit(""))
        undated = N.first_present(rows, "Campaign").isNull() | ~F.coalesce(N.first_present(rows, "Day"), F.lit("")).rlike("[0-9]")
        totals = rows.groupBy(F.col("file").alias("t_file")).agg(F.count_if(undated & F.startswith(F.lower(first), F.lit("total"))).alias("total_rows"))
        out = out.join(totals, F.url_decode(F.regexp_replace("t_file", "^file:/+", "file:/")) == F.regexp_replace("path", "^file:/+", "file:/"), "left")
    count = F.when(F.col("source") == "google_ads", F.coalesce("total_rows", F.lit(0))) if totals is not None else F.lit(None).cast("long")
    return out.select("store_id", "path", "source", "title_rows", "date_column", "other_date_columns", count.alias("total_rows"))


def validate_exports(raw: dict[str, DataFrame], read: Callable[[], None] = lambda: None) -> DataFrame:
    """Q-12: per store and source the rows read, accepted and rejected, issues, period, currency and verdict.

    A source is invalid if a file was refused for a number or nothing was
    accepted, valid with issues if any warning or error was raised. The rows
    are read once, and ``read`` is called when that is done.
    """
    facts = {"shopify_orders": ("orders", "created_at"), "shopify_products": ("products", None), "stripe": ("payments", "created_at"), "google_ads": ("ad_daily", "day")}
    out = []
    for source, parts in normalized(raw, read).items():
        name, at = facts[source]
        day = F.to_date(at) if at else F.lit(None).cast("date")
        code = F.when(F.countDistinct("currency") == 1, F.max("currency")) if name == "orders" else F.lit(None).cast("string")
        seen = parts[name].groupBy("store_id").agg(F.count(F.lit(1)).alias("accepted_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), code.alias("currency"))
        if name == "orders":  # an order's further lines count too
            seen = seen.drop("accepted_rows").join(parts["accepted_rows"], "store_id", "left")
        found = parts["issues"].filter("severity <> 'info'").groupBy("store_id").agg(F.sum("count").alias("issues"), F.count_if(F.col("kind") == "malformed_number").alias("malformed"))
        both = parts["rows_read"].join(seen, "store_id", "left").join(found, "store_id", "left").fillna(0, ["accepted_rows", "issues", "malformed"])
        verdict = F.when((F.col("accepted_rows") == 0) | (F.col("malformed") > 0), "invalid").when(F.col("issues") > 0, "valid_with_issues").otherwise("valid")
        out.append(both.select("store_id", F.lit(source).alias("source"), "rows_read", "accepted_rows", (F.col("rows_read") - F.col("accepted_rows")).alias("rejected_rows"), "issues", "first_day", "last_day", "currency", verdict.alias("verdict")))
    return reduce(DataFrame.unionByName, out)
