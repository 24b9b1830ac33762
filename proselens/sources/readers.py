"""Documents from text files, tables, PDF and vector stores."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.layout import LAYOUT, block_spans, styled_lines
from ..operators.structure import page_of_styled_lines
from ..session import keep, shared_folder, ship


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a small file of one row group would else be one task's work.
    Inputs with more splits than cores, as large ones have, aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table; others aren't read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source, text): each file is a document; ids are hashes of the paths."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    return raw.select(F.xxhash64("source").alias("doc_id"), "source", "text")


def from_frame(df: DataFrame, text: str, doc_id: str | None = None, order: str | None = None) -> DataFrame:
    """(doc_id, text) of any table; without an id column ids count rows in the given order. The rows are sorted by ranges
    and written once; a range's ids begin after the counts of those before it, one number each on the driver."""
    if doc_id:
        return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    rows = df.select(F.col(text).alias("text"), F.col(order or text).alias("order_")).orderBy("order_").select("text", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at_"))
    rows.write.parquet(path)
    kept = spark.read.parquet(path)
    counts = sorted((r["part_"], r["count"]) for r in kept.groupBy("part_").count().collect())
    begin = [(p, end - n) for (p, n), end in zip(counts, itertools.accumulate(n for _, n in counts), strict=True)]
    return kept.join(F.broadcast(spark.createDataFrame(begin, "part_ int, begin_ long")), "part_").select((F.col("begin_") + F.col("at_")).alias("doc_id"), "text")


#: Makes layout rows (dicts of operators.layout.LAYOUT without doc_id) of a PDF's bytes, of its first max_pages pages if given.
Extractor = Callable[[bytes, int | None], Iterable[dict]]


def pdfplumber_lines(data: bytes, max_pages: int | None = None) -> Iterator[dict]:
    """Lines of characters by pdfplumber, which must be installed where executors run; the text's paragraphs of pages
    without characters."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for k, page in enumerate(pdf.pages[: max_pages or None]):
            yield from char_lines(page.chars, k) or plain_paragraphs(page.extract_text() or "", k)


def pymupdf_blocks(data: bytes, max_pages: int | None = None) -> Iterator[dict]:
    """Blocks of spans by PyMuPDF, which must be installed where executors run."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        for k in range(min(len(pdf), max_pages or len(pdf))):
            yield from block_spans(pdf[k].get_text("dict"), k)


def char_lines(chars: list[dict], page: int) -> list[dict]:
    """Layout rows of a page's characters: lines by rounded top, characters from left to right."""
    lines: dict[int, list[dict]] = {}
    for c in sorted(chars, key=lambda c: (c["top"], c["x0"])):
        lines.setdefault(round(c["top"]), []).append(c)
    out = []
    for _, cs in sorted(lines.items()):
        cs = sorted(cs, key=lambda c: c["x0"])
        text, fonts = "".join(c["text"] for c in cs), [(c.get("fontname") or "").lower() for c in cs]
        if text.strip():
            sizes = [c.get("size") or 0.0 for c in cs]
            out.append({"seq": len(out), "text": text, "page": page, "x0": min(c["x0"] for c in cs), "x1": max(c["x1"] for c in cs), "top": min(c["top"] for c in cs), "bottom": max(c["bottom"] for c in cs), "font_size": sum(sizes) / len(sizes), "bold": any("bold" in f for f in fonts), "ital": any("ital" in f or "oblique" in f for f in fonts)})
    return out


def plain_paragraphs(text: str, page: int = 0) -> list[dict]:
    """Layout rows of plain text: paragraphs at blank lines, 100 points each."""
    kept = [x for x in re.split(r"\n\s*\n", text) if x.strip()]
    return [{"seq": k, "text": x, "page": page, "x0": 0.0, "x1": 0.0, "top": 100.0 * k, "bottom": 100.0 * (k + 1), "font_size": 0.0, "bold": False, "ital": False} for k, x in enumerate(kept)]


#: Extractors by name, in the order in which they are tried.
EXTRACTORS: dict[str, Extractor] = {"pymupdf": pymupdf_blocks, "pdfplumber": pdfplumber_lines}


def extract_first(data: bytes, max_pages: int | None, extractors: Iterable[Extractor]) -> list[dict]:
    """The rows of the first extractor that gives any; an error that tells of each one's fault if none does."""
    faults = []
    for f in extractors:
        try:
            if rows := list(f(data, max_pages)):
                return rows
            faults.append(f"{f.__name__}: no text")
        except Exception as e:  # the next one is tried
            faults.append(f"{f.__name__}: {type(e).__name__}: {e}")
    raise ValueError("; ".join(faults) or "no extractor")


def pdf_files(spark: SparkSession, path: str, extract: Extractor | Iterable[Extractor] | None = None, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(layout rows, errors): pages are limited before they are extracted, and the next extractor is tried where one fails
    or finds nothing. Files of which none makes anything are rows of errors (doc_id, source, message) and don't stop the job."""
    ship(spark)
    extractors = tuple(EXTRACTORS.values()) if extract is None else (extract,) if callable(extract) else tuple(extract)
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = f"source string, message string, {LAYOUT}"
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in fields.split(", "))])

    def run(batches):
        for b in batches:
            for d, source, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    rows = [{"doc_id": d, "source": source, "message": None, **r} for r in extract_first(data, max_pages, extractors) if not max_pages or r["page"] < max_pages]
                except Exception as e:  # any fault of a file is that file's own
                    rows = [{"doc_id": d, "source": source, "message": f"{type(e).__name__}: {e}"[:500]}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source"), "content")
    got = files.mapInArrow(run, fields)
    return got.where(F.col("message").isNull()).drop("source", "message"), got.where(F.col("message").isNotNull()).select("doc_id", "source", "message")


#: Gives of a PDF's bytes, of its first max_pages pages if given, {"page" from 0, "dict": the page as PDF libraries describe
#: it (operators.layout.styled_lines), "text": its plain text}; the two may be functions, which are called as needed.
PageReader = Callable[[bytes, int | None], Iterable[dict]]


def pymupdf_pages(data: bytes, max_pages: int | None = None) -> Iterator[dict]:
    """Pages by PyMuPDF, which must be installed where executors run."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        for k in range(min(len(pdf), max_pages or len(pdf))):
            yield {"page": k, "dict": lambda p=pdf[k]: p.get_text("dict"), "text": lambda p=pdf[k]: p.get_text("text")}


def page_rows(page: dict) -> list[dict]:
    """A page's styled lines; if it has none, or they can't be read, its plain text as one row without a size."""
    get = lambda k: page[k]() if callable(page.get(k)) else page.get(k)
    number = page["page"] + 1
    try:
        lines = [{"page": number, "seq": r["seq"], "text": r["text"], "size": r["size"], "flags": r["flags"]} for r in styled_lines(get("dict") or {})]
    except Exception:  # its plain text is left
        lines = []
    if lines:
        return lines
    if not isinstance(text := get("text") or "", str):
        raise TypeError("the page's text is no string")
    return [{"page": number, "seq": 0, "text": text, "size": None, "flags": None}]


def styled_pages(spark: SparkSession, path: str, read: PageReader = pymupdf_pages, max_pages: int | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of PDF files, of those in only (doc_id) if it is given: (doc_id, page, text), which analyse and structure.blocks take. Each page is put together
    from its styled lines (structure.page_of_styled_lines), or is its tidied plain text where it has none, so pages of both
    kinds stand next to each other. A page that can't be read, or a whole file, is a row of errors (doc_id, source, page,
    message); the others stay. Files are read once, into the shared folder."""
    ship(spark)
    fields = "doc_id long, source string, page int, seq int, text string, size double, flags int, message string"
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("page", pa.int32()), ("seq", pa.int32()), ("text", pa.string()), ("size", pa.float64()), ("flags", pa.int32()), ("message", pa.string())])

    def of_file(data: bytes) -> Iterator[dict]:
        said = lambda e: f"{type(e).__name__}: {e}"[:500]
        pages = iter(read(data, max_pages))
        while True:
            try:
                page = next(pages, None)
            except Exception as e:  # no page follows
                yield {"message": said(e)}
                return
            if page is None:
                return
            if max_pages and page["page"] >= max_pages:
                continue
            try:
                yield from page_rows(page)
            except Exception as e:  # the page's own
                yield {"page": page["page"] + 1, "message": said(e)}

    def run(batches):
        for b in batches:
            for d, source, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = [{"doc_id": d, "source": source, **r} for r in of_file(data)] or [{"doc_id": d, "source": source, "message": "no pages"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source"), "content")
    files = files if only is None else files.join(only.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "source", "content")
    got = keep(files.mapInArrow(run, fields), "pages")
    fine, styled = F.col("message").isNull(), F.col("size").isNotNull()
    plain = got.where(fine & ~styled).select("doc_id", "page", T.page_text(F.col("text")).alias("text"))
    lines = page_of_styled_lines(got.where(fine & styled).select("doc_id", "page", "seq", "text", "size", "flags"))
    return lines.unionByName(plain), got.where(~fine).select("doc_id", "source", "page", "message")


def vector_index(spark: SparkSession, vectors: str, meta: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A vector table and, from JSON lines, its metadata, both keyed by vec_id."""
    return spark.read.parquet(vectors), spark.read.json(meta) if meta else None
