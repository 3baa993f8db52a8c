"""Readers with declared schemas, sinks that publish whole or not at all, and facts about files."""

from __future__ import annotations

import hashlib
import json
import posixpath
import shutil
import tempfile
import urllib.request
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.operators.contracts import ContractError
from cartloom.session import shuffle_width


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8", **options: str) -> DataFrame:
    """CSV with a header; empty fields are null; quoted fields may hold line ends. The schema is declared, never inferred."""
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").option("encoding", encoding).option("quote", '"').option("escape", '"')
    for key, value in ({"multiLine": "true"} | options).items():
        reader = reader.option(key, value)
    return reader.csv(path)


def parsed_times(df: DataFrame, columns: list[str], pattern: str | None = None) -> DataFrame:
    """Text columns as timestamps; what can't be read becomes null instead of an error."""
    at = lambda c: F.try_to_timestamp(F.col(c), F.lit(pattern)) if pattern else F.try_to_timestamp(F.col(c))
    return df.withColumns({c: at(c) for c in columns})


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tab-separated, no header, no quoting: a quotation mark is a character like any other."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", False).csv(path)


def read_tsv_strict(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The same as text columns, but the query fails on a line with another number of fields."""
    parts = F.split("value", "\t")
    wrong = F.raise_error(F.concat(F.lit(f"expected {len(columns)} fields: "), F.substring("value", 1, 100)))
    rows = spark.read.text(path).select(F.when(F.size(parts) == len(columns), parts).otherwise(wrong).alias("p"))
    return rows.select(*[F.col("p")[i].alias(c) for i, c in enumerate(columns)])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, parts: int = 0) -> DataFrame:
    """JSON lines, compressed or not. A compressed file is one task: `parts` spreads its rows afterwards."""
    rows = spark.read.schema(schema).json(path)
    return rows.repartition(parts) if parts else rows


# Fixed names of the workbook format.
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the workbook's first sheet: sheets name a relation, and the relation a part."""
    with book.open("xl/workbook.xml") as f:
        sheet = ElementTree.parse(f).find(f"{SHEET_NS}sheets/{SHEET_NS}sheet")
    if sheet is None:
        raise ContractError("a workbook without sheets")
    with book.open("xl/_rels/workbook.xml.rels") as f:
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.parse(f).getroot()}
    return posixpath.normpath(posixpath.join("/xl", parts[sheet.get(f"{LINK_NS}id")])).lstrip("/")


def _plain(holder: ElementTree.Element) -> str:
    """The text of a string item: its own and its runs' (reading aids are not text)."""
    return "".join(t.text or "" for path in (f"{SHEET_NS}t", f"{SHEET_NS}r/{SHEET_NS}t") for t in holder.iterfind(path))


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return [_plain(e) for _, e in ElementTree.iterparse(f) if e.tag == f"{SHEET_NS}si"]


def _column(reference: str | None, following: int) -> int:
    """0-based column of a cell reference as BC12; the following one where a cell has none."""
    digits = [ord(c) - 64 for c in reference or "" if "A" <= c <= "Z"]
    return sum(d * 26**i for i, d in enumerate(reversed(digits))) - 1 if digits else following


def _sheet_rows(book: zipfile.ZipFile) -> Iterator[dict[int, str]]:
    """Column -> value of each row, one row in memory at a time."""
    strings = _strings(book)
    with book.open(_first_sheet(book)) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{SHEET_NS}row":
                continue
            values: dict[int, str] = {}
            at = -1
            for cell in row:
                at = _column(cell.get("r"), at + 1)
                kind, inline, value = cell.get("t"), cell.find(f"{SHEET_NS}is"), cell.findtext(f"{SHEET_NS}v")
                if inline is not None:
                    values[at] = _plain(inline)
                elif value is not None:
                    values[at] = strings[int(value)] if kind == "s" else value
            yield values
            row.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, all columns text, the first row as header. Read by the driver: for small files."""
    with zipfile.ZipFile(path) as book:
        head, *rows = [*_sheet_rows(book)] or [{}]
    names = [head.get(i, f"column{i}") for i in range(max(head, default=-1) + 1)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(r.get(i) for i in range(len(names))) for r in rows], schema)


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def publish(df: DataFrame, path: str, force: bool = False, compression: str = "zstd") -> None:
    """Write Parquet beside `path` and rename it into place; refuses to replace what is there unless forced.

    Every publisher writes to a folder of its own. A table that is replaced is first moved aside, and back if the new one cannot
    take its place, so a failure loses neither.
    """
    spark, mine = df.sparkSession, uuid.uuid4().hex
    target, fs = _path(spark, path)
    staging, _ = _path(spark, f"{path.rstrip('/')}.staging-{mine}")
    aside, _ = _path(spark, f"{path.rstrip('/')}.replaced-{mine}")
    if fs.exists(target) and not force:
        raise FileExistsError(path)
    try:
        df.write.option("compression", compression).parquet(staging.toString())
        if old := fs.exists(target):
            if not force:
                raise FileExistsError(path)
            _rename(fs, target, aside)
        try:
            _rename(fs, staging, target)
        except Exception:
            if old:
                _rename(fs, aside, target)
            raise
        fs.delete(aside, True)
    finally:
        fs.delete(staging, True)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Each append is a set of new files: concurrent writers need no lock."""
    df.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str | Path, most: int = 10_000) -> None:
    """A small result as one JSON file of the driver; stops if it has more than `most` rows."""
    found = rows.limit(most + 1).toJSON().collect()
    if len(found) > most:
        raise ContractError(f"a report may have {most} rows")
    Path(path).write_text(json.dumps([json.loads(r) for r in found], indent=1, sort_keys=True))


def inside(root: str | Path, path: str | Path) -> Path:
    """`path` under `root`; an error if it leads out of it."""
    base, full = Path(root).resolve(), (Path(root) / path).resolve()
    if not full.is_relative_to(base):
        raise ContractError(f"{path} lies outside {root}")
    return full


def safe_members(archive: str | Path, root: str | Path) -> list[str]:
    """Names in a zip archive, none of which may lead out of `root`."""
    with zipfile.ZipFile(archive) as z:
        return [str(inside(root, n)) and n for n in z.namelist()]


def unpack(archive: str | Path, root: str | Path) -> list[str]:
    """Extract a zip archive under `root`, whole or not at all; no name may lead out of it. Returns the names."""
    names, target = safe_members(archive, root), Path(root)
    target.parent.mkdir(parents=True, exist_ok=True)
    staging = Path(tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent))
    try:
        with zipfile.ZipFile(archive) as z:
            z.extractall(staging)
        staging.rename(target)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return names


def fetch(url: str, path: str | Path, sha256: str | None = None) -> Path:
    """Download to `path` by way of a file beside it, so that a half file never has the name; with a hash, only the right file gets it."""
    path = Path(path)
    part = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
    try:
        with urllib.request.urlopen(url) as source, part.open("wb") as f:
            shutil.copyfileobj(source, f, 1 << 20)
        if sha256:
            require_hash(part, sha256)
        return part.replace(path)
    finally:
        part.unlink(missing_ok=True)


def validate_raw(path: str | Path) -> None:
    """A raw file must not be empty, a zip must test well, a JSON-lines file must start with an object."""
    path = Path(path)
    if path.stat().st_size == 0:
        raise ContractError(f"{path} is empty")
    if path.suffix == ".zip":
        with zipfile.ZipFile(path) as z:
            if bad := z.testzip():
                raise ContractError(f"{bad} in {path} is damaged")
    if path.suffix in (".json", ".jsonl"):
        with path.open(encoding="utf-8") as f:
            if not isinstance(json.loads(f.readline()), dict):
                raise ContractError(f"{path} does not start with an object")


def sha256_of(path: str | Path) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def require_hash(path: str | Path, expected: str) -> None:
    if (found := sha256_of(path)) != expected:
        raise ContractError(f"{path} has SHA-256 {found}, not {expected}")


def once(ledger: str | Path, entry: dict) -> None:
    """Take a one-time right: the ledger file is created, or FileExistsError if it was taken before."""
    with Path(ledger).open("x", encoding="utf-8") as f:
        json.dump(entry, f, sort_keys=True)


def file_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of files, by the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def footer_facts(table: DataFrame) -> DataFrame:
    """(path, n_rows, n_columns, n_groups) from the Parquet footers of a table's files, read by the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pf
        import pyarrow.parquet as pq

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                fs, name = pf.FileSystem.from_uri(path)
                f = pq.ParquetFile(name, filesystem=fs)
                rows.append((path, f.metadata.num_rows, len(f.schema_arrow.names), f.metadata.num_row_groups))
            yield pd.DataFrame(rows, columns=["path", "n_rows", "n_columns", "n_groups"])

    spark, files = table.sparkSession, table.inputFiles()
    names = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), shuffle_width(spark))))
    return names.mapInPandas(read, "path string, n_rows bigint, n_columns int, n_groups int")
