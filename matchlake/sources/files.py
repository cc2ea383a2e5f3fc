"""Raw files: archives, delimited files whose headers differ, JSON lines with a manifest, Markdown."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import written

ASSETS = (".csv", ".png")
REQUIRED = ("file", "round", "map", "winner_side", "ct_eq_val", "t_eq_val")
#: A file with fewer of REQUIRED, and without `file` or `map`, is no file of rounds.
LEAST_HEADERS = 5
PHASES = {"01-bronze": "bronze", "02-silver": "silver", "03-gold": "gold", "04-ml-training": "ml-training", "05-architecture": "architecture"}
DOCUMENT = "doc_id string, text string, metadata map<string,string>"


def need_path(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(path)
    return path


def normal_headers(names: list[str]) -> list[str]:
    """Lower case, runs of anything else as one `_`; the second, third, ... of equal names end in _2, _3, ..."""
    plain = ["_".join(re.findall("[a-z0-9]+", n.lower())) or "column" for n in names]
    place = [plain[: k + 1].count(n) for k, n in enumerate(plain)]
    return [n if p == 1 else f"{n}_{p}" for n, p in zip(plain, place, strict=True)]


def normal_header_cells(cells: Column) -> Column:
    """The same of an array of header cells."""
    plain = F.transform(cells, lambda c: F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("column")))
    place = lambda c, k: F.size(F.filter(F.slice(plain, 1, k + 1), lambda x: x == c))
    return F.transform(plain, lambda c, k: F.when(place(c, k) == 1, c).otherwise(F.concat(c, F.lit("_"), place(c, k).cast("string"))))


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ASSETS) -> DataFrame:
    """path, name, size of files below a folder, by path; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(need_path(spark, folder)).select("path", F.col("length").alias("size"))
    low = F.lower("path")
    test = F.lit(False)
    for s in suffixes:
        test = test | low.endswith(s)
    return rows.where(test).select("path", F.substring_index("path", "/", -1).alias("name"), "size").orderBy("path")


def unzip(spark: SparkSession, pattern: str) -> DataFrame:
    """archive, member, content of the archives that match, members of ASSETS only, each archive in one task."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.lower().endswith(ASSETS):
                            yield pd.DataFrame({"archive": [path], "member": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(members, "archive string, member string, content binary")


def typed_manifest(members: DataFrame) -> DataFrame:
    """member, content -> member, file_type, typed_path, size: where each raw file belongs."""
    name = F.substring_index("member", "/", -1)
    kind = S.file_kind(name)
    return members.select("member", kind.alias("file_type"), F.concat_ws("/", kind, F.when(kind == "assets", F.col("member")).otherwise(name)).alias("typed_path"), F.octet_length("content").cast("long").alias("size"))


#: Columns of a file at most; a header with more is an error.
MOST_COLUMNS = 256


def _most_cells(spark: SparkSession, paths: list[str]) -> int:
    """No record has more cells: the most commas of a line, plus one. With a line whose quotes are not in pairs, a record may
    be of several lines, and no less than MOST_COLUMNS + 1 is sure."""
    held = lambda c: F.length("value") - F.length(F.replace("value", F.lit(c), F.lit("")))
    found = spark.read.option("lineSep", "\n").text(paths).agg(F.max(held(",")).alias("most"), F.max(held('"') % 2).alias("broken")).first()
    return MOST_COLUMNS + 1 if found["broken"] else min((found["most"] or 0) + 1, MOST_COLUMNS + 1)


def csv_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Delimited files of unlike headers, in one scan: path, id (ascending within a file), cells. Line breaks and doubled
    quotes within quotes belong to the cell. A file is read by one task, from its beginning to its end, with as many columns
    as any line may have: each costs time in every row."""
    names = [f"c{k}" for k in range(_most_cells(spark, paths))]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", False).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').csv(paths)
    last = F.array_max(F.filter(F.transform(F.array(*names), lambda c, k: F.when(c.isNotNull(), k + 1)), lambda k: k.isNotNull()))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("id"), F.slice(F.array(*names), 1, F.coalesce(last, F.lit(0))).alias("cells"))


class Files:
    """Delimited files read together: `rows` (under all headers' names, with source_file and src_ord), `files` (path, header,
    whether it was read, number of rows)."""

    def __init__(self, rows: DataFrame, files: DataFrame):
        self.rows, self.files = rows, files


def read_files(spark: SparkSession, paths: list[str], wanted=lambda header: F.lit(True)) -> Files:
    """Files whose header (an array of normal names) is `wanted`, as nullable text: a short row ends in nulls, cells beyond
    the header are dropped, a column that a file lacks is null. src_ord goes by path, then by place in the file.

    The cells are read once and written; a header is its file's first row. The driver gets the names of columns alone.
    """
    cells = written(csv_cells(spark, paths), "cells")
    heads = cells.groupBy("path").agg(F.min_by("cells", "id").alias("head"), F.min("id").alias("first"), (F.count(F.lit(1)) - 1).alias("n_rows"))
    heads = heads.withColumn("head", F.transform("head", lambda c: F.regexp_replace(c, "^\ufeff", "")))
    over = F.raise_error(F.concat("path", F.lit(f" has more than {MOST_COLUMNS} columns")))
    header = F.when(F.size("head") > MOST_COLUMNS, over.cast("array<string>")).otherwise(normal_header_cells(F.col("head")))
    heads = heads.withColumn("header", header).withColumn("was_read", F.coalesce(wanted(F.col("header")), F.lit(False)) & (F.size("header") > 0))
    order = heads.select("path").withColumn("rank", F.row_number().over(Window.orderBy("path")))  # names of files alone
    heads = written(heads.join(order, "path").select("path", "first", "n_rows", "header", "was_read", "rank"), "heads")
    names = [r[0] for r in heads.where("was_read").select(F.posexplode("header").alias("k", "name")).groupBy("name").agg(F.min("k").alias("k")).orderBy("k", "name").select("name").collect()]
    few = heads.where("was_read").select(F.col("path").alias("_path"), "first", "header", "rank")
    met = cells.join(F.broadcast(few) if few.limit(10_001).count() <= 10_000 else few, F.col("path") == F.col("_path")).where("id > first")
    cell = lambda n: F.get("cells", F.array_position("header", n).cast("int") - 1)
    source = F.substring_index("path", "/", -1)
    rows = met.select(*[F.when(F.array_contains("header", n), cell(n)).alias(n) for n in names], source.alias(_free("source_file", names)), (F.shiftleft(F.col("rank").cast("long"), 43) + F.col("id") - F.col("first")).alias(_free("src_ord", names)))
    return Files(rows, heads.select("path", "header", "was_read", "n_rows"))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One file as nullable text under normalised headers."""
    found = read_files(spark, [need_path(spark, path)])
    if not found.files.where("was_read").count():
        raise ValueError(f"{path} has no header")
    return found.rows.drop("source_file", "src_ord")


def is_round_header(header: Column) -> Column:
    """By normal names: nearly all of REQUIRED, or `file` and `map` with aliases for the rest."""
    held = lambda names: F.size(F.array_intersect(header, F.array(*map(F.lit, names))))
    return (held(REQUIRED) >= LEAST_HEADERS) | (held(("file", "map")) == 2)


def read_round_files(spark: SparkSession, folder: str) -> tuple[DataFrame, int, int]:
    """All round files below a folder under one header, with source_file and src_ord; how many were read and passed over."""
    paths = [r["path"] for r in list_files(spark, folder, (".csv",)).where(S.is_round_meta_path(F.col("path"))).collect()]
    if not paths:
        raise ValueError(f"No round_meta CSV files in {folder}")
    found = read_files(spark, paths, is_round_header)
    read = found.files.where("was_read").count()
    if not read:
        raise ValueError(f"No round_meta CSV files in {folder}")
    return found.rows, read, len(paths) - read


# ---- types


#: What text may be, the narrowest first.
KINDS = ("boolean", "long", "double", "date", "timestamp")


def inferred_types(rows: DataFrame) -> dict[str, str]:
    """For each column of text the narrowest of KINDS that all its cells are, or string; by one aggregate over the rows.
    Blank cells count for nothing; a column of blanks alone stays text."""
    texts = [c for c, k in rows.dtypes if k == "string"]
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    asked = [F.count(cell(c)).alias(f"n{i}") for i, c in enumerate(texts)]
    for i, c in enumerate(texts):
        for k in KINDS:
            value = cell(c).try_cast(k)
            if k == "boolean":
                value = F.when(F.lower(cell(c)).isin("true", "false"), True)
            asked.append(F.count(value).alias(f"{k}{i}"))
    found = rows.agg(*asked).first() if texts else {}
    return {c: next((k for k in KINDS if found[f"n{i}"] and found[f"{k}{i}"] == found[f"n{i}"]), "string") for i, c in enumerate(texts)}


def typed(rows: DataFrame) -> DataFrame:
    """`rows` with columns of text cast to what they hold. Give a written table: it is read for the types and again for
    the result, the source of the text is not."""
    kinds = inferred_types(rows)
    cast = lambda c: F.col(f"`{c}`") if kinds.get(c, "string") == "string" else F.trim(F.col(f"`{c}`")).try_cast(kinds[c])
    return rows.select(*[cast(c).alias(c) for c in rows.columns])


# ---- one file in order


def write_ordered_csv(df: DataFrame, path: str, keys: list[str], parts: int | None = None) -> None:
    """One CSV file at `path` in the order of `keys`, under a header. Ranges of the keys are sorted and written by many tasks
    and their files are joined by the file system: by its own operation where it has one, else as a stream of bytes."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, goal = hadoop.fs.Path(f"{path}.parts-{uuid.uuid4().hex}"), hadoop.fs.Path(path)
    sorted_ = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    sorted_.write.option("header", False).option("emptyValue", '""').csv(folder.toString())
    conf = spark._jsc.hadoopConfiguration()
    fs = goal.getFileSystem(conf)
    try:
        head, whole = hadoop.fs.Path(folder, "_head"), hadoop.fs.Path(folder, "_whole")
        quoted = [f'"{c.replace(chr(34), chr(34) * 2)}"' if re.search('[",\n]', c) else c for c in df.columns]
        out = fs.create(head, True)
        out.write(bytearray((",".join(quoted) + "\n").encode()))
        out.close()
        files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())
        out = fs.create(whole, True)
        for one in [head, *files]:
            stream = fs.open(one)
            hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
        out.close()
        fs.delete(goal, True)
        fs.rename(whole, goal)
    finally:
        fs.delete(folder, True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """part_no, object_key, rows, first_doc_id, last_doc_id and the document lines they span, checked."""
    schema = "parts array<struct<object_key: string, rows: long, first_doc_id: string, last_doc_id: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(need_path(spark, path)).select(F.posexplode("parts").alias("part_no", "x")).select("part_no", "x.*")
    rows = rows.withColumns({"first_line": S.doc_line(F.col("first_doc_id")), "last_line": S.doc_line(F.col("last_doc_id"))})
    wrong = F.col("object_key").isNull() | F.col("rows").isNull() | (F.col("rows") <= 0) | F.col("first_line").isNull() | F.col("last_line").isNull() | (F.col("last_line") < F.col("first_line"))
    return rows.withColumn("object_key", F.when(wrong, F.raise_error(F.concat(F.lit("bad manifest part "), F.col("part_no").cast("string")))).otherwise(F.col("object_key")))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, part (name of the file), line (from 1), value. Lines of a split are counted, the counts of the splits before it are
    added up, and a line's number is its place in its split beyond them; only counts of splits are shuffled."""
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("path", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = written(splits.select(F.col("path").alias("_p"), F.col("at").alias("_a"), (before - F.col("first") + 1).alias("shift")), "splits")
    few = splits.limit(100_001).count() <= 100_000
    met = rows.join(F.broadcast(splits) if few else splits, (F.col("path") == F.col("_p")) & (F.col("at") == F.col("_a")))
    return met.select("path", F.substring_index("path", "/", -1).alias("part"), (F.col("id") + F.col("shift")).alias("line"), "value")


def _parsed(rows: DataFrame) -> DataFrame:
    """`rows` whose value is not blank, with `x`, the document, and why it is none (null if it is)."""
    full = rows.where(F.trim("value") != "")
    x = F.from_json("value", f"{DOCUMENT}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return full.withColumn("x", x).withColumn("why", F.when(F.col("x._bad").isNotNull() | F.col("x").isNull(), F.lit("invalid JSON")).when(~F.trim("value").startswith("{"), F.lit("no object")))


def document_errors(spark: SparkSession, *paths: str) -> DataFrame:
    """path, part, line, why of each line that is no document."""
    return _parsed(numbered_lines(spark, *paths)).where("why IS NOT NULL").select("path", "part", "line", "why")


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines of documents; a malformed line is an error that names its part and line, a blank one is passed over."""
    rows = _parsed(numbered_lines(spark, *paths))
    said = F.raise_error(F.concat(F.col("why"), F.lit(" at "), "part", F.lit(":"), F.col("line").cast("string")))
    return rows.select(F.when(F.col("why").isNotNull(), said.cast("string")).otherwise(F.col("x.doc_id")).alias("doc_id"), F.col("x.text").alias("text"), F.col("x.metadata").alias("metadata"))


def checked_documents(docs: DataFrame) -> DataFrame:
    """`docs` with the reason why a document cannot be embedded, null if it can."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return docs.withColumn("reason", F.when(blank(F.col("doc_id")), "missing_doc_id").when(blank(F.col("text")), "missing_text").when(F.col("metadata").isNull(), "missing_metadata").when(blank(F.col("metadata")["event_type"]), "missing_event_type").when(blank(F.col("metadata")["document_tier"]), "missing_document_tier"))


def read_markdown(spark: SparkSession, pattern: str) -> DataFrame:
    """path, stem, phase, text of Markdown files."""
    rows = spark.read.option("wholetext", True).text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    phases = F.create_map(*[F.lit(x) for p in PHASES.items() for x in p])
    return rows.select("path", stem.alias("stem"), F.coalesce(phases[stem], stem).alias("phase"), "text")
