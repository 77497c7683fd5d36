"""Keyword exports as files: what they are, and reading the text ones with Spark.

Files of any size are read as lines, in byte ranges as Spark cuts them. A line may begin inside a
quoted cell; that is told without reading a file in order: every line maps the state before it
(outside or inside quotes) to the state behind it, a range of lines is the composition of its lines'
maps, and a file's ranges put together give each range, and so each line, its state. Lines that
belong to one record are then joined; all other lines are records by themselves.
"""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import XLS_MAGIC, XLSX_MAGIC
from ..errors import InputError
from ..operators.ordinals import with_dense_ordinal
from ..storage import materialize
from .roles import clean_header

DELIMITERS = ",\t;|"
# Lines that are not UTF-8, drawn by hash from the whole file, to guess another encoding by.
GUESS_LINES = 400
# Byte order marks, the encoding's name and what Java calls the text behind it.
_MARKS = [
    ("EFBBBF", "utf-8-sig", "utf-8"),
    ("FFFE0000", "utf-32", "utf-32le"),
    ("0000FEFF", "utf-32", "utf-32be"),
    ("FFFE", "utf-16", "utf-16le"),
    ("FEFF", "utf-16", "utf-16be"),
]
_JAVA = {"ascii": "us-ascii", "latin-1": "iso-8859-1", "latin_1": "iso-8859-1", "iso8859-1": "iso-8859-1"}
_DECODED_BY_SPARK = ("us-ascii", "iso-8859-1", "utf-16le", "utf-16be")
# What a line does to the state: keeps it, turns it over, ends outside, ends inside quotes.
KEEPS, TURNS, OUTSIDE, INSIDE = range(4)


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def raw_lines(spark: SparkSession, paths, charset: str = "utf-8") -> DataFrame:
    """path, block, row (ascending in a block) and value (bytes) of every line."""
    wide = {"encoding": charset} if charset.startswith(("utf-16", "utf-32")) else {}
    lines = spark.read.options(lineSep="\n", recursiveFileLookup="true", **wide).text(paths)
    return lines.select(
        _local(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").cast("binary").alias("value"),
    )


def _decoded(value: Column, charset: str) -> Column:
    """The text of a line's bytes, without a byte order mark and the end of a Windows line."""
    if charset == "utf-8":
        text = value.cast("string")
    elif charset in _DECODED_BY_SPARK:
        text = F.decode(value, charset)
    else:

        @F.pandas_udf("string")
        def decode(lines: pd.Series) -> pd.Series:
            return lines.map(lambda x: bytes(x).decode(charset, "replace"))

        text = decode(value)
    return F.regexp_replace(text, "^\ufeff|\\r$", "")


def quote_steps(delimiter: str):
    """Column function: what a line does to the state, by where its quoted cells begin and end.

    A quote opens a cell only where the cell begins; in it, two quotes stand for one.
    """

    def ends_inside(line: str, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line.startswith('""', at):
                    at += 2
                    continue
                inside = False
            elif line.startswith('"', at):
                inside, at = True, at + 1
                continue
            at = line.find(delimiter, at) + 1
            if not at:
                return False

    @F.pandas_udf("int")
    def steps(lines: pd.Series) -> pd.Series:
        kinds = {(False, True): KEEPS, (True, False): TURNS, (False, False): OUTSIDE, (True, True): INSIDE}
        return lines.map(lambda x: kinds[ends_inside(x, False), ends_inside(x, True)])

    return lambda text: F.when(F.instr(text, '"') == 0, F.lit(KEEPS)).otherwise(steps(text))


def parity_step(text: Column) -> Column:
    """The same where the delimiter is not known yet: every quote turns the state over."""
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 1, F.lit(TURNS)).otherwise(F.lit(KEEPS))


def _running(rows: DataFrame, keys: list[str], order: str, step: str, name: str) -> DataFrame:
    """Add ``name``: the composition of all steps of the key's earlier rows, a step itself."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.count_if(F.col(step) == TURNS).over(before), F.lit(0))
    rows = rows.withColumn("_turned", turned)
    ends = F.when(F.col(step) >= OUTSIDE, F.struct(F.col(step).alias("step"), "_turned"))
    rows = rows.withColumn("_ends", F.last(ends, ignorenulls=True).over(before))
    odd = (F.col("_turned") - F.coalesce(F.col("_ends._turned"), F.lit(0))) % 2
    left = F.coalesce(F.col("_ends.step") - OUTSIDE, F.lit(0)).bitwiseXOR(odd.cast("int"))
    found = F.when(F.col("_ends").isNull(), F.when(odd == 1, TURNS).otherwise(KEEPS)).otherwise(left + OUTSIDE)
    return rows.withColumn(name, found.cast("int")).drop("_turned", "_ends")


def _after(first: Column, then: Column) -> Column:
    """One step, then another."""
    turned = F.when(first == TURNS, KEEPS).when(first == KEEPS, TURNS).when(first == OUTSIDE, INSIDE).otherwise(OUTSIDE)
    return F.when(then == KEEPS, first).when(then == TURNS, turned).otherwise(then)


def with_quote_state(lines: DataFrame) -> DataFrame:
    """Add inside: whether the line begins inside quotes. ``lines`` has path, block, row and step.

    A window holds the lines of one range, or one row per range of a file. Read more than once, so
    ``lines`` should be a written table.
    """
    placed = _running(lines, ["path", "block"], "row", "step", "_so_far")
    ranges = placed.groupBy("path", "block").agg(
        F.max_by(_after(F.col("_so_far"), F.col("step")), "row").alias("_range")
    )
    ranges = _running(ranges, ["path"], "block", "_range", "_start").drop("_range")
    state = _after(F.col("_start"), F.col("_so_far"))  # from outside, where every file begins
    return placed.join(ranges, ["path", "block"]).withColumn(
        "inside", state.isin(TURNS, INSIDE)
    ).drop("_so_far", "_start")


def records(lines: DataFrame) -> DataFrame:
    """path, block, row and text of every record, from lines with path, block, row, step and text.

    A record has the place of its first line. Only lines of records of several lines are moved.
    """
    lines = with_quote_state(lines)
    before = Window.partitionBy("path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(~F.col("inside"), F.struct("block", "row"))
    lines = lines.withColumn("_first", F.last(begins, ignorenulls=True).over(before))
    tails = lines.groupBy("path", "block").agg(F.max(begins).alias("_tail"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("_tail", F.last("_tail", ignorenulls=True).over(earlier))
    lines = lines.join(tails, ["path", "block"]).withColumn("_first", F.coalesce("_first", "_tail"))
    goes_on = F.when(F.col("inside"), F.col("step").isin(KEEPS, INSIDE)).otherwise(F.col("step").isin(TURNS, INSIDE))
    alone = lines.where(~F.col("inside") & ~goes_on).select("path", "block", "row", "text")
    parts = lines.where(F.col("inside") | goes_on).groupBy("path", "_first").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", "text"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return alone.unionByName(parts.select("path", "_first.block", "_first.row", joined.alias("text")))


def _guessed(lines: DataFrame, odd: DataFrame) -> dict[str, str]:
    """The encoding of each file that is not UTF-8, by a bounded draw of its lines that are not."""
    draw = F.pmod(F.xxhash64("value", "row"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * GUESS_LINES / F.col("odd")
    some = lines.where(~F.is_valid_utf8(F.col("value").cast("string"))).join(F.broadcast(odd), "path").where(draw)
    found = {}
    for row in some.groupBy("path").agg(F.sort_array(F.collect_list("value")).alias("lines")).collect():
        try:
            from charset_normalizer import from_bytes

            best = from_bytes(b"\n".join(map(bytes, row["lines"]))).best()
        except ImportError:
            best = None
        found[row["path"]] = best.encoding if best else "latin-1"
    return found


def _delimiters(lines: DataFrame) -> DataFrame:
    """path and delimiter: the one that most lines have equally often, outside quotes.

    Lines that begin inside quotes do not count, and the header has to have it. Comma if none.
    """
    bare = F.regexp_replace("text", '"[^"]*("|$)', "")
    often = lambda d: F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))
    each = F.explode(F.array(*(
        F.struct(F.lit(i).alias("at"), often(d).alias("often")) for i, d in enumerate(DELIMITERS)
    )))
    counts = lines.where(~F.col("inside")).select("path", "block", "row", "step", each.alias("d"))
    counts = counts.select("path", F.struct("block", "row").alias("place"), "step", "d.at", "d.often")
    counts = counts.groupBy("path", "at", "often").agg(
        F.count(F.lit(1)).alias("lines"), F.min("place").alias("place"), F.min_by("step", "place").alias("step")
    )
    head = F.min_by(F.struct("often", "step"), "place")
    usual = F.max(F.when(F.col("often") > 0, F.col("lines")))
    found = counts.groupBy("path", "at").agg(head.alias("head"), usual.alias("lines"))
    fit = ((F.col("head.often") > 0) | (F.col("head.step") == TURNS)) & F.col("lines").isNotNull()
    best = F.max(F.when(fit, F.struct("lines", (-F.col("at")).alias("at"))))
    names = F.array(*map(F.lit, DELIMITERS))
    return found.groupBy("path").agg(best.alias("best")).select(
        "path", F.coalesce(F.get(names, -F.col("best.at")), F.lit(DELIMITERS[0])).alias("delimiter")
    )


def _header(text: str, delimiter: str) -> list[str] | None:
    try:
        return next(csv.reader(io.StringIO(text), delimiter=delimiter), [])
    except csv.Error:
        return None


_PROFILE_DDL = (
    "path string, length long, kind string, encoding string, delimiter string, "
    "header array<string>, multiline boolean, error_code string"
)


def listed_files(spark: SparkSession, path: str) -> dict[str, int]:
    """Length of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # The scan skips files without any bytes; the listing knows them.
    found = {re.sub("^file:/+", "file:/", name): 0 for name in files.inputFiles()}
    return found | {r[0]: r[1] for r in files.select(_local(F.col("path")), "length").collect()}


def _facts(lines: DataFrame) -> DataFrame:
    """Per file: first bytes, number of lines that are not blank, not UTF-8, with an odd number of quotes."""
    text = F.col("value").cast("string")
    return lines.groupBy("path").agg(
        F.min_by(F.hex(F.substring("value", 1, 8)), F.struct("block", "row")).alias("head"),
        F.count_if(~F.col("value").cast("string").rlike(r"^[\s\x00]*$")).alias("filled"),
        F.count_if(~F.is_valid_utf8(text)).alias("odd"),
        F.count_if(parity_step(text) == TURNS).alias("turns"),
    )


def _text_lines(spark: SparkSession, paths: list[str], charset: str, tangled: bool, step) -> DataFrame:
    """Lines with text, step and, once it matters, written down."""
    lines = raw_lines(spark, paths, charset).withColumn("text", _decoded(F.col("value"), charset)).drop("value")
    if not tangled:
        return lines.withColumn("step", F.lit(KEEPS)).withColumn("inside", F.lit(False))
    return materialize(lines.withColumn("step", step(F.col("text"))), "export-lines")


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, length, kind (by its first bytes, never its name), encoding,
    delimiter, header, multiline, error_code.

    Every line of every file is looked at, in ranges; one row per file goes through the driver.
    """
    lengths = listed_files(spark, path)
    lines = raw_lines(spark, path)
    facts = {r["path"]: r for r in _facts(lines).collect()} if lengths else {}
    odd = [(p, r["odd"]) for p, r in facts.items() if r["odd"] and not r["head"].startswith((XLSX_MAGIC, XLS_MAGIC))]
    guessed = _guessed(lines, spark.createDataFrame(odd, "path string, odd long")) if odd else {}
    found, layouts = {}, {}
    for name, length in lengths.items():
        row = found[name] = {"path": name, "length": length, "kind": "text", "error_code": None}
        fact = facts.get(name)
        if fact and fact["head"].startswith(XLSX_MAGIC):
            row |= {"kind": "xlsx", "error_code": "WORKBOOK_NOT_SUPPORTED"}
        elif fact and fact["head"] == XLS_MAGIC:
            row |= {"kind": "xls", "error_code": "WORKBOOK_NOT_SUPPORTED"}
        elif not fact or not fact["filled"]:
            row["error_code"] = "EMPTY_FILE"
        else:
            mark = next(((e, c) for m, e, c in _MARKS if fact["head"].startswith(m)), None)
            row["encoding"], charset = mark or (guessed.get(name, "utf-8"),) * 2
            charset = _JAVA.get(charset, charset).replace("_", "-")
            # Spark's own reader would need its multiLine mode, also for text of wide characters.
            row["multiline"] = fact["turns"] > 0 or charset.startswith(("utf-16", "utf-32"))
            layouts.setdefault((charset, fact["turns"] > 0), []).append(name)
    for (charset, tangled), names in layouts.items():
        lines = _text_lines(spark, names, charset, tangled, parity_step)
        filled = lambda table: table.where("trim(text) != ''")
        cut = _delimiters(filled(with_quote_state(lines) if tangled else lines))
        whole = records(lines) if tangled else lines
        first = filled(whole).groupBy("path").agg(F.min_by("text", F.struct("block", "row")).alias("text"))
        for r in first.join(cut, "path").collect():
            header = _header(r["text"], r["delimiter"])
            found[r["path"]] |= {"header": header, "delimiter": r["delimiter"]}
            if header is None:
                found[r["path"]] |= {"error_code": "UNPARSEABLE_FILE", "delimiter": None}
    names = [f.split(" ")[0] for f in _PROFILE_DDL.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in found.values()], _PROFILE_DDL)


def unreadable_files(profile: DataFrame) -> DataFrame:
    """(path, error_code) of the files that a read leaves out or fails on."""
    return profile.where("error_code IS NOT NULL").select("path", "error_code")


def header_names(header: list[str]) -> list[str]:
    """Usable column names: cleaned, empty ones numbered, repeats told apart."""
    names: list[str] = []
    for place, raw in enumerate(header):
        name = clean_header(raw) or f"Unnamed: {place}"
        repeats = sum(re.fullmatch(re.escape(name) + r"(\.\d+)?", n) is not None for n in names)
        names.append(f"{name}.{repeats}" if name in names else name)
    return names


def _charset(spark: SparkSession, paths: list[str], encoding: str) -> list[tuple[str, list[str]]]:
    """The files by what Java calls their text: wide encodings come in two byte orders."""
    marks = [(m, c) for m, e, c in _MARKS if e == encoding]
    if len(marks) < 2:
        charset = marks[0][1] if marks else _JAVA.get(encoding, encoding).replace("_", "-")
        return [(charset, paths)]
    heads = _facts(raw_lines(spark, paths)).select("path", "head").collect()
    by = {c: [r["path"] for r in heads if r["head"].startswith(m)] for m, c in marks}
    return [(c, names) for c, names in by.items() if names]


def _read_group(spark: SparkSession, paths: list[str], layout) -> DataFrame:
    """Rows with their header's columns, source_file and place; a file's first row is its header."""
    charset, delimiter, header, tangled = layout
    lines = _text_lines(spark, paths, charset, tangled, quote_steps(delimiter))
    whole = records(lines) if tangled else lines
    names = header_names(list(header))
    fields = [f"c{i}" for i in range(len(names))]
    # One more column than the header shows which rows are too long.
    schema = ", ".join(f"{c} string" for c in [*fields, "over"])
    how = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    rows = whole.where("trim(text) != ''").withColumn("cells", F.from_csv("text", schema, how))
    rows = rows.where(F.col("cells.over").isNull()).select(
        *(F.nullif(F.col(f"cells.{c}"), F.lit("")).alias(c) for c in fields),
        F.col("path").alias("source_file"), F.col("block").alias("_block"), F.col("row").alias("_row"),
    )
    return rows.withColumnsRenamed(dict(zip(fields, names, strict=True)))


def read_keyword_exports(
    spark: SparkSession, path: str, profile: DataFrame | None = None, on_error: str = "raise"
) -> DataFrame:
    """All text exports under a path as one table of string columns.

    A file that cannot be read is an error, which lists all of them. With ``on_error="skip"`` the
    others are read all the same; ``unreadable_files`` of the profile says which were not.

    Files are read in ranges, whatever their size and encoding. Where every line has an even number
    of quotes, a line is a record; in other files quoted line breaks stay in their cell. Rows with
    more fields than the header are dropped, shorter ones padded with nulls, blank lines left out.
    Adds source_file and row_ord (file path, place in file).
    """
    profile = profile_files(spark, path) if profile is None else profile
    layouts: dict[tuple, list[str]] = {}
    errors = []
    for r in profile.orderBy("path").collect():  # facts about files, not their rows
        if r["error_code"]:
            errors.append((r["path"], r["error_code"]))
            continue
        layout = (r["encoding"], r["delimiter"], tuple(r["header"]), r["multiline"])
        layouts.setdefault(layout, []).append(r["path"])
    if errors and (on_error == "raise" or not layouts):
        raise InputError(errors[0][1], f"{len(errors)} files cannot be read.", files=errors)
    if not layouts:
        raise InputError("NO_ROWS", "No keyword export found.", files=[])
    table = None
    for (encoding, *layout), paths in layouts.items():
        for charset, names in _charset(spark, paths, encoding):
            other = _read_group(spark, names, (charset, *layout))
            table = other if table is None else table.unionByName(other, allowMissingColumns=True)
    ordered = with_dense_ordinal(table, ["source_file", "_block", "_row"], "row_ord").drop("_block", "_row")
    # Every file's first row is its header; the rows behind it move up.
    heads = sorted(r[0] for r in ordered.groupBy("source_file").agg(F.min("row_ord")).select("min(row_ord)").collect())
    before = spark.createDataFrame(list(enumerate(heads, 1)), "_headers long, _head long")
    files = ordered.groupBy("source_file").agg(F.min("row_ord").alias("_head")).join(F.broadcast(before), "_head")
    rows = ordered.join(F.broadcast(files), "source_file").where("row_ord > _head")  # one row per file
    return rows.withColumn("row_ord", F.col("row_ord") - F.col("_headers")).select(*ordered.columns)
