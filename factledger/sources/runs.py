"""What a run leaves: its settings, its tables of numbers, claims and notes, and cached tables; and files that are checked
before they are read."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.operators.reports import without_overlap
from factledger.sources.store import read_store, upsert


def write_run(path: str, **tables: DataFrame) -> None:
    """Each table (numbers, claims, notes) as Parquet in a folder of its name; what was there goes."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_run(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{name}") for name in names]


def write_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """A run's settings as one JSON line, with sorted keys."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def merged(defaults: dict, settings: dict) -> dict:
    """The settings over the defaults, level by level."""
    both = {k: merged(defaults[k], v) if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in settings.items()}
    return {**defaults, **both}


def read_settings(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """The settings at the path, over the defaults: a JSON object, or lines of ``name: value`` (``settings_of``)."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return merged(defaults or {}, json.loads(text) if text.lstrip().startswith("{") else settings_of(text))


def settings_of(text: str) -> dict:
    """Lines of ``name: value``. What is indented below a name belongs to it, ``- `` begins an item of a list, and # after a
    space or at the start begins a remark. A value is JSON, a list in brackets, in single quotes, or plain text; a name with nothing
    below it is left out."""
    lines = []
    for line in text.splitlines():
        if bare := _without_remark(line).rstrip():
            lines.append((len(bare) - len(bare.lstrip(" ")), bare.strip()))
    found, _ = _block(lines, 0, lines[0][0]) if lines else ({}, 0)
    return found if isinstance(found, dict) else {}


def _without_remark(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and line[:i].rstrip()[-1:] in ("", ":", "-", ",", "["):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] == " "):
            return line[:i]
    return line


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[dict | list, int]:
    """The settings of one indent from a line on, and the line after them."""
    names: dict = {}
    items: list = []
    while at < len(lines) and lines[at][0] >= indent:
        depth, line = lines[at]
        if line == "-" or line.startswith("- "):
            rest = line[1:].strip()
            if _name_of(rest):  # an item of names: the rest of this line is the first of them
                lines[at] = (depth + len(line) - len(rest), rest)
                value, at = _block(lines, at, lines[at][0])
            else:
                value, at = _value(rest), at + 1
            items.append(value)
        elif (name := _name_of(line)) is not None:
            rest, at = line[len(name) + 1 :].strip(), at + 1
            below = at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- ")))
            if rest:
                names[name.strip("\"'")] = _value(rest)
            elif below:
                names[name.strip("\"'")], at = _block(lines, at, lines[at][0])
        else:
            at += 1
        if at < len(lines) and items and not names and not lines[at][1].startswith("-") and lines[at][0] == indent:
            break  # a list at its name's own indent ends with the next name
    return (items if items else names), at


def _name_of(line: str) -> str | None:
    """The name before the first colon that a space or the line's end follows, with its quotes."""
    found = re.match(r"""("[^"]*"|'[^']*'|[^\[{"'].*?):(?= |$)""", line)
    return found.group(1) if found else None


def _value(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        if text.startswith("[") and text.endswith("]"):
            return [_value(x.strip()) for x in text[1:-1].split(",") if x.strip()]
        return text[1:-1] if len(text) > 1 and text[0] == text[-1] == "'" else None if text == "~" else text


def filled(template: str, fields: dict[str, Column]) -> Column:
    """A prompt: the template with each {name} replaced by its column (null as empty)."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path; made first where there is none.

    It is written beside the path under a hidden name and then renamed, so a reader never sees half of it, and of several
    jobs that find nothing one puts its table there and the others read that one. (A rename that comes too late moves the
    hidden folder into the table's, where readers pass over it.)"""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".making-{uuid.uuid4().hex}")
    make().write.parquet(aside.toString())
    if files.exists(target) and not files.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):
        files.delete(target, True)  # an empty folder, or what a job that failed has left
    if files.exists(target) or not files.rename(aside, target):
        files.delete(aside, True)
    return spark.read.parquet(path)


def read_sheets(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """CSV sheets of one schema in the order of their names; a key that a later sheet has counts from there alone."""
    sheets = [spark.read.schema(schema).option("header", True).csv(p) for p in sorted(paths)]
    out = sheets[0]
    for sheet in sheets[1:]:
        out = without_overlap(out, sheet, key)
    return out


def read_checked_json(spark: SparkSession, path: str, schema: str, sha256: str | None = None) -> DataFrame:
    """JSON lines of a file; an error if its SHA-256 is not the one given."""
    if sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).collect()
        if [r.h for r in found] != [sha256]:
            raise ValueError(f"{path} is not the file that was asked for")
    return spark.read.schema(schema).json(path)


REPLY = "key string, text string, stop_reason string, max_tokens long"


def write_replies(replies: DataFrame, path: str) -> int:
    """Replies by their content key, each key once: a whole reply goes before one that was cut off, then the one with the higher
    limit. Several jobs may write at once (``store``). Returns the version."""
    rows = replies.select("key", "text", "stop_reason", F.col("max_tokens").cast("long").alias("max_tokens"))
    whole = ~F.coalesce(F.col("stop_reason").isin("max_tokens", "length"), F.lit(False))
    return upsert(rows, path, "key", [whole, F.col("max_tokens")])


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    return read_store(spark, path, REPLY)
