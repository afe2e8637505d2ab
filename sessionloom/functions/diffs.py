"""Patches, status lines and unified diffs as columns: text in, arrays of lines or changes out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .payload import CHANGES
from .text import SPACE, trim

#: How many lines of a patch, of a tool's output and of a live diff are kept.
PATCH_LINES, OUTPUT_LINES, LIVE_LINES = 280, 1200, 2200
#: Kinds of change by the word in a patch's file header, and by the letter of a status line.
PATCH_KINDS = {"Add": "add", "Delete": "delete", "Update": "update"}
STATUS_KINDS = {"A": "add", "D": "delete", "M": "update"}


def header_pattern(word: str) -> str:
    """What finds the paths of a patch's file headers with this word."""
    return rf"(?m)^\*\*\* {word} File: (.+)$"


def _as_changes(paths: Column, kind: str) -> Column:
    return F.transform(paths, lambda p: F.struct(trim(p).alias("path"), F.lit(kind).alias("kind")))


def patch_changes(text: Column) -> Column:
    """(path, kind) of the file headers of a patch: additions, then deletions, then updates, each once."""
    found = [_as_changes(F.regexp_extract_all(text, F.lit(header_pattern(word)), F.lit(1)), kind) for word, kind in PATCH_KINDS.items()]
    return F.coalesce(F.array_distinct(F.concat(*found)), F.array().cast(CHANGES))


def status_changes(text: Column) -> Column:
    """(path, kind) of lines such as "M path", each once."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), trim), lambda x: x.rlike(f"^[{''.join(STATUS_KINDS)}] .*[^\\s]") & (F.length(x) >= 3))
    kind = lambda x: F.coalesce(*(F.when(x.startswith(letter), kind) for letter, kind in STATUS_KINDS.items()))
    return F.coalesce(F.array_distinct(F.transform(lines, lambda x: F.struct(trim(F.substring(x, F.lit(3), F.length(x))).alias("path"), kind(x).alias("kind")))), F.array().cast(CHANGES))


def _rtrimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, f"{SPACE}+$", ""))


def _body(x: Column) -> Column:
    return x.rlike(r"^(\+(?!\+\+)|-(?!--))")


def patch_lines(text: Column, limit: int = PATCH_LINES) -> Column:
    """A patch as diff lines. An update's two header lines stay together, so one line more than the limit may come."""

    def lines(x: Column) -> Column:
        path = trim(F.regexp_extract(x, r"^\*\*\* \w+ File: (.*)$", 1))
        old, new = F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path)
        return (
            F.when(x.startswith("*** Update File: "), F.array(old, new)).when(x.startswith("*** Add File: "), F.array(new))
            .when(x.startswith("*** Delete File: "), F.array(old)).when(x.startswith("@@") | _body(x), F.array(x)).otherwise(F.array().cast("array<string>"))
        )

    groups = F.transform(_rtrimmed(text), lines)
    flat = F.flatten(groups)
    at_limit = F.get(flat, limit - 1)
    # the line at the limit is an update's first header just if the next is its second
    pair = at_limit.startswith("--- a/") & (F.get(flat, F.lit(limit)) == F.concat(F.lit("+++ b/"), F.substring(at_limit, F.lit(7), F.length(at_limit))))
    return F.slice(flat, F.lit(1), F.when(pair, limit + 1).otherwise(limit))


def unified_lines(text: Column, limit: int = OUTPUT_LINES) -> Column:
    """Header and body lines of a unified diff inside any text."""
    header = r"^(diff --git |index |--- |\+\+\+ |@@|Binary files )"
    return F.slice(F.filter(_rtrimmed(text), lambda x: x.rlike(header) | _body(x)), 1, limit)


#: How a line names its file: (how it begins, what finds the name, which group is it, what is cut from its start).
FILE_NAMES = (
    ("FILE ", r"^FILE (.*)$", 1, r"^[+-]\s+"),
    ("diff --git ", r"^diff --git a\/(.+) b\/(.+)$", 2, ""),
    ("+++ b/", r"^\+\+\+ b\/(.*)$", 1, ""),
    ("--- a/", r"^--- a\/(.*)$", 1, ""),
)
#: A file's line in a summary with counts; its line without; how lines of code but bodies begin.
COUNTED, NAMED, CODE = r"^[+-]\s+(.+)\s+\(\+\d+\s+-\d+\)$", r"^FILE [+-]\s+.+$", r"^(@@|diff --git |--- |\+\+\+ )"


def file_label(line: Column) -> Column:
    """The file that a diff line names, if it does."""
    some = lambda c: F.nullif(c, F.lit(""))
    out = some(F.regexp_extract(line, COUNTED, 1))
    for prefix, pattern, group, cut in reversed(FILE_NAMES):
        name = F.regexp_extract(line, pattern, group)
        out = F.when(line.startswith(prefix), some(trim(F.regexp_replace(name, cut, "") if cut else name))).otherwise(out)
    return out


def is_summary(line: Column) -> Column:
    """A line that only says which file changed, and by how much."""
    return line.rlike(NAMED) | line.rlike(COUNTED)


def is_code(line: Column) -> Column:
    return line.rlike(CODE) | (_body(line) & ~is_summary(line))


def has_code(lines: Column) -> Column:
    return F.exists(lines, is_code)


def diff_by_file(lines_df, group: list[str], position: str = "pos", line: str = "line"):
    """Diff lines with the file that each belongs to: the last one named before it."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return lines_df.withColumn("file", F.last(file_label(F.col(line)), ignorenulls=True).over(w))


#: Shown where a diff, or a file's part of it, has no lines.
NO_DIFF, NO_CODE = "(No diff captured)", "  (No code-level diff captured)"


def formatted(lines: Column) -> Column:
    """Diff lines with a header before each file's: an array of lines to show."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit(None).cast("string").alias("file"), F.lit(True).alias("filled"))

    def labelled(x: Column) -> Column:
        line = F.regexp_replace(x, f"{SPACE}+$", "")
        return F.struct(line.alias("line"), file_label(line).alias("label"), (~line.startswith("FILE ") & ~line.startswith("diff --git ") & (line != "")).alias("shown"))

    def step(a: Column, x: Column) -> Column:
        new = x["label"].isNotNull() & ~x["label"].eqNullSafe(a["file"])
        empty = F.when(a["filled"], none).otherwise(F.array(F.lit(NO_CODE)))
        gap = F.when(F.size(a["out"]) + F.size(empty) > 0, F.array(F.lit(""))).otherwise(none)
        head = F.when(new, F.concat(empty, gap, F.array(F.concat(F.lit("=== "), x["label"], F.lit(" ==="))))).otherwise(none)
        body = F.when(x["shown"], F.array(x["line"])).otherwise(none)
        return F.struct(F.concat(a["out"], head, body).alias("out"), F.when(new, x["label"]).otherwise(a["file"]).alias("file"), (x["shown"] | (~new & a["filled"])).alias("filled"))

    def done(a: Column) -> Column:
        out = F.concat(a["out"], F.when(a["filled"], none).otherwise(F.array(F.lit(NO_CODE))))
        return F.when(F.size(out) == 0, F.array(F.lit(NO_DIFF))).otherwise(out)

    return F.aggregate(F.transform(lines, labelled), start, step, done)
