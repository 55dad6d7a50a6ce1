"""What failed: whether a command's output tells of an error, which files and lines it names, and what to ask about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip

# What tells of an error in the output of a command that gave no exit code.
SIGNS = (
    r"\b(?:TypeError|ValueError|KeyError|AttributeError|ImportError|SyntaxError|IndentationError):|Traceback \(most recent call last\):|(?m)^Error:"
    r"|npm ERR!|\bENOENT\b|\bEACCES\b|\bFAILED\b|\bFATAL\b|\bpanic:|(?i:exit code [1-9]|exited with [1-9]|permission denied|command not found|no such file or directory|segmentation fault|core dumped)"
)
#: A line of a listing: one path and nothing else.
LISTED = r"^\s*[\w@+~.-]*(?:/[\w@+~.-]+)*/?\s*$"
# The three forms in which a file and its line are named: file, line, column.
NAMED = (r"([\w./-]+\.\w+):(\d+)(?::(\d+))?", r"File \"([^\"]+)\", line (\d+)()", r"\bat ([\w./-]+\.\w+):(\d+)()")
#: Words of a command that say nothing of what it is about, and how many words are asked about.
EMPTY_WORDS, ASKED = ["run", "test", "tests", "build", "install", "python", "python3"], 3


def is_listing(output: Column) -> Column:
    """Whether all lines that are not blank are paths: file names that speak of errors are none."""
    lines = F.filter(F.split(output, "\n"), lambda x: strip(x) != "")
    return F.coalesce((F.size(lines) > 0) & F.forall(lines, lambda x: F.rlike(x, F.lit(LISTED))), F.lit(False))


def is_error(exit_code: Column, output: Column) -> Column:
    """A code other than 0 is an error; without one, or with 0, a sign in an output that is no listing."""
    told = ~is_listing(output) & F.rlike(output, F.lit(SIGNS))
    return F.coalesce(exit_code != 0, F.lit(False)) | F.coalesce(told, F.lit(False))


def references(output: Column) -> Column:
    """file, line, column (null where not told) of every place that an output names, form by form, each once."""
    found = []
    for pattern in NAMED:
        part = lambda k, p=pattern: F.regexp_extract_all(output, F.lit(p), F.lit(k))
        rows = F.arrays_zip(part(1).alias("file"), part(2).alias("line"), part(3).alias("column"))
        found.append(F.transform(rows, lambda r: F.struct(r["file"].alias("file"), r["line"].cast("int").alias("line"), F.nullif(r["column"], F.lit("")).cast("int").alias("column"))))
    return F.array_distinct(F.concat(*found))


def question(family: Column, command: Column) -> Column:
    """What to ask before a command runs: its family, that it is about errors, up to three telling words of it; null without a family."""
    words = F.filter(F.split(F.lower(command), "\\s+"), lambda w: ~F.startswith(w, F.lit("-")))
    words = F.filter(F.split(F.array_join(words, " "), "[^a-z]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*EMPTY_WORDS) & (w != family))
    return F.when(family.isNotNull(), F.concat_ws(" ", family, F.lit("errors failures"), F.nullif(F.array_join(F.slice(F.array_distinct(words), 1, ASKED), " "), F.lit("")), F.lit("common issues")))
