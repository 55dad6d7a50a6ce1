"""Documents composed from records of issue trackers and forges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _or(value: Column, other: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(other))


def _list(values: Column, most: int) -> Column:
    n = F.size(values)
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(" more)"))).otherwise(""))


def tracker_issue(key: Column, summary: Column, kind: Column, priority: Column, status: Column, reporter: Column, assignee: Column, labels: Column, created: Column, updated: Column, body: Column) -> Column:
    named = F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise("None")
    return F.concat_ws(
        "\n", _line("[", key, "] ", _or(summary, "No summary")), _line("Type: ", _or(kind, "Unknown"), " | Priority: ", _or(priority, "None"), " | Status: ", _or(status, "Unknown")),
        _line("Reporter: ", _or(reporter, "Unknown"), " | Assigned: ", _or(assignee, "Unassigned")), _line("Labels: ", named), _line("Created: ", F.substring(created, 1, 10), " | Updated: ", F.substring(updated, 1, 10)),
        F.lit(""), F.lit("Description:"), _or(body, "(No description)"),
    )


def tracker_comment(key: Column, summary: Column, kind: Column, priority: Column, status: Column, author: Column, created: Column, body: Column) -> Column:
    head = _line("[", key, "] ", _or(summary, "No summary"), " (", _or(kind, "Unknown"), ", ", _or(priority, "None"), ", ", _or(status, "Unknown"), ")")
    return F.concat_ws("\n", head, F.lit(""), _line("Comment by ", _or(author, "Unknown"), " (", F.substring(created, 1, 10), "):"), _or(body, "(Empty comment)"))


def forge_issue(number: Column, title: Column, body: Column, labels: Column, assignees: Column, milestone: Column, state: Column) -> Column:
    meta = F.concat_ws(" | ", F.when(F.size(labels) > 0, _line("Labels: ", F.array_join(labels, ", "))), F.when(F.size(assignees) > 0, _line("Assignees: ", F.array_join(assignees, ", "))), F.when(milestone != "", _line("Milestone: ", milestone)), _line("State: ", _or(state, "unknown")))
    return F.concat_ws("\n", _line("Issue #", number.cast("string"), ": ", _or(title, "Untitled")), F.when(body != "", _line("\n", body)), _line("\n", meta))


def forge_comment(number: Column, author: Column, body: Column) -> Column:
    return F.concat_ws("\n", _line("Comment on Issue #", number.cast("string"), " by ", _or(author, "unknown"), ":"), _line("\n", F.coalesce(body, F.lit(""))))


def pull_request(number: Column, title: Column, body: Column, merged: Column, state: Column, base: Column, head: Column, labels: Column, files: Column) -> Column:
    meta = F.concat_ws(" | ", _line("State: ", F.when(merged, F.lit("merged")).otherwise(_or(state, "open"))), _line("Branch: ", _or(base, "unknown"), " <- ", _or(head, "unknown")), F.when(F.size(labels) > 0, _line("Labels: ", F.array_join(labels, ", "))), F.when(F.size(files) > 0, _line("Files changed: ", _list(files, 20))))
    return F.concat_ws("\n", _line("PR #", number.cast("string"), ": ", _or(title, "Untitled")), F.when(body != "", _line("\n", body)), _line("\n", meta))


def diff(number: Column, file: Column, status: Column, added: Column, removed: Column, patch: Column) -> Column:
    shown = F.concat(F.substring(patch, 1, 2000), F.when(F.length(patch) > 2000, F.lit("\n... (diff truncated for embedding)")).otherwise(""))
    return F.concat_ws("\n", _line("Diff for PR #", number.cast("string"), ": ", _or(file, "unknown")), _line("Change: ", _or(status, "modified"), " (+", added.cast("string"), " -", removed.cast("string"), ")"), F.when(patch != "", _line("\n", shown)))


def review(number: Column, author: Column, state: Column, body: Column) -> Column:
    return F.concat_ws("\n", _line("Review on PR #", number.cast("string"), " by ", _or(author, "unknown"), " (", F.lower(_or(state, "commented")), "):"), _line("\n", F.coalesce(body, F.lit(""))))


def commit(sha: Column, message: Column, author: Column, total: Column, added: Column, removed: Column, files: Column) -> Column:
    stats = F.when(total.isNotNull(), _line("\nStats: ", total.cast("string"), " changes (+", added.cast("string"), " -", removed.cast("string"), ")"))
    return F.concat_ws("\n", _line("Commit ", F.substring(_or(sha, "unknown"), 1, 8), ": ", _or(message, "No message")), stats, F.when(F.size(files) > 0, _line("Files: ", _list(files, 15))), _line("Author: ", _or(author, "unknown")))


def check_run(name: Column, conclusion: Column, branch: Column, sha: Column) -> Column:
    return F.concat_ws("\n", _line("CI ", _or(name, "unknown"), ": ", _or(conclusion, "unknown")), _line("Branch: ", _or(branch, "unknown"), " | Commit: ", F.substring(F.coalesce(sha, F.lit("")), 1, 8)), F.when(conclusion == "failure", F.lit("Status: FAILED -- check workflow logs for details")))


def error_document(command: Column, error: Column, code: Column, refs: Column, output: Column) -> Column:
    return F.concat_ws("\n", F.lit("[error_pattern]"), _line("Command: ", command), _line("Error: ", error), _line("Exit Code: ", code.cast("string")), F.when(F.size(refs) > 0, _line("File References: ", F.array_join(refs, ", "))), _line("Output: ", F.substring(output, 1, 500)))
