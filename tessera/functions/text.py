"""Text expressions: hashing, identities, truncation, rendering. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column, prefix: str = "") -> Column:
    h = F.sha2(F.encode(text, "UTF-8"), 256)
    return F.concat(F.lit(prefix), h) if prefix else h


def short_hash(text: Column, n: int) -> Column:
    return F.substring(content_hash(text), 1, n)


def score_id(*parts: Column) -> Column:
    """The same id on every run."""
    return F.md5(F.encode(F.concat_ws(":", *parts), "UTF-8"))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, "^\\s+", ""), "\\s+$", "")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def project_name(name: Column, most: int = 50) -> Column:
    """Lower case, hyphens for all but letters and digits, cut to a length."""
    x = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9-]", "-"), "-+", "-")
    x = F.regexp_replace(F.substring(F.regexp_replace(x, "^-|-$", ""), 1, most), "-$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("unnamed-project")).otherwise(x)


def repository_slug(url: Column) -> Column:
    """org/repo of a remote's address in either form, else null."""
    u = F.trim(url)
    ssh = F.regexp_extract(u, "^git@[^:]+:([^/]+/[^/]+?)(?:\\.git)?$", 1)
    web = F.regexp_extract(u, "^https?://[^/]+/([^/]+/[^/]+?)(?:\\.git)?$", 1)
    return F.lower(F.coalesce(F.nullif(ssh, F.lit("")), F.nullif(web, F.lit(""))))


def duration_days(text: Column) -> Column:
    """Days of 30d, 2w, 3m or 1y; null where malformed."""
    n = F.regexp_extract(text, "^([0-9]+)[dwmy]$", 1)
    unit = F.regexp_extract(text, "^[0-9]+([dwmy])$", 1)
    factor = F.when(unit == "d", 1).when(unit == "w", 7).when(unit == "m", 30).when(unit == "y", 365)
    return F.when(n != "", n.cast("int")) * factor


def last_index(text: Column, sign: str) -> Column:
    """Place of a character's last occurrence, counted from 0; -1 where there is none."""
    at = F.instr(F.reverse(text), sign)
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at)


def truncated_at_sentence(text: Column, most: int) -> Column:
    """Cut after the last full stop that fits, else the last exclamation or question mark, else the last space; then three dots."""
    part = F.substring(text, 1, most - 3)
    cut = F.when(F.length(text) <= most, text)
    for sign in ".!?":
        at = last_index(part, sign)
        cut = cut.when(at > 0, F.concat(F.substr(text, F.lit(1), at + 1), F.lit("...")))
    space = last_index(part, " ")
    word = F.when(space > 0, F.substr(part, F.lit(1), space)).otherwise(part)
    return cut.otherwise(F.concat(F.rtrim(word), F.lit("...")))


def capped(text: Column, most: int = 5000) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 12), F.lit(" [TRUNCATED]")))


def snippet(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def first_and_last(tokens: Column, most: int, first: float = 0.7) -> Column:
    """The first part and the rest of the budget from the end, of an array of tokens joined by spaces."""
    head = int(most * first)
    middle = F.lit("\n\n[... truncated middle ...]\n\n")
    return F.when(F.size(tokens) <= most, F.array_join(tokens, " ")).otherwise(F.concat(F.array_join(F.slice(tokens, 1, head), " "), middle, F.array_join(F.slice(tokens, -(most - head), most - head), " ")))


def extension(path: Column) -> Column:
    """The last suffix in lower case with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, "[^/.](\\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def issue_url(host: Column, key: Column, comment: Column) -> Column:
    return F.concat(F.lit("https://"), host, F.lit("/browse/"), key, F.when(comment.isNotNull() & (comment != ""), F.concat(F.lit("?focusedCommentId="), comment)).otherwise(""))


def badges(*named: tuple[str, Column]) -> Column:
    """[Name: value] for each value that is there."""
    return F.concat_ws(" ", *(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"[{n}: "), v, F.lit("]"))) for n, v in named))


def context_header(path: Column, symbols: Column, imports: Column, language: Column) -> Column:
    """One line that says where a piece of code is from."""
    scope = F.when(F.size(symbols) >= 2, F.concat(F.lit("Class: "), symbols[0], F.lit(" | Method: "), F.get(symbols, 1))).when(F.size(symbols) == 1, F.concat(F.lit("Symbol: "), symbols[0]))
    used = F.when(F.size(imports) > 0, F.concat(F.lit("Imports: "), F.array_join(F.slice(imports, 1, 5), ", ")))
    return F.concat(F.lit("# "), F.concat_ws(" | ", F.concat(F.lit("File: "), path), scope, used, F.concat(F.lit("Language: "), language)))


# Names of projects of places that are none, folders for what is temporary, and what a temporary folder's name holds.
ROOT, HOME, TEMPORARY = "root-project", "home-project", "temp-project"
TEMPORARY_FOLDERS, TEMPORARY_NAMES = ["/tmp", "/var/tmp"], ["build", "tmp", "cache", "temp"]


def project(named: Column, folder: Column, home: Column, remote: Column) -> Column:
    """The project of a folder: the name it is given; else what its place says (root, home, temporary); else the repository of its
    remote; else its own name."""
    place = F.when(F.rlike(folder, F.lit("^/+$")), F.lit("/")).otherwise(F.regexp_replace(folder, "/+$", ""))
    parent, name = F.regexp_replace(place, "/[^/]*$", ""), file_name(place)
    temporary = place.isin(*TEMPORARY_FOLDERS)
    for word in TEMPORARY_NAMES:
        temporary |= parent.isin(*TEMPORARY_FOLDERS) & F.contains(F.lower(name), F.lit(word))
    return (
        F.when(strip(F.coalesce(named, F.lit(""))) != "", project_name(named)).when(folder.isNull(), F.lit("unknown-project")).when(place == "/", ROOT)
        .when(place == home, HOME).when(temporary, TEMPORARY).otherwise(F.coalesce(repository_slug(remote), project_name(name)))
    )
