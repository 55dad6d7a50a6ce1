"""Scanning text for secrets and personal data, and masking it."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.chunking import column

# Kind, pattern, replacement, confidence. Matches of a secret block a text; the rest is masked.
SECRETS = [
    ("secret_token", "ghp_[A-Za-z0-9_]{36}|github_pat_[A-Za-z0-9_]{82}", None, 0.95), ("secret_api_key", "AKIA[0-9A-Z]{16}", None, 0.93),
    ("secret_api_key", "sk_live_[A-Za-z0-9]{24,}", None, 0.93), ("secret_token", "xox[bpors]-[A-Za-z0-9-]{10,}", None, 0.90),
]
PERSONAL = [
    ("pii_email", "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b", "[EMAIL_REDACTED]", 0.95),
    ("pii_phone", "(?:\\+?\\d{1,3}[-.\\s]?)?\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}", "[PHONE_REDACTED]", 0.85),
    ("pii_ip", "\\b(?!127\\.0\\.0\\.1|0\\.0\\.0\\.0|10\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.)(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\b", "[IP_REDACTED]", 0.80),
    ("pii_cc", "\\b(?:\\d{4}[-\\s]?){3}\\d{1,7}\\b", "[CC_REDACTED]", 0.90),
    ("pii_ssn", "\\b\\d{3}-\\d{2}-\\d{4}\\b", "[SSN_REDACTED]", 0.95),
    ("pii_handle", "(?<!\\w)@(?!pytest\\b|dataclass\\b|property\\b|staticmethod\\b|classmethod\\b|abstractmethod\\b|override\\b|overload\\b|cached_property\\b|wraps\\b|lru_cache\\b|patch\\b|mock\\b|fixture\\b|mark\\b)[a-zA-Z0-9](?:[a-zA-Z0-9]|-(?=[a-zA-Z0-9])){1,38}\\b", "[HANDLE_REDACTED]", 0.70),
    ("pii_internal_url", "https?://(?:internal|intranet|wiki|jira|confluence)\\.[a-zA-Z0-9.-]+\\S*", "[INTERNAL_URL_REDACTED]", 0.75),
]

FINDINGS = "array<struct<kind: string, start: int, end: int, text: string, replacement: string, confidence: double>>"
Finding = tuple[str, int, int, str, str | None, float]
_COMPILED = {"secrets": [(k, re.compile(p), r, c) for k, p, r, c in SECRETS], "personal": [(k, re.compile(p), r, c) for k, p, r, c in PERSONAL]}
#: What a text must hold for any pattern of personal data to match: a digit, an "@" or a link.
_ANY = re.compile(r"[\d@]|https?://")


def luhn(text: str) -> bool:
    digits = [int(c) for c in re.sub("[^0-9]", "", text)]
    doubled = [d * 2 - 9 * (d > 4) if k % 2 else d for k, d in enumerate(reversed(digits))]
    return bool(digits) and sum(doubled) % 10 == 0


def find(text: str, which: str = "personal") -> list[Finding]:
    """Matches of the patterns of one set, pattern by pattern; card numbers must pass Luhn."""
    if which == "personal" and not _ANY.search(text):
        return []
    out = [(kind, m.start(), m.end(), m.group(0), replacement, confidence) for kind, rx, replacement, confidence in _COMPILED[which] for m in rx.finditer(text)]
    return [f for f in out if f[0] != "pii_cc" or luhn(f[3])]


def resolve(found: list[Finding]) -> list[Finding]:
    """Findings that do not overlap: more confident ones first, then longer ones, then earlier ones; in order of place."""
    kept: list[Finding] = []
    starts: list[int] = []
    for f in sorted(found, key=lambda f: (-f[5], f[1] - f[2], f[1])):
        k = bisect_left(starts, f[1])
        if (k == 0 or kept[k - 1][2] <= f[1]) and (k == len(kept) or kept[k][1] >= f[2]):
            kept.insert(k, f)
            starts.insert(k, f[1])
    return kept


def mask(text: str, found: list[Finding]) -> str:
    """The text with each of some findings, in order and apart from each other, replaced."""
    out, at = [], 0
    for _, start, end, _, replacement, _ in found:
        out += [text[at:start], replacement or ""]
        at = end
    return "".join([*out, text[at:]])


def persons(text: str, tagger: Callable[[list[str]], list[list[tuple[int, int]]]], most: int = 2000) -> list[Finding]:
    """Names that an injected tagger finds: it gets the text in segments of a size at most, and gives places within each. Segments
    overlap, so that it sees what stands around a name; a name counts in the segment in whose middle it begins."""
    around = most // 20
    begins = range(0, len(text), most - 2 * around)
    segments = [(max(0, i - around), text[max(0, i - around) : i + most - around]) for i in begins]
    found = tagger([s for _, s in segments]) if segments else []
    out = []
    for i, (at, s), places in zip(begins, segments, found, strict=True):
        out += [("pii_name", at + a, at + b, s[a:b], "[NAME_REDACTED]", 0.80) for a, b in places if i <= at + a < i + most - 2 * around]
    return out


#: What may be a secret: runs of signs that keys and tokens are made of; the window that is measured, and the bits a character that
#: one must have: fewer where all signs are hexadecimal digits.
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
_HEX = re.compile(r"[0-9A-Fa-f]+")
WINDOW, BITS, HEX_BITS = 20, 3.9, 3.0
_PART = [n * math.log2(n) if n else 0.0 for n in range(WINDOW + 1)]


def high_entropy(text: str) -> list[Finding]:
    """Places where a window of characters is too evenly mixed for words: runs of such windows, one after the other. A run must hold a
    letter and a digit. The measure of a window follows from the one before by the characters that leave and enter, so the scan takes
    time in proportion to the text."""
    out: list[Finding] = []
    for run in _RUN.finditer(text):
        t, first = run.group(0), run.start()
        least = HEX_BITS if _HEX.fullmatch(t) else BITS
        count: dict[str, int] = {}
        mixed, begin, end = 0.0, -1, -1
        for i, c in enumerate(t):
            if i >= WINDOW:
                n = count[old := t[i - WINDOW]]
                count[old] = n - 1
                mixed += _PART[n - 1] - _PART[n]
            n = count.get(c, 0)
            count[c] = n + 1
            mixed += _PART[n + 1] - _PART[n]
            if i >= WINDOW - 1 and math.log2(WINDOW) - mixed / WINDOW >= least - 1e-9:
                if begin >= 0 and i - WINDOW + 1 > end:
                    out.append(_entropic(text, first + begin, first + end))
                    begin = -1
                begin, end = (i - WINDOW + 1 if begin < 0 else begin), i + 1
        if begin >= 0:
            out.append(_entropic(text, first + begin, first + end))
    return [f for f in out if re.search(r"\d", f[3]) and re.search(r"[A-Za-z]", f[3])]


def _entropic(text: str, start: int, end: int) -> Finding:
    return ("secret_high_entropy", start, end, text[start:end], None, 0.85)


def entropy_findings(text: Column) -> Column:
    """The findings of the entropy layer."""
    return column(lambda t: [_row(f) for f in high_entropy(t)], FINDINGS, text)


def is_luhn(text: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(text, "[^0-9]", ""))


def _row(f: Finding) -> dict:
    return dict(zip(("kind", "start", "end", "text", "replacement", "confidence"), f, strict=True))


def findings(text: Column, secrets: bool = True, personal: bool = True) -> Column:
    """All findings of the patterns. Places within a text need a pass over it per pattern, which no built-in gives: Arrow-batched."""
    sets = [n for n, on in (("secrets", secrets), ("personal", personal)) if on]
    return column(lambda t: [_row(f) for n in sets for f in find(t, n)], FINDINGS, text)


def has_secret(text: Column) -> Column:
    c = F.lit(False)
    for _, pattern, _, _ in SECRETS:
        c |= F.rlike(text, F.lit(pattern))
    return c


def _found(row) -> Finding:
    return row["kind"], row["start"], row["end"], row["text"], row["replacement"], row["confidence"]


def resolved(found: Column) -> Column:
    """As resolve(), over columns of findings."""
    return column(lambda rows: [_row(f) for f in resolve([_found(r) for r in rows])], FINDINGS, found)


def masked(text: Column, found: Column | None = None) -> Column:
    """The text with its findings replaced: those given, or its personal data."""
    if found is not None:
        return column(lambda t, rows: mask(t, [_found(r) for r in rows]), "string", text, found)
    return column(lambda t: mask(t, resolve(find(t))), "string", text)


def scanned(text: Column, mode: Column, strict: bool = False) -> Column:
    """action and content: off passes everything, a secret blocks, personal data is masked. Only what is left is masked. strict: rows
    of the mode "strict" also go through the entropy layer, whose findings block like secrets."""
    secret = has_secret(text)
    if strict:
        secret |= F.coalesce(F.size(entropy_findings(F.when(mode == "strict", text))) > 0, F.lit(False))
    clean = masked(F.when((mode != "off") & ~secret, text))
    return (
        F.when(mode == "off", F.struct(F.lit("passed").alias("action"), text.alias("content")))
        .when(secret, F.struct(F.lit("blocked").alias("action"), F.lit("").alias("content")))
        .when(clean != text, F.struct(F.lit("masked").alias("action"), clean.alias("content")))
        .otherwise(F.struct(F.lit("passed").alias("action"), text.alias("content")))
    )


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters in bits."""
    chars = F.array_distinct(F.split(text, ""))
    per = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text))
    return F.coalesce(F.aggregate(F.filter(per, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p)), F.lit(0.0))


def for_log(text: Column) -> Column:
    """The first and last four characters of what is long enough to hide the rest."""
    return F.when(F.length(text) > 10, F.concat(F.substring(text, 1, 4), F.lit("..."), F.substring(text, -4, 4))).otherwise("<redacted>")
