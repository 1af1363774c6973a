"""Text expressions: tokens, windows, shingles, license and intent rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearloom import config

WORD3 = r"[\p{L}\p{N}_]{3,}"
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column, pattern: str = WORD3) -> Column:
    """Lower-cased words, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def split_ws(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: inside lambdas an expression would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(tokens: Column, n: int, kind: str = "string") -> Column:
    """All n-token windows; none if there are fewer tokens. kind: the tokens' type."""
    every = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, n))).otherwise(F.array().cast(f"array<array<{kind}>>"))
    return let(tokens, every)


def joined_windows(tokens: Column, n: int) -> Column:
    return F.transform(windows(tokens, n), lambda w: F.array_join(w, " "))


def chunks(text: Column, size: int = 256, overlap: int = 50) -> Column:
    """Overlapping chunks as structs (chunk_idx, start_token, end_token, chunk_text). A text of at most `size` tokens is one chunk as it stands; an empty one has none."""
    step, kind = size - overlap, "array<struct<chunk_idx:int,start_token:int,end_token:int,chunk_text:string>>"

    def every(tokens: Column) -> Column:
        n = F.size(tokens)
        count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - overlap) / step).cast("int"))

        def chunk(i: Column) -> Column:
            body = F.when(n <= size, text).otherwise(F.array_join(F.slice(tokens, i * step + 1, F.lit(size)), " "))
            return F.struct(i.alias("chunk_idx"), (i * step).alias("start_token"), F.least(i * step + size, n).alias("end_token"), body.alias("chunk_text"))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), chunk)).otherwise(F.array().cast(kind))

    return let(split_ws(text), every)


def license_class(text: Column) -> Column:
    return (
        F.when(text.contains("GNU General Public License") | text.contains("GPL"), "GPL-3.0")
        .when(text.contains("AGPL") | text.contains("Affero"), "AGPL-3.0")
        .when(text.contains("MIT") | text.contains("Apache"), "Permissive")
        .otherwise("Proprietary")
    )


def code_title(text: Column, stem: Column) -> Column:
    """The first line that names a corpus entry, without comment marks; else made from stem and license."""
    line = F.regexp_extract(text, r"(?m)^(.*RefCorpus:.*)$", 1)
    clean = F.trim(F.regexp_replace(line, r"//|/\*|\*/", ""))
    return F.when(line != "", clean).otherwise(F.concat(F.lit("© Codebase: "), stem, F.lit(" ["), license_class(text), F.lit("]")))


def has_any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def is_code(text: Column) -> Column:
    return has_any(text, config.CODE_KEYWORDS)


def scan_intent(message: Column) -> Column:
    return has_any(F.lower(message), config.SCAN_WORDS) | (F.length(message) > 60)


def scan_content(message: Column) -> Column:
    """The message without the first prefix that it begins with."""
    low, out = F.lower(message), None
    for p in config.SCAN_PREFIXES:
        cut = F.trim(F.substring(message, F.lit(len(p) + 1), F.length(message)))
        out = F.when(low.startswith(p), cut) if out is None else out.when(low.startswith(p), cut)
    return out.otherwise(message)


def chat_is_code(message: Column) -> Column:
    return has_any(scan_content(message), config.CHAT_CODE_WORDS) | F.lower(message).contains("codebase")


def newlines(text: Column) -> Column:
    """Universal newlines."""
    return F.regexp_replace(text, "\r\n?", "\n")


def source_domain(uri: Column) -> Column:
    host = F.regexp_extract(uri, r"://([^/?#]*)", 1)
    return F.when(uri.contains("://"), F.when(host == "", "unknown").otherwise(host)).otherwise("local-filesystem")
