"""Scalar text functions (F5-F10, F14-F16, P14) as built-in Column expressions.

Regex flavour notes (Python parity): ``(?U)`` makes Java's ``\\s`` Unicode-aware
like Python's; ``(?iu)`` is Unicode case folding; ``(?s)`` lets ``.`` cross newlines.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import (
    COMMAND_MAX_LEN,
    SECRET_FLAG_PATTERN,
    SIGNALS_EN,
    SIGNALS_ZH,
    STOP_ZH_CHARS,
)

_SPECIAL = set("\\^$.|?*+()[]{}")
ELLIPSIS = "…"


def regex_escape(s: str) -> str:
    """Escape regex metacharacters; valid for Java regex and RE2 alike."""
    return "".join("\\" + c if c in _SPECIAL else c for c in s)


def literal_alternation(words: Iterable[str]) -> str:
    return "|".join(regex_escape(w) for w in words)


def load_word_list(path: str) -> list[str]:
    """One word per line; blank lines and lines starting with '#' ignored."""
    with open(path, encoding="utf-8") as f:
        return [w.strip() for w in f if w.strip() and not w.lstrip().startswith("#")]


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse_ws(c: Column) -> Column:
    """Python ``" ".join(s.split())``."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" "))


def truncate_ws(c: Column, n: int) -> Column:
    """collapse whitespace; if longer than n, cut to n, right-strip, add an ellipsis."""
    t = collapse_ws(c)
    return F.when(F.length(t) <= n, t).otherwise(
        F.concat(F.rtrim(F.substring(t, 1, n)), F.lit(ELLIPSIS)))


def signal_pattern(words: Iterable[str] | None = None) -> str:
    words = list(words) if words is not None else SIGNALS_ZH + SIGNALS_EN
    return "(?iu)" + literal_alternation(words)


def has_signal(c: Column, words: Iterable[str] | None = None) -> Column:
    """Any keyword occurs (substring, case-insensitive)."""
    return F.coalesce(c.rlike(signal_pattern(words)), F.lit(False))


def starts_with_any(c: Column, prefixes: Iterable[str]) -> Column:
    expr = F.lit(False)
    for p in prefixes:
        expr = expr | F.startswith(c, F.lit(p))
    return F.coalesce(expr, F.lit(False))


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    expr = F.lit(False)
    for p in needles:
        expr = expr | F.contains(c, F.lit(p))
    return F.coalesce(expr, F.lit(False))


WORD_CHARS = r"\p{L}\p{N}_"
ENGLISH_TERM = rf"(?<![{WORD_CHARS}])[a-zA-Z]{{4,}}(?![{WORD_CHARS}])"


def english_terms(c: Column, stop_words: Iterable[str] = ()) -> Column:
    """F8: whole word tokens of 4+ ASCII letters, lower-cased, stop words removed.

    A token is a maximal run of Unicode letters/digits/underscore (what Python's
    Unicode ``\\b`` delimits); one regex pass extracts the all-ASCII-letter ones.
    For counting, prefer ``english_terms(c)`` + explode + ``isin`` on the stop list
    (a hash set) over filtering inside the array.
    """
    words = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ENGLISH_TERM), 0), lambda t: F.lower(t))
    stop = sorted({w.lower() for w in stop_words})
    if stop:
        stop_arr = F.array(*[F.lit(w) for w in stop])
        words = F.filter(words, lambda t: ~F.array_contains(stop_arr, t))
    return words


def cjk_ngrams(c: Column, stop_chars: str = STOP_ZH_CHARS, stop_words: Iterable[str] = ()) -> Column:
    """greedy runs of 2-8 CJK ideographs, stop characters deleted, then all
    2-grams followed by all 3-grams of what is left (if 2+ characters remain)."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([一-鿿]{2,8})"), 1)
    cls = "[" + "".join(regex_escape(ch) for ch in stop_chars) + "]" if stop_chars else None
    cleaned = F.transform(runs, lambda r: F.regexp_replace(r, cls, "") if cls else r)

    def grams(s):
        lens = F.filter(F.array(F.lit(2), F.lit(3)), lambda L: L <= F.length(s))
        return F.flatten(F.transform(lens, lambda L: F.transform(
            F.sequence(F.lit(1), F.length(s) - L + 1), lambda i: F.substring(s, i, L))))

    out = F.flatten(F.transform(cleaned, grams))
    stop = sorted(set(stop_words))
    if stop:
        stop_arr = F.array(*[F.lit(w) for w in stop])
        out = F.filter(out, lambda t: ~F.array_contains(stop_arr, t))
    return out


_SECRET_RUN = r"(?<![A-Za-z0-9_\-])(?![0-9a-fA-F]{40}(?![A-Za-z0-9_\-]))[A-Za-z0-9_\-]{21,}"


def redact_command(c: Column, max_len: int = COMMAND_MAX_LEN) -> Column:
    """mask secret flag values, mask 21+ character identifier runs (except
    exactly 40 hex digits), cut to max_len with '...'."""
    s = F.regexp_replace(c, "(?iU)" + SECRET_FLAG_PATTERN, "$1***")
    s = F.regexp_replace(s, _SECRET_RUN, "***")
    return F.when(F.length(s) > max_len, F.concat(F.substring(s, 1, max_len - 3), F.lit("..."))).otherwise(s)


def escape_html(c: Column) -> Column:
    """& < > \" in this order."""
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tag(c: Column) -> Column:
    """lower case, space and underscore become '-'."""
    return F.translate(F.lower(c), " _", "--")


def snippet_parts(text: Column, pattern: str) -> tuple[Column, Column]:
    """(text before the first match, the match) from capture groups (code points)."""
    full = f"^((?s:.*?))({pattern})"
    return F.regexp_extract(text, full, 1), F.regexp_extract(text, full, 2)


def snippet_from_parts(text: Column, pre: Column, hit: Column, ctx: int) -> Column:
    """F6 from precomputed parts: up to ``ctx`` characters each side, '…' + left-strip
    before when cut, right-strip + '…' after when cut."""
    start = F.length(pre)
    end = start + F.length(hit)
    before = F.when(start - ctx > 0, F.substring(pre, start - ctx + 1, ctx)).otherwise(pre)
    after = F.substring(text, end + 1, ctx)
    before = F.when((start - ctx > 0) & (before != ""),
                    F.concat(F.lit(ELLIPSIS), F.regexp_replace(before, r"(?U)^\s+", ""))).otherwise(before)
    after = F.when((end + ctx < F.length(text)) & (after != ""),
                   F.concat(F.regexp_replace(after, r"(?U)\s+\z", ""), F.lit(ELLIPSIS))).otherwise(after)
    return F.struct(before.alias("context_before"), hit.alias("match_text"), after.alias("context_after"))


def snippet(text: Column, pattern: str, ctx: int) -> Column:
    """struct(before, matched, after) around the first match of ``pattern``.

    Offsets are taken from capture groups (code points), never from byte or
    UTF-16 positions. On a DataFrame prefer computing ``snippet_parts`` in
    their own projection first (the regex then runs once per row).
    """
    pre, hit = snippet_parts(text, pattern)
    return snippet_from_parts(text, pre, hit, ctx)


def java_regex(pattern: str, groups_before: int = 0) -> str:
    """A Python regex in Java's syntax, for use inside ``(?dU:...)``: named groups and references to them, numbered
    references (moved by ``groups_before``), ``\\Z``, comments, and brackets or ``&&`` inside a class. Raises ValueError for
    an invalid pattern and for syntax Java has no equivalent of."""
    try:
        names = re.compile(pattern).groupindex
    except re.error as e:
        raise ValueError(f"invalid regular expression {pattern!r}: {e}") from e
    out, i, n = [], 0, len(pattern)
    while i < n:
        rest = pattern[i:]
        if m := re.match(r"\\([1-9][0-9]?)", rest):
            out.append(f"(?:\\{int(m[1]) + groups_before})")  # the group ends the number
        elif m := re.match(r"\\Z", rest):
            out.append(r"\z")
        elif m := re.match(r"\\.", rest, re.S):
            out.append(m[0])
        elif m := re.match(r"\(\?P<(\w+)>", rest):
            out.append("(")
        elif m := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(f"(?:\\{names[m[1]] + groups_before})")
        elif m := re.match(r"\(\?#[^)]*\)", rest):
            pass
        elif re.match(r"\(\?\(|\(\?[a-zA-Z]*[aL]", rest):
            raise ValueError(f"not supported in a search pattern: {rest[:8]!r} in {pattern!r}")
        elif m := re.match(r"\(\?([imsux]+)(-[imsx]+)?([:)])", rest):
            flags = m[1].replace("u", "")
            out.append(f"(?{flags}{m[2] or ''}{m[3]}" if flags or m[2] or m[3] == ":" else "")
        elif m := re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]", rest, re.S):
            body = m[0][1:-1]
            neg, body = body[:1] == "^", body.removeprefix("^")
            body = re.sub(r"\\.|\[|\]|&&", lambda x: x[0] if x[0][0] == "\\" else "".join("\\" + c for c in x[0]), body, flags=re.S)
            out.append(f"[{'^' if neg else ''}{body}]")
        else:
            m = re.match(".", rest, re.S)
            out.append(m[0])
        i += m.end()
    return "".join(out)


_UNSAFE_FILE = r'[<>:"|?*]'


def safe_file_name(c: Column) -> Column:
    """drop characters that are unsafe in file names."""
    return F.regexp_replace(c, _UNSAFE_FILE, "")


_SLUG_PUNCT = "[，。！？、；：“”‘’（）\\[\\]…\\n\\r]"
_SLUG_UNSAFE = r'[<>:"|?*{}#@&=+$!`~^]'


def topic_slug(topic: Column, session_id: Column, max_len: int = 40) -> Column:
    """file-name tag from a topic: punctuation to spaces, unsafe characters
    dropped, whitespace collapsed, first ``max_len`` characters with '-' for
    spaces and '/', repeated dashes merged and trimmed; the first 8 characters of
    the session id when the topic is empty, a fallback topic, or the slug is short."""
    clean = F.regexp_replace(topic, _SLUG_PUNCT, " ")
    clean = F.regexp_replace(clean, _SLUG_UNSAFE, "")
    clean = F.btrim(F.regexp_replace(clean, r"(?U)\s+", " "), F.lit(" "))
    tagged = F.translate(F.btrim(F.substring(clean, 1, max_len), F.lit(" ")), " /", "--")
    tagged = F.regexp_replace(F.regexp_replace(tagged, "-+", "-"), "^-+|-+$", "")
    sid = F.substring(session_id, 1, 8)
    return (F.when(topic.isNull() | (topic == "") | F.startswith(topic, F.lit("session-")), sid)
            .when(F.length(tagged) >= 4, tagged).otherwise(sid))


def plain_path(file_path: Column) -> Column:
    """A file's path as it was given, from the URI of the file metadata (which writes some characters as %XX)."""
    decoded = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:(//)?(?=/)", "")
