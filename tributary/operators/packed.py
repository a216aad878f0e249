"""Lists packed into one text, split by a quote-aware finite-state tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r\n 　﻿​"
#: States of the tokenizer.
START, BARE, QUOTED, AFTER = range(4)
CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def scan(text: str, delimiters: str, quotes: str, opened: str = "") -> tuple[list[str], bool]:
    """Values between ``delimiters`` outside quotes and brackets, and whether the quoting came out even.

    A quote opens only at the start of a value and closes only before a delimiter or the end; inside,
    a doubled quote or a backslash before it stands for itself. Brackets of ``opened`` nest; a delimiter
    inside them belongs to the value.
    """
    out: list[str] = []
    buf: list[str] = []
    state, quote, stack, even, i, n = START, "", [], True, 0, len(text)
    while i < n:
        c = text[i]
        if state == QUOTED:
            if c == "\\" and i + 1 < n and text[i + 1] in "\\\"'/nrtu":
                nxt = text[i + 1]
                if nxt == "u" and i + 6 <= n:
                    try:
                        buf.append(chr(int(text[i + 2 : i + 6], 16)))
                        i += 6
                        continue
                    except ValueError:
                        pass
                buf.append({"n": "\n", "r": "\r", "t": "\t"}.get(nxt, nxt))
                i += 2
                continue
            if c == quote:
                if i + 1 < n and text[i + 1] == quote and not closes(text, i + 1, delimiters, quote):
                    buf.append(c)
                    i += 2
                    continue
                if closes(text, i, delimiters, quote):
                    state = AFTER
                    i += 1
                    continue
            buf.append(c)
        elif state == START and c in quotes:
            state, quote = QUOTED, c
        elif c in delimiters and not stack:
            out.append("".join(buf))
            buf, state = [], START
        elif c in BLANK and state == START:
            pass
        elif state == AFTER:
            if c not in BLANK:
                even = False
                buf.append(c)
                state = BARE
        else:
            if c in opened:
                stack.append(CLOSERS[c])
            elif stack and c == stack[-1]:
                stack.pop()
            buf.append(c)
            state = BARE
        i += 1
    out.append("".join(buf))
    return out, even and state != QUOTED and not stack


def closes(text: str, i: int, delimiters: str, quote: str) -> bool:
    """Whether the quote at ``i`` ends its value: blanks, then a delimiter or the end, follow."""
    j = i + 1
    while j < len(text) and text[j] in BLANK and text[j] not in delimiters:
        j += 1
    return j >= len(text) or text[j] in delimiters


def clean(values: list[str]) -> list[str]:
    return [w for w in (v.strip(BLANK) for v in values) if w]


def unwrap(value: str) -> str:
    """A value without the one pair of quotes or angle brackets around it."""
    if len(value) >= 2 and value[0] == "<" and value[-1] == ">" and value.count("<") == 1:
        return value[1:-1].strip(BLANK)
    return value


def split_packed(text: str | None, count: int | None = None) -> list[str]:
    """The values of a packed list, in order, without empty ones.

    The notation is read off the text: a bracketed list, a list of quoted values, or values between line
    breaks, tabs, ``|`` or ``;`` (mixed, too), blanks between addresses, or commas. ``count``, where given,
    picks the reading that yields so many values; it decides above all whether a comma delimits (``a, b``) or
    belongs to a value (``Last, First``). Without a count, commas delimit when nothing else does, or between
    addresses. A count that no reading yields is ignored. Null, empty and blank texts hold no values.
    """
    if text is None or not (body := text.strip(BLANK)):
        return []
    wanted = None if count is None or count != count else int(count)
    if len(body) >= 2 and body[0] == "[" and body[-1] == "]" and body[1:-1].strip(BLANK)[:1] in ("'", '"', ""):
        values, even = scan(body[1:-1], ",", "'\"")
        if even:
            return clean(values)
    if body[0] == "'":
        values, even = scan(body, ",", "'\"")
        if even:
            return clean(values)
    if body[0] == "<" and body[-1] == ">":
        values = [unwrap(v) for v in clean(scan(body.replace(">", ">\n"), ";,|\n\t", "")[0])]
        if not any("<" in v or ">" in v for v in values):
            return clean(values)
    quotes = '"' if '"' in body else ""
    if body[0] == '"' and (d := after_quote(body)):
        values, even = scan(body, d, "'\"" if d == "," else '"')
        if even and (wanted is None or len(clean(values)) == wanted):
            return clean(values)
    hard = [d for d in STRONG if d in body]
    readings: list[list[str]] = []
    for delimiters in ["".join(hard), *(hard if len(hard) > 1 else [])]:
        if delimiters:
            readings.append(read(body, delimiters, quotes))
    parts = readings[0] if readings else [body]
    words = [w for p in parts for w in (addresses(p) if "@" in p else [p])]
    if len(words) > len(parts):
        readings.insert(0, words)
        parts = words
    commas = [v for p in parts for v in read(p, ",", quotes)]
    if wanted is None:
        if not readings and "," in body:
            return commas
        return [v for p in parts for v in (read(p, ",", quotes) if "," in p and all("@" in x for x in p.split(",") if x.strip(BLANK)) else [unquote(p)])]
    if not readings:
        readings.append(read(body, "\0", quotes))
    for r in readings:
        if len(r) == wanted:
            return r
    if len(commas) == wanted:
        return commas
    if len(parts) < wanted < len(commas):
        return by_count(parts, wanted)
    return commas if not hard and wanted > 1 else readings[0]


#: Delimiters that seldom stand inside a value.
STRONG = ("\n", "\r", "\t", "|", ";")


def read(text: str, delimiters: str, quotes: str) -> list[str]:
    values, even = scan(text, delimiters, quotes)
    if not even:
        values, _ = scan(text, delimiters, "")
    return [unwrap(v) for v in clean(values)]


def unquote(value: str) -> str:
    got = read(value, "\0", '"' if value[:1] == '"' else "")
    return got[0] if got else value


def after_quote(body: str) -> str:
    """The delimiter behind the first quoted value, or ''."""
    i = 1
    while i < len(body):
        if body[i] == "\\":
            i += 2
            continue
        if body[i] == body[0]:
            j = i + 1
            if j < len(body) and body[j] == body[0]:
                i += 2
                continue
            while j < len(body) and body[j] == " ":
                j += 1
            if j >= len(body):
                return ","
            if body[j] in ";|,\n\r\t":
                return body[j]
        i += 1
    return ""


def addresses(part: str) -> list[str]:
    """The blank-separated items of a part in which an item is a whole address, else the part itself."""
    items = part.split()
    return items if any("@" in x[1:-1] for x in items) and not any(x[-1] in ",;" for x in items) else [part]


def by_count(parts: list[str], wanted: int) -> list[str]:
    """Split parts at commas until there are ``wanted`` values.

    Commas that look least like ``Last, First`` split first: a comma between two values that each
    read as complete (a user name, an address, two words).
    """
    pieces = [clean(scan(p, ",", '"', "")[0]) or [p] for p in parts]
    total = sum(map(len, pieces))
    if total <= wanted:
        return [x for p in pieces for x in p]
    joins = total - wanted
    if joins >= total - len(parts):
        return [p for p in parts]
    ranked = sorted(((score(a, b), k, i) for k, p in enumerate(pieces) for i, (a, b) in enumerate(zip(p, p[1:]))), key=lambda x: (-x[0], x[1], x[2]))
    glued: set[tuple[int, int]] = set()
    for _, k, i in ranked:
        if len(glued) == joins:
            break
        if (k, i - 1) in glued or (k, i + 1) in glued:
            continue
        glued.add((k, i))
    for _, k, i in ranked:
        if len(glued) < joins:
            glued.add((k, i))
    out = []
    for k, p in enumerate(pieces):
        cur = p[0]
        for i, b in enumerate(p[1:]):
            if (k, i) in glued:
                cur += ", " + b
            else:
                out.append(cur)
                cur = b
        out.append(cur)
    return out


def score(a: str, b: str) -> int:
    """How much ``a, b`` looks like one value: family name, then a given name or a short suffix."""
    if "@" in a or "@" in b:
        return 0
    suffix = b.rstrip(".")
    one = len(b.split()) <= 2 and (b[:1].isupper() or (len(suffix) <= 4 and suffix.isalpha()))
    return 2 * (len(a.split()) == 1 and a[:1].isupper() and not any(c.isdigit() or c in "_." for c in a)) + one


def explode_packed(df: DataFrame, key: str, packed: str, count: str | None = None) -> DataFrame:
    """(key, pos, item_value): one row per value with its position from 1.

    Runs as one Arrow batch pass without a shuffle; texts of any length stay in the task that read them.
    """
    cols = [F.col(key).alias("k"), F.col(packed).alias("t"), (F.col(count).cast("double") if count else F.lit(None).cast("double")).alias("c")]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ks, ps, vs = [], [], []
            for k, t, c in zip(b["k"], b["t"], b["c"]):
                if isinstance(t, str):
                    for i, v in enumerate(split_packed(t, None if c != c else c), 1):
                        ks.append(k)
                        ps.append(i)
                        vs.append(v)
            yield pd.DataFrame({"key": pd.Series(ks, dtype=b["k"].dtype), "pos": pd.Series(ps, dtype="int32"), "item_value": pd.Series(vs, dtype="object")})

    return df.where(F.col(packed).isNotNull()).select(*cols).mapInPandas(run, f"key {kind}, pos int, item_value string")
