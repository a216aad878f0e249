"""Sentence units in any script: candidate boundaries, decided by a maximum-entropy model.

Layout (empty lines, headings, greetings, signatures, list items, chat messages) cuts a text into blocks. In
a block every sentence mark is a candidate. Marks that can mean nothing else end a unit; full stops and
ellipses are decided by a logistic (maximum-entropy) model over the words around them, their case, length,
digits and script. The model is trained on the corpus itself: marks at the end of a block are sure
boundaries, marks before a small letter sure non-boundaries, and words that stand before hundreds of full
stops yet never at the end of a block are abbreviations.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import materialise

STAT_BUCKETS = 1 << 16  #: counters of words before a full stop; bounds what is sent to the driver
WEIGHTS = 1 << 15  #: hashed features of the model; bounds what is sent to the executors
TRAIN_ROWS = 40_000  #: most labelled candidates the model is fitted on
FEATURES = 12  #: features of a candidate
KNOWN = 1 << 16  #: words whose features a Python worker keeps at hand
LINE = 90  #: characters that a greeting or signature line, as matched below, cannot exceed

# Marks, closers and quotation marks of the scripts handled.
SURE = "!?。！？؟।॥｡"
DOTS = ".…．"
CLOSING = "\"'”’»)]}）」』】〉》›“"
PAIRS = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "‹": "›", "《": "》"}
ENCLOSING = re.compile("[" + re.escape("".join(sorted({*PAIRS, *PAIRS.values(), '"'}))) + "]")
CJK = re.compile(r"[　-〿぀-ヿ㐀-鿿豈-﫿＀-￯]")
THAI = re.compile(r"[฀-๿]")
THAI_BLANK = re.compile(r"(?<=[\u0e00-\u0e7f])[ \t]+(?=[\u0e00-\u0e7f])")
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")

LIST = re.compile(r"\s*(?:[-*•+–]|(\d{1,3})[.)]|\(?[a-zA-Z]\))\s+\S")
HEADING = re.compile(r"\s*#{1,6}\s+\S")
CHAT = re.compile(r"\s*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]|<[^<>\n]{1,40}>|\d{1,2}:\d{2}(?::\d{2})?\s+<?[\w.-]{1,30}>?:)\s*\S")
RULE = re.compile(r"\s*[-=_*~]{3,}\s*$")
# Words that open a greeting line or a signature line, by script: with blanks between words, and without.
GREETINGS = "hi|hello|hey|dear|hallo|liebe[rs]?|guten|bonjour|cher|chère|hola|estimad[oa]s?|buenos|здравствуйте|привет|γεια|αγαπητ[έή]|नमस्ते|प्रिय|مرحبا|عزيزي|السلام عليكم"
WIDE_GREETINGS = "你好|您好|大家好|各位|こんにちは|お疲れ様です|皆さん|สวัสดี|เรียน"
SIGNATURES = "(?:best|kind|warm)(?: regards| wishes)?|regards|cheers|thanks|thank you|sincerely|yours|mfg|viele grüße|mit freundlichen grüßen|gruß|cordialement|merci|saludos|atentamente|с уважением|спасибо|με εκτίμηση|ευχαριστώ|सादर|धन्यवाद|مع التحية|شكرا"
WIDE_SIGNATURES = "此致|谢谢|祝好|敬上|よろしくお願いします|敬具|ขอบคุณ|ด้วยความเคารพ"
GREETING = re.compile(rf"\s*(?:(?:{GREETINGS})\b|{WIDE_GREETINGS})[^.!?。！？\n]{{0,40}}[,!:，、！：،]\s*$", re.I)
SIGNATURE = re.compile(rf"\s*(?:--\s*$|(?:{SIGNATURES}|{WIDE_SIGNATURES})\s*(?:[,—–，、،-]|$)[^.!?。！？\n]{{0,40}}$)", re.I)
CANDIDATE = re.compile(r"(?:\.{2,}|…+|[.．]|[!?。！？؟।॥｡;;]+(?:[!?。！？])*)")
WORD = re.compile(r"\S+")
INNER = "\"'“”«»„()[]{}（）「」『』,;:‘’"


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the blocks of a text: ``whole`` blocks are one unit, ``prose`` may hold several."""
    out: list[tuple[int, int, str]] = []
    at, cur, number = 0, None, None  # cur: [start, end, kind]
    for line in text.split("\n"):
        start, end = at, at + len(line)
        at = end + 1
        if not line.strip():
            if cur:
                out.append(tuple(cur))
            cur, number = None, None
            continue
        head = line.lstrip()
        c = head[0]
        item = LIST.match(line) if c in "-*•+–(" or c.isdigit() or head[1:2] == ")" else None
        if item and item[1]:
            n = int(item[1])
            # a wrapped line may begin with a number; an item follows its predecessor, or starts the block
            if not (number is not None and n == number + 1 or cur is None or (number is None and n == 1 and cur[2] == "chat")):
                item = None
            else:
                number = n
        elif item and cur is not None and cur[2] == "prose":
            item = item if c in "-*•+" and looks_listed(text, start) else None
        if c == "#" and HEADING.match(line):
            kind = "whole"
        elif item:
            kind = "item"
        elif (c in "[<" or c.isdigit()) and CHAT.match(line):
            kind = "chat"
        else:
            kind = "line" if len(head.rstrip()) <= LINE and (RULE.match(line) or GREETING.match(line) or SIGNATURE.match(line)) else ""
        if kind or cur is None or cur[2] in ("whole", "line"):
            if cur:
                out.append(tuple(cur))
            cur = [start, end, kind or "prose"]
        else:
            cur[1] = end
    if cur:
        out.append(tuple(cur))
    return [(a, b, "whole" if k in ("whole", "item", "line") else "prose") for a, b, k in out]


def looks_listed(text: str, start: int) -> bool:
    """Whether the line before ``start`` reads as complete, so a dash here opens an item."""
    return text[:start].rstrip()[-1:] in ".:!?。：！？"


def enclosed(text: str) -> np.ndarray:
    """For each character: 0 outside, else the depth of quotation marks and brackets around it.

    A mark without its partner in the block opens nothing.
    """
    depth = np.zeros(len(text) + 1, dtype=np.int16)
    stack: list[tuple[str, int]] = []
    for m in ENCLOSING.finditer(text):
        i, c = m.start(), m[0]
        if stack and c == stack[-1][0]:
            if c == '"' and not (i + 1 >= len(text) or not text[i + 1].isalnum() or CJK.match(text[i + 1])):
                continue
            _, j = stack.pop()
            depth[j : i] += 1
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
        elif c == '"' and i + 1 < len(text) and not text[i + 1].isspace() and (i == 0 or not text[i - 1].isalnum()):
            stack.append(('"', i))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c and c != '"':  # partners crossed by an unclosed mark
                    depth[stack[k][1] : i] += 1
                    del stack[k:]
                    break
    return depth[: len(text)]


@lru_cache(KNOWN)
def shape(word: str) -> str:
    """What the statistics count a word as: itself in small letters, numbers by form and length."""
    if "://" in word or "@" in word:
        return "<url>"
    if re.fullmatch(r"\d+", word):
        return f"<{min(len(word), 4)}d>"
    if re.search(r"\d", word):
        return "<mix>"
    if re.search(r"\w[-_./]\w", word) and not re.fullmatch(r"(?:\w\.)+\w", word):
        return "<name>"
    return word.lower()


def bucket(key: str, size: int) -> int:
    return zlib.crc32(key.encode()) % size


def context(text: str, a: int, b: int) -> tuple[str, str, str]:
    """The word before the mark at [a, b), the word before that, and the word after it."""
    left = text[max(0, a - 60) : a].split()
    right = WORD.search(text, b)
    near = a > 0 and not text[a - 1].isspace()
    w1 = left[-1].strip(INNER) if left and near else ""
    w0 = left[-2].strip(INNER) if len(left) > 1 else ""
    return w1, w0, right[0][:40] if right else ""


CASES = ("none", "digit", "upper", "camel", "name", "lower", "other")


@lru_cache(KNOWN)
def opening_case(word: str) -> str:
    """Case class of the first letter of the next word."""
    w = word.lstrip("\"'“«„‚‘([{¿¡—–- ")
    if not w:
        return "none"
    c = w[0]
    if c.isdigit():
        return "digit"
    if c.isupper():
        return "upper"
    if c.islower():
        return "camel" if any(x.isupper() for x in w[1:]) else "name" if re.search(r"\w[-_.]\w", w.rstrip(".,;:")) else "lower"
    return "other"


def script(c: str) -> str:
    o = ord(c) if c else 0
    return "l" if o < 0x250 else "g" if o < 0x400 else "c" if o < 0x530 else "a" if 0x600 <= o < 0x700 else "d" if 0x900 <= o < 0x980 else "x"


@lru_cache(KNOWN)
def word_features(w1: str, case: str, kind: str) -> tuple[list[int], str]:
    """Buckets of the features of the word before a mark with the case behind it, and what pairs of words count it as."""
    s1, size = shape(w1), min(len(w1), 6)
    single = len(w1) == 1 and w1.isalpha()
    dotted = "." in w1 and not any(c.isdigit() for c in w1) and len(w1) < 7
    f = [
        "1", f"w={s1}", f"c={case}", f"w={s1}|c={case}", f"len={size}", f"one={single}", f"dot={dotted}|{case}", f"cap={w1[:1].isupper()}|{size}",
        f"mark={kind}|{case}", f"scr={script(w1[-1:])}|{case}|{single}",
    ]
    return [bucket(x, WEIGHTS) for x in f], s1 if s1[:1] == "<" else str(size)


@lru_cache(KNOWN)
def pair_feature(w0: str, w1: str) -> int:
    return bucket(f"0={shape(w0)}|{w1}", WEIGHTS)


@lru_cache(KNOWN)
def next_feature(nxt: str) -> int:
    return bucket("n=" + nxt.strip(INNER + ".").lower(), WEIGHTS)


def features(w1: str, w0: str, nxt: str, mark: str) -> list[int]:
    """Buckets of the ``FEATURES`` features of a mark: those of the word before it, of the two words before it and of the word behind it.

    ``BEHIND`` are the places of those that tell what follows, and nothing else.
    """
    f, s = word_features(w1, opening_case(nxt), "e" if mark[0] == "…" or len(mark) > 1 else "p")
    return [*f, pair_feature(w0, s), next_feature(nxt)]


BEHIND = (2, 11)


def candidates(block: str) -> Iterator[tuple[int, int, int, str]]:
    """(mark start, cut, sure, mark) of every candidate of a block of prose outside quotes.

    ``cut`` is the end with closing quotes and brackets; ``sure`` is 1 for marks that always end a unit,
    0 for those the model decides.
    """
    depth = None
    for m in CANDIDATE.finditer(block):
        if depth is None:
            depth = enclosed(block)
        a, b = m.span()
        mark = m[0]
        if mark[0] in ";;" and not (GREEK.search(block[max(0, a - 2) : a])):
            continue
        cut = b
        while cut < len(block) and block[cut] in CLOSING and depth[cut - 1] >= 1 and (block[cut] != "“" or depth[cut] < depth[cut - 1]):
            cut += 1
        closed = block[b:cut]
        if cut < len(block) and depth[cut] and depth[cut - 1] and not (depth[cut] == 1 and opens_at(block, cut)):
            continue  # still inside
        if depth[a] and cut == b:
            continue
        after = block[cut : cut + 1]
        wide = bool(CJK.match(mark[-1])) or (mark[0] in "…" and bool(CJK.match(block[a - 1 : a])))
        if after and not after.isspace():
            if not wide and not (CJK.match(block[a - 1 : a]) and mark[0] in "…!?"):
                continue
            if after in "。！？、，,.…」』”）)":
                continue
        quoted = any(c not in ")]）】}" for c in closed)
        if quoted and wide and after and not after.isspace():
            continue  # the sentence goes on behind the speech
        if quoted and opening_case(block[cut : cut + 40].lstrip().split(" ")[0] if block[cut:].strip() else "") == "lower":
            continue
        sure = 1 if mark[0] in SURE or mark[0] in ";;" or wide else 0
        yield a, cut, sure, mark


def opens_at(block: str, i: int) -> bool:
    return block[i] in PAIRS or block[i] == '"'


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The stretch [a, b) without blanks at its ends."""
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def scan_text(text: str) -> tuple[int, list[int], list[int], list[int], list[int], list[int], list[int]]:
    """(first, ends, nexts, decided, words, cases, ids): all that one reading of a text yields, so that no text is read twice.

    ``first`` is where the first unit starts. Every place where a unit may end is an event, in order: ``ends`` is the end of the unit
    before it, ``nexts`` the start of the one behind, ``decided`` whether it always ends a unit. Every full stop or ellipsis
    that the model decides or learns from has a bucket of the word before it (``words``), the case of what follows (``cases``, -1 at the
    end of a block, which is an event of the block) and ``FEATURES`` feature buckets (``ids``); those with a case are, in order,
    the events that are not decided.
    """
    ends, nexts, decided, words, cases, ids = [], [], [], [], [], []
    spans = [(lo, hi, kind, *trimmed(text, lo, hi)) for lo, hi, kind in blocks(text)]
    for n, (lo, hi, kind, s, e) in enumerate(spans):
        cuts: dict[int, tuple | None] = {}  # None: always ends a unit
        block = text[lo:hi]
        if kind == "prose":
            for a, cut, sure, mark in candidates(block):
                last = lo + cut >= e
                if sure:
                    if not last:
                        cuts[cut] = None
                elif cut not in cuts:
                    w1, w0, nxt = context(block, a, cut)
                    cuts[cut] = bucket(shape(w1), STAT_BUCKETS), -1 if last else CASES.index(opening_case(nxt)), features(w1, w0, nxt, mark)
            if THAI.search(block):
                cuts.update((m.start(), None) for m in THAI_BLANK.finditer(block))
        for cut in sorted(cuts):
            if cuts[cut]:
                w, case, f = cuts[cut]
                words.append(w)
                cases.append(case)
                ids += f
                if case < 0:
                    continue
            ends.append(trimmed(text, s, lo + cut)[1])
            nexts.append(trimmed(text, lo + cut, e)[0])
            decided.append(int(cuts[cut] is None))
        ends.append(e)
        nexts.append(spans[n + 1][3] if n + 1 < len(spans) else e)
        decided.append(1)
    return spans[0][3] if spans else 0, ends, nexts, decided, words, cases, ids


SCANNED = {"ends": np.int32, "nexts": np.int32, "decided": np.uint8, "words": np.uint16, "cases": np.int8, "ids": np.uint16}


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, first, and the lists of :func:`scan_text` as bytes) of every document with a unit."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"]):
                first, *lists = scan_text(t)
                if lists[0]:
                    rows.append((k, first, *(np.array(x, dtype=d).tobytes() for x, d in zip(lists, SCANNED.values()))))
            yield pd.DataFrame(rows, columns=["k", "first", *SCANNED])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return rows.mapInPandas(run, f"k {kind}, first int, " + ", ".join(f"{c} binary" for c in SCANNED))


def flat(batch: pd.DataFrame, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch[column]), dtype=SCANNED[column])


def word_statistics(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket of words: full stops behind them, and how many of these end a block. Over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, k = np.zeros(STAT_BUCKETS, dtype=np.int64), np.zeros(STAT_BUCKETS, dtype=np.int64)
        for batch in batches:
            w = flat(batch, "words")
            n += np.bincount(w, minlength=STAT_BUCKETS)
            k += np.bincount(w[flat(batch, "cases") < 0], minlength=STAT_BUCKETS)
        i = np.flatnonzero(n)
        yield pd.DataFrame({"i": i, "n": n[i], "k": k[i]})

    got = scanned.select("words", "cases").mapInPandas(run, "i long, n long, k long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = np.zeros(STAT_BUCKETS), np.zeros(STAT_BUCKETS)
    for r in got.toPandas().itertuples(index=False):  # at most STAT_BUCKETS rows
        n[r.i], k[r.i] = r.n, r.k
    return n, k


def labels(cases: np.ndarray, n: np.ndarray, k: np.ndarray, rate: float) -> np.ndarray:
    """1 boundary, 0 none, -1 unknown, of candidates with what follows them and the statistics of their words."""
    y = np.full(len(cases), -1)
    y[(k >= 2) & (k > 0.5 * n * rate)] = 1
    y[(n * rate >= 6) & (k < 0.25 * n * rate)] = 0
    y[cases == CASES.index("lower")] = 0
    y[cases < 0] = 1
    return y


def train(scanned: DataFrame, rounds: int = 150, l2: float = 1e-5) -> np.ndarray:
    """Weights of the model, fitted on at most ``TRAIN_ROWS`` candidates that label themselves.

    The statistics that label them cover all documents; the sample takes the candidates whose hash of document
    and place is least. Without labelled candidates all weights are zero, and every candidate is a boundary.
    """
    n, k = word_statistics(scanned)
    rate = k.sum() / max(1.0, n.sum())
    share = min(1.0, 1.2 * TRAIN_ROWS / max(1.0, n.sum()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w, cases = flat(batch, "words"), flat(batch, "cases")
            size = batch["cases"].map(len).to_numpy()
            start = np.repeat(np.array([zlib.crc32(str(d).encode()) for d in batch["k"]], dtype=np.uint64), size)
            place = (np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
            h = ((start * np.uint64(0x9E3779B97F4A7C15)) ^ ((place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)
            y = labels(cases, n[w], k[w], rate)
            take = np.flatnonzero((h < np.uint64(int(share * (1 << 48)))) & (y >= 0))
            x = flat(batch, "ids").reshape(-1, FEATURES)[take]
            yield pd.DataFrame({"h": h[take].astype(np.int64), "y": y[take].astype(np.int32), "end": cases[take] < 0, "x": [r.tobytes() for r in x]})

    drawn = scanned.select("k", "words", "cases", "ids").mapInPandas(run, "h long, y int, end boolean, x binary")
    sample = drawn.orderBy("h").limit(TRAIN_ROWS).toPandas()
    if sample.empty:
        return np.zeros(WEIGHTS)
    x = np.frombuffer(b"".join(sample["x"]), dtype=np.uint16).reshape(-1, FEATURES).astype(np.int64)
    for c in BEHIND:  # what follows tells nothing where a block ends
        x[sample["end"].to_numpy(), c] = WEIGHTS
    y, w, g2 = sample["y"].to_numpy(float), np.zeros(WEIGHTS + 1), np.full(WEIGHTS + 1, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat(p - y, FEATURES), WEIGHTS + 1) / len(y) + l2 * w
        g[WEIGHTS] = 0
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    return w[:WEIGHTS]


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos): every unit of every document, in code points, blanks left out.

    Null, empty and blank texts have no unit. Texts are read whole, whatever their length, and once: what the model learns from and
    decides is kept as a table of numbers. A repeated document gives the same units under each of its keys. No
    shuffle beyond the bounded word counts and the sample.
    """
    scanned = materialise(scan(docs, key, text), "scanned")
    w = train(scanned)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends, nexts, taken, cases = flat(batch, "ends"), flat(batch, "nexts"), flat(batch, "decided") == 1, flat(batch, "cases")
            taken[~taken] = w[flat(batch, "ids").reshape(-1, FEATURES)[cases >= 0]].sum(1) >= 0
            at = np.flatnonzero(taken)
            doc = np.repeat(np.arange(len(batch)), batch["decided"].map(len))[at]
            start = np.concatenate([[0], nexts[at[:-1]]]) if len(at) else nexts[at]
            fresh = np.flatnonzero(np.diff(doc, prepend=-1))
            start[fresh] = batch["first"].to_numpy()[doc[fresh]]
            ok = start < ends[at]
            yield pd.DataFrame({"k": batch["k"].to_numpy()[doc[ok]], "s": start[ok].astype(np.int32), "e": ends[at][ok]})

    out = scanned.drop("words").mapInPandas(run, f"k {kind}, s int, e int")
    return out.select(F.col("k").alias("doc_id"), F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))
