"""Text decoded with the wrong encoding: found by character n-gram models and given back as it was."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIGRAMS, BIGRAMS, UNIGRAMS = 1 << 19, 1 << 17, 1 << 16  #: hashed counters; bound what driver and executors hold
VALIDATION_ROWS = 4_000  #: rows of `validated_margin`, which no query uses
LOST = "�"

# Encodings a UTF-8 text is mistaken for, and pairs of an encoding and the right one of another script it is mistaken for.
VIA_UTF8 = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "koi8_r", "cp866")
VIA_WIDE = ("gbk", "big5", "shift_jis")
SWAPPED = (("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp1253"), ("cp1252", "gbk"), ("cp1252", "big5"), ("cp1252", "shift_jis"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"))
WIDE = set(VIA_WIDE)  # of more than one byte
CHAINS = [f"{e}<utf-8" for e in (*VIA_UTF8, *VIA_WIDE)] + [f"{e}<{right}" for e, right in SWAPPED]
DEPTH = 2  #: most wrong decodings on top of each other
UNSEEN = 8.0  #: log-likelihood that an origin loses for each character clean text does not hold
LEAST_WORD = 4  #: letters in a row that a wrong script must have garbled, for less is no evidence
LEAST_SAMPLES = 30  #: garbled lines a chain needs for a margin of its own

_WORD = re.compile(r"[^\W\d_]+")


def byte_table(encoding: str) -> str:
    """The characters of all bytes; bytes the encoding leaves undefined stand for their control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


TABLES = {e: byte_table(e) for e in sorted({*VIA_UTF8, *(x for p in SWAPPED for x in p)} - WIDE)}
CODES = {e: codecs.charmap_build(t) for e, t in TABLES.items()}


def as_bytes(text: str, encoding: str) -> bytes | None:
    try:
        if encoding in WIDE:
            return text.encode(encoding)
        return codecs.charmap_encode(text, "strict", CODES[encoding])[0]
    except UnicodeEncodeError:
        return None


def from_bytes(raw: bytes, encoding: str) -> str | None:
    if encoding in WIDE:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            return None
    return codecs.charmap_decode(raw, "strict", TABLES[encoding])[0]


def whole_words(text: str) -> bool:
    """Whether the words with other than ASCII letters hold nothing else, as words of another script do, and one is long enough to tell."""
    odd = [w for w in _WORD.findall(text) if not w.isascii()]
    return any(len(w) >= LEAST_WORD for w in odd) and not any(c.isascii() for w in odd for c in w)


def step_back(text: str, swapped: bool = True) -> dict[str, str]:
    """What one wrong decoding may have made of which text: {chain: text before}, without the text itself."""
    out: dict[str, str] = {}
    for e in (*VIA_UTF8, *VIA_WIDE):
        raw = as_bytes(text, e)
        if raw is not None:
            try:
                before = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if before != text:
                out[f"{e}<utf-8"] = before
    if swapped and not out:  # text that reads as UTF-8 is no other encoding by chance
        for e, right in SWAPPED:
            if not (sum(not c.isascii() for c in text) >= LEAST_WORD if right in WIDE else whole_words(text)):
                continue
            raw = as_bytes(text, e)
            if raw is not None and (before := from_bytes(raw, right)) not in (None, text):
                out[f"{e}<{right}"] = before
    return out


def origins(text: str) -> dict[str, str]:
    """Every text that up to ``DEPTH`` wrong decodings may have garbled into this one, by chain."""
    out, level = {}, {"": text}
    for depth in range(DEPTH):
        deeper: dict[str, str] = {}
        for chain, t in level.items():
            for name, before in step_back(t, swapped=depth == 0).items():
                if before not in out.values() and before != text:
                    deeper[f"{chain} {name}".strip()] = before
        out |= deeper
        level = {k: v for k, v in deeper.items() if not v.isascii()}
    return out


def surely_clean(line: str) -> bool:
    """No wrong decoding through UTF-8 can have made the line, and no word consists of accented letters."""
    if line.isascii():
        return True
    if LOST in line or step_back(line, swapped=False):
        return False
    for w in _WORD.findall(line):
        if len(w) >= 3 and sum("\xc0" <= c <= "\xff" for c in w) > 0.6 * len(w):
            return False
    return True


def grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed uni-, bi- and trigram indices of all characters, and the contexts' indices."""
    text = "\x02\x02" + "\x02\x02".join(x.lower() for x in lines)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    a, b, z = c[:-2], c[1:-1], c[2:]
    live = z != 2
    a, b, z = a[live], b[live], z[live]
    mix = lambda x, size: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(size)
    return (
        mix(z, UNIGRAMS).astype(np.int64), mix(b, UNIGRAMS).astype(np.int64), mix(b * np.uint64(1 << 21) + z, BIGRAMS).astype(np.int64),
        mix(a * np.uint64(1 << 21) + b + np.uint64(1), BIGRAMS).astype(np.int64), mix((a * np.uint64(1 << 21) + b) * np.uint64(1 << 21) + z, TRIGRAMS).astype(np.int64),
    )


def code_of(c: int, size: int) -> int:
    return (((c * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 40) % size


class CharacterModel:
    """Interpolated character trigram model over hashed counts of clean text."""

    def __init__(self, uni: np.ndarray, bi: np.ndarray, context: np.ndarray, tri: np.ndarray):
        self.uni, self.bi, self.context, self.tri = (x.astype(np.float32) for x in (uni, bi, context, tri))
        self.total = max(1.0, float(uni.sum()))

    def unseen(self, text: str) -> int:
        """How many different characters of a text clean text does not hold."""
        return sum(not self.uni[code_of(ord(c), UNIGRAMS)] for c in set(text.lower()) if not c.isascii())

    def score(self, text: str) -> float:
        """Log-likelihood of a line."""
        if not text:
            return 0.0
        z, b, bz, ab, abz = grams([text])
        p1 = (self.uni[z] + 0.05) / (self.total + 0.05 * UNIGRAMS)
        p2 = (self.bi[bz] + 4 * p1) / (self.uni[b] + 4)
        p3 = (self.tri[abz] + 4 * p2) / (np.maximum(self.context[ab], self.tri[abz]) + 4)
        return float(np.log(np.minimum(p3, 1.0)).sum())


def fit(df: DataFrame, fields: list[str]) -> CharacterModel:
    """Counts over the clean lines of all rows; each task adds up its own, the sums have a fixed size."""
    sizes = (UNIGRAMS, BIGRAMS, BIGRAMS, TRIGRAMS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = [np.zeros(s, dtype=np.int64) for s in sizes]
        for batch in batches:
            lines = [x for f in fields for v in batch[f].dropna() for x in v.split("\n") if x and surely_clean(x)]
            if lines:
                z, _, bz, ab, abz = grams(lines)
                for k, i in enumerate((z, bz, ab, abz)):
                    n[k] += np.bincount(i, minlength=sizes[k])
        for k, x in enumerate(n):
            i = np.flatnonzero(x)
            yield pd.DataFrame({"k": np.full(len(i), k, dtype=np.int32), "i": i, "n": x[i]})

    got = df.select(*fields).mapInPandas(run, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toPandas()
    n = [np.zeros(s) for s in sizes]
    for k in range(4):
        part = got[got["k"] == k]
        n[k][part["i"].to_numpy()] = part["n"].to_numpy()
    return CharacterModel(*n)


def best_origin(line: str, model: CharacterModel) -> tuple[float, str, str]:
    """(gain in log-likelihood over the line as it is, likeliest origin, its last chain); without origins (-inf, '', '').

    An origin loses ``UNSEEN`` for each character that clean text does not hold, since one odd character is likelier a typing error."""
    here, best = None, (-np.inf, "", "")
    for chain, before in origins(line).items():
        here = model.score(line) if here is None else here
        gain = model.score(before) - UNSEEN * model.unseen(before) - here
        if gain > best[0]:
            best = (gain, before, chain.split(" ")[0])
    return best


def garble(line: str, chain: str) -> str | None:
    """A clean line wrongly decoded on purpose, or None where the chain changes nothing or cannot hold the line."""
    wrong, right = chain.split("<")
    raw = line.encode("utf-8", "surrogatepass") if right == "utf-8" else as_bytes(line, right)
    out = from_bytes(raw, wrong) if raw is not None else None
    if out is None or out == line or (right != "utf-8" and not any(ord(c) > 0x37F for c in line)):
        return None
    return out


MARKS = np.linspace(0.5, 12, 47)  #: margins that are tried


def parted(clean: np.ndarray, garbled: np.ndarray) -> float:
    """The mark that leaves the fewest clean lines above it and the fewest garbled ones below, in the middle of the equally good ones.

    The lines are counted by how many marks their gain is above."""
    errors = clean[1:][::-1].cumsum()[::-1] + garbled[:-1].cumsum()
    best = np.flatnonzero(errors == errors.min())
    return float(MARKS[best[len(best) // 2]])


def parting(clean: list[float], garbled: list[float]) -> float:
    """The mark that parts two lists of gains, see :func:`parted`."""
    count = lambda gains: np.bincount(np.searchsorted(MARKS, gains, "left"), minlength=len(MARKS) + 1)
    return parted(count(np.array(clean, dtype=float)), count(np.array(garbled, dtype=float)))


def gains(line: str, model: CharacterModel) -> Iterator[tuple[int, str, float]]:
    """(0, chain, gain) of a clean line as it is, where it has an origin, and (1, chain, gain) of it garbled on purpose along the first chain, counted from one its hash names, that can hold it."""
    g, _, chain = best_origin(line, model)
    if chain:
        yield 0, chain, g
    first = zlib.crc32(line.encode("utf-8", "surrogatepass"))
    for k in range(len(CHAINS)):
        bad = garble(line, at := CHAINS[(first + k) % len(CHAINS)])
        if bad and not surely_clean(bad):
            g, back, _ = best_origin(bad, model)
            yield 1, at, g if back == line else -np.inf
            return


def margins(df: DataFrame, fields: list[str], model: CharacterModel) -> dict[str, float]:
    """For every chain the gain that parts clean lines from lines garbled on purpose with the fewest mistakes, over all different clean lines of all rows.

    What reaches the driver are counts by chain and mark. A chain with fewer than ``LEAST_SAMPLES`` garbled lines takes the strictest margin of the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, len(CHAINS), len(MARKS) + 1), dtype=np.int64)
        number = {c: i for i, c in enumerate(CHAINS)}
        for batch in batches:
            for x in batch["x"]:
                if surely_clean(x):
                    for kind, chain, g in gains(x, model):
                        n[kind, number[chain], np.searchsorted(MARKS, g, "left")] += 1
        i = np.flatnonzero(n)
        yield pd.DataFrame({"i": i, "n": n.ravel()[i]})

    lines = df.select(F.explode(F.split(F.concat_ws("\n", *fields), "\n", -1)).alias("x")).where(F.col("x").rlike(r"[^\x00-\x7F]")).distinct()
    got = lines.repartition(4 * df.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((2, len(CHAINS), len(MARKS) + 1), dtype=np.int64)
    n.ravel()[got["i"].to_numpy()] = got["n"].to_numpy()
    clean, garbled = n
    out = {c: parted(clean[k], garbled[k]) for k, c in enumerate(CHAINS) if garbled[k].sum() >= LEAST_SAMPLES}
    strict = max([parted(clean.sum(axis=0), garbled.sum(axis=0)), *out.values()])
    return {c: out.get(c, strict) for c in CHAINS}


def validated_margin(df: DataFrame, fields: list[str], model: CharacterModel) -> dict[str, float]:
    """:func:`margins` from about ``VALIDATION_ROWS`` of the rows with other than ASCII characters, drawn by a hash over the whole table. No query uses it."""
    text = F.concat_ws("\n", *fields)
    odd = df.select(text.alias("t"), F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)).alias("h")).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    share = VALIDATION_ROWS / max(odd.count(), 1)
    lines = sorted({x for r in odd.where(F.col("h") < int(min(1.0, share) * (1 << 30))).collect() for x in r["t"].split("\n") if not x.isascii() and surely_clean(x)})
    clean: dict[str, list[float]] = {}
    garbled: dict[str, list[float]] = {}
    for x in lines:
        for kind, chain, g in gains(x, model):
            (garbled if kind else clean).setdefault(chain, []).append(g)
    all_of = lambda d: [g for v in d.values() for g in v]
    out = {c: parting(clean.get(c, []), garbled[c]) for c in garbled if len(garbled[c]) >= LEAST_SAMPLES}
    strict = max([parting(all_of(clean), all_of(garbled)), *out.values()])
    return {c: out.get(c, strict) for c in CHAINS}


_CITED = re.compile(rf"(?:[\"'`]|[(\[<{{]){LOST}+(?:[\"'`]|[)\]>}}])")


def lost(line: str) -> bool:
    """Whether replacement characters of a line stand for lost ones; not where they are cited.

    They are cited where each stands between quotes or brackets, or where other than ASCII characters beside them came through
    unharmed, which the decoding that lost some would have lost too.
    """
    if LOST not in line:
        return False
    rest = line.replace(LOST, "")
    if not rest.isascii() and surely_clean(rest):
        return False
    return LOST in _CITED.sub("", line)


def repair(value: str, model: CharacterModel, margin: dict[str, float]) -> str | None:
    """The right value, '' where characters are lost for good, None where nothing is wrong."""
    out, changed = [], False
    for line in value.split("\n"):
        if not line.isascii():
            if lost(line):
                return ""
            gain, before, chain = best_origin(line, model)
            if chain and gain > margin[chain]:
                line, changed = before, True
        out.append(line)
    return "\n".join(out) if changed else None


def restore(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, restored): one row per garbled value of the fields.

    The unit is the line, so a value may be garbled in part. Values with replacement characters that are not cited are
    lost and give ''. Null, empty and plain ASCII values cannot be garbled and give no row. The scan is one
    pass without a shuffle; equal values of a batch are judged once.
    """
    model = fit(df, fields)
    margin = margins(df, fields, model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str | None] = {}
        for batch in batches:
            ks, fs, rs = [], [], []
            for f in fields:
                for k, v in zip(batch["key"], batch[f]):
                    if isinstance(v, str) and not v.isascii():
                        if v not in known:
                            if len(known) > 50_000:
                                known.clear()
                            known[v] = repair(v, model, margin)
                        if known[v] is not None:
                            ks.append(k)
                            fs.append(f)
                            rs.append(known[v])
            yield pd.DataFrame({"key": pd.Series(ks, dtype=batch["key"].dtype), "field_name": pd.Series(fs, dtype="object"), "restored": pd.Series(rs, dtype="object")})

    odd = [F.when(F.col(f).rlike(r"[^\x00-\x7F]"), F.col(f)).alias(f) for f in fields]
    rows = df.select(F.col(key).alias("key"), *odd).where(F.coalesce(*fields).isNotNull())
    return rows.mapInPandas(run, f"key {kind}, field_name string, restored string").withColumnRenamed("key", key)
