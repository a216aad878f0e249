"""Author pairs compared inside their blocks: texts are coded once an author, not once a pair, and no pair is joined or shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.similarity import local_part, name_parts, winkler

CELL_PART = 1000  #: authors of a block dealt to one part; every two parts of a larger block meet in a cell of their own
CHUNK = 16_384  #: pairs compared at a time, so that their columns stay in a core's cache
BITS = 64  #: letters a text may have to be compared as bits; longer ones are compared letter by letter
CELL = ["project", "t", "i", "j"]


def block_cells(authors: DataFrame, project: str, key: str, name: str, email: str, **more: Column) -> DataFrame:
    """The authors of every cell of every block, cell after cell: project, t, i, j, b, k, fn, ln, un and the columns ``more``.

    A block holds the authors of a project that share a token (first or last of the name, local part). Larger ones than ``CELL_PART`` are
    dealt into parts b, and each two parts i <= j are a cell, so a cell has a bounded number of authors. Blocks of one author are left out.
    """
    p, blank = name_parts(F.col(name)), F.lit("")
    a = authors.select(
        F.col(project).alias("project"), F.col(key).alias("k"), *[F.coalesce(c, blank).alias(x) for x, c in (("fn", p["fn"]), ("ln", p["ln"]), ("un", local_part(F.col(email))))], *[c.alias(x) for x, c in more.items()]
    )
    tokens = F.array_distinct(F.filter(F.array("fn", "ln", "un"), lambda t: t != ""))
    held = a.select("project", F.explode(tokens).alias("t")).groupBy("project", "t").agg(F.count("*").alias("c"))
    parts = held.where("c > 1").select("project", "t", F.ceil(F.col("c") / CELL_PART).cast("int").alias("parts"))
    b = a.withColumn("t", F.explode(tokens)).join(parts, ["project", "t"])
    b = b.withColumns({"b": F.pmod(F.hash("k"), "parts"), "o": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    b = b.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("parts", "o")
    sc = authors.sparkSession.sparkContext
    n = max(int(authors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sc.defaultParallelism)  # named, since small cells hold much work
    return b.repartition(n, *CELL).sortWithinPartitions(*CELL)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole cells with the end of each row's cell; a cell that a batch leaves open waits for the next one."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        start = cell_starts(rest)
        if len(start) > 1:
            yield ended(rest.slice(0, start[-1]), start[:-1])
            rest = rest.slice(start[-1])
    if rest is not None:
        yield ended(rest, cell_starts(rest))


def cell_starts(t: pa.Table) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for c in CELL:
        x = t[c].to_numpy() if c in ("i", "j") else pd.factorize(t[c].to_pandas())[0]
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def ended(t: pa.Table, start: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    size = np.diff(np.append(start, t.num_rows))
    cell = np.repeat(np.arange(len(start)), size)
    order = np.lexsort((t["k"].to_numpy(), cell))
    return t.take(pa.array(order)).combine_chunks(), np.repeat(start + size, size)


def coded(*columns: list[str]) -> list[np.ndarray]:
    """The columns with one number for each text, the same in all of them, 0 for ''."""
    codes = pd.factorize(np.concatenate([np.array([""], dtype=object), *columns]))[0]
    return np.split(codes[1:], np.cumsum([len(c) for c in columns])[:-1])


def partners(end: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row from ``lo`` to ``hi`` with each later row of its cell, in order."""
    n = end[lo:hi] - np.arange(lo, hi) - 1
    x = np.repeat(np.arange(lo, hi), n)
    return x, np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + x + 1


class Firsts:
    """Which pairs of a table of cells count: those of two different parts of a cell of two, in the first block that they share."""

    def __init__(self, t: pa.Table):
        self.fn, self.ln, self.un, token = coded(*[t[c].to_pandas().to_numpy() for c in ("fn", "ln", "un", "t")])
        self.after_fn, self.after_ln = (token != self.fn) & (self.fn > 0), (token != self.fn) & (token != self.ln) & (self.ln > 0)
        self.b, self.one = t["b"].to_numpy(), t["i"].to_numpy() == t["j"].to_numpy()

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        has = lambda c: (c == self.fn[y]) | (c == self.ln[y]) | (c == self.un[y])
        met = self.after_fn[x] & has(self.fn[x]) | self.after_ln[x] & has(self.ln[x])
        return ~met & (self.one[x] | (self.b[x] != self.b[y]))


def upto(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items that weigh at most ``most`` together, or are one item."""
    total, lo = np.cumsum(weight), 0
    while lo < len(weight):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class Winkler:
    """Jaro-Winkler similarities, as :func:`similarity.winkler`, of many pairs from a column a and a column b at a time.

    The places of each letter in a text b are the bits of a number, so one step takes the next letter of all texts a at once.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        texts = np.concatenate([a, b])
        codes, self.texts = pd.factorize(texts)
        self.a, self.b, n = codes[: len(a)], codes[len(a) :], len(self.texts)
        self.size = np.fromiter(map(len, self.texts), dtype=np.int64, count=n)
        longest = int(self.size.max(initial=0))
        self.bits = 32 if longest <= 32 else BITS
        letters = np.array(self.texts, dtype=f"U{BITS}").view(np.uint32).reshape(n, BITS)
        inside = np.arange(BITS) < self.size[:, None]
        known, at = np.unique(letters[inside], return_inverse=True)
        self.letter, self.width = np.zeros((n, BITS), dtype=np.int64), len(known) + 1
        self.letter[inside] = at + 1
        held = np.unique(self.b)
        self.row = np.full(n, -1)
        self.row[held] = np.arange(len(held))
        kind = np.uint32 if self.bits == 32 else np.uint64
        places = np.zeros((len(held), self.width), dtype=kind)
        for j in range(min(BITS, longest)):
            k = held[self.size[held] > j]
            places[self.row[k], self.letter[k, j]] |= kind(1 << j)
        self.places = places.ravel()

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.a[x], self.b[y]
        out = (a == b).astype(np.float64)
        todo = np.flatnonzero((a != b) & (self.size[a] > 0) & (self.size[b] > 0))
        if len(todo):
            a, b = a[todo], b[todo]
            n = len(self.texts)
            least = int(a.min()), int(b.min())
            span = int(b.max()) - least[1] + 1
            cells = (int(a.max()) - least[0] + 1) * span
            if cells <= 4 * len(a):  # few texts in many pairs: each two once
                key = (a - least[0]) * span + b - least[1]
                some = np.zeros(cells, dtype=bool)
                some[key] = True
                k = np.flatnonzero(some)
                got = np.zeros(cells)
                got[k] = self.compare(k // span + least[0], k % span + least[1])
                out[todo] = got[key]
            else:
                out[todo] = self.compare(a, b)
        return out

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of texts, by number, that differ and are not empty."""
        long = (self.size[a] > BITS) | (self.size[b] > BITS)
        if not long.any():
            return self.as_bits(a, b)
        out, k = np.empty(len(a)), np.flatnonzero(~long)
        if len(k):
            out[k] = self.as_bits(a[k], b[k])
        for i in np.flatnonzero(long):
            out[i] = winkler(self.texts[a[i]], self.texts[b[i]])
        return out

    def as_bits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        kind = self.places.dtype.type
        one, every = kind(1), kind(np.iinfo(kind).max)
        differ = np.ascontiguousarray(self.letter[a, :8] != self.letter[b, :8]).view(np.uint64).ravel()
        start = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3  # equal letters at the start, of eight
        order = np.argsort((start - self.size[a]).astype(np.int8), kind="stable")  # texts that have ended are at the end
        a, b, start = a[order], b[order], start[order]
        la, lb = self.size[a], self.size[b]
        left = la - start
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        behind = (one << start.astype(kind)) - one
        used = behind.copy()  # equal letters at the start find each other
        low, high = np.maximum(start - reach, 0), np.minimum(start + reach + 1, self.bits)
        masks = np.array([(1 << k) - 1 for k in range(self.bits + 1)], dtype=kind)
        window = masks[high] & ~masks[low]
        grows = reach - start
        letter, place, flat, n = a * BITS + start, self.row[b] * self.width, self.letter.ravel(), len(a)
        places, hits = [], []
        for i in range(int(left[0])):
            n = int(np.searchsorted(-left[:n], -i, "left"))
            p = self.places.take(flat.take(letter[:n] + i) + place[:n])
            w = p & window[:n]
            w &= ~used[:n]
            w &= ~w + one
            used[:n] |= w
            places.append(p)
            hits.append(w != 0)
            window = (window[:n] << one) | (grows[:n] > i)
        m = np.bitwise_count(used).astype(np.float64)
        moved, rest = np.zeros(len(a), dtype=np.int8), used ^ behind
        for p, hit in zip(places, hits):  # the letters found in b, in its order, against those of a
            n = len(p)
            r = rest[:n]
            w = r & (~r + one)
            moved[:n] += ((p & w) == 0) & hit
            r ^= w & np.where(hit, every, kind(0))
        with np.errstate(invalid="ignore", divide="ignore"):
            base = (m / la + m / lb + (m - moved // 2) / m) / 3
        base[m == 0] = 0.0
        out = np.empty(len(a))
        out[order] = base + np.minimum(start, 4) * 0.1 * (1 - base)
        return out


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    if digits is None:
        return x
    v = x * 10.0**digits
    whole = np.floor(v)
    return (whole + (v - whole >= 0.5)) / 10.0**digits


FEATURES = ("n", "e", "ln", "fn", "un", "ifn", "ln1", "fn1")


def pair_features(authors: DataFrame, project: str, key: str, name: str, email: str, digits: int | None = None) -> DataFrame:
    """(project, k1, k2) of the pairs of :func:`similarity.blocked_author_pairs` with n, e, ln, fn, un, ifn, ln1, fn1: Jaro-Winkler of names, addresses and their parts.

    Two absent addresses are unlike. ifn is the better of first against last name either way, ln1 and fn1 compare the parts split into words.
    ``digits`` rounds.
    """
    kind, area = (authors.schema[c].dataType.simpleString() for c in (key, project))
    p = name_parts(F.col(name))
    words = lambda c: F.array_join(F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != ""), " ")
    more = {"nn": p["n"], "ee": F.lower(F.trim(email)), "fw": words(p["fn"]), "lw": words(p["ln"])}
    cells = block_cells(authors, project, key, name, email, **{c: F.coalesce(v, F.lit("")) for c, v in more.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, end in whole_cells(batches):
            text = {c: t[c].to_pandas().to_numpy() for c in ("nn", "ee", "fn", "ln", "un", "fw", "lw")}
            first = Firsts(t)
            n = end - np.arange(len(end)) - 1
            for lo, hi in upto(n, CHUNK):
                x, y = partners(end, lo, hi)
                keep = first(x, y)
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                top = int(end[hi - 1])
                like = lambda a, b: Winkler(text[a][lo:hi], text[b][lo:top])(x - lo, y - lo)  # noqa: B023, E731
                whole = lambda a, b, known: like(a, a) if (text[a][lo:top] != text[b][lo:top]).any() else known  # noqa: B023, E731
                e = like("ee", "ee")
                e[(text["ee"][x] == "") | (text["ee"][y] == "")] = 0.0
                ln, fn = like("ln", "ln"), like("fn", "fn")
                got = {"n": like("nn", "nn"), "e": e, "ln": ln, "fn": fn, "un": like("un", "un"), "ifn": np.maximum(like("fn", "ln"), like("ln", "fn")), "ln1": whole("lw", "ln", ln), "fn1": whole("fw", "fn", fn)}
                left, right = pa.array(x), pa.array(y)
                columns = [t["project"].combine_chunks().take(left), t["k"].combine_chunks().take(left), t["k"].combine_chunks().take(right), *[pa.array(rounded(got[c], digits)) for c in FEATURES]]
                yield pa.RecordBatch.from_arrays(columns, names=["project", "k1", "k2", *FEATURES])

    return cells.mapInArrow(run, f"project {area}, k1 {kind}, k2 {kind}, " + ", ".join(f"{c} double" for c in FEATURES))


ENTRIES = 500_000  #: products of counts, and pairs, held at a time


def message_similarity(authors: DataFrame, profiles: DataFrame, project: str, key: str, name: str, email: str, digits: int | None = None) -> DataFrame:
    """(project, k1, k2, d2vsim) of the pairs of :func:`similarity.blocked_author_pairs`: the cosine of the word counts (columns words, counts of ``profiles``) of two authors; 0 where either has none.

    Words meet inside the cells of the blocks and their products are added up there, so what is shuffled are profiles, never pairs and words.
    """
    kind, area = (authors.schema[c].dataType.simpleString() for c in (key, project))
    cells = block_cells(authors.join(profiles.select(key, "words", "counts"), key, "left"), project, key, name, email, words=F.col("words"), counts=F.col("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, end in whole_cells(batches):
            first, n, area_of, k = Firsts(t), end - np.arange(len(end)) - 1, t["project"].combine_chunks(), t["k"].combine_chunks()
            words, counts = (t[c].combine_chunks() for c in ("words", "counts"))
            size = np.asarray(words.value_lengths().fill_null(0))
            row, word, count = np.repeat(np.arange(len(end)), size), words.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float64)
            norm = np.sqrt(np.bincount(row, count * count, len(end)))
            start = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            at = np.append(start, len(end))
            for lo, hi in upto(np.add.reduceat(n, start), ENTRIES):
                lo, hi = int(at[lo]), int(at[hi])
                dot = products(end, lo, hi, *[c[slice(*np.searchsorted(row, [lo, hi]))] for c in (row, word, count)])
                x, y = partners(end, lo, hi)
                keep = np.flatnonzero(first(x, y))
                x, y, dot = x[keep], y[keep], dot[keep]
                both = norm[x] * norm[y]
                like = np.divide(dot, both, out=np.zeros(len(dot)), where=both > 0)
                left, right = pa.array(x), pa.array(y)
                yield pa.RecordBatch.from_arrays([area_of.take(left), k.take(left), k.take(right), pa.array(rounded(like, digits))], names=["project", "k1", "k2", "d2vsim"])

    return cells.mapInArrow(run, f"project {area}, k1 {kind}, k2 {kind}, d2vsim double")


def products(end: np.ndarray, lo: int, hi: int, row: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sum over words of the products of counts, for each pair of ``partners(end, lo, hi)``."""
    n = end[lo:hi] - np.arange(lo, hi) - 1
    place = np.cumsum(n) - n - np.arange(lo, hi) - 1  # a pair (x, y) is number place[x] + y
    order = np.lexsort((row, word, end[row]))
    row, word, count = row[order], word[order], count[order]
    new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (end[row[1:]] != end[row[:-1]]))) if len(row) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(new, len(row)))
    last = np.repeat(new + size, size)
    out = np.zeros(int(n.sum()))
    for a, z in upto(last - np.arange(len(row)) - 1, ENTRIES):
        x, y = partners(last, a, z)
        if len(x):
            at = place[row[x] - lo] + row[y]
            least = int(at.min())
            sums = np.bincount(at - least, count[x] * count[y])
            out[least : least + len(sums)] += sums
    return out
