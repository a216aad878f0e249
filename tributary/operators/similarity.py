"""Similarities of names, author profiles and pairs of authors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def jaro(a: str, b: str) -> float:
    """Jaro similarity; two empty texts are equal (1), one empty text is like nothing (0). An odd number of letters out of place counts as one less."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    m = len(matched)
    swaps = sum(x != y for x, y in zip(matched, other)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def winkler(a: str, b: str, weight: float = 0.1, most: int = 4) -> float:
    """Jaro-Winkler similarity without a threshold for the prefix bonus."""
    base, prefix = jaro(a, b), 0
    for x, y in zip(a[:most], b[:most]):
        if x != y:
            break
        prefix += 1
    return base + prefix * weight * (1 - base)


def winkler_columns(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with Jaro-Winkler similarities of column pairs ``{out: (a, b)}``, in one Arrow pass; null counts as ''."""
    schema = StructType(list(df.schema))
    for out in pairs:
        schema = schema.add(out, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], float] = {}
        for b in batches:
            add = {}
            for out, (x, y) in pairs.items():
                vals = []
                for p in zip(b[x], b[y]):
                    p = tuple(v if isinstance(v, str) else "" for v in p)
                    if p not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[p] = winkler(*p)
                    vals.append(known[p])
                add[out] = pd.Series(vals, dtype="float64", index=b.index)
            yield b.assign(**add)

    return df.mapInPandas(run, schema)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; two empty ones give 0."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / F.nullif(u, F.lit(0))).otherwise(0.0)


def bag(tokens: Column) -> Column:
    """Array of (token, count), sorted by token."""
    return F.transform(F.array_sort(F.array_distinct(tokens)), lambda t: F.struct(t.alias("t"), F.size(F.filter(tokens, lambda x: x == t)).alias("n")))


def name_parts(name: Column) -> dict[str, Column]:
    """First and last token of a name in small letters with single blanks."""
    n = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    t = F.split(n, " ")
    return {"n": n, "fn": F.element_at(t, 1), "ln": F.element_at(t, -1)}


def local_part(email: Column) -> Column:
    """The part before '@', or the whole text without one, in small letters."""
    return F.substring_index(F.lower(F.trim(email)), "@", 1)


def camel_words(text: Column) -> Column:
    """The words of a text in small letters, parted at signs, underscores and dashes and before capitals."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.transform(F.split(F.regexp_replace(plain, "([A-Z])", " $1"), " "), lambda x: F.lower(x)), lambda x: x != "")


def model_parts(name: Column, email: Column) -> dict[str, Column]:
    """Parts of a name as the scoring model takes them: ln and fn at blanks, ln1 and fn1 also at ``_ + - , .`` and inside camel case, un before '@'."""
    n = F.trim(name)
    n1 = F.regexp_replace(n, "([a-z])([A-Z])", "$1 $2")
    return {
        "ln": F.regexp_replace(n, r"^.* ", ""), "fn": F.regexp_replace(n, r" .*$", ""), "n1": n1,
        "ln1": F.regexp_replace(n1, r"^.*[ _+\-,.]", ""), "fn1": F.regexp_replace(n1, r"[ _+\-,.].*$", ""), "un": F.regexp_replace(F.lower(F.trim(email)), "@.*$", ""),
    }


#: Rows of a block that meet in one task: larger blocks are split into parts of this size on one side of the join.
BLOCK_PART = 200


def sized_projects(authors: DataFrame, project: str, most: int | None) -> DataFrame:
    """(project, distinct_pairs, skipped): the authors of each project, and whether the guard ``most`` leaves it out."""
    g = authors.groupBy(F.col(project).alias("project")).agg(F.count("*").alias("distinct_pairs"))
    return g.withColumn("skipped", F.lit(False) if most is None else F.col("distinct_pairs") > most)


def blocked_author_pairs(authors: DataFrame, project: str, key: str, name: str, email: str, most: int | None = None) -> DataFrame:
    """Pairs of authors of a project that share the first or last token of the name or the local part of the address.

    Each pair once, smaller key first, as (project, k1, k2, n1, n2, e1, e2). Blocks join on (project, token), so no task holds
    a whole project; a block of more than ``BLOCK_PART`` authors is dealt out in parts, each of which meets the whole block. A pair
    comes from the first token it shares, so pairs are not shuffled. ``most``, where given, skips projects with more authors.
    """
    p = name_parts(F.col(name))
    a = authors.select(F.col(project).alias("project"), F.col(key).alias("k"), F.col(name).alias("n"), F.col(email).alias("e"), p["fn"].alias("fn"), p["ln"].alias("ln"), local_part(F.col(email)).alias("un"))
    if most is not None:
        a = a.join(sized_projects(authors, project, most).where("NOT skipped").select("project"), "project")
    a = a.withColumn("ts", F.array_distinct(F.filter(F.array("fn", "ln", "un"), lambda t: t != "")))
    b = a.select("project", "k", "n", "e", "ts", F.explode("ts").alias("t"))
    parts = b.groupBy("project", "t").agg(F.count("*").alias("c")).where("c > 1").select("project", "t", F.ceil(F.col("c") / BLOCK_PART).cast("int").alias("parts"))
    b = b.join(parts, ["project", "t"])
    l = b.select("project", "t", F.pmod(F.hash("k"), "parts").alias("part"), F.col("k").alias("k1"), F.col("n").alias("n1"), F.col("e").alias("e1"), F.col("ts").alias("ts1"))
    r = b.select("project", "t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("e").alias("e2"), F.col("ts").alias("ts2"))
    first = F.element_at(F.array_intersect("ts1", "ts2"), 1) == F.col("t")
    return l.join(r, ["project", "t", "part"]).where("k1 < k2").where(first).select("project", "k1", "k2", "n1", "n2", "e1", "e2")


def rarity_features(pairs: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """``pairs`` with ln1f and fnf, one over how many of ``names`` have the last and the first token of the first author's name."""
    p = name_parts(F.col(name))
    known = names.select(p["n"].alias("n"), p["fn"].alias("fn"), p["ln"].alias("ln")).distinct()
    mine = name_parts(F.col("n1"))
    out = pairs.withColumns({"__f": mine["fn"], "__l": mine["ln"]})
    for c, k, to in (("fn", "__f", "fnf"), ("ln", "__l", "ln1f")):
        count = known.groupBy(F.col(c).alias(k)).agg((1 / F.count("*")).alias(to))
        out = out.join(count, k, "left").withColumn(to, F.coalesce(to, F.lit(1.0)))
    return out.drop("__f", "__l")


PROFILE_BLOCK, PROFILE_WORDS = 4000, 4096  #: authors and words whose counts a task holds as one dense table


def word_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, counts): how often each word, as a 64-bit hash, stands in all texts of a key; keys without words have no row."""
    w = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("w"))
    n = w.groupBy(key, F.xxhash64("w").alias("w")).agg(F.count("*").alias("n"))
    g = n.groupBy(key).agg(F.collect_list(F.struct("w", F.col("n").cast("int").alias("n"))).alias("x"))
    return g.select(key, F.col("x.w").alias("words"), F.col("x.n").alias("counts"))


def like_profiles(profiles: DataFrame, project: str, key: str, least: float) -> DataFrame:
    """(k1, k2, d2vsim) of all pairs of a project whose word counts (columns words, counts) have a cosine above ``least``.

    All pairs are compared: the authors of a project are dealt into blocks, and each two blocks meet in one task, as dense
    products. The work grows with the square of a project's authors; the result does not depend on any common key.
    """
    kind = profiles.schema[key].dataType.simpleString()
    m = profiles.groupBy(project).agg(F.ceil(F.count("*") / PROFILE_BLOCK).cast("int").alias("m"))
    b = profiles.join(m, project).select(F.col(project).alias("project"), F.col(key).alias("k"), "words", "counts", F.pmod(F.hash(key), "m").alias("b"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    b = b.select("project", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "k", "words", "counts")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        size = np.array([len(w) for w in g["words"]])
        row, n = np.repeat(np.arange(len(g)), size), np.concatenate(list(g["counts"])).astype(np.float64)
        norm = np.sqrt(np.bincount(row, n * n, len(g)))
        _, col, seen = np.unique(np.concatenate(list(g["words"])), return_inverse=True, return_counts=True)
        left, right = (np.flatnonzero(g["b"].to_numpy() == g[c].iloc[0]) for c in ("i", "j"))
        place = np.zeros((2, len(g)), dtype=np.int64)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        order = np.argsort(col, kind="stable")
        order = order[seen[col[order]] > 1]  # a word of one author is part of no product
        used, at = np.unique(col[order], return_inverse=True)
        in_left, in_right = np.isin(row[order], left), np.isin(row[order], right)
        dot = np.zeros((len(left), len(right)))
        for lo in range(0, len(used), PROFILE_WORDS):
            a, z = np.searchsorted(at, [lo, lo + PROFILE_WORDS])
            tables = []
            for side, (inside, rows) in enumerate(((in_left, left), (in_right, right))):
                e = order[a:z][inside[a:z]]
                x = np.zeros((len(rows), min(PROFILE_WORDS, len(used) - lo)), dtype=np.float32)
                x[place[side, row[e]], at[a:z][inside[a:z]] - lo] = n[e]
                tables.append(x)
            dot += tables[0] @ tables[1].T
        k = g["k"].to_numpy()
        near = np.zeros(dot.shape, dtype=bool)
        for lo in range(0, len(left), 256):
            near[lo : lo + 256] = dot[lo : lo + 256] > least * np.outer(norm[left[lo : lo + 256]], norm[right])
        x, y = np.nonzero(near)
        p, q, cos = k[left[x]], k[right[y]], dot[x, y] / (norm[left[x]] * norm[right[y]])
        keep = p < q if g["i"].iloc[0] == g["j"].iloc[0] else p != q
        return pd.DataFrame({"k1": np.minimum(p, q)[keep], "k2": np.maximum(p, q)[keep], "d2vsim": cos[keep]})

    return b.groupBy("project", "i", "j").applyInPandas(run, f"k1 {kind}, k2 {kind}, d2vsim double")


def zone_hours(offset: Column) -> Column:
    """[+-]HHMM as hours; null where the text is none."""
    ok = offset.rlike(r"^[+-]\d{4}$")
    h = F.substring(offset, 2, 2).try_cast("int") + F.substring(offset, 4, 2).try_cast("int") / 60
    return F.when(ok, F.when(offset.startswith("-"), -h).otherwise(h))


def zone_similarity(a: Column, b: Column, wrap: bool = False) -> Column:
    """1 - min(d, 24) / 24 of the difference in hours; with ``wrap`` differences above 12 count the other way round."""
    d = F.abs(a - b)
    if wrap:
        d = F.when(d > 12, 24 - d).otherwise(d)
    return F.greatest(F.lit(0.0), 1 - F.least(d, F.lit(24.0)) / 24)
