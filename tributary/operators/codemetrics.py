"""Comment lines and size metrics of source files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values: (line comment marks, block opening, block closing) of each comment style.
STYLES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "hash": (("#",), "", ""), "slash_star": (("//",), "/*", "*/"), "css": ((), "/*", "*/"), "html": ((), "<!--", "-->"), "sql": (("--",), "/*", "*/"), "percent": (("%",), "", ""),
    "semicolon": ((";",), "", ""), "haskell": (("--",), "{-", "-}"), "lua": (("--",), "--[[", "]]"), "none": ((), "", ""),
}
# The file endings of each comment style. Notebooks, documents and data have no comments, nor have files of other endings.
ENDINGS_OF = {
    "hash": "py sh bash zsh fish rb r pl pm yaml yml toml ini cfg conf properties gitignore dockerignore",
    "slash_star": "js jsx ts tsx c cpp cxx cc c++ h hpp hxx h++ java scala kt kts go rs swift dart php cs fs mm groovy gradle ino pde glsl hlsl metal jsonc",
    "css": "css scss sass less styl", "html": "html htm xml svg vue xhtml rss atom", "sql": "sql mysql pgsql sqlite", "percent": "tex latex ltx m", "semicolon": "asm s lisp cl el scm clj cljs",
    "haskell": "hs lhs", "lua": "lua", "none": "ipynb json md rst txt",
}
ENDINGS = {ending: style for style, endings in ENDINGS_OF.items() for ending in endings.split()}


def classify(lines: list[str], style: str, fixed: bool = False) -> list[bool]:
    """Whether each line of a file is a comment."""
    return [n >= 0 for n in comment_characters(lines, style, fixed)]


def comment_characters(lines: list[str], style: str, fixed: bool = False) -> list[int]:
    """The characters of comment in each line of a file, or -1 where it is none.

    A line with a line comment counts whole, one that opens a block from the opening on, and all up to the line that closes it
    whole. In the reference reading a block opened and closed on one line stays open until a later closing mark; with ``fixed`` it ends on its line.
    """
    marks, opening, closing = STYLES.get(style, STYLES["none"])
    nested = any(opening.startswith(m) for m in marks)  # an opening that reads as a line comment counts only at the start of a line
    out, inside = [], False
    for line in lines:
        head = line.lstrip()
        starts = bool(marks) and head.startswith(marks)
        at = line.find(opening) if opening and (starts if nested else not starts) else -1
        if inside:
            out.append(len(line))
            inside = closing not in line
        elif at >= 0:
            out.append(len(line) - at)
            inside = not (fixed and closing in line[at + len(opening) :])
        else:
            out.append(len(line) if starts else -1)
    return out


def style_of(path: Column) -> Column:
    """The comment style of a file by its ending, in any case; 'none' for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit("none"))


METRICS = ("lines", "chars", "comment_lines", "non_comment_lines", "code_chars", "comment_chars")


def file_metrics(files: DataFrame, path: str, text: str) -> DataFrame:
    """``files`` without ``text``, with ``METRICS`` and size of every file, whole files; characters include line ends. Null texts have no lines."""
    rest = [c for c in files.columns if c != text]
    schema = StructType([files.schema[c] for c in rest])
    for c in (*METRICS, "size"):
        schema = schema.add(c, "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, s in zip(b[text], b["__style"]):
                t = t if isinstance(t, str) else ""
                lines = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                lines = [x + "\n" for x in lines[:-1]] + lines[-1:] * bool(lines[-1])
                c = comment_characters(lines, s)
                n, chars, marked = len(lines), sum(map(len, lines)), sum(x >= 0 for x in c)
                rows.append((n, chars, marked, n - marked, sum(len(x) for x, k in zip(lines, c) if k < 0), sum(k for k in c if k >= 0), len(t.encode("utf-8", "surrogatepass"))))
            got = pd.DataFrame(rows, columns=[*METRICS, "size"], index=b.index)
            yield pd.concat([b[rest], got], axis=1)

    return files.withColumn("__style", style_of(F.col(path))).mapInPandas(run, schema)


def ratio(rest: Column, part: Column) -> Column:
    """rest / part; infinite without a part, 0 without either."""
    return F.when(part > 0, rest / F.nullif(part, F.lit(0))).when(rest > 0, F.lit(float("inf"))).otherwise(0.0)


def repository_metrics(files: DataFrame, repo: str) -> DataFrame:
    """Sums of the ``METRICS`` of :func:`file_metrics` per repository, its size in MB, and the ratios of code to comment in lines and characters."""
    g = files.groupBy(repo).agg(*[F.sum(c).alias(c) for c in METRICS], (F.sum("size") / (1024 * 1024)).alias("size_mb"))
    return g.withColumns({"code_to_comment_lines": ratio(F.col("non_comment_lines"), F.col("comment_lines")), "code_to_comment_chars": ratio(F.col("code_chars"), F.col("comment_chars"))})


def comment_lines(files: DataFrame, key: str, text: str, style: str, fixed: bool = False) -> DataFrame:
    """(key, lines, blank_lines, comment_lines, characters, ratio) per file, whole files; the ratio of comment to other lines is infinite without others.

    Null texts have no lines. One file is one value, so its state never leaves a task and nothing is shuffled.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, s in zip(b["k"], b["t"], b["s"]):
                lines = t.split("\n") if isinstance(t, str) and t else []
                c = sum(classify(lines, s, fixed))
                rows.append((k, len(lines), sum(not x.strip() for x in lines), c, sum(map(len, lines))))
            yield pd.DataFrame(rows, columns=["key", "lines", "blank_lines", "comment_lines", "characters"])

    out = files.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(style).alias("s")).mapInPandas(run, f"key {kind}, lines long, blank_lines long, comment_lines long, characters long")
    rest = F.col("lines") - F.col("comment_lines")
    ratio = F.when(F.col("lines") == 0, 0.0).when(rest == 0, F.lit(float("inf"))).otherwise(F.col("comment_lines") / F.nullif(rest, F.lit(0)))
    return out.withColumn("ratio", ratio).withColumnRenamed("key", key)
