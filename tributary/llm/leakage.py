"""Evaluation items that stand, whole or in part, in a corpus: latent semantic retrieval and run checks.

Texts are cut into overlapping passages; passages become TF-IDF vectors, a randomised SVD computed over
Spark partitions gives a latent space, and every corpus passage is compared with every item passage by
cosine in it. Pairs above their item's calibrated threshold are checked for the longest common run. For paraphrases the longest
common subsequence is taken of these and of all pairs that share enough words for the share asked for, and the answer check asks
how much of the item's telling words, numbers and names among them, the passage holds.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDF_BUCKETS = 1 << 18  #: hashed document frequencies; bounds what driver and executors hold
RANK = 320  #: dimensions of the latent space
ITEM_PASSAGES = 4_000  #: passages of items compared at a time; bounds vocabulary, vectors and runs sent to the executors
PASSAGE, STEP = 20, 10  #: words in a passage and between the starts of passages
WIDE_PASSAGE, WIDE_STEP = 40, 20  #: the same in characters for texts without blanks
RUN, WIDE_RUN = 10, 20  #: words, or characters, in a row that make a leak
SHARE = 0.4  #: part of a passage that an item holds in the same order where it is a paraphrase
ANSWER = 0.25  #: part of the telling words, by weight, that a paraphrase holds: SHARE of them, of which a passage covers five eighths at least

TERMS_AT_HAND = 300_000  #: terms a Python worker remembers

_WORD = re.compile(r"[^\W_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def words(text: str) -> list[str]:
    """Runs of letters and digits, in small letters."""
    return [w for w in _WORD.findall(fold(text))]


def letters(text: str) -> str:
    """All letters and digits in a row, in small letters."""
    return "".join(_WORD.findall(fold(text)))


def fold(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


def pairs_of(chars: str) -> list[str]:
    """Terms of a text without blanks: every character with its successor."""
    return ["~" + chars[i : i + 2] for i in range(len(chars))]


def term_id(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % IDF_BUCKETS


class Buckets(dict):
    """Buckets of the terms seen so far."""

    def __missing__(self, term: str) -> int:
        self[term] = i = term_id(term)
        return i


class Terms(dict):
    """Places of the terms seen so far in ``ids``, their numbers in an index' vocabulary or -1, and ``weights``."""

    def __init__(self, index: ItemIndex):
        self.index, self.ids, self.weights = index, np.full(1 << 12, -1, dtype=np.int64), np.zeros(1 << 12, dtype=np.float32)

    def __missing__(self, term: str) -> int:
        n = len(self)
        if n == len(self.ids):
            self.ids, self.weights = np.concatenate([self.ids, self.ids]), np.concatenate([self.weights, self.weights])
        self.ids[n], self.weights[n] = self.index.vocabulary.get(term, -1), self.index.idf[term_id(term)]
        self[term] = n
        return n

    def of(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary numbers and weights of a sequence of terms."""
        if len(self) > TERMS_AT_HAND:
            self.clear()
        at = np.fromiter(map(self.__getitem__, terms), np.int64, len(terms))
        return self.ids[at], self.weights[at]


def views(text: str, wide: bool | None = None) -> list[tuple[bool, list[str]]]:
    """The term sequences of a text: its words, and for texts in scripts without blanks its characters."""
    out = [] if wide else [(False, words(text))]
    if wide or (wide is None and _WIDE.search(text)):
        out.append((True, pairs_of(letters(text))))
    return out


def windows(n: int, wide: bool) -> list[tuple[int, int]]:
    """Starts and ends of passages so that every run of the leak length lies in one of them."""
    size, step = (WIDE_PASSAGE, WIDE_STEP) if wide else (PASSAGE, STEP)
    return [(a, min(a + size, n)) for a in range(0, max(1, n - size + step), step)] if n else []


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Per bucket of terms the number of documents that hold one; and the number of documents. Over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(IDF_BUCKETS + 1, dtype=np.int64)
        seen = Buckets()
        for b in batches:
            for t in b["t"]:
                if len(seen) > TERMS_AT_HAND:
                    seen.clear()
                ids = {i for _, terms in views(t) for i in map(seen.__getitem__, set(terms))}
                n[list(ids)] += 1
                n[IDF_BUCKETS] += 1
        i = np.flatnonzero(n)
        yield pd.DataFrame({"i": i, "n": n[i]})

    got = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInPandas(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(IDF_BUCKETS + 1)
    n[got["i"].to_numpy()] = got["n"].to_numpy()
    return n[:IDF_BUCKETS], int(n[IDF_BUCKETS])


def randomised_svd(rows: DataFrame, size: int, rank: int, rounds: int = 3, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors (size x rank) of the sparse rows (ids array<int>, weights array<double>).

    Subspace iteration from a random start: each round the partitions add up A'AV for their own rows, and
    the sum, of fixed size, is made orthonormal.
    """
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0].astype(np.float32)
    for _ in range(rounds):

        def run(batches: Iterator[pd.DataFrame], v: np.ndarray = v) -> Iterator[pd.DataFrame]:
            total = np.zeros(v.shape, dtype=np.float32)
            for b in batches:
                for lo in range(0, len(b), 256):
                    part = b.iloc[lo : lo + 256]
                    a = np.zeros((len(part), v.shape[0]), dtype=np.float32)
                    for r, (ids, w) in enumerate(zip(part["ids"], part["weights"])):
                        np.add.at(a[r], np.asarray(ids), np.asarray(w, dtype=np.float32))
                    total += a.T @ (a @ v)
            if total.any():
                yield pd.DataFrame({"part": [total.tobytes()]})

        total = np.zeros(v.shape, dtype=np.float64)
        for r in rows.mapInPandas(run, "part binary").toLocalIterator():
            total += np.frombuffer(r["part"], dtype=np.float32).reshape(v.shape)
        v = np.linalg.qr(total)[0].astype(np.float32)
    return v


class ItemIndex:
    """Latent vectors of the passages of a block of items, with what the checks need."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, filler: float, spark, rank: int):
        self.idf, self.filler = idf, filler
        self.wide, self.terms, self.runs, self.answers, self.sequence = {}, {}, {}, {}, {}
        for k, t in items:
            wide = bool(_WIDE.search(t))
            (_, terms), = views(t, wide)
            self.wide[k], self.sequence[k] = wide, terms
            need = WIDE_RUN if wide else RUN
            units = letters(t) if wide else terms
            self.runs[k] = {hash_run(units[i : i + need]) for i in range(len(units) - need + 1)}
            self.answers[k] = self.telling(terms, wide)
        vocabulary = sorted({w for s in self.sequence.values() for w in s})
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        passages, owner = [], []
        for k, s in self.sequence.items():
            for a, b in windows(len(s), self.wide[k]):
                ids = [self.vocabulary[w] for w in s[a:b]]
                passages.append(ids)
                owner.append(k)
        self.weight = np.array([idf[term_id(w)] for w in vocabulary], dtype=np.float32)
        data = [(ids, [float(self.weight[i]) for i in ids]) for ids in passages]
        self.rank = min(rank, len(vocabulary), len(passages))
        frame = spark.createDataFrame(data, "ids array<int>, weights array<double>").repartition(4)
        self.v = randomised_svd(frame, len(vocabulary), self.rank)
        self.owner = np.array(owner)
        self.starts = np.flatnonzero(np.concatenate([[True], self.owner[1:] != self.owner[:-1]]))
        self.items = self.owner[self.starts]
        self.wide_items = np.array([self.wide[k] for k in self.items.tolist()])
        self.lengths = np.array([len(self.sequence[k]) for k in self.items.tolist()])
        self.holds = np.zeros((len(vocabulary), len(self.items)), dtype=bool)  # whether an item holds a word
        self.masks = {k: places(s) for k, s in self.sequence.items()}
        for c, k in enumerate(self.items.tolist()):
            self.holds[[self.vocabulary[w] for w in self.sequence[k]], c] = True
        self.q = np.stack([self.unit(ids) for ids in passages]).astype(np.float32)
        self.affinity = (self.v @ self.q.T).astype(np.float32)  # a word's share in the latent product with each item passage
        self.thresholds = np.array([self.calibrate(k) for k in self.items.tolist()], dtype=np.float32)
        self.threshold = float(self.thresholds.min())
        self.near = dict(zip(self.items.tolist(), self.thresholds.tolist()))
        del self.v

    def telling(self, terms: list[str], wide: bool) -> tuple[dict[str, float], float]:
        """The half of the item's different terms with the greatest weights, and all its numbers; and the most of their weight a passage of it holds."""
        weight = {w: float(self.idf[term_id(w)]) for w in terms}
        least = float(np.median(list(weight.values()))) if weight else 0.0
        held = {w: x for w, x in weight.items() if x >= least or w.isdigit()}
        most = max((sum(held.get(w, 0.0) for w in set(terms[a:b])) for a, b in windows(len(terms), wide)), default=0.0)
        return held, most

    def answer_share(self, item: int, terms: list[str]) -> float:
        held, most = self.answers[item]
        return min(1.0, sum(held.get(w, 0.0) for w in set(terms)) / most) if most else 0.0

    def unit(self, ids: list[int]) -> np.ndarray:
        w = self.weight[ids]
        return (w @ self.v[ids]) / max(1e-9, float(np.sqrt((w * w).sum())))

    def calibrate(self, k: int) -> float:
        """The least cosine at which a run of the leak length of an item still meets it, amid other words.

        The rest of the passage is reckoned as words that occur in one document only, the heaviest there are; the
        threshold lies a fifth below the least cosine of all runs of the item, for what such words share with them. An item shorter than
        a run is reckoned whole.
        """
        s = self.sequence[k]
        need, size = (WIDE_RUN, WIDE_PASSAGE) if self.wide[k] else (RUN, PASSAGE)
        near, low = self.affinity[:, self.owner == k], 1.0
        for a in range(max(1, len(s) - need + 1)):
            ids = [self.vocabulary[w] for w in s[a : a + need]]
            w = self.weight[ids]
            norm = np.sqrt((w * w).sum() + self.filler * (size - len(ids)))
            low = min(low, float(((w @ near[ids]) / norm).max()))
        return max(0.01, 0.8 * low)


def hash_run(units) -> int:
    return zlib.crc32(("" if isinstance(units, str) else " ").join(units).encode("utf-8", "surrogatepass"))


def places(a: list[str]) -> dict[str, int]:
    """The places of each term of a sequence as bits."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    return where


def common_subsequence(a: list[str], b: list[str], where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence (bit-parallel); ``where`` holds the places of ``a``, if known."""
    where = places(a) if where is None else where
    row, full = 0, (1 << len(a)) - 1
    for w in b:
        x = row | where.get(w, 0)
        row = x & ~((x - ((row << 1) | 1)) & full) & full
    return bin(row).count("1")


def longest_run(a: list[str], b: list[str]) -> int:
    """Length of the longest stretch that both sequences hold in a row."""
    best, prev = 0, {}
    where: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        where.setdefault(w, []).append(i)
    for w in b:
        cur = {}
        for i in where.get(w, ()):
            cur[i] = prev.get(i - 1, 0) + 1
            best = max(best, cur[i])
        prev = cur
    return best


def longest_stretch(known: np.ndarray, need: int) -> bool:
    """Whether ``need`` in a row are set."""
    if len(known) < need:
        return False
    gaps = np.flatnonzero(~known)
    return bool(np.diff(gaps, prepend=-1, append=len(known)).max() > need)


def candidate_passages(text: str, index: ItemIndex, seen: Terms, share: float | None = None) -> Iterator[tuple[int, int, int, float, bool, list[str]]]:
    """(start, end, item, cosine, wide, terms) of the passages of a text that come near an item's passages.

    Without ``share`` only runs are looked for, and passages in which no run of the leak length lies inside the items' vocabulary
    are left out before anything is computed for them. With ``share`` there are also of those that hold so many words of an item that a common subsequence can reach that share;
    this loses none, since a subsequence has at most as many words.
    """
    for wide, terms in views(text):
        if wide and not any(index.wide.values()):
            continue
        spans = windows(len(terms), wide)
        if not spans:
            continue
        ids, weights = seen.of(terms)
        known = ids >= 0
        if share is None and not longest_stretch(known, WIDE_RUN - 1 if wide else RUN):
            continue
        square = np.concatenate([[0], np.cumsum(weights * weights)])
        hit = np.concatenate([[0], np.cumsum(weights * weights * known)])
        lo, hi = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
        norm = np.sqrt(np.maximum(square[hi] - square[lo], 1e-9))
        # the projection cannot be longer than the part of the passage inside the items' vocabulary
        near = np.sqrt(np.maximum(hit[hi] - hit[lo], 0)) >= index.threshold * norm
        if share is None:
            need = WIDE_RUN - 1 if wide else RUN  # a run of letters holds one pair of letters less
            place = np.arange(len(known))
            inside = np.concatenate([[0], np.cumsum(place - np.maximum.accumulate(np.where(known, -1, place)) >= need)])
            near &= inside[hi] > inside[np.minimum(lo + need - 1, hi)]
        else:
            inside = np.concatenate([[0], np.cumsum(known)])
            near |= inside[hi] - inside[lo] >= share * np.minimum(hi - lo, index.lengths.min()) - 1e-9
        near = np.flatnonzero(near & (hit[hi] > hit[lo]))
        step = WIDE_STEP if wide else STEP
        for part in range(0, len(near), 512):
            sel = near[part : part + 512]
            row = np.full(len(spans), -1)
            row[sel] = np.arange(len(sel))
            at = np.flatnonzero(known[lo[sel[0]] : hi[sel[-1]]]) + lo[sel[0]]
            columns, column = np.unique(ids[at], return_inverse=True)
            x = np.zeros((len(sel), len(columns)), dtype=np.float32)
            times = np.zeros_like(x)
            for back in (0, 1):  # a word lies in at most two passages
                w = at // step - back
                ok = (w >= 0) & (w < len(spans))
                r = np.where(ok, row[np.clip(w, 0, len(spans) - 1)], -1)
                ok &= r >= 0
                np.add.at(x, (r[ok], column[ok]), weights[at[ok]])
                if share is not None:
                    np.add.at(times, (r[ok], column[ok]), 1)
            # the nearest passage of each item; an item's passages stand side by side
            cos = np.maximum.reduceat(x @ index.affinity[columns], index.starts, axis=1) / norm[sel][:, None]
            take = cos >= index.thresholds
            if share is not None:
                take |= times @ index.holds[columns].astype(np.float32) >= share * np.minimum.outer((hi - lo)[sel], index.lengths) - 1e-3
            r, c = np.nonzero(take & (index.wide_items == wide))
            for a, b, item, near_by in zip(lo[sel[r]].tolist(), hi[sel[r]].tolist(), index.items[c].tolist(), cos[r, c].tolist()):
                yield a, b, item, near_by, wide, terms


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", rank: int = RANK, share: float | None = SHARE) -> DataFrame:
    """(key, item_key, cosine, lcs_share, answer_share, run_found) of every document and item that come near.

    ``run_found`` says that a passage of the document holds at least ten consecutive words (twenty
    consecutive letters or digits for items in scripts without blanks) of the item. With ``share``, ``lcs_share`` is the largest part of a passage, or of
    the item where that is shorter, that stands in the item in the same order, over all passages of the document: every pair that
    reaches ``share`` has a row. ``answer_share`` is the part, by weight, of the item's telling words (the heavier half of its different words, and its
    numbers) that the passage of the largest ``lcs_share`` holds. With ``share`` None both are null and not looked for. ``cosine`` is that
    of the nearest passage. Items are taken in blocks of at most ``ITEM_PASSAGES`` passages, each against all documents, every text whole. Null and
    empty texts and items shorter than a run give no rows; equal items are found each for itself. The
    documents are read once for the frequencies and once per block, without a shuffle of their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    df, n = document_frequencies(docs, text)
    idf = np.log((n + 1) / (df + 0.5)).clip(0.05).astype(np.float32)
    filler = float(np.log((n + 1) / 1.5).clip(0.05)) ** 2
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"{key} {kind}, {item_key} {item_kind}, cosine double, lcs_share double, answer_share double, run_found boolean"
    out = None
    blocks: list[list[tuple[int, str]]] = []
    room = 0
    for r in items.select(item_key, text).where(F.col(text).isNotNull()).orderBy(item_key).toLocalIterator():
        wide = bool(_WIDE.search(r[1]))
        size = sum(len(windows(len(x), wide)) for _, x in views(r[1], wide))
        if size > room:
            blocks.append([])
            room = ITEM_PASSAGES
        if size:
            blocks[-1].append((r[0], r[1]))
            room -= size
    for block in [b for b in blocks if b]:
        index = ItemIndex(block, idf, filler, spark, rank)

        def run(batches: Iterator[pd.DataFrame], index: ItemIndex = index) -> Iterator[pd.DataFrame]:
            seen = Terms(index)
            for b in batches:
                found: dict[tuple, list] = {}
                for d, t in zip(b["k"], b["t"]):
                    chars = None
                    passages: dict[tuple[bool, int], tuple] = {}
                    for lo, hi, item, cos, wide, terms in candidate_passages(t, index, seen, share):
                        need = WIDE_RUN if wide else RUN
                        if (wide, lo) not in passages:  # once for all items the passage comes near
                            if wide and chars is None:
                                chars = letters(t)
                            units = chars[lo:hi] if wide else terms[lo:hi]
                            passages[wide, lo] = units, {hash_run(units[i : i + need]) for i in range(len(units) - need + 1)}
                        units, hashes = passages[wide, lo]
                        exact = not hashes.isdisjoint(index.runs[item])
                        if exact:  # hashes may collide
                            mine = letters_of(index, item) if wide else index.sequence[item]
                            exact = longest_run(list(mine), list(units)) >= need
                        lcs = answer = None
                        if share is not None:
                            seq = index.sequence[item]
                            lcs = common_subsequence(seq, terms[lo:hi], index.masks[item]) / max(1, min(len(seq), hi - lo))
                            if lcs < share and not exact and cos < index.near[item]:
                                continue  # neither near nor a paraphrase
                            answer = index.answer_share(item, terms[lo:hi])
                        old = found.get((d, item))
                        if old is None:
                            found[d, item] = [cos, lcs, answer, exact]
                        else:
                            if share is not None:
                                old[1], old[2] = max((old[1], old[2]), (lcs, answer))
                            old[0], old[3] = max(old[0], cos), old[3] or exact
                yield pd.DataFrame([(d, i, *v) for (d, i), v in found.items()], columns=[key, item_key, "cosine", "lcs_share", "answer_share", "run_found"])

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def letters_of(index: ItemIndex, item: int) -> str:
    """The letters of an item from its terms, each of which begins with the character it stands for."""
    return "".join(t[1] for t in index.sequence[item])
