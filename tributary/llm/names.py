"""Variant spellings of people and organisations: MinHash candidates, Monge-Elkan checks, star clusters."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.seedtree import connected_components
from tributary.operators.components import star_edges
from tributary.operators.similarity import winkler as jaro_winkler
from tributary.session import materialise

Q = 2  #: length of the padded q-grams
SIMILAR = 0.5  #: q-gram Jaccard similarity at which a pair must still become a candidate
RECALL = 0.95  #: share of pairs at SIMILAR that the banding must collide
HASHES = 200  #: hash functions available for banding
MONGE = 0.9  #: least Monge-Elkan similarity of linked names
NEAR = 0.88  #: least Jaro-Winkler similarity of parts that may be one name
LEAST_PARTNERS, LEAN = 4, 3.0  #: a word of the lexicon has so many partners, and so many times the partners that its partners have on average
TYPO = 10  #: a word one letter away from one with so many times its partners is that word mistyped
LEXICON_WORDS = 200_000  #: most words of the lexicon, those with most partners; bounds what driver and executors hold
SHARED_MAILBOXES = 12  #: different mailboxes of a domain that belongs to no single person
DOMAIN_BITS = 1 << 23  #: hashed domains; bounds the map of shared ones
BUCKET_PART = 200  #: items of a bucket that meet in one task; larger buckets are dealt out in parts

# Names and mailboxes that identify nobody.
NOBODY = set("unknown nan none null na n/a developer ubuntu ci root user admin administrator nobody anonymous anon test guest bot system".split()) | {"(no author)", "no author", "your name", "build bot", "first last", "you"}
MAILBOXES = set("noreply no-reply nobody none root user you unknown builds build ci localhost admin administrator donotreply mailer-daemon postmaster anonymous test".split())
# Mailboxes any owner of a domain may have.
ROLES = set("dev contact oss info hello team mail office support me git".split())
# Titles and legal forms around names.
TITLES = set("dr prof mr mrs ms sir the team inc ltd gmbh llc ev corp co ag e.v jr sr plc".split())
# Given names and their short forms.
NICKNAMES = """
alexander: alex sasha xander; abigail: abby gail; anastasia: nastya stasia; anthony: tony; augustin: gus; benjamin: ben benny; charlotte: charlie lottie;
christopher: chris kit; daniel: dan danny; dmitri: dima mitya; edward: ed eddie ned ted; ekaterina: katya kate; elizabeth: beth betty liz lizzie eliza;
francesca: fran chesca; francisco: paco pancho; frederik: fred rikki; gabriel: gabe; guillermo: memo; ignacio: nacho; johanna: jo hanna; jonathan: jon jonny;
josefina: pepa josie; joseph: joe; katherine: kate kathy katie; margaret: meg maggie peggy; matthias: matt matze; maximilian: max; michael: mike mick mickey;
nicholas: nick nico; nikolai: kolya; patricia: pat patty trish; philippa: pippa; rebecca: becky; richard: dick rick rich; robert: rob bob bobby; samantha: sam;
samuel: sam; sebastian: basti seb; stephanie: steph; theodore: ted theo; thomas: tom tommy; timothy: tim; victoria: vicky tori; vladimir: vova; william: will bill liam billy;
zachary: zach zack; john: jack johnny; james: jim jimmy; henry: harry hank; charles: chuck; software: sw soft; technologies: tech; research: rsrch; foundation: fdn; laboratories: labs lab; networks: net; systems: sys; collective: coll; david: dave; andrew: andy drew; susan: sue; deborah: deb; jennifer: jen jenny
"""
# Latin readings of Cyrillic and of letters that do not decompose.
LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшъыьэю", "a b v g d e e j z i i k l m n o p r s t u f h tz ch sh _ y _ e yu".split())) | {
    "щ": "sch", "я": "ia", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d",
}


def short_forms() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for entry in NICKNAMES.replace("\n", " ").split(";"):
        full, _, short = entry.strip().partition(":")
        for s in short.split():
            out.setdefault(sound(s), set()).add(sound(full))
    return out


def fold(text: str) -> str:
    """Small Latin letters without accents."""
    t = text.lower().replace("уэ", "w")
    t = "".join(LATIN.get(c, c) for c in t).replace("_", "") if any(c in LATIN for c in t) and "_" not in text else "".join("" if LATIN.get(c) == "_" else LATIN.get(c, c) for c in t)
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def sound(token: str) -> str:
    """One spelling for letters that transliterations confuse."""
    if len(token) == 1:
        return "k" if token in "cqx" else token
    t = token.replace("ck", "k").replace("c", "k").replace("q", "k").replace("x", "ks").replace("kk", "k")
    return t.replace("oe", "o").replace("ue", "u").replace("ae", "a") if len(t) > 4 else t


SHORT = short_forms()
LONG = {full: {s for s, fs in SHORT.items() if full in fs} for fs in SHORT.values() for full in fs}
SOUND_TITLES = {sound(t) for t in TITLES}


def mail_key(email: str | None) -> str:
    """An address in one spelling, or '' where it identifies nobody."""
    e = re.sub(r"\s+at\s+", "@", (email or "").strip().strip("<>").strip().lower())
    local, at, domain = e.partition("@")
    if not at or not local or not domain or domain.split(".")[0] == "localhost" or local in MAILBOXES:
        return ""
    return f"{local.split('+')[0] if not re.match(r'[0-9]+[+]', local) else local}@{domain}"


def plain_name(name: str | None) -> str:
    """A name without what stands around it; '' where it identifies nobody."""
    n = re.sub(r"[\(\[].*?[\)\]]|@ \w+$|\s[|;].*$|\"[^\"]*\"|“[^”]*”", " ", name or "").strip()
    return "" if not n or n.lower() in NOBODY or "[bot]" in (name or "").lower() or (name or "").lower().strip() in NOBODY else n


def raw_token(text: str) -> str:
    """A user name in small letters, exact otherwise."""
    return re.sub(r"[^a-z0-9]", "", fold(text))


def near_words(word: str) -> Iterator[str]:
    """The word with one letter left out, each way, and with neighbours swapped."""
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]


class Reader:
    """Reads names and addresses into (given, family) with a lexicon of given names and kinds of organisation."""

    def __init__(self, lexicon: set[str], domains: np.ndarray | None = None):
        self.lexicon = lexicon | {s for s, full in SHORT.items() if full & lexicon}
        self.domains = domains  # one bit per hashed domain, set where many mailboxes share it
        self.near: dict[str, set[str]] = {}
        for w in lexicon:
            if len(w) >= 4:
                for x in (w, *near_words(w)):
                    self.near.setdefault(x, set()).add(w)
        self.whole = lexicon - set(SHORT)
        self.sizes = sorted({len(w) for w in self.whole if len(w) >= 3}, reverse=True)

    def given(self, t: str) -> str:
        """The lexicon's word for a token, typing errors allowed; or ''."""
        if t in self.lexicon:
            return t
        if len(t) >= 5:
            for x in (t, *near_words(t)):
                for w in self.near.get(x, ()):
                    if abs(len(w) - len(t)) <= 1:
                        return w
        return ""

    def split(self, t: str) -> tuple[str, str] | None:
        """(given, rest) of a token in which a word of the lexicon and a name are written together."""
        for n in self.sizes:
            if len(t) - n >= 4:
                if t[:n] in self.whole:
                    return t[:n], t[n:]
                if n >= 4 and t[-n:] in self.whole:
                    return t[-n:], t[:-n]
        return None

    def shared(self, domain: str) -> bool:
        b = domain_bit(domain)
        return self.domains is not None and bool(self.domains[b >> 3] >> (b & 7) & 1)

    def certain(self, g: str) -> bool:
        """Whether a word is surely a given name or an initial, so that the order of the parts is known."""
        return len(g) < 2 or bool(self.given(g))

    def tokens(self, text: str) -> list[str]:
        text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z][a-z])", " ", text) if re.fullmatch(r"[A-Z][a-z]+[A-Z][a-z]+", text) else text
        found = [sound(x) for x in re.findall(r"[a-z0-9]+", fold(text).replace("'", "").replace("’", ""))]
        return [t for t in found if t not in SOUND_TITLES]

    def pair(self, tokens: list[str], comma: bool, upper: list[bool]) -> tuple[str, str]:
        """(given or initial, family) of two or more tokens."""
        full = [i for i, t in enumerate(tokens) if len(t) > 1]
        ones = [i for i, t in enumerate(tokens) if len(t) == 1]
        if not full:
            return "", ""
        if len(full) == 1:
            if tokens[full[0]] in self.lexicon:
                return tokens[full[0]], ""
            return (tokens[ones[0]] if ones else ""), tokens[full[0]]
        hits = [i for i in full if tokens[i] in self.lexicon] or [i for i in full if self.given(tokens[i])]
        if len(hits) != 1:
            g = full[-1] if comma or (upper[full[0]] and not upper[full[-1]]) else full[0]
            if len(hits) > 1 and g not in hits:
                g = hits[0]
        else:
            g = hits[0]
        rest = [i for i in full if i != g]
        family = tokens[rest[0] if g < rest[0] or comma else rest[-1]]
        if g != full[-1] and len(rest) > 1 and not comma:
            family = tokens[rest[0]]
        return self.given(tokens[g]) or tokens[g], family

    def name(self, name: str | None) -> tuple[str, str, str]:
        """(given, family, alias) of a name; an alias is a user name that cannot be read."""
        n = plain_name(name)
        if not n:
            return "", "", ""
        words = re.findall(r"[^\s.,_\-/|]+", n)
        upper = [w.isupper() and len(w) > 1 for w in words]
        t = self.tokens(n)
        if len(t) >= 2:
            if len(upper) != len(t):
                upper = [False] * len(t)
            g, f = self.pair(t, "," in n, upper)
            return g, f, ""
        return self.username(t[0], raw_token(n)) if t else ("", "", "")

    def username(self, t: str, raw: str) -> tuple[str, str, str]:
        base = re.sub(r"\d+$", "", t)
        if t in self.lexicon or len(t) < 4:
            return t if t in self.lexicon else "", "", ""
        if re.search(r"\d", t[:-2]) and not re.fullmatch(r"[a-z]{9,}\d+", t):
            return "", "", raw
        if got := self.split(base):
            return got[0], got[1], ""
        if len(base) >= 7 and base == t:
            return base[0], base[1:], raw
        return "", "", raw

    def mail(self, key: str) -> tuple[str, str, str]:
        """(given, family, alias) of an address in one spelling."""
        if not key:
            return "", "", ""
        local, _, domain = key.partition("@")
        if m := re.match(r"\d+\+(.+)", local):
            return "", "", raw_token(m[1])
        label = sound(re.sub(r"-laptop$", "", domain.split(".")[0]))
        parts = self.tokens(local)
        if not self.shared(domain):
            if local in ROLES:
                got = self.split(label)
                return (*got, "") if got else ("", label, "")
            if len(parts) == 1:
                return self.given(parts[0]) or parts[0], label, ""
        if len(parts) >= 2:
            parts[-1] = re.sub(r"\d+$", "", parts[-1]) or parts[-1]
            g, f = self.pair(parts, False, [False] * len(parts))
            return g, f, ""
        return self.username(parts[0], raw_token(local)) if parts else ("", "", "")


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def domain_bit(domain: str) -> int:
    return zlib.crc32(domain.encode("utf-8", "surrogatepass")) % DOMAIN_BITS


def lexicon_words(pairs: DataFrame) -> set[str]:
    """The words of (one, other) that stand beside many different words which themselves stand beside few.

    A given name stands beside many family names, a family name beside few given names, in a table of any size: a word is taken when
    it has ``LEAST_PARTNERS`` partners and ``LEAN`` times as many as its partners have on average. Words one letter away
    from a far more common one are typing errors of it.
    """
    p = materialise(pairs.select("one", "other").distinct(), "partners")
    n = p.groupBy("one").agg(F.count("*").alias("n"))
    many = n.where(F.col("n") >= LEAST_PARTNERS)
    around = p.join(n.select(F.col("one").alias("other"), F.col("n").alias("m")), "other").groupBy("one").agg(F.avg("m").alias("m"))
    taken = many.join(around, "one").where(F.col("n") >= LEAN * F.col("m")).orderBy(F.desc("n"), "one").limit(LEXICON_WORDS)
    count = {r["one"]: r["n"] for r in taken.select("one", "n").collect()}
    near: dict[str, int] = {}
    for w, k in count.items():
        for x in (w, *near_words(w)):
            near[x] = max(near.get(x, 0), k)
    return {w for w, k in count.items() if len(w) < 4 or max(near.get(x, 0) for x in (w, *near_words(w))) < TYPO * k}


def lexica(df: DataFrame, name: str, email: str) -> Reader:
    """The reader for a table: its given names and kinds of organisation, and its shared mail domains, over all rows."""
    rows = df.select(F.col(name).alias("n"), F.col(email).alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = Reader(set())
        for b in batches:
            out = []
            for n, e in zip(b["n"], b["e"]):
                t = plain.tokens(plain_name(n)) if isinstance(n, str) else []
                if len(t) == 2 and min(map(len, t)) >= 3:
                    out += [("w", t[0], t[1]), ("w", t[1], t[0])]
                k = mail_key(e if isinstance(e, str) else None)
                if k:
                    out.append(("d", str(domain_bit(k.partition("@")[2])), k.partition("@")[0]))
            yield pd.DataFrame(out, columns=["kind", "one", "other"])

    p = materialise(rows.mapInPandas(run, "kind string, one string, other string"), "tokens")
    domains = p.where("kind = 'd'").groupBy("one").agg(F.countDistinct("other").alias("n")).where(F.col("n") >= SHARED_MAILBOXES)
    bits = np.zeros(DOMAIN_BITS >> 3, dtype=np.uint8)
    for r in domains.select(F.col("one").cast("int")).collect():  # at most DOMAIN_BITS numbers
        bits[r[0] >> 3] |= 1 << (r[0] & 7)
    return Reader(lexicon_words(p.where("kind = 'w'")), bits)


def banding(similar: float = SIMILAR, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose collision curve 1 - (1 - s^rows)^bands reaches ``recall`` at ``similar``."""
    best = (hashes, 1)
    for r in range(1, 9):
        b = hashes // r
        if b and 1 - (1 - similar**r) ** b >= recall:
            best = (b, r)
    return best


def band_keys(text: str, bands: int, rows: int, seeds: np.ndarray) -> np.ndarray:
    """MinHash band keys over the padded q-grams of a word."""
    padded = "^" * (Q - 1) + text + "$" * (Q - 1)
    grams = np.array(sorted({hash64(padded[i : i + Q]) for i in range(len(padded) - Q + 1)}), dtype=np.uint64)
    h = ((grams[:, None] ^ seeds[None, :]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)
    low = h.min(0)[: bands * rows].reshape(bands, rows)
    mix = np.zeros(bands, dtype=np.uint64)
    for j in range(rows):
        mix = (mix ^ low[:, j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1)
    return (mix + np.arange(bands, dtype=np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)


def hash64(s: str) -> int:
    x = 0xCBF29CE484222325
    for b in s.encode():
        x = ((x ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 29)


def abbreviates(a: str, b: str) -> bool:
    """Whether the shorter word keeps the first and further letters of the longer one in order."""
    if len(a) > len(b):
        a, b = b, a
    if not a or a[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in a)


def given_fit(a: str, b: str) -> float:
    """How well two given names, initials or kinds of organisation agree: 0 is a contradiction, 0.7 says nothing is known."""
    if not a or not b:
        return 0.7
    if a == b:
        return 1.0 if len(a) > 1 else 0.9
    if len(a) == 1 or len(b) == 1:
        if a[0] == b[0]:
            return 0.9
        short, full = (a, b) if len(a) == 1 else (b, a)
        return 0.85 if short in initials(full) else 0.0
    if SHORT.get(a, set()) & ({b} | SHORT.get(b, set())) or a in SHORT.get(b, set()):
        return 0.97
    near = jaro_winkler(a, b)
    if near >= NEAR:
        return near
    return 0.93 if abbreviates(a, b) and min(len(a), len(b)) >= 3 else 0.0


def initials(g: str) -> set[str]:
    """First letters a given name may stand under: its own, those of the full names it shortens and of its short forms."""
    return {x[0] for x in (g, *SHORT.get(g, ()), *LONG.get(g, ())) if x}


def openings(g: str) -> set[str]:
    """The initials and, for names of four letters or more, the second letter, which a mistyped first letter leaves in place."""
    return initials(g) | ({g[1]} if len(g) >= 4 else set())


def letter_mask(letters: set[str]) -> int:
    return sum(1 << LETTERS.index(c) for c in letters)


def monge_elkan(a: list[str], b: list[str], inner) -> float:
    """Mean over the tokens of the shorter list of the best inner similarity in the other."""
    if len(a) > len(b):
        a, b = b, a
    return sum(max(inner(x, y) for y in b) for x in a) / len(a) if a else 0.0


def agree(g1: str, f1: str, g2: str, f2: str) -> float:
    """Similarity of two read names, 0 where they cannot be one person: Monge-Elkan over family and given name."""
    fam = jaro_winkler(f1, f2)
    if fam < NEAR or (fam < 1 and edits(f1, f2) > allowed(f1, f2)):
        return 0.0
    g = given_fit(g1, g2)
    if g == 0.0:
        return 0.0
    if fam < 1 and g < 0.85:
        return 0.0
    inner = lambda x, y: fam if x[0] == y[0] == "f" else g if x[0] == y[0] == "g" else 0.0
    one, two = [("f", f1)] + [("g", g1)] * bool(g1), [("f", f2)] + [("g", g2)] * bool(g2)
    return monge_elkan(one, two, inner)


def allowed(a: str, b: str) -> int:
    """Edits between two family names that may be one."""
    return 1 + (max(len(a), len(b)) > 9)


def edits(a: str, b: str) -> int:
    """Edit distance with neighbouring letters swapped at the cost of one."""
    prev2, prev = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        cur = [i]
        for j, d in enumerate(b, 1):
            x = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                x = min(x, prev2[j - 2] + 1)
            cur.append(x)
        prev2, prev = prev, cur
    return prev[-1]


def star_clusters(vertices: DataFrame, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(v, center) by star clustering of weighted edges (a, b, w), a < b; ``vertices`` are (v, size).

    Round by round, every vertex that has the largest (size, degree, smallest id) among its free neighbours becomes a
    center and its free neighbours its satellites, each of the center it resembles most. Vertices without
    edges are their own centers. Ties go to the smaller identifier, so the result does not depend on row order.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
    both = materialise(both, "star")
    deg = both.groupBy("u").agg(F.count("*").alias("deg"))
    rank = deg.join(vertices.select(F.col("v").alias("u"), "size"), "u").select("u", F.struct("size", "deg", (-F.col("u")).alias("neg")).alias("r"))
    rank = materialise(rank, "rank")
    free = materialise(both.join(rank, "u").withColumnRenamed("r", "ru").join(rank.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v"), "free", n=F.count(F.lit(1)))
    placed: DataFrame | None = None
    n = free.measured["n"]
    for _ in range(max_rounds):
        if n == 0:
            break
        top = free.groupBy("u", "ru").agg(F.max("rv").alias("best"))
        centers = materialise(top.where("ru > best").select("u"), "centers")
        sat = free.join(centers.select(F.col("u").alias("v")), "v").groupBy("u").agg(F.max(F.struct("w", "rv", "v")).alias("m")).select("u", F.col("m.v").alias("center"))
        step = materialise(sat.unionByName(centers.select("u", F.col("u").alias("center"))), "stars")
        placed = step if placed is None else placed.unionByName(step)
        gone = step.select("u")
        free = free.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti")
        free = materialise(free, "free", n=F.count(F.lit(1)))
        n = free.measured["n"]
    if n:
        raise RuntimeError(f"stars not complete after {max_rounds} rounds")
    done = placed if placed is not None else vertices.sparkSession.createDataFrame([], "u long, center long")
    return vertices.select("v").join(done.withColumnRenamed("u", "v"), "v", "left").select("v", F.coalesce("center", "v").alias("center"))


def meet(items: DataFrame, key: str, item: str, fits: Column | None = None) -> DataFrame:
    """(x, y): the distinct pairs x < y of items that share a key and, where given, for which ``fits`` holds.

    Keys of one item are dropped before the join; the items of a full bucket are dealt out in parts of ``BUCKET_PART``, each of which
    meets the whole bucket in a task of its own, so no task holds all pairs of a bucket.
    """
    full = items.select(F.col(key).alias("key"), F.col(item).alias("x")).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    full = materialise(full.select("key", "x", F.ceil(F.col("n") / BUCKET_PART).cast("int").alias("parts")), "buckets")
    left = full.select("key", "x", F.pmod(F.hash("x"), "parts").alias("part"))
    right = full.select("key", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["key", "part"]).where("x < y")
    return (pairs if fits is None else pairs.where(fits)).select("x", "y").distinct()


def by_size(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to as many tasks as a shuffle has, though its rows be few: each of them makes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def link_variants(df: DataFrame, key: str = "row_id", name: str = "author_name", email: str = "author_email", within: str = "project") -> DataFrame:
    """(key, entity, entity_rows): the rows that name one person or organisation share an entity, the smallest row of it.

    Rows with the same address, user name or full name are copies of one profile (connected components over shared keys, one edge a
    row); so are profiles that are read in exactly the same ways. Profiles are then compared through their spellings, the
    distinct (given, family) readings: padded q-grams of the family names are MinHash-banded, with the banding tuned on the collision
    curve, spellings that meet are links where they agree by Monge-Elkan, and star clustering turns links into entities.
    Equal family names meet in every band and are joined by name. Rows whose name and address both identify nobody have no entity
    and no row; a row that nothing else resembles is an entity of its own. Null, blank and repeated rows are allowed;
    equal rows of one project always share an entity. The table of members with their representative is the whole result;
    :func:`same_entity_pairs` spreads it into pairs.
    """
    reader = lexica(df, name, email)
    rows = df.select(F.col(key).alias("k"), F.col(name).alias("n"), F.col(email).alias("e"), F.col(within).alias("p"))

    def read_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, n, e, p in zip(b["k"], b["n"], b["e"], b["p"]):
                n, e = (x if isinstance(x, str) else None for x in (n, e))
                mk, pn = mail_key(e), plain_name(n)
                if not mk and not pn:
                    continue
                if mk:
                    out.append((k, "e:" + mk, None, None, 0, False))
                out.append((k, f"r:{p}|{pn}|{mk}", None, None, 0, False))
                for g, f, alias in (reader.name(n), reader.mail(mk)):
                    if alias and len(alias) >= 4:
                        out.append((k, "a:" + alias, None, None, 0, False))
                    if f and len(f) >= 3:
                        full = len(g) > 1
                        out.append((k, f"f:{g}|{f}" if full else None, g, f, letter_mask(initials(g)), bool(alias)))
                        if len(g) >= 3 and not alias and not reader.certain(g) and not reader.certain(f):  # the parts may stand in either order
                            out.append((k, None, f, g, letter_mask(initials(f)), False))
            yield pd.DataFrame(out, columns=["k", "link", "g", "f", "m", "guess"])

    read = materialise(rows.mapInPandas(read_rows, "k long, link string, g string, f string, m long, guess boolean"), "read")
    profile = connected_components(star_edges(read, "link", "k"))
    seen = read.select("k").distinct()
    profile = materialise(seen.join(profile, seen.k == profile.vertex, "left").select("k", F.coalesce("component", "k").alias("v")), "profiles")
    named = read.where("f IS NOT NULL")
    # a user name read as an initial and a family name counts only where that family name is known otherwise
    known = named.where("NOT guess").select("f").distinct()
    named = named.where("NOT guess").unionByName(named.where("guess").join(known, "f", "left_semi").select(named.columns))
    names = spellings(named.join(profile, "k").groupBy("v", "g", "f").agg(F.max("m").alias("m")))
    names = materialise(names, "names")
    # profiles read in the same ways, and in no other, are copies
    ways = names.groupBy("v").agg(F.count("*").alias("c"), F.sum(F.xxhash64("g", "f").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("f", "g")).alias("h2"))
    same = materialise(ways.select("v", F.concat_ws(" ", "c", "h1", "h2").alias("way")), "ways")
    edges = star_edges(same, "way", "v").select(F.col("a").alias("v"), F.col("b").alias("to"))
    profile = materialise(profile.join(edges, "v", "left").select("k", F.coalesce("to", "v").alias("v")), "profiles")
    names = materialise(names.join(edges.select("v"), "v", "left_anti"), "names")
    sizes = materialise(profile.groupBy("v").agg(F.count("*").alias("size")), "sizes")
    links = materialise(name_links(names), "links")
    stars = star_clusters(sizes, links)
    entity = materialise(profile.join(stars, "v").select("k", "center"), "entity")
    least = entity.groupBy("center").agg(F.min("k").alias("entity"), F.count("*").alias("n"))
    return entity.join(least, "center").select(F.col("k").alias(key), "entity", F.col("n").alias("entity_rows"))


def spellings(names: DataFrame) -> DataFrame:
    """(v, g, f) of (v, g, f, m) without those that say nothing new of their profile: an initial beside a full given name it may stand
    for, and a family name alone beside one with a given name. ``m`` holds the initials as bits."""
    w = Window.partitionBy("v", "f")
    full = F.bit_or(F.when(F.length("g") > 1, F.col("m")).otherwise(F.lit(0).cast("long"))).over(w)
    some = F.max(F.length("g")).over(w)
    n = names.withColumn("__full", full).withColumn("__some", some)
    new = (F.length("g") > 1) | ((F.length("g") == 1) & (F.col("m").bitwiseAND(F.col("__full")) == 0)) | ((F.length("g") == 0) & (F.col("__some") == 0))
    return n.where(new).select("v", "g", "f")


def near_families(forms: DataFrame) -> DataFrame:
    """(x, y): different family names of (g, f), x < y, within the edits :func:`agree` allows, some of whose given names may agree.

    The MinHash bands of a family name are keyed with the initials its given names may stand under, since names with differing families are
    linked only where the given names agree. Names that differ by one letter, or by two neighbours swapped, meet besides under the name with a
    letter left out, so short names, where the curve is low, and mistyped first letters of the given name lose nothing. Without
    a given name differing families are never linked, and need no band.
    """
    bands, width = banding()
    seeds = np.random.default_rng(11).integers(1, 2**63, size=HASHES, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = {c: np.uint64(hash64(c) | 1) for c in LETTERS}
        for b in batches:
            hs, fs, sizes = [], [], []
            for f, part in b.groupby("f", sort=False)["g"]:
                given = {g for g in part if g}
                first, all_ = {x for g in given for x in initials(g)}, {x for g in given for x in openings(g)}
                if not given:
                    continue
                keys = band_keys(f, bands, width, seeds)
                less = np.array([hash64("-" + x) for x in {f, *near_words(f)}], dtype=np.uint64)
                got = [(keys ^ mark[c]) * np.uint64(0x9E3779B97F4A7C15) for c in first] + [(less ^ mark[c]) * np.uint64(0xC2B2AE3D27D4EB4F) for c in all_]
                hs += got
                fs.append(f)
                sizes.append(sum(map(len, got)))
            h = np.concatenate(hs).view(np.int64) if hs else np.zeros(0, dtype=np.int64)
            yield pd.DataFrame({"h": h, "f": np.repeat(np.array(fs, dtype=object), sizes)})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [jaro_winkler(x, y) >= NEAR and edits(x, y) <= allowed(x, y) for x, y in zip(b["x"], b["y"])]
            yield b[pd.Series(keep, index=b.index, dtype=bool)]

    banded = by_size(forms, "f").mapInPandas(run, "h long, f string")
    # each edit changes the plain edit distance by two at most, a swap by two
    most = F.when(F.greatest(F.length("x"), F.length("y")) > 9, 2).otherwise(1)
    fits = (F.abs(F.length("x") - F.length("y")) <= most) & F.levenshtein("x", "y", 4).between(0, 2 * most)
    return by_size(meet(banded, "h", "f", fits)).mapInPandas(check, "x string, y string")


def name_links(names: DataFrame) -> DataFrame:
    """(a, b, w): profiles a < b whose names agree, from (v, g, f).

    Distinct (given, family) spellings, not profiles, are banded and compared; the profiles of agreeing
    spellings are then joined through the spelling. Initials may agree where full given names contradict each other: such profiles are not linked.
    """
    forms = materialise(names.select("g", "f").distinct(), "forms")
    near = materialise(near_families(forms), "near")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ks = [sorted(openings(g)) for g in b["g"]]
            n = [len(x) for x in ks]
            yield pd.DataFrame({"f": np.repeat(b["f"].to_numpy(), n), "i": pd.Series([x for k in ks for x in k], dtype="object"), "s": np.repeat((b["f"] + "|" + b["g"]).to_numpy(), n)})

    spelt = materialise(forms.mapInPandas(opened, "f string, i string, s string"), "spelt")
    within = meet(spelt.select(F.concat_ws("|", "f", "i").alias("fi"), "s"), "fi", "s")
    x = spelt.select(F.col("f").alias("x"), "i", F.col("s").alias("sx"))
    y = spelt.select(F.col("f").alias("y"), "i", F.col("s").alias("sy"))
    across = near.join(x, "x").join(y, ["y", "i"]).select(F.least("sx", "sy").alias("x"), F.greatest("sx", "sy").alias("y"))
    alone = forms.where("g = ''").select("f", F.concat("f", F.lit("|")).alias("x"))
    alone = alone.join(forms.where("g <> ''"), "f").select("x", F.concat_ws("|", "f", "g").alias("y"))
    pairs = within.unionByName(across).unionByName(alone).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            two = [(x.split("|"), y.split("|")) for x, y in zip(b["x"], b["y"])]
            w = np.array([agree(g1, f1, g2, f2) for (f1, g1), (f2, g2) in two], dtype=float)
            full = np.array([len(g1) > 1 and len(g2) > 1 for (_, g1), (_, g2) in two], dtype=bool)
            yield b.assign(w=w, full=full)[w >= MONGE]

    links = materialise(by_size(pairs).mapInPandas(verify, "x string, y string, w double, full boolean"), "spelling_links")
    own = names.select("v", F.concat_ws("|", "f", "g").alias("s"), F.length("g").alias("c"))
    own = materialise(own, "own")
    a, b = own.select(F.col("v").alias("a"), F.col("s").alias("x")), own.select(F.col("v").alias("b"), F.col("s").alias("y"))
    linked = links.join(a, "x").join(b, "y").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "full")
    # profiles that share a spelling: full given names, or initials of profiles that differ otherwise
    shared = meet(own.where("c > 1"), "s", "v").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("w"), F.lit(True).alias("full"))
    shared = shared.unionByName(meet(own.where("c <= 1"), "s", "v").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0.95).alias("w"), F.lit(False).alias("full")))
    scored = materialise(linked.unionByName(shared).groupBy("a", "b").agg(F.max("w").alias("w"), F.max("full").alias("full")), "scored")
    weak = scored.where("NOT full")
    kin = near.select(F.col("x").alias("fa"), F.col("y").alias("fb")).unionByName(near.select(F.col("y").alias("fa"), F.col("x").alias("fb")))
    whole = names.where("length(g) > 1").select("v", "f").distinct()
    wa, wb = whole.select(F.col("v").alias("a"), F.col("f").alias("fa")), whole.select(F.col("v").alias("b"), F.col("f").alias("fb"))
    kin = kin.unionByName(whole.select(F.col("f").alias("fa"), F.col("f").alias("fb")).distinct())
    against = weak.select("a", "b").join(wa, "a").join(kin, "fa").join(wb, ["b", "fb"]).select("a", "b").distinct()
    return scored.join(against, ["a", "b"], "left_anti").select("a", "b", "w")


def same_entity_pairs(entities: DataFrame, key: str = "row_id") -> DataFrame:
    """(row_id_a, row_id_b): all pairs of rows of one entity, smaller key first.

    The pairs are what is asked for; the rows of a large entity are dealt out in parts of ``BUCKET_PART``, so its pairs are made by many tasks.
    """
    e = entities.where("entity_rows > 1").withColumn("parts", F.ceil(F.col("entity_rows") / BUCKET_PART).cast("int"))
    left = e.select(F.col(key).alias("row_id_a"), "entity", F.pmod(F.hash(key), "parts").alias("part"))
    right = e.select(F.col(key).alias("row_id_b"), "entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["entity", "part"]).where("row_id_a < row_id_b").select("row_id_a", "row_id_b")
