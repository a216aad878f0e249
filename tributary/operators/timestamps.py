"""Text timestamps in many notations to UTC instants, through a dictionary of distinct texts."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.hotjoin import HOT_PARTS
from tributary.session import discard, materialise, scratch_path

# Months by their English abbreviation.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Hours from UTC of the zone abbreviations that are read.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6,
    "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "JST": 9,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"\s*([+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{1,4})?\s*(?:\[([A-Za-z_/+\-0-9]+)\])?"
_SPACE = r"(?U)^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+$"

#: (pattern, template): the template puts year|month|day|hour|minute|second|fraction|am/pm|zone|region.
NOTATIONS: list[tuple[str, str]] = [
    # 2020-06-21 09:37:38 +0000, 2014/08/17 18:45:27, 2024-02-08T05:07:05+00:00[Europe/London], 2011-08-06
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[Tt]|,?\s+){_CLOCK}\s*([AaPp][Mm])?{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    # 20160708T110241+0530, 20160708
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ](\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    # 11.02.2012 00:57:24: day first
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:(?:[Tt]|,?\s+){_CLOCK}\s*([AaPp][Mm])?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    # 03/29/2021 07:50 PM: month first
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:(?:[Tt]|,?\s+){_CLOCK}\s*([AaPp][Mm])?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    # Wed, 14 Nov 2012 23:53:07 +1100; 11 Apr 2015, 20:28:00
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]+([A-Za-z]{{3}})[a-z]*\.?[\s,-]+(\d{{4}})(?:(?:[Tt]|,?\s+){_CLOCK}\s*([AaPp][Mm])?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    # Thu Dec 24 12:07:09 2015 +1100
    (rf"^[A-Za-z]{{3,9}},?\s+([A-Za-z]{{3}})[a-z]*\s+(\d{{1,2}})\s+{_CLOCK}\s+(\d{{4}}){_ZONE}$", "$7|$1|$2|$3|$4|$5|$6||$8|$9"),
    # Dec 24, 2015 12:07:09
    (rf"^([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:(?:[Tt]|,?\s+){_CLOCK}\s*([AaPp][Mm])?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
]
_EPOCH = r"^(-?\d{9,19})(?:\.(\d{1,6})\d*)?(?:\s+[+-]\d{2}:?\d{2})?$"


def parse_instants(df: DataFrame, raw: str, zone: str, out: str) -> DataFrame:
    """``df`` with ``out``: microseconds since 1970-01-01 UTC that the text ``raw`` denotes, or null.

    ``zone`` (IANA) holds for texts without zone or offset: a local time that occurs twice means the
    earlier instant, a skipped one is read with the offset in force before the jump. Nine to eleven
    digits are seconds since 1970, up to thirteen milliseconds, up to sixteen microseconds, beyond that
    nanoseconds; an offset behind them changes nothing. Null, blank, placeholder and impossible texts
    (30 February, 25 o'clock, 13 PM, unknown zone) give null, and so does a text without zone whose row has none.
    The steps are separate projections, so each text is matched once.
    """
    t = F.col("__t")
    canon = F.lit(None).cast("string")
    for pattern, template in reversed(NOTATIONS):
        canon = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, template)).otherwise(canon)
    names = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(str(i + 1)))])
    zones = F.create_map(*[x for k, h in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(h * 60))])
    p = [F.col("__p").getItem(i) for i in range(10)]
    num = lambda i: F.when(p[i] == "", 0).otherwise(p[i].try_cast("int"))
    df = df.withColumn("__t", F.regexp_replace(raw, _SPACE, "")).withColumn("__p", F.split(canon, "\\|"))
    df = df.withColumns({
        "__day": F.concat_ws("-", p[0], F.when(p[1].rlike("^[0-9]"), p[1]).otherwise(F.coalesce(names[F.lower(p[1])], F.lit("x"))), p[2]).try_cast("date"),
        "__h": num(3), "__m": num(4), "__s": num(5), "__f": F.substring(F.rpad(p[6], 6, "0"), 1, 6).cast("long"),
        "__half": F.lower(p[7]), "__off": F.regexp_replace(p[8], ":", ""), "__at": F.when(p[9] != "", p[9]).otherwise(F.col(zone)),
        "__whole": F.regexp_extract(t, _EPOCH, 1),
    })
    hour = (
        F.when(F.col("__half") == "", F.when(F.col("__h") < 24, F.col("__h")))
        .when(F.col("__h").between(1, 12), F.col("__h") % 12 + F.when(F.col("__half") == "pm", 12).otherwise(0))
    )
    size = F.substring("__off", 2, 2).try_cast("int") * 60 + F.when(F.length("__off") > 3, F.substring("__off", 4, 2).try_cast("int")).otherwise(0)
    part = F.rpad(F.regexp_extract(t, _EPOCH, 2), 6, "0").cast("long")
    df = df.withColumns({
        "__local": F.when((F.col("__m") < 60) & (F.col("__s") < 60), ((F.unix_date("__day").cast("long") * 24 + hour) * 60 + F.col("__m")) * 60_000_000 + F.col("__s").cast("long") * 1_000_000 + F.coalesce("__f", F.lit(0))),
        "__minutes": F.when(F.col("__off").rlike("^[+-]"), F.when((size <= 18 * 60) & (size % 60 < 60), F.when(F.col("__off").startswith("-"), -size).otherwise(size))).otherwise(zones[F.upper("__off")]),
        "__at": F.when(F.col("__at").isin(*sorted(available_timezones())), F.col("__at")),
        "__n": F.when(F.col("__whole") != "", F.col("__whole").cast("decimal(20,0)")), "__w": F.length(F.regexp_replace("__whole", "-", "")), "__part": part,
    })
    wall = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__local"), F.col("__at")))
    civil = F.when(F.col("__off") != "", F.col("__local") - F.col("__minutes").cast("long") * 60_000_000).when(F.col("__at").isNotNull(), wall)
    n, w = F.col("__n"), F.col("__w")
    epoch = F.when(w <= 11, n * 1_000_000 + F.col("__part")).when(w <= 13, n * 1000).when(w <= 16, n).otherwise(F.floor(n / 1000))
    df = df.withColumn(out, F.when(F.col("__p").isNotNull(), civil).when(w > 8, epoch.try_cast("long")))
    return df.drop("__t", "__p", "__day", "__h", "__m", "__s", "__f", "__half", "__off", "__at", "__whole", "__local", "__minutes", "__n", "__w", "__part")


class InstantDictionary:
    """A table of every distinct (text, zone) and its instant, kept in a folder and only ever added to.

    ``update`` parses what the table does not hold yet, so a text is parsed once over the table's life;
    ``apply`` brings the instants back to the rows of the last update. Distinct texts are gathered with map-side
    combining, so a text that a third of all rows repeat costs one row per task; the join back is keyed on
    (text, zone) with the hot texts of these rows, not of the table, split off.
    """

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "instants")
        self.batch: DataFrame | None = None  # (__raw, __zone, __rows) of the last update

    def table(self) -> DataFrame:
        return self.spark.read.schema("__raw string, __zone string, __rows long, __micros long").parquet(self.path)

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def update(self, rows: DataFrame, raw: str, zone: str) -> None:
        keys = rows.where(F.col(raw).isNotNull()).groupBy(F.col(raw).alias("__raw"), F.coalesce(F.col(zone), F.lit("")).alias("__zone")).agg(F.count("*").alias("__rows"))
        if self.exists():
            if self.batch is not None:
                discard(self.batch)
            self.batch = materialise(keys, "batch")
            keys = self.batch.join(self.table().select("__raw", "__zone"), ["__raw", "__zone"], "left_anti")
        parse_instants(keys, "__raw", "__zone", "__micros").write.mode("append").parquet(self.path)
        if self.batch is None:  # the first update wrote all it saw
            self.batch = self.table()

    def apply(self, rows: DataFrame, raw: str, zone: str, out: str) -> DataFrame:
        """``rows`` with ``out``: the instant in microseconds, or null. Every row is kept once; the rows are read once."""
        d, batch = self.table(), self.batch if self.batch is not None else self.table()
        total = batch.agg(F.sum("__rows")).first()[0] or 0
        hot = batch.where(F.col("__rows") >= max(2, -(-total // HOT_PARTS))).select("__raw", "__zone")  # at most HOT_PARTS rows
        hot = d.join(F.broadcast(hot), ["__raw", "__zone"]).select("__raw", "__zone", F.col("__micros").alias("__hot"), F.lit(True).alias("__is_hot"))
        k = rows.withColumn("__raw", F.col(raw)).withColumn("__zone", F.coalesce(F.col(zone), F.lit("")))
        k = k.join(F.broadcast(hot), ["__raw", "__zone"], "left")
        # rows of hot texts, and rows without a text, go through the join under keys of their own, which match nothing there
        settled = F.col("__is_hot").isNotNull() | F.col("__raw").isNull()
        k = k.withColumn("__raw", F.when(F.col("__raw").isNull(), "").otherwise(F.col("__raw")))
        k = k.withColumn("__apart", F.when(settled, F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) + 1).otherwise(F.lit(0)))
        cold = d.select("__raw", "__zone", F.lit(0).cast("long").alias("__apart"), "__micros")
        k = k.join(cold, ["__raw", "__zone", "__apart"], "left")
        return k.select(*rows.columns, F.coalesce("__hot", "__micros").alias(out))


def normalise_instants(rows: DataFrame, raw: str, zone: str, out: str = "utc_micros", dictionary: InstantDictionary | None = None) -> DataFrame:
    """``rows`` with ``out``, the instant of ``raw`` in microseconds since 1970-01-01 UTC.

    With ``dictionary`` the table of distinct texts is kept from call to call; without it one is made
    for this call. Extra columns are kept as they are; an empty table gives an empty table.
    """
    d = dictionary or InstantDictionary(rows.sparkSession)
    d.update(rows, raw, zone)
    return d.apply(rows, raw, zone, out)
