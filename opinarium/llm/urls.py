"""URL filters: a blocked Bloom filter, then an exact hash join. DataFrame functions only.

Entries are canonical prefixes, host and path as in ``example.com/en/``: one
fits the URLs of its host and all subdomains whose path starts with its path.
The filter holds all entries' keys in blocks of eight 64-bit words, one bit
in each; it is a small table joined by block number. Each distinct URL
is expanded to the keys that could fit it (host suffixes of as many labels,
and path prefixes of as many characters, as occur among the entries), the
filter passes the possible hits, and an exact join with the entries removes
its false positives.

Named rules are held against host and path as they are. The list is held
against their canonical form: no user, port or final dot, and / for an empty
path, so that a listed host's bare address is blocked, too.

Null URLs and such without ``://`` have an empty host and path and fit
nothing; repeated rows get equal verdicts; an empty table gives an empty
table; of equally long entries the one that comes last in text order counts;
columns of df named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

ENTRY = "key string, action string, named boolean"
WORDS = 8
BITS_PER_ENTRY = 16
#: Entries and filters up to this many entries (under 10 MB) are broadcast; beyond it both are shuffled.
BROADCAST_ENTRIES = 100_000


def host_of(url: str) -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def entries(spark: SparkSession, rules: list[tuple[str, str]], listed: list[str]) -> DataFrame:
    """Rules (action, key) have names; listed keys are blocked without one."""
    rows = [(key, action, True) for action, key in rules] + [(key, "block", False) for key in listed]
    return spark.createDataFrame(rows, ENTRY)


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))


def _bit(key: str, word: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 1), {6 * word}) & 63 as int))")


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) for keys (key)."""
    return keys.groupBy(_block("key", blocks).alias("block")).agg(*(F.bit_or(_bit("key", i)).alias(f"w{i}") for i in range(WORDS)))


def judge(df: DataFrame, given: DataFrame, url: str = "url") -> DataFrame:
    """df with host, path, rule and verdict; given: rows of ENTRY."""
    n = given.count()
    small = F.broadcast if n <= BROADCAST_ENTRIES else lambda x: x
    blocks = 1 << max(0, (n * BITS_PER_ENTRY // (64 * WORDS)).bit_length())
    # How many labels and characters entries' hosts and paths have: few numbers, however many entries.
    of = lambda size: sorted(r[0] for r in given.select(size).distinct().collect())
    lengths, depths = of(F.expr("length(key) - instr(key, '/') + 1")), of(F.size(F.split(F.substring_index("key", "/", 1), r"\.")))
    given = given.withColumn("size", F.length("key"))

    pages = df.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(url), "path": path_of(url)})
    # A verdict depends on host and path: each pair is judged once, however many rows have it.
    distinct = pages.where("host <> ''").select("host", "path").distinct()
    plain = F.regexp_replace("host", r"^.*@|\.?(:[0-9]*)?$", "")
    forms = distinct.withColumns({"plain": plain, "full": F.when(F.col("path") == "", "/").otherwise(F.col("path"))})
    one = lambda h, p, named, listed: F.struct(F.col(h).alias("h"), F.col(p).alias("p"), named.alias("for_named"), listed.alias("for_list"))
    both = (F.col("host") == F.col("plain")) & (F.col("path") == F.col("full"))
    forms = forms.withColumn("form", F.explode(F.array_compact(F.array(one("host", "path", F.lit(True), both), F.when(~both, one("plain", "full", F.lit(False), F.lit(True)))))))
    labels = F.split("form.h", r"\.")
    some = lambda values: F.explode(F.array_compact(F.array(*values) if values else F.array(F.lit(None).cast("string"))))
    forms = forms.withColumn("suffix", some([F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in depths]))
    forms = forms.withColumn("prefix", some([F.when(F.length("form.p") >= n, F.substring("form.p", 1, n)) for n in lengths]))
    keys = forms.select("host", "path", "form.for_named", "form.for_list", F.concat("suffix", "prefix").alias("key"))
    possible = keys.withColumn("block", _block("key", blocks)).join(small(bloom(given, blocks)), "block")
    for i in range(WORDS):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(_bit("key", i)) != 0)
    hits = possible.select("host", "path", "for_named", "for_list", "key").join(small(given), "key").where(F.when(F.col("named"), F.col("for_named")).otherwise(F.col("for_list")))
    best = lambda what: F.max(F.when(what, F.struct("size", "key", "action")))
    verdicts = hits.groupBy("host", "path").agg(best(F.col("named")).alias("best"), F.coalesce(F.max(~F.col("named")), F.lit(False)).alias("listed"))
    verdicts = written(verdicts.select("host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict")), "verdicts")
    # Verdicts grow with the URLs, so they are never broadcast.
    return pages.join(verdicts.hint("merge"), ["host", "path"], "left").select(*pages.columns, "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
