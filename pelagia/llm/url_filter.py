"""URL filters by a Bloom filter cascade, in DataFrame functions alone.

Rules name a host and a path prefix (`example.com/en/`). A page offers a bounded number of keys: every
suffix of its host joined with as many characters of its path as some rule's path has. A cascade of Bloom
filters decides which of these keys are rules: the first level holds the rules, the second those other keys
of the whole corpus that the first lets through, the third the rules that the second lets through, and so on
until a level lets nothing wrong through. Over the universe from which it was built the answer is exact, so
no page is joined with the rules. A second cascade over the rules themselves tells block from allow.

Sizes: the first level has about 1.44 * log2(universe / rules) bits a rule, the later ones a few bits for
each key they hold, so what travels in the plan grows with the rules and the logarithm of the corpus: one binary literal a
level, of seven bits a byte (so that a byte is a character, which built-in functions turn into a number). Over `max_bits`
in all (about 38 MB) or `max_levels` the builder raises, and the caller should split the rules.

Defined cases: null url, or one without `://`: host and path empty, no rule, verdict `allow` (not listed).
Empty table: no rows. Repeated rows: each judged. Other columns do not matter; clashing names are dropped
before use. Between fitting rules the longest host + path wins; of rules of one length, that with the longest host.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import materialise, table

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    packed: bytes  # 7 bits a byte, lowest first


def _position(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1000 * level + i)), F.lit(bits))


def _passes(key: Column, level: int, f: Level) -> Column:
    packed = F.lit(f.packed)
    hit = F.lit(True)
    for i in range(f.hashes):
        at = _position(key, level, i, f.bits)
        seven = F.ascii(F.substring(packed, (F.floor(at / 7) + 1).cast("int"), F.lit(1)).cast("string"))
        hit = hit & (F.call_function("shiftright", seven, (at % 7).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return hit


def _fill(keys: DataFrame, level: int, bits: int, hashes: int) -> Level:
    """A level with all keys set: positions become words of 56 bits by bit_or, before the shuffle; the driver gets these
    words (no more than the level has)."""
    at = F.explode(F.array(*[_position(F.col("key"), level, i, bits) for i in range(hashes)]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 56).cast("int"))
    got = (
        keys.select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / 56).cast("int").alias("w"))
        .agg(F.bit_or(one).alias("bits"))
        .toLocalIterator()
    )
    packed = bytearray(8 * (-(-bits // 56)))
    for w, word in got:
        for k in range(8):
            packed[8 * w + k] = word >> 7 * k & 127
    return Level(bits, hashes, bytes(packed))


def cascade(listed: DataFrame, universe: DataFrame, max_bits: int = 1 << 28, max_levels: int = 40) -> list[Level]:
    """Levels that separate the keys of `listed` from all other keys of `universe` (both: column key).

    The driver gets counts and bit words, never keys."""
    inside = listed.select("key").filter("key IS NOT NULL").distinct()
    r, s = inside.count(), max(universe.count(), 1)
    if not r:
        return []
    levels: list[Level] = []
    hold, test = inside, universe.join(F.broadcast(inside) if r <= 100_000 else inside, "key", "left_anti")
    rate = min(0.5, r * math.sqrt(0.5) / s)
    for k in range(max_levels):
        n = hold.count()
        bits = max(64, math.ceil(n * 1.4427 * math.log2(1 / rate)))
        if bits + sum(x.bits for x in levels) > max_bits:
            raise ValueError(f"cascade: over {max_bits} bits; split the rules or raise max_bits")
        hashes = max(1, round(math.log2(1 / rate)))
        levels.append(_fill(hold, k, bits, hashes))
        wrong = test.filter(_passes(F.col("key"), k, levels[-1]))
        if wrong.isEmpty():
            return levels
        hold, test, rate = wrong, hold, 0.5
    raise RuntimeError(f"cascade: keys are left after {max_levels} levels")


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level that stops it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(~_passes(key, k, levels[k]), F.lit(k % 2 == 1)).otherwise(out)
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), after


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix that starts at a label, with the first characters of the path for each rule length."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
    )
    none = F.array().cast("array<string>")

    def with_path(n: int) -> Column:
        return F.when(F.length(path) >= n, F.transform(suffixes, lambda h: F.concat(h, F.left(path, F.lit(n))))).otherwise(none)

    return F.when(host != "", F.concat(none, *map(with_path, lengths))).otherwise(none)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judges page_id, url of `pages` by `rules` (host, path, verdict); returns page_id, host, path, rule, verdict."""
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict").dropDuplicates(["key"])
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    keyed = split.withColumn("_keys", keys_of(F.col("host"), F.col("path"), lengths))
    # written once: every level of the cascade reads it again
    universe = materialise(keyed.select(F.explode("_keys").alias("key")).union(listed.select("key")).distinct())
    levels = cascade(listed.select("key"), universe)
    block = cascade(listed.filter("verdict = 'block'").select("key"), listed.select("key"))
    if not levels:
        rule = F.lit(None).cast("string")
    else:
        hits = F.filter("_keys", lambda k: member(k, levels))
        rule = F.aggregate(
            hits,
            F.lit(None).cast("string"),
            lambda best, k: F.when(best.isNull() | (F.length(k) > F.length(best)), k).otherwise(best),
        )
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).otherwise(
        F.when(member(F.col("rule"), block), F.lit("block")).otherwise(F.lit("allow")) if block else F.lit("allow")
    )
    return keyed.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")
    return url_filter(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), fit AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""
