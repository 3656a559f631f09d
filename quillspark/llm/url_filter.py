"""Operator 2: URL rules decided by a cascade of Bloom filters [native].

A rule lists a host and a path prefix. The *keys* of a URL are its host and
parent hosts, each with every path prefix as long as some rule's. A cascade
tells listed keys from all other keys of the corpus exactly: level 1 encodes
the listed keys, level 2 the corpus's other keys that level 1 lets through,
level 3 the listed keys that level 2 lets through, and so on until nobody
passes. What is judged must be the table that the cascade was built over (its
key universe), as the operator does.

Level 1's size follows from the number of listed keys and of the universe's
distinct keys (estimated in one scan), so that about as many other keys pass
as are listed; if more than ``ROOM`` times as many do, it is rebuilt with four
times the bits. So level 2 and all later ones are bounded by the number of
rules, not by the corpus. One more scan finds what passes the first levels of
all verdicts. Everything runs as DataFrame expressions; the filters are
literals, so judging a page needs no join and no shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule. Extra columns are dropped from the result, so names can't clash.
Repeated rows are judged each for itself. Equal rules given twice: the first
counts. Very long urls are judged whole; they have as many keys as their host
has labels, times the different lengths of the rules' paths. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits that a key sets in a level; keys that may pass level 1, per listed key.
HASHES, ROOM = 3, 16


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return f"{self.host}{self.path}"


#: Production rules.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The keys that rules of these path lengths could list. A key is host,
    a newline, and the path's prefix: neither side can hide the border."""
    lengths = sorted({len(r.path) for r in rules}) or [0]
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length(path) >= n)
    return F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.concat(h, F.lit("\n"), F.substring(path, F.lit(1), n)))))


def listed_key(rule: Rule) -> str:
    return f"{rule.host}\n{rule.path}"


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``size`` bits as longs of 32 bits each."""

    words: tuple[int, ...]
    size: int
    salt: int

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for at in positions(key, self.size, self.salt):
            out = out & (F.get(words, F.shiftright(at, 5).cast("int")).bitwiseAND(F.expr("1L").cast("bigint") * F.pow(F.lit(2.0), at % 32).cast("bigint")) != 0)
        return out


def positions(key: Column, size: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt * HASHES + i), key), F.lit(size)) for i in range(HASHES)]


def level_of(keys: DataFrame, salt: int, bits_per_key: float) -> Level:
    """Encode ``keys`` (a column ``key``). The driver gets the filter's words only."""
    n = keys.count()
    size = max(64, int(n * bits_per_key))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), size, salt))).alias("at"))
    rows = at.groupBy((F.shiftright("at", 5)).alias("i")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("at") % 32).cast("bigint")).alias("w")).collect()
    words = [0] * ((size + 31) // 32)
    for r in rows:
        words[r["i"]] = r["w"]
    return Level(tuple(words), size, salt)


def first_bits(n_listed: int, n_universe: int) -> float:
    """Bits a key of level 1, so that about ``n_listed`` other keys pass: a
    key passes where all of its positions are set, HASHES * n / size each."""
    share = min(0.125, n_listed / max(n_listed, n_universe))
    return HASHES / share ** (1 / HASHES)


def member(levels: list[Level], key: Column) -> Column:
    """Whether the cascade holds the key: exact on the corpus's keys.

    A key is in unless its first missing level is an odd one; if it passes
    all levels, it belongs to the last one's side."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~level.has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def cascades(universe: DataFrame, listed: dict[str, list[str]]) -> dict[str, list[Level]]:
    """For each name, the levels that tell its listed keys from every other
    key of ``universe`` (a column ``key``, repeated as it may be).

    The universe is scanned twice, whatever the number of names: for its size,
    and through all first levels. What passes is deduplicated with a map-side
    combine; the later levels use only that.
    """
    listed = {name: sorted(set(keys)) for name, keys in listed.items() if keys}
    if not listed:
        return {}
    spark = universe.sparkSession
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    mine = {name: spark.createDataFrame([(k,) for k in keys], "key string") for name, keys in listed.items()}
    bits = {name: first_bits(len(keys), size) for name, keys in listed.items()}
    out: dict[str, list[Level]] = {}
    while len(out) < len(listed):
        first = {name: level_of(mine[name], 100 * i, bits[name]) for i, name in enumerate(listed) if name not in out}
        passes = F.array(*(F.when(level.has(F.col("key")), F.lit(name)) for name, level in first.items()))
        passed = universe.select("key", F.array_compact(passes).alias("names")).where(F.size("names") > 0)
        passed = written(passed.groupBy("key").agg(F.any_value("names").alias("names")), "url-keys")
        for name, level in first.items():
            others = passed.where(F.array_contains("names", name)).join(F.broadcast(mine[name]), "key", "left_anti").select("key")  # the rules: a parameter
            if others.count() > ROOM * len(listed[name]):
                bits[name] *= 4
            else:
                out[name] = _levels(level, mine[name], others)
    return out


def _levels(first: Level, listed: DataFrame, others: DataFrame) -> list[Level]:
    levels, sides, side = [first], [others, listed], 0
    while True:
        passed = sides[side].where(levels[-1].has(F.col("key")))
        if passed.isEmpty():
            return levels
        sides[side] = passed
        levels.append(level_of(passed, first.salt + len(levels), 4.0))
        side = 1 - side


def _hits(keys: Column, levels: list[Level], verdict: str) -> Column:
    held = F.filter(keys, lambda k: member(levels, k))
    return F.transform(held, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict")))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    The longest fitting rule decides; without one the cascade finds no listed
    key and the page is allowed.
    """
    rules = tuple({listed_key(r): r for r in reversed(rules)}.values())
    base = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = F.explode(F.array_distinct(keys_of(F.col("host"), F.col("path"), rules)))
    built = cascades(base.select(found.alias("key")), {v: [listed_key(r) for r in rules if r.verdict == v] for v in sorted({r.verdict for r in rules})})
    keys = F.array_distinct(keys_of(F.col("host"), F.col("path"), rules))
    ranked = [_hits(keys, levels, v) for v, levels in built.items()]
    if not ranked:
        return base.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    best = F.array_max(F.concat(*ranked))
    return base.withColumn("best", best).select(
        key, "host", "path",
        F.replace(F.col("best.key"), F.lit("\n"), F.lit("")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production rules over all pages."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The contract's rules, stated apart from RULES.
ORACLE = f"""
WITH rules(rh, rp, rv) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
),
q AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM p
),
m AS (
  SELECT q.page_id, q.host, q.path, rh || rp AS rule, rv,
    row_number() OVER (PARTITION BY q.page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS rn
  FROM q LEFT JOIN rules ON (q.host = rh OR ends_with(q.host, '.' || rh)) AND starts_with(q.path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE rn = 1
"""
