"""URL rules answered by a Bloom filter cascade, in SQL expressions only.

Keys are a host suffix followed by a path prefix, at the label counts and prefix lengths that occur in the rules. Level 0 encodes
the listed keys; level 1 the keys of the corpus's whole key universe that level 0 wrongly accepts; level 2 the listed keys that
level 1 accepts, and so on until a level errs on no key of the universe. Membership of any key of the universe is then exact, without joins.
Bit arrays stay on the plan as literals; their size follows the rule list, not the corpus: level 0 has a false-positive rate of
about listed / universe, so about as many keys as are listed reach level 1. Longer lists are taken in parts of ``PART_KEYS`` keys, one
after the other with the verdicts so far written between them, so that no literal exceeds a few megabytes.

Null urls and urls without ``://`` have empty host and path, and fit no rule. Rows are judged one by one: null ids and repeated rows stay as
they are. Of an allowing and a blocking rule with the same key the blocking one wins. An empty table gives no rows. Urls of any length are
judged whole. Columns named host, path, rule or verdict are replaced; others may have any name.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Most rules whose filters are on the plan at once.
PART_KEYS = 250_000

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _literal(values: list, type_: str):
    """A list as one literal; the optimizer parses it once."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{type_}>")


class Level:
    """One Bloom filter: ``bits`` positions in 64-bit words and ``hashes`` probes by double hashing."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        self.seed, self.hashes = seed, max(1, round(-math.log2(rate)))
        self.bits = max(64, -(-math.ceil(-n * math.log(rate) / math.log(2) ** 2) // 64) * 64)
        at = keys.select(F.explode(F.array(*self._probes(F.col("key")))).alias("p"))
        rows = at.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).collect()
        words = [0] * (self.bits // 64)
        for r in rows:  # at most bits / 64 of them
            words[r["w"]] = r["v"]
        self.words = words

    def _probes(self, key):
        h = F.xxhash64(key, F.lit(self.seed))
        a, b = F.pmod(h, F.lit(2_147_483_647)), F.pmod(F.shiftright(h, 32), F.lit(self.bits))
        return [F.pmod(a + b * j + F.lit(j * j), F.lit(self.bits)) for j in range(self.hashes)]

    def holds(self, key):
        words = _literal(self.words, "bigint")
        found = None
        for p in self._probes(key):
            bit = F.get(words, (p / 64).cast("int"))
            one = F.call_function("shiftrightunsigned", bit, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
            found = one if found is None else found & one
        return found


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (one string column, key; distinct)."""

    def __init__(self, universe: DataFrame, listed: list[str], seed: int = 0):
        self.levels: list[Level] = []
        if not listed:
            return
        members = _rows(universe.sparkSession, listed)
        # the universe without the listed keys, by counting rather than by a join
        marked = universe.select("key", F.lit(0).alias("m")).unionByName(members.select("key", F.lit(1).alias("m"))).groupBy("key").agg(F.max("m").alias("m"))
        outside = materialize(marked.where("m = 0").select("key"), "universe")
        inside, n, others = members, len(set(listed)), outside.count()
        rate = min(0.5, max(1e-6, n / max(1, n + others)))
        while n:
            self.levels.append(level := Level(inside, n, rate, seed + len(self.levels)))
            wrong = materialize(outside.where(level.holds(F.col("key"))), "accepted")
            inside, outside, n, rate = wrong, inside, wrong.count(), 0.5

    def holds(self, key):
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def _rows(spark: SparkSession, listed: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(_literal(sorted(set(listed)), "string")).alias("key"))


def split_url(url) -> tuple:
    """Host, with A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format(f"`{url}`"))) if isinstance(url, str) else url
    part = lambda i: F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def candidate_keys(rules, host="host", path="path"):
    """All keys of a url that a rule of these shapes could equal."""
    labels, lengths = max(r[1].count(".") + 1 for r in rules), sorted({len(r[2]) for r in rules})
    count = F.regexp_count(host, F.lit("\\.")) + 1
    hosts = [F.when(count >= n, F.substring_index(host, ".", -n)) for n in range(1, labels + 1)]
    paths = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_compact(F.array(*[F.when(h.isNotNull() & p.isNotNull(), F.concat(h, p)) for h in hosts for p in paths]))


def _longest(cascade: Cascade, act: str):
    return F.array_max(F.transform(F.filter("keys", cascade.holds), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(act).alias("act"))))


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow", url_column: str = "url", part_keys: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict; columns of those names are replaced.

    The longest rule that fits wins; where none does the key is in no list and the verdict is ``default``."""
    host, path = split_url(url_column)
    others = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parted = pages.select(F.struct(*others).alias("page"), host.alias("host"), path.alias("path"))
    keyed = parted.withColumns({"keys": candidate_keys(rules), "best": F.lit(None).cast("struct<n: int, key: string, act: string>")})
    universe = materialize(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    size = part_keys or PART_KEYS
    for at in range(0, len(rules), size):
        if at:
            keyed = materialize(keyed, "judged")
        part = rules[at : at + size]
        for i, act in enumerate(("allow", "block")):
            listed = [h + p for b, h, p in part if b == act]
            if listed:
                keyed = keyed.withColumn("best", F.greatest("best", _longest(Cascade(universe, listed, 1000 * i), act)))
    return keyed.select("page.*", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.act", F.lit(default)).alias("verdict"))


def op5_url_cascade(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = """
with a as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages),
b as (select page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(r, ''), '^([^/?#]*)([^?#]*)', 2) as path from a),
c as (select *, case
  when ends_with('.' || host, '.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
  when ends_with('.' || host, '.example.com') and starts_with(path, '/en/') then 'example.com/en/'
  when ends_with('.' || host, '.net') and starts_with(path, '/es/') then 'net/es/'
  when ends_with('.' || host, '.net') and starts_with(path, '/fr/') then 'net/fr/'
  when ends_with('.' || host, '.com') and starts_with(path, '/') then 'com/' end as rule from b)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from c
"""
