"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

DataFrame functions only.  The list is hashed into blocks of 256 bits (8 words of 32, one bit in each),
built with bit_or aggregates.  A URL whose block lacks one of its bits isn't listed; the possible hits
go to an exact hash join with the list, which removes false positives.  The filter is broadcast only
while it has at most ``BROADCAST_BLOCKS`` blocks; a larger one is joined by block number.  URLs are read
once; in both joins the URLs of one key are dealt to ``SALTS`` tasks, and those that can't be listed to
all tasks, so neither a popular URL nor the rest gathers in one.

Null urls and urls without ``://``: empty host and path, no rule, not listed (allow).  Repeated rows
give repeated results; an empty list blocks nothing; an empty table gives no rows; URLs of any length
take linear time; a kept column named like a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import kept, written

BITS_A_KEY = 16
BROADCAST_BLOCKS = 1 << 17
WORDS = 8
#: Tasks to which the URLs of one key are dealt, and those that can't be listed.
SALTS, SPREAD = 16, 1024
#: Parameters of a query that don't tell one page from another.
TRACKING = r"^(?:utm(?:_[a-z]+)?|fbclid|gclid|ref)(?:=|$)"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def query(url: Column) -> Column:
    """The parameters after the first ? up to # or the end, sorted, without empty and tracking ones, joined by &."""
    rest = F.substring_index(F.substring(url, F.locate("://", url) + F.lit(3), F.length(url)), "#", 1)
    at = F.locate("?", rest)
    after = F.when((F.locate("://", url) > 0) & (at > 0), F.substring(rest, at + F.lit(1), F.length(rest))).otherwise(F.lit(""))
    found = F.split(after, "&")
    return F.array_join(F.array_sort(F.filter(found, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")


def canonical(url: Column) -> Column:
    """One form for addresses of one page: no scheme, fragment or tracking parameters, no www. or m. before the host, no .html or slashes at the end of the path; null for an empty host."""
    host_, bare = host(url), F.rtrim(path(url), F.lit("/"))
    bare = F.when(bare.endswith(".html"), F.substring(bare, F.lit(1), F.char_length(bare) - F.lit(5))).otherwise(bare)
    rest = query(url)
    return F.when(host_ != "", F.concat(F.regexp_replace(host_, r"^(?:www|m)\.", ""), bare, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(F.lit(""))))


def longest_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name (host and path joined) and verdict of the longest rule (host, path, verdict) that fits, or nulls.

    A rule fits its host and all subdomains if the path starts with the rule's; the first of equally long ones wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))[::-1]:
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bit(key: str, word: int) -> Column:
    return F.expr(f"shiftleft(1, CAST(shiftrightunsigned(xxhash64({key}, 1), {5 * word}) & 31 AS INT))")


def _block(key: str, blocks: int) -> Column:
    return F.expr(f"pmod(xxhash64({key}), {blocks}L)")


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter's blocks that have bits: _block and the words _w0 ... _w7."""
    return listed.filter(F.col(key).isNotNull()).select(_block(key, blocks).alias("_block"), *[_bit(key, w).alias(f"_b{w}") for w in range(WORDS)]).groupBy("_block").agg(*[F.bit_or(f"_b{w}").alias(f"_w{w}") for w in range(WORDS)])


def with_listed(urls: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """urls with the Boolean column _listed: whether its key is in the key column of listed."""
    listed = written(listed.select(F.col(key)).filter(F.col(key).isNotNull()).distinct())
    blocks = max(1, -(-listed.count() * BITS_A_KEY // (32 * WORDS)))
    filter_, on = bloom(listed, key, blocks), ["_block"]
    known = urls.withColumn("_spread", F.xxhash64(*urls.columns))
    known = known.withColumn("_block", F.when(F.col(key).isNull(), F.pmod("_spread", F.lit(blocks))).otherwise(_block(key, blocks)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    if blocks <= BROADCAST_BLOCKS:
        filter_ = F.broadcast(filter_)
    else:
        filter_, on = filter_.withColumn("_salt", salts).hint("merge"), ["_block", "_salt"]
        known = known.withColumn("_salt", F.pmod("_spread", F.lit(SALTS)))
    known = known.join(filter_, on, "left")
    possible = F.coalesce(F.reduce(F.array(*[F.col(f"_w{w}").bitwiseAND(_bit(key, w)) != 0 for w in range(WORDS)]), F.lit(True), lambda a, x: a & x), F.lit(False)) & F.col(key).isNotNull()
    # a URL that can't be listed has no key, and no salt that the list has
    known = known.withColumn("_possible", possible).withColumn("_key", F.when(F.col("_possible"), F.col(key))).withColumn("_salt", F.when(F.col("_possible"), F.pmod("_spread", F.lit(SALTS))).otherwise(F.lit(SALTS) + F.pmod("_spread", F.lit(SPREAD))))
    exact = listed.select(F.col(key).alias("_key"), salts.alias("_salt"), F.lit(True).alias("_hit"))
    return known.join(exact, ["_key", "_salt"], "left").select(*urls.columns, F.coalesce("_hit", F.lit(False)).alias("_listed"))


def judge(pages: DataFrame, listed_urls: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns in keep, host, path, rule and verdict (allow or block) of every row.

    The longest rule that fits decides; otherwise a url is blocked if its canonical form is one of those of listed_urls (a column named url).
    """
    keep = kept(keep, ["host", "path", "rule", "verdict"])
    h, p = F.col("_host"), F.col("_path")
    urls = pages.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], host(F.col(url_col)).alias("_host"), path(F.col(url_col)).alias("_path"), canonical(F.col(url_col)).alias("_url"))
    name, verdict = longest_rule(h, p, rules)
    return with_listed(urls, listed_urls.select(canonical(F.col("url")).alias("_url")), "_url").select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], h.alias("host"), p.alias("path"), name.alias("rule"), F.coalesce(verdict, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict")
    )
