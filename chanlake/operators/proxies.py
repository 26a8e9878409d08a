"""Proxy lists as data: parsing, merging, ranking and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_META = ("country", "country_code", "latency_ms", "score", "org")


def parse_lines(lines: DataFrame, column: str = "value", default: str = "http") -> DataFrame:
    """``host:port`` or URL lines; comments, blanks and lines that don't parse are skipped."""
    line = F.trim(column)
    x = lines.where((line != "") & ~F.startswith(line, F.lit("#"))).select(line.alias("l"))
    p = r"^(?:([a-z0-9]+)://)?(?:([^:@/]+):([^@/]*)@)?([^:@/\s]+):(\d{1,5})/?$"
    hit = x.where(F.col("l").rlike(p))
    g = lambda k: F.nullif(F.regexp_extract("l", p, k), F.lit(""))
    return hit.select(F.coalesce(g(1), F.lit(default)).alias("type"), g(2).alias("username"), g(3).alias("password"), g(4).alias("host"), g(5).cast("int").alias("port")).where("port between 1 and 65535")


def parse_json(docs: DataFrame, column: str = "value") -> DataFrame:
    """A list of objects, or an object with ``proxies`` or ``working``; aliases of fields are tried in order."""
    names = "ip host address port type protocol country country_name country_code cc latency response_time score hunt_score org organization username password".split()
    item = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    doc = F.from_json(column, f"struct<proxies:{item},working:{item}>")
    items = F.when(F.startswith(F.ltrim(column), F.lit("[")), F.from_json(column, item)).otherwise(F.coalesce(doc["proxies"], doc["working"]))
    x = docs.select(F.explode(items).alias("p"))
    first = lambda *c: F.coalesce(*[F.nullif(F.col(f"p.{n}"), F.lit("")) for n in c])
    out = x.select(
        F.lower(F.coalesce(first("type", "protocol"), F.lit("socks5"))).alias("type"), first("username").alias("username"), first("password").alias("password"), first("ip", "host", "address").alias("host"), F.col("p.port").try_cast("int").alias("port"),
        first("country", "country_name").alias("country"), first("country_code", "cc").alias("country_code"), first("latency", "response_time").try_cast("double").alias("latency_ms"), first("score", "hunt_score").try_cast("double").alias("score"), first("org", "organization").alias("org"),
    )
    return out.where("host is not null and port is not null")


def merged(df: DataFrame, order: str) -> DataFrame:
    """One row for each host and port: the first, enriched by the first one with a country if it has none itself."""
    w = Window.partitionBy("host", "port").orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rich = F.first(F.when(F.col("country").isNotNull(), F.struct(*_META)), ignorenulls=True).over(whole)
    x = df.withColumn("_rn", F.row_number().over(w)).withColumn("_rich", rich).where("_rn = 1")
    fill = F.col("country").isNull() & F.col("_rich").isNotNull()
    return x.withColumns({c: F.when(fill, F.col(f"_rich.{c}")).otherwise(F.col(c)) for c in _META}).drop("_rn", "_rich")


def url(df_type: Column, host: Column, port: Column, user: Column, password: Column) -> Column:
    auth = F.when(user.isNotNull() & password.isNotNull(), F.concat(user, F.lit(":"), password, F.lit("@"))).otherwise("")
    return F.concat(df_type, F.lit("://"), auth, host, F.lit(":"), port.cast("string"))


def success_rate(ok: Column, bad: Column) -> Column:
    return F.when(ok + bad == 0, F.lit(1.0)).otherwise(ok / (ok + bad))


def is_dead(ok: Column, bad: Column) -> Column:
    return (bad >= 3) & (success_rate(ok, bad) < 0.2)


def available(df: DataFrame) -> DataFrame:
    return df.where(~is_dead(F.col("successes"), F.col("failures")))


def _scored(df: DataFrame) -> DataFrame:
    score = 100 * success_rate(F.col("successes"), F.col("failures")) - F.coalesce("latency_ms", F.lit(0.0)) / 100 + F.coalesce("score", F.lit(0.0)) / 10
    return df.withColumn("rank_score", score)


def ranked(df: DataFrame) -> DataFrame:
    """The best quarter of the proxies, ten at least; one is drawn among those of the available ones (:func:`chosen`)."""
    n = df.count()
    return _scored(df).orderBy(F.desc("rank_score"), "host", "port").limit(max(10, n // 4))


def chosen(df: DataFrame, strategy: str = "weighted", turn: int = 0, seed: int = 0):
    """One available proxy, or None: drawn from the best (``weighted``) or from all (``random``), or the next in turn (``round_robin``; the turn advances before use)."""
    if strategy == "round_robin":
        up = available(df)
        n = up.count()
        return up.orderBy("host", "port").offset((turn + 1) % n).first() if n else None
    pool = available(df) if strategy == "random" else ranked(available(df))
    return pool.orderBy(F.xxhash64(F.lit(seed), "host", "port"), "host", "port").first()


def added(df: DataFrame, host: str, port: int, kind: str = "socks5", username: str | None = None, password: str | None = None) -> DataFrame:
    """The pool with one more proxy, unless it has one with that host and port."""
    row = df.sparkSession.createDataFrame([(kind, username, password, host, port)], "type string, username string, password string, host string, port int")
    new = row.join(df.select("host", "port"), ["host", "port"], "left_anti")
    return df.unionByName(new, allowMissingColumns=True)


def tested(results: DataFrame) -> DataFrame:
    """(total, working, dead, success_rate) of a run of tests with a column ``ok``."""
    n, ok = F.count("*"), F.count_if("ok")
    return results.agg(n.alias("total"), ok.alias("working"), (n - ok).alias("dead"), F.when(n == 0, F.lit(0.0)).otherwise(ok / n).alias("success_rate"))


def addresses(df: DataFrame) -> DataFrame:
    """host:port of the available proxies, the list of those that work."""
    return available(df).select(F.concat("host", F.lit(":"), F.col("port").cast("string")).alias("value"))


def by(df: DataFrame, column: str) -> DataFrame:
    """Available proxies by type or country; unknown ones aren't counted."""
    return available(df).where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("proxies"))


def preferred(df: DataFrame, types=None, country=None) -> DataFrame:
    """Rows of the preferred types and country; unknown countries pass; if nothing is left, everything is."""
    keep = df
    if types:
        keep = keep.where(F.col("type").isin(list(types)))
    if country:
        keep = keep.where(F.col("country_code").isNull() | (F.upper("country_code") == country.upper()))
    return keep if keep.limit(1).count() else df


def pool_stats(df: DataFrame) -> DataFrame:
    dead = is_dead(F.col("successes"), F.col("failures"))
    return df.agg(F.count("*").alias("total"), F.count_if(~dead).alias("available"), F.count_if(dead).alias("dead"), F.avg(success_rate(F.col("successes"), F.col("failures"))).alias("mean_success_rate"))


def top_countries(df: DataFrame, n: int = 5) -> DataFrame:
    return df.where("country is not null").groupBy("country").agg(F.count("*").alias("proxies")).orderBy(F.desc("proxies"), "country").limit(n)
