"""URL filters: a sort-merge sweep of reversed-host keys with a stack of nested rules."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.llm.common import ascii_lower, stored

#: The rules of the production query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
#: Ends a host's part of a key; sorts before all that a host may hold, so a host stands before its subdomains.
END = "\x01"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """www.example.net -> net END example END www END: a host's key begins the keys of all its subdomains."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END)))


def _sweep(batches: Iterator[pa.RecordBatch]):
    """Sorted rows in, judged URLs out. The stack holds the rule hosts whose interval the sweep is in, outermost first."""
    stack: list[tuple[str, dict[str, tuple[str, str]], set[int]]] = []
    for batch in batches:
        rules, verdicts = [], []
        cols = [batch.column(n).to_pylist() for n in ("key", "path", "verdict", "rule", "is_url")]
        for key, path, verdict, rule, is_url in zip(*cols, strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                _, paths, lengths = stack[-1]
                if path not in paths or verdict > paths[path][0]:  # of two equal rules, block stands
                    paths[path] = (verdict, rule)
                    lengths.add(len(path))
                continue
            best = None
            for _, paths, lengths in stack:
                for n in lengths:
                    if (fit := paths.get(path[:n])) and n <= len(path):
                        found = (len(fit[1]), *fit)
                        if best is None or found > best:
                            best = found
            verdicts.append(best[1] if best else None)
            rules.append(best[2] if best else None)
        urls = batch.filter(batch.column("is_url"))
        yield pa.RecordBatch.from_arrays([urls.column("page_id"), urls.column("host"), urls.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    rules: (verdict, host, path). A rule fits a URL of its host or a subdomain whose path starts with the rule's; of the
    rules that fit, the one with the longest text wins, of equal ones block. URLs and rules are sorted together by
    reversed host in ranges, the rows of a host being split by path and page id; each range begins with the rules whose
    interval it lies in, which a join finds by the prefixes of its first key and puts before its rows. Null URLs and those without :// have empty
    host and path and get the default verdict, as do all others that no rule fits; null ids and repeated rows stay,
    empty tables are fine, other columns are ignored. Rules of null or empty host are ignored, a null path is "/".
    """
    spark = pages.sparkSession
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    url = url.select(host_key(F.col("host")).alias("key"), "path", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"), F.lit(True).alias("is_url"), "page_id", "host")
    r = rules.select("verdict", ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("/")).alias("path")).where("host <> ''")
    r = r.select(host_key(F.col("host")).alias("key"), "path", "verdict", F.concat("host", "path").alias("rule"), F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    both = url.unionByName(r).repartitionByRange(n, "key", "is_url", "path", F.coalesce("page_id", F.lit(-1)), F.xxhash64("path", "page_id", "key")).withColumn("part", F.spark_partition_id())
    ranged = stored(both.sortWithinPartitions("part", "key", "is_url", "path"), "url-ranges")
    # The first key of each range: as many rows as ranges.
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    prefixes = firsts.select("part", "first", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("first", END))), lambda i: F.concat(F.array_join(F.slice(F.split("first", END), F.lit(1), i), END), F.lit(END)))).alias("key"))
    carried = prefixes.join(ranged.where("not is_url").withColumnRenamed("part", "own"), "key").where("own < part").select(*ranged.columns, F.lit(0).alias("turn"))
    every = ranged.withColumn("turn", F.lit(1)).unionByName(carried)
    ordered = every.repartition(n, "part").sortWithinPartitions("part", "turn", "key", "is_url", "path")
    judged = ordered.mapInArrow(_by_part, T.StructType.fromDDL("page_id long, host string, path string, rule string, verdict string"))
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _by_part(batches: Iterator[pa.RecordBatch]):
    """Several ranges may meet in one task: each is swept on its own."""

    def runs():
        for batch in batches:
            parts = batch.column("part").to_pylist()
            start = 0
            for i in range(1, len(parts) + 1):
                if i == len(parts) or parts[i] != parts[start]:
                    yield parts[start], batch.slice(start, i - start)
                    start = i

    for _, group in itertools.groupby(runs(), key=lambda x: x[0]):
        yield from _sweep(b for _, b in group)
