"""URL rules as a sort-merge range join on reversed-host keys.

A host is turned round label by label (`www.example.com` -> `com.example.www.`), so a rule's host and all its
subdomains are one interval of keys, and the intervals of two rules are nested or disjoint. Rules and urls are
dealt to ranges of keys by sampled splitters and swept in order; the sweep keeps a stack of the host intervals that
hold the current key, each with its rules' paths.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.scratch import shuffle_partitions

#: A-Z only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys sampled for each range, and their longest length. Both only balance the ranges; every row is judged whatever they hold.
SAMPLED, CUT_CHARS = 64, 256
#: Above every key that starts as a rule's does.
LAST = "\U0010ffff"


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without `://`."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _dealt(frame: DataFrame, cuts: list[str]) -> DataFrame:
    """A row for each range that [_low, _high] meets; a url's interval is a point."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for k, (low, high) in enumerate(zip(batch.column("_low").to_pylist(), batch.column("_high").to_pylist(), strict=True)):
                for part in range(bisect.bisect_right(cuts, low), bisect.bisect_right(cuts, high if high is not None else low) + 1):
                    rows.append(k)
                    parts.append(part)
            out = batch.take(pa.array(rows, pa.int64())).drop_columns(["_low", "_high"])
            yield out.append_column("_part", pa.array(parts, pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name not in ("_low", "_high"))
    return frame.mapInArrow(deal, f"{schema}, _part int")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and key, rules before urls. stack: (key, {path: (rule, verdict)}) of the open intervals."""
    stack: list[tuple[str, dict[str, tuple[str, str]], set[int]]] = []
    now = None
    for batch in batches:
        part, key, rule, host, path, verdict = (batch.column(c).to_pylist() for c in ("_part", "_key", "_rule", "host", "path", "_verdict"))
        keep, rules, verdicts = [], [], []
        for k in range(batch.num_rows):
            if part[k] != now:
                now, stack = part[k], []
            while stack and not key[k].startswith(stack[-1][0]):
                stack.pop()
            if rule[k] is not None:
                if not stack or stack[-1][0] != key[k]:
                    stack.append((key[k], {}, set()))
                stack[-1][1][path[k]] = max(stack[-1][1].get(path[k], ("", "")), (rule[k], verdict[k]))
                stack[-1][2].add(len(path[k]))
                continue
            best: tuple = (-1, -1, None, None)
            for depth, (_, held, sizes) in enumerate(stack):
                for size in sizes:
                    if size <= len(path[k]) and (fit := held.get(path[k][:size])):
                        best = max(best, (len(fit[0]), depth, *fit))
            keep.append(k)
            rules.append(best[2])
            verdicts.append(best[3])
        out = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [out.column("_id"), out.column("host"), out.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            names=["_id", "host", "path", "rule", "verdict"],
        )


def judge_urls(urls: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row (id, host, path, rule, verdict) per row of `urls`; other columns are not carried.

    rules: (host, path, verdict). A rule fits its host and every subdomain when the url's path starts with the rule's
    path; of those that fit, the longest host + path wins, then the longest host, then the greatest verdict. Without
    any, rule is null and verdict is `default`. Null or unparsable urls have empty host and path. Null ids and
    repeated rows are kept; rules with a null in any part are ignored; no urls give no rows, no rules the default.

    A rule is copied to those ranges only that its interval meets. A url that holds a large share of all rows is split
    over several ranges, as a hash of the id takes part in the ranges' order.
    """
    spark = urls.sparkSession
    host, path = parse_url(F.col(url_col))
    left = urls.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).withColumn("_key", _key(F.col("host")))
    place = F.concat("_key", F.lit("\x01"), "path", F.lit("\x01"), F.hex(F.xxhash64("_id")))
    parts = shuffle_partitions(spark)
    share = min(1.0, parts * SAMPLED / max(urls.count(), 1))
    sample = sorted(r[0] for r in left.select(F.substring(place, 1, CUT_CHARS)).sample(share, 7).collect())
    cuts = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []

    left = left.select("*", F.lit(None).cast("string").alias("_rule"), F.lit(None).cast("string").alias("_verdict"), place.alias("_low"), F.lit(None).cast("string").alias("_high"))
    low_host = F.translate(F.col("host"), UPPER, LOWER)
    right = rules.select("host", "path", F.col("verdict").alias("_verdict")).dropna().select(
        F.lit(None).cast(left.schema["_id"].dataType).alias("_id"), low_host.alias("host"), "path", _key(low_host).alias("_key"),
        F.concat(low_host, "path").alias("_rule"), "_verdict", _key(low_host).alias("_low"), F.concat(_key(low_host), F.lit(LAST)).alias("_high"),
    )
    swept = (
        _dealt(left, cuts)
        .unionByName(_dealt(right, cuts))
        .repartition(parts, "_part")
        .sortWithinPartitions("_part", "_key", F.col("_rule").isNull())
        .mapInArrow(_sweep, f"_id {left.schema['_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    )
    return swept.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
