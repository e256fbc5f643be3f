"""URL rules by a sort-merge range join over reversed-host keys; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, named, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, PROBE, CLOSE = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there up to ``? #`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of rules from (action, host, path) triples."""
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for a, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def _reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(host: Column, path: Column) -> Column:
    """Sort key: labels from the top-level domain down, a zero byte, the path; in bytes, so no character sorts after 0xFF."""
    return F.concat(F.encode(_reversed_host(host), "UTF-8"), F.lit(b"\x00"), F.encode(path, "UTF-8"))


def _events(rules: DataFrame) -> DataFrame:
    """Each rule opens at its key and closes after every key that it prefixes; of repeated rules one stays."""
    size = F.length(F.concat("rule_host", "rule_path"))
    own = F.struct(size.alias("size"), F.length("rule_host").alias("host_size"), F.concat("rule_host", "rule_path").alias("rule"), "action")
    unique = rules.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action")).select(own.alias("own"), _key(F.col("rule_host"), F.col("rule_path")).alias("key"))
    none = F.lit(None).cast(unique.schema["own"].dataType)
    opens = unique.select("key", F.lit(OPEN).alias("kind"), F.lit(1).alias("step"), "own")
    closes = unique.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(CLOSE).alias("kind"), F.lit(-1).alias("step"), none.alias("own"))
    return opens.unionByName(closes)


def _sweep(dealt: DataFrame) -> DataFrame:
    """Adds ``top``, the innermost open rule, to the probes of range-partitioned events.

    The stack of open rules is swept as slots: a running sum of openings less closings is its height, an opening fills
    the slot at the height it reaches, and the top of the stack is what the slot at the present height was last filled
    with. Intervals nest, so whatever fills a higher slot has been closed by then. The height at which a partition
    starts, and the slots filled before it, are carried over from the partitions before: one row per partition and slot.
    """
    steps = dealt.groupBy("part").agg(F.sum("step").alias("step"))
    base = steps.select("part", F.coalesce(F.sum("step").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    running = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # One row per partition is broadcast.
    heights = dealt.join(F.broadcast(base), "part").withColumn("height", F.col("base") + F.sum("step").over(running))
    filled = heights.where(F.col("kind") == OPEN).groupBy("part", "height").agg(F.max_by("own", "key").alias("own"))
    none = F.lit(None).cast(dealt.schema["own"].dataType)
    asked = base.where("base > 0").select("part", F.explode(F.sequence(F.lit(1).cast("long"), "base")).alias("height"), none.alias("own"))
    slots = asked.withColumn("filled", F.lit(0)).unionByName(filled.withColumn("filled", F.lit(1)))
    before = Window.partitionBy("height").orderBy("part", "filled").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("carried", F.last("own", True).over(before)).where("filled = 0").select("part", "height", "carried")
    slot = Window.partitionBy("part", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    probes = heights.withColumn("here", F.last("own", True).over(slot)).where(F.col("kind") == PROBE).join(carried, ["part", "height"], "left")
    return probes.withColumn("top", F.when(F.col("height") > 0, F.coalesce("here", "carried")))


def _attach(left: DataFrame, right: DataFrame, keys: list[str], total: int, width: int) -> DataFrame:
    """Adds ``own`` of ``right(keys, n, own)`` to the rows of ``left``; ``n`` is how many of the ``total`` rows have the key.

    Keys of more than one in ``8 * width`` rows, of which there are fewer than that, are broadcast, so that no task
    gathers the rows of a common key; the others are joined by key.
    """
    share = total // (8 * width)
    none = F.lit(None).cast(right.schema["own"].dataType)
    common = right.where(F.col("n") > share).select(*keys, F.col("own").alias("_own"), F.lit(True).alias("_common"))
    marked = left.join(F.broadcast(common), keys, "left")
    done = marked.where("_common").select(*left.columns, F.col("_own").alias("own"))
    rest = marked.where("_common IS NULL").select(*left.columns)
    return done.unionByName(rest.join(right.where((F.col("n") <= share) & F.col("own").isNotNull()).select(*keys, F.coalesce("own", none).alias("own")), keys, "left"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: ``id, host, path, rule, verdict``.

    ``rules(action, rule_host, rule_path)``: a rule fits its host and all subdomains if the path starts with the
    rule's; the longest rule (host and path together, then the longer host) wins. Of repeated rules the action that
    sorts last stays (``block`` over ``allow``). Urls that no rule fits, null urls and urls without ``://`` get no
    rule and the default verdict. Nulls in a rule's host or path count as empty. Repeated rows stay repeated; empty
    tables give empty or all-default results.

    Method: hosts probe with every suffix of theirs that is as short as some rule's, so a rule is one interval of the
    keys. The distinct (suffix, path) probes and the rules' events are range-partitioned by key and swept in order with
    the stack of open rules; answers go back to the hosts and urls that asked.
    """
    spark = pages.sparkSession
    width = shuffle_width(spark)
    host, path = host_and_path(F.col("url").cast("string"))
    urls = named(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    rules = rules.select("action", F.coalesce("rule_host", F.lit("")).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"))
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    pairs = urls.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    asking = pairs.select(F.explode(suffixes).alias("suffix"), "host", "path", F.col("n").alias("urls"))
    events = _events(rules)
    probes = asking.groupBy("suffix", "path").agg(F.count(F.lit(1)).alias("n")).select(
        _key(F.col("suffix"), F.col("path")).alias("key"), F.lit(PROBE).alias("kind"), F.lit(0).alias("step"), F.lit(None).cast(events.schema["own"].dataType).alias("own"), "suffix", "path", "n"
    )
    dealt = events.unionByName(probes, allowMissingColumns=True).repartitionByRange(width, "key", "kind").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "url-sweep")
    answers = materialise(_sweep(dealt).select("suffix", "path", "n", F.col("top").alias("own")), "url-answers")
    counts = answers.agg(F.sum("n")).first()[0] or 0
    best = _attach(asking, answers, ["suffix", "path"], counts, width).groupBy("host", "path").agg(F.first("urls").alias("n"), F.max("own").alias("own"))
    best = materialise(best, "url-best")
    counts = best.agg(F.sum("n")).first()[0] or 0
    found = _attach(urls.where("host <> ''"), best, ["host", "path"], counts, width)
    hostless = urls.where("host = ''").withColumn("own", F.lit(None).cast(events.schema["own"].dataType))
    return found.unionByName(hostless).select("id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.action"), F.lit(default)).alias("verdict"))
