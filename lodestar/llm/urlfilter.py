"""URL filter: a trie over reversed host labels and path segments; the longest matching entry decides.

An entry names a host (``example.org`` also covers its subdomains) and
perhaps the first segments of a path.  Of all entries that match a URL the
longest - most host labels, then most path segments - wins, whether it
allows or blocks; of equal ones the block.  The trie is broadcast when the
list is small enough; beyond that, every prefix of a URL is joined to the
entries by shuffle, with the same result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Entries up to which the trie is broadcast.
TRIE_ENTRIES = 200_000
ENTRIES: list[tuple[str, str]] = [
    ("block", "spam-farm.example.org"), ("allow", "spam-farm.example.org/de"), ("block", "spam-farm.example.org/de/9"),
    ("block", "cheap-pills.example.com"), ("allow", "www.cheap-pills.example.com/en"), ("block", "casino.example.net"),
    ("block", "example.net/es"), ("allow", "blog.example.net"), ("block", "example.org/fr"),
    ("allow", "example.com"), ("allow", "example.net"), ("allow", "example.org"), ("block", "m.example.com"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """Reversed host labels and path segments, lower-case host, without user, port, query and fragment."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    rest = F.regexp_replace(rest, r"[?#][\s\S]*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.split(rest, "/", 2)[0], r"^[^@]*@", ""), r":[0-9]*$", ""))
    path = F.filter(F.split(F.regexp_replace(rest, r"^[^/]*", ""), "/"), lambda x: x != "")
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    return labels, path


def entry_key(entry: str) -> tuple[list[str], list[str]]:
    host, _, path = entry.partition("/")
    return [x for x in reversed(host.lower().split(".")) if x], [x for x in path.split("/") if x]


def build_trie(entries: list[tuple[str, str]]) -> dict:
    """Nested dicts; "/" leads from a host to its path segments, "" holds an entry's kind."""
    root: dict = {}
    for kind, entry in entries:
        labels, path = entry_key(entry)
        node = root
        for x in labels:
            node = node.setdefault(x, {})
        if path:
            node = node.setdefault("/", {})
            for x in path:
                node = node.setdefault(x, {})
        if node.get("") != "block":
            node[""] = kind
    return root


def look_up(trie: dict, labels: list[str], path: list[str]) -> tuple[str | None, int, int]:
    """Kind, labels and segments of the longest match; an entry with a path may sit on a parent host."""
    best: tuple[str | None, int, int] = (None, 0, 0)
    node = trie
    for depth, label in enumerate(labels, 1):
        node = node.get(label)
        if node is None:
            break
        if "" in node:
            best = (node[""], depth, 0)
        if "/" in node:
            at = node["/"]
            for n, x in enumerate(path, 1):
                at = at.get(x) if x else None
                if at is None:
                    break
                if "" in at:
                    best = (at[""], depth, n)
    return best


def decide(pages: DataFrame, entries: list[tuple[str, str]] | DataFrame, default: str = "allow", trie_entries: int = TRIE_ENTRIES) -> DataFrame:
    """page_id, url, decision, and how many labels and segments matched (0: by default).

    A null or empty URL matches nothing and takes the default; repeated rows get the same decision each.
    """
    spark = pages.sparkSession
    if isinstance(entries, DataFrame):
        head = entries.select("kind", "entry").where("kind is not null and entry is not null").limit(trie_entries + 1).collect()
    else:
        head = entries
    rows = pages.select("page_id", F.col("url").cast("string"))
    labels, path = parts(F.col("url"))
    if len(head) > trie_entries:
        return _decide_by_join(rows, entries if isinstance(entries, DataFrame) else spark.createDataFrame(entries, "kind string, entry string"), default)
    shared = spark.sparkContext.broadcast(build_trie([(k, e) for k, e in head]))

    @F.pandas_udf("decision string, labels int, segments int")
    def match(labels: pd.Series, path: pd.Series) -> pd.DataFrame:
        trie = shared.value
        out = [look_up(trie, a, b) if a is not None else (None, 0, 0) for a, b in zip(labels, path)]
        return pd.DataFrame({"decision": [d or default for d, _, _ in out], "labels": [n for _, n, _ in out], "segments": [n for _, _, n in out]})

    return rows.withColumn("_m", match(labels, path)).select("page_id", "url", "_m.decision", "_m.labels", "_m.segments")


def _decide_by_join(rows: DataFrame, entries: DataFrame, default: str) -> DataFrame:
    labels, path = parts(F.col("entry"))
    keyed = (
        entries.where("kind is not null and entry is not null")
        .select("kind", F.concat_ws("/", F.concat_ws(".", labels), F.concat_ws("/", path)).alias("key"))
        .groupBy("key").agg(F.max("kind").alias("kind"))  # block is after allow
    )
    labels, path = parts(F.col("url"))
    every = rows.select("url").distinct().select("url", labels.alias("l"), path.alias("p")).select(
        "url", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.transform(
            F.sequence(F.lit(0), F.size("p")),
            lambda j: F.struct(i.cast("int").alias("labels"), j.cast("int").alias("segments"), F.concat_ws("/", F.concat_ws(".", F.slice("l", 1, i)), F.concat_ws("/", F.slice("p", 1, j))).alias("key")),
        )))).alias("x")
    ).select("url", "x.*")
    best = every.join(keyed, "key").groupBy("url").agg(F.max_by(F.struct("kind", "labels", "segments"), F.struct("labels", "segments")).alias("m"))
    return rows.join(best, "url", "left").select(
        "page_id", "url", F.coalesce("m.kind", F.lit(default)).alias("decision"),
        F.coalesce("m.labels", F.lit(0)).alias("labels"), F.coalesce("m.segments", F.lit(0)).alias("segments"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all pages; rows as decide says."""
    return decide(table(spark, sf_dir, "pages"), ENTRIES)


_VALUES = ", ".join(f"('{k}', '{'.'.join(entry_key(e)[0])}', '{'/'.join(entry_key(e)[1])}', {len(entry_key(e)[0])}, {len(entry_key(e)[1])})" for k, e in ENTRIES)
ORACLE_SQL = f"""
WITH entries(kind, host, path, labels, segments) AS (VALUES {_VALUES}),
stripped AS (
  SELECT page_id, url, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '[?#][\\s\\S]*$', '') AS rest FROM pages
), split AS (
  SELECT page_id, url,
    array_to_string(list_reverse(list_filter(string_split(lower(regexp_replace(regexp_replace(split_part(rest, '/', 1), '^[^@]*@', ''), ':[0-9]*$', '')), '.'), lambda x: x <> '')), '.') || '.' AS host,
    array_to_string(list_filter(string_split(regexp_replace(rest, '^[^/]*', ''), '/'), lambda x: x <> ''), '/') || '/' AS path
  FROM stripped
), best AS (
  SELECT s.page_id, s.url, e.kind, e.labels, e.segments,
    row_number() OVER (PARTITION BY s.page_id, s.url ORDER BY e.labels DESC NULLS LAST, e.segments DESC, e.kind DESC) AS rn
  FROM split s LEFT JOIN entries e ON starts_with(s.host, e.host || '.') AND (e.path = '' OR starts_with(s.path, e.path || '/'))
)
SELECT page_id, url, coalesce(kind, 'allow') AS decision, coalesce(labels, 0)::INTEGER AS labels, coalesce(segments, 0)::INTEGER AS segments
FROM best WHERE rn = 1
"""
