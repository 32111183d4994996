"""Exports: filtered and redacted copies, JSON and CSV shapes, mbox text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.functions import text as T


def public_copy(messages: DataFrame, selected: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """Selected messages with subject and body reduced to the entities in them. names: (doc_id, names array)."""
    kept = messages.join(selected.select(key), key, "left_semi").join(names, key, "left")
    own = F.coalesce("names", F.array().cast("array<string>"))
    return kept.withColumn("subject", T.redacted(F.col("subject"), own)).withColumn("body", T.redacted(F.col("body"), own)).drop("names")


def correspondents_json(counts: DataFrame, contacts: DataFrame) -> DataFrame:
    return counts.join(contacts.select("contact", "name"), "contact").select("contact", F.to_json(F.struct("name", "n_in", "n_out", "n_mention")).alias("json"))


def links_json(links: DataFrame) -> DataFrame:
    """{url, times} of each link, in lower case."""
    return links.groupBy(F.lower("url").alias("url")).agg(F.count("*").alias("times")).select("url", F.to_json(F.struct("url", "times")).alias("json"))


def mbox_text(messages: DataFrame) -> DataFrame:
    """A `value` line for each message in mbox form; write it with the text sink."""
    header = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "), F.lit("\n"))).otherwise("")
    body = F.regexp_replace("body", r"(?m)^(>*From )", ">$1")
    return messages.select(F.concat(F.lit("From -\n"), header("Message-ID", "doc_id"), header("Subject", "subject"), F.lit("\n"), body, F.lit("\n")).alias("value"))


def json_leaves(rows: DataFrame, column: str, key: str) -> DataFrame:
    """(key, path, value) of the members of JSON objects, one level deep, in a map."""
    return rows.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))


def hashed_leaves(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("value", F.sha2("value", 256))


def kept(table: DataFrame, selected: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of any table of an archive that belong to selected messages."""
    return table.join(selected.select(key).distinct(), key, "left_semi")


def removed(table: DataFrame, selected: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table of an archive without selected messages."""
    return table.join(selected.select(key).distinct(), key, "left_anti")


def name_lines(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, value): the entities of each message in lower case, blanks as underscores, for a text sink."""
    return found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.replace(F.lower("entity"), F.lit(" "), F.lit("_")))), " ").alias("value"))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A table with fixed columns, missing ones empty, as CSV with a header."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)
