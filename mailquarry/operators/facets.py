"""Facets and counts over messages and correspondents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.sources.archive import Archive


def _facet(rows: DataFrame, facet: str, value: Column, distinct: bool = False) -> DataFrame:
    n = F.countDistinct("doc_id") if distinct else F.count("*")
    return rows.groupBy(value.alias("value")).agg(n.alias("n_docs")).select(F.lit(facet).alias("facet"), F.col("value").cast("string").alias("value"), "n_docs")


def by_person(archive: Archive) -> DataFrame:
    """Messages of each contact but oneself; a message counts once for a contact, whatever its roles."""
    people = archive.addrs.join(archive.contacts.where("not is_self").select("contact", "name"), "contact").select("doc_id", "contact").distinct()
    return _facet(people, "person", F.col("contact"))


def by_folder(messages: DataFrame) -> DataFrame:
    return _facet(messages.where("folder is not null"), "folder", F.element_at(F.split("folder", "/"), -1))


def by_direction(directed: DataFrame) -> DataFrame:
    both = directed.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("received"), "in"), F.when(F.col("sent"), "out")))).alias("d"))
    return _facet(both, "direction", F.col("d"))


def by_flag(messages: DataFrame, flag: str) -> DataFrame:
    return _facet(messages, flag, F.when(F.col(flag), "yes").otherwise("no"))


def by_extension(archive: Archive) -> DataFrame:
    return _facet(archive.attachments, "extension", F.coalesce(F.lower("ext"), F.lit("none")), distinct=True)


def by_annotation(messages: DataFrame) -> DataFrame:
    return _facet(messages, "annotation", F.coalesce(F.lower("comment"), F.lit("none")))


def more_than_one(facet: DataFrame) -> DataFrame:
    """The facet if it has more than one bucket, else nothing: a facet with one value tells nothing apart."""
    size = facet.agg(F.count("*").alias("n_buckets"))
    return facet.crossJoin(F.broadcast(size)).where("n_buckets > 1").drop("n_buckets")  # one row joins every row


def all_facets(archive: Archive) -> DataFrame:
    """Every facet in one table (facet, value, n_docs)."""
    directed = archive.directed()
    parts = [by_person(archive), more_than_one(by_folder(directed)), more_than_one(by_direction(directed)), more_than_one(by_flag(directed, "do_not_transfer")), more_than_one(by_flag(directed, "reviewed")), by_extension(archive), more_than_one(by_annotation(directed))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contact_frequencies(archive: Archive) -> DataFrame:
    """Occurrences of each contact as sender of received messages and as recipient of sent ones; repeats count."""
    marks = archive.directed().select("doc_id", "sent", "received")
    hits = archive.addrs.join(marks, "doc_id")
    return hits.groupBy("contact").agg(F.count_if((F.col("role") == "from") & F.col("received")).alias("n_in"), F.count_if((F.col("role") != "from") & F.col("sent")).alias("n_out"), F.count("*").alias("n_all"))


def in_out_mentions(archive: Archive) -> DataFrame:
    """in: messages received from a contact; out: sent messages to it; mention: received messages that it got too."""
    marks = archive.directed().select("doc_id", "sent", "received")
    own = archive.contacts.where("is_self").select("contact")
    hits = archive.addrs.select("doc_id", F.when(F.col("role") == "from", "from").otherwise("to").alias("side"), "contact").distinct().join(marks, "doc_id").join(own, "contact", "left_anti")
    return hits.groupBy("contact").agg(
        F.count_if((F.col("side") == "from") & F.col("received")).alias("n_in"),
        F.count_if((F.col("side") == "to") & F.col("sent")).alias("n_out"),
        F.count_if((F.col("side") == "to") & ~F.col("sent")).alias("n_mention"),
    )


def at_most(counts: DataFrame, column: str, n: int) -> DataFrame:
    return counts.where(F.col(column) <= n)


def contact_dates(archive: Archive) -> DataFrame:
    """First and last date, and number of messages, for each contact and direction."""
    marks = archive.directed().select("doc_id", "date", "sent", "received")
    hits = archive.addrs.join(marks, "doc_id").select("contact", "doc_id", "date", F.when((F.col("role") == "from") & F.col("received"), "in").when((F.col("role") != "from") & F.col("sent"), "out").alias("direction")).where("direction is not null").distinct()
    return hits.groupBy("contact", "direction").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_docs"))


def address_book_stats(archive: Archive) -> DataFrame:
    return archive.contacts.agg(F.count("*").alias("n_contacts"), F.countDistinct("name").alias("n_names"), F.countDistinct("email").alias("n_emails"), F.count_if("is_self").alias("n_own"), F.count_if("is_list").alias("n_lists"))


def archive_stats(archive: Archive) -> DataFrame:
    return archive.directed().agg(F.count("*").alias("n_docs"), F.count_if("sent").alias("n_sent"), F.count_if("received").alias("n_received"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def blob_stats(archive: Archive) -> DataFrame:
    """Attachments by name and size: all and unique, in number and bytes."""
    unique = archive.attachments.groupBy("filename", "size").agg(F.count("*").alias("n"))
    return unique.agg(F.sum("n").alias("n_all"), F.count("*").alias("n_unique"), F.sum(F.col("n") * F.col("size")).alias("bytes_all"), F.sum("size").alias("bytes_unique"))


def type_rollup(rows: DataFrame, path: str) -> DataFrame:
    """Counts of `A|B|C` paths at every suffix: C, B|C and A|B|C."""
    parts = F.split(F.col(path), r"\|")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "|"))
    return rows.select(F.explode(suffixes).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, group: list[str], n: str) -> DataFrame:
    """Shannon entropy in nats of the counts of each group: ln N - (sum n ln n) / N, so one aggregate suffices."""
    total = F.sum(n)
    return counts.groupBy(*group).agg((F.log(total) - F.sum(F.col(n) * F.log(F.col(n))) / total).alias("entropy"))


def min_frequency(percent: float, n_docs: int) -> int:
    return int(min(max(percent * n_docs / 100, 2), 5))


def top_of_map(counts: DataFrame, column: str, k: int, order: str) -> DataFrame:
    """The k largest counts, ties in the given order."""
    return counts.orderBy(F.desc(column), order).limit(k)


def spread(counts: DataFrame, column: str) -> DataFrame:
    return counts.agg(F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_pop(column), 6).alias("deviation"))


def attachment_counts(attachments: DataFrame) -> DataFrame:
    """All attachments, images and documents, by extension."""
    from mailquarry.functions.text import DOCUMENT_EXTENSIONS, IMAGE_EXTENSIONS

    return attachments.agg(F.count("*").alias("n_all"), F.count_if(F.lower("ext").isin(IMAGE_EXTENSIONS)).alias("n_images"), F.count_if(F.lower("ext").isin(DOCUMENT_EXTENSIONS)).alias("n_documents"))


def median_of_counts(rows: DataFrame, column: str) -> DataFrame:
    """The first value at which the cumulative count passes half of all."""
    return rows.agg(F.expr(f"percentile_disc(0.5) within group (order by {column})").cast("long").alias("median"))
