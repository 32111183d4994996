"""Views of the base tables as archives of messages: messages, addresses, contacts, attachments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Archive:
    """Lazy tables of one archive; nothing is read before a query needs it.

    messages: doc_id, date, folder, comment, reviewed, do_not_transfer. addrs: doc_id, role, pos, contact (every
    occurrence of an address). contacts: contact, name, email, org, last_name, is_self, is_list. attachments: doc_id, pos,
    filename, ext, size.
    """

    messages: DataFrame
    addrs: DataFrame
    contacts: DataFrame
    attachments: DataFrame

    def directed(self) -> DataFrame:
        """messages with sent (the sender is oneself) and received (a recipient is); neither counts as received."""
        own = self.contacts.where("is_self").select("contact")
        marks = self.addrs.join(own, "contact").groupBy("doc_id").agg(F.bool_or(F.col("role") == "from").alias("sent"), F.bool_or(F.col("role") != "from").alias("received"))
        joined = self.messages.join(marks, "doc_id", "left")
        sent = F.coalesce("sent", F.lit(False))
        return joined.withColumn("received", F.coalesce("received", F.lit(False)) | ~sent).withColumn("sent", sent)


def order_archive(spark: SparkSession, sf_dir: str) -> Archive:
    """Orders as messages from customers to the suppliers of their lines; each line is also an attachment."""
    get = lambda name: table(spark, sf_dir, name)
    places = get("nation").join(get("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    mail = lambda name: F.concat(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", ".")), F.lit("@"), F.lower(F.regexp_replace("n_name", " ", "-")), F.lit(".example.com"))
    people = get("customer").select(F.concat(F.lit("c"), "c_custkey").alias("contact"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"), F.lit(False).alias("is_list"))
    people = people.unionByName(get("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("contact"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"), (F.col("s_acctbal") < 0).alias("is_list")))
    contacts = people.join(places, "n_nationkey").select("contact", "name", mail("name").alias("email"), F.col("n_name").alias("org"), F.col("r_name").alias("last_name"), (F.col("n_nationkey") == 0).alias("is_self"), "is_list")
    segment = get("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    messages = get("orders").join(segment, "o_custkey", "left").select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("folder"),
        F.col("c_mktsegment").alias("comment"),
        (F.col("o_orderstatus") == "F").alias("reviewed"),
        (F.col("o_orderstatus") == "P").alias("do_not_transfer"),
    )
    senders = get("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("from").alias("role"), F.lit(0).alias("pos"), F.concat(F.lit("c"), "o_custkey").alias("contact"))
    lines = get("lineitem")
    receivers = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit("to").alias("role"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("s"), "l_suppkey").alias("contact"))
    files = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.lower("l_returnflag")).alias("filename"), F.lower("l_returnflag").alias("ext"), (F.col("l_quantity") * 1024).cast("long").alias("size"))
    return Archive(messages, senders.unionByName(receivers), contacts, files)


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages without date: subject is the first line, body the text, folder the source."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(marks, "doc_id", "left")
    return docs.select("doc_id", F.col("source").alias("folder"), F.substring_index("text", "\n", 1).alias("subject"), F.col("text").alias("body"), F.col("lang").alias("language"), (F.coalesce("quality", F.lit(0)) == 1).alias("reviewed"), (F.coalesce("toxic", F.lit(0)) == 1).alias("do_not_transfer"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated messages: contact is the user, folder and subject the kind of event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("date"), F.col("user_id").alias("contact"), F.col("event_type").alias("folder"), F.col("value").alias("score"), "props")


#: The same views in SQL, for the statements that check the operators.
ORDER_SQL = """
contacts as (select contact, name, lower(regexp_replace(name, '[^A-Za-z0-9]+', '.', 'g')) || '@' || lower(replace(n_name, ' ', '-')) || '.example.com' as email, n_name as org, r_name as last_name, n_nationkey = 0 as is_self, is_list
  from (select 'c' || c_custkey as contact, c_name as name, c_nationkey as n_nationkey, false as is_list from customer union all select 's' || s_suppkey, s_name, s_nationkey, s_acctbal < 0 from supplier) join nation using (n_nationkey) join region on n_regionkey = r_regionkey),
messages as (select o_orderkey as doc_id, o_orderdate as date, o_orderpriority as folder, c_mktsegment as comment, o_orderstatus = 'F' as reviewed, o_orderstatus = 'P' as do_not_transfer from orders left join customer on c_custkey = o_custkey),
addrs as (select o_orderkey as doc_id, 'from' as role, 0 as pos, 'c' || o_custkey as contact from orders union all select l_orderkey, 'to', l_linenumber, 's' || l_suppkey from lineitem),
attachments as (select l_orderkey as doc_id, l_linenumber as pos, l_linenumber || '.' || lower(l_returnflag) as filename, lower(l_returnflag) as ext, (l_quantity * 1024)::bigint as size from lineitem),
marks as (select doc_id, bool_or(role = 'from') as s, bool_or(role <> 'from') as r from addrs join contacts using (contact) where is_self group by doc_id),
directed as (select m.*, coalesce(s, false) as sent, coalesce(r, false) or not coalesce(s, false) as received from messages m left join marks using (doc_id))
"""

DOCUMENT_SQL = r"""
docs as (select d.doc_id, source as folder, string_split(text, chr(10))[1] as subject, text as body, lang as language, coalesce(quality, 0) = 1 as reviewed, coalesce(toxic, 0) = 1 as do_not_transfer
  from documents d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) using (doc_id))
"""
