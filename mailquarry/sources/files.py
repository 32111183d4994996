"""Readers of the archive's own text formats and of mailboxes."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailquarry.functions import text as T

MESSAGE = "path string, msg_no int, message_id string, subject string, sent_date timestamp, sender array<struct<name:string,email:string>>, to array<struct<name:string,email:string>>, cc array<struct<name:string,email:string>>, bcc array<struct<name:string,email:string>>, list_post array<string>, body string, attachments array<struct<filename:string,content_type:string,size:long,sha1:string>>"
#: Longest message whose lines must hold a blank now and then to count as mail.
DENSE_LINES = 50


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(category, term) of `category: a|b` lines; # starts a comment, lines with another number of colons are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*#"))
    parts = F.split("value", ":")
    return lines.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("category"), F.explode(F.split(parts[1], r"\|")).alias("term")).select("category", F.lower(F.trim("term")).alias("term")).where("term <> ''")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line_no, line) of files whose blocks are parted by lines that start with two dashes."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"(?m)^--.*$\n?").alias("blocks"))
    return whole.select("path", F.posexplode("blocks").alias("block", "body")).select("path", "block", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line")).select("path", "block", "line_no", F.trim("line").alias("line")).where("line <> ''")


def address_book(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, is_self, is_list, emails, names): lines with @ are addresses, [ML] marks a list, the first block is oneself."""
    rows = _blocks(spark, path)
    mail = F.col("line").contains("@")
    return rows.groupBy("path", "block").agg(F.max((F.col("line") == "[ML]").cast("int")).alias("m"), F.array_sort(F.collect_set(F.when(mail, T.clean_email(F.col("line"))))).alias("emails"), F.array_sort(F.collect_set(F.when(~mail & (F.col("line") != "[ML]"), F.col("line")))).alias("names")).select("path", "block", (F.col("block") == 0).alias("is_self"), (F.col("m") == 1).alias("is_list"), "emails", "names")


def entity_map(spark: SparkSession, path: str) -> DataFrame:
    """(entity, name): alternates and the display name, the first line of their block; single lines say nothing."""
    rows = _blocks(spark, path)
    named = rows.withColumn("name", F.first("line").over(Window.partitionBy("path", "block").orderBy("line_no"))).withColumn("k", F.count("*").over(Window.partitionBy("path", "block")))
    return named.where("k > 1").select(F.lower("line").alias("entity"), "name")


def name_variants(spark: SparkSession, path: str) -> DataFrame:
    """(variant, canonical) of `canonical = v1 = v2` lines, parted by equals signs, commas or blanks."""
    parts = T.words(F.lower("value"), r"[=,\s]+")
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.element_at(parts, 1).alias("canonical"), F.explode(parts).alias("variant")).select("variant", "canonical")


def gazette(spark: SparkSession, path: str, fraction: float = 1.0, seed: int = 1) -> DataFrame:
    """(title, type) of tab-separated lines; a sample if a fraction is given. Titles with several types are dropped."""
    rows = spark.read.csv(path, sep="\t", schema="title string, type string").where("title is not null and type is not null")
    clear = rows.groupBy("title").agg(F.countDistinct("type").alias("k"), F.min("type").alias("type")).where("k = 1").select(F.regexp_replace("title", r" \(.*\)$", "").alias("title"), "type")
    return clear.sample(fraction, seed) if fraction < 1 else clear


def labels_of_triples(spark: SparkSession, path: str, predicate: str) -> DataFrame:
    """(id, label) of N-triples lines with a predicate."""
    line = r'^<([^>]*?([^/>]*))>\s+<([^>]*)>\s+"((?:[^"\\]|\\.)*)"'
    return spark.read.text(path).select(F.regexp_extract("value", line, 2).alias("id"), F.regexp_extract("value", line, 3).alias("p"), F.regexp_extract("value", line, 4).alias("label")).where(F.col("p") == predicate).select("id", "label")


class _Text(HTMLParser):
    BREAKS = {"div", "br", "hr", "p"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in ("script", "style")
        if tag in ("br", "hr"):
            self.parts.append("\n")

    def handle_endtag(self, tag) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in ("div", "p"):
            self.parts.append("\n")

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.parts.append(data)


def text_of_html(html: str | None) -> str:
    """The text of a page, with a newline after each block and break; scripts and styles are left out."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of_html)


def plausible(body: Column) -> Column:
    """False for text of over 50 lines with over 50 consecutive lines without a blank: encoded data, not mail."""
    lines = F.split(body, "\n")
    run = F.aggregate(lines, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct(F.when(x.contains(" "), 0).otherwise(s["now"] + 1).alias("now"), F.greatest(s["most"], F.when(x.contains(" "), 0).otherwise(s["now"] + 1)).alias("most")))
    return ~((F.size(lines) > DENSE_LINES) & (run["most"] > DENSE_LINES))


def _addresses(message, header: str) -> list[dict]:
    return [{"name": n or None, "email": a.strip().lower()} for n, a in getaddresses([str(v) for v in message.get_all(header, [])]) if a]


def _body(part) -> str:
    """Plain text where there is any, else the text of HTML, else of the first part; nested messages in turn."""
    if part.is_multipart():
        own = list(part.iter_parts()) if part.get_content_maintype() == "multipart" else part.get_payload()
        if part.get_content_subtype() == "alternative":
            plain = [p for p in own if p.get_content_type() == "text/plain"] or [p for p in own if p.get_content_type() == "text/html"] or own[:1]
            return "".join(_body(p) for p in plain)
        return "".join(_body(p) for p in own)
    if part.get_content_maintype() != "text" or part.get_filename():
        return ""
    raw = part.get_payload(decode=True) or b""
    text = raw.decode(part.get_content_charset("utf-8"), "replace")
    return text_of_html(text) if part.get_content_type() == "text/html" else text


def parsed(raw: bytes) -> dict:
    """A message as a row."""
    import hashlib

    m = email.message_from_bytes(raw, policy=email.policy.default)
    try:
        date = parsedate_to_datetime(m["Date"]) if m["Date"] else None
    except (TypeError, ValueError):
        date = None
    files = []
    for p in m.walk():
        if p.get_filename():
            data = p.get_payload(decode=True) or b""
            files.append({"filename": p.get_filename(), "content_type": p.get_content_type(), "size": len(data), "sha1": hashlib.sha1(data).hexdigest()})
    posts = [x.strip().strip("<>").removeprefix("mailto:") for v in m.get_all("List-Post", []) for x in str(v).split(",")]
    return {"message_id": m["Message-ID"], "subject": m["Subject"], "sent_date": date, "sender": _addresses(m, "From"), "to": _addresses(m, "To"), "cc": _addresses(m, "Cc"), "bcc": _addresses(m, "Bcc"), "list_post": posts, "body": _body(m), "attachments": files}


def mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files. Records are cut at `From ` lines by the text reader, so a large file splits over tasks."""
    lines = spark.read.option("lineSep", "\nFrom ").text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("at"), "value")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, at, value in zip(batch["path"], batch["at"], batch["value"]):
                _, _, raw = value.partition("\n")
                if raw.strip():
                    out.append({"path": p, "msg_no": int(at & 0x7FFFFFFF), **parsed(raw.replace("\n>From ", "\nFrom ").encode("utf-8", "surrogateescape"))})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MESSAGE.replace("array<struct<", "array_struct_").split(", ")] if not out else None)

    return lines.mapInPandas(rows, MESSAGE)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(filename, sha1, size, n): files of a folder by content; equal names and contents once, with their number."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = rows.select(T.url_tail(F.col("path")).alias("filename"), F.sha1("content").alias("sha1"), F.col("length").alias("size"))
    return named.groupBy("filename", "sha1").agg(F.first("size").alias("size"), F.count("*").alias("n"))


def sql_dump_tuples(spark: SparkSession, path: str) -> DataFrame:
    """(id, namespace, title) of the tuples in `INSERT INTO` lines of a page table's dump."""
    tuples = F.regexp_extract_all("value", F.lit(r"\((\d+,\d+,'(?:[^'\\]|\\.)*')"), F.lit(1))
    row = r"^(\d+),(\d+),'(.*)'$"
    return spark.read.text(path).where(F.col("value").startswith("INSERT INTO")).select(F.explode(tuples).alias("t")).select(F.regexp_extract("t", row, 1).cast("long").alias("id"), F.regexp_extract("t", row, 2).cast("int").alias("namespace"), F.regexp_replace(F.regexp_extract("t", row, 3), r"\\(.)", "$1").alias("title"))


def coauthors(spark: SparkSession, path: str, field: int = 1) -> DataFrame:
    """(a, b, weight), a < b: authors named together in a field of comma-separated lines, parted by &."""
    names = F.array_sort(F.array_distinct(F.transform(F.split(F.get(F.split("value", ","), F.lit(field)), "&"), lambda x: F.trim(x))))
    pairs = F.flatten(F.transform("n", lambda a: F.transform(F.filter("n", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return spark.read.text(path).select(names.alias("n")).where(F.size("n").between(2, 1000)).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))
