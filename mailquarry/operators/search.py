"""The archive query language: a request compiles to column predicates and semi-joins over messages."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.operators.lineage import numbered
from mailquarry.sources.archive import Archive

#: Bounds in bytes of the attachment size classes 1 to 5.
SIZE_CLASSES = {"1": (0, 5 << 10), "2": (5 << 10, 20 << 10), "3": (20 << 10, 100 << 10), "4": (100 << 10, 2 << 20), "5": (2 << 20, None)}


def alternatives(value: str) -> list[str]:
    """The alternatives of a field: parted by semicolons, trimmed, lower-cased."""
    return [x for x in (v.strip().lower() for v in value.split(";")) if x]


# Kinds of attachments and their extensions; `others` are extensions of no kind.
ATTACHMENT_TYPES = {
    "graphics": ["jpg", "png", "gif", "bmp"],
    "document": ["doc", "docx", "pages"],
    "presentation": ["ppt", "pptx", "key"],
    "spreadsheet": ["xls", "xlsx", "numbers"],
    "internet file": ["htm", "html", "css", "js"],
    "compressed": ["zip", "7z", "tar", "tgz"],
    "video": ["avi", "mp4"],
    "audio": ["mp3", "ogg"],
    "database": ["fmp", "db", "mdb", "accdb"],
}
# Patterns of social security and card numbers.
SENSITIVE = [
    r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}",
    r"3[0-9]{3}[-. ][0-9]{6}[-. ][0-9]{5}",
    r"4[0-9]{3}[-. ][0-9]{4}[-. ][0-9]{4}[-. ][0-9]{4}",
    r"5[0-9]{3}[-. ][0-9]{4}[-. ][0-9]{4}[-. ][0-9]{4}",
    r"6011[-. ][0-9]{4}[-. ][0-9]{4}[-. ][0-9]{4}",
]


def of_types(types: list[str], ext: str = "ext") -> Column:
    """Whether an extension is of one of the kinds; null extensions are of none."""
    known = [x for xs in ATTACHMENT_TYPES.values() for x in xs]
    test = F.lower(ext).isin([x for t in types for x in ATTACHMENT_TYPES.get(t.lower(), [])])
    return test | (~F.lower(ext).isin(known) if "others" in [t.lower() for t in types] else F.lit(False))


def sensitive(body: str = "body") -> Column:
    return F.col(body).rlike("|".join(SENSITIVE))


@dataclass(frozen=True)
class Request:
    """What a message must meet; empty fields ask nothing. All that is set must hold."""

    folder: str = ""
    annotation: str = ""
    annotation_contains: str = ""
    direction: str = ""  # in, out
    flags: dict[str, bool] = field(default_factory=dict)
    start: date | None = None
    end: date | None = None  # inclusive
    correspondents: tuple[str, ...] = ()
    roles: tuple[str, ...] = ("from", "to", "cc", "bcc")
    all_persons: tuple[str, ...] = ()
    mailing_list: str = ""  # yes, no
    attachment_name: str = ""
    attachment_regex: str = ""
    attachment_extension: str = ""
    attachment_sizes: tuple[str, ...] = ()
    ids: tuple[int, ...] = ()


def day_range(start: date | None, end: date | None, column: str = "date") -> list[Column]:
    """From start 00:00 up to before the day after end."""
    found = []
    if start:
        found.append(F.col(column) >= F.lit(start.isoformat()).cast("timestamp_ntz"))
    if end:
        found.append(F.col(column) < F.lit((end + timedelta(days=1)).isoformat()).cast("timestamp_ntz"))
    return found


def size_in(classes: tuple[str, ...], size: str = "size") -> Column:
    """Whether a size lies in one of the classes; unknown classes ask nothing."""
    tests = [(F.col(size) >= low) & (F.col(size) < high if high else F.lit(True)) for low, high in (SIZE_CLASSES[c] for c in classes if c in SIZE_CLASSES)]
    out = F.lit(not tests)
    for t in tests:
        out = out | t
    return out


def column_predicates(request: Request) -> list[Column]:
    """The conjuncts that are tested on a message row; they reach the scan."""
    found = day_range(request.start, request.end)
    if request.folder:
        found.append(F.lower("folder").isin(alternatives(request.folder)))
    if request.annotation:
        found.append(F.lower("comment").isin(alternatives(request.annotation)))
    if request.annotation_contains:
        found.append(F.lower("comment").contains(request.annotation_contains.lower()))
    if request.direction:
        found.append(F.col("sent") if request.direction == "out" else F.col("received"))
    found += [F.col(name) == value for name, value in request.flags.items()]
    if request.ids:
        found.append(F.col("doc_id").isin(list(request.ids)))
    return found


def resolved(archive: Archive, people: tuple[str, ...]) -> DataFrame:
    """(person, contact): contacts of given addresses or whole names, ignoring case."""
    spark = archive.contacts.sparkSession
    asked = spark.createDataFrame([(p.strip().lower(),) for p in people], "person string").distinct()
    named = archive.contacts.select("contact", F.explode(F.array_distinct(F.array(F.lower("email"), F.lower("name")))).alias("person"))
    return named.join(F.broadcast(asked), "person")


def select(archive: Archive, request: Request) -> DataFrame:
    """Messages that meet the request: column tests first, then semi- and anti-joins on message keys."""
    base = archive.directed() if request.direction else archive.messages
    for test in column_predicates(request):
        base = base.where(test)
    if request.correspondents:
        hits = archive.addrs.where(F.col("role").isin(list(request.roles))).join(F.broadcast(resolved(archive, request.correspondents)), "contact")
        base = base.join(hits.select("doc_id"), "doc_id", "left_semi")
    if request.all_persons:
        hits = archive.addrs.join(F.broadcast(resolved(archive, request.all_persons)), "contact").groupBy("doc_id").agg(F.countDistinct("person").alias("n"))
        base = base.join(hits.where(F.col("n") == len(set(p.strip().lower() for p in request.all_persons))), "doc_id", "left_semi")
    if request.mailing_list in ("yes", "no"):
        listed = archive.addrs.join(archive.contacts.where("is_list").select("contact"), "contact", "left_semi").select("doc_id")
        base = base.join(listed, "doc_id", "left_semi" if request.mailing_list == "yes" else "left_anti")
    if request.attachment_name or request.attachment_regex or request.attachment_extension or request.attachment_sizes:
        base = base.join(attachments(archive, request).select("doc_id"), "doc_id", "left_semi")
    return base


def attachments(archive: Archive, request: Request) -> DataFrame:
    """Attachments that meet all attachment conditions of the request at once."""
    found = archive.attachments
    if request.attachment_name:
        found = found.where(F.lower("filename").isin(alternatives(request.attachment_name)))
    if request.attachment_regex:
        found = found.where(F.col("filename").rlike(request.attachment_regex))
    if request.attachment_extension:
        found = found.where(F.lower("ext").isin(alternatives(request.attachment_extension)))
    if request.attachment_sizes:
        found = found.where(size_in(request.attachment_sizes) & (F.col("size") > 0))
    return found


def select_any(archive: Archive, tests: list[Column], start: date | None = None, end: date | None = None) -> DataFrame:
    """Messages that meet one of the tests; the dates must hold in any case, and no test at all asks nothing."""
    base = archive.directed()
    for t in day_range(start, end):
        base = base.where(t)
    if not tests:
        return base
    either = tests[0]
    for t in tests[1:]:
        either = either | t
    return base.where(either)


def date_parts(docs: DataFrame, year: int, month: int = 0, day: int = 0, column: str = "date") -> DataFrame:
    """Messages of a year, month or day; a month or day out of range stands for all."""
    found = docs.where(F.year(column) == year)
    if 1 <= month <= 12:
        found = found.where(F.month(column) == month)
    return found.where(F.dayofmonth(column) == day) if 1 <= day <= 31 else found


def closest(docs: DataFrame, to: date, column: str = "date", key: str = "doc_id") -> DataFrame:
    """The message nearest to a day, the earlier key on ties: one pass, no sort."""
    gap = F.abs(F.unix_micros(F.col(column).cast("timestamp")) - F.unix_micros(F.lit(to.isoformat()).cast("timestamp_ntz").cast("timestamp")))
    return docs.agg(F.min(F.struct(gap.alias("gap"), F.col(key).alias(key))).alias("m")).select(f"m.{key}", (F.col("m.gap") / 1000).cast("long").alias("gap_ms"))


def numbers(spec: str, n: int) -> list[tuple[int, int]]:
    """Row number ranges of `2-10, 14` or `all`; what lies beyond n is left out."""
    if spec.strip().lower() == "all":
        return [(0, n - 1)] if n else []
    found = []
    for part in filter(None, (p.strip() for p in spec.replace(";", ",").split(","))):
        low, _, high = part.partition("-")
        a, b = int(low), int(high or low)
        if a < n and b >= a:
            found.append((a, min(b, n - 1)))
    return found


def by_numbers(docs: DataFrame, order: list[str], spec: str, key: str = "doc_id") -> DataFrame:
    """Rows at given places of an order. Only the key and the order travel, and no task sees all rows."""
    placed = numbered(docs.select(key, *[c for c in order if c != key]), order, "row_no")
    test = F.lit(False)
    for a, b in numbers(spec, placed.count()):
        test = test | F.col("row_no").between(a, b)
    return placed.where(test)


def page(docs: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """A page of an ordered result, from 0: offset and limit, which sort only as much as they need."""
    return docs.orderBy(*order).offset(number * size).limit(size)


def by_address(archive: Archive, emails: list[str]) -> DataFrame:
    """(email, n_docs) of given addresses; addresses without a message have 0."""
    asked = archive.contacts.sparkSession.createDataFrame([(e.lower(),) for e in emails], "email string").distinct()
    hits = archive.addrs.join(archive.contacts.select("contact", "email"), "contact").join(F.broadcast(asked), "email").groupBy("email").agg(F.countDistinct("doc_id").alias("n_docs"))
    return asked.join(hits, "email", "left").select("email", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def import_filter(archive: Archive, persons: tuple[str, ...] = (), start: date | None = None, end: date | None = None, sent_only: bool = False) -> DataFrame:
    """What an import lets in: messages of the dates, with one of the persons, sent by oneself if asked."""
    found = select(archive, Request(correspondents=persons, start=start, end=end, direction="out" if sent_only else ""))
    return found


def in_intervals(docs: DataFrame, intervals: DataFrame, column: str = "date", days: int = 31) -> DataFrame:
    """(interval_id, doc_id): messages with start <= date <= end, intervals may overlap.

    A range join by buckets of `days`: an interval is filed under each bucket that it touches, a message under its own,
    so the join is an equi-join with a residual test.
    """
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (days * 86_400_000_000))
    filed = intervals.select("interval_id", "start", "end", F.explode(F.sequence(slot("start"), slot("end"))).alias("_slot"))
    return docs.withColumn("_slot", slot(column)).join(filed, "_slot").where(f"{column} >= start and {column} <= end").select("interval_id", "doc_id")


def listings(archive: Archive) -> DataFrame:
    """(kind, value): distinct folders, annotations, attachment names and extensions."""
    parts = [(archive.messages, "folder"), (archive.messages, "comment"), (archive.attachments, "filename"), (archive.attachments, "ext")]
    out = None
    for frame, column in parts:
        own = frame.select(F.lit(column).alias("kind"), F.col(column).alias("value")).where("value is not null").distinct()
        out = own if out is None else out.unionByName(own)
    return out


def nearest_context(mentions: DataFrame, query: DataFrame, days: int = 183) -> DataFrame:
    """(query_id, doc_id, level): mentions of a query's name within half a year, by the nearest level of context.

    Level 1 is the same message, 2 the same thread, 3 the same sender and recipient, 4 the sender, 5 the recipient. Each
    query keeps its mentions of the least level. mentions: doc_id, name, date, thread, sender, recipient; query has these
    with query_id.
    """
    q = query.select("query_id", F.col("name"), *[F.col(c).alias(f"q_{c}") for c in ("doc_id", "date", "thread", "sender", "recipient")])
    near = F.abs(F.unix_micros(F.col("date").cast("timestamp")) - F.unix_micros(F.col("q_date").cast("timestamp"))) <= days * 86_400_000_000
    same = lambda c: F.col(c) == F.col(f"q_{c}")
    level = F.when(same("doc_id"), 1).when(same("thread"), 2).when(same("sender") & same("recipient"), 3).when(same("sender"), 4).when(same("recipient"), 5)
    hits = mentions.join(q, "name").where(near).withColumn("level", level).where("level is not null").select("query_id", "doc_id", "level")
    least = hits.groupBy("query_id").agg(F.min("level").alias("level"))
    return hits.join(least, ["query_id", "level"]).select("query_id", "doc_id", "level")
