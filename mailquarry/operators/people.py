"""People: resolving names and addresses to contacts, mailing lists, name matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators.lineage import cut, numbered

SUPER_DEFINITE, DEFINITE, MAYBE, DEFINITE_NOT, USER_ASSIGNED = 8, 1, 2, 4, 16


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, label) of an edge table (a, b): label is the least node of its component.

    Labels move over edges and then jump to the label of the label, so rounds grow with the logarithm of the diameter in
    practice. Minima are pre-aggregated; each round is written to the checkpoint folder.
    """
    both = cut(edges.where("a is not null and b is not null").select("a", "b").union(edges.where("a is not null and b is not null").select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        roots = moved.select(F.col("node").alias("new"), F.col("new").alias("up"))
        jumped = cut(moved.join(roots, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("label"), "old"))
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def unified(observed: DataFrame) -> DataFrame:
    """Contacts from observed (email, name) pairs: equal addresses and equal order-free names make one contact.

    Returns contact_id (dense only by order of label, see numbered), label, emails, names. Addresses are cleaned; names that are single
    words or junk do not unify.
    """
    clean = observed.select(T.clean_email(F.col("email")).alias("email"), T.clean_person_name(F.col("name")).alias("name"), T.lookup_name(T.clean_person_name(F.col("name"))).alias("lookup"))
    clean = clean.where("email is not null or lookup is not null").distinct()
    e, n = F.concat(F.lit("e:"), "email"), F.concat(F.lit("n:"), "lookup")
    edges = clean.select(F.coalesce(e, n).alias("a"), F.coalesce(n, e).alias("b")).distinct()
    label = components(edges)
    named = clean.withColumn("node", F.coalesce(e, n)).join(label, "node")
    return named.groupBy("label").agg(F.array_sort(F.collect_set("email")).alias("emails"), F.array_sort(F.collect_set("name")).alias("names"))


def name_score(name: Column) -> Column:
    """How good a name looks: two words, capitals, no comma; longer ones win ties."""
    points = F.when(F.size(T.words(name)) == 2, 100).otherwise(0) + F.when(name.rlike(r"^\p{Lu}"), 10).otherwise(0) - F.when(name.contains(","), 1).otherwise(0)
    return points * 100 + F.length(name)


def best_name(names: DataFrame, contact: str, name: str, fallback: str) -> DataFrame:
    """The best name of each contact, else its first address."""
    best = F.max(F.when(F.col(name).isNotNull(), F.struct(name_score(F.col(name)).alias("s"), F.col(name).alias("n"))))
    return names.groupBy(contact).agg(F.coalesce(best["n"], F.min(fallback)).alias("best_name"))


def lookup(addresses: DataFrame, contacts: DataFrame, email: str = "email", name: str = "name") -> DataFrame:
    """addresses with contact: by cleaned address, else by order-free name (the smallest contact of that name)."""
    by_email = contacts.select(T.clean_email(F.col("email")).alias("_e"), F.col("contact").alias("_c1")).groupBy("_e").agg(F.min("_c1").alias("_c1"))
    by_name = contacts.select(T.lookup_name(F.col("name")).alias("_n"), F.col("contact").alias("_c2")).where("_n is not null").groupBy("_n").agg(F.min("_c2").alias("_c2"))
    keyed = addresses.withColumn("_e", T.clean_email(F.col(email))).withColumn("_n", T.lookup_name(F.col(name)))
    return keyed.join(by_email, "_e", "left").join(by_name, "_n", "left").withColumn("contact", F.coalesce("_c1", "_c2")).drop("_e", "_n", "_c1", "_c2")


def mailing_list_states(addrs: DataFrame, directed: DataFrame, lists: DataFrame) -> DataFrame:
    """State bits of contacts, as a set formulation that does not depend on the order of messages.

    lists: contacts that a List-Post header names (SUPER_DEFINITE). On messages neither sent by nor to oneself the only
    recipient is DEFINITE, several are MAYBE, unless they ever sent a message themselves (DEFINITE_NOT).
    """
    senders = addrs.where("role = 'from'").select("contact").distinct().withColumn("sender", F.lit(True))
    own = directed.select("doc_id", (F.col("sent") | F.col("to_me")).alias("mine"))
    foreign = addrs.where("role <> 'from'").join(own.where("not mine"), "doc_id").select("doc_id", "contact").distinct()
    sizes = foreign.groupBy("doc_id").agg(F.count("*").alias("k"))
    seen = foreign.join(sizes, "doc_id").groupBy("contact").agg(F.max((F.col("k") == 1).cast("int")).alias("alone"))
    everyone = addrs.select("contact").distinct()
    joined = everyone.join(senders, "contact", "left").join(seen, "contact", "left").join(lists.select("contact", F.lit(True).alias("listed")), "contact", "left")
    state = F.when(F.col("listed"), SUPER_DEFINITE).otherwise(0) + F.when(F.col("sender"), DEFINITE_NOT).when(F.col("alone") == 1, DEFINITE).when(F.col("alone") == 0, MAYBE).otherwise(0)
    return joined.select("contact", state.alias("state"))


def affinity(contacts: DataFrame, most: int = 100) -> DataFrame:
    """(a, b, affinity), a < b: 0.25 for an equal last name and 0.1 for an equal organisation.

    Classes of more than `most` contacts say nothing and are skipped, which also bounds the pairs.
    """
    def pairs(column: str, weight: float) -> DataFrame:
        own = contacts.where(F.col(column).isNotNull()).select("contact", column)
        small = own.groupBy(column).agg(F.count("*").alias("n")).where(f"n <= {most}").select(column)
        kept = own.join(small, column)
        return kept.withColumnRenamed("contact", "a").join(kept.withColumnRenamed("contact", "b"), column).where("a < b").select("a", "b", F.lit(weight).alias("w"))

    return pairs("last_name", 0.25).unionByName(pairs("org", 0.1)).groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("affinity"))


def match_kind(short: Column, long: Column) -> Column:
    """How a shorter name matches a longer one: as a part, as its acronym, or by words in another order."""
    same_words = F.size(F.array_except(T.words(F.lower(short)), T.words(F.lower(long)))) == 0
    return F.when((F.length(short) < F.length(long)) & F.lower(long).contains(F.lower(short)), "CONTAINED").when((short == F.upper(short)) & (T.acronym_of(long) == short), "ACRONYM").when(same_words & (short != long), "CONTAINED_DIFFERENT_ORDER")


def data_errors(messages: DataFrame, addrs: DataFrame) -> DataFrame:
    """(doc_id, error): messages without recipient, sender or date."""
    has = addrs.groupBy("doc_id").agg(F.count_if(F.col("role") == "from").alias("n_from"), F.count_if(F.col("role") != "from").alias("n_to"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    found = F.array_compact(F.array(F.when(none("n_to"), "no recipient"), F.when(none("n_from"), "no sender"), F.when(F.col("date").isNull(), "no date")))
    return messages.join(has, "doc_id", "left").select("doc_id", F.explode(found).alias("error"))


def contact_ranks(counts: DataFrame, column: str, k: int) -> DataFrame:
    """The k contacts of the largest counts, ties by name."""
    return counts.orderBy(F.desc(column), "contact").limit(k)


def last_seen(addrs: DataFrame, messages: DataFrame) -> DataFrame:
    """For each contact: last date, number of messages, and the last date on which it was the only recipient."""
    to = addrs.where("role <> 'from'").select("doc_id", "contact").distinct()
    sizes = to.groupBy("doc_id").agg(F.count("*").alias("k"))
    return to.join(sizes, "doc_id").join(messages.select("doc_id", "date"), "doc_id").groupBy("contact").agg(F.max("date").alias("last_date"), F.count("*").alias("n_docs"), F.max(F.when(F.col("k") == 1, F.col("date"))).alias("last_alone"))


def first_seen_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Dense ids from 1 in the order in which keys are first seen."""
    first = rows.groupBy(key).agg(F.min(order).alias("first"))
    return numbered(first, ["first", key], "id").select(key, (F.col("id") + 1).alias("id"))


def own_addresses(addrs: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses of oneself, and of all others."""
    own = contacts.where("is_self").select("contact")
    return addrs.join(own, "contact", "left_semi"), addrs.join(own, "contact", "left_anti")


def all_addresses_of(emails: DataFrame, contacts: DataFrame) -> DataFrame:
    """Every address of the contacts that given addresses belong to. contacts: contact, email (one row for each address)."""
    hit = contacts.join(emails.select(F.lower("email").alias("email")), "email", "left_semi").select("contact").distinct()
    return contacts.join(hit, "contact").select("email").distinct()


def reachable_people(addrs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts that are on no message without oneself: the people, not the lists."""
    own = addrs.join(contacts.where("is_self").select("contact"), "contact", "left_semi").select("doc_id").distinct()
    foreign = addrs.join(own, "doc_id", "left_anti").select("contact").distinct()
    return addrs.select("contact").distinct().join(foreign, "contact", "left_anti")


def expanded_names(short: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, name, full, score): the nearest longer name that a short one stands for.

    candidates: name, doc_id, thread, correspondent. On the same message a match scores 1.0, in the thread 0.9, with the
    same correspondent 0.8, anywhere 0.7; ties go to the first in the alphabet. short: doc_id, name, thread, correspondent.
    The join is on the words of the names.
    """
    long = candidates.where(F.col("name").contains(" ")).select(F.col("name").alias("full"), F.col("doc_id").alias("d"), F.col("thread").alias("t"), F.col("correspondent").alias("c"), F.explode(F.split(F.lower("name"), " ")).alias("word"))
    score = F.when(F.col("doc_id") == F.col("d"), 1.0).when(F.col("thread") == F.col("t"), 0.9).when(F.col("correspondent") == F.col("c"), 0.8).otherwise(0.7)
    best = F.min(F.struct((-score).alias("s"), F.col("full").alias("full")))
    return short.withColumn("word", F.lower("name")).join(long, "word").groupBy("doc_id", "name").agg(best.alias("m")).select("doc_id", "name", F.col("m.full").alias("full"), (-F.col("m.s")).alias("score"))


def third_party(names: DataFrame, addrs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Names of documents of which no word is in the name of a participant. names: doc_id, name."""
    own = addrs.join(contacts.select("contact", "name"), "contact").select("doc_id", F.explode(F.split(F.lower("name"), r"[^a-z0-9]+")).alias("word")).distinct()
    asked = names.select("doc_id", "name", F.explode(F.split(F.lower("name"), r"[^a-z0-9]+")).alias("word"))
    met = asked.join(own, ["doc_id", "word"], "left_semi").select("doc_id", "name").distinct()
    return names.join(met, ["doc_id", "name"], "left_anti")
