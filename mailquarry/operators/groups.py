"""Groups of people who appear together: baskets, weights, similarity, hierarchy, greedy grouping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.sources.archive import Archive


def baskets(archive: Archive) -> DataFrame:
    """(doc_id, date, members): sorted distinct contacts of a message, without oneself and mailing lists; empty ones go."""
    people = archive.addrs.join(archive.contacts.where("not is_self and not is_list").select("contact"), "contact")
    of_doc = people.groupBy("doc_id").agg(F.array_sort(F.collect_set("contact")).alias("members"))
    return of_doc.join(archive.messages.select("doc_id", "date"), "doc_id")


def member_sets(archive: Archive) -> DataFrame:
    """(members): the distinct member sets of `baskets`, without their dates."""
    people = archive.addrs.select("doc_id", "contact").join(archive.contacts.where("not is_self and not is_list").select("contact"), "contact")
    of_doc = people.groupBy("doc_id").agg(F.array_sort(F.collect_set("contact")).alias("members"))
    return of_doc.join(archive.messages.select("doc_id").distinct(), "doc_id", "left_semi").select("members").distinct()


def weighted(found: DataFrame) -> DataFrame:
    """(members, weight, n): distinct baskets; weight sums the root of the messages of each month, times min(size, 10)."""
    monthly = found.groupBy("members", F.date_trunc("month", "date").alias("m")).agg(F.count("*").alias("c"))
    sums = monthly.groupBy("members").agg(F.sum(F.sqrt("c")).alias("s"), F.sum("c").alias("n"))
    return sums.select("members", (F.col("s") * F.least(F.size("members"), F.lit(10))).alias("weight"), "n")


def hubs(distinct_baskets: DataFrame, most: int = 1000) -> DataFrame:
    """(contact, n): members of more than `most` distinct baskets; they are pruned before self-joins."""
    return distinct_baskets.select(F.explode("members").alias("contact")).groupBy("contact").agg(F.count("*").alias("n")).where(F.col("n") > most)


def without(distinct_baskets: DataFrame, dropped: DataFrame) -> DataFrame:
    """Baskets without some members, merged where they become equal."""
    flat = distinct_baskets.select(F.monotonically_increasing_id().alias("_b"), F.explode("members").alias("contact"), "weight", "n").join(dropped.select("contact"), "contact", "left_anti")
    again = flat.groupBy("_b").agg(F.array_sort(F.collect_set("contact")).alias("members"), F.first("weight").alias("weight"), F.first("n").alias("n"))
    return again.groupBy("members").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def containment_frequency(groups: DataFrame, distinct_baskets: DataFrame) -> DataFrame:
    """(group_id, freq): messages whose basket holds the whole group. Joins on the member and counts, so no cross product."""
    size = groups.select("group_id", F.size("members").alias("k"), F.explode("members").alias("contact"))
    flat = distinct_baskets.select(F.xxhash64("members").alias("b"), "n", F.explode("members").alias("contact"))
    full = size.join(flat, "contact").groupBy("group_id", "k", "b", "n").agg(F.count("*").alias("c")).where("c = k")
    return full.groupBy("group_id").agg(F.sum("n").alias("freq"))


def utilities(groups: DataFrame, base: float = 1.4) -> DataFrame:
    """Linear, square and exponential utility of groups with freq."""
    k = F.size("members")
    return groups.select("group_id", "freq", (k * F.col("freq")).alias("linear"), (k * k * F.col("freq")).alias("square"), F.round(F.pow(F.lit(base), k) * F.col("freq"), 6).alias("exponential"))


def _ranked(groups: DataFrame) -> DataFrame:
    """(group_id, k, contact, n): the members of each group with the number of groups that have them."""
    flat = groups.select("group_id", F.size("members").alias("k"), F.explode("members").alias("contact"))
    return flat.join(flat.groupBy("contact").agg(F.count("*").alias("n")), "contact")


def containments(groups: DataFrame) -> DataFrame:
    """(small, large) group ids where the members of small are a proper subset of large's.

    A superset has the rarest member of its subset, so only groups that have it are compared with the whole of small.
    """
    ranked = _ranked(groups)
    rarest = ranked.groupBy("group_id").agg(F.min(F.struct("n", "contact")).alias("m"))
    small = groups.select(F.col("group_id").alias("small"), F.col("members").alias("ms")).join(rarest.select(F.col("group_id").alias("small"), F.col("m.contact").alias("contact")), "small")
    large = ranked.select(F.col("group_id").alias("large"), F.col("k").alias("kl"), "contact")
    met = small.join(large, "contact").where(F.size("ms") < F.col("kl"))
    whole = groups.select(F.col("group_id").alias("large"), F.col("members").alias("ml"))
    return met.join(whole, "large").where(F.size(F.array_except("ms", "ml")) == 0).select("small", "large")


def subsumption(groups: DataFrame) -> DataFrame:
    """(small, large, error): what is lost if a group is shown by a superset."""
    meta = groups.select("group_id", F.size("members").alias("k"), "freq")
    pairs = containments(groups).join(meta.toDF("small", "ks", "fs"), "small").join(meta.toDF("large", "kl", "fl"), "large")
    missing = (F.col("kl") - F.col("ks")) / F.col("kl")
    error = F.when(F.col("fs") == 0, missing).otherwise(missing * (F.col("fs") - F.col("fl")) / F.col("fs"))
    return pairs.select("small", "large", F.round(error, 6).alias("error"))


def hierarchy(groups: DataFrame) -> DataFrame:
    """(child, parent): the superset of least error, ties to the smaller and then the earlier group."""
    sizes = groups.select(F.col("group_id").alias("large"), F.size("members").alias("k"))
    best = F.min(F.struct("error", "k", "large"))
    return subsumption(groups).join(sizes, "large").groupBy(F.col("small").alias("child")).agg(best.alias("m")).select("child", F.col("m.large").alias("parent"))


def z_scores(groups: DataFrame, flat: DataFrame, n: int) -> DataFrame:
    """(group_id, z): how far the joint frequency is above that of independent members. flat: (doc_id, contact)."""
    p = flat.groupBy("contact").agg((F.countDistinct("doc_id") / F.lit(float(n))).alias("p"))
    members = groups.select("group_id", "freq", F.explode("members").alias("contact")).join(p, "contact")
    product = members.groupBy("group_id", "freq").agg(F.exp(F.sum(F.log("p"))).alias("pp"))
    return product.select("group_id", F.round((F.col("freq") - n * F.col("pp")) / F.sqrt(n * F.col("pp") * (1 - F.col("pp"))), 6).alias("z"))


def closest_group(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, group_id, jaccard): the group most like each message's basket, ties to the smaller id. An equi-join on members."""
    flat = groups.select("group_id", F.size("members").alias("kg"), F.explode("members").alias("contact"))
    docs = found.select("doc_id", F.size("members").alias("kd"), F.explode("members").alias("contact"))
    shared = docs.join(flat, "contact").groupBy("doc_id", "kd", "group_id", "kg").agg(F.count("*").alias("c"))
    jaccard = F.col("c") / (F.col("kd") + F.col("kg") - F.col("c"))
    best = F.max(F.struct(jaccard.alias("j"), (-F.col("group_id")).alias("g")))
    return shared.groupBy("doc_id").agg(best.alias("m")).select("doc_id", (-F.col("m.g")).alias("group_id"), F.round("m.j", 6).alias("jaccard"))


def mass(groups: DataFrame, volumes: DataFrame) -> DataFrame:
    """(group_id, mass): the sum of its members' volumes (contact, volume)."""
    return groups.select("group_id", F.explode("members").alias("contact")).join(volumes, "contact").groupBy("group_id").agg(F.sum("volume").alias("mass"))


def top_groups(distinct_baskets: DataFrame, k: int, least_size: int = 2) -> DataFrame:
    """The k heaviest baskets as groups numbered from 0 (ties by members)."""
    top = distinct_baskets.where(F.size("members") >= least_size).orderBy(F.desc("weight"), F.array_join("members", ",")).limit(k)
    return top.withColumn("group_id", F.row_number().over(Window.orderBy(F.desc("weight"), F.array_join("members", ","))) - 1)  # k rows


def statistics(groups: DataFrame) -> DataFrame:
    people = groups.select(F.explode("members").alias("contact")).groupBy("contact").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_people"), F.count_if(F.col("n") > 1).alias("n_shared"))
    return groups.agg(F.count("*").alias("n_groups"), F.max(F.size("members")).alias("largest"), F.min(F.size("members")).alias("smallest"), F.round(F.avg(F.size("members")), 6).alias("mean_size")).crossJoin(F.broadcast(people))


#: Members of more groups than RARE are frequent; so many of them are known to all tasks, the most frequent first.
RARE, FREQUENT = 32, 200_000


def _overlap(least: float, ka: Column, kb: Column) -> Column:
    """How many members two groups of these sizes must share at least to be as alike as `least`."""
    return F.ceil(least / (1 + least) * (ka + kb) - 1e-9)


def _keyed(groups: DataFrame) -> DataFrame:
    """(id, group_id, k, sig, ordered): members with the rare ones first, numbered; sig has a bit set for each."""
    flat = groups.select("group_id", "members", F.explode("members").alias("contact"))
    often = flat.groupBy("contact").agg(F.count("*").alias("n")).where(F.col("n") > RARE).orderBy(F.desc("n"), "contact").limit(FREQUENT)
    known = flat.join(F.broadcast(often), "contact", "left").select("members", "group_id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "contact").alias("m"))
    of_id = known.groupBy("members", "group_id").agg(F.array_sort(F.collect_list("m")).alias("ordered"))  # distinct members are dealt by them, so they need not move again
    sig = F.expr("aggregate(ordered, 0, (x, m) -> x | shiftleft(1, cast(pmod(hash(m.contact), 31) as int)))")
    numbered = F.transform("ordered", lambda m, i: F.struct(m["n"].alias("n"), m["contact"].alias("contact"), i.alias("i")))
    return of_id.select(F.xxhash64("group_id").alias("id"), "group_id", F.size("ordered").alias("k"), sig.alias("sig"), numbered.alias("ordered"))


def _meetings(keyed: DataFrame, least: float) -> DataFrame:
    """(key, id, k, left, sig): the keys by which a group meets others. left: members from the key's last on, and those before."""
    k = F.col("k")
    alone = F.slice("ordered", 1, (k - F.ceil(least * k - 1e-9) + 1).cast("int"))
    two = F.slice("ordered", 1, F.greatest(k - F.greatest(F.ceil(least * k - 1e-9), F.lit(2)) + 2, F.lit(0)).cast("int"))
    rare = F.transform(F.filter(alone, lambda m: m["n"] == 0), lambda m: F.struct(F.hash(m["contact"]).alias("key"), (k - m["i"]).cast("int").alias("left")))
    often = F.filter(two, lambda m: m["n"] > 0)
    pairs = F.flatten(F.transform("often", lambda x, i: F.transform(F.slice("often", i + 2, F.size("ordered")), lambda y: F.struct(F.hash(x["contact"], y["contact"]).alias("key"), (k - y["i"] + 1).cast("int").alias("left")))))
    rows = keyed.select("id", "k", "sig", "ordered", rare.alias("rare"), often.alias("often")).select("id", "k", "sig", F.explode(F.concat("rare", pairs)).alias("m"))
    return rows.select("m.key", "id", "k", "m.left", "sig")


def _single_meetings(keyed: DataFrame, least: float) -> DataFrame:
    """(a, b): groups that are alike enough by one shared member, as both are small; by member and both sizes."""
    most = math.floor((1 + least) / least + 1e-9)
    rows = keyed.where(F.col("k") < most).select("id", "k", F.explode("ordered.contact").alias("contact"))
    small = rows.select("contact", F.col("k").alias("ks"), F.explode(F.expr(f"filter(sequence(1, {most}), x -> x >= k and x + k <= {most})")).alias("kl"), F.col("id").alias("a"))
    large = rows.select("contact", F.explode(F.expr(f"filter(sequence(1, {most}), x -> x <= k and x + k <= {most})")).alias("ks"), F.col("k").alias("kl"), F.col("id").alias("b"))
    return small.join(large, ["contact", "ks", "kl"]).where((F.col("ks") < F.col("kl")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_pairs(groups: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard), a < b: groups of a Jaccard likeness of at least `least`.

    With the members of each group in one order, rare ones first, the first two members that groups share lie among their
    first k - overlap + 2. Groups meet by the first if it is rare, else by both, so a frequent member alone brings none
    together; only where one shared member is enough do small groups meet by any. What meets is compared by sizes, places
    and sets of 31 bits, all of which only rule out, and what is left by the members.
    """
    keyed = _keyed(groups)
    rows = _meetings(keyed, least)
    a, b = (rows.withColumnsRenamed({"id": x, "k": f"k{x}", "left": f"l{x}", "sig": f"s{x}"}) for x in "ab")
    needed = _overlap(least, F.col("ka"), F.col("kb"))
    near = (F.least("la", "lb") >= needed) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= F.col("ka") + F.col("kb") - 2 * needed)
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b")
    met = met.unionByName(_single_meetings(keyed, least)).distinct()
    ma, mb = (keyed.select(F.col("id").alias(x), F.col("group_id").alias(f"g{x}"), F.col("ordered.contact").alias(f"m{x}")) for x in "ab")
    shared = met.join(ma, "a").join(mb, "b").withColumn("c", F.size(F.array_intersect("ma", "mb")))
    jaccard = F.col("c") / (F.size("ma") + F.size("mb") - F.col("c"))
    return shared.withColumn("jaccard", jaccard).where((F.col("jaccard") >= least) & (F.col("ga") != F.col("gb"))).select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b"), F.round("jaccard", 6).alias("jaccard"))


def without_subsets(groups: DataFrame) -> DataFrame:
    return groups.join(containments(groups).select(F.col("small").alias("group_id")), "group_id", "left_anti")


def named(groups: DataFrame, volumes: DataFrame, names: DataFrame) -> DataFrame:
    """(group_id, label): the most prolific member, and how many more there are. volumes: contact, volume."""
    best = F.max(F.struct("volume", "contact"))
    top = groups.select("group_id", F.size("members").alias("k"), F.explode("members").alias("contact")).join(volumes, "contact").groupBy("group_id", "k").agg(best.alias("m"))
    label = F.when(F.col("k") > 1, F.concat("name", F.lit("+"), (F.col("k") - 1).cast("string"))).otherwise(F.col("name"))
    return top.select("group_id", "k", F.col("m.contact").alias("contact")).join(names.select("contact", "name"), "contact").select("group_id", label.alias("label"))


def by_group(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, n_docs) of the closest groups, and of messages without any (null)."""
    own = closest_group(found, groups)
    return found.select("doc_id").join(own, "doc_id", "left").groupBy("group_id").agg(F.count("*").alias("n_docs"))


def supergroups(groups: list[tuple[str, ...]], least: float = 0.35, overlap: int = 3) -> list[tuple[str, ...]]:
    """Unites the two most alike groups until none are alike enough or share enough people. For a bounded list of groups."""
    now = sorted({tuple(sorted(set(g))) for g in groups})
    while True:
        rated = [(len(set(a) & set(b)) / len(set(a) | set(b)), len(set(a) & set(b)), a, b) for i, a in enumerate(now) for b in now[i + 1 :]]
        good = [r for r in rated if r[0] >= least or r[1] >= overlap]
        if not good:
            return now
        _, _, a, b = max(good, key=lambda r: (r[0], r[1], tuple(r[2]), tuple(r[3])))
        now = sorted({g for g in now if g not in (a, b)} | {tuple(sorted({*a, *b}))})


def likeness_order(groups: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Groups in depth-first order, the most alike unvisited group next. For a bounded list of groups."""
    todo, out = sorted(groups), []
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    while todo:
        now = todo.pop(0) if not out or max(like(out[-1], g) for g in todo) == 0 else todo.pop(max(range(len(todo)), key=lambda i: (like(out[-1], todo[i]), -i)))
        out.append(now)
    return out


def greedy(groups: list[tuple[tuple[str, ...], float]], n: int, error: float = 0.4, affinity: dict[tuple[str, str], float] | None = None) -> list[tuple[tuple[str, ...], float]]:
    """Reduces weighted groups to n by the cheapest moves: unite two, keep what two share, or drop one.

    Costs: a union pays for the people that each side lacks, an intersection for those that are lost, a drop the value.
    Unions and intersections need two shared people. Runs on the few hundred heaviest groups, on one machine by nature.
    """
    now = {tuple(sorted(set(g))): v for g, v in groups}
    near = affinity or {}

    def kinship(a: set[str], b: set[str]) -> float:
        pairs = [near.get((min(x, y), max(x, y)), 0.0) for x in a - b for y in b - a]
        return sum(pairs) / len(pairs) if pairs else 0.0

    def moves(a: tuple[str, ...], b: tuple[str, ...]):
        sa, sb = set(a), set(b)
        shared, va, vb = len(sa & sb), now[a], now[b]
        if shared < 2:
            return
        only_a, only_b = len(sa) - shared, len(sb) - shared
        yield error * (vb * only_a / len(sb) + va * only_b / len(sa)) * (1 - kinship(sa, sb)), 0, tuple(sorted(sa | sb)), va + vb
        yield va + vb - (va * shared / len(sa) + vb * shared / len(sb)), 2, tuple(sorted(sa & sb)), va * shared / len(sa) + vb * shared / len(sb)

    while len(now) > n:
        options = [(v, 3, (), 0.0, (g,)) for g, v in now.items()]
        keys = sorted(now)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                options += [(*m, (a, b)) for m in moves(a, b)]
        _, _, new, value, gone = min(options, key=lambda o: (o[0], o[1], o[4]))
        for g in gone:
            now.pop(g)
        if new:
            now[new] = now.get(new, 0.0) + value
    return sorted(now.items(), key=lambda g: (-g[1], g[0]))


def greedy_groups(distinct_baskets: DataFrame, candidates: int, n: int) -> DataFrame:
    """greedy over the heaviest baskets (a bounded number), as a table (group_id, members, value)."""
    top = top_groups(distinct_baskets, candidates)

    def run(batches):
        import pandas as pd

        frames = list(batches)
        rows = pd.concat(frames) if frames else pd.DataFrame(columns=["members", "weight"])
        found = greedy([(tuple(m), float(w)) for m, w in zip(rows["members"], rows["weight"])], n)
        yield pd.DataFrame({"group_id": range(len(found)), "members": [list(g) for g, _ in found], "value": [v for _, v in found]})

    return top.select("members", "weight").coalesce(1).mapInPandas(run, "group_id int, members array<string>, value double")
