"""A query language over postings: one parser, one boolean tree, hits and scores by one pass over the query's terms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<op>AND\b|OR\b|NOT\b|&&|\|\||[|+!-])|(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()"|]+)))')


@dataclass
class Leaf:
    """Words with their places; one word may hold the wildcards * and ?. Without a field every field counts."""

    words: list[tuple[int, str]]
    where: str | None = None


@dataclass
class Group:
    """Clauses with `+` (must hold), `-` (must not) or an empty sign (one of them must hold if there is no `+`)."""

    clauses: list[list] = field(default_factory=list)


def _leaf(text: str, where: str | None, stop_words: frozenset[str], phrase: bool) -> Leaf | None:
    if not phrase and re.search(r"[*?]", text):
        return Leaf([(0, text.lower())], where)
    found = re.findall(r"[^\W_]+", re.sub(r"['’]s\b", "", text.lower()))
    words = [(i, w) for i, w in enumerate(found) if w not in stop_words]  # a stop word leaves a gap, in text and phrase
    return Leaf([(i - words[0][0], w) for i, w in words], where) if words else None


def parsed(query: str, stop_words: frozenset[str] = frozenset()) -> Group:
    """The tree of a query: words, "phrases", field:word, th*s, +must, -never, NOT, AND, OR, | and brackets.

    Clauses beside each other are alternatives. AND makes both of its sides needed, NOT and - forbid. Stop words are no
    clauses; in a phrase they stand for any word. Brackets that do not match are closed or passed over.
    """
    stack, sign, joined, at = [Group()], "", False, 0
    signs = [""]
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            at += 1
            continue
        at = m.end()
        op = m["op"]
        if op in ("AND", "&&"):
            joined = True
            if stack[-1].clauses and stack[-1].clauses[-1][0] == "":
                stack[-1].clauses[-1][0] = "+"
        elif op in ("+", "-", "!", "NOT"):
            sign = "+" if op == "+" else "-"
        elif op:
            joined = False
        elif m["open"]:
            stack.append(Group())
            signs.append(sign or ("+" if joined else ""))
            sign, joined = "", False
        elif m["close"]:
            if len(stack) > 1:
                group, own = stack.pop(), signs.pop()
                if group.clauses:
                    stack[-1].clauses.append([own, group])
        else:
            part = _leaf(m["phrase"] if m["phrase"] is not None else m["word"], m["field"], stop_words, m["phrase"] is not None)
            if part:
                stack[-1].clauses.append([sign or ("+" if joined else ""), part])
            sign, joined = "", False
    while len(stack) > 1:
        group, own = stack.pop(), signs.pop()
        if group.clauses:
            stack[-1].clauses.append([own, group])
    return stack[0]


def _leaves(node: Group | Leaf) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for _, c in node.clauses for x in _leaves(c)]


def _test(node: Group | Leaf, has: dict[int, Column]) -> Column:
    if isinstance(node, Leaf):
        return has[id(node)]
    must = [_test(c, has) for s, c in node.clauses if s == "+"]
    some = [_test(c, has) for s, c in node.clauses if s == ""]
    out = F.lit(bool(must or some))
    for t in must:
        out = out & t
    if some and not must:
        one = F.lit(False)
        for t in some:
            one = one | t
        out = out & one
    for t in (_test(c, has) for s, c in node.clauses if s == "-"):
        out = out & ~t
    return out


def _word_test(word: str, wild: bool) -> Column:
    if not wild:
        return F.col("term") == word
    return F.col("term").rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in word) + "$")


def found_by(postings: DataFrame, query: str, stop_words: frozenset[str] = frozenset(), key: str = "doc_id") -> DataFrame:
    """(key, tf): documents that a query finds, with how often each of its leaves occurs in them (an array, in order).

    postings: key, term, pos, and field if the query names fields. Only the postings of the query's words are read. An
    occurrence of a leaf has all of its words at their places; it is counted by one aggregate over (document, leaf,
    start), so a phrase needs no join. A query that only forbids finds nothing.
    """
    tree = parsed(query, stop_words)
    leaves = _leaves(tree)
    if not leaves:
        return postings.select(key, F.array().cast("array<bigint>").alias("tf")).where("false")
    has_field = "field" in postings.columns
    wanted, parts = F.lit(False), []
    for i, leaf in enumerate(leaves):
        for n, (offset, word) in enumerate(leaf.words):
            test = _word_test(word, len(leaf.words) == 1 and bool(re.search(r"[*?]", word)))
            if leaf.where is not None:
                test = test & ((F.col("field") == leaf.where) if has_field else F.lit(False))
            wanted = wanted | test
            parts.append(F.when(test, F.struct(F.lit(i).alias("leaf"), F.lit(n).alias("part"), (F.col("pos") - offset).alias("start"))))
    place = [key, "field"] if has_field else [key]
    rows = postings.where(wanted).select(*place, F.explode(F.array_compact(F.array(*parts))).alias("p")).select(*place, "p.*")
    size = F.element_at(F.array(*[F.lit(len(x.words)) for x in leaves]), F.col("leaf") + 1)
    whole = rows.groupBy(*place, "leaf", "start").agg(F.countDistinct("part").alias("n")).where(F.col("n") == size)
    counts = whole.groupBy(key).agg(*[F.count_if(F.col("leaf") == i).alias(f"_{i}") for i in range(len(leaves))])
    has = {id(x): F.col(f"_{i}") > 0 for i, x in enumerate(leaves)}
    return counts.where(_test(tree, has)).select(key, F.array(*[F.col(f"_{i}") for i in range(len(leaves))]).alias("tf"))


def scored(hits: DataFrame, n_docs: int, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """(key, score) of what `found_by` returns, best first: the sum over leaves of sqrt(tf) * (1 + ln(n_docs / (df + 1)))^2.

    df counts the hits that have the leaf. most: only so many of the best are kept (ties by key).
    """
    leaf = hits.select(F.posexplode("tf").alias("leaf", "n")).groupBy("leaf").agg(F.count_if(F.col("n") > 0).alias("df"))
    idf = leaf.agg(F.map_from_entries(F.collect_list(F.struct("leaf", F.pow(1 + F.log(F.lit(float(n_docs)) / (F.col("df") + 1)), 2)))).alias("idf"))  # one row, an entry for each leaf
    each = F.transform("tf", lambda n, i: F.sqrt(n) * F.get(F.map_values(F.map_filter("idf", lambda k, _: k == i)), F.lit(0)))
    out = hits.crossJoin(F.broadcast(idf)).select(key, F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 6).alias("score")).orderBy(F.desc("score"), key)
    return out.limit(most) if most is not None else out


def field_postings(docs: DataFrame, fields: dict[str, str], postings_of, key: str = "doc_id") -> DataFrame:
    """(key, field, term, pos) of several columns: fields maps the names that queries use to columns of docs."""
    parts = [postings_of(docs.select(key, F.col(column)), column).withColumn("field", F.lit(name)) for name, column in fields.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
